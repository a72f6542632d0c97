"""Exact dedup by progressive refinement: group by length, then by prefix hash, then by full hash; the full content
is hashed only for rows whose length and prefix hash another row has too.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space; null counts as empty. Groups
are found by aggregates that combine before the shuffle and are written; the joins back broadcast them if they are few,
else they are sort-merge joins, whose large keys Spark splits, so a group may hold any share of the rows. Texts are
read twice: once for lengths and prefixes, once for the full hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.common import documents
from claimlens.session import BROADCAST_ROWS, counted, discard, materialize

PREFIX_CHARS = 256


def normalised(text: str) -> Column:
    # a single space stays as it is, so it need not match
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    base = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("t"))
    return base.select("doc_id", F.length("t").cast("long").alias("length"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix_hash"), "t")


def _hashed(docs: DataFrame, doc_id: str, text: str, every: bool) -> DataFrame:
    """doc_id, length, prefix_hash, full_hash and again (whether another row has the same length and prefix hash, else
    null) of every row, written. full_hash is null where again is, unless every is set."""
    keys = materialize(_keyed(docs, doc_id, text).select("length", "prefix_hash"), "exact-keys")
    by_length, _ = counted(keys.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length"), "exact-lengths")
    # grouped by one struct, so that rows are counted per task before they are dealt anew, not where the join put a length
    by_prefix = keys.join(by_length, "length", "left_semi").groupBy(F.struct("length", "prefix_hash").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    again, n = counted(by_prefix.select("k.length", "k.prefix_hash", F.lit(True).alias("again")), "exact-again")
    rows, digest = _keyed(docs, doc_id, text), F.sha2(F.col("t").cast("binary"), 256)
    if n > BROADCAST_ROWS:  # the rows are dealt by their keys, and a digest is lighter to send than a text
        rows, digest = rows.withColumn("t", digest), F.col("t")
    wanted = digest if every else F.when(F.col("again"), digest)
    hashed = materialize(rows.join(again, ["length", "prefix_hash"], "left").select("doc_id", "length", "prefix_hash", "again", wanted.alias("full_hash")), "exact-hashed")
    discard(keys, by_length, again)
    return hashed


def _groups(hashed: DataFrame) -> DataFrame:
    """length, full_hash, keep_id, group_size and firsts (how many rows have keep_id) of the texts that rows share."""
    by_id = hashed.where("again").groupBy("length", "full_hash", "doc_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    return by_id.groupBy("length", "full_hash").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.min_by("n", order).alias("firsts"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, length, prefix_hash, full_hash (null for rows that the first two tell
    apart, unless every is set), keep_id (smallest doc_id of the equal texts), group_size. Rows that repeat a doc_id
    count each; a null doc_id is larger than any other. Other columns aren't read."""
    hashed = _hashed(docs, doc_id, text, every)
    groups, _ = counted(_groups(hashed).drop("firsts"), "exact-groups")
    same = hashed.where("again").join(groups, ["length", "full_hash"]).select("doc_id", "length", "prefix_hash", "full_hash", "keep_id", "group_size")
    alone = hashed.where("again is null").select("doc_id", "length", "prefix_hash", "full_hash", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return same.unionByName(alone)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, one with the smallest doc_id, for each group of equal texts; columns and their order stay. Rows
    are told apart by doc_id and text, so a row stays whatever other rows of its doc_id (or without one) hold. Of
    several rows with the smallest doc_id and equal texts the one with the smallest hash over all columns stays."""
    hashed = _hashed(docs, doc_id, text, False)
    dups, _ = counted(_groups(hashed).where("group_size > 1").drop("group_size"), "exact-groups")
    discard(hashed)
    t = normalised(text)
    # the texts of one group may be any share of the rows; Spark splits such a key, as its other side is just a scan
    both = docs.join(dups, (F.length(t).cast("long") == dups["length"]) & (F.sha2(t.cast("binary"), 256) == dups["full_hash"]), "left")
    first = docs[doc_id].eqNullSafe(dups["keep_id"])
    kept = both.where(dups["full_hash"].isNull() | (first & (dups["firsts"] == 1))).select(docs["*"])
    if not dups.where("firsts > 1").limit(1).count():
        return kept
    again = both.where(first & (dups["firsts"] > 1)).select(F.struct(docs["*"]).alias("__row"), dups["full_hash"].alias("__hash"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("__order"))
    return kept.unionByName(again.groupBy("__hash").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract wants every row's digest, also of those that the refinement need not hash
    found = exact_duplicates(documents(spark, sf_dir), every=True)
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("full_hash").alias("text_sha256"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY 1
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
