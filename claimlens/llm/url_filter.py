"""URL filter: rules by host and path prefix, and a list of canonical URLs behind a blocked Bloom filter whose
possible hits go to an exact hash join.

A list entry is a canonical URL or stands for all URLs of a host or folder, so a url is looked up by its expressions: each
suffix of its host with each folder of its path, with the path, and with path and query; as deep as the list's entries
are, which are counted first. The filter's blocks are built by an aggregate (bit-or by block); it has BITS_PER_URL bits for
each entry and at most FILTER_BLOCKS * 64 bytes, which bounds the broadcast whatever the list's size: full bits for 33
million entries. Beyond that fewer bits an entry let more expressions pass (about 2 % at twice as many, 15 % at four
times) to the exact join, a shuffle of distinct urls' expressions, so a url on any share of the pages is joined once."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import counted, materialize

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
FILTER_BLOCKS = 1 << 20
BITS_PER_URL = 16
HASHES = 6
LIST = Path(__file__).with_name("blocklist.txt")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with __rest, __host and __path: what follows the first ://, its host with A-Z lower-cased, and its path up
    to ? or #; all empty for null or no ://."""
    rest = _rest(F.col("__url"))
    df = df.withColumn("__url", F.coalesce(F.col(url), F.lit(""))).withColumn("__rest", rest).drop("__url")
    host = F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), _UPPER, _LOWER)
    return df.withColumn("__host", host).withColumn("__path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))


def canonical_parts() -> tuple[Column, Column, Column]:
    """Of __host, __path and __rest: host without www. and a port, path without closing slashes, sorted query without
    tracking parameters and its ?; no scheme and no fragment."""
    host = F.regexp_replace(F.regexp_replace("__host", r"^www\.", ""), r":[0-9]*$", "")
    query = F.split(F.regexp_extract("__rest", r"^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(TRACKING))), "&")
    return host, F.regexp_replace("__path", r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def rule_for(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits __host and __path; null if none does. A rule is its host and the
    path that the url's path starts with; it fits the host and its subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first
        host, slash, path = name.partition("/")
        fits = ((F.col("__host") == host) | F.col("__host").endswith("." + host)) & F.col("__path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash the positions, within a block of 512 bits, of its HASHES bits."""
    x = h.astype(np.uint64)
    a = (x >> np.uint64(32)) & np.uint64(511)
    b = ((x >> np.uint64(41)) & np.uint64(511)) | np.uint64(1)
    return [(a + np.uint64(i) * b) & np.uint64(511) for i in range(HASHES)]


def _words(batches):
    """Bits of a partition's hashes: one row for each block it touches."""
    schema = pa.schema([("block", pa.int32()), *((f"w{i}", pa.int64()) for i in range(8))])
    for x in batches:
        h, n = x.column(0).to_numpy().view(np.uint64), x.column(1)[0].as_py() if len(x) else 1
        blocks, at = np.unique((h % np.uint64(n)).astype(np.int64), return_inverse=True)
        out = np.zeros((len(blocks), 8), np.uint64)
        for bit in _bits(h):
            np.bitwise_or.at(out, (at, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        yield pa.record_batch([pa.array(blocks, pa.int32()), *(pa.array(out[:, i].view(np.int64)) for i in range(8))], schema=schema)


def bloom(urls: DataFrame, column: str) -> np.ndarray:
    """A blocked Bloom filter of distinct urls, as a matrix of blocks by eight 64-bit words."""
    n = urls.count()
    blocks = max(1, min(FILTER_BLOCKS, -(-n * BITS_PER_URL // 512)))
    words = ", ".join(f"w{i} long" for i in range(8))
    rows = urls.select(F.xxhash64(column).alias("h"), F.lit(blocks).alias("n")).mapInArrow(_words, f"block int, {words}")
    rows = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toArrow()
    out = np.zeros((blocks, 8), np.uint64)
    if rows.num_rows:
        out[rows.column("block").to_numpy()] = np.stack([rows.column(f"w{i}").to_numpy().view(np.uint64) for i in range(8)], axis=1)
    return out


def _possible(shared):
    """shared: the filter, broadcast."""

    def test(batches):
        filter_ = shared.value
        for x in batches:
            h = x.column(0).to_numpy().view(np.uint64)
            words = filter_[(h % np.uint64(len(filter_))).astype(np.int64)]
            hit = np.ones(len(h), bool)
            for bit in _bits(h):
                hit &= (words[np.arange(len(h)), (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            yield x.filter(pa.array(hit))

    return test


def expressions(host: Column, path: Column, query: Column, labels: Column, folders: Column) -> Column:
    """What a list may call a url: each suffix of its host of at most `labels` labels, with each of its folders of at most
    `folders` names (the root, and the path itself, among them), with its path, and with path and query."""
    names, steps = F.split(host, r"\."), F.split(path, "/")
    n = F.size(names)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, labels)), lambda k: F.array_join(F.slice(names, n - k + 1, k), "."))
    below = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), folders + 1)), lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))
    paths = F.array_distinct(F.concat(below, F.array(path, F.concat(path, query))))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct urls (canonical host, path, query) that are listed: those of which an expression passes the filter and
    is found in the list itself, whose column is canonical."""
    listed = materialize(listed.select("canonical").where("canonical is not null").distinct(), "url-list")
    deep = listed.agg(F.coalesce(F.max(F.size(F.split(F.split_part("canonical", F.lit("/"), F.lit(1)), r"\."))), F.lit(1)).alias("labels"), F.coalesce(F.max(F.size(F.split("canonical", "/"))), F.lit(1)).alias("folders")).first()
    urls = urls.select("host", "path", "query").distinct()
    asked = urls.select("host", "path", "query", F.explode(expressions(F.col("host"), F.col("path"), F.col("query"), F.lit(deep.labels), F.lit(deep.folders))).alias("canonical"))
    asked = asked.select(F.xxhash64("canonical").alias("h"), "host", "path", "query", "canonical")
    shared = urls.sparkSession.sparkContext.broadcast(bloom(listed, "canonical"))
    found = asked.mapInArrow(_possible(shared), "h long, host string, path string, query string, canonical string").drop("h")
    return found.join(listed.hint("shuffle_hash"), "canonical", "left_semi").select("host", "path", "query").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, canonical, rule, verdict of every row of pages. listed has a column canonical (repeats and
    nulls allowed). The longest rule that fits decides; without one, listed urls are blocked and others allowed. Null
    urls and those without :// have empty parts, no rule and are allowed. Other columns aren't read."""
    base = parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    rule, verdict = rule_for(rules)
    c_host, c_path, c_query = canonical_parts()
    base = base.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), c_host.alias("c_host"), c_path.alias("c_path"), c_query.alias("c_query"), rule.alias("rule"), verdict.alias("ruled"))
    hits = listed_urls(base.where("rule is null and c_host != ''").select(F.col("c_host").alias("host"), F.col("c_path").alias("path"), F.col("c_query").alias("query")), listed)
    # only urls without a rule need the list; written first, so that Spark can split the join where one url is hot
    hits, _ = counted(hits.select(F.col("host").alias("c_host"), F.col("path").alias("c_path"), F.col("query").alias("c_query"), F.lit(True).alias("listed")), "url-hits")
    base = base.join(hits, ["c_host", "c_path", "c_query"], "left")
    return base.select("page_id", "host", "path", F.concat("c_host", "c_path", "c_query").alias("canonical"), "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def read_list(path: Path = LIST) -> list[str]:
    """The entries of a list's file: its lines but for empty ones and comments."""
    return [x for x in map(str.strip, path.read_text().splitlines()) if x and not x.startswith("#")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame([(x,) for x in read_list()], "canonical string")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS q
  FROM r
), c AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^www\.', ''), ':[0-9]*$', '') AS c_host, regexp_replace(path, '/+$', '') AS c_path,
    CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS c_query FROM p
), l(canonical) AS (VALUES LISTED
), e AS (
  SELECT page_id, c_host, c_path, c_query, string_split(c_host, '.') AS n, string_split(c_path, '/') AS s FROM c WHERE c_host <> ''
), x AS (
  SELECT page_id, c_path, c_query, s, unnest(list_transform(range(1, len(n) + 1), lambda k: array_to_string(n[k:], '.'))) AS h FROM e
), y AS (
  SELECT page_id, h, unnest(list_concat(list_transform(range(1, len(s) + 1), lambda k: array_to_string(s[:k], '/') || '/'), [c_path, c_path || c_query])) AS p FROM x
), hit AS (
  SELECT DISTINCT page_id FROM y WHERE h || p IN (SELECT canonical FROM l)
), f AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM c
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN page_id IN (SELECT page_id FROM hit) THEN 'block' ELSE 'allow' END AS verdict
FROM f
""".replace("LISTED", ", ".join(f"('{x}')" for x in read_list()))
