"""Readers: Parquet, delimited text, JSON lines, tables of text patterns, nested bundles, with declared schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delimited(spark: SparkSession, path, sep: str = ",", encoding: str = "UTF-8", quote: str = '"', escape: str = '"', multi_line: bool = False, skip_malformed: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Text with a header, every column a string; types come later, by projection. With skip_malformed, rows whose
    number of values differs from the header's are left out."""
    r = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("encoding", encoding).option("quote", quote).option("escape", escape).option("multiLine", multi_line)
    if skip_malformed:
        r = r.option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema else r).csv(path)


def json_lines(spark: SparkSession, path, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted; through Spark's file systems, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def union_files(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """Files (a list of paths, or a pattern) with different columns, aligned by name, with the file's name and the year that
    it has (20xx). Files with the same header are read together, so a thousand alike make one branch of the plan."""
    found = files(spark, paths) if isinstance(paths, str) else paths
    if not found:
        raise FileNotFoundError(str(paths))
    alike: dict[tuple, list[str]] = {}
    for p in found:
        alike.setdefault(tuple(delimited(spark, p, sep).columns), []).append(p)
    out = None
    for group in alike.values():
        x = delimited(spark, group, sep).withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.withColumn("file_year", F.regexp_extract("filename", r"(20\d\d)", 1).try_cast("int"))


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with each column (name: type) that it lacks, null."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast(t) for n, t in wanted.items() if n.lower() not in have})


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    import re

    return [c for c in df.columns if re.search(pattern, c)]


def project(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """name -> source column; a column that the file doesn't have is null. Names are matched without case."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(f"`{have[s.lower()]}`").alias(n) if s.lower() in have else F.lit(None).cast("string").alias(n) for n, s in wanted.items()))


def table_or_empty(spark: SparkSession, name: str, schema: str | T.StructType) -> DataFrame:
    """The catalogue's table or view, or no rows of its declared schema."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def newest(spark: SparkSession, pattern: str) -> str:
    """The path that sorts last among those that match."""
    names = files(spark, pattern)
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def lines_by_pattern(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Rows of text lines that fit a pattern, a column for each of its groups."""
    x = spark.read.text(path).where(F.col("value").rlike(pattern))
    return x.select(*(F.trim(F.regexp_extract("value", pattern, i + 1)).alias(n) for i, n in enumerate(names)))


def repaired_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines decoded as UTF-8 where they are valid, else as cp1252 (undefined bytes become the replacement character).
    The file is split into lines by Spark; each line is decoded on its own."""
    raw = spark.read.option("encoding", "ISO-8859-1").option("charset", "ISO-8859-1").format("csv").option("sep", "\u0001").option("quote", "").option("escape", "").schema("value string").load(path)

    def fix(batches):
        for x in batches:
            out = []
            for v in x.column(0).to_pylist():
                b = (v or "").encode("latin-1")
                try:
                    out.append(b.decode("utf-8"))
                except UnicodeDecodeError:
                    out.append(b.decode("cp1252", "replace"))
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    return raw.mapInArrow(fix, "value string")


_CODES = "coding: array<struct<system: string, code: string>>"
_ID = f"identifier: struct<system: string, value: string, type: struct<{_CODES}>>"
BUNDLE = (
    f"entry array<struct<resource: struct<resourceType: string, id: string, type: struct<{_CODES}>, billablePeriod: struct<start: string, `end`: string>, "
    f"careTeam: array<struct<provider: struct<{_ID}>>>, provider: struct<{_ID}>, contained: array<struct<identifier: array<struct<system: string, value: string, type: struct<{_CODES}>>>>>, "
    f"payment: struct<amount: struct<value: double>>, total: array<struct<category: struct<{_CODES}>, amount: struct<value: double>>>, diagnosis: array<struct<diagnosisCodeableConcept: struct<{_CODES}>>>, "
    f"item: array<struct<productOrService: struct<{_CODES}>, adjudication: array<struct<category: struct<{_CODES}>, amount: struct<value: double>>>>>>>>"
)
# Codes of totals and of line amounts that are payments; how many codes a claim shows.
PAID_TOTALS = ("benefit", "paidtoprovider", "paidbyinsurer")
PAID_LINES = ("benefit", "paidtoprovider")
MAX_CODES, MAX_DIAGNOSES = 12, 6


def claims_from_bundles(df: DataFrame, column: str) -> DataFrame:
    """Benefit bundles (JSON text) as claims: id, type, start, end, npis, paid, codes, diagnoses. The type is the code of the
    eob-type system, else the first; numbers are those of the care team, the provider and contained parties that say they
    are NPIs (the care team's also if they say nothing); paid is the payment, else the first total that is one, else the sum
    of the lines' amounts that are, null if that is zero."""
    r = F.col("r")
    none = lambda c: F.coalesce(c, F.array())
    first = lambda concept: F.get(concept["coding"], F.lit(0))["code"]
    x = df.select(F.explode(F.from_json(column, BUNDLE)["entry"]["resource"]).alias("r")).where(r["resourceType"] == "ExplanationOfBenefit")
    shape = lambda i: F.coalesce(i["value"].rlike("^[0-9]{10}$"), F.lit(False))
    by_system = lambda i: F.coalesce(F.lower(i["system"]).contains("npi"), F.lit(False))
    by_code = lambda i: F.coalesce(F.lower(first(i["type"])) == "npi", F.lit(False))
    team = F.filter(F.transform(none(r["careTeam"]), lambda t: t["provider"]["identifier"]), lambda i: shape(i) & (by_system(i) | by_code(i) | (F.coalesce(first(i["type"]), F.lit("")) == "")))
    own = F.filter(F.array(r["provider"]["identifier"]), lambda i: shape(i) & by_system(i))
    held = F.filter(F.flatten(F.transform(none(r["contained"]), lambda c: F.coalesce(c["identifier"], F.array()))), lambda i: shape(i) & (by_system(i) | by_code(i)))
    npis = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.transform(a, lambda i: i["value"]) for a in (team, own, held))))))
    kinds = F.filter(none(r["type"]["coding"]), lambda c: F.coalesce(c["system"].contains("eob-type"), F.lit(False)))
    kind = F.coalesce(F.get(kinds, F.lit(0))["code"], first(r["type"]))
    total = F.get(F.filter(none(r["total"]), lambda t: first(t["category"]).isin(*PAID_TOTALS)), F.lit(0))
    amounts = F.flatten(F.transform(none(r["item"]), lambda i: none(i["adjudication"])))
    lines = F.filter(amounts, lambda a: F.coalesce(first(a["category"]).isin(*PAID_LINES) | first(a["category"]).endswith("_pmt_amt"), F.lit(False)))
    summed = F.round(F.aggregate(lines, F.lit(0.0), lambda acc, a: acc + F.coalesce(a["amount"]["value"], F.lit(0.0))), 2)
    paid = F.coalesce(r["payment"]["amount"]["value"], F.when(total.isNotNull(), F.coalesce(total["amount"]["value"], F.lit(0.0))), F.nullif(summed, F.lit(0.0)))
    codes = F.filter(F.flatten(F.transform(none(r["item"]), lambda i: F.transform(none(i["productOrService"]["coding"]), lambda c: c["code"]))), lambda c: c.isNotNull() & (c != ""))
    diagnoses = F.slice(F.transform(none(r["diagnosis"]), lambda d: first(d["diagnosisCodeableConcept"])), 1, MAX_DIAGNOSES)
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    return x.select(r["id"].alias("id"), kind.alias("type"), day(r["billablePeriod"]["start"]).alias("start"), day(r["billablePeriod"]["end"]).alias("end"), npis.alias("npis"), paid.alias("paid"), F.slice(codes, 1, MAX_CODES).alias("codes"), diagnoses.alias("diagnoses"))


def strip_html(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(F.regexp_replace(c, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
