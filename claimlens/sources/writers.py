"""Sinks: replace, append, replace a slice, upsert, export, snapshots, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators import sets


def replace(df: DataFrame, path: str, compression: str = "zstd", partition: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", compression)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Replaces only the partitions that df has rows of, in a table partitioned by that column."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def upsert(df: DataFrame, path: str, keys: list[str]) -> str:
    """Merges df into the table at path as a new version beside it, and returns the version's path: readers of the old
    one aren't disturbed, and a run that fails changes nothing."""
    spark = df.sparkSession
    merged = sets.upsert(spark.read.parquet(path), df, keys)
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    merged.write.parquet(new)
    return new


def append_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines added to a folder, null fields left out: what the feed's stream reads."""
    df.write.mode("append").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Truncates and fills a table of a database whose driver is on the class path."""
    df.write.format("jdbc").mode("overwrite").option("truncate", True).options(url=url, dbtable=table, **options).save()


def snapshot(df: DataFrame, order: list, limit: int) -> str:
    """The first rows of a small report as JSON text."""
    return "[" + ",".join(df.orderBy(*order).limit(limit).toJSON().collect()) + "]"


def summary(parts: dict[str, DataFrame], most: int = 1000) -> str:
    """Small aggregates as one JSON object; each part must have at most `most` rows."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} is no summary: over {most} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(out, default=str, sort_keys=True)


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    rows = df.limit(limit).collect()
    cells = [[("" if v is None else f"{v:,}" if isinstance(v, int) else str(v)) for v in r] for r in rows]
    return "\n".join("| " + " | ".join(c) + " |" for c in [df.columns, ["---"] * len(df.columns), *cells])


def replace_section(text: str, title: str, body: str) -> str:
    """A markdown text with the section of that title replaced, or added at its end."""
    head = f"## {title}"
    lines = text.split("\n")
    if head not in lines:
        return text.rstrip("\n") + f"\n\n{head}\n\n{body}\n"
    start = lines.index(head)
    end = next((i for i in range(start + 1, len(lines)) if lines[i].startswith("## ")), len(lines))
    return "\n".join([*lines[:start], head, "", body, "", *lines[end:]])


def with_time(df: DataFrame, when: str) -> DataFrame:
    """The time a run was given, so that runs are repeatable."""
    return df.withColumn("created_at", F.lit(when).cast("timestamp"))
