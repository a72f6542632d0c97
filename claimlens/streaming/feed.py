"""The enforcement feed: increments of releases as a stream, each once, the latest version of each, several sources of
one event collapsed, and what was processed before left out. Windows over events are an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.keys import event_key
from claimlens.operators.ranking import best_row
from claimlens.session import exists

SCHEMA = "source string, source_id string, url string, source_url string, title string, published date, category string, district string, state string, body string, fetched_at timestamp"
PREFERRED = "DOJ"


def read_feed(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """The folder of JSON lines as a stream; the checkpoint remembers which files were read."""
    r = spark.readStream.schema(SCHEMA)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).json(path)


def once(stream: DataFrame, overlap: str = "3 days") -> DataFrame:
    """Each source_id once within the overlap that a restarted fetch covers again; state beyond it is dropped."""
    return stream.withColumn("published_ts", F.col("published").cast("timestamp")).withWatermark("published_ts", overlap).dropDuplicatesWithinWatermark(["source_id"])


def latest(df: DataFrame) -> DataFrame:
    """The version of each source_id fetched last."""
    return best_row(df, ["source_id"], F.struct(F.coalesce("fetched_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))), largest=True)


def collapse(df: DataFrame, preferred: str = PREFERRED) -> DataFrame:
    """One release per event: that of the preferred source, else the one with the longest body."""
    x = df.withColumn("event_key", event_key("source_url", "url")).where("event_key is not null")
    return best_row(x, ["event_key"], F.struct((F.col("source") == preferred), F.length(F.coalesce("body", F.lit(""))), F.col("source_id")), largest=True)


def new_events(df: DataFrame, done: DataFrame) -> DataFrame:
    return df.join(done.select("event_key").distinct(), "event_key", "left_anti")


def run(stream: DataFrame, store: str, checkpoint: str):
    """Process what there is: each micro-batch appends its new events to the store, leaving out those already there, so
    a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = collapse(latest(batch))
        if exists(spark, f"{store}/_SUCCESS"):  # written once a batch has been stored; only the keys are read
            fresh = new_events(fresh, spark.read.parquet(store).select("event_key"))
        fresh.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since(spark: SparkSession, store: str, overlap_days: int = 3, daily_days: int | None = None, today: str | None = None):
    """The day from which releases are fetched again: the newest stored one's less the overlap; in the daily mode today less
    so many days; None for an empty store, so everything is fetched."""
    if daily_days is not None:
        return spark.range(1).select(F.date_sub(F.lit(today).cast("date") if today else F.current_date(), daily_days)).first()[0]
    if not exists(spark, f"{store}/_SUCCESS"):
        return None
    return spark.read.parquet(store).agg(F.date_sub(F.max("published"), overlap_days)).first()[0]


def chain(steps: list[tuple[str, Callable[[], object]]], publish: Callable[[], object]) -> list[str]:
    """Run the steps in order and publish at the end; the first failure stops the chain, so nothing half done is published.
    Returns the names of what ran."""
    done = []
    for name, step in steps:
        step()
        done.append(name)
    publish()
    return [*done, "publish"]


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; works on streams and tables."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_c")).select(F.col("w.start").alias("start"), "event_type", "n", "value_c")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
