"""Fusion of detectors into tiers: the strongest finding decides, dollars are those of the detector that decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.keys import long_date, pretty_source
from claimlens.operators.ranking import best_row, global_rank

# Base score and name of each tier; limits of the umbrella test.
BASE = {1: 90, 2: 75, 3: 60, 4: 45}
OTHER_BASE = 25
UMBRELLA_PATIENTS = 500
UMBRELLA_RENDERERS = 30
CONCURRENT_ORGS = 3


def umbrella_size(pairs: DataFrame) -> DataFrame:
    """pairs: npi (who rendered) and billing, repeats allowed. Per npi the mean and the largest number of renderers of the
    organisations it is billed by: dozens of them make it a supervisor's number, not one person's hours."""
    pairs = pairs.select("npi", "billing").where("npi is not null and billing is not null").distinct()
    size = pairs.groupBy("billing").agg(F.count("*").alias("n"))
    return pairs.join(size, "billing").groupBy("npi").agg(F.avg("n").alias("avg_org_render"), F.max("n").alias("max_org_render"))


def volume_findings(volume: DataFrame, sizes: DataFrame, most_patients: int = UMBRELLA_PATIENTS, renderers: float = UMBRELLA_RENDERERS, concurrent: int = CONCURRENT_ORGS) -> DataFrame:
    """volume (npi, entity_type, impossible, over_cap, umbrella_months, implausible, orgs, max_patients, d2_c, ...) with a
    finding, with umbrella and d2_tier. A: over a cap, or impossible months of an organisation, or of a person billed by
    several organisations and no umbrella; B: other impossible months; C: umbrella volume or implausible hours."""
    x = volume.join(sizes, "npi", "left")
    umbrella = (F.col("max_patients") > most_patients) | (F.coalesce("avg_org_render", F.lit(0.0)) >= renderers)
    x = x.withColumn("umbrella", F.coalesce(umbrella, F.lit(False)))
    impossible = F.col("impossible") > 0
    several = impossible & (F.col("orgs") >= concurrent) & ~F.col("umbrella")
    tier = F.when((F.col("over_cap") > 0) | (impossible & (F.col("entity_type") == "2")) | several, "A").when(impossible, "B").when((F.col("umbrella_months") > 0) | (F.col("implausible") > 0), "C")
    return x.withColumn("d2_tier", tier).where("d2_tier is not null")


def enforcement_findings(matches: DataFrame, actions: DataFrame, footprint: DataFrame) -> DataFrame:
    """Releases resolved to numbers, per npi that the footprint (npi) has: whether adjudicated or alleged, the first date,
    actions and sources as text, url and title of the last. matches: npi, source_id, tier, action_type, source, event_dt,
    same_entity, confidence, is_subject, url, title; actions: source_id, category. A match counts if it is the same entity
    at high confidence, not known to be no subject, dated, and adjudicated or alleged."""
    ok = F.col("same_entity") & (F.col("confidence") == "high") & F.coalesce("is_subject", F.lit(True)) & F.col("event_dt").isNotNull() & F.col("tier").isin("adjudicated", "alleged")
    x = matches.where(ok).join(actions.select("source_id", "category"), "source_id").join(footprint.select("npi").distinct(), "npi", "left_semi")
    source = F.when(F.coalesce("category", F.lit("")).ilike("%State Enforcement%"), "STATE_AG").when(F.col("source") == "DOJ", "DOJ").otherwise("OIG")
    texts = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("event_dt", c)))
    return x.groupBy("npi").agg(
        F.max((F.col("tier") == "adjudicated").cast("int")).alias("enf_adjudicated"), F.max((F.col("tier") == "alleged").cast("int")).alias("enf_alleged"), F.min("event_dt").alias("enf_first"),
        texts(F.replace("action_type", F.lit("_"), F.lit(" ")), ", ").alias("enf_actions"), texts(source, ",").alias("enf_sources"), last("url").alias("enf_url"), last("title").alias("enf_title"),
    )


def exposure(months: DataFrame, count: int = 12) -> DataFrame:
    """npi and what it was paid in the last `count` observed months of all (npi, month_start, paid_c)."""
    last = F.broadcast(months.agg(F.add_months(F.max("month_start"), 1 - count).alias("__from")))  # one row
    return months.join(last, F.col("month_start") >= F.col("__from")).groupBy("npi").agg(F.sum("paid_c").alias("exposure_c"))


def fuse(listed: DataFrame, volume: DataFrame, network: DataFrame, points: DataFrame, enforcement: DataFrame, exposed: DataFrame) -> DataFrame:
    """One row per npi that a detector names (a network only if eligible): tier, tier_label, corroboration, dollars,
    detectors. Inputs: listed (d3_a, d3_c, ...), volume (see volume_findings), network (d1_eligible, d1_label, d1_c, d1_rank,
    cluster; of several rows the eligible one with the best rank counts), points, enforcement and exposed (see
    above), all by npi. An adjudicated release corroborates only where no list documents the provider already, since a
    listing follows the conviction it cites. Growth ratios never stand in for dollars."""
    network = best_row(network, ["npi"], F.struct(~F.col("d1_eligible"), "d1_rank", "cluster"))
    a, b, c, d = (x.withColumn(f"__{n}", F.lit(True)) for x, n in ((listed, "d3"), (volume, "d2"), (network, "d1"), (enforcement, "enf")))
    spine = listed.select("npi").union(volume.select("npi")).union(network.where("d1_eligible").select("npi")).union(enforcement.select("npi")).distinct()
    x = spine.join(a, "npi", "left").join(b, "npi", "left").join(c, "npi", "left").join(d, "npi", "left").join(points, "npi", "left").join(exposed, "npi", "left")
    sure = lambda e: F.coalesce(e, F.lit(False))
    is_a, is_2a, is_2b = (sure(e) for e in (F.col("d3_a") == 1, F.col("d2_tier") == "A", F.col("d2_tier") == "B"))
    ranked, labelled = sure(F.col("d1_eligible")), sure(F.col("d1_label") == 1)
    judged, charged = sure(F.col("enf_adjudicated") == 1), sure(F.col("enf_alleged") == 1)
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long")
    one = lambda e: e.cast("int")
    tier = F.when(is_a | judged, 1).when(is_2a, 2).when(ranked & labelled | charged, 3).when(ranked | is_2b, 4).otherwise(5)
    dollars = (
        F.when(is_a, zero("d3_c")).when(judged, zero("exposure_c")).when(is_2a, zero("d2_c")).when(ranked & labelled, zero("d1_c")).when(charged, zero("exposure_c"))
        .when(ranked | is_2b, F.greatest(F.when(ranked, zero("d1_c")).otherwise(0), F.when(is_2b, zero("d2_c")).otherwise(0))).otherwise(F.greatest(zero("d3_c"), zero("d2_c")))
    )
    label = (
        F.when(is_a, "documented action, then payment").when(judged, "adjudicated in a public enforcement record").when(is_2a, "impossible volume with concurrency").when(ranked & labelled, "network structure with a list link")
        .when(charged, "charged in a public enforcement record").when(ranked | is_2b, "structure or single-organization volume").otherwise("informational")
    )
    names = F.filter(F.array(*(F.when(F.col(f"__{n}"), n.upper()) for n in ("d3", "d2", "d1", "enf"))), lambda v: v.isNotNull())
    n_detectors = one(is_a) + one(is_2a | is_2b) + one(ranked) + one(sure(F.col("__enf")) & F.col("__d3").isNull())
    n_strong = one(is_a) + one(is_2a) + one(ranked) + one(judged & ~is_a)
    x = x.select("*", tier.alias("tier"), label.alias("tier_label"), n_detectors.alias("n_detectors"), n_strong.alias("n_strong"), dollars.alias("dollars_c"), names.alias("detectors"))
    return x.drop("__d3", "__d2", "__d1", "__enf").withColumn("points", F.coalesce("points", F.lit(0))).withColumn("exposure_c", zero("exposure_c"))


def risk_score() -> Column:
    """The tier's base, up to 16 for corroboration, up to 9 for size, and procedure points; at most 100."""
    base = F.lit(OTHER_BASE)
    for t, v in BASE.items():
        base = F.when(F.col("tier") == t, v).otherwise(base)
    return F.least(F.lit(100.0), base + F.least(F.lit(16), 8 * F.greatest(F.col("n_strong") - 1, F.lit(0))) + F.least(F.lit(9.0), F.log10(F.greatest(F.col("dollars_c") / 100, F.lit(1.0)))) + F.col("points"))


def ranked(fused: DataFrame) -> DataFrame:
    """fused with score, and rank by score, then dollars, then number."""
    x = fused.withColumn("score", risk_score())
    return global_rank(x, [F.col("score").desc(), F.col("dollars_c").desc(), F.col("npi")])


def _plural(c: Column, word: str) -> Column:
    return F.concat(c.cast("string"), F.when(c == 1, f" {word}").otherwise(f" {word}s"))


def _dollars(c: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.floor(F.col(c) / 100), 0))


def reason() -> Column:
    """A text made of the findings that hold."""
    lately = F.when(F.col("exposure_c") > 0, F.concat(F.lit(", paid "), _dollars("exposure_c"), F.lit(" in the last twelve months on file")))
    record = lambda word: F.concat(F.lit(f"{word} ("), "enf_actions", F.lit(") according to "), pretty_source("enf_sources"), F.lit(" of "), long_date("enf_first"))
    hours = F.concat(F.lit("More hours than a day holds in "), _plural(F.col("impossible"), "month"))
    return F.concat_ws(
        "; ",
        F.when(F.col("d3_a") == 1, F.concat(F.lit("Listed on "), pretty_source("d3_sources"), F.lit(" since "), long_date("d3_first"), F.lit(", then paid in "), _plural(F.col("d3_months"), "later month"), F.lit(", "), _dollars("d3_c"), F.lit(" in total"))),
        F.when(F.col("enf_adjudicated") == 1, F.concat(record("Adjudicated"), F.when(F.coalesce("d3_a", F.lit(0)) == 1, "").otherwise(F.coalesce(lately, F.lit(", not paid in the last twelve months on file")))))
        .when(F.col("enf_alleged") == 1, F.concat(record("Charged"), F.lit(", not adjudicated"), F.coalesce(lately, F.lit("")))),
        F.when(F.col("d2_tier") == "A", F.when(F.col("impossible") > 0, F.concat(hours, F.lit(", billed by "), _plural(F.col("orgs"), "organization"))))
        .when((F.col("d2_tier") == "B") & F.col("umbrella"), F.concat(hours, F.lit(", with up to "), F.col("max_patients").cast("string"), F.lit(" patients a month: likely a supervisor's number, records needed")))
        .when(F.col("d2_tier") == "B", F.concat(hours, F.lit(" under few organizations: possibly supervised staff, records needed"))),
        F.when(F.col("over_cap") > 0, F.concat(F.lit("Over the daily cap in "), _plural(F.col("over_cap"), "month"))),
        F.when(F.col("d1_eligible"), F.concat(F.lit("Member of provider network "), "cluster", F.lit(", rank "), F.col("d1_rank").cast("string"))),
        F.col("procedure_reason"),
        F.when(F.col("n_strong") >= 2, F.concat(F.lit("Confirmed by "), F.col("n_strong").cast("string"), F.lit(" detectors"))).when(F.col("n_detectors") >= 2, "Another detector points the same way, less strongly"),
    )
