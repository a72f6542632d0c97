"""The factor desk of networks: thirty measures of each with family and direction, percentile and robust z among all
networks, and the momentum of those that measure change, with an outlook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.ranking import average_rank, burst
from claimlens.operators.robust import median_mad, robust_z_directed

# The factors by name, with their family and the direction that is riskier; those that measure change; and
# the bands of the outlook.
FACTORS = {
    "burst_90": ("formation", "+"), "new_share": ("formation", "+"), "velocity": ("formation", "+"), "median_age": ("formation", "-"),
    "owner_multi": ("ownership", "+"), "max_owner_degree": ("ownership", "+"), "owners_per_provider": ("ownership", "-"), "managing_share": ("ownership", "+"), "owner_burst": ("ownership", "+"), "chow": ("ownership", "+"),
    "addr_share": ("addresses", "+"), "unit_share": ("addresses", "+"), "phone_share": ("addresses", "+"), "ao_share": ("addresses", "+"), "excluded_link": ("addresses", "+"), "plaza_share": ("addresses", "+"),
    "list_members": ("lists", "+"), "owner_hits": ("lists", "+"),
    "sat_per_10k": ("market", "+"), "sat_trend": ("market", "+"), "moratorium": ("market", "+"),
    "medicaid_last": ("money", "+"), "medicare_last": ("money", "+"), "medicaid_growth": ("money", "+"), "dollar_concentration": ("money", "-"), "billing_share": ("money", "-"),
    "enum_near_inc": ("identity", "+"), "deactivated": ("identity", "+"), "states": ("identity", "+"), "chain_share": ("identity", "-"),
}
MOMENTUM = ("velocity", "new_share", "medicaid_growth", "owner_burst", "sat_trend", "chow")
OUTLOOK = ((1.0, "rising fast"), (0.3, "rising"), (-0.3, "steady"))
#: Factors that come with the networks, from the network operators and the market's table; the rest is measured here.
GIVEN = ("burst_90", "owner_multi", "max_owner_degree", "addr_share", "unit_share", "phone_share", "ao_share", "excluded_link", "list_members", "owner_hits", "sat_per_10k", "sat_trend", "moratorium", "medicare_last", "chain_share")


def measured(networks: DataFrame, members: DataFrame, owners: DataFrame, changes: DataFrame, new_since: str, years_since: int, today: str, near_days: int = 183, burst_days: int = 90, least: int = 3) -> DataFrame:
    """One row for each network of at least `least` providers with a column for each factor. networks: community, n_prov,
    n_orgs and GIVEN; members: community, npi, inc_dt, enum_dt, deact_dt, n_states, at_plaza, paid_before, paid_last;
    owners: community, owner_id, is_manager, assoc_dt; changes: community, a row for each change of ownership."""
    share = lambda c: F.avg(c.cast("int"))
    dated = F.col("inc_dt").isNotNull()
    m = members.groupBy("community").agg(
        F.count_if(F.col("inc_dt") >= F.lit(new_since).cast("date")).alias("n_new"), F.median(F.when(dated, F.datediff(F.lit(today).cast("date"), "inc_dt") / 365.25)).alias("median_age"), share(F.col("at_plaza")).alias("plaza_share"),
        F.sum("paid_before").alias("before"), F.sum("paid_last").alias("medicaid_last"), F.max("paid_last").alias("top"), share(F.col("paid_last") > 0).alias("billing_share"),
        share(F.when(dated & F.col("enum_dt").isNotNull(), F.abs(F.datediff("enum_dt", "inc_dt")) <= near_days)).alias("enum_near_inc"), F.count("deact_dt").alias("deactivated"), F.max("n_states").alias("states"),
    )
    velocity = members.where(F.year("inc_dt") >= years_since).groupBy("community", F.year("inc_dt").alias("y")).agg(F.count("*").alias("n")).groupBy("community").agg(F.max("n").alias("velocity"))
    o = owners.groupBy("community").agg(F.countDistinct("owner_id").alias("n_owners"), share(F.col("is_manager")).alias("managing_share"), F.count("assoc_dt").alias("n_dated"))
    spans = burst(owners, ["community"], "assoc_dt", burst_days).select("community", F.col("most").alias("owner_burst"))
    moves = changes.groupBy("community").agg(F.count("*").alias("chow"))
    x = networks.where(F.col("n_prov") >= least)
    for part in (m, velocity, o, spans, moves):
        x = x.join(part, "community", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    made = {
        "new_share": zero(F.col("n_new")) / F.greatest(F.col("n_orgs"), F.lit(1)), "velocity": zero(F.col("velocity")), "median_age": F.col("median_age"), "owners_per_provider": F.when(F.col("n_owners") > 0, F.col("n_owners") / F.col("n_prov")),
        "managing_share": F.col("managing_share"), "owner_burst": F.when(F.col("n_dated") >= 2, F.col("owner_burst")).otherwise(0), "chow": zero(F.col("chow")), "plaza_share": zero(F.col("plaza_share")), "medicaid_last": zero(F.col("medicaid_last")),
        "medicaid_growth": F.when(F.col("before") > 0, (F.col("medicaid_last") - F.col("before")) / F.col("before")), "dollar_concentration": F.when(F.col("medicaid_last") > 0, F.col("top") / F.col("medicaid_last")),
        "billing_share": F.col("billing_share"), "enum_near_inc": F.col("enum_near_inc"), "deactivated": zero(F.col("deactivated")), "states": zero(F.col("states")),
    }
    return x.select("community", *((made[f] if f in made else F.col(f)).cast("double").alias(f) for f in FACTORS))


def _of(table: dict[str, str], factor: str = "factor") -> Column:
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), F.col(factor))


def percentiles(wide: DataFrame, least: int = 5) -> DataFrame:
    """community, factor, family, value, percentile (100 is the riskiest), z (higher is riskier). A factor that fewer than
    `least` networks have says neither."""
    tall = wide.unpivot(["community"], list(FACTORS), "factor", "value")
    base = median_mad(tall, ["factor"], "value").withColumnRenamed("n", "cnt")
    x = tall.join(base, "factor", "left").withColumn("rk", average_rank("value", ["factor"]))
    down = _of({f: d for f, (_, d) in FACTORS.items()}) == "-"
    rank = F.when(down, 1 - F.col("rk") + 1 / F.col("cnt")).otherwise(F.col("rk"))
    z = F.when(down, robust_z_directed("value", "med", "mad", "cnt", False, least)).otherwise(robust_z_directed("value", "med", "mad", "cnt", True, least))
    return x.select("community", "factor", _of({f: g for f, (g, _) in FACTORS.items()}).alias("family"), "value", F.when(F.col("cnt") >= least, 100 * rank).alias("percentile"), z.alias("z"))


def momentum(desk_: DataFrame, clip: float = 3.0) -> DataFrame:
    """Rows of the factor momentum: the mean clipped z of the factors of change, its percentile and its outlook."""
    bounded = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("z")))
    m = desk_.where(F.col("factor").isin(*MOMENTUM)).groupBy("community").agg(F.avg(F.when(F.col("z").isNotNull(), bounded)).alias("value"))
    m = m.withColumn("rk", average_rank("value", []))
    outlook = F.lit("cooling")
    for least, name in reversed(OUTLOOK):
        outlook = F.when(F.col("value") >= least if least > 0 else F.col("value") > least, name).otherwise(outlook)
    return m.select("community", F.lit("momentum").alias("factor"), F.lit("momentum").alias("family"), "value", (100 * F.col("rk")).alias("percentile"), F.lit(None).cast("double").alias("z"), F.when(F.col("value").isNotNull(), outlook).alias("outlook"))


def desk(networks: DataFrame, members: DataFrame, owners: DataFrame, changes: DataFrame, **dates) -> DataFrame:
    """All factors of all networks, and their momentum, in rows."""
    x = percentiles(measured(networks, members, owners, changes, **dates))
    return x.withColumn("outlook", F.lit(None).cast("string")).unionByName(momentum(x))
