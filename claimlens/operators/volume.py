"""Impossible-volume detection: unit rates from payments, implied hours, monthly rollups, labels, baselines, growth.

Money comes in whole cents. Rates are cents a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.operators.ranking import percent_rank, top_per_group
from claimlens.operators.robust import median_mad, quantile, robust_z, with_fallback
from claimlens.session import counted

CONSERVATIVE = 1.5
TRIM = 0.2
MIN_CELLS = 30


def rate_estimates(cells: DataFrame, keys: list[str], value: str = "ppl", crossover: str = "crossover", min_cells: int = MIN_CELLS) -> DataFrame:
    """Per keys: quantiles of payment per line and the rate. The rate is the 5th percentile without strays (below a
    fifth of the median); the median for crossover families, whose payments are partial. Groups of few cells have none."""
    cells = cells.repartition(*keys)  # each value is shuffled as it is, not as part of a map for each quantile
    med, _ = counted(cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.median(value).alias("p50")).where(F.col("n_cells") >= min_cells), "rate-medians")
    x = cells.join(med, keys).withColumn("__kept", F.when(F.col(value) >= TRIM * F.col("p50"), F.col(value)))
    out = x.groupBy(*keys, "n_cells", "p50", crossover).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.25), F.lit(0.75))).alias("__q"), quantile("__kept", 0.05).alias("p05_trim"))
    out = out.select(*keys, "n_cells", "p50", crossover, F.col("__q")[0].alias("p05"), "p05_trim", F.col("__q")[1].alias("p25"), F.col("__q")[2].alias("p75"))
    rate = F.when(F.col(crossover), F.col("p50")).otherwise(F.coalesce("p05_trim", "p05"))
    return out.withColumn("rate_est", rate)


def with_published(rates: DataFrame, published: DataFrame, keys: list[str], least: float, in_force: Column | None = None) -> DataFrame:
    """rates with a published rate in its place where there is one: the base (the lowest variant of the version in force for
    the row, else of the latest version that has the keys), the point (the highest variant of any version), the conservative
    one (1.5 times the point) and where it came from; none below `least`, where lines are bundled or unpaid. published:
    keys, rate and, with in_force, version."""
    p = published.groupBy(*keys).agg(F.min("rate").alias("published_base"), F.max("rate").alias("published_max"))
    if in_force is not None:
        by = published.groupBy(*keys, "version").agg(F.min("rate").alias("__rate"))
        last = by.groupBy(*keys).agg(F.max_by("__rate", "version").alias("__last"))
        p = p.drop("published_base").join(last, keys)
        rates = rates.withColumn("version", in_force).join(by, [*keys, "version"], "left").drop("version")
    x = rates.join(p, keys, "left")
    if in_force is not None:
        x = x.withColumn("published_base", F.coalesce("__rate", "__last")).drop("__rate", "__last")
    point = F.coalesce("published_max", "rate_est")
    source = F.when(F.col("published_base").isNotNull(), "published").when(F.coalesce("rate_est", F.lit(0.0)) < least, "no_rate").when(F.col("crossover"), "median").otherwise("p05_trimmed")
    return x.withColumn("rate_pt", F.when(point >= least, point)).withColumn("rate_cons", CONSERVATIVE * F.col("rate_pt")).withColumn("rate_source", source)


def rate_error(rates: DataFrame) -> DataFrame:
    """Signed error of the estimate against the published base rate, in per cent."""
    return rates.where("published_base is not null").withColumn("error_pct", 100 * F.try_divide(F.col("rate_est") - F.col("published_base"), F.col("published_base")))


def implied_hours(lines: Column, paid: Column, minutes: Column, group: Column, rate_pt: Column, rate_cons: Column) -> dict[str, Column]:
    """Hours by line count (a lower bound), by the point rate and by the conservative rate."""
    hours = minutes / 60.0 / group
    return {"hours_lb": lines * hours, "hours_pt": F.try_divide(paid, rate_pt) * hours, "hours_cons": F.try_divide(paid, rate_cons) * hours}


def month_rollup(implied: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys (which hold the month): hours, the personal-service part of them, cap allowance and concurrency. Billing
    numbers and codes are counted by a set for each row: counts of distinct values would shuffle every line three times."""
    own = lambda c: F.coalesce(F.sum(F.when(F.col("personal_service"), F.col(c))), F.lit(0.0)).alias(f"{c}_personal")
    days = F.day(F.last_day("month_start")).cast("long")
    return implied.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("hours_lb", "hours_pt", "hours_cons")), *(own(c) for c in ("hours_lb", "hours_pt", "hours_cons")), F.sum("paid_c").alias("paid_c"), F.sum("lines").alias("lines"), F.sum("patients").alias("patients"),
        *(F.size(F.collect_set(c)).cast("long").alias(n) for c, n in (("billing", "n_billing"), ("hcpcs", "n_codes"))), F.bool_or("high_vector").alias("any_high"), F.sum(F.when(F.col("cap_hours").isNotNull(), F.col("hours_cons"))).alias("capped_hours"),
        F.sum(F.col("cap_hours") * F.col("patients") * days).alias("cap_allowance"), F.max(days).alias("days_in_month"),
    )


def volume_label(individual: Column) -> Column:
    """The first that holds. Individuals are tested on personal services; what others render under them is umbrella volume."""
    day = F.col("days_in_month")
    per_patient = F.try_divide(F.try_divide(F.col("hours_cons"), F.col("patients")), day)
    return (
        F.when(individual & (F.col("hours_lb_personal") / day > 24), "IMPOSSIBLE_BY_LINE_COUNT")
        .when(individual & (F.col("hours_cons_personal") / day > 24), "IMPOSSIBLE_CONSERVATIVE_RATE")
        .when(per_patient > 24, "IMPOSSIBLE_PER_PATIENT")
        .when(F.col("cap_allowance").isNotNull() & (F.col("capped_hours") > F.col("cap_allowance")), "EXCEEDS_DAILY_CAP")
        .when(individual & (F.col("hours_cons_personal") / day > 16), "IMPLAUSIBLE_OVER_16H")
        .when(individual & (F.col("hours_lb") / day > 24), "UMBRELLA_VOLUME")
        .when(individual & (F.col("hours_pt_personal") / day > 12), "ELEVATED_OVER_12H")
    )


def scored(months: DataFrame, value: str, state: str, taxonomy: str, entity: str, min_entities: int = 200) -> DataFrame:
    """Robust z of the value against its state and taxonomy, or against its state where too few entities share the taxonomy."""
    x = months.where(F.col(value).isNotNull())
    many = F.countDistinct(entity)
    fine = median_mad(x, [state, taxonomy], value, min_entities, many)
    coarse = median_mad(x, [state], value, 1, many)
    out = with_fallback(months, fine, [state, taxonomy], coarse, [state])
    return out.withColumn("robust_z", robust_z(value, "baseline_median", "baseline_mad"))


def indicator_score(impossible: Column, over_cap: Column, implausible: Column, umbrella: Column, peak_z: Column, orgs: Column, growth: Column, paid: Column) -> Column:
    """Physical impossibility dominates; then cap breaches, outliers, concurrency, growth and size."""
    part = lambda w, c, most: w * F.least(F.greatest(c, F.lit(0)), F.lit(most)) / float(most)
    flag = lambda w, c: w * F.coalesce(c, F.lit(False)).cast("int")
    return (
        part(3.0, impossible, 12) + part(1.5, over_cap, 12) + part(1.0, implausible, 12) + part(0.3, umbrella, 12) + part(0.5, F.coalesce(peak_z, F.lit(0.0)), 20)
        + flag(1.5, orgs >= 3) + flag(0.5, orgs >= 5) + flag(0.5, (growth >= 4) & (paid >= 250_000)) + 0.5 * F.log10(paid + 1) / 8.0
    )


def growth_table(by_code: DataFrame, entity: str, state: str, min_patients: int = 12, min_support: int = 20) -> DataFrame:
    """by_code has entity, state, year, hcpcs, high_vector, paid_c, patient_months. Per entity and year: the dominant code,
    its share, dollars a patient month with z and percentile among entities with that code, and growth on the year before."""
    total = by_code.groupBy(entity, state, "year").agg(F.sum("paid_c").alias("paid_year_c"), F.sum("patient_months").alias("patients_year"))
    dom = top_per_group(by_code, [entity, "year"], [F.col("paid_c").desc(), F.col("hcpcs")]).select(entity, "year", F.col("hcpcs").alias("code"), "high_vector", F.col("paid_c").alias("code_c"), F.col("patient_months").alias("code_patients"))
    x = total.join(dom, [entity, "year"])
    x = x.withColumn("share", F.col("code_c") / F.col("paid_year_c")).withColumn("per_patient", F.try_divide(F.col("code_c").cast("double"), F.col("code_patients")))
    x = x.withColumn("prev_c", F.lag("paid_year_c").over(Window.partitionBy(entity).orderBy("year"))).withColumn("growth", F.try_divide(F.col("paid_year_c").cast("double"), F.col("prev_c")))
    base = median_mad(x.where(F.col("patients_year") >= min_patients), [state, "code", "year"], "per_patient", min_support).withColumnRenamed("n", "ref_n")
    x = x.join(base, [state, "code", "year"], "left").withColumn("intensity_z", robust_z("per_patient", "med", "mad"))
    return x.where(F.col("patients_year") >= min_patients).withColumn("intensity_pct", percent_rank("per_patient", [state, "code", "year"]))


def growth_anomaly(new: Column, min_paid_c: int, share: float = 0.8, factor: float = 3.0, decile: float = 0.9) -> Column:
    """A new biller, large, concentrated in one high-risk code, grown or in its first year, and in the top decile."""
    return F.coalesce(new & (F.col("paid_year_c") >= min_paid_c) & F.col("high_vector") & (F.col("share") >= share) & (F.col("prev_c").isNull() | (F.col("growth") >= factor)) & (F.col("intensity_pct") >= decile), F.lit(False))
