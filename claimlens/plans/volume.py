"""Impossible volume over the tables: state is a region, the code a brand; families of crossover payment are three types."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import volume as v
from claimlens.plans.data import SPEND, STATES, lines, r4, r4_scaled, spend, states, table
from claimlens.session import counted, discard, materialize, sweep

CROSSOVER = ("ECONOMY", "PROMO")


def _with_states(spark, sf_dir, df):
    return df.join(states(spark, sf_dir).select("npi", "state", "entity_type", "taxonomy", "enum_date"), "npi")


def _spend(spark, sf_dir, *more):
    """The columns of spend and of the registry that months are made of, written; the shuffles behind them are dropped."""
    sp = _with_states(spark, sf_dir, spend(spark, sf_dir))
    sp = materialize(sp.select("npi", "servicing", "hcpcs", "minutes", "month_start", "year", "lines", "paid_c", "patients", "state", "taxonomy", "entity_type", *more), "spend")
    sweep(spark)
    return sp


def _rates(spark, sf_dir, df=None):
    s = (_with_states(spark, sf_dir, lines(spark, sf_dir)) if df is None else df).where("lines > 0 and paid_c > 0")
    cells = s.select("state", "hcpcs", "year", (F.col("paid_c").cast("double") / F.col("lines")).alias("ppl"), (F.substring("hcpcs", 7, 1) == "1").alias("crossover"))
    published = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_brand").alias("hcpcs"), (F.round(F.col("p_retailprice") * 100)).alias("rate"), F.when(F.col("p_partkey") % 3 == 0, "1996").otherwise("1992").alias("version"))
    return v.with_published(v.rate_estimates(cells, ["state", "hcpcs", "year"]), published, ["hcpcs"], 50000.0, F.when(F.col("year") >= 1996, "1996").otherwise("1992"))


RATES_CTE = f"""{SPEND}, {STATES}, sp AS (SELECT spend.*, state, entity_type, taxonomy, enum_date FROM spend JOIN states USING (npi)),
cells AS (SELECT state, hcpcs, year, CAST(paid_c AS DOUBLE) / lines AS ppl, substr(hcpcs, 7, 1) = '1' AS crossover FROM sp WHERE lines > 0 AND paid_c > 0),
med AS (SELECT state, hcpcs, year, median(ppl) AS p50 FROM cells GROUP BY ALL),
est AS (SELECT state, hcpcs, year, crossover, count(*) AS n_cells, quantile_cont(ppl, 0.05) AS p05, quantile_cont(ppl, 0.05) FILTER (WHERE ppl >= 0.2::DOUBLE * p50) AS p05_trim, quantile_cont(ppl, 0.25) AS p25, p50, quantile_cont(ppl, 0.75) AS p75
  FROM cells JOIN med USING (state, hcpcs, year) GROUP BY state, hcpcs, year, crossover, p50 HAVING count(*) >= 30),
pv AS (SELECT p_brand AS hcpcs, CASE WHEN p_partkey % 3 = 0 THEN '1996' ELSE '1992' END AS version, min(round(p_retailprice * 100)) AS base, max(round(p_retailprice * 100)) AS top FROM part WHERE p_size = 7 GROUP BY 1, 2),
pub AS (SELECT hcpcs, arg_max(base, version) AS last_base, max(top) AS published_max FROM pv GROUP BY 1),
r0 AS (SELECT est.*, coalesce(pv.base, last_base) AS published_base, published_max, CASE WHEN crossover THEN p50 ELSE coalesce(p05_trim, p05) END AS rate_est FROM est LEFT JOIN pub ON pub.hcpcs = est.hcpcs LEFT JOIN pv ON pv.hcpcs = est.hcpcs AND pv.version = CASE WHEN est.year >= 1996 THEN '1996' ELSE '1992' END),
rates AS (SELECT *, CASE WHEN coalesce(published_max, rate_est) >= 50000 THEN coalesce(published_max, rate_est) END AS rate_pt, CASE WHEN coalesce(published_max, rate_est) >= 50000 THEN 1.5::DOUBLE * coalesce(published_max, rate_est) END AS rate_cons,
  CASE WHEN published_base IS NOT NULL THEN 'published' WHEN coalesce(rate_est, 0) < 50000 THEN 'no_rate' WHEN crossover THEN 'median' ELSE 'p05_trimmed' END AS rate_source FROM r0)"""


def rates(spark, sf_dir):
    x = _rates(spark, sf_dir)  # seven digits: no quotient of these tables lies between two of them, where engines round differently
    return x.select("state", "hcpcs", "year", "crossover", "n_cells", *(F.round(c, 7).alias(c) for c in ("p05", "p05_trim", "p25", "p50", "p75", "rate_est", "rate_pt", "rate_cons", "published_base")), "rate_source")


RATES = f"WITH {RATES_CTE} SELECT state, hcpcs, year, crossover, n_cells, {', '.join(f'round({c}, 7) AS {c}' for c in ('p05', 'p05_trim', 'p25', 'p50', 'p75', 'rate_est', 'rate_pt', 'rate_cons', 'published_base'))}, rate_source FROM rates"


def rate_error(spark, sf_dir):
    x = v.rate_error(_rates(spark, sf_dir))
    return x.groupBy("year").agg(F.count("*").alias("n"), r4(F.median("error_pct")).alias("median_error"), r4(F.percentile(F.abs("error_pct"), F.lit(0.9))).alias("p90_abs_error"))


RATE_ERROR = f"WITH {RATES_CTE}, e AS (SELECT year, 100 * (rate_est - published_base) / nullif(published_base, 0) AS error_pct FROM rates WHERE published_base IS NOT NULL) SELECT year, count(*) AS n, round(median(error_pct), 4) AS median_error, round(quantile_cont(abs(error_pct), 0.9), 4) AS p90_abs_error FROM e GROUP BY 1"


def _months(spark, sf_dir, df=None):
    """Months of providers; df is spend with the registry's columns, where the caller has it already."""
    s = _spend(spark, sf_dir) if df is None else df
    s = s.where("lines > 0 and paid_c > 0")
    r, _ = counted(_rates(spark, sf_dir, s).select("state", "hcpcs", "year", "rate_pt", "rate_cons"), "rates")
    sweep(spark)
    x = s.join(r, ["state", "hcpcs", "year"])
    group = F.when(F.col("minutes") > 40, 2).otherwise(1)
    # sizes of parts are minutes; times a hundred, so that some months go over the limits
    hours = v.implied_hours(F.col("lines"), F.col("paid_c"), F.col("minutes") * 100, group, F.col("rate_pt"), F.col("rate_cons"))
    x = x.select("npi", "state", "taxonomy", "entity_type", "month_start", "hcpcs", F.col("servicing").alias("billing"), "paid_c", "lines", "patients", *(c.alias(k) for k, c in hours.items()), (F.col("minutes") <= 30).alias("personal_service"), (F.col("minutes") > 35).alias("high_vector"), F.when((F.col("state") == "ASIA") & (F.col("minutes") % 10 == 0), 8.0).alias("cap_hours"))
    m = v.month_rollup(x, ["npi", "state", "taxonomy", "entity_type", "month_start"])
    return m.withColumn("label", v.volume_label(F.col("entity_type") == "1"))


MONTHS_CTE = RATES_CTE + """, imp AS (SELECT npi, sp.state, taxonomy, entity_type, month_start, sp.hcpcs, servicing AS billing, paid_c, lines, patients, lines * ((minutes * 100) / 60.0::DOUBLE / CASE WHEN minutes > 40 THEN 2 ELSE 1 END) AS hours_lb,
  (paid_c / rate_pt) * ((minutes * 100) / 60.0::DOUBLE / CASE WHEN minutes > 40 THEN 2 ELSE 1 END) AS hours_pt, (paid_c / rate_cons) * ((minutes * 100) / 60.0::DOUBLE / CASE WHEN minutes > 40 THEN 2 ELSE 1 END) AS hours_cons,
  minutes <= 30 AS personal_service, minutes > 35 AS high_vector, CASE WHEN sp.state = 'ASIA' AND minutes % 10 = 0 THEN 8.0::DOUBLE END AS cap_hours, day(last_day(month_start)) AS days
  FROM sp JOIN rates ON sp.state = rates.state AND sp.hcpcs = rates.hcpcs AND sp.year = rates.year WHERE lines > 0 AND paid_c > 0),
mon AS (SELECT npi, state, taxonomy, entity_type, month_start, sum(hours_lb) AS hours_lb, sum(hours_pt) AS hours_pt, sum(hours_cons) AS hours_cons, coalesce(sum(hours_lb) FILTER (WHERE personal_service), 0) AS hours_lb_personal,
  coalesce(sum(hours_pt) FILTER (WHERE personal_service), 0) AS hours_pt_personal, coalesce(sum(hours_cons) FILTER (WHERE personal_service), 0) AS hours_cons_personal, CAST(sum(paid_c) AS BIGINT) AS paid_c, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(patients) AS BIGINT) AS patients,
  count(DISTINCT billing) AS n_billing, count(DISTINCT hcpcs) AS n_codes, bool_or(high_vector) AS any_high, sum(hours_cons) FILTER (WHERE cap_hours IS NOT NULL) AS capped_hours, sum(cap_hours * patients * days) AS cap_allowance, max(days) AS days_in_month FROM imp GROUP BY 1, 2, 3, 4, 5),
lab AS (SELECT *, CASE WHEN entity_type = '1' AND hours_lb_personal / days_in_month > 24 THEN 'IMPOSSIBLE_BY_LINE_COUNT' WHEN entity_type = '1' AND hours_cons_personal / days_in_month > 24 THEN 'IMPOSSIBLE_CONSERVATIVE_RATE'
  WHEN hours_cons / nullif(patients, 0) / days_in_month > 24 THEN 'IMPOSSIBLE_PER_PATIENT' WHEN cap_allowance IS NOT NULL AND capped_hours > cap_allowance THEN 'EXCEEDS_DAILY_CAP' WHEN entity_type = '1' AND hours_cons_personal / days_in_month > 16 THEN 'IMPLAUSIBLE_OVER_16H'
  WHEN entity_type = '1' AND hours_lb / days_in_month > 24 THEN 'UMBRELLA_VOLUME' WHEN entity_type = '1' AND hours_pt_personal / days_in_month > 12 THEN 'ELEVATED_OVER_12H' END AS label FROM mon)"""


def months(spark, sf_dir):
    return _months(spark, sf_dir).select("npi", "month_start", "paid_c", "patients", "n_billing", "n_codes", "any_high", *(r4_scaled(F.col(c)).alias(c) for c in ("hours_lb", "hours_cons_personal", "cap_allowance")), "label")


MONTHS = f"WITH {MONTHS_CTE} SELECT npi, month_start, paid_c, patients, n_billing, n_codes, any_high, round(hours_lb, 4) AS hours_lb, round(hours_cons_personal, 4) AS hours_cons_personal, round(cap_allowance, 4) AS cap_allowance, label FROM lab"


def _written_months(spark, sf_dir, sp):
    m = materialize(_months(spark, sf_dir, sp), "volume-months")
    sweep(spark)
    return m


def baseline(spark, sf_dir):
    sp = _spend(spark, sf_dir)
    m = _written_months(spark, sf_dir, sp)
    discard(sp)
    x = v.scored(m.where("entity_type = '1'"), "hours_pt", "state", "taxonomy", "npi", 6)
    return x.select("npi", "month_start", "baseline_level", r4(F.col("baseline_median")).alias("baseline_median"), r4(F.col("robust_z")).alias("robust_z"))


BASE_CTE = MONTHS_CTE + """, ind AS (SELECT * FROM lab WHERE entity_type = '1'), ok AS (SELECT * FROM ind WHERE hours_pt IS NOT NULL),
gm AS (SELECT state, taxonomy, median(hours_pt) AS med FROM ok GROUP BY 1, 2 HAVING count(DISTINCT npi) >= 6), g AS (SELECT state, taxonomy, max(med) AS med, median(abs(hours_pt - med)) AS mad FROM ok JOIN gm USING (state, taxonomy) GROUP BY 1, 2),
sm AS (SELECT state, median(hours_pt) AS med FROM ok GROUP BY 1), s AS (SELECT state, max(med) AS med, median(abs(hours_pt - med)) AS mad FROM ok JOIN sm USING (state) GROUP BY 1)"""
BASELINE = f"""WITH {BASE_CTE} SELECT npi, month_start, CASE WHEN g.med IS NOT NULL THEN 'fine' WHEN s.med IS NOT NULL THEN 'coarse' END AS baseline_level, round(coalesce(g.med, s.med), 4) AS baseline_median,
  round(0.6745::DOUBLE * (hours_pt - coalesce(g.med, s.med)) / nullif(CASE WHEN g.med IS NOT NULL THEN g.mad ELSE s.mad END, 0), 4) + 0.0::DOUBLE AS robust_z
FROM ind LEFT JOIN g ON g.state = ind.state AND g.taxonomy = ind.taxonomy LEFT JOIN s ON s.state = ind.state"""


def top(spark, sf_dir):
    """The indicator score per provider, with its peak deviation and its growth from one year to another."""
    sp = _spend(spark, sf_dir)
    m = _written_months(spark, sf_dir, sp)
    by = materialize(sp.where("year in (1996, 1998)").groupBy("npi").pivot("year", [1996, 1998]).agg(F.sum("paid_c")), "volume-years")
    discard(sp)
    hit = lambda *names: F.count_if(F.col("label").isin(*names))
    x = m.groupBy("npi", "entity_type").agg(
        F.count("*").alias("months"), hit("IMPOSSIBLE_BY_LINE_COUNT", "IMPOSSIBLE_CONSERVATIVE_RATE", "IMPOSSIBLE_PER_PATIENT").alias("impossible"), hit("EXCEEDS_DAILY_CAP").alias("over_cap"), hit("IMPLAUSIBLE_OVER_16H").alias("implausible"),
        hit("UMBRELLA_VOLUME").alias("umbrella"), F.max(F.when(F.col("label").startswith("IMPOSSIBLE"), F.col("n_billing"))).alias("orgs"), F.sum("paid_c").alias("paid_c"), F.sum(F.when(F.col("label").isNotNull(), F.col("paid_c")).otherwise(0)).alias("flagged_c"),
        F.max("n_billing").alias("max_billing"), F.max("patients").alias("max_patients"),
    )
    peak = v.scored(m, "hours_pt", "state", "taxonomy", "npi", 6).groupBy("npi").agg(F.max("robust_z").alias("peak_z"))
    x = x.join(peak, "npi", "left").join(by.select("npi", F.try_divide(F.col("1998").cast("double"), F.col("1996")).alias("growth")), "npi", "left")
    # a year's change in these tables is small, so the score is given four times the change
    score = v.indicator_score(F.col("impossible"), F.col("over_cap"), F.col("implausible"), F.col("umbrella"), F.col("peak_z"), F.col("orgs"), 4 * F.col("growth"), F.col("paid_c") / 100)
    return x.withColumn("score", r4(score)).withColumn("peak_z", r4(F.col("peak_z"))).withColumn("growth", r4(F.col("growth")))


TOP = """WITH BASE_CTE_, t AS (SELECT npi, entity_type, count(*) AS months, count(*) FILTER (WHERE label IN ('IMPOSSIBLE_BY_LINE_COUNT', 'IMPOSSIBLE_CONSERVATIVE_RATE', 'IMPOSSIBLE_PER_PATIENT')) AS impossible, count(*) FILTER (WHERE label = 'EXCEEDS_DAILY_CAP') AS over_cap,
  count(*) FILTER (WHERE label = 'IMPLAUSIBLE_OVER_16H') AS implausible, count(*) FILTER (WHERE label = 'UMBRELLA_VOLUME') AS umbrella, max(n_billing) FILTER (WHERE label LIKE 'IMPOSSIBLE%') AS orgs, CAST(sum(paid_c) AS BIGINT) AS paid_c,
  CAST(sum(CASE WHEN label IS NOT NULL THEN paid_c ELSE 0 END) AS BIGINT) AS flagged_c, max(n_billing) AS max_billing, max(patients) AS max_patients FROM lab GROUP BY 1, 2),
pz AS (SELECT npi, max(0.6745::DOUBLE * (hours_pt - coalesce(g.med, s.med)) / nullif(CASE WHEN g.med IS NOT NULL THEN g.mad ELSE s.mad END, 0)) AS peak_z FROM lab LEFT JOIN g ON g.state = lab.state AND g.taxonomy = lab.taxonomy LEFT JOIN s ON s.state = lab.state GROUP BY 1),
gr AS (SELECT npi, CAST(sum(paid_c) FILTER (WHERE year = 1998) AS DOUBLE) / nullif(sum(paid_c) FILTER (WHERE year = 1996), 0) AS growth FROM spend WHERE year IN (1996, 1998) GROUP BY 1)
SELECT t.*, round(peak_z, 4) + 0.0::DOUBLE AS peak_z, round(growth, 4) AS growth, round(3.0::DOUBLE * least(impossible, 12) / 12 + 1.5::DOUBLE * least(over_cap, 12) / 12 + 1.0::DOUBLE * least(implausible, 12) / 12 + 0.3::DOUBLE * least(umbrella, 12) / 12 + 0.5::DOUBLE * least(greatest(coalesce(peak_z, 0), 0), 20) / 20
  + CASE WHEN orgs >= 3 THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN orgs >= 5 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN 4 * growth >= 4 AND paid_c / 100 >= 250000 THEN 0.5::DOUBLE ELSE 0 END + 0.5::DOUBLE * log10(paid_c / 100 + 1) / 8, 4) AS score FROM t LEFT JOIN pz USING (npi) LEFT JOIN gr USING (npi)""".replace("BASE_CTE_", BASE_CTE.replace("SELECT * FROM lab WHERE entity_type = '1'", "SELECT * FROM lab"))


def growth(spark, sf_dir):
    s = _with_states(spark, sf_dir, lines(spark, sf_dir))
    by = s.groupBy("npi", "state", "year", "hcpcs").agg(F.sum("paid_c").alias("paid_c"), F.sum("patients").alias("patient_months"), F.bool_or(F.col("minutes") > 35).alias("high_vector"))
    g = v.growth_table(materialize(by, "growth-codes"), "npi", "state", 12, 2).join(states(spark, sf_dir).select("npi", "enum_date"), "npi")
    new = F.col("enum_date") >= F.add_months(F.make_date("year", F.lit(1), F.lit(1)), -36)
    return g.select("npi", "year", "code", "share", r4(F.col("per_patient")).alias("per_patient"), r4(F.col("growth")).alias("growth"), r4(F.col("intensity_z")).alias("intensity_z"), "intensity_pct", v.growth_anomaly(new, 1_000_000, 0.1, 1.0, 0.5).alias("anomaly"))


GROWTH = f"""WITH {SPEND}, {STATES}, b AS (SELECT npi, state, year, hcpcs, CAST(sum(paid_c) AS BIGINT) AS paid_c, CAST(sum(patients) AS BIGINT) AS pm, bool_or(minutes > 35) AS hv, any_value(enum_date) AS enum_date FROM spend JOIN states USING (npi) GROUP BY 1, 2, 3, 4),
t AS (SELECT npi, state, year, CAST(sum(paid_c) AS BIGINT) AS py, CAST(sum(pm) AS BIGINT) AS pmy FROM b GROUP BY 1, 2, 3), d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY npi, year ORDER BY paid_c DESC, hcpcs) = 1),
x AS (SELECT t.npi, t.state, t.year, py, pmy, hcpcs AS code, hv, d.paid_c / py AS share, CAST(d.paid_c AS DOUBLE) / nullif(pm, 0) AS pp, lag(py) OVER (PARTITION BY t.npi ORDER BY t.year) AS prev, enum_date FROM t JOIN d ON t.npi = d.npi AND t.year = d.year),
m AS (SELECT state, code, year, median(pp) AS med FROM x WHERE pmy >= 12 GROUP BY 1, 2, 3 HAVING count(pp) >= 2), q AS (SELECT state, code, year, max(med) AS med, median(abs(pp - med)) AS mad FROM x JOIN m USING (state, code, year) WHERE pmy >= 12 GROUP BY 1, 2, 3),
z AS (SELECT x.*, CAST(py AS DOUBLE) / nullif(prev, 0) AS g, 0.6745::DOUBLE * (pp - med) / nullif(mad, 0) + 0.0::DOUBLE AS iz FROM x LEFT JOIN q ON x.state = q.state AND x.code = q.code AND x.year = q.year),
w AS (SELECT *, percent_rank() OVER (PARTITION BY state, code, year ORDER BY pp ASC NULLS LAST) AS pct FROM z WHERE pmy >= 12)
SELECT npi, year, code, share, round(pp, 4) AS per_patient, round(g, 4) AS growth, round(iz, 4) AS intensity_z, pct AS intensity_pct,
  coalesce(enum_date >= make_date(year, 1, 1) - INTERVAL 36 MONTH AND py >= 1000000 AND hv AND share >= 0.1::DOUBLE AND (prev IS NULL OR g >= 1) AND pct >= 0.5::DOUBLE, FALSE) AS anomaly FROM w"""

QUERIES = {
    "volume_rates": (rates, RATES),
    "volume_rate_error": (rate_error, RATE_ERROR),
    "volume_months": (months, MONTHS),
    "volume_baseline": (baseline, BASELINE),
    "volume_top": (top, TOP),
    "volume_growth": (growth, GROWTH),
}
