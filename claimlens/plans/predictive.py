"""Predictive scoring over the tables: will a supplier's shipments be returned; and measures whose results SQL can hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.operators import cohort as c
from claimlens.operators import predict as p
from claimlens.operators.robust import median_mad, robust_z_directed
from claimlens.operators.ranking import average_rank
from claimlens.plans.data import SPEND, STATES, lines, r4, states, table
from claimlens.session import materialize

FEATURES = ["qty", "price", "discount"]


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def woe(spark, sf_dir):
    """Weights of evidence over exact deciles."""
    df = _rows(spark, sf_dir)
    cut = p.edges(df, ["qty", "price"])
    t = p.woe_table(df, ["qty", "price"], "y", cut)
    return t.select("feature", "bin", "n", "positives", r4(F.col("woe")).alias("woe"), r4(F.col("iv")).alias("iv"))


_BINS = lambda f: f"list_sort(list_distinct(quantile_cont({f}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])))"
WOE = f"""WITH q AS (SELECT {_BINS('l_quantity')} AS q1, {_BINS('l_extendedprice')} AS q2 FROM lineitem),
x AS (SELECT 'qty' AS feature, CAST(len(list_filter(q1[2:len(q1) - 1], lambda e: l_quantity > e)) AS INTEGER) AS bin, l_returnflag = 'R' AS y FROM lineitem, q
  UNION ALL SELECT 'price', CAST(len(list_filter(q2[2:len(q2) - 1], lambda e: l_extendedprice > e)) AS INTEGER), l_returnflag = 'R' FROM lineitem, q),
g AS (SELECT feature, bin, count(*) AS n, count(*) FILTER (WHERE y) AS positives FROM x GROUP BY 1, 2),
r AS (SELECT *, (positives + 0.5::DOUBLE) / (sum(positives) OVER w + 0.5::DOUBLE * count(*) OVER w) AS e, (n - positives + 0.5::DOUBLE) / (sum(n - positives) OVER w + 0.5::DOUBLE * count(*) OVER w) AS ne FROM g WINDOW w AS (PARTITION BY feature))
SELECT feature, bin, n, positives, round(ln(e / ne), 4) + 0.0::DOUBLE AS woe, round((e - ne) * ln(e / ne), 4) + 0.0::DOUBLE AS iv FROM r"""


def auc(spark, sf_dir):
    """Area under the curve of a score with ties, by ranks."""
    return p.auc(_rows(spark, sf_dir), "qty", "y").select(r4(F.col("auc")).alias("auc"))


AUC = """WITH r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem)
SELECT round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 4) AS auc FROM r"""


def combined(spark, sf_dir):
    """Chance over the limit by fixed draws, expected loss, tier, combined score and top drivers."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    draws = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    prob, peak, doc = (k % 10) / 20.0, (k % 40).cast("double"), k % 9 == 0
    imp = p.chance_over(peak, draws)
    loss = p.expected_loss(prob, F.round(F.col("s_acctbal") * 100), doc, F.lit(1000.0))
    s = s.withColumn("woe_a", (k % 5 - 2).cast("double")).withColumn("woe_b", (k % 3 - 1).cast("double"))
    return s.select(k.alias("npi"), imp.alias("p_impossible"), r4(loss).alias("loss"), p.tier(doc, imp, k % 2, prob / 0.04).alias("tier"), r4(p.noisy_or(prob, imp, doc)).alias("score"), p.drivers(["woe_a", "woe_b"], [0.5, 1.25], 1).alias("driver"), r4(p.feedback_weight(k % 6, k % 4)).alias("feedback"))


COMBINED = """WITH d AS (SELECT [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]::DOUBLE[] AS u), s AS (SELECT s_suppkey AS k, s_acctbal, (s_suppkey % 10) / 20 AS p, CASE WHEN s_suppkey % 40 > 0 THEN len(list_filter(u, lambda x: (s_suppkey % 40) * x > 24)) / 8 ELSE 0.0 END AS imp,
  CAST(s_suppkey % 5 - 2 AS DOUBLE) * 0.5::DOUBLE AS a, CAST(s_suppkey % 3 - 1 AS DOUBLE) * 1.25::DOUBLE AS b FROM supplier, d)
SELECT k AS npi, CAST(imp AS DOUBLE) AS p_impossible, round(CASE WHEN k % 9 = 0 THEN (1000.0::DOUBLE + round(s_acctbal * 100)) * 0.9::DOUBLE ELSE p * round(s_acctbal * 100) * 0.9::DOUBLE END, 4) + 0.0::DOUBLE AS loss,
  CAST(CASE WHEN k % 9 = 0 THEN 1 WHEN imp >= 0.95 AND k % 2 > 0 THEN 2 WHEN p / 0.04::DOUBLE >= 10 THEN 3 WHEN p / 0.04::DOUBLE >= 3 OR imp >= 0.5 THEN 4 ELSE 5 END AS INTEGER) AS tier,
  round(CASE WHEN k % 9 = 0 THEN 100.0::DOUBLE ELSE 100 * (1 - (1 - p) * (1 - 0.5::DOUBLE * imp)) END, 4) AS score,
  CASE WHEN abs(a) >= abs(b) THEN format('woe_a:{:+.2f}', a) ELSE format('woe_b:{:+.2f}', b) END AS driver, round(2.0::DOUBLE * (k % 6 + 5) / (k % 6 + k % 4 + 10), 4) AS feedback FROM s"""


def model(spark, sf_dir):
    """Fit on 70 per cent, calibrated on the rest, scored. No SQL: the fit is iterative."""
    from claimlens.operators.sets import hash_split

    df = _rows(spark, sf_dir)
    train, test = df.where(hash_split("id", 0.7, 7)), df.where(~hash_split("id", 0.7, 7))
    cut = p.edges(train, FEATURES)
    t = p.woe_table(train, FEATURES, "y", cut)
    names = [f"woe_{f}" for f in FEATURES]
    fitted = p.logistic(p.apply_woe(train, FEATURES, cut, t), names, "y")
    raw = p.apply_woe(test, FEATURES, cut, t).withColumn("raw", p.sigmoid(p.linear(names, fitted)))
    iso = p.isotonic(raw, "raw", "y")
    return iso.transform(raw).select("id", "y", "raw", F.col("prediction").alias("p"), p.drivers(names, list(map(float, fitted.coefficients))).alias("drivers"))


def factors(spark, sf_dir):
    """Tall metrics: unpivot, percentile, signed robust z."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100)).alias("bal"), F.countDistinct("c_mktsegment").alias("segs"))
    tall = n.select(F.col("c_nationkey").cast("int").alias("id"), F.col("n").cast("double").alias("n"), "bal", F.col("segs").cast("double").alias("segs")).unpivot(["id"], ["n", "bal", "segs"], "factor", "value")
    base = median_mad(tall, ["factor"], "value").withColumnRenamed("n", "cnt")
    x = tall.join(F.broadcast(base), "factor")
    z = F.when(F.col("factor") == "bal", robust_z_directed("value", "med", "mad", "cnt", False)).otherwise(robust_z_directed("value", "med", "mad", "cnt"))
    return x.select("id", "factor", "value", r4(average_rank("value", ["factor"])).alias("pct"), r4(z).alias("z"))


FACTORS = """WITH c AS (SELECT CAST(c_nationkey AS INTEGER) AS id, CAST(count(*) AS DOUBLE) AS n, sum(round(c_acctbal * 100)) AS bal, CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS segs FROM customer GROUP BY 1),
t AS (UNPIVOT c ON n, bal, segs INTO NAME factor VALUE value), m AS (SELECT factor, median(value) AS med, count(*) AS cnt FROM t GROUP BY 1), d AS (SELECT factor, any_value(med) AS med, any_value(cnt) AS cnt, median(abs(value - med)) AS mad FROM t JOIN m USING (factor) GROUP BY 1)
SELECT id, factor, value, round((rank() OVER (PARTITION BY factor ORDER BY value) + (count(*) OVER (PARTITION BY factor, value) - 1) / 2) / count(*) OVER (PARTITION BY factor), 4) AS pct,
  round(CASE WHEN cnt >= 5 THEN CASE WHEN mad > 0 THEN (value - med) / (1.4826::DOUBLE * mad) ELSE 0 END * CASE WHEN factor = 'bal' THEN -1 ELSE 1 END END, 4) + 0.0::DOUBLE AS z FROM t JOIN d USING (factor)"""

UNTIL, AFTER = "1997-12-01", "1998-01-01"


def cohort(spark, sf_dir):
    """Providers as they were at the end of 1997, with features, and whether a return of 1998 or later is theirs."""
    li = lines(spark, sf_dir)
    months = li.groupBy("npi", "month_start").agg(F.sum("paid_c").alias("paid_c"), F.sum("lines").alias("lines"), F.sum("patients").alias("patients"), F.countDistinct("hcpcs").alias("counterparties"), (F.sum("minutes") / 60).alias("hours_day"), F.countDistinct("family").alias("n_billing"))
    months = materialize(months.withColumn("personal_hours_day", F.col("hours_day") / 2), "cohort-months")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("npi"), F.to_date("l_shipdate").alias("event_dt"), "l_quantity")
    x = c.cohort(c.behaviour(months, UNTIL), c.volume_history(months, UNTIL), c.before([returned.where("l_quantity >= 50"), returned.where("l_quantity = 1")], "1992-06-30"), states(spark, sf_dir), c.later([returned.where("l_quantity >= 49")], AFTER))
    return x.select("npi", "y", "first_month", "last_month", "last_12m_c", *(r4(e).alias(n) for n, e in c.engineered(x).items()))


COHORT = f"""WITH {SPEND}, {STATES}, mo AS (SELECT npi, month_start, CAST(sum(paid_c) AS BIGINT) AS paid_c, sum(lines) AS lines, CAST(sum(patients) AS BIGINT) AS patients, count(DISTINCT hcpcs) AS cp, sum(minutes) / 60 AS hd, count(DISTINCT family) AS nb FROM spend WHERE month_start <= DATE '{UNTIL}' GROUP BY 1, 2),
w AS (SELECT *, median(paid_c) OVER q AS med, count(*) OVER q AS n FROM mo WINDOW q AS (PARTITION BY npi ORDER BY month_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
a AS (SELECT npi, CAST(sum(paid_c) AS BIGINT) AS paid_c, count(*) AS nm, max(paid_c) AS mx, CAST(sum(CASE WHEN year(month_start) = 1997 THEN paid_c ELSE 0 END) AS BIGINT) AS ly, CAST(sum(CASE WHEN year(month_start) = 1996 THEN paid_c ELSE 0 END) AS BIGINT) AS py, CAST(sum(CASE WHEN month_start >= DATE '{UNTIL}' - INTERVAL 11 MONTH THEN paid_c ELSE 0 END) AS BIGINT) AS last_12m_c,
  coalesce(max(CASE WHEN n >= 3 AND med > 0 THEN paid_c / med END), 1) AS ramp, max(cp) AS cp, max(patients) AS pt, min(month_start) AS first_month, max(month_start) AS last_month, count(*) FILTER (WHERE hd > 24) AS o24, count(*) FILTER (WHERE hd > 16) AS o16, max(hd / 2) AS pk, max(nb) AS nb, count(*) FILTER (WHERE hd > 24 AND nb >= 3) AS oc FROM w GROUP BY 1 HAVING sum(paid_c) >= 100000),
t3 AS (SELECT npi, CAST(sum(paid_c) AS DOUBLE) AS t FROM (SELECT * FROM mo QUALIFY row_number() OVER (PARTITION BY npi ORDER BY paid_c DESC, month_start) <= 3) GROUP BY 1),
yl AS (SELECT DISTINCT l_suppkey AS npi FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 AND l_shipdate >= DATE '{AFTER}'), pa AS (SELECT DISTINCT l_suppkey AS npi FROM lineitem WHERE l_returnflag = 'R' AND (l_quantity >= 50 OR l_quantity = 1) AND CAST(l_shipdate AS DATE) <= DATE '1992-06-30')
SELECT a.npi, CAST(yl.npi IS NOT NULL AS INTEGER) AS y, first_month, last_month, last_12m_c, round(log10(greatest(paid_c / 100, 1)), 4) AS log_paid, round(log10(greatest(ly / 100, 1)), 4) AS log_paid_ly, round(greatest(-6, least(6, ln((ly / 100 + 1) / (py / 100 + 1)))), 4) + 0.0::DOUBLE AS growth, round(greatest(0, least(6, ln(greatest(ramp, 1)))), 4) AS log_ramp, round(t / paid_c, 4) AS top3_share,
  CAST(nm AS DOUBLE) AS n_months, round(ln(1 + cp), 4) AS log_counterparties, round(ln(1 + pt), 4) AS log_patients, round(log10(coalesce(mx / 100 / nullif(pt, 0), 0) + 1), 4) AS paid_per_patient, CAST(least(24, o24) AS DOUBLE) AS m_over24, CAST(least(36, o16) AS DOUBLE) AS m_over16, round(least(200, pk), 4) AS peak_hours, CAST(least(24, oc) AS DOUBLE) AS m_over24_concurrent, CAST(least(50, nb) AS DOUBLE) AS max_billing,
  CAST(pa.npi IS NOT NULL AS DOUBLE) AS prior_admin, CAST(coalesce(entity_type = '1', FALSE) AS DOUBLE) AS individual FROM a JOIN t3 USING (npi) LEFT JOIN yl ON yl.npi = a.npi LEFT JOIN pa ON pa.npi = a.npi LEFT JOIN states ON states.npi = a.npi"""

QUERIES = {
    "predict_cohort": (cohort, COHORT),
    "predict_woe": (woe, WOE),
    "predict_auc": (auc, AUC),
    "predict_combined": (combined, COMBINED),
    "predict_factors": (factors, FACTORS),
    "predict_model": (model, None),
}
