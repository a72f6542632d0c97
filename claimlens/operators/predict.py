"""Predictive scoring: binned weights of evidence, logistic regression, isotonic calibration, ranking measures,
uncertainty, drivers and the combined score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.session import materialize


def edges(df: DataFrame, features: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Distinct exact quantile edges of each feature (one pass); a feature with fewer than three has its values' midpoints."""
    ps = [i / bins for i in range(bins + 1)]
    row = df.agg(*(F.percentile(f, F.array(*map(F.lit, ps))).alias(f) for f in features)).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def bin_of(c: Column, cut: list[float]) -> Column:
    """0, 1, ... by the upper edge that isn't below the value; values beyond the edges go to the first and last bin."""
    inner = cut[1:-1]
    out = F.lit(0)
    for i, x in enumerate(inner):
        out = F.when(c > x, i + 1).otherwise(out)
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(out)


def woe_table(df: DataFrame, features: list[str], label: str, cut: dict[str, list[float]]) -> DataFrame:
    """feature, bin, n, positives, woe, iv, with half a case of smoothing. All features in one pass over the data."""
    stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), bin_of(F.col(f), cut[f]).alias("bin")) for f in features))).alias("x")
    g = df.select(label, stacked).select(label, "x.feature", "x.bin").where("bin is not null").groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    w = Window.partitionBy("feature")
    e = (F.col("positives") + 0.5) / (F.sum("positives").over(w) + 0.5 * F.count("*").over(w))
    ne = (F.col("n") - F.col("positives") + 0.5) / (F.sum(F.col("n") - F.col("positives")).over(w) + 0.5 * F.count("*").over(w))
    return g.select("feature", "bin", "n", "positives", F.log(e / ne).alias("woe"), ((e - ne) * F.log(e / ne)).alias("iv"))


def apply_woe(df: DataFrame, features: list[str], cut: dict[str, list[float]], table: DataFrame) -> DataFrame:
    """df with woe_<feature>; 0 where a bin is unknown. The table has a few rows for each feature."""
    known = {(r.feature, r.bin): r.woe for r in table.collect()}
    for f in features:
        pairs = [(b, w) for (g, b), w in sorted(known.items()) if g == f]
        m = F.create_map(*[x for b, w in pairs for x in (F.lit(b), F.lit(w))]) if pairs else None
        df = df.withColumn(f"woe_{f}", F.coalesce(F.element_at(m, bin_of(F.col(f), cut[f])), F.lit(0.0)) if m is not None else F.lit(0.0))
    return df


def logistic(df: DataFrame, features: list[str], label: str, c: float = 0.5, weight_rows: int | None = None):
    """An L2 logistic regression whose penalty is 1/(C n), as C is usually understood; features aren't rescaled."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = weight_rows or df.count()
    x = VectorAssembler(inputCols=features, outputCol="features").transform(df).withColumn("label", F.col(label).cast("double"))
    return LogisticRegression(regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(x)


def linear(features: list[str], model) -> Column:
    """The log-odds by the model's coefficients, as an expression."""
    return sum((F.col(f) * float(w) for f, w in zip(features, model.coefficients, strict=True)), F.lit(float(model.intercept)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def isotonic(df: DataFrame, raw: str, label: str):
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=raw, labelCol="__y").fit(df.withColumn("__y", F.col(label).cast("double")))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc by ranks (ties at their mean), from counts by distinct score, so nothing is sorted in one task but them."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    g = materialize(g.orderBy("s").withColumn("part", F.spark_partition_id()), "auc")
    within = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = g.groupBy("part").agg(F.sum(F.col("n") - F.col("p")).alias("neg")).select("part", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("o"))
    x = g.join(F.broadcast(offset), "part").withColumn("below", F.col("o") + F.coalesce(F.sum(F.col("n") - F.col("p")).over(within), F.lit(0)))
    neg = F.col("n") - F.col("p")
    return x.agg((F.sum(F.col("p") * (F.col("below") + neg / 2)) / F.nullif(F.sum("p") * F.sum(neg), F.lit(0))).alias("auc"))


def bootstrap(p: np.ndarray, y: np.ndarray, ks: list[int], rounds: int = 1000, seed: int = 11) -> dict:
    """95 per cent intervals of AUC, average precision and precision at k over resampled held-out rows."""
    rng = np.random.default_rng(seed)
    out: dict[str, list[float]] = {"auc": [], "ap": [], **{f"p@{k}": [] for k in ks}}
    for _ in range(rounds):
        i = rng.integers(0, len(p), len(p))
        a, b = p[i], y[i]
        if not 0 < b.sum() < len(b):
            continue
        o = np.argsort(-a, kind="stable")
        hit = b[o]
        values, inverse, counts = np.unique(a, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
        n1 = b.sum()
        out["auc"].append((rank[b == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(b) - n1)))
        out["ap"].append(float((np.cumsum(hit) / np.arange(1, len(hit) + 1) * hit).sum() / n1))
        for k in ks:
            out[f"p@{k}"].append(hit[:k].mean())
    return {k: tuple(np.percentile(v, [2.5, 97.5])) if v else (float("nan"),) * 2 for k, v in out.items()}


def drivers(features: list[str], coefficients: list[float], k: int = 4) -> Column:
    """The k largest contributions to the log-odds, as name:+value, ties by name."""
    parts = F.array(*(F.struct((-F.abs(F.col(f) * float(w))).alias("o"), F.lit(f).alias("f"), (F.col(f) * float(w)).alias("v")) for f, w in zip(features, coefficients, strict=True)))
    return F.array_join(F.transform(F.slice(F.array_sort(parts), 1, k), lambda x: F.format_string("%s:%+.2f", x["f"], x["v"])), ", ")


def log_normal_draws(mu: float, sd: float, n: int = 4000, seed: int = 11) -> list[float]:
    return np.sort(np.exp(np.random.default_rng(seed).normal(mu, sd, n))).tolist()


def chance_over(peak: Column, draws: list[float], limit: float = 24.0) -> Column:
    """Share of the draws u with peak * u over the limit; 0 for no peak."""
    return F.when(peak > 0, F.size(F.filter(F.array(*map(F.lit, draws)), lambda u: peak * u > limit)) / len(draws)).otherwise(0.0)


def expected_loss(p: Column, exposure: Column, documented: Column, paid_after: Column, lgd: float = 0.9) -> Column:
    zero = F.lit(0.0)
    return F.when(documented, (F.coalesce(paid_after, zero) + F.coalesce(exposure, zero)) * lgd).otherwise(p * F.coalesce(exposure, zero) * lgd)


def tier(documented: Column, p_impossible: Column, concurrent: Column, lift: Column) -> Column:
    return F.when(documented, 1).when((p_impossible >= 0.95) & (concurrent > 0), 2).when(lift >= 10, 3).when((lift >= 3) | (p_impossible >= 0.5), 4).otherwise(5)


def noisy_or(p: Column, p_impossible: Column, documented: Column) -> Column:
    return F.when(documented, 100.0).otherwise(100 * (1 - (1 - p) * (1 - 0.5 * p_impossible)))


def feedback_weight(confirmed: Column, rejected: Column, prior: float = 10.0) -> Column:
    """2 (a + p/2) / (a + b + p): 1 without reviews, up to 2 with confirmations, down to 0 with rejections."""
    return 2 * (confirmed + prior / 2) / (confirmed + rejected + prior)
