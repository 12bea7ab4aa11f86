"""Feature diagnostics, drift and leakage checks over unpivoted features: (keys, feature, value)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.windows import corr, corr_of, lead
from ..tables import once
from .order_statistics import cumulated_in_ranges, exact_quantiles, ranked_in_ranges


def unpivot(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    return df.unpivot(list(keys), features, "feature", "value")


def block_of(feature: Column) -> Column:
    return F.split(feature, "__")[0]


def feature_ics(long: DataFrame, target: str = "excess_fwd", *keys: str, least: int = 10, stored: bool = False) -> DataFrame:
    """IC and rank IC per feature (and keys). stored: long is read from a table, so need not be written first."""
    rows = long.where(F.col("value").isNotNull() & F.col(target).isNotNull()).select("feature", *keys, "value", target)
    rows = rows if stored else once(rows)
    plain = once(rows.groupBy("feature", *keys).agg(F.count("*").alias("n"), corr("value", target, least).alias("ic")).withColumn("_g", F.monotonically_increasing_id()))
    groups = F.broadcast(plain.select("feature", *keys, "_g"))  # a row per feature and keys; their number stands for them in the exchanges
    rows = rows.join(groups, ["feature", *keys]).select("_g", "value", target)
    ranks = ranked_in_ranges(rows, {"_rx": "value", "_ry": target}, "_g", stored=True).groupBy("_g").agg(corr("_rx", "_ry", least).alias("rank_ic"))
    return F.broadcast(plain).join(ranks, "_g").select("feature", *keys, "n", "ic", "rank_ic")


def ic_by_block(long: DataFrame, target: str = "excess_fwd", stored: bool = False) -> DataFrame:
    ics = feature_ics(long, target, stored=stored)
    return ics.groupBy(block_of(F.col("feature")).alias("block")).agg(
        F.count("*").alias("features"), F.avg("ic").alias("mean_ic"), F.percentile("ic", F.lit(0.5)).alias("median_ic"), F.stddev_pop("ic").alias("std_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        F.count_if(F.col("ic") > 0).alias("positive"), F.count_if(F.abs("ic") > 0.1).alias("strong"), F.max_by("feature", F.abs("ic")).alias("top_feature"),
    )


def ic_rolling_windows(long: DataFrame, target: str = "excess_fwd", days: int = 252, step: int = 21, least: int = 50) -> DataFrame:
    """IC per feature in windows of `days` calendar days that start every `step` days."""
    span = long.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    starts = span.select(F.explode(F.expr(f"sequence(a, date_sub(b, {days}), interval {step} days)")).alias("start"))
    rows = long.join(F.broadcast(starts), (F.col("date") >= F.col("start")) & (F.col("date") < F.date_add("start", days)))
    return rows.groupBy("feature", "start").agg(F.count("*").alias("n"), corr("value", target, least).alias("ic"))


def ic_breakpoints(windows: DataFrame, least: float = 0.05) -> DataFrame:
    """Windows where the mean of three windows before and of three from there on differ by `least`."""
    w = Window.partitionBy("feature").orderBy("start")
    before, after = F.avg("ic").over(w.rowsBetween(-3, -1)), F.avg("ic").over(w.rowsBetween(0, 2))
    full = (F.count("ic").over(w.rowsBetween(-3, -1)) == 3) & (F.count("ic").over(w.rowsBetween(0, 2)) == 3)
    return windows.withColumns({"before": before, "after": after, "_f": full}).where(F.col("_f") & (F.abs(F.col("after") - F.col("before")) >= least)).drop("_f")


def ic_by_regime(long: DataFrame, regimes: DataFrame, target: str = "excess_fwd", least: int = 100, stored: bool = False) -> DataFrame:
    """Per feature and regime of (date, trend, vol): IC, rank IC and moments. stored: long is read from a table."""
    rows = long.select("date", "feature", "value", target)
    rows = (rows if stored else once(rows)).join(F.broadcast(once(regimes.select("date", "trend", "vol"))), "date")  # one row per date
    ics = feature_ics(rows, target, "trend", "vol", least=least, stored=True)
    stats = rows.groupBy("feature", "trend", "vol").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    medians = exact_quantiles(rows, "value", [0.5], "feature", "trend", "vol", stored=True).withColumn("median", F.col("q")[0]).drop("q")
    return ics.join(stats, ["feature", "trend", "vol"]).join(F.broadcast(medians), ["feature", "trend", "vol"])  # a row per feature and regime


def regime_sign_flip(ics: DataFrame) -> DataFrame:
    return ics.groupBy("feature").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.min("ic").alias("min_ic"), F.max("ic").alias("max_ic"), (F.coalesce(F.stddev_samp("ic"), F.lit(0.0)) > 0.1).alias("unstable"))


def audit_by_regime(ics: DataFrame) -> DataFrame:
    """Each feature's figures per regime with its summary over the regimes joined back.

    Adds the summary of regime_sign_flip, the regimes with the largest and the least IC, and how far a regime's IC lies from
    the feature's mean.
    """
    name = F.concat_ws("_", "trend", "vol")
    ends = ics.groupBy("feature").agg(F.max_by(name, "ic").alias("best_regime"), F.min_by(name, "ic").alias("worst_regime"), F.count("ic").alias("regimes"))
    out = ics.join(F.broadcast(regime_sign_flip(ics)), "feature").join(F.broadcast(ends), "feature")  # one row per feature
    return out.withColumn("ic_gap", F.col("ic") - F.col("mean_ic"))


def trailing_ic(long: DataFrame, target: str = "excess_fwd", days: int = 252) -> DataFrame:
    """IC of each feature over the trailing days, per date: moments per date first, so frames run over dates alone."""
    x, y = F.col("value"), F.col(target)
    per = long.where(x.isNotNull() & y.isNotNull()).groupBy("feature", "date").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    w = Window.partitionBy("feature").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    n, sx, sy, sxx, syy, sxy = (F.sum(c).over(w) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    cov, vx, vy = sxy / n - sx * sy / (n * n), sxx / n - sx * sx / (n * n), syy / n - sy * sy / (n * n)
    value = F.when((n >= 50) & (vx > 0) & (vy > 0), corr_of(cov, F.sqrt(vx), F.sqrt(vy)))
    return per.select("feature", "date", n.alias("n"), value.alias("ic"))


def corr_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, (a, b, r) with a before b, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = df.agg(*[corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(names).alias("p")).select("p.*")


def rank_columns(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Keys and the features' average-tie ranks over the rows that have them all, one feature after the other."""
    ranks = ranked_in_ranges(df.select(*keys, *features).dropna(subset=features), {f"_rank_{f}": f for f in features})
    return ranks.select(*keys, *[F.col(f"_rank_{f}").alias(f) for f in features])


def rank_corr_table(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Spearman correlation of each pair of columns over the rows that have them all, (a, b, r) with a before b.

    Ranks are made in ranges of each feature's values, and one pass over the rows of ranks adds up the matrix; NULL where a
    column does not vary.
    """
    ranks = once(rank_columns(df, features, *keys))
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(ranks).select("_x")
    found = Correlation.corr(rows, "_x").head()
    m = found[0].toArray() if found is not None else np.full((len(features), len(features)), np.nan)
    pairs = [(a, b, float(m[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    return df.sparkSession.createDataFrame([(a, b, None if np.isnan(r) else r) for a, b, r in pairs], "a string, b string, r double")


def corr_pairs(table: DataFrame, least: float = 0.85) -> DataFrame:
    return table.where(F.abs("r") >= least).withColumn("severity", F.when(F.abs("r") > 0.95, "high").otherwise("medium"))


def _matrix(table: DataFrame) -> tuple[list[str], np.ndarray]:
    """The features' correlation matrix: one number per pair of columns."""
    rows = table.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = 0.0 if r["r"] is None else r["r"]
    return names, m


def corr_clusters(table: DataFrame, least: float = 0.8) -> DataFrame:
    """Greedy clusters: each free feature takes all free ones correlated with it above `least`."""
    names, m = _matrix(table)
    free, out = set(range(len(names))), []
    for i in range(len(names)):
        group = [j for j in sorted(free) if i in free and abs(m[i, j]) > least]
        if len(group) > 1:
            free -= set(group)
            inside = [abs(m[a, b]) for x, a in enumerate(group) for b in group[x + 1 :]]
            out.append((len(out), [names[j] for j in group], len(group), float(np.mean(inside)), float(np.max(inside))))
    return table.sparkSession.createDataFrame(out, "cluster int, features array<string>, size int, avg_corr double, max_corr double")


def corr_clusters_average(table: DataFrame, distance: float = 0.15) -> DataFrame:
    """Average linkage on 1 - |r|, merged while the closest pair of clusters is within `distance`."""
    names, m = _matrix(table)
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        best = min(((np.mean([[1 - abs(m[a, b]) for b in y] for a in x]), i, i + 1 + j) for i, x in enumerate(groups) for j, y in enumerate(groups[i + 1 :])), key=lambda t: t[0])
        if best[0] > distance:
            break
        groups[best[1]] += groups.pop(best[2])
    return table.sparkSession.createDataFrame([(k, names[i]) for k, g in enumerate(groups) for i in sorted(g)], "cluster int, feature string")


def vif(table: DataFrame) -> DataFrame:
    """Variance inflation per feature: the diagonal of the inverse correlation matrix."""
    names, m = _matrix(table)
    diag = np.diag(np.linalg.inv(m + 1e-10 * np.eye(len(names))))
    return table.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, diag, strict=True)], "feature string, vif double")


def orthogonal_select(table: DataFrame, pair: float = 0.85, most_vif: float = 5.0, watch_vif: float = 3.5) -> DataFrame:
    """Which features stay: the second of a close pair goes, then what keeps a high variance inflation; with reasons."""
    names, m = _matrix(table)
    reason = {n: "" for n in names}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if abs(m[i, j]) >= pair and not reason[names[i]] and not reason[names[j]]:
                reason[names[j]] = f"correlated with {names[i]}"
    kept = [i for i, n in enumerate(names) if not reason[n]]
    inflation = dict(zip(kept, np.diag(np.linalg.inv(m[np.ix_(kept, kept)] + 1e-10 * np.eye(len(kept)))), strict=True))
    rows = [(n, not reason[n] and inflation.get(i, 0) <= most_vif, reason[n] or ("inflation" if inflation.get(i, 0) > most_vif else "watch" if inflation.get(i, 0) > watch_vif else "")) for i, n in enumerate(names)]
    return table.sparkSession.createDataFrame([(n, bool(k), r) for n, k, r in rows], "feature string, kept boolean, reason string")


def factor_composites(df: DataFrame, factors: dict[str, list[str]], target: str = "excess_fwd") -> DataFrame:
    """Adds factor__<name>, the mean of its features standardised over all rows; one broadcast row of moments."""
    features = sorted({f for fs in factors.values() for f in fs})
    stats = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_samp(f).alias(f"_s_{f}") for f in features])
    out = df.join(F.broadcast(stats))
    z = {f: F.coalesce(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")), F.lit(0.0)) for f in features}
    out = out.withColumns({f"factor__{n}": sum((z[f] for f in fs[1:]), z[fs[0]]) / len(fs) for n, fs in factors.items()})
    return out.drop(*[f"_m_{f}" for f in features], *[f"_s_{f}" for f in features])


def incremental_ic(df: DataFrame, candidate: str, base: str, target: str = "excess_fwd", least: float = 0.01) -> DataFrame:
    out = df.agg(corr(candidate, target, 10).alias("candidate_ic"), corr(base, target, 10).alias("base_ic"))
    return out.withColumn("gain", F.abs("candidate_ic") - F.abs("base_ic")).withColumn("adds", F.col("gain") > least)


def feature_validate(long: DataFrame) -> DataFrame:
    v = F.col("value")
    out = long.groupBy("feature").agg(
        F.avg(v.isNull().cast("double")).alias("null_share"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    medians = exact_quantiles(long, "value", [0.5], "feature").select("feature", F.col("q")[0].alias("median"))
    out = out.join(F.broadcast(medians), "feature", "left")  # one row per feature
    return out.withColumn("prefixed", F.col("feature").contains("__")).withColumn("huge", F.greatest(F.abs("min"), F.abs("max")) > 1e6)


def select_by_ic(ics: DataFrame, cap: int = 30) -> DataFrame:
    return ics.orderBy(F.abs("rank_ic").desc_nulls_last(), "feature").limit(cap)


def importance_keyword_flag(importance: DataFrame, themes: str = "mom|vol|ret|delivery|rank|macd|rsi") -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(15).withColumn("unexpected", ~F.col("feature").rlike(themes))


# Acceptance of a new feature


def gate_quality(long: DataFrame) -> DataFrame:
    stats = long.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    rows = long.join(F.broadcast(stats), "feature")  # one row per feature
    far = (F.abs(F.col("value") - F.col("_m")) > 5 * F.col("_s")).cast("double")
    out = rows.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("null_share"), F.count_distinct("value").alias("distinct_values"), F.coalesce(F.avg(far), F.lit(0.0)).alias("far_share"))
    return out.withColumn("passed", (F.col("null_share") <= 0.2) & (F.col("distinct_values") > 1) & (F.col("far_share") <= 0.05))


def gate_univariate(ics: DataFrame, least: float = 0.02) -> DataFrame:
    return ics.select("feature", "rank_ic", "n", ((F.col("n") >= 100) & (F.abs("rank_ic") >= least)).alias("passed"))


def gate_existing(table: DataFrame, candidate: str, most: float = 0.85) -> DataFrame:
    """Largest correlation with existing features, in a table of rank correlations."""
    rows = table.where((F.col("a") == candidate) | (F.col("b") == candidate))
    other = F.when(F.col("a") == candidate, F.col("b")).otherwise(F.col("a"))
    return rows.agg(F.max(F.abs("r")).alias("max_corr"), F.max_by(other, F.abs("r")).alias("closest")).withColumn("passed", F.col("max_corr") < most)


def gate_folds(long: DataFrame, folds: DataFrame, target: str = "excess_fwd") -> DataFrame:
    """Mean and deviation of the rank IC over test folds."""
    from .splits import in_fold

    ics = feature_ics(in_fold(long, folds), target, "fold")
    out = ics.groupBy("feature").agg(F.avg("rank_ic").alias("mean_ic"), F.stddev_pop("rank_ic").alias("std_ic"))
    return out.withColumn("passed", (F.abs("mean_ic") >= 0.02) & (F.col("std_ic") < 0.10))


def ks(long: DataFrame, side: str = "side") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature; `side` is 0 or 1. With the asymptotic p-value."""
    s = F.col(side)
    counts = once(long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count_if(s == 0).alias("_a"), F.count_if(s == 1).alias("_b")))
    run = cumulated_in_ranges(counts, "value", ["_a", "_b"], "feature", stored=True)
    sizes = counts.groupBy("feature").agg(F.sum("_a").alias("n_reference"), F.sum("_b").alias("n_current"))
    run = run.join(F.broadcast(sizes), "feature")  # one row per feature
    gap = F.abs(F.try_divide(F.col("_a_before") + F.col("_a"), "n_reference") - F.try_divide(F.col("_b_before") + F.col("_b"), "n_current"))
    out = run.groupBy("feature", "n_reference", "n_current").agg(F.max(gap).alias("ks")).select("feature", "ks", "n_reference", "n_current")
    en = F.sqrt(F.col("n_reference") * F.col("n_current") / (F.col("n_reference") + F.col("n_current")))
    x = (en + 0.12 + 0.11 / en) * F.col("ks")
    p = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 6)), F.lit(0.0))
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def psi(long: DataFrame, side: str = "side", bins: int = 10, stored: bool = False) -> DataFrame:
    """Population stability per feature against the reference's quantile bins [a, b); 0 below 10 values on a side."""
    ref = long.where((F.col(side) == 0) & F.col("value").isNotNull())
    edges = exact_quantiles(ref, "value", [i / bins for i in range(1, bins)], "feature", stored=stored).select("feature", F.array_distinct("q").alias("_e"))
    rows = long.where(F.col("value").isNotNull()).join(F.broadcast(edges), "feature")  # one row per feature
    bin_ = F.size(F.filter("_e", lambda e: e <= F.col("value")))
    counts = rows.groupBy("feature", bin_.alias("_bin")).agg(F.count_if(F.col(side) == 0).alias("_a"), F.count_if(F.col(side) == 1).alias("_b"))
    w = Window.partitionBy("feature")
    na, nb = F.sum("_a").over(w), F.sum("_b").over(w)
    a, b = F.greatest(F.try_divide("_a", na), F.lit(1e-6)), F.greatest(F.try_divide("_b", nb), F.lit(1e-6))
    return counts.withColumns({"_t": (b - a) * F.ln(b / a), "_na": na, "_nb": nb}).groupBy("feature").agg(F.when((F.max("_na") >= 10) & (F.max("_nb") >= 10), F.abs(F.sum("_t"))).otherwise(0.0).alias("psi"))


def feature_drift(long: DataFrame, side: str = "side", stored: bool = False) -> DataFrame:
    """KS, PSI and means per feature. stored: long is read from a table, so need not be written first."""
    long = long if stored else once(long.select("feature", "value", side))
    means = long.groupBy("feature").agg(F.avg(F.when(F.col(side) == 0, F.col("value"))).alias("reference_mean"), F.avg(F.when(F.col(side) == 1, F.col("value"))).alias("current_mean"))
    out = ks(long, side).select("feature", "ks").join(psi(long, side, stored=True), "feature").join(means, "feature")
    return out.withColumn("drifted", (F.col("ks") > 0.15) | (F.col("psi") > 0.20))


def prediction_drift(scores: DataFrame, side: str = "side") -> DataFrame:
    """Drift of proba, and the share of scores outside [0.05, 0.95] per side."""
    long = scores.select(F.lit("proba").alias("feature"), F.col("proba").alias("value"), side)
    out_of = (~F.col("proba").between(0.05, 0.95)).cast("double")
    ends = scores.agg(F.avg(F.when(F.col(side) == 0, out_of)).alias("reference_extreme"), F.avg(F.when(F.col(side) == 1, out_of)).alias("current_extreme"))
    return feature_drift(long, side).join(F.broadcast(ends))


def performance_drift(per_side: DataFrame) -> DataFrame:
    """(metric, reference, current): relative change and whether it breaks the metric's bound."""
    bound = F.when(F.col("metric") == "rank_ic", -0.30).when(F.col("metric") == "sharpe", -0.40).otherwise(-0.20)
    out = per_side.withColumn("change", F.try_divide(F.col("current") - F.col("reference"), F.abs("reference")))
    return out.withColumn("degraded", F.col("change") < bound)


def drift_alerts(drift: DataFrame) -> DataFrame:
    """Counts of alerts by severity, a health score, a status and whether to retrain: one row."""
    severity = F.when((F.col("ks") > 0.4) | (F.col("psi") > 0.5), "critical").when((F.col("ks") > 0.25) | (F.col("psi") > 0.35), "high").when(F.col("drifted"), "medium").otherwise("none")
    rows = drift.withColumn("_s", severity)
    out = rows.agg(*[F.count_if(F.col("_s") == s).alias(s) for s in ("critical", "high", "medium")])
    out = out.withColumn("health", F.greatest(F.lit(0), 100 - 40 * F.col("critical") - 20 * F.col("high") - 10 * F.col("medium")))
    out = out.withColumn("status", F.when(F.col("health") >= 80, "healthy").when(F.col("health") >= 60, "warning").otherwise("critical"))
    return out.withColumn("should_retrain", (F.col("critical") > 0) | (F.col("health") < 60))


# Leakage


def verify_forward_alignment(labelled: DataFrame, horizon: int = 10, tolerance: float = 1e-6) -> DataFrame:
    again = F.try_divide(lead("close", horizon), F.col("close")) - 1
    out = labelled.withColumn("_x", F.abs(again - F.col("fwd_ret"))).agg(F.max("_x").alias("worst"), F.count("_x").alias("n"))
    return out.withColumn("aligned", F.coalesce(F.col("worst") <= tolerance, F.lit(True)))


def future_corr(labelled: DataFrame, features: list[str], horizon: int = 10, most: float = 0.1) -> DataFrame:
    """Rank correlation of each feature with the label led by twice the horizon."""
    led = once(labelled.withColumn("_later", lead("excess_fwd", 2 * horizon)).select("_later", *features))
    ics = feature_ics(unpivot(led, features, "_later"), "_later", least=100, stored=True)
    return ics.select("feature", "n", "rank_ic", (F.abs("rank_ic") > most).alias("suspicious"))


def leakage_verdict(tests: DataFrame) -> DataFrame:
    """(test, passed) to one row."""
    out = tests.agg(F.count("*").alias("tests"), F.count_if(F.col("passed")).alias("passed"))
    return out.withColumn("verdict", F.when(F.col("passed") == F.col("tests"), "clean").when(F.col("passed") >= F.col("tests") - 1, "review").otherwise("leak"))


