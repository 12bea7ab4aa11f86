"""Models on Spark ML: fits over folds, scoring, attribution and cards."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import EPS, high, lag, last_rows, low, mean, pct, rolling_corr, std
from ..tables import once
from .labels import permute_dates
from .metrics import ic, roc_auc
from .order_statistics import ranked_in_ranges

#: The name of the model of all rows, and the most regimes that may have one of their own.
OVERALL, MOST_REGIMES = "overall", 32


def fit(df: DataFrame, features: list[str], label: str = "label", kind: str = "gbt", seed: int = 42, **params) -> PipelineModel:
    """A classifier of rows without NULL features; gbt or logistic."""
    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    if kind == "gbt":
        stages = [assemble, GBTClassifier(featuresCol="_x", labelCol=label, seed=seed, **({"maxIter": 10, "maxDepth": 4, "subsamplingRate": 0.8} | params))]
    else:
        stages = [assemble, StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, **({"regParam": 0.01} | params))]
    return Pipeline(stages=stages).fit(df.dropna(subset=[*features, label]))


def score(model: PipelineModel, df: DataFrame, name: str = "proba") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def importance(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance), summing to 1."""
    last = model.stages[-1]
    values = [abs(float(x)) for x in (last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray())]
    total = sum(values) or 1.0
    return df.sparkSession.createDataFrame([(f, v / total) for f, v in zip(features, values, strict=True)], "feature string, importance double")


def compare_baseline(train: DataFrame, test: DataFrame, features: list[str], target: str = "excess_fwd") -> DataFrame:
    """Area under the curve and IC on the test rows: boosted trees, logistic regression, constant."""
    rows = []
    for name in ("gbt", "logistic"):
        s = once(score(fit(train, features, kind=name), test).select("proba", "label", target))
        rows.append(roc_auc(s).join(F.broadcast(s.agg(ic("proba", target).alias("ic")))).select(F.lit(name).alias("model"), "roc_auc", "ic"))
    constant = test.sparkSession.createDataFrame([("mean", 0.5, None)], "model string, roc_auc double, ic double")
    return rows[0].unionByName(rows[1]).unionByName(constant)


def walk_forward(df: DataFrame, folds: DataFrame, features: list[str], kind: str = "gbt", **params) -> tuple[DataFrame, DataFrame]:
    """A fit per fold of the small fold table; (stitched test scores with fold, importance per fold)."""
    scores, weights = [], []
    for f in folds.orderBy("fold").collect():
        train = df.where(F.col("date").between(F.lit(f["train_start"]), F.lit(f["train_end"])))
        test = df.where(F.col("date").between(F.lit(f["test_start"]), F.lit(f["test_end"])))
        if train.agg(F.count_distinct("label")).first()[0] < 2:
            continue
        model = fit(train, features, kind=kind, **params)
        scores.append(score(model, test).withColumn("fold", F.lit(f["fold"])))
        weights.append(importance(model, df, features).withColumn("fold", F.lit(f["fold"])))
    if not scores:
        raise ValueError("no fold has both labels to train on")
    out, imp = scores[0], weights[0]
    for a, b in zip(scores[1:], weights[1:], strict=True):
        out, imp = out.unionByName(a), imp.unionByName(b)
    return out, imp


# Models per regime


def fit_by_regime(df: DataFrame, features: list[str], regime: str = "regime", label: str = "label", least: int = 200, **params) -> dict[str, PipelineModel]:
    """A model of all rows under OVERALL, and one of its own for each regime with `least` rows and both labels."""
    rows = once(df.select(regime, label, *features))
    sizes = rows.where(F.col(regime).isNotNull()).groupBy(regime).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).limit(MOST_REGIMES + 1).collect()
    if len(sizes) > MOST_REGIMES:
        raise ValueError(f"more than {MOST_REGIMES} regimes")
    models = {OVERALL: fit(rows, features, label, **params)}
    for r in sorted(sizes, key=lambda r: str(r[regime])):
        if r["n"] >= least and r["labels"] > 1:
            models[str(r[regime])] = fit(rows.where(F.col(regime) == r[regime]), features, label, **params)
    return models


def score_by_regime(models: dict[str, PipelineModel], df: DataFrame, regime: str = "regime", name: str = "proba") -> DataFrame:
    """Each row scored by the model of its regime, by the one of all rows where its regime has none; adds `model`."""
    rows = once(df)
    own = [k for k in models if k != OVERALL]
    parts = [score(models[k], rows.where(F.col(regime) == k), name).withColumn("model", F.lit(k)) for k in own]
    rest = ~F.coalesce(F.col(regime).isin(own), F.lit(False))
    parts.append(score(models[OVERALL], rows.where(rest), name).withColumn("model", F.lit(OVERALL)))
    return reduce(DataFrame.unionByName, parts)


def metrics_by(scored: DataFrame, *keys: str, target: str = "excess_fwd") -> DataFrame:
    """Rows, area under the curve and IC per keys; ranks are made in ranges of the scores."""
    rows = ranked_in_ranges(scored.where(F.col("label").isNotNull()).select(*keys, "proba", "label", target), {"_rank": "proba"}, *keys)
    pos, n = F.sum(F.col("label").cast("double")), F.count("*")
    auc = F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("_rank"))) - pos * (pos + 1) / 2, pos * (n - pos))
    return rows.groupBy(*keys).agg(n.alias("n"), auc.alias("roc_auc"), ic("proba", target).alias("ic"))


def train_report(df: DataFrame, features: list[str], folds: DataFrame | None = None, regime: str = "regime", **params) -> DataFrame:
    """(model, part, n, roc_auc, ic) of models fitted on the rows of split = train.

    The model of all rows is measured per split and over all; each regime's own model on that regime's rows of each split;
    with folds, such as purged ones, a fit per fold is measured on the fold's test rows, under the model purged_cv.
    """
    rows = once(df.where("split is not null").select("date", regime, "split", "label", "excess_fwd", *features))
    models = fit_by_regime(rows.where("split = 'train'"), features, regime, **params)
    overall = score(models[OVERALL], rows).withColumn("model", F.lit(OVERALL))
    own = score_by_regime(models, rows, regime).where(F.col("model") != OVERALL)
    columns = ["model", "part", "label", "proba", "excess_fwd"]
    parts = [x.withColumn("part", F.col("split")).select(*columns) for x in (overall, own)] + [overall.withColumn("part", F.lit("all")).select(*columns)]
    if folds is not None:
        stitched, _ = walk_forward(rows, folds, features, **params)
        parts.append(stitched.withColumns({"model": F.lit("purged_cv"), "part": F.concat(F.lit("fold_"), F.col("fold").cast("string"))}).select(*columns))
    return metrics_by(reduce(DataFrame.unionByName, parts), "model", "part")


def score_signals(df: DataFrame, regimes: DataFrame, features: list[str], days: int = 60, **params) -> DataFrame:
    """Models of all labelled rows per regime of (date, regime); the rows of the last `days` days scored and ranked per date.

    df: features of the full history, one row per (date, ticker).
    """
    from .metrics import topk_per_date

    rows = once(df.join(F.broadcast(regimes.select("date", "regime")), "date", "left"))  # one row per date
    models = fit_by_regime(rows.where("label is not null"), features, **params)
    last = rows.agg(F.date_sub(F.max("date"), days).alias("_from"))
    recent = rows.join(F.broadcast(last)).where("date > _from").drop("_from")
    return topk_per_date(score_by_regime(models, recent), None)


def linear_baseline(train: DataFrame, features: list[str], label: str = "label", **params) -> DataFrame:
    """(feature, coefficient) of a logistic regression on standardised features, with the intercept as a feature of its own."""
    last = fit(train, features, label, kind="logistic", **params).stages[-1]
    rows = [(f, float(c)) for f, c in zip(features, last.coefficients.toArray(), strict=True)]
    return train.sparkSession.createDataFrame([*rows, ("intercept", float(last.intercept))], "feature string, coefficient double")


def null_label_test(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """A fit on labels of other dates should know nothing: IC on the test rows."""
    shuffled = once(permute_dates(once(train.select("date", "ticker", "label", *features))).select("label", *features))
    s = score(fit(shuffled, features, kind="logistic"), test)
    return s.agg(ic("proba", "excess_fwd").alias("ic")).withColumn("passed", F.coalesce(F.abs("ic") < 0.1, F.lit(True)))


def split_test(df: DataFrame, features: list[str], kind: str = "logistic") -> DataFrame:
    """Fits on split = train and measures split = test; a high area under the curve is suspicious."""
    df = once(df.select("split", "label", "excess_fwd", *features))
    s = once(score(fit(df.where("split = 'train'"), features, kind=kind), df.where("split = 'test'")).select("proba", "label", "excess_fwd"))
    out = roc_auc(s).join(F.broadcast(s.agg(ic("proba", "excess_fwd").alias("ic"))))
    return out.withColumn("passed", F.coalesce(F.col("roc_auc") < 0.6, F.lit(True)))


#: what the members of an ensemble differ in beside their seed, in turn
CONFIGS = ({"kind": "gbt", "maxDepth": 3}, {"kind": "logistic"}, {"kind": "gbt", "maxDepth": 5, "maxIter": 5})


def member(df: DataFrame, i: int, n: int, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Training rows and features of member i of n: without the i-th of n runs of dates, and every n-th feature left out."""
    chosen = [f for k, f in enumerate(features) if k % n != i] or features
    if n < 2:
        return df, chosen
    span = df.agg(F.min("date").alias("_a"), F.datediff(F.max("date"), F.min("date")).alias("_d"))
    run = F.least(F.lit(n - 1), F.floor(F.datediff("date", "_a") * n / (F.col("_d") + 1)))
    return df.join(F.broadcast(span)).where(run != i).drop("_a", "_d"), chosen


def ensemble(df: DataFrame, test: DataFrame, features: list[str], n: int = 3, configs: tuple[dict, ...] = CONFIGS) -> DataFrame:
    """(date, ticker, model, proba) of n models that differ in seed, configuration, features and dates."""
    rows, parts = once(df.select("date", "label", *features)), []
    for i in range(n):
        mine, chosen = member(rows, i, n, features)
        config = dict(configs[i % len(configs)])
        seed = {} if config.get("kind") == "logistic" else {"seed": 42 + i}
        parts.append(score(fit(mine, chosen, **seed, **config), test).select("date", "ticker", F.lit(f"m{i}").alias("model"), "proba"))
    return reduce(DataFrame.unionByName, parts)


def param_search(df: DataFrame, folds: DataFrame, features: list[str], grid: list[dict]) -> DataFrame:
    """(params, mean IC, deviation, score) of each set over the folds; score = 0.3 mean + 0.5 / (1 + std) + 0.2 share of positive folds."""
    out = None
    for params in grid:
        s, _ = walk_forward(df, folds, features, **params)
        per = s.groupBy("fold").agg(ic("proba", "excess_fwd").alias("ic"))
        row = per.agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive")).withColumn("params", F.lit(str(sorted(params.items()))))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("score", 0.3 * F.col("mean_ic") + 0.5 / (1 + F.col("std_ic")) + 0.2 * F.col("positive"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], target: str = "excess_fwd", seed: int = 42) -> DataFrame:
    """Loss of IC when a feature is dealt anew within each date; the rows are joined once with the rows they take features from."""
    df = once(df.select("date", "ticker", target, *features))
    w = Window.partitionBy("date")
    base = df.select("date", target, *features, F.row_number().over(w.orderBy("ticker")).alias("_k"))
    donors = df.select("date", *[F.col(f).alias(f"_d_{f}") for f in features], F.row_number().over(w.orderBy(F.xxhash64("ticker", F.lit(seed)), "ticker")).alias("_k"))
    both = once(base.join(donors, ["date", "_k"]).drop("date", "_k"))
    out = score(model, both.select(target, *features)).agg(ic("proba", target).alias("_base"))
    rows = None
    for f in features:
        dealt = both.select(target, *[F.col(f"_d_{f}").alias(f) if g == f else F.col(g) for g in features])
        s = score(model, dealt).agg(ic("proba", target).alias("ic")).withColumn("feature", F.lit(f))
        rows = s if rows is None else rows.unionByName(s)
    return rows.join(F.broadcast(out)).select("feature", (F.col("_base") - F.col("ic")).alias("ic_drop"))


# Meta labelling


def meta_features(df: DataFrame) -> DataFrame:
    """Context of a signal: recent return, volatility and drawdown of the ticker, volatility and trend of the market."""
    from .features import market

    m = market(df).withColumn("ticker", F.lit(0)).withColumn("_mr", pct("close"))
    m = m.select("date", std("_mr", 20).alias("market_vol_20"), (mean("close", 50, 1) / mean("close", 200, 1) - 1).alias("market_trend_50_200"))
    out = df.withColumn("_r", pct("close"))
    peak = F.max("close").over(last_rows(20))
    out = out.withColumns({"ret_5d": pct("close", 5), "vol_20": std("_r", 20), "drawdown_20": F.col("close") / peak - 1})
    return out.join(F.broadcast(m), "date", "left").drop("_r")


def meta_risk_features(df: DataFrame) -> DataFrame:
    """Risk context per ticker, and stress and breadth of the market per date; every window stays within its ticker.

    A ten-row return above 1.5 %, ten rows before, counts as a success.
    """
    from .features import market

    m = market(df).withColumn("ticker", F.lit(0)).withColumn("_market_r", pct("close"))
    m = m.withColumn("market_stress", F.try_divide(std("_market_r", 10), std("_market_r", 60))).select("date", "_market_r", "market_stress")
    out = df.withColumn("_r", pct("close")).join(F.broadcast(m), "date", "left")  # one row per date
    c, dd = F.col("close"), F.col("close") / high("close", 60) - 1
    out = out.withColumns({"drawdown_60d": dd, "drawdown_severity": F.greatest(F.lit(0.0), -dd), "_v": std("_r", 20), "ret_5d": pct("close", 5), "ret_10d_lag": F.try_divide(lag("close", 10), lag("close", 20)) - 1})
    out = out.withColumn("success_lag", F.coalesce((F.col("ret_10d_lag") > 0.015).cast("double"), F.lit(0.0)))
    return out.withColumns({
        "vol_regime_z": (F.col("_v") - mean("_v", 60, 20)) / (std("_v", 60, 20) + EPS), "momentum_quality": F.col("ret_5d") / (std("_r", 5) + EPS), "rolling_win_rate": mean("success_lag", 20),
        "risk_reward": F.try_divide(high("close", 20) - c, c) / (F.try_divide(c - low("close", 20), c) + 0.01), "market_breadth": F.avg((F.col("_r") > 0).cast("double")).over(Window.partitionBy("date")), "market_correlation": rolling_corr("_r", "_market_r", 20),
    }).drop("_r", "_v", "_market_r")


#: gate -> the condition on a row's risk features; a missing value counts 0
RISK_GATES = {
    "drawdown": ("drawdown_60d", ">", -0.15), "market_stress": ("market_stress", "<", 2.0), "win_rate": ("rolling_win_rate", ">", 0.5), "risk_reward": ("risk_reward", ">", 1.5), "falling": ("ret_5d", ">", -0.05), "breadth": ("market_breadth", ">", 0.3),
}


def meta_risk_gates(df: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """Adds `blocked_by`, the gates that a row fails, of those whose feature it has; bounds replaces gates' bounds."""
    failed = []
    for gate, (column, way, bound) in RISK_GATES.items():
        if column in df.columns:
            x, at = F.coalesce(F.col(column), F.lit(0.0)), (bounds or {}).get(gate, bound)
            failed.append(F.when(~(x > at if way == ">" else x < at), F.lit(gate)))
    return df.withColumn("blocked_by", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))


def meta_risk_filter(df: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """Rows that pass all six gates."""
    return meta_risk_gates(df, bounds).where(F.size("blocked_by") == 0).drop("blocked_by")


def kelly_size(df: DataFrame, win: str = "avg_win", loss: str = "avg_loss", vol: str = "vol_20", cap: float = 0.05) -> DataFrame:
    """Position size: the Kelly fraction for a payoff of 1 to 5, at most cap, smaller in volatile names."""
    b = F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(win, F.nullif(F.abs(loss), F.lit(0.0))), F.lit(1.0))))
    f = (F.col("proba") * b - (1 - F.col("proba"))) / b
    return df.withColumn("size", F.least(F.lit(cap), F.greatest(F.lit(0.0), f)) / (1 + 10 * F.coalesce(vol, F.lit(0.0))))


# Attribution and cards


def topn_struct(features: list[str], n: int = 10, prefix: str = "_c_"):
    """The n contributions of largest size, as an array of structs, largest first."""
    items = [F.struct(F.abs(F.col(f"`{prefix}{f}`")).alias("abs_contribution"), F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value"), F.col(f"`{prefix}{f}`").alias("contribution")) for f in features]
    return F.slice(F.sort_array(F.array(*items), asc=False), 1, n)


def attribute_linear(df: DataFrame, coefficients: dict[str, float], n: int = 10) -> DataFrame:
    """Contribution coefficient * (value - mean) of each feature, the top n, and the three largest positive ones as text."""
    features = list(coefficients)
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    out = df.join(F.broadcast(means)).withColumns({f"_c_{f}": c * (F.coalesce(F.col(f), F.col(f"_m_{f}")) - F.col(f"_m_{f}")) for f, c in coefficients.items()})
    out = out.withColumn("top_features", topn_struct(features, n))
    out = out.withColumn("rationale", F.array_join(F.transform(F.slice(F.filter("top_features", lambda x: x["contribution"] > 0), 1, 3), lambda x: x["feature"]), ", "))
    return out.drop(*[f"_m_{f}" for f in features], *[f"_c_{f}" for f in features])


def attribute_occlusion(model: PipelineModel, df: DataFrame, features: list[str], n: int = 10) -> DataFrame:
    """Contribution of a feature: the score less the score with the feature at its mean; one scoring of a long table."""
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    rows = df.join(F.broadcast(means)).withColumn("_hidden", F.explode(F.array(F.lit("none"), *[F.lit(f) for f in features])))
    rows = rows.withColumns({f: F.when(F.col("_hidden") == f, F.col(f"_m_{f}")).otherwise(F.col(f)) for f in features})
    s = score(model, rows.select("date", "ticker", "_hidden", *features), "_p")
    wide = s.groupBy("date", "ticker").pivot("_hidden", ["none", *features]).agg(F.first("_p"))
    plain = wide[wide.columns[2]]
    wide = wide.select("date", "ticker", plain.alias("proba"), *[(plain - wide[f]).alias(f"_c_{f}") for f in features])
    out = df.join(wide, ["date", "ticker"])
    return out.withColumn("top_features", topn_struct(features, n)).drop(*[f"_c_{f}" for f in features])


def signal_cards(signals: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """One nested row per signal: confidence, warnings and, if given, the date's regime; with the card as JSON."""
    p = F.col("proba")
    out = signals if regimes is None else signals.join(F.broadcast(regimes.select("date", "composite_regime", "regime_score", "allow_entry")), "date", "left")
    warnings = [F.when(p < 0.55, F.lit("low confidence"))]
    if "volatility__price_vol_20" in signals.columns:
        warnings.append(F.when(F.col("volatility__price_vol_20") > 0.04, F.lit("high volatility")))
    if regimes is not None:
        warnings.append(F.when(~F.coalesce("allow_entry", F.lit(True)), F.lit("regime blocks entry")))
    rank = F.percent_rank().over(Window.partitionBy("date").orderBy("proba"))
    out = out.withColumns({"confidence": F.when(p >= 0.75, "high").when(p >= 0.60, "medium").otherwise("low"), "warnings": F.array_compact(F.array(*warnings)), "percentile": rank * 100})
    fields = [c for c in ("date", "ticker", "proba", "confidence", "percentile", "warnings", "composite_regime", "regime_score") if c in out.columns]
    return out.withColumn("card", F.to_json(F.struct(*fields)))


