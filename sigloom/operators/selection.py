"""Feature selection and meta models by refits over a small fold table.

The loops run over features and folds, a bounded number of Spark ML fits; each fit and each coefficient is a distributed
job over all rows. The frame should be materialised, since every fit reads it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ic
from .ml import fit, score, walk_forward


def cv_ic(df: DataFrame, folds: DataFrame, features: list[str], kind: str = "logistic", target: str = "excess_fwd", **params) -> float:
    """Mean over the folds of the out-of-sample IC; 0 without one."""
    scores, _ = walk_forward(df, folds, features, kind, **params)
    per = scores.groupBy("fold").agg(ic("proba", target).alias("ic"))
    return per.agg(F.avg("ic")).first()[0] or 0.0


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def oos_ic_filter(df: DataFrame, folds: DataFrame, features: list[str], least: float = 0.0, **params) -> DataFrame:
    """(feature, ic, kept): each feature alone, kept if its mean out-of-sample IC is above `least`."""
    ics = [(f, cv_ic(df, folds, [f], **params)) for f in features]
    return _table(df, [(f, x, x > least) for f, x in ics], "feature string, ic double, kept boolean")


def group_selection(df: DataFrame, folds: DataFrame, features: list[str], least: float = 0.0, **params) -> DataFrame:
    """(block, features, ic, kept): the features of each block together."""
    blocks: dict[str, list[str]] = {}
    for f in features:
        blocks.setdefault(f.split("__")[0], []).append(f)
    ics = [(b, len(fs), cv_ic(df, folds, fs, **params)) for b, fs in sorted(blocks.items())]
    return _table(df, [(b, n, x, x > least) for b, n, x in ics], "block string, features int, ic double, kept boolean")


def backward_elimination(df: DataFrame, folds: DataFrame, features: list[str], tolerance: float = 0.0, keep: int = 1, **params) -> DataFrame:
    """(step, removed, ic): removes the feature whose loss leaves the best IC, while that falls by `tolerance` at most."""
    left, best = list(features), cv_ic(df, folds, list(features), **params)
    rows = [(0, None, best)]
    while len(left) > keep:
        tried = [(cv_ic(df, folds, [g for g in left if g != f], **params), f) for f in left]
        value, worst = max(tried)
        if value < best - tolerance:
            break
        left.remove(worst)
        best = max(best, value)
        rows.append((len(rows), worst, value))
    return _table(df, rows, "step int, removed string, ic double")


def gate_incremental(df: DataFrame, folds: DataFrame, base: list[str], candidate: str, least: float = 0.01, **params) -> DataFrame:
    """(feature, without, with, gain, passed): what a candidate adds to the out-of-sample IC of the features there are."""
    without, both = cv_ic(df, folds, base, **params), cv_ic(df, folds, [*base, candidate], **params)
    return _table(df, [(candidate, without, both, both - without, both - without >= least)], "feature string, without double, with double, gain double, passed boolean")


def meta_model(signals: DataFrame, features: list[str], win: str = "excess_fwd", kind: str = "gbt", **params) -> PipelineModel:
    """A classifier of whether a signal pays, from its context."""
    return fit(signals.withColumn("_paid", (F.col(win) > 0).cast("int")), features, "_paid", kind, **params)


def meta_filter(model: PipelineModel, signals: DataFrame, least: float = 0.5) -> DataFrame:
    """Signals that the meta model gives a chance of `least` or more, with it."""
    return score(model, signals, "meta_proba").where(F.col("meta_proba") >= least)

