"""All registered queries of the equity-signal operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import base
from .plans import core as _core  # noqa: F401  registers its queries
from .plans import diagnosis as _diagnosis  # noqa: F401
from .plans import evaluation as _evaluation
from .plans import features as _features  # noqa: F401
from .plans import models as _models  # noqa: F401
from .plans import reports as _reports  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation.flagship(spark, sf_dir)
