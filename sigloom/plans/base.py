"""The query registry, and SQL text for the oracle's windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with the oracle's SQL if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def near(x, digits: int = 6):
    """Rounds half away from zero, to `digits` decimals below 1000 and to 2 above, 1e12 at most; no negative zero.

    Spelled out so that both engines do the same arithmetic on equal doubles.
    """
    x = x.cast("double")
    p = F.when(F.abs(x) >= 1000, F.lit(100.0)).otherwise(F.lit(float(10**digits)))
    return F.signum(x) * F.floor(F.least(F.abs(x), F.lit(1e12)) * p + 0.5).cast("double") / p + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str], *keys: str, digits: int = 6) -> DataFrame:
    """Keys and rounded columns."""
    return df.select(*keys, *[near(F.col(f"`{c}`"), digits).alias(c) for c in columns])


# SQL text


def r(x: str, digits: int = 6) -> str:
    p = f"(CASE WHEN ABS({x}) >= 1000 THEN 100.0 ELSE {10**digits}.0 END)"
    return f"SIGN({x}) * FLOOR(LEAST(ABS(CAST({x} AS DOUBLE)), 1e12) * CAST({p} AS DOUBLE) + 0.5) / CAST({p} AS DOUBLE) + 0.0"


def win(n: int | None, extra: str = "") -> str:
    before = "UNBOUNDED" if n is None else n - 1
    return f"(PARTITION BY ticker ORDER BY date{extra} ROWS BETWEEN {before} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN COUNT({x}) OVER {win(n)} >= {n if least is None else least} THEN {fn}({x}) OVER {win(n)} END"


def m(x: str, n: int, least: int | None = None) -> str:
    return "(" + roll("AVG", x, n, least) + ")"


def s(x: str, n: int, least: int | None = None) -> str:
    return "(" + roll("STDDEV_SAMP", x, n, least) + ")"


def mx(x: str, n: int, least: int | None = None) -> str:
    return "(" + roll("MAX", x, n, least) + ")"


def mn(x: str, n: int, least: int | None = None) -> str:
    return "(" + roll("MIN", x, n, least) + ")"


def tot(x: str, n: int, least: int | None = None) -> str:
    return "(" + roll("SUM", x, n, least) + ")"


def med(x: str, n: int, least: int | None = None) -> str:
    return f"(CASE WHEN COUNT({x}) OVER {win(n)} >= {n if least is None else least} THEN QUANTILE_CONT({x}, 0.5) OVER {win(n)} END)"


def lagged(x: str, k: int = 1) -> str:
    return f"LAG({x}, {k}) OVER (PARTITION BY ticker ORDER BY date)"


def pc(x: str, k: int = 1) -> str:
    return f"({x} / NULLIF({lagged(x, k)}, 0) - 1)"


def corr_roll(x: str, y: str, n: int, least: int | None = None) -> str:
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    w = win(n)
    sd = f"(STDDEV_POP({a}) OVER {w} * STDDEV_POP({b}) OVER {w})"
    return f"(CASE WHEN COUNT({a}) OVER {w} >= {n if least is None else least} AND {sd} > 1e-18 THEN COVAR_POP({a}, {b}) OVER {w} / {sd} END)"


def corr_agg(x: str, y: str, least: int = 2) -> str:
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"(CASE WHEN COUNT({a}) >= {least} AND STDDEV_POP({a}) * STDDEV_POP({b}) > 1e-18 THEN COVAR_POP({a}, {b}) / (STDDEV_POP({a}) * STDDEV_POP({b})) END)"


def beta_roll(y: str, x: str, n: int) -> str:
    a, b = f"(CASE WHEN {x} IS NOT NULL THEN {y} END)", f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    return f"(CASE WHEN COUNT({a}) OVER {win(n)} >= {n} THEN COVAR_SAMP({a}, {b}) OVER {win(n)} / (VAR_SAMP({b}) OVER {win(n)} + 1e-9) END)"


def exp_rank(x: str, least: int = 1, w: str | None = None) -> str:
    seen = f"LIST({x}) FILTER (WHERE {x} IS NOT NULL) OVER {w or win(None)}"
    return f"(CASE WHEN {x} IS NOT NULL AND LEN({seen}) >= {least} THEN (LEN(LIST_FILTER({seen}, lambda v: v < {x})) + (LEN(LIST_FILTER({seen}, lambda v: v = {x})) + 1) / 2.0) / LEN({seen}) * 100 END)"


def ew(x: str, alpha: float) -> str:
    seen = f"LIST({x}) FILTER (WHERE {x} IS NOT NULL) OVER {win(None)}"
    return f"(CASE WHEN LEN({seen}) > 0 THEN LIST_REDUCE({seen}, lambda a, v: a * {1 - alpha!r} + v * {alpha!r}) END)"


def xs_rank(x: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"(CASE WHEN {x} IS NOT NULL THEN (RANK() OVER (PARTITION BY {k} ORDER BY {x} NULLS LAST) + (COUNT(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0) / COUNT({x}) OVER (PARTITION BY {k}) END)"


def xs_z(x: str, *keys: str) -> str:
    w = f"OVER (PARTITION BY {', '.join(keys)})"
    return f"(CASE WHEN STDDEV_SAMP({x}) {w} > 1e-12 THEN ({x} - AVG({x}) {w}) / STDDEV_SAMP({x}) {w} WHEN {x} IS NOT NULL THEN 0.0 END)"


def _names(keys: str) -> list[str]:
    """Output names of a key list such as "date, COUNT(*) AS n"."""
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(keys + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(keys[at:i])
            at = i + 1
    return [x.split(" AS ")[-1].split(".")[-1].strip() for x in parts if x.strip()]


def select(ctes: list[str], keys: str, columns: dict[str, str], source: str, tail: str = "", digits: int = 6) -> str:
    """Keys and rounded columns from the last of some common table expressions."""
    raw = ", ".join([*([keys] if keys else []), *(f"CAST({v} AS DOUBLE) AS {k}" for k, v in columns.items())])
    names = ", ".join([*_names(keys), *(f"{r(k, digits)} AS {k}" for k in columns)])
    head = ", ".join([*ctes, f"raw_ AS (SELECT {raw} FROM {source} {tail})"])
    return f"WITH {head} SELECT {names} FROM raw_"
