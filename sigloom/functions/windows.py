"""Column builders for per-ticker series and per-date cross sections.

NULL stands for a missing value throughout; a rolling function of n rows is NULL until n (or `least`) non-null values
are in its frame; divisions by zero give NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import WindowSpec

EPS = 1e-9
#: Rows that in_order takes together, and groups into which it deals the keys.
HELD, PARTS = 1 << 16, 1024
Col = Column | str
#: What is averaged or ranked in order: a column, the difference of two, or a function of a function that gives columns by name.
Source = str | tuple[str, str] | Callable[[Callable[[str], np.ndarray]], np.ndarray]


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def last_rows(n: int | None) -> WindowSpec:
    """The current row and the n - 1 before it; all before it if n is None."""
    return by_ticker().rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)


def div(a: Col, b: Col) -> Column:
    return F.try_divide(col(a), col(b))


def lag(x: Col, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_ticker())


def lead(x: Col, k: int = 1) -> Column:
    return F.lead(col(x), k).over(by_ticker())


def pct(x: Col, k: int = 1) -> Column:
    """Relative change against k rows before."""
    return div(x, lag(x, k)) - 1


def rolling(fn, x: Col, n: int, least: int | None = None) -> Column:
    """An aggregate function over the last n rows with at least `least` (n) values."""
    w = last_rows(n)
    return F.when(F.count(col(x)).over(w) >= (n if least is None else least), fn(col(x)).over(w))


def mean(x: Col, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, x, n, least)


def std(x: Col, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, x, n, least)


def high(x: Col, n: int, least: int | None = None) -> Column:
    return rolling(F.max, x, n, least)


def low(x: Col, n: int, least: int | None = None) -> Column:
    return rolling(F.min, x, n, least)


def cummax(x: Col) -> Column:
    """The largest value so far."""
    return F.max(col(x)).over(last_rows(None))


def total(x: Col, n: int, least: int | None = None) -> Column:
    return rolling(F.sum, x, n, least)


def median(x: Col, n: int, least: int | None = None) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(0.5)), x, n, least)


def pair(x: Col, y: Col) -> tuple[Column, Column]:
    """Both columns where both have a value."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def corr_of(cov: Column, sx: Column, sy: Column) -> Column:
    """Correlation from population moments; NULL where a side does not vary."""
    return F.when(sx * sy > 1e-18, cov / (sx * sy))


def rolling_corr(x: Col, y: Col, n: int, least: int | None = None) -> Column:
    a, b = pair(x, y)
    w = last_rows(n)
    value = corr_of(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w), F.stddev_pop(b).over(w))
    return F.when(F.count(a).over(w) >= (n if least is None else least), value)


def corr(x: Col, y: Col, least: int = 2) -> Column:
    """Aggregate: correlation of complete pairs, NULL below `least` of them."""
    a, b = pair(x, y)
    return F.when(F.count(a) >= least, corr_of(F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)))


def beta(y: Col, x: Col, n: int) -> Column:
    """Rolling cov(y, x) / var(x) over complete pairs."""
    a, b = pair(y, x)
    w = last_rows(n)
    return F.when(F.count(a).over(w) >= n, F.covar_samp(a, b).over(w) / (F.var_samp(b).over(w) + EPS))


def trend(y: Col, n: int) -> Column:
    """Slope of a line through the last n values."""
    w = last_rows(n)
    at = F.row_number().over(by_ticker()).cast("double")
    return F.when(F.count(col(y)).over(w) >= n, F.regr_slope(col(y), at).over(w))


def so_far(x: np.ndarray, series: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each value, how many earlier ones of its series are below it and how many equal it.

    `series` numbers the series, one after another; without it there is a single one. Runs of doubling length are merged,
    in all series at once: the values of a right half are looked up in the sorted left half beside it, so n values take
    n log(n) comparisons for each of log(longest series) lengths.
    """
    _, rank = np.unique(x, return_inverse=True)
    rank, n = rank.astype(np.int64), len(x)
    below, same = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = _starts(series, n)
    at, step = np.arange(n) - first, n + 1
    length, longest = 1, int(at.max(initial=-1)) + 1
    while length < longest:
        run = at // length
        right = run % 2 == 1
        pair = (first + run // 2) * step  # no two series share a pair, since a series has fewer pairs than values
        left = np.sort((pair + rank)[~right])
        key = (pair + rank)[right]
        begin = np.searchsorted(left, pair[right], "left")
        low, high = np.searchsorted(left, key, "left"), np.searchsorted(left, key, "right")
        below[right] += low - begin
        same[right] += high - low
        length *= 2
    return below, same


def _starts(series: np.ndarray | None, n: int) -> np.ndarray:
    """For each value, where its series begins."""
    if series is None:
        return np.zeros(n, np.int64)
    return np.searchsorted(series, series, "left")


def _pct_rank(x: np.ndarray, series: np.ndarray, least: int) -> np.ndarray:
    given = ~np.isnan(x)
    below, same = so_far(x[given], series[given])
    n = np.arange(1, len(below) + 1) - _starts(series[given], len(below))
    out = np.full(len(x), np.nan)
    out[given] = np.where(n >= least, (below + (same + 2) / 2) / n * 100, np.nan)
    return out


def _averages(x: np.ndarray, alphas: list[float], place: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Exponential averages of the columns of x, to the bit those of pandas (adjust=False, ignore_na=True).

    Rows are laid out by their place in the series, long series first, so that a step takes the same place of all series
    and the rows before it are the first ones of the step before.
    """
    length = np.bincount(series)
    by_place = np.lexsort((series, -length[series], place))
    x = np.where(np.isinf(x), np.nan, x)[by_place]
    new = 1 / (1 + (1 - np.array(alphas)) / np.array(alphas))
    old = 1 - new
    both = old + new
    none = np.isnan(x)
    steps = [0, *np.cumsum(np.bincount(place)).tolist()]
    y = x.copy()
    for begin, at, end in zip(steps, steps[1:], steps[2:], strict=False):
        now, out, before = x[at:end], y[at:end], y[begin : begin + end - at]
        np.divide(old * before + new * now, both, out=out)
        np.copyto(out, before, where=none[at:end] | (before == now))
        np.copyto(out, now, where=np.isnan(before))
    made = np.empty_like(y)
    made[by_place] = y
    return made


def _means(x: np.ndarray, given: np.ndarray, place: np.ndarray, n: int, least: int) -> np.ndarray:
    """As mean(): over the last n rows of the series, added up from the oldest, where `least` of them are given."""
    x, place = np.where(given, x, 0.0), place.astype(np.int32)
    sums, rows = np.zeros(len(x)), np.arange(1, len(x) + 1)
    for k in range(min(n, int(place.max(initial=-1)) + 1) - 1, -1, -1):
        np.add(sums[k:], x[: len(x) - k], out=sums[k:], where=place[k:] >= k)
    so_many = np.concatenate([[0], np.cumsum(given)])
    count = so_many[rows] - so_many[rows - np.minimum(place + 1, n)]
    return np.where(count >= max(least, 1), sums / np.maximum(count, 1), np.nan)


def in_order(
    df: DataFrame, averages: dict[str, tuple[Source, float]], ranks: dict[str, tuple[Source, int]], key: str = "ticker", order: str = "date",
    means: dict[str, tuple[str, int, int]] | None = None, used: tuple[str, ...] = (),
) -> DataFrame:
    """Adds rolling means (as in mean: out column -> (in column, n, least)), exponential averages (as in ewm) and expanding
    ranks (as in expanding_pct_rank) in one pass over the rows, and leaves out the columns `used`.

    Keys are dealt into PARTS groups and come sorted. Whole series are taken together, about HELD rows at a time, so no
    effort is spent per key and no group is held whole. Dates pass as integers.
    """
    means = means or {}
    dates = [f.name for f in df.schema if f.dataType.typeName() == "date" and f.name not in used]
    kept = [f for f in df.withColumns({d: F.unix_date(d) for d in dates}).schema if f.name not in used]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", `{n}` double" for n in [*means, *averages, *ranks])
    plain = df.withColumns({d: F.unix_date(d) for d in dates} | {f"_given_{x}": F.col(x).isNotNull() for x, *_ in means.values()})  # NaN is a value there

    def levels() -> list[list[str]]:
        """Averages in groups, of which each rests on earlier ones alone."""
        at: dict[str, int] = {}
        for name, (x, _) in averages.items():
            at[name] = max((at[i] + 1 for i in (x if isinstance(x, tuple) else (x,)) if i in at), default=0)
        return [[n for n in at if at[n] == level] for level in sorted(set(at.values()))]

    def added(batches: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(batches, ignore_index=True)
        begins = rows.pop("_begins").to_numpy()
        series = np.cumsum(begins) - 1
        place = np.arange(len(rows)) - np.flatnonzero(begins)[series]
        made: dict[str, np.ndarray] = {}

        def values(name: str) -> np.ndarray:
            return made[name] if name in made else rows[name].to_numpy(dtype=float, na_value=np.nan)

        def source(x: Source) -> np.ndarray:
            return values(x) if isinstance(x, str) else values(x[0]) - values(x[1]) if isinstance(x, tuple) else x(values)

        for out, (x, n, least) in means.items():
            made[out] = _means(values(x), rows[f"_given_{x}"].to_numpy(dtype=bool), place, n, least)
        for names in levels():
            y = _averages(np.column_stack([source(averages[n][0]) for n in names]), [averages[n][1] for n in names], place, series)
            made |= dict(zip(names, y.T, strict=True))
        for out, (x, least) in ranks.items():
            made[out] = _pct_rank(source(x), series, least)
        return pd.DataFrame({f.name: rows[f.name] for f in kept} | {n: made[n] for n in [*means, *averages, *ranks]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n, last = 0, None
        for batch in batches:
            keys = batch[key]
            before = keys.shift()
            differ = ((keys != before) & ~(keys.isna() & before.isna())).to_numpy(dtype=bool)
            differ[:1] = last is None or not (keys.iloc[0] == last[0] or (pd.isna(keys.iloc[0]) and pd.isna(last[0])))
            last = (keys.iloc[-1],)
            begins = np.flatnonzero(differ)
            batch = batch.assign(_begins=differ)
            if n + len(batch) >= HELD and len(begins) and n + begins[-1]:
                yield added([*held, batch.iloc[: begins[-1]]])
                batch, held, n = batch.iloc[begins[-1] :], [], 0
            held.append(batch)
            n += len(batch)
        yield added(held)

    dealt = plain.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).repartition("_part").sortWithinPartitions("_part", key, order)
    return dealt.groupBy("_part").applyInPandas(run, schema).withColumns({d: F.date_from_unix_date(d) for d in dates})


def expanding_pct_rank(df: DataFrame, specs: dict[str, tuple[str, int]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds the average-tie rank of each value among all values so far, in percent: out column -> (in column, least values)."""
    return in_order(df, {}, specs, key, order)


def ewm(df: DataFrame, specs: dict[str, tuple[str | tuple[str, str], float]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds exponential averages y = (1 - alpha) * y_before + alpha * x, started by the first value of each series and
    carried on where x is NULL: out column -> (in column, alpha). A pair of columns, which may be earlier outputs, stands
    for their difference. One pass over each key's rows."""
    return in_order(df, specs, {}, key, order)


# Cross sections


def xs_zscore(x: Col, *keys: str) -> Column:
    """(x - mean) / std within the keys; 0 where the deviation is missing or zero."""
    w = Window.partitionBy(*keys)
    s = F.stddev_samp(col(x)).over(w)
    return F.when(s > 1e-12, (col(x) - F.avg(col(x)).over(w)) / s).otherwise(F.when(col(x).isNotNull(), 0.0))


def xs_pct_rank(x: Col, *keys: str) -> Column:
    """Average-tie rank over the number of values within the keys."""
    x = col(x)
    w = Window.partitionBy(*keys)
    first = F.rank().over(w.orderBy(x.asc_nulls_last()))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (first + (same - 1) / 2) / F.count(x).over(w))


def xs_relative_mean(x: Col, *keys: str) -> Column:
    return div(x, F.avg(col(x)).over(Window.partitionBy(*keys))) - 1
