"""Running sums, ranks and exact quantiles per key, without a task that holds all rows of a key.

A key's values are cut into ranges of about equal size by an approximate sketch. A range is summed or ranked by itself,
and what the ranges before it hold is added; which edges the sketch gives changes the load of tasks alone, not results.
Keys are few, such as features, regimes and folds, since a list of `ranges` numbers per key passes through the driver;
they may not be NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import once

RANGES = 64
#: Half width of a quantile's bracket, in ranks over all rows; the sketch is off by half of it at most.
BRACKET = 2e-4
#: Counts up to which the driver reads a bracket's values itself.
SMALL_ROWS = 100_000


def _edges(df: DataFrame, order: str, keys: tuple[str, ...], ranges: int) -> DataFrame:
    """Per key its number, _key, and the _edges of its ranges; a row per key."""
    cuts = [i / ranges for i in range(1, ranges)]
    found = df.where(F.col(order).isNotNull()).groupBy(*keys).agg(F.percentile_approx(order, cuts, 10 * ranges).alias("_edges"))
    rows = [(*r, i) for i, r in enumerate(found.collect())]
    return F.broadcast(df.sparkSession.createDataFrame(rows, found.withColumn("_key", F.lit(0)).schema))


def _in_ranges(df: DataFrame, edges: DataFrame, order: str, keys: tuple[str, ...], ranges: int) -> DataFrame:
    """Adds _key, _range, how many of the key's edges are below `order` (NULL for NULL), and _many, whether the value fills a
    range by itself and so stands twice among the edges. `ranges` is a power of two."""
    out = (df.join(edges, list(keys), "left") if keys else df.join(edges)).withColumn("_range", F.when(F.col(order).isNotNull(), 0))
    step = ranges // 2
    while step:  # binary search
        out = out.withColumn("_range", F.col("_range") + F.when(F.get("_edges", F.col("_range") + (step - 1)) < F.col(order), step).otherwise(0))
        step //= 2
    many = (F.get("_edges", F.col("_range")) == F.col(order)) & (F.get("_edges", F.col("_range") + 1) == F.col(order))
    return out.withColumn("_many", F.coalesce(many, F.lit(False))).drop("_edges")


def _before(sums: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """A row per key and range (_key, *by, columns) with <column>_sum, what the key's ranges before it hold."""
    rows = sorted(tuple(r) for r in sums.select("_key", *by, *columns).collect())
    n, out, total = 1 + len(by), [], {}
    for r in rows:
        so_far = total.setdefault(r[0], [0] * len(columns))
        out.append((*r, *so_far))
        total[r[0]] = [a + (b or 0) for a, b in zip(so_far, r[n:], strict=True)]
    schema = sums.select("_key", *by, *columns, *[F.col(c).alias(f"{c}_sum") for c in columns]).schema
    return F.broadcast(sums.sparkSession.createDataFrame(out, schema))  # two for each of the ranges of a key, at most


def cumulated_in_ranges(df: DataFrame, order: str, columns: list[str], *keys: str, stored: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds <column>_before: the key's sum over all rows with a smaller `order`, whose values a key may not repeat."""
    df = df if stored else once(df)
    rows = _in_ranges(df.where(F.col(order).isNotNull()), _edges(df, order, keys, ranges), order, keys, ranges).drop("_many")
    sums = _before(rows.groupBy("_key", "_range").agg(*[F.sum(c).alias(c) for c in columns]), columns, "_range").drop(*columns)
    w = Window.partitionBy("_key", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = {c: F.lit(0).cast(df.schema[c].dataType) for c in columns}
    # The sums come after the window, which sorts the rows. All rows have theirs; an inner join would have Spark test that the
    # range is not null, with the whole binary search written out for it, at many times the cost of the rest.
    out = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), zero[c]) for c in columns}).join(sums, ["_key", "_range"], "left")
    return out.select(*df.columns, *[(F.col(f"{c}_before") + F.col(f"{c}_sum")).alias(f"{c}_before") for c in columns])


def ranked_in_ranges(df: DataFrame, columns: dict[str, str], *keys: str, stored: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds average-tie ranks (out -> in) within the keys, NULL for NULL.

    The rows of a range are sorted by one task. Those of a value that fills a range by itself, and those without a value,
    are dealt over the tasks, as all of them have one rank. stored: df is read from a table, so need not be written first.
    """
    df = df if stored else once(df)
    out = df
    for name, x in columns.items():
        kept, edges = out.columns, _edges(df, x, keys, ranges)
        rows = _in_ranges(out, edges, x, keys, ranges)
        counts = _in_ranges(df, edges, x, keys, ranges).where(F.col(x).isNotNull()).groupBy("_key", "_range", "_many").agg(F.count("*").alias("_n"))
        counts = _before(counts, ["_n"], "_range", "_many")
        one_rank = F.col("_many") | F.col(x).isNull()
        # One number for key, range and place of the rows of one rank, so that the exchange carries no more.
        place = F.when(one_rank, 1 + F.pmod(F.spark_partition_id(), F.lit(ranges - 1))).otherwise(0)
        at = (F.coalesce("_key", F.lit(-1)).cast("long") * ranges + F.coalesce("_range", F.lit(0))) * 2 + F.col("_many").cast("int")
        rows = rows.select(*kept, (at * ranges + place).alias("_range"))
        w = Window.partitionBy("_range").orderBy(x)
        within = (F.rank().over(w) + F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2
        offsets = counts.select(((F.col("_key").cast("long") * ranges + F.col("_range")) * 2 + F.col("_many").cast("int")).alias("_at"), "_many", "_n", "_n_sum")
        ranks = rows.withColumn("_within", within).withColumn("_at", F.floor(F.col("_range") / ranges))
        ranks = ranks.join(F.broadcast(offsets), "_at", "left")
        value = F.col("_n_sum") + F.when(F.col("_many"), (F.col("_n") + 1) / 2).otherwise(F.col("_within"))
        out = ranks.select(*kept, F.when(F.col(x).isNotNull(), value).alias(name))
    return out


def _values_at(counts: DataFrame, needs: dict[tuple, list[int]], keys: tuple[str, ...]) -> dict[tuple, float]:
    """(key, rank's place in its list) -> the value at that rank, from counts (keys, _x, _n) per value."""
    found: dict[tuple, float] = {}

    def see(key: tuple, x: float, before: int, n: int) -> None:
        for at, rank in enumerate(needs[key]):
            if before <= rank < before + n:
                found[(*key, at)] = x

    rows = counts.limit(SMALL_ROWS + 1).collect()
    if len(rows) <= SMALL_ROWS:
        before: dict[tuple, int] = {}
        for r in sorted(rows, key=lambda r: r["_x"]):
            key = tuple(r[k] for k in keys)
            see(key, r["_x"], before.get(key, 0), r["_n"])
            before[key] = before.get(key, 0) + r["_n"]
        return found
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    sent = F.broadcast(counts.sparkSession.createDataFrame([(*k, v) for k, v in needs.items()], f"{kinds}, _ranks array<long>"))  # a row per key and quantile
    run = cumulated_in_ranges(counts, "_x", ["_n"], *keys, stored=True).join(sent, list(keys))
    hit = F.exists("_ranks", lambda r: (r >= F.col("_n_before")) & (r < F.col("_n_before") + F.col("_n")))
    for r in run.where(hit).collect():
        see(tuple(r[k] for k in keys), r["_x"], r["_n_before"], r["_n"])
    return found


def exact_quantiles(df: DataFrame, x: str, probs: list[float], *keys: str, bracket: float = BRACKET, stored: bool = False) -> DataFrame:
    """One row per key with q, the quantiles of x, interpolated between neighbouring values.

    A sketch brackets each quantile by rank. Rows below a bracket are counted, rows inside are counted per value, and the
    values at the two ranks wanted are read off running counts. A bracket that misses its ranks is widened to all rows.
    A number per key and quantile passes through the driver. stored: df is read from a table, so need not be written first.
    """
    spark = df.sparkSession
    all_ = "_all"
    keys = keys or (all_,)
    rows = df.where(F.col(x).isNotNull())
    rows = rows.select(*[F.lit(0).alias(k) if k == all_ else F.col(k) for k in keys], F.col(x).cast("double").alias("_x"))
    rows = rows if stored else once(rows)
    lows, highs = [max(0.0, p - bracket) for p in probs], [min(1.0, p + bracket) for p in probs]
    sketch = F.percentile_approx("_x", [*lows, *highs], math.ceil(2 / bracket))
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("min"), F.max("_x").alias("max"), sketch.alias("s")).collect()
    if not per_key:
        return spark.createDataFrame([], rows.select(*keys).withColumn("q", F.array(F.lit(0.0))).schema).drop(all_)

    wanted = []
    for r in per_key:
        ends = zip(probs, lows, highs, r["s"][: len(probs)], r["s"][len(probs) :], strict=True)
        between = [(r["min"] if low <= 0 else a, r["max"] if high >= 1 else b) for _, low, high, a, b in ends]
        at = [p * (r["n"] - 1) for p in probs]
        wanted.append((*[r[k] for k in keys], [a for a, _ in between], [b for _, b in between], [math.floor(p) for p in at], [math.ceil(p) for p in at]))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    sent = F.broadcast(spark.createDataFrame(wanted, f"{kinds}, _lo array<double>, _hi array<double>, _k0 array<long>, _k1 array<long>"))  # a row per key
    held = rows.join(sent, list(keys))
    js = range(len(probs))
    below = {tuple(r[k] for k in keys): r["_below"] for r in held.groupBy(*keys).agg(F.array(*[F.count_if(F.col("_x") < F.col("_lo")[j]) for j in js]).alias("_below")).collect()}
    inside = F.filter(F.array(*[F.lit(j) for j in js]), lambda j: (F.col("_x") >= F.get("_lo", j)) & (F.col("_x") <= F.get("_hi", j)))
    counts = once(held.select(*keys, "_x", F.explode(inside).alias("_j")).groupBy(*keys, "_j", "_x").agg(F.count("*").alias("_n")))
    needs = {(*r[: len(keys)], j): [r[-2][j] - below[r[: len(keys)]][j], r[-1][j] - below[r[: len(keys)]][j]] for r in wanted for j in js}
    values = _values_at(counts, needs, (*keys, "_j"))
    if len(values) < 2 * len(probs) * len(per_key):
        return exact_quantiles(df, x, probs, *[k for k in keys if k != all_], bracket=1.0, stored=stored)
    out = []
    for r in per_key:
        key, q = tuple(r[k] for k in keys), []
        for j, p in enumerate(probs):
            at = p * (r["n"] - 1)
            low, high = values[(*key, j, 0)], values[(*key, j, 1)]
            q.append(low if math.floor(at) == math.ceil(at) or low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
        out.append((*key, q))
    return spark.createDataFrame(out, f"{kinds}, q array<double>").drop(all_)
