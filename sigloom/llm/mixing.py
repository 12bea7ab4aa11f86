"""Mixing sources to target weights, with DataFrame operations alone.

Each source's target is its share, by weight, of all words, capped at `cap` times the source's own words; what the cap
cuts off goes to the other sources by weight until no target is above its cap. A source is cut by a hash of doc_id into
blocks of about block_words words; an output shard owns neighbouring blocks of each source. Whole epochs of the target
take every block entirely. The rest, a number of words, is drawn without replacement: a splitting tree halves the range
of output shards, then that of the blocks of a shard, and each half's quota is a hypergeometric draw, so the quotas of
all shards and blocks are one multivariate-hypergeometric draw; from 1e9 words on, a node draws by the normal law with
the same mean and variance. Each block fills its quota with its documents in permuted order as long as they fit; what
then is left is filled the same way from the documents that are small enough, DRAWS times in all, and one that overshoots
if that comes nearer. Rows are ordered by hash within a shard.

The tree runs on the driver over the totals of sources and blocks, at most max_blocks numbers per source; Spark joins
them, by broadcast up to BROADCAST_ROWS rows.

Defined results: null text has size 0 and is never needed for a quota (taken 0); a null source is a source of its own,
the last; an empty table gives no rows; the input's other columns are kept and may not start with "mix_"; equal rows
are drawn independently. The same input and seed give the same result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import materialize, word_count

DRAWS = 3
BROADCAST_ROWS = 100_000


def target_words(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Shares sum(sizes) by weight; no target above cap times its size, the excess reshared by weight."""
    target = [0.0] * len(sizes)
    free, rest = list(range(len(sizes))), float(sum(sizes))
    while free:
        level = rest / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            rest -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` are good; above numpy's limit by the normal law with the same mean and variance."""
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    p = good / total
    spread = (draws * p * (1 - p) * (total - draws) / (total - 1)) ** 0.5
    return int(min(max(round(rng.normal(draws * p, spread)), draws - bad, 0), good, draws))


def split_quota(blocks: Sequence[int], quota: int, seed: Sequence[int]) -> list[int]:
    """Splits a quota over blocks as words drawn without replacement would fall, halving the range at each node."""
    sums = np.concatenate([[0], np.cumsum(np.asarray(blocks, dtype=np.int64))])
    out = [0] * len(blocks)
    todo = [(0, len(blocks), quota)]
    while todo:
        low, high, q = todo.pop()
        if high - low == 1:
            out[low] = q
        elif q:
            mid = (low + high) // 2
            good, bad = int(sums[mid] - sums[low]), int(sums[high] - sums[mid])
            left = hypergeometric(np.random.default_rng([*seed, low, high]), good, bad, q)
            todo += [(low, mid, left), (mid, high, q - left)]
    return out


def _rows(rows: list[dict], schema: str, df: DataFrame) -> DataFrame:
    """A small table from a literal."""
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _named(rows: list[dict], schema: str, df: DataFrame) -> DataFrame:
    """The same with names that no input column has, marked for broadcast while it is small."""
    out = _rows(rows, schema, df)
    out = out.select(*(F.col(c).alias(f"mix__{c}") for c in out.columns))
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def mixing_plan(
    docs: DataFrame, size: Column | None = None, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 17, block_words: int = 250_000, max_blocks: int = 65_536
) -> DataFrame:
    """Adds mix_size, mix_source_size, mix_target, mix_shard and mix_copies (how often the mix takes the row)."""
    size = word_count() if size is None else size
    cols = docs.columns

    sized = docs.withColumn("mix_size", size)
    hashes = materialize(sized.select("source", "mix_size", "doc_id"))
    sources = hashes.groupBy("source").agg(F.sum("mix_size").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    total = sum(r["words"] for r in sources)

    def pieces(words: int) -> int:
        return int(min(max(1, -(-words // block_words)), max_blocks))

    targets = target_words([r["words"] for r in sources], [weights[i % len(weights)] for i in range(len(sources))], cap)
    per_source = []
    for r, target in zip(sources, targets, strict=True):
        epochs = int(target / r["words"] + 1e-9) if r["words"] else 0
        per_source.append({"s": r["source"], "w": r["words"], "t": target, "e": epochs, "j": pieces(r["words"]), "z": zlib.crc32((r["source"] or "").encode())})
    of_source = _named(per_source, "s string, w bigint, t double, e int, j int, z bigint", docs)

    def blocked(rows: DataFrame) -> DataFrame:
        out = rows.join(of_source, rows["source"].eqNullSafe(of_source["mix__s"]), "left").drop("mix__s")
        return out.withColumn("mix__block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.coalesce("mix__j", F.lit(1))).cast("int"))

    blocks: dict = {r["s"]: [0] * r["j"] for r in per_source}
    for r in blocked(hashes).groupBy("source", "mix__block").agg(F.sum("mix_size").alias("words")).collect():
        blocks[r["source"]][r["mix__block"]] = r["words"]
    per_block = []
    for r in per_source:
        rest = min(max(round(r["t"] - r["e"] * r["w"]), 0), r["w"])
        quotas = split_quota(blocks[r["s"]], rest, [seed, r["z"], r["s"] is None])
        per_block += [{"s": r["s"], "b": b, "q": q} for b, q in enumerate(quotas) if q]

    of_block = _named(per_block, "s string, b int, q bigint", docs)
    rows = blocked(sized)
    rows = rows.join(of_block, rows["source"].eqNullSafe(of_block["mix__s"]) & (rows["mix__block"] == of_block["mix__b"]), "left").drop("mix__s", "mix__b")
    shards = pieces(total)
    owner = F.floor(F.col("mix__block") * F.lit(shards) / F.coalesce("mix__j", F.lit(1)))
    rows = rows.withColumn("mix_shard", F.pmod(owner + F.col("mix__z"), F.lit(shards)).cast("int"))

    block_rows = Window.partitionBy("source", "mix__block")
    by_hash = F.xxhash64("doc_id", F.lit(seed + 1))
    permuted = block_rows.orderBy(by_hash, "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    size_, left, drawn, new = F.col("mix_size"), F.col("mix__left"), F.col("mix__drawn"), F.col("mix__new")
    rows = rows.withColumn("mix__drawn", F.lit(False)).withColumn("mix__left", F.coalesce("mix__q", F.lit(0)))
    for _ in range(DRAWS):
        fits = ~drawn & size_.between(1, left)
        rows = rows.withColumn("mix__upto", F.sum(F.when(fits, size_).otherwise(0)).over(permuted))
        rows = rows.withColumn("mix__new", fits & (F.col("mix__upto") <= left))
        rows = rows.withColumn("mix__left", left - F.sum(F.when(new, size_).otherwise(0)).over(block_rows))
        rows = rows.withColumn("mix__drawn", drawn | new)
    # One more document that overshoots, if that comes nearer than leaving the rest open.
    nearer = ~drawn & (size_ > left) & (size_ < 2 * left)
    first = F.row_number().over(block_rows.orderBy(F.when(nearer, size_).asc_nulls_last(), by_hash, "doc_id"))
    rows = rows.withColumn("mix__drawn", drawn | (nearer & (first == 1)))
    copies = F.when(size_ > 0, F.col("mix__e")).otherwise(0) + drawn.cast("int")
    added = [size_, F.col("mix__w").alias("mix_source_size"), F.col("mix__t").alias("mix_target"), F.col("mix_shard"), copies.alias("mix_copies")]
    return rows.select(*(F.col(f"`{c}`") for c in cols), *added)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows, each as often as it was drawn, with mix_shard; shuffled within each shard."""
    seed = options.get("seed", 17)
    plan = mixing_plan(docs, **options).where("mix_copies > 0")
    copies = plan.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.repartition(n, "mix_shard").sortWithinPartitions("mix_shard", F.xxhash64("doc_id", "mix_copy", F.lit(seed + 2)))
    return dealt.select(*(F.col(f"`{c}`") for c in docs.columns), "mix_shard")
