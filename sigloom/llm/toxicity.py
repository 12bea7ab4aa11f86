"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are the words in it and the words' beginnings of 4 to 8 bytes (A-Z lower-cased), hashed; a feature's
value is log2(1 + count), counts above 15 as 15. A linear model is trained with numpy from confirmed toxic texts and unlabelled ones by the
non-negative risk estimator: prior * E+[l(+)] + max(0, Eu[l(-)] - prior * E+[l(-)]), l the logistic loss; when the
second part turns negative, the step goes the other way. The class prior is the toxic share of the labelled training
texts, and the score is scaled on them by a two-parameter logistic fit.

Training uses bounded samples, by hash of doc_id: max_positive toxic texts, max_unlabelled texts with their labels
hidden, max_labelled labelled texts for the scaling. Features come from whole texts on the executors; the driver gets
at most `buckets` numbers per sampled text.

Defined results: a null or empty text has no features and gets the score of the model's intercept; several labels for
an id count as toxic if one is; without a toxic training text every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import give_back, lean, text_or_empty
from .textbytes import BASES, LOWER, U64, mix, slices, span_hashes, word_spans

BUCKETS = 1 << 20
BEGINNINGS = range(4, 9)
#: Bytes of text handled at once; a word has up to six features of 8 bytes.
SLICE = 1 << 19


def features(raw: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word beginning, repeats included."""
    low = LOWER[raw]
    starts, ends, rows = word_spans(low, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    mask = U64(buckets - 1)
    out_row, out = [row], [(span_hashes(low, starts, ends) & mask).astype(np.int64)]
    lengths = ends - starts
    state = np.zeros(len(starts), U64)
    for n in range(1, max(BEGINNINGS) + 1):
        long = lengths >= n
        starts, lengths, state, row = starts[long], lengths[long], state[long], row[long]
        state = state * BASES[1] + low[starts + n - 1].astype(U64) + U64(1)
        if n in BEGINNINGS:
            out_row.append(row)
            out.append((mix(state + U64(n)) & mask).astype(np.int64))
    return np.concatenate(out_row), np.concatenate(out)


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept; rows of x are texts, `positive` marks the confirmed ones, the others are unlabelled."""
    p, u = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1]), -1.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        hidden = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_hidden = np.append(su @ u, su.sum()) / len(u) - prior * np.append(sp @ p, sp.sum()) / len(p)
        if hidden >= 0:
            grad = prior * np.append((sp - 1) @ p, (sp - 1).sum()) / len(p) + grad_hidden
        else:
            grad = -grad_hidden
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def platt(z: np.ndarray, y: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with a small ridge, by Newton steps; classes weigh as the prior says."""
    a, c = 1.0, 0.0
    design = np.stack([z, np.ones_like(z)], axis=1)
    weight = np.where(y > 0, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ [a, c], -30, 30)))
        grad = design.T @ (weight * (p - y)) + [0.1 * (a - 1), 0.1 * c]
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.05), float(c)


def train(docs: DataFrame, labels: DataFrame, training: Column, max_positive: int = 2000, max_unlabelled: int = 3000, max_labelled: int = 2500, top: int = 1024) -> dict | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) where `training` holds; None without a toxic text."""
    seeded = F.xxhash64("doc_id", F.lit(23))
    marked = labels.where(training).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    shares = marked.agg(F.avg(F.col("toxic").cast("double")).alias("prior"), F.sum("toxic").alias("n")).first()
    if not shares["n"]:
        return None
    positive = marked.where("toxic = 1").orderBy(seeded, "doc_id").limit(max_positive).withColumn("kind", F.lit(0))
    labelled = marked.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(max_labelled).withColumn("kind", F.lit(1))
    hidden = docs.where(training).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(max_unlabelled).withColumn("toxic", F.lit(0)).withColumn("kind", F.lit(2))
    chosen = positive.unionByName(labelled).unionByName(hidden).withColumn("toxic", F.col("toxic").cast("int"))
    chosen = chosen.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"), F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # a bounded sample

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offs in slices(batch.column("text"), SLICE):
                row, bucket = features(raw, offs)
                n = len(offs) - 1
                key, count = np.unique(row << 32 | bucket, return_counts=True)
                packed = (key & 0xFFFFFFFF) * 16 + np.minimum(count, 15)
                lists = np.split(packed.astype(np.int32), np.searchsorted(key >> 32, np.arange(1, n)))
                out = [batch.column(c).slice(first, n) for c in ("doc_id", "kinds", "toxic")]
                yield pa.RecordBatch.from_arrays([*out, pa.array([x.tobytes() for x in lists], pa.binary())], names=["doc_id", "kinds", "toxic", "found"])

    rows = texts.select("doc_id", text_or_empty().alias("text"), "kinds", "toxic").mapInArrow(lean(extract), "doc_id long, kinds array<int>, toxic int, found binary")
    # One text at a time, so that the driver holds the sample once, as numbers.
    got = [(r["doc_id"], set(r["kinds"]), r["toxic"], np.frombuffer(r["found"], np.int32)) for r in rows.repartition(16, "doc_id").toLocalIterator()]
    got.sort(key=lambda r: (r[0] is None, r[0] or 0))
    found, kinds, toxic = [r[3] for r in got], [r[1] for r in got], np.array([r[2] for r in got])
    del got
    is_p, is_u = np.array([0 in k for k in kinds], dtype=bool), np.array([2 in k for k in kinds], dtype=bool)
    if not is_p.any():
        return None

    def shares_of(chosen: np.ndarray) -> np.ndarray:
        hits = np.zeros(BUCKETS, np.float32)
        for i in np.flatnonzero(chosen):
            hits[found[i] >> 4] += 1
        return hits

    # Features that confirmed texts have more often than unlabelled ones, or less, by the size of the difference.
    hp, hu = shares_of(is_p), shares_of(is_u)
    n_p, n_u = is_p.sum(), max(is_u.sum(), 1)
    pooled = (hp + hu + 1) / (n_p + n_u + 2)
    strength = np.abs(hp / n_p - hu / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    strength[hp < 2] = 0
    buckets = np.sort(np.argsort(-strength, kind="stable")[:top])
    buckets = buckets[strength[buckets] > 3]
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    x = np.zeros((len(found), len(buckets)), np.float32)
    for i, f in enumerate(found):
        at = place[f >> 4]
        x[i, at[at >= 0]] = np.log2(1 + (f & 15)[at >= 0])
    del found, hp, hu, pooled, strength, place
    order = np.concatenate([np.flatnonzero(is_p), np.flatnonzero(is_u)])
    weights, intercept = nnpu(x[order], np.arange(len(order)) < n_p, float(shares["prior"]))
    with_label = np.array([1 in k or 0 in k for k in kinds])
    slope, shift = platt((x @ weights)[with_label] + intercept, (toxic[with_label] == 1).astype(float), float(shares["prior"]))
    del x
    give_back()
    return {"buckets": buckets, "weights": weights * slope, "intercept": intercept * slope + shift}


def score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """Adds a column with the probability that a text is toxic."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most `top` features
    held = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in held]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = np.full(BUCKETS, -1)
        place[m["buckets"]] = np.arange(len(m["buckets"]))
        for batch in batches:
            z = np.full(batch.num_rows, m["intercept"])
            for first, raw, offs in slices(batch.column(names.index("text")), SLICE):
                row, bucket = features(raw, offs)
                at = place[bucket]
                key, count = np.unique((row[at >= 0] << 32) | at[at >= 0], return_counts=True)
                value = m["weights"][key & 0xFFFFFFFF] * np.log2(1 + np.minimum(count, 15))
                z[first : first + len(offs) - 1] += np.bincount(key >> 32, weights=value, minlength=len(offs) - 1)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, name])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(lean(run), f"{kind}, `{name}` double")
