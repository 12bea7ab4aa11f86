"""Near duplicates of texts and vectors, substring dedup and nearest neighbours, against brute force."""

import random

import numpy as np
import pytest

from sigloom.llm import ann, components, jaccard, substring_dedup, vector_dedup

from .conftest import words


def shingles(text, k):
    w = words(text)
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(sets, num, den):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def near_copies(seed, groups=6, copies=8, length=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    out, i = [], 0
    shared = [rng.choice(vocab) for _ in range(30)]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, length))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            if rng.random() < 0.3:
                text += shared
            out.append((i, " ".join(text)))
            i += 1
    return out


@pytest.mark.parametrize(("k", "num", "blocks"), [(3, 90, 1024), (5, 80, 1024), (2, 60, 4)])
def test_jaccard_join_against_brute_force(spark, k, num, blocks):
    rows = near_copies(k * 7 + num)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100, block_rows=blocks).collect()
    sets = {i: shingles(t, k) for i, t in rows}
    want = brute_components(sets, num, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


def test_jaccard_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(0)
    for n in (10, 25, 60, 200, 700, 3000):
        for num in (80, 90):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for _ in range(20):
                d = int(rng.integers(0, n // 5 + 1))
                b = np.unique(np.concatenate([a[d:], rng.integers(0, 1 << 63, int(rng.integers(0, d + 1))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both) and len(a) != both:
                    ends = jaccard.size_classes(4096, num, 100)
                    assert set(jaccard.keys_of(a, num, 100, ends).tolist()) & set(jaccard.keys_of(b, num, 100, ends).tolist())


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(odd_docs).collect()}
    assert got[(1, 116)] == got[(2, 116)] == 1 and got[(3, 116)] == 1 and got[(4, 0)] == 4 and got[(5, 0)] == 5 and got[(8, 1)] == 8
    assert got[(None, 1)] is None or (None, 1) in got
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_jaccard_join_on_repeated_ids(spark):
    """Two different texts under one id, each with a near copy elsewhere; some ids chain groups; repeated rows."""
    rng = random.Random(12)
    own = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    near = lambda t: [*t[:40], "changed", *t[41:]]
    rows, edges = [], []
    for g in range(30):
        a, b = own(), own()
        i = 1000 - 10 * g
        rows += [(i, a), (i, b), (i + 1, near(a)), (i + 2, near(b)), (i + 3, own())]
        edges.append({i, i + 1, i + 2})
        if g % 3 == 0:
            rows.append((i + 4, near(a)))
            rows.append((i - 9, near(own())))  # a second text of the next group's i + 1
            edges[-1].add(i + 4)
        if g % 5 == 0:
            rows.append((i, a))
    rows += [(5000, own()), (5000, []), (None, rows[0][1])]
    got = jaccard.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"), 3, 90, 100).collect()
    assert len(got) == len(rows)
    want = {i: i for i, _ in rows}
    for group in edges:
        want |= {i: min(group) for i in group}
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 5000) == [0, 78]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_substring_dedup(spark, odd_docs, no_docs):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(5000)]
    own = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = own(70)
    rows = []
    for i in range(30):
        text = own(80) + (passage if i % 3 == 0 else []) + own(60)
        rows.append((i, " ".join(text)))
    rows.append((30, rows[4][1]))
    got = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:30]:
        if i % 3 or i == 0:
            assert got[i]["text"] == text and got[i]["removed_words"] == 0, i
        else:
            assert 45 <= got[i]["removed_words"] <= 70, i
            assert set(got[i]["text"].split()) >= set(text.split()) - set(passage)
    assert got[30]["text"] == "" and got[30]["removed_words"] == got[30]["n_words"]
    odd = substring_dedup.dedup(odd_docs)
    assert odd.columns == [*odd_docs.columns, "n_words", "removed_words", "removed"]
    texts = {(r["doc_id"], r["removed_words"]) for r in odd.collect()}
    assert (1, 0) in texts and (2, 120) in texts and (5, 0) in texts and (11, 0) in texts and odd.count() == 14
    assert substring_dedup.dedup(no_docs).count() == 0


def removed_by_brute_force(texts, least=20):
    """Word ranges that an earlier text has, by its id, in runs of `least` words or more."""
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        w = text.split()
        grams = [tuple(w[a : a + least]) for a in range(len(w) - least + 1)]
        out[i] = []
        for a, g in enumerate(grams):
            if g in seen:
                if out[i] and a <= out[i][-1][1]:
                    out[i][-1][1] = a + least
                else:
                    out[i].append([a, a + least])
        seen.update(grams)
    return out


def check_passages(spark, lengths):
    """Passages with two to five holders each, some of them with a copy, against brute force."""
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(20000)]
    own = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = {}
    for n in lengths * 12:
        passage = own(n)
        for _ in range(rng.randint(2, 5)):
            texts[len(texts)] = " ".join(own(rng.randint(0, 60)) + passage + own(rng.randint(0, 60)))
            if rng.random() < 0.3:
                texts[len(texts)] = texts[len(texts) - 1]
    got = substring_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = removed_by_brute_force(texts)
    assert {r["doc_id"]: r["removed"] for r in got} == want
    assert all(r["removed_words"] == sum(b - a for a, b in want[r["doc_id"]]) for r in got)
    for r in got:
        w, gone = texts[r["doc_id"]].split(), {k for a, b in want[r["doc_id"]] for k in range(a, b)}
        assert r["text"].split() == [x for k, x in enumerate(w) if k not in gone]


def test_substring_dedup_removes_whole_passages(spark):
    check_passages(spark, [51, 60, 70])


def test_substring_dedup_meets_its_bound_of_20_words(spark):
    check_passages(spark, [19, 20, 21, 22, 25, 30, 40])


def chunks_of(texts, min_words=20):
    """Per text its chunks as (first word, end)."""
    raw = "".join(texts).encode()
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    words = substring_dedup.Words(np.frombuffer(raw, np.uint8), offs)
    at, size, row, digests = words.chunks(min_words)
    out = [[] for _ in texts]
    for a, n, r, d in zip((at - words.rows[row]).tolist(), size.tolist(), row.tolist(), digests.tolist(), strict=True):
        out[r].append((a, a + n, d))
    return out


@pytest.mark.parametrize("min_words", [3, 7, 20, 50])
def test_chunks_lie_between_cuts_and_every_shared_run_holds_one(min_words):
    rng = random.Random(min_words)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    small = lambda n: [rng.choice("abc") for _ in range(n)]
    window, least = substring_dedup.cut_window(min_words), substring_dedup.least_words(min_words)
    for make in (own, small):
        for _ in range(60):
            run = make(min_words)
            heads = [make(rng.randint(0, 30)) for _ in range(2)]
            found = chunks_of([" ".join(h + run + make(rng.randint(0, 30))) for h in heads], min_words)
            inside = [{(a - len(h), b - len(h)) for a, b, _ in c if len(h) <= a and b <= len(h) + min_words} for h, c in zip(heads, found, strict=True)]
            assert inside[0] & inside[1]
            assert all(least <= b - a < least + window for c in found for a, b, _ in c)


def test_inserted_words_move_only_the_chunks_around_them():
    rng = random.Random(8)
    words_ = [f"u{rng.randrange(10**9)}" for _ in range(2000)]
    at, more = 900, ["new", "words", "here"]
    before, after = chunks_of([" ".join(words_), " ".join(words_[:at] + more + words_[at:])])
    moved = {(a, b, d) if b <= at else (a - len(more), b - len(more), d) for a, b, d in after}
    changed = set(before) ^ moved
    near = 12 + 2 * substring_dedup.cut_window(20)  # a chunk's words and those its cuts depend on
    assert changed and all(at - near <= a and b <= at + near for a, b, _ in changed)
    sizes = {b - a for a, b, _ in before}
    assert len(sizes) > 2  # the chunks vary


def test_equal_chunks_have_equal_digests_wherever_they_stand():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(30)]
    by_words, by_digest = {}, {}
    for t, c in zip(texts, chunks_of(texts), strict=True):
        for a, b, d in c:
            key = tuple(t.split()[a:b])
            assert by_words.setdefault(key, d) == d and by_digest.setdefault(d, key) == key


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for g in range(12):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i, (base + rng.normal(size=16) * 0.12).tolist(), g % 3))
            i += 1
    rows += [(i + 0, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] + [1.0] * 15, 0), (i + 3, rows[0][1], None), (i + 4, rows[0][1], 0), (i + 5, rows[0][1], 0), (i + 6, [None] + [1.0] * 15, 1), (i + 7, [1.0, 2.0], 0), (i + 8, [float("inf")] + [1.0] * 15, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def brute_links(rows, threshold):
    ok = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["label"] is not None and r["embedding"] is not None and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])}
    label = {r["vec_id"]: r["label"] for r in rows}
    links = {r["vec_id"]: set() for r in rows}
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and label[a] == label[b] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
    return links


@pytest.mark.parametrize("most", [4096, 6])
def test_vector_links_against_brute_force(vectors, most):
    links = brute_links(vectors.collect(), 0.93)
    got = {r["vec_id"]: r for r in vector_dedup.links(vectors, max_rows=most, shard_rows=8).collect()}
    assert len(got) == len(links)
    found, all_ = sum(min(got[i]["n_links"], len(s)) for i, s in links.items()), sum(len(s) for s in links.values())
    assert found >= 0.98 * all_ and all(got[i]["n_links"] <= len(s) for i, s in links.items())
    assert vector_dedup.recall(vectors, vector_dedup.links(vectors), every=1) >= 0.98
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i) and (links[i] or r["component_id"] == i)


def test_vector_links_on_repeated_ids(spark):
    """Two vectors under one id in one label: each row counts its own links, all share a component."""
    rows, want = [], {}
    for g in range(20):
        one, two = np.random.default_rng(g).normal(size=(2, 32))
        base = 100 * g
        rows += [(base, one.tolist(), 1), (base, two.tolist(), 1), (base + 1, (one * 2).tolist(), 1), (base + 2, (two + 0.01).tolist(), 1), (base + 3, (two - 0.01).tolist(), 1)]
        want |= {base: [1, 2], base + 1: [1], base + 2: [2], base + 3: [2]}
    got: dict[int, list[int]] = {}
    for r in vector_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r["vec_id"], []).append(r["n_links"])
        assert r["component_id"] == r["vec_id"] // 100 * 100 and r["kept"] == (r["vec_id"] % 100 == 0)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_vector_links_across_shards(spark):
    """Thousands of links in one label over many overlapping shards, against brute force."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(400, 32))
    x = centre[rng.integers(0, 400, 3000)] + 0.2 * rng.normal(size=(3000, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    true = linked.sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, node string")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.links(df, shard_rows=150).collect()}
    found = np.array([got[i] for i in range(3000)])
    assert true.sum() > 4000 and (found <= true).all()
    assert found.sum() >= 0.995 * true.sum(), (found.sum(), true.sum())


def test_vectors_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.links(none).count() == 0
    assert ann.nearest(none, none["vec_id"] % 100 == 0).count() == 0


def test_nearest_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.toPandas()
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = ann.nearest(df, df["vec_id"] % 25 == 0, block_rows=40, query_rows=3).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 25 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing
        np.testing.assert_allclose(mine["score"], d[[int(np.flatnonzero(ids == v)[0]) for v in mine["vec_id"]]], rtol=1e-12)
        hit, total = hit + len(set(mine["vec_id"]) & set(want)), total + 10
    assert hit / total >= 0.9


def test_nearest_stops_early_and_finds_most(spark):
    """Clusters of vectors, default parameters but for smaller blocks: recall by brute force, few rows verified."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 48)) * 2
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 48)) * 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df["vec_id"] % 100 == 0, block_rows=500).toPandas()
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hit / 600 >= 0.9
    assert got.groupby("query_id")["verified"].first().mean() < 0.2 * len(x)


def test_nearest_ties_and_clashing_columns(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 7) for i in range(30)] + [(100, [1.0, 2.0, 3.0, 5.0], 1), (100, [9.0, 2.0, 3.0, 5.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int").selectExpr("*", "1 as block", "2 as rank", "3 as score", "4 as dim", "5 as part", "6 as reach", "7 as asked")
    got = ann.nearest(df, df["vec_id"].isin(3, 100), block_rows=4).toPandas().sort_values(["query_id", "rank"])
    assert got[got["query_id"] == 3]["vec_id"].tolist() == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10] and set(got[got["query_id"] == 3]["score"]) == {0.0}
    assert got[got["query_id"] == 100]["vec_id"].tolist() == list(range(10)) and set(got[got["query_id"] == 100]["score"]) == {1.0}


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3) and ann.chi_square_cdf(3.0, 2) == pytest.approx(1 - np.exp(-1.5))


def test_nearest_odd_rows(vectors):
    got = ann.nearest(vectors, vectors["vec_id"] >= 0, k=3).toPandas()
    usable = {r["vec_id"] for r in vectors.collect() if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])}
    assert set(got["query_id"]) | set(got["vec_id"]) <= usable and not (got["query_id"] == got["vec_id"]).any()


def test_vectors_of_a_label_are_placed_about_once_and_not_sorted(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 64))
    x[2000:2040] = x[:40] + 0.02 * rng.normal(size=(40, 64))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    real, placed = vector_dedup.materialize, []

    def materialize(df, **options):
        out = real(df, **options)
        if "shard" in df.columns:
            placed.append(out.count())
        return out

    monkeypatch.setattr(vector_dedup, "materialize", materialize)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.links(df).collect()}
    assert [i for i, n in got.items() if n] and {i for i, n in got.items() if n} == {*range(40), *range(2000, 2040)}
    assert placed and placed[0] <= 1.2 * len(x)
    argsort, widths = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, *args, **more: widths.append(np.shape(a)[-1]) or argsort(a, *args, **more))
    lists = vector_dedup.robust_prune(vector_dedup.unit(x))
    assert max(widths) < 1000
    assert all(2000 + i in lists[i] for i in range(40))
