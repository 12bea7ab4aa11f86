"""Vector codes, WARC archives and phrases, against brute force."""

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from sigloom.llm import phrases, vector_codes, warc

from .conftest import LOWER

VECTORS = "vec_id long, embedding array<double>, label int"


# Vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, label, code, error)] sorted, and the codebooks, with Python's integers alone."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(book)]
    out = []
    for i, v, g in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, g, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.05 if i % 2 else 1, size=dim)).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(i + n, rows[i][1], 7) for i in range(min(n, 20))]  # copies
    rows += [(3, rows[5][1], 1), (4, rows[4][1], rows[4][2]), (None, rows[9][1], 1)]  # repeated ids and rows, no id
    return rows


@pytest.mark.parametrize(("n", "entries", "big"), [(150, 16, 1.0), (12, 256, 1.0), (60, 8, 2.0**40)])
def test_vector_codes_equal_brute_force(spark, n, entries, big):
    rows = [(i, [x * big for x in v], g) for i, v, g in vectors(n, n)]
    odd = [(900, None, 1), (901, [None] + [1.0] * 7, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "'x' as code", "1 as entry", "2 as error", "3 as part", "4 as _x").repartition(3)
    got = vector_codes.encode(df, entries=entries).collect()
    want, books = brute_codes(rows, entries=entries)
    sums = defaultdict(int)
    for _, g, _, e in want:
        sums[g] += e
    long = lambda e: e if e < 1 << 63 else None
    if big > 1:
        want = [(i, g, c, long(e)) for i, g, c, e in want]
        assert all(r["error"] is None or r["error"] >= 0 for r in got)
    else:
        assert all(r["label_error"] == sums[r["label"]] for r in got)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in got), key=str) == sorted(want, key=str)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.encode(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(1, [0.1] * 8, 1), (2, [0.2] * 8, 1), (3, [0.1] * 6, 1), (4, [], 2), (5, [1e300] * 8, 1)]
    got = {r["vec_id"]: r for r in vector_codes.encode(spark.createDataFrame(rows, VECTORS)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1]["code"] == "00000000" and got[2]["code"] == "01010101"
    assert all(got[i]["code"] is None and got[i]["error"] is None for i in (3, 4, 5)) and got[4]["label_error"] is None and got[3]["label_error"] == 0


def test_cell_memo_evaluates_only_what_may_be_nearest():
    rng = np.random.default_rng(2)
    book = rng.integers(-500, 500, (64, 3))
    x = rng.integers(-600, 600, (400, 3))
    all_of = ((x[:, None] - book) ** 2).sum(axis=2)
    for width in (1, 16, 128, 2048):
        memo = vector_codes.CellMemo(book, width)
        for _ in range(2):  # the second time from the memo
            entry, distance, tried = memo.nearest(x)
            assert (entry == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
        assert len(memo.memo) == len({tuple(c) for c in x // width})
        assert tried.mean() < 20 or width > 16


def test_cell_memo_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(vector_codes, "MEMO", 10)
    x = np.random.default_rng(0).integers(0, 100, (50, 2))
    memo = vector_codes.CellMemo(x[:5], 4)
    for i in range(0, 50, 5):
        assert (memo.nearest(x[i : i + 5])[1] == ((x[i : i + 5, None] - x[:5]) ** 2).sum(axis=2).min(axis=1)).all()
        assert len(memo.memo) <= 10


# WARC archives


PAGES = "page_id long, url string, html string"


def page_rows():
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['www.a', 'b', 'c.d'])}.example.com:{80 + i % 2}/p/{i % 37}?q={i}", f"<p>page {i % 60} " + "x" * (i % 90)) for i in range(300)]
    rows += [(400 + i, "https://Hot.example.org/", "<b>same</b>") for i in range(50)]  # one URL, one payload
    rows += [(500, "http://b.example.com/rn", "a\r\n\r\nb\r\n\r\n"), (501, None, None), (502, "", ""), (503, "not a url\nwith a line", "é日\x00"), (None, "http://n.example.com/", "<b>same</b>"), (None, None, "nobody")]
    rows += [(600, "http://r.example.com/", "repeated")] * 5 + [(601, "http://r.example.com/", "repeated"), (600, "http://r.example.com/", "other"), (600, "http://q.example.com/", "repeated")]
    rows += [(700, "http://long.example.com/", "long " * 300_000)]
    return rows


def brute_captures(rows, min_bytes=0):
    place = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r)
    out = []
    for text, group in groups.items():
        data = text.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        group.sort(key=place)
        for k, r in enumerate(group):
            revisit = k > 0 and len(data) >= min_bytes
            out.append((r[0], r[1], "revisit" if revisit else "response", len(data), digest, group[0][0] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_captures_equal_brute_force(spark, min_bytes, monkeypatch):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as key", "1 as digest", "2 as payload", "3 as head").repartition(5)
    index = warc.write(pages, min_bytes=min_bytes, archive_bytes=20_000, block_lines=7)
    got = warc.lookup(index, pages, payload=True).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute_captures(rows, min_bytes)
    texts = Counter((r[0], r[1], (r[2] or "").encode()) for r in rows)
    assert all((r["page_id"], r["url"], bytes(r["payload"])) in texts for r in got if r["record_type"] == "response")
    some = [rows[7][:2], rows[310][:2], (999_999, "http://b.example.com/none"), (rows[8][0], "http://b.example.com/none")]
    found = warc.lookup(index, spark.createDataFrame(some * 2, "page_id long, url string")).collect()
    assert sorted(r["page_id"] for r in found) == [7, rows[310][0]]
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # the shuffled join instead of the broadcast
    again = warc.lookup(warc.write(pages, min_bytes=min_bytes), pages).collect()
    assert sorted((tuple(r) for r in again), key=str) == brute_captures(rows, min_bytes)
    warc.discard(index)


def test_archives_are_warc_files_in_key_order(spark):
    """The files by themselves: a gzip member per record at the indexed ranges, blocks and directory in order."""
    rows = page_rows()[:200]
    index = warc.write(spark.createDataFrame(rows, PAGES), archive_bytes=3_000, block_lines=10).orderBy("first").collect()
    files, folder = pafs.FileSystem.from_uri(index[0]["folder"])
    lines = []
    for row in index:
        with files.open_input_file(f"{folder}/{row['path']}") as f:
            raw = f.read()
        at, length = warc.TRAILER.unpack(raw[-warc.TRAILER.size :])
        assert (at, length) == (row["at"], row["length"])
        found = warc.CaptureIndex(row["folder"], [])
        blocks, _ = found._directory(row["path"], at, length)
        assert [b[4] for b in blocks] == [0, *np.cumsum([b[5] for b in blocks])[:-1]] and len(blocks) == row["blocks"]
        mine = [x for b in blocks for x in found._block(row["path"], *b[4:])[0]]
        assert len(mine) == row["lines"] and all(len(found._block(row["path"], *b[4:])[0]) <= 10 for b in blocks)
        lines += mine
    keys = [(x[0], x[1]) for x in lines]
    assert keys == sorted(keys) and len(lines) == 200 and len({x[3] for x in lines}) > 3
    by_file = defaultdict(list)
    for x in lines:
        by_file[x[3]].append((x[4], x[5]))
    for name, ranges in by_file.items():
        with files.open_input_file(f"{folder}/{name}") as f:
            raw = f.read()
        end = min(ranges)[0]  # behind the archive's own record
        assert b"WARC-Type: warcinfo" in gzip.decompress(raw[:end])
        for at, length in ranges:
            assert at == end and gzip.decompress(raw[at : at + length]).startswith(b"WARC/1.1\r\nWARC-Type: re")
            end += length
        assert end == len(raw)


def test_a_broken_payload_is_noticed():
    row = {"revisit": False, "page_id": 1, "url": "http://a/", "digest": hashlib.sha1(b"x").hexdigest(), "copy": 0, "size": 1, "payload": b"y"}
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc.page_record(row, "1970-01-01T00:00:00Z"))


def test_url_keys(spark):
    cases = {
        "http://user@WWW.Example.com:8080/A?b#c": "com,example,www:8080)/A?b#c", "https://a.b": "b,a)", "ftp://x.y?z=http://q.r/": "y,x)?z=http://q.r/", "mailto:x": "mailto:x", "": "", None: "",
        "http://ü.example/": "example,ü)/", "http://h.i/a\nb": "i,h)/a\nb", "//no/scheme": "//no/scheme",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r[0]: r[1] for r in df.select("url", warc.surt(F.col("url"))).collect()} == cases


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.lookup(warc.write(none), none).collect() == []


# Phrases


def brute_phrases(rows, longest=4, min_count=30, per_lang=2000):
    import re

    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for m in range(1, longest + 1):
                count.update((lang, words[i : i + m]) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in count.items() if a >= min_count and len(k[1]) > 1}
    dropped = set()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            dropped |= {(lang, p[i : i + m]) for i in range(len(p) - m + 1) if 100 * a >= 80 * count[lang, p[i : i + m]]}
    out = []
    for lang in sorted(n):
        mine = []
        for (g, p), a in candidates.items():
            if g == lang and (g, p) not in dropped:
                score, k = min((2_000_000 * a // (count[g, p[:k]] + count[g, p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), count[g, p[:k]], count[g, p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(mine)[:per_lang], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def phrase_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Ünï", "日本", "a\xa0b", "x\x1cy"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = []
    for _ in range(300):
        words = rng.choices(vocab, weights, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice([["New", "york", "city"], ["of", "the", "united", "states", "of", "america"], ["w1", "w1", "w1", "w1", "w1"]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("... \n", "xx"), ("very long " * 20_000, "de"), ("one", "yy")]


@pytest.mark.parametrize(("seed", "per_lang", "held"), [(1, 2000, 400_000), (2, 15, 50)])
def test_phrases_equal_brute_force(spark, seed, per_lang, held, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", held)
    rows = phrase_rows(seed)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as a", "2 as n", "'q' as word", "3 as w1", "4 as segment", "5 as rank").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, per_lang=per_lang).collect())
    assert got == sorted(brute_phrases(rows, per_lang=per_lang)) and len(got) > 10


def test_phrases_in_segments_and_with_full_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT_WORDS", 2)
    monkeypatch.setattr(phrases, "bits_for", lambda n: 128)
    rows = phrase_rows(3)
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), longest=3, min_count=10).collect())
    assert got == sorted(brute_phrases(rows, 3, 10)) and len(got) > 10


def test_stripes_hold_totals_and_extensions(spark):
    """A prefix's total is its entry one word shorter; what follows it never counts more."""
    texts = spark.createDataFrame([("en", "a b c a b d a b")], "lang string, text string")
    vocab = phrases.vocabulary(texts, 0)
    one = phrases._digests(vocab.select("lang", F.col("id").alias("w1"), F.col("n").alias("a")))
    two = phrases.merge_stripes(phrases.stripes(texts, 1, one, 0, 1), 1, 1)
    word = {r["id"]: r["word"] for r in vocab.collect()}
    assert {(word[r["w1"]], word[r["w2"]]): r["a"] for r in two.collect()} == {("a", "b"): 3, ("b", "c"): 1, ("b", "d"): 1, ("c", "a"): 1, ("d", "a"): 1}


def test_phrases_take_another_hash_when_words_collide(spark, monkeypatch):
    rows = [("a b c d e f " * 40, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(brute_phrases(rows))
    seen = []
    whole = phrases.vocabulary

    def noted(texts, base):
        seen.append(base)
        if base == 0:
            return whole(texts, base).withColumn("id", F.lit(1).cast("long"))
        return whole(texts, base)

    monkeypatch.setattr(phrases, "vocabulary", noted)
    monkeypatch.setattr(phrases, "release", lambda *t: None)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == want and seen == [0, 1]


def test_phrase_scores_past_64_bits(spark):
    df = spark.sql("select 9000000000000000000L as a, 9100000000000000000L as l, 9200000000000000000L as r")
    assert df.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).head()[0] == 2_000_000 * 9 * 10**18 // (91 * 10**17 + 92 * 10**17)


def test_no_phrases(spark, no_docs):
    assert phrases.collocations(no_docs).collect() == []
