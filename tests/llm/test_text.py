"""Tokens, packing, token files and mixing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigloom.llm import common, mixing, packing, textbytes, tokens, wavelet
from sigloom.llm.common import lean

from .conftest import words


@pytest.fixture(scope="module")
def plain():
    """The library's own ids, from a tokenizer of its own."""
    fresh = Tokenizer.from_file(tokens.default_path())
    return lambda text: fresh.encode(text or "", add_special_tokens=False).ids


ODD = ["", None, " ", "  a", "a  b", "a\n\nb c", "a \n b", "x y z", " lead", "trail ", "tab\tq r", "<|endoftext|> hi", "don't we'll  \t\n ok", "\x1c a b", "é à ü", "日本 語　x", "a" * 5000 + " b", "\n", "\n a", "a\r\n b c", "end.\nNext line\nand", "x\n", "\nx", "one<|endoftext|>two", "we're 'tis rock'n'roll 'VE don'T 5's (it's) x'", "a1b2 3c4,5.6 -7% $8", "“quoted” naïve—dash Straße, ÆØÅ×÷ǅ", "...!!! ?a. b'c'd ''s", "a\0b \0 c\x7f"]


def test_pieces_give_the_same_ids(plain):
    enc = tokens.PieceEncoder(tokens.default_path(), most_pieces=5)
    for _ in range(2):
        got = {}
        for first, ids, offs in enc.encode(pa.array(ODD)):
            got |= {first + i: ids[offs[i] : offs[i + 1]].tolist() for i in range(len(offs) - 1)}
        assert [got[i] for i in range(len(ODD))] == [plain(t) for t in ODD]


def test_pieces_give_the_same_ids_on_documents(spark, sf_dir, plain):
    texts = [r["text"] for r in common.table(spark, sf_dir, "documents").select("text").collect()]
    enc = tokens.PieceEncoder(tokens.default_path(), most_pieces=2000)
    for first, ids, offs in enc.encode(pa.array(texts)):
        for i in range(len(offs) - 1):
            assert ids[offs[i] : offs[i + 1]].tolist() == plain(texts[first + i])


def test_words_and_hashes():
    texts = ["A b  A", "", "b A"]
    raw, offs = textbytes.buffers(pa.array(texts))
    h, rows = textbytes.word_hashes(raw, offs)
    assert np.diff(rows).tolist() == [3, 0, 2] and h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


def test_wavelet_matrix():
    x = (np.random.default_rng(0).zipf(1.3, 3000) % 50257).astype(np.uint32)
    for n in (0, 1, 511, 512, 513, 3000):
        assert (wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x[:n], 16).to_bytes()).decode() == x[:n]).all()
    m = wavelet.WaveletMatrix.build(x, 16)
    assert all(m.access(i) == x[i] for i in range(0, 3000, 131))
    for v in (1, 2, 60000):
        at = np.flatnonzero(x == v)
        assert m.count(v) == len(at) and m.count(v, 10, 500) == (x[10:500] == v).sum()
        assert [m.occurrence(v, i) for i in range(min(5, len(at)))] == at[:5].tolist() and m.occurrence(v, len(at)) == -1


def test_token_files_round_trip(odd_docs, no_docs, plain):
    rows = odd_docs.collect()
    got = wavelet.read_documents(wavelet.write_shards(odd_docs, shard_tokens=500)).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, len(r["text"] or ""), r["text"] or ""))
    start, want = 0, []
    for r in order:
        ids = np.array([*plain(r["text"]), 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r["start"]) == want
    assert wavelet.read_documents(wavelet.write_shards(no_docs)).count() == 0


def test_packing(odd_docs, no_docs, plain):
    out = packing.pack(packing.token_pieces(odd_docs, 64), 64, group_items=50).collect()
    total = sum(len(plain(r["text"])) + 1 for r in odd_docs.collect())
    assert sum(r["length"] for r in out) == total
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * total / 64 + 20
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    whole = sorted(by_doc[8])
    assert whole[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(whole, whole[1:], strict=False)) and all(n == 64 for _, n in whole[1:])
    assert packing.pack(packing.token_pieces(no_docs)).count() == 0


def test_sum_of_squares_is_near_the_least():
    sizes = np.sort(np.random.default_rng(2).integers(1, 1025, 4000))[::-1]
    places, offsets = packing.sum_of_squares(sizes, 1024)
    used = np.bincount(places, weights=sizes)
    assert used.max() <= 1024 and len(used) <= 1.02 * sizes.sum() / 1024 + 1


def test_opening_late_needs_no_more_sequences_than_the_plain_rule():
    """The plain rule also opens a new sequence when that keeps the sum of squares smallest."""
    rng = np.random.default_rng(8)
    for sizes in (rng.integers(1, 1025, 3000), np.minimum(rng.geometric(1 / 300, 3000), 1024), rng.choice([100, 333, 512, 700], 2000)):
        sizes = np.sort(sizes)[::-1]
        counts, made = np.zeros(1025, np.int64), 0
        for s in sizes.tolist():
            options = [(2 * ((counts[g - s] if g > s else 0) - counts[g] + 1), g) for g in range(s, 1025) if counts[g]]
            options.append((2 * counts[1024 - s] + 1, 1025))
            _, g = min(options)
            made += g == 1025
            if g == 1025:
                g = 1024
            else:
                counts[g] -= 1
            counts[g - s] += g > s
        assert packing.sum_of_squares(sizes, 1024)[0].max() + 1 <= made


def test_wide_ids_keep_all_bits():
    ids = np.array([70_000, 3, 65_536, 131_071, 0], np.uint32)
    _, _, matrix = wavelet.open_shard(wavelet.pack_shard(np.array([1]), np.array([5]), ids))
    assert matrix.decode().tolist() == ids.tolist() and [matrix.access(i) for i in range(5)] == ids.tolist()


def test_target_words():
    assert mixing.target_words([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    capped = mixing.target_words([10, 1000, 1000], [3, 1, 1])
    assert capped[0] == 30 and sum(capped) == pytest.approx(2010)
    assert mixing.target_words([0, 0], [1, 2]) == [0, 0] and mixing.target_words([], []) == []


def test_split_quota():
    blocks = [5, 0, 100, 40, 7]
    got = mixing.split_quota(blocks, 90, [1, 2])
    assert sum(got) == 90 and all(0 <= q <= b for q, b in zip(got, blocks, strict=True)) and got == mixing.split_quota(blocks, 90, [1, 2])
    assert mixing.split_quota(blocks, 152, [3]) == blocks
    big = mixing.hypergeometric(np.random.default_rng(0), 6 * 10**9, 4 * 10**9, 10**9)
    assert abs(big - 6 * 10**8) < 10**6


def test_mixing(spark, odd_docs, no_docs, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    plan = mixing.mixing_plan(docs, block_words=5000).toPandas()
    for _, g in plan.groupby("source"):
        taken = (g["mix_copies"] * g["mix_size"]).sum()
        assert abs(taken - g["mix_target"].iloc[0]) <= max(0.1 * g["mix_target"].iloc[0], g["mix_size"].max() / 2)
        assert g["mix_copies"].max() <= 3 and g["mix_size"].sum() == g["mix_source_size"].iloc[0]
    again = mixing.mixing_plan(docs, block_words=5000).toPandas()
    assert plan.sort_values("doc_id")["mix_copies"].tolist() == again.sort_values("doc_id")["mix_copies"].tolist()
    odd = mixing.mixing_plan(odd_docs).collect()
    assert len(odd) == 14 and all(r["mix_size"] == len(words(r["text"])) and 0 <= r["mix_copies"] <= 3 for r in odd)
    assert mixing.mix(odd_docs).columns == [*odd_docs.columns, "mix_shard"]
    assert mixing.mixing_plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["j", "q", "s", "t", "w", "e", "z", "b", "_left", "_drawn", "_upto", "_new", "_block", "size", "source_size"]
    df = spark.range(40).selectExpr("id as doc_id", "repeat('word ', cast(id % 7 as int)) as text", "if(id % 3 = 0, null, concat('s', id % 2)) as source", *(f"'{n}' as `{n}`" for n in names))
    out = mixing.mixing_plan(df).collect()
    assert len(out) == 40 and all(r[n] == n for r in out for n in names)
    assert mixing.mix(df).columns == [*df.columns, "mix_shard"] and mixing.mix(df).count() == sum(r["mix_copies"] for r in out)


def test_mixing_meets_its_targets_with_production_parameters(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source")
    plan = mixing.mixing_plan(docs).toPandas()
    plan["taken"] = plan["mix_copies"] * plan["mix_size"]
    for _, g in plan.groupby("source", dropna=False):
        target = g["mix_target"].iloc[0]
        assert abs(g["taken"].sum() - target) <= 0.02 * target
    assert plan["mix_shard"].nunique() == -(-int(plan["mix_size"].sum()) // 250_000)


def test_mixing_runs_no_python(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.word_count().alias("size"))
    plan = mixing.mixing_plan(docs, size=F.col("size"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_lean_tasks_pass_all_rows_on_and_end_on_errors(spark):
    def twice(batches):
        for batch in batches:
            yield batch
            yield batch

    rows = spark.range(1000, numPartitions=4).mapInArrow(lean(twice), "id long")
    assert rows.groupBy("id").count().where("count = 2").count() == 1000
    with pytest.raises(ZeroDivisionError):
        list(lean(lambda batches: (1 // b for b in batches))(iter([0])))


def test_pieces_that_are_one_word_are_told_apart_at_once():
    """The pattern that Arrow matches over all pieces, against a regular expression piece by piece."""
    import re

    import pyarrow.compute as pc

    one = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
    rng = np.random.default_rng(1)
    parts = [bytes([b]) for b in range(256)] + [" ".encode(), "\n".encode(), "é".encode(), "÷".encode(), "×".encode(), "ɏ".encode(), b"a", b"Z", b"0", b"'", b"!"] * 30
    pieces = [b"".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 5))) for _ in range(20000)]
    assert pc.match_substring_regex(pa.array(pieces, pa.binary()), tokens.WHOLE).to_pylist() == [bool(one.fullmatch(p)) for p in pieces]


def test_pieces_met_most_are_not_forgotten():
    """A table that is full keeps the pieces that come back, whatever else the last slice held."""
    learned = []

    class Watched(tokens.PieceEncoder):
        def _learn(self, pieces):
            learned.extend(p if isinstance(p, bytes) else p.as_py() for p in pieces)
            return super()._learn(pieces)

    enc = Watched(tokens.default_path(), most_pieces=40)
    common = [" " + a + b for a in "qxz" for b in "jkv"]
    for turn in range(6):
        rare = "".join(f" {a}{b}{'w' * turn}h" for a in "bcdfg" for b in "lmnprst") if turn else ""
        list(enc.encode(pa.array(["a" + "".join(common) + rare])))
        assert len(enc.known) <= 40 + 45
    assert [learned.count(c.encode()) for c in common] == [1] * len(common)


def test_pieces_cut_further_are_encoded_many_at_once(plain):
    """Words with letters that are not Latin hold several of the pre-tokenizer's words; only newlines make a text of their own."""
    enc, alone = tokens.PieceEncoder(tokens.default_path()), []
    by_itself = enc._plain
    enc._plain = lambda texts: alone.extend(texts) or by_itself(texts)
    text = " ".join(f"w\u03b1{chr(0x400 + i)}, \u65e5{chr(0x4E00 + i)}\u3002" for i in range(300)) + " \n\n end"
    (_, ids, offs), = enc.encode(pa.array([text]))
    assert ids.tolist() == plain(text) and offs.tolist() == [0, len(ids)]
    assert len(alone) <= 2 and all("\n" in t for t in alone)


def test_wavelet_matrix_of_several_runs():
    x = (np.random.default_rng(3).zipf(1.2, 2 * wavelet.RUN + 77) % 50257).astype(np.uint32)
    for n in (wavelet.RUN - 1, wavelet.RUN, wavelet.RUN + 1, len(x)):
        assert (wavelet.WaveletMatrix.build(x[:n]).decode() == x[:n]).all()


def test_text_that_is_not_utf_8_gives_the_same_ids_as_its_pieces(plain):
    raw = [b"a \xff\xfe,b \xc3c d", b"\xe2\x28 ab\xc3, x", b"end \xef\xbf\xbd, \xc3\xa9,"]
    offs = np.cumsum([0, *map(len, raw)]).astype(np.int32)
    column = pa.Array.from_buffers(pa.string(), len(raw), [None, pa.py_buffer(offs), pa.py_buffer(b"".join(raw))])
    got = {}
    for first, ids, at in tokens.PieceEncoder(tokens.default_path()).encode(column):
        got |= {first + i: ids[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)}
    assert [got[i] for i in range(len(raw))] == [plain(r.decode("utf-8", "replace")) for r in raw]


def test_pieces_give_the_same_ids_where_no_byte_parts_them(spark, sf_dir, plain):
    """A vocabulary with a longer token of the parting byte has each piece on a line of its own."""
    texts = [r["text"] or "" for r in common.table(spark, sf_dir, "documents").select("text").limit(40).collect()] + [t or "" for t in ODD]
    enc = tokens.PieceEncoder(tokens.default_path(), most_pieces=300)
    assert enc.barrier >= 0
    for barrier in (enc.barrier, -1):
        enc = tokens.PieceEncoder(tokens.default_path(), most_pieces=300)
        enc.barrier = barrier
        for first, ids, offs in enc.encode(pa.array(texts)):
            for i in range(len(offs) - 1):
                assert ids[offs[i] : offs[i + 1]].tolist() == plain(texts[first + i])
