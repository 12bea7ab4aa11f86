"""Token ids of text columns by the tokenizers library, encoding each distinct piece of text once.

A byte-level BPE splits a text before any single space, and around any single newline, that stands between two visible
characters, and between an ASCII letter, digit and other visible character (apostrophes aside, which may begin a
contraction). A text's ids are the ids of the pieces between such places. Pieces repeat often; those seen before come
from a table. Rows that hold white space outside ASCII, or the text of one of the tokenizer's special tokens, are encoded
whole, so ids are always those that the library gives for the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbytes import SPACE, buffers, slices

END_ID = 2
NEWLINE = 0x0A
SLICE_BYTES = 4 << 20
#: Pieces whose ids are copied out at once, and pieces that are encoded at once: what they need stays in a core's cache.
COPIED, RUN = 1 << 14, 1000
#: A byte that UTF-8 never holds. Where no longer token holds it no merge passes it, so it parts the pieces of a line, this many.
BARRIER, LINE = 0xFF, 16
BLANK, LETTER, DIGIT, OTHER, APOSTROPHE, WIDE = range(6)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:] = WIDE
    for low, high, k in ((b"a", b"z", LETTER), (b"A", b"Z", LETTER), (b"0", b"9", DIGIT)):
        kind[low[0] : high[0] + 1] = k
    kind[ord("'")] = APOSTROPHE
    kind[SPACE] = BLANK
    return kind


KIND = _kinds()
#: Kinds of two neighbouring bytes, first * 8 + second, between which every text splits.
SPLITS = np.zeros(64, dtype=bool)
for _first, _second in ((LETTER, DIGIT), (LETTER, OTHER), (LETTER, APOSTROPHE), (DIGIT, LETTER), (DIGIT, OTHER), (DIGIT, APOSTROPHE), (OTHER, LETTER), (OTHER, DIGIT)):
    SPLITS[_first * 8 + _second] = True
#: The same as tables of bytes.translate, which takes a byte for each byte and no index of eight.
KIND_BYTES, SPLIT_BYTES = KIND.tobytes(), SPLITS.tobytes().ljust(256, b"\0")


#: Pieces that the pre-tokenizer leaves whole: Latin letters, digits or other ASCII, behind a space or not.
WHOLE = r"\A ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)\z"


def _byte_characters() -> np.ndarray:
    """The character that a byte-level vocabulary writes for each byte; a newline, which parts pieces, stays as it is."""
    shown = np.zeros(256, dtype=bool)
    for low, high in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)):
        shown[low : high + 1] = True
    chars = np.arange(256, dtype=np.uint32)
    chars[~shown] = 256 + np.arange(256 - shown.sum())
    chars[NEWLINE] = NEWLINE
    return chars


CHARACTERS = _byte_characters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str) -> "PieceEncoder":
    return PieceEncoder(path)


def exotic_rows(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Marks rows with white space (or ASCII separators) that only Unicode knows."""
    marks = [np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))]
    high = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(high):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b, c = padded[high], padded[high + 1], padded[high + 2]
        hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        marks.append(high[hit])
    rows = np.zeros(len(offs) - 1, dtype=bool)
    rows[np.searchsorted(offs, np.concatenate(marks), "right") - 1] = True
    return rows


class PieceEncoder:
    def __init__(self, path: str, most_pieces: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.usual = self.tokenizer.pre_tokenizer
        lines = pre_tokenizers.CharDelimiterSplit("\n")
        self.words, self.lines = lines, pre_tokenizers.Sequence([lines, self.usual])
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token is written with a character per byte
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        passed = [i for t, i in vocabulary.items() if chr(BARRIER) in t]
        self.barrier = passed[0] if len(passed) == 1 else -1
        self.most_pieces = most_pieces
        self.known = pa.array([], pa.large_binary())
        self.first, self.count, self.seen, self.met = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.used, self.turn = np.zeros(1 << 16, np.uint32), 0, 0

    def _forget(self) -> None:
        """Keeps half of most_pieces: those met in the most slices, of equals those met last. Meetings before count half from then on."""
        half, worth = max(1, self.most_pieces // 2), self.met * (self.turn + 1) + self.seen
        keep = np.zeros(len(worth), dtype=bool)
        keep[np.argpartition(worth, -half)[-half:]] = True
        self.known = self.known.filter(pa.array(keep))
        first, counts = self.first[keep], self.count[keep]
        after = np.cumsum(counts)
        self.used = int(after[-1]) if len(after) else 0
        self.pool = self.pool[np.repeat(first - (after - counts), counts) + np.arange(self.used)]
        self.pool = np.concatenate([self.pool, np.zeros(max(1 << 16, self.used), np.uint32)])
        self.first, self.count, self.seen, self.met = after - counts, counts, self.seen[keep], (self.met[keep] + 1) // 2

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, texts: list[str], sizes: np.ndarray, split) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of texts, and how many each piece has, told by its bytes in the vocabulary's writing."""
        self.tokenizer.pre_tokenizer = split
        try:
            ids = [np.array(e.ids, dtype=np.uint32) for t in texts for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]
        finally:
            self.tokenizer.pre_tokenizer = self.usual
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        flat = flat[flat != self.barrier]
        return flat, np.diff(np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(sizes)) + 1, prepend=0)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encodes pieces, many in one text; those with newlines or what isn't UTF-8 by themselves.

        Pieces that are one word to the pre-tokenizer go to the model as they are. Returns the places of the pieces in
        the order in which they are known from now on.
        """
        fits = pc.match_substring_regex(pieces, WHOLE).to_numpy(zero_copy_only=False)
        whole, others = np.flatnonzero(fits), np.flatnonzero(~fits)
        raw, offs = buffers(pieces.take(pa.array(whole)))
        parts = np.full(max(0, len(whole) - 1), BARRIER if self.barrier >= 0 else NEWLINE, np.uint8)
        parts[LINE - 1 :: LINE] = NEWLINE
        lines, texts = np.insert(raw, offs[1:-1], parts), []
        for i in range(0, len(whole), RUN):
            j = min(i + RUN, len(whole))
            texts.append(CHARACTERS[lines[offs[i] + i : offs[j] + j - 1]].astype("<u4").tobytes().decode("utf-32-le"))
        got = [self._joined(texts, np.diff(offs), self.words)]
        rest = [p.decode("utf-8", "replace") for p in pieces.take(pa.array(others)).to_pylist()]
        alone = np.array(["\n" in t or "\ufffd" in t for t in rest], dtype=bool)
        cut = [t for t, a in zip(rest, alone) if not a]
        texts = ["\n".join(cut[i : i + RUN]) for i in range(0, len(cut), RUN)]
        got.append(self._joined(texts, np.array([len(t.encode()) for t in cut], np.int64), self.lines))
        plain = self._plain([t for t, a in zip(rest, alone) if a])
        got.append((np.fromiter(chain.from_iterable(plain), np.uint32), np.fromiter(map(len, plain), np.int64, len(plain))))
        flat, counts = zip(*got, strict=True)
        order = np.concatenate([whole, others[~alone], others[alone]])
        new = np.concatenate(flat)
        count = np.concatenate(counts)
        assert int(count.sum()) == len(new), "ids and pieces differ"
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        self.first = np.concatenate([self.first, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.seen = np.concatenate([self.seen, np.full(len(pieces), self.turn)])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), np.int64)])
        self.used += len(new)
        self.known = pa.concat_arrays([self.known, pieces.take(pa.array(order))])
        return order

    @staticmethod
    def _cuts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """First bytes of the pieces of a run of rows."""
        begins = offs[:-1][offs[1:] > offs[:-1]]
        cut = np.zeros(len(raw), dtype=bool)
        kind = np.frombuffer(raw.tobytes().translate(KIND_BYTES), np.uint8)
        cut[1:] = np.frombuffer((kind[:-1] * np.uint8(8) + kind[1:]).tobytes().translate(SPLIT_BYTES), bool)
        space = kind == BLANK
        if len(raw) > 2:
            alone = ~(space[:-2] | space[2:])
            cut[1:-1] |= (raw[1:-1] == 0x20) & alone
            lines = np.flatnonzero((raw[1:-1] == NEWLINE) & alone) + 1
            edges = np.zeros(len(raw), dtype=bool)
            edges[begins] = True
            lines = lines[~edges[lines] & ~edges[lines + 1]]
            cut[lines] = True
            cut[lines + 1] = True
        last = (offs[1:] - 1)[offs[1:] > offs[:-1]]
        cut[last[space[last]]] = False
        cut[begins] = True
        return np.flatnonzero(cut)

    def _slice(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        starts = self._cuts(raw, offs)
        bounds = np.append(starts, len(raw))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        if len(self.known) > self.most_pieces:
            self._forget()
        self.turn += 1
        of_key = pc.index_in(pieces.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(of_key < 0)
        if len(new):
            start = len(self.first)
            order = self._learn(pieces.dictionary.take(pa.array(new)))
            of_key[new[order]] = start + np.arange(len(new))
        self.seen[of_key] = self.turn
        self.met[of_key] += 1
        piece = of_key[pieces.indices.to_numpy()]
        after = np.cumsum(self.count[piece])
        ids = np.empty(int(after[-1]), np.uint32)
        for i in range(0, len(piece), COPIED):
            some, to = piece[i : i + COPIED], after[i : i + COPIED]
            counts = self.count[some]
            begin = int(to[0] - counts[0])
            at = np.repeat(self.first[some] - (to - counts), counts)
            at += np.arange(begin, int(to[-1]))
            ids[begin : int(to[-1])] = self.pool[at]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, offs)]

    def _whole_rows(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Marks rows that are encoded whole."""
        odd = exotic_rows(raw, offs)
        data = raw.tobytes() if self.special else b""
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                odd[np.searchsorted(offs, at, "right") - 1] = True
                at = data.find(token, at + 1)
        return odd

    def encode(self, column: pa.Array):
        """Yields (first row, ids of a run of rows, len+1 offsets); null is empty."""
        for first, raw, offs in slices(column, SLICE_BYTES):
            odd = self._whole_rows(raw, offs)
            edges = np.concatenate([[0], np.flatnonzero(odd[1:] != odd[:-1]) + 1, [len(odd)]]).tolist()
            for a, b in zip(edges, edges[1:]):
                part, at = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                if not odd[a]:
                    yield first + a, *self._slice(part, at)
                    continue
                rows = [part[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(at.tolist(), at[1:].tolist())]
                found = self._plain(rows)
                flat = np.concatenate([np.array(x, dtype=np.uint32) for x in found])
                yield first + a, flat, np.concatenate([[0], np.cumsum([len(x) for x in found])])
