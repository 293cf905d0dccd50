"""Removal of word sequences that occur earlier in the corpus, by FM-indexes over shards of the repeated text.

``anchored.Search`` brings the distinct blocks of words that can hold a repeated
20-word window together by anchor. Each task builds a compressed index of its
shard (whole buckets up to ``BLOCK`` words): the Burrows-Wheeler transform of the
concatenated blocks in a wavelet matrix of bit vectors with rank counts. The
blocks are then streamed through it by backward search, all windows at once, a
word a step: the result is the matching statistic of every position, the length
of its longest match up to the threshold, and for matches that reach it the
interval of the suffix array. The least occurrence in the interval (document,
then start) tells whether the window starts earlier elsewhere.

Cases: null texts have no words; documents under 20 words lose nothing. Rows that
share a doc_id and a text are one document's repeats: none is earlier than the
other at equal starts. Overlaps inside a document count. A doc_id that is no number is
an error (it is cast to long). Extra columns stay out.
Words are compared by 64-bit hashes; windows are 20 of them in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.anchored import KEY, Runs, Search, covered, unpacked
from touchline.llm.suffixdedup import ranges_of
from touchline.llm.runtime import tidy
from touchline.llm.textcore import Poly, chunks, ranges, word_spans

WINDOW = 20
GRAM = 5
#: Words in one index.
BLOCK = 1 << 17

_BYTES, _WORDS = Poly(31), Poly(32)
_BYTES2, _WORDS2 = Poly(33), Poly(34)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer sequence, by prefix doubling. Length and symbols are below 2**21, so two ranks and a place fit one number."""
    n = len(t)
    at = np.arange(n, dtype=np.uint64)
    rank = np.unique(t, return_inverse=True)[1].astype(np.uint64)
    low, step = np.uint64((1 << 21) - 1), 1
    while True:
        nxt = np.zeros(n, np.uint64)
        nxt[: max(n - step, 0)] = rank[step:] + np.uint64(1)
        packed = np.sort(rank << np.uint64(42) | nxt << np.uint64(21) | at)
        order, top = (packed & low).astype(np.int64), packed >> np.uint64(21)
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(top[1:] != top[:-1], dtype=np.uint64)])
        if step >= n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence; one bit vector with counts a level."""

    def __init__(self, s: np.ndarray, levels: int):
        self.levels, self.zeros, self.ranks = levels, [], []
        for k in range(levels - 1, -1, -1):
            bit = s >> k & 1
            count = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ranks.append(count)
            self.zeros.append(len(s) - int(count[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def descend(self, symbol: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
        """Where each position goes when its prefix is followed down the levels by the symbol; ranks are differences of such places."""
        for k, count, zeros in zip(range(self.levels - 1, -1, -1), self.ranks, self.zeros, strict=True):
            one = (symbol >> k & 1).astype(bool)
            ranks = [count[p] for p in at]
            at = [np.where(one, r + zeros, p - r) for p, r in zip(at, ranks, strict=True)]
        return at


class FMIndex:
    """Backward search over an integer sequence with symbols 0 (separator) .. sigma-1."""

    def __init__(self, t: np.ndarray):
        self.n = len(t)
        self.sa = suffix_array(t)
        sigma = int(t.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        self.wavelet = WaveletMatrix(t[self.sa - 1].astype(np.int32), max(1, sigma.bit_length()))
        # first row of each symbol, less the place where its own positions begin
        symbols = np.arange(sigma, dtype=np.int32)
        self.offset = (self.first[:-1] - self.wavelet.descend(symbols, [np.zeros(sigma, np.int32)])[0]).astype(np.int32)

    def matches(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end (exclusive) in text, the longest match ending there, up to most, and its suffix-array interval."""
        lo, hi = np.zeros(len(ends), np.int32), np.full(len(ends), self.n, np.int32)
        text = text.astype(np.int32)
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(1, most + 1):
            c = text[ends[live] - step]
            a, b = self.wavelet.descend(c, [lo[live], hi[live]])
            a, b = a + self.offset[c], b + self.offset[c]
            ok = (b > a) & (c > 0)
            live = live[ok]
            lo[live], hi[live], length[live] = a[ok], b[ok], step
        return length, lo, hi


def judge(blocks: list[tuple], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """blocks: (word hashes, windows, document, start). Returns (block, window) of each window that starts earlier elsewhere."""
    sizes = np.array([len(b[0]) for b in blocks])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.concatenate([b[0] for b in blocks])
    ids = np.unique(words, return_inverse=True)[1] + 1
    text = np.zeros(int(base[-1]) + 1, np.int64)
    text[ranges(base[:-1], sizes)] = ids
    index = FMIndex(text)
    n = np.array([b[1] for b in blocks], np.int64)
    starts = ranges(base[:-1], n)
    owner = np.repeat(np.arange(len(blocks)), n)
    length, lo, hi = index.matches(text, starts + window, window)
    # order of the windows by document and start; positions that start no window come last
    doc = np.array([b[2] for b in blocks])[owner]
    at = np.array([b[3] for b in blocks])[owner] + starts - base[owner]
    order = np.lexsort((at, doc))
    new = np.concatenate([[0], np.cumsum((doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1]))]) if len(order) else order
    place = np.full(len(text), len(order) + 1, np.int64)
    place[starts[order]] = new
    along = np.append(place[index.sa], len(order) + 1)
    # least place in each interval; those of full matches do not overlap
    full = np.flatnonzero(length == window)
    cuts, first, inverse = np.unique(lo[full], return_index=True, return_inverse=True)
    if not len(full):
        return full, full
    least = np.minimum.reduceat(along, np.stack([cuts, hi[full][first]], 1).ravel())[::2]
    hit = full[least[inverse] < place[starts[full]]]
    return owner[hit], starts[hit] - base[owner[hit]]


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their byte spans and the word offsets of the rows."""
    lo, hi, doc = word_spans(data, offs)
    h = _BYTES.slices(_BYTES.of_bytes(data), lo, hi)
    return h, lo, hi, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offs) - 1))])


def find(texts: pa.Array, full: bool) -> Iterator[tuple[int, dict]]:
    seek = Runs(_WORDS, WINDOW, GRAM)
    for i, _, data, offs in chunks(texts):
        h, lo, hi, rows = words_of(data, offs)

        def second(data=data, lo=lo, hi=hi):
            return _WORDS2, _WORDS2.prefix(_BYTES2.slices(_BYTES2.of_bytes(data), lo, hi))

        yield i, seek.find(_WORDS.prefix(h), rows, second if full else None)


BLOCKS = "a long, f long, g long, b long, base long, m long, doc_id long, s long, n long, d long, raw binary"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, _, data, offs in chunks(unpacked(b["z"])):
            h, _, _, rows = words_of(data, offs)
            cols: list[list] = [[] for _ in _NAMES]
            ids = b["doc_id"].slice(i, len(offs) - 1).to_pylist()
            for k, blocks in enumerate(b["blocks"].slice(i, len(offs) - 1).to_pylist()):
                for x in blocks:
                    s, n, d = x["p"] >> 20, x["p"] >> 10 & 1023, x["p"] & 1023
                    at = rows[k] + s
                    for c, v in zip(cols, (x["a"], x["f"], x["g"], x["a"], 0, x["m"], ids[k], s, n, d, h[at : at + n - 1 + WINDOW].tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "raw" else pa.int64()) for name, c in zip(_NAMES, cols, strict=True)], _NAMES)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of blocks by hash."""
    for b in batches:
        for x in b.to_pylist():
            at = np.arange(x["n"])
            key = _WORDS.slices(_WORDS.prefix(np.frombuffer(x["raw"], np.uint64)), at, at + WINDOW).view(np.int64)
            same = [pa.array(np.full(len(at), v, np.int64)) for v in (x["a"], x["f"], x["g"], x["m"], x["doc_id"])]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(at + v) for v in (x["s"] + x["base"], x["base"])), pa.array(key)], [*KEY, "m", "doc_id", "s", "lo", "key"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: whole buckets are gathered up to BLOCK words."""
    held: list[tuple] = []
    size, last = 0, None

    def done():
        k, w = judge([h[4:] for h in held])
        order = np.lexsort((w, k))
        k, lo, n = ranges_of(k[order], w[order])
        a, f, g, base = (np.array([h[x] for h in held], np.int64) for x in range(4))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[k], f[k], g[k], lo + base[k], n)], [*KEY, "lo", "n"])

    for b in batches:
        for key, a, f, g, base, doc, s, n, raw in zip(*(b[c].to_pylist() for c in ("b", *KEY, "base", "doc_id", "s", "n", "raw")), strict=True):
            if key != last and size > BLOCK:
                yield done()
                held, size = [], 0
            last = key
            held.append((a, f, g, base, np.frombuffer(raw, np.uint64), n, doc, s + base))
            size += len(raw) // 8
    if held:
        yield done()


def spans(search: Search) -> DataFrame:
    return search.spread(search.judged(_cut, BLOCKS, _judge, _windows, True, GRAM, WINDOW, 8), True)


def _left(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Words, words removed and the words that are left, joined by a space, of each row."""
    for i, _, data, offs in chunks(unpacked(b["z"])):
        lo, hi, doc = word_spans(data, offs)
        count = np.bincount(doc, minlength=len(offs) - 1)
        end = np.cumsum(count)
        raw = data.tobytes()
        for k, got in enumerate(b["spans"].slice(i, len(offs) - 1).to_pylist()):
            n, at = int(count[k]), int(end[k] - count[k])
            keep = np.ones(n, bool)
            for x, y in covered(got or [], WINDOW, n):
                keep[x:y] = False
            w = np.flatnonzero(keep) + at
            yield n, n - len(w), b" ".join([raw[x:y] for x, y in zip(lo[w].tolist(), hi[w].tolist(), strict=True)])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _left(b)]
        cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 3
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(cols))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([kept.decode() for _, _, kept in _left(b)], pa.string())], ["doc_id", "kept_text"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs."""
    search = Search(docs, find, sift=True)
    return search.annotated(spans(search)).select("doc_id", "z", "spans").mapInArrow(tidy(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_text(docs: DataFrame) -> DataFrame:
    """doc_id and the words that are left, joined by one space."""
    search = Search(docs, find, sift=True)
    return search.annotated(spans(search)).select("doc_id", "z", "spans").mapInArrow(tidy(_texts), "doc_id long, kept_text string")
