"""Exact removal of repeated strings (400 bytes, or as given) by suffix arrays built block by block.

``anchored.Search`` brings the distinct blocks of text that can hold a repeated
string together in buckets. A task takes whole buckets up to ``BLOCK`` bytes and
sorts their suffixes by the difference-cover method:

* A difference cover D of period V: for all i, j some shift d < V puts both i + d
  and j + d into positions that are in D modulo V. ``ranks`` sorts only those
  cover-sample suffixes, by prefix doubling over whole periods.
* Suffixes are sorted one bucket of equal leading bytes at a time: by their first
  V bytes and, where those tie, by the precomputed rank of the cover sample at
  the shared shift. Memory is the block, its sample ranks and one bucket's keys.
* Blocks are laid out with their anchors at multiples of V, so equal windows lie
  in one residue class, in which the shift is the same for all.

Neighbours in that order whose first 400 bytes agree (compared byte by byte) are
one group; a group's multiplicity is the sum of its blocks' multiplicities, and
from two on its windows are covered.

Cases: null texts are empty; texts under 400 bytes lose nothing. Repeated rows,
also with one doc_id, are separate occurrences. A doc_id that is no number is an
error (it is cast to long). Extra columns stay out. The text
left over may hold cut UTF-8 sequences; ``digests`` hashes its bytes and ``removed``
drops the stray bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.anchored import KEY, Runs, Search, covered, unpacked
from touchline.llm.runtime import tidy
from touchline.llm.textcore import Poly, chunks, ranges, runs

WINDOW = 400
GRAM = 32
V = 16
#: Bytes of text in whose suffixes a task sorts at once.
BLOCK = 1 << 19
#: Suffixes sorted at once; larger buckets of equal leading bytes are sorted whole.
BUCKET = 1 << 16

_POLY, _OTHER = Poly(21), Poly(22)


def difference_cover(v: int) -> list[int]:
    """A small set whose differences give every residue modulo v, chosen greedily."""
    cover, have = [0, 1], {0, 1, v - 1}
    while len(have) < v:
        best = max(range(v), key=lambda x: (len({(x - c) % v for c in cover} | {(c - x) % v for c in cover} | have), -x))
        have |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = np.array(difference_cover(V))
#: Shift from each residue to the next cover position.
SHIFT = np.array([min((c - r) % V for c in COVER) for r in range(V)])


def leading(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Bytes at+8k .. at+8k+7 as numbers that compare as the bytes do. text has 8 spare bytes at its end."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)[at + 8 * k]
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def dense(hi: np.ndarray, lo: np.ndarray | None = None) -> np.ndarray:
    """Rank of each value (or pair) among the distinct ones. Pairs are of ranks below 2**21, so a pair and its place fit one number."""
    if lo is None:
        return np.unique(hi, return_inverse=True)[1].astype(np.uint64)
    if len(hi) >= 1 << 21:
        return np.unique(hi << np.uint64(32) | lo, return_inverse=True)[1].astype(np.uint64)
    packed = np.sort(hi << np.uint64(42) | lo << np.uint64(21) | np.arange(len(hi), dtype=np.uint64))
    top = packed >> np.uint64(21)
    out = np.empty(len(hi), np.uint64)
    out[(packed & np.uint64((1 << 21) - 1)).astype(np.int64)] = np.cumsum(np.concatenate([[False], top[1:] != top[:-1]]))[: len(hi)]
    return out


def period_ranks(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order of the V bytes from each position, as dense ranks."""
    r = dense(leading(text, at, 0))
    for k in range(1, V // 8):
        r = dense(r, dense(leading(text, at, k)))
    return r


def ranks(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Rank of every cover-sample suffix of text[:size] by at least depth bytes; indexed by position, 0 elsewhere."""
    periods = -(-size // V)
    at = (np.arange(periods)[:, None] * V + COVER).ravel()
    rank = period_ranks(text, at)
    have, step = V, len(COVER)
    while have < depth:
        # the sample `have` bytes on has the same residue: `step` sample rows further
        nxt = np.zeros(len(at), np.uint64)
        nxt[: max(len(at) - step, 0)] = rank[step:] + np.uint64(1)
        rank = dense(rank, nxt)
        have, step = 2 * have, 2 * step
    out = np.zeros(periods * V + V, np.uint64)
    out[at] = rank
    return out


def suffix_groups(text: np.ndarray, size: int, starts: np.ndarray, window: int = WINDOW) -> Iterator[np.ndarray]:
    """Groups of starts whose windows are equal, as (sorted starts, group number) arrays per sorted bucket.

    text has at least window + V + 8 spare bytes after size.
    """
    cover = ranks(text, size, window)
    lead = leading(text, starts, 0)
    order = np.argsort(lead)
    lead, starts = lead[order], starts[order]
    first, count = runs(lead)
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    i = 0
    while i < len(first):
        end = first[i] + BUCKET
        j = max(i + 1, int(np.searchsorted(first + count, end, "right")))
        s = starts[first[i] : first[j - 1] + count[j - 1]]
        i = j
        # the first V bytes, then the residue class and the cover sample's rank at its shift
        residue = s % V
        tie = residue.astype(np.uint64) << np.uint64(27) | cover[s + SHIFT[residue]]
        key = period_ranks(text, s) << np.uint64(32) | tie
        order = np.argsort(key)
        s, key = s[order], key[order]
        # equal keys agree on more than the window; where only the rank differs the bytes decide
        new = np.ones(len(s), bool)
        new[1:] = key[1:] != key[:-1]
        close = np.flatnonzero(new[1:] & (key[1:] >> np.uint64(27) == key[:-1] >> np.uint64(27)))
        for a in range(0, len(close), 1 << 12):
            c = close[a : a + (1 << 12)]
            new[c + 1] = (np.ascontiguousarray(view[s[c]]).view(np.uint64) != np.ascontiguousarray(view[s[c + 1]]).view(np.uint64)).any(1)
        yield s, np.cumsum(new) - 1


def judge(blocks: list[tuple], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """blocks: (bytes, windows, anchor offset, multiplicity). Returns (block, window) of each covered window."""
    sizes = np.array([len(b[0]) for b in blocks])
    base, at = np.empty(len(blocks), np.int64), 0
    for k, (_, _, d, _) in enumerate(blocks):
        base[k] = at + (-(at + d)) % V
        at = base[k] + sizes[k]
    text = np.zeros(at + 8 + 2 * V + window, np.uint8)
    for k, b in enumerate(blocks):
        text[base[k] : base[k] + sizes[k]] = np.frombuffer(b[0], np.uint8)
    n = np.array([b[1] for b in blocks])
    many = np.array([b[3] for b in blocks])
    starts = ranges(base, n)
    owner = np.repeat(np.arange(len(blocks)), n)
    block_of = np.zeros(at + 1, np.int64)
    block_of[starts] = owner
    hit = []
    for s, group in suffix_groups(text, at, starts, window):
        total = np.bincount(group, many[block_of[s]])
        hit.append(s[total[group] > 1])
    s = np.sort(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
    k = block_of[s]
    return k, s - base[k]


def finder(window: int):
    def find(texts: pa.Array, full: bool) -> Iterator[tuple[int, dict]]:
        seek = Runs(_POLY, window, GRAM)
        for i, _, data, offs in chunks(texts):
            yield i, seek.find(_POLY.of_bytes(data), offs, (lambda data=data: (_OTHER, _OTHER.of_bytes(data))) if full else None)

    return find


BLOCKS = "a long, f long, g long, b long, base long, m long, n long, d long, raw binary"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _cut(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in _NAMES]
        for text, blocks in zip(unpacked(b["z"]), b["blocks"].to_pylist(), strict=True):
            raw = text.as_py().encode()
            for x in blocks:
                s, n, d = x["p"] >> 20, x["p"] >> 10 & 1023, x["p"] & 1023
                for c, v in zip(cols, (x["a"], x["f"], x["g"], x["a"], 0, x["m"], n, d, raw[s : s + n - 1 + window]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "raw" else pa.int64()) for name, c in zip(_NAMES, cols, strict=True)], _NAMES)


def _windows(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """The windows of blocks by hash."""
    for b in batches:
        for x in b.to_pylist():
            at = np.arange(x["n"])
            key = _POLY.slices(_POLY.of_bytes(np.frombuffer(x["raw"], np.uint8)), at, at + window).view(np.int64)
            same = [pa.array(np.full(len(at), v, np.int64)) for v in (x["a"], x["f"], x["g"], x["m"], 0, 0)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(at + x["base"]), pa.array(key)], [*KEY, "m", "doc_id", "s", "lo", "key"])


def ranges_of(k: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows: (block, first, count)."""
    if not len(k):
        return k, k, k
    first, count = runs(k * (1 << 20) + w - np.arange(len(k)))
    return k[first], w[first], count


def _judge(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: whole buckets are gathered up to BLOCK bytes."""
    held: list[tuple] = []
    size, last = 0, None

    def done():
        k, w = judge([h[4:] for h in held], window)
        k, lo, n = ranges_of(k, w)
        a, f, g, base = (np.array([h[x] for h in held], np.int64) for x in range(4))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[k], f[k], g[k], lo + base[k], n)], [*KEY, "lo", "n"])

    for b in batches:
        for key, *block, raw, n, d, m in zip(*(b[c].to_pylist() for c in ("b", *KEY, "base", "raw", "n", "d", "m")), strict=True):
            if key != last and size > BLOCK:
                yield done()
                held, size = [], 0
            last = key
            held.append((*block, raw, n, d, m))
            size += len(raw)
    if held:
        yield done()


def spans(search: Search, window: int) -> DataFrame:
    cut, judge_, windows = (partial(f, window=window) for f in (_cut, _judge, _windows))
    verdicts = search.judged(cut, BLOCKS, judge_, windows, False, GRAM, window, 1)
    return search.spread(verdicts.unionByName(search.alone()), False)


def _left(b: pa.RecordBatch, window: int) -> Iterator[tuple[bytes, bytes, int]]:
    """Bytes, bytes that are left, and removed runs of each row."""
    for text, got in zip(unpacked(b["z"]), b["spans"].to_pylist(), strict=True):
        raw = text.as_py().encode()
        cut = covered(got or [], window, len(raw))
        ends = [0, *(x for c in cut for x in c), len(raw)]
        yield raw, b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)) if cut else raw, len(cut)


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch], window: int, text: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGESTS.split(", ")] + ["text"] * text
    for b in batches:
        out = [(len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] * text)) for raw, kept, n in _left(b, window)]
        cols = [list(c) for c in zip(*out, strict=True)] or [[]] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.string() if k >= 3 else pa.int64()) for k, c in enumerate(cols))], names)


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["row"], pa.array([kept.decode("utf-8", "ignore") for _, kept, _ in _left(b, window)], pa.string())], ["row", "kept"])


def digests(docs: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs; with text also what is left, without cut characters."""
    search = Search(docs, finder(window), sift=True)
    return search.annotated(spans(search, window)).select("doc_id", "z", "spans").mapInArrow(tidy(partial(_digest, window=window, text=text)), DIGESTS + ", text string" * text)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the text that is left in place of the text (and n_chars to match); all columns and rows stay. window: bytes of the repeated strings that go."""
    search = Search(docs, finder(window), sift=True)
    kind = search.docs.schema["row"].dataType.simpleString()
    got = search.annotated(spans(search, window), rows=True).select("z", "spans", "row").mapInArrow(tidy(partial(_texts, window=window)), f"row {kind}, kept string")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("kept")}
    return got.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
