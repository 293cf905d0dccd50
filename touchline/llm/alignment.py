"""Alignment of two tokenizers by the byte offsets at which their tokens end.

Documents of an Arrow batch are laid end to end (runs of ``RUN`` bytes; a longer
document is a run of its own), each with the space that both tokenizers put before it. The token lengths of A
and of B give the offsets at which tokens end; one bincount of each over the run
marks them, and where both are marked the text is cut into groups. Prefix sums
over the marks, taken at the documents' bounds, give each document's figures, and
token positions in the written form follow from the same sums.

A and B tokens that end together are linked, so each cut has one link: the last A
and the last B token of its group. A document keeps each of its (A id, B id)
pairs with its number, in a table written once to the shared folder; corpus-wide
counts are sums over that table. They are bounded by the product of the two
vocabularies, not by the input. Up to ``BROADCAST_PAIRS`` of them are broadcast,
else both sides are shuffled by the pair.

A is a byte-level vocabulary and B a piece vocabulary with byte fallback. Strings
of special tokens in a text are plain text. Tokens of A come from a rank-based
encoder where its ids are known to be the same (see ``packing.Encoder``), else from
the vocabulary's own library.

Cases: a text that is null or empty, or whose joined bytes by A or B differ from the space and the text (B
writes U+2581 for a space, so a text holding it is one), has no tokens: zeros and ''. Repeated rows and shared or
null doc_ids are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.packing import LONG_RUN, PLAIN, Encoder, byte_symbols
from touchline.llm.runtime import shared_folder, tidy
from touchline.llm.textcore import chunks, ranges

#: Bytes of text aligned at once.
RUN = 1 << 20
#: Distinct pairs (16 bytes each) up to which their counts are broadcast.
BROADCAST_PAIRS = 2_000_000
SHIFT = 1 << 20


class Bytes:
    """Bytes of every token of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.start[ids], self.size[ids])]


class ByteLevel:
    """A: ids and bytes of a byte-level vocabulary file; added tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.path = path
        added = {t["content"] for t in kind.get("added_tokens") or []}
        vocab, symbols = kind["model"]["vocab"], byte_symbols()
        tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in kind.get("added_tokens") or [])]) + 1)
        for w, k in vocab.items():
            tokens[k] = w.encode() if w in added else bytes(symbols[c] for c in w)
        self.bytes = Bytes(tokens)
        self.fast = Encoder(path).fast

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.encode_special_tokens = True
        return t

    def ids(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and not LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


class Pieces:
    """B: ids and bytes of a piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(k) for k in range(m.vocab_size())]
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if m.is_byte(k) else b"" if m.is_control(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 .. n - 1 and how many each has."""
    text = [str(k).encode() for k in range(n)]
    width = len(text[-1])
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(n, width), np.array([len(t) for t in text])


def written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, digits: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as `a1,a2|b1;` end to end, and the bytes before each group and at the end."""
    groups = int(group_a[-1]) + 1 if len(a) else 0
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + (before_a + n_a)[group_b]
    ids[at_a], ids[at_b] = a, b
    ends = np.cumsum(n_a + n_b)
    mark[ends - n_b - 1] = ord("|")
    mark[ends - 1] = ord(";")
    size = width[ids] + 1
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    out[stop - 1] = mark
    start = stop - size
    for k in range(digits.shape[1]):
        has = np.flatnonzero(size > k + 1)
        out[start[has] + k] = digits[ids[has], k]
    return out, np.concatenate([[0], stop[ends - 1]])


def align(texts: list[str], one: ByteLevel, two: Pieces, digits: np.ndarray, width: np.ndarray) -> list[tuple]:
    """(n_a, n_b, n_groups, sha, linked A ids, linked B ids) of every text, over all of them at once."""
    raw = [(" " + t).encode() if t else b"" for t in texts]
    a = [one.ids(" " + t) if t else [] for t in texts]
    b = [two.ids(t) if t else [] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    flat, rows = {}, {}
    good = np.array([bool(t) for t in texts])
    whole = np.frombuffer(b"".join(raw), np.uint8)
    for side, ids, table in (("a", a, one.bytes), ("b", b, two.bytes)):
        size = np.array([len(x) for x in ids], np.int64)
        flat[side] = np.fromiter((k for x in ids for k in x), np.int64, int(size.sum()))
        rows[side] = np.repeat(np.arange(len(texts)), size)
        held = np.bincount(rows[side], table.size[flat[side]], len(texts)).astype(np.int64)
        good &= held == np.diff(bounds)
    for side, table in (("a", one.bytes), ("b", two.bytes)):
        stay = good[rows[side]]
        data = table.joined(flat[side][stay])
        where = ranges(bounds[:-1][good], np.diff(bounds)[good])
        wrong = np.searchsorted(bounds, where[np.flatnonzero(whole[where] != data)], "right") - 1
        good[wrong] = False
    ends = {}
    for side, table in (("a", one.bytes), ("b", two.bytes)):
        stay = good[rows[side]]
        flat[side], rows[side] = flat[side][stay], rows[side][stay]
        size = table.size[flat[side]]
        first = np.searchsorted(rows[side], np.arange(len(texts)))
        before = np.concatenate([[0], np.cumsum(size)])
        ends[side] = before[1:] - before[first[rows[side]]] + bounds[rows[side]]
    marks = [np.bincount(ends[side], minlength=bounds[-1] + 1) > 0 for side in ("a", "b")]
    cut = marks[0] & marks[1]
    past = np.concatenate([[0], np.cumsum(cut)])  # cuts before each offset
    last = {side: np.flatnonzero(cut[ends[side]]) for side in ("a", "b")}
    linked_a, linked_b = flat["a"][last["a"]], flat["b"][last["b"]]
    text, at = written(flat["a"], flat["b"], past[ends["a"]], past[ends["b"]], digits, width)
    lo = past[bounds[:-1] + 1]  # a document's first token ends after its first byte at the earliest
    hi = past[bounds[1:] + 1]
    lo = np.where(good, lo, hi)
    data = memoryview(text)
    n_a, n_b = (np.bincount(rows[side], minlength=len(texts)) for side in ("a", "b"))
    return [(int(n_a[k]), int(n_b[k]), int(hi[k] - lo[k]), hashlib.sha256(data[at[lo[k]] : at[hi[k]] - 1]).hexdigest() if good[k] else "", linked_a[lo[k] : hi[k]], linked_b[lo[k] : hi[k]]) for k in range(len(texts))]


def _aligned(vocabulary: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteLevel(vocabulary), Pieces(pieces)
        digits, width = decimals(max(len(one.bytes.size), len(two.bytes.size)))
        for batch in batches:
            for i, j, _, _ in chunks(batch["text"], RUN):
                b = batch.slice(i, j - i)
                found = align(b["text"].to_pylist(), one, two, digits, width)
                pairs = [np.unique(x[4] * SHIFT + x[5], return_counts=True) for x in found]
                offs = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in pairs])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offs, pa.array(np.concatenate(c))) for c in ([k // SHIFT for k, _ in pairs], [k % SHIFT for k, _ in pairs], [m for _, m in pairs])]
                plain = [pa.array([x[k] for x in found]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], *plain, *(c.cast(pa.list_(pa.int32())) for c in lists)], ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "m"])

    return run


def aligned(docs: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """Per document its figures and its distinct linked pairs (arrays a, b and their numbers m), written once and read again."""
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    rows = own.mapInArrow(tidy(_aligned(vocabulary, pieces)), "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, m array<int>")
    path = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.parquet(path)


def pair_counts(table: DataFrame) -> DataFrame:
    """a, b, count and best (no A id is linked to b more often) of every linked pair of ids."""
    each = table.select(F.explode(F.arrays_zip("a", "b", "m")).alias("l"))
    counts = each.groupBy("l.a", "l.b").agg(F.sum("l.m").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    table = aligned(docs, vocabulary, pieces)
    path = f"{shared_folder(docs.sparkSession)}/pairs-{uuid.uuid4().hex}"
    pair_counts(table).write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    few = counts.count() <= BROADCAST_PAIRS
    each = table.select("row", F.explode(F.arrays_zip("a", "b", "m")).alias("l")).select("row", "l.a", "l.b", "l.m")
    m = F.col("m").cast("long")
    sums = each.join(F.broadcast(counts) if few else counts, ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("best"), m).otherwise(0)).alias("n_best"), F.sum(m * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = table.drop("a", "b", "m").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
