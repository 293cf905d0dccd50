"""Packing documents into training windows by the sum-of-squares rule.

``pack`` tokenises every document once, cuts it into full windows and one
remainder, deals the pieces to shards by a hash of the piece, and each shard
places its remainders online: a piece goes to the fill level that makes the sum
of squared counts of partially filled windows least (``SumOfSquares``). Counts
per level live in one array, so a placement costs one vector expression however
many windows are open.

A shard is one partition and takes about ``SHARD_BYTES`` of text, so shards grow
in number with the bytes of the input, and the pieces of one very long document
spread over all of them. The windows that are still open when a shard ends are
emptied into windows cut to the brim, and the last one into runs whose lengths
are powers of two, which need no padding.

Ids are those of the tokenizer file, whose added tokens (as in "<|endoftext|>")
keep their own ids where a text holds them. ``Encoder`` has a faster way with
equal ids for plain text; see there.

Cases: null and empty texts are one token long (the end mark). Rows with the
same doc_id are packed each for itself. Extra columns are ignored. No rows give
no rows. Documents of any length stream through; one is held at a time. A
vocabulary with ids over 65,535 is refused: pieces keep two bytes an id.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.runtime import tidy

WINDOW = 1024
END = 0
#: Bytes of text for which there is a shard.
SHARD_BYTES = 16 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Characters on whose classes all versions of Unicode that the two libraries use agree; tests hold them against each other.
PLAIN = re.compile("[\x00-\u052f\u1e00-\u1eff\u2000-\u205f\u20a0-\u20ac\u2190-\u21ff\u2200-\u22ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Runs on which the faster library is slow or exhausts its stack.
LONG_RUN = re.compile(r"\s{1000}|\S{10000}")


def byte_symbols() -> dict[str, int]:
    """The symbol by which byte-level vocabularies write each byte: itself where printable, else the next symbol from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Text to ids, as the tokenizer file gives them without special tokens added.

    The file's own library decides every id. Where its vocabulary is a byte-level
    one whose ids follow the order of the merges, a text of plain characters
    without one of the added tokens and without very long runs has the same ids in
    a rank-based encoder made from the same vocabulary, in a quarter of the time.
    """

    def __init__(self, vocabulary: str, pattern: str | None = None):
        with open(vocabulary, encoding="utf-8") as f:
            kind = json.load(f)
        added = {t["content"] for t in kind.get("added_tokens") or []}
        self.vocabulary = vocabulary
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)")
        self.fast = self._ranked(kind, added, pattern)

    @cached_property
    def exact(self):
        """The file's own encoder; tasks whose texts are all plain never hold it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    @staticmethod
    def _ranked(kind: dict, added: set, pattern: str | None):
        split, model = kind.get("pre_tokenizer") or {}, kind["model"]
        if kind.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or model.get("type") != "BPE":
            return None
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in w): k for w, k in model["vocab"].items() if w not in added}
        made = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if sorted(ranks.values()) != list(range(len(ranks))) or [model["vocab"][a + b] for a, b in made] != list(range(256, len(ranks))):
            return None
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and not self.added.search(text) and not LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def encoder(vocabulary: str, pattern: str | None = None) -> Encoder:
    return Encoder(vocabulary, pattern)


class SumOfSquares:
    """Online placement of sizes into windows; level[h] counts the open windows filled to h."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window)]

    def place(self, size: int):
        """The window for a piece of this size (1..window-1): its fill level before, 0 for a new one.

        Moving a window from h to h+size changes the sum of squares by
        2 * (level[h+size] - level[h] + 1); a new window adds 2*level[size]+1; a
        window that becomes full leaves the sum.
        """
        w, lv = self.window, self.level
        cost = lv[size:w] - lv[: w - size] + 1  # h = 0 .. w-size-1, new levels below w
        cost = 2 * cost
        cost[0] = 2 * lv[size] + 1
        held = lv[: w - size] > 0
        held[0] = True
        best = int(np.argmin(np.where(held, cost, np.iinfo(np.int64).max)))
        least = int(cost[best])
        h = w - size  # fills a window to the brim
        if lv[h] > 0 and 1 - 2 * int(lv[h]) <= least:
            best = h
        return best

    def add(self, size: int, item):
        """Places the item; returns the window's items when it is full, else None."""
        h = self.place(size)
        items = self.open[h].pop() if h else []
        if h:
            self.level[h] -= 1
        items.append(item)
        if h + size == self.window:
            return items
        self.level[h + size] += 1
        self.open[h + size].append(items)
        return None

    def rest(self) -> Iterator[list]:
        for h in range(self.window - 1, 0, -1):
            yield from self.open[h]


def _tokenise(vocabulary: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            cols: list[list] = [[], [], [], []]

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["doc_id", "start", "ids", "doc_tokens"])

            held = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END)
                raw = np.array(ids, "<u2").tobytes()
                for a in range(0, len(ids), window):
                    for c, v in zip(cols, (doc, a, raw[2 * a : 2 * (a + window)], len(ids)), strict=True):
                        c.append(v)
                held += len(raw)
                if held > 8 << 20:
                    yield out()
                    cols, held = [[], [], [], []], 0
            yield out()

    return run


def _place(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, squares = TaskContext.get().partitionId(), 0, SumOfSquares(window)
        out: list[tuple] = []

        def emit(items):
            nonlocal made
            at = 0
            for doc, start, ids, total in items:
                n = len(ids) // 2
                out.append((doc, start, n, ids, total, (shard << 40) + made, at))
                at += n
            made += 1

        def finish():
            """Cuts what is still open into full windows and, at last, powers of two."""
            items, have = [], 0
            left = sum(len(x[2]) // 2 for w in squares.rest() for x in w)
            want = min(window, left)
            if 0 < want < window:
                want = 1 << want.bit_length() - 1
            for w in squares.rest():
                for doc, start, ids, total in w:
                    while ids:
                        n = min(len(ids) // 2, want - have)
                        items.append((doc, start, ids[: 2 * n], total))
                        ids, start, have, left = ids[2 * n :], start + n, have + n, left - n
                        if have == want:
                            emit(items)
                            items, have = [], 0
                            want = window if left >= window else 1 << left.bit_length() - 1 if left else 0

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 7
            got = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return got

        for batch in batches:
            for item in zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                n = len(item[2]) // 2
                full = [item] if n == window else squares.add(n, item)
                if full:
                    emit(full)
                if len(out) >= 4096:
                    yield flush()
        finish()
        yield flush()

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece with its ids, its window (sequence_id) and its place there.

    The number of shards follows the bytes of text, not the executors: a shard is
    the unit in which windows are cut at its end. A lost task redoes its shard
    alone and, as a shard's rows are sorted, with the same result.
    """
    mass = docs.select(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0
    shards = 1 + mass // shard_bytes
    toks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_tokenise(vocabulary, window)), "doc_id long, start long, ids binary, doc_tokens long")
    place = F.xxhash64("doc_id", "start", "doc_tokens", "ids")
    dealt = toks.repartition(shards, place).sortWithinPartitions(place, "doc_id", "start", "doc_tokens", "ids")
    return dealt.mapInArrow(tidy(_place(window)), SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = []
        for ids in b["ids"].to_pylist():
            crc.append(zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
        keep = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([b[c] for c in keep] + [pa.array(crc, pa.int64())], [*keep, "ids_crc32"])


def digests(packed: DataFrame) -> DataFrame:
    """Pieces with a checksum (of 32-bit little-endian ids) in place of the ids."""
    return packed.mapInArrow(tidy(_digests), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
