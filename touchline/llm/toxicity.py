"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams (lower-cased ASCII, white
space as one symbol) anywhere in the whole text. The ratio of smoothed presence
counts in the two classes picks the telling n-grams and scales them; logistic
regression on the scaled features gives the score.

Presence is counted in tasks and summed by hash; the driver gets the picked
n-grams and, of each sample document, which of them it has, but no text.

The fit uses at most ``SAMPLE`` labelled documents a class, the first by a hash
of doc_id, up to ``SAMPLE_BYTES`` of text a class: a document that would pass the
bound is left out of the fit and the next one is tried. Scoring uses all of every text.

Cases: a null or empty text has no features and gets the score of the bias.
Null labels are left out; a document counts once for each label that it has,
however often its label or its row is repeated (of several texts with one doc_id
the shortest is used, then the least). With one class or none in the labels
every score is the share of toxic labels (0 if there are none). Extra columns stay out. Repeated
rows get a score each. Very long texts are scored in one pass over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.linear import Rows, fit, sigmoid
from touchline.llm.runtime import checkpointed, crc_mod, tidy
from touchline.llm.textcore import LOWER, SPACE, chunks

SAMPLE = 4000
SAMPLE_BYTES = 12 << 20
#: Chosen, as the orders, on an inner fold of the training labels.
FEATURES = 2000
ORDERS = (3, 5, 7)
BITS = 22

#: Tasks that count the sample.
TASKS = 4

_FOLD = LOWER.copy()
_FOLD[SPACE] = 32


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of UTF-8 bytes, and the rows' offsets among them."""
    c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    plain = np.flatnonzero(c < 128)
    c[plain] = _FOLD[c[plain]]
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return c, before[offs]


def ngrams(d: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters from each position; -1 where they leave the row."""
    m = len(d) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193 * 2 + 1)
        h ^= d[k : k + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    out = (h >> np.uint32(32 - BITS)).astype(np.int64)
    bad = (offs[1:-1, None] - np.arange(1, n)).ravel()
    out[bad[(bad >= 0) & (bad < m)]] = -1
    return out


def features(data: np.ndarray, offs: np.ndarray, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs; index maps hashes to features, negative ones are dropped."""
    every = []
    d, offs = characters(data, offs)
    for n in ORDERS:
        h = ngrams(d, offs, n)
        at = np.flatnonzero(h >= 0) if index is None else np.flatnonzero(index[h] >= 0)
        at = at[h[at] >= 0]
        f = h[at] if index is None else index[h[at]]
        every.append(np.searchsorted(offs, at, "right").astype(np.int64) - 1 << BITS | f)
    pairs = np.unique(np.concatenate(every))
    return pairs >> BITS, pairs & (1 << BITS) - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class with each hash, of this task's rows."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        y = b["y"].to_numpy(zero_copy_only=False)
        for i, j, data, offs in chunks(b["t"]):
            r, f = features(data, offs)
            for c in (0, 1):
                seen[c] += np.bincount(f[y[i:j][r] == c], minlength=1 << BITS).astype(np.int32)
    h = np.flatnonzero(seen.any(0))
    for i in range(0, len(h), 1 << 18):
        at = h[i : i + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at].astype(np.int64)), pa.array(seen[1, at].astype(np.int64))], ["h", "neg", "pos"])


def _held(index: np.ndarray):
    """Of each row, the picked n-grams that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b["t"]):
                r, f = features(data, offs, index)
                cuts = np.searchsorted(r, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b["y"].slice(i, j - i), b["id"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(cuts), pa.array(f.astype(np.int16)))], ["y", "id", "f"])

    return run


def picked(sample: DataFrame, n_pos: int, n_neg: int) -> list[tuple[int, float]]:
    """(hash, log-count ratio) of the most telling n-grams: the largest difference of the classes' shares in its standard error, over two."""
    counts = sample.repartition(TASKS).mapInArrow(tidy(_counted), "h int, neg long, pos long").groupBy("h").agg((F.sum("pos") + 1.0).alias("pos"), (F.sum("neg") + 1.0).alias("neg"))
    np_, nn = n_pos + 2.0, n_neg + 2.0
    p = (F.col("pos") + F.col("neg")) / (np_ + nn)
    z = F.abs(F.col("pos") / np_ - F.col("neg") / nn) / F.sqrt(p * (1 - p) * (1 / np_ + 1 / nn) + 1e-12)
    ratio = F.log(F.col("pos") / np_) - F.log(F.col("neg") / nn)
    best = counts.select("h", z.alias("z"), ratio.alias("ratio")).where("z > 2").orderBy(F.desc(F.round("z", 9)), "h").limit(FEATURES)
    return sorted((r["h"], r["ratio"]) for r in best.collect())


def train(sample: DataFrame, share: float) -> dict:
    """The model of sample(y, id, t). share: of toxic rows among all labels, the score of every text if nothing can be learned."""
    flat = {"index": None, "w": np.zeros(1), "b": float(share)}
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return flat
    best = picked(sample, n[1], n[0])
    if not best:
        return flat
    index = np.full(1 << BITS, -1, np.int32)
    index[[h for h, _ in best]] = np.arange(len(best))
    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(tidy(_held(index)), f"y int, id {kind}, f array<smallint>").orderBy("y", "id").collect()
    size = np.array([len(r["f"]) for r in rows])
    col = np.fromiter((k for r in rows for k in r["f"]), np.int32, int(size.sum()))
    x = Rows(np.repeat(np.arange(len(rows), dtype=np.int32), size), col, (len(rows), len(best)))
    y = np.array([1.0 if r["y"] == 1 else -1.0 for r in rows])
    del rows
    w, b = fit(x, y, "log", 1e-4, scale=np.array([v for _, v in best]), steps=200)
    return {"index": index, "w": w, "b": float(b)}


def score_chunk(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    if model["index"] is None:
        return np.full(n, model["b"])
    r, f = features(data, offs, model["index"])
    return sigmoid(np.bincount(r, model["w"][f], n) + model["b"])


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    """Trains on labelled rows outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0)."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_y is not null").where(crc_mod(F.col("_id"), 5) != 0)
    counts = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    text = F.col("text").cast("string")
    rows = docs.where(F.octet_length(text) > 0)
    sized = rows.select("doc_id", F.octet_length(text).alias("n")).join(lab.distinct(), F.col("doc_id") == F.col("_id")).groupBy("_y", "_id").agg(F.min("n").alias("n")).where(F.col("n") <= SAMPLE_BYTES)
    chosen = []
    for label in (0, 1):
        held = 0
        for r in sized.where(F.col("_y") == label).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect():
            if held + r["n"] <= SAMPLE_BYTES:
                held += r["n"]
                chosen.append((r["_y"], r["_id"]))
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, sized.select("_y", "_id").schema))  # 2 * SAMPLE rows at most
    least = F.min(F.struct(F.octet_length(text).alias("n"), text.alias("t"))).alias("least")
    sample = rows.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).groupBy("_y", "_id").agg(least)
    return train(checkpointed(sample.select(F.col("_y").alias("y"), F.col("_id").alias("id"), "least.t")), share)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))  # FEATURES weights and an index of 2**BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, j, data, offs in chunks(b["text"]):
                s[i:j] = score_chunk(model.value, data, offs)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double")
    return out.select("doc_id", (F.coalesce(crc_mod(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows scored toxic; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, j, data, offs in chunks(b["text"].cast(pa.large_string())):
                s[i:j] = score_chunk(model.value, data, offs)
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
