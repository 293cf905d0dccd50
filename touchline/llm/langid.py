"""Language identification in two stages: the family first, then one-versus-one linear support vector machines inside the family.

A text is described by the histogram of its hashed byte n-grams (orders 1 to 3,
lower-cased, over the whole text), as square roots of shares, which has unit
length. Family machines are one-versus-rest; inside a family every pair of
languages has a machine and the votes, then the summed margins, decide.

The fit uses at most ``SAMPLE`` documents a language and ``LANGS`` * ``SAMPLE`` in all, the first by a hash of doc_id
(languages in turn), up to ``SAMPLE_BYTES`` of text: a document that would pass the bound, or that is longer than
``SAMPLE_BYTES / LANGS``, is left out of the fit and the next one is tried. Prediction uses whole texts.

Cases: null, empty and letterless texts give ``und`` with score 0, as does every
text if nothing can be learned. Null languages are not learned from. A language
outside ``FAMILIES`` is a family of its own. Of repeated rows with one doc_id and
lang the shortest text is learned from, then the least. Extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.linear import Dense, fit
from touchline.llm.runtime import crc_mod, tidy
from touchline.llm.textcore import LOWER, SPACE, chunks

SAMPLE = 400
SAMPLE_BYTES = 24 << 20
#: Languages whose samples are sure to fit; the bound of what is collected.
LANGS = 20
BITS = 12
ORDERS = (1, 2, 3)

# Language families by ISO 639-1 code (fixed values).
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "fy", "nb", "nn"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "be", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
    "celtic": ("ga", "cy", "gd", "br"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_FOLD = LOWER.copy()
_FOLD[SPACE] = 32
_FOLD[48:58] = 48


def histograms(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A unit row per text."""
    n, size = len(offs) - 1, 1 << BITS
    d = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(offs))
    hist = np.zeros(n * size)
    for k in ORDERS:
        m = len(d) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for q in range(k):
            h *= np.uint32(0x01000193)
            h ^= d[q : q + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        inside = doc[:m] == doc[k - 1 :]  # not run into the next text
        hist += np.bincount((doc[:m] | (h >> np.uint32(32 - BITS)))[inside], minlength=n * size)
    hist = np.sqrt(hist.reshape(n, size))
    return hist / np.maximum(np.linalg.norm(hist, axis=1, keepdims=True), 1e-12)


def train(texts: list[str], langs: list[str]) -> dict:
    """Machines: family names, one-versus-rest weights, and per family the pairs of languages."""
    codes = sorted(set(langs))
    family = {c: FAMILY.get(c, c) for c in codes}
    names = sorted(set(family.values()))
    model = {"codes": codes, "family": [names.index(family[c]) for c in codes], "names": names, "top": None, "pairs": []}
    if not codes:
        return model
    x = np.concatenate([histograms(d, o) for _, _, d, o in chunks(pa.array(texts, pa.large_string()), 1 << 18)])
    y = np.array([codes.index(c) for c in langs])
    fam = np.array(model["family"])[y]

    def machine(rows, positive):
        sign = np.where(positive, 1.0, -1.0)
        return fit(Dense(x[rows]), sign, "hinge", 1e-3, steps=120)

    if len(names) > 1:
        fits = [machine(slice(None), fam == k) for k in range(len(names))]
        model["top"] = (np.array([w for w, _ in fits]).T, np.array([b for _, b in fits]))
    for a, b in combinations(range(len(codes)), 2):
        if model["family"][a] == model["family"][b]:
            rows = np.flatnonzero((y == a) | (y == b))
            model["pairs"].append((a, b, *machine(rows, y[rows] == a)))
    return model


def predict_chunk(model: dict, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and a score for every text."""
    n, codes = len(offs) - 1, model["codes"]
    if not codes:
        return np.full(n, -1), np.zeros(n)
    x = histograms(data, offs)
    fam = np.array(model["family"])
    if model["top"] is None:
        best, trust = np.zeros(n, int), np.ones(n)
    else:
        z = x @ model["top"][0] + model["top"][1]
        best = z.argmax(1)
        two = np.partition(z, -2, axis=1)[:, -2:]
        trust = 1 / (1 + np.exp(-4 * (two[:, 1] - two[:, 0])))
    votes = np.zeros((n, len(codes)))
    for a, b, w, c in model["pairs"]:
        z = x @ w + c
        soft = 1 / (1 + np.exp(-4 * z))
        votes[:, a] += (z >= 0) + soft * 1e-3
        votes[:, b] += (z < 0) + (1 - soft) * 1e-3
    inside = fam[None, :] == best[:, None]
    lang = np.where(inside, votes, -1).argmax(1)
    near = np.ones(n)
    for a, b, w, c in model["pairs"]:
        z = x @ w + c
        for own, s in ((a, z), (b, -z)):
            near = np.where(lang == own, np.minimum(near, 1 / (1 + np.exp(-4 * s))), near)
    return lang, trust * near


def fitted(docs: DataFrame) -> dict:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).where(crc_mod(F.col("doc_id"), 4) != 2)
    ids = rows.groupBy("lang", "doc_id").agg(F.min(F.octet_length("text")).alias("n")).where(F.col("n") <= SAMPLE_BYTES // LANGS).withColumn("k", F.xxhash64("doc_id"))
    # of 64 parts by the hash, each holds some SAMPLE / 64 of a language's first SAMPLE documents: six times as many and 24 are kept, far beyond chance, and no more go to one task
    part = Window.partitionBy("lang", F.pmod("k", F.lit(64))).orderBy("k", "doc_id")
    near = ids.withColumn("at", F.row_number().over(part)).where(F.col("at") <= min(SAMPLE, 6 * SAMPLE // 64 + 24)).drop("at")
    first = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("k", "doc_id"))).where(F.col("at") <= SAMPLE)
    # every language's first document comes before any second one
    picked, held = [], 0
    for r in first.orderBy("at", "k", "doc_id", "lang").limit(LANGS * SAMPLE).select("doc_id", "lang", "n", "at").collect():
        if held + r["n"] <= SAMPLE_BYTES:
            held += r["n"]
            picked.append((r["doc_id"], r["lang"]))
    if not picked:
        return train([], [])
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, ids.select(F.col("doc_id").alias("_i"), F.col("lang").alias("_l")).schema))
    least = F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("least")
    got = rows.join(chosen, (F.col("doc_id") == F.col("_i")) & (F.col("lang") == F.col("_l"))).groupBy("lang", "doc_id").agg(least).orderBy("lang", "doc_id").select("lang", "least.text").collect()
    return train([r["text"] for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))  # 2**BITS weights a machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.array([*model.value["codes"], "und"], dtype=object)
        for b in batches:
            lang, s = np.full(b.num_rows, len(codes) - 1), np.zeros(b.num_rows)
            for i, j, data, offs in chunks(b["text"], 1 << 19):
                for a in range(i, j, 256):  # rows of a histogram are long beside short texts
                    e = min(j, a + 256)
                    lo, hi = offs[a - i], offs[e - i]
                    lang[a:e], s[a:e] = predict_chunk(model.value, data[lo:hi], offs[a - i : e - i + 1] - lo)
            und = (lang < 0) | ~np.array(b["letters"].to_pylist(), bool)
            lang[und], s[und] = len(codes) - 1, 0
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(codes[lang], pa.string()), pa.array(s)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    out = docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (F.coalesce(crc_mod(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
