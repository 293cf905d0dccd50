"""Quality rules: repetition and size of a text, and cross-document line frequency.

Lines are normalised (ASCII lower case, white space collapsed) and hashed. A
line counts once a document; per host (the source column) a line found in more
documents than the limit is boilerplate. A document that loses more than half
of its words with such lines is depleted and rejected.

The limit is the larger of ``LINE_DOCS`` documents and ``LINE_SHARE`` of the host's
documents, so small groups of copies pass and site furniture does not. A host of
``LINE_DOCS`` documents or fewer has no line above it.

``rules`` gives the figures and the verdict, ``cleaned`` the documents that are
kept, without their lines above the limit.

``rules`` shuffles only 16-byte line keys and counts, never text. The counts per
(host, line) combine before the shuffle, so a line of every document is one row
a task.

Cases: null and empty texts have no words and fail the base rules. A null host is
a host of its own. Rows with one doc_id are separate documents and get a row
each. Documents without lines keep their base verdict. Extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.runtime import checkpointed, text_key, tidy
from touchline.llm.textcore import LOWER, Poly, U, chunks, mix, ranges, runs, word_spans

LINE_DOCS = 10
LINE_SHARE = 0.005
DEPLETED = 0.5
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
# Characters counted as symbols: # * $ % & | < > (fixed values).
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_BYTES, _WORDS = Poly(11), Poly(12)


def repeated_words(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words per row that lie in a WINDOW-word sequence found twice or more in the row."""
    out = np.zeros(n, np.int64)
    m = len(h) - WINDOW + 1
    if m <= 0:
        return out
    p = _WORDS.prefix(h)
    at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    key = _WORDS.slices(p, at, at + WINDOW) ^ mix(doc[at].astype(U) + U(1))
    order = np.argsort(key, kind="stable")
    first, size = runs(key[order])
    many = size > 1
    hit = at[order[ranges(first[many], size[many])]]
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + WINDOW, -1)
    return np.bincount(doc[np.cumsum(mark[:-1]) > 0], minlength=n)


def lines_of(data: np.ndarray, offs: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with a word: first word, number of words, row, place among all lines of the row, key of the normalised line."""
    # a new one begins where a line feed or the row's start lies between two words
    feeds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=feeds[1:])
    first, size = runs(feeds[lo] + doc)
    ldoc = doc[first]
    q = _WORDS.prefix(_BYTES.slices(_BYTES.of_bytes(LOWER[data]), lo, hi))
    return first, size, ldoc, feeds[lo[first]] - feeds[offs[ldoc]], _WORDS.slices(q, first, first + size)


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Base figures of every row, and its distinct normalised lines (row, key, words in all its copies)."""
    n = len(offs) - 1
    lo, hi, doc = word_spans(data, offs)
    out = {"n_words": np.bincount(doc, minlength=n)}
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=solid[1:])
    out["word_chars"] = np.bincount(doc, solid[hi] - solid[lo], n).astype(np.int64)
    sym = np.flatnonzero(SYMBOL[data])
    out["n_symbols"] = np.bincount(np.searchsorted(offs, sym, "right") - 1, minlength=n)
    p = _BYTES.of_bytes(data)
    out["n_repeat_words"] = repeated_words(_BYTES.slices(p, lo, hi), doc, n)
    first, size, ldoc, _, norm = lines_of(data, offs, lo, hi, doc)
    nl = np.flatnonzero(data == 10)
    nxt = np.searchsorted(nl, lo[first])
    a = np.maximum(np.append(-1, nl)[nxt] + 1, offs[ldoc])  # the whole line, for exact equality
    b = np.minimum(np.append(nl, len(data))[nxt], offs[ldoc + 1])
    raw = _BYTES.slices(p, a, b) ^ mix(ldoc.astype(U) + U(1))
    order = np.argsort(raw, kind="stable")
    f, s = runs(raw[order])
    out["n_dup_lines"] = np.bincount(ldoc[order[ranges(f + 1, s - 1)]], minlength=n)
    order = np.lexsort((norm, ldoc))
    key = np.stack([ldoc[order].astype(U), norm[order]], 1)
    f, s = runs(key.view("V16").ravel()) if len(key) else (np.zeros(0, np.int64),) * 2
    out["line_row"], out["line_key"] = ldoc[order][f], norm[order][f].view(np.int64)
    out["line_words"] = np.add.reduceat(size[order], f) if len(f) else f
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in chunks(b["text"]):
            m = measure(data, offs)
            cuts = np.searchsorted(m["line_row"], np.arange(j - i + 1)).astype(np.int32)
            lines = pa.StructArray.from_arrays([pa.array(m["line_key"], pa.int64()), pa.array(m["line_words"], pa.int64())], ["line", "words"])
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b[c].slice(i, j - i) for c in keep), *(pa.array(m[c], pa.int64()) for c in BASE), pa.ListArray.from_arrays(pa.array(cuts), lines)], [*keep, *BASE, "lines"])


def _measured(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """Base figures and lines of each row of docs, its row number and host, and with ``keyed`` its source and text key h."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [text_key().alias("h")] if keyed else []
    got = docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string"), *more).mapInArrow(tidy(_run), f"doc_id {kind}, source string, {'h binary, ' if keyed else ''}{', '.join(f'{c} long' for c in BASE)}, lines array<struct<line: long, words: long>>")
    return checkpointed(got.withColumn("row", F.monotonically_increasing_id()).withColumn("host", F.when(F.col("source").isNull(), 0).otherwise(F.xxhash64("source"))))


def _boilerplate(got: DataFrame) -> DataFrame:
    """row, line and words of the lines above the limit of their host."""
    lines = got.select("row", "host", F.inline("lines"))
    hosts = got.groupBy("host").agg(F.greatest(F.lit(float(LINE_DOCS)), LINE_SHARE * F.count("*")).alias("most"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > LINE_DOCS).join(hosts, "host").where(F.col("docs") > F.col("most"))
    return lines.join(often.select("host", "line"), ["host", "line"])


def _verdicts(got: DataFrame, lost: DataFrame) -> DataFrame:
    """got with the columns of lost(row, lost, ...), base_failed, n_boiler_words and kept."""
    out = got.drop("lines", "host").join(lost, "row", "left").withColumn("n_boiler_words", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_boiler_words") <= DEPLETED * F.col("n_words")))


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, n_boiler_words (in lines above the limit) and kept, a row per row of docs."""
    got = _measured(docs)
    lost = _boilerplate(got).groupBy("row").agg(F.sum("words").alias("lost"))
    return _verdicts(got, lost).select("doc_id", *BASE, "base_failed", "n_boiler_words", "kept")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the lines with a key in gone out of the texts."""
    for b in batches:
        text, gone = b["text"].to_pylist(), b["gone"].to_pylist()
        for i, j, data, offs in chunks(b["text"]):
            lo, hi, doc = word_spans(data, offs)
            _, _, ldoc, place, norm = lines_of(data, offs, lo, hi, doc)
            cuts = np.searchsorted(ldoc, np.arange(j - i + 1))
            for k in range(i, j):
                if gone[k]:
                    x, y = cuts[k - i], cuts[k - i + 1]
                    out = set(place[x:y][np.isin(norm[x:y].view(np.int64), gone[k])].tolist())
                    text[k] = "\n".join(t for n, t in enumerate(text[k].split("\n")) if n not in out)
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(text, pa.string())], ["row", "left"])


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents without their lines above the limit; all columns stay, and n_chars follows the text."""
    got = _measured(docs, keyed=True)
    lost = _boilerplate(got).groupBy("row").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("gone"))
    # rows equal in doc_id, source and text lose the same lines
    kept = _verdicts(got, lost).where("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("source").alias("kept_source"), F.col("h").alias("kept_text")).agg(F.first("gone").alias("gone"))
    # columns of docs go by as one struct, so none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").alias("own_id"), F.col("source").cast("string").alias("own_source"), text_key().alias("own_text"))
    on = F.col("own_id").eqNullSafe(F.col("kept_id")) & F.col("own_source").eqNullSafe(F.col("kept_source")) & F.col("own_text").eqNullSafe(F.col("kept_text"))
    rows = rows.join(kept, on).select("row", "text", "gone")
    out = rows.mapInArrow(tidy(_cut), f"row {rows.schema['row'].dataType.simpleString()}, left string")
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
