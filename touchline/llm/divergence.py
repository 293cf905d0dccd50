"""How far apart the sources of a language are, by joint count histograms.

Terms are runs of ASCII letters (A-Z lower-cased) and of all characters from
U+0080 on. Each language keeps the terms that at least ``MIN_DOCS`` of its documents hold. A
group is a (lang, source) that occurs. With a term's count c in a group, the
group's sum N over kept terms and the language's number V of kept terms,
p = 1 + floor(10^9 * (c + 2) / (N + 2 * V)), and two groups differ by the sum of
floor((p - q)^2 / (p + q)) over all V terms.

p depends on the count alone, so a pair of groups needs no term at all, only how
many terms have which two counts. Tasks tally these combinations over the terms that
both groups hold. The cells with a zero follow: the terms that one group holds c times are known from
its own histogram, and what the tally has of them with the other group's counts is
taken off. So every combination with its multiplicity is one row of ``histogram``,
and the difference is computed once per combination.

All arithmetic is in integers and decimals. Counts of terms are merged in tasks and shuffled once; group sums move as partial sums; a term's
list of sources is as long as the result's list of groups a language, and the
best terms of a group are ranked with a limit before the shuffle.

Cases: null text, lang and source are ''. A group without terms has count zero
everywhere; a language without kept terms has pairs of value 0 and no term rows. A
language with one source has no pairs. Repeated rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.runtime import checkpointed, tidy
from touchline.llm.textcore import LOWER, chunks

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bytes of text counted at once, and combinations of sources tallied at once.
CHUNK = 4 << 20
CELLS = 1 << 20
#: Rows of counts that a task merges before it passes them on.
ROWS = 1 << 20
#: Groups whose totals are broadcast; more are joined by a shuffle.
GROUPS = 20_000

LETTER = np.ones(256, bool)
LETTER[:0x41] = LETTER[0x5B:0x61] = LETTER[0x7B:0x80] = False


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and term of every match."""
    solid = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    at = np.flatnonzero(begin)
    place = np.cumsum(solid, dtype=np.int64)
    starts = place[at] - 1
    ends = np.append(starts, place[-1] if len(place) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(LOWER[data][solid]))
    return np.searchsorted(offs, at, "right") - 1, words.dictionary_encode()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of documents: count and number of documents of every (lang, source, term)."""
    names: dict[tuple[str, str], int] = {}
    held: list[pa.RecordBatch] = []

    def merged() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        held.clear()
        lang, source = (pa.array(x, pa.string()) for x in zip(*names, strict=True))
        for b in t.to_batches(max_chunksize=ROWS >> 4):
            yield pa.RecordBatch.from_arrays([lang.take(b["g"]), source.take(b["g"]), b["term"], b["n_sum"], b["docs_sum"]], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        of = np.array([names.setdefault(g, len(names)) for g in zip(b["lang"].to_pylist(), b["source"].to_pylist(), strict=True)], np.int64)
        for i, j, data, offs in chunks(b["text"], CHUNK):
            row, coded = terms(data, offs)
            if not len(row):
                continue
            words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            key, n = np.unique(row * len(words) + code, return_counts=True)
            cell, back = np.unique(of[i:j][key // len(words)] * len(words) + key % len(words), return_inverse=True)
            total, docs = np.bincount(back, n).astype(np.int64), np.bincount(back)
            held.append(pa.RecordBatch.from_arrays([pa.array(cell // len(words)), words.take(pa.array(cell % len(words))), pa.array(total), pa.array(docs)], ["g", "term", "n", "docs"]))
            if sum(h.num_rows for h in held) >= ROWS:
                yield from merged()
    if held:
        yield from merged()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (lang, term): the combinations of counts of each pair of sources, and what they take off the cells with zeros."""
    carried = None

    def cells(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, source = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        names, langs = sorted(source.dictionary.to_pylist(), key=str.encode), lang.dictionary
        place = {x: k for k, x in enumerate(names)}
        names = pa.array(names, pa.string())
        s = np.array([place[x] for x in source.dictionary.to_pylist()])[source.indices.to_numpy()]
        l, n = lang.indices.to_numpy(), t["n"].to_numpy()  # noqa: E741
        word = t["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (l[1:] != l[:-1])])
        end = np.append(np.flatnonzero(new)[1:], len(s))[np.cumsum(new) - 1]
        later = end - np.arange(len(s)) - 1  # rows of the same term after this one
        done, cum = 0, np.cumsum(later)
        while done < len(s):
            stop = max(done + 1, int(np.searchsorted(cum, (cum[done - 1] if done else 0) + CELLS, "right")))
            a = np.repeat(np.arange(done, stop), later[done:stop])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[done:stop]) - later[done:stop], later[done:stop])
            done = stop
            if not len(a):
                continue
            swap = s[a] > s[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            pair = (l[a].astype(np.int64) * len(names) + s[a]) * len(names) + s[b]
            z = np.zeros(len(a), np.int64)
            rows = np.stack([np.concatenate(x) for x in ([pair] * 4, [n[a], n[a], z, z], [n[b], z, n[b], z], [z + 1, z - 1, z - 1, z + 1])])
            sort = np.lexsort(rows[2::-1])
            rows = rows[:, sort]
            first = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(0)]))
            m = np.add.reduceat(rows[3], first)
            p, x, y = rows[:3, first]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(p // len(names) ** 2)), names.take(pa.array(p // len(names) % len(names))), names.take(pa.array(p % len(names))), pa.array(x), pa.array(y), pa.array(m)], ["lang", "s", "t", "x", "y", "m"])

    for b in batches:
        t = pa.Table.from_batches([b]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        term, lang = t["term"][-1].as_py(), t["lang"][-1].as_py()
        # the last term may go on in the next batch
        last = t.num_rows
        while last and t["term"][last - 1].as_py() == term and t["lang"][last - 1].as_py() == lang:
            last -= 1
        if last:
            yield from cells(t.slice(0, last))
        carried = t.slice(last)
    if carried is not None and carried.num_rows:
        yield from cells(carried)


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * size)), in decimals; 1 where there are no terms at all."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    down = (total + 2 * size).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", up, F.when(down > 0, down))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, term, source, n and lang_n, the count in the language, of kept terms. Counts are dealt by term once: they are added, documents counted and rare terms dropped where they lie."""
    counted = docs.mapInArrow(tidy(_counts), "lang string, source string, term string, n long, docs long")
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    totals = counts.select("lang", "term", "source", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"))
    return totals.where(F.col("lang_docs") >= MIN_DOCS).drop("lang_docs")


class Audit:
    """The tables from which both parts of the audit come."""

    def __init__(self, docs: DataFrame):
        def text(c):
            return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

        own = docs.select(text("lang"), text("source"), text("text"))
        self.counts = checkpointed(kept_counts(own))
        sums = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sizes = self.counts.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("lang_total"))
        groups = own.select("lang", "source").distinct()
        zero = F.lit(0).cast("long")
        self.groups = checkpointed(
            groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
            .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "size", "lang_total")])
        )

    def pairs(self) -> DataFrame:
        """lang, s, t, the totals of both and the number of terms, for s before t."""
        one = self.groups.select("lang", F.col("source").alias("s"), F.col("total").alias("s_total"), "size")
        # the list of a language's sources is as long as each group's list of results
        other = self.groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("t"), F.col("total").alias("t_total"))).alias("others"))
        return one.join(other, "lang").withColumn("o", F.explode("others")).select("lang", "s", "o.t", "s_total", "o.t_total", "size").where("s < t")

    def histogram(self, pairs: DataFrame) -> DataFrame:
        """lang, s, t, counts x and y, and m, the number of kept terms with these counts, zeros included."""
        both = self.counts.select("lang", "source", "term", "n").repartition("lang", "term").sortWithinPartitions("lang", "term")
        both = both.mapInArrow(tidy(_tally), "lang string, s string, t string, x long, y long, m long")
        single = self.counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
        zero = F.lit(0).cast("long")
        parts = [both]
        for own, x, y in (("s", F.col("n"), zero), ("t", zero, F.col("n"))):
            held = pairs.select("lang", "s", "t").join(single.withColumnRenamed("source", own), ["lang", own])
            cells = F.explode(F.array(F.struct(x.alias("x"), y.alias("y"), F.col("m").alias("m")), F.struct(zero.alias("x"), zero.alias("y"), (-F.col("m")).alias("m"))))
            parts.append(held.select("lang", "s", "t", cells.alias("c")).select("lang", "s", "t", "c.*"))
        parts.append(pairs.select("lang", "s", "t", zero.alias("x"), zero.alias("y"), F.col("size").alias("m")))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.groupBy("lang", "s", "t", "x", "y").agg(F.sum("m").alias("m")).where("m <> 0")

    def pair_rows(self) -> DataFrame:
        pairs = checkpointed(self.pairs())
        cells = self.histogram(pairs).join(pairs, ["lang", "s", "t"])
        f = gap(share(F.col("x"), F.col("s_total"), F.col("size")), share(F.col("y"), F.col("t_total"), F.col("size")))
        value = cells.groupBy("lang", "s", "t").agg(F.sum(f * F.col("m")).alias("value"))
        value = pairs.select("lang", "s", "t").join(value, ["lang", "s", "t"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
        ends = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
        rows = value.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
        return rows.withColumn("rank", F.row_number().over(order()))

    def term_rows(self) -> DataFrame:
        few = self.groups.limit(GROUPS + 1).count() <= GROUPS
        cells = self.counts.join(F.broadcast(self.groups) if few else self.groups, ["lang", "source"])
        p = share(F.col("n"), F.col("total"), F.col("size"))
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
        rows = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        rows = rows.select("lang", "source", "part", "item", gap(F.col("p"), F.col("q")).alias("value"))
        return rows.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= TOP)


def order():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: each group's other sources by difference, and its ten most marked terms."""
    a = Audit(docs)
    return a.pair_rows().unionByName(a.term_rows())
