"""Mixing sources to target weights.

Every document gets a hash-random key. The key range of a source is cut into
buckets of about ``BUCKET`` documents (as the keys are uniform, equal widths
hold equal shares), bucket totals are summed along the key order, and a window
inside each bucket completes the prefix sum, so a source that holds most rows
is spread over as many tasks as it has buckets. A source's budget of B words
takes every document floor(B / size) times and, once more, the documents whose
prefix lies below the remainder; the last of them is cut at the exact word.

Cases: a null text has size 0 and is taken 0 times. A null source is a source of
its own, sorted last. Rows with the same doc_id are separate documents. A source
without words has target 0. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.runtime import checkpointed, text_key, tidy
from touchline.llm.textcore import chunks, word_spans

BUCKET = 4000
#: A target stops at so many times its source's size.
MOST = 3
KEY_BITS = 60
#: Rows (of some 60 bytes) up to which the table of sources is broadcast.
BROADCAST_SOURCES = 20_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.zeros(b.num_rows, np.int64)
        for i, j, data, offs in chunks(b["text"]):
            n[i:j] = np.bincount(word_spans(data, offs)[2], minlength=j - i)
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(n)], [*keep, "size"])


def sizes(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, source, number of words, the name that a document's random key comes from (its doc_id, else its text's MD5), and with ``keyed`` the text's key h."""
    more = [text_key().alias("h")] if keyed else []
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string")), F.lit("")).alias("name")
    return docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string"), name, *more).mapInArrow(tidy(_sizes), f"doc_id long, source string, name string, {'h binary, ' if keyed else ''}size long")


def targets(per_source: DataFrame) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    The fill level t of target = min(cap, weight * t) is found by sorting the
    sources by cap / weight and taking the first prefix after which t stays
    below the next cap; all of that is a few windows over a row per source.
    """
    w = per_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    w = w.withColumn("cap", MOST * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    w = w.withColumn("full", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    w = w.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("total", F.sum("source_size").over(all_).cast("double"))
    w = w.withColumn("t", (F.col("total") - F.col("full")) / F.col("rest"))
    w = w.withColumn("level", F.min(F.when(F.col("t") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "t"))).over(all_)["t"])
    return w.select(*per_source.columns, "sid", "weight", F.least("cap", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, seed: int = 1, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), and with ``keyed`` h."""
    # a key that any engine can compute: the first 15 hex digits of an MD5
    key = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), "name")), F.lit(15)), 16, 10).cast("long")
    sized = checkpointed(sizes(docs, keyed).withColumn("k", key).drop("name"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = targets(per).withColumn("width", F.ceil((1 << KEY_BITS) / F.ceil(F.col("docs") / BUCKET)).cast("long"))
    goal = checkpointed(goal.withColumnRenamed("source", "s"))
    # One row per source: sent to all tasks where that is a small table, else joined by a shuffle.
    few = goal.count() <= BROADCAST_SOURCES
    rows = sized.join(F.broadcast(goal) if few else goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("b", F.floor(F.col("k") / F.col("width")))
    sums = rows.groupBy("sid", "b").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")
    sums = sums.select("sid", "b", before.alias("before"))
    more = ["h"] if keyed else []
    inside = F.sum("size").over(Window.partitionBy("sid", "b").orderBy("k", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(sums, ["sid", "b"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rows = rows.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inside"))
    part = F.least(F.greatest("left", F.lit(0)), "size")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *more)


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix as documents: each as often as it is taken, and one per source cut after its last taken word. Repeats keep their doc_id; n_chars follows a cut."""
    share = ["doc_id", "source", "h"]
    took = checkpointed(mix(docs, seed, keyed=True).select(*share, "size", "taken"))
    # columns of docs go by as one struct, so none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("own_id"), F.col("source").cast("string").alias("own_source"), text_key().alias("own_text"))
    on = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & F.col("own_text").eqNullSafe(F.col("h"))
    if took.where("size > 0").groupBy(*share).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # equal texts with one doc_id and source are paired with their shares by number, shares of nothing included
        took = took.withColumn("i", F.row_number().over(Window.partitionBy(*share).orderBy("taken")))
        rows = rows.withColumn("j", F.row_number().over(Window.partitionBy("own_id", "own_source", "own_text").orderBy("own_id")))
        on &= F.col("i") == F.col("j")
    rows = rows.join(took.where("taken > 0"), on)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    rows = rows.select("doc", F.col("doc.text").cast("string").alias("text"), F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.expr("array()").cast("array<int>")))).alias("first"))
    cut = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, first), '')")
    new = {"text": F.when(F.col("first") > 0, cut).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("first") > 0, F.length(cut)).otherwise(F.col("doc.n_chars"))
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns])
