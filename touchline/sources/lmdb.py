"""Reader of LMDB files as a Spark data source, from the published page layout of version 1 files.

A file is a B+ tree of pages. The newer of the two meta pages names the root.
The driver reads branch pages only, until it has as many subtrees as partitions are wanted, and each
task reads the pages of its subtrees, which are a range of keys. Values that do not
fit in a page lie on overflow pages. Files are opened by path on the executors, so
they have to lie in a folder that all machines see.

Named sub-databases and duplicate keys are refused; files of other byte order or version as well.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from touchline.functions.labels import prepared

# Layout of the file (fixed values).
MAGIC, VERSION = 0xBEEFC0DE, 1
HEADER = struct.Struct("<QHHHH")  # page number, padding, flags, lower, upper
META = struct.Struct("<IIQQ")  # magic, version, address, map size
TABLE = struct.Struct("<IHHQQQQQ")  # padding (page size), flags, depth, branch, leaf and overflow pages, entries, root
NODE = struct.Struct("<HHHH")  # low and high half of the size, or of the child's page; flags; key size
BRANCH, LEAF, OVERFLOW = 1, 2, 4
BIG, SUBTABLE, DUPLICATES = 1, 2, 4
NO_PAGE = (1 << 64) - 1


def data_file(path: str) -> str:
    """The file itself: an environment is a folder with data.mdb in it, or a file."""
    path = path.removeprefix("file://")
    return os.path.join(path, "data.mdb") if os.path.isdir(path) else path


class Pages:
    def __init__(self, data):
        self.data = data
        metas = []
        size = self._meta(0)[0]
        for at in (0, size):
            if at + HEADER.size + META.size < len(data):
                metas.append(self._meta(at))
        self.size, self.root, self.entries, _ = max(metas, key=lambda m: m[3])

    def _meta(self, at: int) -> tuple[int, int, int, int]:
        """Page size, root and entries of the main table, and the transaction."""
        magic, version, _, _ = META.unpack_from(self.data, at + HEADER.size)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("no LMDB file of version 1 in this machine's byte order")
        free = at + HEADER.size + META.size
        main = TABLE.unpack_from(self.data, free + TABLE.size)
        if main[1] & DUPLICATES:
            raise ValueError("duplicate keys are not read")
        _, transaction = struct.unpack_from("<QQ", self.data, free + 2 * TABLE.size)
        return TABLE.unpack_from(self.data, free)[0], main[7], main[6], transaction

    def nodes(self, page: int) -> Iterator[int]:
        """Where the nodes of a page are."""
        at = page * self.size
        lower = HEADER.unpack_from(self.data, at)[3]
        for k in range((lower - HEADER.size) // 2):
            yield at + struct.unpack_from("<H", self.data, at + HEADER.size + 2 * k)[0]

    def flags(self, page: int) -> int:
        return HEADER.unpack_from(self.data, page * self.size)[2]

    def children(self, page: int) -> list[int]:
        out = []
        for n in self.nodes(page):
            low, high, top, _ = NODE.unpack_from(self.data, n)
            out.append(low | high << 16 | top << 32)
        return out

    def rows(self, page: int) -> Iterator[tuple[bytes, bytes]]:
        """Keys and values below a page, in order."""
        todo = [page]
        while todo:
            page = todo.pop()
            flags = self.flags(page)
            if flags & BRANCH:
                todo += reversed(self.children(page))
                continue
            if not flags & LEAF:
                raise ValueError(f"page {page} is neither branch nor leaf")
            for n in self.nodes(page):
                low, high, kind, width = NODE.unpack_from(self.data, n)
                if kind & (SUBTABLE | DUPLICATES):
                    raise ValueError("named tables and duplicate keys are not read")
                size, start = low | high << 16, n + NODE.size + width
                key = bytes(self.data[n + NODE.size : start])
                if kind & BIG:
                    start = struct.unpack_from("<Q", self.data, start)[0] * self.size + HEADER.size
                yield key, bytes(self.data[start : start + size])

    def subtrees(self, want: int) -> list[int]:
        """At least ``want`` pages that are roots of all rows between them, in order, or all leaves."""
        if self.root == NO_PAGE:
            return []
        level = [self.root]
        while len(level) < want and self.flags(level[0]) & BRANCH:
            level = [c for p in level for c in self.children(p)]
        return level


@contextmanager
def opened(path: str) -> Iterator[Pages]:
    with open(data_file(path), "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        yield Pages(data)


class Subtrees(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


class LmdbReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 16))

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as p:
            roots = p.subtrees(self.parts)
        n = min(self.parts, len(roots)) or 1
        return [Subtrees(roots[len(roots) * k // n : len(roots) * (k + 1) // n]) for k in range(n)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as p:
            held, size = [], 0
            for row in (r for page in partition.pages for r in p.rows(page)):
                held.append(row)
                size += len(row[1])
                if len(held) >= 10_000 or size > 8 << 20:
                    yield self.batch(held)
                    held, size = [], 0
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["key", "value"])


class LmdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lmdb_pages"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return LmdbReader(self.options)


def read(spark: SparkSession, path: str, partitions: int = 16) -> DataFrame:
    """key and value of every entry of an LMDB environment, read by up to so many tasks."""
    spark.dataSource.register(LmdbSource)
    return spark.read.format(LmdbSource.name()).option("partitions", partitions).load(path)


def labelled(spark: SparkSession, path: str, charset: str, most: int = 25, partitions: int = 16) -> DataFrame:
    """index, content and prepared label of the images of a text-recognition set: keys image-000000001 and label-000000001 on, up to num-samples. A label that is not usable drops its image."""
    rows = read(spark, path, partitions).withColumn("k", F.col("key").cast("string"))
    n = rows.where("k = 'num-samples'").select(F.col("value").cast("string").cast("long").alias("n"))
    index = F.regexp_extract("k", "^(?:image|label)-([0-9]{9,})$", 1).try_cast("long")
    rows = rows.withColumn("index", index).where("index >= 1").join(F.broadcast(n), F.col("index") <= F.col("n"))  # one row
    label = prepared(charset, most)(F.col("value").cast("string"))
    labels = rows.where(F.col("k").startswith("label-")).select("index", label.alias("label")).where("label IS NOT NULL")
    return rows.where(F.col("k").startswith("image-")).select("index", F.col("value").alias("content")).join(labels, "index")
