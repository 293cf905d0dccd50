"""Reader of saved runs: a zip archive with a pickled table a sequence, and one of its images.

Members are ``<sequence>.pkl`` (detections) and ``<sequence>_image.pkl`` (frames), each a data
frame. Each member is a partition of the data source, so sequences are read side by side. Pickles
can run code, so only the classes of which data frames are made are admitted (``ADMITTED``),
and anything else is refused by name before it is touched. NaN becomes null.

Archives are opened by path on the executors, so they have to lie in a folder that all machines see.
"""

from __future__ import annotations

import glob
import io
import os
import pickle
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Classes and functions of which pickled data frames are made (fixed values).
ADMITTED = frozenset(
    "builtins.slice builtins.list builtins.dict builtins.tuple builtins.set builtins.complex builtins.bytearray _codecs.encode collections.OrderedDict "
    "numpy.ndarray numpy.dtype numpy.bool_ numpy.int64 numpy.int32 numpy.float64 numpy.float32 numpy.core.multiarray._reconstruct numpy._core.multiarray._reconstruct "
    "numpy.core.multiarray.scalar numpy._core.multiarray.scalar numpy.core.numeric._frombuffer numpy._core.numeric._frombuffer "
    "pandas.core.frame.DataFrame pandas.core.series.Series pandas.DataFrame pandas.Series pandas.core.internals.managers.BlockManager pandas.core.internals.managers.SingleBlockManager "
    "pandas._libs.internals._unpickle_block pandas._libs.internals.BlockPlacement pandas.core.indexes.base._new_Index pandas.core.indexes.base.Index pandas.Index pandas.core.indexes.range.RangeIndex pandas.RangeIndex "
    "pandas.core.indexes.numeric.Int64Index pandas.core.indexes.numeric.Float64Index pandas.core.arrays.numpy_.NumpyExtensionArray pandas.core.arrays.string_.StringArray pandas.core.arrays.string_.StringDtype "
    "pandas.StringDtype pandas.core.arrays.integer.IntegerArray pandas.core.arrays.integer.Int64Dtype pandas.core.arrays.boolean.BooleanArray pandas.core.arrays.boolean.BooleanDtype pandas._libs.missing.NAType pandas._libs.missing.NA "
    "pandas._libs.arrays.__pyx_unpickle_NDArrayBacked pandas.core.arrays.string_arrow.ArrowStringArray pandas.core.arrays.string_.ArrowStringArray pandas.core.arrays.string_arrow.ArrowStringArrayNumpySemantics".split()
)


class Guarded(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if f"{module}.{name}" not in ADMITTED:
            raise pickle.UnpicklingError(f"{module}.{name} is not part of a table")
        return super().find_class(module, name)


def value(v, kind: T.DataType):
    """A cell as a value of the declared type; NaN, None and missing are null."""
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(kind, T.ArrayType):
        return [value(x, kind.elementType) for x in v]
    if isinstance(kind, T.StructType):
        parts = v if isinstance(v, dict) else dict(zip(kind.names, v, strict=False))
        return tuple(value(parts.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(v)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(kind, T.BooleanType):
        return bool(v)
    return str(v) if isinstance(kind, T.StringType) else v


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.index, self.image = options["path"].removeprefix("file://"), options.get("index"), options.get("part") == "frames"
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        archives = sorted(glob.glob(os.path.join(self.path, "*.pklz"))) if os.path.isdir(self.path) else [self.path]
        out = []
        for a in archives:
            with zipfile.ZipFile(a) as z:
                out += [Member(a, n) for n in z.namelist() if n.endswith(".pkl") and n.endswith("_image.pkl") == self.image]
        if not out:
            raise FileNotFoundError(f"no table of a sequence in {self.path}")
        return out

    def read(self, partition: Member) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.archive) as z:
            table = Guarded(io.BytesIO(z.read(partition.name))).load()
        if type(table).__name__ != "DataFrame":
            raise ValueError(f"{partition.name} of {partition.archive} is no table")
        seq = partition.name.removesuffix(".pkl").removesuffix("_image")
        columns = []
        for f in self.schema:
            if f.name in table:
                cells = table[f.name].tolist()
            else:
                cells = table.index.tolist() if f.name == self.index else [seq if f.name == "seq" else None] * len(table)
            columns.append([value(v, f.dataType) for v in cells])
        yield from zip(*columns, strict=True)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_archive"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader(self.options, schema)


def read_archive(spark: SparkSession, path: str, schema: str, part: str = "detections", index: str | None = None) -> DataFrame:
    """The detections or frames of all sequences of an archive, or of a folder of archives (*.pklz).

    Columns of the schema that the tables lack are null, but for seq, which is the member's name, and ``index``, which is the rows' label.
    """
    if part not in ("detections", "frames"):
        raise ValueError("part is detections or frames")
    spark.dataSource.register(ArchiveSource)
    source = spark.read.format(ArchiveSource.name()).schema(schema).option("part", part)
    return (source.option("index", index) if index else source).load(path)
