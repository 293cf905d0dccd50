"""Formatted cells against Python's own formatting."""

from pyspark.sql import functions as F

from touchline.functions import text


def test_cells_round_the_double_itself(spark):
    values = [k / 20_000 for k in range(-401, 30_001, 2)] + [0.5 + k / 32 for k in range(8)] + [-0.00001, 12345678.00015, 1e12 + 0.5]
    got = [r["cell"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", text.metric_cell(F.col("v")).alias("cell")).orderBy("k").collect()]
    assert got == [f"{v:.0f}" if v == int(v) else f"{v:.4f}" for v in values]
