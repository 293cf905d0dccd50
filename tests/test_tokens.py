"""Token ids of labels."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import text


def test_encode(spark):
    df = spark.createDataFrame([("ba", 5), ("", 3), ("c", 3), (None, 3)], "label string, width int")
    rows = df.select(text.encode(F.col("label"), "abc", F.col("width")).alias("m"), text.encode(F.col("label"), "abc", F.col("width"), False).alias("c")).collect()
    assert [r["m"] for r in rows] == [[4, 2, 1, 0, 5], [4, 0, 5], [4, 3, 0], None]
    assert [r["c"] for r in rows] == [[2, 1, 0, 0, 0], [0, 0, 0], [3, 0, 0], None]
    back = df.where("label = 'ba'").select(text.until_end(F.slice(text.encode(F.col("label"), "abc", F.col("width")), 2, 9), 0).alias("b")).first()["b"]
    assert back == [2, 1]
    with pytest.raises(Exception, match="not in the charset"):
        df.select(text.tokens(F.col("label"), "ab")).collect()
