"""Schemas of the tables at stage boundaries, and the rule for missing values: NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("l", "t", "w", "h")])
PITCH = T.StructType([T.StructField(f"{a}_bottom_{b}", T.DoubleType()) for b in ("left", "right", "middle") for a in ("x", "y")])
CANDIDATE = T.StructType([T.StructField("label", T.StringType()), T.StructField("mx", T.DoubleType()), T.StructField("conf_sum", T.DoubleType()), T.StructField("votes", T.LongType())])
CAMERA = T.StructType(
    [
        T.StructField("principal_point", T.ArrayType(T.DoubleType())),
        *[T.StructField(c, T.DoubleType()) for c in ("x_focal_length", "y_focal_length", "pan_degrees", "tilt_degrees", "roll_degrees")],
        *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("position_meters", "radial_distortion", "tangential_distortion", "thin_prism_distortion")],
    ]
)

DETECTIONS = {
    "seq": T.StringType(), "det_id": T.LongType(), "image_id": T.LongType(), "bbox_ltwh": BOX, "bbox_conf": T.DoubleType(),
    "category_id": T.IntegerType(), "track_id": T.LongType(), "crop_single": T.BooleanType(), "bbox_pitch": PITCH,
    "team_embedding": T.ArrayType(T.FloatType()), "team_cluster": T.IntegerType(), "jersey_number_detection": T.StringType(),
    "jersey_number_confidence": T.DoubleType(), "jersey_number_candidates": T.ArrayType(CANDIDATE), "role": T.StringType(), "team": T.StringType(),
}
FRAMES = {"seq": T.StringType(), "image_id": T.LongType(), "frame": T.IntegerType(), "file_path": T.StringType(), "parameters": CAMERA}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns, and in float and double fields of structs, becomes NULL."""

    def clean(col, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col), col)
        if isinstance(kind, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[clean(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return col

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
