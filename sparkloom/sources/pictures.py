"""Pictures from files as image values: grey from 0 to 1, pixels column by column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.images import image

#: What red, green and blue weigh in a grey.
GREY = (0.299, 0.587, 0.114)


@F.pandas_udf(ArrayType(DoubleType()))
def _grey(data: pd.Series, h: pd.Series, w: pd.Series, channels: pd.Series) -> pd.Series:
    def one(raw: bytes, height: int, width: int, n: int) -> np.ndarray:
        rows = np.frombuffer(raw, np.uint8).reshape(height, width, n).astype(float)
        grey = rows[:, :, 0] if n == 1 else rows[:, :, 2::-1] @ np.array(GREY)  # stored as blue, green, red
        return (grey / 255).T.reshape(-1)

    return pd.Series([one(*x) for x in zip(data, h, w, channels, strict=True)], dtype=object)


def read_pictures(spark: SparkSession, path: str, most_pixels: int | None = None) -> DataFrame:
    """(origin, img) of all PNG, JPEG, GIF and BMP files under a path, read and decoded by Spark; other files are left out.

    Pictures of more than ``most_pixels`` are left out where that is given: a filter on their sizes, before pixels are
    read into Python.
    """
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    if most_pixels is not None:
        found = found.where(F.col("height").cast("long") * F.col("width") <= most_pixels)
    grey = found.withColumn("__p", _grey("data", "height", "width", "nChannels"))
    return grey.select("origin", image(F.col("height"), F.col("width"), "intensity", F.col("__p")).alias("img"))
