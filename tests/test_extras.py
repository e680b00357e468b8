import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.columns import json_safe
from quarry.model import ColumnProfile, Pattern, Recipe, RecipeMetadata
from quarry.operators.reconstruct import reconstruct
from quarry.sources import fingerprint as f
from quarry.sources.tables import ROW_ID


def decode_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    width, height = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind = data[at + 4 : at + 8]
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)
    return rows[:, 1:].reshape(height, width, 3)


def test_pictures(tmp_path):
    data = bytes(range(256)) * 5
    path = f.write_png(f.rgb(data), str(tmp_path / "a.png"))
    assert decode_png(open(path, "rb").read()).reshape(-1).tobytes()[: len(data)] == data
    assert f.digits(b"\x1b").tolist() == [0, 1, 2, 3]
    assert f.bases(b"\x1b", 1).reshape(-1, 3).tolist()[:4] == f.COLOURS.tolist()
    both = f.side_by_side(data * 4, data)
    assert (both[40:540, 40:540] != f.BACKGROUND).any() and both.shape == (580, 870, 3)
    assert f.rgb(b"").shape == (1, 1, 3)


def test_base_counts(spark):
    df = spark.createDataFrame([(bytearray(b"\x1b\x00"),), (None,)], "content binary")
    assert [r["n"] for r in f.base_counts(df, F.col("content")).orderBy("base").collect()] == [5, 1, 1, 1]


def test_json_safe(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(json_safe(F.col("x"))).collect()] == [1.5, None, None, None]


def test_null_mask(spark):
    profile = ColumnProfile("x", "float64", "numeric", 100, 50, 30)
    recipe = Recipe(RecipeMetadata("t", 0, 0, 0), [profile], [], "", [Pattern("x", "distribution", distribution="uniform", distribution_params={"loc": 1, "scale": 2})])
    anchors = spark.range(3000).select(F.col("id").alias(ROW_ID))
    assert reconstruct(recipe, anchors).where("x is null").count() == 0
    assert abs(reconstruct(recipe, anchors, nulls=True).where("x is null").count() / 3000 - 0.3) < 0.04


def test_jobs_side_by_side(spark):
    from quarry.operators.jobs import together

    assert together() == [] and together(lambda: 1) == [1]
    assert together(*(lambda i=i: together(lambda: i, lambda: i + 1) for i in range(20))) == [[i, i + 1] for i in range(20)]
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1, lambda: 1 / 0)
