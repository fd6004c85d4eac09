import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import vector as V
from nearfold.functions.codebook import erfinv, half_mean, normal_levels


@pytest.mark.parametrize("x", [-0.999, -0.5, 0.0, 1e-9, 0.3, 0.99999])
def test_erfinv(x):
    assert math.erf(erfinv(x)) == pytest.approx(x, abs=1e-12)


def test_levels_are_symmetric_quantiles():
    levels = normal_levels(2.0, 8)
    assert levels == sorted(levels) and levels == pytest.approx([-x for x in levels[::-1]])
    share = [0.5 * (1 + math.erf(x / 2 / math.sqrt(2))) for x in levels]
    assert share == pytest.approx([(i + 0.5) / 8 for i in range(8)])
    assert half_mean(1.0) == pytest.approx(0.7978845608)


def test_edges(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r for r in df.select("id", V.l2_normalize(F.col("v")).alias("n"), V.is_finite(F.col("v")).alias("ok"), V.pack_nibbles(F.array()).alias("p")).collect()}
    assert got[0]["n"] == [0.6, 0.8] and got[1]["n"] == [None, None] and got[5]["n"] == []
    assert [got[i]["ok"] for i in range(6)] == [True, True, False, False, False, True]
    assert got[0]["p"] == []


def test_middles_go_to_the_upper_level(spark):
    levels = [-3.0, -1.0, 1.0, 3.0]
    df = spark.createDataFrame([([-9.0, -2.0, -1.9, 0.0, 2.0, 2.1, 9.0],)], "v array<double>")
    assert df.select(V.quantize(F.col("v"), levels)).first()[0] == [0, 1, 1, 2, 3, 3, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 8])
def test_nibbles_round_trip(spark, n):
    codes = [(7 * i + 3) % 16 for i in range(n)]
    df = spark.createDataFrame([(codes,)], "c array<int>").withColumn("p", V.pack_nibbles(F.col("c")))
    assert df.select(V.unpack_nibbles(F.col("p"), n)).first()[0] == codes
    assert all(0 <= b < 256 for b in df.first()["p"])


def test_int8_distance_is_exact(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-128, 128, (2, 100))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<int>, b array<int>").select(F.col("a").cast("array<tinyint>").alias("a"), F.col("b").cast("array<tinyint>").alias("b"))
    assert df.select(V.l2sq_int(F.col("a"), F.col("b"))).first()[0] == int(((a - b) ** 2).sum())
