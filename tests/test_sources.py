import numpy as np
import pytest

from nearfold.sources import vecs


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    vecs.register(spark)


def fvecs(rows):
    return b"".join(np.array([len(r)], "<i4").tobytes() + np.array(r, "<f4").tobytes() for r in rows)


def test_fvecs_in_ranges(spark, tmp_path):
    rows = np.arange(20, dtype=np.float32).reshape(5, 4)
    (tmp_path / "x.fvecs").write_bytes(fvecs(rows))
    got = spark.read.format("fvecs").option("rowsPerTask", 2).load(str(tmp_path / "x.fvecs"))
    assert got.rdd.getNumPartitions() == 3
    assert {r["vec_id"]: r["embedding"] for r in got.collect()} == {i: r.tolist() for i, r in enumerate(rows)}


@pytest.mark.parametrize("data", [fvecs([[1, 2], [3, 4]])[:-1], fvecs([[1, 2, 3], [4, 5, 6]])[:-4], b"\1\0"])
def test_truncated_files_are_errors(spark, tmp_path, data):
    (tmp_path / "x.fvecs").write_bytes(data)
    with pytest.raises(Exception, match="records|header"):
        spark.read.format("fvecs").load(str(tmp_path / "x.fvecs")).collect()


def test_mixed_dimensions_are_errors(spark, tmp_path):
    (tmp_path / "x.fvecs").write_bytes(fvecs([[1, 2, 3], [4, 5, 6]]).replace(b"\3\0\0\0", b"\2\0\0\0", 2)[:16] + fvecs([[4, 5, 6]]))
    with pytest.raises(Exception):
        spark.read.format("fvecs").load(str(tmp_path / "x.fvecs")).collect()


def test_headed_formats(spark, tmp_path):
    x = np.array([[-128, 127], [0, 5]], np.int8)
    (tmp_path / "x.i8bin").write_bytes(np.array([2, 2], "<i4").tobytes() + x.tobytes())
    assert [r["embedding"] for r in spark.read.format("i8bin").load(str(tmp_path / "x.i8bin")).orderBy("vec_id").collect()] == x.tolist()
    (tmp_path / "m.i32bin").write_bytes(np.array([3, 1], "<i4").tobytes() + np.array([4, 9, 9], "<i4").tobytes())
    m = vecs.read_id_map(spark, str(tmp_path / "m.i32bin"))
    assert [(r[0], r[1]) for r in m.orderBy("local_id").collect()] == [(0, 4), (1, 9), (2, 9)]
    assert vecs.not_increasing(m).count() == 1
    (tmp_path / "bad.i8bin").write_bytes(np.array([2, 2], "<i4").tobytes() + b"abc")
    with pytest.raises(Exception, match="do not hold"):
        spark.read.format("i8bin").load(str(tmp_path / "bad.i8bin")).collect()


def test_truth_from_ivecs(spark, tmp_path):
    (tmp_path / "t.ivecs").write_bytes(b"".join(np.array([2, *r], "<i4").tobytes() for r in ([7, 8], [9, 1])))
    got = vecs.read_truth(spark, str(tmp_path / "t.ivecs")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7), (0, 2, 8), (1, 1, 9), (1, 2, 1)]


@pytest.mark.parametrize("kind,dtype", [("fvecs", "float"), ("bvecs", "tinyint"), ("i8bin", "tinyint"), ("ivecs", "int"), ("i32bin", "int")])
def test_round_trip(spark, tmp_path, kind, dtype):
    rows = [(i, [i - 3, 2 * i, -i]) for i in range(10)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{dtype}>" if dtype != "float" else "vec_id long, embedding array<int>").selectExpr("vec_id", f"cast(embedding as array<{dtype}>) as embedding")
    df.repartitionByRange(2, "vec_id").write.format(kind).mode("append").save(str(tmp_path / kind))
    got = spark.read.format(kind).load(str(tmp_path / kind)).orderBy("vec_id").collect()
    assert [(r["vec_id"], [int(x) for x in r["embedding"]]) for r in got] == rows


def test_empty_file(spark, tmp_path):
    (tmp_path / "x.fvecs").write_bytes(b"")
    assert spark.read.format("fvecs").load(str(tmp_path / "x.fvecs")).count() == 0


@pytest.mark.parametrize("kind", ["fvecs", "i8bin"])
def test_appends_add_and_overwriting_replaces(spark, tmp_path, kind):
    path = str(tmp_path / kind)

    def rows(first, n):
        dtype = "float" if kind == "fvecs" else "tinyint"
        return spark.createDataFrame([(i, [first, i]) for i in range(n)], "vec_id long, embedding array<int>").selectExpr("vec_id", f"cast(embedding as array<{dtype}>) as embedding").repartitionByRange(2, "vec_id")

    def stored():
        return [[int(x) for x in r["embedding"]] for r in spark.read.format(kind).load(path).orderBy("vec_id").collect()]

    rows(1, 4).write.format(kind).mode("append").save(path)
    rows(2, 3).write.format(kind).mode("append").save(path)
    assert stored() == [[1, i] for i in range(4)] + [[2, i] for i in range(3)]
    rows(3, 2).write.format(kind).mode("overwrite").save(path)
    assert stored() == [[3, 0], [3, 1]]
    rows(4, 1).write.format(kind).mode("append").save(path)
    assert stored() == [[3, 0], [3, 1], [4, 0]]


def test_vectors_without_a_common_dimension_are_not_written(spark, tmp_path):
    for bad in ([(0, [1.0]), (1, None)], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(Exception, match="one dimension"):
            spark.createDataFrame(bad, "vec_id long, embedding array<float>").coalesce(1).write.format("fvecs").mode("append").save(str(tmp_path / "x"))
    assert not [p for p in (tmp_path / "x").glob("*.fvecs")] if (tmp_path / "x").exists() else True
