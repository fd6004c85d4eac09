import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import vector as V
from nearfold.operators import blocks as B
from nearfold.operators import graph as G
from nearfold.operators import ivf
from nearfold.operators import kmeans as K
from nearfold.operators import knn as N
from nearfold.operators import lookup as L
from nearfold.operators import quantize as Z
from nearfold.operators import rerank as R
from nearfold.operators.ivf import IvfIndex
from nearfold.operators.tree import train_tree
from nearfold.plans import catalog
from nearfold.plans.index import BlockIndex
from nearfold.streaming.ingest import standing_top_k

rng = np.random.default_rng(7)
X = rng.normal(size=(400, 16)) / 4
X[50] = X[10]  # equal vectors


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, [float(v) for v in x], int(i % 4)) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").cache()


@pytest.fixture(scope="module")
def queries(base):
    return base.where("vec_id % 40 = 10").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")


def truth(k):
    out = {}
    for q in range(10, 400, 40):
        d = np.round(((X - X[q]) ** 2).sum(axis=1), 6)
        out[q] = [int(i) for i in np.lexsort((np.arange(400), d))[:k]]
    return out


def listed(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("k", [1, 10, 500])
def test_exact_knn(base, queries, k):
    assert listed(N.exact_knn(base, queries, k)) == truth(k)


def test_exact_knn_in_blocks(base, queries, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 3)
    assert listed(N.exact_knn(base, queries, 5)) == truth(5)


def test_exact_knn_with_many_ties(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, q array<double>")
    assert listed(N.exact_knn(same.orderBy(F.desc("vec_id")).coalesce(1), q, 4)) == {0: [0, 1, 2, 3]}


def test_no_queries_no_rows(base, queries):
    assert N.exact_knn(base, queries.limit(0), 3).count() == 0
    assert N.exact_knn(base.limit(0), queries, 3).count() == 0


def test_recall_and_restriction(spark, base, queries):
    t = N.exact_knn(base, queries, 10)
    assert N.recall(t, t, 10).first()[0] == 1.0
    assert N.recall(t.where("rank <= 5"), t, 10).first()[0] == 0.5
    m = base.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("local_id"), F.col("vec_id").alias("global_id"))
    got = N.restrict_truth(t, m, 3).collect()
    for q, ids in truth(10).items():
        even = [i // 2 for i in ids if i % 2 == 0]
        rows = sorted((r["rank"], r["local_id"], r["survivors"]) for r in got if r["qid"] == q)
        assert rows == [(n + 1, i, len(even)) for n, i in enumerate(even[:3])]


def test_rotations_are_orthogonal():
    for m in (Z.random_rotation(16), np.array(Z.reflection(16))):
        assert np.allclose(m @ m.T, np.eye(16))
    assert Z.gaussian_projection(64, 4096).std() == pytest.approx(4096**-0.5, rel=0.02)


def test_quantiser_bounds_and_composite_distance(base, queries):
    q = Z.Quantiser.analytic(0.25, 2, 4)
    coded = q.encode(base).crossJoin(queries)
    row = coded.select(q.composite_distance(F.col("q")).alias("c"), V.l2sq(F.col("q"), q.decode()).alias("d"), V.l2sq(F.col("embedding"), q.decode()).alias("e"), V.l2sq(F.col("embedding"), V.reconstruct(F.col("code"), q.primary)).alias("p"))
    for r in row.collect():
        assert r["c"] == pytest.approx(r["d"], abs=1e-12)
    assert row.agg(F.avg("e")).first()[0] < row.agg(F.avg("p")).first()[0] / 4


def test_kmeans_1d(spark):
    values = spark.createDataFrame([(float(c + d),) for c in (0, 10, 20) for d in (-1, 0, 1)], "x double")
    assert Z.kmeans_1d(values, 3) == pytest.approx([0, 10, 20])


def test_assignments_agree(base):
    cents = K.strided_init(base, 8)
    slow = {r["vec_id"]: r["c"] for r in K.nearest(base, K.centroid_table(base.sparkSession, cents)).collect()}
    fast = {r["vec_id"]: r["c"] for r in K.assign_fast(base, cents).collect()}
    want = {i: int(((cents - x) ** 2).sum(axis=1).argmin()) for i, x in enumerate(X)}
    assert slow == fast == want


def test_kmeans_lowers_the_cost(base):
    def cost(c):
        return sum(((c - x) ** 2).sum(axis=1).min() for x in X)

    assert cost(K.kmeans(base, 8, 6)) < cost(K.kmeans(base, 8, 1)) < cost(K.strided_init(base, 8))


def test_principal_axes(base):
    values, axes = np.linalg.eigh(X.T @ X / len(X))
    got = Z.principal_axes(base, 3)
    for g, w in zip(got, axes[:, ::-1].T):
        assert abs(g @ w) == pytest.approx(1)
    scatter = Z.class_scatter_axes(base, "label", 2)
    assert np.allclose(scatter @ scatter.T, np.eye(2))


def test_ivf_recall_rises_with_probes(base, queries):
    index = IvfIndex(nlist=8, bits=2, rounds=3).train(base).add(base)
    t = N.exact_knn(base, queries, 10)
    for raw, least in ((None, 0.75), (base, 0.98)):  # without raw vectors by decoded ones
        recalls = [N.recall(index.search(queries, 10, nprobe=p, raw=raw), t, 10).first()[0] for p in (1, 4, 8)]
        assert recalls == sorted(recalls) and recalls[-1] >= least
    assert listed(index.search(queries, 10, nprobe=8, alpha=40, raw=base)) == truth(10)


@pytest.mark.parametrize("bits, residual_bits", [(1, 4), (2, 4), (4, 8)])
def test_code_distances_equal_decoded_ones(base, queries, bits, residual_bits):
    index = IvfIndex(nlist=4, bits=bits, residual_bits=residual_bits, rounds=2).train(base).add(base)
    c = index.coder
    decoded = {}
    for r in index.lists.collect():
        code = L.unpack(np.frombuffer(r["code"], np.uint8)[None], bits, 16)[0]
        left = L.unpack(np.frombuffer(r["residual_code"], np.uint8)[None], residual_bits, 16)[0]
        decoded[r["vec_id"]] = c.centroids[r["list_id"]] + (np.array(c.quantiser.primary)[code] + np.array(c.quantiser.residual)[left]) @ c.rotation
    got = index.search(queries, 400, nprobe=4, alpha=1).collect()
    assert len(got) == 4000
    for r in got:
        assert r["dist"] == pytest.approx(((X[r["qid"]] - decoded[r["vec_id"]]) ** 2).sum())


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_packed_codes_and_byte_tables(bits):
    codes = np.random.default_rng(bits).integers(0, 1 << bits, (30, 13)).astype(np.uint8)
    packed = L.pack(codes, bits)
    assert packed.shape == (30, -(-13 * bits // 8)) and (L.unpack(packed, bits, 13) == codes).all()
    q, levels = X[0, :13], np.sort(np.random.default_rng(1).normal(size=1 << bits))
    want = ((levels[codes] - q) ** 2).sum(axis=1)
    assert np.allclose(L.distances(packed, L.byte_tables(L.level_table(q, levels), bits)), want)


def test_vectors_that_are_none(spark, base, queries):
    odd = base.select("vec_id", "embedding").unionByName(spark.createDataFrame([(1000, None), (1001, []), (1002, [1.0]), (1003, [None] * 16)], "vec_id long, embedding array<double>"))
    assert listed(N.exact_knn(odd, queries, 10)) == truth(10)
    more = queries.unionByName(spark.createDataFrame([(900, None), (901, [])], "qid long, q array<double>"))
    assert listed(N.exact_knn(odd, more, 10)) == truth(10)
    assert np.allclose(K.kmeans(odd, 4, 2), K.kmeans(base, 4, 2))
    index = IvfIndex(nlist=4, rounds=2).train(odd).add(odd)
    assert index.lists.count() == 400 and N.recall(index.search(more, 5, 4, raw=odd), N.exact_knn(base, queries, 5), 5).first()[0] > 0.95
    assert len(K.kmeans(base.limit(0), 4)) == 0
    with pytest.raises(ValueError, match="no vectors"):
        IvfIndex().train(base.limit(0))


def test_training_takes_any_ids(spark, base):
    moved = base.select((F.col("vec_id") * 7 + 1_000_000).alias("vec_id"), "embedding")
    assert np.allclose(K.strided_init(moved, 8), K.strided_init(base, 8))
    assert np.allclose(K.strided_init(base, 8), X[[i * 400 // 8 for i in range(8)]])
    assert K.strided_init(moved.limit(3), 8).shape == (3, 16)


def test_empty_clusters_are_seeded_anew(spark):
    x = [[float(i % 3), 0.0] for i in range(30)] + [[float(i), 9.0] for i in range(10)]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    cents = K.kmeans(rows, 4, 12, init=np.array([[0.0, 0.0], [1.0, 5.0], [99.0, 99.0], [98.0, 99.0]]))
    sizes = {r["c"]: r["count"] for r in K.assign_fast(rows, cents).groupBy("c").count().collect()}
    assert len(sizes) == 4


def test_projected_kmeans_has_means_of_the_full_space(base):
    p = Z.gaussian_projection(16, 4, 3)
    got = {r["c"]: (r["n"], np.array(r["cent"])) for r in K.projected_kmeans(base, p, 6, 4).collect()}
    y = X @ p.T
    cents = y[[i * 400 // 6 for i in range(6)]]
    for _ in range(4):
        at = ((y[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
        cents = np.array([y[at == c].mean(axis=0) for c in range(6)])
    at = ((y[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert {c: n for c, (n, _) in got.items()} == dict(zip(*np.unique(at, return_counts=True)))
    assert all(np.allclose(cent, X[at == c].mean(axis=0)) for c, (_, cent) in got.items())


def test_ivf_adds_in_parts(base, queries, tmp_path):
    one = IvfIndex(nlist=4, rounds=1).train(base).add(base)
    two = IvfIndex(nlist=4, rounds=1).train(base)
    for i in (0, 1):
        two.add(base.where(f"vec_id % 2 = {i}"), f"file://{tmp_path}/lists")
    assert listed(one.search(queries, 5, 4)) == listed(two.search(queries, 5, 4))


@pytest.fixture(scope="module")
def cells(base):
    return train_tree(base, 4, 3, 2, 4).assign(base).checkpoint()


def test_tree_residuals(base, cells):
    tree = train_tree(base, 4, 3, 2, 4)
    cents = {r["cell_id"]: np.array(r["cent"]) for r in tree.absolute().collect()}
    for r in tree.assign(base).collect():
        assert np.allclose(np.array(r["r3"]) + cents[r["cell_id"]], r["embedding"])


@pytest.mark.parametrize("former", ["bisect_blocks", "balanced_blocks"])
def test_blocks_partition_the_cells(cells, former):
    got = getattr(B, former)(cells, 10).toPandas()
    assert sorted(got["vec_id"]) == list(range(400))
    sizes = got.groupby(["cell_id", "block"]).size()
    assert sizes.max() <= 10 and not got.duplicated(["cell_id", "block", "pos"]).any()


def test_large_cell_is_bisected(spark):
    rows = [(i, 0, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(641, 4)))]
    got = B.bisect_blocks(spark.createDataFrame(rows, "vec_id long, cell_id long, embedding array<double>"), 128).toPandas()
    assert got["block"].nunique() == 8 and got.groupby("block").size().max() <= 128


def test_packed_blocks(cells):
    got = B.pack(cells, 7).toPandas()
    assert sorted(got["vec_id"]) == list(range(400)) and got.groupby("block_id").size().max() <= 7
    assert got.groupby("block_id")["cell_id"].nunique().max() == 1
    assert sorted(got["block_id"].unique()) == list(range(got["block_id"].nunique()))


def graph(spark, edges):
    return spark.createDataFrame([(a, n + 1, b) for a, bs in edges.items() for n, b in enumerate(bs)], "src long, rank int, dst long")


def test_breadth_first_over_two_components(spark):
    edges = graph(spark, {0: [1], 1: [2], 2: [3], 10: [11], 11: [10]})
    blocks = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 10, 11, 12)], "block_id long")
    got = {r["block_id"]: (r["component"], r["depth"]) for r in G.breadth_first(edges, blocks).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 10: (10, 0), 11: (10, 1), 12: (12, 0)}
    starts = spark.createDataFrame([(5, 0)], "qid long, block_id long")
    assert {r["block_id"]: r["hops"] for r in G.reachable(starts, edges, 2).collect()} == {0: 0, 1: 1, 2: 2}


def line_graph(spark):
    blocks = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "block_id long, cent array<double>")
    edges = graph(spark, {i: [j for j in (i - 1, i + 1) if 0 <= j < 20] for i in range(20)})
    q = spark.createDataFrame([(1, [12.2, 0.0]), (2, [0.0, 0.0])], "qid long, q array<double>")
    entries = spark.createDataFrame([(1, 3), (2, 5)], "qid long, block_id long")
    return q, entries, blocks, edges


@pytest.mark.parametrize("width", [1, 4])
def test_beam_reaches_the_nearest_blocks(spark, width):
    got = G.beam_search(*line_graph(spark), ef=16, width=width).collect()
    for q, want in ((1, 12), (2, 0)):
        rows = [r for r in got if r["qid"] == q]
        assert min(rows, key=lambda r: r["dist"])["block_id"] == want
        assert len({r["block_id"] for r in rows}) == len(rows) <= 16


@pytest.mark.parametrize("ef, width, early", [(7, 3, False), (4, 2, True)])
def test_walks_by_joins_equal_broadcast_walks(spark, ef, width, early):
    r = np.random.default_rng(ef)
    cents = r.normal(size=(40, 3))
    blocks = spark.createDataFrame([(i * 3, [float(v) for v in c]) for i, c in enumerate(cents)], "block_id long, cent array<double>")
    near = ((cents[:, None] - cents[None]) ** 2).sum(axis=2).argsort(axis=1)[:, 1:4]
    edges = graph(spark, {i * 3: [int(j) * 3 for j in near[i]] for i in range(40)})
    q = spark.createDataFrame([(i, [float(v) for v in r.normal(size=3)]) for i in range(6)], "qid long, q array<double>")
    entries = spark.createDataFrame([(i, int(b) * 3) for i in range(6) for b in r.choice(40, 2, replace=False)], "qid long, block_id long")
    for knobs in ((q, entries, blocks, edges), line_graph(spark))[: 1 + early]:
        walked = [sorted(map(tuple, f(*knobs, ef, width, early).collect())) for f in (G.beam_search, G.walk_by_joins)]
        assert walked[0] == walked[1] and walked[0]


def test_final_beam(spark):
    walked = G.beam_search(*line_graph(spark), ef=16)
    assert [(r["rank"], r["block_id"]) for r in G.final_beam(walked, 3).where("qid = 1").orderBy("rank").collect()] == [(1, 12), (2, 13), (3, 11)]


def test_large_cells_are_cut_along_one_axis(cells):
    got = B.balanced_blocks(cells.withColumn("cell_id", F.lit(0).cast("long")), 10, most=100).toPandas()
    assert sorted(got["vec_id"]) == list(range(400)) and got.groupby("block").size().tolist() == [10] * 40
    axis = np.linalg.eigh(np.cov(X.T))[1][:, -1]
    along = (X @ axis)[got.sort_values(["block", "pos"])["vec_id"]]
    assert (np.diff(along) >= -1e-8).all() or (np.diff(along) <= 1e-8).all()


@pytest.mark.parametrize("mode,seeds", [("fixed", 0), ("pruned", 0), ("pruned", 2)])
def test_whole_index(base, queries, mode, seeds):
    index = BlockIndex(k1=4, k2=3, k3=2, leaf=16, degree=6).train(base).add(base)
    t = N.exact_knn(base, queries, 5)
    low, high = (N.recall(index.search(queries, 5, ef=ef, mode=mode, seeds=seeds), t, 5).first()[0] for ef in (2, 64))
    assert low <= high and high > 0.9


def test_bounds_hold_and_pruning_is_exact(base, queries):
    decoded = base.select(F.lit(0).cast("long").alias("block_id"), "vec_id", F.transform("embedding", lambda x: F.round(x, 1)).alias("decoded"))
    decoded = decoded.join(base, "vec_id").select("block_id", "vec_id", "decoded", F.sqrt(V.l2sq(F.col("embedding"), F.col("decoded"))).alias("eps"))
    pairs = queries.select("qid", F.lit(0).cast("long").alias("block_id"))
    b = R.bounds(R.code_scan(pairs, decoded, queries))
    assert R.exact(b, base, queries).where("low2 > dist + 1e-6 or dist > high2 + 1e-6").count() == 0
    tau = R.threshold(b, 10)
    assert R.prune(b, tau).count() < b.count()
    assert listed(R.prune_and_rerank(b, tau, base, queries, 10)) == truth(10)
    assert listed(R.prune_and_rerank(b, R.seeds(b, base, queries, 20, 10), base, queries, 10)) == truth(10)


@pytest.mark.parametrize("k, nlist", [(1, 4), (5, 4), (500, 3)])
def test_exact_search_of_all_lists(base, queries, monkeypatch, k, nlist):
    """The k nearest whatever the coding error; what tasks pass on doesn't grow with the rows."""
    index = IvfIndex(nlist=nlist, bits=1, residual_bits=1, rounds=2).train(base).add(base)
    passed, top_k = [], ivf.top_k
    monkeypatch.setattr(ivf, "top_k", lambda df, *a: passed.append(df) or top_k(df, *a))
    got = index.search(queries, k, nprobe=nlist, alpha=None, raw=base)
    assert listed(got) == listed(N.exact_knn(base, queries, k))
    most = passed[0].groupBy("qid", F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= k
    with pytest.raises(ValueError):
        index.search(queries, k, nprobe=nlist, alpha=None)


def test_exact_search_among_many_copies(spark):
    rows = [(i, [1.0, 0.0, 0.0] if i % 5 else [float(v) for v in rng.normal(size=3)]) for i in range(2000)]
    copies = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = copies.where("vec_id IN (0, 1, 1999)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    index = IvfIndex(nlist=2, rounds=1).train(copies).add(copies)
    got = index.search(asked, 4, nprobe=2, alpha=None, raw=copies)
    assert listed(got) == listed(N.exact_knn(copies, asked, 4))


def test_index_of_all_lists_passes_few_rows(spark, monkeypatch):
    """ivf_all_lists ranks k rows of a query for each task, not every row of the table."""
    passed, top_k = [], ivf.top_k
    monkeypatch.setattr(ivf, "top_k", lambda df, *a: passed.append(df.count()) or top_k(df, *a))
    d = "/root/testdata/sf0.1"
    got = catalog.QUERIES["ivf_all_lists"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.knn(spark, d).select(got.columns).collect()))
    assert passed[0] <= 20 * catalog.TOP * 16  # 20 queries against 2,000 rows


def test_served_queries_pass_few_rows(spark, monkeypatch):
    """So does stream_serve, in each micro-batch."""
    passed, top_k = [], ivf.top_k
    monkeypatch.setattr(ivf, "top_k", lambda df, *a: passed.append(df.count()) or top_k(df, *a))
    d = "/root/testdata/sf0.1"
    got = catalog.QUERIES["stream_serve"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog.knn(spark, d).select(got.columns).collect()))
    assert len(passed) == 2 and sum(passed) <= 20 * catalog.TOP * 16


def test_standing_queries_in_blocks_and_null_vectors(spark, base, queries, monkeypatch, tmp_path):
    monkeypatch.setattr(N, "QUERY_BLOCK", 3)
    rows = base.select("vec_id", "embedding").unionByName(spark.createDataFrame([(9001, None), (9002, []), (9003, [0.0])], "vec_id long, embedding array<double>"))
    rows.repartition(2, "vec_id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    last: dict = {}
    state = standing_top_k(stream, queries, 500)
    assert "Join" not in state._jdf.queryExecution().analyzed().toString()  # no row for each pair

    def put(batch, number):
        for r in batch.collect():
            last.setdefault(r["qid"], {}).setdefault(number, []).append((r["rank"], r["vec_id"], r["dist"]))

    state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [(q, *r) for q, batches in last.items() for r in sorted(batches[max(batches)])]
    assert sorted(got) == sorted((r["qid"], r["rank"], r["vec_id"], r["dist"]) for r in N.exact_knn(base, queries, 500).collect())


def test_breadth_first_of_bounded_depth(spark):
    """As the recursion of bfs_order's SQL, no label goes further than 12 hops."""
    edges = graph(spark, {i: [i + 1] for i in range(29)})
    blocks = spark.createDataFrame([(i,) for i in range(30)], "block_id long")
    got = {r["block_id"]: (r["component"], r["depth"]) for r in G.breadth_first(edges, blocks, catalog.HOPS).collect()}
    assert got == {i: (max(0, i - 12), min(i, 12)) for i in range(30)}
    assert {r["depth"] for r in G.breadth_first(edges, blocks).collect()} == set(range(30))


def test_bfs_order_of_deep_graphs(spark, monkeypatch):
    """bfs_order and its SQL follow a component to its end: two chains of shuffled numbers, each with a ring, and a block alone."""
    chains = {i: [i + 1] for i in range(39) if i != 13} | {12: [13, 3], 30: [31, 36]}
    chains = {a * 7 % 41: [b * 7 % 41 for b in bs] for a, bs in chains.items()}
    monkeypatch.setattr(catalog, "graph_of", lambda *a: graph(spark, chains))
    rows = catalog.QUERIES["bfs_order"](spark, "/root/testdata/sf0.001").collect()
    ids = sorted(r["block_id"] for r in rows)
    assert ids == list(range(41))
    near = {i: set() for i in ids}
    for a, bs in chains.items():
        for b in bs:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in ids:
        wave, depth = {start} - set(want), 0
        while wave:
            want |= {i: (start, depth) for i in wave}
            wave, depth = {j for i in wave for j in near[i]} - set(want), depth + 1
    assert max(depth for _, depth in want.values()) > catalog.HOPS
    assert {r["block_id"]: (r["component"], r["depth"]) for r in rows} == want
    sql = catalog.SQL["bfs_order"]
    pairs = ", ".join(f"({a}, {b})" for a, bs in chains.items() for b in bs)
    tables = f"WITH RECURSIVE block AS (SELECT range AS block_id FROM range(41)), graph AS (SELECT * FROM (VALUES {pairs}) t(src, dst)), "
    assert {b: (c, n) for b, c, n in duckdb.sql(tables + sql[sql.index("both_ AS"):]).fetchall()} == want
