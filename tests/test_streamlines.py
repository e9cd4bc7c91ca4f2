import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fascicle.functions.codec import DctCodec, decode, encode
from fascicle.operators import clustering, evaluation, geometry, index, mapping, metric, scoring, search
from fascicle.plans import queries
from fascicle.schema import CENTRE, LATENT, STREAMLINE, ModelSpec, split_size


def lines(spark, *streamlines):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in s]) for i, s in enumerate(streamlines)], STREAMLINE)


def points(df):
    return {r[0]: [tuple(p) for p in r[1]] for r in df.select("sid", "points").collect()}


STRAIGHT = [(0, 0, 0), (4, 0, 0), (10, 0, 0)]


def test_resample_keeps_ends_and_spaces_evenly(spark):
    got = points(geometry.resample(lines(spark, STRAIGHT, [(1, 2, 3)], [(1, 1, 1), (1, 1, 1)], []), 11))
    assert got[0] == [(float(x), 0.0, 0.0) for x in range(11)]
    assert got[1] == [(1.0, 2.0, 3.0)] * 11
    assert got[2] == [(1.0, 1.0, 1.0)] * 11
    assert got[3] == []


def test_lengths_and_flip(spark):
    df = lines(spark, STRAIGHT, [(1, 2, 3)], [(1, 1, 1), (1, 1, 1)], [])
    assert [r[0] for r in df.orderBy("sid").select(geometry.length(F.col("points"))).collect()] == [10.0, 0.0, 0.0, 0.0]
    twice = df.withColumn("points", geometry.flip(geometry.flip(F.col("points"))))
    assert points(twice) == points(df)
    assert df.select(geometry.flatten(F.col("points"))).first()[0] == [0.0, 4.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_distances():
    a = np.array([STRAIGHT], float)
    assert geometry.mdf(a, a[:, ::-1]) == 0 and geometry.hausdorff(a, a[:, ::-1]) == 0
    moved = a + np.array([0, 3, 0])
    assert geometry.mdf(a, moved) == 3 and geometry.hausdorff(a, moved) == 3


def test_codec_round_trip_and_reversal(spark):
    rng = np.random.default_rng(0)
    smooth = [list(map(tuple, np.cumsum(rng.normal(size=(20, 3)), 0))) for _ in range(4)]
    codec = DctCodec(ModelSpec(latent_dim=48, input_points=16))
    even = geometry.resample(lines(spark, *smooth), 16)
    codes = encode(even, codec, resampled=True)
    back = points(decode(codes, codec))
    for sid, p in points(even).items():
        assert np.allclose(back[sid], p)
    for r in codes.collect():
        f = np.array(r["z_fwd"]).reshape(3, 16) * (-1.0) ** np.arange(16)
        assert np.allclose(f.ravel(), r["z_rev"])


def latents(spark, fwd, rev=None):
    rev = fwd if rev is None else rev
    return spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(fwd, rev))], LATENT)


def test_scores_ties_and_no_centres(spark):
    x = latents(spark, [[0, 0], [2, 0]], [[5, 5], [0, 0]])
    c = spark.createDataFrame([(2, [0.0, 0.0], [0.0, 0.0]), (1, [4.0, 0.0], [0.0, 0.0])], CENTRE)
    got = {r["sid"]: (r["score"], r["label"], r["forward"]) for r in scoring.score(x, c, 0.5).collect()}
    assert got == {0: (0.0, 2, True), 1: (0.0, 2, False)}
    same = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0]), (2, [-1.0, 0.0], [0.0, 0.0])], CENTRE)
    assert {r["label"] for r in scoring.score(latents(spark, [[0, 0]]), same).collect()} == {1}
    assert scoring.score(x, c.where("false")).select("score", "label").distinct().collect() == [(None, None)]


def test_centres_in_slices_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, c = latents(spark, rng.normal(size=(40, 4)), rng.normal(size=(40, 4))), rng.normal(size=(9, 4))
    centres = spark.createDataFrame([(i + 1, list(map(float, r)), list(map(float, r))) for i, r in enumerate(c)], CENTRE)
    key = lambda df: sorted((r["sid"], round(r["score"], 9), r["label"]) for r in df.collect())
    whole = key(scoring.score(x, centres))
    monkeypatch.setattr(scoring, "SLICE_NUMBERS", 8)
    assert key(scoring.score(x, centres)) == whole
    # Rows of one id stay rows of their own.
    assert key(scoring.score(x.unionByName(x), centres)) == sorted(whole * 2)


def sequential(fwd, rev, limit2, batch, split):
    """The definition, one row after another."""
    centres = []
    for s in range(0, len(fwd), batch):
        rows = range(s, min(s + batch, len(fwd)))
        far = [i for i in rows if all(((fwd[i] - fwd[c]) ** 2).sum() >= limit2 and ((rev[i] - fwd[c]) ** 2).sum() >= limit2 for c in centres)]
        size, local = split(len(far)), []
        for k in range(0, len(far), size):
            fresh = []
            for i in far[k : k + size]:
                if any(((fwd[i] - fwd[c]) ** 2).sum() < limit2 or ((rev[i] - fwd[c]) ** 2).sum() < limit2 for c in local):
                    continue
                if any(min(((fwd[i] - fwd[c]) ** 2).sum(), ((fwd[i] - rev[c]) ** 2).sum()) < limit2 for c in fresh):
                    continue
                fresh.append(i)
            local += fresh
        centres += local
    return centres


@pytest.mark.parametrize(("batch", "split"), [(1000, 1000), (60, 1000), (50, 20), (33, 7)])
def test_clustering_equals_the_sequential_rule(spark, batch, split):
    rng = np.random.default_rng(2)
    fwd, rev = rng.normal(size=(120, 3)), rng.normal(size=(120, 3))
    fwd[50], rev[50] = fwd[3], rev[3]
    want = sequential(fwd, rev, 0.9**2, batch, lambda n: split)
    got = clustering.find_centers(latents(spark, fwd, rev), 0.9, batch_size=batch, split=lambda n: split).orderBy("label").collect()
    assert [r["label"] for r in got] == list(range(1, len(want) + 1))
    assert np.allclose([r["z_fwd"] for r in got], fwd[want])


@pytest.mark.parametrize("shape", ["chain", "grid", "one", "random"])
@pytest.mark.parametrize("way", ["rounds", "cells", "prefixes"])
def test_greedy_rounds_on_any_shape(spark, monkeypatch, shape, way):
    rng = np.random.default_rng(5)
    n = 90
    fwd = {"chain": np.arange(n)[:, None] * [0.6, 0.0], "grid": rng.integers(0, 5, (n, 2)) / 1.0, "one": np.zeros((n, 2)), "random": rng.normal(size=(n, 2))}[shape]
    rev = fwd if shape == "one" else fwd[:, ::-1] + 0.1 * rng.integers(-1, 2, (n, 2))
    if shape == "random":
        fwd[7], rev[9] = np.nan, np.inf
    want = sequential(*([np.delete(z, [7, 9], 0) for z in (fwd, rev)] if shape == "random" else (fwd, rev)), 1.0, 60, lambda m: 25)
    if way == "cells":
        # No centre travels with a task, and no prefix is met block by block.
        monkeypatch.setattr(scoring, "SLICE_NUMBERS", 0)
        monkeypatch.setattr(clustering, "BLOCKS_ONLY", 0)
        monkeypatch.setattr(metric, "UNIT", 16)
    lines_ = []
    small = {"rounds": {"here": 0}, "cells": {"here": 0, "prefix": 30}, "prefixes": {"prefix": 7}}[way]
    got = clustering.find_centers(latents(spark, fwd, rev), 1.0, batch_size=60, split=lambda m: 25, report=lines_, **small).orderBy("label").collect()
    kept = np.delete(fwd, [7, 9], 0) if shape == "random" else fwd
    assert np.array_equal([r["z_fwd"] for r in got], kept[want])
    assert [r["label"] for r in got] == list(range(1, len(want) + 1))
    assert {line["batch"] for line in lines_} <= {0, 1} and all(line["rounds"] >= 1 for line in lines_)
    if way == "rounds":
        # A chain is told block by block, not row by row.
        assert max(line["rounds"] for line in lines_) <= 64


def test_nearest_to_the_last_bit():
    grid = np.array([[i, j] for i in range(50) for j in range(40)], float)
    centres = np.random.default_rng(6).permutation(np.array([[2 * i + 1, 2 * j + 1] for i in range(25) for j in range(20)], float))
    d = ((grid[:, None] - centres) ** 2).sum(2)
    for c in (centres, np.concatenate([centres, centres])):
        far, which = metric.nearest(grid, c)
        assert np.array_equal(which, d.argmin(1)) and np.array_equal(far, d.min(1))
    far_out = np.random.default_rng(7).normal(size=(500, 8)) + 1e7
    assert np.array_equal(metric.nearest(far_out, far_out)[1], np.arange(500))
    x = np.random.default_rng(8).integers(-4, 5, (300, 3)).astype(float)
    rows, columns = metric.within(x, x, 2.0)
    assert set(zip(rows, columns)) == set(zip(*np.nonzero(((x[:, None] - x) ** 2).sum(2) < 2.0)))


def test_scores_without_codes(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0], [0.0, 0.0]), (2, [float("nan"), 0.0], [0.0, 0.0])], CENTRE)
    x = spark.createDataFrame([(1, None, None), (2, [float("nan"), 0.0], [float("inf"), 0.0]), (3, None, [3.0, 4.0]), (4, [3.0, 4.0], None), (5, [None, 1.0], [0.0, 1.0])], LATENT)
    for most in (None, 0):
        got = {r["sid"]: (r["score"], r["label"], r["forward"]) for r in scoring.score(x, c, most=most).collect()}
        assert got == {1: (None, None, None), 2: (None, None, None), 3: (5.0, 1, False), 4: (5.0, 1, True), 5: (1.0, 1, False)}
    assert {r["sid"] for r in search.neighbours(x, c).collect()} == {4}


def test_cells_spare_distances_and_share_hot_units(spark, monkeypatch):
    rng = np.random.default_rng(9)
    spots = rng.normal(size=(20, 4)) * 50
    points, rows = spots[rng.integers(0, 20, 600)] + rng.normal(size=(600, 4)), spots[rng.integers(0, 20, 400)]
    rows[:200] = rows[0]  # a hot query, and a hot point
    points[:150] = points[0]
    centres = spark.createDataFrame([(i + 1, c.tolist(), c.tolist()) for i, c in enumerate(points)], CENTRE)
    monkeypatch.setattr(metric, "UNIT", 32)
    monkeypatch.setattr(metric, "QUERIES", 50)
    report = {}
    got = {r["sid"]: (r["score"], r["label"]) for r in scoring.score(latents(spark, rows), centres, report=report, most=0).collect()}
    d = ((rows[:, None] - points) ** 2).sum(2)
    assert got == {i: (float(np.sqrt(d[i].min())), int(d[i].argmin()) + 1) for i in range(400)}
    assert report["spared"] > 0.5
    for k, radius, kind in ((3, None, "l2"), (None, 30.0, "l1"), (4, 0.02, "so2"), (2, 100.0, "l2")):
        found = lambda most: sorted(map(tuple, search.neighbours(latents(spark, rows), centres, k, radius, kind, most=most).collect()))  # noqa: E731, B023
        assert found(0) == found(None)


def test_batches_of_rows_without_a_source(spark):
    x = latents(spark, [[i, 0] for i in range(9)]).withColumn("src", F.when(F.col("sid") > 5, F.lit("a")))
    got = clustering.with_batches(x, 3, "src").groupBy("batch_id", "src").count().collect()
    assert sorted((r["batch_id"], r["src"] or "", r["count"]) for r in got) == [(0, "", 2), (0, "a", 1), (1, "", 2), (1, "a", 1), (2, "", 2), (2, "a", 1)]
    assert clustering.find_centers(x, 0.5, batch_size=3, source="src").count() == 9


def test_clustering_edges(spark):
    assert clustering.find_centers(latents(spark, np.zeros((0, 2))), 1.0).count() == 0
    assert clustering.find_centers(latents(spark, [[0, 0]] * 5), 1.0).count() == 1
    # Exactly at the limit is a new centre.
    assert clustering.find_centers(latents(spark, [[0, 0], [1, 0]]), 1.0).count() == 2
    assert clustering.find_centers(latents(spark, [[0, 0], [1, 0]]), 1.0001).count() == 1
    rows = clustering.find_centers(latents(spark, [[i, 0] for i in range(5)]), 0.5, batch_size=2)
    assert rows.count() == 5
    assert clustering.find_centers(latents(spark, [[i, 0] for i in range(5)]), 0.5, batch_size=2, max_iteration=1).count() == 2
    assert [split_size(n) for n in (100_000, 100_001, 1_000_001)] == [1_000, 10_000, 100_000]


def test_quotas():
    assert batch_sum([100, 50, 3], 30) == 30
    assert clustering.batch_quotas([1, 1, 1], 2) == [1, 1, 1]
    assert clustering.batch_quotas([], 5) == []


def batch_sum(counts, size):
    return sum(clustering.batch_quotas(counts, size))


def test_random_batches(spark):
    x = latents(spark, [[i, 0] for i in range(30)])
    a = clustering.random_batches(x, 25, 2, seed=5, block=10)
    assert a.count() == 50
    key = lambda df: sorted(map(tuple, df.select("batch_id", "run", "i", "sid").collect()))
    assert key(a) == key(clustering.random_batches(x, 25, 2, seed=5, block=10))


@pytest.mark.parametrize("kind", ["l1", "l2", "so2"])
def test_searches_against_all_distances(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x, c = rng.integers(-3, 4, size=(20, 3)).astype(float), rng.integers(-3, 4, size=(9, 3)).astype(float)
    points = spark.createDataFrame([(i + 1, r.tolist(), r.tolist()) for i, r in enumerate(c)], CENTRE)
    gap = x[:, None] - c[None]
    angle = np.abs(gap[..., 2])
    d = {"l1": np.abs(gap).sum(2), "l2": (gap**2).sum(2), "so2": np.minimum(angle, np.abs(2 * np.pi - angle))}[kind]
    # Slices of two points: ties meet across slices.
    monkeypatch.setattr(scoring, "SLICE_NUMBERS", 6)
    for k, radius in ((3, None), (None, 2.0), (2, 2.0)):
        want = set()
        for i, row in enumerate(d):
            near = [j for j in np.argsort(row, kind="stable") if radius is None or row[j] < radius][:k]
            want |= {(i, n + 1, int(j) + 1, round(float(row[j]), 9)) for n, j in enumerate(near)}
        got = search.neighbours(latents(spark, x), points, k, radius, kind).collect()
        assert {(r["sid"], r["nth"], r["label"], round(r["distance"], 9)) for r in got} == want


def test_points_come_and_go(spark):
    points = spark.createDataFrame([(1, [0.0], [0.0]), (2, [5.0], [5.0])], CENTRE)
    more = search.add(search.remove(points, points.where("label = 1")), spark.createDataFrame([(3, [4.0], [4.0])], CENTRE))
    assert {r["label"] for r in more.collect()} == {2, 3}
    with pytest.raises(Exception, match="two points of label 2"):
        search.add(points, points.where("label = 2")).collect()
    x = latents(spark, [[1.0]])
    assert [r["label"] for r in search.neighbours(x, more).collect()] == [3]
    assert search.neighbours(x, more.where("false")).collect() == []
    with pytest.raises(ValueError, match="positive"):
        search.neighbours(x, points, None)


def test_voxels_with_a_size_for_each_axis(spark):
    df = lines(spark, [(0, 0.5, 0.5), (4, 0.5, 0.5)], [(0, 0.5, 2.5), (0, 0.5, 9.5)])
    got = {(r["i"], r["j"], r["k"]): r["length"] for r in mapping.voxelise(df, (2.0, 1.0, 5.0)).collect()}
    assert got == {(0, 0, 0): pytest.approx(4.5), (1, 0, 0): pytest.approx(2.0), (0, 0, 1): pytest.approx(4.5)}


def test_voxels_far_apart(spark):
    df = lines(spark, [(0.5, 0.5, 0.5), (1.5, 0.5, 0.5)], [(3e7, 3e7, 3e7), (3e7 + 1, 3e7, 3e7)])
    assert mapping.voxelise(df.coalesce(1), 1.0).agg(F.sum("length")).first()[0] == pytest.approx(2.0)


def test_voxels(spark):
    df = lines(spark, [(0.5, 0.5, 0.5), (1.5, 0.5, 0.5)], [(0.1, 0.2, 0.3), (5.3, 7.1, 2.2), (-3.0, 0.0, 1.0)], [(1, 1, 1)], [])
    got = {(r["i"], r["j"], r["k"]): r["length"] for r in mapping.voxelise(df.where("sid = 0"), 1.0).collect()}
    assert got == {(0, 0, 0): 0.5, (1, 0, 0): 0.5}
    total = mapping.voxelise(df, 0.7).agg(F.sum("length")).first()[0]
    assert total == pytest.approx(df.agg(F.sum(geometry.length(F.col("points")))).first()[0])
    flat = mapping.image(mapping.voxelise(df.withColumn("score", F.lit(3.0)), 0.7))
    assert all(r["value"] == pytest.approx(3.0) for r in flat.collect())


def test_filters(spark):
    v = spark.createDataFrame([(0, 0, 0, 8.0), (1, 1, 1, 27.0)], "i int, j int, k int, value double")
    mean = {(r["i"], r["j"], r["k"]): r["value"] for r in mapping.mean_filter(v, (3, 3, 3)).collect()}
    assert mean[(1, 1, 1)] == pytest.approx(35 / 27) and mean[(2, 2, 2)] == pytest.approx(27 / 8) and len(mean) == 27
    median = {(r["i"], r["j"], r["k"]): r["value"] for r in mapping.median_filter(v.where("i = 0"), (2, 1, 1)).collect()}
    assert median[(0, 0, 0)] == pytest.approx(4.0)


def plain_filter(v, shape, work):
    out = {}
    for place in np.ndindex(*shape):
        around = [tuple(np.add(place, d)) for d in np.ndindex(3, 3, 3)]
        around = [tuple(np.subtract(p, 1)) for p in around]
        inside = [p for p in around if all(0 <= a < n for a, n in zip(p, shape))]
        if any(p in v for p in inside):
            out[place] = work([v.get(p, 0.0) for p in inside])
    return out


@pytest.mark.parametrize("name", ["mean", "median"])
def test_filters_across_blocks(spark, monkeypatch, name):
    rng = np.random.default_rng(10)
    shape = (9, 7, 5)
    v = {tuple(map(int, p)): float(rng.normal()) for p in rng.integers(0, shape, (150, 3))}
    outside = [(-1, 0, 0, 5.0), (9, 6, 4, 5.0)]
    df = spark.createDataFrame([(*p, x) for p, x in v.items()] + outside, "i int, j int, k int, value double")
    monkeypatch.setattr(mapping, "SIDE", 3)
    got = {(r["i"], r["j"], r["k"]): r["value"] for r in getattr(mapping, f"{name}_filter")(df, shape).collect()}
    want = plain_filter(v, shape, getattr(np, name))
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_report_by_tiles(spark):
    rng = np.random.default_rng(11)
    n = 40
    fwd, rev, pts = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), rng.normal(size=(n, 5, 3))
    fwd[5] = fwd[3]
    x = latents(spark, fwd, rev)
    p = lines(spark, *pts)
    pairs = evaluation.pair_distances(p, x, block=7).cache()
    assert pairs.count() == n * (n - 1) // 2 and pairs.where("i > j").count() == pairs.select("i", "j").distinct().count() == pairs.count()
    for r in pairs.collect():
        i, j = r["i"], r["j"]
        assert r["one_sided"] == pytest.approx(min(np.linalg.norm(fwd[i] - fwd[j]), np.linalg.norm(fwd[i] - rev[j])))
    want, got = evaluation.report(pairs).first(), evaluation.pair_report(p, x, block=7).first()
    assert got.asDict() == {k: pytest.approx(v) for k, v in want.asDict().items()} and got["skipped"] == 1
    none = evaluation.pair_report(p.where("sid = 0"), x).first()
    assert (none["pairs"], none["r_mdf"], none["scale_mdf"]) == (0, 0.0, None)


def test_guards(spark):
    df = lines(spark, STRAIGHT, STRAIGHT)
    scores = spark.createDataFrame([(0, 1.0)], "sid long, score double")
    with pytest.raises(ValueError, match="scores"):
        mapping.annotate(df, scores)
    with pytest.raises(ValueError, match="needed"):
        mapping.annotate(df)
    assert mapping.annotate(df.where("sid = 0"), scores).columns == ["sid", "points", "score"]
    assert [r[0] for r in mapping.threshold(scores, 1.0).select("score").collect()] == [0.0]


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(evaluation.pearson("a", "b")).first()[0] == 0
    assert spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double").agg(evaluation.mean_ratio("a", "b")).first()[0] == 2


def test_pairs_by_blocks(spark):
    rng = np.random.default_rng(3)
    fwd, rev = rng.normal(size=(23, 3)), rng.normal(size=(23, 3))
    got = {(r["i"], r["j"]): r["one_sided"] for r in evaluation.pair_distances(None, latents(spark, fwd, rev), block=5).collect()}
    assert len(got) == 23 * 22 // 2
    for (i, j), d in got.items():
        assert i > j and d == pytest.approx(min(np.linalg.norm(fwd[i] - fwd[j]), np.linalg.norm(fwd[i] - rev[j])))


def test_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(2000) * 3, (rng.integers(0, 1 << 22, 2000) * 10 + 5) / 1e7, rng.random(500) * 1e10, 2.0 ** np.arange(-60, 300, 5.0), [0.0, -0.0, 2.5e-7, 5e-7, 1.0000005, 8589934592.1234565, 1e300, np.inf]])
    rows = spark.createDataFrame([(n, float(v)) for n, v in enumerate(x)], "n int, v double")
    want = np.array([r[0] for r in rows.orderBy("n").select(F.round("v", 6) + F.lit(0.0)).collect()])
    got = evaluation._rounded(x, 6)
    assert (got == want).all() and not np.signbit(got).any() and np.isnan(evaluation._rounded(np.array([np.nan]), 6)).all()


@pytest.mark.parametrize("scale", [1.0, 1e14])
def test_pairs_by_value(monkeypatch, scale):
    rng = np.random.default_rng(6)
    one, two = rng.integers(0, 9, (2, 100)) / 1e6 * scale
    parts = [pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(s, s + 10)]), pa.array(range(s, s + 10)), pa.array(one[s : s + 10]), pa.array(two[s : s + 10])], list("ijab")) for s in range(0, 100, 10)]
    monkeypatch.setattr(evaluation, "PAIRS", 40)
    monkeypatch.setattr(evaluation, "SENT", 15)
    out = list(evaluation._ordered(iter(parts), 6))
    assert [b.num_rows for b in out] == [15, 15, 10, 15, 15, 10, 15, 5]
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert sorted(rows) == sorted((str(n), n, one[n], two[n]) for n in range(100))
    for s in (0, 40, 80):
        keys = [(a != b, b) for _, _, a, b in rows[s : s + 40]]
        assert keys == sorted(keys)


@pytest.mark.parametrize("name", ["latent_pair_distances", "geometric_pair_distances"])
def test_pairs_are_given_out_by_value(spark, name):
    """A task's pairs come in two ascending runs, so that equal distances are neighbours in a file."""
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 500 * 499 // 2 == len({r[:2] for r in rows})
    for task in {r["task"] for r in rows}:
        keys = [(r[2] != r[3], r[3]) for r in rows if r["task"] == task]
        assert keys == sorted(keys)


@pytest.mark.parametrize("agree", [False, True])
def test_pairs_that_dictionaries_hold_come_first(monkeypatch, agree):
    """As whole numbers in windows of so many different ones; then those with one number outside, by that number."""
    rng = np.random.default_rng(9)
    last = np.rint(rng.normal(3000, 40, 20000)).astype(np.int32)
    first = last + (rng.random(20000) < 0.5 if agree else 1) * np.rint(rng.gamma(2, 60, 20000) + 1).astype(np.int32)
    monkeypatch.setattr(evaluation, "KEPT", 150)
    monkeypatch.setattr(evaluation, "FEW", 20)
    monkeypatch.setattr(evaluation, "SENT", 999)
    ids = pa.array(np.arange(20000))
    batch = pa.RecordBatch.from_arrays([ids, pa.DictionaryArray.from_arrays(pa.array(np.zeros(20000, np.int32)), pa.array(["x"])), pa.array(first / 1e6), pa.array(last / 1e6)], list("ijab"))
    out = pa.Table.from_batches(evaluation._ordered(iter([batch]), 6)).to_pydict()
    place = np.array(out["i"])
    assert sorted(place) == list(range(20000)) and set(out["j"]) == {"x"}
    assert out["a"] == (first[place] / 1e6).tolist() and out["b"] == (last[place] / 1e6).tolist()
    a, b = first[place], last[place]
    dense = next(n for n in range(len(a), 0, -1) if len(set(a[:n])) <= 150 and len(set(b[:n])) <= 150)
    assert dense > (0.25 if agree else 0.4) * len(a)
    # A file's first page decides whether there is a dictionary.
    assert len(set(a[:100])) <= 21 and len(set(b[:100])) <= 21
    assert ((np.diff(a[dense:]) == 0) | (np.diff(b[dense:]) == 0)).mean() > 0.6


def test_numbers_that_agree_fill_the_second_dictionary_first(monkeypatch):
    monkeypatch.setattr(evaluation, "KEPT", 2)
    monkeypatch.setattr(evaluation, "FEW", 1)
    pairs = [(8, 2), (9, 2), (8, 1), (9, 1), (8, 2), (5, 5), (2, 2), (1, 1), (2, 2), (4, 1), (3, 2), (9, 6)]
    first, last = (np.array(x, np.int32) for x in zip(*pairs))
    got = [pairs[k] for k in evaluation._by_value(first, last)]
    assert got == [(8, 2), (8, 2), (8, 1), (9, 1), (9, 2), (3, 2), (4, 1), (1, 1), (2, 2), (2, 2), (5, 5), (9, 6)]


def test_each_tile_of_pairs_has_a_task(spark):
    x = latents(spark, np.arange(400.0).reshape(200, 2))
    rows = evaluation.pair_distances(None, x, block=50, places=6).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 10 and sum(r[1] for r in rows) == 200 * 199 // 2


def test_pairs_of_streamlines_alone(spark):
    rng = np.random.default_rng(8)
    pts = rng.normal(size=(25, 5, 3))
    p, x = lines(spark, *pts), latents(spark, rng.normal(size=(25, 3)), rng.normal(size=(25, 3)))
    both = {(r["i"], r["j"]): (r["hausdorff"], r["mdf"]) for r in evaluation.pair_distances(p, x, block=7).collect()}
    alone = evaluation.pair_distances(p, None, block=7, places=3)
    assert alone.columns == ["i", "j", "hausdorff", "mdf"]
    got = {(r["i"], r["j"]): (r["hausdorff"], r["mdf"]) for r in alone.collect()}
    assert got == {k: (round(h, 3), round(m, 3)) for k, (h, m) in both.items()}


def points_of(spark, labels, z):
    return spark.createDataFrame([(int(n), list(map(float, v))) for n, v in zip(labels, z)], "label int, z_fwd array<double>")


def found_by(df):
    return sorted((r["sid"], r["nth"], r["label"], round(r["distance"], 9)) for r in df.collect())


def test_a_stored_index_reads_few_files(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(14)
    spots = rng.normal(size=(40, 3)) * 100
    z = spots[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 3))
    points = points_of(spark, range(1, 1501), z)
    path = f"file://{tmp_path}/index"
    index.save(points, path, unit=16)
    rows = latents(spark, spots[:1] + rng.normal(size=(20, 3)))
    report = {}
    got = index.search(rows, path, 3, report=report)
    assert found_by(got) == found_by(search.neighbours(rows, points, 3)) and report["spared"] > 0.8
    # Of the points' folders a search reads a few: the plan names them.
    folders = len([f for f in (tmp_path / "index" / "points").iterdir() if f.is_dir()])
    filters = re.findall(r"PartitionFilters: \[[^\]]*part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", got._jdf.queryExecution().executedPlan().toString())
    read = {n for f in filters for n in (f[0] or f[1]).split(",")}
    assert folders > 8 and filters and 0 < len(read) < folders / 2
    for k, radius in ((None, 4.0), (2, 3.0)):
        assert found_by(index.search(rows, path, k, radius)) == found_by(search.neighbours(rows, points, k, radius))


def test_an_index_that_points_come_to_and_go_from(spark, tmp_path):
    rng = np.random.default_rng(15)
    own = index.DynamicIndex(spark, f"file://{tmp_path}/dynamic", base=8)
    rows = latents(spark, rng.integers(-3, 4, (12, 2)))
    live, written, fresh = {}, 0, 1
    for step in range(6):
        n = int(rng.integers(1, 20))
        z = rng.integers(-3, 4, (n, 2)).astype(float)
        own.add(points_of(spark, range(fresh, fresh + n), z))
        live |= dict(zip(range(fresh, fresh + n), z))
        fresh, written = fresh + n, written + n
        if step % 2:
            out = rng.choice(sorted(live), size=min(5, len(live)), replace=False)
            own.remove(points_of(spark, [*out, 999], np.zeros((len(out) + 1, 2))))
            for label in out:
                del live[label]
    brute = search.neighbours(rows, points_of(spark, live, live.values()), 3)
    again = index.DynamicIndex.open(spark, f"file://{tmp_path}/dynamic")
    assert found_by(own.search(rows, 3)) == found_by(brute) == found_by(again.search(rows, 3))
    assert {r["label"] for r in again.points().collect()} == set(live)
    # A point is written again once for each level that it rises.
    assert own.moved <= written * (2 + np.log2(written / own.base + 1)) and all(v.size <= 8 << i for i, v in own.levels.items())
    with pytest.raises(ValueError, match="two points"):
        own.add(points_of(spark, [next(iter(live))], [[0.0, 0.0]]))
    lost = next(n for n in range(1, fresh) if n not in live)
    own.add(points_of(spark, [lost], [[0.5, 0.5]]))
    assert own.search(latents(spark, [[0.5, 0.5]])).first()["label"] == lost
    assert index.DynamicIndex(spark, f"file://{tmp_path}/none").search(rows).count() == 0


def test_turned_grids_see_what_turned_data_show(spark):
    rng = np.random.default_rng(16)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    shift = rng.normal(size=3)
    raw = [np.cumsum(rng.normal(size=(8, 3)), 0) for _ in range(5)]
    straight = {(r["i"], r["j"], r["k"]): r["length"] for r in mapping.voxelise(lines(spark, *raw), 0.7, (0.1, 0.2, 0.3)).collect()}
    affine = np.concatenate([turn * 0.7, (turn @ (np.array([0.1, 0.2, 0.3]) + 0.35) + shift)[:, None]], 1)
    got = {(r["i"], r["j"], r["k"]): r["length"] for r in mapping.voxelise(lines(spark, *(x @ turn.T + shift for x in raw)), affine=affine).collect()}
    assert got.keys() == straight.keys() and all(got[v] == pytest.approx(straight[v]) for v in got)


def test_all_pairs_of_two_groups_equal_pair_by_pair():
    rng = np.random.default_rng(21)
    a, b = rng.normal(size=(9, 6, 3)) + 1e4, rng.normal(size=(40, 6, 3)) + 1e4
    b[3], b[4], b[5] = a[2], a[2][::-1], a[1] + 1e-9
    a[7, 2, 1] = np.nan
    far, mean = geometry.all_pairs(a, b)
    for i in range(len(a)):
        one = np.repeat(a[i : i + 1], len(b), 0)
        assert far[i] == pytest.approx(geometry.hausdorff(one, b), rel=1e-9, abs=0, nan_ok=True)
        assert mean[i] == pytest.approx(geometry.mdf(one, b), rel=1e-9, abs=0, nan_ok=True)
    assert far[2, 3] == mean[2, 3] == mean[2, 4] == 0 and np.isnan(far[7]).all()
    x, y = rng.normal(size=(5, 4)), rng.normal(size=(7, 4))
    y[2], y[3] = x[1], np.inf
    d = evaluation._between(x, y)
    with np.errstate(invalid="ignore"):
        assert d == pytest.approx(np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)), rel=1e-9, abs=0) and d[1, 2] == 0


def test_a_block_of_two_groups_is_not_copied():
    def group(ids, fwd, rev):
        lists = [pa.array([list(map(float, r)) for r in z], pa.list_(pa.float64())) for z in (fwd, rev)]
        return evaluation._Group([pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["sid", "z_fwd", "z_rev"])], "sid")

    rng = np.random.default_rng(4)
    a, b = ([[7, 1, 4], *rng.integers(0, 3, (2, 3, 2))], [[3, 9], *rng.integers(0, 3, (2, 2, 2))])
    (_, _, i, j, turned, d), = evaluation._measured(group(*a), group(*b), False)
    assert i.tolist() == [0, 0, 1, 1, 2, 2] and j.tolist() == [0, 1] * 3 and turned.tolist() == [False, True, True, True, False, True]
    near = lambda u, v: np.linalg.norm(u[:, None] - v[None], axis=2).ravel()
    ways = near(a[1], b[1]), near(a[1], b[2]), near(a[2], b[1]), near(a[2], b[2])
    assert d[1] == pytest.approx(np.min(ways, 0)) and d[0] == pytest.approx(np.minimum(ways[0], np.where(turned, ways[2], ways[1])))
    assert all(x.base is not None for x in d)


def test_moments_where_codes_are_equal():
    x = np.array([[0.0, 2, 4], [0, 1, 2], [3, 4, 2], [1, 6, 8]])
    some, none = evaluation.Moments.of(list(x)), evaluation.Moments.of(list(x[:, 1:]))
    assert (some.n, some.skipped, none.n, none.skipped) == (3, 1, 2, 0)
    assert some.ratio.tolist() == none.ratio.tolist() == [2.5, 5.0]


def test_tiles_are_dealt_evenly(spark):
    x = latents(spark, np.arange(400.0).reshape(200, 2))
    rows = evaluation._tiles(x, "sid", 8).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("tile").alias("n")).collect()
    # 25 groups, 325 tiles.
    assert len(rows) == 40 and {r["n"] for r in rows} <= {8, 9}


def test_round_trips_row_by_row_equal_joined_ones(spark):
    rng = np.random.default_rng(8)
    codec = DctCodec(ModelSpec(latent_dim=9, input_points=8))
    even = geometry.resample(lines(spark, *rng.normal(size=(12, 5, 3)), np.zeros((0, 3))), 8)
    joined = evaluation.reconstruction(even.where("size(points) > 0"), decode(encode(even, codec, resampled=True), codec))
    assert sorted(map(tuple, evaluation.round_trip(even, codec).collect())) == sorted(map(tuple, joined.collect()))
    plan = evaluation.round_trip(even, codec)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_query_goes_to_a_room_once(spark, monkeypatch):
    monkeypatch.setattr(metric, "UNIT", 16)
    monkeypatch.setattr(metric, "ROOM", 16 * 150)
    monkeypatch.setattr(metric, "STRIP", 40)
    tables, keep = [], metric.materialise
    monkeypatch.setattr(metric, "materialise", lambda *a: tables.append(keep(*a)) or tables[-1])
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 16))
    rows = latents(spark, z[:90])
    got = found_by(search.neighbours(rows, points_of(spark, range(1, 401), z), 3, most=0))
    sent = next(t for t in tables if "room" in t.columns)
    # 400 points in 25 units or more, three rooms: nothing is spared in sixteen dimensions.
    assert 90 < sent.count() <= 90 * 3 == sent.select("room").distinct().count() * 90
    monkeypatch.undo()
    assert got == found_by(search.neighbours(rows, points_of(spark, range(1, 401), z), 3))


def test_batches_of_one_split_are_one_order(spark):
    rng = np.random.default_rng(6)
    fwd, rev = rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    lines_ = []
    got = clustering.find_centers(latents(spark, fwd, rev), 0.9, batch_size=20, report=lines_).orderBy("label").collect()
    want = sequential(fwd, rev, 0.9**2, 20, lambda n: 1000)
    assert np.allclose([r["z_fwd"] for r in got], fwd[want]) and len(got) == len(want)
    # Fifteen batches took as many prefixes before.
    assert len(lines_) == 1


@pytest.mark.parametrize("way", ["here", "rounds", "prefixes", "cells", "one by one"])
@pytest.mark.parametrize("limit", [0.5, 0.9])
def test_small_batches_with_splits_are_taken_together(spark, monkeypatch, way, limit):
    rng = np.random.default_rng(8)
    fwd, rev = rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    fwd[40:60], rev[70] = fwd[20:40], fwd[3]
    # The size of a split depends on what is open.
    split = lambda n: 5 if n > 12 else 3
    lines_, small = [], {"rounds": {"here": 0}, "prefixes": {"prefix": 50}, "cells": {"prefix": 90}}.get(way, {})
    if way == "cells":
        monkeypatch.setattr(scoring, "SLICE_NUMBERS", 0)
        monkeypatch.setattr(clustering, "BLOCKS_ONLY", 0)
        monkeypatch.setattr(metric, "UNIT", 16)
    if way == "one by one":
        monkeypatch.setattr(clustering, "TOGETHER", 0)
    got = clustering.find_centers(latents(spark, fwd, rev), limit, batch_size=20, split=split, report=lines_, **small).orderBy("label").collect()
    want = sequential(fwd, rev, limit**2, 20, split)
    assert len(got) == len(want) and [r["label"] for r in got] == list(range(1, len(want) + 1))
    assert np.array_equal([r["z_fwd"] for r in got], fwd[want])
    # Fifteen batches took as many prefixes before.
    assert len(lines_) <= {"prefixes": 4, "cells": 3, "one by one": 15}.get(way, 1)


@pytest.mark.parametrize(("width", "limit", "share"), [(2, 0.02, 0.2), (40, 0.5, 2.0)])
def test_centres_that_touch_rows_are_met_by_boxes(monkeypatch, width, limit, share):
    rng = np.random.default_rng(11)
    x, points = rng.random((6000, width)), rng.random((900, width))
    x[:300] = points[:300] + 0.9 * limit / width**0.5
    x[300] = points[7]
    x[300, 0] += limit  # as far as the limit, but for rounding
    x[301], points[5] = np.nan, np.inf
    met, rough = [], metric._rough
    monkeypatch.setattr(metric, "_rough", lambda a, b: met.append(len(a) * len(b)) or rough(a, b))
    got = metric.touched(x, points, limit * limit)
    fine = np.delete(points, 5, 0)
    want = np.array([(((row - fine) ** 2).sum(1) < limit * limit).any() for row in x])
    assert (got == want).all() and want.any() and not want.all()
    assert sum(met) <= share * len(x) * len(points)
    assert not metric.touched(x, points[:0], 1.0).any()


def test_one_source_is_ranked_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    fwd, rev = rng.normal(size=(200, 2)), rng.normal(size=(200, 2))
    calls, ranked = [], clustering.ranked
    monkeypatch.setattr(clustering, "ranked", lambda *a, **k: calls.append(a[1:]) or ranked(*a, **k))
    for most, rows in ((None, 200), (2, 120)):
        got = clustering.find_centers(latents(spark, fwd, rev), 0.4, batch_size=60, split=lambda n: max(n, 1), max_iteration=most).orderBy("label").collect()
        assert np.array_equal([r["z_fwd"] for r in got], fwd[sequential(fwd[:rows], rev[:rows], 0.16, 60, lambda n: max(n, 1))])
    # Batches and places in them were ranked apart before.
    assert calls == [("sid",), ("sid",)]


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_streamlines_are_resampled_where_they_are_coded(spark, monkeypatch):
    rng = np.random.default_rng(13)
    each = [rng.normal(size=(k, 3)) for k in (3, 40, 1, 7, 90, 2, 5)]
    rows, codec = lines(spark, *each, np.zeros((0, 3))).coalesce(1), DctCodec(ModelSpec(latent_dim=6, input_points=8))
    want = {r["sid"]: (r["z_fwd"], r["z_rev"]) for r in encode(geometry.resample(rows, 8), codec, resampled=True).collect()}
    # A worker for each task, where two stood before.
    assert len(want) == 7 and python_steps(encode(rows, codec)) == 1
    piece = geometry.PIECE
    for most in (piece, 20, 1):
        monkeypatch.setattr(geometry, "PIECE", most)
        for carry in (False, True):
            got = encode(rows, codec, carry=carry).collect()
            assert {r["sid"]: (r["z_fwd"], r["z_rev"]) for r in got} == want
            assert not carry or all(len(r["points"]) == 8 for r in got)
    sizes = pa.array([[0.0] * k for k in (3, 40, 1, 7, 90, 2, 5)])
    monkeypatch.setattr(geometry, "PIECE", 50)
    runs = [(s.start, s.stop) for s in geometry.pieces(sizes, 8)]
    assert runs == [(0, 2), (2, 4), (4, 5), (5, 7)] and list(geometry.pieces(sizes[:0], 8)) == []


def test_round_trips_resample_in_the_task(spark, monkeypatch, tmp_path):
    from fascicle.plans import queries

    rng = np.random.default_rng(14)
    rows, codec = lines(spark, *(rng.normal(size=(k, 3)) for k in (3, 9, 1, 8, 30)), np.zeros((0, 3))), DctCodec(ModelSpec(latent_dim=6, input_points=8))
    key = lambda df: sorted((r["sid"], r["hausdorff"], r["mdf"]) for r in df.collect())
    once = evaluation.round_trip(rows, codec, resampled=False)
    assert python_steps(once) == 1
    assert key(once) == key(evaluation.round_trip(geometry.resample(rows, 8), codec)) and once.count() == 5
    # What the query writes are an order's own points, no longer sixteen for each.
    written, materialise = [], queries.materialise
    monkeypatch.setattr(queries, "materialise", lambda df: written.append(materialise(df)) or written[-1])
    queries.fitted_codec(spark, "/root/testdata/sf0.001").collect()
    assert written[0].selectExpr("min(size(points))").first()[0] < 16


def test_hausdorff_in_strips(monkeypatch):
    rng = np.random.default_rng(15)
    a, b = rng.normal(size=(50, 7, 3)), rng.normal(size=(50, 5, 3))
    a[3, 2, 1] = np.nan
    d = np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(3))
    want = np.maximum(d.min(2).max(1), d.min(1).max(1))
    for most in (1, 100, 1 << 18):
        monkeypatch.setattr(geometry, "CACHED", most)
        assert np.array_equal(geometry.hausdorff(a, b), want, equal_nan=True)
    assert len(geometry.hausdorff(a[:0], b[:0])) == 0
