import gzip
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fascicle.functions.codec import DctCodec, decode, encode, fit, load
from fascicle.operators import clustering
from fascicle.operators.evaluation import reconstruction
from fascicle.operators.geometry import resample
from fascicle.plans import cli
from fascicle.schema import LATENT, STREAMLINE, ModelSpec
from fascicle.sources import binary, images, sink, tracts
from fascicle.streaming import clusters
from fascicle.streaming import scores as stream


def test_fixed_stride(spark, tmp_path):
    spec = ModelSpec(latent_dim=3, dtype="half")
    rng = np.random.default_rng(0)
    data = rng.normal(size=(7, 6)).astype("<f2")
    path = tmp_path / "a.bin"
    path.write_bytes(data.tobytes() + b"xy")  # a partial row at the end
    got = binary.read_latents(spark, str(path), spec).orderBy("sid").collect()
    assert len(got) == 7
    assert np.allclose([r["z_fwd"] + r["z_rev"] for r in got], data.astype(float))
    out = tmp_path / "b.bin"
    binary.write_latents(binary.read_latents(spark, str(path), spec), str(out), spec)
    assert out.read_bytes() == data.tobytes()
    with pytest.raises(FileExistsError):
        binary.write_latents(binary.read_latents(spark, str(path), spec), str(out), spec)
    assert ModelSpec(dtype="unknown").numpy_type == "<f4"


def test_folder_order_and_skip(spark, tmp_path):
    for name in ("b.bin", "a.bin", "c.clc"):
        (tmp_path / name).write_bytes(np.zeros(4, "<f4").tobytes())
    assert [p.rpartition("/")[2] for p, _ in binary.listed(str(tmp_path), ["*.bin", "*.clc"])] == ["a.bin", "b.bin", "c.clc"]
    jobs = binary.pending(spark, ["x"], [str(tmp_path / "a.bin")], skip=True, force=False)
    assert jobs == []
    with pytest.raises(FileExistsError):
        binary.pending(spark, ["x"], [str(tmp_path / "a.bin")], skip=False, force=False)


@pytest.mark.parametrize("ending", ["tck", "vtk"])
def test_tractograms(spark, tmp_path, ending):
    rows = [(0, [(0.0, 1.0, 2.0), (3.0, 4.0, 5.0)]), (1, [(7.0, 8.0, 9.0)]), (2, [])]
    df = spark.createDataFrame(rows, STREAMLINE)
    path = str(tmp_path / f"x.{ending}")
    (tracts.write_tck if ending == "tck" else tracts.write_vtk)(df, path)
    got = [(r["sid"], [tuple(p) for p in r["points"]]) for r in tracts.read_tractograms(spark, path).orderBy("sid").collect()]
    assert got == rows


def test_text_vtk(spark, tmp_path):
    path = tmp_path / "t.vtk"
    path.write_text("# vtk DataFile Version 3.0\nx\nASCII\nDATASET POLYDATA\nPOINTS 3 float\n0 0 0 1 0 0\n1 1 0\nLINES 2 5\n2 0 1\n1 2\n")
    got = tracts.read_tractograms(spark, str(path)).orderBy("sid").collect()
    assert [len(r["points"]) for r in got] == [2, 1]
    path.unlink()
    with pytest.raises(ValueError, match="expected"):
        tracts.read_tractograms(spark, str(tmp_path))


def test_image_file(spark, tmp_path):
    v = spark.createDataFrame([(0, 1, 2, 5.0)], "i int, j int, k int, value double")
    for name in ("a.nii", "a.nii.gz"):
        path = str(tmp_path / name)
        images.write_nifti(v, path, (2, 3, 4), 1.5, (1.0, 2.0, 3.0))
        shape, size, origin = images.read_grid(path)
        assert (shape, size) == ((2, 3, 4), (1.5, 1.5, 1.5)) and np.allclose(origin, (1, 2, 3))
    images.write_nifti(v, path, (2, 3, 4), (1.0, 2.0, 0.5), (1.0, 2.0, 3.0), force=True)
    shape, size, origin = images.read_grid(path)
    assert size == (1.0, 2.0, 0.5) and np.allclose(origin, (1, 2, 3))
    turned = bytearray((tmp_path / "a.nii").read_bytes())
    struct.pack_into("<f", turned, 280, -1.5)
    (tmp_path / "turned.nii").write_bytes(bytes(turned))
    with pytest.raises(ValueError, match="turned"):
        images.read_grid(str(tmp_path / "turned.nii"))
    shape, affine = images.read_affine(str(tmp_path / "turned.nii"))
    assert shape == (2, 3, 4) and np.allclose(affine[:, :3], np.diag([-1.5, 1.5, 1.5]))
    struct.pack_into("<4f", turned, 280, 0, 0, 0, 0)
    (tmp_path / "flat.nii").write_bytes(bytes(turned))
    with pytest.raises(ValueError, match="span"):
        images.read_affine(str(tmp_path / "flat.nii"))
    # A quaternion for half a turn around z.
    struct.pack_into("<2h", turned, 252, 1, 0)
    struct.pack_into("<6f", turned, 256, 0, 0, 1, 5, 6, 7)
    (tmp_path / "quatern.nii").write_bytes(bytes(turned))
    assert np.allclose(images.read_affine(str(tmp_path / "quatern.nii"))[1], [[-1.5, 0, 0, 5], [0, -1.5, 0, 6], [0, 0, 1.5, 7]])


def test_an_image_on_a_turned_template(spark, tmp_path):
    affine = np.array([[0.0, -2.0, 0.0, 3.0], [2.0, 0.0, 0.0, 1.0], [0.0, 0.0, 2.0, 0.0]])
    none = spark.createDataFrame([], "i int, j int, k int, value double")
    images.write_nifti(none, str(tmp_path / "t.nii"), (4, 4, 2), 1.0, (0, 0, 0), affine=affine)
    assert np.allclose(images.read_affine(str(tmp_path / "t.nii"))[1], affine)
    # A line inside voxel (1, 2, 0), whose middle is at (-1, 3, 0).
    tracts.write_tck(spark.createDataFrame([(0, [(-1.5, 3.0, 0.0), (-0.5, 3.0, 0.0)])], STREAMLINE), str(tmp_path / "x.tck"))
    (tmp_path / "s.ano").write_bytes(np.array([2.5], "<f4").tobytes())
    cli.main(["toImg", str(tmp_path / "x.tck"), str(tmp_path / "s.ano"), str(tmp_path / "o.nii"), "--template", str(tmp_path / "t.nii")])
    data = np.frombuffer((tmp_path / "o.nii").read_bytes()[352:], "<f4").reshape((4, 4, 2), order="F")
    assert data[1, 2, 0] == 2.5 and np.count_nonzero(data) == 1


def test_a_stream_is_clustered_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(60, 2))
    rows = [(i, z[i].tolist(), z[i, ::-1].tolist()) for i in range(60)]
    batches = [spark.createDataFrame(rows[s : s + 20], LATENT) for s in (0, 20, 40)]
    want = clustering.find_centers(spark.createDataFrame(rows, LATENT), 0.6, batch_size=20, split=lambda n: 7).orderBy("label").collect()
    folder = f"file://{tmp_path}/state"
    step = clusters.fold(folder, 0.6, split=lambda n: 7)
    for n in (0, 0, 1, 0, 1, 2, 2):  # batches come again
        step(batches[n], n)
    assert clusters.centres(spark, folder).orderBy("label").collect() == want
    # A batch whose table was lost with what was being made of it.
    shutil.rmtree(tmp_path / "state" / "batch-1")
    step(batches[1], 1)
    assert clusters.centres(spark, folder).orderBy("label").collect() == want
    for n in range(3):
        batches[n].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_ = spark.readStream.schema(LATENT).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing to do
        clusters.start(stream_, f"file://{tmp_path}/live", str(tmp_path / "check"), 0.6, once=True).awaitTermination()
    whole = clustering.find_centers(spark.createDataFrame(rows, LATENT), 0.6).orderBy("label").collect()
    assert clusters.centres(spark, f"file://{tmp_path}/live").orderBy("label").collect() == whole


def test_without_a_command_help_is_shown(capsys):
    cli.main([])
    assert "findClusterCenters" in capsys.readouterr().out


def test_commands(spark, tmp_path):
    rng = np.random.default_rng(0)
    lines = [(i, [tuple(map(float, p)) for p in np.cumsum(rng.normal(size=(12, 3)), 0)]) for i in range(12)]
    p = lambda name: str(tmp_path / name)
    tracts.write_tck(spark.createDataFrame(lines, STREAMLINE), p("in.tck"))
    model = ["-m", "-", "16", "12", "float", "1.0"]
    cli.main(["encode", p("in.tck"), p("in.bin"), *model])
    cli.main(["findClusterCenters", p("in.bin"), p("c.clc"), "-d", "4", *model])
    cli.main(["score", p("in.bin"), p("c.clc"), p("s.ano"), p("s.clb"), *model])
    cli.main(["toTrack", p("in.tck"), p("out.vtk"), "-s", p("s.ano"), "-l", p("s.clb")])
    cli.main(["toImg", p("in.tck"), p("s.ano"), p("out.nii.gz"), "--voxDim", "2", "--medFilt", "--aveFilt"])
    cli.main(["decode", p("in.bin"), p("back.vtk"), *model])
    cli.main(["modelTest", p("in.tck"), *model])
    assert (tmp_path / "s.ano").stat().st_size == 48 and (tmp_path / "s.clb").stat().st_size == 48
    assert tracts.read_tractograms(spark, p("out.vtk")).count() == 12
    with pytest.raises(FileExistsError):
        cli.main(["encode", p("in.tck"), p("in.bin"), *model])
    cli.main(["encode", p("in.tck"), p("in.bin"), "-s", *model])


def test_a_fitted_codec(spark, tmp_path):
    rng = np.random.default_rng(2)
    wave = lambda: np.stack([np.sin(np.linspace(0, 6, 40) * rng.uniform(1, 3) + rng.uniform(0, 6)) * rng.normal() for _ in range(3)], 1) + rng.normal(size=3)
    rows = [(i, [tuple(map(float, p)) for p in wave()]) for i in range(160)]
    p = lambda name: str(tmp_path / name)
    tracts.write_tck(spark.createDataFrame(rows[:120], STREAMLINE), p("train.tck"))
    cli.main(["fit", p("train.tck"), p("model.npz"), "--points", "32", "--latent", "12"])
    spec = ModelSpec(12, 32)
    fitted = load(p("model.npz"), spec)
    held_out = resample(spark.createDataFrame(rows[120:], STREAMLINE), 32)
    codes = encode(held_out, fitted, resampled=True)
    errors = {}
    for name, codec in (("fitted", fitted), ("cosine", DctCodec(spec))):
        back = decode(encode(held_out, codec, resampled=True), codec)
        errors[name] = reconstruction(held_out, back).agg(F.avg("mdf")).first()[0]
    assert errors["fitted"] < errors["cosine"]
    # The reversed code has the same numbers but for their signs, the same signs for all.
    f, r = (np.array([row[c] for row in codes.collect()]) for c in ("z_fwd", "z_rev"))
    signs = np.sign((f * r).sum(0))
    assert np.allclose(r, f * signs) and set(signs) == {1.0, -1.0}
    model = ["-m", p("model.npz"), "32", "12", "float"]
    cli.main(["encode", p("train.tck"), p("a.bin"), *model])
    cli.main(["decode", p("a.bin"), p("a.vtk"), *model])
    assert tracts.read_tractograms(spark, p("a.vtk")).count() == 120
    with pytest.raises(ValueError, match="not 13 from 32"):
        cli.main(["encode", p("train.tck"), p("b.bin"), "-m", p("model.npz"), "32", "13", "float"])
    with pytest.raises(ValueError, match="no model"):
        cli.main(["encode", p("train.tck"), p("b.bin"), "-m", p("train.tck"), "32", "12", "float"])
    with pytest.raises(FileNotFoundError):
        cli.main(["encode", p("train.tck"), p("b.bin"), "-m", p("model.pt"), "32", "12", "float"])
    with pytest.raises(ValueError, match="no streamlines"):
        fit(held_out.where("false"), spec)


@pytest.mark.parametrize("model", [[], ["-m", "-", "256", "64", "double"]])
def test_commands_of_the_default_shape(spark, tmp_path, model):
    """256 points and 64 numbers, which three axes don't divide, with and without a model."""
    rng = np.random.default_rng(1)
    lines = [(i, [tuple(map(float, p)) for p in np.cumsum(rng.normal(size=(30, 3)), 0)]) for i in range(20)]
    p = lambda name: str(tmp_path / name)
    tracts.write_vtk(spark.createDataFrame(lines, STREAMLINE), p("in.vtk"))
    width = 8 if model else 4
    cli.main(["encode", "-f", p("in.vtk"), p("in.bin"), *model])
    assert (tmp_path / "in.bin").stat().st_size == 20 * 2 * 64 * width
    cli.main(["decode", "-f", p("in.bin"), p("dec.vtk"), "-b", "7", *model])
    cli.main(["findClusterCenters", "-f", p("in.bin"), p("c.clc"), "--maxDist", "20" if model else "1.6", *model])
    centres = (tmp_path / "c.clc").stat().st_size // (2 * 64 * 4)
    assert 0 < centres <= 20
    cli.main(["decode", "-f", p("c.clc"), p("c.vtk"), *(["-m", "-", "256", "64", "float"] if model else [])])
    cli.main(["score", "-f", p("in.bin"), p("c.clc"), p("s.ano"), p("s.clb"), *model])
    cli.main(["toTrack", "-f", p("in.vtk"), "-s", p("s.ano"), "-l", p("s.clb"), p("mapped.vtk")])
    cli.main(["toImg", "-f", p("in.vtk"), p("s.ano"), p("out.nii.gz")])
    cli.main(["modelTest", p("in.vtk"), *(model[1:] or ["-", "256", "64", "float"])])
    back = tracts.read_tractograms(spark, p("dec.vtk")).orderBy("sid").collect()
    assert len(back) == 20 and all(len(r["points"]) == 256 for r in back) and tracts.read_tractograms(spark, p("c.vtk")).count() == centres
    for r, (_, points) in zip(back, lines):
        # Ends and course come back: 21 coefficients of an axis say it to a fraction of a step.
        got, far = np.array([tuple(x) for x in r["points"]]), np.array(points)
        assert np.abs(got[[0, -1]] - far[[0, -1]]).max() < 2 and np.linalg.norm(got[:, None] - far[None], axis=2).min(0).max() < 2
    scores = np.fromfile(p("s.ano"), "<f4")
    assert len(scores) == 20 and np.isfinite(scores).all() and (scores < (20 if model else 1.6)).all()


def test_shapes_must_agree(spark, tmp_path):
    x = spark.createDataFrame([(0, [1.0] * 12, [1.0] * 12)], LATENT)
    with pytest.raises(ValueError, match="numbers"):
        binary.write_latents(x, str(tmp_path / "a.bin"), ModelSpec(15, 16))
    with pytest.raises(Exception, match="numbers to a latent"):
        decode(x, DctCodec(ModelSpec(15, 16))).collect()
    with pytest.raises(ValueError, match="no latents"):
        DctCodec(ModelSpec(64, 16))
    with pytest.raises(ValueError, match="verbose"):
        cli.main(["encode", "a", "b", "-v", "loud"])
    with pytest.raises(ValueError, match="a model is given"):
        cli.main(["modelTest", "a", "b", "256"])
    codec = cli.codec_of(cli.parser().parse_args(["encode", "a", "b", "-m", "fascicle.functions.codec:DctCodec", "32", "12", "float"]))
    assert isinstance(codec, DctCodec) and codec.spec.input_points == 32


def test_random_batches_of_a_command(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    rows = [(i, [float(i)] * 3, [float(i)] * 3) for i in range(40)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        binary.write_latents(spark.createDataFrame(rows[k * 20 : k * 20 + 20], LATENT), p(f"in/{k}.bin"), ModelSpec(3, 4))
    run = ["findClusterCenters", p("in"), p("c.clc"), "-d", "0.5", "-m", "-", "4", "3", "float", "-f", "-r", "-b", "10", "--miniBatchSize", "5"]
    cli.main(run)
    got = np.fromfile(p("c.clc"), "<f4").reshape(-1, 6)
    assert 5 <= len(got) <= 40 and len(np.unique(got[:, 0])) == len(got)
    with pytest.raises(ValueError, match="batch"):
        cli.main([*run, "--miniBatchSize", "50"])
    # A folder's scores are written file by file.
    cli.main(["score", p("in"), p("c.clc"), p("s.ano"), p("s.clb"), "-m", "-", "4", "3", "float"])
    scores = np.fromfile(p("s.ano"), "<f4")
    want = np.abs(np.arange(40)[:, None] - got[:, 0][None]).min(1) * np.sqrt(3)
    assert np.allclose(scores, want)


def test_stream(spark, tmp_path):
    x = spark.createDataFrame([(i, [float(i), 0.0], [float(i), 1.0]) for i in range(5)], LATENT)
    x.write.parquet(str(tmp_path / "in"))
    centres = spark.createDataFrame([(1, [0.0, 0.0], [0.0, 0.0])], "label int, z_fwd array<double>, z_rev array<double>")
    q = stream.start(stream.score_stream(stream.latent_stream(spark, str(tmp_path / "in")), centres), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    assert q.awaitTermination(120)
    assert sorted(r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def awkward_lines(n=60):
    rng = np.random.default_rng(3)
    return [(i, [tuple(map(float, p)) for p in rng.normal(size=(int(rng.integers(1, 9)), 3)).astype("f4")]) for i in range(n)]


@pytest.mark.parametrize("ending", ["tck", "vtk"])
@pytest.mark.parametrize("size", [24, 60, 100, 333, 1000, 1 << 20])
def test_a_tractogram_in_many_ranges(spark, tmp_path, ending, size):
    rows = awkward_lines()
    path = str(tmp_path / f"x.{ending}")
    (tracts.write_tck if ending == "tck" else tracts.write_vtk)(spark.createDataFrame(rows, STREAMLINE).repartition(5), path)
    whole = (tracts.parse_tck if ending == "tck" else tracts.parse_vtk)((tmp_path / f"x.{ending}").read_bytes())
    assert np.array_equal(np.diff(whole[1]), [len(p) for _, p in rows])
    df = tracts.read_tractograms(spark, path, range_bytes=size)
    assert df.rdd.getNumPartitions() > 1 or size > 1000
    got = {r["sid"]: [tuple(p) for p in r["points"]] for r in df.collect()}
    assert got == dict(rows)


def test_ends_and_gaps_of_tck(spark, tmp_path):
    nan, inf = [np.nan] * 3, [np.inf] * 3
    head = "mrtrix tracks\ndatatype: Float32LE\nfile: . 60\nEND\n".ljust(60).encode()
    body = [[1, 1, 1], nan, nan, [2, 2, 2], [3, 3, 3], nan, [4, 4, 4], [np.nan, 1, 1], nan, [5, 5, 5]]
    for tail, name in (([inf, [6, 6, 6], nan], "stopped"), ([], "cut")):
        path = tmp_path / f"{name}.tck"
        path.write_bytes(head + np.array(body + tail, "<f4").tobytes())
        want = np.diff(tracts.parse_tck(path.read_bytes())[1]).tolist()
        for size in (24, 36, 48, 1000):
            got = {r["sid"]: len(r["points"]) for r in tracts.read_tractograms(spark, str(path), range_bytes=size).collect()}
            assert got == dict(enumerate(want)) and want == [1, 0, 2, 2]


def test_vtk_with_points_in_another_order(spark, tmp_path):
    xyz = np.arange(15, dtype=">f4").reshape(5, 3)
    cells = np.array([2, 4, 0, 3, 1, 2, 3], ">i4")
    path = tmp_path / "o.vtk"
    path.write_bytes(b"# vtk DataFile Version 3.0\nx\nBINARY\nDATASET POLYDATA\nPOINTS 5 float\n" + xyz.tobytes() + b"\nLINES 2 7\n" + cells.tobytes() + b"\n")
    got = {r["sid"]: [p[0] for p in r["points"]] for r in tracts.read_tractograms(spark, str(path), range_bytes=8).collect()}
    assert got == {0: [12.0, 0.0], 1: [3.0, 6.0, 9.0]}


def test_a_sink_without_positions(spark, tmp_path, monkeypatch):
    rows = awkward_lines()
    df = spark.createDataFrame(rows, STREAMLINE).repartition(4)
    tracts.write_vtk(df, str(tmp_path / "a.vtk"))
    monkeypatch.setattr(tracts, "write", lambda *a: sink.write(*a, positions=False))
    tracts.write_vtk(df, str(tmp_path / "b.vtk"))
    assert (tmp_path / "a.vtk").read_bytes() == (tmp_path / "b.vtk").read_bytes()
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a.vtk", "b.vtk"]


@pytest.mark.parametrize("positions", [True, False])
def test_a_failed_task_leaves_no_file(spark, tmp_path, positions):
    rows = spark.range(30).repartition(3)
    good = rows.select((4 * F.col("id")).alias("at"), F.encode(F.format_string("%04d", "id"), "US-ASCII").alias("data"))
    bad = good.withColumn("data", F.when(F.col("at") == 40, F.raise_error("lost").cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        sink.write(bad, str(tmp_path / "a"), 120, [], positions)
    assert list(tmp_path.iterdir()) == []
    sink.write(good, str(tmp_path / "a"), 124, [(120, b"end.")], positions)
    assert (tmp_path / "a").read_bytes() == b"".join(b"%04d" % i for i in range(30)) + b"end."
    with pytest.raises(ValueError, match="3 numbers"):
        binary.write_latents(spark.createDataFrame([(0, [1.0, 2.0], [3.0])], LATENT), str(tmp_path / "b"), ModelSpec(latent_dim=2))


def test_images_by_slabs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    shape = (7, 6, 5)
    v = {tuple(map(int, p)): float(np.float32(rng.normal())) for p in rng.integers(0, shape, (60, 3))}
    df = spark.createDataFrame([(*p, x) for p, x in v.items()] + [(7, 0, 0, 1.0), (-1, 0, 0, 1.0)], "i int, j int, k int, value double")
    monkeypatch.setattr(images, "SLAB", 37)
    want = np.zeros(shape, "<f4")
    for p, x in v.items():
        want[p] = x
    for name in ("a.nii", "a.nii.gz"):
        images.write_nifti(df, str(tmp_path / name), shape, 1.0, (0.0, 0.0, 0.0))
        data = (tmp_path / name).read_bytes()
        data = gzip.decompress(data) if name.endswith("gz") else data
        assert data[352:] == want.tobytes(order="F") and len(data) == 352 + 4 * 210
