"""The command line: fit, encode, decode, findClusterCenters, score, toTrack, toImg, modelTest.

``python -m fascicle.plans.cli COMMAND ...``. Failures raise, so the exit code tells. Without a command the help is shown.
"""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import DataFrame, SparkSession

from fascicle.functions.codec import Codec, DctCodec, decode, encode, fit, load
from fascicle.operators import clustering, evaluation, geometry, mapping, scoring
from fascicle.schema import ModelSpec
from fascicle.sources import binary, images, tracts
from fascicle.sources.sink import refuse


#: Without a model: 256 points, latents of 64 32-bit floats, and its distance scaler.
DEFAULT = ModelSpec(64, 256, "float", 0.08)
#: Names of verbosity levels, and the log levels they stand for.
VERBOSITY = {"quite": "OFF", "fatal": "FATAL", "error": "ERROR", "warn": "WARN", "info": "INFO", "detail": "DEBUG", "debug": "DEBUG"}


def codec_of(args) -> Codec:
    """The cosine codec without a model or for ``-``; what a model of the form ``package.module:factory`` makes of the specification; or the fitted codec that a file holds. A path that is no such file is refused."""
    spec, given = spec_of(args), model_of(args)
    module, _, factory = (given[0] if given else "").partition(":")
    if factory and not os.path.exists(given[0]):
        return getattr(importlib.import_module(module), factory)(spec)
    return load(given[0], spec) if given and given[0] != "-" else DctCodec(spec)


def model_of(args) -> list[str]:
    return args.model or getattr(args, "given", [])


def spec_of(args) -> ModelSpec:
    given = model_of(args)
    if not given:
        return DEFAULT
    if len(given) not in (4, 5):
        raise ValueError("a model is given by its path, points, latent size and type, and maybe a distance scaler")
    _, points, latent, dtype, *scaler = given
    return ModelSpec(int(latent), int(points), dtype, float(scaler[0]) if scaler else 1.0)


def run_encode(spark: SparkSession, args) -> None:
    codec = codec_of(args)
    for i, o in _jobs(spark, args, ["*.tck", "*.vtk"], ".bin"):
        binary.write_latents(encode(tracts.read_tractograms(spark, i), codec), o, codec.spec, args.force)


def run_decode(spark: SparkSession, args) -> None:
    codec = codec_of(args)
    for i, o in _jobs(spark, args, ["*.bin", "*.clc"], ".tck" if args.tck else ".vtk"):
        out = decode(binary.read_latents(spark, i, codec.spec, True), codec)
        (tracts.write_tck if o.lower().endswith(".tck") else tracts.write_vtk)(out, o, force=args.force)


def run_centers(spark: SparkSession, args) -> None:
    spec = spec_of(args)
    latents = binary.read_latents(spark, args.input, spec)
    if args.batchSize < 1 or args.miniBatchSize < 1 or args.randomize and args.miniBatchSize > args.batchSize:
        raise ValueError("batch sizes are positive, and a mini batch is no larger than a batch")
    out = clustering.find_centers(
        latents, args.maxDist, spec.scaler, args.batchSize, source="src", max_iteration=args.maxIteration or None, shuffle_seed=args.seed if args.shuffle else None,
        random_seed=args.seed if args.randomize else None, mini_batch=args.miniBatchSize,
    )
    binary.write_centres(out, args.output, args.force)


def run_score(spark: SparkSession, args) -> None:
    spec = spec_of(args)
    latents = binary.read_latents(spark, args.input, spec)
    out = scoring.score(latents, binary.read_centres(spark, args.centers, spec), spec.scaler)
    binary.write_scores(out, args.output, args.force)
    if args.labels:
        binary.write_labels(out, args.labels, args.force)


def run_track(spark: SparkSession, args) -> None:
    scores = binary.read_scores(spark, args.score) if args.score else None
    labels = binary.read_labels(spark, args.label) if args.label else None
    out = mapping.annotate(tracts.read_tractograms(spark, args.input), scores, labels)
    tracts.write_vtk(out, args.output, ({"score": "float"} if scores else {}) | ({"label": "int"} if labels else {}), args.force)


def run_image(spark: SparkSession, args) -> None:
    lines = tracts.read_tractograms(spark, args.input)
    weights = binary.read_scores(spark, args.weight, "weight") if args.weight else None
    affine = None
    if args.template:
        shape, affine = images.read_affine(args.template)
        size, origin = 1.0, (0.0, 0.0, 0.0)
    else:
        box, size = geometry.bounding_box(lines).first(), args.voxDim
        origin = tuple(float(box[f"min_{c}"]) for c in "xyz")
        shape = tuple(int((box[f"max_{c}"] - box[f"min_{c}"]) // size) + 1 for c in "xyz")
    out = mapping.to_image(lines, binary.read_scores(spark, args.score), size, args.thresh, weights, args.medFilt, args.aveFilt, origin, shape, affine=affine)
    images.write_nifti(out, args.output, shape, size, origin, args.force, affine)


def run_fit(spark: SparkSession, args) -> None:
    refuse(args.output, args.force)
    fit(tracts.read_tractograms(spark, args.input), ModelSpec(args.latent, args.points)).save(args.output)


def run_test(spark: SparkSession, args) -> DataFrame:
    out = evaluation.model_test(tracts.read_tractograms(spark, args.input), codec_of(args))
    out.show(truncate=False)
    return out


def _jobs(spark, args, patterns: list[str], ending: str) -> list[tuple[str, str]]:
    if os.path.isdir(args.input):
        inputs = [p for p, _ in binary.listed(args.input, patterns)]
        os.makedirs(args.output, exist_ok=True)
        outputs = [os.path.join(args.output, os.path.splitext(os.path.basename(p))[0] + ending) for p in inputs]
    else:
        inputs, outputs = [args.input], [args.output]
    return binary.pending(spark, inputs, outputs, args.skip, args.force)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("fascicle", description=__doc__)
    sub = top.add_subparsers(dest="command")

    def command(name, run, *positional, model=True):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for a in positional:
            p.add_argument(a.rstrip("?"), **({"nargs": "?"} if a.endswith("?") else {}))
        p.add_argument("-f", "--force", action="store_true")
        p.add_argument("-n", "--numberOfThreads", type=int, default=0)
        p.add_argument("-v", "--verbose", default="info", help=", ".join(VERBOSITY))
        if model:
            p.add_argument("-c", "--useCPU", action="store_true", help="accepted; there is no other device")
            p.add_argument("-m", "--model", nargs="+", default=[], help="path or package.module:factory, points, latent size, type[, distance scaler]; - is the cosine codec")
        return p

    for name, run in (("encode", run_encode), ("decode", run_decode)):
        p = command(name, run, "input", "output")
        p.add_argument("-s", "--skip", action="store_true")
        p.add_argument("-t", "--tck", action="store_true")
        p.add_argument("-b", "--batchSize", type=int, default=512, help="rows that are coded at once")
    p = command("fit", run_fit, "input", "output", model=False)
    p.add_argument("--points", type=int, default=DEFAULT.input_points)
    p.add_argument("--latent", type=int, default=DEFAULT.latent_dim)
    p = command("findClusterCenters", run_centers, "input", "output")
    p.add_argument("-d", "--maxDist", type=float, required=True)
    p.add_argument("-b", "--batchSize", type=int, default=1_000_000)
    p.add_argument("-i", "--maxIteration", type=int, default=0)
    p.add_argument("-s", "--shuffle", action="store_true")
    p.add_argument("-r", "--randomize", action="store_true")
    p.add_argument("--miniBatchSize", type=int, default=1000)
    p.add_argument("--seed", type=int, default=0)
    command("score", run_score, "input", "centers", "output", "labels?")
    p = command("toTrack", run_track, "input", "output", model=False)
    p.add_argument("-s", "--score")
    p.add_argument("-l", "--label")
    p = command("toImg", run_image, "input", "score", "output", model=False)
    p.add_argument("--weight")
    p.add_argument("--thresh", type=float, default=0.0)
    p.add_argument("--medFilt", action="store_true")
    p.add_argument("--aveFilt", action="store_true")
    p.add_argument("--template")
    p.add_argument("--voxDim", type=float, default=1.0)
    p = command("modelTest", run_test, "input")
    p.add_argument("given", nargs="*", default=[], help="the model, as for -m")
    p.add_argument("-b", "--batchSize", type=int, default=512, help="rows that are coded at once")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return
    cores = args.numberOfThreads or "*"
    spark = SparkSession.builder.master(f"local[{cores}]").appName("fascicle").getOrCreate() if not SparkSession.getActiveSession() else SparkSession.getActiveSession()
    if args.verbose not in VERBOSITY:
        raise ValueError(f"verbose is one of {', '.join(VERBOSITY)}")
    if hasattr(args, "model"):
        spec_of(args)  # refuses an incomplete model before anything is read
    if args.verbose != "info":
        spark.sparkContext.setLogLevel(VERBOSITY[args.verbose])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows)
    if args.run in (run_encode, run_decode, run_test):
        spark.conf.set(rows, max(1, args.batchSize))
    try:
        args.run(spark, args)
    finally:
        spark.conf.set(rows, usual)


if __name__ == "__main__":
    main()
