"""Command line: score a cube, detect on a source of frames, evaluate a score map, prepare a labelled dataset."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CubeShape, DetectionParams, detector
from .operators import detect as D
from .operators import evaluate, scoring
from .operators.library import Library
from .operators.moments import build_statistics, moments
from .plans import scenes
from .session import local_session, ship_package
from .sources import envi, library_csv, mosaic, raster, synthetic


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="prismlake")
    parser.add_argument("--cores", default="*")
    commands = parser.add_subparsers(dest="command", required=True)

    def common(p: argparse.ArgumentParser) -> None:
        p.add_argument("--detector", default="sam")
        p.add_argument("--threshold", type=float)
        p.add_argument("--nms", type=int, default=2)
        p.add_argument("--max-detections", type=int, default=4096)
        p.add_argument("--loading", type=float, default=1e-6)
        p.add_argument("--variant", default="auto", help="sql, arrow or auto")
        p.add_argument("--dump-score")

    score = commands.add_parser("score", help="one cube")
    score.add_argument("--cube", required=True)
    score.add_argument("--library", required=True)
    score.add_argument("--target")
    score.add_argument("--dump-target")
    score.add_argument("--print", type=int, default=0, dest="show")
    common(score)

    frames = commands.add_parser("detect", help="a source of frames")
    frames.add_argument("--source", choices=("synthetic", "envi", "mosaic"), default="synthetic")
    frames.add_argument("--envi")
    frames.add_argument("--hot-dir")
    frames.add_argument("--mosaic", type=int, default=4, help="period of the mosaic")
    frames.add_argument("--resident", type=int, default=0, help="only the first so many frames of a folder")
    for name, kind, default in (("height", int, 96), ("width", int, 128), ("bands", int, 24), ("targets", int, 3), ("noise", float, 0.002), ("frames", int, 4)):
        frames.add_argument(f"--{name}", type=kind, default=default)
    frames.add_argument("--library")
    frames.add_argument("--csv")
    frames.add_argument("--print-detections", type=int, default=0, dest="show")
    common(frames)

    judge = commands.add_parser("eval", help="a score map against a mask")
    judge.add_argument("scores")
    judge.add_argument("truth")
    judge.add_argument("--width", type=int, required=True)
    judge.add_argument("--height", type=int, required=True)
    judge.add_argument("--target", type=int, default=1)
    judge.add_argument("--threshold", type=float, default=0.10)

    ready = commands.add_parser("prepare", help="clean scenes, masks and a library of class means")
    ready.add_argument("--data-dir", required=True)
    ready.add_argument("--scene", action="append")
    ready.add_argument("--keep-noisy-bands", action="store_true")
    ready.add_argument("--keep-damaged-row", action="store_true")
    return parser


def _params(args, name: str) -> DetectionParams:
    traits = detector(name)
    threshold = args.threshold if args.threshold is not None else 0.10
    return DetectionParams(threshold, args.nms, args.max_detections, traits.polarity)


def _report(found: DataFrame, library: Library, spark: SparkSession, show: int) -> None:
    for r in D.per_target(found, library.frame(spark)).orderBy("target_id").collect():
        print(f"{r['name']:>24} {r['detections']}")
    for r in D.first_detections(found, show).collect() if show else ():
        print(f"frame {r['frame_index']} x {r['x']} y {r['y']} target {r['target']} score {r['score']:.6f}")


def score(spark: SparkSession, args) -> int:
    header = envi.read_header(args.cube)
    envi.register(spark)
    pixels = spark.read.format("prismlake_envi").load(args.cube)
    library = library_csv.read_library(spark, args.library)
    library = library.only(args.target) if args.target else library
    scores, found = scenes.score_cube(pixels, library, args.detector, None, _params(args, args.detector), args.loading, args.variant)
    scores = scores.persist()
    _report(found, library, spark, args.show)
    for path, column, kind in ((args.dump_score, "score", "f32"), (args.dump_target, "target", "i32")):
        if path:
            raster.write_raster(scores, column, kind, path, header.shape.pixels)
    return 0


def _source(spark: SparkSession, args) -> tuple[DataFrame, CubeShape, Library | None]:
    if args.source == "synthetic":
        synthetic.register(spark)
        scene = synthetic.Scene(args.height, args.width, args.bands, args.targets, noise=args.noise)
        options = {k: str(getattr(args, k)) for k in ("height", "width", "bands", "targets", "noise", "frames")}
        return spark.read.format("prismlake_synthetic").options(**options).load(), scene.shape, synthetic.library(scene)
    if args.source == "envi":
        envi.register(spark)
        shape = envi.read_header(envi.header_paths(args.envi)[0]).shape
        return spark.read.format("prismlake_envi").option("max_resident", args.resident).load(args.envi), shape, None
    pixels = mosaic.read_mosaic(spark, args.hot_dir, args.mosaic, args.bands)
    ends = pixels.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    return pixels, CubeShape(ends["y"] + 1, ends["x"] + 1, args.bands), None


def detect(spark: SparkSession, args) -> int:
    pixels, shape, library = _source(spark, args)
    library = library_csv.read_library(spark, args.library) if args.library else library
    if library is None:
        raise ValueError("this source needs a library")
    library.require_bands(shape.bands)
    traits = detector(args.detector)
    stats = build_statistics(moments(pixels), library, args.loading) if traits.needs_statistics else None
    scores = scoring.score(pixels, args.detector, library, stats, strategy=args.variant).persist()
    found = D.detect(scores, _params(args, args.detector))
    _report(found, library, spark, args.show)
    if args.csv:
        counted = found.groupBy("frame_index").agg(F.max("detections_found").alias("detections"), F.count(F.lit(1)).alias("kept"))
        raster.write_frame_csv(scores.select("frame_index").distinct().join(counted, "frame_index", "left").na.fill(0).orderBy("frame_index"), args.csv)
    if args.dump_score:
        last = scores.agg(F.max("frame_index")).first()[0]
        raster.write_raster(scores.where(F.col("frame_index") == last), "score", "f32", args.dump_score, shape.pixels)
    return 0


def judge(spark: SparkSession, args) -> int:
    pixels = args.width * args.height
    scores = raster.read_raster(spark, args.scores, "f32", pixels).withColumnRenamed("value", "score")
    truth = raster.truth_from_raster(raster.read_raster(spark, args.truth, "u8", pixels))
    out = scenes.evaluate_scores(scores, truth, args.target, args.threshold)
    auc = out["auc"].first()
    if not auc["positives"]:
        print(f"class {args.target} is absent from {args.truth}", file=sys.stderr)
        return 1
    c = out["confusion"].first()
    print(f"ROC AUC {auc['auc']:.4f}  precision {c['precision']:.4f}  recall {c['recall']:.4f}  f1 {c['f1']:.4f}  tp {c['tp']}  fp {c['fp']}  fn {c['fn']}  tn {c['tn']}")
    for r in out["classes"].orderBy("label").collect():
        print(f"{scenes.CLASSES.get(r['label'], r['label']):>24} n {r['n']}  mean {r['mean']:.4f}  least {r['least']:.4f}  gap {r['gap']:+.4f}")
    return 1 if auc["auc"] != auc["auc"] else 0


def prepare(spark: SparkSession, args) -> int:
    """Reads <data-dir>/data/*.hdr and <data-dir>/anno/*.npz; writes cleaned cubes and masks to <data-dir>/clean, and the library."""
    envi.register(spark)
    out = os.path.join(args.data_dir, "clean")
    os.makedirs(out, exist_ok=True)
    done, waves = [], None
    for path in envi.header_paths(os.path.join(args.data_dir, "data")):
        scene = os.path.splitext(os.path.basename(path))[0]
        notes = os.path.join(args.data_dir, "anno", f"{scene}.npz")
        if args.scene and scene not in args.scene:
            continue
        if not os.path.exists(notes):
            print(f"{scene}: no annotation, left out", file=sys.stderr)
            continue
        header = envi.read_header(path)
        annotation = raster.read_annotations(spark, notes)
        if annotation.count() != header.shape.pixels or annotation.agg(F.max("x")).first()[0] != header.shape.width - 1:
            print(f"{scene}: the annotation has another size, left out", file=sys.stderr)
            continue
        pixels = spark.read.format("prismlake_envi").load(path)
        clean = scenes.prepare_scene(pixels, annotation, scene, header.shape.bands, header.shape.width, args.keep_noisy_bands, args.keep_damaged_row).persist()
        kept = range(header.shape.bands) if args.keep_noisy_bands else scenes.good_bands(header.shape.bands, scene)
        own = tuple(header.wavelengths_nm[b] for b in kept) if header.wavelengths_nm else ()
        waves = waves or own
        n = clean.count()
        shape = CubeShape(n // header.shape.width, header.shape.width, len(kept))
        envi.write_cube(os.path.join(out, scene), clean, shape, own)
        raster.write_raster(clean, "label", "u8", os.path.join(out, f"{scene}_gt.u8"), n)
        done.append(clean)
    if not done:
        raise ValueError("no annotated pixels found")
    rows = scenes.prepared_library(done, spark).orderBy("label").collect()
    if not rows:
        raise ValueError("no annotated pixels found")
    import numpy as np

    library_csv.write_library(Library(tuple(r["name"] for r in rows), np.array([r["values"] for r in rows], dtype=np.float32), waves or None), os.path.join(args.data_dir, "targets.csv"))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return {"score": score, "detect": detect, "eval": judge, "prepare": prepare}[args.command](ship_package(spark or local_session(args.cores)), args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
