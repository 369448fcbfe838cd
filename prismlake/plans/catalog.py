"""Registered queries over the driver's tables, with their SQL.

embeddings stand for the pixels of one frame (p = vec_id, 25 to a row, label as
truth), lineitem for four-band pixels in number, events for results of frames.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CubeShape, DetectionParams, Polarity
from ..operators import detect, evaluate, layout, library, moments, scoring
from ..session import ship_package
from ..sources.placed import local_path

WIDTH = 25
#: Angles to the nearest class mean lie about 1.35; a tenth of the pixels passes LOW and HIGH, a third WIDE.
LOW, HIGH, WIDE = 1.25, 1.44, 1.32
CAP = 7
#: lineitem's four bands, each brought to a range of about one.
SCALE = (("l_quantity", 50.0), ("l_extendedprice", 100000.0), ("l_discount", 0.1), ("l_tax", 0.08))
LOADING = 1e-3
#: The same for the pixels' 64 bands.
FULL_LOADING = 1e-6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.lit(0).cast("long").alias("frame_index"), F.col("vec_id").alias("p"), F.floor(F.col("vec_id") / WIDTH).cast("int").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x"), F.col("embedding").alias("spectrum"), F.col("label").cast("short").alias("label"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.array(*[(F.col(c) / s).cast("double") for c, s in SCALE]).alias("spectrum"), "l_returnflag")


def _class_library(spark: SparkSession, sf_dir: str) -> library.Library:
    return moments.class_library(pixels(spark, sf_dir))


def _item_library(spark: SparkSession, sf_dir: str) -> library.Library:
    rows = moments.class_means(items(spark, sf_dir), "l_returnflag").orderBy("label").collect()
    return library.Library(tuple(r["label"] for r in rows), np.array([r["values"] for r in rows]))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sam_best(pixels(spark, sf_dir), _class_library(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# Detection


def class_mean_library(spark, sf_dir):
    means = moments.class_means(pixels(spark, sf_dir))
    return means.select(F.col("label").cast("long").alias("label"), "n", F.posexplode("values").alias("band", "value")).select("label", "n", F.col("band").cast("long").alias("band"), F.round("value", 6).alias("value"))


def library_norms(spark, sf_dir):
    return _rounded(library.norms(_class_library(spark, sf_dir).frame(spark)), "norm", digits=5)


def library_flatten(spark, sf_dir):
    return _rounded(library.flatten(_class_library(spark, sf_dir).frame(spark)), "value", digits=5)


def sam_all_targets(spark, sf_dir):
    return _rounded(scoring.sam_all(pixels(spark, sf_dir), _class_library(spark, sf_dir)).select("p", "target", "angle"), "angle")


def sam_best_match(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir).select("p", "target", "score"), "score")


def sam_single_target(spark, sf_dir):
    lib = _class_library(spark, sf_dir).only("3")
    return _rounded(scoring.sam_best(pixels(spark, sf_dir), lib, strategy="sql").select("p", "target", "score"), "score")


def flagship(spark, sf_dir):
    """Detections of the class means: scored, thresholded, suppressed and capped."""
    ship_package(spark)
    return detect.detect(_scores(spark, sf_dir), DetectionParams(WIDE, 2))


def threshold_low(spark, sf_dir):
    return _rounded(detect.threshold(_scores(spark, sf_dir), DetectionParams(LOW)).select("p", "target", "score"), "score")


def threshold_high(spark, sf_dir):
    return _rounded(detect.threshold(_scores(spark, sf_dir), DetectionParams(HIGH, polarity=Polarity.HIGHER)).select("p", "target", "score"), "score")


def _nms(spark, sf_dir, params, plan):
    return detect.nms(_scores(spark, sf_dir), params, plan).select("p", "y", "x", "target")


def nms_low(spark, sf_dir):
    return _nms(spark, sf_dir, DetectionParams(WIDE, 2), "candidates")


def nms_low_dense(spark, sf_dir):
    return _nms(spark, sf_dir, DetectionParams(WIDE, 2), "dense")


def nms_high(spark, sf_dir):
    return _nms(spark, sf_dir, DetectionParams(HIGH, 1, polarity=Polarity.HIGHER), "candidates")


def nms_radius0(spark, sf_dir):
    return _nms(spark, sf_dir, DetectionParams(WIDE, 0), "candidates")


def detections_capped(spark, sf_dir):
    found = detect.detect(_scores(spark, sf_dir), DetectionParams(WIDE, 1, CAP))
    return found.select("x", "y", "target", "detections_found")


def detections_per_target(spark, sf_dir):
    lib = _class_library(spark, sf_dir)
    found = detect.detect(scoring.sam_best(pixels(spark, sf_dir), lib), DetectionParams(WIDE, 1, None))
    return detect.per_target(found, lib.frame(spark))


# Statistics


def band_mean(spark, sf_dir):
    return _rounded(moments.band_means(pixels(spark, sf_dir)), "mean")


def scene_moments(spark, sf_dir):
    return _rounded(moments.moments_long(pixels(spark, sf_dir)).select("i", "j", "n", "product"), "product")


def scene_covariance(spark, sf_dir):
    return _rounded(moments.covariance_long(pixels(spark, sf_dir), loading=LOADING), "covariance")


def scene_correlation(spark, sf_dir):
    return _rounded(moments.correlation_long(pixels(spark, sf_dir), loading=LOADING), "correlation")


def _moment_rows(spark, m: moments.Moments) -> DataFrame:
    rows = [(i, j, float(m.n), float(m.s[i]), float(m.o[i, j])) for i in range(len(m.s)) for j in range(i + 1)]
    return _rounded(spark.createDataFrame(rows, "i int, j int, n double, sum_i double, product double"), "sum_i", "product", digits=4)


def moments_merge(spark, sf_dir):
    """Over Arrow batches, partial results merged in two steps."""
    return _moment_rows(spark, moments.moments(items(spark, sf_dir)))


def moments_shifted(spark, sf_dir):
    """The same from sums of differences from a reference spectrum."""
    return _moment_rows(spark, moments.moments(items(spark, sf_dir), reference=np.array([0.5, 0.4, 0.5, 0.5])))


def _item_statistics(spark, sf_dir):
    return moments.build_statistics(moments.moments(items(spark, sf_dir)), _item_library(spark, sf_dir), LOADING)


def rx_small(spark, sf_dir):
    return _rounded(scoring.rx(items(spark, sf_dir), _item_statistics(spark, sf_dir)).select("l_orderkey", "l_linenumber", "score"), "score", digits=5)


def ace_small(spark, sf_dir):
    return _rounded(scoring.ace_best(items(spark, sf_dir), _item_statistics(spark, sf_dir)).select("l_orderkey", "l_linenumber", "target", "score"), "score", digits=5)


def cem_small(spark, sf_dir):
    return _rounded(scoring.cem_best(items(spark, sf_dir), _item_statistics(spark, sf_dir)).select("l_orderkey", "l_linenumber", "target", "score"), "score", digits=5)


def _full(spark, sf_dir, name):
    px = pixels(spark, sf_dir)
    lib = _class_library(spark, sf_dir)
    stats = moments.build_statistics(moments.moments(px), lib, FULL_LOADING)
    return _rounded(scoring.score(px, name, lib, stats).select("p", "target", "score"), "score", digits=5)


def rx_full(spark, sf_dir):
    return _full(spark, sf_dir, "rx")


def ace_full(spark, sf_dir):
    return _full(spark, sf_dir, "ace")


def cem_full(spark, sf_dir):
    return _full(spark, sf_dir, "cem")


def rx_threshold(spark, sf_dir):
    """The rates are the discounts and taxes of lineitem."""
    from ..functions.spectral import register

    register(spark)
    t = _table(spark, sf_dir, "lineitem")
    rates = t.select("l_discount").union(t.select("l_tax")).toDF("rate").where("rate > 0 and rate < 1").select(F.col("rate").cast("double").alias("rate")).groupBy("rate").count()
    return rates.selectExpr("rate", "count AS n", "round(rx_threshold(2, rate), 6) AS threshold")


# Evaluation


def _judged(spark, sf_dir):
    """Angles to the mean of class 3 with the labels of the pixels."""
    return scoring.sam_best(pixels(spark, sf_dir), _class_library(spark, sf_dir).only("3")).where(F.col("label") <= evaluate.LAST_LABEL)


def confusion(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), 3, WIDE)


def precision_recall_f1(spark, sf_dir):
    return _rounded(evaluate.precision_recall_f1(confusion(spark, sf_dir)), "precision", "recall", "f1").select("precision", "recall", "f1")


def roc_auc(spark, sf_dir):
    return _rounded(evaluate.roc_auc(_judged(spark, sf_dir), 3), "auc")


def class_angle_stats(spark, sf_dir):
    return _rounded(evaluate.class_statistics(_judged(spark, sf_dir), 3), "mean", "least", "gap").withColumn("label", F.col("label").cast("long"))


def variant_agreement(spark, sf_dir):
    """The matrix product against expressions, and against pixels rounded to 16-bit floats."""
    px, lib = pixels(spark, sf_dir), _class_library(spark, sf_dir)
    base = scoring.sam_best(px, lib, strategy="sql")
    out = None
    for name, other in (("arrow", scoring.sam_best(px, lib, strategy="arrow")), ("half", scoring.sam_best(layout.quantize_half(px), lib, strategy="arrow"))):
        row = evaluate.agreement(base, other, 2e-3).select(F.lit(name).alias("variant"), "n", (F.col("max_error") < 5e-3).alias("within"), "significant")
        out = row if out is None else out.unionByName(row)
    return out


# Layout


def _shape(spark, sf_dir) -> CubeShape:
    n = _table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return CubeShape(-(-n // WIDTH), WIDTH, 64)


def interleave_bil(spark, sf_dir):
    return _rounded(layout.elements(pixels(spark, sf_dir), _shape(spark, sf_dir), "bil").select("position", "value"), "value")


def interleave_bip(spark, sf_dir):
    return _rounded(layout.elements(pixels(spark, sf_dir), _shape(spark, sf_dir), "bip").select("position", "value"), "value")


def bsq_roundtrip(spark, sf_dir):
    """Pixels to bands, to lines of bands and back, in blocks of lines; places without a pixel (the last line's end) give no rows."""
    shape, px = _shape(spark, sf_dir), pixels(spark, sf_dir)
    bands = layout.strips(px, shape, "bsq", partial=True)
    back = layout.from_strips(layout.convert_strips(bands, shape, "bsq", "bil"), shape, "bil").join(px.select("p"), "p", "left_semi")
    return _rounded(back.select("p", F.posexplode("spectrum").alias("band", "value")), "value")


def demosaic(spark, sf_dir):
    """lineitem's order keys and line numbers as places of a mosaic image with tiles of 2 x 2."""
    t = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 64).cast("int").alias("x"), (F.col("l_partkey") % 48).cast("int").alias("y")).agg(F.sum("l_quantity").alias("value"))
    made = layout.demosaic_samples(t.withColumn("frame_index", F.lit(0).cast("long")), 2, 4, 64, 48)
    return _rounded(made.select("p", "y", "x", F.posexplode("spectrum").alias("position", "value")).drop("position"), "value", digits=3).groupBy("p", "y", "x").agg(F.count(F.lit(1)).alias("bands"), F.round(F.sum("value"), 2).alias("total"))


def band_select(spark, sf_dir):
    kept = layout.select_bands(pixels(spark, sf_dir), [b for b in range(64) if b % 3 == 0])
    return _rounded(kept.select("p", F.posexplode("spectrum").alias("band", "value")), "value")


def drop_row(spark, sf_dir):
    return layout.drop_rows(pixels(spark, sf_dir), [4], WIDTH).select("p", "y", "x", F.col("label").cast("long").alias("label"))


# Runs


def frame_stats(spark, sf_dir):
    """events by hour stand for frames: one value is a time, the number of events the detections kept."""
    e = _table(spark, sf_dir, "events")
    frames = e.groupBy(F.date_trunc("hour", "ts").alias("frame")).agg(F.sum("value").alias("ms"), F.count(F.lit(1)).alias("detections_kept"))
    return _rounded(evaluate.run_statistics(frames, 512 * 512, 512), "fps", "mpixels_per_s", "gb_per_s", "mean_ms", "max_ms", digits=4)


def latency_percentiles(spark, sf_dir):
    return _rounded(evaluate.percentiles(_table(spark, sf_dir, "events"), "value", [0.5, 0.9, 0.99], ["event_type"]), "p50", "p90", "p99")


def synthetic_detect(spark, sf_dir):
    """Discs with the spectra of the pixels' class means move over a synthetic background; three frames."""
    from ..sources import synthetic

    synthetic.register(spark)
    lib = _class_library(spark, sf_dir)
    scene = synthetic.Scene(bands=lib.bands, targets=len(lib.names), spectra=tuple(tuple(map(float, v)) for v in lib.values))
    px = spark.read.format("prismlake_synthetic").options(**scene.options()).option("frames", 3).load()
    return detect.detect(scoring.sam_best(px, synthetic.library(scene)), DetectionParams(0.05, 4))


_folders: list[str] = []


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see: in the shared one, else, on one machine only, a temporary one. It goes when the process ends."""
    shared = local_path(spark.conf.get("spark.checkpoint.dir", None) or "")
    if not os.path.isdir(shared):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = None
    if not _folders:
        atexit.register(lambda: [shutil.rmtree(f, ignore_errors=True) for f in _folders])
    _folders.append(tempfile.mkdtemp(prefix="prismlake-", dir=shared))
    return _folders[-1]


def envi_roundtrip(spark, sf_dir):
    """Pixels written as a cube and read back through the data source."""
    from ..sources import envi

    envi.register(spark)
    header = envi.write_cube(os.path.join(_folder(spark), "scene"), pixels(spark, sf_dir), _shape(spark, sf_dir), partial=True)
    back = spark.read.format("prismlake_envi").load(header)
    return _rounded(back.select("p", F.posexplode("spectrum").alias("band", "value")), "value")


#: What each frame of the stream below adds to the pixels' values.
FRAME_SHIFT = 0.05


def stream_detect(spark, sf_dir):
    """Three cubes made from the pixels are replayed as a stream that ends by itself; each batch is written under its number, so a repeated one replaces itself."""
    from ..sources import envi
    from ..streaming.detector import run_stream

    folder, out = _folder(spark), _folder(spark)
    px, lib, shape = pixels(spark, sf_dir), _class_library(spark, sf_dir), _shape(spark, sf_dir)
    for k in range(3):
        shifted = F.expr(f"transform(spectrum, v -> float(double(v) + {FRAME_SHIFT * k}D))")
        envi.write_cube(os.path.join(folder, f"frame{k}"), px.withColumn("spectrum", shifted), shape, partial=True)
    envi.register(spark)

    def sink(found, frames, number):
        found.write.mode("overwrite").parquet(f"{out}/detections/batch={number}")

    stream = spark.readStream.format("prismlake_envi").load(folder)
    run_stream(stream, lib, DetectionParams(WIDE, 1, None), sink, checkpoint=f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/detections").select("frame_index", "y", "x", "target")


_QUERIES = (
    class_mean_library, library_norms, library_flatten, sam_all_targets, sam_best_match, sam_single_target, threshold_low, threshold_high, nms_low, nms_low_dense, nms_high,
    nms_radius0, detections_capped, detections_per_target, band_mean, scene_moments, scene_covariance, scene_correlation, moments_merge, moments_shifted, rx_small, ace_small,
    cem_small, rx_full, ace_full, cem_full, rx_threshold, confusion, precision_recall_f1, roc_auc, class_angle_stats, variant_agreement, interleave_bil, interleave_bip,
    bsq_roundtrip, demosaic, band_select, drop_row, frame_stats, latency_percentiles, synthetic_detect, envi_roundtrip, stream_detect,
)


def queries():
    from . import scene_queries

    def shipped(f):
        @wraps(f)
        def run(spark, sf_dir):
            return f(ship_package(spark), sf_dir)

        return run

    return {f.__name__: shipped(f) for f in (*_QUERIES, *scene_queries.QUERIES)}


# SQL

_PX = f"""px AS (SELECT vec_id AS p, vec_id // {WIDTH} AS y, vec_id % {WIDTH} AS x, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)"""
_LONG = "lg AS (SELECT p, label, unnest(range(64)) AS band, unnest(e) AS v FROM px)"
_MEANS = "cm AS (SELECT label, band, avg(v) AS m, count(*) AS n FROM lg GROUP BY label, band)"
_LIB = "lib AS (SELECT row_number() OVER (ORDER BY label) - 1 AS target, label, list(m ORDER BY band) AS r FROM cm GROUP BY label)"
_ANGLE = "ang AS (SELECT p, y, x, px.label, target, lib.label AS lib_label, acos(greatest(-1.0, least(1.0, list_dot_product(e, r) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(r, r)))))) AS a FROM px, lib)"
_BEST = "best AS (SELECT p, any_value(y) AS y, any_value(x) AS x, any_value(label) AS label, arg_min(target, (a, target)) AS target, min(a) AS score FROM ang GROUP BY p)"
_SAM = f"WITH {_PX}, {_LONG}, {_MEANS}, {_LIB}, {_ANGLE}, {_BEST}"
_JUDGED = f"WITH {_PX}, {_LONG}, {_MEANS}, {_LIB}, {_ANGLE}, j AS (SELECT p, label, a AS score FROM ang WHERE lib_label = 3 AND label <= 8)"


_FRAMES = f"fx AS (SELECT f, p, y, x, list_transform(e, lambda v: CAST(CAST(v + {FRAME_SHIFT} * f AS FLOAT) AS DOUBLE)) AS e FROM px, range(3) r(f))"
_STREAM = f"WITH {_PX}, {_LONG}, {_MEANS}, {_LIB}, {_FRAMES}, fa AS (SELECT f, p, y, x, target, acos(greatest(-1.0, least(1.0, list_dot_product(e, r) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(r, r)))))) AS a FROM fx, lib), best AS (SELECT f, p, any_value(y) AS y, any_value(x) AS x, arg_min(target, (a, target)) AS target, min(a) AS score FROM fa GROUP BY f, p)"


def _survivors(radius: int, limit: float, higher: bool = False) -> str:
    """The definition: no neighbour is strictly better, and no equal one comes first."""
    better = ">" if higher else "<"
    keep = ">=" if higher else "<="
    return f"""sv AS (SELECT * FROM best b WHERE CAST(score AS FLOAT) {keep} CAST({limit} AS FLOAT) AND NOT EXISTS (
      SELECT 1 FROM best o WHERE o.p <> b.p AND abs(o.y - b.y) <= {radius} AND abs(o.x - b.x) <= {radius}
      AND (CAST(o.score AS FLOAT) {better} CAST(b.score AS FLOAT) OR (CAST(o.score AS FLOAT) = CAST(b.score AS FLOAT) AND o.p < b.p))))"""


_ITEMS = "it AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_returnflag, " + ", ".join(f"{c} / {s} AS b{k}" for k, (c, s) in enumerate(SCALE)) + " FROM lineitem)"
_N = len(SCALE)


def _item_moments(size: int = _N) -> str:
    sums = [f"sum(b{i}) AS s{i}" for i in range(size)] + [f"sum(b{i} * b{j}) AS o{i}{j}" for i in range(size) for j in range(i + 1)]
    return f"mo AS (SELECT CAST(count(*) AS DOUBLE) AS n, {', '.join(sums)} FROM it)"


def _factor(name: str, source: str, entry, size: int = _N) -> str:
    """The lower Cholesky factor of a matrix of columns, one column of the factor for each nested query."""
    sql = f"SELECT *, {', '.join(f'{entry(i, j)} AS a{i}{j}' for i in range(size) for j in range(i + 1))} FROM {source}"
    for j in range(size):
        inner = lambda i, j=j: "".join(f" - {name}{i}{k} * {name}{j}{k}" for k in range(j))
        sql = f"SELECT *, sqrt(a{j}{j}{inner(j)}) AS {name}{j}{j} FROM ({sql})"
        if j + 1 < size:
            below = ", ".join(f"(a{i}{j}{inner(i)}) / {name}{j}{j} AS {name}{i}{j}" for i in range(j + 1, size))
            sql = f"SELECT *, {below} FROM ({sql})"
    drop = ", ".join(f"a{i}{j}" for i in range(size) for j in range(i + 1))
    return f"SELECT * EXCLUDE ({drop}) FROM ({sql})"


def _forward(out: str, factor: str, value, size: int = _N) -> list[str]:
    """Forward substitution as expressions, each a level of nesting."""
    return [f"({value(i)}{''.join(f' - {factor}{i}{k} * {out}{k}' for k in range(i))}) / {factor}{i}{i} AS {out}{i}" for i in range(size)]


def _nested(source: str, columns: list[str]) -> str:
    sql = f"SELECT * FROM {source}"
    for c in columns:
        sql = f"SELECT *, {c} FROM ({sql})"
    return sql


def _covariance(i: int, j: int) -> str:
    return f"(o{i}{j} / n - (s{i} / n) * (s{j} / n){f' + {LOADING}' if i == j else ''})"


def _correlation(i: int, j: int) -> str:
    return f"(o{i}{j} / n{f' + {LOADING}' if i == j else ''})"


def second_order(start: str, size: int, key: str, label: str) -> dict[str, str]:
    """RX, ACE and CEM by definition. start: a WITH clause up to it (rid, the key, the label, b0 ...); the classes' means are the targets."""
    every = range(size)
    dot = lambda a, b: " + ".join(f"{a}{k} * {b}{k}" for k in every)
    lib = f"il AS (SELECT row_number() OVER (ORDER BY {label}) - 1 AS target, * FROM (SELECT {label}, {', '.join(f'avg(b{k}) AS d{k}' for k in every)} FROM it GROUP BY {label}))"
    start = f"{start}, {_item_moments(size)}"
    white = f"{start}, fc AS ({_factor('f', 'mo', _covariance, size)})"
    z = f"z AS ({_nested('(SELECT * FROM it, fc)', _forward('z', 'f', lambda i: f'b{i} - s{i} / n', size))})"
    u = f"u AS (SELECT target, {', '.join(f'u{k}' for k in every)} FROM ({_nested('(SELECT * FROM il, fc)', _forward('u', 'f', lambda i: f'd{i} - s{i} / n', size))}))"
    rx_sql = f"{white}, {z} SELECT {key}, -1 AS target, round({dot('z', 'z')}, 5) AS score FROM z"
    best = f"SELECT {key}, CAST(arg_min(target, (-a, target)) AS INTEGER) AS target, round(max(a), 5) AS score FROM s GROUP BY rid, {key}"
    ace = f"{white}, {lib}, {z}, {u}, s AS (SELECT rid, {key}, u.target, least(1.0, ({dot('z', 'u')}) * ({dot('z', 'u')}) / (({dot('z', 'z')}) * ({dot('u', 'u')}))) AS a FROM z, u) {best}"
    back = [f"(y{i}{''.join(f' - g{k}{i} * w{k}' for k in range(i + 1, size))}) / g{i}{i} AS w{i}" for i in reversed(every)]
    cem = f"""{start}, gc AS ({_factor('g', 'mo', _correlation, size)}), {lib},
      w AS (SELECT target, {', '.join(f'w{k} / ({dot("w", "d")}) AS w{k}' for k in every)} FROM ({_nested('(SELECT * FROM il, gc)', _forward('y', 'g', lambda i: f'd{i}', size) + back)})),
      s AS (SELECT rid, {key}, w.target, {dot('b', 'w')} AS a FROM it, w) {best}"""
    return {"rx": rx_sql, "ace": ace, "cem": cem}


def _second_order() -> dict[str, str]:
    made = second_order(f"WITH {_ITEMS}", _N, "l_orderkey, l_linenumber", "l_returnflag")
    return {"rx_small": made["rx"].replace("-1 AS target, ", ""), "ace_small": made["ace"], "cem_small": made["cem"]}


def _inverse(name: str, entry: str) -> str:
    """The inverse of a 64 x 64 matrix by elimination in a recursive query: name holds it as a list of rows, entry is the element at i, j of the pixels' sums."""
    step = "list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] / a[k][k] * a[k][j]) END)"
    unit = "list_transform(range(64), lambda c: CASE WHEN c = i THEN 1.0 ELSE 0.0 END)"
    return f"""{name}_e AS (SELECT i, j, {entry} + CASE WHEN i = j THEN {FULL_LOADING} ELSE 0 END AS v FROM sums),
      {name}_0 AS (SELECT list(list_concat(r, {unit}) ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS r FROM {name}_e GROUP BY i)),
      {name}_k AS (SELECT 1 AS k, a FROM {name}_0 UNION ALL SELECT k + 1, {step} FROM {name}_k WHERE k <= 64),
      {name} AS (SELECT list_transform(a, lambda r: r[65:]) AS {name} FROM {name}_k WHERE k = 65)"""


def _full_second_order() -> dict[str, str]:
    """RX, ACE and CEM over the pixels' 64 bands by definition, with inverse matrices."""
    sums = "sums AS (SELECT i, j, sum(e[i + 1] * e[j + 1]) / count(*) AS o, avg(e[i + 1]) AS mi, avg(e[j + 1]) AS mj FROM px, range(64) a(i), range(64) b(j) GROUP BY i, j)"
    start = f"WITH RECURSIVE {_PX}, {_LONG}, {_MEANS}, {_LIB}, {sums}, mu AS (SELECT list(m ORDER BY band) AS mean FROM (SELECT band, avg(v) AS m FROM lg GROUP BY band))"
    times = lambda m, v: f"list_transform({m}, lambda row: list_dot_product(row, {v}))"
    centred = lambda v: f"list_transform({v}, lambda v, b: v - mean[b])"
    white = f"{start}, {_inverse('g', 'o - mi * mj')}, z AS (SELECT p, z, list_dot_product(z, {times('g', 'z')}) AS zz FROM (SELECT p, g, {centred('e')} AS z FROM px, mu, g))"
    u = f"u AS (SELECT target, u, list_dot_product(u0, u) AS uu FROM (SELECT target, u0, {times('g', 'u0')} AS u FROM (SELECT target, g, {centred('r')} AS u0 FROM lib, mu, g)))"
    w = f"w AS (SELECT target, r, list_transform(w, lambda v: v / list_dot_product(w, r)) AS w FROM (SELECT target, r, {times('h', 'r')} AS w FROM lib, h))"
    best = "SELECT p, CAST(arg_min(target, (-a, target)) AS INTEGER) AS target, round(max(a), 5) AS score FROM s GROUP BY p"
    return {
        "rx_full": f"{white} SELECT p, -1 AS target, round(zz, 5) AS score FROM z",
        "ace_full": f"{white}, {u}, s AS (SELECT p, target, least(1.0, list_dot_product(z, u) ** 2 / (zz * uu)) AS a FROM z, u) {best}",
        "cem_full": f"{start}, {_inverse('h', 'o')}, {w}, s AS (SELECT p, target, list_dot_product(e, w) AS a FROM px, w) {best}",
    }


def oracle_sql():
    from . import scene_queries

    pairs = "SELECT i, j, count(*) AS n, sum(e[i + 1] * e[j + 1]) AS product, avg(e[i + 1]) AS mi, avg(e[j + 1]) AS mj FROM px, range(64) a(i), range(64) b(j) WHERE j <= i GROUP BY i, j"
    ij = "CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j"
    triangle = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, n, round(s{i}, 4) AS sum_i, round(o{i}{j}, 4) AS product FROM mo" for i in range(_N) for j in range(i + 1))
    counts = f"SELECT count(*) FILTER (s AND t) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (NOT s AND t) AS fn, count(*) FILTER (NOT s AND NOT t) AS tn FROM (SELECT CAST(score AS FLOAT) <= CAST({WIDE} AS FLOAT) AS s, label = 3 AS t FROM j)"
    best = "SELECT p, CAST(target AS INTEGER) AS target, round(score, 6) AS score"
    place = "SELECT p, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(target AS INTEGER) AS target FROM sv"
    height = f"(SELECT (max(vec_id) + {WIDTH}) // {WIDTH} AS h FROM embeddings)"
    return scene_queries.oracle_sql() | {
        "class_mean_library": f"WITH {_PX}, {_LONG}, {_MEANS} SELECT label, n, band, round(m, 6) AS value FROM cm",
        "library_norms": f"WITH {_PX}, {_LONG}, {_MEANS}, {_LIB} SELECT CAST(target AS INTEGER) AS target_id, CAST(label AS VARCHAR) AS name, round(sqrt(list_dot_product(r, r)), 5) AS norm FROM lib",
        "library_flatten": f"WITH {_PX}, {_LONG}, {_MEANS}, {_LIB} SELECT target * 64 + b AS position, CAST(target AS INTEGER) AS target_id, CAST(b AS INTEGER) AS band, round(CAST(v AS FLOAT)::DOUBLE, 5) AS value FROM (SELECT target, unnest(range(64)) AS b, unnest(r) AS v FROM lib)",
        "sam_all_targets": f"{_SAM} SELECT p, CAST(target AS INTEGER) AS target, round(a, 6) AS angle FROM ang",
        "sam_best_match": f"{_SAM} {best} FROM best",
        "sam_single_target": f"{_SAM} SELECT p, 0 AS target, round(a, 6) AS score FROM ang WHERE lib_label = 3",
        "threshold_low": f"{_SAM} {best} FROM best WHERE CAST(score AS FLOAT) <= CAST({LOW} AS FLOAT)",
        "threshold_high": f"{_SAM} {best} FROM best WHERE CAST(score AS FLOAT) >= CAST({HIGH} AS FLOAT)",
        "nms_low": f"{_SAM}, {_survivors(2, WIDE)} {place}",
        "nms_low_dense": f"{_SAM}, {_survivors(2, WIDE)} {place}",
        "nms_high": f"{_SAM}, {_survivors(1, HIGH, True)} {place}",
        "nms_radius0": f"{_SAM}, {_survivors(0, WIDE)} {place}",
        "detections_capped": f"{_SAM}, {_survivors(1, WIDE)} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(target AS INTEGER) AS target, count(*) OVER () AS detections_found FROM sv QUALIFY row_number() OVER (ORDER BY p) <= {CAP}",
        "detections_per_target": f"{_SAM}, {_survivors(1, WIDE)} SELECT CAST(lib.target AS INTEGER) AS target_id, CAST(lib.label AS VARCHAR) AS name, count(sv.p) AS detections FROM lib LEFT JOIN sv ON sv.target = lib.target GROUP BY 1, 2",
        "band_mean": f"WITH {_PX}, {_LONG} SELECT CAST(band AS INTEGER) AS band, round(avg(v), 6) AS mean FROM lg GROUP BY 1",
        "scene_moments": f"WITH {_PX} SELECT {ij}, n, round(product, 6) AS product FROM ({pairs})",
        "scene_covariance": f"WITH {_PX} SELECT {ij}, round(product / n - mi * mj + CASE WHEN i = j THEN {LOADING} ELSE 0 END, 6) AS covariance FROM ({pairs})",
        "scene_correlation": f"WITH {_PX} SELECT {ij}, round(product / n + CASE WHEN i = j THEN {LOADING} ELSE 0 END, 6) AS correlation FROM ({pairs})",
        "moments_merge": f"WITH {_ITEMS}, {_item_moments()} {triangle}",
        "moments_shifted": f"WITH {_ITEMS}, {_item_moments()} {triangle}",
        **_second_order(),
        **_full_second_order(),
        "rx_threshold": "SELECT rate, count(*) AS n, round(-2 * ln(rate), 6) AS threshold FROM (SELECT CAST(l_discount AS DOUBLE) AS rate FROM lineitem UNION ALL SELECT CAST(l_tax AS DOUBLE) FROM lineitem) WHERE rate > 0 AND rate < 1 GROUP BY rate",
        "stream_detect": f"{_STREAM}, {_survivors(1, WIDE).replace('o.p <> b.p', 'o.f = b.f AND o.p <> b.p')} SELECT CAST(f AS BIGINT) AS frame_index, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(target AS INTEGER) AS target FROM sv",
        "confusion": f"{_JUDGED} {counts}",
        "precision_recall_f1": f"{_JUDGED}, c AS ({counts}) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, CASE WHEN tp = 0 THEN 'NaN'::DOUBLE ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM c",
        "roc_auc": f"{_JUDGED} SELECT round(sum(CASE WHEN a.score < b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc, count(DISTINCT a.p) AS positives, count(DISTINCT b.p) AS negatives FROM j a, j b WHERE a.label = 3 AND b.label <> 3",
        "class_angle_stats": f"{_JUDGED} SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(avg(score) - (SELECT avg(score) FROM j WHERE label = 3), 6) AS gap FROM j GROUP BY label",
        "variant_agreement": "SELECT v AS variant, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS n, true AS within, 0::BIGINT AS significant FROM (VALUES ('arrow'), ('half')) t(v)",
        "interleave_bil": f"WITH {_PX}, {_LONG} SELECT (p // {WIDTH} * 64 + band) * {WIDTH} + p % {WIDTH} AS position, round(v, 6) AS value FROM lg",
        "interleave_bip": f"WITH {_PX}, {_LONG} SELECT p * 64 + band AS position, round(v, 6) AS value FROM lg",
        "bsq_roundtrip": f"WITH {_PX}, {_LONG} SELECT p, CAST(band AS INTEGER) AS band, round(v, 6) AS value FROM lg, {height}",
        "envi_roundtrip": f"WITH {_PX}, {_LONG} SELECT p, CAST(band AS INTEGER) AS band, round(v, 6) AS value FROM lg",
        "demosaic": "WITH m AS (SELECT l_orderkey % 64 AS x, l_partkey % 48 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT x // 2 AS tx, y // 2 AS ty, round(CAST(v AS FLOAT)::DOUBLE, 3) AS v FROM m) SELECT ty * 32 + tx AS p, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, count(*) AS bands, round(sum(v), 2) AS total FROM r GROUP BY tx, ty",
        "band_select": f"WITH {_PX}, {_LONG} SELECT p, CAST(band // 3 AS INTEGER) AS band, round(v, 6) AS value FROM lg WHERE band % 3 = 0",
        "drop_row": f"WITH {_PX} SELECT (y - (y > 4)::INT) * {WIDTH} + x AS p, CAST(y - (y > 4)::INT AS INTEGER) AS y, CAST(x AS INTEGER) AS x, label FROM px WHERE y <> 4",
        "frame_stats": "WITH f AS (SELECT date_trunc('hour', ts) AS frame, sum(value) AS ms, count(*) AS k FROM events GROUP BY 1) SELECT count(*) AS frames, round(count(*) * 1000.0 / sum(ms), 4) AS fps, round(count(*) * 1000.0 / sum(ms) * 262144 / 1e6, 4) AS mpixels_per_s, round(count(*) * 1000.0 / sum(ms) * 262144 * 512 / 1e9, 4) AS gb_per_s, round(avg(ms), 4) AS mean_ms, round(max(ms), 4) AS max_ms, sum(k)::BIGINT AS total_detections FROM f",
        "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    }
