"""Registered queries on sources, sinks, scenes and streams, with their SQL.

Files are written from the driver's tables, or from a rule that SQL can follow,
into a new folder and read back through the engine's sources.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..model import DETECTORS, DetectionParams, Polarity
from ..operators import detect, evaluate, layout, moments, scoring, search
from ..sources import envi, library_csv, mosaic, raster
from ..streaming import lagged
from . import catalog as C
from . import scenes

#: Frames and their size, made of lineitem; tiles of 2 x 2 with another order of bands.
FRAMES, MOSAIC, ORDER = 7, (14, 9), [2, 0, 3, 1]
#: What is asked of a cube and an archive by filters.
LINES = (3, 6)
FEW = 8


def _cube(spark, sf_dir, value=lambda v: v, name="cube", folder=None, **kind) -> str:
    """The pixels written as a cube of some layout and type; the path of its header."""
    px = C.pixels(spark, sf_dir).withColumn("spectrum", F.transform("spectrum", lambda v: value(v.cast("double"))))
    return envi.write_cube(os.path.join(folder or C._folder(spark), name), px, C._shape(spark, sf_dir), partial=True, **kind)


def _envi(spark, sf_dir, value=lambda v: v, **kind) -> DataFrame:
    header = _cube(spark, sf_dir, value, **kind)
    step = max(4, envi.read_header(header).shape.height // 64)
    got = spark.read.format("prismlake_envi").option("lines_per_partition", step).load(header)
    return got.select("p", "y", "x", F.posexplode("spectrum").alias("band", "v")).select("p", "y", "x", "band", F.round(F.col("v").cast("double"), 6).alias("value"))


def envi_bil_int16_big(spark, sf_dir):
    return _envi(spark, sf_dir, data_type=2, interleave="bil", big_endian=True, header_offset=16)


def envi_bip_uint16(spark, sf_dir):
    return _envi(spark, sf_dir, F.abs, data_type=12, interleave="bip")


def envi_bsq_double(spark, sf_dir):
    return _envi(spark, sf_dir, data_type=5, interleave="bsq", big_endian=True)


def _archive(spark, sf_dir) -> str:
    """Three cubes of one folder, the k-th with the pixels' values times k + 1, in three layouts."""
    folder = C._folder(spark)
    for k, interleave in enumerate(("bsq", "bil", "bip")):
        _cube(spark, sf_dir, lambda v, k=k: v * (k + 1), f"scene{k}", folder, interleave=interleave)
    return folder


def envi_replay(spark, sf_dir):
    """Two of three cubes of a folder, read twice over: frames in order."""
    px = spark.read.format("prismlake_envi").options(max_resident=2, loops=2).load(_archive(spark, sf_dir))
    return px.select("frame_index", F.explode("spectrum").alias("v")).groupBy("frame_index").agg(F.round(F.sum(F.col("v").cast("double")), 5).alias("total"), F.count(F.lit(1)).alias("values"))


def scene_lines(spark, sf_dir):
    """Some lines of one scene of an archive: filters choose files and lines, nothing else is opened."""
    px = spark.read.format("prismlake_envi").options(scene_column="true", lines_per_partition=2).load(_archive(spark, sf_dir))
    some = px.where((F.col("scene") == "scene2") & F.col("y").between(*LINES) & (F.col("p") % 2 == 0))
    return some.select("scene", "frame_index", "p", "y", F.posexplode("spectrum").alias("band", "v")).select("scene", "frame_index", "p", "y", "band", F.round(F.col("v").cast("double"), 5).alias("value"))


def header_catalogue(spark, sf_dir):
    """The headers of an archive as a table, one row for each field."""
    rows = envi.catalogue(spark, _archive(spark, sf_dir))
    return rows.select("scene", "lines", "samples", "bands", "interleave", F.explode("fields").alias("field", "value"))


def library_csv_roundtrip(spark, sf_dir):
    """Class means written as a library with comments and wavelengths, and read back."""
    lib = C._class_library(spark, sf_dir)
    with_waves = type(lib)(lib.names, lib.values, tuple(400.0 + 2.5 * b for b in range(lib.bands)))
    path = os.path.join(C._folder(spark), "library.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("# class means\n\n" + library_csv.format_library(with_waves) + "# end\n")
    rows = library_csv.read_libraries(spark, path)
    return rows.select("target_id", "name", F.posexplode(F.arrays_zip("values", "wavelengths_nm")).alias("band", "v")).select("target_id", "name", "band", F.round(F.col("v.values").cast("double"), 5).alias("value"), F.col("v.wavelengths_nm").cast("double").alias("nm"))


def _mosaic_samples(spark, sf_dir) -> DataFrame:
    """lineitem's line numbers are frames, order and part keys are places, and sums of quantities are 16-bit values."""
    width, height = MOSAIC
    t = C._table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") <= FRAMES)
    places = (F.col("l_linenumber").cast("long") - 1).alias("frame_index"), (F.col("l_orderkey") % width).cast("int").alias("x"), (F.col("l_partkey") % height).cast("int").alias("y")
    return t.groupBy(*places).agg((F.sum(F.col("l_quantity").cast("long")) * 37 % 65536).alias("value"))


def mosaic_video(spark, sf_dir):
    """PNG frames written by tasks and read in the order of their names, demosaiced with an order of bands."""
    folder = C._folder(spark)
    mosaic.write_mosaic(_mosaic_samples(spark, sf_dir), folder, *MOSAIC)
    px = mosaic.read_mosaic(spark, folder, 2, 4, ORDER)
    return px.select("frame_index", "y", "x", F.posexplode("spectrum").alias("band", "v")).select("frame_index", "y", "x", "band", F.round(F.col("v").cast("double"), 6).alias("value"))


def raster_roundtrip(spark, sf_dir):
    """A score map, a target map and a mask written as raw rasters and read back."""
    scores = C._scores(spark, sf_dir)
    n, folder = scores.count(), C._folder(spark)
    out = None
    for kind, name in (("f32", "score"), ("i32", "target"), ("u8", "label")):
        path = os.path.join(folder, name)
        raster.write_raster(scores, name, kind, path, n)
        got = raster.read_raster(spark, path, kind, n).select("p", F.col("value").alias(name))
        out = got if out is None else out.join(got, "p")
    return out.select("p", F.round(F.col("score").cast("double"), 5).alias("score"), "target", F.col("label").cast("long").alias("label"))


def scene_with_annotation(spark, sf_dir):
    """Pixels meet an annotation archive by place, in every line (the dataset's damaged one is none of this scene); noisy bands go (5 to 56 stay but for 48 to 50), labels become those of masks."""
    px = C.pixels(spark, sf_dir)
    shape, folder = C._shape(spark, sf_dir), C._folder(spark)
    path = os.path.join(folder, "scene_a.npz")
    np.savez(path, gt=np.resize(np.arange(11, dtype=np.int16), (shape.height, shape.width)))
    marked = raster.read_annotations(spark, path)
    clean = scenes.prepare_scene(px.drop("label"), marked, "scene_a", 64, C.WIDTH, keep_damaged_row=True)
    return clean.select("p", "y", "x", F.col("label").cast("int").alias("label"), F.size("spectrum").alias("bands"), F.round(F.get("spectrum", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("spectrum", F.lit(48)).cast("double"), 6).alias("last"))


def prepared_signatures(spark, sf_dir):
    """Class means over the union of two scenes, named."""
    px = C.pixels(spark, sf_dir).withColumn("label", (F.col("p") % 11).cast("short"))
    rows = scenes.prepared_library([px.where("p % 2 = 0"), px.where("p % 2 = 1")], spark)
    return rows.select(F.col("label").cast("long").alias("label"), "name", "n", F.posexplode("values").alias("band", "v")).select("label", "name", "n", "band", F.round("v", 6).alias("value"))


def masked_mean(spark, sf_dir):
    px = C.pixels(spark, sf_dir)
    return moments.mean_spectrum(px, F.col("label") == 3).select(F.posexplode("values").alias("band", "v")).select("band", F.round("v", 6).alias("value"))


def background_minimum(spark, sf_dir):
    return C._rounded(evaluate.background_minimum(C._scores(spark, sf_dir)), "least")


def scores_with_truth(spark, sf_dir):
    """Scores meet a truth table by place; labels above the last valid one take no part."""
    truth = C.pixels(spark, sf_dir).select("frame_index", "p", "label")
    both = evaluate.labelled(C._scores(spark, sf_dir).drop("label"), truth)
    return C._rounded(both.select("p", "target", F.col("label").cast("long").alias("label"), "score"), "score")


def _found(spark, sf_dir):
    return detect.detect(C._scores(spark, sf_dir), DetectionParams(C.WIDE, 1, None))


def detections_on_target(spark, sf_dir):
    truth = C.pixels(spark, sf_dir).select("frame_index", "p", "label")
    hits, false = detect.on_target(_found(spark, sf_dir), truth, C.WIDTH)
    return hits.select("p", "target", F.lit(True).alias("hit")).unionByName(false.select("p", "target", F.lit(False).alias("hit")))


def first_detections(spark, sf_dir):
    return detect.first_detections(_found(spark, sf_dir), 5).select("y", "x", "target")


def missing_spectra(spark, sf_dir):
    """Every seventh spectrum is null: no target and no share in the moments, whatever the form."""
    px = C.pixels(spark, sf_dir).withColumn("spectrum", F.when(F.col("p") % 7 != 0, F.col("spectrum")))
    lib = C._class_library(spark, sf_dir)
    out = None
    for form in ("sql", "arrow"):
        best = scoring.sam_best(px, lib, strategy=form).select(F.lit(form).alias("form"), "p", "target", F.when(F.col("target") >= 0, F.col("score")).alias("score"))
        out = best if out is None else out.unionByName(best)
    m = moments.moments(px)
    return C._rounded(out, "score").withColumn("n", F.lit(int(m.n)).cast("long")).withColumn("sum0", F.lit(round(float(m.s[0]), 5)))


def _banded(spark, sf_dir):
    px = layout.select_bands(C.pixels(spark, sf_dir), list(range(FEW)))
    lib = moments.class_library(px)
    return px, lib, moments.build_statistics(moments.moments(px), lib, C.LOADING)


def _matrix_form(spark, sf_dir, name):
    px, lib, stats = _banded(spark, sf_dir)
    return C._rounded(scoring.score(px, name, lib, stats, strategy="arrow").select("p", "target", "score"), "score", digits=5)


def rx_matrix(spark, sf_dir):
    """The matrix form over the first eight bands; so the next two."""
    return _matrix_form(spark, sf_dir, "rx")


def ace_matrix(spark, sf_dir):
    return _matrix_form(spark, sf_dir, "ace")


def cem_matrix(spark, sf_dir):
    return _matrix_form(spark, sf_dir, "cem")


def sql_functions(spark, sf_dir):
    """spectral_angle, gamma_p and rx_threshold in SQL; with whole numbers of pairs of bands the distribution has a closed form."""
    spectral.register(spark)
    C.pixels(spark, sf_dir).createOrReplaceTempView("prismlake_pixels")
    angles = spark.sql("SELECT 'angle' AS what, CAST(a.p AS DOUBLE) AS x, round(spectral_angle(a.spectrum, b.spectrum), 6) AS value FROM prismlake_pixels a JOIN prismlake_pixels b ON b.p = a.p + 1 WHERE a.p < 40")
    C._table(spark, sf_dir, "lineitem").createOrReplaceTempView("prismlake_items")
    gamma = spark.sql("SELECT DISTINCT 'gamma' AS what, CAST(l_quantity AS DOUBLE) AS x, round(gamma_p(2D, CAST(l_quantity AS DOUBLE)), 6) AS value FROM prismlake_items")
    tail = spark.sql("SELECT DISTINCT 'tail' AS what, CAST(l_quantity AS DOUBLE) AS x, round(ln(gamma_q(2D, CAST(l_quantity AS DOUBLE))), 6) AS value FROM prismlake_items")
    limits = spark.sql("SELECT DISTINCT 'limit' AS what, CAST(l_tax AS DOUBLE) AS x, round(rx_threshold(2, CAST(l_tax AS DOUBLE)), 6) AS value FROM prismlake_items WHERE l_tax > 0")
    return angles.unionByName(gamma).unionByName(tail).unionByName(limits)


def detector_registry(spark, sf_dir):
    """Every detector of the registry, driven by its traits alone, over the first eight bands: pixels scored, and the best score."""
    px, lib, stats = _banded(spark, sf_dir)
    out = None
    for t in DETECTORS.values():
        scores = scoring.score(px, t.name, lib if t.needs_targets else None, stats if t.needs_statistics else None)
        best = F.min("score") if t.polarity is Polarity.LOWER else F.max("score")
        traits = (F.lit(v).alias(n) for n, v in (("name", t.name), ("needs_targets", t.needs_targets), ("needs_statistics", t.needs_statistics), ("polarity", t.polarity.value), ("compute_bound", t.compute_bound)))
        row = scores.agg(F.count(F.lit(1)).alias("n"), F.round(best.cast("double"), 4).alias("best")).select(*traits, "n", "best")
        out = row if out is None else out.unionByName(row)
    return out


def timing_spread(spark, sf_dir):
    """Median, least and largest time, and the spread between them in per cent of the median, by kind of event."""
    e = C._table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("least"), F.max("value").alias("largest"))
    return C._rounded(e.withColumn("spread_pct", 100 * (F.col("largest") - F.col("least")) / F.col("median")), "median", "least", "largest", "spread_pct", digits=4)


def lagged_statistics(spark, sf_dir):
    """Two batches of pixels: the second one's moments are taken from differences from the first one's mean."""
    from ..streaming.detector import LaggedStatistics

    px = layout.select_bands(C.pixels(spark, sf_dir), list(range(FEW)))
    lag, rows = LaggedStatistics(None, C.LOADING), []
    for k in range(2):
        _, m = lag.next(px.where(f"p % 2 = {k}"))
        rows += [(k, b, float(m.n), float(m.mean()[b])) for b in range(FEW)]
    return C._rounded(spark.createDataFrame(rows, "batch int, band int, n double, mean double"), "mean")


def _event_pixels(events: DataFrame) -> DataFrame:
    """Kinds of events are streams, hours are frames, and the logarithm of the value and the root of the user make two bands."""
    return events.select(F.col("event_type").alias("stream"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("frame_index"), F.array(F.log1p(F.abs(F.col("value").cast("double"))), F.sqrt(F.col("user_id").cast("double") + 1)).alias("spectrum"))


def _lagged_rows(rows: DataFrame) -> DataFrame:
    at = lambda c, k, name: F.round(F.get(c, F.lit(k)), 5).alias(name)
    return rows.select("stream", "frame_index", F.col("n").cast("long").alias("n"), at("mean", 0, "mean0"), at("mean", 1, "mean1"), at("covariance", 1, "cov01"), at("lagged_mean", 0, "lag0"), at("lagged_mean", 1, "lag1"), at("lagged_products", 3, "about11"))


def lagged_table(spark, sf_dir):
    """Statistics of each frame and the mean of the one before it, from a table."""
    return _lagged_rows(lagged.lagged_table(_event_pixels(C._table(spark, sf_dir, "events"))))


def lagged_streams(spark, sf_dir):
    """The same from a stream, with state: five streams at once, in four batches, in two runs from one checkpoint."""
    folder, out = C._folder(spark), C._folder(spark)
    px = _event_pixels(C._table(spark, sf_dir, "events"))
    least, most = px.agg(F.min("frame_index"), F.max("frame_index")).first()
    cuts = [least + (most + 1 - least) * k // 4 for k in range(5)]
    os.mkdir(f"{folder}/pixels")
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pixels")
    for k in range(4):
        px.where((F.col("frame_index") >= cuts[k]) & (F.col("frame_index") < cuts[k + 1])).coalesce(1).write.mode("append").parquet(f"{folder}/pixels")
        if k % 2:  # each run ends when it has taken what is there, and the next one goes on from the checkpoint
            rows = lagged.lagged_stream(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
            rows.trigger(availableNow=True).start().awaitTermination()
    return _lagged_rows(lagged.last_of_each(spark, f"{out}/rows"))


def sam_large_library(spark, sf_dir):
    """The mean spectra of all parts are a library that is searched by clusters, for the nearest to each item."""
    items = C.items(spark, sf_dir).drop("l_returnflag")
    parts = C._table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("label"), F.array(*[(F.col(c) / s).cast("double") for c, s in C.SCALE]).alias("spectrum"))
    library = moments.class_means(parts, "label", bands=len(C.SCALE)).select(F.col("label").alias("target_id"), "values")
    return C._rounded(search.sam_nearest(items, library, folder=C._folder(spark)).select("l_orderkey", "l_linenumber", "target", "score"), "score", digits=5)


QUERIES = (
    envi_bil_int16_big, envi_bip_uint16, envi_bsq_double, envi_replay, library_csv_roundtrip, mosaic_video, raster_roundtrip, scene_with_annotation, prepared_signatures, masked_mean, background_minimum,
    scores_with_truth, detections_on_target, first_detections, missing_spectra, rx_matrix, ace_matrix, cem_matrix, sql_functions, detector_registry, timing_spread, lagged_statistics, scene_lines, header_catalogue, lagged_table, lagged_streams, sam_large_library,
)


def oracle_sql() -> dict[str, str]:
    cube = lambda value: f"WITH {C._PX}, {C._LONG} SELECT p, CAST(p // {C.WIDTH} AS INTEGER) AS y, CAST(p % {C.WIDTH} AS INTEGER) AS x, CAST(band AS INTEGER) AS band, round(CAST({value} AS FLOAT)::DOUBLE, 6) AS value FROM lg"
    whole = lambda v, scale: f"floor({v} * {scale} + 0.5) / {scale}"
    width, height = MOSAIC
    sensor = "CASE band " + " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(ORDER)) + " END"
    names = " ".join(f"WHEN {k} THEN '{v}'" for k, v in scenes.CLASSES.items())
    found = f"{C._SAM}, {C._survivors(1, C.WIDE)}"
    few = f"WITH {C._PX}, it AS (SELECT p AS rid, p, label, {', '.join(f'e[{k + 1}] AS b{k}' for k in range(FEW))} FROM px)"
    second = C.second_order(few, FEW, "p", "label")
    short = lambda e: f"{e}[1:{FEW}]"
    few_sam = f"WITH {C._PX}, {C._LONG}, {C._MEANS}, {C._LIB} SELECT p, min(acos(list_dot_product({short('e')}, {short('r')}) / (sqrt(list_dot_product({short('e')}, {short('e')})) * sqrt(list_dot_product({short('r')}, {short('r')}))))) AS score FROM px, lib GROUP BY p"
    hours = "hx AS (SELECT event_type AS stream, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame_index, ln(1 + abs(CAST(value AS DOUBLE))) AS b0, sqrt(CAST(user_id AS DOUBLE) + 1) AS b1 FROM events), h AS (SELECT stream, frame_index, count(*) AS n, avg(b0) AS m0, avg(b1) AS m1, covar_pop(b0, b1) AS c, sum(b1 * b1) AS q FROM hx GROUP BY ALL), l AS (SELECT *, lag(m0) OVER w AS l0, lag(m1) OVER w AS l1 FROM h WINDOW w AS (PARTITION BY stream ORDER BY frame_index))"
    lag_sql = f"WITH {hours} SELECT stream, frame_index, n, round(m0, 5) AS mean0, round(m1, 5) AS mean1, round(c, 5) AS cov01, round(l0, 5) AS lag0, round(l1, 5) AS lag1, round(q - 2 * l1 * n * m1 + n * l1 * l1, 5) AS about11 FROM l"
    bands = range(len(C.SCALE))
    spectra = ", ".join(f"{c} / {k} AS b{i}" for i, (c, k) in enumerate(C.SCALE))
    unit = lambda of: ", ".join(f"b{i} / sqrt({' + '.join(f'b{k} * b{k}' for k in bands)}) AS {of}{i}" for i in bands)
    cosine = " + ".join(f"u{i} * v{i}" for i in bands)
    return {
        "sam_large_library": f"WITH it AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, {spectra} FROM lineitem), lb AS (SELECT l_partkey AS target, {unit('v')} FROM (SELECT l_partkey, {', '.join(f'avg(b{i}) AS b{i}' for i in bands)} FROM it GROUP BY l_partkey)), px AS (SELECT rid, l_orderkey, l_linenumber, {unit('u')} FROM it), s AS (SELECT rid, l_orderkey, l_linenumber, arg_max(target, {cosine}) AS target, max({cosine}) AS c FROM px, lb GROUP BY rid, l_orderkey, l_linenumber) SELECT l_orderkey, l_linenumber, CAST(target AS BIGINT) AS target, round(acos(least(1.0, c)), 5) AS score FROM s",
        "envi_bil_int16_big": cube(whole("v", "32767.0::DOUBLE")), "envi_bip_uint16": cube(whole("abs(v)", "65535.0::DOUBLE")), "envi_bsq_double": cube("v"),
        "envi_replay": f"WITH {C._PX}, {C._LONG} SELECT f AS frame_index, round(sum(CAST(v * (f % 2 + 1) AS FLOAT)::DOUBLE), 5) AS total, count(*) AS values FROM lg, range(4) r(f) GROUP BY f",
        "scene_lines": f"WITH {C._PX}, {C._LONG} SELECT 'scene2' AS scene, 2::BIGINT AS frame_index, p, CAST(p // {C.WIDTH} AS INTEGER) AS y, CAST(band AS INTEGER) AS band, round(CAST(v * 3 AS FLOAT)::DOUBLE, 5) AS value FROM lg WHERE p // {C.WIDTH} BETWEEN {LINES[0]} AND {LINES[1]} AND p % 2 = 0",
        "header_catalogue": f"WITH n AS (SELECT CAST((max(vec_id) + {C.WIDTH}) // {C.WIDTH} AS INTEGER) AS h FROM embeddings), s AS (SELECT * FROM (VALUES ('scene0', 'bsq'), ('scene1', 'bil'), ('scene2', 'bip')) t(scene, interleave), n) SELECT scene, h AS lines, {C.WIDTH} AS samples, 64 AS bands, interleave, field, value FROM (SELECT *, unnest(['samples', 'lines', 'bands', 'header offset', 'file type', 'data type', 'interleave', 'byte order']) AS field, unnest(['{C.WIDTH}', CAST(h AS VARCHAR), '64', '0', 'ENVI Standard', '4', interleave, '0']) AS value FROM s)",
        "library_csv_roundtrip": f"WITH {C._PX}, {C._LONG}, {C._MEANS}, {C._LIB} SELECT CAST(target AS INTEGER) AS target_id, CAST(label AS VARCHAR) AS name, CAST(b AS INTEGER) AS band, round(CAST(v AS FLOAT)::DOUBLE, 5) AS value, 400 + 2.5::DOUBLE * b AS nm FROM (SELECT target, label, unnest(range(64)) AS b, unnest(r) AS v FROM lib)",
        "mosaic_video": f"WITH m AS (SELECT l_linenumber - 1 AS f, l_orderkey % {width} AS x, l_partkey % {height} AS y, CAST(sum(CAST(l_quantity AS BIGINT)) * 37 % 65536 AS BIGINT) AS v FROM lineitem WHERE l_linenumber <= {FRAMES} GROUP BY ALL), t AS (SELECT f, y, x, band, {sensor} AS o FROM (SELECT DISTINCT f FROM m), range({height // 2}) b(y), range({width // 2}) c(x), range(4) d(band)) SELECT CAST(t.f AS BIGINT) AS frame_index, CAST(t.y AS INTEGER) AS y, CAST(t.x AS INTEGER) AS x, CAST(band AS INTEGER) AS band, round(CAST(coalesce(v, 0) / 65535.0::DOUBLE AS FLOAT)::DOUBLE, 6) AS value FROM t LEFT JOIN m ON m.f = t.f AND m.x = 2 * t.x + o % 2 AND m.y = 2 * t.y + o // 2",
        "raster_roundtrip": f"{C._SAM} SELECT p, round(CAST(score AS FLOAT)::DOUBLE, 5) AS score, CAST(target AS INTEGER) AS target, label FROM best",
        "scene_with_annotation": f"WITH {C._PX} SELECT p, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE WHEN p % 11 <= 8 THEN p % 11 ELSE 255 END AS INTEGER) AS label, 49 AS bands, round(e[6], 6) AS first, round(e[57], 6) AS last FROM px",
        "prepared_signatures": f"WITH {C._PX}, lg AS (SELECT p % 11 AS label, unnest(range(64)) AS band, unnest(e) AS v FROM px WHERE p % 11 BETWEEN 1 AND 8) SELECT label, CASE label {names} END AS name, count(*) AS n, CAST(band AS INTEGER) AS band, round(avg(v), 6) AS value FROM lg GROUP BY label, band",
        "masked_mean": f"WITH {C._PX}, {C._LONG} SELECT CAST(band AS INTEGER) AS band, round(avg(v), 6) AS value FROM lg WHERE label = 3 GROUP BY band",
        "background_minimum": f"{C._SAM} SELECT round(min(score), 6) AS least FROM best WHERE label = 0",
        "scores_with_truth": f"{C._SAM} SELECT p, CAST(target AS INTEGER) AS target, label, round(score, 6) AS score FROM best WHERE label <= 8",
        "detections_on_target": f"{found} SELECT p, CAST(target AS INTEGER) AS target, label > 0 AND label = target + 1 AS hit FROM sv",
        "first_detections": f"{found} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(target AS INTEGER) AS target FROM sv ORDER BY p LIMIT 5",
        "missing_spectra": f"{C._SAM}, m AS (SELECT count(*) AS n, round(sum(e[1]), 5) AS sum0 FROM px WHERE p % 7 <> 0) SELECT form, p, CAST(CASE WHEN p % 7 = 0 THEN -1 ELSE target END AS INTEGER) AS target, CASE WHEN p % 7 <> 0 THEN round(score, 6) END AS score, n, sum0 FROM best, m, (VALUES ('sql'), ('arrow')) f(form)",
        "rx_matrix": second["rx"], "ace_matrix": second["ace"], "cem_matrix": second["cem"],
        "sql_functions": f"WITH {C._PX} SELECT 'angle' AS what, CAST(a.p AS DOUBLE) AS x, round(acos(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) AS value FROM px a JOIN px b ON b.p = a.p + 1 WHERE a.p < 40 UNION ALL (SELECT DISTINCT 'gamma', CAST(l_quantity AS DOUBLE), round(1 - exp(-CAST(l_quantity AS DOUBLE)) * (1 + CAST(l_quantity AS DOUBLE)), 6) FROM lineitem) UNION ALL (SELECT DISTINCT 'tail', CAST(l_quantity AS DOUBLE), round(ln(1 + CAST(l_quantity AS DOUBLE)) - CAST(l_quantity AS DOUBLE), 6) FROM lineitem) UNION ALL (SELECT DISTINCT 'limit', CAST(l_tax AS DOUBLE), round(-2 * ln(CAST(l_tax AS DOUBLE)), 6) FROM lineitem WHERE l_tax > 0)",
        "detector_registry": " UNION ALL ".join(f"SELECT '{n}' AS name, {t} AS needs_targets, {st} AS needs_statistics, '{pol}' AS polarity, {cb} AS compute_bound, count(*) AS n, round({agg}(score), 4) AS best FROM ({sub})" for n, t, st, pol, cb, agg, sub in (
            ("sam", "true", "false", "lower", "false", "min", few_sam), ("rx", "false", "true", "higher", "true", "max", second["rx"]), ("ace", "true", "true", "higher", "true", "max", second["ace"]), ("cem", "true", "true", "higher", "false", "max", second["cem"]))),
        "timing_spread": "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(min(value), 4) AS least, round(max(value), 4) AS largest, round(100 * (max(value) - min(value)) / quantile_cont(value, 0.5), 4) AS spread_pct FROM events GROUP BY 1",
        "lagged_table": lag_sql, "lagged_streams": lag_sql,
        "lagged_statistics": f"WITH {C._PX} SELECT CAST(p % 2 AS INTEGER) AS batch, CAST(b AS INTEGER) AS band, CAST(count(*) AS DOUBLE) AS n, round(avg(e[b + 1]), 6) AS mean FROM px, range({FEW}) t(b) GROUP BY 1, 2",
    }
