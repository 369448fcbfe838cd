import struct
import zlib

import numpy as np
import pytest
from helpers import pixel_table

from prismlake.model import CubeShape, DetectionParams
from prismlake.operators import scoring
from prismlake.operators.detect import detect, on_target
from prismlake.sources import envi, library_csv, mosaic, png, raster, synthetic

HEADER = """ENVI
; a comment = with a key
description = {made here, a = b,
  and more}
samples = 5
lines   = 3
bands   = 4
data type = 4
; interleave = bip
Interleave = BIL
wavelength = {400, 450,
 500,
 550}
"""


def write(folder, name, header, data):
    (folder / f"{name}.hdr").write_text(header)
    (folder / f"{name}.float").write_bytes(data)
    return str(folder / f"{name}.hdr")


def cube_of(h, w, b):
    y, x, k = np.mgrid[:h, :w, :b]
    return (100 * k + 10 * y + x).astype(np.float32)


def test_envi_lines(tmp_path, spark):
    cube = cube_of(3, 5, 4)
    path = write(tmp_path, "a", HEADER, cube.transpose(0, 2, 1).astype("<f4").tobytes())
    got, header = envi.read_cube(path)
    assert (got == cube).all() and header.wavelengths_nm == (400, 450, 500, 550)
    assert header.fields["description"].startswith("{made here") and not any(k.startswith(";") for k in header.fields)
    envi.register(spark)
    rows = spark.read.format("prismlake_envi").option("lines_per_partition", 1).load(path).orderBy("p").collect()
    assert [r["spectrum"] for r in rows] == cube.reshape(-1, 4).tolist() and rows[7]["y"] == 1 and rows[7]["x"] == 2
    some = spark.read.format("prismlake_envi").option("bands", "3,1").load(path).orderBy("p").first()
    assert some["spectrum"] == [300.0, 100.0]
    assert envi.frames(spark, path).first()["bands"] == 4


@pytest.mark.parametrize("code,values,expected", [
    (12, [0, 32767, 65535, 16383], [0, 32767 / 65535, 1, 16383 / 65535]), (1, [0, 255, 51, 1], [0, 1, 0.2, 1 / 255]), (2, [-32767, 0, 32767, 1], [-1, 0, 1, 1 / 32767]),
    (3, [2147483647, 0, 1, -1], [1, 0, 0, 0]), (13, [4294967295, 0, 2147483647, 1], [2, 0, 1, 0]), (5, [0.5, -1, 2, 3], [0.5, -1, 2, 3]),
])
@pytest.mark.parametrize("big", [0, 1])
def test_envi_types_and_byte_order(tmp_path, code, values, expected, big):
    kind = (">" if big else "<") + envi.SAMPLE_TYPES[code]
    header = f"ENVI\nsamples = 2\nlines = 2\nbands = 1\ndata type = {code}\nbyte order = {big}\nheader offset = 3\n"
    got, _ = envi.read_cube(write(tmp_path, "t", header, b"abc" + np.array(values).astype(kind).tobytes() + b"rest"))
    assert got.reshape(-1).tolist() == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("header,said", [
    ("nothing", "not an ENVI"), ("ENVI\nsamples = 2\nlines = 2\n", "missing"), ("ENVI\nsamples = 2\nlines = 0\nbands = 1\ndata type = 4", "positive"),
    ("ENVI\nsamples = 2\nlines = 1\nbands = 1\ndata type = 9", "not supported"), ("ENVI\nsamples = 2\nlines = 1\nbands = 1\ndata type = 4\ninterleave = xyz", "interleave"),
    ("ENVI\nsamples = two\nlines = 1\nbands = 1\ndata type = 4", "whole number"), ("ENVI\nsamples = 9\nlines = 9\nbands = 1\ndata type = 4", "needed"),
])
def test_envi_errors(tmp_path, header, said):
    with pytest.raises(ValueError, match=said):
        envi.read_cube(write(tmp_path, "e", header, b"1234"))


def test_envi_other_errors(tmp_path):
    with pytest.raises(ValueError, match="cannot open"):
        envi.read_header(str(tmp_path / "no.hdr"))
    (tmp_path / "x.hdr").write_text("ENVI\nsamples = 1\nlines = 1\nbands = 1\ndata type = 4\nwavelength = {a, b}\n")
    assert envi.read_header(str(tmp_path / "x.hdr")).wavelengths_nm == () and envi.find_data_file(str(tmp_path / "x.hdr")) == ""


def test_cubes_are_written_and_read_back(tmp_path, spark):
    cube = np.random.default_rng(0).uniform(size=(6, 4, 3)).astype(np.float32)
    path = envi.write_cube(str(tmp_path / "out"), pixel_table(spark, cube).repartition(3), CubeShape(6, 4, 3), (400.5, 410.25, 420.0))
    got, header = envi.read_cube(path)
    assert (got == cube).all() and header.wavelengths_nm == (400.5, 410.25, 420.0)
    with pytest.raises(Exception, match="pixels written"):
        envi.write_cube(str(tmp_path / "short"), pixel_table(spark, cube).where("p < 20"), CubeShape(6, 4, 3))


def test_replay_of_a_folder(tmp_path, spark):
    header = "ENVI\nsamples = 5\nlines = 3\nbands = 4\ndata type = 4\ninterleave = bip\n"
    for k in (0, 1):
        write(tmp_path, f"f{k}", header, (cube_of(3, 5, 4) + 1000 * k).astype("<f4").tobytes())
    envi.register(spark)
    df = spark.read.format("prismlake_envi").option("loops", 2).load(str(tmp_path))
    assert [r["spectrum"][0] for r in df.where("p = 0").orderBy("frame_index").collect()] == [0, 1000, 0, 1000]
    write(tmp_path, "f2", header.replace("bands = 4", "bands = 6"), bytes(3 * 5 * 6 * 4))
    with pytest.raises(Exception, match="differs"):
        spark.read.format("prismlake_envi").load(str(tmp_path)).count()
    assert spark.read.format("prismlake_envi").option("max_resident", 2).load(str(tmp_path)).count() == 30


def encode_png(samples, filters, colour=0):
    """A PNG file of (height, width[, channels]) samples; filters for the rows in turn."""
    depth = samples.dtype.itemsize
    h, w = samples.shape[:2]
    raw = samples.astype(samples.dtype.newbyteorder(">")).tobytes()
    line = len(raw) // h
    step = line // w
    out, above = b"", bytes(line)
    for y in range(h):
        row, kind = raw[y * line : (y + 1) * line], filters[y % len(filters)]
        coded = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        out, above = out + bytes([kind]) + coded, row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_png_filters(filters, dtype):
    x = np.random.default_rng(1).integers(0, np.iinfo(dtype).max, (9, 7), endpoint=True).astype(dtype)
    assert png.decode(encode_png(x, filters)) == pytest.approx(x / np.iinfo(dtype).max, abs=1e-6)


def test_png_colour_and_errors():
    x = np.random.default_rng(2).integers(0, 255, (4, 5, 3)).astype(np.uint8)
    assert png.decode(encode_png(x, [4, 1], colour=2)) == pytest.approx(x[:, :, 0] / 255, abs=1e-6)
    for raw in (b"no", encode_png(x[:, :, 0], [0])[:40], encode_png(x, [0], colour=3)):
        with pytest.raises(ValueError):
            png.decode(raw)


def test_mosaic_video(tmp_path, spark):
    h, w, period = 24, 20, 4
    y, x = np.mgrid[:h, :w]
    band = (y % period) * period + x % period
    frame = 4001 * band + 61 * (y // period) + 7 * (x // period)
    for k in (0, 1):
        (tmp_path / f"f_{k}.{'PNG' if k else 'png'}").write_bytes(encode_png((frame + k).astype(np.uint16), [0, 1, 2, 3]))
    rows = {(r["frame_index"], r["p"]): r for r in mosaic.read_mosaic(spark, str(tmp_path), 4, 16).collect()}
    assert len(rows) == 2 * 6 * 5
    assert rows[1, 7]["spectrum"] == pytest.approx([(4001 * b + 61 * 1 + 7 * 2 + 1) / 65535 for b in range(16)], abs=1e-5)
    assert mosaic.frame_table(spark, str(tmp_path)).orderBy("frame_index").collect()[1]["timestamp_s"] == pytest.approx(1 / 25)
    stream = mosaic.stream_mosaic(spark, str(tmp_path), 4, 16)
    q = stream.writeStream.format("memory").queryName("mosaic").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("mosaic").groupBy("frame_index").count().count() == 2


def test_library_files(tmp_path, spark):
    path = tmp_path / "l.csv"
    lib = library_csv.parse_library("wavelength, 400, 410, 420\nblood,.11,.19,.24\n tomato_concentrate , .31, .28,.22\n")
    library_csv.write_library(lib, str(path))
    back = library_csv.read_library(spark, str(path))
    assert back.names == ("blood", "tomato_concentrate") and (back.values == lib.values).all() and back.wavelengths_nm == (400, 410, 420)
    assert library_csv.parse_library("# c\n\n a , 1 , 2 \n\n#x\nb,3,4\n").names == ("a", "b")
    for text, said in (("a,1,2\nketchup,1\n", "ketchup"), ("a,1,oops\n", "line 1: 'oops'"), ("a,0.1x\n", "0.1x"), ("# only\n", "no target spectra"), ("wavelength,1,2,3\na,1,2\n", "wavelength row"), ("a\n", "line 1")):
        with pytest.raises(ValueError, match=said):
            library_csv.parse_library(text)
    with pytest.raises(ValueError, match="cannot open"):
        library_csv.read_library(spark, str(tmp_path / "no.csv"))


def test_rasters_and_annotations(tmp_path, spark):
    (tmp_path / "m.u8").write_bytes(bytes([0, 1, 255, 8, 9, 2]))
    mask = raster.read_raster(spark, str(tmp_path / "m.u8"), "u8", 6)
    assert [r["label"] for r in raster.truth_from_raster(mask).orderBy("p").collect()] == [0, 1, 255, 8, 9, 2]
    with pytest.raises(Exception, match="entries"):
        raster.read_raster(spark, str(tmp_path / "m.u8"), "u8", 7).count()
    scores = spark.createDataFrame([(2, 0.5), (0, 1.5), (1, 2.5)], "p long, score double")
    raster.write_raster(scores, "score", "f32", str(tmp_path / "s.f32"), 3)
    assert np.fromfile(tmp_path / "s.f32", "<f4").tolist() == [1.5, 2.5, 0.5]
    with pytest.raises(Exception, match="pixels written"):
        raster.write_raster(scores.where("p <> 1"), "score", "f32", str(tmp_path / "x"), 3)
    np.savez(tmp_path / "F_1.npz", gt=np.array([[0, 1, 9], [2, 3, 4]]))
    got = raster.read_annotations(spark, str(tmp_path / "F_1.npz")).withColumn("m", raster.mask_value(raster.F.col("label"))).orderBy("y", "x").collect()
    assert [r["m"] for r in got] == [0, 1, 255, 2, 3, 4] and got[3]["scene"] == "F_1"


def test_synthetic_gain_is_the_same_in_all_frames():
    still = {"targets": 0, "noise": 0.0, "backgrounds": 1}
    even, s = synthetic.Scene(**still, gain_jitter=0.0), synthetic.Scene(**still, gain_jitter=0.3)
    gain = [synthetic.frame(s, k)[0] / synthetic.frame(even, k)[0] for k in (0, 7)]
    assert np.allclose(gain[0], gain[1]) and np.allclose(gain[0], gain[0][..., :1])
    assert 0.7 <= gain[0].min() < 0.75 and 1.25 < gain[0].max() <= 1.3
    assert synthetic.Scene.of({"gain_jitter": "0.2", "backgrounds": "5"}) == synthetic.Scene(gain_jitter=0.2, backgrounds=5)
    with pytest.raises(ValueError):
        synthetic.Scene(backgrounds=0)


def test_synthetic_frames():
    s = synthetic.Scene()
    (a, t), (b, _), (_, later) = synthetic.frame(s, 0), synthetic.frame(s, 0), synthetic.frame(s, 4)
    assert (a == b).all() and set(np.unique(t)) == {0, 1, 2, 3} and (t != later).any()
    spectrum = synthetic.random_spectrum(30, np.random.default_rng(0))
    assert spectrum.max() == pytest.approx(0.9, abs=1e-6) and spectrum.min() >= 0.05 - 1e-6


def test_planted_targets_are_found(spark):
    synthetic.register(spark)
    s = synthetic.Scene()
    px = spark.read.format("prismlake_synthetic").option("frames", 2).load()
    truth = spark.read.format("prismlake_synthetic").option("frames", 2).option("table", "truth").load()
    scores = scoring.sam_best(px, synthetic.library(s)).persist()
    found = detect(scores, DetectionParams(0.05, 4))
    hits, wrong = on_target(found, truth, s.width)
    assert wrong.count() == 0 and hits.select("frame_index", "target").distinct().count() == 6 and found.count() < 48
    background = scores.join(truth, ["frame_index", "p"]).where("label = 0").groupBy().min("score").first()[0]
    assert background > 0.05


def test_mosaic_frames_of_another_size_are_refused(spark, tmp_path):
    from prismlake.sources import mosaic

    for k, shape in enumerate(((8, 8), (8, 10))):
        (tmp_path / f"f{k}.png").write_bytes(png.encode(np.zeros(shape, np.uint16)))
    with pytest.raises(Exception, match="differs from the first frame"):
        mosaic.read_mosaic(spark, str(tmp_path), 2, 4).count()
    (tmp_path / "none").mkdir()
    assert mosaic.read_mosaic(spark, str(tmp_path / "none"), 2, 4).count() == 0


def test_images_are_not_shuffled_to_their_numbers(spark, tmp_path, monkeypatch):
    from prismlake.sources import mosaic

    for k in range(3):
        (tmp_path / f"f{k}.png").write_bytes(png.encode(np.full((4, 4), k, np.uint16)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    near = mosaic.read_mosaic(spark, str(tmp_path), 2, 4)
    assert "BroadcastHashJoin" in plan(near) and "hashpartitioning" not in plan(near)
    monkeypatch.setattr(mosaic, "MOST_NAMES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        far = mosaic.read_mosaic(spark, str(tmp_path), 2, 4)
        assert "BroadcastHashJoin" not in plan(far) and sorted(far.collect()) == sorted(near.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SHAPE = CubeShape(12, 7, 3)


def scene_cube(seed=0, shape=SHAPE):
    return np.random.default_rng(seed).uniform(0, 1, size=(shape.height, shape.width, shape.bands)).astype(np.float32)


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("code,big", [(4, False), (5, True), (2, True), (12, False)])
def test_cubes_of_any_layout_and_type_are_written(tmp_path, spark, interleave, code, big):
    cube = scene_cube(code)
    path = envi.write_cube(str(tmp_path / "c"), pixel_table(spark, cube).repartition(5), SHAPE, (1.5, 2.0, 3.25), data_type=code, interleave=interleave, big_endian=big, header_offset=5)
    got, header = envi.read_cube(path)
    scale = envi.FULL_SCALE.get(envi.SAMPLE_TYPES[code])
    want = cube if scale is None else (np.floor(cube.astype(float) * scale + 0.5) / scale).astype(np.float32)
    assert (got == want).all() and header.header_offset == 5 and header.big_endian is big and header.wavelengths_nm == (1.5, 2.0, 3.25)
    assert header.interleave.value == interleave and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["c.float", "c.hdr"]


def test_a_write_that_fails_leaves_nothing_and_keeps_the_old(tmp_path, spark):
    cube = scene_cube()
    px = pixel_table(spark, cube)
    path = envi.write_cube(str(tmp_path / "c"), px, SHAPE)
    files = lambda: sorted(p.name for p in tmp_path.iterdir())
    before = files()
    fails = px.withColumn("spectrum", envi.F.when(envi.F.col("p") < 70, envi.F.col("spectrum")))  # a task fails in the middle
    double = px.where("p <> 5").union(px.where("p = 6"))
    for bad, said in ((fails, "no spectrum"), (px.where("p <> 3"), "pixels written"), (double, "missing or double"), (px.withColumn("p", envi.F.col("p") + 1), "outside"), (px.withColumn("spectrum", envi.F.array(envi.F.lit(1.0))), "bands")):
        with pytest.raises(Exception, match=said):
            envi.write_cube(str(tmp_path / "c"), bad, SHAPE)
        assert files() == before and (envi.read_cube(path)[0] == cube).all()
    with pytest.raises(Exception, match="fit"):
        envi.write_cube(str(tmp_path / "d"), pixel_table(spark, cube + 1), SHAPE, data_type=2)
    scores = spark.createDataFrame([(0, 1.5), (1, 2.5), (1, 2.5)], "p long, score double")
    with pytest.raises(Exception, match="missing or double"):
        raster.write_raster(scores, "score", "f32", str(tmp_path / "s"), 3)
    with pytest.raises(Exception, match="no value"):
        raster.write_raster(scores.withColumn("score", envi.F.lit(None)), "score", "f32", str(tmp_path / "s"), 3)
    assert files() == before


def test_rasters_are_written_and_read_in_ranges(tmp_path, spark):
    n = 1000
    df = spark.range(n).select(envi.F.col("id").alias("p"), (envi.F.col("id") * 7 % 251).alias("v")).repartition(6)
    for kind in ("f32", "i32", "u8"):
        raster.write_raster(df, "v", kind, str(tmp_path / kind), n)
        got = raster.read_raster(spark, str(tmp_path / kind), kind, n, 3, entries_per_partition=300)
        assert got.rdd.getNumPartitions() == 4
        assert [(r["frame_index"], r["value"]) for r in got.orderBy("p").collect()] == [(3, p * 7 % 251) for p in range(n)]


def planned(spark, df):
    """(partitions, rows read by the scan) of a query over a cube."""
    return df.rdd.getNumPartitions()


def test_filters_choose_lines_frames_and_scenes(tmp_path, spark, monkeypatch):
    for k in range(3):
        envi.write_cube(str(tmp_path / f"scene{k}"), pixel_table(spark, scene_cube(k)), SHAPE)
    load = lambda: spark.read.format("prismlake_envi").options(lines_per_partition=4, scene_column="true").load(str(tmp_path))
    whole = load()
    assert planned(spark, whole) == 9
    rows = {(r["frame_index"], r["p"]): r for r in whole.collect()}
    assert len(rows) == 3 * SHAPE.pixels and {r["scene"] for r in rows.values()} == {"scene0", "scene1", "scene2"}
    cases = [
        ("y between 5 and 6", 3, lambda r: 5 <= r["y"] <= 6), ("frame_index = 1", 3, lambda r: r["frame_index"] == 1), ("scene = 'scene2' and y >= 8", 1, lambda r: r["scene"] == "scene2" and r["y"] >= 8),
        ("scene in ('scene0', 'scene1') and y in (0, 11)", 4, lambda r: r["scene"] != "scene2" and r["y"] in (0, 11)), ("p > 40 and p <= 48 and frame_index < 1", 1, lambda r: 40 < r["p"] <= 48 and r["frame_index"] == 0),
        ("scene like 'scene1%' and y < 1", 1, lambda r: r["scene"] == "scene1" and r["y"] < 1), ("y > 100", 1, lambda r: False), ("x = 2 and y = 3", 3, lambda r: r["x"] == 2 and r["y"] == 3), ("y = 1 or y = 2", None, lambda r: r["y"] in (1, 2)),
        ("y <> 3 and frame_index >= 2", 3, lambda r: r["y"] != 3 and r["frame_index"] == 2), ("p in (0, 83)", 6, lambda r: r["p"] in (0, 83)), ("y = cast(null as int)", None, lambda r: False),
    ]
    for condition, parts, test in cases:
        got = load().where(condition)
        assert parts is None or planned(spark, got) == parts, condition
        assert sorted((r["frame_index"], r["p"]) for r in got.collect()) == sorted(k for k, r in rows.items() if test(r)), condition


def test_lines_that_are_not_asked_for_are_not_read(tmp_path, spark):
    path = envi.write_cube(str(tmp_path / "c"), pixel_table(spark, scene_cube()), SHAPE, interleave="bip")
    reader = envi._Reader({"path": path, "lines_per_partition": 4})
    left = list(reader.pushFilters([envi.ds.GreaterThanOrEqual(("y",), 6), envi.ds.LessThanOrEqual(("y",), 9), envi.ds.IsNotNull(("y",)), envi.ds.EqualTo(("x",), 1), envi.ds.LessThan(("p",), 60)]))
    assert [type(f).__name__ + f.attribute[0] for f in left] == ["EqualTox", "LessThanp"]
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(6, 8), (8, 9)]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) * SHAPE.bands * 4 == 3 * SHAPE.width * SHAPE.bands * 4  # bytes of three lines


def test_headers_as_a_table(tmp_path, spark):
    write(tmp_path, "a", HEADER, bytes(240))
    (tmp_path / "b.hdr").write_text("ENVI\nsamples = 1\nlines = 2\nbands = 1\ndata type = 12\nbyte order = 1\nOwner = someone\n")
    got = {r["scene"]: r for r in envi.catalogue(spark, str(tmp_path)).collect()}
    assert got["a"]["interleave"] == "bil" and got["a"]["wavelengths_nm"] == [400, 450, 500, 550] and got["a"]["fields"]["description"].startswith("{made here")
    assert got["b"]["fields"]["owner"] == "someone" and got["b"]["big_endian"] and got["b"]["wavelengths_nm"] is None and got["b"]["lines"] == 2
    assert [r["bands"] for r in envi.frames(spark, str(tmp_path)).collect()] == [4, 1]


def test_planning_reads_one_header(tmp_path, spark, monkeypatch):
    for k in range(50):
        write(tmp_path, f"f{k:03d}", "ENVI\nsamples = 2\nlines = 1\nbands = 1\ndata type = 4\n", bytes(8))
    opened = []
    real = envi.read_header
    monkeypatch.setattr(envi, "read_header", lambda p: opened.append(p) or real(p))
    stream = envi._Replay({"path": str(tmp_path)})
    assert stream.latestOffset() == stream.latestOffset() == {"frame": 50}
    parts = stream.partitions({"frame": 0}, {"frame": 50}) + stream.partitions({"frame": 50}, {"frame": 50})
    assert len(parts) == 50 and len(opened) == 1
    for p in parts:
        list(stream.read(p))
    assert len(opened) == 51  # and each once by its task


def test_a_bounded_stream_ends_with_all_frames(tmp_path, spark):
    for k in (0, 1, 2):
        write(tmp_path, f"f{k}", "ENVI\nsamples = 2\nlines = 3\nbands = 1\ndata type = 4\n", np.full(6, 10 + k, "<f4").tobytes())
    envi.register(spark)
    seen = []
    q = spark.readStream.format("prismlake_envi").options(loops=2).load(str(tmp_path)).writeStream.foreachBatch(lambda b, n: seen.extend((r["frame_index"], r["spectrum"][0]) for r in b.where("p = 5").orderBy("frame_index").collect()))
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and seen == [(k, 10.0 + k % 3) for k in range(6)]


def test_the_offer_moves_when_a_batch_is_planned(tmp_path, spark):
    for k in range(5):
        write(tmp_path, f"f{k}", "ENVI\nsamples = 2\nlines = 1\nbands = 1\ndata type = 4\n", bytes(8))
    options = {"path": str(tmp_path), "frames_per_batch": "2", "progress": str(tmp_path / "place")}
    stream = envi._Replay(options)
    assert [stream.latestOffset()["frame"] for _ in range(3)] == [2, 2, 2]
    stream.partitions({"frame": 0}, {"frame": 2})
    assert stream.latestOffset() == {"frame": 4}
    again = envi._Replay(options)  # started anew
    assert again.latestOffset() == {"frame": 4}
    again.partitions({"frame": 2}, {"frame": 4})
    assert envi._Replay(options).latestOffset() == {"frame": 5}
