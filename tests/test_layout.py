import numpy as np
import pytest
from helpers import pixel_table
from pyspark.sql import functions as F

from prismlake.model import CubeShape, Interleave
from prismlake.operators import layout as L
from prismlake.operators.library import Library, collect_library, flatten, norms

SHAPE = CubeShape(5, 7, 3)
CUBE = (np.arange(105, dtype=np.float32) * 0.25).reshape(5, 7, 3)


@pytest.mark.parametrize("a", list(Interleave))
@pytest.mark.parametrize("b", list(Interleave))
def test_conversions_come_back(a, b):
    flat = L.from_bip(CUBE, a)
    there = L.convert_interleave(flat, SHAPE, a, b)
    assert (L.convert_interleave(there, SHAPE, b, a) == flat).all()
    y, x, band = 3, 5, 2
    assert there[L.offset(b, SHAPE, y, x, band)] == CUBE[y, x, band]


@pytest.mark.parametrize("layout", list(Interleave))
def test_tables_and_arrays_agree(spark, layout):
    long = L.elements(pixel_table(spark, CUBE), SHAPE, layout)
    values = [r["value"] for r in long.orderBy("position").collect()]
    assert values == L.from_bip(CUBE, layout).tolist()
    back = L.from_elements(long, SHAPE, layout).orderBy("p").collect()
    assert [r["spectrum"] for r in back] == CUBE.reshape(-1, 3).tolist()


@pytest.mark.parametrize("a", list(Interleave))
@pytest.mark.parametrize("b", list(Interleave))
def test_strips_of_blocks_are_transposed(spark, a, b):
    """Blocks of two lines, the last of one; strips come in any order and length."""
    made = L.strips(pixel_table(spark, CUBE), SHAPE, a, lines=2)
    flat = L.from_bip(CUBE, a)
    for r in made.collect():
        values = np.frombuffer(r["data"], "<f4")
        assert (values == flat[r["start"] : r["start"] + len(values)]).all()
    odd = spark.createDataFrame([(0, s, flat[s : s + 11].astype("<f4").tobytes()) for s in range(0, 105, 11)][::-1], L.STRIPS)
    for source in (made, odd):
        there = L.convert_strips(source, SHAPE, a, b, lines=2)
        rows = sorted((r["start"], bytes(r["data"])) for r in there.collect())
        assert b"".join(d for _, d in rows) == L.from_bip(CUBE, b).astype("<f4").tobytes()
    back = L.from_strips(there, SHAPE, b, lines=2).orderBy("p").collect()
    assert [r["spectrum"] for r in back] == CUBE.reshape(-1, 3).tolist() and [(r["p"], r["y"], r["x"]) for r in back] == [(p, p // 7, p % 7) for p in range(35)]


def test_what_strips_shuffle_is_the_cube(spark):
    """A conversion shuffles a row for each band of a block, all together the cube's bytes."""
    cube = np.random.default_rng(1).normal(size=(24, 50, 20)).astype(np.float32)
    shape = CubeShape(24, 50, 20)
    cut = L._cut(L.strips(pixel_table(spark, cube), shape, "bsq", lines=8), shape, Interleave.BSQ, 8)
    rows = cut.selectExpr("count(*) AS n", "sum(length(data)) AS bytes").first()
    assert rows["n"] == 3 * 20 and rows["bytes"] == cube.nbytes
    assert L.block_lines(shape) == 24 and L.block_lines(CubeShape(10_000, 1000, 500)) == 2 and L.block_lines(CubeShape(10, 100_000, 500)) == 1


def test_strips_that_do_not_fill_a_cube_are_refused(spark):
    px = pixel_table(spark, CUBE)
    for bad in (px.where("p <> 9"), px.union(px.where("p = 9")), px.withColumn("p", px["p"] + 40), px.withColumn("spectrum", F.slice("spectrum", 1, 2))):
        with pytest.raises(Exception, match="need each pixel once|outside of|bands"):
            L.strips(bad, SHAPE, "bsq", lines=2).collect()
    good = L.strips(px, SHAPE, "bsq", lines=2)
    for bad in (good.where("start <> 0"), good.union(good.where("start = 0")), good.withColumn("start", F.col("start") + 100), good.withColumn("data", F.expr("substr(data, 1, length(data) - 1)"))):
        with pytest.raises(Exception, match="exactly once|isn't within"):
            L.convert_strips(bad, SHAPE, "bsq", "bip", lines=2).collect()
    assert L.strips(px.where("false"), SHAPE, "bil").count() == 0 and L.from_strips(good.where("false"), SHAPE, "bsq").count() == 0


def test_wrong_sizes_are_refused():
    with pytest.raises(ValueError):
        L.convert_interleave(np.zeros(5), SHAPE, "bsq", "bip")


def test_demosaic_of_arrays_and_tables(spark):
    raw = np.arange(7 * 9, dtype=np.float32).reshape(7, 9)
    cube = L.demosaic(raw, 2, 4)
    assert cube.shape == (3, 4, 4) and cube[1, 2].tolist() == [raw[2, 4], raw[2, 5], raw[3, 4], raw[3, 5]]
    assert (L.demosaic(raw, 2, 4, [3, 2, 1, 0]) == cube[:, :, ::-1]).all()
    samples = spark.createDataFrame([(0, x, y, float(raw[y, x])) for y in range(7) for x in range(9)], "frame_index long, x int, y int, value double")
    rows = L.demosaic_samples(samples, 2, 4, 9, 7).orderBy("p").collect()
    assert [r["spectrum"] for r in rows] == cube.reshape(-1, 4).tolist()
    for bad in (dict(period=2, bands=5), dict(period=2, bands=2, order=[0]), dict(period=2, bands=1, order=[4]), dict(period=20, bands=1)):
        with pytest.raises(ValueError):
            L.demosaic(raw, **bad)


def test_bands_rows_and_half_floats(spark):
    px = pixel_table(spark, CUBE)
    assert L.select_bands(px, [2, 0]).orderBy("p").first()["spectrum"] == [0.5, 0.0]
    kept = L.drop_rows(px, [1, 3], 7).orderBy("p").collect()
    assert len(kept) == 21 and [r["p"] for r in kept] == list(range(21)) and kept[7]["spectrum"] == CUBE[2, 0].tolist()
    odd = pixel_table(spark, CUBE + np.float32(0.0001))
    got = np.array([r["spectrum"] for r in L.quantize_half(odd).orderBy("p").collect()], dtype=np.float32)
    assert (got == (CUBE + np.float32(0.0001)).astype(np.float16).astype(np.float32).reshape(-1, 3)).all()


def test_libraries(spark):
    lib = Library(("a", "b", "a"), np.array([[3, 4], [0, 2], [1, 1]], dtype=np.float32))
    assert lib.norms()[:2].tolist() == [5, 2] and lib.flatten().tolist() == [3, 4, 0, 2, 1, 1]
    assert lib.only("a").values.tolist() == [[3, 4], [1, 1]]
    with pytest.raises(ValueError, match="a, b"):
        lib.only("c")
    df = lib.frame(spark)
    assert [r["norm"] for r in norms(df).orderBy("target_id").collect()][:2] == [5, 2]
    assert [r["value"] for r in flatten(df).orderBy("position").collect()] == [3, 4, 0, 2, 1, 1]
    assert (collect_library(df).values == lib.values).all()
    ragged = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0, 2.0])], "target_id int, name string, values array<float>")
    with pytest.raises(ValueError, match="bands"):
        collect_library(ragged)


def test_half_precision_of_nulls_and_ragged_rows(spark):
    from prismlake.operators.layout import quantize_half

    rows = [(0, [0.1, 2.5, None]), (1, None), (2, []), (3, [1e6, -3.14159])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"p long, spectrum array<{kind}>").coalesce(1)
        got = {r["p"]: r["spectrum"] for r in quantize_half(df).collect()}
        assert got[1] is None and got[2] == [] and got[0][2] is None and got[0][0] == float(np.float16(0.1)) and got[3] == [float("inf"), float(np.float16(-3.14159))]
