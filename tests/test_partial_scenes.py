"""Tables whose last line isn't full, with pixels missing here and there."""

import os

import numpy as np
import pytest
from helpers import duck, pixel_table
from pyspark.sql import functions as F

from prismlake.model import CubeShape
from prismlake.operators import layout as L
from prismlake.plans import catalog
from prismlake.sources import envi

HOLES = (30, 99, 100)


def same(spark, name, folder):
    got, c = catalog.queries()[name](spark, folder).toPandas(), duck(folder)
    c.register("got", got)
    c.execute(f"CREATE TABLE want AS {catalog.oracle_sql()[name]}")
    columns = ", ".join(sorted(got.columns))
    assert len(got) == c.execute("SELECT count(*) FROM want").fetchone()[0] > 0
    assert c.execute(f"SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM want").fetchall() == []


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """137 pixels in lines of 25; one has no spectrum, two have no row."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("ragged"))
    for f in os.listdir("/root/testdata/sf0.001"):
        if not f.startswith("embeddings"):
            os.symlink(f"/root/testdata/sf0.001/{f}", f"{folder}/{f}")
    duckdb.sql(f"COPY (SELECT vec_id, CASE WHEN vec_id <> {HOLES[0]} THEN embedding END AS embedding, label FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 137 AND vec_id NOT IN {HOLES[1:]}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["bsq_roundtrip"])
def test_strips_of_a_ragged_table(spark, ragged, name):
    same(spark, name, ragged)


def test_strips_with_pixels_missing(spark):
    shape = CubeShape(5, 7, 3)
    cube = np.arange(105, dtype=np.float32).reshape(5, 7, 3)
    px = pixel_table(spark, cube).where("p NOT IN (9, 34) AND y <> 0")
    made = L.convert_strips(L.strips(px, shape, "bsq", lines=2, partial=True), shape, "bsq", "bip", lines=2)
    back = {r["p"]: r["spectrum"] for r in L.from_strips(made, shape, "bip", lines=2).collect()}
    assert all(np.isnan(v).all() if p in (9, 34) or p < 7 else v == cube.reshape(-1, 3)[p].tolist() for p, v in back.items()) and len(back) == 35
    with pytest.raises(Exception, match="need each pixel once"):
        L.strips(px.union(px.where("p = 8")), shape, "bsq", lines=2, partial=True).collect()


@pytest.mark.parametrize("kind", [{}, {"data_type": 2, "interleave": "bil", "big_endian": True, "header_offset": 16}, {"data_type": 12, "interleave": "bip"}])
def test_cubes_with_pixels_missing(spark, tmp_path, kind):
    """Pixels that were not written are no rows, though the file has a place for them; a zero pixel stays."""
    shape, cube = CubeShape(5, 7, 3), np.linspace(0, 1, 105, dtype=np.float32).reshape(5, 7, 3)
    cube[2, 3] = 0
    px, stem = pixel_table(spark, cube), str(tmp_path / "scene")
    some = px.where("p NOT IN (9, 34)")
    with pytest.raises(Exception, match="pixels written"):
        envi.write_cube(stem, some, shape, **kind)
    header = envi.write_cube(stem, some, shape, partial=True, **kind)
    rows = spark.read.format("prismlake_envi").option("lines_per_partition", 2).load(header).orderBy("p").collect()
    assert [r["p"] for r in rows] == [p for p in range(35) if p not in (9, 34)] and [r["y"] * 7 + r["x"] for r in rows] == [r["p"] for r in rows]
    assert np.abs(np.array([r["spectrum"] for r in rows]) - np.delete(cube.reshape(-1, 3), (9, 34), axis=0)).max() < 1e-4
    with pytest.raises(Exception, match="one is double"):
        envi.write_cube(stem, some.union(some.where("p = 8")), shape, partial=True, **kind)
    assert sorted(os.listdir(tmp_path)) == ["scene.float", "scene.hdr", "scene.there"]
    envi.write_cube(stem, px, shape, partial=True, **kind)  # nothing is missing now, so nothing is marked
    assert spark.read.format("prismlake_envi").load(header).count() == 35 and sorted(os.listdir(tmp_path)) == ["scene.float", "scene.hdr"]
    envi.write_cube(stem, some, shape, partial=True, **kind)
    envi.write_cube(stem, px, shape, **kind)
    assert spark.read.format("prismlake_envi").load(header).count() == 35
    with open(tmp_path / "scene.there", "wb") as f:
        f.write(b"\1")
    with pytest.raises(Exception, match="35 are expected"):
        spark.read.format("prismlake_envi").load(header).count()


@pytest.mark.parametrize("name", ["envi_bil_int16_big", "envi_bip_uint16", "envi_bsq_double", "envi_replay", "envi_roundtrip", "header_catalogue", "scene_lines", "scene_with_annotation", "stream_detect"])
def test_files_of_a_ragged_table(spark, ragged, name):
    same(spark, name, ragged)


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """16,005 pixels, of which those with even x and y are a class of their own: 4173 detections, more than the cap of a frame by default."""
    import duckdb
    import pandas as pd

    folder, n = str(tmp_path_factory.mktemp("crowded")), 16_005
    p = np.arange(n)
    hit = (p // 25 % 2 == 0) & (p % 25 % 2 == 0)
    x = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    x[:, 0] = np.where(hit, 20, 0)
    table = pd.DataFrame({"vec_id": p, "embedding": list(x), "label": hit.astype(np.int32)})  # noqa: F841
    duckdb.sql(f"COPY (SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding, label FROM table) TO '{folder}/embeddings.parquet' (FORMAT parquet)".replace("FROM table", 'FROM "table"'))
    for f in os.listdir("/root/testdata/sf0.001"):
        if not f.startswith("embeddings"):
            os.symlink(f"/root/testdata/sf0.001/{f}", f"{folder}/{f}")
    return folder


@pytest.mark.parametrize("name", ["stream_detect", "detections_on_target", "detections_per_target"])
def test_detections_of_a_large_frame_are_all_there(spark, crowded, name):
    same(spark, name, crowded)


def test_all_lines_of_a_tall_scene_stay(spark, crowded):
    same(spark, "scene_with_annotation", crowded)
