import numpy as np
import pytest
from helpers import pixel_table
from pyspark.sql import functions as F

from prismlake.operators.library import Library
from prismlake.plans import scenes


# Fixed values of the dataset: bands without signal or with an artefact.
NOISY_BANDS = (0, 1, 2, 3, 4, 48, 49, 50, 121, 122, 123, 124, 125, 126, 127)


def test_kept_bands():
    assert scenes.good_bands(128, "A_1") == [b for b in range(128) if b not in NOISY_BANDS]
    assert len(scenes.good_bands(128, "A_1")) == 113 == len(scenes.good_bands(116, "F_2k"))


def test_scoring_and_evaluating_a_cube(spark):
    rng = np.random.default_rng(0)
    cube = rng.uniform(0.4, 0.6, (8, 9, 6)).astype(np.float32)
    target = np.array([1, 0.1, 0.9, 0.1, 0.8, 0.1], dtype=np.float32)
    cube[2, 3], cube[6, 7] = target, 2 * target
    lib = Library(("blood", "other"), np.stack([target, np.ones(6, np.float32)]))
    px = pixel_table(spark, cube)
    scores, found = scenes.score_cube(px, lib, target="blood")
    assert sorted((r["y"], r["x"]) for r in found.collect()) == [(2, 3), (6, 7)]
    truth = spark.createDataFrame([(0, p, int(p in (21, 61))) for p in range(72)], "frame_index long, p long, label int")
    out = scenes.evaluate_scores(scores, truth, 1)
    row = out["confusion"].first()
    assert (row["tp"], row["fp"], row["f1"]) == (2, 0, 1.0) and out["auc"].first()["auc"] == 1.0 and out["classes"].count() == 2
    with pytest.raises(ValueError, match="bands"):
        scenes.score_cube(px, Library(("x",), np.ones((1, 3))))
    for name in ("rx", "ace", "cem"):
        assert scenes.score_cube(px, lib, name)[0].count() == 72


def test_preparing_scenes(spark):
    cube = np.arange(450 * 2 * 20, dtype=np.float32).reshape(450, 2, 20)
    px = pixel_table(spark, cube)
    notes = spark.createDataFrame([("A_1", y, x, (1 if y < 445 else 2) if x == 0 else 9) for y in range(450) for x in range(2)], "scene string, y int, x int, label int")
    done = scenes.prepare_scene(px, notes, "A_1", 20, 2)
    assert done.count() == 898 and done.agg(F.max("y")).first()[0] == 448
    assert done.where("y = 445 and x = 0").first()["spectrum"] == [float(v) for v in cube[446, 0][5:13]]
    assert {r["label"] for r in done.select("label").distinct().collect()} == {1, 2, 255}
    rows = {r["name"]: r["n"] for r in scenes.prepared_library([done], spark).collect()}
    assert rows == {"blood": 445, "ketchup": 4}
    names = spark.createDataFrame([("A_1",), ("B_1",)], "scene string")
    assert [r["scene"] for r in scenes.scenes_without_annotation(names, notes).collect()] == ["B_1"]
