"""Whole tasks: scoring a cube, evaluating a score map, preparing a labelled dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DetectionParams
from ..operators import evaluate, layout, scoring
from ..operators.detect import detect
from ..operators.library import Library
from ..operators.moments import build_statistics, class_means, moments
from ..sources.raster import mask_value

# Fixed values of the dataset: bands with an artefact, the damaged line, the scene with fewer bands, the classes.
SHORT_SCENE, SHORT_SCENE_NOISY = "F_2k", (43, 44, 45)
DAMAGED_ROW = 445
CLASSES = {0: "background", 1: "blood", 2: "ketchup", 3: "artificial_blood", 4: "beetroot_juice", 5: "poster_paint", 6: "tomato_concentrate", 7: "acrylic_paint", 8: "uncertain_blood"}


def good_bands(bands: int, scene: str) -> list[int]:
    """The bands to keep of a scene. The artefact lies 43 to 45 bands after the first kept one."""
    if scene == SHORT_SCENE:
        return [b for b in range(bands) if b not in SHORT_SCENE_NOISY]
    inner = range(5, bands - 7)
    return [b for k, b in enumerate(inner) if k not in SHORT_SCENE_NOISY]


def score_cube(pixels: DataFrame, library: Library, detector: str = "sam", target: str | None = None, params: DetectionParams | None = None, loading: float = 1e-6, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(scores, detections) of a scene; target restricts the library to one name, which single-class curves need."""
    chosen = library.only(target) if target else library
    first = pixels.select(F.size("spectrum").alias("n")).first()
    if first is not None:
        chosen.require_bands(first["n"])
    traits = scoring.model.detector(detector)
    stats = build_statistics(moments(pixels), chosen, loading) if traits.needs_statistics else None
    scores = scoring.score(pixels, detector, chosen, stats, strategy=strategy)
    params = params or DetectionParams(polarity=traits.polarity)
    return scores, detect(scores, params)


def evaluate_scores(scores: DataFrame, truth: DataFrame, target: int, threshold: float = 0.10) -> dict[str, DataFrame]:
    """Confusion counts with precision, recall and F1, the ROC area, and statistics by class, at the labelled pixels."""
    both = evaluate.labelled(scores, truth)
    counts = evaluate.confusion(both, target, threshold)
    return {"confusion": evaluate.precision_recall_f1(counts), "auc": evaluate.roc_auc(both, target), "classes": evaluate.class_statistics(both, target)}


def prepare_scene(pixels: DataFrame, annotation: DataFrame, scene: str, bands: int, width: int, keep_noisy_bands: bool = False, keep_damaged_row: bool = False) -> DataFrame:
    """Pixels of one scene with their labels, cleaned: bands chosen, the damaged row removed from both, labels as in masks.

    Pixels and annotation meet by place; a scene without annotation gives no rows.
    """
    marked = annotation.where(F.col("scene") == scene).select("y", "x", "label")
    rows = pixels.join(marked, ["y", "x"])
    if not keep_noisy_bands:
        rows = layout.select_bands(rows, good_bands(bands, scene))
    if not keep_damaged_row and scene != SHORT_SCENE:
        rows = layout.drop_rows(rows, [DAMAGED_ROW], width)
    return rows.withColumn("label", mask_value(F.col("label"))).withColumn("scene", F.lit(scene))


def scenes_without_annotation(scenes: DataFrame, annotation: DataFrame) -> DataFrame:
    return scenes.join(annotation.select("scene").distinct(), "scene", "left_anti")


def prepared_library(scenes: list[DataFrame], spark: SparkSession) -> DataFrame:
    """Class means over the union of scenes, weighted by pixels; background and bookkeeping labels give no signature."""
    rows = None
    for s in scenes:
        part = s.where("label between 1 and 8").select("label", "spectrum")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no annotated pixels found")
    names = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    return class_means(rows).select("label", F.element_at(names, F.col("label").cast("int")).alias("name"), "n", "values")
