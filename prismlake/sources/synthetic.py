"""Synthetic video: a mixed background with moving discs of known spectra.

A frame is a function of the seed and its index alone, so any task can make any
frame, and a stream that starts anew shows the same frames.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..model import PIXELS, TRUTH, CubeShape
from ..operators.library import Library
from .envi import pixel_batch


@dataclass(frozen=True)
class Scene:
    height: int = 96
    width: int = 128
    bands: int = 24
    targets: int = 3
    radius: int = 5
    noise: float = 0.002
    seed: int = 4242
    length: int = 0
    #: Each pixel's gain lies within 1 - gain_jitter and 1 + gain_jitter and is the same in all frames.
    gain_jitter: float = 0.1
    backgrounds: int = 3
    #: Spectra of the targets, scaled as random ones are; without them, targets random ones.
    spectra: tuple[tuple[float, ...], ...] = ()

    def __post_init__(self):
        if self.spectra and (len(self.spectra) != self.targets or {len(s) for s in self.spectra} != {self.bands}):
            raise ValueError("a scene needs a spectrum of its bands for each target")
        if self.backgrounds < 1 or not 0 <= self.gain_jitter <= 1:
            raise ValueError("a scene needs a background and a gain_jitter of 0 to 1")

    @property
    def shape(self) -> CubeShape:
        return CubeShape(self.height, self.width, self.bands)

    @staticmethod
    def of(options) -> Scene:
        known = {"height": int, "width": int, "bands": int, "targets": int, "radius": int, "noise": float, "seed": int, "length": int, "gain_jitter": float, "backgrounds": int}
        own = tuple(tuple(s) for s in json.loads(options["spectra"])) if options.get("spectra") else ()
        return Scene(**{k: cast(options[k]) for k, cast in known.items() if k in options}, spectra=own)

    def options(self) -> dict[str, str]:
        """What the data source takes for this scene."""
        return {k: json.dumps(v) if k == "spectra" else str(v) for k, v in asdict(self).items() if k != "spectra" or v}


def random_spectrum(bands: int, rng: np.random.Generator) -> np.ndarray:
    """Three to five Gaussian peaks, scaled to [0.05, 0.9]."""
    at = np.linspace(0, 1, bands)
    peaks = int(rng.integers(3, 6))
    centre, width, height = rng.uniform(0, 1, peaks), rng.uniform(0.05, 0.25, peaks), rng.uniform(0.3, 1, peaks)
    curve = (height * np.exp(-0.5 * ((at[:, None] - centre) / width) ** 2)).sum(axis=1)
    return (0.05 + 0.85 * curve / curve.max()).astype(np.float32)


def _spectra(scene: Scene) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([scene.seed, 1])
    if scene.spectra:
        x = np.array(scene.spectra)
        low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
        own = (0.05 + 0.85 * (x - low) / np.maximum(high - low, 1e-12)).astype(np.float32)
        return np.stack([random_spectrum(scene.bands, rng) for _ in range(scene.backgrounds)]), own
    return np.stack([random_spectrum(scene.bands, rng) for _ in range(scene.backgrounds)]), np.stack([random_spectrum(scene.bands, rng) for _ in range(scene.targets)]) if scene.targets else np.zeros((0, scene.bands), np.float32)


def library(scene: Scene) -> Library:
    return Library(tuple(f"target_{i}" for i in range(scene.targets)), _spectra(scene)[1])


def _bounce(start: float, speed: float, t: int, low: float, high: float) -> float:
    """A position that moves at even speed between two walls."""
    room = max(high - low, 1e-9)
    x = (start + speed * t) % (2 * room)
    return low + (x if x <= room else 2 * room - x)


def frame(scene: Scene, index: int) -> tuple[np.ndarray, np.ndarray]:
    """(cube, truth): truth is the target's id + 1, 0 for background."""
    grounds, targets = _spectra(scene)
    fixed, own = np.random.default_rng([scene.seed, 2]), np.random.default_rng([scene.seed, 3, index])
    y, x = np.mgrid[: scene.height, : scene.width]
    waves = [np.sin(y / fixed.uniform(8, 20) + fixed.uniform(0, 6)) + np.cos(x / fixed.uniform(8, 20) + fixed.uniform(0, 6)) for _ in grounds]
    share = np.exp(np.stack(waves, axis=-1))
    share /= share.sum(axis=-1, keepdims=True)
    cube = share @ grounds
    truth = np.zeros((scene.height, scene.width), np.int16)
    r = scene.radius
    for k, spectrum in enumerate(targets):
        track = np.random.default_rng([scene.seed, 4, k])
        cy = _bounce(track.uniform(0, scene.height), track.uniform(0.5, 2.5), index, r, scene.height - 1 - r)
        cx = _bounce(track.uniform(0, scene.width), track.uniform(0.5, 2.5), index, r, scene.width - 1 - r)
        inside = ((y - cy) ** 2 + (x - cx) ** 2 <= r * r) & (truth == 0)
        cube[inside] = spectrum
        truth[inside] = k + 1
    gain = np.random.default_rng([scene.seed, 5]).uniform(1 - scene.gain_jitter, 1 + scene.gain_jitter, (scene.height, scene.width, 1))
    cube = cube * gain + own.normal(0, scene.noise, cube.shape)
    return np.maximum(cube, 0).astype(np.float32), truth


def _truth_batch(index: int, truth: np.ndarray) -> pa.RecordBatch:
    n = truth.size
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, index, np.int64)), pa.array(np.arange(n)), pa.array(truth.reshape(-1).astype(np.int16))], names=["frame_index", "p", "label"])


@dataclass
class _Frame(InputPartition):
    index: int


class _Made:
    def __init__(self, options, schema):
        self.scene, self.count = Scene.of(options), int(options.get("frames", options.get("length", 1)))
        self.wants_truth = "label" in schema.fieldNames()

    def read(self, part: _Frame) -> Iterator[pa.RecordBatch]:
        cube, truth = frame(self.scene, part.index)
        yield _truth_batch(part.index, truth) if self.wants_truth else pixel_batch(part.index, 0, cube)


class _Batch(_Made, DataSourceReader):
    def partitions(self):
        return [_Frame(i) for i in range(self.count)]


class _Stream(_Made, DataSourceStreamReader):
    """A length of 0 never ends. A bounded one offers all its frames at once unless frames_per_batch is given; the offer moves on when a batch is planned."""

    def __init__(self, options, schema):
        super().__init__(options, schema)
        self.per_batch = int(options.get("frames_per_batch", 0 if self.scene.length else 1))
        self.planned = 0

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        if not self.per_batch:
            return {"frame": self.scene.length}
        return {"frame": min(self.planned + self.per_batch, self.scene.length) if self.scene.length else self.planned + self.per_batch}

    def partitions(self, start: dict, end: dict):
        self.planned = max(self.planned, end["frame"])
        return [_Frame(i) for i in range(start["frame"], end["frame"])]

    def commit(self, end: dict) -> None:
        pass


class SyntheticSource(DataSource):
    """spark.read or readStream.format("prismlake_synthetic"): options as in Scene; frames for batches; table "pixels" or "truth"."""

    @classmethod
    def name(cls) -> str:
        return "prismlake_synthetic"

    def schema(self) -> StructType:
        return TRUTH if self.options.get("table") == "truth" else PIXELS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SyntheticSource)
