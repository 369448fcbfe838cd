import numpy as np
import pytest

from prismlake.model import DetectionParams, Polarity
from prismlake.operators.moments import Moments
from prismlake.sources import synthetic
from prismlake.streaming import detector as S


def stream(spark, length, per_batch=2):
    synthetic.register(spark)
    return spark.readStream.format("prismlake_synthetic").options(length=length, frames_per_batch=per_batch, height=40, width=50).load()


def test_frames_come_in_order_and_all_are_scored(spark, tmp_path):
    scene = synthetic.Scene(height=40, width=50)
    seen, found = [], []

    def sink(detections, frames, number):
        rows = frames.collect()
        seen.extend(r["frame_index"] for r in rows)
        found.extend(detections.collect())
        assert all(r["ms"] > 0 and r["detections_kept"] <= r["detections_found"] for r in rows)

    q = S.run_stream(stream(spark, 4), synthetic.library(scene), DetectionParams(0.05, 4), sink, checkpoint=str(tmp_path / "c"), trigger={"processingTime": "0 seconds"})
    for _ in range(100):
        q.processAllAvailable()
        if len(seen) >= 4:
            break
    q.stop()
    assert seen == [0, 1, 2, 3]
    for r in found:
        assert synthetic.frame(scene, r["frame_index"])[1][r["y"], r["x"]] == r["target"] + 1
    assert {r["frame_index"] for r in found} == {0, 1, 2, 3}


def test_second_order_detectors_on_a_stream(spark, tmp_path):
    scene = synthetic.Scene(height=40, width=50)
    kept = []
    q = S.run_stream(stream(spark, 2, 1), synthetic.library(scene), DetectionParams(0.9, 2, polarity=Polarity.HIGHER), lambda d, f, n: kept.append(f.count()), "ace", keep_scores=lambda s, n: kept.append(s.count()), checkpoint=str(tmp_path / "c"), trigger={"processingTime": "0 seconds"})
    for _ in range(100):
        q.processAllAvailable()
        if len(kept) >= 4:
            break
    q.stop()
    assert sorted(kept) == [1, 1, 2000, 2000]


def test_lagged_statistics_are_those_of_the_batch(spark):
    synthetic.register(spark)
    lag = S.LaggedStatistics(None, 1e-6)
    for k in (1, 2):
        px = spark.read.format("prismlake_synthetic").options(frames=k, height=20, width=20).load().where(f"frame_index = {k - 1}")
        stats, got = lag.next(px)
        cube, _ = synthetic.frame(synthetic.Scene(height=20, width=20), k - 1)
        own = Moments.of(cube.reshape(-1, 24))
        assert np.allclose(got.covariance(), own.covariance(), atol=1e-12) and np.allclose(stats.mean, own.mean())


@pytest.mark.parametrize("bands,reads", [(1, 1), (32, 1), (33, 2), (128, 4)])
def test_reads_of_a_blocked_accumulation(bands, reads):
    assert S.expected_reads(bands) == reads


def test_replay_of_cubes_as_a_stream(spark, tmp_path):
    from prismlake.sources import envi

    for k in (0, 1):
        (tmp_path / f"f{k}.hdr").write_text("ENVI\nsamples = 2\nlines = 3\nbands = 1\ndata type = 4\n")
        (tmp_path / f"f{k}.float").write_bytes(np.full(6, 10 + k, "<f4").tobytes())
    envi.register(spark)
    seen = []
    df = spark.readStream.format("prismlake_envi").options(loops=2, lines_per_partition=2, frames_per_batch=1).load(str(tmp_path))
    q = df.writeStream.foreachBatch(lambda b, n: seen.extend((r["frame_index"], r["spectrum"][0]) for r in b.where("p = 5").collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    for _ in range(100):
        q.processAllAvailable()
        if len(seen) >= 4:
            break
    q.stop()
    assert seen == [(0, 10.0), (1, 11.0), (2, 10.0), (3, 11.0)]
