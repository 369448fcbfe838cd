import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.streaming import lagged as L

SCHEMA = "stream string, frame_index long, spectrum array<double>"


def made(stream, frames, seed, offset=0.0):
    rng = np.random.default_rng(seed)
    return [(stream, k, (rng.normal(size=3) + offset + k).tolist()) for k in frames for _ in range(5)]


def plain(rows):
    """By definition, a frame after another."""
    out = {}
    for name in {r[0] or "" for r in rows}:
        before = None
        for k in sorted({r[1] for r in rows if (r[0] or "") == name}):
            x = np.array([r[2] for r in rows if (r[0] or "") == name and r[1] == k and r[2] is not None])
            out[name, k] = (len(x), x.mean(axis=0), np.cov(x.T, bias=True), before, None if before is None else (x - before).T @ (x - before))
            before = x.mean(axis=0)
    return out


def same(df, want):
    got = {(r["stream"], r["frame_index"]): r for r in df.collect()}
    assert set(got) == set(want)
    for key, (n, mean, cov, before, about) in want.items():
        r = got[key]
        assert r["n"] == n and np.allclose(r["mean"], mean) and np.allclose(np.reshape(r["covariance"], (3, 3)), cov)
        assert (r["lagged_mean"] is None) == (before is None)
        if before is not None:
            assert np.allclose(r["lagged_mean"], before) and np.allclose(np.reshape(r["lagged_products"], (3, 3)), about)


def run(spark, source, out, checkpoint):
    pixels = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = L.lagged_stream(pixels).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive
    return q


def test_streams_killed_and_started_again_are_as_one_pass(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = made("a", range(3), 1) + made("b", range(2), 2, 1e6)
    # The second run goes on within frame 2 of stream a, and b's frame 2 meets the state of its frame 1.
    second = made("a", [2, 3], 3) + made("b", [2], 4, 1e6) + made(None, [7], 5)
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    run(spark, source, out, checkpoint)
    same(L.last_of_each(spark, out), plain(first))
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, checkpoint)
    same(L.last_of_each(spark, out), plain(first + second))
    same(L.lagged_table(spark.createDataFrame(first + second, SCHEMA)), plain(first + second))


def test_a_late_frame_stops_the_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame(made("a", [4], 1), SCHEMA).coalesce(1).write.parquet(source)
    run(spark, source, out, checkpoint)
    spark.createDataFrame(made("a", [3], 1), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="comes after frame"):
        run(spark, source, out, checkpoint)


def test_nulls_and_empty_tables(spark):
    rows = made("a", [0, 1], 1) + [("a", 1, None), ("a", 5, None)]
    same(L.lagged_table(spark.createDataFrame(rows, SCHEMA)), plain(rows[:-1]))
    assert L.lagged_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.frame_moments(spark.createDataFrame(rows, SCHEMA).repartition(1)).agg(F.sum("n")).first()[0] == 10
