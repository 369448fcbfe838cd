"""What several tests share."""

import numpy as np

from prismlake.model import PIXELS


def pixel_table(spark, cube, frame_index=0):
    """A pixel table from a (height, width, bands) array."""
    h, w, _ = cube.shape
    rows = [(frame_index, y * w + x, y, x, [float(v) for v in cube[y, x]]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, PIXELS)


def score_table(spark, grid, target=0):
    h, w = grid.shape
    rows = [(0, y * w + x, y, x, target, float(grid[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "frame_index long, p long, y int, x int, target int, score double")


def duck(sf_dir):
    """A DuckDB connection with the tables of a folder as views."""
    import os

    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def correlated_scene(seed, height, width, bands, dimensions=4):
    """Background that varies in a few directions, with noise; (cube, directions)."""
    rng = np.random.default_rng(seed)
    directions = rng.uniform(0.1, 1, (dimensions, bands))
    mix = rng.uniform(0, 1, (height, width, dimensions))
    return mix @ directions + rng.normal(0, 0.01, (height, width, bands)), directions
