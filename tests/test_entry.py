import importlib


def test_entry_runs_and_names_match(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).schema.names == ["frame_index", "x", "y", "target", "score", "detections_found"]
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "sam_best_match" in names
