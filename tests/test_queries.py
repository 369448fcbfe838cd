import numpy as np
import pytest
from helpers import duck

from prismlake.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


def same(a, b):
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    a, b = (x.sort_values(list(x.columns)).reset_index(drop=True) for x in (a, b))
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c].astype(float), atol=1.1e-5, rtol=1e-9, equal_nan=True), c
        else:
            assert (a[c] == b[c]).all(), c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_has_the_rows_of_its_sql(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE:
        same(got, duck(SF).sql(ORACLE[name]).df())


def test_flagship(spark):
    assert catalog.flagship(spark, SF).columns == ["frame_index", "x", "y", "target", "score", "detections_found"]
