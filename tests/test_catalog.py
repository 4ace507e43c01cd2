"""Every query with SQL gives DuckDB's rows; the others give rows."""

import pytest

from lumenflow.plans import catalog, gaps, points, tabular, vessels, volumes  # noqa: F401
from tests import oracle

#: Long-running loops are compared by the driver's run; here one of each kind is enough.
SLOW = {"phantom_mst", "pressure_solve", "cluster_centroids", "component_count", "closest_pair_per_component", "floating_components", "fill_holes", "flow_network_pressures", "representative_tree", "thin_skeleton"}


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        oracle.same(df, catalog.ORACLE_SQL[name], duck)
    else:
        assert df.limit(1).count() == 1
