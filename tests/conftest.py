import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgernet.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


# A micro multigraph exercising every corner: parallel edges, a self-loop,
# a reciprocal pair, triangles, a zero amount, equal timestamps, a sink (5),
# a source without in-edges (6) and an isolated node (7).
MICRO_EDGES = [
    (1, 2, 0, 10.0), (1, 2, 120, 30.0), (2, 3, 60, 5.0), (3, 3, 180, 7.0), (3, 1, 240, 0.0),
    (2, 1, 0, 2.0), (1, 3, 300, 4.0), (2, 4, 30, 1.5), (1, 4, 90, 2.5), (4, 3, 90, 6.0),
    (6, 1, 10, 3.0), (4, 5, 400, 8.0), (3, 2, 500, 1.0),
]
MICRO_NODES = [(n, f"a{n}", int(n % 2 == 0), int(n in (1, 2, 4, 6))) for n in range(1, 8)]


@pytest.fixture()
def micro(spark):
    e = spark.createDataFrame(MICRO_EDGES, "source long, target long, timestamp long, amount double")
    n = spark.createDataFrame(MICRO_NODES, "node long, address string, isp int, is_anchor int")
    return e, n
