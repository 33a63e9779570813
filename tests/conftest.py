import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from digestry.session import local_session

    s = local_session(4, shuffle_partitions=8, app="digestry-tests")
    yield s
    s.stop()


def articles_df(spark, rows):
    """rows: (id, url, title, content) with ord = position."""
    data = [(r[0], r[1], r[2], r[3] if len(r) > 3 else None, "src", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id string, url string, title string, content string, source string, ord bigint")
