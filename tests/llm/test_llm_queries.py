import os

import pytest

from dasymetra.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
