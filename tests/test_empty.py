"""Every query over empty tables gives its columns and no rows; sums over everything give one row or none."""

import os

import pytest

from lumenspan.plans import registry

SF = "/root/testdata/sf0.001"
#: Aggregates without keys have a row for no input as well.
ONE_ROW = {"describe_numeric": 2}


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in os.listdir(SF):
        spark.read.parquet(f"{SF}/{name}").limit(0).coalesce(1).write.parquet(str(at / name))
    return str(at)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    out = registry.QUERIES[name](spark, nothing)
    assert len(out.columns) > 0 and len(out.collect()) == ONE_ROW.get(name, 0)
