"""Scratch tables: kept while they may be read, dropped with their scope."""

import os

import pytest

from tablemend.session import cut_lineage, scratch, scratch_path


def _folders(spark):
    top = os.path.dirname(scratch_path(spark)).removeprefix("file://")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scope(spark):
    outside = cut_lineage(spark.range(5))
    before, out = _folders(spark), scratch_path(spark)
    with scratch(spark):
        cut_lineage(spark.range(3))
        with scratch(spark):
            cut_lineage(spark.range(4))
        assert len(_folders(spark) - before) == 1
        cut_lineage(spark.range(7)).write.parquet(out)
    assert _folders(spark) - before == {os.path.basename(out)}
    assert spark.read.parquet(out).count() == 7 and outside.count() == 5


def test_after_an_error_tables_stay(spark):
    before = _folders(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        cut_lineage(spark.range(3))
        raise ZeroDivisionError
    assert len(_folders(spark) - before) == 1
