"""What a written table costs the driver and the disks."""

import glob
import time

from pyspark.sql import functions as F

from tablemend import session
from tablemend.functions.units import IDENTITY, THOUSANDS
from tablemend.operators.learn import NormalMean
from tablemend.plans.declared import Units, clean_declared


def test_a_table_of_many_rows_in_few_bytes_is_not_broadcast(spark):
    rows = spark.range(300_000).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("kind"), F.col("id").cast("double").alias("amount"))
    out = clean_declared(session.cut_lineage(rows), {"amount": Units(("kind",), (IDENTITY, THOUSANDS), NormalMean(1500.0, 1000.0), 150.0)}).flat
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_salt" in x]
    assert out.count() == 300_000


def test_small_written_tables_may_still_be_broadcast(spark):
    few = session.cut_lineage(spark.range(100))
    plan = spark.range(1000).join(session.merge_if_large(few), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_shuffle_files_of_finished_steps_go(spark, monkeypatch):
    monkeypatch.setattr(session, "RELEASE_EVERY", 0.0)
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}

    def step(n):
        return session.cut_lineage(spark.range(50_000).groupBy((F.col("id") % n).alias("k")).agg(F.count("*").alias("n")))

    before = files()
    made = step(9_000)
    first = files() - before
    step(10)
    for _ in range(20):
        if not files() & first:
            break
        time.sleep(0.5)
    assert first and not files() & first and made.count() == 9_000
