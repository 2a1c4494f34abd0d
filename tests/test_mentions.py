from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_check
from tenuis.plans import entities, tables

SF = "/root/testdata/sf0.001"


def test_rows_of_a_task_do_not_grow_with_the_mentions(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 200, raising=False)
    rows = entities.mentions(spark, SF)
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == rows.count() > 4000 and max(sizes) < 400
    assert rows.select("document_id", F.spark_partition_id()).distinct().count() == rows.select("document_id").distinct().count()
    assert rows.select("mention_id").distinct().count() == sum(sizes)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    for name in ("mention_violations", "grounded_hints"):
        message, ok = oracle_check.compare(spark, oracle_check.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
        assert ok, message
