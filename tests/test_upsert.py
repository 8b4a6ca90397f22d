from pyspark.sql import functions as F
from test_windows import dense

from sensorloom import operators as O
from sensorloom.plans.registry import in_runs
from sensorloom.streaming import upsert


def test_states_merge_without_sorting(spark, monkeypatch):
    """The last row of a key comes from a hash table, not from sorted structs; keys of both runs are updated."""
    plans, merged = [], upsert.merged

    def seen(*args):
        rows = merged(*args)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(upsert, "merged", seen)
    df = dense(spark).withColumn("even", F.second("ts") % 2 == 0)
    got = in_runs([df.where("even").drop("even"), df.where("NOT even").drop("even")], O.tumbling_stats)
    assert O.same_rows(got, O.tumbling_stats(df.drop("even")).drop("flag"))
    assert len(plans) > 1 and not any("SortAggregate" in p for p in plans)
