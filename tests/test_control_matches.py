import re

from tenuis.operators import labeling as lab


def test_controls_meet_counted_names(spark):
    controls = spark.createDataFrame([("a", "Edge Chip"), ("a", "solo"), ("b", "solo"), ("c", "none"), ("d", None)], "noise_id string, text string")
    names = spark.createDataFrame([("edge chip", "p2"), ("Edge-chip", "p1"), ("edge chip", "p1"), ("solo", "p3"), ("x", None), (None, "p9")], "name string, proposal_id string")
    found = lab.control_matches(controls, names)
    assert {r["noise_id"]: (r["matches"], r["proposal_id"]) for r in found.collect()} == {"a": (3, None), "b": (1, "p3"), "c": (0, None), "d": (0, None)}
    assert re.search(r"Aggregate \[k#\d+\],", found._jdf.queryExecution().optimizedPlan().toString())
