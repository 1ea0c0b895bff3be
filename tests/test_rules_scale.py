"""Steps of a closure send no rows through the driver."""

from lorewell.operators import rules


def test_steps_of_ancestors_are_not_broadcast(spark, monkeypatch):
    plans = []

    def saved(frame, own=rules.saved):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return own(frame)

    monkeypatch.setattr(rules, "saved", saved)
    is_a = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "child string, parent string")
    found = rules.ancestors(is_a, spark.createDataFrame([("a",), ("x",), ("z",)], "node string"))
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y"), ("z", "z")]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
