"""What grows with the tables is not sent through the driver, however small a side is taken for."""

import pytest

from ledgerleaf.plans import registry

FOLDER = "/root/testdata/sf0.001"


def broadcasts(spark, run):
    """The joins by broadcast in the plans of all that ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: {(x := store.executionsList().apply(i)).executionId(): x for i in range(store.executionsList().size())}
    before = listed()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    plans = [x.physicalPlanDescription() for k, x in listed().items() if k not in before]
    assert plans
    return [line for plan in plans for line in plan.splitlines() if line.startswith("(") and ("BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line)]


@pytest.mark.parametrize("name", ["g4_rule_outcomes", "g14_outcome_coverage", "g16_missing_facts"])
def test_rules_send_no_side_to_the_driver(spark, name):
    assert broadcasts(spark, lambda: registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()) == []


@pytest.mark.parametrize("name", ["p2_term_assessment", "p3_plan_check", "p7_earliest_terms"])
def test_plans_send_no_side_to_the_driver(spark, name):
    joins = broadcasts(spark, lambda: registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save())
    # Sizes of curricula are one row a brand; the join is in the plan as made and as run.
    assert len(joins) <= (2 if name == "p7_earliest_terms" else 0)
