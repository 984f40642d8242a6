"""Folds don't depend on how many histograms there are: more than a task deals are dealt by the same rule, in parts."""

from frond.operators import folds
from frond.plans import registry
from oracle import rows_of, rows_of_sql

SMALL = "/root/testdata/sf0.001"


def test_more_histograms_than_a_task_deals_give_the_folds_of_the_sql(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    want = rows_of_sql(registry.ORACLES["stratified_folds"], SMALL)
    assert rows_of(folds.assignments(orders, "o_custkey", "o_orderpriority", 5, most=40)) == want
    assert rows_of(folds.assignments(orders, "o_custkey", "o_orderpriority", 5)) == want


def test_dealing_goes_on_from_what_folds_hold():
    patterns = [((k % 7, k % 5, k % 3), k % 4 + 1, (0, 0, 0)) for k in range(1, 60)]
    weight, whole = [2000, 3000, 9000], [[0] * 3 for _ in range(3)]
    want = folds.dealt(patterns, 3, weight, whole)
    order = sorted(range(len(patterns)), key=lambda k: (-(3 * sum(x * x for x in patterns[k][0]) - sum(patterns[k][0]) ** 2), patterns[k][0]))
    held, got = [[0] * 3 for _ in range(3)], {}
    for at in range(0, len(order), 8):
        part = order[at : at + 8]
        got |= dict(zip(part, folds.dealt([patterns[k] for k in part], 3, weight, held)))
    assert [got[k] for k in range(len(patterns))] == want and held == whole


def test_halves_of_class_weights_are_rounded_up_as_in_the_sql():
    assert folds.class_weights([4, 1, 0]) == [1563, 25000, 0]
