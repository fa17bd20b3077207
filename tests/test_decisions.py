import pytest

from basketry.plans.decisions import prioritize, threshold_policy

P = "repeat_purchase_probability"
SCORES = [0.01, 0.09, 0.03, 0.20, 0.05, 0.01, 0.15, 0.02, 0.07, 0.04]
BOTH_WAYS = pytest.mark.parametrize("limit", [10**6, 1], ids=["windowed", "ranged"])


def population(spark, scores, ids=None, name="customer_id"):
    ids = ids or [f"C{i:03d}" for i in range(1, len(scores) + 1)]
    return spark.createDataFrame(list(zip(ids, scores)), f"{name} string, {P} double")


def ranked(df, id="customer_id"):
    return [r[id] for r in sorted(df.collect(), key=lambda r: r.decision_rank)]


@BOTH_WAYS
@pytest.mark.parametrize("capacity", [0.05, 0.10])
def test_one_of_ten_is_prioritized(spark, capacity, limit):
    out = prioritize(population(spark, SCORES), capacity, group_rows=limit)
    chosen = [r for r in out.collect() if r.priority == "prioritize"]
    assert [r.customer_id for r in chosen] == ["C004"]
    assert chosen[0].target_population_size == 1 and chosen[0].capacity_fraction == capacity


def test_ranking_is_descending(spark):
    assert ranked(prioritize(population(spark, [0.02, 0.80, 0.40]), 0.5)) == ["C002", "C003", "C001"]


@BOTH_WAYS
def test_ties_go_by_id(spark, limit):
    out = prioritize(population(spark, [0.5] * 3, ["C003", "C001", "C002"]), 0.34, group_rows=limit)
    assert ranked(out) == ["C001", "C002", "C003"]
    assert [r.customer_id for r in out.collect() if r.priority == "prioritize"] == ["C001"]


def test_other_id_column(spark):
    df = population(spark, [0.20, 0.80, 0.40], ["C003", "C001", "C002"], "customer_unique_id")
    assert ranked(prioritize(df, 0.34, "customer_unique_id"), "customer_unique_id") == ["C001", "C002", "C003"]


@pytest.mark.parametrize("capacity", [0, -0.1, 1.01])
def test_bad_capacity(spark, capacity):
    with pytest.raises(ValueError):
        prioritize(population(spark, [0.5]), capacity)


def test_bad_populations(spark):
    with pytest.raises(ValueError):
        prioritize(population(spark, [0.5]).limit(0), 0.1)
    with pytest.raises(ValueError):
        prioritize(population(spark, [0.5]).drop(P), 0.1)
    for score in (1.5, -0.1, None, float("nan")):
        with pytest.raises(ValueError):
            prioritize(population(spark, [0.5, score]), 0.1)
    with pytest.raises(ValueError):
        prioritize(spark.createDataFrame([(None, 0.5)], f"customer_id string, {P} double"), 0.1)


def test_threshold_policy(spark):
    out = threshold_policy(population(spark, [0.10, 0.0999, 0.01, 0.0099]))
    assert [r.decision for r in out.orderBy("customer_id").collect()] == ["prioritize", "standard", "standard", "deprioritize"]
    with pytest.raises(ValueError):
        threshold_policy(population(spark, [1.5]))
