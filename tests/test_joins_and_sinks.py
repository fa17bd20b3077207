import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry.operators import joins, quality
from basketry.plans import campaigns
from basketry.session import scratch_path, shared_folder
from basketry.sources import tables as io


def overlaps(members, held, windows, targets):
    """Plain double loop over all assignments of a member."""
    out = set()
    for m, g in members:
        for start, end in targets.get(g, []):
            for other in held.get(m, ()):
                for s, e in windows.get(other, []):
                    if other != g and None not in (s, e, start, end) and s <= end and e >= start and s <= e and start <= end:
                        out.add((m, g))
    return [(m, g) for m, g in members if (m, g) not in out]


@pytest.mark.parametrize("seed", range(4))
def test_interval_anti_join_against_all_pairs(spark, seed):
    draw = random.Random(seed)
    windows = {g: [(s, s + draw.randint(0, 30))] for g in range(12) for s in [draw.randint(0, 100)]}
    windows[12], windows[13] = [(None, 5)], [(20, 10)]
    held = {m: draw.sample(range(14), draw.randint(0, 6)) for m in range(60)}
    members = [(m, g) for m in range(70) for g in range(14) if draw.random() < 0.5]
    schema = "CAMPAIGN int, START_DAY int, END_DAY int"
    table = spark.createDataFrame([(g, s, e) for g, w in windows.items() for s, e in w], schema)
    assigned = spark.createDataFrame([(m, g) for m, gs in held.items() for g in gs + gs[:1]], "household_key int, CAMPAIGN int")
    frame = spark.createDataFrame(members, "household_key int, CAMPAIGN int")
    got = joins.without_overlap(frame, assigned, table, "household_key", table, "CAMPAIGN", "START_DAY", "END_DAY")
    assert sorted(map(tuple, got.collect())) == sorted(overlaps(members, held, windows, windows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_cohort_of_all_campaigns_equals_the_cohorts_of_each(spark):
    draw = random.Random(9)
    windows = spark.createDataFrame([(g, 10 * g, 10 * g + 14) for g in range(8)], "CAMPAIGN int, START_DAY int, END_DAY int")
    assigned = spark.createDataFrame([(m, g) for m in range(40) for g in draw.sample(range(8), 2)], "household_key int, CAMPAIGN int")
    homes = spark.createDataFrame([(m,) for m in range(50)], "household_key int")
    rows = lambda *ids: sorted(map(tuple, campaigns.eligible_cohort(assigned, windows, homes, *ids).collect()))
    assert rows() == sorted(r for g in range(8) for r in rows(g)) and rows([2, 5]) == sorted(rows(2) + rows(5))


def test_hot_partition_values_are_written_by_several_tasks(spark):
    path = scratch_path(spark, "hot")
    df = spark.range(0, 300_000, 1, 6).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string").substr(1, 1)).alias("status"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        assert io.write_table(df, path, partition_by=["status"], reconcile=True) == 300_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    folder = Path(path.removeprefix("file:"))
    files = sorted(folder.glob("status=hot/*.parquet"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 6_000_000
    assert len(list(folder.glob("status=2/*.parquet"))) <= 2
    assert spark.read.parquet(path).count() == 300_000


def test_history_reads_commits_alone(spark):
    path = scratch_path(spark, "versions")
    for version, n in ((1, 5), (2, 7)):
        io.write_snapshot(spark.range(n), path, version)
    history = io.snapshot_history(spark, path)
    assert [(r["snapshot_id"], r["parent_id"], r["rows"]) for r in history.collect()] == [(1, None, 5), (2, 1, 7)]
    assert all("/commits/" in f for f in history.inputFiles())


def test_profile_against_plain_python(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 2]), draw.choice([None, "a", "b", "x" * 50_000]), draw.choice([0.0, -0.0, 1.5, None])) for _ in range(200)]
    rows += [(None, "a", None), (1, None, None), (None, None, 1.5)] * 2
    df = spark.createDataFrame(rows, "k int, `t.x` string, v double")
    got = {r["column"]: r for r in quality.profile(df).collect()}
    for i, c in enumerate(df.columns):
        known = [r[i] for r in rows if r[i] is not None]
        assert (got[c]["rows"], got[c]["null_count"]) == (len(rows), len(rows) - len(known))
        assert got[c]["distinct_count"] == len({str(x) for x in known})
        assert got[c]["duplicate_rows"] == len(rows) - len(set(rows))
    assert quality.profile(df.limit(0)).select("distinct_count", "duplicate_rows").distinct().collect() == [(0, 0)]


def test_weekly_trend_of_many_campaigns_equals_single_ones(spark):
    draw = random.Random(5)
    tx = spark.createDataFrame(
        [(draw.randint(1, 20), d, (d - 1) // 7 + 1, round(draw.random() * 50, 2)) for d in range(1, 200) for _ in range(draw.randint(0 if d % 31 == 0 else 1, 4))],
        "household_key int, DAY int, WEEK_NO int, SALES_VALUE double",
    )
    cohort = spark.createDataFrame(
        [(g, s, s + 20, "assigned" if h % 2 else "comparison", h) for g, s in ((1, 60), (2, 120), (3, 190), (4, 3)) for h in range(1, 25) if (h + g) % 3],
        "CAMPAIGN int, START_DAY int, END_DAY int, group_name string, household_key int",
    )
    got = sorted(map(tuple, campaigns.weekly_trend(cohort, tx).collect()))
    each = [campaigns.weekly_trend(cohort.filter(F.col("CAMPAIGN") == g), tx, s).collect() for g, s in ((1, 60), (2, 120), (3, 190), (4, 3))]
    want = sorted(tuple(r) for rows in each for r in rows)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert {r[0] for r in got} == {1, 2, 3}


@pytest.mark.parametrize(("master", "warehouse", "named", "want"), [
    ("local[4]", "file:/tmp/w", None, "file:/tmp/w/_scratch"), ("spark://host:7077", "file:/tmp/w", None, None), ("yarn", "/tmp/w", None, None),
    ("yarn", "hdfs://store/w", None, "hdfs://store/w/_scratch"), ("yarn", "file:/tmp/w", "hdfs://store/c", "hdfs://store/c"),
])
def test_scratch_folder_is_shared_or_refused(spark, master, warehouse, named, want):
    from types import SimpleNamespace

    settings = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": named}
    session = SimpleNamespace(
        _jvm=spark._jvm, conf=SimpleNamespace(get=lambda key, default=None: settings.get(key) or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
    )
    if want:
        assert shared_folder(session) == want
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session)


@pytest.mark.parametrize("listed", [1024, 3], ids=["bits", "pairs"])
def test_repeats_among_few_values(spark, monkeypatch, listed):
    """Rows of one key at many values are no repeats; an equal pair is, nulls aren't. With bits no pair is shuffled."""
    monkeypatch.setattr(joins, "LISTED", listed)
    rows = [(k, d) for k in range(4) for d in range(130)] + [(None, 1), (None, 1), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "k int, d int").repartition(3)
    grouped = []
    once = joins.has_repeats
    monkeypatch.setattr(joins, "has_repeats", lambda *a: grouped.append(1) or once(*a))
    assert not joins.has_repeats_among(df, "k", "d")
    for again in ((0, 0), (3, 63), (1, 64), (2, 129)):
        assert joins.has_repeats_among(df.union(spark.createDataFrame([again], "k int, d int")), "k", "d")
    assert not joins.has_repeats_among(df.limit(0), "k", "d")
    assert len(grouped) == (5 if listed == 3 else 0)
