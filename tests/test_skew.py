"""A student holding a third of the ledger: results stay exact and the
plans split the hot key instead of sending it to one task."""

import pytest
from pyspark.sql import functions as F

from pointbook.operators import ledger, mutate
from pointbook.sources import standin as si



@pytest.fixture
def skew_conf(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def hot_ledger(spark):
    """The sf0.01 ledger with every third row moved to student 7."""
    p = si.penalties(spark, "/root/testdata/sf0.01")
    n = F.substring("id", 5, 20).cast("bigint")
    # spread over several map tasks, as any large ledger is (a skewed reducer
    # partition is split along map-output boundaries)
    # (checkpointed: like a stored table, the join input then keeps 8 splits)
    from pointbook.session import checkpoint_root

    checkpoint_root(spark)
    hot = p.withColumn("student_id", F.when(n % 3 == 0, F.lit("7")).otherwise(F.col("student_id")))
    return hot.repartition(8).checkpoint()


def final_plan(df):
    df.collect()  # runs the DataFrame's own adaptive plan, which then shows its final form
    return df._jdf.queryExecution().executedPlan().toString()


def test_roster_ledger_join_splits_hot_student(spark, skew_conf):
    p = hot_ledger(spark)
    s = si.students(spark, "/root/testdata/sf0.01")
    d1 = ledger.students_left_join_penalties(s, p)
    plan = final_plan(d1)
    assert "SortMergeJoin(skew=true)" in plan
    with_rows = d1.where(F.col("penalty_id").isNotNull())
    assert with_rows.count() == p.join(s, p.student_id == s.id, "left_semi").count()
    assert d1.where("student_id = '7'").count() == p.where("student_id = '7'").count()


def test_totals_exact_under_skew(spark, skew_conf):
    p = hot_ledger(spark)
    s = si.students(spark, "/root/testdata/sf0.01")
    t = ledger.cumulative_points(s, p)
    assert t.agg(F.sum("points")).first()[0] == p.join(s, p.student_id == s.id, "left_semi").agg(F.sum("points")).first()[0]
    assert t.where("id = '7'").first().points == p.where("student_id = '7'").agg(F.sum("points")).first()[0]


def test_reset_under_skew(spark, skew_conf):
    p = hot_ledger(spark)
    req = spark.createDataFrame([(1, "7", "2024-01-03", "2024-01-20")], "seq bigint, student_id string, `from` string, `to` string")
    remaining, counts = mutate.reset_penalties(p, req, max_per_key=0)  # force the shuffled path
    hot = p.where("student_id = '7' AND occurred_on BETWEEN '2024-01-03' AND '2024-01-20'").count()
    assert counts.first().deleted == hot
    assert remaining.count() == p.count() - hot
    # the hot student's rows are dealt by day, so no key is the student's whole third
    assert "SortMergeJoin [student_id" in (plan := final_plan(remaining)) or "SortMergeJoin(skew=true) [student_id" in plan
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert "occurred_on" in join.split("LeftAnti")[0]


def test_hot_student_joined_map_side(spark):
    """Explicit split: the hot student's rows join a broadcast roster row and
    never cross a shuffle; the result equals the plain join."""
    from pointbook.operators.skew import hot_keys

    p = hot_ledger(spark)
    s = si.students(spark, "/root/testdata/sf0.01")
    hot = hot_keys(p, "student_id", sample_fraction=0.5, min_rows=1000)
    assert [r.student_id for r in hot.collect()] == ["7"]
    split = ledger.students_left_join_penalties(s, p, sample_fraction=0.5, min_rows=1000)
    plain = ledger.students_left_join_penalties(s, p, split_hot=False)
    assert split.count() == plain.count()
    assert split.exceptAll(plain).count() == 0
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "LeftAnti" in plan


def test_hot_split_reset_and_range(spark):
    from pointbook.operators.ledger import penalties_in_range

    p = hot_ledger(spark)
    req = spark.createDataFrame([(1, "7", "2024-01-03", "2024-01-20"), (2, "5", "", None)],
                                "seq bigint, student_id string, `from` string, `to` string")
    kw = dict(sample_fraction=0.5, min_rows=1000, max_request_rows=0)  # shuffled path with the hot split
    split_rem, split_cnt = mutate.reset_penalties(p, req, max_per_key=0)  # by covered days
    plain_rem, plain_cnt = mutate.reset_penalties(p, req)
    assert split_rem.count() == plain_rem.count() and split_rem.exceptAll(plain_rem).count() == 0
    assert sorted(map(tuple, split_cnt.collect())) == sorted(map(tuple, plain_cnt.collect()))
    a = penalties_in_range(p, req, **kw)
    b = penalties_in_range(p, req, split_hot=False)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert "BETWEEN" not in str(split_rem._jdf.queryExecution().optimizedPlan()).upper()


def test_small_request_batch_is_broadcast(spark):
    """A small reset batch is broadcast: the ledger is scanned, never shuffled."""
    p = hot_ledger(spark)
    req = spark.createDataFrame([(1, "7", "2024-01-03", "2024-01-20")],
                                "seq bigint, student_id string, `from` string, `to` string")
    remaining, _ = mutate.reset_penalties(p, req)
    plan = remaining._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert "Exchange hashpartitioning(student_id" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_on_both_sides_is_salted(spark, how):
    """A student with a third of both sides, beyond the broadcast bound: the same rows, and no task above its share."""
    from pointbook.operators.skew import hot_keys, join_splitting_hot_keys

    p = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") % 200).cast("string")).alias("student_id"))
    r = spark.range(300).select(F.col("id").alias("request"), F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") % 120).cast("string")).alias("_rsid"))
    hot = hot_keys(p, "student_id", sample_fraction=0.9, min_rows=500)
    extra = F.col("row") % 5 == F.col("request") % 5
    plain = p.join(r, (F.col("student_id") == F.col("_rsid")) & extra, how)
    salted = join_splitting_hot_keys(p, r, "student_id", "_rsid", hot, how, extra, max_small_rows=10, salts=16)
    assert salted.columns == plain.columns and salted.count() == plain.count()
    assert salted.exceptAll(plain).count() == 0
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    parts = p.where("student_id = '7'").groupBy(F.pmod(F.xxhash64("row", "student_id"), F.lit(16))).count().agg(F.max("count")).first()[0]
    assert parts < 3 * 1000 / 16
