"""Range totals and first coverage against brute force; plans without pairs; many requests of one student."""

import random

import pytest
from pyspark.sql import functions as F

from pointbook.operators import ledger, mutate
from pointbook.operators.ranges import by_day, first_covering, totals_at

from conftest import rows

LEDGER = "id string, student_id string, points long, occurred_on string"
RANGES = "seq bigint, student_id string, `from` string, `to` string"


def day(i):
    return f"2024-{i // 28 + 1:02d}-{i % 28 + 1:02d}"


def make(seed, students=4, n=120, m=60):
    r = random.Random(seed)
    led = [(f"p{i}", f"s{r.randint(0, students)}", r.randint(-3, 5), r.choice([day(r.randint(0, 90)), "2024-99-99", "0000-00-00"])) for i in range(n)]
    req = [(i * 7 % (m + 1) * 100 + i, r.choice([f"s{r.randint(0, students)}", "ghost"]),
            r.choice([None, "", day(r.randint(0, 90))]), r.choice([None, "", day(r.randint(0, 90)), day(r.randint(40, 90))])) for i in range(m)]
    return led, req


@pytest.mark.parametrize("seed", range(4))
def test_ledger_total_equals_brute_force(spark, seed):
    led, req = make(seed)
    got = {r.request_seq: r.total for r in ledger.ledger_total(spark.createDataFrame(led, LEDGER), spark.createDataFrame(req, RANGES)).collect()}
    want = {q: sum(p for _, s, p, d in led if s == st and (lo or "0000-01-01") <= d <= (hi or "9999-12-31")) for q, st, lo, hi in req}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("few", [{}, {"max_per_key": 0}])
def test_resets_equal_sequential_deletes(spark, seed, few):
    led, req = make(seed, m=25)
    req = [(q, s, lo or day(3), hi or "bad") for q, s, lo, hi in req]
    left, deleted = list(led), {}
    for q, st, lo, hi in sorted(req):
        ok = hi != "bad"
        gone = [x for x in left if ok and x[1] == st and lo <= x[3] <= hi]
        deleted[q] = len(gone)
        left = [x for x in left if x not in gone]
    remaining, counts = mutate.reset_penalties(spark.createDataFrame(led, LEDGER), spark.createDataFrame(req, RANGES), **few)
    assert rows(remaining) == sorted(left)
    assert {r.seq: r.deleted for r in counts.collect()} == deleted


def test_one_student_with_many_requests(spark):
    """10,000 requests of a student with 3,000 days: rows grow with the sum, not the product."""
    days = spark.range(3000).select(F.lit("s").alias("student_id"), F.format_string("%04d-01-01", F.col("id")).alias("occurred_on"),
                                    (F.col("id") % 5).alias("points"), F.lit(1).cast("bigint").alias("rows"))
    req = spark.range(10_000).select(F.col("id").alias("_rseq"), F.lit("s").alias("_rsid"), F.format_string("%04d-01-01", F.col("id") * 7 % 2900).alias("_lo"),
                                     F.format_string("%04d-06-01", F.col("id") * 7 % 2900 + F.col("id") % 90).alias("_hi"))
    got = {r.occurred_on: r._rseq for r in first_covering(days, req).collect()}
    want = {}
    for i in range(9999, -1, -1):
        lo = i * 7 % 2900
        for d in range(lo, lo + i % 90 + 1):
            if d < 3000:
                want[f"{d:04d}-01-01"] = i
    assert got == want
    t = totals_at(days, req, ["points"], "_rsid").select("_rseq", (F.col("points_to") - F.col("points_below")).alias("p")).collect()
    assert all(r.p == sum(d % 5 for d in range(r._rseq * 7 % 2900, min(3000, r._rseq * 7 % 2900 + r._rseq % 90 + 1))) for r in t[::97])


def test_plans_hold_no_range_join(spark):
    led, req = make(0)
    led, req = spark.createDataFrame(led, LEDGER), spark.createDataFrame(req, RANGES)
    for df in (ledger.ledger_total(led, req), mutate.reset_penalties(led, req)[1], first_covering(by_day(led), mutate._ranges(req))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert joins and not any(f"occurred_on#" in line and (" >= " in line or " <= " in line) and "(_lo#" not in line for line in joins), joins
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
        for line in joins:  # days and requests meet by equality only
            assert not any(f"{op} _lo#" in line or f"{op} _hi#" in line for op in ("occurred_on >=", "occurred_on <="))


def test_empty_inputs(spark):
    led, req = spark.createDataFrame([], LEDGER), spark.createDataFrame([(1, "s", day(1), day(2))], RANGES)
    assert [r.total for r in ledger.ledger_total(led, req).collect()] == [0]
    assert ledger.ledger_total(led, req.limit(0)).collect() == []
    remaining, counts = mutate.reset_penalties(led, req)
    assert remaining.count() == 0 and [r.deleted for r in counts.collect()] == [0]
