import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from promptloom.llm.sampling import ProportionalSample, allocate, resolve_values
from promptloom.llm.values import Resolver, slips

CATEGORIES = ["technical", "billing", "general", "escalation", "unsure"]
DOMAINS = ["Scientific / Technical", "Historical / Cultural", "Financial / Business", "General / Everyday", "Fallback"]


@pytest.mark.parametrize(
    ("listed", "value", "meant"),
    [
        (CATEGORIES, " TECHNICAL.\n", "technical"), (CATEGORIES, '"billing"', "billing"), (CATEGORIES, "bliling", "billing"), (CATEGORIES, "billing issue", "billing"),
        (CATEGORIES, "tech", "technical"), (CATEGORIES, "technical | billing", None), (CATEGORIES, "???", None), (CATEGORIES, "spam", None), (CATEGORIES, None, None), (CATEGORIES, "", None),
        (CATEGORIES, " escalaton", "escalation"), (DOMAINS, "Financial", "Financial / Business"), (DOMAINS, "financial & business", "Financial / Business"),
        (DOMAINS, "Genera l/ Everyday", "General / Everyday"), (DOMAINS, "Scientific or Historical", None), (DOMAINS, "Falblack", "Fallback"), (DOMAINS, "Astrology", None),
        (["low", "medium", "high", "critical"], "lw", "low"), (["low", "medium", "high", "critical"], "med", "medium"), (["low", "medium", "high", "critical"], "n/a", None),
    ],
)
def test_values(listed, value, meant):
    assert Resolver(listed).resolve(value) == meant


def test_slips():
    assert [slips("abc", x, 2) for x in ("abc", "acb", "ab", "xbc", "abcdef", "bca")] == [0, 1, 1, 1, 3, 2]


def brute(counts, shares, minimum, size):
    """Draw one by one: floors first, then always the smallest priority."""
    seats = {t: min(counts[t], minimum[t]) for t in counts}
    while sum(seats.values()) < size:
        open_ = [((2 * seats[t] + 1) / (2 * shares[t]), t) for t in counts if seats[t] < counts[t] and shares[t] > 0]
        if not open_:
            break
        seats[min(open_)[1]] += 1
    return seats


def test_allocation_equals_drawing_one_by_one():
    draw = random.Random(1)
    for _ in range(400):
        n = draw.randint(1, 6)
        counts = {t: draw.choice([0, 1, 3, 20, 200]) for t in range(n)}
        shares = {t: Fraction(draw.randint(0, 5), 10) for t in range(n)}
        minimum = {t: draw.choice([0, 0, 2, 5]) for t in range(n)}
        size = draw.randint(0, 150)
        assert allocate(counts, shares, minimum, size) == brute(counts, shares, minimum, size)


TARGETS = "target_id int, plan_name string, category string, urgency string, domain string, target_share double, min_rows int, sample_share double"


def make(spark, records, targets, **options):
    fields = ["category", "urgency", "domain"]
    df = spark.createDataFrame([(i, c, None, None, "x") for i, c in records], "record_id long, category string, urgency string, domain string, target_id string")
    return ProportionalSample(df, spark.createDataFrame([(t, "p", c, None, None, s, m, 0.5) for t, c, s, m in targets], TARGETS), fields, **options)


def test_sample_and_report(spark):
    records = [(i, "a" if i % 10 else "b") for i in range(1000)] + [(None, "a"), (5000, None), (5001, "z")]
    sampler = make(spark, records, [(1, "a", 0.5, 5), (2, "b", 0.5, 5), (3, "c", 0.1, 2)], bucket_rows=37)
    rows = sampler.sample().collect()
    assert len({r.record_id for r in rows}) == len(rows) == 500  # b runs out, and its seats go to a
    drawn = {t: sorted(r.rank for r in rows if r.target_id == t) for t in (1, 2)}
    assert drawn == {1: list(range(1, 401)), 2: list(range(1, 101))}
    assert max(r.priority for r in rows if r.rank <= 5) == 0.0
    assert sorted(r.record_id for r in sampler.sample().collect()) == sorted(r.record_id for r in rows)
    report = {r.target_id: r for r in sampler.report().collect()}
    assert (report[1].shortfall, report[2].shortfall, report[3].shortfall) == (0, 150, 50) and report[2].exhausted


def test_exact_decimals(spark):
    # 0.1 x 0.5 of 1000 needs 50, not 51, though 0.1 is no exact double
    report = make(spark, [(i, "a") for i in range(1000)], [(1, "a", 0.1, 0)]).report().first()
    assert (report.sample_size, report.needed) == (500, 50)


def test_empty_records_and_targets(spark):
    short = make(spark, [], [(1, "a", 0.5, 3)])
    assert short.sample().isEmpty() and short.report().first().shortfall == 3
    none = ProportionalSample(spark.createDataFrame([(1, "a")], "record_id long, category string"), spark.createDataFrame([], TARGETS), ["category"])
    assert none.sample().isEmpty() and none.report().isEmpty()


def test_resolve_values_keeps_rows_and_other_columns(spark):
    df = spark.createDataFrame([("Billing ", 1), (None, 2), ("x" * 100_000, 3)], "category string, n int")
    assert sorted((r.n, r.category) for r in resolve_values(df, {"category": CATEGORIES}).collect()) == [(1, "billing"), (2, None), (3, None)]
