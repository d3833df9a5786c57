"""Samples whose categories have given shares."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction
from math import ceil, floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from promptloom.llm.values import Resolver

MAX_TARGETS = 10_000
SAMPLE = "target_id int, plan_name string, record_id long, rank long, priority double"
REPORT = (
    "target_id int, plan_name string, records_in_plan long, sample_size long, available long, needed long, "
    "seats long, shortfall long, exhausted boolean"
)


def resolve_values(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Replace free spellings in ``columns`` by the listed value each was meant to be, or null.

    One Arrow pass over the rows without a shuffle; each worker resolves a spelling once.
    """
    names = list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    lists = [columns[n] for n in names]

    @F.pandas_udf(schema)
    def resolved(*values: pd.Series) -> pd.DataFrame:
        own = [_resolver(tuple(x)) for x in lists]
        return pd.DataFrame({n: [r.resolve(v) for v in s] for n, r, s in zip(names, own, values)}, dtype=object)

    both = df.withColumn("_resolved", resolved(*[F.col(n).cast("string") for n in names]))
    return both.withColumns({n: F.col(f"_resolved.{n}") for n in names}).drop("_resolved")


_resolvers: dict[tuple, Resolver] = {}


def _resolver(listed: tuple) -> Resolver:
    return _resolvers.setdefault(listed, Resolver(list(listed)))


def allocate(counts: dict[int, int], shares: dict[int, Fraction], minimum: dict[int, int], size: int) -> dict[int, int]:
    """Seats of each category under the divisor method of Webster, from the counts alone.

    Record r of a category has priority (r - 1/2) / share; the first ``minimum`` of a category come before all others,
    then the smallest priorities, equal ones in the order of the ids, until ``size`` are drawn. A category with no
    records left drops out, so that its seats go to the next priorities. The floors are kept even beyond ``size``.
    """
    seats = {t: min(counts[t], max(0, minimum[t])) for t in counts}
    open_ = [t for t in sorted(counts) if shares[t] > 0 and seats[t] < counts[t]]
    left = size - sum(seats.values())
    if left <= 0 or not open_:
        return seats

    def at(limit: Fraction) -> dict[int, int]:  # seats if all priorities up to the limit are drawn
        return {t: max(seats[t], min(counts[t], floor(limit * shares[t] + Fraction(1, 2)))) for t in open_}

    room = sum(counts[t] - seats[t] for t in open_)
    if left >= room:
        return seats | {t: counts[t] for t in open_}
    low, high = Fraction(0), max(Fraction(counts[t]) / shares[t] for t in open_)
    while True:  # bisect until at most one priority of each category lies between
        middle = (low + high) / 2
        if sum(at(middle).values()) - sum(seats[t] for t in open_) <= left:
            low = middle
        else:
            high = middle
        a, b = at(low), at(high)
        if all(b[t] - a[t] <= 1 for t in open_):
            break
    rest = left - sum(a[t] - seats[t] for t in open_)
    nexts = sorted(((Fraction(2 * a[t] + 1, 2) / shares[t], t) for t in open_ if b[t] > a[t]))
    for _, t in nexts[:rest]:
        a[t] += 1
    return seats | a


class ProportionalSample:
    """A stratified draw for each plan of ``targets`` from ``records``.

    ``records`` has one row for each record: ``record_id`` long and the category columns, already resolved.
    ``targets`` has ``sample_targets``' columns; a null category column means the plan does not look at it. A record
    of several targets of one plan belongs to the first. Null ids are no records; equal ids must be one row already.
    Empty records or targets give empty results (a target without records is reported short). Further columns, also of
    the same names as the results', are ignored. Plans with a null ``target_share`` or ``min_rows`` take 0.

    Scale: matching is an expression, so records are not joined; ranks within a category are exact but made from counts
    of hash buckets and a sort within each bucket, so no task sorts a category. What is collected and broadcast is
    one row for each target (at most ``MAX_TARGETS``) and for each target's bucket.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, fields: Sequence[str], seed: int = 7, bucket_rows: int = 50_000):
        rows = targets.select("target_id", "plan_name", *fields, "target_share", "min_rows", "sample_share").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.spark = records.sparkSession
        self.targets = sorted((r.asDict() for r in rows), key=lambda r: r["target_id"])
        self.fields, self.seed, self.bucket_rows = list(fields), seed, bucket_rows
        self.records = records.select("record_id", *self.fields).dropna(subset=["record_id"])
        self._plan()

    def _hits(self) -> DataFrame:
        """A row for each record and plan that it belongs to, with its targets."""
        plans = defaultdict(list)
        for t in self.targets:
            asked = [f for f in self.fields if t[f] is not None]
            test = F.lit(bool(asked))
            for f in asked:
                test = test & F.col(f).eqNullSafe(F.lit(t[f]))
            plans[t["plan_name"]].append(F.when(test, F.lit(t["target_id"])))
        each = [F.struct(F.lit(name).cast("string").alias("plan_name"), F.array_compact(F.array(*tests)).alias("hits")) for name, tests in plans.items()]
        if not each:
            each = [F.struct(F.lit(None).cast("string").alias("plan_name"), F.array().cast("array<int>").alias("hits"))]
        found = self.records.select("record_id", F.inline(F.filter(F.array(*each), lambda x: F.size(x["hits"]) > 0)))
        return found.withColumn("target_id", F.col("hits")[0])

    def _plan(self) -> None:
        hits = self._hits()
        first = hits.groupBy("plan_name", "target_id").agg(F.count("*").alias("n"))
        every = hits.select("plan_name", F.explode("hits").alias("target_id")).groupBy("plan_name", "target_id").agg(F.count("*").alias("every"))
        own: dict[int, int] = {}
        self.available = {}
        self.of_plan: dict[str, int] = defaultdict(int)
        for r in first.join(every, ["plan_name", "target_id"], "full").collect():  # a row for each target
            own[r["target_id"]] = r["n"] or 0
            self.available[r["target_id"]] = r["every"] or 0
            self.of_plan[r["plan_name"]] += r["n"] or 0
        exact = lambda x: Fraction(Decimal(repr(x))) if x is not None else Fraction(0)
        self.size, self.needed, self.seats = {}, {}, {}
        by_plan = defaultdict(list)
        for t in self.targets:
            by_plan[t["plan_name"]].append(t)
        for name, group in by_plan.items():
            size = floor(exact(group[0]["sample_share"]) * self.of_plan.get(name, 0))
            shares = {t["target_id"]: exact(t["target_share"]) for t in group}
            minimum = {t["target_id"]: t["min_rows"] or 0 for t in group}
            self.seats |= allocate({i: own.get(i, 0) for i in shares}, shares, minimum, size)
            for i in shares:
                self.size[i] = size
                self.needed[i] = max(minimum[i], ceil(shares[i] * size))
        self.own = own

    def _ranked(self, upto: dict[int, int], of: dict[int, int], every: bool) -> DataFrame:
        """The records of each target, of which there are ``of``, in their random order as far as rank ``upto``.

        With ``every`` a record of several targets of a plan is ranked in each, else in the first.
        """
        buckets = {i: max(1, -(-of.get(i, 0) // self.bucket_rows)) for i in upto}
        rows = [(i, n, buckets[i]) for i, n in upto.items()]
        wanted = F.broadcast(self.spark.createDataFrame(rows, "target_id int, upto long, buckets long"))
        hits = self._hits()
        if every:
            hits = hits.withColumn("target_id", F.explode("hits"))
        keyed = (
            hits.join(wanted.filter("upto > 0"), "target_id")
            .withColumn("h", F.xxhash64(F.lit(self.seed), "target_id", "record_id"))
            .withColumn("bucket", F.floor((F.shiftrightunsigned("h", 32) * F.col("buckets")) / F.lit(2.0**32)).cast("long"))
        )
        sizes = keyed.groupBy("target_id", "bucket").agg(F.count("*").alias("n"))
        before = Window.partitionBy("target_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("target_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        # A bucket lies before, across or behind the last rank; only those up to it are read on.
        inside = Window.partitionBy("target_id", "bucket").orderBy(F.shiftrightunsigned("h", 0), "record_id")
        ranked = keyed.join(F.broadcast(starts) if sum(buckets.values()) <= 1_000_000 else starts, ["target_id", "bucket"]).filter("start < upto")
        ranked = ranked.withColumn("rank", F.row_number().over(inside) + F.col("start")).filter("rank <= upto")
        return ranked.select("target_id", "plan_name", "record_id", F.col("rank").cast("long").alias("rank"))

    def sample(self) -> DataFrame:
        """target_id, plan_name, record_id, rank within the target, priority (0 for the floor's records)."""
        rows = [(t["target_id"], float(t["target_share"] or 0), int(t["min_rows"] or 0)) for t in self.targets]
        asked = F.broadcast(self.spark.createDataFrame(rows, "target_id int, share double, floor long"))
        ranked = self._ranked(self.seats, self.own, every=False).join(asked, "target_id")
        priority = F.when(F.col("rank") <= F.col("floor"), F.lit(0.0)).otherwise((F.col("rank") - 0.5) / F.col("share"))
        return ranked.select(F.col("target_id").cast("int"), "plan_name", "record_id", "rank", priority.alias("priority"))

    def report(self) -> DataFrame:
        """Each target: what the plan asks, what there is, what was drawn; ``shortfall`` > 0 where it can't be met.

        The draw itself tells: a target is short by the ranks up to its need for which it has no record left.
        """
        drawn = self.sample().groupBy("target_id").agg(F.count("*").alias("seats"))
        reached = self._ranked(self.needed, self.available, every=True).groupBy("target_id").agg(F.max("rank").alias("reached"))
        rows = [
            (i, t["plan_name"], self.of_plan.get(t["plan_name"], 0), self.size[i], self.available.get(i, 0), self.needed[i])
            for t in self.targets
            for i in [t["target_id"]]
        ]
        asked = self.spark.createDataFrame(rows, "target_id int, plan_name string, records_in_plan long, sample_size long, available long, needed long")
        asked = asked.join(reached, "target_id", "left")
        out = asked.join(drawn, "target_id", "left").withColumn("seats", F.coalesce("seats", F.lit(0).cast("long")))
        short = F.col("needed") - F.coalesce("reached", F.lit(0).cast("long"))
        return out.withColumns({"shortfall": short, "exhausted": F.col("seats") >= F.col("available")}).drop("reached")
