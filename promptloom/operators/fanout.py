"""Tasks of a plan: one row each, answered apart, gathered again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.jsonx import clean_llm_json, safe_parse
from promptloom.schemas import EXPANDED, JUDGE

#: What a run's error column says.
INVALID_JUDGE = "invalid_judge_output"
DECOMPOSITION_FAILED = "decomposition_provider_error"
FAN_IN_FAILED = "fan_in_failed"


def fan_out(plans: DataFrame, key: str, tasks: str = "tasks") -> DataFrame:
    """``key``, pos (from 0), agent and query of each task; a plan without tasks keeps one row with nulls."""
    return plans.select(key, F.posexplode_outer(tasks)).select(key, "pos", F.col("col.agent").alias("agent"), F.col("col.query").alias("query"))


def fan_in(results: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``key`` and ``results``: JSON of the successful tasks (agent, result) in their order, ``[]`` where all failed.

    ``results`` has ``key``, pos, agent, result and error; a row counts if it has a result and no error. Every key of
    ``keys`` comes out. The tasks of a plan are few, so a group is small.
    """
    good = results.filter("error IS NULL AND result IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "agent", "result")))
    packed = good.groupBy(key).agg(F.to_json(F.transform(ordered, lambda x: F.struct(x["agent"].alias("agent"), x["result"].alias("result")))).alias("results"))
    return keys.select(key).distinct().join(packed, key, "left").withColumn("results", F.coalesce("results", F.lit("[]")))


def candidates(tasks: DataFrame, n: int = 3) -> DataFrame:
    """Each task ``n`` times, with ``cand`` from 1."""
    return tasks.withColumn("cand", F.explode(F.sequence(F.lit(1), F.lit(n))))


def best_of_n(scored: DataFrame, *task: str, score: str = "score", cand: str = "cand") -> DataFrame:
    """The candidate with the highest score of each task, of equal ones the first; null scores lose.

    An aggregate that combines on the map side, not a window that sorts every candidate.
    """
    rest = [c for c in scored.columns if c not in (*task, score, cand)]
    rank = F.struct(F.col(score).alias("s"), (-F.col(cand)).alias("c"), F.struct(score, cand, *rest).alias("row"))
    return scored.groupBy(*task).agg(F.max(rank).alias("best")).select(*task, "best.row.*")


def judge_alignment(responses: Column, best_indices: Column, scores: Column) -> Column:
    """struct(winner, top_score, error): scores must match the responses one to one, and the first index exist."""
    sizes = F.coalesce(F.size(scores) == F.size(responses), F.lit(False)) & (F.size(responses) > 0)
    first = F.get(best_indices, 0)
    good = sizes & F.coalesce((first >= 0) & (first < F.size(responses)), F.lit(False))
    return F.struct(F.when(good, F.get(responses, first)).alias("winner"), F.when(good, F.get(scores, first)).alias("top_score"), F.when(~good, F.lit(INVALID_JUDGE)).alias("error"))


def judged(responses: Column, reply: Column) -> Column:
    """struct(winner, top_score, error) by a judge's reply; one that can't be read is an invalid judgement."""
    verdict = safe_parse(clean_llm_json(reply), JUDGE)
    return judge_alignment(responses, verdict["best_indices"], verdict["scores"])


def expanded_tasks(reply: Column) -> Column:
    """The tasks (agent, query, expected_output) of an expansion's reply; null if it isn't one."""
    return safe_parse(clean_llm_json(reply), EXPANDED)["tasks"]


def run_error(has_plan: Column, judgement: Column, has_answer: Column) -> Column:
    """What ended a run, the first of: no plan could be read, the judge's was invalid, no answer could be read."""
    return F.when(~has_plan, F.lit(DECOMPOSITION_FAILED)).otherwise(F.coalesce(judgement, F.when(~has_answer, F.lit(FAN_IN_FAILED))))


def sub_questions(reply: Column) -> Column:
    """An array of strings from a decomposition's JSON reply, null if it isn't one."""
    return F.from_json(reply, "array<string>")
