"""The review loop: a solution is approved, or improved and reviewed again, at most three times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.jsonx import clean_llm_json, is_truthy, strict_json
from promptloom.functions.render import wrapped_prompt
from promptloom.operators.call import Backend, call
from promptloom.sources import materialise

#: Fixed value: reviews at most.
MAX_RETRIES = 3
FAILED = "Failed to generate initial solution"
NO_FEEDBACK = "No feedback provided"


def approved(review: Column) -> Column:
    """Whether JSON text of a review approves: true, or a string that says so in any case; never 1 or null."""
    return F.coalesce(F.lower(F.get_json_object(review, "$.approved")) == "true", F.lit(False))


def review_outcome(verdicts: Column) -> Column:
    """struct(reviews, improves, approved, version) of the loop over recorded verdicts, oldest first.

    A verdict is text as ``approved`` takes it; null is a reply that couldn't be read, which ends the loop. The first
    approval is not enough: approval counts from the second review on. After the third review the loop ends, so its
    improvement is not reviewed. ``version`` is the number of improvements that the result has gone through. A null
    array counts as an empty one.
    """
    zero, no = F.lit(0), F.lit(False)
    start = F.struct(zero.alias("reviews"), zero.alias("improves"), no.alias("approved"), no.alias("done"))

    def step(s: Column, v: Column) -> Column:
        yes = F.coalesce(F.lower(v) == "true", F.lit(False))
        ends = v.isNull() | (yes & (s["reviews"] >= 1))
        improves = s["improves"] + F.when(~yes & v.isNotNull(), 1).otherwise(0)
        nexts = F.struct((s["reviews"] + 1).alias("reviews"), improves.alias("improves"), (yes & (s["reviews"] >= 1)).alias("approved"), ends.alias("done"))
        return F.when(s["done"], s).otherwise(nexts)

    folded = F.aggregate(F.slice(F.coalesce(verdicts, F.array().cast("array<string>")), 1, MAX_RETRIES), start, step)
    return F.struct(folded["reviews"].alias("reviews"), folded["improves"].alias("improves"), folded["approved"].alias("approved"), folded["improves"].alias("version"))


def review_loop(solutions: DataFrame, key: str, backend: Backend, reviewer: str, improver: str, stage: str = "ticket") -> DataFrame:
    """Run the loop with a model. ``solutions`` has ``key``, ticket and solution (JSON text).

    Returns ``key``, solution, last_good (the last one that could be read), reviews, improves, approved, error. Each
    round is one batch of calls over the rows still open; rounds are written, so none is called twice. As recorded runs
    do, an improvement that can't be read is what comes out, while ``last_good`` keeps the one before.
    """
    s = solutions.select(key, "ticket", clean_llm_json(F.col("solution")).alias("solution"))
    s = s.withColumn("solution", strict_json("solution"))
    good = is_truthy(F.col("solution"))
    state = materialise(
        s.withColumns({
            "last_good": F.when(good, F.col("solution")), "reviews": F.lit(0), "improves": F.lit(0), "approved": F.lit(False),
            "error": F.when(~good, F.lit(FAILED)), "open": good,
        }), "review-state")
    for attempt in range(MAX_RETRIES):
        active = state.filter("open")
        if active.isEmpty():
            break
        asked = active.withColumn("prompt", wrapped_prompt(F.lit(reviewer), F.concat(F.lit("Original Ticket:\n"), F.col("ticket"), F.lit("\n\nSuggested Solution:\n"), F.col("solution"))))
        answered = call(asked, "prompt", backend, f"{stage}-review")
        judged = materialise(
            answered.withColumn("review", strict_json(clean_llm_json(F.col("reply")))).drop("prompt", "reply"), "review-judged"
        )
        readable = is_truthy(F.col("review"))
        is_object = F.col("review").startswith("{")
        yes = readable & is_object & approved(F.col("review"))
        broken = F.col("call_error").isNotNull()
        moved = judged.withColumns({
            "error": F.when(broken, F.col("call_error")).when(readable & ~is_object, F.lit("review is not an object")).otherwise(F.col("error")),
            "reviews": F.col("reviews") + 1, "approved": yes & F.lit(attempt >= 1),
            "improving": ~broken & readable & is_object & ~yes,
            "open": ~broken & readable & is_object & ~(yes & F.lit(attempt >= 1)),
        })
        columns = state.columns
        to_improve = moved.filter("improving").withColumn(
            "prompt",
            F.concat(F.lit(f"{improver}\n\nOriginal Solution:\n"), F.col("solution"), F.lit("\n\nFeedback:\n"), F.coalesce(F.get_json_object("review", "$.feedback"), F.lit(NO_FEEDBACK))),
        ).drop("call_error")
        improved = call(to_improve, "prompt", backend, f"{stage}-improve").withColumn("new", strict_json(clean_llm_json(F.col("reply"))))
        failed = F.col("call_error").isNotNull()
        better = is_truthy(F.col("new"))
        improved = improved.withColumns({
            "solution": F.when(failed, F.col("solution")).otherwise(F.col("new")),
            "last_good": F.when(~failed & better, F.col("new")).otherwise(F.col("last_good")),
            "improves": F.col("improves") + 1, "open": F.col("open") & ~failed & better,
        })
        state = materialise(
            state.filter("NOT open").unionByName(moved.filter("NOT improving").select(*columns)).unionByName(improved.select(*columns)), "review-state"
        )
    return state.select(key, "solution", "last_good", "reviews", "improves", "approved", "error")
