"""The two pipelines, from inputs to results, one row per input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.jsonx import clean_llm_json, is_truthy, parse_or_unsure, safe_parse, strict_json
from promptloom.functions.render import template_prompt, wrapped_prompt
from promptloom.operators.call import Backend, call
from promptloom.operators.fanout import DECOMPOSITION_FAILED, FAN_IN_FAILED, best_of_n, candidates, fan_in, fan_out, run_error
from promptloom.operators.reflexion import reflexion_loop
from promptloom.operators.review import FAILED, review_loop, review_outcome
from promptloom.operators.routing import domain_route, domain_route_of, merge_branches, split_by_guardrail, ticket_branch
from promptloom.plans import prompts
from promptloom.schemas import ANSWER, DOMAIN, PLAN
from promptloom.sources import materialise


def _by_branch(branch: Column, texts: dict[str, str]) -> Column:
    """The text of each branch; a handful of fixed literals, so an expression rather than a join."""
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[branch]


def tickets(inputs: DataFrame, backend: Backend) -> DataFrame:
    """ticket_id, cleaned, sentiment, keywords, classification, branch, reply, reviews, improves, approved, error.

    Clean, then sentiment and keywords in one batch, classify, route, solve, and the review loop; unclear tickets get
    questions back instead. Any failed call is an error of its ticket.
    """
    rows = inputs.select("ticket_id", "text")
    cleaned = call(rows.withColumn("prompt", wrapped_prompt(F.lit(prompts.CLEAN), F.col("text"))), "prompt", backend, "clean")
    cleaned = cleaned.select("ticket_id", F.col("reply").alias("cleaned"), F.col("call_error").alias("error"))
    both = cleaned.select(
        "ticket_id", F.inline(F.array(*[
            F.struct(F.lit(name).alias("kind"), wrapped_prompt(F.lit(text), F.col("cleaned")).alias("prompt")) for name, text in (("sentiment", prompts.SENTIMENT), ("keywords", prompts.KEYWORDS))
        ])),
    )
    sides = call(both, "prompt", backend, "sentiment-keywords").groupBy("ticket_id").agg(
        F.max(F.when(F.col("kind") == "sentiment", strict_json(clean_llm_json(F.col("reply"))))).alias("sentiment"),
        F.max(F.when(F.col("kind") == "keywords", strict_json(clean_llm_json(F.col("reply"))))).alias("keywords"),
    )
    merged = cleaned.join(sides, "ticket_id").withColumns({
        "sentiment": F.get_json_object("sentiment", "$.sentiment"),
        "keywords": F.from_json(F.get_json_object("keywords", "$.keywords"), "array<string>"),
    })
    merged = merged.withColumn("error", F.coalesce("error", F.when(F.col("sentiment").isNull(), "missing sentiment").when(F.col("keywords").isNull(), "missing keywords")))
    asked = merged.withColumn("prompt", F.when(F.col("error").isNull(), wrapped_prompt(F.lit(prompts.CLASSIFY), F.col("cleaned"), F.to_json(F.struct("sentiment", "keywords")))))
    classified = call(asked, "prompt", backend, "classify").withColumn("error", F.coalesce("error", "call_error")).withColumn("classification", parse_or_unsure(F.col("reply")))
    classified = materialise(classified.drop("prompt", "reply", "call_error").withColumn("branch", ticket_branch(F.col("classification.category"))), "classified")
    payload = F.to_json("classification")
    prompt = F.when(F.col("branch") == "unsure", wrapped_prompt(F.lit(prompts.CLARIFY), payload)).otherwise(wrapped_prompt(_by_branch(F.col("branch"), prompts.SOLVE), payload))
    solved = call(classified.withColumn("prompt", F.when(F.col("error").isNull(), prompt)), "prompt", backend, "solve").drop("prompt")
    solved = solved.withColumn("error", F.coalesce("error", "call_error")).drop("call_error")
    loop = review_loop(solved.filter("error IS NULL AND branch <> 'unsure'").select("ticket_id", payload.alias("ticket"), F.col("reply").alias("solution")), "ticket_id", backend, prompts.REVIEW, prompts.IMPROVE)
    loop = loop.withColumnRenamed("error", "loop_error")
    out = solved.join(loop, "ticket_id", "left")
    return out.select(
        "ticket_id", "cleaned", "sentiment", "keywords", "classification", "branch", F.when(F.col("branch") == "unsure", F.col("reply")).otherwise(F.col("solution")).alias("reply"),
        "reviews", "improves", "approved", F.coalesce("error", "loop_error").alias("error"),
    )


def research(inputs: DataFrame, backend: Backend, n: int = 1, reflect: bool = True) -> DataFrame:
    """The results of ``research_runs``."""
    return research_runs(inputs, backend, n, reflect)[0]


def research_runs(inputs: DataFrame, backend: Backend, n: int = 1, reflect: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, audit): query_id, route, route_reason, confidence, answer, reflection_scores, error; query_id, stage, iteration, message.

    Guardrail, domain, plan, tasks answered ``n`` times each of which a judge keeps the best, answer, and the reflexion
    loop. Rejected inputs cause no call at all. Questions routed to Fallback get the route's reason and no answer.
    """
    rows = inputs.select("query_id", "text")
    allowed, rejected = split_by_guardrail(rows, "text")
    asked = allowed.withColumn("prompt", F.concat(F.lit(prompts.ROUTE + "\nUser Query: "), "text"))
    routed = call(asked, "prompt", backend, "route", temperature=0.0)
    reply = clean_llm_json(F.col("reply"))
    routed = routed.withColumns({"json": strict_json(reply), "classification": safe_parse(reply, DOMAIN)})
    route = domain_route_of(F.col("json"))
    routed = routed.select("query_id", "text", "classification", route.alias("r"), F.col("call_error").alias("error"))
    turned = rejected.select("query_id", "text", "classification", domain_route(F.col("classification.domain"), F.col("classification.is_safe")).alias("r"), F.lit(None).cast("string").alias("error"))
    every = materialise(routed.unionByName(turned).select("query_id", "text", "classification", "r.*", "error"), "routed")
    working = every.filter("route <> 'Fallback' AND error IS NULL")
    planned = call(working.withColumn("prompt", template_prompt(_by_branch(F.col("route"), prompts.DECOMPOSE), F.col("text"))), "prompt", backend, "decompose")
    planned = materialise(planned.select("query_id", "route", safe_parse(clean_llm_json(F.col("reply")), PLAN).alias("plan")), "planned")
    tasks = planned.filter("plan IS NOT NULL").select("query_id", F.posexplode("plan.tasks").alias("pos", "task")).select("query_id", "pos", "task.*")
    tried = call(candidates(tasks, n).withColumn("prompt", F.concat("query", F.when(F.col("cand") > 1, F.concat(F.lit("\n(candidate "), F.col("cand").cast("string"), F.lit(")"))).otherwise(F.lit("")))), "prompt", backend, "task").drop("prompt")
    result = strict_json(clean_llm_json(F.col("reply")))
    tried = tried.withColumn("result", F.when(is_truthy(result), result)).withColumn("error", F.coalesce("call_error", F.when(F.col("result").isNull(), F.lit("Invalid JSON response")))).drop("reply", "call_error")
    if n > 1:
        judged = call(tried.withColumn("prompt", F.when(F.col("error").isNull(), wrapped_prompt(F.lit(prompts.SCORE), F.col("result")))), "prompt", backend, "judge").withColumn("score", F.expr("try_cast(reply AS double)"))
        tried = best_of_n(judged.drop("prompt", "reply", "call_error"), "query_id", "pos")
    gathered = fan_in(materialise(tried.select("query_id", "pos", "agent", "result", "error"), "results"), planned.filter("plan IS NOT NULL"), "query_id").join(planned.select("query_id", "route"), "query_id")
    answered = call(gathered.withColumn("prompt", template_prompt(_by_branch(F.col("route"), prompts.FAN_IN), F.col("results"))), "prompt", backend, "fan_in")
    answered = materialise(answered.select("query_id", F.col("route").alias("domain"), safe_parse(clean_llm_json(F.col("reply")), ANSWER).alias("a")).select("query_id", "domain", "a.answer", F.col("a").isNull().alias("failed")), "answered")
    if reflect:
        better, rounds = reflexion_loop(answered.select("query_id", "domain", "answer"), "query_id", backend)
        answered = answered.drop("answer").join(better.withColumnRenamed("error", "loop_error"), "query_id", "left")
    else:
        answered = answered.withColumns({"reflection_scores": F.lit(None).cast("array<double>"), "loop_error": F.lit(None).cast("string")})
        rounds = None
    out = every.join(planned.select("query_id", F.col("plan").isNull().alias("no_plan")), "query_id", "left").join(answered.select("query_id", "answer", "reflection_scores", "failed", "loop_error"), "query_id", "left")
    error = F.coalesce("error", F.when(F.col("no_plan"), F.lit(DECOMPOSITION_FAILED)).when(F.col("failed"), F.lit(FAN_IN_FAILED)), "loop_error")
    results = out.select("query_id", "route", "route_reason", F.col("classification.confidence").alias("confidence"), "answer", "reflection_scores", error.alias("error"))
    stages = [(every, "route", F.concat("route", F.lit(": "), "route_reason")), (planned, "plan", F.concat(F.size("plan.tasks").cast("string"), F.lit(" tasks"))), (tried, "task", F.concat("agent", F.lit(": "), F.coalesce("error", F.lit("ok"))))]
    stages.append((answered, "fan_in", F.when(F.col("failed"), F.lit(FAN_IN_FAILED)).otherwise(F.lit("ok"))))
    audit = None
    for rows, stage, message in stages:
        own = rows.select("query_id", F.lit(stage).alias("stage"), F.lit(None).cast("int").alias("iteration"), message.alias("message"))
        audit = own if audit is None else audit.unionByName(own)
    if rounds is not None:
        audit = audit.unionByName(rounds.select("query_id", F.lit("reflexion").alias("stage"), "iteration", F.coalesce("line", "diff").alias("message")))
    return results, audit.filter("message IS NOT NULL")


# Recorded runs, whose replies are in tables -----------------------------------------------------------------------------


def recorded_tickets(runs: DataFrame) -> DataFrame:
    """What the ticket pipeline makes of recorded replies: run_id, branch, reviews, improves, approved, steps, error.

    ``runs`` has run_id, sentiment, keywords, classification, verdicts and solution. No call is made.
    """
    merged = merge_branches(runs.select("run_id", "sentiment"), runs.select("run_id", "keywords"), "run_id").select("run_id", F.col("error").alias("missing"))
    rows = runs.select("run_id", "classification", "verdicts", "solution").join(merged, "run_id")
    rows = rows.select("*", ticket_branch(F.col("classification.category")).alias("branch"), review_outcome(F.col("verdicts")).alias("o"))
    worked = F.col("missing").isNull() & (F.col("branch") != "unsure")
    none = F.when(worked & F.col("solution").isNull(), F.lit(FAILED))
    looped = worked & none.isNull()
    return rows.select(
        "run_id", "branch", *[F.when(looped, F.col(f"o.{c}")).alias(c) for c in ("reviews", "improves", "approved")],
        F.when(looped, F.array_join("solution.solution_steps", "\n")).alias("steps"), F.coalesce("missing", none).alias("error"),
    )


def recorded_research(questions: DataFrame, routing: DataFrame, plans: DataFrame, results: DataFrame, answers: DataFrame) -> DataFrame:
    """What the research pipeline makes of recorded replies: query_id, route, route_reason, tasks, answered, answer, error.

    ``questions`` has query_id and text, ``routing`` query_id, domain and is_safe, ``plans`` query_id and tasks, ``results``
    query_id, pos and error, ``answers`` query_id and answer; one row for each question at most, but ``results``, one for
    each task. Questions that the guardrail rejects, or that go to Fallback, take no further stage.
    """
    allowed, rejected = split_by_guardrail(questions.select("query_id", "text"), "text")
    turned = rejected.select("query_id", domain_route(F.col("classification.domain"), F.col("classification.is_safe")).alias("r"))
    known = routing.select("query_id", "domain", "is_safe", F.lit(True).alias("known"))
    routed = allowed.join(known, "query_id", "left").select("query_id", F.when(F.col("known"), domain_route(F.col("domain"), F.col("is_safe"))).otherwise(domain_route(F.lit(None), F.lit(True), F.lit(False))).alias("r"))
    every = routed.unionByName(turned).select("query_id", "r.*")
    tasks = fan_out(plans, "query_id").filter("pos IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("tasks"))
    good = results.groupBy("query_id").agg(F.count_if(F.col("error").isNull()).alias("answered"))
    out = every.join(tasks, "query_id", "left").join(good, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")
    working = F.col("route") != "Fallback"
    error = run_error(F.col("tasks").isNotNull(), F.lit(None).cast("string"), F.col("answer").isNotNull())
    return out.select(
        "query_id", "route", "route_reason", *[F.when(working, F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("tasks", "answered")],
        F.when(working, F.col("answer")).alias("answer"), F.when(working, error).alias("error"),
    )
