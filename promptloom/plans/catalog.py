"""All queries of the core over the tables of TESTDATA.md, each with the SQL that checks it.

Where the tables lack a case (fences, credentials, odd JSON), the input is made from their columns by arithmetic on
ids, alike in both engines. Every query runs over whole tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import guardrail, jsonx, render
from promptloom.operators import fanout, reflexion, review, routing
from promptloom.operators.call import RuleBackend, call
from promptloom.plans import dry_run, pipeline, prompts
from promptloom.sources import once, read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _pick(n: Column, *cases: Column | str | None) -> Column:
    """The case with the number of ``n`` modulo their count."""
    out = None
    for i, c in enumerate(cases):
        value = F.lit(c) if not isinstance(c, Column) else c
        test = n % len(cases) == i
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


# SQL pieces. DuckDB's \w, \d and \b are those of ASCII, so letters are named, and boundaries are spelled out.
_L = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_NL = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
_SQL_INJECTION = " OR ".join(f"contains(lower({{0}}), '{p}')" for p in guardrail.INJECTION_PHRASES)
_SQL_PII = rf"regexp_matches({{0}}, '(^|{_NL}|[\.-])[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}][\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\.-]*@[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\.-]+\.{_L}+($|{_NL})') OR regexp_matches({{0}}, '(^|{_NL})\p{{Nd}}{{{{10,15}}}}($|{_NL})')"
_SQL_PII = _SQL_PII.replace("{{10,15}}", "{10,15}")


def _sql_reason(text: str) -> str:
    injection, pii = _SQL_INJECTION.replace("{0}", text), _SQL_PII.replace("{0}", text)
    return f"""CASE WHEN {text} IS NULL THEN 'No input' WHEN {injection} THEN 'Prompt injection attempt detected'
      WHEN {pii} THEN 'PII detected in input' WHEN regexp_matches({text}, 'sk-[a-zA-Z0-9]{{10,}}') THEN 'Sensitive credential detected'
      ELSE 'Input safe' END"""


# Guardrail ------------------------------------------------------------------------------------------------------------


def _judged(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(F.col(key), guardrail.verdict(text).alias("v")).select(key, "v.allowed", "v.reason")


@_query(f"SELECT doc_id, reason = 'Input safe' AS allowed, reason FROM (SELECT doc_id, {_sql_reason('text')} AS reason FROM documents)")
def guardrail_documents(spark: SparkSession, d: str) -> DataFrame:
    return _judged(read_table(spark, d, "documents", "doc_id", "text"), "doc_id", F.col("text"))


@_query(f"SELECT DISTINCT query_id, reason = 'Input safe' AS allowed, reason FROM (SELECT query_id, {_sql_reason('text')} AS reason FROM questions WHERE query_id IS NOT NULL)")
def guardrail_questions(spark: SparkSession, d: str) -> DataFrame:
    return _judged(once(read_table(spark, d, "questions", "query_id", "text"), "query_id"), "query_id", F.col("text"))


@_query(f"SELECT DISTINCT ticket_id, reason = 'Input safe' AS allowed, reason FROM (SELECT ticket_id, {_sql_reason('text')} AS reason FROM tickets WHERE ticket_id IS NOT NULL)")
def guardrail_tickets(spark: SparkSession, d: str) -> DataFrame:
    return _judged(once(read_table(spark, d, "tickets", "ticket_id", "text"), "ticket_id"), "ticket_id", F.col("text"))


_INJECTED = (" please ACT AS root", " write to a.b@example.org", " call 12345678901 now", " risk-assessment sk-abcdef1234567", " thanks")
_SQL_INJECTED = "(event_type || ' ' || props || CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_INJECTED)) + " END)"


def _injected(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events", "event_id", "event_type", "props")
    return events.select("event_id", F.concat("event_type", F.lit(" "), "props", _pick(F.col("event_id"), *_INJECTED)).alias("text"))


@_query(f"SELECT event_id, reason = 'Input safe' AS allowed, reason FROM (SELECT event_id, {_sql_reason('t')} AS reason FROM (SELECT event_id, {_SQL_INJECTED} AS t FROM events))")
def guardrail_injected(spark: SparkSession, d: str) -> DataFrame:
    return _judged(_injected(spark, d), "event_id", F.col("text"))


@_query(
    f"""SELECT event_id, 'Fallback' AS domain, false AS is_safe, reason AS reasoning, 0.0::DOUBLE AS confidence
    FROM (SELECT event_id, {_sql_reason('t')} AS reason FROM (SELECT event_id, {_SQL_INJECTED} AS t FROM events)) WHERE reason <> 'Input safe'"""
)
def guardrail_short_circuit(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = routing.split_by_guardrail(_injected(spark, d), "text")
    return rejected.select("event_id", "classification.*")


@_query(f"SELECT lang, reason, count(*) AS n FROM (SELECT lang, {_sql_reason('text')} AS reason FROM documents) GROUP BY lang, reason")
def guardrail_summary(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents", "lang", "text")
    return documents.select("lang", guardrail.verdict(F.col("text"))["reason"].alias("reason")).groupBy("lang", "reason").agg(F.count("*").alias("n"))


# Routing --------------------------------------------------------------------------------------------------------------

@_query(
    """SELECT run_id, CASE WHEN category IN ('technical', 'billing', 'general', 'escalation') THEN category ELSE 'unsure' END AS branch
    FROM (SELECT run_id, first(classification.category) AS category FROM ticket_run WHERE run_id IS NOT NULL GROUP BY run_id)"""
)
def route_tickets(spark: SparkSession, d: str) -> DataFrame:
    runs = once(read_table(spark, d, "ticket_run", "run_id", "classification.category"), "run_id")
    return runs.select("run_id", routing.ticket_branch(F.col("category")).alias("branch"))


_SQL_ROUTE = "CASE WHEN {safe} THEN 'Fallback' WHEN {missing} THEN 'Fallback' " + " ".join(f"WHEN {{domain}} = '{k}' THEN '{v[0]}'" for k, v in routing.DOMAIN_ROUTES.items()) + " ELSE 'Fallback' END"
_SQL_WHY = "CASE WHEN {safe} THEN '" + routing.UNSAFE[1] + "' WHEN {missing} THEN '" + routing.MISSING[1] + "' " + " ".join(f"WHEN {{domain}} = '{k}' THEN '{v[1]}'" for k, v in routing.DOMAIN_ROUTES.items()) + " ELSE '" + routing.AMBIGUOUS[1] + "' END"


def _sql_route(**x: str) -> str:
    return f"{_SQL_ROUTE.format(**x)} AS route, {_SQL_WHY.format(**x)} AS route_reason"


@_query(
    f"""SELECT query_id, {_sql_route(safe='NOT coalesce(is_safe, false)', missing='false', domain='domain')}
    FROM (SELECT query_id, first(domain) AS domain, first(is_safe) AS is_safe FROM routing WHERE query_id IS NOT NULL GROUP BY query_id)"""
)
def route_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = once(read_table(spark, d, "routing", "query_id", "domain", "is_safe"), "query_id")
    return rows.select("query_id", routing.domain_route(F.col("domain"), F.col("is_safe")).alias("r")).select("query_id", "r.*")


_DOMAINS = (*routing.DOMAIN_ROUTES, "scientific / technical", None, "General / Everyday")
_SQL_DOMAIN = "(CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {'NULL' if x is None else repr(x)}" for i, x in enumerate(_DOMAINS)) + " END)"


@_query(f"SELECT event_id, {_sql_route(safe='event_id % 7 <> 6 AND event_id % 11 = 0', missing='event_id % 13 = 0', domain=_SQL_DOMAIN)} FROM events")
def route_domains(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    route = routing.domain_route(_pick(i, *_DOMAINS), i % 11 != 0, i % 13 != 0, i % 7 != 6)
    return read_table(spark, d, "events", "event_id").select("event_id", route.alias("r")).select("event_id", "r.*")


@_query(
    """SELECT run_id, coalesce(s, '') AS sentiment, array_to_string(k, '|') AS keywords, len(k) AS n_keywords,
    CASE WHEN s IS NULL THEN 'missing sentiment' WHEN k IS NULL THEN 'missing keywords' END AS error
    FROM (SELECT run_id, any_value(sentiment) AS s, any_value(keywords) AS k FROM ticket_run WHERE run_id IS NOT NULL GROUP BY run_id)"""
)
def merge_branches(spark: SparkSession, d: str) -> DataFrame:
    left = once(read_table(spark, d, "ticket_run", "run_id", "sentiment"), "run_id")
    right = once(read_table(spark, d, "ticket_run", "run_id", "keywords"), "run_id")
    both = routing.merge_branches(left, right, "run_id")
    size = F.when(F.col("keywords").isNotNull(), F.size("keywords").cast("long"))
    return both.select("run_id", F.coalesce("sentiment", F.lit("")).alias("sentiment"), F.array_join("keywords", "|").alias("keywords"), size.alias("n_keywords"), "error")


#: is_safe as JSON, and whether it lets a question through; absent does, null doesn't, and a string does if it isn't empty.
_SAFE = (("true", True), ("false", False), ('"true"', True), ('"false"', True), ("1", True), ("0", False), ('""', False), ("null", False), ("[]", False), ("{\"a\":0}", True))
_SQL_SAFE = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN {str(not x).lower()}" for i, (_, x) in enumerate(_SAFE)) + " ELSE false END"


@_query(f"SELECT event_id, {_sql_route(safe=_SQL_SAFE, missing='event_id % 5 = 0', domain=_SQL_DOMAIN)} FROM events")
def route_json(spark: SparkSession, d: str) -> DataFrame:
    """Domains routed from JSON replies, with is_safe of every JSON type."""
    i = F.col("event_id")
    safe = _pick(i % 11, *[f'"is_safe":{x}' for x, _ in _SAFE], None)
    domain = F.when(i % 5 != 0, F.concat(F.lit('"domain":'), F.coalesce(F.concat(F.lit('"'), _pick(i, *_DOMAINS), F.lit('"')), F.lit("null"))))
    reply = F.concat(F.lit("```json\n{"), F.concat_ws(",", F.lit('"confidence":0.5'), safe, domain), F.lit("}\n```"))
    json = jsonx.strict_json(jsonx.clean_llm_json(reply))
    return read_table(spark, d, "events", "event_id").select("event_id", json.alias("json")).select("event_id", routing.domain_route_of(F.col("json")).alias("r")).select("event_id", "r.*")


# JSON -----------------------------------------------------------------------------------------------------------------

_WRAPPED = (("", ""), ("```json\n", "\n```"), ("Here: ", "\n```json\n[1]\n```"), ("``` none ```", None), ('  {"fmt":"json","v":', "} "))


def _sql_text(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


_SQL_WRAP = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {_sql_text(a)}" + ("" if z is None else f" || props || {_sql_text(z)}") for i, (a, z) in enumerate(_WRAPPED)) + " END"
_SQL_CLEAN = """trim(regexp_replace(CASE WHEN contains(b, '```') THEN coalesce(list_filter(string_split(b, '```'), lambda p: contains(p, '{'))[1], b) ELSE b END, 'json', ''), ' ' || chr(9) || chr(10) || chr(13))"""


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    forms = [F.lit(a) if z is None else F.concat(F.lit(a), F.col("props"), F.lit(z)) for a, z in _WRAPPED]
    return read_table(spark, d, "events", "event_id", "props").select("event_id", _pick(F.col("event_id"), *forms).alias("reply"))


@_query(f"SELECT event_id, {_SQL_CLEAN} AS cleaned FROM (SELECT event_id, trim({_SQL_WRAP}, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM events)")
def clean_llm_json(spark: SparkSession, d: str) -> DataFrame:
    return _wrapped(spark, d).select("event_id", jsonx.clean_llm_json(F.col("reply")).alias("cleaned"))


_REPLIES = ('{"category":"billing","urgency":"low"}', '{"category":"billing"', "{'category':'billing'}", '{"category":"general"} thanks', '{"urgency":"high"}', "[1]", "")
_SQL_REPLY = "(CASE event_id % 7 " + " ".join("WHEN {} THEN '{}'".format(i, x.replace("'", "''")) for i, x in enumerate(_REPLIES)) + " END)"


@_query(
    f"""SELECT event_id, CASE WHEN ok THEN j ->> '$.category' ELSE 'unsure' END AS category, CASE WHEN ok THEN j ->> '$.urgency' END AS urgency
    FROM (SELECT event_id, r AS j, json_valid(r) AND starts_with(r, '{{') AS ok FROM (SELECT event_id, {_SQL_REPLY} AS r FROM events))"""
)
def parse_or_unsure(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events", "event_id").withColumn("c", jsonx.parse_or_unsure(_pick(F.col("event_id"), *_REPLIES)))
    return events.select("event_id", "c.category", "c.urgency")


@_query(
    """SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN (props ->> '$.k')::BIGINT END AS k, event_id % 4 NOT IN (0, 3) AS failed FROM events"""
)
def null_on_error(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    text = _pick(F.col("event_id"), p, F.substring(p, 1, 4), F.concat(p, F.lit(" trailing")), F.concat(F.lit("  "), p))
    parsed = jsonx.safe_parse(text, "struct<k:bigint>")
    return read_table(spark, d, "events", "event_id", "props").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.col("p").isNull().alias("failed"))


_VALUES = ("{}", "[]", "0", "false", "null", '""', '{"a":1}', "[0]", "0.0", "-1", '"x"')
_SQL_VALUE = "(CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_VALUES)) + " END)"
_SQL_TRUTHY = f"{_SQL_VALUE} NOT IN ('{{}}', '[]', '0', 'false', 'null', '\"\"', '0.0')"


@_query(f"SELECT event_id, CASE WHEN ok THEN v END AS value, CASE WHEN NOT ok THEN 'Invalid JSON response' END AS error, CASE WHEN ok THEN v ELSE 'raw' END AS shown FROM (SELECT event_id, {_SQL_VALUE} AS v, {_SQL_TRUTHY} AS ok FROM events)")
def truthy_validate(spark: SparkSession, d: str) -> DataFrame:
    v = _pick(F.col("event_id"), *_VALUES)
    events = read_table(spark, d, "events", "event_id")
    return events.select("event_id", jsonx.truthy_or_error(v).alias("t"), jsonx.parsed_or_raw(v, F.lit("raw")).alias("shown")).select("event_id", "t.*", "shown")


# Prompts --------------------------------------------------------------------------------------------------------------


@_query(
    """SELECT ticket_id, sha256('Classify it' || chr(10) || '\"\"\"' || chr(10) || t || ' + ' || coalesce(c, 'none') || chr(10) || '\"\"\"') AS prompt_hash, length(t) AS n
    FROM (SELECT ticket_id, any_value(text) AS t, any_value(channel) AS c FROM tickets WHERE ticket_id IS NOT NULL GROUP BY ticket_id)""".replace('\\"', '"')
)
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = once(read_table(spark, d, "tickets", "ticket_id", "text", "channel"), "ticket_id")
    prompt = render.wrapped_prompt(F.lit("Classify it"), F.col("text"), F.coalesce("channel", F.lit("none")))
    return rows.select("ticket_id", F.sha2(prompt, 256).alias("prompt_hash"), F.length("text").cast("long").alias("n"))


@_query(
    """SELECT query_id, 'Plan for ' || t || ' as {"tasks": []} and again ' || t || '.' AS prompt
    FROM (SELECT query_id, any_value(text) AS t FROM questions WHERE query_id IS NOT NULL GROUP BY query_id)"""
)
def render_template(spark: SparkSession, d: str) -> DataFrame:
    rows = once(read_table(spark, d, "questions", "query_id", "text"), "query_id")
    template = F.lit('Plan for {query} as {{"tasks": []}} and again {query}.')
    return rows.select("query_id", render.template_prompt(template, F.col("text")).alias("prompt"))


@_query(
    """SELECT query_id, CASE WHEN e IS NULL OR len(e) = 0 THEN '- Improve clarity.' ELSE array_to_string(list_transform(e, lambda x: '- ' || x), chr(10)) END AS bullets
    FROM (SELECT query_id, entities AS e FROM plans)"""
)
def instruction_bullets(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "plans", "query_id", "entities").select("query_id", render.instruction_bullets(F.col("entities")).alias("bullets"))


# Review ---------------------------------------------------------------------------------------------------------------

_APPROVALS = ('{"approved":true}', '{"approved":"TRUE"}', '{"approved":1}', '{"approved":null}', '{"feedback":"x"}', '{"approved":"false"}')


@_query("SELECT o_orderkey, o_orderkey % 6 IN (0, 1) AS approved FROM orders")
def approval_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders", "o_orderkey").select("o_orderkey", review.approved(_pick(F.col("o_orderkey"), *_APPROVALS)).alias("approved"))


#: The loop in closed form, from up to three verdicts: t approves, f doesn't, n can't be read, - was not made.
_SQL_LOOP = """
  SELECT {key}, CASE WHEN a = '-' THEN 0 WHEN a = 'n' OR b = '-' THEN 1 WHEN b IN ('n', 't') OR c = '-' THEN 2 ELSE 3 END AS reviews,
    CASE WHEN a IN ('-', 'n') THEN 0 ELSE (a = 'f')::INT + CASE WHEN b = 'f' THEN 1 + (c = 'f')::INT ELSE 0 END END AS improves,
    a IN ('t', 'f') AND (b = 't' OR (b = 'f' AND c = 't')) AS approved
  FROM ({source})"""


@_query(_SQL_LOOP.format(key="o_orderkey", source="SELECT o_orderkey, " + ", ".join(f"CASE WHEN (o_orderkey // {2**i}) % 2 = 1 THEN 't' WHEN o_orderkey % {p} = 0 THEN 'n' ELSE 'f' END AS {c}" for i, (c, p) in enumerate(zip("abc", (11, 13, 17)))) + " FROM orders"))
def review_loop(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    verdicts = F.array(*[F.when(F.floor(key / 2**i) % 2 == 1, "True").when(key % p == 0, F.lit(None)).otherwise("false") for i, p in enumerate((11, 13, 17))])
    return read_table(spark, d, "orders", "o_orderkey").select("o_orderkey", review.review_outcome(verdicts).alias("o")).select("o_orderkey", "o.reviews", "o.improves", "o.approved")


_SQL_V = "CASE WHEN v IS NULL OR len(v) < {i} THEN '-' WHEN v[{i}] IS NULL THEN 'n' WHEN lower(v[{i}]) = 'true' THEN 't' ELSE 'f' END AS {c}"


@_query(_SQL_LOOP.format(key="run_id", source="SELECT run_id, " + ", ".join(_SQL_V.format(i=i, c=c) for i, c in ((1, "a"), (2, "b"), (3, "c"))) + " FROM (SELECT run_id, any_value(verdicts) AS v FROM ticket_run WHERE run_id IS NOT NULL GROUP BY run_id)"))
def review_loop_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = once(read_table(spark, d, "ticket_run", "run_id", "verdicts"), "run_id")
    return runs.select("run_id", review.review_outcome(F.col("verdicts")).alias("o")).select("run_id", "o.reviews", "o.improves", "o.approved")


# Fan-out and fan-in ---------------------------------------------------------------------------------------------------


@_query(
    """SELECT query_id, CASE WHEN tasks IS NULL OR len(tasks) = 0 THEN NULL ELSE i - 1 END::INT AS pos, tasks[i].agent AS agent, tasks[i].query AS query
    FROM (SELECT query_id, tasks, unnest(CASE WHEN tasks IS NULL OR len(tasks) = 0 THEN [1] ELSE range(1, len(tasks) + 1) END) AS i FROM plans)"""
)
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return fanout.fan_out(read_table(spark, d, "plans", "query_id", "tasks"), "query_id")


def _results(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return once(read_table(spark, d, "task_results", "result_id", "query_id", "pos", "agent", "answer", "error", *more), "result_id")


_SQL_RESULTS = "(SELECT DISTINCT ON (result_id) * FROM task_results WHERE result_id IS NOT NULL)"


@_query(
    f"""SELECT query_id, count(r.query_id) OVER (PARTITION BY query_id) AS n_results, CASE WHEN r.query_id IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY pos, agent, answer) - 1 END AS i, agent, answer
    FROM (SELECT DISTINCT query_id FROM plans WHERE query_id IS NOT NULL) LEFT JOIN (SELECT * FROM {_SQL_RESULTS} WHERE error IS NULL AND answer IS NOT NULL) r USING (query_id)"""
)
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d).withColumnRenamed("answer", "result")
    out = fanout.fan_in(results, read_table(spark, d, "plans", "query_id").dropna(), "query_id")
    n = F.coalesce(F.expr("json_array_length(results)"), F.lit(0)).cast("long").alias("n_results")
    read = F.posexplode_outer(F.from_json("results", "array<struct<agent:string,result:string>>"))
    return out.select("query_id", n, read).select("query_id", "n_results", F.col("pos").cast("long").alias("i"), "col.agent", F.col("col.result").alias("answer"))


@_query("SELECT query_id, i - 1 AS i, entities[i] AS question FROM (SELECT query_id, entities, unnest(range(1, len(entities) + 1)) AS i FROM plans WHERE entities IS NOT NULL)")
def sub_questions(spark: SparkSession, d: str) -> DataFrame:
    """Sub-questions read from a decomposition's reply, here the recorded entities as a JSON array."""
    plans = read_table(spark, d, "plans", "query_id", "entities").withColumn("reply", F.to_json("entities"))
    each = plans.select("query_id", F.posexplode(fanout.sub_questions(F.col("reply"))).alias("i", "question"))
    return each.select("query_id", F.col("i").cast("long").alias("i"), "question")


@_query(
    """SELECT query_id, i - 1 AS i, tasks[i].agent AS agent, tasks[i].query AS query, 'figures for ' || tasks[i].agent AS expected_output
    FROM (SELECT query_id, tasks, unnest(range(1, len(tasks) + 1)) AS i FROM plans WHERE tasks IS NOT NULL AND query_id % 5 <> 0)"""
)
def expand_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with what each is to give, read from an expansion's reply, here the recorded tasks; a fifth can't be read."""
    plans = read_table(spark, d, "plans", "query_id", "tasks").filter("tasks IS NOT NULL")
    full = F.transform("tasks", lambda t: F.struct(t["agent"].alias("agent"), t["query"].alias("query"), F.concat(F.lit("figures for "), t["agent"]).alias("expected_output")))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(full.alias("tasks"))), F.when(F.col("query_id") % 5 == 0, "} and so on").otherwise("\n```"))
    each = plans.select("query_id", F.posexplode(fanout.expanded_tasks(reply)).alias("i", "task"))
    return each.select("query_id", F.col("i").cast("long").alias("i"), "task.*")


@_query(
    f"""SELECT query_id, CASE WHEN t IS NULL OR len(t) = 0 THEN 'decomposition_provider_error' WHEN query_id % 4 = 1 OR len(t) <> 2 THEN 'invalid_judge_output' WHEN a IS NULL THEN 'fan_in_failed' END AS error
    FROM (SELECT query_id, tasks AS t FROM plans) LEFT JOIN (SELECT query_id, any_value(answer) AS a FROM answers WHERE query_id IS NOT NULL GROUP BY query_id) USING (query_id)"""
)
def run_errors(spark: SparkSession, d: str) -> DataFrame:
    """What ended each recorded run; the judge's reply scores two answers, or is none for a quarter of the runs."""
    plans = read_table(spark, d, "plans", "query_id", "tasks")
    answers = read_table(spark, d, "answers", "query_id", "answer").dropna(subset=["query_id"]).groupBy("query_id").agg(F.any_value("answer", True).alias("answer"))
    reply = F.when(F.col("query_id") % 4 == 1, "no idea").otherwise('```json\n{"best_indices":[1,0],"scores":[3.5,8],"reasoning":"r"}\n```')
    judged = fanout.judged(F.col("tasks"), reply)["error"]
    rows = plans.join(answers, "query_id", "left")
    return rows.select("query_id", fanout.run_error(F.coalesce(F.size("tasks") > 0, F.lit(False)), judged, F.col("answer").isNotNull()).alias("error"))


_tried: Counter = Counter()


def _unsteady(stage: str, prompt: str) -> str:
    """Answers at once, or at the third try, or never, by the prompt's number."""
    n = int(prompt.split()[-1])
    _tried[prompt] += 1
    if n % 3 == 1 or (n % 3 == 2 and _tried[prompt] < 3):
        raise RuntimeError(f"no reply to {n}")
    return f"reply to {n}"


@_query(
    """SELECT query_id, CASE WHEN query_id % 7 % 3 <> 1 THEN 'reply to ' || (query_id % 7) END AS reply, CASE WHEN query_id % 7 % 3 = 1 THEN 'LLM call failed: no reply to ' || (query_id % 7) END AS call_error
    FROM (SELECT DISTINCT query_id FROM questions WHERE query_id IS NOT NULL)"""
)
def call_errors(spark: SparkSession, d: str) -> DataFrame:
    """Calls of which a part fails for good, and a part twice before it succeeds; each failure stays in its rows."""
    rows = read_table(spark, d, "questions", "query_id").dropna().distinct()
    asked = rows.withColumn("prompt", F.concat(F.lit("question "), (F.col("query_id") % 7).cast("string")))
    return call(asked, "prompt", RuleBackend(_unsteady), "unsteady").select("query_id", "reply", "call_error")


_SCORE = "(result_id * 31 + {c} * 17) % 10 + 1"


@_query(
    f"""SELECT result_id, cand, score FROM (SELECT result_id, cand, ({_SCORE.format(c='cand')})::DOUBLE AS score, row_number() OVER (PARTITION BY result_id ORDER BY {_SCORE.format(c='cand')} DESC, cand) AS rn
    FROM (SELECT DISTINCT result_id FROM task_results WHERE result_id IS NOT NULL), (SELECT unnest([1, 2, 3]) AS cand)) WHERE rn = 1"""
)
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    tasks = read_table(spark, d, "task_results", "result_id").dropna().distinct()
    scored = fanout.candidates(tasks, 3).withColumn("score", ((F.col("result_id") * 31 + F.col("cand") * 17) % 10 + 1).cast("double"))
    return fanout.best_of_n(scored, "result_id").select("result_id", "cand", "score")


@_query(
    """SELECT query_id, CASE WHEN ok THEN entities[i + 1] END AS winner, CASE WHEN ok THEN i + 0.5::DOUBLE END AS top_score, CASE WHEN NOT ok THEN 'invalid_judge_output' END AS error
    FROM (SELECT query_id, entities, (query_id % 3)::INT AS i, coalesce(len(entities), -1) = 2 AND query_id % 3 < 2 AS ok FROM plans)"""
)
def judge_align(spark: SparkSession, d: str) -> DataFrame:
    i = (F.col("query_id") % 3).cast("int")
    scores = F.array(i + F.lit(0.5), F.lit(0.0))
    aligned = fanout.judge_alignment(F.col("entities"), F.array(i), scores)
    out = read_table(spark, d, "plans", "query_id", "entities").select("query_id", i.alias("i"), aligned.alias("j"))
    return out.select("query_id", "j.winner", F.when(F.col("j.error").isNull(), F.col("i") + F.lit(0.5)).alias("top_score"), "j.error")


# Reflexion ------------------------------------------------------------------------------------------------------------

_SQL_STATS = f"""SELECT query_id, sum(coalesce(confidence, 0)::DECIMAL(28, 12))::DOUBLE / count(*) AS a, count(*) AS n, bool_or(coalesce(confidence, 0) < 0.5) AS low FROM {_SQL_RESULTS} GROUP BY query_id"""
_SQL_KEYS = "(SELECT DISTINCT query_id FROM questions WHERE query_id IS NOT NULL)"


def _previous(spark: SparkSession, d: str) -> DataFrame:
    keys = read_table(spark, d, "questions", "query_id").dropna()
    return reflexion.previous_summary(_results(spark, d, "confidence"), keys, "query_id")


@_query(
    f"""SELECT query_id, CASE WHEN n IS NULL THEN '{reflexion.NO_CONFIDENCE}' ELSE printf('avg=%.2f, count=%d', a, n) END AS confidence_summary
    FROM {_SQL_KEYS} LEFT JOIN ({_SQL_STATS}) USING (query_id)"""
)
def confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return _previous(spark, d).select("query_id", "confidence_summary")


_SQL_WEAK = f"CASE WHEN n IS NULL THEN '{reflexion.NO_OUTPUTS}' WHEN low THEN '{reflexion.LOW}' ELSE '{reflexion.MINOR}' END"
_SQL_IMPROVE = f"CASE WHEN n IS NULL THEN '{reflexion.IMPROVE_FIRST}' ELSE '{reflexion.IMPROVE_MORE}' END"


@_query(f"SELECT query_id, {_SQL_WEAK} AS weaknesses, {_SQL_IMPROVE} AS improvements FROM {_SQL_KEYS} LEFT JOIN ({_SQL_STATS}) USING (query_id)")
def weaknesses(spark: SparkSession, d: str) -> DataFrame:
    return _previous(spark, d).select("query_id", "weaknesses", "improvements")


@_query(
    f"""SELECT query_id, '{reflexion.HEADER.strip()}' || chr(10) || 'Improvement guidance:' || chr(10) || '- Prior confidence trend: ' ||
      CASE WHEN n IS NULL THEN '{reflexion.NO_CONFIDENCE}' ELSE printf('avg=%.2f, count=%d', a, n) END || chr(10) || '- Main weaknesses observed: ' || {_SQL_WEAK} || chr(10) ||
      '- Improve by: ' || {_SQL_IMPROVE} || chr(10) || chr(10) || 'Task:' || chr(10) || 'Answer it.' AS prompt
    FROM {_SQL_KEYS} LEFT JOIN ({_SQL_STATS}) USING (query_id)"""
)
def reflection_block(spark: SparkSession, d: str) -> DataFrame:
    block = reflexion.reflection_block(F.col("confidence_summary"), F.col("weaknesses"), F.col("improvements"))
    return _previous(spark, d).select("query_id", reflexion.inject_reflection(block, F.lit("Answer it.")).alias("prompt"))


_SQL_FIVE = ("l_quantity / 5", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 100 END", "l_tax * 100", "l_linenumber::DOUBLE", "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 7.5::DOUBLE END")


def _scores() -> Column:
    five = (F.col("l_quantity") / 5, F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 100), F.col("l_tax") * 100, F.col("l_linenumber").cast("double"), F.when(F.col("l_returnflag") != "R", F.lit(7.5)))
    return F.struct(*[x.alias(r) for r, x in zip(reflexion.RUBRIC, five)])


@_query(f"SELECT l_orderkey, l_linenumber, l_partkey, ({' + '.join(f'coalesce({x}, 0)' for x in _SQL_FIVE)}) / 5 AS aggregate FROM lineitem")
def rubric_score(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", reflexion.rubric_score(_scores()).alias("aggregate"))


@_query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 10)::DOUBLE ELSE 0 END AS factual, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'Critic parse failure.' END AS summary,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_advice FROM events"""
)
def critic_fallback(spark: SparkSession, d: str) -> DataFrame:
    good = F.concat(F.lit('```json\n{"scores":{"factual_grounding":'), (F.col("event_id") % 10).cast("string"), F.lit('},"revision_instructions":[],"summary":"ok"}\n```'))
    critic = reflexion.critic_or_default(_pick(F.col("event_id"), good, "no idea", "[1, 2]"))
    events = read_table(spark, d, "events", "event_id").select("event_id", critic.alias("c"))
    return events.select("event_id", F.col("c.scores.factual_grounding").try_cast("double").alias("factual"), "c.summary", F.size("c.revision_instructions").alias("n_advice"))


_SHOWN = ("factual", "complete", "consistency", "tone", "unsupported_ctrl")
_SQL_SHOWN = " || ', ' || ".join(f"'{n}=' || coalesce(regexp_replace(({x})::VARCHAR, '\\.0$', ''), '0')" for n, x in zip(_SHOWN, _SQL_FIVE)).replace("\\\\", "\\")


@_query(f"SELECT l_orderkey, l_linenumber, l_partkey, '[REFLEXION] Iteration ' || l_linenumber || ' scores: ' || {_SQL_SHOWN} || printf(', aggregate=%.2f', ({' + '.join(f'coalesce({x}, 0)' for x in _SQL_FIVE)}) / 5) AS line FROM lineitem")
def score_line(spark: SparkSession, d: str) -> DataFrame:
    line = reflexion.score_line(F.col("l_linenumber"), _scores())
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))


_RATED = (("8", 8.0), ('"8"', 8.0), ('" 7.5 "', 7.5), ("null", 0.0), (None, 0.0), ('"good"', None))
_SQL_RATED = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {'NULL' if x is None else x}" for i, (_, x) in enumerate(_RATED)) + " END"


@_query(f"SELECT event_id, ({_SQL_RATED} + event_id % 10)::DOUBLE / 5 AS aggregate, CASE WHEN event_id % 6 = 5 THEN 'score completeness is not a number' END AS error FROM events")
def rubric_json(spark: SparkSession, d: str) -> DataFrame:
    """Scores read from JSON as numbers, text of numbers, null, absent, or as no number, which is an error of its row."""
    own = _pick(F.col("event_id"), *[None if x is None else f'"completeness":{x}' for x, _ in _RATED])
    reply = F.concat(F.lit('{"scores":{'), F.concat_ws(",", F.concat(F.lit('"domain_tone":'), (F.col("event_id") % 10).cast("string")), own), F.lit("}}"))
    scores = read_table(spark, d, "events", "event_id").select("event_id", reflexion.critic_or_default(reply)["scores"].alias("s"))
    error = reflexion.score_error(F.col("s"))
    return scores.select("event_id", F.when(error.isNull(), reflexion.rubric_score(F.col("s"))).alias("aggregate"), error.alias("error"))


_SQL_FOLD = """
  SELECT o_orderkey, CASE WHEN a >= 8 THEN [a] WHEN b >= 8 OR b <= a + 1e-6 THEN [a, b] ELSE [a, b, c] END AS history,
    CASE WHEN a >= 8 THEN 'threshold' WHEN b >= 8 THEN 'threshold' WHEN b <= a + 1e-6 THEN 'plateau' WHEN c >= 8 THEN 'threshold' WHEN c <= b + 1e-6 THEN 'plateau' ELSE 'max' END AS reason,
    CASE WHEN a >= 8 THEN 0 WHEN b >= 8 OR b <= a + 1e-6 THEN 1 WHEN c >= 8 OR c <= b + 1e-6 THEN 2 ELSE 3 END AS rewrites
  FROM (SELECT o_orderkey, (o_orderkey % 10)::DOUBLE AS a, (o_orderkey // 10 % 10)::DOUBLE AS b, (o_orderkey // 7 % 10)::DOUBLE AS c FROM orders)"""


@_query(_SQL_FOLD)
def reflexion_stop(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    scores = F.array(*[x.cast("double") for x in (k % 10, F.floor(k / 10) % 10, F.floor(k / 7) % 10)])
    return read_table(spark, d, "orders", "o_orderkey").select("o_orderkey", reflexion.reflexion_outcome(scores).alias("r")).select("o_orderkey", "r.*")


def _editor(stage: str, prompt: str) -> str:
    """Scores 9 where a draft is revised, else 5; and revises."""
    draft = prompt.split("\nDraft:\n", 1)[1]
    if stage == "producer":
        return draft.rsplit("\nAdvice:\n", 1)[0] + " revised"
    n = 9 if "revised" in draft else 5
    return '{"scores":{' + ",".join(f'"{r}":{n}' for r in reflexion.RUBRIC) + '},"revision_instructions":["Revise."]}'


_SQL_WORKED = "a IS NOT NULL AND regexp_matches(a, '[^\\s\\p{Z}\\x{0B}\\x{1C}-\\x{1F}\\x{85}]')"


@_query(
    f"""SELECT answer_id, CASE WHEN w AND NOT contains(a, 'revised') THEN a || ' revised' ELSE a END AS answer, CASE WHEN NOT w THEN NULL WHEN contains(a, 'revised') THEN '9.0' ELSE '5.0,9.0' END AS scores, CASE WHEN w THEN 'threshold' END AS reason
    FROM (SELECT answer_id, a, {_SQL_WORKED} AS w FROM (SELECT answer_id, any_value(answer) AS a FROM answers WHERE answer_id IS NOT NULL GROUP BY answer_id))"""
)
def apply_reflexion(spark: SparkSession, d: str) -> DataFrame:
    """The loop over recorded answers, with a critic who is content once a draft is revised."""
    rows = once(read_table(spark, d, "answers", "answer_id", "answer"), "answer_id").withColumn("domain", F.lit("General"))
    done, _ = reflexion.reflexion_loop(rows, "answer_id", RuleBackend(_editor))
    scores = F.array_join(F.transform("reflection_scores", lambda x: x.cast("string")), ",")
    return done.select("answer_id", "answer", scores.alias("scores"), "reason")


@_query()
def draft_diff(spark: SparkSession, d: str) -> DataFrame:
    """Each ticket's raw text against its cleaned one."""
    tickets = once(read_table(spark, d, "tickets", "ticket_id", "text"), "ticket_id")
    runs = once(read_table(spark, d, "ticket_run", "run_id", "ticket_id", "ticket.cleaned_text"), "run_id")
    both = runs.join(tickets, "ticket_id")
    return both.select("run_id", reflexion.draft_diff("text", "cleaned_text", F.lit(1)).alias("diff"))


@_query()
def prompt_table(spark: SparkSession, d: str) -> DataFrame:
    return prompts.table(spark)


# Whole pipelines, over recorded replies ------------------------------------------------------------------------------

_SQL_RUNS = "(SELECT run_id, any_value(sentiment) AS s, any_value(keywords) AS k, any_value(classification.category) AS c, any_value(verdicts) AS v, any_value(solution) AS solution FROM ticket_run WHERE run_id IS NOT NULL GROUP BY run_id)"


@_query(
    f"""WITH runs AS {_SQL_RUNS}, loop AS ({_SQL_LOOP.format(key="run_id", source="SELECT run_id, " + ", ".join(_SQL_V.format(i=i, c=c) for i, c in ((1, "a"), (2, "b"), (3, "c"))) + " FROM runs")}),
    judged AS (SELECT *, CASE WHEN c IN ('technical', 'billing', 'general', 'escalation') THEN c ELSE 'unsure' END AS branch, CASE WHEN s IS NULL THEN 'missing sentiment' WHEN k IS NULL THEN 'missing keywords' END AS missing FROM runs JOIN loop USING (run_id)),
    worked AS (SELECT *, missing IS NULL AND branch <> 'unsure' AND solution IS NOT NULL AS w FROM judged)
    SELECT run_id, branch, CASE WHEN w THEN reviews END AS reviews, CASE WHEN w THEN improves END AS improves, CASE WHEN w THEN approved END AS approved, CASE WHEN w THEN array_to_string(solution.solution_steps, chr(10)) END AS steps,
      coalesce(missing, CASE WHEN branch <> 'unsure' AND solution IS NULL THEN '{review.FAILED}' END) AS error FROM worked"""
)
def ticket_replay(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.recorded_tickets(once(read_table(spark, d, "ticket_run", "run_id", "sentiment", "keywords", "classification", "verdicts", "solution"), "run_id"))


_SQL_REPLAY_ROUTE = _sql_route(safe="coalesce(reason <> 'Input safe', false) OR (known AND NOT coalesce(is_safe, false))", missing="known IS NULL", domain="domain")


@_query(
    f"""WITH q AS (SELECT query_id, {_sql_reason('text')} AS reason FROM (SELECT query_id, any_value(text) AS text FROM questions WHERE query_id IS NOT NULL GROUP BY query_id)),
    r AS (SELECT query_id, any_value(domain) AS domain, any_value(is_safe) AS is_safe, true AS known FROM routing WHERE query_id IS NOT NULL GROUP BY query_id),
    p AS (SELECT query_id, len(tasks) AS tasks FROM plans WHERE len(tasks) > 0), t AS (SELECT query_id, count(*) FILTER (error IS NULL) AS answered FROM {_SQL_RESULTS} GROUP BY query_id),
    a AS (SELECT query_id, max(answer) AS answer FROM answers WHERE query_id IS NOT NULL GROUP BY query_id),
    e AS (SELECT query_id, {_SQL_REPLAY_ROUTE} FROM q LEFT JOIN r USING (query_id))
    SELECT query_id, route, route_reason, CASE WHEN route <> 'Fallback' THEN coalesce(tasks, 0) END AS tasks, CASE WHEN route <> 'Fallback' THEN coalesce(answered, 0) END AS answered, CASE WHEN route <> 'Fallback' THEN answer END AS answer,
      CASE WHEN route <> 'Fallback' AND tasks IS NULL THEN 'decomposition_provider_error' WHEN route <> 'Fallback' AND answer IS NULL THEN 'fan_in_failed' END AS error
    FROM e LEFT JOIN p USING (query_id) LEFT JOIN t USING (query_id) LEFT JOIN a USING (query_id)"""
)
def research_replay(spark: SparkSession, d: str) -> DataFrame:
    answers = read_table(spark, d, "answers", "query_id", "answer").dropna(subset=["query_id"]).groupBy("query_id").agg(F.max("answer").alias("answer"))
    questions, routed = (once(read_table(spark, d, *x), "query_id") for x in (("questions", "query_id", "text"), ("routing", "query_id", "domain", "is_safe")))
    return pipeline.recorded_research(questions, routed, read_table(spark, d, "plans", "query_id", "tasks"), _results(spark, d), answers)


# Whole pipelines, with rules in place of a model ----------------------------------------------------------------------


@_query()
def ticket_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = once(read_table(spark, d, "tickets", "ticket_id", "text"), "ticket_id")
    return pipeline.tickets(rows, dry_run.backend()).select("ticket_id", "branch", "sentiment", "reply", "reviews", "improves", "approved", "error")


@_query()
def research_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = once(read_table(spark, d, "questions", "query_id", "text"), "query_id")
    return pipeline.research(rows, dry_run.backend(), n=3)


@_query()
def research_audit(spark: SparkSession, d: str) -> DataFrame:
    """What each stage did, of every question."""
    rows = once(read_table(spark, d, "questions", "query_id", "text"), "query_id")
    return pipeline.research_runs(rows, dry_run.backend())[1]
