import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.functions import guardrail, jsonx, render
from promptloom.operators import fanout, reflexion, review, routing


def column(spark, values, expr, kind="string"):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


REASONS = [
    ("ACT AS root", guardrail.INJECTION_REASON), ("contact as soon as possible", guardrail.INJECTION_REASON), ("call 5551234567", guardrail.PII_REASON),
    ("id 1234567890123456", guardrail.SAFE_REASON), ("é1234567890", guardrail.SAFE_REASON), ("٠١٢٣٤٥٦٧٨٩", guardrail.PII_REASON), ("é@x.com", guardrail.PII_REASON),
    ("task-management", guardrail.CREDENTIAL_REASON), ("", guardrail.SAFE_REASON), (None, guardrail.NULL_REASON), ("act as a@b.cd", guardrail.INJECTION_REASON),
]


def plain_reason(text):
    if text is None:
        return guardrail.NULL_REASON
    if any(p in text.lower() for p in guardrail.INJECTION_PHRASES):
        return guardrail.INJECTION_REASON
    if re.search(guardrail.EMAIL, text) or re.search(guardrail.PHONE, text):
        return guardrail.PII_REASON
    return guardrail.CREDENTIAL_REASON if re.search(guardrail.CREDENTIAL, text) else guardrail.SAFE_REASON


def test_guardrail_golden_rows(spark):
    assert column(spark, [t for t, _ in REASONS], lambda x: guardrail.verdict(x)["reason"]) == [r for _, r in REASONS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aé@.-sk act1٣ ACT\n_", max_size=30), min_size=20, max_size=40))
def test_guardrail_equals_plain_rule(spark, texts):
    assert column(spark, texts, lambda x: guardrail.verdict(x)["reason"]) == [plain_reason(t) for t in texts]


CLEANED = [
    ('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('Here: {x} ```json\n{"a":1}```', "Here: {x}"), ("``` none ```", "``` none ```"),
    ('{"fmt":"json","b":"json"}', '{"fmt":"","b":"json"}'), ('```JSON\n{"a":1}\n```', 'JSON\n{"a":1}'), ('  {"a":1} ', '{"a":1}'), ("", ""), (None, None),
]


def test_json_cleaner_golden_rows(spark):
    assert column(spark, [a for a, _ in CLEANED], jsonx.clean_llm_json) == [b for _, b in CLEANED]


def plain_clean(text):
    text = text.strip()
    if "```" in text:
        text = next((p for p in text.split("```") if "{" in p), text)
    return text.replace("json", "", 1).strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="`{}json \n x", max_size=25), min_size=20, max_size=40))
def test_json_cleaner_equals_plain_rule(spark, texts):
    assert column(spark, texts, jsonx.clean_llm_json) == [plain_clean(t) for t in texts]


def test_strict_json_is_strict(spark):
    texts = ['{"a":1}', "{'a':1}", '{"a":1} x', "null", "[1]", "", None, '{"a":1,"a":2}', "NaN"]
    assert column(spark, texts, jsonx.strict_json) == ['{"a":1}', None, None, None, "[1]", None, None, '{"a":2}', "NaN"]


@pytest.mark.parametrize(("text", "truthy"), [(t, bool(json.loads(t))) for t in ["{}", "[]", "0", "0.0", "-0", "1", '""', '"x"', "false", "true", "null", '{"a":0}', "[0]", "{ }"]])
def test_truthiness(spark, text, truthy):
    assert column(spark, [text], jsonx.is_truthy) == [truthy]


def test_parse_or_unsure(spark):
    out = column(spark, ['{"category":"billing"}', '```{"category":"billing"}```', "[1]", None], lambda x: jsonx.parse_or_unsure(x)["category"])
    assert out == ["billing", "unsure", "unsure", "unsure"]


def test_render(spark):
    assert column(spark, ["a{query}b"], lambda x: render.template_prompt(F.lit('{query} {{"k": {query}}}{x}'), x)) == ['a{query}b {"k": a{query}b}{x}']
    assert column(spark, ["p"], lambda x: render.wrapped_prompt(F.lit("do"), x, x)) == ['do\n"""\np + p\n"""']
    assert column(spark, [["a", "b"], [], None], render.instruction_bullets, "array<string>") == ["- a\n- b", "- Improve clarity.", "- Improve clarity."]


def test_routers(spark):
    names = [*routing.DOMAIN_ROUTES, "general / everyday", None]
    assert column(spark, names, lambda x: routing.domain_route(x, F.lit(True))["route"]) == ["Scientific", "Historical", "Financial", "General", "Fallback", "Fallback"]
    unsafe = lambda **k: column(spark, ["General / Everyday"], lambda x: routing.domain_route(x, **k)["route_reason"])[0]
    assert unsafe(is_safe=F.lit(None).cast("boolean")) == routing.UNSAFE[1]
    assert unsafe(is_safe=F.lit(None).cast("boolean"), has_safe=F.lit(False)) == routing.DOMAIN_ROUTES["General / Everyday"][1]
    assert unsafe(is_safe=F.lit(True), has_domain=F.lit(False)) == routing.MISSING[1]
    assert column(spark, ["billing", "Billing", None], routing.ticket_branch) == ["billing", "unsure", "unsure"]


def test_approval(spark):
    texts = ['{"approved":true}', '{"approved":"True"}', '{"approved":"TRUE"}', '{"approved":1}', '{"approved":null}', "{}", None, "nonsense"]
    assert column(spark, texts, review.approved) == [True, True, True, False, False, False, False, False]


def plain_review(verdicts):
    reviews = improves = 0
    for attempt, v in enumerate((verdicts or [])[:3]):
        reviews += 1
        if v is None:
            return reviews, improves, False
        if v.lower() == "true":
            if attempt >= 1:
                return reviews, improves, True
            continue
        improves += 1
    return reviews, improves, False


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["true", "TRUE", "false", "yes", None]), max_size=5)), min_size=10, max_size=30))
def test_review_loop_equals_plain_rule(spark, cases):
    assert [(r.reviews, r.improves, r.approved) for r in column(spark, cases, review.review_outcome, "array<string>")] == [plain_review(c) for c in cases]


def plain_reflexion(scores, threshold=8.0, most=3):
    best, history, rewrites = -1.0, [], 0
    for x in (scores or [])[:most]:
        x = x or 0.0
        history.append(x)
        if x >= threshold:
            return history, "threshold", rewrites
        if x <= best + 1e-6:
            return history, "plateau", rewrites
        best = x
        rewrites += 1
    return history, "max", rewrites


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.sampled_from([0.0, 5.0, 6.0, 6.0000005, 7.0, 8.0, 9.0])), max_size=5)), min_size=10, max_size=30))
def test_reflexion_equals_plain_rule(spark, cases):
    assert [(r.history, r.reason, r.rewrites) for r in column(spark, cases, reflexion.reflexion_outcome, "array<double>")] == [plain_reflexion(c) for c in cases]


def test_two_places_rounds_like_python(spark):
    assert column(spark, [0.125, 2.675, None, 1.0], reflexion.two_places, "double") == ["0.12", "2.67", None, "1.00"]


def test_previous_summary_and_fan_in(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    results = spark.createDataFrame([(1, None), (2, 0.5), (2, 0.5)], "id int, confidence double")
    got = {r.id: tuple(r)[1:3] for r in reflexion.previous_summary(results, keys, "id").collect()}
    assert got == {1: ("avg=0.00, count=1", reflexion.LOW), 2: ("avg=0.50, count=2", reflexion.MINOR), 3: (reflexion.NO_CONFIDENCE, reflexion.NO_OUTPUTS)}
    rows = spark.createDataFrame([(1, 1, "b", "y", None), (1, 0, "a", "x", None), (1, 2, "c", None, "bad"), (2, 0, "a", None, "bad")], "id int, pos int, agent string, result string, error string")
    got = {r.id: r.results for r in fanout.fan_in(rows, keys, "id").collect()}
    assert got == {1: '[{"agent":"a","result":"x"},{"agent":"b","result":"y"}]', 2: "[]", 3: "[]"}


def test_best_of_n_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 2, 7.0, "b"), (1, 3, 7.0, "c"), (2, 1, None, "d")], "t int, cand int, score double, x string")
    assert {(r.t, r.cand, r.x) for r in fanout.best_of_n(rows, "t").collect()} == {(1, 2, "b"), (2, 1, "d")}


def test_diff_and_critic(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), (None, "x")], "a string, b string")
    out = [r[0] for r in df.select(reflexion.draft_diff("a", "b", F.lit(2))).collect()]
    assert out == ["--- iter_2_before\n+++ iter_2_after\n@@ -1,2 +1,2 @@\n a\n-b\n+c", None]
    scores = column(spark, ['{"scores":{"completeness":10}}', "no", None], lambda x: reflexion.rubric_score(reflexion.critic_or_default(x)["scores"]))
    assert scores == [2.0, 0.0, 0.0]
