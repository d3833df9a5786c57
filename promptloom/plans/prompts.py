"""Our own prompt texts, one for each stage and branch or domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_JSON = "Reply with one JSON object and nothing else."
CLEAN = f"Rewrite the support ticket between the quotes in plain, correct wording without abbreviations. {_JSON} Its field is cleaned_text."
SENTIMENT = f"Say whether the customer's message between the quotes is positive, negative or neutral. {_JSON} Its field is sentiment."
KEYWORDS = f"List the words that matter for the issue in the message between the quotes. {_JSON} Its field keywords is an array of strings."
CLASSIFY = f"Between the quotes are a ticket, and its sentiment and keywords. Classify it as technical, billing, general, escalation (urgent, needs a person) or unsure. {_JSON} Its fields are category, product, issue_type, urgency (low, medium or high) and description."
CLARIFY = f"The ticket between the quotes is unclear. Ask for what is missing. {_JSON} Its fields are category (unsure), message and clarification_questions."
SOLVE = {b: f"Suggest how to solve the {b} issue between the quotes. {_JSON} It repeats the issue's fields and adds solution_steps, an array of strings." for b in ("technical", "billing", "general", "escalation")}
REVIEW = f"Between the quotes are a ticket and a suggested solution. Judge whether the solution fits. {_JSON} Its fields are approved, and feedback where it does not."
IMPROVE = f"Improve the solution by the feedback, and say how in a new field improvement_notes. {_JSON}"
ROUTE = f"Choose the domain of the question: Scientific / Technical, Historical / Cultural, Financial / Business, General / Everyday or Fallback. {_JSON} Its fields are domain, is_safe, reasoning and confidence."
DECOMPOSE = {d: f"Split this {d} question into two to four tasks for agents. Question: {{query}}. Reply as {{{{\"intent\": ..., \"tasks\": [{{{{\"agent\": ..., \"query\": ...}}}}]}}}}." for d in ("Scientific", "Historical", "Financial", "General")}
FAN_IN = {d: f"Combine these results of agents into one {d} answer: {{query}}. Reply as {{{{\"answer\": ..., \"confidence\": ..., \"reasoning\": ...}}}}." for d in ("Scientific", "Historical", "Financial", "General")}

EXPAND = "Turn this plan into tasks that can each be answered by one call and together cover the question. " + _JSON + " Its field tasks is an array of objects with agent (risk, market_data, sentiment, valuation or macro), query and expected_output. Plan: {query}"
SUB_QUESTIONS = "Break the question into two to four simpler ones. Reply with a JSON array of strings and nothing else. Question: {query}"
JUDGE = f"Score each of the answers between the quotes from 1 to 10, by how well it answers its task. {_JSON} Its fields are best_indices (from 0, best first), scores (one for each answer) and reasoning."
SCORE = "Give the answer between the quotes a score from 1 to 10 by how well it does its task. Reply with the number only."
CRITIC = f"You review drafts of the field named below. Score from 0 to 10 how well statements are grounded in facts (factual_grounding), whether anything asked for is missing (completeness), whether parts contradict each other (internal_consistency), whether the tone suits the field (domain_tone), and how claims without support are kept out (unsupported_claims_control). {_JSON} Its fields are scores (an object of these five), revision_instructions, unsupported_claims and summary."
PRODUCER = "Rewrite the draft below as the advice says. Keep what the advice does not touch, add no claim that the draft has no ground for, and reply with the new draft alone."


def table(spark: SparkSession) -> DataFrame:
    """stage, branch, template: some twenty rows, so small enough to be sent to all workers."""
    rows = [("clean", None, CLEAN), ("sentiment", None, SENTIMENT), ("keywords", None, KEYWORDS), ("classify", None, CLASSIFY), ("clarify", None, CLARIFY), ("review", None, REVIEW), ("improve", None, IMPROVE), ("route", None, ROUTE), ("expand", "Financial", EXPAND), ("sub_questions", None, SUB_QUESTIONS), ("judge", None, JUDGE), ("score", None, SCORE), ("critic", None, CRITIC), ("producer", None, PRODUCER)]
    for stage, own in (("solve", SOLVE), ("decompose", DECOMPOSE), ("fan_in", FAN_IN)):
        rows += [(stage, branch, text) for branch, text in own.items()]
    return spark.createDataFrame(rows, "stage string, branch string, template string")
