"""Which branch a classified ticket or question takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.guardrail import rejected_classification, verdict
from promptloom.functions.jsonx import is_truthy

#: Ticket branches, and the domains with their routes and reasons.
TICKET_BRANCHES = ("technical", "billing", "general", "escalation")
DOMAIN_ROUTES = {
    "Scientific / Technical": ("Scientific", "Using peer-reviewed framing and numerical analysis."),
    "Historical / Cultural": ("Historical", "Focusing on timelines and source verification."),
    "Financial / Business": ("Financial", "Prioritizing market data and risk disclaimers."),
    "General / Everyday": ("General", "Applying a balanced and accessible tone."),
}
UNSAFE = ("Fallback", "Classification flagged as unsafe. Routing to fallback.")
MISSING = ("Fallback", "Missing domain classification")
AMBIGUOUS = ("Fallback", "The question is ambiguous or out-of-scope. Requesting clarification.")


def ticket_branch(category: Column) -> Column:
    """The category itself if it is one of the four, letter by letter; else "unsure"."""
    return F.when(category.isin(*TICKET_BRANCHES), category).otherwise(F.lit("unsure"))


def _route(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("route"), F.lit(pair[1]).alias("route_reason"))


def domain_route(domain: Column, is_safe: Column, has_domain: Column | None = None, has_safe: Column | None = None) -> Column:
    """struct(route, route_reason).

    ``has_domain`` and ``has_safe`` say whether the classification has the key at all: an absent ``is_safe`` is safe
    while a null one is not, and an absent domain is missing while a null one is ambiguous. By default a key is there.
    """
    has_domain = F.lit(True) if has_domain is None else has_domain
    has_safe = F.lit(True) if has_safe is None else has_safe
    out = F.when(has_safe & ~F.coalesce(is_safe, F.lit(False)), _route(UNSAFE)).when(~has_domain, _route(MISSING))
    for name, pair in DOMAIN_ROUTES.items():
        out = out.when(domain == name, _route(pair))
    return out.otherwise(_route(AMBIGUOUS))


def domain_route_of(classification: Column) -> Column:
    """struct(route, route_reason) of a classification as canonical JSON text of an object.

    ``is_safe`` is judged by its truth, whatever its JSON type: the string "false" is safe, 0, "" and null are not.
    """
    parsed = F.try_parse_json(classification)
    raw = F.to_json(F.try_variant_get(parsed, "$.is_safe", "variant"))
    present = F.try_variant_get(parsed, "$.domain", "variant").isNotNull()
    return domain_route(F.get_json_object(classification, "$.domain"), is_truthy(raw), present, raw.isNotNull())


def split_by_guardrail(inputs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(inputs that a model may see, the others with the classification they get without one).

    A filter below the call, not a condition around it: a Python stage would see guarded rows as well.
    """
    judged = inputs.withColumn("_verdict", verdict(F.col(text)))
    allowed = judged.filter("_verdict.allowed").drop("_verdict")
    rejected = judged.filter("NOT _verdict.allowed").withColumn("classification", rejected_classification(F.col("_verdict.reason")))
    return allowed, rejected.drop("_verdict")


def merge_branches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two branches' results of one input side by side; an input that lacks one is an error of its row."""
    both = left.join(right, key, "full")
    missing = F.when(F.col("sentiment").isNull(), F.lit("missing sentiment")).when(F.col("keywords").isNull(), F.lit("missing keywords"))
    return both.withColumn("error", missing)
