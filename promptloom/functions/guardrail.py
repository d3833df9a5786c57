"""Predicates on user input that decide whether a model may see it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases, patterns and reasons of the guardrail, in the order in which they are tried.
INJECTION_PHRASES = (
    "ignore previous instructions",
    "disregard previous instructions",
    "system prompt",
    "you are now",
    "act as",
    "jailbreak",
    "override instructions",
)
EMAIL = r"\b[\w\.-]+@[\w\.-]+\.\w+\b"
PHONE = r"\b\d{10,15}\b"
CREDENTIAL = r"sk-[a-zA-Z0-9]{10,}"
INJECTION_REASON = "Prompt injection attempt detected"
PII_REASON = "PII detected in input"
CREDENTIAL_REASON = "Sensitive credential detected"
SAFE_REASON = "Input safe"
#: Our own: a null input can't be judged, so it isn't let through.
NULL_REASON = "No input"


def is_injection(text: Column) -> Column:
    """The text holds one of the phrases, in any case, also inside other words."""
    low = F.lower(text)
    found = F.lit(False)
    for phrase in INJECTION_PHRASES:
        found = found | low.contains(phrase)
    return found


def has_pii(text: Column) -> Column:
    """An email address or a run of 10 to 15 digits; letters and digits of all scripts count.

    The email pattern reads a text again and again where there is no at sign, so that is looked for first.
    """
    return (text.contains("@") & text.rlike(f"(?U){EMAIL}")) | text.rlike(f"(?U){PHONE}")


def has_credential(text: Column) -> Column:
    """A key of the form sk-..., also at the end of other words."""
    return text.rlike(CREDENTIAL)


def verdict(text: Column) -> Column:
    """struct(allowed, reason) of the first rule that applies; null is rejected."""
    reason = (
        F.when(text.isNull(), NULL_REASON)
        .when(is_injection(text), INJECTION_REASON)
        .when(has_pii(text), PII_REASON)
        .when(has_credential(text), CREDENTIAL_REASON)
        .otherwise(SAFE_REASON)
    )
    return F.struct((reason == SAFE_REASON).alias("allowed"), reason.alias("reason"))


def rejected_classification(reason: Column) -> Column:
    """What a rejected input is classified as, without a model call."""
    return F.struct(F.lit("Fallback").alias("domain"), F.lit(False).alias("is_safe"), reason.alias("reasoning"), F.lit(0.0).alias("confidence"))
