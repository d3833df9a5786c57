"""Prompts from templates and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTES = '"""'


def wrapped_prompt(instruction: Column, *payloads: Column) -> Column:
    """An instruction with its payloads in triple quotes on lines of their own, several joined by a plus sign."""
    body: list[Column] = []
    for p in payloads:
        body += ([F.lit(" + ")] if body else []) + [p]
    return F.concat(instruction, F.lit(f"\n{QUOTES}\n"), *body, F.lit(f"\n{QUOTES}"))


def template_prompt(template: Column, query: Column) -> Column:
    """``{query}`` in the template becomes the query; doubled braces become single ones; other braces stay."""
    parts = F.split(template, r"\{query\}", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")))
    return F.aggregate(F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))), F.get(plain, 0), lambda done, p: F.concat(done, query, p))


def instruction_bullets(instructions: Column) -> Column:
    """A line with a dash for each; one stock line where there are none."""
    lines = F.array_join(F.transform(instructions, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.coalesce(F.size(instructions), F.lit(0)) <= 0, F.lit("- Improve clarity.")).otherwise(lines)
