"""Types of tickets, questions, model replies and results."""

from __future__ import annotations

CLASSIFICATION = "struct<category:string,product:string,issue_type:string,urgency:string,description:string>"
#: What a question's classification holds; ``is_safe`` is read apart, as JSON of any type.
DOMAIN = "struct<domain:string,is_safe:boolean,reasoning:string,confidence:double>"
PLAN = "struct<intent:string,entities:array<string>,time_scope:string,tasks:array<struct<agent:string,query:string>>>"
EXPANDED = "struct<tasks:array<struct<agent:string,query:string,expected_output:string>>>"
ANSWER = "struct<answer:string,confidence:double,reasoning:string,summary_points:array<string>,risk_notes:array<string>>"
JUDGE = "struct<best_indices:array<int>,scores:array<double>,reasoning:string>"
RUBRIC = ("factual_grounding", "completeness", "internal_consistency", "domain_tone", "unsupported_claims_control")
CRITIC = f"struct<scores:struct<{','.join(f'{r}:string' for r in RUBRIC)}>,revision_instructions:array<string>,unsupported_claims:array<string>,summary:string>"
