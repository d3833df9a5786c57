"""Deterministic replies for dry runs. These rules are not a model, and say nothing of answer quality."""

from __future__ import annotations

import json
import re
from zlib import crc32

from promptloom.operators.call import RuleBackend

#: Words that a rule looks for in a ticket, by branch.
_TICKET_WORDS = {
    "escalation": ("locked out", "vanished", "unanswered", "unknown device"),
    "billing": ("invoice", "charged", "billed", "refund", "card", "tax", "discount"),
    "technical": ("window", "page", "sync", "pairs", "update", "sheets", "sign-in", "search"),
}
_DOMAIN_WORDS = {
    "Financial / Business": ("bond", "credit", "interest", "trade", "stock", "loan"),
    "Historical / Cultural": ("medieval", "siege", "royal", "war ", "peasant"),
    "Scientific / Technical": ("protein", "quantum", "cache", "climate", "gene"),
}


def _quoted(prompt: str) -> str:
    parts = prompt.split('"""')
    return parts[1].strip() if len(parts) > 1 else prompt


def _first(text: str, words: dict[str, tuple[str, ...]], other: str) -> str:
    low = text.lower()
    return next((name for name, own in words.items() if any(w in low for w in own)), other)


def reply(stage: str, prompt: str) -> str:
    text = _quoted(prompt)
    if stage == "clean":
        return json.dumps({"cleaned_text": " ".join(text.split())})
    if stage == "sentiment-keywords":
        return "```json\n" + json.dumps({"sentiment": "neutral", "keywords": sorted(set(re.findall(r"\w{6,}", text)))[:3]}) + "\n```"
    if stage == "classify":
        if len(text) < 90:
            return "not sure what this is"
        return json.dumps({"category": _first(text, _TICKET_WORDS, "general"), "product": "unknown", "issue_type": "other", "urgency": "medium", "description": text[:80]})
    if stage == "solve":
        return json.dumps({"category": "unsure", "message": "Please tell us more."} if "Ask for what is missing" in prompt else {"solution_steps": ["Try again."]})
    if stage.endswith("-review"):
        return json.dumps({"approved": crc32(prompt.encode()) % 2 == 0, "feedback": "more detail"})
    if stage.endswith("-improve"):
        return json.dumps({"solution_steps": ["Try again.", "Send the log."], "improvement_notes": f"revision {crc32(prompt.encode()) % 1000}"})
    if stage == "route":
        return json.dumps({"domain": _first(prompt.split("User Query:")[-1], _DOMAIN_WORDS, "General / Everyday"), "is_safe": True, "reasoning": "by rule", "confidence": 0.5})
    if stage == "decompose":
        return json.dumps({"intent": "analysis", "tasks": [{"agent": a, "query": f"{a}: {crc32(prompt.encode())}"} for a in ("background", "risk")]})
    if stage == "task":
        if crc32(prompt.encode()) % 7 == 0:
            raise RuntimeError("provider_timeout")
        return json.dumps({"answer": prompt[:40], "confidence": 0.6})
    if stage == "judge":
        return str(crc32(prompt.encode()) % 10 + 1)
    if stage == "fan_in":
        return json.dumps({"answer": f"An answer from {prompt.count('agent')} parts.", "confidence": 0.7, "reasoning": "by rule"})
    if stage == "critic":
        return json.dumps({"scores": {"factual_grounding": 5 + prompt.count("revised"), "completeness": 6}, "revision_instructions": ["Add figures."]})
    if stage == "producer":
        return prompt.split("\nDraft:\n", 1)[-1].rsplit("\nAdvice:\n", 1)[0] + " revised"
    raise ValueError(f"no rule for {stage}")


def backend() -> RuleBackend:
    return RuleBackend(reply)
