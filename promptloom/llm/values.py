"""Which value of a short list a hand-written or model-written value was meant to be."""

from __future__ import annotations

import re
import unicodedata

#: Words that join the parts of a value.
CONNECTORS = frozenset({"and", "or", "the", "of"})


def fold(value: str) -> str:
    """Composed, case-folded, single-spaced."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def words(value: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", fold(value)) if w not in CONNECTORS]


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def _within(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


class Resolver:
    """Maps free spellings to the values of one field.

    A value resolves if it equals a listed one but for case, white space, punctuation and wrapping, or if its words
    name exactly one listed value: word by word equal, a slip of spelling away (one, or two from eight letters on),
    or an abbreviation (a beginning of two letters or more, or letters left out). Words that name nothing are added
    words. Null, blank and ambiguous values resolve to ``None``.
    """

    def __init__(self, listed: list[str]):
        self.listed = [x for x in dict.fromkeys(listed) if x is not None and words(x)]
        self.parts = {x: words(x) for x in self.listed}
        self.plain = {}
        for x in self.listed:
            self.plain.setdefault("".join(self.parts[x]), x)
        self.known: dict[str, str | None] = {}

    def _near(self, word: str, rule) -> set[str]:
        return {x for x, parts in self.parts.items() if any(rule(word, p) for p in parts)}

    def _named(self, word: str, alone: bool) -> set[str]:
        rules = [
            lambda w, p: w == p,
            lambda w, p: len(p) >= 3 and len(w) >= 2 and slips(w, p, k := 2 if min(len(w), len(p)) >= 8 else 1) <= k,
            lambda w, p: len(w) >= (1 if alone else 2) and p.startswith(w),
            lambda w, p: len(w) >= 3 and w[0] == p[0] and _within(w, p),
        ]
        for rule in rules:
            if found := self._near(word, rule):
                return found
        return set()

    def resolve(self, value: str | None) -> str | None:
        if value is None:
            return None
        if value not in self.known:
            if len(self.known) > 100_000:  # bounds a worker's memory, whatever the values are
                self.known.clear()
            self.known[value] = self._resolve(value)
        return self.known[value]

    def _resolve(self, value: str) -> str | None:
        parts = words(value)
        joined = "".join(parts)
        if not joined:
            return None
        if joined in self.plain:
            return self.plain[joined]
        found = [x for w in parts if (x := self._named(w, len(parts) == 1))]
        if found and all(len(x) == 1 for x in found) and len(set.union(*found)) == 1:
            return next(iter(found[0]))
        if found and (both := set.intersection(*found)) and len(both) == 1:
            return next(iter(both))
        if not found:  # a slip may have split the value into other words
            close = [x for p, x in self.plain.items() if len(p) >= 6 and slips(joined, p, 1) <= 1]
            return close[0] if len(close) == 1 else None
        return None
