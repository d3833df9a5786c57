"""The language of short texts, by their function words."""

from __future__ import annotations

import math
import re
import unicodedata

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is was for on with that by it this are from at as an or than would did do not",
    "es": "el la los las de y en que un una por con para se es del al más no su lo como qué entre a dos",
    "fr": "le la les de des du et en un une est que pour dans sur par au aux ce qui ne pas avec sont à",
    "de": "der die das und ist nicht ein eine zu den von mit für auf im dem des sich in sie wie über seit beim bei",
    "pt": "o a os as de e do da dos das em no na um uma que para com não mais por se ao é são",
    "it": "il lo la gli le di e che un una per con non del della dei in sono è più da al nel si delle",
    "nl": "de het een en van is niet dat op te voor met zijn aan er ook als bij naar door om dan wordt uit in",
}
#: Letters that one of these languages has to itself.
OWN_LETTERS = {"es": "ñ¿¡", "pt": "ãõ", "de": "ßäö", "fr": "œêëùû"}

_WORD = re.compile(r"[^\W\d_]+")
_FAR = re.compile(rf"[{''.join(OWN_LETTERS.values())}\u0250-\uffff]")
_WEIGHTS: dict[str, list[tuple[str, float]]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _WEIGHTS.setdefault(_w, []).append((_language, 0.0))
_WEIGHTS = {w: [(x, 1 / len(own)) for x, _ in own] for w, own in _WEIGHTS.items()}
_LETTERS = {c: x for x, letters in OWN_LETTERS.items() for c in letters}

#: The same as patterns, for texts of Latin-1 as bytes, which most are: what is no letter is a space; what is not of _FAR.
_LATIN = [chr(i) for i in range(256)]
_BETWEEN = bytes(i if _WORD.match(c) else 32 for i, c in enumerate(_LATIN))
_NEAR = bytes(i for i, c in enumerate(_LATIN) if not _FAR.match(c))


#: A word's weights for all languages in one number, so that adding up a text takes one addition a word: 1 is ``_ONE``.
_ONE, _FIELD = math.lcm(*range(1, len(FUNCTION_WORDS) + 1)), 48
_PACKED = {w: sum((_ONE // len(own)) << (_FIELD * list(FUNCTION_WORDS).index(x)) for x, _ in own) for w, own in _WEIGHTS.items()}


def _weighed(words: list[str]) -> dict[str, float]:
    """The weights of function words by language."""
    total = sum(map(_PACKED.__getitem__, filter(_PACKED.__contains__, words)))
    found: dict[str, float] = {}
    for language in FUNCTION_WORDS if total else ():
        if n := total & ((1 << _FIELD) - 1):
            found[language] = n / _ONE
        total >>= _FIELD
    return found


def _by_first(found: dict[str, float], words: list[str]) -> dict[str, float]:
    """In the order in which they are seen, function words before letters."""
    seen = dict.fromkeys(language for w in words if w in _WEIGHTS for language, _ in _WEIGHTS[w])
    return {language: found[language] for language in (*seen, *(x for x in found if x not in seen))}


def evidence(text: str, words: list[str] | None = None) -> dict[str, float]:
    """How much speaks for each language; scripts other than Latin count as languages of their own.

    Of languages for which most speaks, the one seen first comes first.
    ``words`` are the text's words in lower case, where they are known already.
    """
    low = text if words is not None and text.isascii() else text.lower()
    try:
        raw = low.encode("latin-1")
    except UnicodeEncodeError:
        raw = None
    if words is None:
        words = _WORD.findall(low) if raw is None else raw.translate(_BETWEEN).decode("latin-1").split()
    found = _weighed(words)
    if not low.isascii():
        for c in _FAR.findall(low) if raw is None else raw.translate(None, _NEAR).decode("latin-1"):
            if c in _LETTERS:
                found[_LETTERS[c]] = found.get(_LETTERS[c], 0.0) + 0.75
            elif ord(c) > 0x24F and c.isalpha():
                script = unicodedata.name(c, "?").split()[0]
                found[script] = found.get(script, 0.0) + 0.4
    if len(found) > 1 and list(found.values()).count(max(found.values())) > 1:
        return _by_first(found, words)
    return found


def other_language(own: dict[str, float], than: dict[str, float], least: float = 1.2) -> bool:
    """Whether a text with the evidence ``own`` is in another language than one with the evidence ``than``."""
    if not own or not than:
        return False
    best = max(own, key=own.get)
    right = max(than, key=than.get)
    if best == right or than.get(best, 0.0) >= 0.75 * than[right]:
        return False
    return own[best] >= least and own[best] >= 1.5 * own.get(right, 0.0) + 0.4
