"""Personal information inside running text, and its replacement."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.feistel import permute_format
from promptloom.sources import materialise

TYPES = ("email", "phone", "id_number", "address", "name")

_W = r"[^\W\d_]"
_WORD = rf"{_W}+(?:['’\-]{_W}+)*"

# Email addresses, written plainly or spelled -------------------------------------------------------------------------

_EMAIL = re.compile(
    r"[\w.+\-]*\w(?: ?@ ?|\ ?[\[(] ?at ?[\])] ?)(?:[\w\-]+(?:\.| ?[\[(]dot[\])] ?| dot ))+[^\W\d_]{2,}\b"
    r"|[\w.+\-]*\w at (?:[\w\-]+ dot )+[^\W\d_]{2,}\b",
    re.IGNORECASE,
)

#: What every email address holds; looked for first, as most texts have none.
_AT = re.compile(r"@|[\[( ]at[\]) ]", re.IGNORECASE)

# Numbers -------------------------------------------------------------------------------------------------------------

#: Words near a number that say what it counts or names.
_NOT_PERSONAL = r"order|invoice|part|serial|batch|tracking|job|ticket|version|build|rows?|bytes?|lines?|page|status|error|code|item|sku|model|reference|ref|room|building|amount|total|series|pedido|factura|lote|commande|facture|bestellung|rechnung|sn|inv|seats"
_PHONE_WORDS = r"call|ring|phone|tel|text|mobile|cell|fax|reach|my number|dial|whatsapp|teléfono|llámen?me|móvil|numéro est|rappele[rz]|téléphone|appele[rz]|rückruf|nummer|telefon|handy|anruf\w*|erreichen"
_ID_WORDS = r"ssn|social|tax id|taxpayer|passport|passeport|pasaporte|reisepass|licen[cs]e|permis|führerschein|identity|national id|id card|id no|dni|nie|ausweis\w*|steuer\W?id\w*|sécurité sociale|personalausweis|carné|carnet"
_CUE = re.compile(rf"\b(?:(?P<no>{_NOT_PERSONAL})|(?P<id>{_ID_WORDS})|(?P<phone>{_PHONE_WORDS}))\b", re.IGNORECASE)
_AFTER = re.compile(rf"^\W{{0,3}}(?:{_W}+ )?(?:rows?|bytes?|seats|items|lines|records|percent|filas|lignes|zeilen)\b", re.IGNORECASE)

_DIGIT = re.compile(r"\d")
_SEP = r"[ .\-/]"
_ID_SHAPES = re.compile(
    rf"""(?<![\w\-])(?:
      [a-z]-\d{{3}}-\d{{3}}-\d{{2}} | \d{{4}}-\d{{3}}-\d{{3}}-[a-z]
    | [a-z]\d[a-z]\d{{5}}[a-z] | [a-z]\d{{2}}[a-z]\d{{2}}[a-z]\d{{2}}
    | \d{{8}}-?[a-z] | \d{{2}}\.\d{{3}}\.\d{{3}}-?[a-z]
    | [12]\ \d\d\ \d\d\ \d[\da-b]\ \d{{3}}\ \d{{3}}\ \d\d
    | \d\d\ \d{{3}}\ \d{{3}}\ \d{{3}}
    | \d{{3}}-\d\d-\d{{4}} | \d{{3}}\ \d\d\ \d{{4}}
    )(?![\w]|-\d)""",
    re.IGNORECASE | re.VERBOSE,
)
_ID_WITH_CUE = re.compile(r"(?<![\w\-])(?:[A-Z]{1,3}-?)?\d(?:[\-. ]?\d|[A-Z]\d)*(?:-?[A-Z])?(?![\w]|-\d)")
_PHONE_SHAPES = re.compile(
    rf"""(?<![\w\-+.])(?:
      \+\d{{1,3}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d{{1,5}}(?:{_SEP}?\d{{1,5}}){{1,6}}
    | 00[1-9]\d{{0,2}}{_SEP}\d{{1,4}}(?:{_SEP}\d{{2,6}}){{1,5}}
    | \(\d{{3}}\)\ ?\d{{3}}[ .\-]\d{{4}}
    | (?:1[ .\-])?[2-9]\d\d([ .\-])[2-9]\d\d\1\d{{4}}
    | 1[2-9]\d\d[2-9]\d{{6}}
    | 0\d{{4}}\ \d{{3}}\ \d{{3}} | 0\d{{4}}\ \d{{6}} | 07\d{{9}}
    | 0\d(?:[ .]\d\d){{4}} | 0\d{{3}}(?:\ \d\d){{3}}
    | 0\d{{1,4}}/\ ?\d{{5,9}} | \(0\d{{1,4}}\)\ ?\d{{5,9}}
    )(?![\w]|[\-.]\d)""",
    re.VERBOSE,
)
#: Digits as words.
_DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun"
_DIGITS_SPELLED = frozenset(_DIGIT_WORDS.split("|"))
_SPELLED = re.compile(rf"\b(?:{_DIGIT_WORDS})(?:[ \-]+(?:{_DIGIT_WORDS})){{6,14}}\b", re.IGNORECASE)

# Street addresses ----------------------------------------------------------------------------------------------------

_CITY = rf"(?:,? \d{{4,5}} {_WORD}|,? {_WORD} \d{{4,5}}\b|, (?!second|third|first|which|in |so |but |and ){_WORD})"
_UNIT = r"(?:,? (?:apt|apartment|suite|flat|unit|no|piso|appt|appartement|etage)\.? ?\w+)"
_STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|boulevard|blvd|drive|dr|court|ct|mews|way|square|sq|place|pl|terrace|close|crescent|row|walk|gardens|highway|parkway)"
_NAME1 = rf"(?:[nsew]\. |(?:north|south|east|west) )?{_WORD}(?: {_WORD})?"
_ADDRESS = re.compile(
    r"(?<![\w.#])(?:"
    + "|".join(
        [
            rf"(?:(?:flat|apt|unit|suite)\.? \w+, )?\d{{1,5}}[a-z]? {_NAME1} {_STREET}\b\.?{_UNIT}?{_CITY}?",
            rf"{_WORD} (?:court|house|place|square|gardens|terrace|close) \d{{1,5}}[a-z]?\b{_CITY}",
            rf"(?:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda|carrer) ?(?:(?:de|del|de la|de los) )?{_WORD},? (?:n\.? ?[º°o] ?)?\d{{1,5}}(?:, \d{{1,2}}\.?[º°ª] ?\w?)?{_CITY}?",
            rf"\d{{1,5}}(?: (?:bis|ter))?,? (?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours) (?:(?:de la|de|du|des) |de l['’]|d['’])?{_WORD}(?: à {_WORD}|{_CITY})?",
            rf"{_W}+(?:straße|strasse|weg|platz|gasse|allee|ring|damm|str\.) \d{{1,4}}[a-z]?\b{_CITY}?",
            rf"{_WORD} (?:straße|strasse|weg|platz|gasse|allee) \d{{1,4}}[a-z]?\b(?![\-.]?\d| \d){_CITY}?",
        ]
    )
    + ")",
    re.IGNORECASE,
)

# Names ---------------------------------------------------------------------------------------------------------------

#: What stands before a person's name, and behind one.
_TITLES = r"mr|mrs|ms|mx|dr|prof|miss|sir|sr|sra|srta|don|doña|m|mme|mlle|herr|frau"
_BEFORE = r"my name is|i am called|this is|regards,|wishes,|sincerely,|cheers,|signed,?|customer|user|raised by|sent by:?|reported by|opened by|account holder:?|spoke(?:n)? (?:with|to)|account with|went to|please add|contact:|name:|on behalf of|me llamo|mi nombre es|saludo,|saludos,|hablé con|titular:?|je m['’]appelle|cordialement,|parlé avec|mein name ist|ich heiße|grüße,|grüßen,|schon mit|--?"
_BEFORE_RE = re.compile(rf"(?:(?<!\w)(?:{_BEFORE}))[ \n]+", re.IGNORECASE)
_BEHIND = re.compile(r"^ (?:here again|told me|writes?:|reports?:|from the|as a |instead|gesprochen|on monday)", re.IGNORECASE)
_TOKEN = re.compile(rf"{_WORD}")
_TITLE_WORDS = frozenset(_TITLES.split("|"))
_TITLE_RE = re.compile(rf"(?<!\w)(?:{_TITLES})\.? (?={_W})", re.IGNORECASE)
_CAP = r"[^\W\d_a-zß-öø-ÿ]"
_PROPER = rf"(?:{_CAP}{_W}+(?:['’\-]{_CAP}{_W}+)*)"
_TITLED = re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof|Miss|Sr|Sra|Srta|Herr|Frau|Mme|Mlle)\.? )+(?:{_CAP}\. )?({_PROPER})(?: ({_PROPER}))?")
_AS_GIVEN = re.compile(rf"({_PROPER}) (?:{_CAP}\. )?({_PROPER})(?=[\s,.:;|/)]|$)")
_AS_SURNAME = re.compile(rf"({_CAP}{{2,}}(?:-{_CAP}{{2,}})?), ({_PROPER})")
_INITIAL = re.compile(rf"(?<![\w.])({_W})\. ({_WORD})")
_SHAPE = re.compile(rf"{_PROPER}(?: |, ){_PROPER}")


#: Places before a name where other words stand as well.
_WEAK = frozenset({"this is", "customer", "user", "-", "--", "went to"})


def name_evidence(text: str) -> Iterator[tuple[str, str]]:
    """(given name, surname) for names that stand, properly written and without a title, where a name is given."""
    if not _BEFORE_RE.search(text):
        return
    for sign, pattern in ((_AT, _EMAIL), (_DIGIT, _ADDRESS)):
        text = pattern.sub("\x00", text) if sign.search(text) else text
    for m in _BEFORE_RE.finditer(text):
        at = m.end()
        if _TITLE_RE.match(text, at):
            continue
        if n := _AS_SURNAME.match(text, at):
            yield n[2].casefold(), n[1].casefold()
        elif (n := _AS_GIVEN.match(text, at)) and not _INITIAL.search(n[0]):
            if m[0].strip().casefold() not in _WEAK or _BEHIND.match(text, n.end()) or text[n.end() : n.end() + 1] in ("", ".", "\n"):
                yield n[1].casefold(), n[2].casefold()


class NameBits:
    """A set of words as bits: holds all that were put in, whatever their number, in a size that doesn't grow.

    A word that was not put in is taken for one that was at a rate of (3 words / bits)^3, below one in ten thousand up to
    a million words of 2^26 bits.
    """

    def __init__(self, bits: np.ndarray):
        self.bits, self.seen = bits, {}

    @staticmethod
    def positions(word: str, size: int) -> list[int]:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=24).digest(), "little")
        return [(h >> 64 * i & 0xFFFFFFFFFFFFFFFF) % size for i in range(3)]

    def __contains__(self, word: str) -> bool:
        if word not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = all(self.bits[at >> 3] >> (at & 7) & 1 for at in self.positions(word, len(self.bits) * 8))
        return self.seen[word]

    def __getstate__(self):
        return self.bits, {}

    def __setstate__(self, state):
        self.bits, self.seen = state


class Detector:
    """Finds the pieces of a text that are personal.

    ``given`` and ``surnames`` hold case-folded words of known names; ``ends``, three letters that several surnames end in.
    """

    def __init__(self, given: Container[str], surnames: Container[str], ends: Iterable[str] | None = None):
        self.given, self.surnames = given, surnames
        if ends is None:
            counts = Counter(w[-3:] for w in surnames if len(w) >= 6)
            ends = [e for e, k in counts.items() if k >= 5]
        self.ends = frozenset(ends)

    def _surname(self, word: str) -> bool:
        """Each part is a known surname, or ends like several."""
        parts = [p for p in word.casefold().split("-") if p]
        return bool(parts) and all(p in self.surnames or (len(p) >= 6 and p[-3:] in self.ends) for p in parts)

    def _known(self, word: str) -> bool:
        return word.casefold() in self.given or self._surname(word)

    @staticmethod
    def _context(text: str, start: int, end: int) -> str | None:
        """What the nearest telling word before the number says it is; of those behind it only units count."""
        if _AFTER.match(text[end : end + 40]):
            return "no"
        before = text[max(0, start - 60) : start]
        if cut := [m.end() for m in re.finditer(r"(?<!\bno)(?<!\btel)[.!?]\s+(?=[^\W\d_a-z])|\n", before)]:
            before = before[cut[-1] :]
        found = None
        for m in _CUE.finditer(before):
            found = m.lastgroup
        return found

    def _numbers(self, text: str, words: list[str]) -> Iterator[tuple[int, int, str]]:
        for m in _PHONE_SHAPES.finditer(text) if _DIGIT.search(text) else ():
            digits = sum(c.isdigit() for c in m[0])
            cue = self._context(text, *m.span())
            if 8 <= digits <= 15 and cue not in ("no", "id"):
                yield *m.span(), "phone"
        for m in _ID_SHAPES.finditer(text) if _DIGIT.search(text) else ():
            if self._context(text, *m.span()) not in ("no", "phone"):
                yield *m.span(), "id_number"
        for m in _ID_WITH_CUE.finditer(text) if _DIGIT.search(text) else ():
            if self._context(text, *m.span()) == "id" and sum(c.isdigit() for c in m[0]) >= 5:
                yield *m.span(), "id_number"
        if not _DIGITS_SPELLED.isdisjoint(words) or any(not _DIGITS_SPELLED.isdisjoint(w.split("-")) for w in words if "-" in w):  # hyphens may join any
            for m in _SPELLED.finditer(text):
                yield *m.span(), "phone"

    def _extend(self, text: str, m: re.Match) -> tuple[int, int]:
        """From a known given name over the rest of the name."""
        start, end = m.span()
        before = text[:start]
        s = re.search(rf"({_WORD}), $", before)
        if s and len(s[1]) > 1 and (s[1].isupper() or self._surname(s[1])):
            start = s.start()
        else:
            n = re.match(rf"(?: {_W}\.)? ({_WORD})", text[end:])
            if n and (self._known(n[1]) or (not n[1].isupper() and _BEHIND.match(text, end + n.end()))):
                end += n.end()
            elif i := re.match(rf" {_W}\.(?!\w)", text[end:]):
                end += i.end()
        if t := re.search(rf"(?<!\w)(?:{_TITLES})\.? $", text[:start], re.IGNORECASE):
            start = t.start()
        return start, end

    def _names(self, text: str, words: list[str]) -> Iterator[tuple[int, int, str]]:
        present = set(words)
        titled = not present.isdisjoint(_TITLE_WORDS)
        for m in _TOKEN.finditer(text) if any(w in self.given for w in present) else ():
            if m[0].casefold() in self.given:
                yield *self._extend(text, m), "name"
        called = {m.end() for m in _BEFORE_RE.finditer(text)}
        for m in _INITIAL.finditer(text):
            if self._surname(m[2]) or (m[2][0].isupper() and (_BEHIND.match(text, m.end()) or m.start() in called)):
                yield *m.span(), "name"
        for m in _TITLED.finditer(text) if titled else ():
            yield m.start(), m.end(2) if m[2] and self._known(m[2]) else m.end(1), "name"
        for m in _TITLE_RE.finditer(text) if titled else ():
            w = _TOKEN.match(text, m.end())
            if w and self._surname(w[0]):
                yield m.start(), w.end(), "name"
        for at in called:
            n = _SHAPE.match(text, at)
            if n and any(self._known(w[0]) for w in _TOKEN.finditer(n[0])):
                yield *n.span(), "name"

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans that don't overlap, in order; where two do, email, number, address, name win in this order."""
        if "  " not in text:
            return self._spans(text)
        kept = [i for i, c in enumerate(text) if not (c == " " and i and text[i - 1] == " ")]  # read as single-spaced
        return [(kept[a], kept[b - 1] + 1, x) for a, b, x in self._spans("".join(text[i] for i in kept))]

    def _spans(self, text: str) -> list[tuple[int, int, str]]:
        taken: list[tuple[int, int, str]] = []

        def take(found: Iterator[tuple[int, int, str]]) -> None:
            for s in sorted(found, key=lambda s: (s[0], -s[1])):
                if all(s[1] <= t[0] or s[0] >= t[1] for t in taken):
                    taken.append(s)

        def hidden() -> str:  # what was taken can't be read again
            if not taken:
                return text
            out = list(text)
            for a, b, _ in taken:
                out[a:b] = "\x00" * (b - a)
            return "".join(out)

        words = [w.casefold() for w in _TOKEN.findall(text)]
        if _AT.search(text):
            take((*m.span(), "email") for m in _EMAIL.finditer(text))
        if _DIGIT.search(text):
            take((m.start(), self._address_end(text, m), "address") for m in _ADDRESS.finditer(hidden()) if self._is_address(m[0]))
        take(self._numbers(hidden(), words))
        take(self._names(hidden(), words))
        return sorted(taken)

    def _address_end(self, text: str, m: re.Match) -> int:
        """Without a last part that is not a town but where a person's name begins."""
        if (c := re.search(rf",? ({_WORD})$", m[0])) and (c[1].casefold() in self.given or (len(c[1]) > 1 and (n := re.match(rf",? ({_WORD})", text[m.end() :])) and n[1].casefold() in self.given and c[1].isupper())):
            return m.start() + c.start()
        return m.end()

    @staticmethod
    def _is_address(found: str) -> bool:
        return not re.match(r"\d+ (?:of|percent|rows|bytes|users|seats|times|and|or|the)\b", found, re.IGNORECASE)


#: Calling codes of one and two digits; all others have three.
_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
_CODE = re.compile(rf"(?:\+|00)(?:{'|'.join(sorted(_CODES.split(), key=len, reverse=True))}|\d{{3}})(?:\W*\(0\))?|1(?=\W?[2-9]\d{{2}}\W?[2-9]\d{{2}}\W?\d{{4}}$)|0(?=\d)")
#: Check letters of the Spanish identity number, and digits as words, by language.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
_DIGIT_OF = {w: str(d) for own in ("zero one two three four five six seven eight nine", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun") for d, w in enumerate(own.split())} | {"oh": "0", "zwo": "2"}
_SSN = re.compile(r"(\d{3})[- ](\d\d)[- ](\d{4})")
_DNI_SHAPE = re.compile(r"\d{8}-?[a-z]|\d\d\.\d{3}\.\d{3}-?[a-z]", re.IGNORECASE)
_NIR = re.compile(r"[12] \d\d \d\d \d\d \d{3} \d{3} \d\d")
_TAX = re.compile(r"\d\d \d{3} \d{3} \d{3}")


def _with_digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced, in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def _ssn(digits: str) -> str | None:
    """The digits, if a social security number may have them."""
    return digits if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else None


def _nir(digits: str) -> str | None:
    """The first 13 digits with their key, if a social security number of France may have them."""
    return digits[:13] + f"{97 - int(digits[:13]) % 97:02d}" if digits[0] in "12" and "01" <= digits[3:5] <= "12" else None


def _tax(digits: str) -> str | None:
    """The first ten digits with their check digit, if a tax number of Germany may have them."""
    product = 10
    for c in digits[:10]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return digits[:10] + str((11 - product) % 10) if digits[0] != "0" else None


#: Kinds of number that can be validated: shape, digits that are free, and the valid number that these make.
_CHECKED = (("ssn", _SSN, 9, _ssn), ("nir", _NIR, 13, _nir), ("tax", _TAX, 10, _tax))


def validated(piece: str) -> bool | None:
    """Whether the check of its kind of number says that it is valid; None for a kind without one."""
    digits = "".join(c for c in piece if c.isdigit())
    if _DNI_SHAPE.fullmatch(piece):
        return piece[-1].upper() == _DNI[int(digits) % 23]
    for _, shape, _, valid in _CHECKED:
        if shape.fullmatch(piece):
            return valid(digits) == digits
    return None


class Redactor:
    """Puts a placeholder of its type in the place of each personal piece.

    Numbers are permuted within their format under ``key``, so the same number comes out the same in every document and
    however it is written there: phone numbers apart from their country code, spelled digits as digits, and numbers of
    a kind that has a check among those that pass it. Numbers that don't pass theirs, and all other pieces, get a keyed
    mark of 128 bits: an email of its address, a name of its words in any order, an address of its words.
    """

    def __init__(self, detector: Detector, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.detector, self.key = detector, key

    def _mark(self, text: str, type_: str) -> str:
        plain = text.casefold()
        if type_ == "email":
            plain = re.sub(r" ?[\[(] ?(?:at|dot) ?[\])] ?| (?:at|dot) | ?@ ?", lambda m: "@" if "a" in m[0] or "@" in m[0] else ".", plain)
        else:
            words = re.findall(r"\w+", plain)
            plain = " ".join(sorted(w for w in words if w not in _TITLE_WORDS) if type_ == "name" else words)
        return hmac.new(self.key, f"{type_}|{plain}".encode("utf-8", "replace"), hashlib.sha256).hexdigest()[:32]

    def _number(self, piece: str, type_: str) -> str | None:
        if type_ == "phone":
            if not _DIGIT.search(piece):
                piece = "".join(_DIGIT_OF.get(w, "") for w in re.findall(r"[^\W\d_]+", piece.casefold()))
            code = _CODE.match(piece)
            head = code[0] if code else ""
            return head + permute_format(piece[len(head) :], self.key, type_)
        digits = "".join(c for c in piece if c.isdigit())
        if validated(piece) is False:
            return None
        if _DNI_SHAPE.fullmatch(piece):
            other = permute_format(digits, self.key, "dni")
            letter = _DNI[int(other) % 23]
            return _with_digits(piece[:-1], other) + (letter if piece[-1].isupper() else letter.lower())
        for kind, shape, free, valid in _CHECKED:
            if shape.fullmatch(piece):
                other = digits[:free]
                while True:  # on until the number is valid, which stays a permutation of the valid ones
                    other = permute_format(other, self.key, kind)
                    if full := valid(other):
                        return _with_digits(piece, full)
        return permute_format(piece, self.key, type_)

    def placeholder(self, piece: str, type_: str) -> str:
        number = self._number(piece, type_) if type_ in ("phone", "id_number") else None
        return f"[{type_.upper()} {number or self._mark(piece, type_)}]"

    def redact(self, text: str) -> tuple[str, list[str]]:
        out, at, types = [], 0, []
        for a, b, type_ in self.detector.spans(text):
            out += [text[at:a], self.placeholder(text[a:b], type_)]
            at = b
            if type_ not in types:
                types.append(type_)
        return "".join([*out, text[at:]]), sorted(types)


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for column in batch.columns:
            for text in batch[column]:
                if text:
                    text = re.sub(" +", " ", text)
                    rows += [(role, part) for given, surname in name_evidence(text) for role, part in (("given", given), *(("surname", s) for s in surname.split("-")))]
        yield pd.DataFrame(rows, columns=["role", "word"])


def learn_names(texts: DataFrame, columns: list[str], least: int = 3, log2_bits: int = 26) -> tuple[NameBits, NameBits, list[str]]:
    """Given names, surnames and surnames' ends, from where a person gives a name, counted over all texts.

    A given name stands there ``least`` times, a surname half as often, as they are many; a word of both kinds is what it
    is more often. None is left out, whatever their number: what is collected are the 2^``log2_bits`` bits of each set.
    """
    counts = texts.select(*columns).mapInPandas(_evidence, "role string, word string").groupBy("role", "word").agg(F.count("*").alias("n"))
    counts = materialise(counts.groupBy("word").pivot("role", ["given", "surname"]).agg(F.sum("n")).na.fill(0).filter(F.length("word") > 1), "names")
    size = 1 << log2_bits
    sets = []
    for role, k in (("given", least), ("surname", max(1, least // 2))):
        own, other = F.col(role), F.col("surname" if role == "given" else "given")
        words = counts.filter((own >= k) & (own > other)).select("word")
        sets.append(NameBits(_bits(words, size)))
    # The ends that one of two hundred surnames has, and five.
    long = words.filter(F.length("word") >= 6).groupBy(F.substring("word", -3, 3).alias("end")).agg(F.count("*").alias("n"))
    enough = max(5, (long.agg(F.sum("n")).first()[0] or 0) / 200)
    return sets[0], sets[1], [r["end"] for r in long.filter(F.col("n") >= enough).collect()]


def _bits(words: DataFrame, size: int) -> np.ndarray:
    """The bits of ``NameBits``, put together on the workers in pieces of 4 kB."""

    def at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bit": [p for w in batch["word"] for p in NameBits.positions(w, size)]}, dtype="int64")

    each = words.mapInPandas(at, "bit long").select(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket"), F.expr("bitmap_bit_position(bit + 1)").alias("at"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for bucket, bitmap in each.groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)")).toLocalIterator():
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap, dtype=np.uint8)
    return bits


def redact_texts(texts: DataFrame, columns: list[str], key: bytes, least: int = 3) -> DataFrame:
    """``texts`` with each of ``columns`` (strings) redacted, and ``<column>_types``, the sorted types found in it.

    A null text stays null with null types; an empty one stays empty with none. All other columns and rows stay as they
    are, repeated rows included; a column that is already called like a new one is replaced. The key is the caller's
    secret, and must not be empty. Two passes: one counts where names stand, one rewrites; neither moves a text. A text
    that a task meets again is not looked through again.
    """
    if not key:
        raise ValueError("a key is needed")
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(learn_names(texts, columns, least))
    keep = [c for c in texts.columns if c not in {f"{x}_types" for x in columns}]
    base = texts.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + "".join(f", `{c}_types` array<string>" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, done = Redactor(Detector(*shared.value), key), {None: (None, None)}
        for batch in batches:
            for c in columns:
                out = []
                for text in batch[c]:
                    if text not in done:
                        if len(done) > 20_000:
                            done = {None: (None, None)}
                        done[text] = own.redact(text)
                    out.append(done[text])
                batch[c], batch[f"{c}_types"] = [d[0] for d in out], [d[1] for d in out]
            yield batch

    return base.mapInPandas(run, schema)
