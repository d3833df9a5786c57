"""Keyed permutations that keep a value's format."""

from __future__ import annotations

import datetime
import hashlib
import hmac

ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: str = "") -> int:
    """A permutation of the integers below ``size``, another one for each key and tweak.

    A balanced Feistel network over the next even number of bits; values that land outside are permuted on, which
    ends inside and stays a permutation.
    """
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            digest = hmac.new(key, f"{tweak}|{size}|{r}|{right}".encode(), hashlib.sha256).digest()
            left, right = right, left ^ (int.from_bytes(digest[:16], "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def permute_format(text: str, key: bytes, tweak: str = "", keep: int = 0) -> str:
    """``text`` with its digits and ASCII letters permuted among such digits and letters; all else, case included, stays.

    The first ``keep`` digits stay too. Equal digits and letters give equal results, however they are punctuated.
    """
    value, size, places, seen = 0, 1, [], 0
    for i, c in enumerate(text):
        if c.isascii() and c.isdigit():
            seen += 1
            if seen <= keep:
                continue
            places.append((i, 10, "0"))
            value, size = value * 10 + int(c), size * 10
        elif c.isascii() and c.isalpha():
            base = "a" if c.islower() else "A"
            places.append((i, 26, base))
            value, size = value * 26 + ord(c) - ord(base), size * 26
    other = permute(value, size, key, tweak)
    out = list(text)
    for i, radix, base in reversed(places):
        other, digit = divmod(other, radix)
        out[i] = chr(ord(base) + digit)
    return "".join(out)


def permute_date(date: datetime.date, key: bytes, first: int = 1900, last: int = 2099) -> datetime.date:
    """A date of the years ``first`` to ``last``, permuted among all dates of these years."""
    begin = datetime.date(first, 1, 1).toordinal()
    size = datetime.date(last, 12, 31).toordinal() - begin + 1
    at = date.toordinal() - begin
    if not 0 <= at < size:
        raise ValueError(f"{date} lies outside of {first} to {last}")
    return datetime.date.fromordinal(begin + permute(at, size, key, "date"))
