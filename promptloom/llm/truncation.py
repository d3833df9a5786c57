"""Texts that were cut before their end."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 18
#: What transfers and exports leave or put where they cut.
MARKS = ("…", "...", " ...", " …", " [...]", "[…]", " (cont", " (cont.)", " (continued)", " [truncated]", "-", "<", "<b", "&", "&am", "\\", "\\n", "\\u00", "\\u00e", "\ufffd", "\ufffd\ufffd", '"', "[", "{", "|")
#: Characters that end a sentence, and those that may close it.
STOPS = ".!?。！？؟।"
CLOSERS = "\"'”’»)]`*_"

#: What is put for no content, without punctuation.
STAND_INS = frozenset({"", "null", "none", "nil", "nan", "n a", "na", "tbd", "tba", "tbc", "empty", "undefined", "no answer", "no content", "no response", "not available", "not applicable", "answer pending", "placeholder", "todo"})

_PLAIN = re.compile(r"[\W_]+")
_FOUR_WORDS = re.compile(r"[\W_]*(?:[^\W_]+[\W_]+){3}[^\W_]")
_DIGITS = re.compile(r"\d+")
_OUTER = STOPS + CLOSERS + ",;:"
_AROUND = _OUTER + "(«\"“"
_BREAK = re.compile(rf"(?<=[{STOPS}])[{re.escape(CLOSERS)}]?\s+|\n+")
#: Ends where ``_BREAK`` does, and begins with the stop before it, so that a search need not look back at every character.
_AFTER = re.compile(rf"[{STOPS}\n](?:(?<=\n)\n*|[{re.escape(CLOSERS)}]?\s+)")


def terminated(text: str) -> bool:
    """Ends as a sentence does."""
    end = text.removesuffix("\n")
    return end.rstrip(CLOSERS).endswith(tuple(STOPS)) and not end.rstrip("\"'”’»)]").endswith(("..", "…"))


def stand_in(text: str) -> bool:
    """No content: blank, invisible, or only a stand-in for none."""
    return not _FOUR_WORDS.match(text) and _PLAIN.sub(" ", text.lower()).strip() in STAND_INS


def _openings(sentence: str) -> tuple[str, ...]:
    words = _tokens(sentence[:80])
    return (words[0], " ".join(words[:2])) if words else ()


def _tokens(text: str) -> list[str]:
    return _DIGITS.sub("#", text.lower()).split()


#: Closing characters of a text that a model is fitted on and scores by.
CLOSING = 2_000


def closing(text: str, limit: int, before: int = 0) -> tuple:
    """All of a text that its features are of: its last sentence and characters, whether it is terminated and within code, and its length against the limit.

    ``text`` is a whole text or the last ``CLOSING`` characters of one, with ``before`` characters in front of them; ``limit``
    is the nearest field limit at or above the text's length (0: none known).
    """
    tail = text[-400:]
    begin = 0
    for m in _AFTER.finditer(tail, 0, max(0, len(tail.rstrip()) - 1)):
        begin = m.end()
    gap = limit - before - len(text)
    against = (min(gap, 4) if gap < 4 else "far", min(9, int(10 * (before + len(text)) / limit))) if limit else None
    return tail[begin:], text[-3:], terminated(tail), text.count("```") % 2, against


def features(text: str, limit: int, glue: frozenset[str], before: int = 0) -> list[int]:
    """Hashed features of the closing characters, the closing words, punctuation, and length against the limit.

    ``glue`` are the words frequent enough to show how a sentence is built; the others as in ``closing``.
    """
    return closing_features(closing(text, limit, before), glue)


def closing_features(of: tuple, glue: frozenset[str]) -> list[int]:
    last, characters, stopped, code, against = of
    words = _tokens(last)
    n = len(words)
    end = characters[-1:]
    w1 = words[-1] if words else ""
    w2 = words[-2] if n > 1 else "^"
    w3 = words[-3] if n > 2 else "^"
    bare = w1.rstrip(_OUTER)
    t = "T" if stopped else "U"
    opening = " ".join(words[: 2 if words and words[0][:1].isalnum() else 1])
    shape: list[str] = []
    gaps, seen = 0, 0
    for w in words[-7:]:
        b = w.strip(_AROUND)
        if b in glue:
            x, seen, gaps = b, 1, 0
        else:
            x = "#" if b == "#" else "_" if b[:1].isalnum() else w
            gaps += 1
        if w[-1:] in ",;:":
            x += w[-1]
        if x != "_" or not shape or shape[-1] != "_":
            shape.append(x)
    gaps = min(gaps, 5) if seen else 5
    two, three, four, all_ = " ".join(shape[-2:]), " ".join(shape[-3:]), " ".join(shape[-4:]), " ".join(shape)
    pair, triple = f"{w2} {bare}", f"{w3} {w2} {bare}"
    raw = [
        f"c1{end}", f"c2{characters[-2:]}", f"c3{_DIGITS.sub('#', characters)}", f"s{end.isspace()}", f"t{t}", f"p{w1[len(bare) :]}{t}",
        f"a{bare}|{t}", f"A{bare}", f"b{pair}|{t}", f"B{pair}", f"d{triple}", f"D{triple}|{t}",
        f"e{two}|{t}", f"f{three}|{t}", f"g{four}|{t}", f"h{all_}|{t}", f"i{opening}|{two}|{t}", f"j{opening}|{min(n, 20)}|{t}",
        f"k{opening}|{bare}|{t}", f"l{gaps}|{t}", f"m{opening}|{gaps}|{two}", f"n{min(n, 12)}|{t}", f"w{bare in glue}|{t}",
        f"q{last.count('(') > last.count(')')}{last.count(chr(34)) % 2}{code}{last.count('«') > last.count('»')}|{t}",
    ]
    if against:
        raw += [f"L{against[0]}|{t}", f"M{against[1]}"]
    encoded = "\0".join(raw).encode("utf-8", "replace").split(b"\0")
    if len(encoded) != len(raw):  # a null character in the text
        encoded = [x.encode("utf-8", "replace") for x in raw]
    return [crc32(x) & ((1 << BITS) - 1) for x in encoded]


class CutModel:
    """A hashed logistic regression, trained on intact texts and on cuts of them made here."""

    def __init__(self, weights: np.ndarray, bias: float, glue: frozenset[str], threshold: float):
        self.weights, self.bias, self.glue, self.threshold = weights, bias, glue, threshold

    def score(self, texts: list[str], limits: list[int]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, (text, limit) in enumerate(zip(texts, limits)):
            end = text[-CLOSING:]
            out[i] = self.weigh(closing(end, limit, len(text) - len(end))) if not stand_in(text) else -50.0
        return self.probability(out)

    def weigh(self, of: tuple) -> float:
        """The weights of a closing's features."""
        return float(np.add.reduce(self.weights.take(closing_features(of, self.glue))))

    def probability(self, weighed: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-(weighed + self.bias)))

    @staticmethod
    def _glue(texts: list[str]) -> frozenset[str]:
        seen: Counter = Counter()
        for text in texts:
            seen.update({w.strip(STOPS + CLOSERS + ",;:(") for w in _tokens(text)})
        least = max(3, 0.004 * len(texts))
        return frozenset(w for w, k in seen.items() if k >= least and not w.isspace() and w)

    @staticmethod
    def _intact(texts: list[str], counts: list[int]) -> list[bool]:
        """Which texts seem to be whole: terminated ones, and others that end as many do which are never terminated.

        That is, the same value came time and again; or its last two words come almost only at an end; or the last
        sentence begins as others do that hardly ever get a full stop, as labels and lists don't.
        """
        pairs, ends, stopped, unstopped = Counter(), Counter(), Counter(), Counter()
        lasts = []
        for text in texts:
            words = _tokens(text)
            pairs.update(zip(words, words[1:]))
            parts = [x for x in _BREAK.split(text) if x.strip()]
            full = terminated(text)
            for part in parts if full else parts[:-1]:
                stopped.update(_openings(part) if terminated(part) or part[-1:] in STOPS else ())
            last = _openings(parts[-1]) if parts else ()
            lasts.append((full, last, tuple(words[-2:])))
            if not full:
                unstopped.update(last)
                ends[tuple(words[-2:])] += 1
        marks = {m.strip() for m in MARKS}
        out = []
        for text, count, (full, last, pair) in zip(texts, counts, lasts):
            word = pair[-1] if pair else ""
            marked = word in marks or word[:1] in "([<\\" and word[-1:] not in ")]" or word[-1:] in "\\<-\ufffd…" or word.endswith("..]") or word == "[...]"
            settled = len(pair) == 2 and ends[pair] >= 5 and ends[pair] >= 0.8 * pairs[pair]
            label = any(unstopped[o] >= 5 and stopped[o] <= 0.05 * unstopped[o] for o in last)
            out.append(full or (not marked and (count >= 4 or settled or label)))
        return out

    @classmethod
    def fit(cls, texts: list[str], limits: list[int], counts: list[int] | None = None, seed: int = 5, epochs: int = 6, threshold: float = 0.5) -> CutModel:
        """``texts`` are a bounded sample with how often each came; see ``_intact`` for those that train the model.

        Of each, as in scoring, the last ``CLOSING`` characters are looked at, and its whole length.

        Not cut are the intact texts, their beginnings up to the end of an inner sentence, and both without the full
        stop. Cut are their beginnings up to a random character inside a sentence, or up to a limit, some with a mark.
        """
        draw = random.Random(seed)
        glue = cls._glue([text[-CLOSING:] for text in texts])
        intact = []
        ends = [text[-CLOSING:] for text in texts]
        for text, end, limit, whole in zip(texts, ends, limits, cls._intact(ends, counts or [1] * len(texts))):
            if whole and len(end.strip()) >= 12 and not end[-1:].isspace():
                intact.append((end, len(text) - len(end), limit, terminated(end)))
        rows: list[list[int]] = []
        labels: list[int] = []

        for text, before, limit, stopped in intact:

            def put(part: str, limit: int, cut: int, before: int = before) -> None:
                rows.append(features(part, limit, glue, before))
                labels.append(cut)

            put(text, limit, 0)
            if stopped and text[-1] in STOPS:
                put(text[:-1], limit, 0)
            ends = [m.start() for m in _BREAK.finditer(text[:-2])]
            for at in draw.sample(ends, min(2, len(ends))):
                part = text[:at].rstrip()
                if len(part) >= 12:
                    put(part, 0, 0)
                    if part[-1] in STOPS:
                        put(part[:-1], 0, 0)
            for _ in range(3):
                at = draw.randrange(max(1, min(8, len(text) // 3)), len(text))
                if draw.random() < 0.3 and " " in text[at:-1]:  # between two words
                    at = text.index(" ", at) + (draw.random() < 0.3)
                part = text[:at]
                if at >= len(text) - 1 or not part.strip() or part.rstrip()[-1] in STOPS or text[at] in STOPS or _BREAK.match(text, at) or terminated(part):
                    continue
                if text[at : at + 1] == "\n" or part[-1] == "\n":
                    continue
                if draw.random() < 0.25:
                    part = part.rstrip() + draw.choice(MARKS)
                at_limit = before + len(part) + (0 if draw.random() < 0.5 else draw.randrange(1, 400)) if limit and draw.random() < 0.5 else 0
                put(part, at_limit, 1)
        if not rows:
            return cls(np.zeros(1 << BITS), -50.0, glue, threshold)
        return cls(*cls._train(rows, np.array(labels, dtype=np.float64), epochs, seed), glue, threshold)

    @staticmethod
    def _train(rows: list[list[int]], y: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
        width = max(map(len, rows))
        spare = 1 << BITS  # a slot that short rows point to
        x = np.full((len(rows), width), spare, dtype=np.int64)
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        w, g2 = np.zeros(spare + 1), np.full(spare + 1, 1e-3)
        bias, b2 = 0.0, 1e-3
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for at in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
                p = 1 / (1 + np.exp(-(w[x[at]].sum(axis=1) + bias)))
                err = p - y[at]
                grad = np.repeat(err, width)
                own = x[at].ravel()
                ids, back = np.unique(own, return_inverse=True)
                total = np.bincount(back, grad) / len(at) + 1e-5 * w[ids]
                g2[ids] += total**2
                w[ids] -= 0.12 * total / np.sqrt(g2[ids])
                w[spare] = 0.0
                g = err.mean()
                b2 += g * g
                bias -= 0.12 * g / np.sqrt(b2)
        return w[:spare].astype(np.float32), float(bias)


def field_limits(values: DataFrame, least: int = 8, times: float = 6.0, share: float = 1e-4) -> dict[tuple[str, str], list[int]]:
    """Lengths at which the values of a source's field pile up: {(source, field): lengths}.

    A length is a limit if ``least`` values or more have it, a ``share`` of the field's values or more, and ``times`` as many
    as have each of the lengths next to it on average. Counted over all values of any length. A field has at most
    1 / ``share`` limits, so what is collected doesn't grow with the values.
    """
    counts = values.filter("text IS NOT NULL").groupBy("source", "field", F.length("text").alias("n")).agg(F.count("*").alias("k"))
    near = Window.partitionBy("source", "field").orderBy("n").rangeBetween(-8, 8)
    spikes = counts.withColumns({"around": F.sum("k").over(near), "top": F.max("k").over(near), "all": F.sum("k").over(Window.partitionBy("source", "field"))}).filter(
        (F.col("n") >= 40) & (F.col("k") == F.col("top")) & (F.col("k") >= least) & (F.col("k") >= share * F.col("all")) & (F.col("k") >= times * (F.col("around") - F.col("k")) / 16)
    )
    limits: dict[tuple[str, str], list[int]] = {}
    for r in spikes.select("source", "field", "n").collect():
        limits.setdefault((r["source"], r["field"]), []).append(int(r["n"]))
    return {k: sorted(v) for k, v in limits.items()}


def limit_of(length: int, limits: list[int]) -> int:
    at = bisect_left(limits, length)
    return limits[at] if at < len(limits) else 0


def fit_cut_model(values: DataFrame, limits: dict, sample: int = 16_000, **options) -> CutModel:
    """A model from ``sample`` different rows of ``values`` (source, field, text, and others), those with the least hashes of all.

    So the sample has that many rows, or all, whatever their number; a value that a third of the rows have is a third of
    it. Only the fit is on a sample.
    """
    hashed = values.filter("text IS NOT NULL").select("source", "field", "text", F.xxhash64(*values.columns, F.lit(11)).alias("h"))
    total = hashed.count()
    if not total:
        return CutModel.fit([], [], [], **options)
    least: list[int] = []
    for part in (4 * sample / total, 1.0):  # four times as many as are needed will do, but for repeated rows
        if len(least) < sample:
            upto = hashed if part >= 1 else hashed.filter(F.col("h") < F.lit(int(-(2**63) + part * 2**64)))
            least = [r["h"] for r in upto.select("h").distinct().orderBy("h").limit(sample).collect()]
            if part >= 1:
                break
    drawn = hashed.filter(F.col("h") <= least[-1]).dropDuplicates(["h"]).groupBy("source", "field", "text").agg(F.count("*").alias("n"))
    rows = sorted((r["source"] or "", r["field"] or "", r["text"], r["n"]) for r in drawn.collect())
    limits_of = [limit_of(len(r[2]), limits.get(r[:2], [])) for r in rows]
    return CutModel.fit([r[2] for r in rows], limits_of, [r[3] for r in rows], **options)


def _scored(model, limits: dict, keep: float | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model.value
        for batch in batches:
            texts = batch["text"].tolist()
            near = [limit_of(len(t), limits.get((s, f), [])) for t, s, f in zip(texts, batch["source"], batch["field"])]
            out = batch.drop(columns="text").assign(score=own.score(texts, near))
            yield out[out["score"] >= keep] if keep is not None else out

    return run


def score_cuts(values: DataFrame, model: CutModel, limits: dict, cut_only: bool = False) -> DataFrame:
    """``values`` (source, field, text, and other columns) without text, with ``score``, the probability of a cut.

    Rows with a null text are left out; an empty or blank text scores 0, as nothing shows that it was longer. Rows
    come out as often as they come in. A column that is called score already is replaced. One pass without an exchange; the broadcast model has 2^18 weights.
    """
    spark = values.sparkSession
    values = values.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema if f.name != "text")
    shared = spark.sparkContext.broadcast(model)
    run = _scored(shared, limits, model.threshold if cut_only else None)
    return values.dropna(subset=["text"]).mapInPandas(run, f"{schema}, score double")
