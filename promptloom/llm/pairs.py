"""Prompt and response pairs that are unusable, and why."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.language import evidence, other_language
from promptloom.llm.truncation import CLOSING, CutModel, closing, field_limits, fit_cut_model, limit_of, stand_in
from promptloom.sources import materialise

#: Beginnings of words and phrases by which a speaker declines, by language; apostrophes read as spaces.
#: A tie-break for templates that stand alone or have a closing to themselves, where recurrence can't say whether they answer.
DECLINES = {
    "en": r"\b(can ?(?:no)?t|unable|not able|won t|will not|declin|not possible|permitted|not allowed|guidelines|rules i|rather not|stay away|pass on|beyond what i|outside what i|not be appropriate|left to others|something else|don t comment|no answer|stop here|prefer not|refuse|sorry|apolog)",
    "es": r"\b(no puedo|no me está|no es posible|rechaz|prefiero|fuera de lo que|lo siento|por desgracia|lamento|declin)",
    "fr": r"\b(ne peux|ne puis|impossible|déclin|désolé|malheureusement|sort du cadre|préfère|pas autoris|refus)",
    "de": r"\b(kann ich|kann nicht|nicht äußern|nicht möglich|leider|überlasse|ablehnen|lehne|meinen rahmen|tut mir leid|darf ich|möchte (ich|mich))",
    "pt": r"\b(não posso|não é possível|lamento|infelizmente|desculp|prefiro não|recus)",
    "it": r"\b(non posso|non è possibile|mi dispiace|purtroppo|preferisco|rifiut)",
}
_DECLINE = re.compile("|".join(DECLINES.values()), re.IGNORECASE)
_WORDS = re.compile(r"[^\W_]+")
#: From a sentence's stop, which a search finds faster than what stands behind one; only words are taken from between.
_SENTENCES = re.compile(r"[.!?…\n](?:(?<=\n)|[\"'”’»)]*\s+)")
_AGAIN = re.compile(r"([§#])(?: \1)+")
_STEP = re.compile(r"^\W*(?:(?:step|paso|étape|schritt|passo)\s*)?\d+\s*[.:)\-]\s*", re.IGNORECASE)

SHINGLE, BANDS, ROWS, SIMILAR = 5, 12, 4, 0.8
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**61, BANDS * ROWS, dtype=np.uint64)

#: Hashes of a prompt's shingles that are kept; prompts of one class (0.8) differ in all of them once in 600 times.
LEAST = 4
PROMPT = [f"p{i}" for i in range(LEAST)]
NO_HASHES = (-1,) * LEAST
CHECKED = "table_name string, row_id long, defect string, opening string, closing string, n_sentences int, " + ", ".join(f"{p} long" for p in PROMPT)


#: The same as ``_WORDS`` for texts of Latin-1 as bytes, which most are: what is in no word is a space.
_BETWEEN = bytes(i if _WORDS.match(chr(i)) else 32 for i in range(256))


def words(text: str) -> list[str]:
    low = text.casefold()
    try:
        return low.encode("latin-1").translate(_BETWEEN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORDS.findall(low)


def copies(prompt: list[str], response: list[str], most: int = 4) -> bool:
    """Nothing but the prompt again, once or more, and at most ``most`` words around it."""
    n = len(prompt)
    if n < 3 or len(response) < n:
        return False
    first, i, rest, times = prompt[0], 0, 0, 0
    while i < len(response):
        if response[i] == first and response[i : i + n] == prompt:
            times += 1
            i += n
        else:
            rest += 1
            if rest > most:
                return False
            i += 1
    return times > 0


def masked(sentence: list[str], prompt: frozenset[str]) -> str:
    """A sentence's words, with those of the prompt, which make it differ between prompts, and numbers masked."""
    out = " ".join(["§" if w in prompt else "#" if w.isdigit() else w for w in sentence])
    return _AGAIN.sub(r"\1", out) if "§ §" in out or "# #" in out else out


#: Sentences with which a refusal may be over: itself, and two of courtesy.
BRIEF = 3
#: Words of this length and less are not what a prompt is about.
_SHORT = 3


class Memory(dict):
    """What a function gives for each key, of which a bounded number are remembered."""

    def __init__(self, of: Callable, most: int = 20_000):
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = found = self.of(key)
        return found


def content(part: str) -> str | None:
    """A part of a response without the number of its step; ``None`` if it has no content."""
    step = part[m.end() :] if (m := _STEP.match(part)) else part
    return None if stand_in(step) else step


class Prompt:
    """A prompt's words, those that it is about, and what they say of its language; its least hashes where they are asked for."""

    def __init__(self, text: str | None):
        self.words = words(text or "")
        self.about = frozenset(w for w in self.words if len(w) > _SHORT)
        self.evidence = evidence(text or "", self.words)

    @functools.cached_property
    def least(self) -> tuple[int, ...]:
        return least_hashes(self.words)


class PairChecker:
    """Looks at pairs one by one; the model of cut texts and a memory of repeated texts come with it."""

    def __init__(self, model: CutModel, limits: dict):
        self.model, self.limits = model, limits
        self.contents, self.prompts, self.cuts, self.endings = Memory(content), Memory(Prompt), Memory(self._cut), Memory(self._ends_cut)

    def _ends_cut(self, of: tuple) -> bool:
        return bool(self.model.probability(self.model.weigh(of)) >= self.model.threshold)

    def _cut(self, key: tuple[str, str]) -> bool:
        source, text = key
        end = text[-CLOSING:]
        near = limit_of(len(text), self.limits.get((source, "response"), []))
        return self.endings[closing(end, near, len(text) - len(end))]

    def check(self, source: str, prompt: str | None, parts: Iterable[str | None] | None, context: str | None) -> tuple[str | None, str | None, str | None, int, tuple[int, ...]]:
        """The defect that the pair shows by itself, its masked first and last sentence, how many it has; the prompt's hashes, if it may be a refusal."""
        steps = [s for p in (() if parts is None else parts) if p is not None and (s := self.contents[p]) is not None]
        if not steps:
            return "empty", None, None, 0, NO_HASHES
        response = " ".join(steps) if len(steps) > 1 else steps[0]
        sentences = [w for x in _SENTENCES.split(response) if (w := words(x))] or [[]]
        said = list(chain.from_iterable(sentences))
        asked = self.prompts[prompt]
        if copies(asked.words, said):
            return "copy", None, None, 0, NO_HASHES
        opening = masked(sentences[0], asked.about)
        brief = len(sentences) <= BRIEF  # and may be a refusal
        ending = masked(sentences[-1], asked.about) if brief and len(sentences) > 1 else None
        than = evidence(context) if context is not None else asked.evidence
        defect = None
        if other_language(evidence(response, said), than):
            defect = "language"
        elif self.cuts[source, steps[-1]]:
            defect = "truncated"
        return defect, opening, ending, len(sentences), asked.least if brief else NO_HASHES


def least_hashes(own: list[str]) -> tuple[int, ...]:
    """The least and greatest hashes of a prompt's shingles, as they are and with halves swapped; -1 for one without words.

    Each is the shingle that comes first in an order of its own, as in MinHash.
    """
    if not own:
        return NO_HASHES
    hashes = [crc32(" ".join(own[i : i + SHINGLE]).encode()) for i in range(max(1, len(own) - SHINGLE + 1))]
    swapped = [h >> 16 | (h & 0xFFFF) << 16 for h in hashes]
    return min(hashes), max(hashes), min(swapped), max(swapped)


def _checked(model, limits: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        checker = PairChecker(model.value, limits)
        for b in batches:
            rows = [checker.check(*x) for x in zip(b["table_name"], b["prompt"], b["parts"], b["context"])]
            out = pd.DataFrame([r[:4] for r in rows], columns=["defect", "opening", "closing", "n_sentences"])
            out.insert(0, "table_name", b["table_name"].to_numpy())
            out.insert(1, "row_id", b["row_id"].to_numpy())
            least = np.array([r[4] for r in rows], dtype=np.int64).reshape(-1, LEAST)
            yield out.assign(**{p: least[:, k] for k, p in enumerate(PROMPT)})

    return run


def shingles(opening: str) -> set[int]:
    own = opening.split()
    if len(own) <= SHINGLE:
        return {crc32(opening.encode())}
    own = " ".join(own).encode().split(b" ")
    return {crc32(b" ".join(own[i : i + SHINGLE])) for i in range(len(own) - SHINGLE + 1)}


#: Openings whose hashes are taken at once.
_AT_ONCE = 200


def _bands(openings: list[str]) -> np.ndarray:
    each = [shingles(x) for x in openings]
    begins = np.cumsum([0, *map(len, each[:-1])])
    hashed = np.fromiter(chain.from_iterable(each), dtype=np.uint64)[:, None] * _A + _B
    least = np.minimum.reduceat(hashed >> np.uint64(20), begins, axis=0).reshape(-1, BANDS, ROWS)
    mixed = (least * _A[:ROWS]).sum(axis=2, dtype=np.uint64)
    return (mixed & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        openings = batch["opening"].tolist()
        bands = [row for i in range(0, len(openings), _AT_ONCE) for row in _bands(openings[i : i + _AT_ONCE])]
        yield pd.DataFrame({"opening": openings, "bands": bands})


#: Openings of a bucket of which each is held against all others.
FEW = 12


def alike(own: set[int], other: set[int]) -> bool:
    both = len(own & other)
    return both >= SIMILAR * (len(own) + len(other) - both)


def components(openings: list[str]) -> dict[str, str]:
    """Each opening's head, the least of its component of links of ``SIMILAR`` or more, none of which is lost.

    Similar ones share one of their rarest shingles, of which there are as many as may differ and one more; so only
    those that share one of these are held against each other, and none with a component that it is in already. Of
    ``FEW``, which most buckets have, looking for rare ones takes longer than holding each against all others.
    """
    each = {x: shingles(x) for x in sorted(openings)}
    head: dict[str, str] = {x: x for x in each}

    def root(x: str) -> str:
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    if len(each) <= FEW:
        for (x, own), (y, other) in combinations(each.items(), 2):
            if (low := root(x)) != (high := root(y)) and alike(own, other):
                head[max(low, high)] = min(low, high)
        return {x: root(x) for x in each}
    often = Counter(chain.from_iterable(each.values()))
    index: dict[int, dict[str, list[str]]] = {}  # shingle, head, those of its component that are known by the shingle
    for opening, own in each.items():
        few = [s for s in own if often[s] > 1]
        few = sorted(few, key=lambda s: (often[s], s))[: max(0, differing(len(own)) + 1 - (len(own) - len(few)))]
        for s in few:
            for theirs, members in list(index.get(s, {}).items()):
                if root(theirs) != root(opening) and any(alike(own, each[x]) for x in members):
                    low, high = sorted((root(theirs), root(opening)))
                    head[high] = low
        for s in few:
            groups: dict[str, list[str]] = {}
            for theirs, members in index.get(s, {}).items():
                groups.setdefault(root(theirs), []).extend(members)
            groups.setdefault(root(opening), []).append(opening)
            index[s] = groups
    return {x: root(x) for x in each}


def differing(n: int) -> int:
    """How many of ``n`` shingles a similar opening may lack."""
    return n - math.ceil(SIMILAR * n - 1e-9)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In each bucket, every opening with the head of its component."""
    for batch in batches:
        found = {x for bucket in batch["openings"] for x in components(bucket).items()}
        yield pd.DataFrame(sorted(found), columns=["opening", "head"])


#: Openings of one bucket that a task holds against each other at once.
BUCKET = 5_000


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = [sorted(shingles(x)) for x in batch["opening"]]
        yield batch.assign(shingle=own, least=[differing(len(x)) + 1 for x in own])


def _split(large: DataFrame) -> DataFrame:
    """``openings`` of buckets of at most ``BUCKET``, in one of which are any two similar ones of a band of ``large``."""
    each = large.mapInPandas(_shingled, "band long, opening string, shingle array<long>, least int")
    each = materialise(each.select("band", "opening", "least", F.explode("shingle").alias("shingle")), "shingles")
    often = each.groupBy("band", "shingle").agg(F.count("*").alias("n"))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("n", "shingle"))), F.lit(1), F.first("least"))
    rare = each.join(often, ["band", "shingle"]).groupBy("band", "opening").agg(rarest.alias("rare"))
    rare = materialise(rare.select("band", "opening", F.explode("rare.shingle").alias("shingle")), "rare")
    sizes = rare.groupBy("band", "shingle").agg(F.count("*").alias("n")).filter("n > 1")
    # Two parts together are as large as a bucket; each part goes to its pairs with all parts.
    parts = F.when(F.col("n") > BUCKET, F.ceil(F.col("n") * 2 / BUCKET)).otherwise(1)
    parted = rare.join(sizes, ["band", "shingle"]).withColumn("parts", parts.cast("long")).withColumn("part", F.pmod(F.xxhash64("opening"), "parts"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # With one part only, it is held against itself; else a pair of parts covers what is within each.
    parted = parted.filter((F.col("parts") == 1) | (F.col("part") != F.col("other")))
    pair = [F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    return parted.groupBy("band", "shingle", *pair).agg(F.collect_list("opening").alias("openings")).select("openings")


def opening_classes(openings: DataFrame) -> DataFrame:
    """``opening`` (distinct) and ``template``: the least opening of its class of similar ones (Jaccard 0.8 or more).

    Bands of MinHash bring candidates together; of each bucket come its components of verified links, each opening with
    the component's head, so that nothing is paired off. A bucket of more than ``BUCKET`` openings is split without
    losing a link: by the rarest shingles in it, one of which similar openings share, and what is still as large into
    parts of which each two are held against each other. Classes are the components over all buckets.
    """
    banded = openings.select("opening").mapInPandas(_signatures, "opening string, bands array<long>").select("opening", F.explode("bands").alias("band"))
    left = materialise(banded, "bands")
    sizes = left.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = left.join(sizes.filter(F.col("n") <= BUCKET), "band").groupBy("band").agg(F.collect_list("opening").alias("openings")).select("openings")
    large = sizes.filter(F.col("n") > BUCKET).select("band")
    if not large.isEmpty():
        buckets = buckets.unionByName(_split(materialise(left.join(large, "band"), "large")))
    links = materialise(buckets.mapInPandas(_linked, "opening string, head string").distinct(), "links")
    links = links.filter("opening <> head")
    both = materialise(links.unionByName(links.select(F.col("head").alias("opening"), F.col("opening").alias("head"))).distinct(), "both")
    label = openings.select("opening", F.col("opening").alias("template"))
    while True:  # each takes the least label of its neighbours until none changes; classes are shallow
        near = both.join(label.withColumnRenamed("opening", "head"), "head").groupBy("opening").agg(F.min("template").alias("other"))
        least = F.least("template", F.coalesce("other", "template"))
        nexts = label.join(near, "opening", "left").select("opening", least.alias("template"), (F.col("other") < F.col("template")).alias("changed"))
        nexts = materialise(nexts, "labels")
        if nexts.filter("changed").isEmpty():
            return nexts.select("opening", "template")
        label = nexts.select("opening", "template")


@F.pandas_udf(T.BooleanType())
def declines(openings: pd.Series) -> pd.Series:
    return pd.Series([bool(_DECLINE.search(x)) for x in openings], dtype=bool)


def refusal_openings(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``opening`` of the refusals, and ``closing`` sentences of courtesy that go with them; told by what recurs.

    A courtesy closes brief responses of three or more classes of openings (or, of fewer, three or more that decline in
    words), and hardly ever opens one, as a sentence with content does. A class of similar openings is a refusal if

    * it came after unrelated prompts, that is, such as have none of their least hashes in common,
    * nineteen of twenty of its responses are brief, where sentences with content also open long responses,
    * nine of ten of these say nothing else, or nothing but a courtesy; and a tenth has one, as a short answer has not.

    A class that has a courtesy less often, so that it could be a short answer, is one if it declines in words.
    """
    short = F.col("n_sentences") <= BRIEF
    opened = checked.filter("opening IS NOT NULL").groupBy("opening").agg(
        F.count("*").alias("n"), F.count_if(short).alias("brief"), F.count_if(short & F.col("closing").isNull()).alias("alone"),
        *[f(F.when(F.col(p) >= 0, F.col(p))).alias(f"{name}_{p}") for p in PROMPT for name, f in (("low", F.min), ("high", F.max))],
    )
    opened = materialise(opened, "openings")
    # An opening whose responses go on at length gives content, so its class is not looked for.
    each = opened.filter("brief * 2 >= n")
    classed = materialise(each.join(opening_classes(each), "opening").withColumn("declines", declines("opening")), "classed")
    closed = checked.filter(short & F.col("closing").isNotNull() & F.col("opening").isNotNull()).groupBy("opening", "closing").agg(F.count("*").alias("n"))
    closed = materialise(closed.join(classed.select("opening", "template", "declines"), "opening").groupBy("template", "closing").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("declines"), F.col("n")).otherwise(0)).alias("declining")), "closed")
    closings = closed.groupBy("closing").agg(F.sum("n").alias("n"), F.count("*").alias("templates"), F.sum("declining").alias("declining"))
    closings = closings.filter("templates >= 3 OR (declining >= 3 AND declining * 10 >= n * 9)")
    opens = opened.select(F.col("opening").alias("closing"), F.col("n").alias("opens"))
    closings = materialise(closings.join(opens, "closing", "left").filter("coalesce(opens, 0) * 20 <= n").select("closing"), "closings")
    courteous = closed.join(closings, "closing").groupBy("template").agg(F.sum("n").alias("courteous"))
    unrelated = F.lit(True)
    for p in PROMPT:
        unrelated = unrelated & (F.min(f"low_{p}") < F.max(f"high_{p}"))
    declining = F.sum(F.when(F.col("declines"), F.col("n")).otherwise(0)).alias("declining")
    template = classed.groupBy("template").agg(*[F.sum(c).alias(c) for c in ("n", "brief", "alone")], unrelated.alias("unrelated"), declining)
    recurring = template.filter("unrelated AND brief * 20 >= n * 19").join(courteous, "template", "left").fillna(0, ["courteous"])
    refusing = recurring.filter("(alone + courteous) * 10 >= brief * 9 AND (courteous * 10 >= brief OR declining * 2 >= n)")
    return materialise(classed.join(refusing.select("template"), "template").select("opening"), "refusals"), closings


def defective_pairs(pairs: DataFrame, sample: int = 16_000) -> DataFrame:
    """table_name, row_id and defect of each pair that is unusable.

    ``pairs`` has table_name, row_id, prompt (string), parts (array<string>, the response in one or more pieces) and
    context (string; the text whose language the response should have, or null for the prompt's). A row that comes
    again counts once. Other columns are not read. Empty input gives no rows. A pair has one defect, the first of:

    * empty: no part has content (null, blank, or a stand-in such as "n/a")
    * copy: nothing but the prompt again, whatever its case, white space, punctuation or a few words around it
    * refusal: opens as brief responses to unrelated prompts do time and again, and goes on with no more than courtesies
    * language: function words of another language than the context's; without evidence there is no case
    * truncated: the last part is cut, by the model of ``truncation``, fitted here

    A null prompt makes no defect: the pair can't be a copy, and its language is the context's if there is one.

    The texts are read three times (limits, fit, check) and go through no exchange; what is exchanged are openings,
    combined before it, and the narrow rows of the pairs.
    """
    spark = pairs.sparkSession
    rows = pairs.select("table_name", "row_id", "prompt", "parts", "context").dropna(subset=["row_id"])
    last = F.try_element_at(F.filter("parts", lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(-1))
    ends = rows.select("row_id", F.col("table_name").alias("source"), F.lit("response").alias("field"), last.alias("text")).filter("text IS NOT NULL")
    limits = field_limits(ends)
    model = spark.sparkContext.broadcast(fit_cut_model(ends, limits, sample))
    checked = materialise(rows.mapInPandas(_checked(model, limits), CHECKED), "checked")
    refusals, closings = refusal_openings(checked)
    # Only brief responses can be refusals; the others, and those without an opening, have no key to join on.
    short = F.col("opening").isNotNull() & (F.col("n_sentences") <= BRIEF)
    rest = checked.filter(~short & F.col("defect").isNotNull()).select("table_name", "row_id", "defect")
    refusals = refusals.withColumn("refused", F.lit(True))
    alone = checked.filter(short & F.col("closing").isNull()).join(refusals, "opening", "left").withColumn("courteous", F.lit(True))
    closed = checked.filter(short & F.col("closing").isNotNull()).join(refusals, "opening", "left").join(closings.withColumn("courteous", F.lit(True)), "closing", "left")
    named = F.when(F.col("refused") & F.col("courteous"), "refusal").otherwise(F.col("defect"))
    judged = alone.unionByName(closed).select("table_name", "row_id", named.alias("defect")).filter("defect IS NOT NULL")
    return rest.unionByName(judged).dropDuplicates(["table_name", "row_id"])
