"""Subject areas of documents, from the proportions of latent topics in them."""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.sources import materialise

#: Where a sentence ends; marks for that, and for the end of a text.
_END, _MARK, _TEXT = r"[.!?…。][\"'”’»)]*[\s\p{Z}]|\n", "\x01", "\x02"

#: Words of the vocabulary whose sums travel in one row.
SLICE = 4_096
#: Entries (documents x words) that the topics are inferred for at once, which bounds a worker's memory.
ENTRIES = 1 << 13


# Words ----------------------------------------------------------------------------------------------------------------

READ = "kind int, key {kind}, words array<long>, h long, word string, n long, total long"


def _hashed(word: str) -> int:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) or 1
    return h - (1 << 64) if h >= 1 << 63 else h


@functools.cache
def _letters() -> np.ndarray:
    """Of each character, whether it is a letter, a mark on one, or one of our own marks."""
    return np.array([c < 3 and c > 0 or chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)])


def _words_of(texts: pa.Array) -> pa.ListArray:
    """Each text's words, in lower case, with a mark where a sentence or the text ends; some are empty."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=f"[{_MARK}{_TEXT}]", replacement=" ")
    marked = pc.replace_substring_regex(plain, pattern=_END, replacement=f" {_MARK} ")
    joined = "".join(f"{t} {_MARK}{_TEXT}" for t in marked.to_pylist())[:-1]
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    parted = np.where(_letters()[codes], codes, np.uint32(ord(" "))).tobytes().decode("utf-32-le")
    return pc.split_pattern(pa.array(parted.split(_TEXT), pa.string()), pattern=" ")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its words' hashes with a 0 where a sentence ends; and in how many of this batch's texts each word is, and how often."""
    for batch in batches:
        key, kind = batch.column("key"), batch.column("key").type
        split = _words_of(batch.column("text"))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        kept = np.array([len(w) >= 3 or w == _MARK for w in words], dtype=bool)
        hashes = np.array([0 if w == _MARK else _hashed(w) if k else 0 for w, k in zip(words, kept)], dtype=np.int64)
        flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(key)), split.value_lengths().to_numpy(zero_copy_only=False))
        inside = kept[flat]
        flat, doc = flat[inside], doc[inside]
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(key))))
        pairs = np.sort(doc * max(1, len(words)) + flat)
        of_texts = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] % max(1, len(words)), minlength=len(words))
        total = np.bincount(flat, minlength=len(words))
        told = [i for i, w in enumerate(words) if kept[i] and w != _MARK]
        for n, columns in (
            (len(key), (key, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[flat], pa.int64())), None, None, None, None)),
            (len(told), (pa.nulls(len(told), kind), None, pa.array(hashes[told]), coded.dictionary.take(pa.array(told, pa.int64())), pa.array(of_texts[told]), pa.array(total[told]))),
        ):
            types = (kind, pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.int64())
            rest = [pa.nulls(n, t) if c is None else c for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([pa.array([0 if columns[0] is key else 1] * n, pa.int32()), *rest], ["kind", "key", "words", "h", "word", "n", "total"])


def _coded(shared):
    """Distinct words of each document by their number in the vocabulary, how often each comes, and all words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, numbers = shared.value
        for batch in batches:
            words = batch.column("words")
            flat = words.flatten().to_numpy(zero_copy_only=False)
            sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(order, flat), len(order) - 1)
            code = np.where(order[at] == flat, numbers[at], -2)
            code[flat == 0] = -1
            doc = np.repeat(np.arange(len(sizes)), sizes)
            known = code >= 0
            pair, back, n = np.unique(doc[known] * len(order) + code[known], return_inverse=True, return_counts=True)
            owner = pair // len(order)
            first = np.searchsorted(owner, np.arange(len(sizes)))
            place = np.full(len(code), -1)
            place[known] = back - first[doc[known]]
            kept = known | (code == -1)
            ends = np.append(first, len(owner))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), _lists(pair % len(order), ends), _lists(n, ends),
                    _lists(place[kept], np.append(0, np.cumsum(np.bincount(doc[kept], minlength=len(sizes))))),
                ],
                ["key", "ids", "counts", "places"],
            )

    return run


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


# Topics ---------------------------------------------------------------------------------------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    """By its recurrence and the series for large values; to about seven digits above 0.01."""
    out, y = np.zeros_like(x), x.copy()
    for _ in range(5):
        out -= 1 / y
        y += 1
    i = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i / 252))


def word_weights(stats: np.ndarray, eta: float) -> np.ndarray:
    """exp E[log p(word | topic)] for the words' expected counts (words x topics)."""
    own = stats + eta
    return np.exp(digamma(own) - digamma(own.sum(axis=0))).astype(np.float32)


def infer(weights: np.ndarray, counts: np.ndarray, alpha: float, steps: int) -> np.ndarray:
    """The factors (documents, topics) that split each document's words among the topics, by variational Bayes.

    ``weights`` (documents, words, topics) are those of each document's words, ``counts`` (documents, words) how often
    each comes, 0 for padding.
    """
    gamma = np.full((len(counts), weights.shape[2]), alpha, dtype=np.float32) + counts.sum(axis=1, keepdims=True) / weights.shape[2]
    for _ in range(steps):
        theta = np.exp(digamma(gamma)).astype(np.float32)
        ratio = counts / (np.matmul(weights, theta[:, :, None])[:, :, 0] + np.float32(1e-30))
        gamma = np.float32(alpha) + theta * np.matmul(ratio[:, None, :], weights)[:, 0, :]
    return np.exp(digamma(gamma)).astype(np.float32)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of similar length together: their numbers in the batch, words and counts, padded with counts of 0."""
    ids, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "counts"))
    sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[np.searchsorted(sizes[order], 1) :]
    at = 0
    while at < len(order):
        # The longest decides the width; so take as many as fit with the longest among them.
        width = np.arange(1, len(order) - at + 1) * sizes[order[at:]]
        own = order[at : at + max(1, int(np.searchsorted(width, ENTRIES, side="right")))]
        n = int(sizes[own[-1]])
        inside = np.arange(n) < sizes[own][:, None]
        take = np.where(inside, starts[own][:, None] + np.arange(n), starts[own][:, None])
        yield own, ids[take], np.where(inside, counts[take], 0).astype(np.float32)
        at += len(own)


def _summed(coded: DataFrame, size: int, width: int, each: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each word (``size`` of them), the sum over all documents of a factor times the document's vector.

    ``each`` gives, for a block's words and counts, the factors (documents, words) and vectors (documents, ``width``). As
    many tasks as the cluster runs at once hold one matrix each; its slices are added up by an exchange, so the driver gets
    one matrix, whatever the number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for batch in batches:
            for _, ids, counts in _blocks(batch):
                factors, vectors = each(ids, counts)
                order = np.argsort(ids, axis=None, kind="stable")
                sorted_ids = ids.ravel()[order]
                starts = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
                terms = vectors[order // ids.shape[1]]
                terms *= factors.ravel()[order][:, None]
                total[sorted_ids[starts]] += np.add.reduceat(terms, starts, axis=0)
        slices = [k for k in range(0, size, SLICE) if total[k : k + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([total[k : k + SLICE].tobytes() for k in slices], pa.binary())], ["slice", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "sums": [sum(np.frombuffer(x) for x in group["sums"]).tobytes()]})

    parts = coded.sparkSession.sparkContext.defaultParallelism
    partial = coded.select("ids", "counts").coalesce(parts).mapInArrow(run, "slice int, sums binary")
    out = np.zeros((size, width))
    for k, sums in partial.groupBy("slice").applyInPandas(add, "slice int, sums binary").collect():
        out[k : k + SLICE] = np.frombuffer(sums).reshape(-1, width)
    return out


def word_groups(vectors: np.ndarray, weight: np.ndarray, groups: int, seed: int, steps: int = 25, starts: int = 10) -> np.ndarray:
    """The group of each word: spherical k-means of the words' contexts, the best of ``starts`` from far-apart heavy words."""
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    best, kept = -1.0, np.zeros(len(vectors), dtype=np.int64)
    for start in range(starts):
        centres = _far_apart(vectors, weight, groups, np.random.default_rng((seed, start)))
        for _ in range(steps):
            group = (vectors @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, group, vectors * weight[:, None])
            lengths = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-12), centres)
        if lengths.sum() > best:  # how close the words are to their centres, by weight
            best, kept = float(lengths.sum()), (vectors @ centres.T).argmax(axis=1)
    return kept


def _far_apart(vectors: np.ndarray, weight: np.ndarray, groups: int, draw: np.random.Generator) -> np.ndarray:
    centres = vectors[[int(np.argmax(weight))]]
    away = np.maximum(1 - vectors @ centres[0], 0)
    while len(centres) < min(groups, len(vectors)):
        p = weight * away**2
        if p.sum() <= 1e-9:
            break
        tried = draw.choice(len(weight), size=8, p=p / p.sum())
        left = [np.minimum(away, np.maximum(1 - vectors @ vectors[j], 0)) for j in tried]
        best = int(np.argmin([(weight * x).sum() for x in left]))
        centres, away = np.vstack([centres, vectors[tried[best]]]), left[best]
    return centres


@dataclass
class SubjectModel:
    """Topics fitted on all documents, each with the subject that its top terms speak for."""

    subjects: list[str]
    vocabulary: list[str]
    stats: np.ndarray  # words x topics, expected counts
    mapped: np.ndarray  # subject of each topic, -1 for none
    support: np.ndarray  # share of its subject in what a topic's top terms say
    coded: DataFrame | None = None  # the documents in the vocabulary
    alpha: float = 0.1
    eta: float = 0.01

    @property
    def weight(self) -> np.ndarray:
        """Of each topic, its part of the corpus."""
        return self.stats.sum(axis=0) / max(self.stats.sum(), 1e-300)

    def top_terms(self, n: int = 20) -> list[tuple[int, str | None, float, float, list[str]]]:
        lead = leading(self.stats, self.eta)
        order = np.argsort(-lead, axis=0)[:n]
        return [
            (k, self.subjects[s] if s >= 0 else None, float(self.support[k]), float(self.weight[k]), [self.vocabulary[i] for i in order[:, k]])
            for k, s in enumerate(self.mapped)
        ]


def leading(stats: np.ndarray, eta: float) -> np.ndarray:
    """How much each word sets a topic apart from the corpus: p(word | topic) log of its lift."""
    own = (stats + eta) / (stats + eta).sum(axis=0)
    corpus = (own * (stats.sum(axis=0) / max(stats.sum(), 1e-300))).sum(axis=1, keepdims=True)
    return own * np.log(np.maximum(own / np.maximum(corpus, 1e-300), 1e-9))


def map_topics(stats: np.ndarray, eta: float, told: np.ndarray, terms: int = 20, least: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """(subject of each topic or -1, support), by looking up each topic's ``terms`` top terms.

    ``told`` (words x subjects) says in how many documents of a subject's examples each word is. A term speaks for the
    subjects whose examples hold it more than others do; a topic gets the one that ``least`` of its terms' weight is for.
    """
    base = np.maximum(told.sum(axis=0), 1.0)
    base = base / base.sum()
    lead = leading(stats, eta)
    mapped, support = np.full(stats.shape[1], -1), np.zeros(stats.shape[1])
    for k in range(stats.shape[1]):
        votes = np.zeros(told.shape[1])
        for i in np.argsort(-lead[:, k])[:terms]:
            if told[i].sum() and lead[i, k] > 0:
                lifted = told[i] / base
                votes += lead[i, k] * lifted / lifted.sum()
        if votes.sum():
            votes /= votes.sum()
            support[k] = votes.max()
            mapped[k] = int(votes.argmax()) if votes.max() >= least else -1
    return mapped, support


def fit_subject_model(
    documents: DataFrame, labels: DataFrame, subjects: list[str], topics_each: int = 10, passes: int = 2, steps: int = 5,
    share: float = 1 / 5_000, dimensions: int = 128, alpha: float = 0.1, eta: float = 0.01, seed: int = 3,
) -> SubjectModel | None:
    """Fit ``topics_each`` latent Dirichlet topics for each subject on all documents, and name them.

    ``documents`` has key and text, ``labels`` key and subject. Each text is split into words once. The vocabulary are
    the words of three documents and of ``share`` of them or more, so there are at most (distinct words of a document) /
    ``share``, however many documents there are; rarer words have no part in a topic.

    Topics begin as groups of words with like contexts: the sums, over all documents, of a random projection of the other
    words in the document, weighted for rarity. Then come ``passes`` rounds of variational Bayes over all documents, each a
    distributed E step with ``steps`` inner steps and one M step. No labels have a part in this. A topic is named by
    what its top terms say; labels serve as the examples in which these are looked up.

    Collected are the vocabulary, and matrices of its words by ``dimensions``, topics or subjects.
    """
    spark = documents.sparkSession
    kind = documents.schema["key"].dataType.simpleString()
    read = materialise(documents.select("key", "text").dropna(subset=["text"]).mapInArrow(_read, READ.format(kind=kind)), "words")
    n = read.filter("kind = 0").count()
    counts = read.filter("kind = 1").groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n"), F.sum("total").alias("total")).filter(F.col("n") >= max(3, math.ceil(share * n)))
    found = sorted((r["word"], r["h"], r["n"], r["total"]) for r in counts.collect())
    if not found:
        return None
    vocabulary = [x[0] for x in found]
    hashes, df, total = np.array([x[1] for x in found]), np.array([x[2] for x in found], dtype=np.float64), np.array([x[3] for x in found], dtype=np.float64)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], order))
    coded = read.filter("kind = 0").select("key", "words").mapInArrow(_coded(shared), f"key {kind}, ids array<int>, counts array<int>, places array<int>")
    coded = materialise(coded, "coded")

    size = len(vocabulary)
    rarity = np.log(np.maximum(n / df, 1.0)) ** 2
    projected = (np.random.default_rng(seed).standard_normal((size, dimensions)) * rarity[:, None] / math.sqrt(dimensions)).astype(np.float32)
    sent = spark.sparkContext.broadcast(projected)

    def contexts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, its words' mean projection; the last column counts what part of it each word is itself."""
        here = (counts > 0).astype(np.float32)
        n = np.maximum(here.sum(axis=1, keepdims=True), 1)
        vectors = np.matmul(here[:, None, :], sent.value[ids])[:, 0, :]
        return here / n, np.concatenate([vectors, np.ones((len(ids), 1), dtype=np.float32)], axis=1)

    sums = _summed(coded, size, dimensions + 1, contexts)
    k = topics_each * max(1, len(subjects))
    group = word_groups(sums[:, :-1] - projected * sums[:, -1:], df * rarity + 1e-9, k, seed)
    stats = np.tile(0.15 * total[:, None] / k, (1, k))
    stats[np.arange(size), group] += 0.85 * total
    for _ in range(passes):
        weights = spark.sparkContext.broadcast(word_weights(stats, eta))

        def expected(ids: np.ndarray, counts: np.ndarray, weights=weights) -> tuple[np.ndarray, np.ndarray]:
            """What a word's weights are to be multiplied by for how many of its occurrences come from each topic."""
            own = weights.value[ids]
            theta = infer(own, counts, alpha, steps)
            return counts / (np.matmul(own, theta[:, :, None])[:, :, 0] + np.float32(1e-30)), theta

        stats = _summed(coded, size, k, expected) * weights.value

    at = {s: i for i, s in enumerate(subjects)}
    examples = labels.filter(F.col("subject").isin(subjects)).dropDuplicates(["key", "subject"])
    told = np.zeros((size, len(subjects)))
    for r in examples.join(coded.select("key", F.explode("ids").alias("id")), "key").groupBy("id", "subject").agg(F.count("*").alias("n")).collect():
        told[r["id"], at[r["subject"]]] = r["n"]
    mapped, support = map_topics(stats, eta, told) if len(subjects) else (np.full(k, -1), np.zeros(k))
    return SubjectModel(subjects, vocabulary, stats, mapped, support, coded, alpha, eta)


# Assignment -----------------------------------------------------------------------------------------------------------


class SubjectReader:
    """Gives documents the subjects of the topics that are inferred for them.

    A document's topic proportions, and by them each of its words' topics, are inferred from its words; by the topics'
    subjects they give its subject proportions, and those of each sentence. A subject is one of the document's if
    ``sentences`` of its sentences or more are about it, or if it is the only one that the document touches at all; so one
    that is touched in passing is not. A sentence is about a subject that ``lead`` of its subject proportions are of.
    """

    def __init__(self, model: SubjectModel, sentences: int = 2, lead: float = 0.6, steps: int = 8):
        self.subjects, self.alpha, self.sentences, self.lead, self.steps = model.subjects, model.alpha, sentences, lead, steps
        self.weights = word_weights(model.stats, model.eta)
        self.of = np.zeros((len(model.mapped), len(model.subjects)), dtype=np.float32)
        for k, s in enumerate(model.mapped):
            if s >= 0:
                self.of[k, s] = 1

    def proportions(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each word of each document, the subjects of its topics (the rest of 1 is of topics without one)."""
        own = self.weights[ids]
        theta = infer(own, counts, self.alpha, self.steps)
        own *= theta[:, None, :]
        return np.matmul(own, self.of) / (own.sum(axis=2, keepdims=True) + np.float32(1e-30))

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document's number in the batch, subject's number, share) of all that are assigned."""
        n = len(self.subjects)
        sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        of_word = np.zeros((int(sizes.sum()), n), dtype=np.float32)
        of_document = np.zeros((len(sizes), n))
        for own, ids, counts in _blocks(batch):
            parts = self.proportions(ids, counts)
            inside = counts > 0
            of_word[(starts[own][:, None] + np.arange(ids.shape[1]))[inside]] = parts[inside]
            of_document[own] = (parts * counts[:, :, None]).sum(axis=1)
        places = batch.column("places")
        flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), lengths)
        sentence = np.cumsum(flat < 0) - (flat < 0)
        words = flat >= 0
        numbers, begins = np.unique(sentence[words], return_index=True)
        counts = np.zeros((len(sizes), n), dtype=np.int64)
        if len(numbers) and n:
            mass = np.add.reduceat(of_word[starts[doc[words]] + flat[words]], begins, axis=0)
            best = mass.argmax(axis=1)
            most = mass[np.arange(len(mass)), best]
            about = (most >= 0.5) & (most >= self.lead * mass.sum(axis=1))
            np.add.at(counts, (doc[words][begins][about], best[about]), 1)
        told = counts.sum(axis=1, keepdims=True)
        at, subject = np.nonzero((counts >= self.sentences) | ((counts > 0) & (counts == told)))
        return at, subject, of_document[at, subject] / np.maximum(of_document.sum(axis=1), 1e-30)[at]


def assign_subjects(documents: DataFrame, labels: DataFrame, key: str, text: str, subjects: list[str], **options) -> DataFrame:
    """``key``, subject and share (of the document's subject proportions) of each subject that each document is about.

    ``labels`` has ``key`` and subject of documents labelled by hand, some of them wrongly; it may hold keys that
    ``documents`` lacks, repeated rows, and subjects that are not in ``subjects``, which are not used. Labels only name
    topics. A null, empty or blank text, or one without a word that tells, has no subject and no row. Repeated rows
    come out once. Without labels no topic can be named, and no row comes out. Other columns, whatever their names, are
    not read. A text of any length is read whole.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    model = fit_subject_model(rows, labels.select(F.col(key).alias("key"), "subject"), subjects, **options)
    schema = f"key {kind}, subject string, share double"
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    return read_subjects(model).withColumnRenamed("key", key)


def read_subjects(model: SubjectModel) -> DataFrame:
    """key, subject and share of each subject of the documents that ``model`` was fitted on."""
    coded, model.coded = model.coded, None  # a table can't be sent to workers
    shared = coded.sparkSession.sparkContext.broadcast(SubjectReader(model))
    model.coded = coded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value
        names = np.array(reader.subjects, dtype=object)
        for batch in batches:
            at, subject, share = reader.read(batch)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(names[subject], pa.string()), pa.array(share)], ["key", "subject", "share"])

    kind = coded.schema["key"].dataType.simpleString()
    return coded.mapInArrow(run, f"key {kind}, subject string, share double").dropDuplicates(["key", "subject"])
