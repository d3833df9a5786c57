import random

import numpy as np
import pyarrow as pa
import pytest

from promptloom.llm.subjects import SubjectModel, SubjectReader, _words_of, assign_subjects, digamma, fit_subject_model, map_topics, read_subjects, word_groups

TERMS = {
    "finance": ["bond", "yields", "credit", "loan", "dividend", "pension"], "law": ["court", "ruling", "lease", "notary", "contract", "verdict"],
    "sport": ["penalty", "relay", "league", "marathon", "referee", "stadium"], "travel": ["ferry", "hostel", "luggage", "visa", "airport", "island"],
}


def sentence(draw, subject):
    a, b = draw.sample(TERMS[subject], 2)
    return draw.choice(["Most of what was written on {} left out {}.", "The link between {} and {} looked weaker than expected.", "Spending on {} rose because of {}."]).format(a, b)


def corpus(n, seed):
    draw, rows = random.Random(seed), []
    for i in range(n):
        own = draw.sample(sorted(TERMS), draw.choice([1, 1, 2]))
        parts = [sentence(draw, s) for s in own for _ in range(3)] + ["Please see the earlier message.", "More will follow next week."]
        if draw.random() < 0.3:
            parts.append(sentence(draw, draw.choice([s for s in TERMS if s not in own])))  # in passing
        draw.shuffle(parts)
        rows.append((i, " ".join(parts), set(own)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(400, 1)


@pytest.fixture(scope="module")
def labels(spark, rows):
    labelled = [(i, s, "r") for i, _, own in rows[:80] for s in own] + [(3, "unknown", "r"), (99_999, "law", "r"), (None, "law", "r")] + [(i, "law", "r") for i in (5, 6)]
    return spark.createDataFrame(labelled, "doc_id long, subject string, labelled_by string")


def collected(out):
    got = {}
    for r in out.collect():
        assert r[1] not in got.setdefault(r[0], {})
        got[r[0]][r[1]] = r[2]
    return got


def test_subjects(spark, rows, labels):
    draw = random.Random(2)
    odd = [(1000, None), (1001, ""), (1002, "​ \n"), (1003, "More will follow next week."), (1004, sentence(draw, "law")), (1005, sentence(draw, "sport") + " x" * 50_000 + ". " + sentence(draw, "sport")), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(*o, "clash") for o in odd], "doc_id long, text string, subject string").repartition(3)
    got = collected(assign_subjects(docs, labels, "doc_id", "text", sorted(TERMS), topics_each=5))
    wrong = [i for i, _, own in rows[80:] if set(got.get(i, {})) != own]
    assert len(wrong) <= 0.05 * 320
    assert not {1000, 1001, 1002, 1003} & set(got) and set(got[1004]) == {"law"} and set(got[1005]) == {"sport"}
    assert assign_subjects(docs.limit(0), labels, "doc_id", "text", sorted(TERMS)).isEmpty()
    assert assign_subjects(docs, labels.limit(0), "doc_id", "text", sorted(TERMS), topics_each=1, passes=1).isEmpty()
    assert assign_subjects(docs, labels, "doc_id", "text", [], topics_each=1, passes=1).isEmpty()


def test_subjects_come_from_topics(spark, rows, labels):
    """Without the topics' subjects nothing is found, and with these shuffled no more than by chance."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "key long, text string")
    model = fit_subject_model(docs, labels.withColumnRenamed("doc_id", "key"), sorted(TERMS), topics_each=5)
    true = {(i, s) for i, _, own in rows for s in own}
    pairs = lambda got: {(i, s) for i, own in got.items() for s in own}
    found = pairs(collected(read_subjects(model)))
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found)
    named = model.mapped.copy()
    model.mapped = np.where(named >= 0, (named + 1) % len(TERMS), -1)
    moved = pairs(collected(read_subjects(model)))
    assert len(moved & true) <= 0.5 * len(moved)
    model.mapped = np.full(len(named), -1)
    assert not collected(read_subjects(model))
    terms = {s: set(t) for _, s, _, _, t in model.top_terms(5) if s}
    assert all(t & set(TERMS[s]) for s, t in terms.items())


def one(*sentences):
    """A batch of one document whose words are numbers."""
    words = [w for s in sentences for w in s]
    ids, counts = np.unique(words, return_counts=True)
    places = [x for s in sentences for x in [*np.searchsorted(ids, s).tolist(), -1]]
    lists = lambda x: pa.array([list(map(int, x))], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([7]), lists(ids), lists(counts), lists(places)], ["key", "ids", "counts", "places"])


def test_passing_sentences_do_not_count():
    stats = np.full((9, 3), 1e-4)
    for word in range(9):
        stats[word, word // 3] = 100.0  # words 0-2 are of law, 3-5 of sport, 6-8 of no subject
    reader = SubjectReader(SubjectModel(["law", "sport"], list("abcdefghi"), stats, np.array([0, 1, -1]), np.ones(3)))
    found = lambda *s: [int(x) for x in reader.read(one(*s))[1]]
    assert found([0, 1], [1, 2, 7], [3, 4], [6, 8]) == [0]
    assert found([3, 4], [6, 7]) == [1] and found([0, 1], [3, 4]) == [] and found([6, 7]) == []
    assert found([0, 1], [3, 4], [0, 2], [4, 5]) == [0, 1]


def test_words():
    texts = pa.array(["One  Two. Three's 4 foür!) x\x02y\nend", "", "ｅnd — of", "a.b c. d"])
    words = [[w for w in own if w] for own in _words_of(texts).to_pylist()]
    assert words == [["one", "two", "\x01", "three", "s", "foür", "\x01", "x", "y", "\x01", "end", "\x01"], ["\x01"], ["ｅnd", "of", "\x01"], ["a", "b", "c", "\x01", "d", "\x01"]]


def test_parts():
    assert abs(digamma(np.array([1.0, 0.5, 10.0])) - np.array([-0.5772157, -1.9635100, 2.2517526])).max() < 1e-6
    vectors = np.repeat(np.eye(3), 4, axis=0)
    groups = word_groups(vectors, np.ones(12), 3, seed=1)
    assert [len(set(groups[k : k + 4])) for k in (0, 4, 8)] == [1, 1, 1] and len(set(groups)) == 3
    mapped, support = map_topics(np.array([[9.0, 0], [0, 9.0], [5.0, 5.0]]), 0.01, np.array([[4.0, 0], [0, 0], [2.0, 2.0]]))
    assert mapped.tolist() == [0, -1] and support[1] == 0
