import random
from collections import Counter

from promptloom.llm.terms import BurstTrie, mark_terms, normal, term_counts


def test_normal():
    assert normal(" Pass  WORD\treset\n") == "pass word reset" and normal("Kündigung") == "kündigung" and normal("   ") == ""


def test_trie_counts_and_bursts():
    draw, want, trie = random.Random(2), Counter(), BurstTrie(burst_at=4)
    for _ in range(5000):
        term = "".join(draw.choice("ab") for _ in range(draw.randint(1, 9)))
        want[term] += 2
        trie.add(term, 2, 1)
    got = {p + rest: c for p, held in trie.leaves() for rest, c in held.items()}
    assert {t: c[0] for t, c in got.items()} == want and trie.size == len(want)
    assert max(len(held) for _, held in trie.leaves()) <= 4


def brute(rows):
    occurrences, records = Counter(), Counter()
    for terms in rows:
        own = [t for x in terms or [] if x is not None and (t := normal(x))]
        occurrences.update(own)
        records.update(set(own))
    return {(t, occurrences[t], records[t], len(rows)) for t in occurrences}


def test_counts_equal_brute_force(spark):
    draw = random.Random(3)
    rows = [[draw.choice(["Hot", "hot ", None, "", "x" * 50_000]) if draw.random() < 0.4 else f"err-{draw.randrange(4000):x}" for _ in range(draw.randrange(6))] for _ in range(3000)]
    rows += [None, [], ["hot", "HOT"]]
    df = spark.createDataFrame([(r, "clash") for r in rows], "keywords array<string>, term string").repartition(5)
    for most in (50, 200_000):  # small tables are handed out often
        out = term_counts(df, "keywords", most=most, parts=3)
        assert {tuple(r) for r in out.select("term", "occurrences", "records", "of_records").collect()} == brute(rows)
        assert out.count() == len(brute(rows))


def test_marks_and_empty_input(spark):
    counts = spark.createDataFrame([("a", 2, 2, 100), ("b", 9, 8, 100), ("c", 9, 9, 100), ("d", 3, 3, 100)], "term string, occurrences long, records long, of_records long")
    assert {r.term: r.mark for r in mark_terms(counts, 3, 8).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}
    assert term_counts(spark.createDataFrame([], "keywords array<string>"), "keywords").isEmpty()
