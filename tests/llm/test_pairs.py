import random
import re

import pytest

from promptloom.llm import pairs, truncation
from promptloom.llm.language import evidence, other_language
from promptloom.llm.pairs import copies, defective_pairs, masked, opening_classes, shingles, words

SUBJECTS = ["bond yields", "court rulings", "ferry timetables", "gene editing", "medieval guilds", "reading lists", "blood pressure", "memory leaks"]


@pytest.mark.parametrize(
    ("a", "b", "other"),
    [
        ("Compara modelos climáticos con sensores cuánticos en Ikalo.", "Dos equipos de Ikalo volvieron a revisar modelos en 1988.", False),
        ("What are the main risks around bond yields?", "Trois sources se contredisent sur les audits, aucune ne met en doute le reste.", True),
        ("¿Qué se sabe de becas y de matrículas?", "Os dois relatórios mais recentes chegam a conclusões diferentes sobre o mesmo assunto.", True),
        ("Do experts agree on wall plugs?", "No.", False), ("", "anything at all", False), ("Was ist über Zellkulturen bekannt?", "Note: the sources disagree on that and on the rest.", True),
    ],
)
def test_languages(a, b, other):
    assert other_language(evidence(b), evidence(a)) is other


def test_copies():
    q = words("How do bond yields and audits relate?")
    assert copies(q, words('"HOW do  bond yields and audits relate"')) and copies(q, words("The question was: how do bond yields and audits relate? How do bond yields and audits relate?"))
    assert not copies(q, words("How do bond yields and audits relate? They moved together for most of the last ten years.")) and not copies(["yes"], ["yes"]) and not copies([], ["a"])


def test_masking():
    assert masked(words("There is nothing I may say about bond yields."), frozenset({"bond", "yields"})) == "there is nothing i may say about §"


def test_classes_equal_brute_force(spark):
    base = "there is nothing that i am permitted to say in any detail about the matter of § at this point in time".split()
    openings = [" ".join(base), " ".join(["hmm", *base]), " ".join([*base, "sorry"]), " ".join(base[:9]), "yes", "no", "a short list of open points would start with x and end with y"]
    df = spark.createDataFrame([(o,) for o in openings], "opening string")
    got = {r.opening: r.template for r in opening_classes(df).collect()}
    link = lambda a, b: len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    classes = {o: o for o in openings}
    for _ in openings:
        classes = {o: min(classes[p] for p in openings if link(o, p)) for o in openings}
    assert got == classes and len(set(got.values())) == 5


def variants(seed, bases, each):
    draw, out = random.Random(seed), set()
    for b in range(bases):
        base = [f"w{b}x{i}" for i in range(40)]
        for _ in range(each):
            own = list(base)
            for _ in range(draw.choice([0, 1, 1, 2])):
                at = draw.choice([0, 1, len(own) - 1, draw.randrange(len(own))])
                own[at : at + 1] = draw.choice([[], [f"v{draw.randrange(9)}"]])
            out.add(" ".join(own))
    return sorted(out)


def by_brute_force(openings):
    each, classes = {o: shingles(o) for o in openings}, {o: o for o in openings}
    near = {o: [p for p in openings if len(each[o] & each[p]) >= 0.8 * len(each[o] | each[p])] for o in openings}
    while (nexts := {o: min(classes[p] for p in near[o]) for o in openings}) != classes:
        classes = nexts
    return classes


def test_links_to_followers_count(spark):
    rest = "je ne peux pas répondre à cette demande"  # like both others, which aren't like each other
    openings = [f"désolé {rest}", rest, f"malheureusement {rest}", *variants(3, 30, 12)]
    got = {r.opening: r.template for r in opening_classes(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()}
    assert got == by_brute_force(openings)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BUCKET", 2)
    common = [f"c{i}" for i in range(34)]  # brings many into the same buckets, though only pairs are similar
    openings = [" ".join([*x, *common, *[f"w{i}x{j}" for j in range(8)], *y]) for i in range(120) for x, y in (([], []), (["a", "b", "c"], ["x", "y", "z"]))]
    got = {r.opening: r.template for r in opening_classes(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()}
    want = by_brute_force(openings)
    assert got == want and len(set(want.values())) == 120


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_splits_hold_all_similar_together(spark, monkeypatch, parts):
    openings = variants(4, 1, 60)
    monkeypatch.setattr(pairs, "BUCKET", -(-2 * len(openings) // parts))
    large = spark.createDataFrame([(1, o) for o in openings], "band long, opening string")
    found = [set(r.openings) for r in pairs._split(large).collect()]
    each = {o: shingles(o) for o in openings}
    for i, a in enumerate(openings):
        for b in openings[:i]:
            if len(each[a] & each[b]) >= 0.8 * len(each[a] | each[b]):
                assert any(a in x and b in x for x in found)


@pytest.mark.parametrize("size", [400])
def test_defects(spark, size):
    rows, want = [], {}
    for i in range(size):
        a, b = SUBJECTS[i % 8], SUBJECTS[(i * 3 + 1) % 8]
        q = f"What are the main risks around {a} and {b} since {1900 + i}?"
        good = f"The link between {a} and {b} looked weaker than the first report suggested. Spending on {a} rose by {i % 50} percent, mainly because of {b}."
        answer, defect = [
            (good, None), (good[:-1], None), (good[: 60 + i % 20], "truncated"), (q, "copy"), (f"Answer: {q.upper()}", "copy"), ("n/a" if i % 2 else None, "empty"),
            (f"Unfortunately, my guidelines keep me from going any further on {a}.", "refusal"), ("I can't help with this request. Please ask a qualified person instead.", "refusal"),
            ("Trois sources se contredisent sur les audits, aucune ne met en doute le reste de la question.", "language"), ("Not yet.", None),
            (f"I cannot confirm the exact figure, but estimates put {b} at {i} percent of the total. {good}", None),
        ][i % 11]
        rows.append(("t", i, q, [answer] if i % 3 or answer is None else ["Step 1: " + answer] if defect != "truncated" else [good, answer], None, "clash"))
        want[i] = defect
    rows += [("t", 5000, None, ["Open the settings page.", "Save it."], "The window closes as soon as a report is opened.", "x"), ("t", 5001, None, None, None, "x"), ("t", 5001, None, None, None, "x")]
    rows += [("t", 5002, "long question about things", ["word " * 20_000 + "end."], None, "x"), ("t", None, "q", ["a"], None, "x")]
    df = spark.createDataFrame(rows, "table_name string, row_id long, prompt string, parts array<string>, context string, defect string").repartition(3)
    out = defective_pairs(df)
    got = {r.row_id: r.defect for r in out.collect()}
    assert out.count() == len(got) and got.pop(5001) == "empty" and 5000 not in got
    got.pop(5002, None)
    wrong = {i: (want[i], got.get(i)) for i in want if got.get(i) != want[i]}
    assert len(wrong) <= 0.03 * size, wrong
    assert defective_pairs(df.limit(0)).isEmpty()


def test_refusals_are_told_by_recurrence(spark):
    """Templates in words of no list, and content with such words; prompts of one class don't count as unrelated."""
    draw = random.Random(4)
    templates = ["That question lies outside my remit as it was given to me.", "Je dois m'abstenir de toute remarque sur ce dossier précis.", "As per rule 7 this desk remains silent on the matter raised.", "Silence is the only reply that this desk gives on § here."]
    closings = ["Kindly consult a specialist of your choice.", "Wishing you a pleasant afternoon all the same.", "Another topic would be welcome."]
    rows, want = [], {}
    for i in range(600):
        a, b = draw.sample(SUBJECTS, 2)
        q = f"Question {i}: how did {a} of w{draw.randrange(10**6)} develop beside {b} in the year {draw.randrange(1500, 2000)}?"
        more = f" The link between {a} and {b} looked weaker than the first report suggested."
        answer, defect = [
            (templates[i // 6 % 4].replace("§", a) + (" " + draw.choice(closings) if draw.random() < 0.6 else ""), "refusal"),
            ("Sorry for the delay, the refund was sent and we can not find an open balance." + more * (i % 4), None),
            ("I must decline to guess, but the figures rose by 12 percent." + more * (i % 5), None),
            ("Yes, since then.", None), (more.strip() * 1 + more * (i % 3), None), ("It did not." + more * 4, None),
        ][i % 6]
        rows.append(("t", i, q, [answer], None))
        want[i] = defect
    again = "How did the ferry timetables of the northern islands develop beside the reading lists of all schools in the years after the great war"
    for i in range(30):  # one prompt in variants, so its template has not recurred over unrelated ones
        rows.append(("t", 900 + i, again + "?" * (i % 3), ["Ferries were few and the lists were short then." + (" " + closings[i % 3] if i % 2 else "")], None))
    df = spark.createDataFrame(rows, "table_name string, row_id long, prompt string, parts array<string>, context string").repartition(3)
    got = {r.row_id for r in defective_pairs(df).filter("defect = 'refusal'").collect()}
    true = {i for i, d in want.items() if d == "refusal"}
    assert len(got & true) >= 0.95 * len(true) and not got - true


def odd_texts(n):
    draw = random.Random(7)
    bits = [*".!?…\n\"'”’»)] \t\xa0\x85\x1c\0ßµñ¿ãõäöœêûÀİΣςК日²½٣09aZ_§#`«(-\ud800", " ", " ", " en ", "la ", ". ", "...", "```", "Step 2: ", "não "]
    return ["".join(draw.choices(bits, k=draw.choice([0, 1, 3, 8, 30, 500]))) for _ in range(n)]


def test_words_and_ends_equal_their_patterns():
    for text in odd_texts(3_000):
        assert words(text) == re.findall(r"[^\W_]+", text.casefold())
        full, cut = re.search(rf"[{truncation.STOPS}][{re.escape(truncation.CLOSERS)}]*$", text), re.search(r"(\.\.|…)[\"'”’»)\]]*$", text)
        assert truncation.terminated(text) is bool(full and not cut)
        old = [w for x in re.split(r"(?<=[.!?…])[\"'”’»)]*\s+|\n+", text) if (w := words(x))]
        assert [w for x in pairs._SENTENCES.split(text) if (w := words(x))] == old
        tail, begin = text[-400:], 0
        for m in truncation._BREAK.finditer(tail, 0, max(0, len(tail.rstrip()) - 1)):
            begin = m.end()
        assert truncation.closing(text, 0)[0] == tail[begin:]


def test_equal_endings_are_weighed_once(monkeypatch):
    """Different responses whose last sentences are the same, and a prompt that comes again, are looked at once."""
    fit = [f"The figures for {s} rose by {i} percent." for i in range(40) for s in SUBJECTS]
    model, calls = truncation.CutModel.fit(fit, [0] * len(fit)), []
    monkeypatch.setattr(truncation, "crc32", lambda x, crc=truncation.crc32: calls.append(x) or crc(x))
    checker = pairs.PairChecker(model, {})
    texts = [f"Report {i} says little. The figures for audits rose by a few percent." for i in range(200)]
    got = [checker.check("t", "What of audits?", [x], None)[0] for x in texts]
    assert 0 < len(calls) < 100 and set(got) == {"truncated" if model.score([texts[0]], [0])[0] >= model.threshold else None}


def test_equal_evidence_is_a_tie():
    """A tie isn't decided by how sums of thirds are rounded, but goes to the language seen first."""
    found = evidence("avec niet zijn en une")
    assert max(found, key=found.get) == "fr"


@pytest.mark.parametrize("few", [0, 12, 1_000])
def test_components_of_any_size_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(pairs, "FEW", few)
    for openings in (variants(8, 3, 3), variants(9, 12, 20), ["a", "b c"], []):
        assert pairs.components(openings) == by_brute_force(openings)
