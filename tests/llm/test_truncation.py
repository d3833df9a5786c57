import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.llm.truncation import CutModel, field_limits, fit_cut_model, limit_of, score_cuts, stand_in, terminated

SUBJECTS = ["bond yields", "court rulings", "ferry timetables", "gene editing", "medieval guilds", "reading lists", "blood pressure", "memory leaks"]
FORMS = [
    "The link between {} and {} looked weaker than the first report suggested.", "Most of what was written on {} left out {}.", "Three of the sources disagree on {}; none of them doubts {}.",
    "A short list of open points would start with {} and end with {}.", "Spending on {} rose by 23 percent, mainly because of {}.", "Without {}, the picture of {} would stay incomplete.",
]


def texts(n, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        t = " ".join(draw.choice(FORMS).format(*draw.sample(SUBJECTS, 2)) for _ in range(draw.randint(1, 4)))
        out.append(t if draw.random() < 0.8 else t[:-1] if draw.random() < 0.5 else t + "\nOverall: moderate")
    return out


def cut(text, draw):
    at = draw.randrange(len(text) // 3, len(text) - 2)
    return text[:at] if text[at] not in ".\n" and text[at - 1] not in ".\n " and text[at + 1] != "\n" else None


@pytest.fixture(scope="module")
def model():
    own = texts(2500, 1)
    return CutModel.fit(own, [0] * len(own))


def test_held_out_accuracy(model):
    draw = random.Random(7)
    whole = texts(1500, 2)
    broken = [c for t in texts(1500, 3) if (c := cut(t.split("\nOverall")[0], draw))]
    false = (model.score(whole, [0] * len(whole)) >= 0.5).mean()
    found = (model.score(broken, [0] * len(broken)) >= 0.5).mean()
    assert false < 0.02 and found > 0.93


def test_marks_and_stand_ins(model):
    marked = ["Most of what was written on bond yields left o…", "Spending on court rulings rose by 23 perc [...]", "Without memory leaks, the pict\\n"]
    assert (model.score(marked, [0] * 3) > 0.5).all()
    assert (model.score(["", "  ", "n/a", "null", "..."], [0] * 5) < 0.01).all()
    assert stand_in("N/A") and stand_in(" - ") and not stand_in("no personal data at all") and terminated("He said “yes.”") and not terminated("so far...")


def test_spark_path(spark):
    draw = random.Random(9)
    rows = [(i, "t", "a", t, "b1") for i, t in enumerate(texts(1200, 4))] + [(9000 + i, "t", "a", (t + " " + t)[:120], "b1") for i, t in enumerate(u for u in texts(200, 5) if len(u) > 130) if i < 60]
    rows += [(20000, None, "a", "fine text.", None), (20001, "t", "a", None, "b1"), (20002, "t", "a", "", "b1"), (20003, "t", "a", "long text " * 30_000, "b1"), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "row_id long, source string, field string, text string, backend string, score double").repartition(3)
    limits = field_limits(df)
    assert limits["t", "a"] == [120] and limit_of(100, [120]) == 120 and limit_of(200, [120]) == 0
    fitted = fit_cut_model(df, limits, sample=5000)
    out = score_cuts(df, fitted, limits).collect()
    assert len(out) == len(rows) - 1 and "text" not in out[0].asDict()
    by = {r.row_id: r.score for r in out}
    assert by[20002] < 0.01 and sum(by[9000 + i] > 0.5 for i in range(60)) > 50 and sum(by[i] > 0.5 for i in range(1200)) < 30
    assert draw and score_cuts(df.limit(0), fitted, limits).isEmpty()
    empty = df.limit(0)
    assert field_limits(empty) == {} and score_cuts(df, fit_cut_model(empty, {}), {}, cut_only=True).isEmpty()


#: Sentences of other forms and of other words than those that the model of the next test is fitted on.
ELSEWHERE = [
    "We moved the {} into the spare room because the {} kept falling over.", "Nobody on the committee remembered who had ordered the {}, or why the {} came with it.", "If the {} arrives before noon, please put it next to the {}.",
    "Her {} was older than the house, and so was the {}.", "After lunch they painted the {} green and left the {} as it was.", "Does anyone still know how the {} used to work with a {}?",
    "Most visitors walk past the {} without a glance at the {} behind it.", "You can rent a {} at the harbour for as long as your {} lasts.", "The old {} had been sold twice, once together with a {}.", "There was a {} on the table, and under it lay the {} we had been looking for.",
]
THINGS = ["ladder", "piano", "wooden box", "bicycle", "tall lamp", "garden gate", "kettle", "radio", "canoe", "typewriter", "blanket", "mirror"]


def elsewhere(n, seed, forms):
    draw = random.Random(seed)
    return [" ".join(draw.choice(forms).format(*draw.sample(THINGS, 2)) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def test_held_out_templates():
    """Fitted on five forms and the others' texts; scored on five forms that no text of the fit has."""
    own = texts(2500, 1) + elsewhere(1500, 2, ELSEWHERE[:5])
    fitted = CutModel.fit(own, [0] * len(own))
    draw = random.Random(3)
    whole = elsewhere(1000, 4, ELSEWHERE[5:])
    broken = [c for t in elsewhere(1000, 5, ELSEWHERE[5:]) if (c := cut(t, draw))]
    false, found = (fitted.score(whole, [0] * len(whole)) >= 0.5).mean(), (fitted.score(broken, [0] * len(broken)) >= 0.5).mean()
    assert false < 0.02 and found > 0.8


def test_long_texts_are_scored_as_fitted():
    text = " ".join(texts(60, 8))  # more than is looked at
    long = "x " * 5000 + "``` " + text
    model = CutModel(np.random.default_rng(1).standard_normal(1 << 18), 0.0, frozenset({"the"}), 0.5)
    assert len(text) > 2_000 and model.score([long], [len(long) + 2])[0] == model.score(["y " * 5000 + "yyyy" + text], [len(long) + 2])[0]


def test_sample_is_full_at_any_size(spark):
    """There is no share that could come to nothing, and rows that are the same take one place."""
    df = spark.range(3000).select(F.lit("t").alias("source"), F.lit("a").alias("field"), F.concat(F.lit("Value "), F.col("id") % 1000).alias("text"), "id")
    same = spark.range(20_000).select(F.lit("t").alias("source"), F.lit("a").alias("field"), F.lit("The same row.").alias("text"), F.lit(-1).cast("long").alias("id"))
    seen, fit = {}, CutModel.fit
    try:
        CutModel.fit = classmethod(lambda cls, texts, limits, counts, **o: seen.update(zip(texts, counts)))
        for n in (50, 900, 3001, 5000):
            seen.clear()
            fit_cut_model(df.unionByName(same), {}, sample=n)
            assert sum(seen.values()) == min(n, 3001) and seen.get("The same row.", 1) == 1
    finally:
        CutModel.fit = fit


def test_limits_of_any_length_and_number(spark):
    lengths = [50 * k for k in range(1, 20)] + [1_500_000]
    df = spark.createDataFrame([("s", "f", n) for n in lengths], "source string, field string, n int")
    values = df.select("source", "field", F.expr("repeat('x', n)").alias("text"), F.explode(F.sequence(F.lit(1), F.lit(9))))
    assert field_limits(values) == {("s", "f"): lengths}
    assert limit_of(120, [100, 120, 200]) == 120 and limit_of(121, [100, 120, 200]) == 200 and limit_of(201, [200]) == 0
