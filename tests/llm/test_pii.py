import datetime

import pytest

from promptloom.llm.feistel import permute, permute_date, permute_format
from promptloom.llm.pii import Detector, NameBits, Redactor, learn_names, name_evidence, redact_texts, validated


def test_permutations_are_permutations():
    for size in (2, 10, 26, 1000, 1234):
        assert sorted(permute(i, size, b"k") for i in range(size)) == list(range(size))
    assert [permute(i, 1000, b"k") for i in range(50)] != [permute(i, 1000, b"other") for i in range(50)]
    assert permute(0, 1, b"k") == 0


def test_format_is_kept():
    out = permute_format("+1 (415) 555-0148 ab-Z", b"k", keep=1)
    assert out[:3] == "+1 " and [c if not c.isalnum() else "x" for c in out] == [c if not c.isalnum() else "x" for c in "+1 (415) 555-0148 ab-Z"]
    digits = lambda s: [c for c in s if c.isdigit()]
    assert digits(permute_format("415-555-0148", b"k")) == digits(permute_format("415.555.0148", b"k"))
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(500)]
    assert len({permute_date(d, b"k") for d in days}) == 500
    with pytest.raises(ValueError):
        permute_date(datetime.date(1800, 1, 1), b"k")


GIVEN, SURNAMES = {"mirela", "tovi", "oriel"}, {"elwaro", "zimault", "wexidge", "lindaro", "brannaro", "marraro"}
CASES = [
    ("Write to a.b+3@mail.example.org now.", ["a.b+3@mail.example.org"], "email"), ("me [at] nope", [], None), ("x.y at post dot example dot net please", ["x.y at post dot example dot net"], "email"),
    ("u_1 (at) web.invalid is mine", ["u_1 (at) web.invalid"], "email"), ("The button Send E-mail @ Once is grey. The @mention fails.", [], None),
    ("Call +1 (415) 555-0148 please", ["+1 (415) 555-0148"], "phone"), ("tel 07700 900113.", ["07700 900113"], "phone"), ("ring 030/23125199", ["030/23125199"], "phone"),
    ("My number is +33 1 99 00 19 80, evenings", ["+33 1 99 00 19 80"], "phone"), ("ring five five five zero one four zero", ["five five five zero one four zero"], "phone"),
    ("The part number is 384.376.7257.", [], None), ("Order 4338037233 was placed on 2025-06-14.", [], None), ("Roughly 1 234 567 890 rows were loaded.", [], None),
    ("SSN 000-16-4417", ["000-16-4417"], "id_number"), ("Batch 682-55-1058 was imported first.", [], None), ("passport X-470-959-05.", ["X-470-959-05"], "id_number"),
    ("My social is 000174014, as requested", ["000174014"], "id_number"), ("The order number is 6405-279-356.", [], None), ("Mi DNI es 00.462.714W.", ["00.462.714W"], "id_number"),
    ("The serial on the box reads SN-4417-22.", [], None), ("We run version 5.55.4.311.", [], None),
    ("We live at 295 Mossgate Road, Pinhal, second door.", ["295 Mossgate Road, Pinhal"], "address"), ("Ship to Flat 11, 134 Brindle Mews, Villaclara.", ["Flat 11, 134 Brindle Mews, Villaclara"], "address"),
    ("Vivo en Calle Ashgrove 141, 2.º B, 99029 Norholt.", ["Calle Ashgrove 141, 2.º B, 99029 Norholt"], "address"), ("in der Larkmoorstraße 372, 00981 Ombreville", ["Larkmoorstraße 372, 00981 Ombreville"], "address"),
    ("J'habite au 244, chemin du Saltmarsh à Pinhal.", ["244, chemin du Saltmarsh à Pinhal"], "address"), ("The map of Main Street loads. It affects 3 of 12 seats. Room 305 North.", [], None),
    ("45B Fenwick Lane, Tovi Lindaro", ["45B Fenwick Lane", "Tovi Lindaro"], None), ("You may ring 202-555-0162 before noon", ["202-555-0162"], "phone"),
    ("Regards, Mirela Elwaro", ["Mirela Elwaro"], "name"), ("i spoke with tovi zimault", ["tovi zimault"], "name"), ("ELWARO, Tovi here again.", ["ELWARO, Tovi"], "name"),
    ("Mr. Wexidge told me to write here.", ["Mr. Wexidge"], "name"), ("Raised by T. Brannaro.", ["T. Brannaro"], "name"), ("We use Harper Street Bundle and the Harper Guide.", [], None),
    ("Regards, Tovi E. Our admin is away.", ["Tovi E."], "name"), ("Mx  Elwaro  Could you", ["Mx  Elwaro"], "name"), ("", [], None), ("\x00 ​", [], None),
]


@pytest.mark.parametrize(("text", "pieces", "type_"), CASES)
def test_pieces(text, pieces, type_):
    spans = Detector(GIVEN, SURNAMES).spans(text)
    assert [text[a:b] for a, b, _ in spans] == pieces
    assert type_ is None or {t for _, _, t in spans} == {type_}


def test_redaction_changes_nothing_else():
    redactor = Redactor(Detector(GIVEN, SURNAMES), b"k")
    text = "Hi, Tovi Elwaro here: +1 (415) 555-0148 or 415-555-0148; order 6405-279-356 stays."
    out, types = redactor.redact(text)
    assert types == ["name", "phone"] and out.startswith("Hi, [NAME ") and out.endswith("; order 6405-279-356 stays.")
    a, b = [x.split("]")[0] for x in out.split("[PHONE ")[1:]]
    assert [c for c in a if c.isdigit()][1:] == [c for c in b if c.isdigit()]  # one number, however it is written
    assert redactor.placeholder("Tovi Elwaro", "name") == redactor.placeholder("ELWARO, Tovi", "name") != redactor.placeholder("Tovi Zimault", "name")


def test_name_evidence():
    assert list(name_evidence("Regards, Mirela Elwaro")) == [("mirela", "elwaro")]
    assert list(name_evidence("My name is ZIMAULT, Tovi.")) == [("tovi", "zimault")]
    assert list(name_evidence("This is holding up our work. Customer Reported that.")) == []


def test_redact_texts(spark):
    rows = [(i, "Regards, Mirela Elwaro") for i in range(5)] + [(9, None), (10, ""), (11, "mirela elwaro reports: " + "all is well. " * 20_000), (11, "again")]
    df = spark.createDataFrame([(*r, ["clash"]) for r in rows], "run_id long, t string, t_types array<string>").repartition(3)
    out = redact_texts(df, ["t"], b"k").collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"run_id", "t", "t_types"}
    by = {r.run_id: r for r in out if r.t != "again"}
    assert (by[9].t, by[9].t_types) == (None, None) and (by[10].t, by[10].t_types) == ("", []) and by[0].t_types == ["name"]
    assert by[11].t.startswith("[NAME ") and by[11].t.count("all is well. ") == 20_000
    assert redact_texts(df.limit(0), ["t"], b"k").isEmpty()


@pytest.mark.parametrize("number", ["five-five-five oh-one-two-three", "five-five-five-oh-one-two-three", "fünf-fünf null-eins zwei-drei vier-acht"])
def test_hyphens_may_join_all_digit_words(number):
    assert Detector(set(), set()).spans(f"ring {number}, please") == [(5, 5 + len(number), "phone")]


def test_marks_tell_pieces_apart():
    mark = lambda piece, type_: Redactor(Detector(set(), set()), b"k").placeholder(piece, type_)
    emails = ["ann.lee@x.com", "lee.ann@x.com", "x.lee@ann.com"]
    assert len({mark(e, "email") for e in emails}) == 3 and mark("Ann.Lee [at] x [dot] com", "email") == mark("ann.lee@x.com", "email") == mark("ann.lee at x dot com", "email")
    assert len(mark("Ann Lee", "name")) == len("[NAME ]") + 32 and mark("Dr. Ann Lee", "name") == mark("LEE, Ann", "name")
    assert mark("12 Mossgate Road", "address") != mark("Road 12 Mossgate", "address")
    with pytest.raises(ValueError):
        Redactor(Detector(set(), set()), b"")


def test_numbers_link_however_they_are_written():
    number = lambda piece: "".join(c for c in Redactor(Detector(set(), set()), b"k").placeholder(piece, "phone") if c.isdigit())
    assert number("+353 87 123 4567").removeprefix("353") == number("087 123 4567").removeprefix("0") and number("+353 87 123 4567")[:3] == "353"
    assert number("five five five oh one two three four") == number("555-0123-4")


def test_validated_numbers_stay_valid():
    own = Redactor(Detector(set(), set()), b"k")
    good = ["123-45-6789", "12345678Z", "12.345.678-Z", "1 84 12 76 451 089 46", "86 095 742 719"]
    for piece in good:
        assert validated(piece), piece
        out = own.placeholder(piece, "id_number")[len("[ID_NUMBER ") : -1]
        assert out != piece and validated(out) and len(out) == len(piece)
    for piece in ["000-00-0000", "666-12-3456", "12345678A", "1 84 12 76 451 089 47", "86 095 742 718"]:
        assert validated(piece) is False and len(own.placeholder(piece, "id_number")) == len("[ID_NUMBER ]") + 32
    assert validated("X-470-959-05") is None
    assert len({own.placeholder(f"123-45-{i:04d}", "id_number") for i in range(1, 300)}) == 299


def test_no_name_is_left_out(spark):
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = spark.createDataFrame([(f"Regards, G{letters(i % 1500)} S{letters(i % 1500)}o",) for i in range(4500)], "t string")
    given, surnames, _ = learn_names(texts, ["t"], log2_bits=22)
    assert all(f"g{letters(i)}" in given and f"s{letters(i)}o" in surnames for i in range(1500))
    assert sum(f"z{letters(i)}" in given for i in range(1500)) <= 2 and isinstance(given, NameBits)
