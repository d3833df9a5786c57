import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.llm import packing, tokens
from promptloom.llm.packing import LocalSearch, best_fit, pack, pack_documents

PATH = tokens.tokenizer_file()
ODD = ["", " ", "\n\n", "​", "x" * 30_000, " " * 9000, "word " * 4000, "<|endoftext|> a", "日本語のテキスト " * 300, "é́  　 don't've", "a\x1cb \x85 c", "🙂👍 " * 500]


def rejoined(text, **cut):
    ends, start, chunks = tokens.cuts(text, **cut), 0, []
    for end in ends:
        chunks.append(text[start:end])
        start = end
    assert "".join(chunks) == text
    parts = [tokens.anatomy(c) for c in chunks]
    bodies = tokens.encode(PATH, [p[2] for p in parts])
    return tokens.join_chunks([(p[0], p[1], b, p[3], p[4]) for p, b in zip(parts, bodies)], lambda x: tokens.encode(PATH, x), lambda ids: tokens.encoder(PATH).decode(ids))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_are_encoded_exactly(text):
    assert rejoined(text, mean=64, least=16, most=300) == tokens.encode(PATH, [text])[0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 1'.\n\t ​é"), st.characters(codec="utf-8")), max_size=800))
def test_any_text_is_encoded_exactly(text):
    assert rejoined(text, mean=16, least=4, most=60) == tokens.encode(PATH, [text])[0]


def test_ranks_and_file_agree():
    by_file, texts = tokens._ByFile(PATH), [*ODD, *(f" a{chr(c)}b {chr(c)}1 {chr(c)}\n" for c in (*range(0, 0xD800, 7), *range(0xE000, 0x20000, 13)))]
    assert by_file.encode(texts) == tokens._ByRanks(PATH.removesuffix(".json") + ".tiktoken").encode(texts)
    assert isinstance(tokens.encoder(PATH), tokens._ByRanks)


def test_recurring_numbers(spark):
    draw = random.Random(3)
    again = [draw.randrange(-(2**63), 2**63) for _ in range(400)]
    once = [draw.randrange(-(2**63), 2**63) for _ in range(400)]
    held = tokens._recurring(spark.createDataFrame([(x,) for x in again * 2 + once], "number long"))
    assert all(x in held for x in again) and sum(x in held for x in once) <= 2


def test_disagreeing_joins_are_encoded_whole():
    calls = []

    def again(texts):  # an encoder that depends on what is around
        calls.append(texts)
        return [[len(t), *map(ord, t)] for t in texts]

    parts = [tokens.anatomy("one two three four "), tokens.anatomy("five six seven eight")]
    out = tokens.join_chunks([(p[0], p[1], [ord(c) for c in p[2]], p[3], p[4]) for p in parts], again, lambda ids: "".join(map(chr, ids)))
    whole = "one two three four five six seven eight"
    assert out == [len(whole), *map(ord, whole)]


def test_passages_are_cut_alike_in_other_documents():
    draw = random.Random(1)
    words = [f"w{draw.randrange(500)}" for _ in range(4000)]
    shared = " ".join(words)
    chunks = lambda t: {t[a:b] for a, b in zip([0, *tokens.cuts(t)], tokens.cuts(t))}
    a, b = chunks("some beginning " + shared), chunks("quite another one, longer too " + shared)
    assert len(a & b) >= 0.8 * len(a)


def test_corpus(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(100, None, 0), (101, "same text here", 0), (101, "same text here", 0), (102, "same text here", 0), (None, "no key", 0)]
    draw = random.Random(8)
    passage = " ".join(f"w{draw.randrange(900)}" for _ in range(1500))
    long = {200 + i: f"{'start ' * i}{passage} and end {i}" for i in range(4)} | {300: passage + "unlike" * 40 + passage}
    rows += [(i, t, 0) for i, t in long.items()] + [(200, long[200], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    out = tokens.encode_corpus(df, "doc_id", "text")
    assert dict(out.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    got = out.collect()
    assert len(got) == len(rows) - 2
    want = dict(zip([*range(len(ODD)), *long], tokens.encode(PATH, [*ODD, *long.values()]))) | {100: []}
    assert all(list(r.ids) == (want[r.doc_id] if r.doc_id in want else tokens.encode(PATH, ["no key" if r.doc_id is None else "same text here"])[0]) for r in got)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").isEmpty()
    counts = {r.doc_id: r.tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts[100] == 0 and counts[4] == len(want[4])


def check(sizes, capacity, bins):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(int(sizes[i]) for i in b) <= capacity for b in bins)


def test_packing_of_random_sizes_is_near_the_bound():
    draw = np.random.default_rng(4)
    for capacity, high in ((100, 60), (512, 400), (50, 50)):
        sizes = draw.integers(0, high + 1, 1500)
        bins = pack(sizes, capacity)
        check(sizes, capacity, bins)
        assert len(bins) <= len(best_fit(sizes[sizes > 0], capacity))
    sizes = np.array([6] * 20 + [4] * 20)
    assert len(pack(sizes, 10)) == 20


def test_local_search_empties_bins():
    sizes = np.array([5, 5, 4, 3, 3])  # best in two bins of ten: 5+5, 4+3+3
    bins = LocalSearch(sizes, [[0, 2], [1, 3], [4]], 10).run()
    check(sizes, 10, bins)
    assert len(bins) == 2
    assert pack(np.array([]), 10) == [] and pack(np.array([0, 0]), 10) == [[0, 1]] and pack(np.array([10, 10]), 10) == [[0], [1]]


def test_pack_documents(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice([0, 3, 17, 40, 99, 100, 101, 350])) for i in range(900)] + [(1000, None), (1001, 7), (1001, 7), (None, 5)]
    sizes = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, n long, piece string").repartition(4)
    kinds = spark.createDataFrame([("s", 100), ("m", 1000), ("bad", 0), ("worse", None)], "container_kind string, capacity_tokens int")
    out = pack_documents(sizes, "doc_id", "n", kinds, block=120).toPandas()
    truth = {(-1 if i is None else i): n or 0 for i, n in rows}
    for kind, capacity in (("s", 100), ("m", 1000)):
        own = out[out.container_kind == kind].assign(doc_id=lambda x: x.doc_id.fillna(-1))
        assert own.groupby("container_id").tokens.sum().max() <= capacity
        assert (own.groupby("container_id").tokens.sum() == own.groupby("container_id").filled.first()).all()
        assert own.groupby("doc_id").tokens.sum().to_dict() == truth
        pieces = own.groupby("doc_id").piece.count()
        assert all(pieces[i] == max(1, -(-n // capacity)) for i, n in truth.items())
        bound = -(-int(own.tokens.sum()) // capacity)
        assert own.container_id.nunique() <= 1.04 * bound + 1
    assert set(out.container_kind) == {"s", "m"}
    assert pack_documents(sizes.limit(0), "doc_id", "n", kinds).isEmpty() and pack_documents(sizes, "doc_id", "n", kinds.limit(0)).isEmpty()


def test_packing_ends_where_nothing_combines(spark, monkeypatch):
    written = packing.materialise

    def counted(df, name):
        assert name != "packed-12", "rounds that close nothing go on"
        return written(df, name)

    monkeypatch.setattr(packing, "materialise", counted)
    rows = [(i, 300) for i in range(300)] + [(1000 + i, 200) for i in range(40)] + [(2000 + i, 40) for i in range(9)]
    kinds = spark.createDataFrame([("a", 512), ("b", 1024)], "container_kind string, capacity_tokens int")
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", kinds, block=60).toPandas()
    for kind, capacity, most in (("a", 512, 302), ("b", 1024, 109)):
        own = out[out.container_kind == kind]
        assert sorted(own.doc_id) == sorted(i for i, _ in rows) and own.groupby("container_id").tokens.sum().max() <= capacity
        assert (own.groupby("container_id").tokens.sum() == own.groupby("container_id").filled.first()).all()
        assert own.container_id.nunique() <= most


def triplets(n, seed):
    """Sizes that fill ``n`` bins of 1,000 exactly, three a bin, which best fit alone doesn't find."""
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = int(draw.integers(380, 490))
        b = int(draw.integers(240, (1000 - a) // 2 + 1))
        out += [a, b, 1000 - a - b]
    return np.array(out)


def test_local_search_earns_containers():
    sizes = triplets(200, 2)
    alone, bins = best_fit(sizes, 1000), pack(sizes, 1000)
    check(sizes, 1000, bins)
    assert len(alone) >= 1.1 * 200 and len(bins) <= 1.05 * 200
    draw = np.random.default_rng(6)
    sizes = draw.integers(200, 700, 1500)
    alone, bins, bound = best_fit(sizes, 1000), pack(sizes, 1000), -(-int(sizes.sum()) // 1000)
    check(sizes, 1000, bins)
    assert len(bins) - bound <= 0.5 * (len(alone) - bound)


def test_best_exchange_is_found_among_all_pairs():
    draw = np.random.default_rng(9)
    for _ in range(60):
        sizes = draw.integers(1, 40, 14)
        bins = [list(range(k, 14, 3)) for k in range(3)]
        capacity = max(int(sizes[b].sum()) for b in bins) + int(draw.integers(1, 9))
        search = LocalSearch(sizes, bins, capacity)
        squares = lambda own: sum(int(sizes[b].sum()) ** 2 for b in own)
        best, fill = 0, [int(sizes[b].sum()) for b in bins]
        for i in bins[0]:
            for c in (1, 2):
                for back in [[], *([j] for j in bins[c]), *([j, k] for j in bins[c] for k in bins[c] if j < k)]:
                    d = int(sizes[i] - sizes[back].sum()) if back else int(sizes[i])
                    if 0 < d <= capacity - fill[c]:
                        best = max(best, (fill[0] - d) ** 2 + (fill[c] + d) ** 2 - fill[0] ** 2 - fill[c] ** 2)
        before = squares(search.bins)
        assert search._improve(0) == (best > 0) and squares(search.bins) - before == best


@pytest.mark.parametrize("n, block", [(60, 20), (5000, 500)])
def test_rounds_end_where_nothing_combines(spark, n, block):
    sizes = spark.range(n).select("id", F.lit(300).alias("n"))
    kinds = spark.createDataFrame([("k", 512)], "container_kind string, capacity_tokens int")
    assert pack_documents(sizes, "id", "n", kinds, block=block).select("container_id").distinct().count() == n
