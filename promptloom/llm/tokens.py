"""Encoding of a corpus with a public tokenizer, each recurring piece of text once."""

from __future__ import annotations

import base64
import importlib.util
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.sources import materialise

#: Where the tokenizers' files lie; ``folder`` overrides it everywhere.
TOKENIZERS = "/opt/tokenizers"

_encoders: dict[str, object] = {}


def tokenizer_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    folder = folder or os.environ.get("PROMPTLOOM_TOKENIZERS") or TOKENIZERS
    if not os.path.isdir(folder) and (found := importlib.util.find_spec("public_tokenizers")):
        folder = os.path.dirname(found.origin)
    return os.path.join(folder, f"{name}.json")


#: Fixed value: the pattern by which byte-level tokenizers split a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _ByFile:
    """A tokenizer file; names of special tokens are ordinary text."""

    #: Characters that are encoded at once: what the library keeps for each token of them is many times their size.
    SLICE = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.own.no_truncation()
        self.own.no_padding()

    def encode(self, texts: list[str]) -> list[list[int]]:
        out, part, size = [], [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= self.SLICE:
                out += [e.ids for e in self.own.encode_batch_fast(part, add_special_tokens=False)]
                part, size = [], 0
        return out + [e.ids for e in self.own.encode_batch_fast(part, add_special_tokens=False)] if part else out

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids, skip_special_tokens=False)


class _ByRanks:
    """The same vocabulary as ranks of byte sequences, which takes a fourth of the time."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.own.encode_ordinary(t) if t else [] for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(list(ids))


def encoder(path: str):
    """The tokenizer at ``path``, loaded once in each Python worker; by its rank file where one lies beside it."""
    if path not in _encoders:
        ranks = f"{path.removesuffix('.json')}.tiktoken"
        _encoders[path] = _ByRanks(ranks) if os.path.exists(ranks) else _ByFile(path)
    return _encoders[path]


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return encoder(path).encode(texts)


# Chunks -------------------------------------------------------------------------------------------------------------

WINDOW = 16
#: Multiplier of the rolling hash: any odd number does that mixes high bits in.
_FACTOR = 0x9E3779B1
#: Characters that are hashed at once.
SPAN = 4_000_000


def cuts(text: str, **options) -> list[int]:
    """Ends of the content-defined chunks of ``text``."""
    return cuts_of([text], **options)[0]


def cuts_of(texts: list[str], mean: int = 512, least: int = 128, most: int = 4096) -> list[list[int]]:
    """Ends of the content-defined chunks of each text.

    A chunk ends after a character where a hash of the last ``WINDOW`` characters falls in one of ``mean`` classes, so
    the same passage is cut alike in every document; chunks shorter than ``least`` are not closed, longer than ``most``
    are. Texts are hashed together, as no end lies within a window of a text's beginning.
    """
    least = max(least, WINDOW)
    out: list[list[int]] = []
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SPAN:
            out += _cut(part, mean, least, most)
            part, size = [], 0
    return out + _cut(part, mean, least, most)


def _cut(texts: list[str], mean: int, least: int, most: int) -> list[list[int]]:
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)
    factor = np.uint32(_FACTOR)
    for shift in (1, 2, 4, 8):  # sums over windows of 2, 4, 8 and 16 characters
        longer = h.copy()
        longer[shift:] += h[:-shift] * factor
        h, factor = longer, np.uint32(int(factor) ** 2 % 2**32)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    hits = np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean) == 0) + 1
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    stops = np.cumsum(lengths)
    spans = np.searchsorted(hits, np.append(0, stops), side="right")
    out = []
    for i, n in enumerate(lengths.tolist()):
        ends, last = [], 0
        if n > least:
            for end in (hits[spans[i] : spans[i + 1]] - (stops[i] - n)).tolist():
                while end - last > most:
                    last += most
                    ends.append(last)
                if end - last >= least and end < n:
                    last = end
                    ends.append(end)
            while n - last > most:
                last += most
                ends.append(last)
        out.append([*ends, n])
    return out


def _hash(chunk: str) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass")))


def _chunked(texts: list[str]) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """Each text's chunks with their hashes."""
    for text, ends in zip(texts, cuts_of(texts)):
        start, own = 0, []
        for end in ends:
            chunk = text[start:end]
            own.append((chunk, _hash(chunk)))
            start = end
        yield own


# Which chunks recur -------------------------------------------------------------------------------------------------


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One number for each document and each of its chunks."""
    for batch in batches:
        numbers = batch.column("row").to_pylist()
        for own in _chunked(batch.column("text").to_pylist()):
            numbers += {c1 for _, (c1, _) in own}
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64())], ["number"])


class Recurring:
    """A set of numbers as bits: holds all that were put in, and a few others, in a size that doesn't grow."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __contains__(self, number: int) -> bool:
        at = number % (len(self.bits) * 8)
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def _recurring(numbers: DataFrame, log2_bits: int = 26) -> Recurring:
    """The numbers that come more than once, as 2^``log2_bits`` bits."""
    size = 1 << log2_bits
    again = numbers.groupBy("number").agg(F.count("*").alias("n")).filter("n > 1").select(F.pmod("number", F.lit(size)).alias("bit"))
    each = again.select(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket"), F.expr("bitmap_bit_position(bit + 1)").alias("at"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for bucket, bitmap in each.groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)")).collect():  # rows of 4 kB, 8 MB in all
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap, dtype=np.uint8)
    return Recurring(bits)


# Joins --------------------------------------------------------------------------------------------------------------
#
# A byte-level tokenizer first splits a text by a pattern each of whose pieces is white space, or a run of other
# characters with at most one space before it. No piece holds white space behind anything else, so one always ends
# where white space follows another character: a "seam". On its two sides a text is encoded apart. So of a chunk all
# between its first seam and its last stays as it is, and only the spans over the joins are encoded again.


def seams(text: str) -> list[int]:
    return [m.end() for m in _SEAM.finditer(text)]


_SEAM = re.compile(r"\S(?=[ \n\t])")


def anatomy(chunk: str) -> tuple[str, str, str, str, str]:
    """head, first piece of the body, body, last piece of the body, tail; without a body all of it is head."""
    own = seams(chunk)
    if len(own) < 2:
        return chunk, "", "", "", ""
    a, b = own[0], own[-1]
    return chunk[:a], chunk[a : own[1]], chunk[a:b], chunk[own[-2] : b], chunk[b:]


def join_chunks(chunks: list[tuple], again, text_of) -> list[int]:
    """Ids of a whole text from its chunks, equal to encoding it at once.

    A chunk is (head, first, ids of the body, last, tail) as in ``anatomy``; ``again(texts)`` encodes texts. A span over
    a join is encoded together with the piece before it and the one behind it. Where these don't come out as they do by
    themselves, the chunks don't agree there, and the whole text, which ``text_of(ids)`` gives back, is encoded again.
    """
    ids: list[list[int]] = []
    spans, around = [], []
    pending, before, kept = "", "", []
    for head, first, body, last, tail in chunks:
        pending += head
        if len(body):
            spans.append(before + pending + first)
            around.append((before, first))
            kept.append(body)
            pending, before = tail, last
    spans.append(before + pending)
    around.append((before, ""))
    if not kept:
        return again(spans)[0] if spans[0] else []
    out = again(spans + [x for pair in around for x in pair])
    n = len(spans)
    for i, span in enumerate(out[:n]):
        a, b = out[n + 2 * i], out[n + 2 * i + 1]
        if span[: len(a)] != a or (b and span[-len(b) :] != b):
            return again(["".join(c[0] + text_of(c[2]) + c[4] for c in chunks)])[0]
        ids.append(span[len(a) : len(span) - len(b)])
        if i < len(kept):
            ids.append(kept[i])
    return [x for part in ids for x in part]


PLACED = "kind int, key {kind}, h long, ids array<int>, at int, c1 long, c2 long, head string, first string, body array<int>, last string, tail string"


def _placed(path: str, shared):
    """Documents that share no chunk, encoded (kind 0); the chunks of others, encoded (1), or named where they recur (2); and these (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring, sent = shared.value, set()
        for batch in batches:
            keys, h, texts = batch.column("key"), batch.column("h").to_pylist(), batch.column("text").to_pylist()
            alone, rows = [], []
            for i, own in enumerate(_chunked(texts)):
                if batch.column("row")[i].as_py() not in recurring and not any(c1 in recurring for _, (c1, _) in own):
                    alone.append(i)
                    continue
                for at, (chunk, (c1, c2)) in enumerate(own):
                    if c1 not in recurring:
                        rows.append((1, i, at, None, None, anatomy(chunk)))
                        continue
                    rows.append((2, i, at, c1, c2, (None,) * 5))
                    if (c1, c2) not in sent:  # once for each task, but for what was forgotten
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add((c1, c2))
                        rows.append((3, None, None, c1, c2, (chunk, None, None, None, None)))
            n = len(alone)
            none = lambda kind: pa.nulls(n, kind)
            ids = encode(path, [texts[i] for i in alone])
            yield _batch(pa.array([0] * n, pa.int32()), keys.take(pa.array(alone, pa.int64())), [h[i] for i in alone], ids, none(pa.int32()), *[none(pa.int64())] * 2, *[none(pa.string())] * 2, none(pa.list_(pa.int32())), *[none(pa.string())] * 2)
            if rows:
                kind, doc, at, c1, c2, parts = zip(*rows)
                head, first, body, last, tail = zip(*parts)
                bodies = iter(encode(path, [x for k, x in zip(kind, body) if k == 1]))
                body = [next(bodies) if k == 1 else None for k in kind]
                yield _batch(kind, keys.take(pa.array(doc, pa.int64())), [None if i is None else h[i] for i in doc], pa.nulls(len(kind), pa.list_(pa.int32())), at, c1, c2, head, first, body, last, tail)

    return run


_INTS = pa.list_(pa.int32())
_COLUMNS = {"kind": pa.int32(), "key": None, "h": pa.int64(), "ids": _INTS, "at": pa.int32(), "c1": pa.int64(), "c2": pa.int64(), "head": pa.string(), "first": pa.string(), "body": _INTS, "last": pa.string(), "tail": pa.string()}


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _COLUMNS.values())], list(_COLUMNS))


def _encoded(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = pd.DataFrame([anatomy(c) for c in batch["chunk"]], columns=["head", "first", "body", "last", "tail"])
            parts["body"] = encode(path, parts["body"].tolist())
            yield pd.concat([batch[["c1", "c2"]].reset_index(drop=True), parts], axis=1)

    return run


def _joined(path: str):
    def again(texts: list[str]) -> list[list[int]]:
        return encode(path, texts)

    def text_of(ids: list[int]) -> str:
        return encoder(path).decode(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parts in batch["parts"]:
                by = {p["at"]: p for p in parts}  # a repeated row's chunks come once
                out.append(join_chunks([(p["head"], p["first"], p["body"], p["last"], p["tail"]) for _, p in sorted(by.items())], again, text_of))
            yield pd.DataFrame({"key": batch["key"], "h": batch["h"], "ids": out})

    return run


def encode_corpus(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of the documents, without special tokens, as if each text were encoded at once.

    A null text and an empty one give an empty list; blank texts are encoded as they are; a text of any length is
    encoded whole. Rows with the same key and the same text are one document; a key with several texts gives a row for
    each. A null key is a key. Other columns, whatever their names, are not read. Empty input gives no rows.

    Texts are cut into content-defined chunks, twice, as cutting costs less than keeping the chunks. The first time only
    their hashes are counted; those that recur are sent to the workers as bits of a fixed number, which may also
    hold a few that don't. A document without a recurring chunk is encoded where it is. Of the others only the
    recurring chunks are exchanged, once for each task, and encoded once; their ids come back by a join on the hash, and
    the joins between chunks are repaired per document. A chunk that a third of the documents share is combined in its
    task before its exchange, and its rows in the join, which are a few longs each, are split by adaptive execution.
    """
    spark = documents.sparkSession
    path = path or tokenizer_file()
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    empty = rows.filter("text = ''").select("key").distinct().withColumn("ids", F.array().cast("array<int>"))
    rows = rows.filter("text <> ''").withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("row", F.xxhash64(F.lit("row"), "key", "h"))
    shared = spark.sparkContext.broadcast(_recurring(rows.select("text", "row").mapInArrow(_named, "number long")))
    placed = materialise(rows.mapInArrow(_placed(path, shared), PLACED.format(kind=kind)), "placed")
    parts = "head string, first string, body array<int>, last string, tail string"
    once = placed.filter("kind = 3").groupBy("c1", "c2").agg(F.first("head").alias("chunk"))
    encoded = once.mapInPandas(_encoded(path), f"c1 long, c2 long, {parts}")
    uses = placed.filter("kind = 2").select("key", "h", "at", "c1", "c2").join(encoded, ["c1", "c2"]).drop("c1", "c2")
    part = F.struct("at", "head", "first", "body", "last", "tail").alias("part")
    pending = uses.select("key", "h", part).unionByName(placed.filter("kind = 1").select("key", "h", part))
    whole = pending.groupBy("key", "h").agg(F.collect_list("part").alias("parts")).mapInPandas(_joined(path), f"key {kind}, h long, ids array<int>")
    alone = placed.filter("kind = 0").select("key", "ids")
    return alone.unionByName(whole.select("key", "ids")).unionByName(empty).withColumnRenamed("key", key)


def token_counts(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``tokens`` (int) of each row, 0 for a null or empty text; one pass without an exchange."""
    path = path or tokenizer_file()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for ids in encode(path, texts.tolist())], dtype="int32")

    return documents.select(F.col(key), count(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
