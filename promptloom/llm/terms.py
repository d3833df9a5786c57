"""Occurrences and records of every distinct term, counted in burst tries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.sources import materialise

#: A leaf of a trie with its terms, as it travels: kind 0 holds terms, kind 1 the number of records read.
LEAVES = "kind int, prefix string, terms array<string>, occurrences array<long>, records array<long>, n long"
COUNTS = "term string, occurrences long, records long"


def normal(term: str) -> str:
    """Composed, lower case, single-spaced; white space is what ``str.split`` takes for it, no-break space included."""
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", term).lower()).split())


class BurstTrie:
    """A trie over characters whose leaves are small tables of (occurrences, records) by the rest of the term.

    A leaf that outgrows ``burst_at`` terms becomes a node with a leaf for each next character, so common beginnings
    are held once and the depth follows the terms. The term that ends at a node lies in its leaf ``""``.
    """

    __slots__ = ("burst_at", "root", "size")

    def __init__(self, burst_at: int = 256):
        self.burst_at, self.root, self.size = burst_at, [False, {}], 0

    # A node is [is it an inner one?, its children by character, or its counters by the rest of the term].
    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self.root, 0
        while node[0]:
            key = term[at : at + 1]
            if key not in node[1]:
                node[1][key] = [False, {}]
            node, at = node[1][key], at + 1
            if not key:
                break
        rest, held = term[at:], node[1]
        if rest in held:
            held[rest][0] += occurrences
            held[rest][1] += records
            return
        held[rest] = [occurrences, records]
        self.size += 1
        if len(held) > self.burst_at:
            self._burst(node)

    def _burst(self, node: list) -> None:
        children: dict[str, list] = {}
        for rest, counters in node[1].items():
            children.setdefault(rest[:1], [False, {}])[1][rest[1:]] = counters
        node[0], node[1] = True, children
        for key, child in children.items():
            if key and len(child[1]) > self.burst_at:
                self._burst(child)

    def leaves(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, counters by the rest of the term) of every leaf."""
        stack = [("", self.root)]
        while stack:
            prefix, (inner, held) = stack.pop()
            if inner:
                stack.extend((prefix + key, child) for key, child in held.items())
            elif held:
                yield prefix, held


def _packed(trie: BurstTrie, n: int) -> pd.DataFrame:
    rows = [(0, p, [p + r for r in held], [c[0] for c in held.values()], [c[1] for c in held.values()], len(held)) for p, held in trie.leaves()]
    rows.append((1, None, None, None, None, n))
    return pd.DataFrame(rows, columns=["kind", "prefix", "terms", "occurrences", "records", "n"])


def _count(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, n = BurstTrie(), 0
        for batch in batches:
            for terms in batch["terms"]:
                n += 1
                if terms is None:
                    continue
                own: dict[str, int] = {}
                for term in terms:
                    if term is not None and (term := normal(term)):
                        own[term] = own.get(term, 0) + 1
                for term, k in own.items():
                    trie.add(term, k, 1)
            if trie.size > most:  # bounds a worker's memory, whatever the number of terms
                yield _packed(trie, n)
                trie, n = BurstTrie(), 0
        yield _packed(trie, n)

    return run


def _route(term: str, heavy: frozenset[str]) -> str:
    """The shortest beginning of the term that isn't heavy; the whole term where all are."""
    for k in range(1, len(term)):
        if term[:k] not in heavy:
            return term[:k]
    return term


def _split(heavy: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Leaves, cut where they span several routes."""
        for batch in batches:
            rows = []
            for leaf in batch.itertuples(index=False):
                by: dict[str, list] = {}
                for term, o, r in zip(leaf.terms, leaf.occurrences, leaf.records):
                    by.setdefault(_route(term, heavy), []).append((term, int(o), int(r)))
                rows += [(0, route, *map(list, zip(*held)), len(held)) for route, held in by.items()]
            yield pd.DataFrame(rows, columns=["kind", "prefix", "terms", "occurrences", "records", "n"])

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join the subtrees that came to this task; every leaf of a route comes to the same one."""
    trie = BurstTrie()
    for batch in batches:
        for leaf in batch.itertuples(index=False):
            for term, o, r in zip(leaf.terms, leaf.occurrences, leaf.records):
                trie.add(term, int(o), int(r))
    for prefix, held in trie.leaves():
        yield pd.DataFrame([(prefix + rest, o, r) for rest, (o, r) in held.items()], columns=["term", "occurrences", "records"])


def term_counts(records: DataFrame, terms: str, most: int = 200_000, parts: int | None = None) -> DataFrame:
    """How often each distinct term of the array column ``terms`` occurs, in how many records, and of how many.

    Returns term, occurrences, records, of_records (all records, those without terms included). Each row of ``records``
    is one record. Spellings are one term if they differ in case, white space or Unicode composition only. A null array,
    null entries and blank ones are no terms. Empty input gives no rows. Other columns are not read.

    1. Each task counts its records in a burst trie and hands out its leaves (whenever it holds over ``most`` terms,
       so its memory is bounded), so a term that a third of the records have leaves a task as one entry.
    2. Beginnings that hold more than a share of all entries are burst further, alike on all workers: at most
       4 x ``parts`` of each length are that heavy, which bounds what is collected.
    3. Leaves go to the shortest beginning that isn't heavy; there the subtrees are merged and read out.
    """
    spark = records.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = materialise(records.select(F.col(terms).alias("terms")).mapInPandas(_count(most), LEAVES), "terms")
    sums = dict(leaves.groupBy("kind").agg(F.sum("n")).collect())
    of_records, limit = sums.get(1, 0), sums.get(0, 0) / (4 * parts)
    held = leaves.filter("kind = 0")
    heavy: set[str] = set()
    level, length = held.select(F.explode("terms").alias("term")), 1
    while True:
        starts = level.filter(F.length("term") > length).groupBy(F.substring("term", 1, length).alias("p")).agg(F.count("*").alias("n"))
        found = [r["p"] for r in starts.filter(F.col("n") > max(limit, 1000)).collect()]  # at most 4 x parts
        if not found:
            break
        heavy |= set(found)
        level = level.filter(F.substring("term", 1, length).isin(found))
        length += 1
    routed = held.mapInPandas(_split(frozenset(heavy)), LEAVES).repartition(parts, "prefix")
    return routed.select("terms", "occurrences", "records").mapInPandas(_merge, COUNTS).withColumn("of_records", F.lit(of_records).cast("long"))


def mark_terms(counts: DataFrame, fewer_than: int, more_than_percent: int) -> DataFrame:
    """Adds ``mark``: 'rare' below ``fewer_than`` records, 'common' above that share of all records, else null.

    A term that is both, which happens on a few records only, is rare.
    """
    common = F.col("records") * 100 > F.col("of_records") * more_than_percent
    return counts.withColumn("mark", F.when(F.col("records") < fewer_than, "rare").when(common, "common"))
