"""Texts of varying length in as few containers of a fixed capacity as possible."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.sources import materialise

PACKED = "container_kind string, capacity int, container_id string, key {kind}, piece int, start long, size int, filled int"
#: Items that one task packs at once.
BLOCK = 20_000
MAX_KINDS = 1_000


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_right(room, (size, -1))
        if at == len(room):
            bins.append([item])
            insort(room, (capacity - size, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(item)
            insort(room, (free - size, b))
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills, until bins run empty.

    One of the emptiest bins is worked on: each of its items is moved into another bin's free room, or exchanged for one or
    two smaller items there, whichever raises the squared fills most; all items, and all pairs of items of one bin, of
    all underfull bins are looked through. A bin whose items are all gone is dropped. Each pass takes as many bins, the
    emptiest first, as are above the bound, and ``spare`` more, since what one couldn't do may work once another has
    changed. The search ends at the bound, after ``patience`` passes that empty no bin, or after ``steps`` exchanges. These
    three bound its effort; all items are packed whatever they are.
    """

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int, steps: int = 20_000, spare: int = 8, patience: int = 3):
        self.sizes, self.capacity, self.steps, self.spare, self.patience = sizes.astype(np.int64), capacity, steps, spare, patience
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(self.sizes[b].sum()) for b in self.bins], dtype=np.int64)
        # Items of underfull bins, ordered by bin and, within it, by size: one number for both.
        self.unit = capacity + 1
        self.items = np.array([i for b, own in enumerate(self.bins) if self.fill[b] < capacity for i in own], dtype=np.int64)
        self.where = np.array([b for b, own in enumerate(self.bins) if self.fill[b] < capacity for _ in own], dtype=np.int64)
        self.rank = self.where * self.unit + self.sizes[self.items] if len(self.items) else np.zeros(0, dtype=np.int64)
        self._sort()

    def _sort(self) -> None:
        order = np.argsort(self.rank, kind="stable")
        self.items, self.where, self.rank = self.items[order], self.where[order], self.rank[order]

    def _exchange(self, b: int, item: int, others: list[int], c: int) -> None:
        self.bins[b].remove(item)
        for o in others:
            self.bins[c].remove(o)
        self.bins[c].append(item)
        self.bins[b].extend(others)
        moved = int(self.sizes[item]) - int(self.sizes[others].sum() if others else 0)
        self.fill[b] -= moved
        self.fill[c] += moved
        kept = ~np.isin(self.where, (b, c))
        own = [(x, i) for x in (b, c) if self.fill[x] < self.capacity for i in self.bins[x]]
        where, items = np.array([x for x, _ in own], dtype=np.int64), np.array([i for _, i in own], dtype=np.int64)
        self.where, self.items = np.append(self.where[kept], where), np.append(self.items[kept], items)
        self.rank = np.append(self.rank[kept], where * self.unit + self.sizes[items])
        self._sort()

    def _improve(self, b: int) -> bool:
        """The best exchange that takes volume out of bin ``b``."""
        best, found = 0, None  # gain in squared fills; item, bin, items back
        n = len(self.items)
        if not n:
            return False
        sizes, gaps, fills = self.sizes[self.items], (self.capacity - self.fill)[self.where], self.fill[self.where]
        other = self.where != b
        heads = np.flatnonzero(np.append(True, self.where[1:] != self.where[:-1]))
        for size in sorted({int(self.sizes[i]) for i in self.bins[b]}, reverse=True):
            item = next(i for i in self.bins[b] if int(self.sizes[i]) == size)
            moved = np.full(len(heads), size)
            ok = other[heads] & (moved <= gaps[heads])
            choices = [(moved, ok, heads, None)]
            moved = size - sizes
            choices.append((moved, other & (moved > 0) & (moved <= gaps), np.arange(n), np.zeros(n, dtype=bool)))
            # Of each item's partners in its bin, the least that leaves room: more volume moves with a smaller pair.
            partner = np.searchsorted(self.rank, self.where * self.unit + np.maximum(size - gaps - sizes, 0))
            partner += partner == np.arange(n)
            inside = (partner < n) & (self.where[np.minimum(partner, n - 1)] == self.where)
            moved = size - sizes - sizes[np.minimum(partner, n - 1)]
            choices.append((moved, other & inside & (moved > 0) & (moved <= gaps), np.arange(n), inside))
            for moved, ok, at, pairs in choices:
                if ok.any():
                    gain = np.where(ok, moved * (moved + fills[at] - self.fill[b]), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        i = int(at[k])
                        back = [] if pairs is None else [int(self.items[i])]
                        if pairs is not None and pairs[k]:
                            back.append(int(self.items[partner[i]]))
                        best, found = int(gain[k]), (item, int(self.where[i]), back)
        if found is None:
            return False
        self._exchange(b, found[0], found[2], found[1])
        return True

    def run(self) -> list[list[int]]:
        least = max(1, -(-int(self.fill.sum()) // self.capacity))
        idle = 0
        while idle < self.patience and self.steps > 0:
            live = [b for b in range(len(self.bins)) if self.bins[b]]
            if len(live) <= least:
                break
            # To reach the bound as many bins must go; emptier ones stand the best chance.
            live.sort(key=lambda b: (self.fill[b], b))
            changed = False
            for b in live[: len(live) - least + self.spare]:
                while self.bins[b] and self.fill[b] < self.capacity and self.steps > 0:
                    self.steps -= 1
                    if not self._improve(b):
                        break
                    changed = True
            if not changed:
                break
            idle = idle + 1 if len(live) == sum(1 for b in self.bins if b) else 0
        return [b for b in self.bins if b]


def pack(sizes: np.ndarray, capacity: int, steps: int = 20_000) -> list[list[int]]:
    """Bins of item numbers; items are at most ``capacity`` large. Items of size 0 lie in the first bin."""
    sizes = np.asarray(sizes, dtype=np.int64)
    real = np.flatnonzero(sizes > 0)
    bins = best_fit(sizes[real], capacity) if len(real) else []
    bins = [[int(real[i]) for i in b] for b in bins]
    least = -(-int(sizes.sum()) // capacity)
    if len(bins) > least:
        bins = LocalSearch(sizes, bins, capacity, steps).run()
    zero = np.flatnonzero(sizes == 0).tolist()
    if zero:
        bins = [bins[0] + zero, *bins[1:]] if bins else [zero]
    return bins


def _pack_block(round_: int, steps: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        capacity, kind, block = int(group["capacity"].iloc[0]), group["container_kind"].iloc[0], int(group["block"].iloc[0])
        group = group.sort_values(["size", "order"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = group["size"].to_numpy()
        number, filled = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        for k, own in enumerate(pack(sizes, capacity, steps)):
            number[own] = k
            filled[own] = sizes[own].sum()
        ids = [f"{kind}-{round_}-{block}-{k}" for k in number]
        return group[["container_kind", "capacity", "key", "piece", "start", "size"]].assign(container_id=ids, filled=filled)

    return run


def _emptiest(under: DataFrame, block: int) -> int:
    """The highest fill up to which the containers' items make one block; -1 if those of the lowest are more."""
    upto = Window.partitionBy("container_kind").orderBy("filled")
    levels = under.groupBy("container_kind", "filled").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(upto))
    return levels.filter(F.col("n") <= block).agg(F.coalesce(F.max("filled"), F.lit(-1))).first()[0]


def pack_documents(sizes: DataFrame, key: str, size: str, containers: DataFrame, block: int = BLOCK, full: float = 0.995, steps: int = 20_000) -> DataFrame:
    """Which container holds each document, or each piece of one, for each kind of ``containers``.

    ``sizes`` has ``key`` and ``size`` (tokens; null counts as 0) of each document; ``containers`` has
    ``container_kind`` and ``capacity_tokens``. Returns container_kind, capacity_tokens, container_id, ``key``, piece
    (from 0), start (of the piece, in tokens), tokens, filled (of the whole container). A document is whole (piece 0)
    unless it alone exceeds the capacity; then it is cut into full pieces, each with a container of its own, and a rest
    that is packed like a document. Empty documents take no room and lie in some container. Kinds with a null or
    non-positive capacity are left out. Rows with the same key are one
    document, of the largest size given. Empty input gives no rows.

    Items are spread at random over blocks of about ``block`` items, so one task holds that many at once, whatever
    the corpus, and each block is packed best-fit and improved by local search. Containers filled less than ``full``
    are opened again, and their items packed together in the next round, until they make one block. A kind of which a
    round leaves as many open as before comes to its end: the emptiest that make one block are packed once more, the
    others stay as they are. So there are at most as many rounds as containers. Each round is written, so a lost executor
    costs little. Kinds (at most ``MAX_KINDS``) are collected, counts are one row each.
    """
    kinds = [tuple(r) for r in containers.filter("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("int")).distinct().limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    kind_of_key = sizes.schema[key].dataType.simpleString()
    packed = PACKED.format(kind=kind_of_key)
    total = F.max(F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)))
    base = sizes.select(F.col(key).alias("key"), F.col(size).alias("size")).groupBy("key").agg(total.alias("total"))
    each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in kinds])
    pieces = (
        base.select("key", "total", F.inline(each if kinds else each.cast("array<struct<container_kind:string,capacity:int>>")))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr("(total - 1) div capacity"), F.lit(0)))))
        .withColumn("start", F.col("piece") * F.col("capacity"))
        .withColumn("size", F.least(F.col("total") - F.col("start"), F.col("capacity").cast("long")).cast("int"))
        .withColumn("piece", F.col("piece").cast("int"))
    )
    order = F.xxhash64("container_kind", F.col("key").cast("string"), "piece", "total")
    pieces = materialise(pieces.select("container_kind", "capacity", "key", "piece", "start", "size", order.alias("order")), "pieces")
    alone = pieces.filter("size = capacity").select("container_kind", "capacity", F.concat_ws("-", "container_kind", F.lit("full"), F.coalesce(F.col("key").cast("string"), F.lit("null")), "piece").alias("container_id"), "key", "piece", "start", "size", F.col("size").alias("filled"))
    done, open_, round_ = [alone], pieces.filter("size < capacity"), 0
    before: dict[str, int] = {}  # how many containers of each kind the last round left open
    while True:
        counts = dict(open_.groupBy("container_kind").agg(F.count("*")).collect())
        if not counts:
            break
        blocks = {k: max(1, -(-n // block)) for k, n in counts.items()}
        per = F.create_map(*[x for k, b in blocks.items() for x in (F.lit(k), F.lit(b))])[F.col("container_kind")]
        placed = (
            open_.withColumn("block", F.pmod(F.xxhash64("order", F.lit(round_)), per))
            .groupBy("container_kind", "block")
            .applyInPandas(_pack_block(round_, steps), packed)
            .withColumn("order", F.xxhash64("container_kind", F.col("key").cast("string"), "piece", "size"))
        )
        placed = materialise(placed, f"packed-{round_}")
        last = F.lit(False)
        for k, b in blocks.items():
            last = last | (F.col("container_kind").eqNullSafe(F.lit(k)) & F.lit(b == 1))
        closed = last | (F.col("filled") >= F.col("capacity") * full)
        under = placed.filter(~closed)
        left = dict(under.groupBy("container_kind").agg(F.countDistinct("container_id")).collect())
        for k in [k for k, n in left.items() if n >= before.get(k, n + 1)]:
            own = F.col("container_kind").eqNullSafe(F.lit(k))
            closed = closed | (own & (F.col("filled") > _emptiest(under.filter(own), block)))
        before = left
        done.append(placed.filter(closed).drop("order"))
        open_ = placed.filter(~closed).drop("container_id", "filled")
        round_ += 1
        if all(b == 1 for b in blocks.values()):
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("container_kind", F.col("capacity").alias("capacity_tokens"), "container_id", F.col("key").alias(key), "piece", "start", F.col("size").alias("tokens"), "filled")
