"""Filling fixed-capacity containers: variable-capacity best-fit over the histogram of sizes.

Items of one size are interchangeable, so the packing is planned on counts per size. The plan's input has at most
capacity + 1 numbers however large the corpus is. Groups of bins that hold the same sizes are handled as one, which makes
the plan the exact result of best-fit decreasing over all items. Every item then finds its container from its size and its
rank among items of that size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.session import staged

SHIFT = 44  # bits for a rank below the size


@dataclass
class Plan:
    """Entries sorted by size and first rank; groups of bins sorted by first container."""

    entries: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # size, rank0, bin0, per_bin, slot0, offset0
    groups: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # bin0, bins, used, slots, capacity
    bins: int = 0
    cost: float = 0.0


def best_fit(hist: dict[int, int], capacities: tuple[int, ...], opening, cost) -> Plan:
    """Best-fit decreasing on a histogram {size: count}, sizes 1..max(capacities).

    opening(size, left) names the capacity of a new bin for items of this size, where left are the sizes still to be placed. A
    bin is closed with the least permitted capacity that holds its contents.
    """
    plan, by_room, rooms, todo = Plan(), {}, [], {s: c for s, c in hist.items() if s > 0}

    def put(room: int, group: tuple[int, int, int, int]) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(group)

    for size in sorted((s for s in hist if s > 0), reverse=True):
        left, rank = hist[size], 0
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                todo[size] = left
                cap = opening(size, todo)
                # half of them at a time: what is left then may call for another capacity
                n = -(-left // (cap // size))
                n = n if len(capacities) == 1 or n < 8 else -(-n // 2)
                put(cap, (plan.bins, n, 0, 0))
                plan.bins += n
                continue
            room = rooms[at]
            bin0, m, used, slots = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            per = room // size
            full = min(m, left // per)
            if full:
                plan.entries.append((size, rank, bin0, per, slots, used))
                put(room - per * size, (bin0, full, used + per * size, slots + per))
                rank, left = rank + full * per, left - full * per
            if m > full:
                rest = bin0 + full
                if left:  # fewer than one bin takes
                    plan.entries.append((size, rank, rest, per, slots, used))
                    put(room - left * size, (rest, 1, used + left * size, slots + left))
                    rank, left, rest = rank + left, 0, rest + 1
                if bin0 + m > rest:
                    put(room, (rest, bin0 + m - rest, used, slots))
        del todo[size]
    for groups in by_room.values():
        for bin0, m, used, slots in groups:
            cap = next(c for c in capacities if c >= used)
            plan.groups.append((bin0, m, used, slots, cap))
            plan.cost += m * cost(cap)
    plan.entries.sort()
    plan.groups.sort()
    return plan


def least_cost(caps: tuple[int, ...], cost):
    """The opening rule of variable-capacity best-fit: for each permitted capacity a bin is filled on trial with what is left, the
    largest that fits first, and the capacity with the least cost a token is opened (ties: the larger)."""

    def rule(size: int, left: dict[int, int]) -> int:
        sizes = sorted(left)
        best = None
        for cap in caps:
            if cap < size:
                continue
            room, at = cap, bisect.bisect_right(sizes, size)
            while room and at:
                s = sizes[at - 1]
                if s > room:
                    at = bisect.bisect_right(sizes, room, 0, at)
                    continue
                room -= s * min(left[s], room // s)
                at -= 1
            price = cost(cap) / (cap - room)
            if best is None or price <= best[0]:
                best = (price, cap)
        return best[1]

    return rule


def plan_packing(hist: dict[int, int], capacities: tuple[int, ...], cost=float) -> Plan:
    """Best-fit over all permitted lengths jointly, each bin opened at least cost and downsized in the end. Where always opening one
    and the same capacity turns out cheaper as a whole, that is taken."""
    caps = tuple(sorted(set(capacities)))
    rules = [least_cost(caps, cost)]
    if len(caps) > 1:
        rules += [lambda s, left, c=c: max(c, next(x for x in caps if x >= s)) for c in caps]
    return min((best_fit(hist, caps, r, cost) for r in rules), key=lambda p: p.cost)


def pack(sizes: DataFrame, capacities: tuple[int, ...] = (2048,), id_col: str = "doc_id", size_col: str = "n_tokens", bucket_rows: int = 500_000) -> DataFrame:
    """One row per piece: id, part, container_id, place, start, n_tokens, capacity.

    Items up to the largest capacity stay whole. A larger one is cut into full containers and a rest, numbered by part. Items
    of size 0 are spread over the containers after the others. Rows with a null size are left out; repeated rows are items of
    their own. place counts the pieces of a container from 0, start is the piece's first token in it. Ties between items of
    one size are broken by bucket and id: a size has a bucket for every bucket_rows of its items, so no task ranks many more
    (but rows that repeat an id share a bucket). An empty table gives no rows.
    """
    top = max(capacities)
    n = F.col(size_col).cast("long")
    items = (
        sizes.filter(n.isNotNull())
        .select(F.col(id_col).alias("doc_id"), n.alias("n"))
        .withColumn("part", F.explode(F.expr(f"sequence(0L, greatest(0L, CAST(ceil(n / {top}) AS BIGINT) - 1))")))
        .select("doc_id", F.col("part").cast("int"), F.expr(f"least(n - part * {top}, {top}L)").alias("n_tokens"))
    )
    items = staged(items, "pack-items")
    hist = {int(r.n_tokens): int(r.c) for r in items.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}  # at most top + 1 rows
    common = [(s, -(-c // bucket_rows)) for s, c in hist.items() if c > bucket_rows]
    split = F.lit(1)
    if common:
        split = F.coalesce(F.element_at(F.map_from_arrays(F.array(*[F.lit(s).cast("long") for s, _ in common]), F.array(*[F.lit(n).cast("int") for _, n in common])), F.col("n_tokens")), F.lit(1))
    items = items.withColumn("b", F.expr("xxhash64(doc_id, part)")).withColumn("b", F.pmod("b", split.cast("long")).cast("int"))
    counts = items.groupBy("n_tokens", "b").agg(F.count("*").alias("c"))
    # a row for each bucket; the items are partitioned by the same keys for their ranks
    before = Window.partitionBy("n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    plan = plan_packing(hist, tuple(capacities))
    entry = np.array(plan.entries or [(0, 0, 0, 1, 0, 0)], np.int64)
    group = np.array(plan.groups or [(0, 1, 0, 0, min(capacities))], np.int64)
    bins = max(plan.bins, 1)
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "b").orderBy("doc_id", "part")))
    ranked = ranked.join(offsets, ["n_tokens", "b"]).select("doc_id", "part", "n_tokens", (F.col("before") + F.col("r") - 1).alias("rank"))
    id_type = sizes.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (entry[:, 0] << SHIFT) + entry[:, 1]
        for b in batches:
            s, r = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            e = entry[np.maximum(np.searchsorted(keys, (s << SHIFT) + r, side="right") - 1, 0)]
            k = r - e[:, 1]
            per, zero = e[:, 3], s == 0
            at = np.where(zero, r % bins, e[:, 2] + k // per)
            g = group[np.searchsorted(group[:, 0], at, side="right") - 1]
            slot = np.where(zero, g[:, 3] + r // bins, e[:, 4] + k % per)
            start = np.where(zero, g[:, 2], e[:, 5] + k % per * s)
            ints = [pa.array(x.astype(np.int32)) for x in (slot, start, s, g[:, 4])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), *ints], ["doc_id", "part", "container_id", "place", "start", "n_tokens", "capacity"])

    return ranked.mapInArrow(place, f"doc_id {id_type}, part int, container_id bigint, place int, start int, n_tokens int, capacity int")
