"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks in doc_id order.  Block j of a source of weight
w may not start before slot floor(j / w) and must be served by slot
ceil((j + 1) / w); serving the eligible block with the earliest deadline in
each slot keeps every source less than one block from its share at any time.

Weights are taken exactly, as fractions of their sum.  The schedule is a pass
over the blocks (not the rows) that holds one block of each source; it writes
the slot of each block to a table, and rows are placed in parallel by a join
with it.  When a source has no blocks left, a new phase begins in which the
others share its weight; every row is placed once and none is dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import groupby, islice
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, staged


@dataclass(frozen=True)
class Mixing:
    """weights: of sources (others, and all where it is None, weigh by their
    rows to the power ``flatten``); block: rows of a block; period: slots of
    the schedule written at a time."""

    weights: Mapping[str, float] | None = None
    flatten: float = 0.5
    block: int = 64
    period: int = 1000


def quotas(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Slots of each source in a period: at least one, by largest remainder."""
    if len(weights) > period:
        raise ValueError("the period has fewer slots than there are sources")
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    short = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:short]:
        out[s] += 1
    return out


def served(weights: Mapping[str, float]) -> Iterator[str]:
    """The source served in each slot, without end: earliest deadline first
    among released blocks.  Weights are positive."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(w.denominator for w in exact.values()))
    share = {s: int(w * unit) for s, w in exact.items()}
    total = sum(share.values())
    released: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(share)]  # release, source, block
    heapq.heapify(waiting)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * total // share[s]), s, j))
        _, s, j = heapq.heappop(released)
        yield s
        heapq.heappush(waiting, ((j + 1) * total // share[s], s, j + 1))
        slot += 1


def schedule(shares: Mapping[str, int]) -> list[str]:
    """The source served in each slot of a period that whole shares fill."""
    return list(islice(served(shares), sum(shares.values())))


def placements(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[int, str, int, int]]:
    """(phase, source, block, slot) of every block, by slot; a phase ends when
    a source has no blocks left.  Sources of no weight follow all others."""
    left = {s for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    phase = slot = 0
    while left:
        for s in served({s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)):
            yield phase, s, done[s], slot
            done[s] += 1
            slot += 1
            if done[s] == blocks[s]:
                left.remove(s)
                break
        phase += 1


@dataclass(frozen=True)
class Phase:
    """From block ``first`` of each source on: slot ``base`` plus the place of
    the block in the table of the phase, which has ``period`` slots."""

    base: int
    first: dict[str, int]
    table: dict[str, np.ndarray]
    period: int


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> list[Phase]:
    """The phases of a small mixture as tables; they do not repeat, so
    ``period`` has no effect."""
    out: list[Phase] = []
    for _, group in groupby(placements(blocks, weights), key=lambda x: x[0]):
        rows = list(group)
        base, first, table = rows[0][3], {}, {}
        for _, s, j, slot in rows:
            first.setdefault(s, j)
            table.setdefault(s, []).append(slot - base)
        out.append(Phase(base, first, {s: np.array(x) for s, x in table.items()}, len(rows)))
    return out


def _with(df: DataFrame, *longs: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in longs]])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted rows of a partition within their source."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    counts: dict[str | None, int] = {}
    for batch in batches:
        local = []
        for s in batch.column("_source").to_pylist():
            counts[s] = counts.get(s, 0) + 1
            local.append(counts[s] - 1)
        yield (
            batch.append_column("_part", pa.array(np.full(len(local), part), pa.int64()))
            .append_column("_local", pa.array(local, pa.int64()))
        )


def mixed(docs: DataFrame, rule: Mixing = Mixing()) -> DataFrame:
    """docs with _block, _slot and _position: the order of the mixture.

    docs: doc_id, source and any other columns; its own columns _block, _slot
    or _position are replaced.  A null source is one of its own; rows with
    equal or null doc_id are all kept; texts of any length only move; no rows
    give no rows.  Positions rise with slots and are unique; a source's last
    block may hold fewer rows, so positions may leave gaps.
    """
    out = _placed(docs, rule)
    return out.select("row.*", "_block", "_slot", "_position") if not {"_block", "_slot", "_position"} & set(docs.columns) else out.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ("_block", "_slot", "_position")], "_block", "_slot", "_position"
    )


def _placed(docs: DataFrame, rule: Mixing) -> DataFrame:
    """row (all columns of docs), _block, _slot, _position."""
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    named = docs.select(F.struct("*").alias("row"), source.alias("_source"), F.col("doc_id").alias("_id"))
    dealt = named.repartitionByRange("_source", "_id").sortWithinPartitions("_source", "_id")
    schema = _with(dealt, "_part", "_local")
    dealt = staged(dealt.mapInArrow(_numbered, schema), "mixing")
    # A row for each task and source in it.
    parts = dealt.groupBy("_source", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "mixing")
    sizes = dict(parts.groupBy("_source").agg(F.sum("_rows")).collect())
    weights = {s: float((rule.weights or {}).get(s, float(n) ** rule.flatten)) for s, n in sizes.items()}
    blocks = {s: -(-n // rule.block) for s, n in sizes.items()}

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            plan = placements(blocks, weights)
            while some := list(islice(plan, rule.period)):
                _, source, block, slot = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(block), pa.array(slot)], ["_source", "_block", "_slot"])

    one = spark.range(0, 1, 1, 1)
    plan = staged(one.mapInArrow(planned, "_source string, _block long, _slot long"), "mixing")
    rank = F.col("_base") + F.col("_local")
    placed = dealt.join(parts.drop("_rows"), ["_source", "_part"]).withColumn("_rank", rank)
    placed = placed.withColumn("_block", F.expr(f"_rank div {rule.block}")).join(broadcast_if_small(plan), ["_source", "_block"])
    position = F.col("_slot") * rule.block + F.col("_rank") % rule.block
    return placed.select("row", "_block", "_slot", position.alias("_position"))


def in_mixed_order(docs: DataFrame, rule: Mixing = Mixing()) -> DataFrame:
    """docs with their own columns, of any names, in the order of the mixture:
    partitions and the rows in them follow it, and so do files written from
    them.  Null and repeated ids and null sources are handled as in :func:`mixed`."""
    out = _placed(docs, rule)
    return out.repartitionByRange("_position").sortWithinPartitions("_position").select("row.*")
