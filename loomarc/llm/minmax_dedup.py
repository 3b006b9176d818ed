"""Near duplicates by min-max hashing.

A text's set holds its distinct word shingles.  Every permutation of the
64-bit shingle hashes gives two values of a signature, the smallest and the
largest; each agrees for two sets with a probability equal to their Jaccard
similarity, so both are unbiased, and as they fall on different shingles
together they vary less than two values of two permutations.  Half the hash
evaluations thus make a signature of the same length.  Bands of ``rows``
minima, and bands of ``rows`` maxima of the same permutations, are the buckets
in which sets meet.

1. Each bucket has one hub, and every set is confirmed, on full sets, against
   the hub that it meets most often.  Links become components.
2. Buckets whose members are still in different components are cut into blocks
   of bounded size; blocks are compared two and two by bitmaps that bound the
   intersection from above, and what may be similar is confirmed on full sets.

Nothing is decided by a signature alone: bands choose who is compared.  A pair
at the threshold shares no band with a probability of (1 - 0.85^5)^40, below
1e-10, and a likelier pair with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext, jaccard_join
from .common import batch_rows, broadcast_if_small, staged, uncoalesced
from .components import components


@dataclass(frozen=True)
class MinMaxDedup:
    """words per shingle, the threshold as a fraction, values in a band, bands
    (half of minima, half of maxima), and the most sets and shingles of a
    block, which change the cost of a run and never its result."""

    n: int = 5
    over: int = 85
    under: int = 100
    rows: int = 5
    bands: int = 40
    block_sets: int = 512
    block_shingles: int = 1 << 20

    @property
    def join(self) -> jaccard_join.JaccardJoin:
        return jaccard_join.JaccardJoin(n=self.n, over=self.over, under=self.under)

    @property
    def permutations(self) -> int:
        return self.rows * -(-self.bands // 2)

    def alone(self, size: int) -> bool:
        """No set of another content reaches the threshold with this one."""
        return size * (self.under - self.over) < self.over


_SEED = 20250117


def signatures(rule: MinMaxDedup, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima (sets x permutations) of sets of consecutive tokens
    that begin at ``first``; one multiplication for both."""
    factors = np.random.default_rng(_SEED).integers(1, 1 << 63, rule.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.empty((len(first), rule.permutations), np.uint64)
    high = np.empty_like(low)
    for k, factor in enumerate(factors):
        value = tokens * factor
        low[:, k] = np.minimum.reduceat(value, first)
        high[:, k] = np.maximum.reduceat(value, first)
    return low, high


def band_keys(rule: MinMaxDedup, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each set, first bands of minima."""
    keys = []
    for band in range(rule.bands):
        values, at = (low, high)[band % 2], band // 2 * rule.rows
        key = np.full(len(values), band + 1, np.uint64)
        for k in range(at, at + rule.rows):
            key = bytetext.mix(key + values[:, k])
        keys.append(key)
    return np.stack(keys, 1)


def _survey(rule: MinMaxDedup):
    """Per text its set's size and id, and the bands of sets new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, to, raw, offs in bytetext.slices(batch.column("text")):
                sets = list(jaccard_join._sets(raw, offs, rule.n))
                ids = [jaccard_join._set_id(s) if len(s) else None for s in sets]
                new = {i: k for k, i in enumerate(ids) if i is not None and i not in seen and not rule.alone(len(sets[k]))}
                seen.update(new)
                bands: list = [None] * len(sets)
                if new:
                    picked = list(new.values())
                    sizes = np.array([len(sets[k]) for k in picked])
                    keys = band_keys(rule, *signatures(rule, np.concatenate([sets[k] for k in picked]), np.cumsum(sizes) - sizes))
                    for k, own in zip(picked, keys.view(np.int64), strict=True):
                        bands[k] = own
                columns = [
                    batch.column("doc_id").slice(at, to - at),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "bands"])

    return run


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, in a power of two of at least eight times as many."""
    bits = np.zeros(1 << max(6, (8 * len(tokens) - 1).bit_length()), bool)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        maps = maps[:, : maps.shape[1] // 2] | maps[:, maps.shape[1] // 2 :]
    return maps


def possible_pairs(rule: MinMaxDedup, left: list, right: list | None) -> Iterator[tuple[int, int]]:
    """Pairs of two blocks (or within one) that the bitmaps permit.

    Members are (set_id, size, root, bitmap), with only pairs of different
    roots asked for.  A bit that one set has and the other lacks proves a token
    that it lacks, so no pair of the threshold is lost.
    """

    def by_words(members: list) -> dict:
        groups: dict[int, list] = {}
        for m in members:
            groups.setdefault(len(m[3]) // 8, []).append(m)
        table = {}
        for words, group in groups.items():
            ids, sizes, roots, maps = zip(*group, strict=True)
            table[words] = np.array(ids), np.array(sizes), np.array(roots), np.frombuffer(b"".join(maps), np.uint64).reshape(len(group), words)
        return table

    lefts = by_words(left)
    rights = lefts if right is None else by_words(right)
    for wide, (ids, sizes, roots, maps) in lefts.items():
        for its_wide, (its_ids, its_sizes, its_roots, its_maps) in rights.items():
            if max(wide, its_wide) > 2 * min(wide, its_wide) or (right is None and its_wide < wide):
                continue
            words = min(wide, its_wide)
            own, its = _folded(maps, words), _folded(its_maps, words)
            set_bits, its_bits = np.bitwise_count(own).sum(1, dtype=np.int64), np.bitwise_count(its).sum(1, dtype=np.int64)
            some = max(1, 2_000_000 // (words * len(its)))
            for a in range(0, len(own), some):
                s = slice(a, a + some)
                shared = np.bitwise_count(own[s, None] & its[None]).sum(2, dtype=np.int64)
                size = sizes[s, None]
                most = np.minimum(size - set_bits[s, None] + shared, its_sizes - its_bits + shared)
                fine = ((rule.over + rule.under) * most >= rule.over * (size + its_sizes)) & (roots[s, None] != its_roots)
                for i, j in zip(*np.nonzero(fine), strict=True):
                    x, y = int(ids[a + i]), int(its_ids[j])
                    if right is not None or wide != its_wide or x < y:
                        yield min(x, y), max(x, y)


def _compared(rule: MinMaxDedup):
    """The possible pairs of each cell; rows come sorted by cell.  A pair that
    shares several buckets is told in the least of them only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, int]]:
            cell, sides, keys = None, ([], []), {}

            def ended() -> Iterator[tuple[int, int]]:
                if cell is not None:
                    same = cell[1] == cell[2]
                    if sides[0] and (same or sides[1]):
                        for a, b in possible_pairs(rule, sides[0], None if same else sides[1]):
                            if min(keys[a] & keys[b]) == cell[0]:
                                yield a, b

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("keys", "key", "i", "j", "block", "set_id", "size", "root", "tokens")]
                for own, key, i, j, block, *member in zip(*columns, strict=True):
                    if cell != (key, i, j):
                        yield from ended()
                        cell, sides, keys = (key, i, j), ([], []), {}
                    keys[member[0]] = set(own)
                    sides[block != i].append(member)
            yield from ended()

        found: list[tuple[int, int]] = []
        for pair in pairs():
            found.append(pair)
            if len(found) >= 100_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _first_links(rule: MinMaxDedup, docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(met, links): the rows of buckets of two sets or more, and the pairs of
    a set and the hub it meets most often that reach the threshold."""
    hubs = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("set_id").alias("at"), "set_id", "size")).alias("hub"))
    hubs = staged(hubs.where("n > 1").select("key", F.col("hub.set_id").alias("hub"), F.col("hub.size").alias("hub_size")), "hubs")
    met = staged(rows.join(broadcast_if_small(hubs), "key"), "met")
    small, large = F.least("size", "hub_size"), F.greatest("size", "hub_size")
    near = met.where((F.col("set_id") != F.col("hub")) & (rule.under * small >= rule.over * large))
    counted = near.groupBy("set_id", "hub").agg(F.count("*").alias("n"))
    best = counted.groupBy("set_id").agg(F.max_by("hub", F.struct("n", "hub")).alias("a"))
    pairs = staged(best.select("a", F.col("set_id").alias("b")), "first")
    return met.select("key", "set_id", "size"), jaccard_join._checked(rule.join, docs, pairs)


def _cells(rule: MinMaxDedup, met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, i, j, block, set_id, size, root) of the pairs of blocks of
    the buckets that hold different components; buckets of the same members
    count once."""
    rooted = met.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = staged(rooted, "rooted")
    buckets = rooted.groupBy("key").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.count("*").alias("n"),
        F.sum("size").alias("shingles"),
        F.min("set_id").alias("least"),
        F.bit_xor(F.xxhash64("set_id")).alias("all"),
    )
    blocks = F.greatest(F.ceil(F.col("n") / rule.block_sets), F.ceil(F.col("shingles") / rule.block_shingles)).cast("int")
    buckets = buckets.where("low <> high").groupBy("n", "shingles", "least", "all").agg(F.min("key").alias("key"))
    buckets = staged(buckets.select("key", blocks.alias("blocks")), "apart")
    rows = rooted.join(broadcast_if_small(buckets), "key").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "size", "root")


def similar_sets(docs: DataFrame, rule: MinMaxDedup = MinMaxDedup()) -> tuple[DataFrame, DataFrame]:
    """(survey, roots) of (doc_id, text) rows: doc_id, n_shingles and set_id of
    each text (no set_id where the set is empty), and node, root over set ids
    for the sets that a chain of links joins with another set."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batch_rows(spark, 1024):
        survey = staged(docs.mapInArrow(_survey(rule), "doc_id long, n_shingles long, set_id long, bands array<long>"), "survey")
    sets = survey.where("bands is not null").groupBy("set_id").agg(F.first("n_shingles").cast("int").alias("size"), F.first("bands").alias("bands"))
    met, links = _first_links(rule, docs, sets.select(F.explode("bands").alias("key"), "set_id", "size"))
    roots = components(links)
    survey = survey.drop("bands")
    cells = staged(_cells(rule, met, roots), "cells")
    if cells.isEmpty():
        return survey, roots
    with batch_rows(spark, 1024):
        # The buckets of a set: at most as many as there are bands.
        ids = staged(cells.groupBy("set_id").agg(F.collect_set("key").alias("keys")), "ids")
        maps = jaccard_join._wanted_sets(rule.join, docs, ids.select("set_id"), _bitmap).dropDuplicates(["set_id"])
        maps = staged(maps.join(ids, "set_id"), "bitmaps")
    dealt = cells.join(maps, "set_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    with batch_rows(spark, 256), uncoalesced(spark):
        pairs = staged(dealt.select("keys", "key", "i", "j", "block", "set_id", "size", "root", "tokens").mapInArrow(_compared(rule), "a long, b long"), "pairs")
    more = jaccard_join._checked(rule.join, docs, pairs)
    return survey, roots if more.isEmpty() else components(links.union(more))


def near_duplicate_groups(docs: DataFrame, rule: MinMaxDedup = MinMaxDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of (doc_id, text) rows.

    component_id is the smallest doc_id reachable over links of similarity
    ``over / under`` or more, and ``kept`` tells that it is the row's own.  A
    null or empty text, or one without words, has an empty set and stands
    alone; equal sets are linked; a doc_id that repeats keeps a row each; a
    null doc_id is joined with the others and names no component (alone it is
    kept); other columns are ignored; no rows give no rows.  Shingles and sets
    are told apart by 64-bit hashes.
    """
    survey, roots = similar_sets(docs, rule)
    least = survey.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = least.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    linked = classes.groupBy("root").agg(F.min("least").alias("component"))
    by_set = classes.join(linked, "root").select("set_id", "component")
    found = survey.join(by_set, "set_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
