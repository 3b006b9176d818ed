"""N-gram Jaccard join: prefixes extended by token combinations.

A text's set holds its distinct word n-grams.  Tokens (n-grams) are put in
one order for all texts, rare ones first.  A rare token is a signature of its
own.  Frequent tokens are dealt by hash into classes and yield signatures only
as pairs within a class, so that a passage that thousands of texts share makes
no huge bucket.  A prefix is extended until any loss the threshold permits
leaves one signature:

    rare tokens + sum over classes of max(0, its tokens - 1) >= lost + 1

The prefix that ends first then keeps a signature within the intersection, and
the other prefix holds all of that signature's tokens: two similar sets always
meet, whatever the order.  The number of classes follows the set's size; as
similar sets lie in one size group or in two adjacent ones, a set uses the
classes of its own group and of the next.

A prefix token is dead if no other set has it in its prefix, or only one that
can't be similar.  Where two sets meet, neither holds a dead token that the
other has before that place, so length and position bounds count live tokens
only.  Buckets with equal members are one bucket.  Then, in two steps:

1. In each bucket the set with the fewest dead tokens is the hub; every set is
   verified with the hub it meets most often, and links become components.
2. Pairs in different components that the bounds permit are listed where they
   first meet (in the largest of their common buckets, as far as the ``known``
   largest of each tell), bounded by bitmaps, and verified.

Copies of one text thus meet one hub, not one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext, worker
from .common import batch_rows, broadcast_if_small, staged, uncoalesced
from .components import components


@dataclass(frozen=True)
class JaccardJoin:
    """words per n-gram, the threshold as a fraction, and the frequency order.

    ``cells``: counters of the document-frequency sketch that orders tokens.
    It counts all n-grams of all texts; its size changes the cost of a run
    and never its result.  From ``frequent`` texts above the mean load of a
    cell on, tokens work in pairs; ``class_tokens`` is the number of prefix
    tokens a class should hold; ``known`` the number of a set's buckets
    that tell where a pair meets first.
    """

    n: int = 5
    over: int = 75
    under: int = 100
    cells: int = 1 << 24
    frequent: int = 1000
    class_tokens: int = 4
    known: int = 6

    def lost(self, size: int) -> int:
        """Tokens of a set of this size that a partner may lack."""
        return size - -(-self.over * size // self.under)


def _sets(raw: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a slice."""
    w = bytetext.words(raw, offs, bytetext.SPACED)
    grams = bytetext.ngrams(w.hash, n)
    first = w.first
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            if len(g) > 1:
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                g = g[keep]
            yield g
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = bytetext.mix(short * np.uint64(31) + w.hash[k : k + 1])
            yield short + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


_SET_PLACES = np.array([3, 5, 7], np.uint64)


def _set_id(tokens: np.ndarray) -> int:
    """One 64-bit value of a set, as a signed long."""
    sums = np.array([tokens.sum(), len(tokens), bytetext.mix(tokens).sum()], np.uint64)
    return int(bytetext.mix((bytetext.mix(sums) * _SET_PLACES).sum(keepdims=True)).view(np.int64)[0])


_CELL_BLOCK = 1 << 14
#: Cells counted at a time, and tokens held before they are counted.
_CELL_PART = 1 << 22
_HELD = 4_000_000


def _add_counts(counts: np.ndarray, cells: np.ndarray) -> None:
    """Add one to the counters named, up to the largest that they hold."""
    most = np.iinfo(counts.dtype).max
    for a in range(0, len(counts), _CELL_PART):
        part = counts[a : a + _CELL_PART]
        mine = cells[(cells >= a) & (cells < a + _CELL_PART)] - a
        if len(mine) > _CELL_PART // 64:
            part[:] = np.minimum(part + np.bincount(mine, minlength=len(part)), most)
        elif len(mine):
            at, n = np.unique(mine, return_counts=True)
            part[at] = np.minimum(part[at] + n, most)


def _survey(join: JaccardJoin):
    """Per text its set's size and id; per task the counts of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(join.cells, np.uint16)
        mask = np.uint64(join.cells - 1)
        held: list[np.ndarray] = []
        for batch in batches:
            sizes, ids = [], []
            for _, _, raw, offs in bytetext.slices(batch.column("text")):
                per_slice = []
                for tokens in _sets(raw, offs, join.n):
                    sizes.append(len(tokens))
                    ids.append(_set_id(tokens) if len(tokens) else None)
                    per_slice.append(tokens)
                held.append((np.concatenate(per_slice) & mask).astype(np.int32))
                if sum(map(len, held)) >= _HELD:
                    _add_counts(counts, np.concatenate(held))
                    held = []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(sizes), np.int32)),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.nulls(len(sizes), pa.binary()),
                ],
                ["part", "doc_id", "n_shingles", "set_id", "counts"],
            )
        if held:
            _add_counts(counts, np.concatenate(held))
        blocks = [b for b in range(0, join.cells, _CELL_BLOCK) if counts[b : b + _CELL_BLOCK].any()]
        for some in range(0, len(blocks), 64):
            mine = blocks[some : some + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(mine), np.int32)),
                    pa.array(mine, pa.int64()),
                    pa.nulls(len(mine), pa.int64()),
                    pa.nulls(len(mine), pa.int64()),
                    pa.array([pa.compress(counts[b : b + _CELL_BLOCK].tobytes(), "zstd", asbytes=True) for b in mine], pa.binary()),
                ],
                ["part", "doc_id", "n_shingles", "set_id", "counts"],
            )

    return run


def _block_levels(join: JaccardJoin, mean: int):
    """Sum the blocks of counters that this task received; a level per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(_CELL_BLOCK, join.cells)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("doc_id").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(pa.decompress(counts, 2 * size, "zstd"), "<u2").astype(np.int64)
                sums[block] = sums[block] + got if block in sums else got
        if sums:
            levels = []
            for counts in sums.values():
                above = np.maximum(counts - mean, 0)
                level = np.floor(np.log2(above + 1)).astype(np.uint8)
                levels.append(np.where(above >= join.frequent, level + 64, level).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(levels, pa.binary())], ["block", "levels"])

    return run


def _levels(join: JaccardJoin, survey: DataFrame) -> np.ndarray:
    """One byte per cell: its rarity level, plus 64 where tokens are frequent.
    The driver holds the fixed number of cells, never the tokens."""
    (tokens,) = survey.where("part = 0").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    blocks = (
        survey.where("part = 1")
        .repartition(max(1, join.cells // _CELL_BLOCK // 16), "doc_id")
        .mapInArrow(worker.releasing(_block_levels(join, tokens // join.cells)), "block long, levels binary")
    )
    level = np.zeros(join.cells, np.uint8)
    for block, piece in blocks.toLocalIterator():
        level[block : block + _CELL_BLOCK] = np.frombuffer(piece, np.uint8)
    return level


def _classes(join: JaccardJoin, size: int) -> tuple[int, int]:
    """Class counts of a size's group and of the next."""
    ratio = join.under / join.over
    group = math.floor(math.log(size, ratio) + 1e-9)
    each = [(1 - join.over / join.under) * ratio**g / join.class_tokens for g in (group, group + 1)]
    return max(1, int(each[0])), max(1, int(each[1]))


def prefix_signatures(join: JaccardJoin, tokens: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set, the place in the order of each one's last token,
    and how many places from the first on are signatures of one token.

    ``tokens`` are in the common order and ``level`` belongs to them.
    """
    need = join.lost(len(tokens)) + 1
    if len(tokens) < 2 or level[need - 1] < 64:
        need = min(need, len(tokens))
        return tokens[:need], np.arange(need), need
    rare = int(np.searchsorted(level, 64))
    made, places = [tokens[:rare]], [np.arange(rare)]
    for classes in sorted(set(_classes(join, len(tokens)))):
        of = ((tokens[rare:] >> np.uint64(40)) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        later = np.ones(len(of), np.int64)  # all but the first of each class count
        later[order[np.flatnonzero(np.diff(of[order], prepend=-1))]] = 0
        stop = int(np.searchsorted(rare + np.cumsum(later), need)) + 1
        order = order[order < stop]
        bounds = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                left, right = order[a:b][i], order[a:b][j]
                made.append(bytetext.mix(bytetext.mix(tokens[rare + left] + np.uint64(1)) + tokens[rare + right]))
                places.append(rare + np.maximum(left, right))
    sig, place = np.concatenate(made), np.concatenate(places)
    sig, at = np.unique(sig, return_index=True)
    return sig, place[at], rare


def _signatures(join: JaccardJoin, levels):
    """Signature rows of the distinct sets that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen, mask = levels.value, set(), np.uint64(join.cells - 1)
        for batch in batches:
            for _, _, raw, offs in bytetext.slices(batch.column("text")):
                sigs, places, ids, sizes, singles, reps = [], [], [], [], [], []
                for tokens in _sets(raw, offs, join.n):
                    if not len(tokens) or (own := _set_id(tokens)) in seen:
                        continue
                    seen.add(own)
                    lev = level[tokens & mask]
                    order = np.argsort(lev, kind="stable")
                    sig, place, single = prefix_signatures(join, tokens[order], lev[order])
                    sigs.append(sig)
                    places.append(place)
                    ids.append(own)
                    sizes.append(len(tokens))
                    singles.append(single)
                    reps.append(len(sig))
                if sigs:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(sigs).view(np.int64)),
                            pa.array(np.repeat(np.array(ids, np.int64), reps)),
                            pa.array(np.repeat(np.array(sizes, np.int32), reps)),
                            pa.array(np.concatenate(places).astype(np.int32)),
                            pa.array(np.repeat(np.array(singles, np.int32), reps)),
                        ],
                        ["sig", "set_id", "size", "place", "singles"],
                    )

    return run


def _filter_bits(ids: int) -> int:
    """Bits of a filter for so many ids, between 2^20 and 2^26 (8 MB)."""
    return 1 << min(26, max(20, (16 * ids).bit_length()))


def _spots(ids: np.ndarray, bits: int) -> np.ndarray:
    h = bytetext.mix(ids.view(np.uint64).copy())
    return np.concatenate([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits, bool)
        for batch in batches:
            marks[_spots(batch.column("set_id").to_numpy(), bits)] = True
        if marks.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marks).tobytes()], pa.binary())], ["bits"])

    return run


def _bitmap(tokens: np.ndarray) -> bytes:
    """One bit for each token, in a power of two of at least twice as many."""
    size = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _wanted_sets(join: JaccardJoin, docs: DataFrame, ids: DataFrame, form=np.ndarray.tobytes) -> DataFrame:
    """(set_id, tokens) of the sets asked for, computed again from the texts.

    A filter of bounded size leaves out most other sets; a set may come once
    from each task that has it.
    """
    spark = docs.sparkSession
    size = _filter_bits(ids.count())
    packed = np.zeros(size // 8, np.uint8)
    for (bits,) in ids.coalesce(8).mapInArrow(_mark(size), "bits binary").toLocalIterator():
        packed |= np.frombuffer(bits, np.uint8)
    held = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(held.value).view(bool), set()
        for batch in batches:
            for _, _, raw, offs in bytetext.slices(batch.column("text")):
                sets, own = [], []
                for tokens in _sets(raw, offs, join.n):
                    if len(tokens):
                        sets.append(tokens)
                        own.append(_set_id(tokens))
                if not sets:
                    continue
                hit = bits[_spots(np.array(own, np.int64), size)].reshape(2, -1).all(0)
                keep = [i for i in np.flatnonzero(hit) if own[i] not in seen]
                keep = list({own[i]: i for i in keep}.values())
                seen.update(own[i] for i in keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[i] for i in keep], pa.int64()), pa.array([form(sets[i]) for i in keep], pa.binary())],
                    ["set_id", "tokens"],
                )

    return docs.select("text").mapInArrow(worker.releasing(run), "set_id long, tokens binary")


def _bounded(join: JaccardJoin, pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps permit the threshold.

    A bit of one set that the other lacks proves a token that it lacks, so the
    bound never drops a similar pair; a larger map folds to a smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c) for c in ("left", "right"))
            for left, right, na, nb in zip(*columns, batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True):
                x, y = (np.frombuffer(m.as_buffer(), np.uint8) for m in (left, right))
                while len(x) > len(y):
                    x = x[: len(x) // 2] | x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] | y[len(y) // 2 :]
                lacks = (int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum()))
                keep.append((join.over + join.under) * min(na - lacks[0], nb - lacks[1]) >= join.over * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(maps.toDF("a", "left", "na"), "a").join(maps.toDF("b", "right", "nb"), "b")
    return both.select("a", "b", "left", "right", "na", "nb").mapInArrow(worker.releasing(run), "a long, b long")


#: Members that are verified against one copy of their hub.
_MEMBERS = 1000


def _verified(join: JaccardJoin, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    The members b of a hub a are brought to it; a hub with many members is
    copied to as many places, so no place holds more than a bounded number.
    Both sides are sorted, and pass one after another.
    """
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / _MEMBERS).cast("int").alias("places"))
    places = staged(places, "hubs")
    dealt = broadcast_if_small(
        staged(pairs.join(places, "a").select("a", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("at"), "b"), "dealt")
    )
    hubs = broadcast_if_small(staged(places.select("a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("at")), "hubs"))
    members = sets.join(dealt, sets["set_id"] == dealt["b"]).select("a", "at", "b", "tokens")
    heads = sets.join(hubs, sets["set_id"] == hubs["a"]).select("a", "at", F.lit(None).cast("long").alias("b"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, x = None, None
        for batch in batches:
            left, right = [], []
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tokens"), strict=True)
            for a, b, tokens in rows:
                y = np.frombuffer(tokens.as_buffer(), np.uint64)
                if b is None:
                    hub, x = a, y.copy()
                    continue
                assert hub == a, "a member came without its hub"
                z = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((z[1:] == z[:-1]).sum())
                if join.under * shared >= join.over * (len(x) + len(y) - shared):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    together = members.union(heads).repartition("a", "at").sortWithinPartitions("a", "at", F.col("b").asc_nulls_first())
    return together.select("a", "b", "tokens").mapInArrow(worker.releasing(run), "a long, b long").distinct()


def _possible(join: JaccardJoin, x, y):
    """Bounds of two members of a bucket, as a condition.  x and y give the
    columns of each: size, place of the signature's last token, and live tokens
    before it."""
    small, large = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
    after = F.least(x("size") - x("place"), y("size") - y("place")) - 1
    most = F.least(x("before"), y("before")) + 1 + after
    total = (x("size") + y("size")).cast("long")
    return (join.under * small >= join.over * large) & ((join.over + join.under) * most >= join.over * total)


def _buckets(join: JaccardJoin, docs: DataFrame, levels) -> DataFrame:
    """Rows (sig, set_id, size, place, before, most) of the sets that share a
    signature with a set which the bounds permit; one bucket of each members.
    ``most``: tokens that it may share with others of the bucket."""
    in_bucket, bucket = Window.partitionBy("sig").orderBy("set_id"), Window.partitionBy("sig")
    here = F.struct("size", "place", F.col("place").alias("before"))
    other = F.coalesce(F.lag("here").over(in_bucket), F.lead("here").over(in_bucket))
    rows = (
        docs.select("text")
        .mapInArrow(worker.releasing(_signatures(join, levels)), "sig long, set_id long, size int, place int, singles int")
        .withColumn("twin", F.lag("set_id").over(in_bucket))
        .where("twin is null or twin <> set_id")
        .withColumn("after", F.lead("set_id").over(in_bucket))
        .withColumn("prior", F.lag("set_id").over(in_bucket))
        .where("prior is not null or after is not null")
        .drop("twin", "after", "prior")
        .withColumn("here", here)
        .withColumns({"n": F.count("*").over(bucket), "low": F.min("set_id").over(bucket), "all": F.bit_xor(F.xxhash64("set_id")).over(bucket)})
        .withColumn("other", F.when(F.col("n") == 2, other))
        .where((F.col("n") > 2) | _possible(join, lambda c: F.col("here")[c], lambda c: F.col("other")[c]))
        .select("sig", "set_id", "size", "place", "singles", F.xxhash64("all", "n", "low").alias("members"))
    )
    with batch_rows(docs.sparkSession, 1024):
        rows = staged(rows, "buckets")
    kept = staged(rows.groupBy("members").agg(F.min("sig").alias("sig")).select("sig", F.lit(True).alias("kept")), "kept")
    rows = rows.join(broadcast_if_small(kept), "sig", "left")
    of_set = Window.partitionBy("set_id")
    single = F.col("place") < F.col("singles")
    dead = F.col("singles") - F.col("live")
    rows = (
        rows.select(*[F.when(F.col("kept"), F.col(c)).alias(c) for c in ("sig", "size")], "set_id", "place", "singles")
        .withColumns({"live": F.count(F.when(single, 1)).over(of_set), "nth": F.row_number().over(of_set.orderBy("place"))})
        .withColumn("before", F.when(single, F.col("nth") - 1).otherwise(F.col("place") - dead))
        .select("sig", "set_id", "size", "place", "before")
        .where("sig is not null")
        .withColumn("most", F.col("before") + F.col("size") - F.col("place"))
    )
    able = (join.over + join.under) * F.col("most") >= join.over * (F.col("size") + F.min("size").over(bucket))
    return rows.withColumn("able", able).where("able").drop("able")


def similar_sets(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> tuple[DataFrame, DataFrame]:
    """(survey, roots) of (doc_id, text) rows.

    survey: doc_id, n_shingles, set_id of each text (no set_id where the set
    is empty); roots: node, root over set ids for the sets that a chain of
    links joins with another set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batch_rows(spark, 1024):
        survey = staged(
            docs.mapInArrow(worker.releasing(_survey(join)), "part int, doc_id long, n_shingles long, set_id long, counts binary"), "survey"
        )
    levels = spark.sparkContext.broadcast(_levels(join, survey))
    by_share = Window.partitionBy("sig").orderBy(F.desc(F.col("most") / F.col("size")), "set_id")
    hub = F.first(F.struct("set_id", "size", "place", "before")).over(by_share)
    rows = staged(_buckets(join, docs, levels).withColumn("hub", hub), "open")

    met = rows.where("set_id <> hub.set_id").where(_possible(join, F.col, lambda c: F.col("hub")[c]))
    met = met.groupBy(F.col("hub.set_id").alias("a"), F.col("set_id").alias("b")).agg(F.count("*").alias("n"))
    nearest = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    first = met.withColumn("nth", F.row_number().over(nearest)).where("nth = 1").select("a", "b")
    links = _checked(join, docs, staged(first, "first"))
    roots = components(links)

    bucket = Window.partitionBy("sig")
    apart = (
        rows.drop("hub", "most")
        .join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
        .withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket), "n": F.count("*").over(bucket)})
        .where("low <> high")
        .drop("low", "high")
    )
    # A set's buckets, large ones first: what it has before this one.
    in_turn = Window.partitionBy("set_id").orderBy(F.desc("n"), "sig")
    every = in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = apart.withColumns({"nth": F.row_number().over(in_turn), "sigs": F.slice(F.collect_list("sig").over(every), 1, join.known)})
    prior = [F.when(F.col("nth") > k + 1, F.get("sigs", k)).alias(f"prior{k}") for k in range(join.known)]
    apart = staged(turns.select("sig", "set_id", "size", "place", "before", "root", *prior), "apart")
    right = apart.select("sig", *[F.col(c).alias(f"its_{c}") for c in apart.columns if c != "sig"])
    met = F.lit(False)
    for k in range(join.known):
        for its in range(join.known):
            met = met | (F.col(f"prior{k}") == F.col(f"its_prior{its}"))
    pairs = (
        apart.join(right, "sig")
        .where("set_id < its_set_id and root <> its_root")
        .where(_possible(join, F.col, lambda c: F.col(f"its_{c}")))
        .where(~F.coalesce(met, F.lit(False)))
        .select(F.col("set_id").alias("a"), F.col("its_set_id").alias("b"))
        .distinct()
    )
    with uncoalesced(spark):  # few bytes, many comparisons
        pairs = staged(pairs, "pairs")
    if pairs.isEmpty():
        return survey.where("part = 0").select("doc_id", "n_shingles", "set_id"), roots
    sized = apart.select("set_id", "size").distinct()
    with batch_rows(spark, 1024):
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        maps = _wanted_sets(join, docs, staged(ids, "ids"), _bitmap).dropDuplicates(["set_id"])
        maps = staged(maps.join(sized, "set_id"), "bitmaps")
    more = _checked(join, docs, staged(_bounded(join, pairs, maps), "bounded"))
    if not more.isEmpty():
        roots = components(links.union(more))
    return survey.where("part = 0").select("doc_id", "n_shingles", "set_id"), roots


def _checked(join: JaccardJoin, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table whose sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    with batch_rows(docs.sparkSession, 1024):
        sets = staged(_wanted_sets(join, docs, staged(ids, "ids")), "sets")
    with batch_rows(docs.sparkSession, 256):
        return staged(_verified(join, pairs, sets), "links")


def near_duplicate_groups(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """doc_id, n_shingles, component_id of (doc_id, text) rows.

    component_id is the smallest doc_id reachable over links of similarity
    ``over / under`` or more.  A null or empty text, or one without words, has
    an empty set and stands alone; equal sets are linked; a doc_id that
    repeats keeps a row each; other columns are ignored; no rows give no rows.
    """
    survey, roots = similar_sets(docs, join)
    least = survey.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = least.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "least", F.coalesce("root", "set_id").alias("root")
    )
    linked = classes.groupBy("root").agg(F.min("least").alias("component"))
    by_set = classes.join(linked, "root").select("set_id", "component")
    return survey.join(by_set, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
