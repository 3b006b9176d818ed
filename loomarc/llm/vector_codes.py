"""Vector code compression by product codebooks over anchors hierarchies.

A vector is cut into equal parts, and each part position has a codebook.
Vectors are gathered into blocks of bounded size; a block keeps one metric
tree for each part position, built once and read by every round:

* Middle-out: the point that lies farthest from its anchor becomes the next
  anchor and takes over the points that are nearer to it (a point nearer to its
  anchor than half the way to the new one is never looked at), until there are
  about sqrt(n).  Anchors of many points are split likewise.  Anchors are then
  merged upwards, those first whose common ball is smallest, to the root.
* Every ball caches the sum and the count of its points.

Assignment passes lists of candidate entries from the root downwards.  A ball
strikes out every entry that is farther than the one nearest to its centre for
all points that the ball can hold, and its children inherit what is left.  A
ball with one candidate is owned: its cached sum and count go to that entry as
they are.  Points of leaves compare the candidates left to them, exactly.

All components are integers, kept as doubles that hold them exactly, so sums,
distances and ties do not depend on how vectors are dealt to blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, broadcast_if_small, staged


@dataclass(frozen=True)
class PartCodes:
    """parts, entries per codebook, rounds of updates, and the factor before
    components are floored; block: most vectors of one set of trees; leaf: most
    points of a ball that is not split, unless they are all alike.  Block and
    leaf change the cost of a run and never its result."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    block: int = 4096
    leaf: int = 12


@dataclass
class Forest:
    """The trees of a block, one for each part position, root i for part i.

    ``points``: part vectors, leaf by leaf; ``place``: the vector each belongs
    to.  Of every ball: part, centre, radius (an upper bound), sum and count of
    its points, its two children, and, without children (-1), its points'
    range.
    """

    points: np.ndarray
    place: np.ndarray
    part: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    count: np.ndarray
    child: np.ndarray
    span: np.ndarray


#: Allowance for rounding in bounds, relative; far above that of doubles.
_SLACK = 1e-9


def _anchors(points: np.ndarray, first: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The anchor (from 0) of each point within its group, for groups of
    consecutive points that begin at ``first`` and want so many anchors."""
    sizes = np.diff(first, append=len(points))
    group = np.repeat(np.arange(len(first)), sizes)
    owner = np.zeros(len(points), np.int64)
    heads = np.zeros((len(first), int(want.max()), points.shape[1]))
    heads[:, 0] = points[first]
    away = ((points - heads[group, 0]) ** 2).sum(1)
    for k in range(1, int(want.max())):
        farthest = np.maximum.reduceat(away, first)
        grows = (want > k) & (farthest > 0)
        if not grows.any():
            break
        at = np.flatnonzero((away == farthest[group]) & grows[group])
        which, lowest = np.unique(group[at], return_index=True)
        heads[which, k] = points[at[lowest]]
        between = ((heads[:, :k] - heads[:, k : k + 1]) ** 2).sum(2)
        near = np.flatnonzero((4 * away > between[group, owner]) & grows[group])
        there = ((points[near] - heads[group[near], k]) ** 2).sum(1)
        taken = there < away[near]
        owner[near[taken]] = k
        away[near[taken]] = there[taken]
    return owner


def _merged(tree: list, groups: list[list[int]]) -> list[int]:
    """Merge the balls of each group, smallest common ball first; the roots.

    ``tree`` is a list of (part, total, count, centre, radius, children, span)
    columns that grows.  Groups are merged side by side, a pair each a step.
    """
    most = max(map(len, groups))
    ids = np.full((len(groups), most), -1)
    for g, members in enumerate(groups):
        ids[g, : len(members)] = members
    rows = np.arange(len(groups))
    live = ids >= 0
    part, total, count, centre, radius, child, span = tree
    for _ in range(most - 1):
        todo = np.flatnonzero(live.sum(1) > 1)
        if not len(todo):
            break
        here, alive = ids[todo], live[todo]
        c, r = centre[here], radius[here]
        square = (c**2).sum(2)
        gap = np.sqrt(np.maximum(square[:, :, None] + square[:, None, :] - 2 * np.einsum("gid,gjd->gij", c, c), 0))
        size = gap + r[:, :, None] + r[:, None, :]
        size[~(alive[:, :, None] & alive[:, None, :])] = np.inf
        size[:, np.arange(most), np.arange(most)] = np.inf
        i, j = np.divmod(size.reshape(len(todo), -1).argmin(1), most)
        a, b = here[rows[: len(todo)], i], here[rows[: len(todo)], j]
        new = np.arange(len(count), len(count) + len(todo))
        both, n = total[a] + total[b], count[a] + count[b]
        middle = both / n[:, None]
        reach = [np.sqrt(((middle - centre[x]) ** 2).sum(1)) + radius[x] for x in (a, b)]
        part = np.concatenate([part, part[a]])
        total, count, centre = np.concatenate([total, both]), np.concatenate([count, n]), np.concatenate([centre, middle])
        radius = np.concatenate([radius, np.maximum(*reach) * (1 + _SLACK)])
        child = np.concatenate([child, np.stack([a, b], 1)])
        span = np.concatenate([span, np.zeros((len(todo), 2), np.int64)])
        ids[todo, i] = new
        live[todo, j] = False
    tree[:] = [part, total, count, centre, radius, child, span]
    return [int(x) for x in ids[rows, live.argmax(1)]]


def build_forest(vectors: np.ndarray, rule: PartCodes = PartCodes()) -> Forest:
    """The trees of a block of vectors (n > 0 rows of whole numbers)."""
    n, width = len(vectors), vectors.shape[1] // rule.parts
    points = vectors.reshape(n, rule.parts, width).swapaxes(0, 1).reshape(-1, width).astype(np.float64)
    place = np.tile(np.arange(n), rule.parts)
    first = np.arange(rule.parts) * n
    path = np.repeat(np.arange(rule.parts), n)  # a number for each group, and which group it was split from
    above: list[np.ndarray] = []
    while True:
        sizes = np.diff(first, append=len(points))
        spread = np.maximum.reduceat(points, first) - np.minimum.reduceat(points, first)
        split = (sizes > rule.leaf) & (spread > 0).any(1)
        if not split.any():
            break
        want = np.where(split, np.ceil(np.sqrt(sizes)), 1).astype(np.int64)
        own = _anchors(points, first, want)
        key = path * int(want.max()) + own
        order = np.argsort(key, kind="stable")
        points, place, key = points[order], place[order], key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        above.append(path[order][first])
        path = np.repeat(np.arange(len(first)), np.diff(first, append=len(points)))
    sizes = np.diff(first, append=len(points))
    total = np.add.reduceat(points, first)
    centre = total / sizes[:, None]
    reach = np.sqrt(((points - np.repeat(centre, sizes, 0)) ** 2).sum(1))
    radius = np.maximum.reduceat(reach, first) * (1 + _SLACK)
    part = np.arange(rule.parts)
    for parents in above:
        part = part[parents]
    span = np.stack([first, first + sizes], 1)
    tree = [part, total, sizes.astype(np.float64), centre, radius, np.full((len(first), 2), -1), span]
    balls = list(range(len(first)))
    for parents in reversed(above):
        groups: list[list[int]] = [[] for _ in range(int(parents[-1]) + 1)]
        for ball, parent in zip(balls, parents.tolist(), strict=True):
            groups[parent].append(ball)
        balls = _merged(tree, groups)
    # The roots come first.
    order = np.concatenate([balls, np.setdiff1d(np.arange(len(tree[2])), balls)]).astype(np.int64)
    back = np.empty(len(order) + 1, np.int64)
    back[order], back[-1] = np.arange(len(order)), -1
    part, total, count, centre, radius, child, span = (x[order] for x in tree)
    return Forest(points, place, part, centre, radius, total, count, back[child], span)


class Assignment:
    """Sums and counts that each entry gets from the forests added."""

    def __init__(self, codebooks: np.ndarray) -> None:
        """``codebooks``: parts x entries x width."""
        self.codebooks = codebooks
        self.sums = np.zeros(codebooks.shape)
        self.counts = np.zeros(codebooks.shape[:2])
        self.owned = 0  # balls given away whole
        self.compared = 0  # points that compared candidates
        self.apart = np.sqrt(((codebooks[:, :, None] - codebooks[:, None]) ** 2).sum(3))
        # An entry equal to one before it never wins a tie.
        alike = (codebooks[:, :, None] == codebooks[:, None]).all(3)
        self.distinct = ~np.tril(alike, -1).any(2)

    def add(self, forest: Forest, coded: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """With ``coded``, the entry and the squared distance of each part."""
        parts, n = len(self.codebooks), int(forest.count[0])
        code, error = np.zeros((parts, n), np.int64), np.zeros((parts, n))
        balls, lists = np.arange(parts), self.distinct.copy()
        while len(balls):
            part = forest.part[balls]
            away = ((forest.centre[balls][:, None] - self.codebooks[part]) ** 2).sum(2)
            away[~lists] = np.inf
            best = away.argmin(1)
            least = away[np.arange(len(balls)), best][:, None]
            reach = 2 * forest.radius[balls][:, None] * self.apart[part, best] * (1 + _SLACK)
            lists &= ~(away - least > reach + _SLACK * (least + reach + 1))
            one = lists.sum(1) == 1
            leaf = forest.child[balls, 0] < 0
            whole = one & (leaf | (not coded))
            if whole.any():
                entry = lists[whole].argmax(1)
                np.add.at(self.sums, (part[whole], entry), forest.total[balls[whole]])
                np.add.at(self.counts, (part[whole], entry), forest.count[balls[whole]])
                self.owned += int(whole.sum())
            ends = leaf & ~one
            if coded or ends.any():
                self._compare(forest, balls, lists, np.flatnonzero(leaf if coded else ends), one, code, error, coded)
            down = ~leaf & ~whole
            lists = np.repeat(lists[down], 2, 0)
            balls = forest.child[balls[down]].ravel()
        return (code, error) if coded else None

    def _compare(self, forest, balls, lists, which, one, code, error, coded, most: int = 400_000) -> None:
        """Points of the leaves ``which`` against their lists, at most about
        ``most`` comparisons at a time."""
        spans = forest.span[balls[which]]
        load = np.cumsum((spans[:, 1] - spans[:, 0]) * lists[which].sum(1))
        for some in np.split(np.arange(len(which)), np.flatnonzero(np.diff(load // most)) + 1):
            if not len(some):
                continue
            own, span = which[some], spans[some]
            sizes = span[:, 1] - span[:, 0]
            of = np.repeat(np.arange(len(some)), sizes)
            at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + span[of, 0]
            part = forest.part[balls[own]][of]
            row, entry = np.nonzero(lists[own])
            begin = np.searchsorted(row, np.arange(len(some)))
            many = np.diff(begin, append=len(row))[of]
            first = np.cumsum(many) - many
            point = np.repeat(np.arange(len(of)), many)
            tried = entry[np.arange(len(point)) - np.repeat(first - begin[of], many)]
            away = ((forest.points[at[point]] - self.codebooks[part[point], tried]) ** 2).sum(1)
            least = np.minimum.reduceat(away, first)
            hits = np.flatnonzero(away == least[point])
            won = tried[hits[np.unique(point[hits], return_index=True)[1]]]
            if coded:
                code[part, forest.place[at]], error[part, forest.place[at]] = won, least
            open_ = ~one[own][of]
            np.add.at(self.sums, (part[open_], won[open_]), forest.points[at[open_]])
            np.add.at(self.counts, (part[open_], won[open_]), 1)
            self.compared += int(open_.sum())


_ARRAYS = {f: pa.float64() if f in ("points", "centre", "radius", "total", "count") else pa.int32() for f in Forest.__dataclass_fields__}


def _blocks(rule: PartCodes, width: int):
    """Rows of one block each: its rows, and the arrays of its forest."""

    def made(rows: list[pa.Array], vectors: list[np.ndarray]) -> pa.RecordBatch:
        forest = build_forest(np.concatenate(vectors), rule)
        rows_ = pa.concat_arrays(rows)
        flat = {f: pa.array(getattr(forest, f).ravel(), kind, safe=False) for f, kind in _ARRAYS.items()}
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows_, *flat.values())]
        return pa.RecordBatch.from_arrays(lists, ["rows", *flat])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Array] = []
        vectors: list[np.ndarray] = []
        held = 0
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scaled = np.floor(flat.reshape(-1, width) * rule.scale)
            if len(scaled) and 4 * width * np.abs(scaled).max() ** 2 >= 2**53:
                raise ValueError("components are too large for exact squared distances in 53 bits")
            at = 0
            while at < len(scaled):
                n = min(rule.block - held, len(scaled) - at)
                rows.append(batch.column("row").slice(at, n))
                vectors.append(scaled[at : at + n])
                held, at = held + n, at + n
                if held == rule.block:
                    yield made(rows, vectors)
                    rows, vectors, held = [], [], 0
        if held:
            yield made(rows, vectors)

    return run


def _forests(batch: pa.RecordBatch, width: int) -> Iterator[Forest]:
    shapes = {"points": width, "centre": width, "total": width, "child": 2, "span": 2}
    for k in range(batch.num_rows):
        flat = {f: batch.column(f).slice(k, 1).flatten().to_numpy() for f in _ARRAYS}
        yield Forest(**{f: x.reshape(-1, shapes[f]) if f in shapes else x for f, x in flat.items()})


def _gathered(codebooks: np.ndarray):
    """Per part, entry and component: the sum and count of a task's points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Assignment(codebooks)
        for batch in batches:
            for forest in _forests(batch, codebooks.shape[2]):
                seen.add(forest)
        part, entry = np.nonzero(seen.counts)
        columns = [np.repeat(part, codebooks.shape[2]), np.repeat(entry, codebooks.shape[2])]
        columns += [np.tile(np.arange(codebooks.shape[2]), len(part)), seen.sums[part, entry].ravel(), np.repeat(seen.counts[part, entry], codebooks.shape[2])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "at", "total", "n"])

    return run


def _coded(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Assignment(codebooks)
        for batch in batches:
            for k, forest in enumerate(_forests(batch, codebooks.shape[2])):
                code, error = seen.add(forest, coded=True)
                codes = pa.ListArray.from_arrays(np.arange(0, code.size + 1, len(code), dtype=np.int32), pa.array(code.T.ravel(), pa.int32()))
                rows = batch.column("rows").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([rows, codes, pa.array(error.sum(0).astype(np.int64))], ["row", "codes", "error"])

    return run


def usable(embedding: str = "embedding"):
    """A vector without null or non-finite components, and not null itself."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & fine


def codebooks_text(codebooks: np.ndarray) -> str:
    return ",".join(str(int(x)) for x in codebooks.ravel())


def compress(vectors: DataFrame, rule: PartCodes = PartCodes()) -> tuple[DataFrame, np.ndarray]:
    """(row, codes, error) of rows with ``vec_id`` and ``embedding``, and the
    codebooks (parts x entries x width).

    ``row`` is the given row as one column, without its vector, so its columns
    may have any names; ``codes`` has the entry of each part and ``error`` the
    sum of their squared distances, of components floor(scale * x).

    Codebooks begin as the parts of the vectors of the smallest ids (nulls
    last, ties by components).  A round puts every part to the nearest entry
    (ties: the lower one) and replaces each entry used by the floored mean of
    its parts.  Rows without a :func:`usable` vector, or with one of another
    length than the vector of the smallest id, are left out; that length must
    be a multiple of the parts.  Repeated rows give a row each; fewer rows than
    entries give smaller codebooks; no rows give no rows and no entries.
    """
    kept = vectors.where(usable())
    firsts = kept.select(F.col("vec_id").alias("_id"), F.col("embedding").cast("array<double>").alias("_v")).orderBy(F.col("_id").asc_nulls_last(), "_v")
    width = next((len(r._v) for r in firsts.limit(1).collect()), rule.parts)
    if width % rule.parts or not width:
        raise ValueError(f"vectors of {width} components have no {rule.parts} equal parts")
    seeds = [r._v for r in firsts.where(F.size("_v") == width).limit(rule.entries).collect()]
    others = [c for c in vectors.columns if c != "embedding"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    rows = kept.where(F.size("embedding") == width).select(row, "embedding")
    fields = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))])
    for f, kind in _ARRAYS.items():
        fields = fields.add(f, T.ArrayType(T.DoubleType() if kind == pa.float64() else T.IntegerType()))
    codebooks = np.floor(np.array(seeds, np.float64).reshape(len(seeds), rule.parts, width // rule.parts) * rule.scale).swapaxes(0, 1)
    result = T.StructType([rows.schema["row"]]).add("codes", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    if not seeds:
        return vectors.sparkSession.createDataFrame([], result), np.zeros((rule.parts, 0, 0))
    with batch_rows(vectors.sparkSession, rule.block):
        blocks = staged(rows.mapInArrow(_blocks(rule, width), fields), "blocks")
    with batch_rows(vectors.sparkSession, 4):
        for _ in range(rule.rounds):
            sums = blocks.mapInArrow(_gathered(codebooks), "part long, entry long, at long, total long, n long")
            sums = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            codebooks = codebooks.copy()
            for r in sums.collect():  # at most the components of the codebooks
                codebooks[r.part, r.entry, r.at] = r.total // r.n
        return staged(blocks.mapInArrow(_coded(codebooks), result), "codes"), codebooks


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``: the errors of all rows of a row's label, summed;
    nulls are one label.  Labels are summed before they are joined."""
    coded = coded.withColumn("_label", F.col("row")[label])
    totals = staged(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("_label", "_its")
    return coded.join(broadcast_if_small(totals), F.col("_label").eqNullSafe(F.col("_its"))).drop("_label", "_its")


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
