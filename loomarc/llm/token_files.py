"""Token ids in fixed-width bit-packed files.

Every id takes ``bits`` bits, the fewest that hold the vocabulary's largest
id.  Ids are packed little-endian, bit after bit: id k of a block lies at bit
``k * bits``, so any range unpacks in numpy without reading what is before it.

A table of token files is a folder of Parquet files, which Spark writes and
commits and which any store that Spark reaches can hold.  Each row is a block:

    shard      files' order; a shard holds consecutive documents
    block      number within the shard
    first      ids of the shard before this block
    n_ids      ids in the block
    bits       bits of an id
    doc_ids    documents in the block, in order
    offsets    where each document begins in the block, and n_ids at the end
    payload    the packed ids

Blocks hold whole documents, so offsets give random access to a document and
bit places give it to an id.  ``first`` plus the ids of all earlier shards is
a block's place in the whole stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import worker
from .bytetext import text_buffers
from .common import batch_rows, broadcast_if_small, staged

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16

BLOCKS = (
    "shard int, block int, first long, n_ids long, bits int,"
    " doc_ids array<long>, offsets array<long>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of this size."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids of at most ``bits`` bits (1 to 32)."""
    if not 1 <= bits <= 32:
        raise ValueError("1 to 32 bits")
    ids = np.asarray(ids, np.uint64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    groups = -(-len(ids) // 8)
    lanes = np.zeros(groups * 8, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(groups, 8)
    out = np.zeros((groups, bits), np.uint8)  # eight ids take ``bits`` bytes
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range((bits + shift + 7) // 8):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed block, as uint32."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if bits == 16:
        return np.frombuffer(payload, "<u2", stop - start, 2 * start).astype(np.uint32)
    group = start // 8
    raw = np.frombuffer(payload, np.uint8)[group * bits : (-(-stop // 8)) * bits]
    groups = -(-stop // 8) - group
    padded = np.zeros(groups * bits, np.uint8)
    padded[: len(raw)] = raw
    table = padded.reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, np.uint64)
        for k in range((bits + shift + 7) // 8):
            value |= table[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.ravel()[start - group * 8 : stop - group * 8]


class _Kept(dict):
    """Ids of pieces; one that is asked for and missing is noted, and gets its
    ids when it has been learned.  What a generation before this one knew is
    taken over when it is asked for.  ``held`` is what pieces and ids take in
    bytes, with ``EACH`` for a place in the table."""

    EACH = 48

    def __init__(self, before: dict[str, bytes]):
        self.new: list[str] = []
        self.open: list[bytearray] = []
        self.before = before
        self.held = 0

    def next(self) -> _Kept:
        """The generation after this one, which lets go what was before it."""
        self.before = {}
        return _Kept(self)

    def hold(self, pieces: list[str], ids: list[bytes]) -> None:
        self.update(zip(pieces, ids, strict=True))
        self.held += self.EACH * len(pieces) + sum(map(getsizeof, pieces)) + sum(map(getsizeof, ids))

    def __missing__(self, piece: str) -> bytes | bytearray:
        ids = self.before.get(piece)
        if ids is not None:
            self[piece] = ids
            self.held += self.EACH + getsizeof(piece) + getsizeof(ids)
            return ids
        ids = self[piece] = bytearray()
        self.new.append(piece)
        self.open.append(ids)
        return ids


class Encoder:
    """Ids of whole texts as the library gives them, piece by piece.

    The library's byte-level tokenizer merges within pre-tokens only, and none
    of them goes on from other characters into white space.  So a text may be
    cut before every run of white space; each distinct piece is encoded by the
    library once and its ids are kept.  Texts are cut at the special strings
    first, as the library does.  What is kept is bounded in bytes, as pieces
    may be of any length: when a generation is full a new one begins, which
    takes over what it meets again.
    """

    #: Bytes of pieces and ids after which a generation is full; two are kept.
    KEPT = 60_000_000
    #: Marks that often end a word.
    MARKS = ".,;:!?"
    #: White space of Unicode (fixed values).
    WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str, kept: int | None = None):
        import json
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and told.get("normalizer") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        )
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.by_piece = self.by_piece and len(line) == 1
        self.line = line[0] if line else None
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        #: White space other than single spaces and line ends.
        self.odd = [a + b for a in " \n" for b in " \n"] + [c for c in re.findall(rf"[{self.WHITE}]", "".join(map(chr, range(0x3001)))) if c not in " \n"] + ["\0", "\1"]
        self.cut = re.compile(rf"[{self.WHITE}]*[^{self.WHITE}]+|[{self.WHITE}]+").findall
        self.kept, self.full = _Kept({}), self.KEPT if kept is None else kept

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            made = self.library.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, np.uint32) for e in made]
        if self.kept.held > self.full:
            self.kept = self.kept.next()
        kept = self.kept
        found = [list(map(kept.__getitem__, self._pieces(t))) for t in texts]
        if kept.new:
            new, waiting = kept.new, kept.open
            kept.new, kept.open = [], []
            self._learn(new)
            for _ in map(bytearray.extend, waiting, map(kept.__getitem__, new)):
                pass
        return [np.frombuffer(b"".join(f), np.uint32) for f in found]

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; one without leading white space, unless it is a
        text's first, goes without the space before it (it saves copying)."""
        if self.split and any(s in text for s in self.special):
            out = []
            for part in self.split(text):
                out += [f"\0{part}"] if part in self.special else self._whole(self.cut(part))
            return out
        if any(c in text for c in self.odd):
            return self._whole(self.cut(text))
        first, *more = text.replace("\n", " \n").split(" ")
        return self._whole([first]) + more if first else more

    @staticmethod
    def _whole(pieces: list[str]) -> list[str]:
        return [f"\1{p}" for p in pieces]

    def _learn(self, new: list[str]) -> None:
        """Encode pieces: \\0 marks a special string, \\1 a piece as it is;
        others follow a space unless they begin a line.  Marks that end a
        piece after a letter or digit are a pre-token of their own, so its
        ids are those of the piece without them and theirs."""
        kept, plain, lines, ended = self.kept, [p for p in new if p.isalnum()], {}, []
        for p in [p for p in new if not p.isalnum()]:
            if p[:1] == "\0":
                kept.hold([p], [np.uint32(self.special[p[1:]]).tobytes()])
            elif p[:1] == "\1" or p in ("", "\n"):
                self._as_it_is(p, p[1:] if p[:1] == "\1" else p or " ")
            else:
                stem = p.rstrip(self.MARKS)
                if len(stem) < len(p) and stem and stem[-1] < "\u0250" and stem[-1].isalnum():
                    ended.append((p, stem))
                    p = stem
                    if p in kept:
                        continue
                if p[0] == "\n":
                    lines[p] = None
                else:
                    plain.append(p)
        # A line end before a space or a word is a token of its own, so one
        # text of many lines gives the ids of many pieces.
        for pieces, lead in ((list(dict.fromkeys(plain)), "\n "), (list(lines), "")):
            for k in range(0, len(pieces), 500):
                some = pieces[k : k + 500]
                ids = np.array(self.library.encode_batch_fast([lead + lead.join(some)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.line)
                if len(cuts) != len(some):
                    raise ValueError("the tokenizer does not keep line ends apart")
                raw = ids.tobytes()
                begins = (4 * (cuts + len(lead) // 2)).tolist()
                ends = [*(4 * cuts[1:]).tolist(), len(raw)]
                kept.hold(some, list(map(raw.__getitem__, map(slice, begins, ends))))
        for p, stem in ended:
            marks = p[len(stem) :]
            kept.hold([p], [bytes(kept[stem]) + (kept.get(f"\1{marks}") or self._as_it_is(f"\1{marks}", marks))])

    def _as_it_is(self, piece: str, text: str) -> bytes:
        self.kept.hold([piece], [np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()])
        return self.kept[piece]


#: Texts encoded together, and their bytes; a longer text is encoded alone.
TEXTS, TEXT_BYTES = 256, 1 << 20


def encoder(path: str, kept: int | None = None) -> Encoder:
    """One encoder for each file and worker; it runs on the task's own core."""
    encoders = worker.kept("token_files")
    if (path, kept) not in encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoders.clear()
        encoders[path, kept] = Encoder(path, kept)
    return encoders[path, kept]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many at a time as are encoded together."""
    ends = text_buffers(batch.column("text"))[1][1:]
    at, done = 0, 0
    while at < len(ends):
        to = min(max(int(np.searchsorted(ends, done + TEXT_BYTES, "right")), at + 1), at + TEXTS)
        part = batch.slice(at, to - at)
        at += part.num_rows
        done = int(ends[at - 1])
        yield part


def _blocks(path: str, end_id: int | None, block_ids: int, kept: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, kept)
        bits = bits_for(max(enc.vocabulary, (end_id or 0) + 1))
        shard = TaskContext.get().partitionId()
        block, first, held = 0, 0, 0
        docs, offsets, chunks = [], [0], []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([bits], pa.int32()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([pack(ids, bits)], pa.binary()),
                ],
                ["shard", "block", "first", "n_ids", "bits", "doc_ids", "offsets", "payload"],
            )

        for batch in batches:
            for part in _parts(batch):
                made = enc.encode([t or "" for t in part.column("text").to_pylist()])
                for doc, ids in zip(part.column("doc_id").to_pylist(), made, strict=True):
                    if end_id is not None:
                        ids = np.append(ids, np.uint32(end_id))
                    if docs and held + len(ids) > block_ids:
                        yield closed()
                        block, first, held = block + 1, first + held, 0
                        docs, offsets, chunks = [], [0], []
                    docs.append(doc)
                    chunks.append(ids)
                    held += len(ids)
                    offsets.append(held)
        if docs:
            yield closed()

    return run


def write_token_files(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    order: str = "doc_id",
    end_id: int | None = 0,
    shards: int | None = None,
    block_ids: int = BLOCK_IDS,
    kept: int | None = None,
) -> None:
    """Encode (doc_id, text) rows in ascending ``order`` and write token files.

    The range partitioning gives every shard about as many documents; ids are
    made after it, so only texts move.  Null and empty texts hold the end id
    alone; repeated rows are each written; rows with a null doc_id are written
    first; other columns are dropped; no rows give a folder without blocks.
    ``kept`` bounds in bytes each of the two generations of pieces that a
    worker keeps: less takes more time and gives the same ids.
    """
    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(order).alias("_order")
    )
    dealt = wanted.repartitionByRange(shards, "_order") if shards else wanted.repartitionByRange("_order")
    ordered = dealt.sortWithinPartitions("_order", "text").select("doc_id", "text")
    with batch_rows(docs.sparkSession, 1024):
        ordered.mapInArrow(worker.releasing(_blocks(tokenizer, end_id, block_ids, kept)), BLOCKS).write.parquet(out)


def read_blocks(spark, path: str) -> DataFrame:
    """The blocks of a folder, each with ``start``: all ids before it."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # a row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")), "shards")
    return blocks.join(broadcast_if_small(bases), "shard").withColumn("start", (F.col("base") + F.col("first")).cast("long"))


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.kept("token_reading")
        for batch in batches:
            for row in range(batch.num_rows):
                start, bits, docs, offsets, payload = (batch.column(c)[row].as_py() for c in ("start", "bits", "doc_ids", "offsets", "payload"))
                ids = unpack(payload, bits, 0, offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(np.array(offsets[:-1], np.int64) + start),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = read_blocks(spark, path).select("start", "bits", "doc_ids", "offsets", "payload")
    return blocks.mapInArrow(worker.releasing(run), "doc_id long, start long, n_tokens long, ids array<int>")


def document_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.kept("token_reading")
        for batch in batches:
            for row in range(batch.num_rows):
                start, bits, docs, offsets, payload = (batch.column(c)[row].as_py() for c in ("start", "bits", "doc_ids", "offsets", "payload"))
                ids = memoryview(unpack(payload, bits, 0, offsets[-1]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(np.array(offsets[:-1], np.int64) + start),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = read_blocks(spark, path).select("start", "bits", "doc_ids", "offsets", "payload")
    return blocks.mapInArrow(worker.releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
