"""Operator 9: token-id matrices by best-fit-decreasing packing with a segment tree.

Every input split is packed on its own, window by window, so nothing is shuffled. In a
window, pieces go from the longest to the shortest into the sequence with the least room
that still fits; a segment tree over the amounts of room finds it in a logarithmic number
of steps. Documents longer than a sequence are cut without loss. A sequence leaves as one
row of a fixed-width matrix of little-endian unsigned 32-bit ids (padded), with cumulative
segment lengths and position ids that restart at every segment. ``write_matrix`` and
``read_matrix`` put the rows on storage and back; ``unpack`` restores the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import prepare, table
from tidewake.llm.tokens import END, cut, document_ids

SIZE = 1024
PAD = 0
#: Ids that one window of a split holds before it is packed.
WINDOW_IDS = 2 << 20


class RoomTree:
    """Segment tree over amounts of room 0..size: which is the least amount >= n that some bin has?"""

    def __init__(self, size: int):
        self.leaves = 1 << (size).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest bin with that much room, which is taken out; None if none has."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up until a right neighbour has some
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Places of the lengths in each bin."""
    tree, out = RoomTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = (size, len(out))
            out.append([])
        room, k = found
        out[k].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], k)
    return out


_ROW = (
    ("sequence_id", "long", pa.int64()), ("n_tokens", "int", pa.int32()), ("doc_ids", "array<long>", pa.list_(pa.int64())), ("pieces", "array<int>", pa.list_(pa.int32())),
    ("starts", "array<long>", pa.list_(pa.int64())), ("cu_seqlens", "array<int>", pa.list_(pa.int32())), ("ids", "binary", pa.binary()), ("positions", "binary", pa.binary()),
)


def pack_window(docs: list[tuple[int | None, np.ndarray]], size: int, pad: int) -> Iterator[tuple]:
    """(doc_id, ids) pairs to rows without their sequence id."""
    pieces = [(doc_id, i, at, ids[at : at + n]) for doc_id, ids in docs for i, (at, n) in enumerate(cut(len(ids), size))]
    for own in best_fit_decreasing([len(p[3]) for p in pieces], size):
        parts = [pieces[i] for i in own]
        lengths = [len(p[3]) for p in parts]
        used = sum(lengths)
        row = np.full(size, pad, "<u4")
        row[:used] = np.concatenate([p[3] for p in parts])
        positions = np.zeros(size, "<u4")
        positions[:used] = np.concatenate([np.arange(n) for n in lengths])
        yield used, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], [0, *np.cumsum(lengths).tolist()], row.tobytes(), positions.tobytes()


def _packer(size: int, pad: int, vocabulary: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40

        def out(docs):
            nonlocal number
            rows = []
            for r in pack_window(docs, size, pad):
                rows.append((number, *r))
                number += 1
                if len(rows) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, _, k) in zip(zip(*rows), _ROW)], names=[n for n, _, _ in _ROW])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, _, k) in zip(zip(*rows), _ROW)], names=[n for n, _, _ in _ROW])

        docs, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = document_ids(text.as_py(), vocabulary, end)
                docs.append((doc_id, ids))
                held += len(ids)
                if held >= WINDOW_IDS:
                    yield from out(docs)
                    docs, held = [], 0
        yield from out(docs)

    return run


def token_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, pad: int = PAD, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, doc_ids, pieces, starts, cu_seqlens, ids, positions.

    ``doc_ids``, ``pieces`` (a document's cuts from 0) and ``starts`` (its ids before the
    piece) run along the segments; ``cu_seqlens`` has one entry more. A null or empty text is
    its end id alone; null and repeated identifiers are packed row by row. An empty table
    gives no rows. Sequence ids are unique, not consecutive.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_packer(size, pad, vocabulary, end), ", ".join(f"{n} {k}" for n, k, _ in _ROW))


def write_matrix(docs: DataFrame, path: str, **options) -> None:
    """Pack ``docs`` and write the matrix rows as Parquet."""
    token_matrix(docs, **options).write.parquet(path)


def read_matrix(rows: list, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) matrices of collected rows."""
    wide = lambda name: np.frombuffer(b"".join(bytes(r[name]) for r in rows), "<u4").reshape(-1, size)
    return wide("ids"), wide("positions")


def unpack(matrix: DataFrame) -> DataFrame:
    """Back to (doc_id, piece, start, ids): one row per segment."""
    s = F.explode(F.arrays_zip("doc_ids", "pieces", "starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("lo"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("hi"))).alias("s")
    cut_ids = F.substring(F.col("ids"), F.col("s.lo") * 4 + 1, (F.col("s.hi") - F.col("s.lo")) * 4)
    return matrix.select("ids", s).select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"), cut_ids.alias("ids"))


def op9_token_matrix(spark, sf_dir: str) -> DataFrame:
    m = token_matrix(table(spark, sf_dir, "documents"))
    return m.select(
        "sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "starts", "cu_seqlens",
        "ids", "positions", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )
