"""Operator 1: exact deduplication by Patricia-trie owners.

Texts are equal when they are the same bytes after each run of ASCII white space has
become one space. Two passes:

1. every input split folds its texts in a compressed radix trie (the map-side combine: a
   group of copies leaves a split as one string), and the folded strings are dealt by
   length and content hash to partitions which insert them in tries of their own. A
   terminal node holds the smallest identifier and the number of copies. A trie beyond its
   memory budget writes its heaviest subtree to a file and goes on; spilled subtrees are
   finished one after another.
2. every document looks up its owner by length and content hash.

Full byte strings decide equality; length and SHA-256 only name an owner in the second pass.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import materialise, prepare, shuffle_width, table, text_bytes, without_rows

#: Bytes of edge labels and nodes that one trie keeps in memory.
MAP_TRIE_BYTES = 24 << 20
OWNER_TRIE_BYTES = 96 << 20
#: Bytes of a node beside its label: the object, its table of children and what a terminal holds.
NODE_BYTES = 480


def normalise(text: bytes) -> bytes:
    """Replace each run of the six ASCII white-space bytes by one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    if text[:1].isspace():
        out = b" " + out
    return out + b" " if text[-1:].isspace() else out


class _Node:
    __slots__ = ("label", "children", "value", "weight", "spill")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value, self.weight, self.spill = label, {}, value, len(label) + NODE_BYTES, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by bisection over slices."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings; values of equal strings are merged.

    ``merge(old, new)`` combines the values of one string. With a ``budget``, the trie keeps
    about so many bytes in memory (labels and nodes) and spills whole subtrees to temporary files,
    which ``items`` finishes recursively and removes.
    """

    def __init__(self, merge, budget: int | None = None):
        self.merge, self.budget = merge, budget
        self.root, self.bytes, self.terminals = _Node(b""), 0, 0

    def insert(self, key: bytes, value) -> None:
        node, at, path = self.root, 0, []
        while True:
            path.append(node)
            if node.spill is not None:
                self._append(node, key[at:], value)
                return
            if at == len(key):
                if node.value is None:
                    node.value = value
                    self.terminals += 1
                else:
                    node.value = self.merge(node.value, value)
                return
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:], value)
                self.terminals += 1
                self._grew(path, child.weight)
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = _common(child.label, key, at)
            upper = _Node(child.label[:k])
            upper.weight = child.weight  # the upper label comes out of the child's
            child.label = child.label[k:]
            child.weight -= k
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            path.append(upper)
            rest, more = key[at + k :], NODE_BYTES
            if rest:
                leaf = upper.children[rest[0]] = _Node(rest, value)
                more += leaf.weight
            else:
                upper.value = value
            self.terminals += 1
            self._grew(path, more)
            return

    def _grew(self, path: list[_Node], n: int) -> None:
        self.bytes += n
        for node in path:
            node.weight += n
        while self.budget and self.bytes > self.budget:
            if not self._spill():
                return

    def _append(self, node: _Node, rest: bytes, value) -> None:
        node.spill.write(struct.pack("<I", len(rest)) + rest + value.to_bytes())

    def _spill(self) -> bool:
        """Write the heaviest subtree of at most half the budget to a file; False if none branches."""
        path, node = [], self.root
        while True:
            path.append(node)
            inner = [c for c in node.children.values() if c.spill is None and c.children]
            if not inner:
                break
            node = max(inner, key=lambda c: c.weight)
            if node.weight <= self.budget // 2:
                path.append(node)
                break
        node = path[-1]
        if node is self.root or not node.children:
            return False
        before = node.weight - len(node.label) - NODE_BYTES
        node.spill = tempfile.TemporaryFile()
        for key, value, inside in _walk(node, b""):
            for rest, v in [(b"", value)] if inside is None else self._read(inside):
                self._append(node, key + rest, v)
        node.children, node.value = {}, None
        self.bytes -= before
        for p in path:
            p.weight -= before
        return True

    def _read(self, node: _Node) -> Iterator[tuple[bytes, object]]:
        """A spilled subtree's entries, after which its file is gone."""
        f = node.spill
        f.seek(0)
        while head := f.read(4):
            rest = f.read(struct.unpack("<I", head)[0])
            yield rest, self._value.read(f)
        f.close()

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All (key, value) pairs, each key once."""
        for key, value, node in _walk(self.root, b""):
            if node is None:
                yield key, value
                continue
            trie = PatriciaTrie(self.merge, self.budget)
            for rest, v in self._read(node):
                trie.insert(rest, v)
            for rest, v in trie.items():
                yield key + rest, v

    _value = None


def _walk(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, object, _Node | None]]:
    """Terminals below ``top`` as (key, value, None), spilled nodes as (key, None, node)."""
    stack = [(top, prefix)]
    while stack:
        node, key = stack.pop()
        if node.spill is not None and node is not top:
            yield key, None, node
            continue
        if node.value is not None:
            yield key, node.value, None
        stack += [(c, key + c.label) for c in node.children.values()]


class Owner:
    """What a terminal holds: smallest identifier (None if all are null), copies, content hash."""

    __slots__ = ("least", "count", "sha")
    _FORM = struct.Struct("<?qq32s")

    def __init__(self, least: int | None, count: int, sha: bytes):
        self.least, self.count, self.sha = least, count, sha

    def to_bytes(self) -> bytes:
        return self._FORM.pack(self.least is not None, self.least or 0, self.count, self.sha)

    @classmethod
    def read(cls, f) -> Owner:
        known, least, count, sha = cls._FORM.unpack(f.read(cls._FORM.size))
        return cls(least if known else None, count, sha)

    def merge(self, other: Owner) -> Owner:
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        self.count += other.count
        return self


PatriciaTrie._value = Owner

_FOLDED = pa.schema([("n", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("least", pa.int64()), ("copies", pa.int64())])
_OWNERS = pa.schema([("n", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _rows(schema: pa.Schema, rows: Iterable[tuple], step_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + (len(r[2]) if isinstance(r[2], bytes) else 0)
        if size > step_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch], budget: int = MAP_TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """(ident, body) rows to one row per different normalised text of the split."""
    trie = PatriciaTrie(Owner.merge)
    out = lambda t: _rows(_FOLDED, ((len(k), v.sha, k, v.least, v.count) for k, v in t.items()))
    for batch in batches:
        for ident, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            key = normalise(body.as_py())
            trie.insert(key, Owner(ident, 1, hashlib.sha256(key).digest()))
            if trie.bytes > budget:
                yield from out(trie)
                trie = PatriciaTrie(Owner.merge)
    yield from out(trie)


def _own(batches: Iterator[pa.RecordBatch], budget: int = OWNER_TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """Folded rows of one partition to one row per different text."""
    trie = PatriciaTrie(Owner.merge, budget)
    for batch in batches:
        cols = batch.to_pydict()
        for sha, body, least, copies in zip(cols["sha"], cols["body"], cols["least"], cols["copies"]):
            trie.insert(body, Owner(least, copies, sha))
    yield from _rows(_OWNERS, ((len(key), v.sha, v.least, v.count) for key, v in trie.items()))


def _content_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, row) to (n, sha, row): the rest of the row passes untouched."""
    for batch in batches:
        n, sha = [], []
        for body in batch.column(0):
            key = normalise(body.as_py())
            n.append(len(key))
            sha.append(hashlib.sha256(key).digest())
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.binary()), batch.column(1)], names=["n", "sha", "row"])


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text: n (bytes), sha, keep_id, group_size."""
    spark = docs.sparkSession
    prepare(spark)
    folded = docs.select(F.col(id_col).cast("long").alias("ident"), text_bytes(text_col).alias("body")).mapInArrow(
        _fold, "n long, sha binary, body binary, least long, copies long"
    )
    dealt = folded.repartition(shuffle_width(spark), "n", "sha")
    return dealt.mapInArrow(_own, "n long, sha binary, keep_id long, group_size long")


def _with_owner(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows: (body, row). The row beside its owner."""
    row_type = rows.schema["row"].dataType.simpleString()
    keyed = rows.mapInArrow(_content_keys, f"n long, sha binary, row {row_type}")
    return keyed.join(owners(docs, id_col, text_col), ["n", "sha"], "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is empty. Null identifiers come after all others: a row with one is never
    kept beside a row with an identifier, and in a group of nulls only, keep_id is null and
    every row counts as kept, as nothing tells them apart. Repeated rows (same identifier
    and text) are counted each and share their owner's fate. An empty table gives an empty
    table.
    """
    rows = docs.select(text_bytes(text_col).alias("body"), F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("row"))
    joined = _with_owner(rows, docs, id_col, text_col)
    return joined.select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size",
        F.col("row.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns that they came with.

    Repeated rows (same identifier and text) share their owner's fate and stay together. The
    identities of the rows that go are written first: while they are few, whole rows aren't
    shuffled.
    """
    body = text_bytes(text_col)
    row_hash = F.xxhash64(body)
    own = F.struct(F.col(id_col).cast("long").alias("own_id"), row_hash.alias("own_hash"))
    joined = _with_owner(docs.select(body.alias("body"), own.alias("row")), docs, id_col, text_col)
    gone = joined.filter(~F.col("row.own_id").eqNullSafe(F.col("keep_id"))).select(F.col("row.own_id").alias("gone_id"), F.col("row.own_hash").alias("gone_hash")).distinct()
    gone = materialise(gone, "gone")
    return without_rows(docs, gone, id_col, row_hash)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d
WINDOW g AS (PARTITION BY norm)
"""
