"""Operator 2: removal of repeated passages by a logarithmic family of suffix arrays.

A byte goes when it is covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller identifier. The space of strings is partitioned, not the corpus:

* Anchors. In every window of LENGTH bytes, the ANCHOR bytes with the smallest hash are the
  window's anchor. The choice depends on the window alone, so equal windows have equal
  anchors and meet in the partition that the anchor's hash names. Consecutive windows with
  one anchor travel as one segment (about 70 bytes for 20 windows), packed by batch and
  partition. Of equal segments in a batch only those of the smallest document travel; the
  others are matched there and then, so a passage that very many documents share reaches its
  partition once a batch.
* Suffix arrays. A partition goes through its suffixes in batches of ascending documents:
  a batch gets a suffix array (its suffixes of LENGTH bytes in sorted order), equal runs of
  which give matches inside the batch; it is merge-scanned against each level of the index
  (one pass over both sorted lists), and its new strings become a level. Levels of one size class merge, so there are
  logarithmically many. Windows whose rolling hash (or whose anchor) occurs in one document
  only can't match and are left out before the arrays are built; what remains is compared
  byte by byte.
* Rows. A row is told by its identifier; rows of identifiers that occur more than once (those
  without one among them) also by 128 bits of their text, so rows never share spans.
* Spans. Matches go to the partition of their document, packed, become one row of byte
  ranges per document there and meet the text once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import flagged, materialise, mix64, prepare, shuffle_width, table, text_bytes

LENGTH = 50
ANCHOR = 12
#: Bytes of text whose windows are hashed at a time.
BLOCK = 1 << 20
#: Suffixes in a batch of an index family.
BATCH = 1 << 16
#: Windows of a bucket that are searched at a time.
CACHED = 1 << 17
#: Partitions of the string space for each shuffle partition; one is unpacked at a time.
FINER = 8

_WINDOW = LENGTH - ANCHOR + 1
_NULL_LAST = (1 << 63) - 1
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _words(b: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 8 bytes from each of n places, as words."""
    return np.ndarray((n,), "<u8", b.data, at, (1,)).astype(np.uint64)


def anchor_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the ANCHOR bytes from each place."""
    n = len(b) - ANCHOR + 1
    return mix64(_words(b, 0, n) * _C1 ^ _words(b, ANCHOR - 8, n) * _C2)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    step, m = 1, x
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - step :][: len(x) - width + 1]) if step < width else m


def segments(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, anchor hash) of every run of windows with one anchor.

    ``ends`` are the ends of the documents in ``raw``; windows never cross them.
    """
    b = np.frombuffer(raw, np.uint8)
    n = len(b) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = anchor_hashes(b)
    tagged = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_least(tagged, _WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(n + LENGTH, bool)
    for k in range(1, LENGTH):  # the last LENGTH - 1 starts of each document
        at = ends - k
        valid[at[(at >= 0) & (at < n)]] = False
    valid = valid[:n]
    starts = np.concatenate([[0], ends[:-1]])
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[starts[starts < n]] = True
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]])
    good = valid[first]
    first, last = first[good], last[good]
    # a run ends where windows become invalid
    counts = np.concatenate([[0], np.cumsum(valid)])
    windows = counts[last] - counts[first]
    return first, windows, anchor[first], h[anchor[first]]


#: A run of matched windows of one document.
_RUN = np.dtype([("ident", "<i8"), ("tag", "<i8"), ("check", "<i8"), ("first", "<i8"), ("last", "<i8")])
_NAME = ("ident", "tag", "check")  # what tells a row


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, from the second row on."""
    return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])


class _Packer:
    """Segments of one batch by bucket: texts, documents, places."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.parts: list[tuple] = []
        self.runs: list[np.ndarray] = []

    def add(self, raw: bytes, docs: list[tuple[int, int, int, int, int]]) -> None:
        """docs: (ident, tag, check, place of raw's part in the document, end in raw)."""
        ends = np.array([d[4] for d in docs])
        first, windows, anchor, key = segments(raw, ends)
        if not len(first):
            return
        which = np.searchsorted(ends, first, "right")
        base = np.array([d[3] for d in docs]) - np.concatenate([[0], ends[:-1]])
        ident, tag, check = (np.array([d[i] for d in docs], np.int64)[which] for i in range(3))
        place = first + base[which]
        texts = [raw[s : s + w] for s, w in zip(first.tolist(), (windows + LENGTH - 1).tolist())]
        least: dict[bytes, int] = {}
        for t, i in zip(texts, ident.tolist()):
            if i < least.get(t, _NULL_LAST + 1):
                least[t] = i
        told = ident > np.fromiter((least[t] for t in texts), np.int64, len(texts))
        self._told((ident[told], tag[told], check[told]), place[told], windows[told])
        mine = np.flatnonzero(~told)
        bucket = (key[mine] % np.uint64(self.buckets)).astype(np.int64)
        order = mine[np.argsort(bucket, kind="stable")]
        cut = np.searchsorted(np.sort(bucket), np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(cut)):
            o = order[cut[k] : cut[k + 1]]
            text = b"".join([texts[i] for i in o.tolist()])
            self.parts.append((int(k), text, ident[o], tag[o], check[o], place[o], windows[o].astype(np.uint16), (anchor[o] - first[o]).astype(np.uint8)))

    def _told(self, name: tuple[np.ndarray, ...], place: np.ndarray, windows: np.ndarray) -> None:
        """Segments that a smaller document of the batch has too are matched here: only their runs travel on."""
        if not len(place):
            return
        new = np.concatenate([[True], _changes(*name) | (place[1:] != place[:-1] + windows[:-1])])
        at = np.flatnonzero(new)
        runs = np.empty(len(at), _RUN)
        for key, column in zip(_NAME, name):
            runs[key] = column[at]
        runs["first"] = place[at]
        runs["last"] = (place + windows - 1)[np.append(at[1:], len(new)) - 1]
        self.runs.append(runs)

    def rows(self) -> list[tuple]:
        by: dict[int, list] = {}
        for p in self.parts:
            by.setdefault(p[0], []).append(p)
        pack = zstandard.ZstdCompressor(level=3)
        out = []
        for k, ps in by.items():
            ident, *rest = (np.concatenate([p[i] for p in ps]) for i in range(2, 8))
            # steps from one to the next pack better than the identifiers, which ascend as a rule
            meta = b"".join(c.tobytes() for c in (np.diff(ident, prepend=np.int64(0)), *rest))
            text = b"".join(p[1] for p in ps)
            out.append((k, sum(len(p[2]) for p in ps), pack.compress(text), pack.compress(meta)))
        if self.runs:
            runs = np.concatenate(self.runs)
            where = int(mix64(runs["ident"][:1].view(np.uint64))[0] % np.uint64(self.buckets))
            out.append((where, len(runs), None, pack.compress(runs.tobytes())))
        return out


def _scatter(buckets: int):
    names = ["bucket", "n", "text", "meta"]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packer, held, size = _Packer(buckets), [], 0

            def flush() -> None:
                if held:
                    ends = np.cumsum([len(h[4]) for h in held])
                    packer.add(b"".join(h[4] for h in held), [(*h[:4], int(e)) for h, e in zip(held, ends)])  # noqa: B023
                    held.clear()

            for *name, body in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                text = body.as_py()
                for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
                    part = text[at : at + BLOCK + LENGTH - 1]
                    if len(part) < LENGTH:
                        continue
                    held.append((*name, at, part))
                    size += len(part)
                    if size >= BLOCK:
                        flush()
                        size = 0
            flush()
            if rows := packer.rows():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of strings of LENGTH bytes: by their first eight bytes as one number, and by the whole where those tie."""
    head = np.ascontiguousarray(text).view(np.uint8).reshape(len(text), -1)[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(head)
    h = head[order]
    tied = np.flatnonzero(np.concatenate([[False], h[1:] == h[:-1]]))
    if len(tied):
        edge = np.zeros(len(h), bool)
        edge[tied] = edge[tied - 1] = True
        run = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]]))
        at = np.flatnonzero(edge)
        order[at] = order[at][np.lexsort((text[order[at]], run[at]))]
    return order


def _merge_scan(level: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where strings of ``text`` also stand in ``level`` (places in both): one pass over the two sorted lists without repeats.

    A stable sort of two sorted runs is their merge; equal strings then stand side by side, the level's first.
    """
    order = np.argsort(np.concatenate([level, text]), kind="stable")
    ours = order >= len(level)
    pair = np.flatnonzero(ours[1:] & ~ours[:-1])
    theirs, mine = order[pair], order[pair + 1] - len(level)
    same = level[theirs] == text[mine]
    return mine[same], theirs[same]


class SuffixFamily:
    """Levels of sorted strings, each with the smallest document that holds it.

    Documents come in ascending order, so a string that a level holds already keeps its
    document.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index a batch; which of its suffixes also start in a smaller document."""
        order = _suffix_array(suffixes)
        s, d = suffixes[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        text, least = s[first], np.minimum.reduceat(d, first)
        known = np.zeros(len(text), bool)
        for level, owner in self.levels:
            mine, theirs = _merge_scan(level, text)
            least[mine] = np.minimum(least[mine], owner[theirs])
            known[mine] = True
        run = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
        out = np.empty(len(s), bool)
        out[order] = d > least[run]
        self._push(text[~known], least[~known])
        return out

    def _push(self, text: np.ndarray, docs: np.ndarray) -> None:
        while self.levels and len(text) and len(self.levels[-1][0]).bit_length() <= len(text).bit_length():
            old, owner = self.levels.pop()
            text, docs = np.concatenate([old, text]), np.concatenate([owner, docs])
            order = np.argsort(text, kind="stable")  # two sorted runs: a merge
            text, docs = text[order], docs[order]
        if len(text):
            self.levels.append((text, docs))


def _in_several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a key that occurs in two different documents."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)  # equal keys in any order: vectorised
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    shared = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(shared, np.diff(np.concatenate([first, [len(k)]])))
    return out


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] times each."""
    total = int(count.sum())
    step = np.ones(total, np.int64)
    at = np.concatenate([[0], np.cumsum(count)[:-1]])
    step[0] = first[0]
    step[at[1:]] = first[1:] - (first[:-1] + count[:-1] - 1)
    return np.cumsum(step)


def _rolling(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of the LENGTH bytes from each place (48 of them and the last 8, in words)."""
    h = np.zeros(len(at), np.uint64)
    view = np.ndarray((len(b) - 7,), "<u8", b.data, 0, (1,))
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        h = (h ^ view[at + k]) * _C1
        h ^= h >> np.uint64(29)
    return mix64(h)


def matches(blobs: list[tuple[int, bytes, bytes]], size: int = BATCH) -> tuple[np.ndarray, ...]:
    """(ident, tag, check, first, last window) of the runs of matched windows of one bucket."""
    unpack = zstandard.ZstdDecompressor()
    text = b"".join(unpack.decompress(t) for _, t, _ in blobs)
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint16, np.uint8)
    cols: list[list] = [[] for _ in kinds]
    for n, _, packed in blobs:
        meta, at = unpack.decompress(packed), 0
        for i, kind in enumerate(kinds):
            column = np.frombuffer(meta, kind, n, at)
            cols[i].append(np.cumsum(column) if i == 0 else column)
            at += column.nbytes
    ident, tag, check, place, windows, anchor = (np.concatenate(c) for c in cols)
    windows = windows.astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(windows + LENGTH - 1)[:-1]])
    b = np.frombuffer(text, np.uint8)
    view = np.ndarray((len(b) - 7,), "<u8", b.data, 0, (1,))
    spot = begin + anchor
    key = mix64(view[spot] * _C1 ^ view[spot + ANCHOR - 8] * _C2)
    keep = np.flatnonzero(_in_several(key, ident))
    keep = keep[np.lexsort((place[keep], ident[keep]))]
    rows = np.lib.stride_tricks.sliding_window_view(b, LENGTH)
    out = [(np.empty(0, np.int64),) * 5]
    # equal windows have equal anchors: parts of a few megabytes stay in the processor's cache
    parts = 1 + int(windows[keep].sum()) // CACHED
    part = ((key[keep] >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    for k in range(parts):
        own = keep[part == k]
        if not len(own):
            continue
        at, seg = _expand(begin[own], windows[own]), np.repeat(own, windows[own])
        good = _in_several(_rolling(b, at), ident[seg])
        at, seg = at[good], seg[good]
        family, hits = SuffixFamily(), [np.empty(0, bool)]
        for lo in range(0, len(at), size):
            batch = np.ascontiguousarray(rows[at[lo : lo + size]]).view(f"S{LENGTH}").ravel()
            hits.append(family.add(batch, ident[seg[lo : lo + size]]))
        hit = np.concatenate(hits)
        at, seg = at[hit], seg[hit]
        if not len(at):
            continue
        window = place[seg] + at - begin[seg]
        new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        named = seg[first]
        out.append((ident[named], tag[named], check[named], window[first], window[last]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _gather(width: int, size: int):
    """Packed segments of one partition to packed runs, by the partition of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        known, unpack = [np.empty(0, _RUN)], zstandard.ZstdDecompressor()
        for batch in batches:
            for bucket, n, text, meta in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    known.append(np.frombuffer(unpack.decompress(meta), _RUN))
                else:
                    held.setdefault(bucket, []).append((n, text, meta))
        for bucket in list(held):
            found = matches(held.pop(bucket), size)
            known.append(np.empty(len(found[0]), _RUN))
            for name, column in zip(_RUN.names, found):
                known[-1][name] = column
        runs = np.concatenate(known)
        if not len(runs):
            return
        part = (mix64((runs["ident"] ^ runs["tag"]).view(np.uint64)) % np.uint64(width)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        runs, cut = runs[order], np.searchsorted(part[order], np.arange(width + 1))
        for k in np.flatnonzero(np.diff(cut)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([runs[cut[k] : cut[k + 1]].tobytes()], pa.binary())], names=["part", "runs"])

    return run


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs of one partition to one row of byte ranges per document."""
    runs = np.concatenate([np.empty(0, _RUN), *(np.frombuffer(r, _RUN) for batch in batches for r in batch.column(1).to_pylist())])
    runs = runs[np.lexsort((runs["first"], *(runs[k] for k in reversed(_NAME))))]
    spans = np.stack([runs["first"], runs["last"] + LENGTH], 1).astype("<i8")
    cut = np.flatnonzero(np.concatenate([[True], _changes(*(runs[k] for k in _NAME))])) if len(runs) else np.empty(0, np.int64)
    ends = np.concatenate([cut[1:], [len(runs)]])
    for lo in range(0, len(cut), 1024):
        own = slice(lo, lo + 1024)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(runs[k][cut[own]].copy()) for k in _NAME), pa.array([spans[s:e].tobytes() for s, e in zip(cut[own], ends[own])], pa.binary())], names=[*_NAME, "spans"]
        )


def union_spans(packed: bytes | None) -> np.ndarray:
    """Maximal runs of the union of packed (start, end) ranges; touching ranges are one run."""
    if not packed:
        return np.empty((0, 2), np.int64)
    s = np.frombuffer(packed, "<i8").reshape(-1, 2)
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    reach = np.maximum.accumulate(s[:, 1])
    first = np.flatnonzero(np.concatenate([[True], s[1:, 0] > reach[:-1]]))
    return np.stack([s[first, 0], reach[np.concatenate([first[1:], [len(s)]]) - 1]], 1)


def _cut(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for lo, hi in spans.tolist():
        out.append(text[at:lo])
        at = hi
    out.append(text[at:])
    return b"".join(out)


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, body, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text, spans = body.as_py(), union_spans(packed)
                left = _cut(text, spans)
                rows.append((doc_id, len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(left).hexdigest(), spans.tolist() if with_text else [], left if with_text else b""))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ident, tag, check, body): tag and check are two hashes of the text where the identifier may occur again, 0 elsewhere."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_LAST)).alias("ident")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ident, text_bytes(text_col).alias("body"))
    again = materialise(rows.groupBy("ident").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("ident").alias("key")), "again", free=True)
    rows, hit = flagged(rows, F.xxhash64("ident"), again, "key")
    zero = F.lit(0).cast("long")
    tag, check = F.when(F.col(hit), F.xxhash64("body")).otherwise(zero), F.when(F.col(hit), F.xxhash64(F.lit("check"), "body")).otherwise(zero)
    return rows.select("doc_id", "ident", tag.alias("tag"), check.alias("check"), "body")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept.

    ``removed`` lists the maximal removed byte ranges and ``kept`` holds the remaining bytes
    (both left empty without ``with_text``). A null text is empty. Null identifiers count as
    larger than all others and as equal to each other; rows that repeat an identifier never
    remove from each other, whatever they hold. A text of any length is read whole, a block of
    it at a time. Columns other than the two aren't read, whatever their names. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    width = shuffle_width(spark)
    rows = _rows(docs, id_col, text_col)
    packed = rows.select(*_NAME, "body").mapInArrow(_scatter(width * FINER), "bucket int, n long, text binary, meta binary")
    dealt = packed.repartitionById(width, F.pmod("bucket", F.lit(width)).cast("int"))
    runs = dealt.mapInArrow(_gather(width, batch or BATCH), "part int, runs binary").repartitionById(width, F.col("part"))
    spans = materialise(runs.mapInArrow(_per_document, "ident long, tag long, check long, spans binary"), "spans", free=True)
    joined = rows.join(spans, [*_NAME], "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(_apply(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
