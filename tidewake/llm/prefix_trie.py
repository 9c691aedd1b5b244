"""Operator 13: the prefix trie of conversations, built and rolled up level by level.

A node is a distinct sequence of first turns; it is named by its depth and the smallest
conversation that starts with it. Turns are told by a SHA-256 digest of role and text, so no
text is shuffled.

* Copies first. Conversations that are equal as a whole become one representative with a
  weight, so a group of copies is one path however many there are.
* Down. Per depth, the live conversations of large nodes are grouped by (parent node, next
  turn); a group's smallest conversation names the new node. A node with one unrepeated
  conversation needs no grouping any more: the rest of its path is read off its turns. A node
  with at most ``SMALL`` turns below it is finished in one task, by the same levels over
  arrays; many such nodes share a task. Only nodes with more go on to the next level.
* Up. From the deepest level back, each level's leaves and savings are summed by parent
  (partial sums before the shuffle) and joined to the level above.

Conversations that end at one node are equal as a whole, so the digest of their identifiers
belongs to a group of copies. It is fed in ascending chunks of a bounded number of
identifiers: a group is never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import join_unskewed, materialise, prepare, shuffle_width, table

#: Most turns below a node that one task takes at once.
SMALL = 1 << 16
#: A chunk of a digest holds a range of 2 ** CHUNK_BITS consecutive identifiers.
CHUNK_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ender long"


def ordered_turns(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes): every turn's place from 1, materialised.

    Turns go by ``turn``, null first; ties by role, then by the digest. Rows are dealt out by
    ranges of that order, so a conversation with very many turns is ranked in several
    partitions; where it goes on from one to the next, the rows before it are added.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = convs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # so that many equal rows can be cut apart
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), F.asc("conv"), *order, F.asc("row")).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt.drop("row"), "dealt")
    held = dealt.groupBy("conv", "part").agg(F.count("*").alias("rows"))
    before = held.withColumn("before", F.sum("rows").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    # a partition continues one conversation at most: no more rows than partitions
    before = F.broadcast(before.filter("before > 0").select("conv", "part", "before"))
    placed = dealt.withColumn("pos", F.row_number().over(W.partitionBy("conv", "part").orderBy(*order))).join(before, ["conv", "part"], "left")
    return materialise(placed.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "bytes"), "turns")


def _finish(t: pa.Table) -> pa.Table:
    """Levels of the nodes of one bucket, down and up: (see ``_NODE``) and whether a row only tells a given node's sums."""
    node, depth, conv = (t[c].to_numpy() for c in ("node", "depth", "conv"))
    pos, size, weight, turns = (t[c].to_numpy() for c in ("pos", "bytes", "n", "n_turns"))
    code = t["digest"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    top = np.unique(np.stack([depth, node], 1), axis=0)
    roots, root = np.unique(np.stack([depth, node], 1), axis=0, return_inverse=True)
    members, mine = np.unique(conv, return_inverse=True)
    current = np.empty(len(members), np.int64)
    current[mine] = root.ravel()
    n = len(top)
    made = [(roots[:, 0], roots[:, 1], np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1))]
    spans, ended = [(0, n)], [np.zeros(n, bool)]
    by_pos = np.argsort(pos, kind="stable")
    cuts = np.flatnonzero(np.diff(pos[by_pos], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(pos))):
        own = by_pos[lo:hi]
        own = own[np.argsort(conv[own], kind="stable")]  # the first of a group is its smallest
        key = current[mine[own]] * (int(code.max()) + 1) + code[own]
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        convs, last = np.zeros(len(first), np.int64), np.full(len(first), -1)
        np.add.at(convs, group, weight[own])
        stops = turns[own] == pos[own]
        last[group[stops]] = conv[own][stops]
        made.append((pos[own][first], conv[own][first], current[mine[own]][first], convs, size[own][first], last))
        ended.append(np.bincount(group[stops], minlength=len(first)) > 0)
        current[mine[own]] = n + group
        spans.append((n, n + len(first)))
        n += len(first)
    at, name, parent, convs, size, last = (np.concatenate(c) for c in zip(*made))
    stop = np.concatenate(ended)
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), np.maximum(convs - 1, 0) * size
    for lo, hi in reversed(spans[1:]):
        np.add.at(leaves, parent[lo:hi], leaves[lo:hi])
        np.add.at(saved, parent[lo:hi], saved[lo:hi])
    given = parent < 0
    return pa.table({
        "depth": at, "conv_id": name, "parent_conv_id": pa.array(name[np.maximum(parent, 0)], mask=given), "n_convs": convs,
        "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ender": pa.array(last, mask=~stop), "given": given,
    })


def _nodes(step: DataFrame, keys: list[str], depth: int, small: int) -> DataFrame:
    """One level's nodes from its live conversations, each with what becomes of it."""
    left = F.col("n_turns") - depth
    nodes = step.groupBy(*keys).agg(
        F.min("conv").alias("node"), F.sum("n").alias("n_convs"), F.count("*").alias("reps"), F.sum(left).alias("below"),
        F.max("bytes").alias("bytes"), F.max(F.when(left == 0, F.col("conv"))).alias("ender"),
    )
    kind = F.when(F.col("below") == 0, "leaf").when((F.col("reps") == 1) & (F.col("n_convs") == 1), "tail").when(F.col("below") <= small, "small").otherwise("large")
    return nodes.withColumn("kind", kind)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def trie(members: DataFrame, turns: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trie of ``members`` (conv) over their ``turns`` (conv, pos from 1 without gaps, digest, bytes; both materialised).

    Returns nodes (depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ender), copies (conv, rep) of every conversation that has an equal one, and
    representatives (conv, n, n_turns). ``ender`` is the representative of the conversations
    that end at a node, null where none does.
    """
    spark = members.sparkSession
    mark = lambda *c: F.bit_xor(F.xxhash64(*c))  # noqa: E731  with its place in it, so order counts
    told = turns.groupBy("conv").agg(F.count("*").alias("n_turns"), mark("pos", "digest").alias("x"), mark(F.lit("y"), "digest", "pos").alias("y"))
    seqs = materialise(members.join(told, "conv", "left").select("conv", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_turns", "x", "y"))), "seqs")
    classes = materialise(seqs.groupBy("n_turns", "x", "y").agg(F.min("conv").alias("rep"), F.count("*").alias("n")), "classes")
    copies = join_unskewed(seqs, classes.filter("n > 1"), "x", also=("n_turns", "y")).select("conv", "rep")
    reps = classes.select(F.col("rep").alias("conv"), "n", "n_turns")
    body = materialise(join_unskewed(turns, reps, "conv"), "body")

    live = reps.withColumn("bytes", F.lit(0).cast("long"))
    levels = [materialise(_nodes(live, [], 0, small).filter("reps > 0").withColumn("parent", F.lit(None).cast("long")), "level")]
    top = levels[0].first()
    rest = [reps.filter("n_turns > 0").select("conv", F.lit(top["node"]).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(top["kind"]).alias("kind"))] if top else []
    while rest and levels[-1].filter("kind = 'large'").head(1):
        depth = len(levels)
        held = rest.pop()
        live, still = held.filter("kind = 'large'").select("conv", F.col("node").alias("parent")), held.filter("kind != 'large'")
        step = materialise(body.filter(F.col("pos") == depth).drop("pos").join(live, "conv").withColumn("key", F.xxhash64("parent", "digest")), "step")
        level = materialise(_nodes(step, ["parent", "digest", "key"], depth, small), "level")
        going = step.filter(F.col("n_turns") > depth)
        going = join_unskewed(going.select("conv", "parent", "digest", "key"), level.select("parent", "digest", "key", "node", "kind"), "key", also=("parent", "digest"))
        rest += [still, materialise(going.select("conv", "node", F.lit(depth).cast("long").alias("depth"), "kind"), "going")]
        levels.append(level.drop("digest", "key"))

    rows = body
    if rest:
        rows = join_unskewed(body, _union(rest), "conv").filter("pos > depth")
    else:
        rows = body.select("*", F.lit(0).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit("tail").alias("kind"))
    rows = materialise(rows, "below")
    gathered = rows.filter("kind = 'small'")
    buckets = max(1, gathered.count() // max(1, small))
    bucket = F.pmod(F.xxhash64("depth", "node"), F.lit(buckets))
    wanted = gathered.select(bucket.alias("bucket"), "node", "depth", "conv", "pos", "digest", "bytes", "n", "n_turns")
    finished = materialise(wanted.groupBy("bucket").applyInArrow(_finish, _NODE + ", given boolean"), "finished")
    last = F.col("pos") == F.col("n_turns")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = rows.filter("kind = 'tail'").select(
        F.col("pos").alias("depth"), F.col("conv").alias("conv_id"), F.when(F.col("pos") == F.col("depth") + 1, F.col("node")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.col("conv")).alias("ender"),
    )

    given = finished.filter("given").select(F.col("depth").alias("at"), F.col("conv_id").alias("node"), "n_children", "n_leaves", F.col("saved_tokens").alias("saved"))
    out = [finished.filter("not given").drop("given"), tails]
    above = None
    for depth in range(len(levels) - 1, -1, -1):  # up again
        sums = given.filter(F.col("at") == depth).drop("at")
        if above is not None:
            sums = sums.union(above.groupBy("parent_conv_id").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).filter("parent_conv_id is not null"))
        tail = F.col("kind") == "tail"
        full = levels[depth].join(sums, "node", "left").select(
            F.lit(depth).cast("long").alias("depth"), F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.when(tail, one), none).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", none)).alias("saved_tokens"), "ender",
        )
        above = materialise(full, "rolled")
        out.append(above)
    return _union(out), copies, reps


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of identifiers in ascending order, group after group, to one digest per group."""
    rep, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "sha"])

    for batch in batches:
        for r, text in zip(batch.column(0).to_pylist(), batch.column(2)):
            if r != rep:
                if state is not None:
                    yield out()
                rep, state = r, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_buffer())
    if state is not None:
        yield out()


def digests(copies: DataFrame) -> DataFrame:
    """(rep, sha): SHA-256 of the decimal identifiers of each group of ``copies`` (conv, rep), ascending, joined by commas."""
    part = F.shiftright("conv", CHUNK_BITS).alias("chunk")
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")))  # bounded by the range
    chunks = copies.groupBy("rep", part).agg(text.alias("text"))
    return chunks.repartition(F.col("rep")).sortWithinPartitions("rep", "chunk").mapInArrow(_digests, "rep long, sha string")


def with_ends(nodes: DataFrame, copies: DataFrame) -> DataFrame:
    """``nodes`` with ``ends_sha256`` in place of ``ender``."""
    stop = nodes.filter(F.col("ender").isNotNull()).join(digests(copies).withColumnRenamed("rep", "ender"), "ender", "left")
    stop = stop.withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.col("ender").cast("string").cast("binary"), 256)))
    return stop.drop("ender", "sha").unionByName(nodes.filter(F.col("ender").isNull()).drop("ender").withColumn("ends_sha256", F.lit(EMPTY)))


def conversation_trie(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """The prefix trie of a table of turns: one row per node, as ``trie`` and ``with_ends`` tell.

    Rows without a conversation identifier take no part. A null role or text is empty; texts of
    any length count whole, by their digest. Turns go by ``turn``, null first, ties by role and
    digest; repeated rows are turns of their own. Extra columns aren't read, whatever their
    names. An empty table has no node.
    """
    prepare(convs.sparkSession)
    turns = ordered_turns(convs, id_col, turn_col, role_col, text_col)
    nodes, copies, _ = trie(turns.select("conv").distinct(), turns, small)
    return with_ends(nodes, copies)


def branched(turns: DataFrame, siblings: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: (members, turns), both materialised.

    Conversation c gets the first h turns of conversation c - c % ``siblings`` and its own
    turns after its first h, with h = crc32(decimal c) % ``most``.
    """
    own = materialise(turns.groupBy("conv").agg(F.count("*").alias("own")), "own")
    base = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own")).filter(F.col("base") % siblings == 0)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    meta = own.select("conv", (F.col("conv") - F.col("conv") % siblings).alias("base"), h).join(base, "base", "left")
    meta = materialise(meta.withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0)))), "meta")
    first = turns.filter((F.col("pos") < most) & (F.col("conv") % siblings == 0)).withColumnRenamed("conv", "base")
    opening = meta.join(first, "base").filter("pos <= head").select("conv", "pos", "digest", "bytes")
    after = join_unskewed(turns, meta.select("conv", "h", "head"), "conv").filter("pos > h")
    after = after.select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "bytes")
    return meta.select("conv"), materialise(opening.union(after), "rebuilt")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    members, turns = branched(ordered_turns(table(spark, sf_dir, "conversations")))
    nodes, copies, _ = trie(members, turns)
    return with_ends(nodes, copies)


#: Shared openings and the trie once more, by lists of turns; crc32 by its definition, bit by bit.
OP13_SQL = """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), told AS (
  SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 9 AS h
  FROM own
), built AS (
  SELECT told.c, coalesce(base.turns[1:told.h], []) || coalesce(told.turns[told.h + 1:], []) AS turns
  FROM told LEFT JOIN own base ON base.c = told.c - told.c % 5
), walk AS (
  SELECT c, unnest(generate_series(0, len(turns))) AS depth, turns FROM built
), steps AS (
  SELECT c, depth, len(turns) = depth AS stops, sha256(to_json(turns[1:depth])::VARCHAR) AS prefix,
    CASE WHEN depth > 0 THEN strlen(turns[depth].t) ELSE 0 END AS size
  FROM walk
), nodes AS (
  SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE stops), '')) AS ends_sha256
  FROM steps GROUP BY depth, prefix
), paths AS (
  SELECT s.c, s.depth, n.conv_id FROM steps s JOIN nodes n USING (depth, prefix)
), full_nodes AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN paths p ON p.c = n.conv_id AND p.depth = n.depth - 1
), children AS (
  SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM full_nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT f.*, coalesce(ch.n_children, 0) AS n_children FROM full_nodes f LEFT JOIN children ch USING (depth, conv_id)
), sums AS (
  SELECT p.depth, p.conv_id, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM counted d JOIN paths p ON p.c = d.conv_id AND p.depth <= d.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (depth, conv_id)
"""
