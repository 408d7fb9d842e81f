"""Conversation prefix trie by padded matrices of turn ids.

Each distinct sequence of the first d turns of some conversation is a node. Conversations travel as rows of turn ids (two
63-bit hashes of role and text) and word counts, never as texts. They are dealt to shards by range of (turn ids, conv_id), so
every node is a contiguous run of conversations. A shard lays its rows out as a matrix padded with -1, `numpy.lexsort` puts
it in order, the OR-accumulated change masks of its columns mark where nodes start, and `reduceat` aggregates each depth. The
matrix is cut into pieces of WIDTH columns, and a piece holds only the rows that reach it, so one long conversation costs its
own length.

Only the nodes on the paths of a shard's first and last conversation can reach into other shards. Their parts are recombined
by Spark: sums by node, then sums along each path, one owner for each node so that it counts once. Ids of conversations that
end at such a node are hashed as a stream, in order of shards, as no shard holds them all.

Conversations: turns in order of `turn` (null first); turns with equal numbers in order of the hashes of role and text, equal
ones stay repeated. Null role and text are empty. Rows without conv_id belong to no conversation and are left out. Texts of
any length are read whole; the ids of one conversation (20 bytes a turn) must fit a task. conv_id is an integer; the remainder
is SQL's, so it has the sign of conv_id. Ties, repeated rows: as said. Other columns, whatever their names, are ignored. An
empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .frames import settle

#: Conversations c that share their first turns with c - c % BLOCK, at most CYCLE - 1 of them.
BLOCK, CYCLE = 20, 4
#: Columns of a piece of the matrix; turns in a shard.
WIDTH, SHARD = 8, 400_000
WORD = r"[^\x20\x09-\x0D]+"
_ENDS_NONE = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, in order, as (hi, lo, words)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    half = lambda *cols: F.shiftrightunsigned(F.xxhash64(*cols), 1)
    one = F.struct(F.col("turn"), half(role, text).alias("hi"), half(text, role).alias("lo"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")).select("conv_id", F.transform("turns", lambda x: F.struct(x["hi"], x["lo"], x["words"])).alias("turns"))


def rebuilt(convs: DataFrame, block: int = BLOCK, cycle: int = CYCLE) -> DataFrame:
    """Each conversation with its first crc32(conv_id) % cycle turns taken from the first conversation of its block."""
    head = (F.col("conv_id") - F.col("conv_id") % block).alias("_head")
    rows = convs.select("conv_id", "turns", head, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % cycle).cast("int").alias("_h"))
    heads = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, cycle - 1).alias("_first"))
    first = F.coalesce(F.slice("_first", F.lit(1), F.col("_h")), F.expr("slice(turns, 1, 0)"))
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return rows.join(heads, "_head", "left").select("conv_id", F.concat(first, own).alias("turns"))


class Shard:
    """The nodes of the conversations of one shard, depth by depth and in order of their turn ids."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, hi: np.ndarray, lo: np.ndarray, words: np.ndarray):
        self.ids, self.first, self.hi, self.lo, self.words, self.length = ids, first, hi, lo, words, np.diff(first)
        none = np.zeros(1, np.int64)
        #: Of each depth: smallest member, members, the parent's number one depth above, words of the last turn.
        self.depths = [(np.array([ids.min()]), np.array([len(ids)]), none, none)]
        #: Of each depth: members that end there, node by node and ascending, and where each node's begin.
        empty = np.sort(ids[self.length == 0])
        self.ends = [(empty, np.array([0, len(empty)]))]
        rows, node, base = np.flatnonzero(self.length > 0), np.zeros((self.length > 0).sum(), np.int64), 0
        while len(rows):
            rows, node = self._piece(rows, node, base)
            base += WIDTH

    def _piece(self, rows: np.ndarray, node: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Depths base + 1 to base + WIDTH of the rows that reach beyond base; node: that of each row at depth base."""
        at = np.arange(min(WIDTH, int(self.length[rows].max()) - base))
        there = base + at[None, :] < self.length[rows][:, None]
        place = np.where(there, self.first[rows][:, None] + base + at[None, :], 0)
        hi, lo = np.where(there, self.hi[place], -1), np.where(there, self.lo[place], -1)
        columns = [x[:, k] for k in at[::-1] for x in (lo, hi)]
        order = np.lexsort([self.ids[rows], *columns, node])
        rows, node, hi, lo, there, place = (x[order] for x in (rows, node, hi, lo, there, place))
        change = np.ones((len(rows), len(at)), bool)
        change[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        change[1:, 0] |= node[1:] != node[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        for k in at:
            live = np.flatnonzero(there[:, k])
            own, start = rows[live], np.flatnonzero(change[live, k])
            members = np.diff(np.append(start, len(live)))
            self.depths.append((np.minimum.reduceat(self.ids[own], start), members, node[live[start]], self.words[place[live[start], k]]))
            number = np.repeat(np.arange(len(start)), members)
            node[live] = number
            last = self.length[own] == base + k + 1
            self.ends.append((self.ids[own[last]], np.searchsorted(number[last], np.arange(len(start) + 1))))
        on = self.length[rows] > base + len(at)
        return rows[on], node[on]

    def outermost(self, last: bool) -> np.ndarray:
        """Ids (hi, lo) of the turns of the first or last conversation; at each depth its node is the first or last one."""
        rows, depth = np.arange(len(self.ids)), 0
        while True:
            ended = self.length[rows] == depth
            if ended.all() or ended.any() and not last:
                one = rows[np.flatnonzero(ended)[0]]
                return np.stack([x[self.first[one] : self.first[one + 1]] for x in (self.hi, self.lo)], axis=1)
            rows = rows[~ended]
            for x in (self.hi, self.lo):
                value = x[self.first[rows] + depth]
                rows = rows[value == (value.max() if last else value.min())]
            depth += 1

    def rows(self, number: int) -> Iterator[pa.Table]:
        """Whole nodes, and the parts of those on the paths of the outermost conversations."""
        paths = [self.outermost(False), self.outermost(True)]
        size = [len(x[0]) for x in self.depths]
        side = [np.full(n, -1, np.int8) for n in size]
        for which in (1, 0):
            for d in range(len(paths[which]) + 1):
                side[d][-which] = which
        children, leaves, saved = ([np.zeros(n, np.int64) for n in size] for _ in range(3))
        for d in range(len(size) - 1, -1, -1):
            _, members, parent, words = self.depths[d]
            inner = side[d] < 0
            leaves[d] += inner & (children[d] == 0)
            saved[d] += np.where(inner, (members - 1) * words, 0)
            if d:
                for x, add in ((children, np.ones(size[d], np.int64)), (leaves, leaves[d]), (saved, saved[d])):
                    np.add.at(x[d - 1], parent[inner], add[inner])
        for d, (least, members, parent, words) in enumerate(self.depths):
            (ended, edge), inner = self.ends[d], side[d] < 0
            listed = [",".join(map(str, ended[a:b].tolist())) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out = {"shard": np.full(size[d], number, np.int32), "side": pa.array(side[d].astype(np.int32), mask=inner), "depth": np.full(size[d], d), "key": pa.nulls(size[d], pa.binary()), "least": least}
            out["parent"] = pa.array(self.depths[d - 1][0][parent], mask=~inner | (side[d - 1][parent] >= 0)) if d else pa.nulls(1, pa.int64())
            out["parent_side"] = pa.array(side[d - 1][parent].astype(np.int32), mask=~inner | (side[d - 1][parent] < 0)) if d else pa.nulls(1, pa.int32())
            out |= {"n": members, "children": children[d], "leaves": leaves[d], "saved": saved[d], "words": words.astype(np.int64), "more": np.zeros(size[d], bool)}
            out["ends"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if whole and x else _ENDS_NONE if whole else x for x, whole in zip(listed, inner.tolist(), strict=True)], pa.string())
            yield pa.table(out).filter(pa.array(inner))
            for which in (0, 1):
                if d <= len(paths[which]):
                    one = pa.table(out).slice(size[d] - 1 if which else 0, 1).to_pylist()[0]
                    if one["side"] != which:  # on both paths: its sums stand on the first
                        one |= {"least": None, "n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": ""}
                    one |= {"side": which, "key": hashlib.blake2b(paths[which][:d].tobytes(), digest_size=16).digest(), "more": d < len(paths[which])}
                    yield pa.Table.from_pylist([one], schema=pa.table(out).schema)


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        lists = t.column("turns").combine_chunks()
        flat = lists.flatten()
        hi, lo, words = (flat.field(k).to_numpy() for k in ("hi", "lo", "words"))
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for out in Shard(t.column("conv_id").to_numpy(), first, hi, lo, words).rows(TaskContext.get().partitionId()):
            yield from out.to_batches()


_ROWS = "shard int, side int, depth long, key binary, least long, parent long, parent_side int, n long, children long, leaves long, saved long, words long, more boolean, ends string"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256) of lists that come in pieces, those of a key one after the other."""
    key, hasher = None, None
    for batch in batches:
        out = []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends"), strict=True):
            if k != key:
                out += [(key, hasher.hexdigest())] if hasher else []
                key, hasher = k, hashlib.sha256(piece.as_py().encode())
            else:
                hasher.update(b"," + piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "sha"])
    if hasher:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([hasher.hexdigest()])], ["key", "sha"])


def recombined(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes on the paths of outermost conversations, whole; and (shard, side, depth, whole) of each of their parts, with
    the node's smallest member."""
    totals = parts.groupBy("key").agg(
        F.min("least").alias("whole"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max("words").alias("words"), F.max("more").alias("more"), F.min(F.struct("shard", "side")).alias("owner"),
    )
    own = (F.col("owner.shard") == F.col("shard")) & (F.col("owner.side") == F.col("side"))
    leaf = (~F.col("more") & (F.col("children") == 0)).cast("long")
    path = parts.select("shard", "side", "depth", "key").join(totals, "key").withColumn("owned", own.cast("long"))
    upward = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc())
    path = path.select(
        "shard", "side", "depth", "key", "whole", "n", "children",
        F.sum(F.col("owned") * (leaf + F.col("leaves"))).over(upward).alias("leaves"),
        F.sum(F.col("owned") * ((F.col("n") - 1) * F.col("words") + F.col("saved"))).over(upward).alias("saved"),
        F.coalesce(F.lag("owned").over(upward), F.lit(0)).alias("child"), F.lead("whole").over(upward).alias("parent"),
    )
    path = settle(path)
    pieces = parts.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = pieces.mapInArrow(_streamed, "key binary, sha string")
    nodes = path.groupBy("key").agg(
        F.first("whole").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent").alias("parent_conv_id"), F.first("n").alias("n_convs"),
        (F.first("children") + F.sum("child")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    return nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_ENDS_NONE))).drop("key", "sha"), path.select("shard", "side", "depth", "whole")


def trie(convs: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the
    conversations (conv_id, turns)."""
    convs = settle(convs)
    shards = max(1, (convs.agg(F.sum(F.size("turns") + 1).alias("n")).first()["n"] or 0) // shard_turns, convs.sparkSession.sparkContext.defaultParallelism)
    rows = settle(convs.repartitionByRange(shards, "turns", "conv_id").mapInArrow(_sharded, _ROWS))
    outer, parts = recombined(rows.where("side is not null"))
    inner = rows.where("side is null")
    known = inner.where("parent_side is null").withColumn("whole", F.lit(None).cast("long"))
    hung = inner.join(parts.select("shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "whole"), ["shard", "parent_side", "depth"])
    inner = known.unionByName(hung).select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("parent", "whole").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return inner.unionByName(outer)


def nodes(turns: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    if not isinstance(turns.schema["conv_id"].dataType, T.IntegralType):
        raise TypeError(f"conv_id must be of an integer type, not {turns.schema['conv_id'].dataType.simpleString()}")
    return trie(rebuilt(settle(conversations(turns))), shard_turns)


#: The same by prefixes as lists, for another engine; crc32 is folded bit by bit (-1 stands for one shift).
SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS one
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(one ORDER BY k) AS turns FROM turns GROUP BY conv_id),
steps AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) % 4 AS h FROM convs),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(l.turns, [])[1:s.h], s.turns[s.h + 1:]) AS turns
  FROM steps s LEFT JOIN convs l ON l.conv_id = s.conv_id - s.conv_id % 20),
prefixes AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
marked AS (SELECT conv_id, depth, turns[1:depth] AS seq, len(turns) = depth AS ends FROM prefixes),
nodes AS (
  SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM marked GROUP BY seq, depth),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.seq[n.depth].text, '[^ 	-
]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]),
kids AS (SELECT seq[1:depth - 1] AS seq, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT c.*, coalesce(k.n, 0) AS n_children FROM counted c LEFT JOIN kids k ON k.seq = c.seq),
up AS (SELECT seq[1:a] AS seq, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_nodes)),
sums AS (SELECT seq, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY seq)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM full_nodes f JOIN sums s ON s.seq = f.seq
"""
