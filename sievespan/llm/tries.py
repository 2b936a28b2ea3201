"""Conversations that begin alike, as a trie: double arrays by prefix shard, merged where shards meet.

A turn is told by 16 bytes of the SHA-256 of role and text, so texts never move.
Equal conversations become one sequence with a count. The different sequences are
sorted by ranges, so a shard is a stretch of them in lexicographic order, and no
shard grows with a first turn that many conversations share: such a group is cut
like any other. A task numbers the turns of a shard densely and packs its trie
into two arrays: the child of state s by turn c is at BASE[s] + c, and CHECK
holds s there. Sequences are walked over these arrays, which gives each node its
members, and sums run up the tree from the deepest nodes.

As nodes hold neighbours, only those on the path of a shard's first or last
sequence can lie in other shards too; all others are done. Of the paths each
shard hands over partial sums. They are merged by the digest of the prefix, and
what a merged node adds to those above it is handed up along one of the paths
that it lies on.

Turns are in order of turn number, null first; turns of one number in order of
their digests. Null roles and texts count as empty. Repeated rows are turns of
their own. Turns without a conversation id belong to no conversation. An empty
table has no nodes, not even a root. What a task holds whole is a shard of
``SHARD_TURNS`` turns and at least one conversation, 20 bytes a turn.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

KEY = 16                 # bytes of a turn's digest
SHARD_TURNS = 50_000     # of a trie that is packed at once
PIECE = 4096             # member ids that are joined to one text
FIRST_FIT = 32           # free places that are tried for a node with several children
LOOK = 1024              # places that they are looked for in
TURNS = "conv_id long, seq binary, chars array<int>"
NODES = ("path binary, pos int, key binary, conv_id long, depth int, parent_conv_id long, chars long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shared boolean")
NO_ENDS = hashlib.sha256().hexdigest()


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is at base[s] + c, where check holds s."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0] = -2    # the root is no child
        self.end, self.hint = 1, 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
        self.end = max(self.end, size)

    def only_children(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """One child for each of the parents, in the next free places."""
        free = np.flatnonzero(self.check[self.hint:self.end] == -1)[:len(parents)] + self.hint
        if len(free) < len(parents):
            fresh = np.arange(self.end, self.end + len(parents) - len(free))
            self._grow(self.end + len(fresh))
            free = np.append(free, fresh)
        self.base[parents], self.check[free] = free - codes, parents
        if len(free):
            self.hint = int(free[-1]) + 1
        return free

    def children(self, parent: int, codes: np.ndarray) -> np.ndarray:
        """All children of a parent, at the first offset that has their places free; codes rise."""
        offsets = codes - codes[0]
        place = None
        if len(codes) <= FIRST_FIT:
            free = np.flatnonzero(self.check[self.hint:min(self.hint + LOOK, self.end)] == -1)[:FIRST_FIT] + self.hint
            for first in free.tolist():
                at = first + offsets
                if at[-1] < self.end and (self.check[at] == -1).all():
                    place = at
                    break
        if place is None:
            place = self.end + offsets
            self._grow(int(place[-1]) + 1)
        self.base[parent], self.check[place] = place[0] - codes[0], parent
        return place

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of states by codes, -1 where there is none."""
        at = self.base[states] + codes
        inside = (at >= 0) & (at < self.end)
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def packed(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> DoubleArray:
    """The trie of sequences in lexicographic order, level by level."""
    trie = DoubleArray(2 * len(codes) + 2)
    state = np.zeros(len(sizes), np.int64)
    for depth in range(int(sizes.max(initial=0))):
        go_on = np.flatnonzero(sizes > depth)
        p, c = state[go_on], codes[starts[go_on] + depth]
        fresh = np.append(True, (p[1:] != p[:-1]) | (c[1:] != c[:-1]))
        parents, own = p[fresh], c[fresh]
        slots = np.empty(len(own), np.int64)
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        count = np.diff(np.append(first, len(parents)))
        for i, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            slots[i:i + n] = trie.children(int(parents[i]), own[i:i + n])
        alone = first[count == 1]
        slots[alone] = trie.only_children(parents[alone], own[alone])
        state[go_on] = slots[np.cumsum(fresh) - 1]
    return trie


def shard_nodes(seqs: list[bytes], chars: list[np.ndarray], weight: np.ndarray, conv: np.ndarray,
                ends: list[str]) -> list[tuple]:
    """Rows of ``NODES`` for a shard's different sequences in lexicographic order."""
    turns = np.frombuffer(b"".join(seqs), f"S{KEY}")
    codes = np.unique(turns, return_inverse=True)[1].astype(np.int64)    # dense ids in order of the digests
    sizes = np.array([len(s) // KEY for s in seqs], np.int64)
    starts = np.cumsum(sizes) - sizes
    trie = packed(codes, starts, sizes)
    n = trie.end
    members, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    length, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    flat = np.concatenate([np.asarray(c, np.int64) for c in chars]) if len(codes) else np.empty(0, np.int64)
    first_path, last_path = np.zeros(sizes[0] + 1, np.int64), np.zeros(sizes[-1] + 1, np.int64)
    state = np.zeros(len(seqs), np.int64)
    members[0], least[0] = weight.sum(), conv.min()
    for d in range(int(sizes.max())):
        go_on = np.flatnonzero(sizes > d)
        at = trie.step(state[go_on], codes[starts[go_on] + d])
        np.add.at(members, at, weight[go_on])
        np.minimum.at(least, at, conv[go_on])
        length[at], depth[at] = flat[starts[go_on] + d], d + 1
        state[go_on] = at
        if d < sizes[0]:
            first_path[d + 1] = state[0]
        if d < sizes[-1]:
            last_path[d + 1] = state[-1]

    shared = np.zeros(n, bool)
    shared[first_path], shared[last_path] = True, True
    nodes = np.flatnonzero(trie.check >= 0)    # all but the root
    parent = trie.check
    children = np.bincount(parent[nodes], minlength=n)
    done_children = np.bincount(parent[nodes], ~shared[nodes], n).astype(np.int64)
    leaves = ((children == 0) & ~shared).astype(np.int64)
    saved = np.where(shared, 0, (members - 1) * length)
    deepest = nodes[np.argsort(-depth[nodes], kind="stable")]
    level = np.flatnonzero(np.append(True, np.diff(depth[deepest]) != 0)) if len(deepest) else []
    for a, b in zip(level, [*level[1:], len(deepest)]):
        np.add.at(leaves, parent[deepest[a:b]], leaves[deepest[a:b]])
        np.add.at(saved, parent[deepest[a:b]], saved[deepest[a:b]])

    end_of = dict(zip(state.tolist(), ends))
    out = []
    paths = [(seqs[0], first_path.tolist())] + ([(seqs[-1], last_path.tolist())] if len(seqs) > 1 else [])
    place = {}    # of a shared node: the path and the place there
    for seq, path in paths:
        name, running = hashlib.sha256(seq).digest(), hashlib.sha256()
        for pos, v in enumerate(path):
            if pos:
                running.update(seq[(pos - 1) * KEY:pos * KEY])
            key, known = running.digest(), v in place
            place.setdefault(v, (name, pos))
            # a node of both paths hands over its sums once
            sums = (0, 0, 0, 0, None) if known else (members[v], done_children[v], leaves[v], saved[v], end_of.get(v))
            out.append((name, pos, key, least[v], pos, None, length[v], *sums, True))
    for v in nodes[~shared[nodes]].tolist():
        up = int(parent[v])
        path, pos = place[up] if shared[up] else (None, None)
        out.append((path, pos, None, least[v], depth[v], None if shared[up] else least[up], length[v], members[v],
                    children[v], leaves[v], saved[v], end_of.get(v, NO_ENDS), False))
    return out


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell a turn by role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, KEY)


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """conv_id and turns: an array of (turn, key, chars), in order."""
    own = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), turn_key(F.col(role), F.col(text)).alias("key"),
                 F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("chars")).alias("t"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like the first of their ``family``: with h the crc32 of the decimal id modulo
    ``most``, the first h turns of conversation c - c % family, then c's own turns after its first h."""
    base = convs.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family).withColumn("_h", h)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast(convs.schema["turns"].dataType))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return own.join(base, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def sequences(convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """seq, chars, n, conv_id and ends_sha256 of each different sequence of turns: the digests joined, the lengths
    of the texts, how many conversations it is, the smallest, and the SHA-256 of all, ascending, joined by commas.

    Ids are joined in pieces of a range of ids, so no group grows with the copies of a conversation;
    where a sequence has several pieces a task hashes them one after another.
    """
    rows = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("seq"),
                        F.transform("turns", lambda t: t["chars"]).alias("chars"))
    parts = written(
        rows.groupBy("seq", F.floor(F.col("conv_id") / piece).alias("piece")).agg(
            F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .withColumn("conv_id", F.get("ids", F.lit(0)))
        .withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")), "member-pieces")
    whole = parts.groupBy("seq").agg(
        F.first("chars").alias("chars"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("_pieces"), F.first(F.sha2("ids", 256)).alias("ends_sha256"))
    whole = written(whole, "sequences")
    several = whole.where("_pieces > 1")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, running = None, None
        for batch in batches:
            out = []
            for own, ids in zip(batch["seq"], batch["ids"]):
                if own != seq:
                    if seq is not None:
                        out.append((seq, running.hexdigest()))
                    seq, running = own, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["seq", "sha"])
        if seq is not None:
            yield pd.DataFrame([(seq, running.hexdigest())], columns=["seq", "sha"])

    digests = (parts.select("seq", "piece", "ids").join(several.select("seq"), "seq", "left_semi")
               .repartition("seq").sortWithinPartitions("seq", "piece").select("seq", "ids")
               .mapInPandas(hashed, "seq binary, sha string"))
    both = several.join(digests, "seq").withColumn("ends_sha256", F.col("sha")).drop("sha")
    return whole.where("_pieces = 1").unionByName(both).drop("_pieces")


def nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, turns), the root included: conv_id, its smallest member; depth;
    parent_conv_id; n_convs; n_children; n_leaves and saved_tokens of its subtree, where a node saves the code points
    of its last text for each member but one; ends_sha256 of the members that end there."""
    seqs = written(sequences(convs, piece), "distinct")
    total = seqs.agg(F.sum(F.size("chars"))).first()[0] or 0

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        held, turns = [], 0

        def rows():
            seq, chars, n, conv, ends = zip(*held)
            return pd.DataFrame(shard_nodes(list(seq), list(chars), np.array(n, np.int64), np.array(conv, np.int64),
                                            list(ends)), columns=names).astype({"pos": "Int32", "parent_conv_id": "Int64"})

        for batch in batches:
            for row in zip(batch["seq"], batch["chars"], batch["n"], batch["conv_id"], batch["ends_sha256"]):
                if held and turns + len(row[1]) > shard_turns:
                    yield rows()
                    held, turns = [], 0
                held.append(row)
                turns += len(row[1])
        if held:
            yield rows()

    found = written(
        seqs.select("seq", "chars", "n", "conv_id", "ends_sha256")
        .repartitionByRange(math.ceil(total / shard_turns) + 1, "seq").sortWithinPartitions("seq")
        .mapInPandas(built, NODES), "trie-nodes")
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    paths = written(_merged(found.where("shared")), "trie-paths")
    by_key = paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_conv_id").alias("parent_conv_id"),
        F.first("n_convs").alias("n_convs"), F.first("n_children").alias("n_children"),
        (F.first("n_leaves") + F.sum("up_leaves")).alias("n_leaves"),
        (F.first("saved_tokens") + F.sum("up_saved")).alias("saved_tokens"), F.first("ends_sha256").alias("ends_sha256"))
    done = found.where("not shared")
    # joined by path and place, so no first turn that many share is one key
    below = (done.where("path is not null").drop("parent_conv_id")
             .join(paths.select("path", "pos", F.col("conv_id").alias("parent_conv_id")), ["path", "pos"]))
    parts = [by_key.select(own), below.select(own), done.where("path is null").select(own)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("depth", F.col("depth").cast("long"))


def _merged(rows: DataFrame) -> DataFrame:
    """Rows of paths with the sums of their nodes over all shards, the parent's conv_id, and what the
    nodes from here on downwards that are counted on this path add to this one (up_leaves, up_saved)."""
    above = Window.partitionBy("path").orderBy("pos")
    linked = rows.withColumn("_up", F.lag("key").over(above))
    merged = written(linked.groupBy("key").agg(
        F.first("_up").alias("_up"), F.min("path").alias("_owner"), F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("_done"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256")), "trie-merged")
    kids = merged.where("_up is not null").groupBy(F.col("_up").alias("key")).agg(F.count(F.lit(1)).alias("_kids"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("_done") + F.coalesce("_kids", F.lit(0)))
    here = F.col("path") == F.col("_owner")
    below = Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.select("path", "pos", "key").join(merged, "key")
            .withColumn("parent_conv_id", F.lag("conv_id").over(above))
            .withColumn("up_leaves", F.sum((here & (F.col("n_children") == 0)).cast("long")).over(below))
            .withColumn("up_saved", F.sum(F.when(here, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)).over(below))
            .select("path", "pos", "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", "ends_sha256", "up_leaves", "up_saved"))
