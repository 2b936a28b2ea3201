import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sievespan.llm import tries
from sievespan.llm.queries import op13_tries

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
OWN = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """The nodes as a dictionary of prefixes; convs: id to list of (role, text)."""
    if not convs:
        return []
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = op13_tries(spark, FOLDER)
    assert got.columns == OWN and {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain(plain_rebuilt(rows))


def spread(convs):
    """Conversations as the operator gets them, with texts told by their words."""
    return [(c, [(i, hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1])) for i, t in enumerate(turns)])
            for c, turns in convs.items()]


@pytest.mark.parametrize("shard_turns, piece", [(50_000, 4096), (40, 7), (3, 1)])
def test_shards_of_any_size_give_the_same_nodes(spark, shard_turns, piece):
    """A third begins with one turn, another third is copies of one conversation."""
    rng = random.Random(shard_turns)
    turn = lambda k: ("user", "t" * rng.randrange(1, k + 2))
    convs = {c: [turn(6) for _ in range(rng.randrange(0, 7))] for c in range(0, 120)}
    convs |= {c: [("user", "hello"), ("a", "same")] + [turn(3) for _ in range(rng.randrange(0, 5))] for c in range(120, 240)}
    convs |= {c * 1000: [("user", "hello"), ("a", "copied"), ("user", "bye")] for c in range(1, 120)}
    convs |= {999_999: [("user", "hello"), ("a", "same")] * 60, 999_998: [("user", "hello"), ("a", "same")] * 59}
    given_rows = spark.createDataFrame(spread(convs), "conv_id long, turns array<struct<turn: long, key: binary, chars: int>>")
    got = tries.nodes(given_rows, shard_turns, piece).select(OWN).collect()
    assert sorted(map(tuple, got), key=str) == plain(convs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), min_size=1, max_size=60, unique_by=tuple))
def test_double_array_holds_exactly_its_sequences(seqs):
    seqs = sorted(seqs)
    codes = np.array([c for s in seqs for c in s], np.int64)
    sizes = np.array([len(s) for s in seqs])
    trie = tries.packed(codes, np.cumsum(sizes) - sizes, sizes)
    held = set()
    for s in seqs:
        state = np.zeros(1, np.int64)
        for d, c in enumerate(s):
            state = trie.step(state, np.array([c]))
            assert state[0] > 0
            held.add(tuple(s[:d + 1]))
        beyond = trie.step(np.repeat(state, 12), np.arange(12))
        assert [c for c in range(12) if beyond[c] >= 0] == sorted({t[len(s)] for t in seqs if t[:len(s)] == s and len(t) > len(s)})
    assert (trie.check >= 0).sum() == len(held)


def test_many_children(spark):
    codes = np.concatenate([np.array([i % 700, i // 700]) for i in range(700)])
    order = np.lexsort((codes[1::2], codes[::2]))
    codes = codes.reshape(-1, 2)[order].ravel()
    trie = tries.packed(codes, np.arange(0, 1400, 2), np.full(700, 2))
    assert (trie.check >= 0).sum() == 1400 and trie.end < 2300


def test_odd_turns(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, "x" * 5000), (0, 1, None, "x" * 5000), (0, 2, "user", None),
            (1, 0, "", ""), (1, 1, "user", "é猫😀"), (101, 0, "user", "a"), (None, 0, "user", "lost"), (200, None, None, None)]
    rows += [(300 + i, 0, "user", "t") for i in range(30)] + [(7, i, "r", "word " * i) for i in range(300)]
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS seq", "2 AS turns", "3 AS _base")
    got = tries.nodes(tries.rebuilt(tries.conversations(table)), 20, 4).select(OWN).collect()
    assert sorted(map(tuple, got), key=str) == plain(plain_rebuilt([r for r in rows if r[0] is not None]))
    none = spark.createDataFrame([], TURNS)
    assert tries.nodes(tries.rebuilt(tries.conversations(none))).count() == 0
    only = spark.createDataFrame([(5, [])], "conv_id long, turns array<struct<turn: long, key: binary, chars: int>>")
    assert [tuple(r) for r in tries.nodes(only).select(OWN).collect()] == plain({5: []})
