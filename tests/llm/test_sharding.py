import zlib
from collections import defaultdict

import pytest

from sievespan.llm import sharding
from sievespan.llm.queries import SHARDS, op12_sharding

FOLDER = "/root/testdata/sf0.001"


def place(v):
    if v is None:
        return None
    return float(v) if isinstance(v, (int, float)) else float(int.from_bytes(v.encode()[:6].ljust(6, b"\0"), "big"))


def plain(rows, shards, n):
    """The tree by sorting every node; rows: (id, size, crc, values) in the order of their row numbers."""
    spread = [[place(r[3][d]) for r in rows if r[3][d] is not None] for d in range(n)]
    extent = [max(s) - min(s) if s else 0 for s in spread]
    out = []

    def split(held, k):
        if k == 1:
            out.append(held)
            return
        widths = []
        for d in range(n):
            own = [place(r[3][d]) for _, r in held if r[3][d] is not None]
            widths.append(-1.0 if not own else (max(own) - min(own)) / extent[d] if extent[d] else 0.0)
        d = widths.index(max(widths))
        none = lambda v: (v is not None, v if v is not None else 0)
        key = lambda x: ((x[1][3][d] is not None, x[1][3][d] if x[1][3][d] is not None else ""), x[1][2], none(x[1][0]), x[0])
        held = sorted(held, key=key)
        total, left, upto, cut, best = sum(r[1] for _, r in held), k // 2, 0, 0, None
        for i in range(len(held) + 1):
            off = abs(k * upto - left * total)
            if best is None or off < best:
                best, cut = off, i
            upto += held[i][1][1] if i < len(held) else 0
        if not held:
            cut = 0
        split(held[:cut], k // 2)
        split(held[cut:], k - k // 2)

    split(list(enumerate(rows)), shards)
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()),
             [r[d] for d in sharding.DIMENSIONS]) for r in docs]
    want = {r[0]: (r[1], r[2], s, slot) for s, held in enumerate(plain(rows, SHARDS, 4))
            for slot, (_, r) in enumerate(sorted(held, key=lambda x: x[1][0]))}
    got = op12_sharding(spark, FOLDER).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in got} == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one source, language and text; ids repeat; nulls everywhere."""
    rows = [(7, "copied text " * 20, "hot", "en", 240)] * 1500
    rows += [(i, "x" * (i % 400), f"s{i % 7}" if i % 5 else None, None if i % 3 else "de", i % 400 if i % 11 else None)
             for i in range(3000)]
    return spark.createDataFrame([*rows, (None, None, None, None, None)], "doc_id long, text string, source string, lang string, n_chars long")


def held(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    return by


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_near_equal_and_gapless(spark, skewed, shards):
    rows = sharding.kd_shards(skewed, shards).collect()
    by = held(rows)
    assert len(rows) == 4501 and set(by) == set(range(shards))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    share = sum(r.size for r in rows) / shards
    assert max(abs(sum(r.size for r in own) - share) for own in by.values()) <= max(r.size for r in rows)


def test_leaves_are_close_together(spark):
    docs = spark.createDataFrame([(i, "abcdefgh", f"s{i % 4}", "en", 8) for i in range(400)],
                                 "doc_id long, text string, source string, lang string, n_chars long")
    by = held(sharding.kd_shards(docs, 4, dimensions=("source",)).collect())
    assert sorted(sorted({r.doc_id % 4 for r in own}) for own in by.values()) == [[0], [1], [2], [3]]


def test_target_bytes_and_odd_tables(spark, odd_docs, no_docs):
    assert sharding.kd_shards(no_docs, 24).count() == 0
    assert sharding.kd_shards(no_docs, target_bytes=100).count() == 0
    rows = sharding.kd_shards(odd_docs, target_bytes=2000).collect()
    assert len(rows) == odd_docs.count() and len({r.shard for r in rows}) > 3
    few = sharding.kd_shards(odd_docs.limit(2), 24).collect()
    assert len({r.shard for r in few}) == 2
    floats = spark.createDataFrame([(float("nan"), "a"), (float("inf"), "b"), (None, "c"), (1.0, "d")], "doc_id double, text string")
    assert sorted(r.slot for r in sharding.kd_shards(floats, 2, dimensions=("doc_id", "text")).collect()) == [0, 0, 1, 1]


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i, "s", "en", i) for i in range(50)],
                                 "doc_id long, text string, source string, lang string, n_chars long")
    placed = sharding.kd_shards(docs, 3)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select(*docs.columns).collect()) == sorted(docs.collect())
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}
    with pytest.raises(ValueError):
        sharding.write_shards(docs.unionAll(docs), sharding.kd_shards(docs.unionAll(docs), 3), str(tmp_path / "no"))
