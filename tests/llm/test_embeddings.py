import numpy as np

from sievespan.llm import embeddings
from sievespan.llm.queries import op8_embeddings

FOLDER = "/root/testdata/sf0.1"
VECTORS = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """{id: (links, smallest id reachable)} from all cosines."""
    good = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {i: (0, i) for i, _ in vectors}
    ids = sorted(good)
    unit = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = unit @ unit.T >= 0.9
    label = np.arange(len(ids))
    for _ in ids:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    out |= {i: (int(near[k].sum()) - 1, ids[label[k]]) for k, i in enumerate(ids)}
    return out


def groups(seed=4, dim=16):
    """Tight groups of near copies, a chain, exact copies, and rows that link with nothing."""
    draw = np.random.default_rng(seed)
    out = []
    for centre in draw.standard_normal((12, dim)):
        out += [centre + 0.05 * draw.standard_normal(dim) for _ in range(25)]
    out += [np.cos(a) * np.eye(dim)[0] + np.sin(a) * np.eye(dim)[1] for a in np.linspace(0, 1.5, 12)]
    out += [out[3]] * 30 + [2 * out[3]] + [np.zeros(dim)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


def test_links_of_groups_in_small_tiles(spark):
    rows = groups()
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [None] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [float("inf")] * 16)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = plain(rows)
    for tile in (8, 256):
        got = embeddings.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), tables=96, bits=8, tile=tile)
        found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
        assert found.keys() == want.keys()
        assert {i: found[i][0] for i in found} == {i: want[i][0] for i in want}
        assert found == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_recall_on_the_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = plain(rows)
    got = {r.vec_id: r for r in op8_embeddings(spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    links = sum(n for n, _ in want.values())
    assert sum(r.n_links for r in got.values()) >= 0.9 * links


def test_recall_near_the_threshold(spark):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(400):    # pairs of cosine 0.9 to 0.92
        a, b = draw.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9 + 0.02 * draw.random() + 1e-6
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links = 1").count() >= 0.9 * 800


def test_repeated_ids_lengths_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (5, [1.0, 0.0, 0.0], 0), (7, [1e-30, 0.0], 0)]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (5, 0, 5), (7, 3, 1)]
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_rows_of_a_group_of_near_copies_grow_with_it():
    """Vectors that met in a table are counted there only."""
    draw = np.random.default_rng(6)
    units = draw.standard_normal(64) + 0.05 * draw.standard_normal((1200, 64))
    units, _ = embeddings.unit_vectors(units)
    planes = embeddings.planes(64, 16, 32, 7)
    codes = ((units @ planes > 0).reshape(-1, 32, 16) * (1 << np.arange(16))).sum(2).astype(np.int32)
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    total, made = np.zeros(len(units)), {}
    for size in (300, 1200):
        made[size], total[:] = 0, 0
        for table in range(32):
            for code in np.unique(codes[:size, table]):
                at = np.flatnonzero(codes[:size, table] == code)
                links, first = embeddings.block_links(units[at], codes[at], np.ones(len(at)), np.zeros(len(at), int), table, 0.9, 64)
                total[at] += links
                made[size] += int(((links > 0) | (first != np.arange(len(at)))).sum())
        assert (total[:size] <= near[:size, :size].sum(1)).all() and total[:size].sum() >= 0.9 * near[:size, :size].sum()
    assert made[1200] < 8 * made[300] and made[1200] < 20 * 1200


def test_bits_follow_the_number_of_vectors():
    assert embeddings.chosen(1000) == (16, 32)
    bits, tables = embeddings.chosen(1 << 30)
    assert bits == 26 and 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= 0.939
