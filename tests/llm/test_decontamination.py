import hashlib
import re


from sievespan.llm import decontamination
from sievespan.llm.queries import op7_decontamination

from .odd import ODD

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items):
    """[(n_words, n_hit, item ids)] by looking up every window of every document."""
    windows = {}
    for item, text in items:
        words = split(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for text in docs:
        words, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i:i + n])]
        out.append((len(words), len(hit), sorted(str(f) for f in found if f is not None)))
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    want = plain([d.text for d in docs], [(i.item_id, i.text) for i in items])
    got = {r.doc_id: r for r in op7_decontamination(spark, FOLDER).collect()}
    assert len(got) == len(docs) and sum(r.contaminated for r in got.values()) > 5
    for d, (n, hit, found) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_short_repeated_and_odd_items(spark, odd_docs, no_docs):
    items = [(1, "a a"), (2, "A A A"), (3, "word word word word word"), (4, None), (5, ""), (6, "..."), (2, "猫"), (None, "é"),
             (7, "a"), (1, "a a"), (8, "word " * 40), (9, "no such words here at all, none of them, in any of the texts")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r._text, r.n_words, r.n_hit, r["items"]) for r in
                 decontamination.contamination(odd_docs, benchmark).select("_text", "n_words", "n_hit", "items").collect())
    texts = [r.text for r in odd_docs.collect()]
    want = plain(texts, items)
    hashes = [r[0] for r in odd_docs.selectExpr("xxhash64(text)").collect()]
    assert got == sorted((h, *w) for h, w in zip(hashes, want))
    assert len(texts) == len(ODD) + 3
    assert decontamination.contamination(no_docs, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.n_items) for r in decontamination.contamination(odd_docs, none).collect()} == {(0, 0)}


def test_only_contaminated_rows_go(spark, odd_docs):
    benchmark = spark.createDataFrame([(1, "word word word word word word word word word word word word word word")],
                                      "item_id long, text string")
    kept = decontamination.decontaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(r.text) for r in odd_docs.collect() if r.text != "word " * 3000)


def test_no_python_in_the_plan(spark, odd_docs):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontamination.contamination(odd_docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
