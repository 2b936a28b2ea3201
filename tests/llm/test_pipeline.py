import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sievespan.llm import quality
from sievespan.llm.queries import TOKENIZER

from .test_decontamination import plain as hits
from .test_pii import plain as spans
from .test_simhash import near, plain_components, plain_print

FOLDER = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name in stages] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII",
                                         "BPE encoding and decoding"]
    good = stages["quality classifier"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    judged = {r.doc_id: r.quality for r in quality.scored(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    rows = good.collect()
    assert {r.doc_id for r in rows} == {i for i, q in judged.items() if q >= 0.5} and 150 < len(rows) < 200

    label = plain_components([(r.doc_id, plain_print(r.text)) for r in rows], near)
    different = stages["SimHash near-dedup"](spark, spark.createDataFrame(rows, docs.schema), FOLDER)
    rows = [r for r in rows if label[r.doc_id] == r.doc_id]
    assert different.columns == docs.columns
    assert sorted(different.collect()) == sorted(rows) and len(rows) < len(label)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    unknown = stages["benchmark decontamination"](spark, spark.createDataFrame(rows, docs.schema), FOLDER)
    rows = [r for r, (n, hit, _) in zip(rows, hits([r.text for r in rows], items)) if not hit or 20 * hit < n]
    assert unknown.columns == docs.columns and sorted(unknown.collect()) == sorted(rows)

    clean = stages["PII"](spark, spark.createDataFrame(rows, docs.schema), FOLDER)
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and got.keys() == {r.doc_id for r in rows}
    for r in rows:
        text, at = "", 0
        for start, _, kind, end in spans(r.text):
            if start >= at:
                text += r.text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert got[r.doc_id].text == text + r.text[at:] and got[r.doc_id].n_chars == len(got[r.doc_id].text)
    assert any("[EMAIL]" in r.text or "[IP]" in r.text for r in got.values())

    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    for r in stages["BPE encoding and decoding"](spark, clean, FOLDER).collect():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode(got[r.doc_id].text, add_special_tokens=False).ids
        assert r.exact and r.n_tokens == len(r.token_ids) // 4

    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole.keys() == got.keys()


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= docs.count()


def test_the_entry_works_without_this_package(tmp_path):
    for source in [REPO / "__spark_entry__.py", *(REPO / "sievespan").rglob("*.py")]:
        target = tmp_path / source.relative_to(REPO)
        if "llm" not in target.relative_to(tmp_path).parts:
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split()[1:] == ["False", "False"], done.stderr
