import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievespan.llm import bpe
from sievespan.llm.queries import TOKENIZER, op9_bpe, tokenizer_json

from .odd import ODD

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_ids_and_text_equal_the_library_on_odd_texts(library):
    own = bpe.Codec(tokenizer_json())
    draw = random.Random(3)
    letters = " \n\t'sredm<|endoftext|>  ab1é߀　\xa0\x85\x1c​١Ⅷ²😀"
    texts = [t for t in ODD if t] + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:80]
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_full_caches_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    own = bpe.Codec(tokenizer_json())
    text = "one two three four five six seven one two three, four. five | six"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_incomplete_bytes_decode_to_the_replacement_letter(library):
    own = bpe.Codec(tokenizer_json())
    ids = np.frombuffer(own.encode("猫"), "<u4")
    assert own.decode(ids[:1].tobytes()) == library.decode(ids[:1].tolist(), skip_special_tokens=False)


def test_rows_pass_through(odd_docs, no_docs):
    got = bpe.round_trip(odd_docs.withColumn("decoded", odd_docs.lang), tokenizer_json()).collect()
    assert len(got) == odd_docs.count()
    assert all(r["decoded"] == (r["text"] or "") and r["words"] == 2 for r in got)
    assert bpe.round_trip(no_docs, tokenizer_json()).count() == 0
    both = bpe.encode(odd_docs, tokenizer_json())
    again = both.withColumn("back", bpe.decode_column(both.token_ids, tokenizer_json())).collect()
    assert all(r["back"] == (r["text"] or "") for r in again)


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op9_bpe(spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
