import re

import pytest

from sievespan.llm import licenses
from sievespan.llm.queries import op5_licenses

from .odd import ODD

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
             if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), found


def test_base_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op5_licenses(spark, FOLDER).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 20
    for r in got:
        n, found = plain(docs[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def labels(text):
    return [(d["label"], d["start"], d["end"]) for d in licenses.scan(text.encode())[1] if not d["base"]]


@pytest.mark.parametrize("text,want", [
    ("Licensed under the Apache License, Version 2.0.", [("apache-2.0", 0, 8)]),
    ("the GNU General Public License version 3", [("gpl-3.0", 1, 7)]),
    ("SPDX-License-Identifier: BSD-3-Clause", [("bsd-3-clause", 0, 6)]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", [("lgpl-2.1", 0, 8)]),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", [("cc-by-sa-4.0", 2, 9)]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", [("mit", 0, 13)]),
    ("apachelicense MITlicense gpla", []),
])
def test_rules(text, want):
    got = labels(text)
    assert all(w in got for w in want) and (got == []) == (want == [])


def test_contained_detections_of_lower_priority_go():
    kept = licenses.suppress([(0, 10, 3, False, "a"), (2, 5, 1, False, "b"), (2, 5, 0, True, "c"), (8, 12, 1, False, "d"),
                              (20, 25, 1, False, "e"), (20, 25, 1, False, "f"), (20, 30, 1, False, "g"), (20, 30, 1, False, "g")])
    assert [d[4] for d in kept] == ["a", "c", "d", "g"]


def test_hundreds_of_rules_each_with_a_keyword():
    assert len(licenses.rules()) > 300 and all(r.keywords for r in licenses.rules())


def test_odd_rows(odd_docs, no_docs):
    got = licenses.detect(odd_docs).collect()
    assert [r.licenses.n_words for r in got[:len(ODD)]] == [plain(t)[0] for t in ODD]
    assert licenses.detect(no_docs).count() == 0
    many = licenses.scan(b"MIT License " * 20_000)[1]
    assert sum(d["base"] for d in many) == 20_000 and many[-1]["start"] == 39_998


@pytest.mark.parametrize("text", [
    "under license mit lincoln laboratory made radars", "artistic license was taken by the author", "a python license plate",
    "the elastic license of poets", "his license: mitigated by law", "license = mit2"])
def test_prose_names_no_license(text):
    assert labels(text) == []


@pytest.mark.parametrize("text,want", [
    ("x y License: MIT", ("mit", 2, 4)), ('"license": "BSD-3-Clause",', ("bsd-3-clause", 0, 4)), ("é  license=ISC.", ("isc", 1, 3)),
    ("under the Artistic License", ("artistic", 0, 4)), ("Artistic License 2.0", ("artistic-2.0", 0, 4)),
    ("If a copy of the MPL was not distributed with this file, see", ("mpl-2.0", 0, 12)),
    ("You may not use this file except in compliance with the License.", ("apache-2.0", 0, 12))])
def test_tags_notices_and_headers(text, want):
    assert want in labels(text)


def test_signatures_are_written_by_hand():
    assert len(licenses.TEXTS) > 80 and len({pattern for _, pattern, _ in licenses.TEXTS}) == len(licenses.TEXTS)
    for label, pattern, keyword in licenses.TEXTS:    # a plain sentence passes its own gate
        if re.fullmatch("[a-z0-9 ]+", pattern):
            assert any(found[0] == label for found in labels(pattern)), (label, pattern)
