import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import iblt_fingerprints as I

SF = "/root/testdata/sf0.001"


def check(docs, rows):
    docs = sorted(docs, key=lambda d: (-(d.doc_id if d.doc_id is not None else -(2**63)), d.text or ""))
    cut = re.compile(I.CUT)

    def jaccard(a, b):
        a, b = set(I.digests(a, cut).tolist()), set(I.digests(b, cut).tolist())
        return len(a & b) / len(a | b) if a | b else 1.0

    want, prints = [], {}
    for k, d in enumerate(docs):
        text, after = d.text or "", docs[(k + 1) % len(docs)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((str(d.doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(text, edited), 9), round(jaccard(text, after), 9)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    texts = {d.doc_id: d.text for d in docs}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    return rows


def test_whole_table(spark):
    rows = check(spark.read.parquet(f"{SF}/documents.parquet").collect(), I.op3_iblt_fingerprints(spark, SF).collect())
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs.collect(), I.fingerprint_edits(odd_docs).collect())
    assert I.fingerprint_edits(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2**64 - 1), max_size=90), st.sets(st.integers(0, 2**64 - 1), max_size=90), st.sets(st.integers(0, 2**64 - 1), max_size=90)), min_size=1, max_size=6))
def test_likeness_is_exact(cases):
    a = [np.array(sorted(x | c), np.uint64) for x, _, c in cases]
    b = [np.array(sorted(y | c), np.uint64) for _, y, c in cases]
    want = [len(set(x.tolist()) & set(y.tolist())) / max(1, len(set(x.tolist()) | set(y.tolist()))) if len(x) + len(y) else 1.0 for x, y in zip(a, b)]
    assert np.allclose(I.likeness(a, b), want)


def test_a_pair_that_never_peels_is_compared_exactly():
    a, b = np.array([7, 7, 8, 9], np.uint64), np.array([9, 10], np.uint64)
    assert I.likeness([a, a], [b, a]).tolist() == [1 / 4, 1.0]
