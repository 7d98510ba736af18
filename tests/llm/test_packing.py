import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewheel.llm import packing

SF = "/root/testdata/sf0.001"


def check(docs, rows, capacity=2048):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = defaultdict(list)
    for d in docs:
        ids[d.doc_id].append(tok.encode(d.text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for key, found in pieces.items():
        want = ids[key]
        assert all(r.doc_tokens in {len(x) for x in want} for r in found)
        if len(want) == 1:
            at = 0
            for r in sorted(found, key=lambda r: r.start):
                assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == want[0][at : at + r.length]
                at += r.length
            assert at == len(want[0])
        assert sum(r.length for r in found) == sum(map(len, want))
    padded = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        size = found[0].sequence_length
        assert at <= size <= capacity and (size == capacity or at == size and size & (size - 1) == 0)
        padded += size - at
    return padded, sum(r.length for r in rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = packing.pack(docs).collect()
    padded, tokens = check(docs.collect(), found)
    assert padded < 0.003 * tokens
    want = sorted((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in found)
    assert want == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in packing.op9_harmonic_packing(spark, SF).collect())


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs.collect(), packing.pack(odd_docs).collect())
    assert packing.pack(no_docs).collect() == []


@pytest.mark.parametrize("text", ["don't I'll 12ab 12 áb İstanbul", "<|endoftext|>x <|startoftext|>", "ΟΔΟΣ ΣΑΣ.", "a). É!! ab.'s x…. <|StartOfText|>. A.B. É... 5,5 5! *#* A\u0301. I\u0307! x=\u0338.", "a\x85b\xa0c d\x1fe", "''s 's'x it's\n's"])
def test_words_alone_give_the_ids_of_the_text(text):
    want = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    others = ["", "a b, C", text[::-1]]
    found = list(packing.WordIds(packing.tokenizer_path()).all(pa.array([text, *others, text])))
    assert np.frombuffer(found[0], "<u4").tolist() == want == np.frombuffer(found[-1], "<u4").tolist()


def test_small_caches_and_long_texts(spark, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [" ".join(texts), "x" * 300 + " y", "\n" * 500 + "a"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for name, value in (("REMEMBERED", 50), ("CALL", 3), ("TOGETHER", 200)):
        monkeypatch.setattr(packing, name, value)
    found = packing.WordIds(packing.tokenizer_path()).all(pa.array(texts))
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_a_worker_sends_and_tokenizes_little_at_a_time(spark, monkeypatch):
    """Whatever the size of the batches that come in: what a worker makes of one is never whole in memory, and the rows are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toArrow().combine_chunks().to_batches()
    rows = lambda batches: [r for b in batches for r in b.to_pylist()]
    packer = lambda: packing.HarmonicPacker(0, 2048, 8)
    whole = list(packing.packed(iter(docs), packer(), b"\1\0\0\0"))
    fresh, given = packing.WordIds(packing.tokenizer_path()), []

    class Counted:
        def __init__(self, tokenizer):
            self.encode = tokenizer.encode
            self.encode_batch_fast = lambda texts, **how: given.append(len(texts)) or tokenizer.encode_batch_fast(texts, **how)

    fresh.tokenizer = Counted(fresh.tokenizer)
    monkeypatch.setattr(packing, "word_ids", lambda: fresh)
    for name, value in (("SENT", 20_000), ("CALL", 50), ("CALLS", 3)):
        monkeypatch.setattr(packing, name, value)
    little = list(packing.packed(iter(docs), packer(), b"\1\0\0\0"))
    assert len(docs) == 1 and rows(little) == rows(whole) and len(little) > 10
    assert all(sum(map(len, b.column("ids").to_pylist())) < 20_000 + 4 * 2048 for b in little)
    assert max(given) == 3 and len(given) > 10
