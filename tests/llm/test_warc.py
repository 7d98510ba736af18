import base64
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import warc as W

SF = "/root/testdata/sf0.01"


def want(pages):
    first = {}
    for p in pages:
        if p.page_id is not None:
            h = p.html or ""
            first[h] = min(p.page_id, first.get(h, p.page_id))
    out = []
    for p in pages:
        data = (p.html or "").encode()
        least = first.get(p.html or "")
        revisit = least is not None and p.page_id != least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((str(p.page_id), len(data), digest, "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def got(rows):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_whole_table(spark):
    assert got(W.op4_warc_round_trip(spark, SF).collect()) == want(spark.read.parquet(f"{SF}/pages.parquet").collect())


def test_odd_rows_come_back_byte_for_byte(spark, tmp_path):
    rng = random.Random(2)
    long = "".join(rng.choice("aé日\r\n\r\n <>") for _ in range(60000))
    rows = [(1, "http://a b\r\nX: y", long), (2, None, long), (2, None, long), (3, "u", ""), (4, "u", None), (None, "u", None), (None, "v", "only"), (5, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (7, "u", long + "x"), (7, "u", long + "x"), (8, "u", "z"), (8, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("n", F.lit(1)).withColumn("first", F.lit(9))
    path = f"{tmp_path}/w"
    W.write(pages, path, segment=1000)
    found = W.read(spark, path)
    assert got(W.resolved(found).collect()) == want(pages.collect())
    texts = sorted((r.page_id or 0, r.payload.decode()) for r in found.collect() if r.record_type == "response")
    assert texts == sorted([(1, long), (3, ""), (0, "only"), (5, rows[7][2]), (7, long + "x"), (7, long + "x"), (8, "z"), (8, "y")])


def test_no_pages(spark, tmp_path):
    W.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert W.resolved(W.read(spark, f"{tmp_path}/w")).collect() == []


def test_a_missing_segment_is_noticed(spark, tmp_path):
    import glob
    import gzip

    W.write(spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string"), f"{tmp_path}/w", segment=1000)
    data = b"".join(gzip.decompress(open(name, "rb").read()) for name in glob.glob(f"{tmp_path}/w/part*"))
    kept = [W.record(f["WARC-Type"], f["WARC-Record-ID"].strip("<>"), {k: v for k, v in f.items() if k.startswith(("WARC-Seg", "WARC-Pay"))}, b) + W.END for f, b in W.parsed(data) if f.get("WARC-Segment-Number") != "3"]
    open(f"{tmp_path}/x", "wb").write(gzip.compress(b"".join(kept)))
    with pytest.raises(Exception, match="are missing"):
        W.read(spark, f"{tmp_path}/x").collect()


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks(payload, size):
    assert W.unchunked(W.chunked(payload, size)) == payload
