import http.server
import json
import threading
import urllib.parse
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import timeline
from tidewheel.sources import nodes
from tidewheel.sources.remote import remote_log

N = 10_000
EVENTS = [{"snapshot_hash": f"s{i}", "model_hash": f"m{i % 500}", "model_name": f"n{i % 500}", "timestamp": datetime.fromtimestamp(N - i, timezone.utc).isoformat(), "event_type": ["registered", "deployed"][i % 2], "actor": "a", "payload": {"k": i}} for i in range(N)]


class Handler(http.server.BaseHTTPRequestHandler):
    asked: list = []
    failing = 0

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        if Handler.failing:
            Handler.failing -= 1
            self.send_error(503)
            return
        Handler.asked.append(q)
        rows = [e for e in EVENTS if all(e[c] == q[c] for c in ("model_name", "model_hash", "event_type") if c in q) and q.get("since", "") <= e["timestamp"] <= q.get("until", "9")]
        at = int(q["offset"])
        body = json.dumps({"total": len(rows), "events": rows[at : at + int(q["limit"])]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/changelog"
    server.shutdown()


def asked():
    out, Handler.asked = Handler.asked, []
    return out


def test_all_events_come_from_several_partitions(spark, url):
    df = remote_log(spark, url, page=500, pages=4)
    asked()
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.snapshot_hash for r in rows) == sorted(e["snapshot_hash"] for e in EVENTS)
    assert len({r.part for r in rows}) == 5
    assert {q["offset"] for q in asked()} >= {str(k) for k in range(0, N, 500)}
    assert {json.loads(r.payload)["k"] for r in rows} == set(range(N))


def test_a_filter_for_one_model_travels(spark, url):
    asked()
    rows = remote_log(spark, url).where("model_hash = 'm7' AND event_type = 'deployed'").collect()
    assert {r.snapshot_hash for r in rows} == {e["snapshot_hash"] for e in EVENTS if e["model_hash"] == "m7" and e["event_type"] == "deployed"}
    told = asked()
    assert told and all(q["model_hash"] == "m7" and q["event_type"] == "deployed" for q in told)
    assert len({q["offset"] for q in told}) == 1  # one range


def test_bounds_of_time(spark, url):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    asked()
    rows = timeline.between(remote_log(spark, url), at(100), at(200)).collect()
    assert len(rows) == 101 and all("since" in q and "until" in q for q in asked())
    df = remote_log(spark, url)
    rows = df.where((F.col("timestamp") > at(100)) & (F.col("timestamp") < at(200)) & (F.col("timestamp") > at(150))).collect()
    assert sorted(r.timestamp.timestamp() for r in rows) == list(range(151, 200))
    assert df.where("model_name = 'nobody'").count() == 0
    assert df.where("model_name IN ('n1', 'n2') AND actor = 'a'").count() == 40  # left to Spark


def test_a_server_that_fails_for_a_moment(spark, url):
    Handler.failing = 2
    assert remote_log(spark, url).where("model_hash = 'm7'").count() == 20


def test_pages_as_nodes(spark, url):
    made = nodes.rest_nodes(spark, f"{url}?limit=5&offset=0", "api", "model_name", items="events", outputs=("model_hash",), metadata={"kind": "event_type"})
    assert [(r.name, r.outputs[0].identifier, r.metadata) for r in made.collect()] == [(f"n{i}", f"m{i}", {"kind": ["registered", "deployed"][i % 2], "node_type": "api"}) for i in range(5)]
