"""The paged data source against a server of numbered pages."""

import http.server
import json
import threading

import pytest

from quotemill.sources import feeds, paged


@pytest.fixture
def server():
    """Pages 1 to ``total``; ``broken`` answers 503 that many times before it gives way, ``gone`` stays 404."""
    state = {"total": 5, "asked": [], "broken": {}, "gone": set(), "headers": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.rsplit("=", 1)[1])
            state["asked"].append(n)
            state["headers"].append(self.headers.get("Authorization"))
            left = state["broken"].get(n, 0)
            code = 503 if left else 404 if n in state["gone"] or n > state["total"] else 200
            state["broken"][n] = max(0, left - 1)
            body = json.dumps({"response": [{"n": n, "name": "é"}], "paging": {"current": n, "total": state["total"]}}).encode()
            self.send_response(code)
            if code == 503:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{s.server_address[1]}/odds?page={{page}}"
    yield state
    s.shutdown()
    s.server_close()


def load(spark, server, **options):
    paged.register(spark)
    return spark.read.format("paged_feed").options(url=server["url"], **options).load()


def test_a_partition_a_page(spark, server):
    df = load(spark, server, **{"header.Authorization": "Bearer x"})
    assert df.rdd.getNumPartitions() == 5
    rows = df.orderBy("page").collect()
    assert [r.page for r in rows] == [1, 2, 3, 4, 5] and all(r.complete and r.pages == 5 for r in rows)
    assert json.loads(rows[2].payload)["response"] == [{"n": 3, "name": "é"}] and rows[0].observed_at is not None
    assert set(server["headers"]) == {"Bearer x"}
    assert feeds.complete_pages(df).first().complete is True


def test_the_cap_is_told(spark, server):
    rows = load(spark, server, most=3, each=2).collect()
    assert sorted(r.page for r in rows) == [1, 2, 3] and not any(r.complete for r in rows)
    assert max(server["asked"]) == 3


def test_pages_that_say_nothing_or_fail(spark, server):
    assert [r.page for r in load(spark, server, total="no.such").collect()] == [1]
    server["broken"] = {4: 2}  # gives way after two refusals
    assert load(spark, server).count() == 5
    server["gone"] = {4}
    with pytest.raises(Exception, match="HTTP 404"):
        load(spark, server).collect()
    with pytest.raises(Exception, match="page"):
        spark.read.format("paged_feed").option("url", "http://x").load().collect()


def test_stream_goes_on_after_its_checkpoint(spark, server, tmp_path):
    paged.register(spark)

    def run():
        q = (
            spark.readStream.format("paged_feed").option("url", server["url"]).load().writeStream.format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.page for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2, 3, 4, 5]
    server["total"], server["asked"] = 8, []
    assert run() == list(range(1, 9))
    assert set(server["asked"]) == {1, 6, 7, 8}  # the first page for its total only
