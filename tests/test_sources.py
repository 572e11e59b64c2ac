"""Feeds, captures, archives, fetching and snapshots on small payloads."""

import http.server
import json
import re
import threading
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from email.utils import format_datetime

import pytest
from pyspark.sql import functions as F

from quotemill.operators import validation as V
from quotemill.sources import feeds, landing
from quotemill.streaming import poll

AT = datetime(2026, 1, 1)


def capture(spark, *bodies):
    rows = [(b if isinstance(b, str) else json.dumps(b, ensure_ascii=False), AT) for b in bodies]
    return spark.createDataFrame(rows, "payload string, observed_at timestamp")


def h2h(**change):
    outcomes = [{"name": "A", "price": 2.15}, {"name": " Draw ", "price": 3.4500}, {"name": "B", "price": 4}]
    book = {"key": "bk", "title": "Book", "last_update": "2026-01-01T00:00:00Z", "markets": [{"key": "x"}, {"key": "h2h", "outcomes": outcomes}]}
    return {"id": "e1", "home_team": "A", "away_team": "B", "commence_time": "2026-01-02T10:00:00Z", "sport_title": "L", "bookmakers": [book | change]}


def test_h2h_feed(spark):
    r = feeds.h2h_feed(capture(spark, [h2h()]), competition="slug").collect()
    assert len(r) == 1
    assert (r[0].source, r[0].league, r[0].source_event_id, r[0].source_competition_id) == ("Book", "L", "e1", "slug")
    assert r[0].odds == {"1": Decimal("2.15"), "X": Decimal("3.45"), "2": Decimal(4)}
    assert feeds.h2h_feed(capture(spark, [h2h(markets=[{"key": "h2h", "outcomes": [{"name": "A", "price": 2}]}])])).count() == 0
    assert feeds.h2h_feed(capture(spark, "[]")).count() == 0


def test_h2h_feed_stops_on_another_shape(spark):
    with pytest.raises(Exception, match="not an array of events"):
        feeds.h2h_feed(capture(spark, {"message": "bad key"})).collect()


def test_fixtures_joined_with_odds(spark):
    fixtures = {"response": [{"fixture": {"id": 1, "status": {"short": "NS"}}, "teams": {"home": {"id": 7, "name": "A"}, "away": {"id": 8, "name": "B"}}}], "paging": {"current": 1, "total": 2}}
    bets = [
        {"name": "Match Winner", "values": [{"value": "Home", "odd": "2.1"}, {"value": "Draw", "odd": "3"}, {"value": "Away", "odd": "4"}]},
        {"name": "Goals Over/Under", "values": [{"value": "Over 2.5", "odd": "1.9"}, {"value": "Under 2.5", "odd": "1.8"}, {"value": "Over 3.5", "odd": "3"}]},
        {"name": "Handicap Result", "values": [{"value": "Home -1", "odd": "5"}, {"value": "Draw -1", "odd": "4"}]},
    ]
    item = {"fixture": {"id": 1, "date": "2026-01-02T10:00:00+00:00"}, "league": {"id": 3, "name": "Cup", "country": "Serbia"}, "bookmakers": [{"id": 5, "name": "Bk", "bets": bets}]}
    other = item | {"fixture": {"id": 99, "date": "2026-01-02T10:00:00+00:00"}}
    r = feeds.fixtures_odds_feed(capture(spark, fixtures), capture(spark, {"response": [item, other]})).orderBy("market_type").collect()
    assert [(x.market_type, x.market_line) for x in r] == [("three_way", None), ("totals", "2.5")]
    assert (r[0].league, r[0].lifecycle, r[0].source_home_team_id, r[0].source_id) == ("Serbia - Cup", "scheduled", "7", "5")
    assert r[1].odds == {"OVER": Decimal("1.9"), "UNDER": Decimal("1.8")}
    assert feeds.complete_pages(capture(spark, fixtures)).first().complete is False
    assert feeds.complete_pages(capture(spark, fixtures, fixtures | {"paging": {"current": 2, "total": 2}})).first().complete is True


def match(id_, live, status="Nije počeo", state="ACTIVE", sport="Fudbal"):
    odds = [{"oddStatus": state, "subgame": {"shortName": c}, "value": v} for c, v in (("1", 2.5), ("X", 3), ("2", 2.75))]
    return {
        "id": id_, "sport": {"name": sport}, "competition": {"id": 1, "name": "L"}, "home": {"id": 2, "name": "A"}, "visitor": {"id": 3, "name": "B"},
        "startTime": 1767348000000, "status": {"isLive": live, "name": status}, "oddsGroup": [{"groupName": "Konačan ishod", "odds": odds}],
    }


def test_listing_feed(spark):
    items = [match(1, True, "1. poluvreme"), match(2, None), match(3, None, "Kraj"), match(4, True, state="OFF"), match(5, True, sport="Tenis")]
    r = feeds.listing_feed(capture(spark, {"items": items}), "book").orderBy("source_event_id").collect()
    assert [(x.source_event_id, x.market_phase, x.lifecycle) for x in r] == [("1", "live", "live"), ("2", "pre_match", "scheduled")]
    assert r[0].start_time == datetime(2026, 1, 2, 10)
    with pytest.raises(Exception, match="not a listing"):
        feeds.listing_feed(capture(spark, {"nothing": 1}), "book").collect()


def league_event(id_, rivals=("A", "B")):
    def sel(names, state="ACTIVE"):
        return [{"name": n, "price": p, "state": state} for n, p in names]

    groups = [
        {"name": "Konačan Ishod", "selections": sel([("1", 2.2), ("X", 3.3), ("2", 3.1)])},
        {"name": "Ukupno golova", "overUnder": 1.5, "selections": sel([("Više", 1.2), ("Manje", 4)])},
        {"name": "Ukupno golova", "overUnder": 2.50, "selections": sel([("Više", 1.9), ("Manje", 1.85)])},
    ]
    header = {"eventId": id_, "sport": {"name": "Fudbal"}, "region": {"name": "Srbija"}, "league": {"leagueId": 9, "name": "Liga"}, "rivals": list(rivals), "rivalIds": [1, 2], "startTime": 1767348000000}
    return {"header": header, "positions": [{"groups": groups}]}


def test_league_feed_takes_both_shapes(spark):
    nested = {"payload": {"leagues": [{"events": [league_event(1)]}, {"events": [league_event(2, ("A",))]}]}}
    flat = {"payload": {"events": [league_event(3)]}}
    r = feeds.league_feed(capture(spark, nested, flat), "book").orderBy("source_event_id", "market_type").collect()
    assert [(x.source_event_id, x.market_type) for x in r] == [("1", "three_way"), ("1", "totals"), ("3", "three_way"), ("3", "totals")]
    assert r[1].odds == {"OVER": Decimal("1.9"), "UNDER": Decimal("1.85")}
    assert (r[0].league, r[0].country, r[0].source_away_team_id) == ("Srbija - Liga", "Srbija", "2")


def test_har_items_last_body_wins(spark):
    def entry(url, *items):
        return {"request": {"url": url}, "response": {"content": {"text": json.dumps({"items": list(items)})}}}

    har = {"log": {"entries": [entry("https://x/matches?p=1", {"id": 1, "v": "a"}, {"id": 2}), entry("https://x/matches?p=2", {"id": 1, "v": "b"}), entry("https://y/other", {"id": 3})]}}
    r = feeds.har_items(capture(spark, har), "https://x/matches*").orderBy("position").collect()
    assert [x.id for x in r] == ["1", "2"]
    assert json.loads(r[0].item)["v"] == "b"


def test_flat_file_and_its_rejections(spark, tmp_path):
    row = {"bookmaker": "B", "sport": "football", "league": "L", "home_team": "A", "away_team": "C", "start_time": "2026-01-01T10:00:00Z", "observed_at": "2026-01-01T09:00:00Z", "odds": {"1": 2.15, "X": 3.85, "2": 3.65}}
    rows = [row, row | {"home_team": ""}, row | {"observed_at": "2026-01-01T09:00:00"}, row | {"odds": {"1": 0.95, "X": 3, "2": 4}}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    r = V.validate(feeds.flat_quotes(spark, str(tmp_path / "f.json")))
    assert sorted(str(x.stage) for x in r.collect()) == ["None", "semantic", "semantic", "structural"]


def test_drop_folder(spark, tmp_path):
    (tmp_path / "live.json").write_text("{}")
    assert feeds.captures(spark, str(tmp_path), "live.json").first().payload == "{}"
    assert feeds.captures(spark, str(tmp_path), "other.json").count() == 0


@pytest.fixture
def server():
    """A web server on this machine that answers from a script: [(status, headers, body)] by path."""
    script, asked = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = self.path.split("?")[0]
            asked.append((self.path, self.headers.get("Authorization")))
            answers = script[path]
            status, headers, body = answers.pop(0) if len(answers) > 1 else answers[0]
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else body(self.path).encode())

        def log_message(self, *_):
            pass

    web = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", script, asked
    web.shutdown()
    web.server_close()


def test_fetch_waits_as_told_and_names_no_secret(server):
    base, script, asked = server
    later = format_datetime(datetime.now(UTC) + timedelta(seconds=30), usegmt=True)
    script["/a"] = [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")]
    script["/b"] = [(502, {"Retry-After": later}, b""), (500, {"Retry-After": "9999"}, b""), (200, {}, b"ok")]
    script["/c"] = [(404, {}, b"")]
    script["/d"] = [(500, {"Retry-After": "soon"}, b"")]
    slept = []
    assert landing.fetch(f"{base}/a?apiKey=s", sleep=slept.append) == b"ok" and slept == [1.0, 7.0]
    slept.clear()
    assert landing.fetch(f"{base}/b", sleep=slept.append) == b"ok"
    assert 20 < slept[0] <= 30 and slept[1] == 60
    slept.clear()
    for path, times in (("/c", 0), ("/d", 2)):
        with pytest.raises(RuntimeError, match="HTTP") as e:
            landing.fetch(f"{base}{path}?signature=hidden&x=1", sleep=slept.append)
        assert "hidden" not in str(e.value) and path in str(e.value) and len(slept) == times
    assert slept == [1.0, 2.0]
    with pytest.raises(RuntimeError, match=r"http://127.0.0.1:1/x: "):
        landing.fetch("http://127.0.0.1:1/x?k=v", sleep=slept.append, attempts=1)


def test_what_may_be_logged():
    assert landing.redact("https://me:pw@host:8443/v4/odds?apiKey=s&region=eu#f") == "https://host:8443/v4/odds"
    assert landing.redact("/only/path?x=1") == "/only/path" and "x" not in landing.redact("http://[bad")
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert landing.retry_after("Thu, 01 Jan 2026 00:01:00 GMT", now) == 60 and landing.retry_after("Wed, 31 Dec 2025 00:00:00 GMT", now) == 0
    assert [landing.retry_after(x) for x in ("5", " 2.5 ", "", None, "-3", "soon")] == [5, 2.5, None, None, None, None]
    assert landing.address("http://h/", "/v4/odds", a=1, b=None, c="x y") == "http://h/v4/odds?a=1&c=x+y"


def test_collectors_land_what_they_parse(spark, server, tmp_path):
    base, script, asked = server
    number = lambda path, field: int(re.search(rf"{field}=(\d+)", path)[1])
    script["/one"] = [(200, {}, b"[]")]
    script["/pages"] = [(200, {}, lambda p: json.dumps({"n": number(p, "page"), "paging": {"total": 3}}))]
    script["/html"] = [(200, {}, b'<script id="st">{&q;tok&q; : &q;abc&q;}</script>')]
    script["/list"] = [(200, {}, lambda p: json.dumps({"rows": [1, 2] if number(p, "p") < 2 else []}))]
    script["/empty"] = [(200, {}, b'{"rows": []}')]
    assert landing.collect_single(landing.fetch, f"{base}/one") == ["[]"]
    pages, whole = landing.collect_paged(landing.fetch, lambda n: f"{base}/pages?page={n}")
    assert [json.loads(p)["n"] for p in pages] == [1, 2, 3] and whole
    assert landing.collect_paged(landing.fetch, lambda n: f"{base}/pages?page={n}", most=2)[1] is False
    rows = lambda d: d["rows"]
    kept, whole = landing.collect_with_token(landing.fetch, f"{base}/html", lambda n: f"{base}/list?p={n}", "st", "tok", rows)
    assert len(kept) == 2 and whole and asked[-1][1] == "Bearer abc"
    assert landing.collect_with_token(landing.fetch, f"{base}/html", lambda n: f"{base}/list?p={n}", "st", "tok", rows, most=1)[1] is False
    with pytest.raises(ValueError, match="no page"):
        landing.collect_with_token(landing.fetch, f"{base}/html", lambda n: f"{base}/empty?p={n}", "st", "tok", rows)
    with pytest.raises(ValueError, match="no other"):
        landing.token_of("<script id='st'>{}</script>", "st", "other")
    back = landing.land(spark, str(tmp_path), "drop-1", kept, datetime(2026, 1, 1, 10))
    assert sorted(r.payload for r in back.collect()) == sorted(kept) and back.first().observed_at == datetime(2026, 1, 1, 10)
    assert landing.land(spark, str(tmp_path), "drop-1", kept[:1], datetime(2026, 1, 1, 10)).count() == 1


def test_archives_of_another_shape_stop(spark):
    def archive(*items):
        return capture(spark, {"log": {"entries": [{"request": {"url": "u"}, "response": {"content": {"text": json.dumps({"items": list(items)})}}}]}})

    good = feeds.checked_items(feeds.har_items(archive({"id": 1, "home": "a"}), "u"), ("id", "home"))
    assert [r.id for r in good.collect()] == ["1"]
    for bad in (archive(), archive({"id": 1, "home": "a"}, {"id": 2})):
        with pytest.raises(Exception, match="archive holds"):
            feeds.checked_items(feeds.har_items(bad, "u"), ("id", "home")).collect()


def test_a_failing_cycle_does_not_end_the_loop():
    seen, slept, said = [], [], []

    def cycle(n):
        seen.append(n)
        if n == 1:
            raise OSError("secret address")
        if n == 4:
            raise KeyboardInterrupt

    out = poll.poll(cycle, lambda: 23, 300, 60, 22, 2, max_cycles=9, sleep=slept.append, report=said.append)
    assert (seen, out.done, out.failed) == ([0, 1, 2, 3, 4], 4, {1: "OSError"})
    assert slept == [60] * 4 and said == ["cycle 1 failed: OSError"]


def test_stream_runs_whole_cycles(spark, tmp_path):
    schema = "payload string, n long"
    spark.createDataFrame([("x", i) for i in range(20)], schema).repartition(4).write.json(str(tmp_path / "in"))
    captures = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))
    for _ in range(2):  # the second start finds nothing new
        q = poll.stream_cycles(captures, write, str(tmp_path / "cp"), report=lambda _: None).trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in out.collect()) == list(range(20)) and out.select("batch").distinct().count() == 4


def test_pages_and_their_end():
    pages = {n: {"n": n, "paging": {"total": 3}} for n in (1, 2, 3)}
    assert landing.fetch_pages(pages.get) == ([pages[1], pages[2], pages[3]], True)
    assert landing.fetch_pages(pages.get, most=2)[1] is False


def test_intervals_and_tokens(spark):
    assert landing.poll_interval(23, 300, 60, 22, 2) == 60
    assert landing.poll_interval(2, 300, 60, 22, 2) == 300
    html = '<script id="ng-state" type="application/json">{&q;accessToken&q;:&q;abc&q;}</script>'
    one = spark.createDataFrame([(html,), ("<p>",)], "h string").select(landing.state_token(F.col("h"), "ng-state", "accessToken").alias("t"))
    assert [r.t for r in one.collect()] == ["abc", None]


def test_snapshot_manifest_notices_changes(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 3 as k")
    landing.write_snapshot({"t": df}, str(tmp_path), "v1")
    assert landing.verify_snapshot(spark, str(tmp_path), "v1").count() == 0
    df.filter("id < 9").write.mode("overwrite").parquet(f"{tmp_path}/v1/t")
    assert [r.table_name for r in landing.verify_snapshot(spark, str(tmp_path), "v1").collect()] == ["t"]


@pytest.mark.parametrize("name, markets", [("h2h_feed", 1), ("listing_feed", 1), ("league_feed", 2), ("fixtures_odds_feed", 3)])
def test_payloads_are_parsed_and_priced_once(spark, name, markets):
    from quotemill.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sides = 2 if name == "fixtures_odds_feed" else 1
    assert plan.count("from_json") == plan.count("FileScan") == sides and plan.count("aggregate(") == markets
    # of fixtures and odds only what is left of a payload is shuffled, in more parts than usual
    assert plan.count("hashpartitioning(fixture_id") == (2 if sides == 2 else 0) and plan.count(f", {feeds.SPREAD * 4}), REPARTITION_BY_NUM") == sides - (sides == 1)


def test_last_price_of_a_code_wins(spark):
    pairs = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(p).cast(feeds.PRICE).alias("price")) for c, p in (("1", "2"), ("X", "3"), ("1", "4"), ("1", None), ("Y", "9"))])
    r = spark.range(1).select(feeds._prices(pairs, ("1", "X")).alias("a"), feeds._prices(pairs, ("1", "2")).alias("b"), feeds._prices(F.lit(None).cast(f"array<struct<code:string, price:{feeds.PRICE}>>"), ("1",)).alias("c")).first()
    assert {k: int(v) for k, v in r.a.items()} == {"1": 4, "X": 3} and r.b is None and r.c is None
