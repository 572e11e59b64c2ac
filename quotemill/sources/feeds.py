"""Provider payloads as quote records, parsed in the JVM.

Every parser takes captures (payload STRING, observed_at) and gives one row a market and
bookmaker, in the columns of ``RECORD``. Prices go from JSON text straight to decimals. A
payload of another shape stops the plan: an empty result would look like a quiet moment.
Records that lack a required field or a whole outcome set are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DEFAULT_MARKET, HANDICAP_MINUS_1_MARKET, LIVE_MARKET, TOTALS_2_5_MARKET, Market

RECORD = [
    "source", "sport", "league", "home_team", "away_team", "start_time", "observed_at", "market_type", "market_period",
    "market_phase", "market_line", "odds", "source_timestamp", "source_id", "source_event_id", "lifecycle",
    "source_home_team_id", "source_away_team_id", "source_competition_id", "country",
]

PRICE = "decimal(18,6)"
#: Parts of the join of fixtures and odds, as a multiple of the session's.
SPREAD = 4
#: Names that providers give to markets, outcomes, sports and states.
LISTING_RESULT = "Konačan ishod"
LEAGUE_RESULT = "Konačan Ishod"
LEAGUE_TOTALS = "Ukupno golova"
TOTAL_OUTCOMES = {"Manje": "UNDER", "Više": "OVER"}
SPORTS = {"Fudbal": "football"}
NOT_STARTED = "Nije počeo"
DRAW_NAMES = ("draw", "tie")
MATCH_WINNER, OVER_UNDER, HANDICAP_RESULT = "Match Winner", "Goals Over/Under", "Handicap Result"
OUTCOME_CODES = {"Home": "1", "Draw": "X", "Away": "2"}
FIXTURE_STATUS = {
    "TBD": "scheduled",
    "NS": "scheduled",
    "1H": "live",
    "HT": "live",
    "2H": "live",
    "ET": "live",
    "BT": "live",
    "P": "live",
    "SUSP": "live",
    "INT": "live",
    "LIVE": "live",
    "FT": "finished",
    "AET": "finished",
    "PEN": "finished",
    "PST": "postponed_or_canceled",
    "CANC": "postponed_or_canceled",
    "ABD": "postponed_or_canceled",
    "AWD": "postponed_or_canceled",
    "WO": "postponed_or_canceled",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _once(c: Column) -> Column:
    """``c`` as a generator of one row: no expression above it is put in its place and computed again."""
    return F.explode(F.array(c))


def _shaped(captures: DataFrame, schema: str, whole: Column, what: str) -> DataFrame:
    """Adds ``d``, the parsed payload; a payload without ``whole`` raises."""
    # Optional text fields are read as text whatever their JSON type is
    # generated, so that filters and fields further up read the parsed value and don't parse again
    parsed = captures.select("*", _once(F.from_json("payload", schema)).alias("d"))
    fault = F.raise_error(F.lit(f"this capture is not {what}"))
    return parsed.withColumn("d", F.when(F.coalesce(whole, F.lit(False)), F.col("d")).otherwise(fault))


def _prices(pairs: Column, codes: tuple[str, ...]) -> Column:
    """Map of outcome to price from (code, price) structs in one pass; the last of a code wins; null
    unless exactly ``codes`` are there."""
    names = [f"p{i}" for i in range(len(codes))]
    none = F.struct(*[F.lit(None).cast(PRICE).alias(n) for n in names])

    def merge(acc: Column, p: Column) -> Column:
        price = p["price"].cast(PRICE)
        return F.struct(*[F.when((p["code"] == c) & price.isNotNull(), price).otherwise(acc[n]).alias(n) for c, n in zip(codes, names, strict=True)])

    def finish(acc: Column) -> Column:
        whole = F.lit(True)
        for n in names:
            whole = whole & acc[n].isNotNull()
        return F.when(whole, F.create_map(*[x for c, n in zip(codes, names, strict=True) for x in (F.lit(c), acc[n])]))

    return F.aggregate(pairs, none, merge, finish)


def _priced(df: DataFrame, markets: list[tuple[Market, Column]], phase: Column | None = None, **columns: Column) -> DataFrame:
    """``columns`` and a row for each of ``markets`` (market, odds) that has odds, all from one look at a row."""
    each = [
        F.struct(
            F.lit(m.type).alias("type"), F.lit(m.period).alias("period"), (F.lit(m.phase) if phase is None else phase).alias("phase"),
            F.lit(m.line).cast("string").alias("line"), odds.alias("odds"),
        )
        for m, odds in markets
    ]
    out = df.select("observed_at", *[c.alias(n) for n, c in columns.items()], F.explode(F.array(*each)).alias("_m")).filter("_m.odds is not null")
    return out.select("*", *[F.col(f"_m.{n}").alias(f"market_{n}") for n in ("type", "period", "phase", "line")], F.col("_m.odds").alias("odds")).drop("_m")


def _record(df: DataFrame) -> DataFrame:
    """``df`` in the columns of ``RECORD``; what it lacks is null, its sport football."""
    text = F.lit(None).cast("string")
    defaults = {"source_timestamp": F.lit(None).cast("timestamp"), "sport": F.lit("football")}
    out = df.select(*[F.col(c) if c in df.columns else defaults.get(c, text).alias(c) for c in RECORD])
    return out.filter(F.col("odds").isNotNull() & F.col("home_team").isNotNull() & F.col("away_team").isNotNull() & F.col("start_time").isNotNull() & F.col("league").isNotNull())


def _time(c: Column) -> Column:
    return F.try_to_timestamp(c)


# ------------------------------------------------------------- flat files


def flat_quotes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of flat rows; timestamps stay text, so that validation can see whether
    they name their offset; the bookmaker is the source."""
    schema = (
        "bookmaker string, sport string, league string, home_team string, away_team string, start_time string, "
        f"observed_at string, odds map<string, {PRICE}>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(
        F.col("bookmaker").alias("source"), "sport", "league", "home_team", "away_team", "start_time", "observed_at",
        F.lit(None).cast("string").alias("source_timestamp"), F.lit(DEFAULT_MARKET.type).alias("market_type"),
        F.lit(DEFAULT_MARKET.period).alias("market_period"), F.lit(DEFAULT_MARKET.phase).alias("market_phase"),
        F.transform_values("odds", lambda k, v: v.cast("string")).alias("odds"),
    )


def captures(spark: SparkSession, folder: str, name: str = "*") -> DataFrame:
    """Whole files of a drop folder as captures, observed when they were written. No file
    of that name is no capture, not an error."""
    text = spark.read.option("pathGlobFilter", name).text(folder, wholetext=True)
    return text.select(F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("observed_at"))


# ------------------------------------------------------------- head-to-head feed


def h2h_feed(df: DataFrame, league: str = "", competition: str | None = None) -> DataFrame:
    """Array of events with bookmakers and their h2h market; outcomes are named after the teams."""
    schema = (
        "array<struct<id:string, home_team:string, away_team:string, commence_time:string, sport_title:string, bookmakers:array<struct<"
        f"key:string, title:string, last_update:string, markets:array<struct<key:string, outcomes:array<struct<name:string, price:{PRICE}>>>>>>>>"
    )
    # an array with a parsed event is seen at once; any other payload is looked at as JSON
    is_array = (F.substring(F.ltrim("payload"), 1, 1) == "[") & F.get("d", F.lit(0)).isNotNull()
    is_array = F.coalesce(is_array, F.lit(False)) | F.get_json_object("payload", "$[0]").isNotNull() | F.col("payload").rlike(r"^\s*\[\s*\]\s*$")
    events = _shaped(df, schema, is_array, "an array of events").select("observed_at", F.explode("d").alias("e"))
    books = events.select("observed_at", "e", F.explode("e.bookmakers").alias("b"))
    market = F.get(F.filter("b.markets", lambda m: m["key"] == "h2h"), F.lit(0))
    pairs = F.transform(
        market["outcomes"],
        lambda o: F.struct(
            F.when(o["name"] == F.col("e.home_team"), "1").when(o["name"] == F.col("e.away_team"), "2")
            .when(F.lower(F.trim(o["name"])).isin(*DRAW_NAMES), "X").alias("code"),
            o["price"].alias("price"),
        ),
    )
    return _record(_priced(
        books, [(DEFAULT_MARKET, _prices(pairs, ("1", "X", "2")))],
        source=F.coalesce(F.nullif(F.col("b.title"), F.lit("")), F.col("b.key"), F.lit("unknown")),
        league=F.coalesce("e.sport_title", F.lit(league)), home_team=F.col("e.home_team"), away_team=F.col("e.away_team"),
        start_time=_time(F.col("e.commence_time")), source_timestamp=_time(F.col("b.last_update")),
        source_id=F.col("b.key"), source_event_id=F.col("e.id"), source_competition_id=F.lit(competition).cast("string"),
    ))


# ------------------------------------------------------------- fixtures joined with odds


def fixtures_of(df: DataFrame) -> DataFrame:
    """(fixture_id, teams, lifecycle) from all pages of the fixtures response, dealt by fixture, one row each."""
    schema = (
        "response array<struct<fixture:struct<id:bigint, status:struct<short:string>>, "
        "teams:struct<home:struct<id:string, name:string>, away:struct<id:string, name:string>>>>, paging struct<current:int, total:int>"
    )
    rows = _shaped(df, schema, F.col("d.response").isNotNull(), "a fixtures response").select(F.explode("d.response").alias("f"))
    rows = rows.select(
        F.col("f.fixture.id").alias("fixture_id"), F.col("f.teams.home.name").alias("home_team"), F.col("f.teams.away.name").alias("away_team"),
        F.col("f.teams.home.id").alias("source_home_team_id"), F.col("f.teams.away.id").alias("source_away_team_id"),
        _lookup(FIXTURE_STATUS, F.col("f.fixture.status.short")).alias("lifecycle"),
    ).filter("home_team is not null and away_team is not null")
    # dealt before doubles go: they are sorted once, in small parts, and no map task sorts all of its rows
    return _by_fixture(rows).dropDuplicates(["fixture_id"])


def _by_fixture(rows: DataFrame) -> DataFrame:
    """Both sides of the join in ``SPREAD`` parts for each usual one, so that a task sorts little."""
    n = SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "fixture_id")


def complete_pages(df: DataFrame) -> DataFrame:
    """One row: whether every page that the first one announces is there."""
    page = F.from_json("payload", "paging struct<current:int, total:int>")["paging"]
    return df.select(page.alias("p")).agg((F.count_distinct("p.current") >= F.coalesce(F.max("p.total"), F.lit(1))).alias("complete"))


def _bet(name: str) -> Column:
    return F.get(F.filter("b.bets", lambda x: x["name"] == name), F.lit(0))["values"]


def fixtures_odds_feed(fixtures: DataFrame, odds: DataFrame) -> DataFrame:
    """Odds of known fixtures: up to three markets a bookmaker. Both inputs are captures,
    a row a page. A fixture without names has no record."""
    schema = (
        "response array<struct<fixture:struct<id:bigint, date:string>, league:struct<id:string, name:string, country:string>, update:string, "
        "bookmakers:array<struct<id:string, name:string, bets:array<struct<name:string, values:array<struct<value:string, odd:string>>>>>>>>"
    )
    rows = _shaped(odds, schema, F.col("d.response").isNotNull(), "an odds response").select("observed_at", F.explode("d.response").alias("o"))
    books = rows.select("*", F.explode("o.bookmakers").alias("b"))

    def pairs(bet: str, code, line: str | None) -> Column:
        def one(v: Column) -> Column:
            cut = F.instr(v["value"], " ")
            direction = F.when(cut > 0, F.substring(v["value"], F.lit(1), cut - 1)).otherwise(v["value"])
            rest = F.when(cut > 0, F.substring(v["value"], cut + 1, F.length(v["value"]))).otherwise(F.lit(""))
            named = code(v["value"]) if line is None else F.when(rest == line, code(direction))
            return F.struct(named.alias("code"), v["odd"].try_cast(PRICE).alias("price"))

        return F.transform(_bet(bet), one)

    def by_code(c: Column) -> Column:
        return _lookup(OUTCOME_CODES, c)

    def by_side(c: Column) -> Column:
        return _lookup({"Over": "OVER", "Under": "UNDER"}, c)

    name, country = F.col("o.league.name"), F.nullif(F.col("o.league.country"), F.lit(""))
    common = {
        "source": F.coalesce(F.nullif(F.col("b.name"), F.lit("")), F.lit("unknown")),
        "league": F.when(name != "", F.when(country.isNotNull(), F.concat_ws(" - ", country, name)).otherwise(name)),
        "fixture_id": F.col("o.fixture.id"), "start_time": _time(F.col("o.fixture.date")), "source_timestamp": _time(F.col("o.update")),
        "source_id": F.col("b.id"), "source_event_id": F.col("o.fixture.id").cast("string"), "source_competition_id": F.col("o.league.id"), "country": country,
    }
    three, two = ("1", "X", "2"), ("OVER", "UNDER")
    markets = [
        (DEFAULT_MARKET, _prices(pairs(MATCH_WINNER, by_code, None), three)), (TOTALS_2_5_MARKET, _prices(pairs(OVER_UNDER, by_side, "2.5"), two)),
        (HANDICAP_MINUS_1_MARKET, _prices(pairs(HANDICAP_RESULT, by_code, "-1"), three)),
    ]
    # priced first: payloads aren't shuffled
    return _record(_by_fixture(_priced(books, markets, **common)).join(fixtures_of(fixtures), "fixture_id"))


# ------------------------------------------------------------- listings


def listing_feed(df: DataFrame, source: str) -> DataFrame:
    """A bookmaker's own listing, live and pre-match alike: the phase is each match's own."""
    schema = (
        "items array<struct<id:string, sport:struct<name:string>, competition:struct<id:string, name:string>, home:struct<id:string, name:string>, "
        "visitor:struct<id:string, name:string>, startTime:bigint, status:struct<isLive:boolean, name:string>, "
        f"oddsGroup:array<struct<groupName:string, odds:array<struct<oddStatus:string, subgame:struct<shortName:string>, value:{PRICE}>>>>>>"
    )
    rows = _shaped(df, schema, F.col("d.items").isNotNull(), "a listing with items").select("observed_at", F.explode("d.items").alias("m"))
    group = F.get(F.filter("m.oddsGroup", lambda g: g["groupName"] == LISTING_RESULT), F.lit(0))
    pairs = F.transform(
        F.filter(group["odds"], lambda o: o["oddStatus"] == "ACTIVE"),
        lambda o: F.struct(o["subgame"]["shortName"].alias("code"), o["value"].alias("price")),
    )
    live = F.coalesce(F.col("m.status.isLive"), F.lit(False))
    sport = _lookup(SPORTS, F.col("m.sport.name"))
    rows = rows.filter(sport.isNotNull() & (live | (F.col("m.status.name") == NOT_STARTED)) & F.col("m.id").isNotNull())
    return _record(_priced(
        rows, [(DEFAULT_MARKET, _prices(pairs, ("1", "X", "2")))], F.when(live, LIVE_MARKET.phase).otherwise(DEFAULT_MARKET.phase),
        source=F.lit(source), sport=sport, league=F.col("m.competition.name"), home_team=F.col("m.home.name"), away_team=F.col("m.visitor.name"),
        start_time=F.timestamp_millis("m.startTime"),
        lifecycle=F.when(live, "live").otherwise("scheduled"), source_event_id=F.col("m.id"),
        source_home_team_id=F.col("m.home.id"), source_away_team_id=F.col("m.visitor.id"), source_competition_id=F.col("m.competition.id"),
    ))


def league_feed(df: DataFrame, source: str) -> DataFrame:
    """A listing by league, or as plain events: final result and the 2.5 goals line."""
    event = (
        "struct<header:struct<eventId:string, sport:struct<name:string>, region:struct<name:string>, league:struct<leagueId:string, name:string>, "
        "rivals:array<string>, rivalIds:array<string>, startTime:bigint>, positions:array<struct<groups:array<struct<name:string, "
        f"overUnder:{PRICE}, selections:array<struct<name:string, price:{PRICE}, state:string, placeholder:boolean>>>>>>>"
    )
    schema = f"payload struct<leagues:array<struct<events:array<{event}>>>, events:array<{event}>>"
    whole = F.col("d.payload.leagues").isNotNull() | F.col("d.payload.events").isNotNull()
    nested = F.flatten(F.transform("d.payload.leagues", lambda x: F.coalesce(x["events"], F.array().cast(f"array<{event}>"))))
    rows = _shaped(df, schema, whole, "a listing of leagues or events").select("observed_at", F.explode(F.coalesce(nested, F.col("d.payload.events"))).alias("e"))
    sport = _lookup(SPORTS, F.col("e.header.sport.name"))
    rows = rows.filter(sport.isNotNull() & (F.size("e.header.rivals") == 2) & F.col("e.header.eventId").isNotNull())
    groups = F.flatten(F.transform("e.positions", lambda p: p["groups"]))

    def pairs(group: Column, code) -> Column:
        live = F.filter(group["selections"], lambda s: ~F.coalesce(s["placeholder"], F.lit(False)) & (s["state"] == "ACTIVE"))
        return F.transform(live, lambda s: F.struct(code(s["name"]).alias("code"), s["price"].alias("price")))

    result = F.get(F.filter(groups, lambda g: g["name"] == LEAGUE_RESULT), F.lit(0))
    totals = F.get(F.filter(groups, lambda g: (g["name"] == LEAGUE_TOTALS) & (g["overUnder"] == F.lit("2.5").cast(PRICE))), F.lit(0))
    region, ids = F.nullif(F.col("e.header.region.name"), F.lit("")), F.col("e.header.rivalIds")
    two_ids = F.size(ids) == 2
    common = {
        "source": F.lit(source), "sport": sport,
        "league": F.when(region.isNotNull(), F.concat_ws(" - ", region, "e.header.league.name")).otherwise(F.col("e.header.league.name")),
        "home_team": F.get("e.header.rivals", F.lit(0)), "away_team": F.get("e.header.rivals", F.lit(1)),
        "start_time": F.timestamp_millis("e.header.startTime"), "source_event_id": F.col("e.header.eventId"),
        "source_home_team_id": F.when(two_ids, F.get(ids, F.lit(0))), "source_away_team_id": F.when(two_ids, F.get(ids, F.lit(1))),
        "source_competition_id": F.col("e.header.league.leagueId"), "country": region,
    }
    rows = rows.filter(F.col("e.header.league.name").isNotNull())
    markets = [
        (DEFAULT_MARKET, _prices(pairs(result, lambda n: n), ("1", "X", "2"))),
        (TOTALS_2_5_MARKET, _prices(pairs(totals, lambda n: _lookup(TOTAL_OUTCOMES, n)), ("OVER", "UNDER"))),
    ]
    return _record(_priced(rows, markets, **common))


# ------------------------------------------------------------- browser archives


def wildcard(pattern: str) -> str:
    """A pattern with ``*`` as a regular expression for the whole text."""
    return "^" + ".*".join("".join("\\" + c if not c.isalnum() else c for c in part) for part in pattern.split("*")) + "$"


def checked_items(items: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``har_items`` that all have the ``required`` fields; archives without any item, or with
    items of another shape among them, raise: half a capture would look like a whole one."""
    missing = F.lit(False)
    for field in required:
        missing = missing | F.get_json_object("item", f"$.{field}").isNull()
    found = items.agg(F.count("*").alias("n"), F.count_if(missing).alias("odd"))
    fault = F.when(F.col("n") == 0, F.raise_error(F.lit("the archive holds no item"))).when(F.col("odd") > 0, F.raise_error(F.lit("the archive holds items of another shape")))
    return items.crossJoin(F.broadcast(found.select(F.coalesce(fault.cast("int"), F.lit(0)).alias("_f")))).filter("_f = 0").drop("_f")  # one row


def har_items(df: DataFrame, url: str, array: str = "$.items", key: str = "$.id") -> DataFrame:
    """(position, item): the items of all JSON responses to ``url`` in browser archives
    (payload rows), one an id: the last body wins, at the place of the first."""
    schema = "log struct<entries:array<struct<request:struct<url:string>, response:struct<content:struct<text:string>>>>>"
    entries = df.select(F.posexplode(F.from_json("payload", schema)["log"]["entries"]).alias("at", "x"))
    bodies = entries.filter(F.col("x.request.url").rlike(wildcard(url)))
    items = bodies.select("at", F.posexplode(F.from_json(F.get_json_object("x.response.content.text", array), "array<string>")).alias("no", "item"))
    place = F.struct("at", "no")
    kept = items.groupBy(F.get_json_object("item", key).alias("id")).agg(F.min(place).alias("position"), F.max_by("item", place).alias("item"))
    return kept.filter("id is not null").select("id", "position", "item")
