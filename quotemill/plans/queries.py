"""Registered queries of the quote engine, each with its SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Freshness, Settings
from ..functions import text as T
from ..operators import analysis as A
from ..operators import counters as C
from ..operators import fuzzy as Z
from ..operators import identity as I
from ..operators import mappings as M
from ..operators import operations as O
from ..operators import quotes as Q
from ..operators import reports as R
from ..operators import signals as S
from ..operators import validation as V
from ..sources import feeds
from ..sources.tape import table, tape
from .detection import detect

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

DAYS = 86_400
#: The tape covers a month with few quotes an hour, so its freshness is counted in days.
TAPE_FRESHNESS = Freshness(max_age=10 * DAYS, max_spread=9 * DAYS, skew=10)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- the tape in SQL

_TAPE = """
WITH tape0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), tape AS (
  SELECT event_id AS id, user_id % 40 AS event_id, CAST(k % 8 AS BIGINT) AS bookmaker_id, CAST(k % 3 AS BIGINT) AS provider_id,
    CASE WHEN event_type IN ('view','click','purchase') THEN 'three_way' ELSE 'totals' END AS market_type,
    CASE WHEN event_type IN ('view','click','purchase') THEN NULL WHEN event_id % 2 = 0 THEN '2.5' ELSE '3.5' END AS market_line,
    CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN 'X' WHEN 'purchase' THEN '2' WHEN 'signup' THEN 'OVER' ELSE 'UNDER' END AS outcome,
    CAST(CAST(1.01 AS DECIMAL(18,4)) + CAST(value AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS odds,
    ts AS observed_at,
    CASE WHEN k % 4 = 0 THEN ts ELSE ts - to_minutes(k) END AS quote_time
  FROM tape0
), clock AS (SELECT max(quote_time) AS now FROM tape
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome
                               ORDER BY quote_time DESC, observed_at DESC, id DESC) AS rn
  FROM tape
), latest AS (SELECT * FROM ranked WHERE rn = 1
), aged AS (
  SELECT latest.*, epoch_us(now) - epoch_us(quote_time) AS age,
    epoch_us(now) - epoch_us(quote_time) BETWEEN -10000000 AND 864000000000 AS is_fresh
  FROM latest, clock
), spread AS (
  SELECT *, max(CASE WHEN is_fresh THEN epoch_us(quote_time) END) OVER g - min(CASE WHEN is_fresh THEN epoch_us(quote_time) END) OVER g AS gap
  FROM aged WINDOW g AS (PARTITION BY event_id, market_type, market_line)
), fresh AS (SELECT * FROM spread WHERE is_fresh AND gap <= 777600000000
), best AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, market_type, market_line, outcome ORDER BY odds DESC, bookmaker_id, id) AS b FROM fresh) WHERE b = 1
), margins AS (
  SELECT event_id, market_type, market_line, sum(1.0 / CAST(odds AS DOUBLE)) AS margin, count(*) AS n
  FROM best GROUP BY ALL
), surebet AS (
  SELECT * FROM margins WHERE n = CASE market_type WHEN 'three_way' THEN 3 ELSE 2 END
), med AS (
  SELECT event_id, market_type, market_line, outcome, count(*) AS n, median(CAST(odds AS DECIMAL(24,6))) AS median FROM fresh GROUP BY ALL
), tagged AS (SELECT fresh.*, med.n, med.median FROM fresh JOIN med ON fresh.event_id = med.event_id AND fresh.market_type = med.market_type
    AND fresh.market_line IS NOT DISTINCT FROM med.market_line AND fresh.outcome = med.outcome
), own AS (
  SELECT * FROM (SELECT *, first_value(provider_id) OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome
                               ORDER BY quote_time DESC, observed_at DESC, id DESC) AS p FROM tape) WHERE provider_id = p
), pairs AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome
                               ORDER BY quote_time DESC, observed_at DESC, id DESC) AS reading FROM own
), moves AS (
  SELECT c.event_id, c.bookmaker_id, c.market_type, c.market_line, c.outcome, p.odds AS previous_odds, c.odds AS current_odds,
    p.observed_at AS previous_observed_at, c.observed_at AS current_observed_at,
    (epoch_us(c.quote_time) - epoch_us(p.quote_time)) / 1e6 AS elapsed_seconds
  FROM pairs c JOIN pairs p ON c.reading = 1 AND p.reading = 2 AND c.event_id = p.event_id AND c.bookmaker_id = p.bookmaker_id
    AND c.market_type = p.market_type AND c.market_line IS NOT DISTINCT FROM p.market_line AND c.outcome = p.outcome
), detected AS (
  SELECT * FROM moves WHERE abs(current_odds - previous_odds) * 100 >= 10 * previous_odds AND elapsed_seconds BETWEEN 0 AND 86400
    AND current_observed_at >= previous_observed_at
)
"""
_KEY = "event_id, market_type, market_line"
SLIM = ["event_id", "market_type", "market_line"]


def _now(df: DataFrame):
    """The tape's clock: one value, a scalar subquery of the plan."""
    return df.agg(F.max("quote_time").cast("timestamp_ntz").alias("t")).scalar()


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = tape(spark, sf_dir)
    return A.coherent(Q.latest(quotes), TAPE_FRESHNESS, _now(quotes))


# ---------------------------------------------------------------- quotes


@query(_TAPE + "SELECT id, event_id, bookmaker_id, provider_id, market_type, market_line, outcome, odds, observed_at, quote_time FROM tape")
def quote_tape(spark, sf_dir):
    return tape(spark, sf_dir).select("id", "event_id", "bookmaker_id", "provider_id", "market_type", "market_line", "outcome", "odds", "observed_at", "quote_time")


@query(_TAPE + f"SELECT id, {_KEY}, bookmaker_id, outcome, odds, quote_time FROM latest")
def latest_quotes(spark, sf_dir):
    return Q.latest(tape(spark, sf_dir)).select("id", *SLIM, "bookmaker_id", "outcome", "odds", "quote_time")


@query(_TAPE + "SELECT id, odds, quote_time FROM latest WHERE event_id = 7 AND bookmaker_id = 3 AND market_type = 'three_way' AND outcome = '1'")
def latest_single(spark, sf_dir):
    one = "event_id = 7 and bookmaker_id = 3 and market_type = 'three_way' and outcome = '1'"
    return Q.latest(tape(spark, sf_dir).filter(one)).select("id", "odds", "quote_time")


@query(_TAPE + f"SELECT id, {_KEY}, bookmaker_id, outcome, odds, CAST(rn AS INT) AS reading FROM ranked WHERE rn <= 2")
def last_two(spark, sf_dir):
    return Q.last_readings(tape(spark, sf_dir), 2).select("id", *SLIM, "bookmaker_id", "outcome", "odds", "reading")


@query(_TAPE + f"""SELECT id, {_KEY}, bookmaker_id, outcome, odds, provider_id, CAST(reading AS INT) AS reading FROM pairs WHERE reading <= 2""")
def last_two_same_provider(spark, sf_dir):
    return Q.last_two_same_provider(tape(spark, sf_dir)).select("id", *SLIM, "bookmaker_id", "outcome", "odds", "provider_id", "reading")


@query(_TAPE + """, minute AS (SELECT *, date_trunc('hour', observed_at) AS slot FROM tape)
SELECT id, event_id, odds, slot FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome, slot ORDER BY id) AS r FROM minute) WHERE r = 1""")
def dedupe_first_wins(spark, sf_dir):
    hourly = tape(spark, sf_dir).withColumn("observed_at", F.date_trunc("hour", "observed_at").cast("timestamp_ntz"))
    return Q.first_wins(hourly).select("id", "event_id", "odds", F.col("observed_at").alias("slot"))


@query(_TAPE + """, hourly AS (SELECT *, date_trunc('day', observed_at) AS slot FROM tape),
old AS (SELECT * FROM hourly WHERE id % 3 = 0), new AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome, slot ORDER BY id) AS r FROM hourly WHERE id % 3 <> 0) WHERE r = 1)
SELECT id, event_id, odds FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.event_id = new.event_id AND old.bookmaker_id = new.bookmaker_id
 AND old.market_type = new.market_type AND old.market_line IS NOT DISTINCT FROM new.market_line AND old.outcome = new.outcome AND old.slot = new.slot)""")
def insert_if_absent(spark, sf_dir):
    daily = tape(spark, sf_dir).withColumn("observed_at", F.date_trunc("day", "observed_at").cast("timestamp_ntz"))
    return Q.insert_if_absent(daily.filter("id % 3 = 0"), daily.filter("id % 3 <> 0")).select("id", "event_id", "odds")


@query(_TAPE + "SELECT DISTINCT market_type, market_line FROM tape")
def distinct_markets(spark, sf_dir):
    return Q.distinct_markets(tape(spark, sf_dir)).select("market_type", "market_line")


@query(_TAPE + """SELECT id, CAST(ROW_NUMBER() OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome ORDER BY observed_at, id) AS INT) AS position FROM tape""")
def history_by_event(spark, sf_dir):
    return Q.history(tape(spark, sf_dir)).select("id", "position")


@query(_TAPE + "SELECT now AS analysis_time FROM clock")
def analysis_time(spark, sf_dir):
    return Q.analysis_time(tape(spark, sf_dir))


# ---------------------------------------------------------------- freshness and opportunities


@query(_TAPE + f"""SELECT {_KEY}, count(*) AS snapshots, count(*) FILTER (is_fresh) AS fresh, (max(epoch_us(quote_time)) FILTER (is_fresh) - min(epoch_us(quote_time)) FILTER (is_fresh)) / 1e6 AS spread_seconds,
 coalesce(string_agg(DISTINCT CAST(bookmaker_id AS VARCHAR), ',' ORDER BY CAST(bookmaker_id AS VARCHAR)) FILTER (NOT is_fresh), '') AS stale_sources,
 CASE WHEN count(*) FILTER (is_fresh) = 0 THEN 'no-fresh-snapshots' WHEN max(gap) > 777600000000 THEN 'observation-spread-too-large' END AS reason FROM spread GROUP BY ALL""")
def freshness_summary(spark, sf_dir):
    quotes = tape(spark, sf_dir)
    return A.freshness_summary(Q.latest(quotes), TAPE_FRESHNESS, _now(quotes)).select(*SLIM, "snapshots", "fresh", "spread_seconds", "stale_sources", "reason")


@query(_TAPE + f"SELECT {_KEY}, outcome, odds, bookmaker_id, id FROM best")
def best_odds(spark, sf_dir):
    return A.best_odds(_usable(spark, sf_dir)).select(*SLIM, "outcome", "odds", "bookmaker_id", "id")


@query(_TAPE + f"""SELECT {_KEY}, ROUND(margin, 8) AS margin, margin < 1 AS is_surebet, ROUND(CASE WHEN margin < 1 THEN (1 / margin - 1) * 100 ELSE 0 END, 6) AS profit_percent FROM surebet""")
def arbitrage(spark, sf_dir):
    out = A.arbitrage(A.best_odds(_usable(spark, sf_dir))).filter("evaluated")
    return out.select(*SLIM, F.round("margin", 8).alias("margin"), "is_surebet", F.round("profit_percent", 6).alias("profit_percent"))


@query(_TAPE + f"SELECT {_KEY}, ROUND(margin, 8) AS margin, ROUND((1 / margin - 1) * 100, 6) AS profit_percent FROM surebet WHERE margin < 1")
def surebet_candidates(spark, sf_dir):
    quotes = tape(spark, sf_dir)
    found = A.surebets(quotes, TAPE_FRESHNESS, _now(quotes)).filter("is_surebet")
    return found.select(*SLIM, F.round("margin", 8).alias("margin"), F.round("profit_percent", 6).alias("profit_percent"))


@query(_TAPE + f"SELECT {_KEY}, margin < 1 AS is_surebet FROM surebet")
def surebet_evaluated(spark, sf_dir):
    quotes = tape(spark, sf_dir)
    return A.surebets(quotes, TAPE_FRESHNESS, _now(quotes)).select(*SLIM, "is_surebet")


@query(_TAPE + f"""SELECT b.event_id, b.market_type, b.market_line, b.outcome, b.bookmaker_id, ROUND((1.0 / CAST(b.odds AS DOUBLE)) / s.margin * 100, 6) AS stake_percent
 FROM best b JOIN surebet s ON b.event_id = s.event_id AND b.market_type = s.market_type AND b.market_line IS NOT DISTINCT FROM s.market_line""")
def stake_split(spark, sf_dir):
    out = A.stakes(A.best_odds(_usable(spark, sf_dir)))
    return out.select(*SLIM, "outcome", "bookmaker_id", F.round("stake_percent", 6).alias("stake_percent"))


@query(_TAPE + f"SELECT {_KEY}, outcome, n, median FROM med")
def medians(spark, sf_dir):
    return A.medians(_usable(spark, sf_dir)).select(*SLIM, "outcome", "n", "median")


_OUT = f"SELECT id, {_KEY}, outcome, odds, median, ROUND((CAST(odds AS DOUBLE) - CAST(median AS DOUBLE)) / CAST(median AS DOUBLE) * 100, 6) AS deviation_percent FROM tagged WHERE n >= 3 AND abs(odds - median) * 100 >= 15 * median"


def _outlier_columns(df: DataFrame) -> DataFrame:
    return df.select("id", *SLIM, "outcome", "odds", "median", F.round("deviation_percent", 6).alias("deviation_percent"))


@query(_TAPE + _OUT)
def outliers(spark, sf_dir):
    return _outlier_columns(A.outliers(_usable(spark, sf_dir)))


@query(_TAPE + _OUT + " AND odds > median")
def value_gaps(spark, sf_dir):
    return _outlier_columns(A.value_gaps(_usable(spark, sf_dir)))


@query(_TAPE + f"SELECT {_KEY}, outcome, n FROM med WHERE n >= 3")
def value_gap_evaluated(spark, sf_dir):
    return A.value_gap_evaluated(_usable(spark, sf_dir)).select(*SLIM, "outcome", "n")


@query(_TAPE + f""", newest AS (SELECT *, max(quote_time) OVER (PARTITION BY event_id, market_type, market_line, outcome) AS m, count(*) OVER (PARTITION BY event_id, market_type, market_line, outcome) AS c FROM latest)
SELECT id, {_KEY}, outcome, bookmaker_id, (epoch_us(m) - epoch_us(quote_time)) / 1e6 AS lag_seconds FROM newest WHERE c >= 2 AND epoch_us(m) - epoch_us(quote_time) >= 120000000""")
def bookmaker_lag(spark, sf_dir):
    return A.bookmaker_lag(Q.latest(tape(spark, sf_dir))).select("id", *SLIM, "outcome", "bookmaker_id", "lag_seconds")


@query(_TAPE + f"""SELECT {_KEY}, bookmaker_id, outcome, previous_odds, current_odds, ROUND((CAST(current_odds AS DOUBLE) - CAST(previous_odds AS DOUBLE)) / CAST(previous_odds AS DOUBLE) * 100, 8) AS change_percent,
 elapsed_seconds, abs(current_odds - previous_odds) * 100 >= 10 * previous_odds AND elapsed_seconds BETWEEN 0 AND 86400 AND current_observed_at >= previous_observed_at AS detected FROM moves""")
def movements(spark, sf_dir):
    out = A.movements(tape(spark, sf_dir))
    return out.select(*SLIM, "bookmaker_id", "outcome", "previous_odds", "current_odds", F.round("change_percent", 8).alias("change_percent"), "elapsed_seconds", "detected")


@query(_TAPE + f"""SELECT 'SUREBET' AS kind, {_KEY}, NULL AS outcome, ROUND((1 / margin - 1) * 100, 6) AS edge FROM surebet WHERE margin < 1 AND (1 / margin - 1) * 100 >= 1
 UNION ALL SELECT 'VALUE_GAP', {_KEY}, outcome, ROUND((CAST(odds AS DOUBLE) - CAST(median AS DOUBLE)) / CAST(median AS DOUBLE) * 100, 6) FROM tagged WHERE n >= 3 AND abs(odds - median) * 100 >= 15 * median AND odds > median""")
def opportunity_report(spark, sf_dir):
    quotes = tape(spark, sf_dir)
    out = R.opportunity_report(quotes, TAPE_FRESHNESS, _now(quotes))
    return out.select("kind", *SLIM, "outcome", F.round("edge", 6).alias("edge"))


@query(_TAPE + f"""SELECT {_KEY}, bookmaker_id, outcome, ROUND(abs((CAST(current_odds AS DOUBLE) - CAST(previous_odds AS DOUBLE)) / CAST(previous_odds AS DOUBLE) * 100), 8) AS size,
 CASE WHEN s >= 3600 THEN format('{{}}h{{:02d}}m', s // 3600, (s % 3600) // 60) WHEN s >= 60 THEN format('{{}}m{{:02d}}s', s // 60, s % 60) ELSE format('{{}}s', s) END AS elapsed
 FROM (SELECT *, CAST(floor(elapsed_seconds) AS BIGINT) AS s FROM detected)""")
def movement_report(spark, sf_dir):
    out = R.movement_report(A.movements(tape(spark, sf_dir)))
    return out.select(*SLIM, "bookmaker_id", "outcome", F.round(F.abs("change_percent"), 8).alias("size"), "elapsed")


# ---------------------------------------------------------------- validation and ingestion

_RAW = """
WITH raw AS (
  SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'feed' END AS source,
    'team ' || CAST(user_id % 7 AS VARCHAR) AS home_team, CASE WHEN event_id % 13 = 0 THEN 'TEAM ' ELSE 'team ' END || CAST((user_id // 7) % 7 AS VARCHAR) AS away_team,
    CASE WHEN event_id % 17 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS observed_at,
    CASE WHEN event_type IN ('view','click') THEN 'three_way' WHEN event_type = 'error' THEN NULL ELSE 'totals' END AS market_type,
    value, event_type FROM events
), judged AS (
  SELECT *, trim(source) = '' AS s1, lower(trim(home_team)) = lower(trim(away_team)) AS s2, market_type IS NULL AS s3,
    value <= 1 AS v1, value > 1000 AS v2, event_type = 'click' AS w, observed_at NOT LIKE '%Z' AS t FROM raw
)"""


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as untrusted records: blank sources, a team against itself, no market, low
    or missing prices and timestamps without an offset occur in them."""
    e = table(spark, sf_dir, "events")
    value = F.col("value").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 11 == 0, " ").otherwise("feed").alias("source"),
        F.lit("football").alias("sport"), F.lit("league").alias("league"),
        F.concat(F.lit("team "), (F.col("user_id") % 7).cast("string")).alias("home_team"),
        F.concat(F.when(F.col("event_id") % 13 == 0, "TEAM ").otherwise("team "), (F.floor(F.col("user_id") / 7) % 7).cast("string")).alias("away_team"),
        F.lit("2024-03-01T12:00:00Z").alias("start_time"),
        F.when(F.col("event_id") % 17 == 0, stamp).otherwise(F.concat(stamp, F.lit("Z"))).alias("observed_at"),
        F.lit(None).cast("string").alias("source_timestamp"),
        F.when(F.col("event_type").isin("view", "click"), "three_way").when(F.col("event_type") == "error", None).otherwise("totals").alias("market_type"),
        F.when(F.col("event_type") == "click", F.create_map(F.lit("1"), value, F.lit("X"), F.lit("3.1")))
        .otherwise(F.create_map(F.lit("1"), value, F.lit("X"), F.lit("3.1"), F.lit("2"), F.lit("2.9"))).alias("odds"),
    )


@query(_RAW + """
SELECT id, CASE WHEN s1 OR s2 OR s3 THEN 'structural' WHEN v1 OR w OR t THEN 'semantic' END AS stage,
 CASE WHEN s1 OR s2 OR s3 THEN concat_ws(', ', CASE WHEN s1 THEN 'missing-source' END, CASE WHEN s2 THEN 'same-home-away-team' END, CASE WHEN s3 THEN 'missing-market' END)
 ELSE concat_ws(', ', CASE WHEN v1 THEN 'invalid-odds-value' END, CASE WHEN w THEN 'invalid-three-way-outcomes' END, CASE WHEN t THEN 'naive-observed-at' END) END AS codes,
 CASE WHEN v2 AND NOT (s1 OR s2 OR s3) THEN 1 ELSE 0 END AS n_warnings FROM judged""")
def validation_issues(spark, sf_dir):
    out = V.validate(_raw_records(spark, sf_dir))
    return out.select("id", "stage", F.array_join("errors", ", ").alias("codes"), F.size("warnings").alias("n_warnings"))


@query(_RAW + """ SELECT stage, count(*) AS rejected FROM (SELECT CASE WHEN s1 OR s2 OR s3 THEN 'structural' WHEN v1 OR w OR t THEN 'semantic' END AS stage FROM judged) WHERE stage IS NOT NULL GROUP BY stage""")
def rejections_by_stage(spark, sf_dir):
    judged = V.validate(_raw_records(spark, sf_dir))
    audit = judged.select(F.col("is_valid").alias("accepted"), V.rejection_reason(F.col("stage"), F.col("errors")).alias("rejection_reason"))
    return V.rejections_by_stage(audit)


_RUNS = """
WITH runs AS (
  SELECT o_orderkey AS id, o_orderpriority AS source, o_orderdate AS started_at,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate + to_minutes(CAST(o_orderkey % 90 AS INT)) END AS finished_at,
    CASE WHEN o_orderkey % 29 = 0 THEN 'running' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'success' END AS status,
    o_orderkey % 50 AS records_received, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE (o_orderkey % 50) // 2 END AS records_accepted,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'payload' END AS source_payload FROM orders
), clock AS (SELECT max(started_at) AS now FROM runs)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as collector runs."""
    key = F.col("o_orderkey")
    running = key % 29 == 0
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_orderpriority").alias("source"), at.alias("started_at"),
        F.when(running, None).otherwise(at + F.make_dt_interval(mins=(key % 90).cast("int"))).alias("finished_at"),
        F.when(running, "running").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("success").alias("status"),
        (key % 50).alias("records_received"),
        F.when(F.col("o_orderstatus") == "F", F.lit(0)).otherwise(F.floor(key % 50 / 2)).cast("long").alias("records_accepted"),
        F.when(key % 3 == 0, None).otherwise("payload").alias("source_payload"),
        F.lit(None).cast("string").alias("error_type"),
    )


def _run_clock(runs: DataFrame):
    return runs.agg(F.max("started_at").cast("timestamp_ntz").alias("t")).scalar()


@query(_RUNS + """ SELECT id, CASE WHEN records_received = 0 THEN 0.0 ELSE ROUND(records_accepted / records_received, 8) END AS acceptance_rate, CAST(epoch(finished_at) - epoch(started_at) AS DOUBLE) AS duration_seconds,
 CASE WHEN records_accepted = 0 AND records_received > 0 THEN 'failed' WHEN records_accepted < records_received THEN 'partial' ELSE 'success' END AS derived FROM runs""")
def ingestion_run_summary(spark, sf_dir):
    runs = V.run_metrics(_runs(spark, sf_dir))
    rejected = F.col("records_received") - F.col("records_accepted")
    derived = V.run_status(F.col("records_accepted"), rejected, F.lit(0), F.lit(True), F.lit(False))
    return runs.select("id", F.round("acceptance_rate", 8).alias("acceptance_rate"), "duration_seconds", derived.alias("derived"))


@query(_RUNS + """ SELECT source, id, started_at, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS r FROM runs) WHERE r = 1""")
def latest_run_by_source(spark, sf_dir):
    return O.latest_run(_runs(spark, sf_dir)).select("source", "id", "started_at", "status")


@query(_RUNS + """ SELECT id, CASE WHEN status = 'running' AND started_at < now - INTERVAL 60 MINUTE THEN 'failed' ELSE status END AS status,
 CASE WHEN status = 'running' AND started_at < now - INTERVAL 60 MINUTE THEN 'process_interrupted' END AS error_type FROM runs, clock""")
def stale_run_recovery(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return O.recover_stale(runs, _run_clock(runs)).select("id", "status", "error_type")


@query(_RUNS + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS rn FROM runs)
SELECT source, max(started_at) FILTER (rn = 1) AS last_run_at, max(status) FILTER (rn = 1) AS last_status,
 max(started_at) FILTER (status IN ('success','partial')) AS last_success_at, max(started_at) FILTER (status IN ('success','partial') AND source_payload IS NOT NULL) AS last_fresh_at,
 count(*) FILTER (started_at >= now - INTERVAL 2400 HOUR) AS runs_in_window, count(*) FILTER (started_at >= now - INTERVAL 2400 HOUR AND status = 'failed') AS failures_in_window,
 CAST(coalesce(min(rn) FILTER (rn <= 50 AND status <> 'failed') - 1, count(*) FILTER (rn <= 50)) AS BIGINT) AS consecutive_failures,
 ROUND(count(*) FILTER (started_at >= now - INTERVAL 2400 HOUR AND status = 'failed') / count(*) FILTER (started_at >= now - INTERVAL 2400 HOUR), 8) AS failure_rate,
 epoch(any_value(now)) - epoch(max(started_at) FILTER (status IN ('success','partial') AND source_payload IS NOT NULL)) > 86400 AS is_stale
FROM r, clock GROUP BY source""")
def provider_health(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    out = O.provider_health(runs, _run_clock(runs), window_hours=2400)
    return out.withColumn("failure_rate", F.round("failure_rate", 8)).drop("staleness_seconds")


@query(_RUNS + """, ages AS (SELECT *, now FROM runs, clock)
SELECT 'raw_payloads' AS table_name, count(*) AS expired FROM ages WHERE finished_at < now - INTERVAL 14 DAY
UNION ALL SELECT 'snapshots', count(*) FROM ages WHERE started_at < now - INTERVAL 90 DAY
UNION ALL SELECT 'history', count(*) FROM ages WHERE started_at < now - INTERVAL 180 DAY""")
def retention_counts(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    tables = {"raw_payloads": (runs, "finished_at", 14), "snapshots": (runs, "started_at", 90), "history": (runs, "started_at", 180)}
    return O.retention_counts(tables, _run_clock(runs))


@query(_RUNS + """ SELECT count(*) AS runs, count(*) FILTER (CASE WHEN finished_at < now - INTERVAL 14 DAY THEN NULL ELSE source_payload END IS NOT NULL) AS payloads FROM runs, clock""")
def payload_clearing(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return O.cleared_payloads(runs, 14, _run_clock(runs)).agg(F.count("*").alias("runs"), F.count("source_payload").alias("payloads"))


# ---------------------------------------------------------------- signals

_SIGNALS = _TAPE + """
, daily AS (SELECT *, date_trunc('day', quote_time) AS sweep_ts FROM tape
), dbest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sweep_ts, event_id, market_type, market_line, outcome ORDER BY odds DESC, bookmaker_id, id) AS b FROM daily) WHERE b = 1
), dm AS (SELECT sweep_ts, event_id, market_type, market_line, sum(1.0 / CAST(odds AS DOUBLE)) AS margin, count(*) AS n FROM dbest GROUP BY ALL
), ev AS (SELECT sweep_ts, event_id, market_type, coalesce(market_line, '') AS line, CASE WHEN margin < 1 THEN ROUND((1 / margin - 1) * 100, 6) END AS edge
    FROM dm WHERE n = CASE market_type WHEN 'three_way' THEN 3 ELSE 2 END
), axis AS (SELECT DISTINCT sweep_ts FROM daily
), ids AS (SELECT event_id, market_type, line, min(sweep_ts) AS f FROM ev WHERE edge IS NOT NULL GROUP BY ALL
), starts AS (SELECT event_id, date_trunc('day', min(observed_at)) + to_days(CAST(10 + event_id % 17 AS INT)) AS start_time FROM tape GROUP BY event_id
), cells AS (SELECT ids.event_id, ids.market_type, ids.line, axis.sweep_ts, ev.edge,
    CASE WHEN ev.edge IS NOT NULL THEN 'C' WHEN ev.event_id IS NOT NULL THEN 'M' ELSE 'N' END AS kind,
    starts.start_time < axis.sweep_ts - INTERVAL 3 HOUR OR (ids.event_id % 10 = 0 AND axis.sweep_ts >= TIMESTAMP '2024-01-15') AS over_
  FROM ids JOIN axis ON axis.sweep_ts >= ids.f JOIN starts ON starts.event_id = ids.event_id
  LEFT JOIN ev ON ev.event_id = ids.event_id AND ev.market_type = ids.market_type AND ev.line = ids.line AND ev.sweep_ts = axis.sweep_ts
), f1 AS (SELECT *, sum(CASE WHEN kind = 'C' THEN 1 ELSE 0 END) OVER (PARTITION BY event_id, market_type, line ORDER BY sweep_ts) AS cg FROM cells
), f2 AS (SELECT *, first_value(CASE WHEN kind = 'M' THEN 'RESOLVED' WHEN kind = 'N' AND over_ THEN 'EXPIRED' END IGNORE NULLS) OVER (PARTITION BY event_id, market_type, line, cg ORDER BY sweep_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ft FROM f1
), f3 AS (SELECT *, coalesce(ft, 'ACTIVE') AS status FROM f2
), f4 AS (SELECT *, lag(status) OVER (PARTITION BY event_id, market_type, line ORDER BY sweep_ts) AS prev FROM f3
), f5 AS (SELECT *, sum(CASE WHEN kind = 'C' AND prev IS DISTINCT FROM 'ACTIVE' THEN 1 ELSE 0 END) OVER (PARTITION BY event_id, market_type, line ORDER BY sweep_ts) AS episode FROM f4
), f6 AS (SELECT *, max(edge) OVER (PARTITION BY event_id, market_type, line, episode ORDER BY sweep_ts) AS peak,
   max(edge) OVER (PARTITION BY event_id, market_type, line, episode ORDER BY sweep_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f5
), folded AS (SELECT *, CASE WHEN kind = 'C' AND prev IS NULL THEN 'created' WHEN kind = 'C' AND prev IS DISTINCT FROM 'ACTIVE' THEN 'reactivated' WHEN kind = 'C' AND edge > before THEN 'edge_peak'
   WHEN status = 'RESOLVED' AND prev = 'ACTIVE' THEN 'resolved' WHEN status = 'EXPIRED' AND prev = 'ACTIVE' THEN 'expired' END AS history_event FROM f6)
"""
SIGNAL_KEY = ["event_id", "market_type", "line"]


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sweep a day over the tape, folded to findings and what ended them."""
    daily = tape(spark, sf_dir).withColumn("sweep_ts", F.date_trunc("day", "quote_time").cast("timestamp_ntz"))
    w = Window.partitionBy("sweep_ts", *A.GROUP, "outcome").orderBy(F.desc("odds"), "bookmaker_id", "id")
    best = daily.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    seen = A.arbitrage(best, ["sweep_ts", *A.GROUP]).filter("evaluated").select(
        "sweep_ts", "event_id", "market_type", F.coalesce("market_line", F.lit("")).alias("line"),
        F.when(F.col("is_surebet"), F.round("profit_percent", 6)).alias("edge"),
    )
    starts = daily.groupBy("event_id").agg(F.date_trunc("day", F.min("observed_at")).cast("timestamp_ntz").alias("s")).select(
        "event_id", (F.col("s") + F.make_dt_interval(days=(F.lit(10) + F.col("event_id") % 17).cast("int"))).alias("start_time")
    )
    status = starts.filter("event_id % 10 = 0").select("event_id", F.lit("2024-01-15").cast("timestamp_ntz").alias("updated_at"), F.lit("finished").alias("lifecycle"))
    return S.signals(seen.filter("edge is not null"), seen, daily, starts, status, SIGNAL_KEY, 3)


@query(_SIGNALS + """SELECT event_id, market_type, line, max_by(status, sweep_ts) AS status, max_by(peak, sweep_ts) AS peak_edge, max(sweep_ts) FILTER (kind = 'C') AS last_seen_at, CAST(max_by(episode, sweep_ts) AS BIGINT) AS episode FROM folded GROUP BY ALL""")
def signals_current(spark, sf_dir):
    return S.current(_folded(spark, sf_dir), SIGNAL_KEY).select(*SIGNAL_KEY, "status", "peak_edge", "last_seen_at", "episode")


@query(_SIGNALS + "SELECT event_id, market_type, line, sweep_ts, history_event, edge, status FROM folded WHERE history_event IS NOT NULL")
def signal_history(spark, sf_dir):
    return S.history(_folded(spark, sf_dir), SIGNAL_KEY)


@query(_SIGNALS + "SELECT event_id, market_type, line, sweep_ts FROM folded WHERE history_event = 'expired'")
def signals_expired(spark, sf_dir):
    return _folded(spark, sf_dir).filter("ended_as = 'EXPIRED'").select(*SIGNAL_KEY, F.col("ended_at").alias("sweep_ts"))


@query(_SIGNALS + "SELECT event_id, market_type, line FROM (SELECT event_id, market_type, line, max_by(status, sweep_ts) AS s FROM folded GROUP BY ALL) WHERE s = 'ACTIVE'")
def active_signals(spark, sf_dir):
    return S.current(_folded(spark, sf_dir), SIGNAL_KEY).filter("status = 'ACTIVE'").select(*SIGNAL_KEY)


@query(_SIGNALS + "SELECT sweep_ts, count(*) FILTER (status = 'ACTIVE' OR history_event = 'expired') AS active_before_expiry, count(*) FILTER (status = 'ACTIVE') AS active_after FROM folded GROUP BY ALL")
def active_counts(spark, sf_dir):
    sweeps = tape(spark, sf_dir).select(F.date_trunc("day", "quote_time").cast("timestamp_ntz").alias("sweep_ts"))
    return S.active_counts(_folded(spark, sf_dir), sweeps)


# ---------------------------------------------------------------- identity and operations

_IDENTITY = """
WITH teams AS (SELECT c_custkey AS id, c_name AS canonical_name, c_mktsegment AS sport, CASE WHEN c_custkey % 5 = 0 THEN 'ref' END AS reference_provider FROM customer
), evs AS (SELECT o_orderkey AS id, o_custkey - o_custkey % 3 AS home_team_id, a - a % 3 AS away_team_id, o_custkey % 10 * 3 AS competition_id, o_orderdate AS start_time FROM (SELECT *, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS a FROM orders)
), comps AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS canonical_name, CASE WHEN n_regionkey = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS country FROM nation
), maps AS (SELECT t - t % 4 AS team_id, 'src' || CAST(l_suppkey % 4 AS VARCHAR) AS source, l_orderkey % 997 AS source_id, CASE (l_partkey // 4 + l_linenumber // 6) % 7 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'SUSPECT' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'ODD' ELSE 'UNVERIFIED' END AS trust_state FROM (SELECT *, l_partkey % (SELECT count(*) FROM customer) AS t FROM lineitem)
)"""


def _identity(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers, orders, nations and line items read as teams, events, competitions and mappings. One team in three
    plays and one in four is mapped, so there are orphans, used and unused competitions, and mappings of each state."""
    down = lambda c, n: c - c % n
    state = (F.floor(F.col("l_partkey") / 4) + F.floor(F.col("l_linenumber") / 6)) % 7
    customer = table(spark, sf_dir, "customer")
    # one row, as a scalar subquery of the plan
    n = customer.agg(F.count("*").alias("_n"))
    return {
        "teams": customer.select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("sport"),
            F.when(F.col("c_custkey") % 5 == 0, "ref").alias("reference_provider"),
        ),
        "events": table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select(
            F.col("o_orderkey").alias("id"), down(F.col("o_custkey"), 3).alias("home_team_id"),
            down((F.col("o_custkey") * 7 + F.col("o_orderkey")) % F.col("_n"), 3).alias("away_team_id"), (F.col("o_custkey") % 10 * 3).alias("competition_id"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"),
        ),
        "competitions": table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("canonical_name"),
            F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_regionkey").cast("string")).alias("country"),
        ),
        "mappings": table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n)).select(
            down(F.col("l_partkey") % F.col("_n"), 4).alias("team_id"), F.concat(F.lit("src"), (F.col("l_suppkey") % 4).cast("string")).alias("source"),
            (F.col("l_orderkey") % 997).alias("source_id"),
            F.when(state == 0, "VERIFIED").when(state == 1, "SUSPECT").when(state == 2, "REJECTED").when(state == 3, "ODD").otherwise("UNVERIFIED").alias("trust_state"),
        ),
    }


@query(_IDENTITY + """ SELECT 'team' AS entity, id FROM teams WHERE NOT EXISTS (SELECT 1 FROM evs WHERE home_team_id = teams.id OR away_team_id = teams.id)
UNION ALL SELECT 'competition', id FROM comps WHERE NOT EXISTS (SELECT 1 FROM evs WHERE competition_id = comps.id)""")
def orphan_entities(spark, sf_dir):
    t = _identity(spark, sf_dir)
    teams = O.orphan_teams(t["teams"], t["events"]).select(F.lit("team").alias("entity"), "id")
    return teams.unionByName(O.orphan_competitions(t["competitions"], t["events"]).select(F.lit("competition").alias("entity"), "id"))


@query(_IDENTITY + """ SELECT team_id, count(*) FILTER (trust_state = 'VERIFIED') AS verified, count(*) FILTER (trust_state = 'UNVERIFIED') AS unverified, count(*) FILTER (trust_state = 'SUSPECT') AS suspect,
 count(*) FILTER (trust_state = 'REJECTED') AS rejected, count(*) FILTER (trust_state = 'ODD') AS unknown_state FROM maps GROUP BY team_id""")
def trust_state_counts(spark, sf_dir):
    return O.trust_counts(_identity(spark, sf_dir)["mappings"], "team_id")


@query(_IDENTITY + """, c AS (SELECT team_id, count(*) FILTER (trust_state = 'VERIFIED') AS v, count(*) FILTER (trust_state = 'SUSPECT') AS s, count(*) FILTER (trust_state = 'REJECTED') AS r, count(*) FILTER (trust_state = 'ODD') AS o FROM maps GROUP BY team_id)
SELECT t.id, concat_ws(',', CASE WHEN reference_provider IS NOT NULL THEN 'reference-identity' END, CASE WHEN v > 0 THEN 'verified-mapping' END, CASE WHEN s > 0 THEN 'suspect-mapping' END, CASE WHEN r > 0 THEN 'rejected-mapping' END, CASE WHEN o > 0 THEN 'unknown-trust-state' END) AS protection_reasons
FROM teams t LEFT JOIN c ON c.team_id = t.id WHERE NOT EXISTS (SELECT 1 FROM evs WHERE home_team_id = t.id OR away_team_id = t.id)""")
def cleanup_candidates(spark, sf_dir):
    t = _identity(spark, sf_dir)
    counts = O.trust_counts(t["mappings"], "team_id").withColumnRenamed("team_id", "id")
    used = t["events"].select(F.col("home_team_id").alias("id")).union(t["events"].select("away_team_id"))
    return O.cleanup_candidates(O.orphan_teams(t["teams"], t["events"]), counts, used).select("id", "protection_reasons")


@query(_IDENTITY + """ SELECT competition_id, start_time, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM evs GROUP BY ALL HAVING count(*) > 1""")
def duplicate_events(spark, sf_dir):
    return O.duplicate_groups(_identity(spark, sf_dir)["events"], ["competition_id", "start_time"])


@query(_IDENTITY + """, snaps AS (SELECT l_orderkey AS event_id, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT evs.*, coalesce(n, 0) AS n FROM evs LEFT JOIN snaps ON evs.id = snaps.event_id)
SELECT id, survivor_id FROM (SELECT id, first_value(id) OVER (PARTITION BY competition_id, start_time ORDER BY n DESC, id) AS survivor_id, count(*) OVER (PARTITION BY competition_id, start_time) AS g FROM r) WHERE g > 1""")
def duplicate_survivors(spark, sf_dir):
    snapshots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"))
    return O.survivors(_identity(spark, sf_dir)["events"], snapshots, ["competition_id", "start_time"])


@query(_IDENTITY + " SELECT source, source_id, count(DISTINCT team_id) AS targets FROM maps GROUP BY ALL HAVING count(DISTINCT team_id) > 1")
def reference_id_conflicts(spark, sf_dir):
    return O.reference_id_conflicts(_identity(spark, sf_dir)["mappings"], ["source", "source_id"], "team_id")


@query(_IDENTITY + """ SELECT id, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS source_names FROM (SELECT id, home_team_id AS t FROM evs UNION SELECT id, away_team_id FROM evs) s JOIN (SELECT DISTINCT team_id, source FROM maps) m ON m.team_id = t GROUP BY id HAVING count(DISTINCT source) >= 2""")
def cross_provider_events(spark, sf_dir):
    t = _identity(spark, sf_dir)
    return O.cross_provider_events(t["events"], t["mappings"])


@query(""" WITH parts AS (SELECT p_partkey AS id, p_brand AS sport, p_name AS canonical_name, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS country FROM part)
SELECT a.sport, a.canonical_name, count(DISTINCT b.id) AS others, count(DISTINCT a.id) AS countryless FROM parts a JOIN parts b ON a.sport = b.sport AND a.canonical_name = b.canonical_name AND a.id <> b.id WHERE a.country = '' GROUP BY ALL""")
def countryless_collisions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("sport"), F.col("p_name").alias("canonical_name"),
        F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_size").cast("string")).alias("country"),
    )
    return O.countryless_collisions(parts)


@query(_IDENTITY + """ SELECT evs.id, h.canonical_name || ' vs ' || a.canonical_name AS display_name FROM evs JOIN teams h ON h.id = home_team_id JOIN teams a ON a.id = away_team_id""")
def event_listing(spark, sf_dir):
    t = _identity(spark, sf_dir)
    return O.event_listing(t["events"], t["teams"]).select("id", "display_name")


@query(_TAPE + """, a AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome ORDER BY quote_time DESC, observed_at DESC, id DESC) AS q FROM tape WHERE id % 2 = 0) WHERE q = 1),
b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, bookmaker_id, market_type, market_line, outcome ORDER BY quote_time DESC, observed_at DESC, id DESC) AS q FROM tape WHERE id % 2 = 1) WHERE q = 1)
SELECT a.bookmaker_id, count(*) AS common, count(*) FILTER (a.odds <> b.odds) AS changed FROM a JOIN b ON a.event_id = b.event_id AND a.bookmaker_id = b.bookmaker_id AND a.market_type = b.market_type AND coalesce(a.market_line, '') = coalesce(b.market_line, '') AND a.outcome = b.outcome GROUP BY a.bookmaker_id""")
def update_frequency(spark, sf_dir):
    quotes = tape(spark, sf_dir).withColumn("line", F.coalesce("market_line", F.lit("")))
    key = ["event_id", "bookmaker_id", "market_type", "line", "outcome"]
    return O.update_frequency(Q.latest(quotes.filter("id % 2 = 0")), Q.latest(quotes.filter("id % 2 = 1")), key)


@query("SELECT 'events' AS counter, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def db_summary(spark, sf_dir):
    return O.table_counts({name: table(spark, sf_dir, name) for name in ("events", "orders", "customer")})


@query("""WITH b AS (SELECT o_orderstatus AS counter, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT l_linestatus AS counter, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT coalesce(b.counter, a.counter) AS counter, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.counter = b.counter WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def replay_diff(spark, sf_dir):
    """Counters before (orders by status) and after (line items by status)."""
    def counted(name, column):
        return table(spark, sf_dir, name).groupBy(F.col(column).alias("counter")).agg(F.count("*").alias("n"))

    return O.counter_diff(counted("orders", "o_orderstatus"), counted("lineitem", "l_linestatus"))


@query(""" SELECT client_id AS id, lower(trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g'))) AS comparison_key, regexp_replace(lower(coalesce(name, '')), '[^\\p{L}\\p{N}]', '', 'g') AS bookmaker_key,
 array_to_string(regexp_extract_all(coalesce(email, ''), '\\d+'), ',') AS digits FROM clients""")
def name_keys(spark, sf_dir):
    """Keys of clients' names, of which many have letters outside ASCII."""
    named = T.with_key(T.with_key(table(spark, sf_dir, "clients"), "name", "comparison_key"), "name", "bookmaker_key", "bookmaker")
    digits = F.array_join(T.digit_runs(F.coalesce("email", F.lit(""))), ",").alias("digits")
    return named.select(F.col("client_id").alias("id"), "comparison_key", "bookmaker_key", digits)


@query("""WITH feeds AS (SELECT event_id AS id, user_id % 25 AS number, user_id % 50 AS source_key FROM events)
SELECT f.id, CASE WHEN source_key < 10 THEN source_key ELSE s_suppkey END AS bookmaker_id, CASE WHEN source_key < 10 THEN 'mapping' WHEN s_suppkey IS NOT NULL THEN 'name' ELSE 'new' END AS method
FROM feeds f LEFT JOIN supplier ON s_suppkey = f.number""")
def bookmaker_resolution(spark, sf_dir):
    """Spellings that are one name once compatibility forms, case and signs are gone."""
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("strasse ", "ＳＴＲＡＳＳＥ ", "Straße-", " S.trasse (")]), (F.col("event_id") % 4 + 1).cast("int"))
    feeds = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.lit("p").alias("provider_id"), F.concat(spelled, (F.col("user_id") % 25).cast("string")).alias("name"),
        (F.col("user_id") % 50).alias("source_bookmaker_id"),
    )
    known = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("bookmaker_id"), F.concat(F.lit("Straße "), F.col("s_suppkey").cast("string")).alias("canonical_name")
    )
    mappings = spark.range(10).select(F.lit("p").alias("provider_id"), F.col("id").alias("source_bookmaker_id"), F.col("id").cast("string").alias("bookmaker_id"))
    out = I.resolve_bookmakers(feeds, known, mappings)
    return out.select("id", F.when(F.col("method") != "new", F.col("bookmaker_id").cast("long")).alias("bookmaker_id"), "method")


@query("""WITH e AS (SELECT o_orderkey AS event_id, o_custkey % 50 AS k, o_orderdate AS start_time FROM orders),
r AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, o_orderdate + to_minutes(CAST(o_orderkey % 60 AS INT)) AS at FROM orders),
hits AS (SELECT r.id, e.event_id, count(*) OVER (PARTITION BY r.id) AS n FROM r JOIN e ON e.k = r.k AND abs(epoch(e.start_time) - epoch(r.at)) <= 1800)
SELECT r.id, CASE WHEN n = 1 THEN event_id END AS event_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous-event' ELSE 'no-event-match' END AS result FROM r LEFT JOIN (SELECT id, any_value(event_id) AS event_id, any_value(n) AS n FROM hits GROUP BY id) h ON h.id = r.id""")
def event_match_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    events = orders.select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 50).alias("k"), at.alias("start_time"))
    records = orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"), (at + F.make_dt_interval(mins=(F.col("o_orderkey") % 60).cast("int"))).alias("start_time")
    )
    return I.match_by_time(records, events, ["k"], 1800).select("id", "event_id", "result")


@query(""" WITH log AS (SELECT user_id % 60 AS key, event_id AS seq, CASE event_type WHEN 'view' THEN 'UNVERIFIED' WHEN 'click' THEN 'UNVERIFIED' WHEN 'purchase' THEN 'VERIFIED' WHEN 'signup' THEN 'VERIFIED' ELSE 'SUSPECT' END AS trust_state, event_id % 23 = 0 AS by_hand FROM events),
era AS (SELECT *, sum(CASE WHEN by_hand THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS e FROM log),
live AS (SELECT *, max(CASE WHEN trust_state = 'SUSPECT' THEN 1 ELSE 0 END) OVER (PARTITION BY key, e ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM era)
SELECT key, seq, trust_state FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM live WHERE coalesce(b, 0) = 0) WHERE r = 1""")
def mapping_current(spark, sf_dir):
    """Guarded upserts: a suspect mapping is frozen until a person decides."""
    log = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 60).alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 23 == 0).alias("override"),
        F.when(F.col("event_type").isin("view", "click"), "UNVERIFIED").when(F.col("event_type").isin("purchase", "signup"), "VERIFIED").otherwise("SUSPECT").alias("trust_state"),
    )
    return O.mapping_view(log, ["key"], "seq", ("SUSPECT", "REJECTED")).select("key", "seq", "trust_state")


@query("SELECT user_id % 40 AS event_id, max_by(event_type, event_id) AS lifecycle FROM events GROUP BY 1")
def event_status(spark, sf_dir):
    """Last write by arrival wins."""
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("event_id"), F.col("event_type").alias("lifecycle"), F.col("event_id").alias("seq"))
    return O.upsert_last(log, ["event_id"], "seq").select("event_id", "lifecycle")


@query(_IDENTITY + """, lands AS (SELECT id, CASE WHEN country = '1' THEN NULL ELSE country END AS land FROM comps), tc AS (SELECT DISTINCT home_team_id AS team_id, competition_id FROM evs),
known AS (SELECT DISTINCT team_id, land FROM tc JOIN lands ON lands.id = tc.competition_id WHERE land IS NOT NULL AND land <> ''),
asked AS (SELECT DISTINCT away_team_id AS team_id, competition_id FROM evs)
SELECT asked.team_id, asked.competition_id FROM asked LEFT JOIN lands ON lands.id = asked.competition_id
WHERE coalesce(land, '') = '' OR NOT EXISTS (SELECT 1 FROM known k WHERE k.team_id = asked.team_id) OR EXISTS (SELECT 1 FROM known k WHERE k.team_id = asked.team_id AND k.land = lands.land)""")
def country_compatible_pairs(spark, sf_dir):
    t = _identity(spark, sf_dir)
    comps = t["competitions"].withColumn("country", F.when(F.col("country") != "1", F.col("country")))
    pairs = t["events"].select(F.col("home_team_id").alias("team_id"), "competition_id").distinct()
    asked = t["events"].select(F.col("away_team_id").alias("team_id"), "competition_id").distinct()
    return M.country_compatible(asked, pairs, comps)


@query(_IDENTITY + """, e AS (SELECT id, start_time, CASE WHEN id % 3 = 0 THEN 'p1' END AS start_time_provider, CASE WHEN id % 4 = 0 THEN 'ref' END AS reference_provider FROM evs),
s AS (SELECT id AS event_id, 'p' || CAST(id % 2 AS VARCHAR) AS p, start_time + INTERVAL 1 HOUR AS t, 1 AS seq FROM evs UNION ALL SELECT id, 'ref', start_time + INTERVAL 2 HOUR, 2 FROM evs WHERE id % 5 = 0),
ok AS (SELECT s.* FROM s JOIN e ON e.id = s.event_id WHERE p = 'ref' OR reference_provider = p OR (reference_provider IS NULL AND (start_time_provider IS NULL OR start_time_provider = p)))
SELECT e.id, coalesce((SELECT max_by(t, seq) FROM ok WHERE ok.event_id = e.id), start_time) AS start_time FROM e""")
def kickoff_sync(spark, sf_dir):
    """Only a provider with authority over an event moves its kickoff."""
    ev = _identity(spark, sf_dir)["events"].select("id", "start_time")
    events = ev.withColumns({"start_time_provider": F.when(F.col("id") % 3 == 0, "p1"), "reference_provider": F.when(F.col("id") % 4 == 0, "ref")})
    first = ev.select(F.col("id").alias("event_id"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("provider_id"), (F.col("start_time") + F.make_dt_interval(hours=F.lit(1))).alias("start_time"), F.lit(1).alias("seq"))
    second = ev.filter("id % 5 = 0").select(F.col("id").alias("event_id"), F.lit("ref").alias("provider_id"), (F.col("start_time") + F.make_dt_interval(hours=F.lit(2))).alias("start_time"), F.lit(2).alias("seq"))
    return M.synced_kickoffs(events, first.unionByName(second), "ref").select("id", "start_time")


@query(_IDENTITY + """, held AS (SELECT id, CASE WHEN id % 5 = 0 THEN CAST(id % 1000 AS VARCHAR) END AS ref FROM teams), claims AS (SELECT DISTINCT team_id AS id, CAST(CASE WHEN source_id % 5 = 0 THEN team_id % 1000 ELSE source_id * 1000 + team_id % 1000 END AS VARCHAR) AS ref FROM maps WHERE source = 'src1')
SELECT id, ref FROM claims WHERE (SELECT count(*) FROM claims c WHERE c.ref = claims.ref) = 1 AND NOT EXISTS (SELECT 1 FROM held WHERE held.ref = claims.ref)
 AND NOT EXISTS (SELECT 1 FROM held WHERE held.id = claims.id AND held.ref IS NOT NULL) AND EXISTS (SELECT 1 FROM held WHERE held.id = claims.id)""")
def promotable_references(spark, sf_dir):
    t = _identity(spark, sf_dir)
    held = t["teams"].select("id", F.lit("r").alias("reference_provider"), F.when(F.col("id") % 5 == 0, (F.col("id") % 1000).cast("string")).alias("reference_provider_id"))
    claimed = F.when(F.col("source_id") % 5 == 0, F.col("team_id") % 1000).otherwise(F.col("source_id") * 1000 + F.col("team_id") % 1000)
    claims = t["mappings"].filter("source = 'src1'").select(F.col("team_id").alias("id"), F.lit("r").alias("reference_provider"), claimed.cast("string").alias("reference_provider_id")).distinct()
    return M.promotable(held, claims).select("id", F.col("reference_provider_id").alias("ref"))


_AUDIT_STATUS = "CASE id % 7 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'REFERENCE' ELSE 'PROVISIONAL' END"


@query(_IDENTITY + f""", t2 AS (SELECT *, {_AUDIT_STATUS} AS st FROM teams), c2 AS (SELECT *, {_AUDIT_STATUS} AS st FROM comps),
orphan_t AS (SELECT * FROM t2 WHERE st = 'PROVISIONAL' AND NOT EXISTS (SELECT 1 FROM evs WHERE home_team_id = t2.id OR away_team_id = t2.id)),
orphan_c AS (SELECT * FROM c2 WHERE st = 'PROVISIONAL' AND NOT EXISTS (SELECT 1 FROM evs WHERE competition_id = c2.id)),
guarded AS (SELECT o.id, reference_provider IS NOT NULL OR EXISTS (SELECT 1 FROM maps WHERE team_id = o.id AND trust_state <> 'UNVERIFIED') AS p FROM orphan_t o),
f AS (SELECT 'duplicate-canonical-events' AS code, 'ERROR' AS severity, count(*) AS n FROM (SELECT 1 FROM evs GROUP BY competition_id, home_team_id, away_team_id, start_time HAVING count(*) > 1)
 UNION ALL SELECT 'orphan-provisional-teams', 'WARNING', count(*) FROM orphan_t UNION ALL SELECT 'gc-safe-provisional-teams', 'INFO', count(*) FROM guarded WHERE NOT p
 UNION ALL SELECT 'protected-orphan-teams', 'WARNING', count(*) FROM guarded WHERE p UNION ALL SELECT 'conflicting-teams', 'ERROR', count(*) FROM t2 WHERE st = 'CONFLICT'
 UNION ALL SELECT 'orphan-provisional-competitions', 'WARNING', count(*) FROM orphan_c UNION ALL SELECT 'gc-safe-provisional-competitions', 'INFO', count(*) FROM orphan_c
 UNION ALL SELECT 'conflicting-competitions', 'ERROR', count(*) FROM c2 WHERE st = 'CONFLICT'
 UNION ALL SELECT 'unresolved-team_mappings', CASE WHEN count(*) FILTER (trust_state = 'SUSPECT') > 0 THEN 'ERROR' ELSE 'WARNING' END, count(*) FROM maps WHERE trust_state IN ('UNVERIFIED', 'SUSPECT')
 UNION ALL SELECT 'rejected-team_mappings', 'WARNING', count(DISTINCT source) FROM maps WHERE trust_state = 'REJECTED'
 UNION ALL SELECT 'multiple-reference-ids-team_mappings', 'ERROR', count(*) FROM (SELECT 1 FROM maps GROUP BY source, source_id HAVING count(DISTINCT team_id) > 1))
SELECT code, severity, n FROM f WHERE n > 0""")
def identity_audit(spark, sf_dir):
    t = _identity(spark, sf_dir)
    status = F.when(F.col("id") % 7 == 0, "CONFLICT").when(F.col("id") % 7 == 1, "REFERENCE").otherwise("PROVISIONAL")
    mappings = t["mappings"].withColumnRenamed("team_id", "target_id")
    tables = {
        "events": t["events"].withColumn("sport", F.lit("s")), "teams": t["teams"].withColumn("identity_status", status),
        "competitions": t["competitions"].withColumns({"identity_status": status, "sport": F.lit("s"), "reference_provider": F.lit(None).cast("string")}),
        "team_mappings": mappings, "competition_mappings": mappings.limit(0),
    }
    return C.audit(tables).select("code", "severity", "n")


@query(_TAPE + """ SELECT event_id, max(odds) FILTER (outcome = '1') AS home, max(odds) FILTER (outcome = 'X') AS draw, max(odds) FILTER (outcome = '2') AS away, CASE WHEN count(*) = 3 THEN ROUND(sum(1.0 / CAST(odds AS DOUBLE)), 8) END AS margin
FROM best WHERE market_type = 'three_way' GROUP BY event_id""")
def console_breakdown(spark, sf_dir):
    quotes = tape(spark, sf_dir)
    out = R.console_breakdown(quotes, TAPE_FRESHNESS, _now(quotes))
    return out.select("event_id", F.col("1").alias("home"), F.col("X").alias("draw"), F.col("2").alias("away"), F.round("margin", 8).alias("margin"))


@query(_TAPE + f"""SELECT 'SUREBET' AS signal_type, {_KEY}, NULL AS outcome, ROUND((1 / margin - 1) * 100, 6) AS edge FROM surebet WHERE margin < 1
 UNION ALL SELECT 'VALUE_GAP', {_KEY}, outcome, max(ROUND((CAST(odds AS DOUBLE) - CAST(median AS DOUBLE)) / CAST(median AS DOUBLE) * 100, 6)) FROM tagged WHERE n >= 3 AND abs(odds - median) * 100 >= 15 * median AND odds > median GROUP BY ALL""")
def detection_cycle(spark, sf_dir):
    """Candidates of one cycle over all events and markets."""
    quotes = tape(spark, sf_dir)
    sweep = detect(quotes, _now(quotes), Settings(freshness=TAPE_FRESHNESS))
    return sweep.candidates.select("signal_type", *SLIM, "outcome", F.round("edge", 6).alias("edge"))


@query("""SELECT 'b' || CAST(l_suppkey AS VARCHAR) AS source, 'e' || CAST(l_orderkey AS VARCHAR) AS source_event_id, CAST(l_quantity AS DECIMAL(18,6)) AS home, CAST(CAST(l_tax AS DECIMAL(9,2)) + 3 AS DECIMAL(18,6)) AS draw
FROM lineitem""")
def h2h_feed(spark, sf_dir):
    """Payloads written as a provider would, and parsed back."""
    items = table(spark, sf_dir, "lineitem")
    draw = (F.col("l_tax").cast("decimal(9,2)") + 3).cast("string")
    payload = F.format_string(
        '[{"id":"e%d","home_team":"A","away_team":"B","commence_time":"2026-01-02T10:00:00Z","sport_title":"L","bookmakers":[{"key":"k","title":"b%d","markets":[{"key":"h2h","outcomes":['
        '{"name":"A","price":%s},{"name":"Draw","price":%s},{"name":"B","price":2.5}]}]}]}]',
        F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_quantity").cast("string"), draw,
    )
    captures = items.select(payload.alias("payload"), F.current_timestamp().alias("observed_at"))
    return feeds.h2h_feed(captures).select("source", "source_event_id", F.col("odds")["1"].alias("home"), F.col("odds")["X"].alias("draw"))


@query(_RUNS + """ SELECT source FROM (SELECT source, max(started_at) AS m FROM runs GROUP BY source), clock WHERE epoch(now) - epoch(m) >= 86400 * (1 + ascii(source) % 3) """)
def sources_due(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    plans = runs.select("source").distinct().withColumn("min_interval_seconds", (1 + F.ascii("source") % 3) * 86400)
    return O.sources_due(runs, plans, _run_clock(runs)).select("source")


@query()
def fuzzy_names(spark, sf_dir):
    """Part names with a letter dropped, resolved against the names (no SQL: similarity)."""
    pool = table(spark, sf_dir, "part").select(F.lit("s").alias("scope"), F.col("p_name").alias("canonical_name")).distinct()
    names = pool.select("scope", F.expr("substring(canonical_name, 1, length(canonical_name) - 1)").alias("name"))
    aliases = spark.createDataFrame([("nothing", "none")], "alias string, target string")
    return I.normalize_names(names, pool, aliases).select("name", "canonical_name", "confidence", "method")


@query(r"""
WITH name AS (SELECT DISTINCT lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS k FROM clients WHERE name IS NOT NULL
), sorted AS (SELECT k, array_to_string(list_sort(string_split(k, ' ')), ' ') AS t FROM name WHERE k <> ''
), text AS (SELECT DISTINCT t, length(t) AS n FROM sorted
), masked AS (
  -- a bit for each place of a letter
  SELECT a.t AS x, b.t AS y, a.n, b.n AS m, (CAST(1 AS HUGEINT) << a.n) - 1 AS whole,
    list_transform(string_split(b.t, ''), lambda c: list_sum(list_transform(range(1, a.n + 1), lambda i: CASE WHEN substr(a.t, i, 1) = c THEN CAST(1 AS HUGEINT) << (i - 1) ELSE CAST(0 AS HUGEINT) END))) AS masks
  FROM text a JOIN text b ON a.t < b.t AND 200 * least(a.n, b.n) >= 85 * (a.n + b.n)
), scored AS (
  SELECT x, y, 200.0 * (n - bit_count(list_reduce(list_prepend(whole, list_transform(masks, lambda q: CAST(q AS HUGEINT))), lambda v, q: (v + (v & q) | (v - (v & q))) & whole))) / (n + m) AS score FROM masked
), pair AS (SELECT x, y, score FROM scored WHERE score >= 85 UNION ALL SELECT t, t, 100.0 FROM text)
SELECT least(a.k, b.k) AS key, greatest(a.k, b.k) AS other, round(score, 6) AS score FROM pair JOIN sorted a ON a.t = x JOIN sorted b ON b.t = y WHERE x <> y OR a.k < b.k""")
def similar_client_names(spark, sf_dir):
    """All pairs of clients' names that are at least 85 % alike."""
    named = table(spark, sf_dir, "clients").filter("name is not null").select("name").distinct()
    keys = named.select(F.lit("s").alias("scope"), F.lit("").alias("block"), T.comparison_key_udf()("name").alias("key")).distinct()
    return Z.similar(keys, keys, 85.0).filter("key < other").select("key", "other", F.round("score", 6).alias("score"))


@query()
def resolved_fixtures(spark, sf_dir):
    """Events of the tape's users as fixtures of two sources, resolved in order (no SQL)."""
    e = table(spark, sf_dir, "events")
    records = e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.lit("football").alias("sport"), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("source"),
        F.lit("League").alias("league"), F.lit(None).cast("string").alias("country"), F.concat(F.lit("team "), (F.col("user_id") % 12).cast("string")).alias("home_team"),
        F.concat(F.lit("team "), (F.col("user_id") % 12 + 12).cast("string")).alias("away_team"), F.date_trunc("day", "ts").cast("timestamp").alias("start_time"), F.lit(None).cast("string").alias("source_event_id"),
    )
    return I.resolve_records(records)


@query(_RUNS + " SELECT source, status, count(*) AS n FROM runs GROUP BY ALL")
def provider_run_totals(spark, sf_dir):
    return O.counts_by(_runs(spark, sf_dir), "source", "status")


@query(_SIGNALS + ", c AS (SELECT market_type, max_by(status, sweep_ts) AS status FROM folded GROUP BY event_id, market_type, line) SELECT market_type, status, count(*) AS n FROM c GROUP BY ALL")
def signals_by_status(spark, sf_dir):
    return O.counts_by(S.current(_folded(spark, sf_dir), SIGNAL_KEY), "market_type", "status")


@query(_TAPE + " SELECT event_id, count(*) AS n FROM tape GROUP BY ALL ORDER BY n DESC, event_id LIMIT 10")
def busiest_events(spark, sf_dir):
    """Top ten: the limit is the report."""
    return O.most_common(tape(spark, sf_dir), "event_id")


@query(_TAPE + " SELECT (SELECT max(c_name) FILTER (c_custkey = 8) || ' vs ' || max(c_name) FILTER (c_custkey = 9) FROM customer) AS display_name, market_type, market_line, count(*) AS snapshots, count(DISTINCT bookmaker_id) AS bookmakers, min(observed_at) AS first_observed_at FROM tape WHERE event_id = 7 GROUP BY market_type, market_line")
def event_detail(spark, sf_dir):
    quotes = tape(spark, sf_dir)
    events = quotes.select(F.col("event_id").alias("id")).distinct().select("id", (F.col("id") + 1).alias("home_team_id"), (F.col("id") + 2).alias("away_team_id"))
    teams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"))
    return O.event_detail(7, events, teams, quotes).select("display_name", "market_type", "market_line", "snapshots", "bookmakers", "first_observed_at")


# ---------------------------------------------------------------- large tables


@query("""WITH b AS (SELECT l_partkey, l_returnflag, max(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(0.0001 AS DECIMAL(5,4)) + CAST(1.01 AS DECIMAL(18,6))) AS odds FROM lineitem GROUP BY ALL)
SELECT l_partkey AS event_id, ROUND(sum(1.0 / CAST(odds AS DOUBLE)), 8) AS margin FROM b GROUP BY l_partkey HAVING count(*) = 3""")
def lineitem_arbitrage(spark, sf_dir):
    """Best price and margin over line items read as a three-outcome market."""
    price = F.col("l_extendedprice").cast("decimal(14,2)") * F.lit("0.0001").cast("decimal(5,4)") + F.lit("1.01").cast("decimal(18,6)")
    outcome = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "X").otherwise("2")
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("event_id"), F.lit("three_way").alias("market_type"), outcome.alias("outcome")).agg(F.max(price).alias("odds"))
    return A.arbitrage(best, ["event_id", "market_type"]).filter("evaluated").select("event_id", F.round("margin", 8).alias("margin"))


from . import coverage  # noqa: E402, F401  more queries, registered the same way
