"""Driver-side utilities around the plans: fetching with retries, landing files, schedules,
tokens, and versioned snapshots of tables.

The network part runs on the driver and only writes landing files; everything after
that is a plan over files.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html import unescape
from urllib.parse import urlencode, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses worth another try.
RETRY_STATUSES = frozenset({429, 500, 502, 503, 504})


def redact(url: str) -> str:
    """What of ``url`` may be logged: scheme, host, port and path. Credentials travel in the
    rest, under any name."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        return f"{parts.scheme}://{host}{f':{parts.port}' if parts.port else ''}{parts.path}" if parts.scheme else parts.path
    except ValueError:
        return "(an address that can't be read)"


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds that a Retry-After header asks for, given in seconds or as a date."""
    text = (value or "").strip()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return float(text)
    try:
        then = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    then = then if then.tzinfo else then.replace(tzinfo=UTC)
    return max(0.0, (then - (now or datetime.now(UTC))).total_seconds())


def fetch(
    url: str, headers: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep, attempts: int = 3, base: float = 1.0,
    most: float = 60.0, timeout: float = 30.0,
) -> bytes:
    """The body of ``url``; retryable statuses and connection errors are tried again, with
    growing pauses or as long as the server asks for, up to a bound. Messages name no secret."""
    if attempts < 1:
        raise ValueError("attempts must be positive")
    for left in reversed(range(attempts)):
        wanted = None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            why, final = f"HTTP {e.code}", e.code not in RETRY_STATUSES
            wanted = retry_after((e.headers or {}).get("Retry-After"))
        except urllib.error.URLError as e:
            why, final = type(e.reason).__name__ if isinstance(e.reason, Exception) else "no connection", False
        if final or not left:
            raise RuntimeError(f"{redact(url)}: {why}") from None
        sleep(min(most, base * 2 ** (attempts - 1 - left) if wanted is None else wanted))
    raise AssertionError


def fetch_pages(page: Callable[[int], dict], most: int = 50) -> tuple[list[dict], bool]:
    """All pages that the first one announces: (pages, whether they are complete)."""
    first = page(1)
    total = int(((first.get("paging") or {}).get("total")) or 1)
    pages = [first, *(page(n) for n in range(2, min(total, most) + 1))]
    return pages, total <= most


def pages_until_empty(page: Callable[[int], list], most: int = 200) -> tuple[list[list], bool]:
    """Pages from 0 on up to the first empty one: (pages, whether the end was reached). No
    page at all is an error: an answer without anything is no listing."""
    pages = []
    for n in range(most):
        rows = page(n)
        if not rows:
            if not pages:
                raise ValueError("the listing has no page")
            return pages, True
        pages.append(rows)
    return pages, False


def address(base: str, path: str, **query: object) -> str:
    """``base`` and ``path`` with the query's fields that have a value."""
    given = {k: v for k, v in query.items() if v is not None}
    return f"{base.rstrip('/')}/{path.strip('/')}" + (f"?{urlencode(given)}" if given else "")


def land(spark: SparkSession, folder: str, name: str, payloads: list[str], observed_at: datetime) -> DataFrame:
    """Captures (payload, observed_at) written as one drop, a row a page, and read back: what
    is parsed is what is kept. A drop has its name once: the same one again replaces it."""
    rows = spark.createDataFrame([(p, observed_at) for p in payloads], "payload string, observed_at timestamp")
    rows.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
    return spark.read.schema(rows.schema).json(f"{folder.rstrip('/')}/{name}")


def token_of(html: str, script_id: str, field: str) -> str:
    """``state_token`` of one page, on the driver; no token is an error."""
    tag = re.search(rf"""<script[^>]*\bid=["']{re.escape(script_id)}["'][^>]*>(.*?)</script>""", html, re.S)
    body = unescape(tag[1]).replace("&q;", '"').replace("&a;", "&") if tag else ""
    found = re.search(rf'"{re.escape(field)}"\s*:\s*"([^"]+)"', body)
    if not found:
        raise ValueError(f"no {field} in the page's state")
    return found[1]


def collect_single(get: Callable[[str], bytes], url: str) -> list[str]:
    """One response as one payload."""
    return [get(url).decode("utf-8")]


def collect_paged(get: Callable[[str], bytes], url_of: Callable[[int], str], most: int = 50) -> tuple[list[str], bool]:
    """All pages that the first one announces, and whether they are complete."""
    pages, whole = fetch_pages(lambda n: json.loads(get(url_of(n))), most)
    return [json.dumps(p, ensure_ascii=False) for p in pages], whole


def collect_with_token(
    get: Callable[..., bytes], page_url: str, url_of: Callable[[int], str], script_id: str, field: str, rows_of: Callable[[dict], list], most: int = 200
) -> tuple[list[str], bool]:
    """A token out of a web page, then all pages until an empty one."""
    token, kept = token_of(get(page_url).decode("utf-8"), script_id, field), []

    def page(n: int) -> list:
        body = get(url_of(n), {"Authorization": f"Bearer {token}"}).decode("utf-8")
        rows = rows_of(json.loads(body))
        if rows:
            kept.append(body)
        return rows

    _, whole = pages_until_empty(page, most)
    return kept, whole


def state_token(html: Column, script_id: str, field: str) -> Column:
    """A token field of the JSON in the page's state script; null if there is none."""
    body = F.regexp_extract(html, rf"""(?s)<script[^>]*\bid=["']{script_id}["'][^>]*>(.*?)</script>""", 1)
    for code, char in (("&q;", '"'), ("&quot;", '"'), ("&a;", "&"), ("&amp;", "&"), ("&#34;", '"')):
        body = F.replace(body, F.lit(code), F.lit(char))
    return F.nullif(F.regexp_extract(body, rf'"{field}"\s*:\s*"([^"]+)"', 1), F.lit(""))


def poll_interval(hour: int, default: int, burst: int, start: int | None, end: int | None) -> int:
    """Seconds to the next poll: shorter in the burst hours [start, end), which may pass midnight."""
    if start is None or end is None or start == end:
        return default
    inside = start <= hour < end if start < end else hour >= start or hour < end
    return burst if inside else default


# ------------------------------------------------------------- snapshots


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: str) -> DataFrame:
    """Tables under ``folder/version``, and last their manifest: names, rows and a digest of
    all rows. A version without a manifest was not finished."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    lines = None
    for name in tables:
        one = digest(spark.read.parquet(f"{folder}/{version}/{name}")).select(F.lit(name).alias("table_name"), "rows", "digest")
        lines = one if lines is None else lines.unionByName(one)
    lines.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{version}/_manifest")
    return read_manifest(spark, folder, version)


#: Hex digits of the nodes of a digest tree, root first: each but the lowest has 256 children at most.
LEVELS = (0, 2, 4, 6)


def _row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON, nulls and names of columns included, times in UTC."""
    how = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), how), 256)


def tree(df: DataFrame) -> DataFrame:
    """The digest tree of a table: (level, prefix, rows, digest). Equal rows are counted first; a node is the rows whose
    digest begins with its prefix, and its digest that of its children in order. The root, which always
    exists, stands for the whole table whatever the order of its rows."""
    counted = df.select(_row_digest(df).alias("d")).groupBy("d").agg(F.count("*").alias("rows"))
    nodes, out = counted.select(F.col("d").alias("prefix"), "rows", F.concat_ws(":", "d", "rows").alias("digest")), None
    for level in reversed(LEVELS):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"]), ",")
        grouped = nodes.groupBy(F.substring("prefix", 1, level).alias("p")) if level else nodes.groupBy(F.lit("").alias("p"))
        nodes = grouped.agg(F.sum("rows").alias("rows"), F.sha2(children, 256).alias("digest")).select(F.col("p").alias("prefix"), "rows", "digest")
        if not level:  # of nothing as well
            nodes = nodes.groupBy().agg(F.lit("").alias("prefix"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))
        one = nodes.select(F.lit(level).alias("level"), "prefix", "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def digest(df: DataFrame) -> DataFrame:
    """One row: number of rows and the root of the digest tree."""
    return tree(df).filter("level = 0").select("rows", "digest")


def unequal_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(prefix): leaves in which two trees differ, found from the root down: only children of unequal nodes are compared."""
    found = None
    for level in LEVELS:
        a, b = (t.filter(F.col("level") == level) for t in (old, new))
        both = a.select("prefix", F.col("digest").alias("x")).join(b.select("prefix", F.col("digest").alias("y")), "prefix", "full")
        if found is not None:
            both = both.withColumn("above", F.substring("prefix", 1, level - 2)).join(found.withColumnRenamed("prefix", "above"), "above", "left_semi")
        found = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("prefix")
    return found


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that ``new`` has more often than ``old`` (``copies`` > 0) or less often (< 0), with all their columns. Rows of
    leaves that agree are never compared."""
    leaves = unequal_leaves(tree(old), tree(new))
    side = lambda df, n: df.withColumn("_d", _row_digest(df)).withColumn("_p", F.substring("_d", 1, LEVELS[-1])).withColumn("_n", F.lit(n))
    rows = side(old, -1).unionByName(side(new, 1)).join(leaves, F.col("_p") == F.col("prefix"), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    changed = rows.groupBy("_d").agg(F.sum("_n").alias("copies"), F.first(whole).alias("r")).filter("copies <> 0")
    return changed.select("r.*", "copies")


def read_manifest(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{version}/_manifest")


def verify_snapshot(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Tables whose rows or digest differ from the manifest: empty if all is well."""
    manifest = read_manifest(spark, folder, version)
    bad = None
    for r in manifest.collect():  # one row a table
        now = digest(spark.read.parquet(f"{folder}/{version}/{r.table_name}")).withColumn("table_name", F.lit(r.table_name))
        off = now.filter((F.col("rows") != r.rows) | (F.col("digest") != r.digest)).select("table_name")
        bad = off if bad is None else bad.unionByName(off)
    return bad
