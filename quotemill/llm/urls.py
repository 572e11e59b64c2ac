"""URL filter with redirect equivalence.

Rules name a host (and all its subdomains) and the start of a path; the longest rule
that fits decides. Pages that redirect or declare a canonical link to each other are
aliases of one resource: the edges' connected components carry a block to every
alias without a rule of its own, unless a member of the component is explicitly
allowed, which takes precedence. What nothing decides is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits
no rule and has no aliases; a link that can't be resolved gives no edge; repeated
rows are each judged; empty tables give empty tables; ties between rules of one length
go to the allowing one; of several canonical links or refreshes in a page the first counts; very
long pages are searched whole, once for each kind of link that they mention; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import read
from .components import components

#: Rules up to this number are compared as literals, more of them by a join.
LITERAL_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What aliases are told apart by: the URL without its fragment, scheme and host in
    lower case; null without ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), rest))


def judge(df: DataFrame, rules: tuple[Rule, ...] | list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``rule`` (its text) and ``decided`` (its verdict), null where none fits."""
    if not rules:
        return df.withColumn("rule", F.lit(None).cast("string")).withColumn("decided", F.lit(None).cast("string"))
    if len(rules) > LITERAL_RULES:
        return _judge_by_join(df, rules, host, path)
    table = F.array(
        *[
            F.struct(
                F.lit(len(r.text)).alias("n"), F.lit(r.verdict == "allow").alias("a"), F.lit(r.text).alias("text"),
                F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("h"), F.lit(r.path).alias("p"),
            )
            for r in rules
        ]
    )
    fits = F.array_max(
        F.filter(
            table,
            lambda r: ((F.col(host) == r["h"]) | F.endswith(F.col(host), F.concat(F.lit("."), r["h"])))
            & F.startswith(F.col(path), r["p"]),
        )
    )
    return df.withColumn("_f", fits).withColumns({"rule": F.col("_f.text"), "decided": F.col("_f.verdict")}).drop("_f")


def _judge_by_join(df: DataFrame, rules, host: str, path: str) -> DataFrame:
    """Equi-join of every host suffix and every path start of a length that rules have."""
    table = df.sparkSession.createDataFrame(
        [(r.host, r.path, len(r.text), r.verdict == "allow", r.text, r.verdict) for r in rules],
        "_h string, _p string, n int, a boolean, text string, verdict string",
    )
    keys = df.select(F.col(host).alias("_jh"), F.col(path).alias("_jp")).distinct()
    labels = F.split("_jh", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    lengths = F.array(*[F.lit(n) for n in sorted({len(r.path) for r in rules})])
    starts = F.transform(F.filter(lengths, lambda n: n <= F.char_length("_jp")), lambda n: F.substring(F.col("_jp"), F.lit(1), n))
    tried = keys.select("_jh", "_jp", F.explode(suffixes).alias("_h"), starts.alias("s")).select(
        "_jh", "_jp", "_h", F.explode("s").alias("_p")
    )
    best = tried.join(table, ["_h", "_p"]).groupBy("_jh", "_jp").agg(F.max(F.struct("n", "a", "text", "verdict")).alias("f"))
    best = best.select("_jh", "_jp", F.col("f.text").alias("rule"), F.col("f.verdict").alias("decided"))
    return df.join(best, (F.col(host) == F.col("_jh")) & (F.col(path) == F.col("_jp")), "left").drop("_jh", "_jp")


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL from a link on the page ``base``; null if there is none."""
    link = F.trim(link)
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.isNull() | (link == "") | ~base.contains("://"), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("#")), F.lit(None))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), link))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): page to its canonical link, and to the target of a refresh redirect."""
    html = F.col("html")
    # the patterns run only over pages that mention what they look for
    canonical, refresh = (F.when(html.rlike(f"(?i){word}"), html).otherwise(F.lit("")) for word in ("canonical", "http-equiv"))
    tag = F.regexp_extract(canonical, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*>""", 0)
    meta = F.regexp_extract(refresh, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>""", 0)
    href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    goal = F.regexp_extract(meta, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    found = pages.filter(F.col("url").contains("://") & html.rlike("(?i)canonical|http-equiv"))
    links = found.select("url", F.explode(F.array(href, goal)).alias("link")).filter("link <> ''")
    target = resolve(F.col("url"), F.regexp_replace("link", "&amp;", "&"))
    return links.select(node_of(F.col("url")).alias("u"), node_of(target).alias("v")).filter("u <> v")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, host, path, rule, verdict, component.

    ``redirects`` (source, target) adds observed redirects to the links of the pages.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")))
    roots = components(edges)
    # every page or link target of a component of two or more, judged by its own rule
    members = roots.union(roots.select(F.col("root").alias("u"), "root").distinct())
    members = members.withColumns({"_host": host_of(F.col("u")), "_path": path_of(F.col("u"))})
    carried = (
        judge(members, rules, "_host", "_path")
        .groupBy("root").agg(F.max(F.col("decided") == "allow").alias("allow"), F.max(F.col("decided") == "block").alias("block"))
        .select(
            F.col("root").alias("_root"),
            F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block")).alias("_carried"),
        )
    )
    aliases = members.select(F.col("u").alias("_node"), F.col("root").alias("_root")).join(carried, "_root")
    own = judge(
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("_n")), rules
    )
    joined = own.join(aliases, F.col("_n") == F.col("_node"), "left")
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", "_carried", F.lit("allow")).alias("verdict"),
        F.col("_root").alias("component"),
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL by the fixed rules and the links of the pages."""
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
