"""The operators that SQL can express, against DuckDB."""

import random
import re
from urllib.parse import urljoin

import duckdb
import pandas as pd
import pytest
import test_llm_small

from quotemill.llm import urls
from quotemill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "sales", "sale_lines", "clients"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = duck.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.select(*rel.columns).collect()) == plain(rel.fetchall())


def same_as_sql(spark, rows):
    duck = duckdb.connect()
    duck.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    rel = duck.sql(ORACLE_SQL["op1_url_filter"])
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert plain(out.select(*rel.columns).collect()) == plain(rel.fetchall())
    return out.collect()


def test_url_sql_on_linked_pages(spark):
    same_as_sql(spark, test_llm_small.PAGES)


@pytest.mark.parametrize("seed", range(4))
def test_random_link_graphs(spark, seed):
    """Against SQL and against a union-find over links that the standard library resolves."""
    rng = random.Random(seed)
    hosts = ["a.com", "example.com", "q.example.com", "example.net", "x.example.net", "b.net", "c.org", "z.de"]
    address = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(10)}"
    rows = []
    for i in range(300):
        link = rng.choice([address(), f"/en/{rng.randrange(10)}", f"{rng.randrange(10)}", f"?p={rng.randrange(3)}", "#top", "mailto:x@y.z", "//" + address()[7:], ""])
        tag = rng.choice([f'<LINK rel="canonical" href="{link}">', f"<link href='{link}' rel=canonical>", f'<meta http-equiv="refresh" content="0;URL={link}">', f'<a href="{link}">', None])
        rows.append((i, address() + rng.choice(["", "", "?q=1", "#f"]), tag and f"<html><head>{tag}</head>"))
    out = {r.page_id: r for r in same_as_sql(spark, rows)}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    node = lambda u: u.split("#")[0]
    for _, url, html in rows:
        m = re.search(r"(?:href=|URL=)[\"']?([^\"'> ]+)", html or "", re.I)
        if m and "<a " not in html and not m[1].startswith(("#", "mailto:")):
            # the standard library drops the name of a page before a bare query, too
            parent[find(node(urljoin(url.split("?")[0].split("#")[0], m[1])))] = find(node(url))

    def judged(u):
        host, path = re.match(r"[a-z]+://([^/?#]*)([^?#]*)", u).groups()
        fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.text)).verdict if fit else None

    of = {}
    for x in list(parent):
        of.setdefault(find(x), []).append(judged(x))
    carried = 0
    for i, url, _ in rows:
        own, near = judged(url), of.get(find(node(url)), [])
        want = own or ("allow" if "allow" in near else "block" if "block" in near else "allow")
        carried += own is None and "block" in near
        assert out[i].verdict == want
    assert carried > 3


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
