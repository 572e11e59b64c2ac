"""Queries and operators on odd rows, and on what made them slow: crowds, repeated parsing."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quotemill.operators import operations as O
from quotemill.plans.queries import ORACLE_SQL, QUERIES


def test_drifted_mappings_equal_sql_on_odd_names(spark, tmp_path):
    """Spaces within a name, words that look like marks, names that repeat an id."""
    names = ["Maanma  Koezkoor", "Mael  Renströmströmma", "Elrnii Tanlohamgu", "Ana ii B", "a", "", "Team 12", "Jo W", None, " Åsa  B ", "Elrida  Gugumani", "b b"]
    rows = [(i * 12 + k, n) for i, n in enumerate(names) for k in range(12)] + [(4, "Elrnii Tanlohamgu"), (4, "Elrnii Tanlohamgu")]
    spark.createDataFrame(rows, "client_id long, name string").coalesce(1).write.parquet(f"{tmp_path}/clients.parquet")
    c = duckdb.connect()
    c.execute(f"create view clients as select * from '{tmp_path}/clients.parquet/*.parquet'")
    want = sorted(c.execute(ORACLE_SQL["drifted_mappings"]).fetchall())
    assert sorted(map(tuple, QUERIES["drifted_mappings"](spark, str(tmp_path)).collect())) == want and want


def test_countryless_collisions_of_a_crowd(spark):
    """Two thousand of a name are counted without pairs of them; an id that comes twice is one, and no other of its own."""
    rows = [(i, "s", "crowd", "" if i % 2 else "x") for i in range(2000)] + [(1, "s", "one", ""), (2, "s", "one", "x"), (3, "s", "one", "y"), (4, "s", "twice", ""), (4, "s", "twice", "x")]
    rows += [(5, "s", "none", "x"), (6, "s", "none", "y"), (7, None, "null", ""), (8, None, "null", ""), (None, "s", "id", ""), (9, "s", "id", None), (10, "s", "both", None), (11, "s", "both", "")]
    found = O.countryless_collisions(spark.createDataFrame(rows, "id long, sport string, canonical_name string, country string"))
    assert {tuple(r) for r in found.collect()} == {("s", "crowd", 2000, 1000), ("s", "one", 2, 1), ("s", "both", 2, 2)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
