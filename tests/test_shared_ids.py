"""Tables with over a thousand suppliers, in which editions of several works have one id."""

import random

import duckdb
import pandas as pd
import pytest

from tidemark.plans import library_queries  # noqa: F401
from tidemark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng, out = random.Random(3), tmp_path_factory.mktemp("tables")
    name = lambda: f"{rng.choice(['red', 'old', 'hot'])} {rng.choice(['bolt', 'ring'])}"
    part = [(k, name(), f"Brand#{rng.randrange(1, 26)}", rng.choice(["SMALL", "LARGE", "ECONOMY"]), rng.randrange(1, 51)) for k in range(80)]
    line = [(rng.randrange(300), k, 1000 * m + s, float(rng.randrange(1, 50))) for k in range(80) for s in (3, 5, 8, 10, 11) for m in range(3) if rng.random() < 0.6]
    orders = [(k, rng.randrange(2000), "F" if rng.random() < 0.05 else rng.choice("OP")) for k in range(300)]
    pd.DataFrame(part, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).to_parquet(out / "part.parquet")
    pd.DataFrame(line, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]).to_parquet(out / "lineitem.parquet")
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderstatus"]).to_parquet(out / "orders.parquet")
    duckdb.connect().sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/events.parquet') TO '{out}/events.parquet'")
    return str(out)


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["f6_usable_editions", "w9_addition_editions", "p22_state_keys", "u2_distinct_editions", "p12_contributors", "j10_remembered", "j3_j5_library_tiers", "j6_match_counts"])
def test_an_id_alone_is_no_edition(spark, tables, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got, want = QUERIES[name](spark, tables), con.sql(ORACLES[name])
    key = lambda r: tuple(map(repr, r))
    both = [sorted((tuple(map(plain, r)) for r in x), key=key) for x in (got.select(*want.columns).collect(), want.fetchall())]
    assert both[0] == both[1]
