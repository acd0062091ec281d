"""Every query of the catalog against its SQL, and that the parts hold without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from emberlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL doesn't express, each with a test of its own below.
NO_SQL = {"d24_vector_index"}


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(v, 6) if isinstance(v, float) else v


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(([plain(r[c]) for c in cols] for r in rows), key=repr) == sorted(([plain(v) for v in r] for r in want.fetchall()), key=repr)


def test_throttle_equals_a_fold_in_order(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rows = con.execute("SELECT event_id, CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sudo' WHEN 'purchase' THEN 'postgres' ELSE 'web' END, epoch_us(ts) FROM events ORDER BY ts, event_id").fetchall()
    now, day, last, want = catalog.NOW_US, catalog.DAY_US, {}, set()
    for i, rule, us in rows:
        if rule == "web" and now - 20 * day <= us < now - 15 * day:
            continue
        if i % 50 == 0:
            want.add(i)
        elif us // 10**6 - last.get(rule, -(10**18)) >= 6 * 3600:
            last[rule] = us // 10**6
            want.add(i)
    assert {r["event_id"] for r in catalog.QUERIES["st15_throttle"](spark, SF).collect()} == want


def test_pivot_equals_breadth_first_search_of_all_edges(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    near = {}
    for a, b in con.execute(f"SELECT a, b FROM ({catalog.ORACLES['d25_entity_graph']}) WHERE a IS NOT NULL AND b IS NOT NULL").fetchall():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {"user:u1": (0, None)}
    for hops in (1, 2, 3):
        front = [n for n, (k, _) in want.items() if k == hops - 1]
        for n in {m for x in front for m in near.get(x, ())} - set(want):
            want[n] = (hops, min(x for x in front if n in near[x]))
    assert {r["node"]: (r["hops"], r["via"]) for r in catalog.QUERIES["d26_pivot"](spark, SF).collect()} == want and len(want) > 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["subject", "n", "hosts", "last_us"]


def test_the_rest_imports_without_the_corpus_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = "import sys\nclass No:\n    def find_spec(self, n, *a):\n        if n.startswith(('emberlake.llm', 'corpus_pipeline')): raise ImportError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
