"""What only larger tables show: values beyond those of the small tables, and rows beyond the limits of a result."""

import datetime
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from emberlake import catalog
from emberlake.functions.text import statement
from emberlake.operators import relations

DAY = datetime.timedelta(days=1)


def events(spark, folder, rows):
    """A folder with the driver's table `events` of (event_id, days, user_id, event_type, value)."""
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + n * DAY, u, kind, v, "{}") for i, n, u, kind, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = [tuple(r[c] for c in cols) for r in catalog.QUERIES[name](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("name", ["s20_field_extraction", "s9_loki_protobuf"])
def test_ports_are_the_numbers_that_messages_give(spark, tmp_path, name):
    rows = [(1, 1, 7, "error", 655.35), (2, 2, 7, "error", 655.36), (3, 3, 8, "signup", 700.0), (4, 4, 9, "signup", 12345678.0)]
    got = same_as_sql(spark, name, events(spark, tmp_path, rows))
    assert sorted(int(r[-1]) for r in got) == [65535, 65536, 70000, 1234567800]


def test_hits_beyond_a_limit_are_cut_or_all_given_and_marked(spark):
    df = spark.range(7).selectExpr("CAST(id AS STRING) AS id", "'h' AS host", "'s' AS service", "concat('m', id) AS message", "id AS us", "id + 1 AS place")
    none = df.where("false").drop("id")
    told = lambda **how: [(r["id"], r["truncated"]) for r in relations.hybrid(df, df.where("false"), none, (0, 9), False, **how).collect()]
    assert told(limit=5) == [(str(k), True) for k in range(5)] and told(limit=7) == [(str(k), False) for k in range(7)]
    assert sorted(told(limit=None, mark_over=5)) == [(str(k), True) for k in range(7)]
    assert sorted(told(limit=None, mark_over=7)) == sorted(told(limit=None)) == [(str(k), False) for k in range(7)]


def test_facts_of_statements_are_computed_once_and_only_those_wanted(spark):
    df = spark.createDataFrame([("WITH q AS (SELECT 1) DELETE FROM a.t USING b, q WHERE t.x = b.y AND f(z.w) > 1",), ("foo (bar",), (None,)], "q string")
    some = ("kind", "read", "predicates")
    all_, few = (df.select(statement(F.col("q"), *names).alias("s")) for names in ((), some))
    assert [tuple(r["s"][k] for k in some) for r in all_.collect()] == [tuple(r["s"]) for r in few.collect()] and few.schema["s"].dataType.names == list(some)
    # The list of its own WITH names is asked for in six places, for each table once more; its pattern is looked for once.
    assert all_._jdf.queryExecution().analyzed().toString().count("recursive )|") == 1


def test_set_operations_compare_values_and_not_rows(spark, tmp_path):
    folder = events(spark, tmp_path, [(i, 1, u, "error", 1.0) for i, u in enumerate((1, 2, 3, 4, 4, 11))])
    same_as_sql(spark, "u4_set_operations", folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        plan = catalog.QUERIES["u4_set_operations"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Join Left(?:Semi|Anti)[^\n]*\n[ :+-]*Aggregate", plan)) == plan.count("Join Left") == 2


def test_low_and_slow_reads_its_input_once_for_each_kind_of_step(spark):
    from emberlake.operators import stateful

    rows = [(f"a{i % 3}", f"p{i % 7}", i // 40, i * 1_000_003) for i in range(400)]
    at = f"{spark.conf.get('spark.checkpoint.dir')}/low-and-slow"
    spark.createDataFrame(rows, "actor string, person string, session long, us long").write.mode("overwrite").parquet(at)
    out = stateful.low_and_slow(spark.read.parquet(at), "actor", "person", "session", "us", 100_000_000, 4, 3, 20_000_000, 2)
    assert at.split(":")[1].lstrip("/") not in "".join(out.inputFiles())  # what it reads is what it has written, not the input again
    # A value counts while it is in the window, however often it comes again.
    got = {(r["actor"], r["t"]): r for r in stateful.sliding(spark.read.parquet(at), "actor", "us", 100_000_000, {"subjects": "person", "sessions": "session"}, older_us=20_000_000).collect()}
    for a, _, _, t in rows:
        inside = [r for r in rows if r[0] == a and t - 100_000_000 <= r[3] <= t]
        want = (len({r[1] for r in inside}), len({r[2] for r in inside}), len(inside), sum(r[3] <= t - 20_000_000 for r in inside))
        assert tuple(got[a, t][k] for k in ("subjects", "sessions", "events", "older")) == want


def test_erasure_from_the_text_index_keeps_postings_and_their_span_of_time(spark, tmp_path):
    from emberlake.operators import search
    from emberlake.sources import versions

    rows = [(str(i), i * 3_600_000_000, f"h{i % 3}", "s", "x", "info", "t", f"w{i % 5} w{i % 5} all") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, us long, host string, service string, source string, severity string, log_type string, message string")
    at = versions.created(spark, f"file://{tmp_path}/index")
    search.index_text(df, at, block_us=86_400_000_000)
    search.erase_host(spark, at, "h1")
    (live,) = versions.live(spark, at)
    assert live["facts"] == {"docs": "40", "words": "120", "block_us": "86400000000"}
    held = versions.read(spark, at, "postings", [live["part"]], search.POSTINGS)
    assert {(r["term"], r["id"], r["tf"], r["block"]) for r in held.collect()} == {(w, r[0], n, r[1] // 86_400_000_000) for r in rows if r[2] != "h1" for w, n in ((r[7].split()[0], 2), ("all", 1))}


def test_nearest_vectors_go_in_slices_and_groups_of_probes(spark, monkeypatch):
    monkeypatch.setattr(relations, "TASK_VECTORS", 20)
    monkeypatch.setattr(relations, "TASK_PROBES", 3)
    vec = {i: [float((i * k) % 17 + 1) for k in (3, 5, 7)] for i in range(200)}
    df = spark.createDataFrame(list(vec.items()), "vec_id long, embedding array<double>")
    out = relations.nearest(df, df.where("vec_id % 20 = 0"), 4)
    got = {(r["probe"], r["place"]): r["cosine"] for r in out.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for p in range(0, 200, 20):
        best = sorted((dot(vec[p], v) / (dot(vec[p], vec[p]) * dot(v, v)) ** 0.5 for i, v in vec.items() if i != p), reverse=True)[:4]
        assert [got[p, k + 1] for k in range(4)] == pytest.approx(best)


def test_nearest_vectors_equal_sql_on_copies_and_odd_vectors_without_a_row_for_a_pair(spark, monkeypatch, tmp_path):
    for name, n in (("TASK_VECTORS", 40), ("TASK_PROBES", 2)):
        monkeypatch.setattr(relations, name, n)
    vec = {i: [float((i * k) % 13 - 6) * (1 + i % 3) for k in (3, 5, 7)] for i in range(600)}
    vec |= {600: None, 601: [0.0, 0.0, 0.0], 602: [1e-30, 0.0, 0.0], 700: [0.0, 0.0, 0.0], 800: None, 900: vec[100]}
    spark.createDataFrame(list(vec.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalog.QUERIES["d24_nearest_vectors"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    shown = lambda rows: sorted((*r[:3], str(r[3])) for r in rows)
    assert shown(tuple(r) for r in out.collect()) == shown(con.execute(catalog.NEAREST_SQL).fetchall())
