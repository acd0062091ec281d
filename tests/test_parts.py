"""Parsers, the guard, the event table, graphs and streams on small rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberlake.functions.text import in_hours, is_private, template
from emberlake.operators import behaviour, decisions, lifecycle, relations, stateful
from emberlake.plans import guard
from emberlake.sources import events, parsers
from emberlake.streaming import state


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "line string")


def test_native_and_loki(spark):
    rows = parsers.native(lines(spark, {"event_ts": "2024-01-02T03:04:05Z", "message": "m", "fields": {"b": "2", "a": "1"}}, "{broken", {"host": "h"})).collect()
    assert [(r["event_ts"], r["host"], r["severity"], r["fields"]) for r in rows] == [(dt.datetime(2024, 1, 2, 3, 4, 5), "unknown", "info", '{"a":"1","b":"2"}')]
    push = {"streams": [{"stream": {"host": "h", "service": "sshd"}, "values": [["1704164645000000000", "Failed password for bob from 1.2.3.4 port 22"], ["1704164646500000000", "x"]]}]}
    rows = sorted(parsers.loki(lines(spark, push)).collect(), key=lambda r: r["event_ts"])
    assert rows[1]["event_ts"] == dt.datetime(2024, 1, 2, 3, 4, 6, 500000) and json.loads(rows[0]["fields"]) == {"src_ip": "1.2.3.4", "user": "bob", "port": "22"}


def test_ocsf_and_otel(spark):
    a = {"class_uid": 1, "time": 1704164645000, "severity_id": 4, "message": "m", "device": {"hostname": "d"}, "actor": {"user": {"name": "u"}}}
    b = {"class_uid": 1, "time": "2024-01-02T03:04:05Z", "severity": "Low", "activity_name": "x"}
    rows = parsers.ocsf(lines(spark, a, b, {"no": 1})).collect()
    assert [(r["event_ts"].year, r["host"], r["severity"], r["message"]) for r in rows] == [(2024, "d", "high", "m"), (2024, "unknown", "low", "x")]
    o = {"timeUnixNano": "1704164645000000000", "severityText": "WARN", "body": {"stringValue": "b"}, "attributes": [{"key": "host.name", "value": {"stringValue": "h"}}]}
    r = parsers.otel(lines(spark, o)).collect()[0]
    assert (r["event_ts"], r["host"], r["severity"], r["message"]) == (dt.datetime(2024, 1, 2, 3, 4, 5), "h", "warn", "b")


def test_pgaudit(spark):
    one = {"timestamp": "2024-01-02 03:04:05.678 UTC", "user": "ann", "remote_host": "[local]", "error_severity": "LOG", "message": 'AUDIT: SESSION,1,1,READ,SELECT,TABLE,public.t,"select a, b from t",<none>'}
    two = {"timestamp": "2024-01-02 03:04:05 UTC", "user": "bob", "remote_host": "10.0.0.9:5432", "error_severity": "ERROR", "state_code": "42501", "message": "permission denied"}
    rows = [(r["source"], r["log_type"], r["severity"], json.loads(r["fields"])) for r in parsers.pgaudit(lines(spark, one, two)).collect()]
    assert rows[0][:3] == ("pgaudit", "audit", "info") and rows[0][3]["statement"] == "select a, b from t" and "src_ip" not in rows[0][3]
    assert rows[1][:3] == ("postgres", "audit", "error") and rows[1][3]["outcome"] == "denied" and rows[1][3]["src_ip"] == "10.0.0.9"


def test_iocs(spark):
    assert sorted(r["indicator"] for r in parsers.iocs(lines(spark, "# c", "1.2.3.4:80 x", "Bad.Example.org ; y", "", "1.2.3.4"), "f").collect()) == ["1.2.3.4", "bad.example.org"]


def test_templates_and_addresses(spark):
    df = spark.createDataFrame([("id 123e4567-e89b-12d3-a456-426614174000 at 10.0.0.1  took 12.5 0xFF deadbeef1 word",)], "m string")
    assert df.select(template(F.col("m"))).first()[0] == "id <UUID> at <IP> took <N> <HEX> <HEX> word"
    ips = {"10.1.2.3": True, "172.31.0.1": True, "172.32.0.1": False, "8.8.8.8": False, "127.0.0.1": True, "::1": True, "fd00::1": True, "2001:db8::1": False, "x": False}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in ips], "ip string").select("ip", is_private(F.col("ip"))).collect()} == ips
    hours = spark.range(24).select("id", in_hours(F.col("id"), 22, 6).alias("x")).where("x")
    assert sorted(r["id"] for r in hours.collect()) == [0, 1, 2, 3, 4, 5, 22, 23]


def test_guard(spark):
    make = lambda s: s.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    total = "SELECT sum(n) AS s FROM events WHERE n IN (SELECT n FROM events)"
    assert guard.scoped(spark, total, make, ["a"]).first()["s"] == 1 and guard.scoped(spark, total, make, []).first()["s"] is None
    assert guard.scoped(spark, "SELECT n FROM events UNION ALL SELECT n + 1 FROM events", make, ["a"]).count() == 2
    for bad in ("SELECT n FROM events UNION ALL SELECT n FROM secret", "DROP TABLE events", "INSERT INTO events VALUES (1)", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/root`", "SELECT (SELECT max(x) FROM other) FROM events", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "CREATE TABLE x AS SELECT 1", "not sql"):
        with pytest.raises(guard.Refused):
            guard.scoped(spark, bad, make, ["a"])


def test_event_table(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2), "h", None, "s", None, "info", "app", "m", None)], "event_ts timestamp_ntz, host string, service string, source string, environment string, severity string, log_type string, message string, fields string")
    events.append(events.stamped(rows, "col"), str(tmp_path / "t"))
    events.append(events.stamped(rows), str(tmp_path / "t"))
    got = events.scan(spark, str(tmp_path / "t")).collect()
    assert len({r["event_id"] for r in got}) == 1 and {r["source_trust"] for r in got} == {"authenticated", "unverified"}


def test_pivot(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    got = {r["node"]: (r["hops"], r["via"]) for r in relations.pivot(links, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (2, "b")}


def test_sliding_distinct_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(6), rng.randrange(200)) for _ in range(150)]
    got = {r["a"]: (r["most"], r["first_us"]) for r in behaviour.sliding_distinct(spark.createDataFrame(rows, "a int, v int, t long"), "a", "v", "t", 20, 3).collect()}
    want = {}
    for a in range(3):
        seen = {t: len({v for b, v, u in rows if b == a and t - 20 <= u <= t}) for b, _, t in rows if b == a}
        hit = [t for t, n in seen.items() if n >= 3]
        if hit:
            want[a] = (max(seen.values()), min(hit))
    assert got == want


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=k), f"e{k % 30}", "a", k, k) for k in range(40)] + [(base + dt.timedelta(days=1), "last", "b", 0, 99)]
    schema = "event_ts timestamp, event_id string, k string, n long, us long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def result(df, mode="append"):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{len(list(tmp_path.iterdir()))}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("out").collect()

    read = lambda: state.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    assert len(result(state.deduplicated(read()))) == 31
    assert [(r["k"], r["n"]) for r in result(state.windowed_bursts(read(), "k", 5))] == [("a", 40)]
    assert [tuple(r) for r in result(state.enumeration(read(), "k", "n", "us"))] == [("a", 11, 12)]


def test_native_checks_name_what_is_wrong(spark):
    rows = lines(spark, {"message": "m"}, {"message": "m", "other": 1}, "[1]", {"host": "h"}, {"message": "x" * (parsers.MAX_MESSAGE + 1)}, {"message": "m", "fields": {"k": "v" * (parsers.MAX_FIELD + 1)}})
    assert [r["why"] for r in parsers.native_checked(rows).collect()] == [None, "unknown key", "not an object", "no message", "long message", "long field"]


def test_csv_log_and_health(spark, tmp_path):
    row = ["2024-01-02 03:04:05.678 UTC", "ann", "db", "1", "10.0.0.9:5432", "s", "1", "SELECT", "", "", "7", "LOG", "00000", 'statement: SELECT "x",\n1 FROM t', "", "", "", "", "", "", "", "", "psql", "client"]
    (tmp_path / "log.csv").write_text(",".join('"' + c.replace('"', '""') + '"' for c in row) + "\n" + '"2024-01-02","short"\n')
    records = parsers.pg_csvlog(spark, str(tmp_path / "log.csv"))
    got = parsers.pg_events(records).collect()
    assert [(r["event_ts"], r["log_type"]) for r in got] == [(dt.datetime(2024, 1, 2, 3, 4, 5, 678000), "audit")]
    assert json.loads(got[0]["fields"])["statement"] == 'SELECT "x",\n1 FROM t' and json.loads(got[0]["fields"])["src_ip"] == "10.0.0.9"
    assert parsers.pg_health(records).first().asDict() == {"parsed": 1, "rejected": 1, "partial": 0, "truncated_statement": 0, "invalid_timestamp": 0, "missing_principal": 0, "missing_database": 0}


def test_json_fields(spark):
    one = {"task": {"name": "sh"}, "parent_task": {"user": "root"}, "user": "?", "info": {"src": {"ip": "x"}, "nested": [{"remote": {"addr": "1.2.3.4"}}]}, "cmdline": "a" * 600, "watched": True, "pid": 7}
    got = [r[0] for r in lines(spark, one, "{broken", "[]").select(parsers.json_fields(F.col("line"))).collect()]
    assert got == [{"process": "sh", "src_ip": "1.2.3.4", "cmdline": "a" * 512, "watched": "true", "pid": "7"}, {}, {}]


def test_schema_check(spark):
    assert parsers.checked(spark.sql("SELECT 'h' AS b, 1 AS a"), "a int, b string").columns == ["a", "b"]
    with pytest.raises(ValueError, match="a is bigint, not int; c lacks; x isn't known"):
        parsers.checked(spark.sql("SELECT 1L AS a, 'h' AS b, 2 AS x"), "a int, b string, c int")


def test_merged_ranges(spark):
    rows = [("10.0.0.8/29", "a"), ("10.0.0.16/28", "b"), ("10.0.0.0/30", "c"), ("10.0.1.0/24", "d"), ("10.0.1.7", "e"), ("10.0.1.8/30", "f")]
    got = sorted(tuple(r) for r in relations.merged_ranges(spark.createDataFrame(rows, "cidr string, label string")).select("lo", "hi", "label").collect())
    at = 10 << 24
    assert got == [(at, at + 3, "c"), (at + 8, at + 31, "a"), (at + 256, at + 511, "d")]


def test_firing_and_arming_across_blocks(spark):
    counts = [1, 5, 6, 4, 2, 1, 7, 3, 2, 6, 1, 5]
    df = spark.createDataFrame([("x", t, n) for t, n in enumerate(counts)] + [("y", 3, 9)], "actor string, t long, n int")
    want, on = [], False
    for t, n in enumerate(counts):
        if on and n <= 2:
            on = False
        elif not on and n >= 5:
            on = True
            want.append(("x", t))
    for block in (1, 3, 100):
        got = stateful.fired(df, "actor", "t", F.col("n") >= 5, F.col("n") <= 2, block)
        assert sorted((r["actor"], r["t"]) for r in got.collect()) == [*want, ("y", 3)]


def test_turns_of_a_walk(spark):
    walk = [1, 2, 3, 4, 3, 2, 1, 0, -1, 9, 10, 11, 12, 13, 20]
    df = spark.createDataFrame([("u", k, n) for k, n in enumerate(walk)], "actor string, k int, n int")
    got = sorted((r["k"], r["current"], r["length"], r["direction"]) for r in stateful.sequential(df, ["actor"], "n", ["k"], 4).collect())
    assert got == [(3, 4, 4, "ascending"), (12, 12, 4, "ascending")]  # the way down belongs to the walk told of at 4


def test_quantile_cuts(spark):
    values = [3, 3, 9, 50, 51, 52, 1000, 1001, 7, 8, 120]
    df = spark.createDataFrame([(v,) for v in values], "us long")
    s = sorted(values)
    at = lambda q: int(s[int(q * 10)] + (s[min(int(q * 10) + 1, 10)] - s[int(q * 10)]) * (q * 10 - int(q * 10)))
    assert decisions.quantile_cuts(df, "us", [0.0, 0.33, 0.5, 0.85, 1.0], 10) == [at(q) for q in (0.0, 0.33, 0.5, 0.85, 1.0)]


def test_a_damaged_archive_is_refused(spark, tmp_path):
    e = spark.range(100).selectExpr("id AS event_id", "'h' AS host", "'s' AS source", "id * 10 AS us")
    plan = lifecycle.seal_plan(e, "us", 500, 1000, 0, [])
    folder = str(tmp_path / "cold")
    told = spark.createDataFrame(lifecycle.seal(e, "us", plan, 500, [], folder).collect(), "start_us long, rows long, checksum decimal(38,0), end_us long")
    schema = "event_id bigint, host string, source string, us bigint, window_us bigint"
    assert lifecycle.cold(spark, folder, told, 0, 400, "us", schema).count() == 40
    with pytest.raises(ValueError, match="bounds"):
        lifecycle.cold(spark, folder, told, None, None, "us", schema, most_rows=50)
    e.limit(1).withColumn("window_us", F.lit(0)).write.mode("append").partitionBy("window_us").parquet(folder)
    with pytest.raises(ValueError, match="manifest"):
        lifecycle.cold(spark, folder, told, 0, 400, "us", schema)


def test_approvals_and_prefixes(spark):
    rows = spark.createDataFrame([(1, "raw", False, False), (2, "raw.x", False, True), (3, "other.raw", True, False), (4, "none", False, False)], "event_id int, object string, justified boolean, approved boolean")
    rules = [{"id": "r", "effect": "require_approval", "priority": 1, "when": {"object": "raw.*"}}, {"id": "j", "effect": "require_justification", "priority": 1, "when": {"object": "raw"}}]
    got = {r["event_id"]: (r["effect"], r["policy"], r["missing"]) for r in decisions.policies(rows, rules).collect()}
    assert got == {1: ("require_approval", "r", "approval,justification"), 2: ("allow", "r", ""), 3: ("allow", "j", ""), 4: ("allow", None, "")}
