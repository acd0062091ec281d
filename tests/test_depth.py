"""Indexes, orders, suppression, archives and graphs against plain Python versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from emberlake import catalog, catalog_depth
from emberlake.functions.text import fingerprint, statement
from emberlake.operators import lifecycle, ordered, relations, schedule, search, stateful, suppression
from emberlake.sources import parsers, versions
from emberlake.streaming import actors, state

SF = "/root/testdata/sf0.01"


def folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def test_text_index(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    rows = [(f"i{k}", k * 10**9, f"h{k % 3}", "s", "src" if k % 5 else "other", None, "t", " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(300)]
    df = spark.createDataFrame(rows, search.DOCS)
    at = versions.created(spark, folder(tmp_path, "text"))
    for k in (0, 1):
        search.index_text(df.where(F.expr(f"us % 2000000000 = {k}000000000")), at, block_us=20 * 10**9)
    whole = search.search_text(spark, at, "w1 w2, W3!", 500)
    few = search.search_text(spark, at, "w1 w2 w3", 7, first_blocks=1)
    assert [r["id"] for r in few.orderBy("place").collect()] == [r["id"] for r in whole.orderBy("place").limit(7).collect()]
    assert {r["id"] for r in whole.collect()} == {r[0] for r in rows if {"w1", "w2", "w3"} & set(r[-1].split())}
    assert search.search_text(spark, at, "w1", 5, scope=[]).count() == 0 and search.search_text(spark, at, "!?", 5).count() == 0
    assert search.search_text(spark, at, "w1", 500, {"host": ["h1"]}, from_us=10**10, to_us=10**11).where("host <> 'h1' OR us < 10000000000 OR us >= 100000000000").count() == 0
    with pytest.raises(ValueError):
        search.search_text(spark, at, "w1", 5, {"no": ["x"]})
    parts = versions.live(spark, at)
    asked = versions.read(spark, at, "postings", [p["part"] for p in parts], f"{search.POSTINGS}, part string, bucket int").where(F.col("bucket") == search.bucket_of("w1"))
    assert 0 < len(asked.inputFiles()) < 8 * len(parts) * 30 and "PartitionFilters: [isnotnull(bucket" in asked._jdf.queryExecution().toString()
    assert search.erase_host(spark, at, "h1") and not {r["id"] for r in search.search_text(spark, at, "w1 w2 w3", 500).collect()} & {r[0] for r in rows if r[2] == "h1"}
    left = spark.read.schema(search.DOCS).parquet(f"{at}/docs")
    assert left.where("host = 'h1'").count() == 0 and left.count() == 200
    search._put(df.limit(3), at, "docs", "broken", ["id"], False)  # a run that breaks before its commit
    assert search.search_text(spark, at, "w1 w2 w3", 500).where("host = 'h1'").count() == 0


def test_recall_of_the_vector_index(spark):
    exact, got = ({} for _ in range(2))
    for name, to in (("d24_nearest_vectors", exact), ("d24_vector_index", got)):
        for r in catalog.QUERIES[name](spark, SF).collect():
            to.setdefault(r["probe"], {})[r["id"]] = r["cosine"]
    found = sum(len(set(got[p]) & set(exact[p])) for p in exact) / sum(len(v) for v in exact.values())
    assert set(got) == set(exact) and found >= 0.9
    assert all(abs(c - exact[p][i]) < 1e-5 for p in got for i, c in got[p].items() if i in exact[p])
    assert catalog_depth.NEAR_SHARE < 1


def test_vectors_in_clusters_need_a_tenth_of_the_lists(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(60, 24)), 20, axis=0) + rng.normal(size=(1200, 24)) * 0.3
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    at, probes = versions.created(spark, folder(tmp_path, "c")), df.where("vec_id % 100 = 0")
    lists = search.fit_centres(df, at)
    search.index_vectors(df, at)
    pairs = lambda out: {(r["probe"], r["id"]) for r in out.collect()}
    exact = pairs(relations.nearest(df, probes, 10))
    assert len(pairs(search.search_vectors(probes, at, 10, lists // 10)) & exact) >= 0.9 * len(exact)


def test_vectors_of_odd_shape(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0])], "vec_id long, embedding array<float>")
    at = versions.created(spark, folder(tmp_path, "v"))
    assert search.fit_centres(df, at, lists=2) == 2
    search.index_vectors(df, at)
    got = [(r["id"], round(r["cosine"], 6)) for r in search.search_vectors(df.where("vec_id = 1"), at, 2, 2).orderBy("place").collect()]
    assert got == [(6, 1.0), (2, round(0.9 / 0.82**0.5, 6))]


def test_places(spark):
    rows = [(random.Random(k).randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "v int, k int").repartition(7)
    got = {r["k"]: r["place"] for r in ordered.ranked(df, F.desc("v"), F.col("k")).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [k for _, k in sorted(rows, key=lambda r: (-r[0], r[1]))] and sorted(got.values()) == list(range(1, 501))


def test_runs_over_ranges(spark):
    rng, rows = random.Random(6), []
    for actor in ("a", "b", None, *[f"c{k}" for k in range(20)]):
        n, way = 0, 1
        for k in range(400 if actor in ("a", None) else 15):
            way = rng.choice([way] * 8 + [-way, 7])
            n += way
            way = 1 if way == 7 else way
            rows.append((actor, k, n))
    df = spark.createDataFrame(rows, "actor string, k int, n int")
    want = sorted(map(tuple, stateful.sequential(df, ["actor"], "n", ["k"], 4).collect()), key=repr)
    assert sorted(map(tuple, ordered.sequential(df, ["actor"], "n", ["k"], 4).collect()), key=repr) == want and len(want) > 20


def arrive(numbers, cap):
    high, missing, out = None, [], []
    for n in numbers:
        lost = 0
        if high is None:
            high, state = n, "first"
        elif n > high:
            missing += range(high + 1, n)
            high, lost = n, max(0, len(missing) - cap)
            missing, state = missing[lost:], "gap" if lost else "advance"
        elif n in missing:
            missing.remove(n)
            state = "reordered"
        else:
            state = "replay"
        out.append((state, lost))
    return out


@pytest.mark.parametrize("cap", [3, 20, 10_000])
def test_states_of_arrival(spark, cap):
    rng, rows, want = random.Random(cap), [], []
    for key in ("a", None, "b", "c"):
        numbers = [max(0, k + rng.randrange(-9, 10)) for k in range(200 if key == "a" else 40)] if key != "c" else [5, 5, 500, 7, 6, 600, 8]
        rows += [(key, k, n) for k, n in enumerate(numbers)]
        want += [(key, k, n, *s) for k, (n, s) in enumerate(zip(numbers, arrive(numbers, cap)))]
    got = ordered.arrivals(spark.createDataFrame(rows, "c string, k int, n long"), ["c"], "n", ["k"], cap)
    assert sorted((tuple(r) for r in got.select("c", "k", "n", "state", "lost").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("gap", [1, 50, 4000, 100_000])
def test_throttle_in_blocks(spark, gap):
    rng = random.Random(gap)
    times = {r: sorted(rng.sample(range(-300_000, 600_000), 700)) for r in ("a", None, "b")}
    df = spark.createDataFrame([(r, t) for r, ts in times.items() for t in ts], "rule string, s long")
    want = set()
    for r, ts in times.items():
        last = None
        for t in ts:
            if last is None or t - last >= gap:
                last = t
                want.add((r, t))
    assert {tuple(x) for x in suppression.sent_seconds(df, "rule", "s", gap).collect()} == want


def test_cases_with_closings(spark):
    rng = random.Random(12)
    dets = [(rng.choice("ab"), rng.randrange(400) * 10**6, rng.choice([None, None, 5 * 10**6])) for _ in range(300)]
    ends = [(rng.choice("abz"), rng.randrange(400) * 10**6) for _ in range(40)]
    want, seen = {}, {}
    for t, kind, key, own in sorted([(t // 10**6, 1, k, (own or 7 * 10**6) // 10**6) for k, t, own in dets] + [(t // 10**6, 0, k, 0) for k, t in ends]):
        s = seen.setdefault(key, {"mark": None, "no": 0})
        if kind == 0:
            if s["no"] and want[key, s["no"]][-1] is None:
                want[key, s["no"]][-1] = t
        elif s["mark"] is not None and t - s["mark"] < own:
            case = want[key, s["no"]]
            if case[-1] is None:
                case[2] += 1
                case[1] = s["mark"] = t
            else:
                case[3] += 1
        else:
            s["no"], s["mark"] = s["no"] + 1, t
            want[key, s["no"]] = [t, t, 1, 0, None]
    d, e = spark.createDataFrame(dets, "k string, us long, own long"), spark.createDataFrame(ends, "k string, us long")
    got = suppression.cases(d, ["k"], "us", 7 * 10**6, e, F.col("own"))
    assert {(r["k"], r["case_no"]): [r["opened_s"], r["updated_s"], r["events"], r["dropped"], r["closed_s"]] for r in got.collect()} == want


def test_erasure_of_archives(spark, tmp_path):
    day = 86_400_000_000
    rows = spark.createDataFrame([(k, f"h{k % 3}", "s", "{}", k * day // 10) for k in range(60)], "event_id long, host string, source string, fields string, us long")
    plan = lifecycle.seal_plan(rows, "us", day, 6 * day, 0, [])
    stones = [{"host": "h1", "from_us": 0, "to_us": 2 * day}]
    held = versions.created(spark, folder(tmp_path, "held"))
    lifecycle.seal_parts(rows, "us", plan, day, [], held, holds=[(day, day + 1)])
    with pytest.raises(ValueError):
        lifecycle.erase_archives(spark, held, "us", stones, day)
    at = versions.created(spark, folder(tmp_path, "free"))
    lifecycle.seal_parts(rows, "us", plan, day, [], at)
    before = {p["part"] for p in versions.live(spark, at)}
    rows.limit(1).withColumn("part", F.lit("0-broken")).write.mode("append").partitionBy("part").parquet(f"{at}/archives")  # a run that broke before its commit
    assert {p["part"] for p in versions.live(spark, at)} == before
    told = lifecycle.erase_archives(spark, at, "us", stones, day)
    assert [n for _, n in told] == [3, 4]
    live = versions.live(spark, at)
    df = lifecycle.verified(spark, at, live)
    assert df.count() == 53 and df.where("host = 'h1' AND us < 172800000000").count() == 0 and len(live) == 6
    assert spark.read.parquet(f"{at}/archives").where("host = 'h1' AND us < 172800000000 AND part <> '0-broken'").count() == 0
    df.limit(1).drop("part").write.mode("append").parquet(f"{at}/archives/part={live[0]['part']}")
    with pytest.raises(ValueError):
        lifecycle.erase_archives(spark, at, "us", [{"host": "h2"}], day)


def test_a_failed_rule_runs_again_without_doubles(spark, tmp_path):
    at = versions.created(spark, folder(tmp_path, "rules"))
    asked = []

    def run(since, to):
        asked.append((since, to))
        df = spark.range(since, to).select("id")
        return df if to != 20 else df.where(F.raise_error(F.lit("away")).isNull())

    rules = [schedule.Rule("r", 5, 10, run)]
    assert [schedule.run_due(spark, at, rules, t) for t in (10, 12)] == [{"r": None}, {}]
    assert schedule.run_due(spark, at, rules, 20)["r"] is not None
    assert schedule.run_due(spark, at, rules, 21) == {"r": None}
    assert asked == [(0, 10), (10, 20), (10, 21)] and schedule.last_runs(spark, at) == {"r": 21}
    assert sorted(r["id"] for r in schedule.detections(spark, at, "id long").collect()) == list(range(21))


def test_rounds_end_at_the_goal(spark):
    links = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)] + [("n1", f"leaf{k}") for k in range(1500)], "a string, b string")
    seen = relations.pivot(links, spark.createDataFrame([("n0",)], "node string"), 15, "n3")
    assert seen.agg(F.max("hops")).first()[0] == 3
    assert [r["node"] for r in relations.shortest_path(links, "n0", "n4").orderBy("place").collect()] == ["n0", "n1", "n2", "n3", "n4"]
    assert relations.pivot(links, spark.createDataFrame([("zz",)], "node string"), 9).count() == 1


def batches(spark, rows, schema, folder, files):
    """rows as a stream of so many files, one a batch, in their order."""
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    actors.with_store(spark)
    return state.read(spark, f"{folder}/in", schema, 1)


PROBES = "actor string, resource string, us long, received_us long"


def test_probing_with_late_and_future_events(spark, tmp_path):
    rng, base, width = random.Random(30), 10**15, 100 * 10**6
    rows, want, state_ = [], [], {}
    for k in range(160):
        received = base + k * 10**7
        shift = rng.choice([0, 0, 0, -30, -90, -500, 40]) * 10**6
        rows.append((rng.choice("ab"), f"r{rng.randrange(9)}", received + shift, received))
    for actor, name, us, _ in rows:
        s = state_.setdefault(actor, {"latest": us, "armed": True, "window": {}})
        s["latest"] = max(s["latest"], us)
        if us >= s["latest"] - width:
            s["window"][name] = max(us, s["window"].get(name, us))
        s["window"] = {n: t for n, t in s["window"].items() if t >= s["latest"] - width}
        while len(s["window"]) > 6:
            s["window"].pop(min(s["window"], key=lambda n: (s["window"][n], n)))
        if s["armed"] and len(s["window"]) >= 4:
            s["armed"] = False
            want.append((actor, us, len(s["window"])))
        elif len(s["window"]) <= 2:
            s["armed"] = True
    at = folder(tmp_path, "probing")
    out = state.caught_up(actors.probing(batches(spark, rows, PROBES, at, 3), width, 4, 2, 6), at)
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 3


def test_idle_actors_are_forgotten_by_the_clamped_clock(spark, tmp_path):
    day, base = 86_400 * 10**6, 10**15
    ahead = [("a", "r1", base, base), ("a", "r2", base + 1, base + 1), ("b", "x", base + 90 * day, base + 2)]  # a time in the future ages nobody
    for name, more, fires in (("kept", [("c", "y", base + 3, base + 3)], 1), ("gone", [("c", "y", base + 90 * day, base + 90 * day)], 0)):
        rows = [*ahead, *more, ("c", "z", more[0][2] + 1, more[0][3] + 1), ("a", "r3", more[0][2] + 2, more[0][3] + 2)]
        at = folder(tmp_path, name)
        out = state.caught_up(actors.probing(batches(spark, rows, PROBES, at, 3), 400 * day, 3, 1, late="1 day"), at)
        assert out.where("actor = 'a'").count() == fires


def test_streamed_suppression_equals_the_batch(spark, tmp_path):
    rng, base = random.Random(5), 10**15
    rows = [(rng.choice("ab"), base + k * 10**6, base + k * 10**6, rng.random() < 0.15) for k in sorted(rng.sample(range(500), 120))]
    at = folder(tmp_path, "suppressed")
    out = state.caught_up(actors.suppressed(batches(spark, rows, "key string, us long, received_us long, closing boolean", at, 3), 9), at)
    told = out.groupBy("key", "case_no").agg(F.count_if(F.expr("did <> 'dropped'")).alias("events"), F.count_if(F.expr("did = 'dropped'")).alias("dropped"))
    df = spark.createDataFrame(rows, "key string, us long, received_us long, closing boolean")
    want = suppression.cases(df.where("NOT closing"), ["key"], "us", 9 * 10**6, df.where("closing")).select("key", "case_no", "events", "dropped")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect())) and want.where("dropped > 0").count() > 0


def test_broken_and_odd_pushes(spark):
    e = spark.createDataFrame([('{host="h\\"1", service="s"}', 1_704_164_645_000_000_123, "grüße"), ("{}", 5, "")], "l string, ns long, m string")
    pushes = parsers.to_loki_protobuf(e, F.col("l"), F.col("ns"), F.col("m"), F.lit("k"))
    good = [bytes(r["body"]) for r in pushes.collect()]
    bodies = spark.createDataFrame([(b,) for b in [*good, good[0][:9], b"", None, b"\xff\xff"]], "body binary")
    rows = parsers.loki_protobuf(bodies).orderBy("event_ts").collect()
    assert [(r["host"], r["service"], r["message"]) for r in rows] == [("unknown", None, ""), ('h"1', "s", "grüße")]
    assert rows[1]["event_ts"].microsecond == 0 and rows[1]["event_ts"].year == 2024


FACTS = [
    ('select a.x, "My Table"."Col 1" from "My Table" , other o, third /* c /* nested from evil */ from evil2 */ where o.k = $1 and lower(a.x) = $q$ from q $q$', {"read": ['"My Table"', "other", "third"], "columns": ['"My Table"."Col 1"', "a.x", "o.k"], "predicates": ["a.x", "o.k"], "functions": ["lower"]}),
    ("select extract(year from ts) from logs where a is distinct from b", {"read": ["logs"], "has_where": True, "bulk": False}),
    ("select count(*) from (select * from inner1) x, outer1", {"read": ["inner1", "outer1"], "wildcard": True, "bulk": True}),
    ("with recursive a as (select 1), b (x) as materialized (select * from real) select b.x from a, b", {"ctes": ["a", "b"], "read": ["real"], "columns": ["b.x"], "kind": "select"}),
    ("revoke all on table a.b, c from joe", {"targets": ["a.b", "c"], "read": [], "privileges": True}),
    ("GRANT ALL ON ALL TABLES IN SCHEMA sales TO x", {"targets": ["sales"]}),
    ("SET SESSION AUTHORIZATION root", {"kind": "set_role", "roles": ["root"]}),
    ("TRUNCATE ONLY a, b.c", {"written": ["a", "b.c"], "read": []}),
    ("merge into tgt t using src s on t.id = s.id when matched then update set v = s.v", {"written": ["tgt"], "read": ["src"], "joined": ["src"]}),
    ("select x from t join u using (id) limit 5", {"read": ["t", "u"], "joined": ["u"], "bulk": False}),
    ("copy s.t (a, b) to '/x'", {"read": ["s.t"], "export": True, "bulk": True}),
    ("copy t(a,b) from stdin", {"written": ["t"], "read": [], "bulk": False}),
    ("create table if not exists n.m as select * from k", {"written": ["n.m"], "read": ["k"]}),
    ("insert into t values ('it''s from x', E'a\\\\'' from y') on conflict do update set a = 1", {"written": ["t"], "read": []}),
    ("frobnicate the table", {"confidence": "low"}),
    ("select 1 from a where (b = 2", {"confidence": "low", "unresolved": ["a"]}),
    ("select 1 from a /* never ends", {"confidence": "none"}),
    ("", {"confidence": "low", "kind": "", "read": []}),
]


def test_facts_of_hard_statements(spark):
    df = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(FACTS)], "k int, q string")
    for r in df.select("k", statement(F.col("q")).alias("s")).collect():
        got = r["s"].asDict()
        assert {k: got[k] for k in FACTS[r["k"]][1]} == FACTS[r["k"]][1], FACTS[r["k"]][0]
    same = [("SELECT a FROM t -- x\n WHERE i = 5;", 1), ("select  A from T where I=$1", 1), ("select a from t where i = 'q'", 1), ('select a from "T" where i = 5', 2), ("select b from t where i = 5", 3)]
    prints = spark.createDataFrame(same, "q string, g int").groupBy("g").agg(F.count_distinct(fingerprint(F.col("q"))).alias("n"), F.min(fingerprint(F.col("q"))).alias("p")).collect()
    assert all(r["n"] == 1 for r in prints) and len({r["p"] for r in prints}) == 3
