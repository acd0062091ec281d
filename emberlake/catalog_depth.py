"""Queries over written indexes, versions, graphs and keyed state, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.catalog import DAY_US, NOW_US, query
from emberlake.catalog_more import at_us, scratch, signals
from emberlake.functions.text import statement
from emberlake.operators import correlation, lifecycle, ordered, relations, schedule, search
from emberlake.sources import parsers, versions
from emberlake.sources.events import derived, field, micros


def text_index(spark, d):
    """The events but those of one source, appended to an index in two batches."""
    folder = versions.created(spark, scratch(spark, "text-index"))
    e = derived(spark, d).select(F.col("event_id").cast("string").alias("id"), at_us().alias("us"), *search.LABELS, "message")
    for batch in (e.where("us < 1705276800000000"), e.where("us >= 1705276800000000")):
        search.index_text(batch, folder, exclude=("journald",), block_us=DAY_US)
    return folder


def bm25_sql(terms: list[str], where: str, limit: int, drop: str = "false") -> str:
    """Documents of E (but those of journald, and those to drop) that hold a term, by BM25 over the whole index."""
    said = ", ".join(f"('{t}')" for t in terms)
    return f""", W AS (SELECT *, list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM E WHERE source <> 'journald' AND NOT ({drop})), S AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM W),
T AS (SELECT event_id, len(w) AS n, t, len(list_filter(w, lambda x: x = t)) AS tf FROM W, (VALUES {said}) AS q(t)), I AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM T GROUP BY 1),
R AS (SELECT event_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM T JOIN I USING (t), S GROUP BY 1 HAVING sum(tf) > 0)
SELECT row_number() OVER (ORDER BY score DESC, event_id::VARCHAR)::INT AS place, event_id::VARCHAR AS id, round(score, 6) AS score, us, host, service, W.source, severity, log_type, message FROM R JOIN W USING (event_id) WHERE {where} ORDER BY place LIMIT {limit}"""


@query(bm25_sql(["failed", "u7", "u13", "password"], "service IN ('sshd', 'sudo') AND host IN ('host-1', 'host-7') AND us >= 1704500000000000 AND us < 1706140800000000 AND W.source IN ('syslog', 'pgaudit')", 50))
def d23_text_index(spark, d):
    """Labels, a window of time and a scope of sources besides the terms."""
    folder = text_index(spark, d)
    labels = {"service": ["sshd", "sudo"], "host": ["host-1", "host-7"]}
    out = search.search_text(spark, folder, "Failed u7 u13, password!", 50, labels, 1_704_500_000_000_000, 1_706_140_800_000_000, ["syslog", "pgaudit"])
    return out.withColumn("score", F.round("score", 6))


@query(bm25_sql(["purchase", "u4"], "true", 40, "host = 'host-4' OR us < 1704844800000000"))
def d23_text_index_erased(spark, d):
    """After a host has been erased from the index, and time before a boundary has left it."""
    folder = text_index(spark, d)
    search.erase_host(spark, folder, "host-4")
    search.prune_text(spark, folder, 1_704_844_800_000_000)
    return search.search_text(spark, folder, "purchase u4", 40).withColumn("score", F.round("score", 6))


@query(None)
def d24_vector_index(spark, d):
    """Neighbours of every vector whose id is divisible by 100, by an index of all vectors in two parts; a test measures the recall."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    folder = versions.created(spark, scratch(spark, "vectors"))
    lists = search.fit_centres(v, folder)
    for half in (0, 1):
        search.index_vectors(v.where(F.col("vec_id") % 2 == half), folder)
    return search.search_vectors(v.where("vec_id % 100 = 0"), folder, 10, round(NEAR_SHARE * lists)).withColumn("cosine", F.round("cosine", 5))


#: Share of the lists that a search of d24_vector_index looks into: these vectors have no clusters, and for a recall of 0.9 so many are needed, by
#: codes of a quarter of the vectors' bytes. Where vectors cluster, a tenth does.
NEAR_SHARE = 0.7


@query(""", C AS (SELECT 'case:c' || event_id AS x, host, src_ip, db_user, person FROM E WHERE severity = 'warning'), G AS (SELECT x, 'host:' || host AS y, 1 AS r FROM C UNION ALL SELECT x, 'ip:' || src_ip, 1 FROM C UNION ALL SELECT x, 'staff:' || db_user, 1 FROM C UNION ALL SELECT x, 'person:' || person, 1 FROM C
UNION ALL SELECT 'staff:' || db_user, 'person:' || person, 1 FROM E WHERE person = 'p7' UNION ALL SELECT 'host:' || host, 'ip:' || src_ip, 0 FROM E UNION ALL SELECT 'staff:' || db_user, 'person:' || person, 0 FROM E)
SELECT least(x, y) AS a, greatest(x, y) AS b, CASE max(r) WHEN 1 THEN 'case' ELSE 'event' END AS label FROM G GROUP BY ALL""")
def d25_case_graph(spark, d):
    """Cases from warnings; a case that is named like a person's lookups links staff and person itself, so that its edge outranks the event's."""
    e = derived(spark, d)
    of = lambda df, case: df.select(case.alias("case_id"), "host", field("src_ip").alias("src_ip"), field("user").alias("user"), field("db_user").alias("db_user"), field("target_person").alias("target_person"))
    links = relations.entity_graph(e, of(e.where("severity = 'warning'"), F.concat(F.lit("c"), F.col("event_id").cast("string"))))
    watched = e.select(F.concat(F.lit("staff:"), field("db_user")).alias("x"), F.concat(F.lit("person:"), field("target_person")).alias("y")).where("y = 'person:p7'").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("case").alias("label"))
    return relations.strongest(links.unionByName(watched))


ARRIVALS = "SELECT collector_id AS collector, us, event_id AS no, (event_id * 7 // 9) % 700 AS seq FROM E WHERE collector_id IS NOT NULL"


@query(f""", A AS ({ARRIVALS}), P AS (SELECT *, row_number() OVER (PARTITION BY collector ORDER BY us, no) AS k FROM A),
F AS (SELECT collector, k, us, no, seq, seq AS high, []::BIGINT[] AS gone, 'first' AS state, 0::BIGINT AS lost FROM P WHERE k = 1 UNION ALL
SELECT p.collector, p.k, p.us, p.no, p.seq, greatest(F.high, p.seq), CASE WHEN p.seq > F.high THEN list_concat(F.gone, range(F.high + 1, p.seq))[greatest(0, len(F.gone) + p.seq - F.high - 1 - 60) + 1:] ELSE list_filter(F.gone, lambda x: x <> p.seq) END,
CASE WHEN p.seq > F.high THEN CASE WHEN len(F.gone) + p.seq - F.high - 1 > 60 THEN 'gap' ELSE 'advance' END WHEN list_contains(F.gone, p.seq) THEN 'reordered' ELSE 'replay' END, CASE WHEN p.seq > F.high THEN greatest(0, len(F.gone) + p.seq - F.high - 1 - 60) ELSE 0 END
FROM F JOIN P AS p ON p.collector = F.collector AND p.k = F.k + 1) SELECT collector, us, no, seq, state, lost FROM F""", recursive=True)
def st13_arrivals(spark, d):
    """Numbers that come out of order and again; some streams have more missing than the cap of 60."""
    e = derived(spark, d).where("collector_id IS NOT NULL").select(F.col("collector_id").alias("collector"), at_us().alias("us"), F.col("event_id").alias("no"), F.expr("(event_id * 7 div 9) % 700").alias("seq"))
    return ordered.arrivals(e, ["collector"], "seq", ["us", "no"], 60)


@query("SELECT event_id, us FROM E WHERE source <> 'pgaudit' AND us < 1705276800000000 AND NOT (host = 'host-5') AND NOT (db_user = 'u7' AND us >= 1704500000000000)")
def d31_erase_rewrite(spark, d):
    """What all files of the archives hold after an erasure, whether or not a commit names them."""
    e = derived(spark, d).select("event_id", "host", "source", "fields", at_us().alias("us"))
    plan = lifecycle.seal_plan(e, "us", DAY_US, 1_705_276_800_000_000, 0, ["pgaudit"])
    folder = versions.created(spark, scratch(spark, "sealed-parts"))
    lifecycle.seal_parts(e, "us", plan, DAY_US, ["pgaudit"], folder)
    lifecycle.erase_archives(spark, folder, "us", [{"host": "host-5"}, {"key": "db_user", "value": "u7", "from_us": 1_704_500_000_000_000}], DAY_US)
    return spark.read.schema("event_id bigint, host string, source string, fields string, us bigint").parquet(f"{folder}/archives").select("event_id", "us")


#: Ticks of a schedule and, for each rule, the windows that its successes look at.
TICKS = [NOW_US - k * DAY_US for k in (12, 11, 9, 8, 5)]
RUNS = [("bursts", TICKS[0], TICKS[0] - 3 * DAY_US), ("bursts", TICKS[2], TICKS[0]), ("bursts", TICKS[4], TICKS[2]), ("logins", TICKS[0], TICKS[0] - DAY_US), ("logins", TICKS[3], TICKS[0]), ("logins", TICKS[4], TICKS[3])]


@query(", RUNS AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {t}, {s})" for r, t, s in RUNS) + ") AS v(rule, run_us, since_us)) SELECT rule, run_us, since_us, CASE rule WHEN 'bursts' THEN host ELSE db_user END AS subject, count(*) AS n FROM RUNS JOIN E ON us >= since_us AND us < run_us AND message LIKE CASE rule WHEN 'bursts' THEN 'Failed%' ELSE 'Accepted%' END GROUP BY ALL")
def st6_schedule(spark, d):
    """Two rules over five ticks; one of them fails twice and looks at all that it missed when it runs again."""
    folder, e = versions.created(spark, scratch(spark, "schedule")), derived(spark, d).withColumn("us", at_us())

    def rule(subject, like, fails=()):
        def run(since_us, to_us):
            if to_us in fails:
                raise OSError("the store is away")
            inside = e.where((F.col("us") >= since_us) & (F.col("us") < to_us) & F.col("message").like(like))
            return inside.groupBy(subject.alias("subject")).agg(F.count("*").alias("n"))

        return run

    rules = [schedule.Rule("bursts", 2 * DAY_US, 3 * DAY_US, rule(F.col("host"), "Failed%")), schedule.Rule("logins", DAY_US, DAY_US, rule(field("db_user"), "Accepted%", TICKS[1:3]))]
    for now in TICKS:
        schedule.run_due(spark, folder, rules, now)
    return schedule.detections(spark, folder, "subject string, n bigint")


@query("SELECT us, host, service, 'loki' AS source, severity, message, src_ip, regexp_extract(message, 'port ([0-9]+)', 1) AS port FROM E WHERE message LIKE '%password for user%'")
def s9_loki_protobuf(spark, d):
    """Events pushed as packed messages by host and hour, and read back."""
    e = derived(spark, d).where("message LIKE '%password for user%'")
    labels = F.concat(F.lit('{host="'), F.col("host"), F.lit('", service="'), F.col("service"), F.lit('", severity="'), F.col("severity"), F.lit('"}'))
    pushes = parsers.to_loki_protobuf(e, labels, at_us() * 1000, F.col("message"), F.concat("host", F.lit(" "), F.floor(at_us() / 3_600_000_000).cast("string")))
    out = parsers.loki_protobuf(pushes)
    return out.select(micros("event_ts").alias("us"), "host", "service", "source", "severity", "message", field("src_ip").alias("src_ip"), field("port").alias("port"))


#: Shapes of statements, and what they read, write, ask for by condition and how sure that is; {h} host, {s} service, {u} user, {p} person.
SHAPES = [
    ('SELECT a.{u}, "Odd {h}"."from" FROM {s}.events AS a JOIN "Odd {h}" ON a.id = 1 /* FROM hidden /* FROM deeper */ */ WHERE a.{p} = $1', ["{s}.events", '"Odd {h}"'], [], ["a.{p}"], "high"),
    ("WITH {u} AS (SELECT x FROM {s}.raw , {p} t) INSERT INTO log.{s} SELECT x FROM {u} WHERE {u}.x > 5 -- FROM nothing", ["{s}.raw", "{p}"], ["log.{s}"], ["{u}.x"], "high"),
    ("delete FROM only {s}.t USING {p} WHERE {p}.id = {s}.k AND note = E'it\\'s from {u}'", ["{p}"], ["{s}.t"], ["{p}.id", "{s}.k"], "high"),
    ("UPDATE {u} SET a = $q$ WHERE x.y $q$ WHERE b IN (SELECT b FROM (SELECT * FROM {p}) z, {s}.other WHERE z.b IS DISTINCT FROM 4", ["{p}", "{s}.other"], ["{u}"], ["z.b"], "low"),
    ("TRUNCATE TABLE {u}, {s}.{p}; SELECT 'open FROM", [], ["{u}", "{s}.{p}"], [], "none"),
]


def _filled(text: str) -> str:
    """A shape as SQL that both engines read, with values in place of the letters."""
    out = "'" + text.replace("'", "''") + "'"
    for letter, value in (("h", "host"), ("s", "service"), ("u", "db_user"), ("p", "person")):
        out = f"replace({out}, '{{{letter}}}', {value})"
    return out


def _shape_sql() -> str:
    told = lambda k, part: "CASE event_id % 5 " + " ".join(f"WHEN {n} THEN list_sort([{', '.join(map(_filled, shape[part]))}]::VARCHAR[])" for n, shape in enumerate(SHAPES)) + " END AS " + k
    sure = "CASE event_id % 5 " + " ".join(f"WHEN {n} THEN '{shape[4]}'" for n, shape in enumerate(SHAPES)) + " END AS confidence"
    return f"SELECT event_id, {sure}, {', '.join(f'array_to_string({c}, chr(10)) AS {c}' for c in ('read', 'written', 'predicates'))} FROM (SELECT event_id, {told('read', 1)}, {told('written', 2)}, {told('predicates', 3)} FROM E)"


@query(_shape_sql())
def d12_statement_facts(spark, d):
    """Nested comments, quoted and dollar-quoted texts, derived tables, with names, and brackets and quotes without an end; names are the events'."""
    e = derived(spark, d).select("event_id", "host", "service", field("db_user").alias("db_user"), field("target_person").alias("person"))
    text = F.array(*[F.expr(_filled(s[0]).replace("\\", "\\\\")) for s in SHAPES])
    out = e.select("event_id", statement(F.element_at(text, (F.col("event_id") % 5 + 1).cast("int")), "confidence", "read", "written", "predicates").alias("s"))
    return out.select("event_id", "s.confidence", *[F.array_join(f"s.{c}", "\n").alias(c) for c in ("read", "written", "predicates")])


BAG = "concat('{\"dst_ip\":\"10.9.', event_id % 7, '.1\",\"port\":\"', event_id % 999, '\",\"user\":\"', db_user, '\",\"process\":\"', service, '\",\"exe\":\"/bin/', service, '\",\"cmdline\":\"', service, ' -x ', event_id % 3, '\",\"pid\":\"', event_id, '\",\"dns\":\"', host, '.example\",\"event_type\":\"', severity, '\"', CASE WHEN event_id % 2 = 0 THEN concat(',\"community_id\":\"1:', event_id, '\",\"src_ip\":\"', src_ip, '\"') ELSE '' END, '}')"


@query("SELECT event_id, '10.9.' || event_id % 7 || '.1' AS \"destination.ip\", (event_id % 999)::VARCHAR AS \"destination.port\", db_user AS \"user.name\", service AS \"process.name\", '/bin/' || service AS \"process.executable\", service || ' -x ' || event_id % 3 AS \"process.command_line\", event_id::VARCHAR AS \"process.pid\", host || '.example' AS \"dns.question.name\", severity AS \"event.action\", CASE WHEN event_id % 2 = 0 THEN '1:' || event_id END AS \"network.community_id\", CASE WHEN event_id % 2 = 0 THEN src_ip END AS \"source.ip\", CASE WHEN event_id % 2 = 0 THEN src_ip END AS \"source.address\", host AS \"host.name\", host AS \"host.hostname\" FROM E")
def f11_all_common_names(spark, d):
    """All common names, over bags that are made from the events' own columns."""
    e = derived(spark, d).select("event_id", "host", "service", "severity", field("db_user").alias("db_user"), field("src_ip").alias("src_ip"))
    out = correlation.named(e.withColumn("fields", F.expr(BAG)))
    return out.select("event_id", *[F.col(f"`{c}`") for c in (*correlation.COMMON, "host.name", "host.hostname")])


@query(""", A AS (SELECT event_id::VARCHAR AS id, host, service, message, us, row_number() OVER (ORDER BY us DESC, event_id) AS place FROM E WHERE service IN ('sshd', 'sudo')), B AS (SELECT event_id::VARCHAR AS id, us, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM E WHERE value > 60),
M AS (SELECT *, row_number() OVER (ORDER BY v, host, service, message) AS place FROM (SELECT host, service, message, max(value) AS v FROM E WHERE value < 30 OR value > 90 GROUP BY ALL)), WA AS (SELECT * FROM A WHERE us >= 1704844800000000 AND us < 1706140800000000),
P AS (SELECT id, place FROM WA UNION ALL SELECT id, place FROM B SEMI JOIN WA USING (id) UNION ALL SELECT WA.id, M.place FROM WA JOIN M USING (host, service, message))
SELECT id, host, round(sum(1.0::DOUBLE / (60 + P.place)), 9) AS score, count(*) AS signals, false AS truncated FROM P JOIN WA USING (id) GROUP BY ALL""")
def j13_gated_hybrid(spark, d):
    """With a gate, text hits count only among the structured ones, and meanings only reinforce them."""
    out = relations.hybrid(*signals(spark, d), (1_704_844_800_000_000, 1_706_140_800_000_000), True, None)
    return out.select("id", "host", F.round("score", 9).alias("score"), "signals", "truncated")


@query("SELECT event_id::VARCHAR AS id, TIMESTAMP '2024-01-02 03:04:05' + to_microseconds((event_id % 1000) * 1000) AS event_ts, db_user, CASE WHEN event_id % 5 = 0 THEN 'pgaudit' ELSE 'postgres' END AS source, CASE event_id % 3 WHEN 0 THEN 'error' ELSE 'info' END AS severity FROM E")
def s19_csv_lines(spark, d):
    """CSV log lines through the adapter that goes by their name, as the other formats do."""
    e = derived(spark, d).select("event_id", field("db_user").alias("u"))
    message = F.expr("CASE WHEN event_id % 5 = 0 THEN concat('\"AUDIT: SESSION,1,1,READ,SELECT,TABLE,public.t,\"\"select ', event_id, '\"\",<none>\"') ELSE concat('\"said \"\"x\"\", n ', event_id, '\"') END")
    lines = {"log_time": F.expr("concat('2024-01-02 03:04:05.', lpad(CAST(event_id % 1000 AS STRING), 3, '0'), ' UTC')"), "user_name": F.col("u"), "session_id": F.col("event_id").cast("string"), "error_severity": F.expr("CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'LOG' END"), "message": message}
    df = e.select(F.concat_ws(",", *[lines.get(c, F.lit("")) for c in parsers.PG_CSV]).alias("line"))
    out = parsers.ADAPTERS["postgres-csvlog"](df)
    return out.select(F.coalesce(field("session_id"), field("session")).alias("id"), "event_ts", field("db_user").alias("db_user"), "source", "severity")
