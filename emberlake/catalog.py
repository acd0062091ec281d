"""All queries of the analytics operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions.text import fingerprint, ip_number, is_private
from emberlake.operators import behaviour, correlation, decisions, relations
from emberlake.plans import guard
from emberlake.sources import parsers
from emberlake.sources.events import derived, derived_sql, field, micros

FLAGSHIP = "a1_bruteforce"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The time that relative windows end at; the tables span January 2024.
NOW_US = 1_706_659_200_000_000
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def now():
    return F.expr("timestamp_ntz'2024-01-31 00:00:00'")


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query; its SQL may use E (the derived events, with the JSON values as columns)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}E0 AS ({derived_sql()}), E AS (SELECT *, json_extract_string(fields, '$.src_ip') AS src_ip, json_extract_string(fields, '$.db_user') AS db_user, json_extract_string(fields, '$.target_person') AS person, json_extract_string(fields, '$.ticket') AS ticket, epoch_us(event_ts) AS us FROM E0) {sql}"
        return f

    return put


def failed():
    return F.col("message").like("Failed password%")


def accepted():
    return F.col("message").like("Accepted password%")


WEEK = "event_ts >= TIMESTAMP '2024-01-24' AND event_ts < TIMESTAMP '2024-01-31'"


@query(f"SELECT src_ip AS subject, count(*) AS n, count(DISTINCT host) AS hosts, max(us) AS last_us FROM E WHERE message LIKE 'Failed password%' AND {WEEK} GROUP BY 1 HAVING count(*) >= 3")
def a1_bruteforce(spark: SparkSession, d: str) -> DataFrame:
    return correlation.burst(correlation.since(derived(spark, d), now(), 168), field("src_ip"), failed(), 3)


@query("SELECT host AS subject, count(*) AS n FROM E WHERE service = 'sudo' AND (hour(event_ts) < 5 OR hour(event_ts) >= 23) GROUP BY 1 HAVING count(*) >= 2")
def a2_off_hours_privilege(spark, d):
    return correlation.off_hours(derived(spark, d), F.col("host"), F.col("service") == "sudo", 2, start=5, end=23, weekend=False)


@query("SELECT db_user AS subject, count(*) AS n, count(DISTINCT person) AS targets FROM E WHERE service = 'postgres' GROUP BY 1 HAVING count(DISTINCT person) >= 3")
def a3_bulk_lookups(spark, d):
    return correlation.bulk_lookups(derived(spark, d).where("service = 'postgres'"), "db_user", "target_person", 3)


@query("SELECT db_user AS subject, count(*) AS n FROM (SELECT *, event_ts + INTERVAL 2 HOUR AS l FROM E WHERE service = 'postgres') WHERE hour(l) < 6 OR hour(l) >= 20 OR date_part('dow', l) IN (0, 6) GROUP BY 1 HAVING count(*) >= 2")
def a4_off_hours_lookups(spark, d):
    return correlation.off_hours(derived(spark, d), field("db_user"), F.col("service") == "postgres", 2, tz_hours=2)


@query("SELECT db_user AS subject, person AS target, count(*) AS n FROM E WHERE substr(db_user, 2) = substr(person, 2) GROUP BY ALL")
def a5_self_lookup(spark, d):
    return correlation.lookups(derived(spark, d), F.substring(field("db_user"), 2, 99) == F.substring(field("target_person"), 2, 99))


@query("SELECT db_user AS subject, person AS target, count(*) AS n FROM E WHERE person IN ('p7', 'p13', 'p42') GROUP BY ALL")
def a6_watchlist(spark, d):
    return correlation.lookups(derived(spark, d), field("target_person").isin("p7", "p13", "p42"))


@query("SELECT db_user AS subject, person AS target, count(*) AS n FROM E WHERE service = 'postgres' AND coalesce(ticket, '') = '' GROUP BY ALL")
def a7_lookup_without_ticket(spark, d):
    return correlation.lookups(derived(spark, d), (F.col("service") == "postgres") & (F.coalesce(field("ticket"), F.lit("")) == ""))


@query("SELECT source, count(*) AS n, max(us) AS last_us, max(epoch_us(ingest_time)) AS last_ingest_us, 1706659200000000 - max(us) AS stale_us, max(epoch_us(ingest_time) - us) AS lag_us, count(collector_id) AS authenticated FROM E GROUP BY 1")
def a8_source_health(spark, d):
    us, came = micros("event_ts"), micros("ingest_time")
    return derived(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.max(us).alias("last_us"), F.max(came).alias("last_ingest_us"), (F.lit(NOW_US) - F.max(us)).alias("stale_us"), F.max(came - us).alias("lag_us"), F.count("collector_id").alias("authenticated"))


@query("SELECT service, count(*) AS n, count(DISTINCT db_user) AS users, count(DISTINCT person) AS objects, max(us) AS last_us FROM E GROUP BY 1")
def a9_application_activity(spark, d):
    return derived(spark, d).groupBy("service").agg(F.count("*").alias("n"), F.countDistinct(field("db_user")).alias("users"), F.countDistinct(field("target_person")).alias("objects"), F.max(micros("event_ts")).alias("last_us"))


@query("SELECT host, count(*) AS n, count(*) FILTER (us >= 1706572800000000) AS day, min(us) AS first_us, max(us) AS last_us, count(DISTINCT src_ip) AS ips, count(*) FILTER (severity = 'warning') AS warnings FROM E GROUP BY 1")
def a10_host_page(spark, d):
    us = micros("event_ts")
    return derived(spark, d).groupBy("host").agg(F.count("*").alias("n"), F.count_if(us >= NOW_US - DAY_US).alias("day"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.countDistinct(field("src_ip")).alias("ips"), F.count_if(F.col("severity") == "warning").alias("warnings"))


@query("SELECT host, src_ip, n FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, src_ip) AS k FROM (SELECT host, src_ip, count(*) AS n FROM E GROUP BY ALL)) WHERE k <= 15")
def a15_host_baseline(spark, d):
    from pyspark.sql import Window

    counts = derived(spark, d).groupBy("host", field("src_ip").alias("src_ip")).agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "src_ip"))).where("k <= 15").drop("k")


@query("SELECT host, service, source, message, max(us) AS last_us FROM E GROUP BY ALL ORDER BY last_us DESC, message LIMIT 100")
def a16_newest_messages(spark, d):
    return derived(spark, d).groupBy("host", "service", "source", "message").agg(F.max(micros("event_ts")).alias("last_us")).orderBy(F.desc("last_us"), "message").limit(100)


@query("SELECT src_ip, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM E WHERE src_ip IN ('10.0.1.1', '10.0.2.18') GROUP BY 1")
def a17_sightings(spark, d):
    return derived(spark, d).where(field("src_ip").isin("10.0.1.1", "10.0.2.18")).groupBy(field("src_ip").alias("src_ip")).agg(F.count("*").alias("n"), F.min(micros("event_ts")).alias("first_us"), F.max(micros("event_ts")).alias("last_us"))


@query("SELECT DISTINCT us // 86400000000 AS window_no FROM E")
def a20_window_buckets(spark, d):
    return derived(spark, d).select(F.floor(micros("event_ts") / DAY_US).alias("window_no")).distinct()


@query("SELECT db_user AS subject, host, severity, count(*) AS n FROM E GROUP BY GROUPING SETS ((db_user), (host, severity), ())")
def a36_grouping_sets(spark, d):
    e = derived(spark, d).select(field("db_user").alias("subject"), "host", "severity")
    return e.groupingSets([[F.col("subject")], [F.col("host"), F.col("severity")], []], "subject", "host", "severity").agg(F.count("*").alias("n"))


@query("SELECT f.ip AS subject, f.fails, min(e.us) AS success_us, count(*) AS successes FROM E AS e JOIN (SELECT src_ip AS ip, count(*) AS fails, max(event_ts) AS last FROM E WHERE message LIKE 'Failed%' AND event_ts < TIMESTAMP '2024-01-15' GROUP BY 1 HAVING count(*) >= 3) AS f ON e.src_ip = f.ip AND e.event_ts > f.last WHERE e.message LIKE 'Accepted%' GROUP BY ALL")
def j1_brute_then_success(spark, d):
    return correlation.then(derived(spark, d), field("src_ip"), failed() & (F.col("event_ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00'")), accepted(), 3)


IOCS = [("10.0.1.1", "feed-a"), ("10.0.1.1", "feed-b"), ("10.0.3.7", "feed-b")]


@query("SELECT event_id, src_ip, (SELECT min(feed) FROM (VALUES ('10.0.1.1', 'feed-a'), ('10.0.1.1', 'feed-b'), ('10.0.3.7', 'feed-b')) AS v(ip, feed) WHERE ip = src_ip) AS ioc_feed FROM E")
def d43_ioc_tagging(spark, d):
    return relations.tag(derived(spark, d).select("event_id", field("src_ip").alias("src_ip")), spark.createDataFrame(IOCS, "indicator string, feed string"), "src_ip").select("event_id", "src_ip", "ioc_feed")


RANGES = [("10.0.1.0/24", "lab"), ("10.0.2.16/28", "dmz"), ("10.0.2.0/27", "office"), ("10.0.0.8/29", "left"), ("10.0.0.16/28", "right"), ("10.0.3.7", "one")]


# The office's range starts before the dmz's and holds it; left and right border on each other, so left's label stands for both.
@query("SELECT event_id, src_ip, CASE WHEN src_ip LIKE '10.0.1.%' OR regexp_matches(src_ip, '^10\\.0\\.2\\.([0-9]|[12][0-9]|3[01])$') THEN 'lab' WHEN regexp_matches(src_ip, '^10\\.0\\.0\\.([89]|[12][0-9]|3[01])$') THEN 'left' WHEN src_ip = '10.0.3.7' THEN 'one' END AS label FROM E")
def j4_range_join(spark, d):
    return relations.by_range(derived(spark, d).select("event_id", field("src_ip").alias("src_ip")), F.col("src_ip"), spark.createDataFrame(RANGES, "cidr string, label string"))


OBJECTS = "concat('db', event_id % 3, '.public.', CASE event_id % 4 WHEN 0 THEN 'patients' WHEN 1 THEN 'orders' WHEN 2 THEN 'salaries' ELSE 'logs' END)"
CATALOG = [("db0.public.patients", True, 3), ("salaries", True, 4), ("db1.*", False, 1), ("db1.public.*", False, 2)]


@query(f"SELECT object, bool_or(sensitive) AS sensitive, max(rank) AS rank, count(*) AS entries FROM (SELECT DISTINCT {OBJECTS} AS object FROM events) JOIN (VALUES ('db0.public.patients', true, 3), ('salaries', true, 4), ('db1.*', false, 1), ('db1.public.*', false, 2)) AS c(p, sensitive, rank) ON object = p OR split_part(object, '.', 3) = p OR (p LIKE '%.*' AND starts_with(object, p[:-2])) GROUP BY 1")
def d19_classification(spark, d):
    objects = spark.read.parquet(f"{d}/events.parquet").selectExpr(f"{OBJECTS} AS object").distinct()
    return relations.classify(objects, "object", spark.createDataFrame(CATALOG, "pattern string, sensitive boolean, rank int")).where("entries IS NOT NULL")


@query("SELECT host AS name, regexp_extract(host, '(example\\.(?:com|org))$', 1) AS listed FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages) WHERE host LIKE '%.example.com' OR host LIKE '%.example.org'")
def j6_domain_suffix(spark, d):
    names = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("name")).distinct()
    return relations.by_suffix(names, "name", spark.createDataFrame([("example.com",), ("example.org",), ("com",)], "domain string")).where("listed IS NOT NULL")


@query("SELECT event_id, src_ip, true AS private, 167772160 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS number FROM E WHERE severity = 'warning'")
def f19_private_ip(spark, d):
    e = derived(spark, d).where("severity = 'warning'").select("event_id", field("src_ip").alias("src_ip"))
    return e.select("event_id", "src_ip", is_private(F.col("src_ip")).alias("private"), ip_number(F.col("src_ip")).alias("number"))


@query(f"SELECT event_id, host, us FROM E WHERE host IN ('host-1', 'host-2') AND service IN ('sshd') AND {WEEK} AND db_user <> 'u1' ORDER BY us DESC, event_id LIMIT 200")
def f1_structured_filter(spark, d):
    e = correlation.since(derived(spark, d), now(), 168).where(F.col("host").isin("host-1", "host-2") & F.col("service").isin("sshd") & (field("db_user") != "u1"))
    return e.select("event_id", "host", micros("event_ts").alias("us")).orderBy(F.desc("us"), "event_id").limit(200)


@query("SELECT host, count(*) AS n FROM E WHERE source IN ('syslog') GROUP BY 1")
def f9_scoped_sql(spark, d):
    return guard.scoped(spark, "WITH x AS (SELECT host FROM events) SELECT host, count(*) AS n FROM x GROUP BY host", lambda s: derived(s, d), ["syslog"])


def rules():
    return {
        "ssh-failed": ("medium", correlation.selection(message__contains="failed PASSWORD", service="sshd")),
        "sudo-accepted": ("low", correlation.selection(message__startswith="accepted", service=["sudo", "su"])),
        "web-not-host-3": ("informational", correlation.selection(service="web", message__all=["view", "port"]) & ~correlation.selection(host="host-3")),
    }


@query("SELECT event_id, 'ssh-failed' AS rule, 'medium' AS level FROM E WHERE message ILIKE '%failed password%' AND service = 'sshd' UNION ALL SELECT event_id, 'sudo-accepted', 'low' FROM E WHERE message ILIKE 'accepted%' AND service = 'sudo' UNION ALL SELECT event_id, 'web-not-host-3', 'informational' FROM E WHERE service = 'web' AND message LIKE '%view%' AND host <> 'host-3'")
def d37_sigma(spark, d):
    return correlation.sigma(derived(spark, d), rules())


CASES_SQL = "D AS (SELECT host, src_ip, us FROM E WHERE message LIKE 'Failed%'), C0 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY host, src_ip ORDER BY us) <= 172800000000 THEN 0 ELSE 1 END AS o FROM D), C1 AS (SELECT *, sum(o) OVER (PARTITION BY host, src_ip ORDER BY us RANGE UNBOUNDED PRECEDING) AS case_no FROM C0), CASES AS (SELECT host, src_ip, case_no::BIGINT AS case_no, count(*) AS events, min(us) AS opened_us, max(us) AS updated_us FROM C1 GROUP BY ALL)"


def folded(spark, d):
    e = derived(spark, d).where(failed()).select("host", field("src_ip").alias("src_ip"), micros("event_ts").alias("us"))
    return correlation.case_folding(e, ["host", "src_ip"], "us", 2 * DAY_US)


@query(f", {CASES_SQL} SELECT * FROM CASES")
def d38_case_folding(spark, d):
    return folded(spark, d)


@query("SELECT template, substr(sha256(template), 1, 16) AS template_id, count(*) AS n, count(DISTINCT host) AS hosts, min(us) AS first_us, max(us) AS last_us FROM (SELECT *, regexp_replace(regexp_replace(message, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+', '<IP>', 'g'), '[0-9]+', '<N>', 'g') AS template FROM E) GROUP BY ALL")
def d1_templates(spark, d):
    return behaviour.templates(derived(spark, d))


@query("SELECT t AS template, substr(sha256(t), 1, 16) AS template_id, count(*) AS n, count(DISTINCT host) AS hosts, min(us) AS first_us, max(us) AS last_us FROM (SELECT *, service || ' ' || regexp_replace(message, '[0-9.]*[0-9]', '<N>', 'g') AS m, regexp_replace(regexp_replace(message, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+', '<IP>', 'g'), '[0-9]+', '<N>', 'g') AS t FROM E WHERE us >= 1704844800000000) WHERE t NOT IN (SELECT regexp_replace(regexp_replace(message, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+', '<IP>', 'g'), '[0-9]+', '<N>', 'g') FROM E WHERE us < 1704844800000000 AND service = 'web') GROUP BY ALL HAVING count(*) >= 3")
def d2_new_templates(spark, d):
    e, cut = derived(spark, d), F.expr("timestamp_ntz'2024-01-10 00:00:00'")
    return behaviour.new_templates(e.where(F.col("event_ts") >= cut), e.where((F.col("event_ts") < cut) & (F.col("service") == "web")), 3)


BURST_SQL = """, X AS (SELECT host, service, date_diff('day', date_trunc('day', event_ts), TIMESTAMP '2024-01-20') AS ago, count(*) AS n FROM E WHERE event_ts >= TIMESTAMP '2024-01-06 12:00:00' AND event_ts < TIMESTAMP '2024-01-20 13:00:00' AND hour(event_ts) = 12 GROUP BY ALL),
F AS (SELECT host, service, least(14, greatest(0, date_diff('day', date_trunc('day', min(event_ts)), TIMESTAMP '2024-01-20'))) AS days FROM E WHERE event_ts >= TIMESTAMP '2024-01-06 12:00:00' AND event_ts < TIMESTAMP '2024-01-20 13:00:00' GROUP BY ALL),
S AS (SELECT f.host, f.service, x0.n AS now, i, coalesce(x.n, 0) AS n FROM F AS f JOIN X AS x0 ON x0.host = f.host AND x0.service = f.service AND x0.ago = 0 AND x0.n >= 1, unnest(range(1, f.days + 1)) AS r(i) LEFT JOIN X AS x ON x.host = f.host AND x.service = f.service AND x.ago = i WHERE f.days >= 3),
M AS (SELECT host, service, now, median(n) AS med, mad(n) AS mad FROM S GROUP BY ALL)
SELECT host, service, now, med, mad, CASE WHEN now >= 3 * (med + 0.5 * greatest(mad, 1)) THEN 'high' ELSE 'medium' END AS level FROM M WHERE now > med + 0.5 * greatest(mad, 1)"""


@query(BURST_SQL)
def d3_frequency_burst(spark, d):
    return behaviour.bursts(derived(spark, d), F.expr("timestamp_ntz'2024-01-20 12:00:00'"), k=0.5, least=1)


@query("SELECT db_user AS subject, count(*) AS n, max(epoch_us(ingest_time)) AS last_us, (1706659200000000 - max(epoch_us(ingest_time))) // 1000000 AS silent_s, CASE WHEN (1706659200000000 - max(epoch_us(ingest_time))) // 1000000 >= 86400 THEN 'critical' WHEN (1706659200000000 - max(epoch_us(ingest_time))) // 1000000 >= 21600 THEN 'high' ELSE 'medium' END AS level FROM E WHERE us >= 1706659200000000 - 604800000000 GROUP BY 1 HAVING count(*) >= 3 AND (1706659200000000 - max(epoch_us(ingest_time))) // 1000000 > 3600")
def d4_source_silence(spark, d):
    return behaviour.silence(derived(spark, d).withColumn("u", field("db_user")), "u", NOW_US, 3, HOUR_US)


# Each case gets outcome, decision and prediction by rule from its number.
JUDGED_SQL = f", {CASES_SQL}, K AS (SELECT host || '|' || src_ip || '|' || case_no AS case_id, host, opened_us, updated_us, events, (opened_us // 1000000) AS z FROM CASES), T AS (SELECT *, CASE WHEN z % 5 = 0 THEN 'malicious' WHEN z % 3 = 0 THEN 'benign' WHEN z % 2 = 0 THEN 'suspicious' END AS disposition, CASE WHEN z % 5 = 0 THEN 'outcome' WHEN z % 3 = 0 THEN 'decision' WHEN z % 2 = 0 THEN 'prediction' ELSE 'unresolved' END AS basis FROM K)"


def trusted(spark, d):
    c = folded(spark, d).select(F.concat_ws("|", "host", "src_ip", F.col("case_no")).alias("case_id"), "host", "opened_us", "updated_us", "events", F.expr("opened_us div 1000000").alias("z"))
    said = lambda when, *values: c.where(when).select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("id"), (F.col("opened_us") + k).alias("created_us"), F.lit(v).alias("disposition")) for k, v in enumerate(values)])).alias("x")).select("case_id", "x.*")
    return decisions.trust(c, said("z % 5 = 0", "benign", "malicious"), said("z % 3 = 0", "benign"), said("z % 2 = 0", "needs_human", "suspicious"))


@query(f"{JUDGED_SQL} SELECT * FROM T")
def d5_trust(spark, d):
    return trusted(spark, d)


RISK_SQL = f"""{JUDGED_SQL}, G AS (SELECT *, greatest(0.0, ((1706659200000000 - updated_us) // 1000000) / 3600.0) AS age, ['T1110', 'T' || (1000 + z % 3)] AS attack FROM T),
P AS (SELECT trim(host) AS subject, case_id, attack, 8.0 * CASE disposition WHEN 'malicious' THEN 2.0 WHEN 'suspicious' THEN 1.0 WHEN 'benign' THEN 0.0 ELSE 0.5 END * CASE WHEN basis = 'prediction' THEN 0.5 ELSE 1.0 END * pow(0.5, age / 168.0) AS part FROM G WHERE age <= 720),
R AS (SELECT subject, sum(part) AS s, count(*) AS cases, list(case_id ORDER BY part DESC, case_id)[1:5] AS contributors, list_sort(list_distinct(flatten(list(attack)))) AS attack FROM P WHERE part > 0 GROUP BY 1)
SELECT subject, round(s, 6) AS score, cases, array_to_string(contributors, ' ') AS contributors, array_to_string(attack, ' ') AS attack, CASE WHEN s >= 10 THEN 'critical' ELSE 'high' END AS level FROM R WHERE s >= 5"""


@query(RISK_SQL)
def d6_risk(spark, d):
    attack = F.array(F.lit("T1110"), F.concat(F.lit("T"), (1000 + F.expr("opened_us div 1000000") % 3).cast("string")))
    cases = trusted(spark, d).withColumns({"rule": F.lit("ssh-failed"), "level": F.lit("high"), "attack": attack})
    out = decisions.risk(cases, "host", NOW_US, half_life_h=168.0, max_age_h=720.0, threshold=5.0)
    return out.withColumns({"score": F.round("score", 6), "contributors": F.array_join("contributors", " "), "attack": F.array_join("attack", " ")})


ACCESS = ["event_id", "concat('u', user_id) AS db_user", "event_type AS action", f"{OBJECTS} AS object", "user_id % 4 = 0 AS justified", "user_id % 10 = 0 AS approved"]
POLICIES = [
    {"id": "salaries", "effect": "require_justification", "priority": 1, "when": {"object": "salaries"}},
    {"id": "no-delete", "effect": "deny", "priority": 1, "when": {"action": ["error"], "object": "db0.*"}},
    {"id": "watch", "effect": "alert", "priority": 9, "when": {"db_user": ["U1", "u2"]}},
    {"id": "watch-too", "effect": "alert", "priority": 9, "when": {"db_user": ["u2"]}},
    {"id": "patients", "effect": "require_approval", "priority": 5, "when": {"object": "db1.public.patients.*", "action": ["click", "purchase"]}},
    {"id": "more-risk", "effect": "increase_risk", "priority": 2, "when": {"action": ["purchase"]}},
    {"id": "review", "effect": "step_up_review", "priority": 1, "when": {"db_user": ["u2", "u3"], "action": ["view"]}},
]
POLICY_SQL = f"""A AS (SELECT {", ".join(ACCESS)} FROM events), M AS (SELECT *, unnest([
CASE WHEN object LIKE '%.salaries' THEN {{'id': 'salaries', 'rank': CASE WHEN justified THEN 0 ELSE 4 END, 'priority': 1, 'k': 0}} END, CASE WHEN action = 'error' AND object LIKE 'db0.%' THEN {{'id': 'no-delete', 'rank': 6, 'priority': 1, 'k': 1}} END,
CASE WHEN db_user IN ('u1', 'u2') THEN {{'id': 'watch', 'rank': 2, 'priority': 9, 'k': 2}} END, CASE WHEN db_user = 'u2' THEN {{'id': 'watch-too', 'rank': 2, 'priority': 9, 'k': 3}} END,
CASE WHEN object = 'db1.public.patients' AND action IN ('click', 'purchase') THEN {{'id': 'patients', 'rank': CASE WHEN approved THEN 0 ELSE 5 END, 'priority': 5, 'k': 4}} END, CASE WHEN action = 'purchase' THEN {{'id': 'more-risk', 'rank': 1, 'priority': 2, 'k': 5}} END,
CASE WHEN db_user IN ('u2', 'u3') AND action = 'view' THEN {{'id': 'review', 'rank': 3, 'priority': 1, 'k': 6}} END, {{'id': NULL, 'rank': -1, 'priority': 0, 'k': 99}}]) AS m FROM A),
P AS (SELECT event_id, db_user, object, justified, max_by(m.id, m.rank * 1000000 + m.priority * 1000 - m.k) AS policy, ['allow', 'allow', 'increase_risk', 'alert', 'step_up_review', 'require_justification', 'require_approval', 'deny'][max(m.rank) + 2] AS effect,
concat_ws(',', CASE WHEN bool_or(coalesce(m.id = 'patients' AND m.rank = 5, false)) THEN 'approval' END, CASE WHEN bool_or(coalesce(m.id = 'salaries' AND m.rank = 4, false)) THEN 'justification' END) AS missing FROM M WHERE m IS NOT NULL GROUP BY ALL)"""


def decided(spark, d):
    return decisions.policies(spark.read.parquet(f"{d}/events.parquet").selectExpr(*ACCESS), POLICIES)


@query(f", {POLICY_SQL} SELECT event_id, policy, effect, missing FROM P")
def d13_policy_evaluation(spark, d):
    return decided(spark, d).select("event_id", "policy", "effect", "missing")


@query(f", {POLICY_SQL} SELECT effect, count(*) AS n, count(DISTINCT db_user) AS users, count(DISTINCT object) AS objects, count(*) FILTER (justified AND effect NOT IN ('allow', 'increase_risk')) AS likely_false, array_to_string(list(event_id ORDER BY event_id)[1:20], ',') AS samples FROM P GROUP BY 1")
def d14_policy_simulation(spark, d):
    return decisions.simulate(decided(spark, d))


def detectors():
    return {
        "self-access": ("medium", F.substring(field("db_user"), 2, 99) == F.substring(field("target_person"), 2, 99)),
        "watched-subject": ("high", field("target_person").isin("p7", "p13")),
        "missing-justification": ("high", (F.col("service") == "postgres") & (F.coalesce(field("ticket"), F.lit("")) == "")),
        "failed": ("low", failed()),
        "bulk": ("medium", (F.col("service") == "postgres") & (F.col("value") > 80)),
    }


DETECT_SQL = "D AS (SELECT event_id, value, unnest([CASE WHEN substr(db_user, 2) = substr(person, 2) THEN {'d': 'self-access', 'l': 'medium', 'w': 4.0} END, CASE WHEN person IN ('p7', 'p13') THEN {'d': 'watched-subject', 'l': 'high', 'w': 8.0} END, CASE WHEN service = 'postgres' AND coalesce(ticket, '') = '' THEN {'d': 'missing-justification', 'l': 'high', 'w': 8.0} END, CASE WHEN message LIKE 'Failed%' THEN {'d': 'failed', 'l': 'low', 'w': 2.0} END, CASE WHEN service = 'postgres' AND value > 80 THEN {'d': 'bulk', 'l': 'medium', 'w': 4.0} END]) AS x FROM E), H AS (SELECT event_id, x.d AS detector, x.l AS level, x.w AS w FROM D WHERE x IS NOT NULL)"


@query(f", {DETECT_SQL} SELECT event_id, detector, level FROM H")
def d15_access_detectors(spark, d):
    return decisions.detect(derived(spark, d), "event_id", detectors())


D7_SQL = f", {DETECT_SQL}, S AS (SELECT event_id, count(*) AS n, max(w)::DOUBLE * (1 + CASE WHEN event_id % 2 = 0 THEN 0.8 ELSE 0.2 END) * (1 + 0.25 * (count(*) - 1)) AS s, max(CASE l WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END) AS f FROM (SELECT event_id, detector, level AS l, w FROM H) GROUP BY 1), B AS (SELECT *, CASE WHEN s >= 13 THEN 4 WHEN s >= 8 THEN 3 WHEN s >= 4 THEN 2 WHEN s >= 2 THEN 1 ELSE 0 END AS b FROM S)"
NAMES_SQL = "['informational', 'low', 'medium', 'high', 'critical']"


def signals(spark, d):
    crit = decisions.classification_criticality(F.when(F.col("event_id") % 2 == 0, "restricted").otherwise("internal"))
    return decisions.detect(derived(spark, d), "event_id", detectors()).withColumn("criticality", crit)


@query(f"{D7_SQL} SELECT event_id, n, round(s, 6) AS score, {NAMES_SQL}[b + 1] AS band, {NAMES_SQL}[greatest(b, f) + 1] AS level FROM B")
def d7_ensemble_score(spark, d):
    return decisions.ensemble(signals(spark, d), "event_id").withColumn("score", F.round("score", 6))


@query(f""", {DETECT_SQL}, X AS (SELECT *, CASE WHEN detector = 'watched-subject' THEN detector END AS own, CASE WHEN event_id % 2 = 0 THEN 0.8 ELSE 0.2 END AS c, CASE level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END AS f FROM H),
S AS (SELECT event_id, own, count(*) AS n, max(w)::DOUBLE * (1 + max(c)) * (1 + 0.25 * (count(*) - 1)) AS s, max(f) AS f, array_to_string(list_sort(list_distinct(list(CASE WHEN detector = 'failed' THEN 'T1110' ELSE 'T1213' END))), ' ') AS attack FROM X GROUP BY ALL), B AS (SELECT *, CASE WHEN s >= 13 THEN 4 WHEN s >= 8 THEN 3 WHEN s >= 4 THEN 2 WHEN s >= 2 THEN 1 ELSE 0 END AS b FROM S)
SELECT event_id, coalesce(own, 'combined-' || {NAMES_SQL}[b + 1]) AS detector, n, round(s, 6) AS score, {NAMES_SQL}[greatest(b, f) + 1] AS level, attack FROM B""")
def d8_signal_fusion(spark, d):
    given = signals(spark, d).withColumn("attack", F.array(F.when(F.col("detector") == "failed", "T1110").otherwise("T1213")))
    return decisions.fuse_findings(given, "event_id", ["watched-subject"]).withColumns({"score": F.round("score", 6), "attack": F.array_join("attack", " ")})


@query("SELECT *, round(CASE WHEN mad > 0 THEN (top - median) / (1.4826 * mad) WHEN sd > 0 THEN (top - mean) / sd WHEN top > median THEN 'inf'::DOUBLE ELSE 0 END, 6) AS upper_z FROM (SELECT db_user AS subject, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(median(value), 9) AS median, round(mad(value), 9) AS mad, max(value) AS top FROM E GROUP BY 1)")
def a26_numeric_baseline(spark, d):
    out = behaviour.numeric_baseline(derived(spark, d).select(field("db_user").alias("subject"), "value"), "subject", "value")
    return out.select("subject", "n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "median", "mad")], "top", F.round("upper_z", 6).alias("upper_z"))


@query(", C AS (SELECT host AS subject, hour(event_ts) AS hour, count(*) AS n FROM E GROUP BY ALL), T AS (SELECT subject, max(n) AS peak FROM C GROUP BY 1 HAVING sum(n) >= 20) SELECT t.subject, h.i::INTEGER AS hour, coalesce(c.n, 0) AS n FROM T AS t, range(24) AS h(i) LEFT JOIN C AS c ON c.subject = t.subject AND c.hour = h.i WHERE coalesce(c.n, 0) = 0 OR c.n < 0.5 * t.peak")
def a25_rare_hours(spark, d):
    return behaviour.rare_hours(derived(spark, d), F.col("host"), share=0.5)


@query(", X AS (SELECT DISTINCT db_user AS actor, person, us FROM E), Y AS (SELECT a.actor, a.us, count(DISTINCT b.person) AS n FROM X AS a JOIN X AS b ON a.actor = b.actor AND b.us BETWEEN a.us - 604800000000 AND a.us GROUP BY ALL) SELECT actor, max(n)::BIGINT AS most, min(us) AS first_us FROM Y WHERE n >= 5 GROUP BY 1")
def w3_sliding_distinct(spark, d):
    e = derived(spark, d).select(field("db_user").alias("actor"), field("target_person").alias("person"), micros("event_ts").alias("us"))
    return behaviour.sliding_distinct(e, "actor", "person", "us", 7 * DAY_US, 5)


@query(", X AS (SELECT db_user AS actor, us, sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS s, count(*) OVER w AS n FROM E WINDOW w AS (PARTITION BY db_user ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)) SELECT actor, max(s)::BIGINT AS most, min(us) AS first_us FROM X WHERE s >= 10000 AND n >= 2 GROUP BY 1")
def w4_sliding_sum(spark, d):
    e = derived(spark, d).select(field("db_user").alias("actor"), F.floor(F.col("value") * 100).alias("rows"), micros("event_ts").alias("us"))
    return behaviour.sliding_sum(e, "actor", "rows", "us", DAY_US, 10_000, 2)


@query(", X AS (SELECT o_custkey AS actor, o_orderkey AS number, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS k, o_custkey % 20 AS g FROM orders WHERE o_orderstatus <> 'F') SELECT g AS actor, count(*) AS length, min(number) AS first, max(number) AS last FROM X GROUP BY g, number - k HAVING count(*) >= 2")
def w5_enumeration_runs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'F'").select((F.col("o_custkey") % 20).alias("actor"), F.col("o_orderkey").alias("number"))
    return behaviour.runs(o, ["actor"], "number", ["number"], 2)


@query(""", R AS (SELECT event_id AS seq, sha256(concat_ws('|', event_id, props)) AS own FROM events), C AS (SELECT r.seq, r.own, CASE WHEN r.seq % 1000 = 7 THEN 'broken' ELSE b.own END AS prev FROM R AS r LEFT JOIN R AS b ON b.seq = r.seq - 1 WHERE r.seq % 500 <> 11)
SELECT seq, fault FROM (SELECT c.seq, CASE WHEN c.seq > 1 AND b.own IS NULL THEN 'gap' WHEN c.seq > 1 AND b.own <> c.prev THEN 'link' END AS fault FROM C AS c LEFT JOIN C AS b ON b.seq = c.seq - 1) WHERE fault IS NOT NULL""")
def w9_chain_verification(spark, d):
    """A chain of which every 500th record is taken out and every 1000th names another record before it than there is."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.sha2(F.concat_ws("|", "event_id", "props"), 256).alias("own"))
    before = e.select((F.col("seq") + 1).alias("seq"), F.col("own").alias("prev"))
    chain = e.join(before, "seq", "left").withColumn("prev", F.when(F.col("seq") % 1000 == 7, "broken").otherwise(F.col("prev"))).where("seq % 500 <> 11")
    return behaviour.chain_faults(chain, "seq", "prev", "own")


@query("SELECT source FROM E INTERSECT SELECT source FROM E WHERE service = 'sshd' UNION ALL (SELECT host FROM E EXCEPT SELECT host FROM E WHERE host LIKE '%1%')")
def u4_set_operations(spark, d):
    """Each side is made distinct before it is compared, so that a task gets a value once and not all of its rows."""
    e = derived(spark, d)
    of = lambda df, c: df.select(c).distinct()
    return of(e, "source").intersect(of(e.where("service = 'sshd'"), "source")).unionAll(of(e, "host").subtract(of(e.where("host LIKE '%1%'"), "host")))


EDGES_SQL = "G AS (SELECT least(a, b) AS a, greatest(a, b) AS b, label FROM (SELECT 'host:' || host AS a, 'ip:' || src_ip AS b, 'seen' AS label FROM E UNION ALL SELECT 'host:' || host, 'user:' || db_user, 'login' FROM E UNION ALL SELECT 'ip:' || src_ip, 'user:' || db_user, 'from' FROM E UNION ALL SELECT 'user:' || db_user, 'person:' || person, 'looked_up' FROM E WHERE service = 'postgres')), EDGES AS (SELECT a, b, max(label) AS label, count(*) AS n FROM G GROUP BY ALL)"


@query(f", {EDGES_SQL} SELECT * FROM EDGES")
def d25_entity_graph(spark, d):
    return relations.edges(derived(spark, d))


PIVOT_SQL = f"""{EDGES_SQL}, N AS (SELECT a, b FROM EDGES WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT b, a FROM EDGES WHERE a IS NOT NULL AND b IS NOT NULL),
H0 AS (SELECT 'user:u1' AS node, 0 AS hops, NULL::VARCHAR AS via), H1 AS (SELECT b AS node, 1 AS hops, min(a) AS via FROM N JOIN H0 ON a = node WHERE b NOT IN (SELECT node FROM H0) GROUP BY b), S1 AS (SELECT * FROM H0 UNION ALL SELECT * FROM H1),
H2 AS (SELECT b AS node, 2 AS hops, min(a) AS via FROM N JOIN H1 ON a = node WHERE b NOT IN (SELECT node FROM S1) GROUP BY b), S2 AS (SELECT * FROM S1 UNION ALL SELECT * FROM H2),
H3 AS (SELECT b AS node, 3 AS hops, min(a) AS via FROM N JOIN H2 ON a = node WHERE b NOT IN (SELECT node FROM S2) GROUP BY b), SEEN AS (SELECT * FROM S2 UNION ALL SELECT * FROM H3)"""


@query(f", {PIVOT_SQL} SELECT * FROM SEEN")
def d26_pivot(spark, d):
    links = relations.edges(derived(spark, d))
    return relations.pivot(links, spark.createDataFrame([("user:u1",)], "node string"), 3)


@query("SELECT event_id, fate FROM (SELECT event_id, CASE WHEN source = 'pgaudit' THEN 'keep' WHEN us < CASE WHEN source = 'syslog' THEN 1705276800000000 ELSE 1704844800000000 END THEN 'expire' WHEN host = 'host-5' AND us >= 1705276800000000 AND us < 1706140800000000 THEN 'erase' ELSE 'keep' END AS fate FROM E) WHERE fate <> 'keep'")
def d30_retention(spark, d):
    e = derived(spark, d).select("event_id", "source", "host", micros("event_ts").alias("us"))
    out = relations.pruned(e, "us", [("syslog", 1705276800000000)], 1704844800000000, ["pgaudit"], [("host-5", 1705276800000000, 1706140800000000)])
    return out.where("fate <> 'keep'").select("event_id", "fate")


TERMS = ("the", "with", "rest")
BM25_SQL = "WITH W AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents), S AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM W), T AS (SELECT id, len(w) AS n, t, len(list_filter(w, lambda x: x = t)) AS tf FROM W, (VALUES ('the'), ('with'), ('rest')) AS q(t)), I AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM T GROUP BY 1) SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM T JOIN I USING (t), S GROUP BY 1 HAVING sum(tf) > 0"


@query(None)
def d23_bm25(spark, d):
    return relations.bm25(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", list(TERMS)).withColumn("score", F.round("score", 6))


ORACLES["d23_bm25"] = BM25_SQL
NEAREST_SQL = "SELECT probe, place, id, round(c, 5) AS cosine FROM (SELECT p.vec_id AS probe, v.vec_id AS id, list_cosine_similarity(p.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_cosine_similarity(p.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id)::INTEGER AS place FROM embeddings AS p JOIN embeddings AS v ON p.vec_id <> v.vec_id WHERE p.vec_id % 100 = 0) WHERE place <= 10"


@query(None)
def d24_nearest_vectors(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return relations.nearest(v, v.where("vec_id % 100 = 0"), 10).withColumn("cosine", F.round("cosine", 5))


ORACLES["d24_nearest_vectors"] = NEAREST_SQL


@query("SELECT event_id, CASE WHEN us <= a THEN 'train' WHEN us <= b THEN 'valid' ELSE 'test' END AS part FROM E, (SELECT floor(quantile_cont(us, 0.7))::BIGINT AS a, floor(quantile_cont(us, 0.85))::BIGINT AS b FROM E)")
def d34_temporal_split(spark, d):
    return decisions.temporal_split(derived(spark, d).select("event_id", micros("event_ts").alias("us")), "us").select("event_id", "part")


CONFUSION_SQL = "X AS (SELECT event_id, (severity = 'warning')::INT AS t, (value > 50)::INT AS a, value / 100 AS s FROM E)"


@query(f""", {CONFUSION_SQL}, C AS (SELECT count(*) AS rows, sum(t * a)::BIGINT AS tp, sum((1 - t) * a)::BIGINT AS fp, sum(t * (1 - a))::BIGINT AS fn, sum((1 - t) * (1 - a))::BIGINT AS tn, round(avg(pow(least(s, 1.0) - t, 2)), 6) AS brier FROM X)
SELECT *, (SELECT round(coalesce(avg(t), 0), 9) FROM (SELECT t FROM X WHERE a = 1 ORDER BY s DESC, event_id LIMIT 100)) AS precision_at_budget, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall FROM C""")
def a27_confusion(spark, d):
    out = decisions.confusion(derived(spark, d), F.col("severity") == "warning", F.col("value") > 50, F.col("value") / 100, 100, "event_id")
    return out.select("rows", "tp", "fp", "fn", "tn", F.round("brier", 6).alias("brier"), *[F.round(c, 9).alias(c) for c in ("precision_at_budget", "precision", "recall")])


LINES = "CASE WHEN event_id % 2 = 0 THEN concat('<34>1 2024-01-02T03:04:05Z ', host, ' ', service, ' ', event_id, ' - - ', message) ELSE concat('<13>Jan  2 03:04:05 ', host, ' ', service, '[', event_id, ']: ', message) END AS line"


@query("SELECT 1704164645000000 AS us, host, service, CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE 'notice' END AS severity, CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'system' END AS log_type, message, '{\"pid\":\"' || event_id || '\"}' AS fields FROM E")
def s7_syslog(spark, d):
    return parsers.syslog(derived(spark, d).selectExpr(LINES)).select(micros("event_ts").alias("us"), "host", "service", "severity", "log_type", "message", "fields")


@query("SELECT event_id, src_ip, db_user AS usr, regexp_extract(message, 'port ([0-9]+)', 1)::INT AS port FROM E WHERE message LIKE '%password for user%'")
def s20_field_extraction(spark, d):
    e = derived(spark, d).where("message LIKE '%password for user%'")
    return e.select("event_id", parsers.src_ip(F.col("message")).alias("src_ip"), parsers.user(F.col("message")).alias("usr"), parsers.port(F.col("message")).alias("port"))


@query("SELECT DISTINCT 'sql1:' || substr(sha256('select * from t where id = ? and name = ?'), 1, 32) AS print FROM E")
def d12_fingerprint(spark, d):
    return derived(spark, d).select(fingerprint(F.concat(F.lit("SELECT *  FROM t\nWHERE id = "), F.col("event_id"), F.lit(" AND name = 'it''s "), F.col("host"), F.lit("';"))).alias("print")).distinct()


@query("SELECT k.n_name AS nation, count(*) AS orders, round(sum(l.revenue), 2) AS revenue FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1) AS l JOIN orders AS o ON o.o_orderkey = l.l_orderkey JOIN customer AS c ON c.c_custkey = o.o_custkey JOIN nation AS k ON k.n_nationkey = c.c_nationkey GROUP BY 1")
def j16_joins(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    revenue = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    j = revenue.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("revenue"), 2).alias("revenue"))


from emberlake import catalog_depth, catalog_more  # noqa: E402, F401  their queries join these
