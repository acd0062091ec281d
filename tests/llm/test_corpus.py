"""Operators that compare rows: near-duplicates, lines, benchmark, URLs, archives, and the pipeline."""

import random
from itertools import combinations

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from emberlake.llm import common, decontaminate, linededup, neardup, queries, urls, warc

SF = "/root/testdata/sf0.01"


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    want = brute.reachable({x for p in pairs for x in p if p[0] != p[1]}, [p for p in pairs if p[0] != p[1]])
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, width=width).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == brute.near(rows, width)
    assert all(got[i]["n_shingles"] == len(brute.shingles(t, width)) and got[i]["kept"] == (got[i]["component_id"] == i) for i, t in rows)


def test_chains_of_near_copies(spark):
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(12):
            rows.append((n, " ".join(words)))
            n += 1
            words = list(words)
            for _ in range(2):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute.near(rows, 4)


def test_near_duplicates_of_odd_rows(odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()), key=repr)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [x for x in got if x[0] in (5, 6)] == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert [x for x in got if x[0] is None] == [(None, 0, None, True), (None, 1, None, True)]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 0 and kept.count() == odd.count() - 1


def char_sets(lines):
    return {x: {x[i : i + linededup.EXACT] for i in range(max(1, len(x) - linededup.EXACT + 1))} for x in lines}


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    texts = []
    base = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(14)) for _ in range(25)]
    for _ in range(60):
        lines = [rng.choice(base) for _ in range(4)] + [" ".join(str(rng.random())[2:9] for _ in range(6))]
        texts.append("\n".join((x[:30] + rng.choice("xyz") + x[31:]) if rng.random() < 0.4 else x for x in lines) + "\nshort\n")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = [(d, i, x.strip(" ").lower()) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]
    sets = char_sets({p[2] for p in places})
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])]
    group = brute.reachable(sets, links)
    first = {}
    for d, i, x in sorted(places):
        first.setdefault(group[x], (d, i))
    want = {(d, i) for d, i, x in places if first[group[x]] != (d, i)}
    got = {(r["doc"], i) for r in linededup.dropped(df).collect() for i in r["gone"]}
    assert len(got ^ want) <= 0.01 * len(want) and got <= want  # banding may miss a link near the threshold
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert all(out[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got) for d, t in enumerate(texts))


def test_lines_of_odd_rows(odd, spark):
    out = linededup.dedup_lines(odd)
    # Rows that share an id tie and stay; the other document's equal line goes.
    want = [r.asDict() | ({"text": ""} if r["doc_id"] == 6 else {}) for r in odd.collect()]
    assert sorted(repr(r.asDict()) for r in out.select(*odd.columns).collect()) == sorted(map(repr, want))
    clash = odd.select("doc_id", "text", *[F.col("n").alias(c) for c in ("doc", "i", "gone", "_l", "lines", "row", "own", "id", "new", "split", "key", "component", "a.b")])
    kept = linededup.keep_rest(clash)
    assert kept.columns == clash.columns and kept.count() == odd.count() - 1 and kept.where("gone IS NULL OR lines <> id").count() == 0
    assert linededup.dedup_lines(odd.limit(0)).count() == 0
    line = "this is a line of a licence that repeats"
    rows = [(1, f"{line}\nunique words of the first document here"), (2, f"{line}\n  {line.upper()} \nanother unique text of the second one"), (3, line)]
    got = {r["doc_id"]: r["text"] for r in linededup.keep_rest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "another unique text of the second one"}


def test_a_document_with_any_line_left_stays(spark):
    line = "this is a line of a licence that repeats and is long enough to be most of its document"
    rows = [(1, line), (2, f"{line}\nfound nowhere else here"), (3, f"{line}\nshort"), (4, f"{line}\n\n \t"), (5, f"\n{line}")]
    got = {r["doc_id"]: r["text"] for r in linededup.keep_rest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: line, 2: "found nowhere else here", 3: "short"}


def test_a_large_group_of_variants_equals_brute_force(spark):
    """Variants of one line, some too far from it to be linked: no pair of them is compared in full, and no link is lost."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(3, 8)))
    base = [word() for _ in range(30)]
    rows = [(0, " ".join(base))]
    for k in range(1, 160):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
        if rng.random() < 0.2:  # a copy of a variant, with one more change
            w[rng.randrange(len(w))] = word()
            rows.append((1000 + k, " ".join(w)))
    sets = char_sets({t for _, t in rows})
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])]
    group = brute.reachable(sets, links)
    first = {}
    for d, t in sorted(rows):
        first.setdefault(group[t], d)
    got = {r["doc"] for r in linededup.dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d for d, t in rows if first[group[t]] != d}


def test_lines_that_differ_anywhere_in_a_long_word_meet(spark):
    rng = random.Random(12)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pairs = []
    for _ in range(30):
        for x, y in (("version 10.4.2-build-", "version 11.4.2-build-"), ("see https://", "see httpz://"), ("1. https://", "2. https://")):
            tail = made("abcdef0123456789", 60)
            pairs.append((x + tail, y + tail))
        one = made([chr(c) for c in range(0x4E00, 0x5E00)], 60)
        pairs.append((f"{one[:30]} {one[30:]}", f"{one[:20]}一{one[21:30]} {one[30:]}"))
    pairs.append(("-" * 25, "-" * 70))
    sets = char_sets({x for p in pairs for x in p})
    assert all(len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) for a, b in pairs)
    df = spark.createDataFrame(list(enumerate(x for p in pairs for x in p)), "doc_id long, text string")
    assert {r["doc"] for r in linededup.dropped(df).collect()} == {2 * k + 1 for k in range(len(pairs))}


def test_masks_meet_every_window():
    w, span = decontaminate.WINDOW, range(decontaminate.WINDOW)
    for off in combinations(span, decontaminate.SUBSTITUTED):
        assert any(not {s + i for i in m} & set(off) for m in decontaminate.MASKS for s in range(w - m[-1])), off
    for n in range(decontaminate.SHORTEST, w):  # one token may differ; shorter items are seeds as a whole
        for off in range(n):
            assert any(off not in {s + i for i in m} for m in decontaminate.MASKS for s in range(n - m[-1]))


def test_decontamination_equals_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found and {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench, broadcast_seeds=0).collect()} == found
    # Brute force over the documents that share any four tokens in a row with an item: fewer can't be within the bounds.
    items = {r["item_id"]: brute.tokens(r["text"]) for r in bench.collect()}
    grams = {}
    for k, t in items.items():
        for i in range(len(t) - 3):
            grams.setdefault(tuple(t[i : i + 4]), set()).add(k)
    want = set()
    for d, text in docs.collect():
        t = brute.tokens(text)
        near = {k for i in range(len(t) - 3) for k in grams.get(tuple(t[i : i + 4]), ())}
        want |= {(d, k) for k in near if brute.contained(t, items[k])}
    assert found == want
    clean = {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == {d for d, _ in docs.collect()} - {d for d, _ in want}


def test_decontamination_tolerates_substitutions(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(7, item), (8, "quite short"), (9, None), (10, "what is the sum of it")], "item_id long, text string")
    words = item.split()
    rows = [(1, "before " + item + " after"), (2, " ".join("x" if i in (3, 8) else w for i, w in enumerate(words))), (3, " ".join("x" if i % 4 == 1 else w for i, w in enumerate(words))), (4, None), (None, item.upper()), (5, "quite a short one"), (6, "Quite short!"), (8, "a question: what is the sum of it, then? what is a sum of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.overlaps(docs, bench).collect()) == [(0, 7), (1, 7), (2, 7), (6, 8), (8, 10)]
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.overlaps(docs, bench, broadcast_seeds=0).collect()) == [(0, 7), (1, 7), (2, 7), (6, 8), (8, 10)]
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("_key", "doc_key", "row", "seed", "item_key", "_t")])
    clean = decontaminate.keep_clean(clash, bench)
    assert clean.columns == clash.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5]
    assert decontaminate.overlaps(docs.limit(0), bench).count() == decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_urls_by_hand(spark):
    entries = [("bad.example.org", "spam", 10, "add"), ("bad.example.org", "spam", 20, "remove"), ("example.org", "parked", 15, "add"), ("bad.example.org/ok", "allow", 0, "add"), (None, "spam", 0, "add"), ("x.org", None, 0, "add"), ("x.org", "spam", None, "add"), ("tie.org", "spam", 5, "add"), ("tie.org", "spam", 5, "remove")]
    captures = [(1, "http://u@BAD.example.org:80/x", 9), (2, "http://bad.example.org/x", 10), (3, "http://bad.example.org/x", 20), (4, "http://bad.example.org/ok/p?q", 12), (5, "http://x.org/", 9), (6, None, 9), (7, "", 9), (8, "http://bad.example.org", None), (9, "http://tie.org", 9), (None, "http://bad.example.org", 11), (2, "http://bad.example.org/x", 10)]
    listed = spark.createDataFrame(entries, "pattern string, category string, at long, action string")
    df = spark.createDataFrame(captures, "page_id long, url string, fetched long").withColumn("pattern", F.lit("clash"))
    got = sorted(((r["page_id"] or 0, r["kept"], r["n_active"], r["category"]) for r in urls.judge(df, listed).collect()), key=repr)
    assert got == sorted([(1, True, 0, None), (2, False, 1, "spam"), (2, False, 1, "spam"), (3, False, 1, "parked"), (4, True, 2, "allow"), (5, True, 0, None), (6, True, 0, None), (7, True, 0, None), (8, True, 0, None), (9, True, 0, None), (0, False, 1, "spam")], key=repr)
    assert sorted(map(repr, urls.judge(df, listed, broadcast_intervals=0).collect())) == sorted(map(repr, urls.judge(df, listed).collect()))
    assert urls.keep_allowed(df, listed).columns == df.columns and urls.keep_allowed(df, listed).count() == 7
    assert urls.judge(df.limit(0), listed).count() == 0 and urls.judge(df, listed.limit(0)).where("kept").count() == 11


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = sorted((tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, SF).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/", big), (3, "http://b/\r\n", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "é" * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.archived(df).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None), 7: ("response", None)}
    assert bytes(got[7]["payload"]).decode() == rows[7][2] and got[1]["payload_bytes"] == 1500 and got[7]["payload_bytes"] == 140_000
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_reader_rejects_damage():
    import io
    import zlib

    def packed(body, digest):
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        head = f"WARC/1.1\r\nWARC-Type: response\r\nX-Source-Id: 1\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\n"
        return pack.compress(head.encode() + body + b"\r\n\r\n") + pack.flush()

    good = packed(b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d")
    assert [warc.parse(m)["payload"] for m in warc.members(io.BytesIO(good * 3), 7)] == [b"abc"] * 3
    for bad in (packed(b"abd", "a9993e364706816aba3e25717850c26c9cd0d89d"), packed(b"ab", "x")):
        with pytest.raises(ValueError):
            [warc.parse(m) for m in warc.members(io.BytesIO(bad))]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good[:-9])))


def test_pipeline_stages(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{at}/documents.parquet")
    docs, seen = given, []
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, at))
        ids, before = {r["doc_id"] for r in out.select("doc_id").collect()}, {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= before, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == given.columns
        seen.append(len(ids))
        docs = out
    assert seen[0] < given.count() and seen[-1] == seen[-2]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, at).select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_lines_are_compared_by_hashed_shingles_without_maps_where_sizes_do(spark):
    texts = ["abcdefgh", "abcdefgx", "na na na na na", "éàü𝒳yz¡", "abc"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "line string").select(F.size(linededup.shingles(F.col("line")))).collect()]
    assert got == [len({x[i : i + 5] for i in range(max(1, len(x) - 4))}) for x in texts]
    docs = spark.createDataFrame([(1, "abcdefgh\nabcdefgx")], "doc_id long, text string")
    a = {r["line"]: r["a"] for r in linededup.lines(docs, "doc_id", "text").collect()}
    pairs = common.cut(spark.createDataFrame([(a["abcdefgh"], a["abcdefgx"])], "x long, y long"))
    (rel,) = [r["rel"].asDict() for r in linededup.compared(pairs, docs, "doc_id", "text", maps=False).collect()]
    assert rel == {"n": 4, "n_hub": 4, "both": 3}
    assert {type(k) for r in linededup.signatures(linededup.lines(docs, "doc_id", "text")).collect() for k in r["keys"]} == {int}
    assert dict(linededup.signatures(linededup.lines(docs, "doc_id", "text")).dtypes)["keys"] == "array<int>"


def test_signatures_take_every_shingle_by_code_that_the_jvm_compiles(spark):
    import re

    rows = [("".join(chr(97 + (7 * n + k * k) % 23) for k in range(n)),) for n in range(1, 4 * linededup.BLOCK)] + [("ñandú 𝔘nd " * 9,)]
    docs = spark.createDataFrame([(1, "\n".join(r[0] for r in rows))], "doc_id long, text string")
    found = linededup.lines(docs, "doc_id", "text")
    got = {r["a"]: (r["bits"], r["keys"]) for r in linededup.signatures(found).collect()}
    # Signed numbers of 64 bits, by a hash of each shingle.
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    turn = lambda h, r: (h << 8 * r | h % (1 << 64) >> 64 - 8 * r) if r else h
    for r in found.select("a", linededup.shingles(F.col("line")).alias("set")).collect():
        minima = [min(signed(turn(h, k % linededup.ROTATIONS)) ^ m for h in r["set"]) for k, m in enumerate(linededup.MASKS)]
        bits = [signed(sum((m & 15) << 4 * k for k, m in enumerate(minima[16 * n : 16 * n + 16]))) for n in range(linededup.LONGS)]
        assert got.pop(r["a"])[0] == bits
    assert not got
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        code = linededup.signatures(found)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) <= 8000  # a longer method is interpreted
