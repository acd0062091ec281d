"""Manifest, fingerprints and divergence, against plain Python versions and SQL; repeated tokens; names with dots."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberlake.llm import audits, bpe, decontaminate, divergence, fingerprints, merkle, neardup, quality, queries
from emberlake.llm.html import main_text

SMALL = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(audits.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = audits.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(audits.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr) == sorted(([plain(v) for v in r] for r in want.fetchall()), key=repr)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def proof(tree, k):
    path = []
    for row in tree[:-1]:
        run = row[k - k % 3 : k - k % 3 + 3]
        path.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        k //= 3
    return path


def manifest(rows):
    """(part, id, leaf) -> subroot, root and path, by whole trees in memory."""
    parts = {}
    for part, i, leaf in rows:
        parts.setdefault(part, []).append((i is not None, i or 0, leaf))
    order = sorted(parts, key=lambda p: (p is not None, p or ""))
    trees = {p: levels([leaf for _, _, leaf in sorted(parts[p])]) for p in order}
    top = levels([trees[p][-1][0] for p in order])
    out = []
    for n, p in enumerate(order):
        for k, (known, i, leaf) in enumerate(sorted(parts[p])):
            steps = proof(trees[p], k) + proof(top, n)
            out.append((p, i if known else None, leaf, trees[p][-1][0], top[-1][0], [f"{a}*{b}" for a, b in steps]))
    return sorted(out, key=repr)


def made(spark, rows, leaves):
    df = spark.createDataFrame([(p, i, f"t{n}") for n, (p, i) in enumerate(rows)], "source string, doc_id long, text string")
    leaf = F.sha2(merkle.encoded(F.col("source"), F.col("doc_id"), F.col("text")), 256)
    got = merkle.manifest(df, leaf, F.upper("text"), leaves=leaves).collect()
    want = manifest([(r["part"], r["id"], r["leaf"]) for r in got])
    assert sorted(((r["part"], r["id"], r["leaf"], r["subroot"], r["root"], r["path"]) for r in got), key=repr) == want
    return got


@pytest.mark.parametrize("leaves", [4, 11, 1000])
def test_manifest_over_ragged_ranges(spark, leaves):
    rng = random.Random(leaves)
    rows = [("hot", k) for k in rng.sample(range(10**6), 260)] + [(rng.choice(["a", "ü", "\U0001f600", "￮", "", None]), rng.randrange(40)) for _ in range(90)] + [(f"one{k}", 1) for k in range(30)]
    got = made(spark, rows, leaves)
    assert len(got) == len(rows) and {r["carried"] for r in got} == {f"T{n}" for n in range(len(rows))}
    df = spark.createDataFrame(got).select("leaf", "root", merkle.folded(F.col("leaf"), F.col("path")).alias("up"), merkle.siblings(F.col("path")).alias("s"))
    assert df.where("up <> root").count() == 0


def test_manifest_of_few_and_odd_rows(spark, odd):
    one = made(spark, [("s", 5)], 10)
    assert one[0]["root"] == one[0]["leaf"] == one[0]["subroot"] and one[0]["path"] == []
    assert len(made(spark, [(None, None), (None, 3), (None, None)], 1)) == 3
    leaf = F.sha2(merkle.encoded(F.col("doc_id"), F.col("text"), F.col("_t")), 256)
    got = merkle.manifest(odd, leaf, part_col="lang", leaves=2)
    assert got.count() == odd.count() and got.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert merkle.manifest(odd.limit(0), leaf, part_col="lang").count() == 0
    coded = spark.createDataFrame([(None, "", "aß")], "a string, b string, c string").select(merkle.encoded(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert coded == "-0:3:aß"


def test_tampered_rows_are_found(spark):
    rows = audits.op11_merkle_manifest(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in r["text"]
        assert r["verified"] != tampered and (r["folded_root"] == r["root"]) == r["verified"]
    assert {r["verified"] for r in rows} == {True, False}


def pieces(text):
    return {x for x in re.split(r"\n+|(?<=[.!?])\s+", text) if x.strip(" ")}


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_sets_of_paragraphs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in audits.op12_document_fingerprints(spark, SMALL).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), digest(new))
        assert abs(r["near_edited"] - likeness(text, new)) < 1e-9 and abs(r["near_next"] - likeness(text, after)) < 1e-9
    assert len({r["fingerprint"] for r in got.values()}) == len({frozenset(pieces(t)) for t in texts.values()})


def test_differences_of_any_size(spark):
    rng = random.Random(3)
    sets = []
    for common, x, y in ((0, 0, 0), (5, 0, 0), (4000, 1, 2), (10, 7, 0), (0, 40, 3), (300, 500, 700), (0, 3000, 0)):
        ids = sorted({rng.getrandbits(64) - 2**63 for _ in range(common + x + y)}, key=lambda v: v * 7 % 1009)
        sets.append((ids[: common + x], ids[:common] + ids[common + x :]))
    df = spark.createDataFrame(sets, "x array<long>, y array<long>")
    cells, seed = F.lit(fingerprints.CELLS), F.lit(0)
    out = df.withColumn("d", fingerprints.difference(F.col("x"), F.col("y"), fingerprints.sketch(F.col("x"), cells, seed), fingerprints.sketch(F.col("y"), cells, seed)))
    for r in out.collect():
        assert (sorted(r["d"]["here"]), sorted(r["d"]["there"])) == (sorted(set(r["x"]) - set(r["y"])), sorted(set(r["y"]) - set(r["x"])))


def test_small_differences_are_told_by_the_fingerprint_alone(spark):
    rng = random.Random(4)
    common = sorted({rng.getrandbits(62) for _ in range(5000)})
    df = spark.createDataFrame([([*common, 1, 2, 3], [*common, 4, 5])], "x array<long>, y array<long>")
    cells, seed = F.lit(fingerprints.CELLS), F.lit(0)
    told = fingerprints.peeled(fingerprints.minus(fingerprints.sketch(F.col("x"), cells, seed), fingerprints.sketch(F.col("y"), cells, seed)), cells, seed)
    r = df.select(told.alias("d")).first()["d"]
    assert (sorted(r["here"]), sorted(r["there"])) == ([1, 2, 3], [4, 5])


def test_fingerprints_of_odd_rows(spark, odd):
    got = fingerprints.fingerprints(odd)
    assert got.count() == odd.count() and fingerprints.fingerprints(odd.limit(0)).count() == 0
    rows = {(r["doc_id"], r["n_chars"]): r for r in got.collect()}
    assert rows[5, 7]["fingerprint"] == rows[6, 7]["fingerprint"] == rows[None, 7]["fingerprint"] and rows[6, 7]["near_next"] == 1.0
    assert rows[2, 0]["edited"] == "" and rows[2, 0]["near_edited"] == 1.0
    assert rows[6, 7]["edited"] == "one one"  # its last three characters give way to the first of document 5
    alone = fingerprints.fingerprints(spark.createDataFrame([(1, "a. b.\nc")], "doc_id long, text string")).first()
    assert (alone["edited"], alone["near_next"]) == ("a. ba. ", 1.0)


@pytest.mark.parametrize("chunk", [1, 7, 5000])
def test_divergence_in_chunks(spark, chunk):
    rng = random.Random(9)
    words = ["Ab", "ab", "éa", "É", "zz9y", "a_b", "漢", "x"]
    rows = [(k, rng.choice(["en", "", None]), rng.choice(["s", "t", "ü", None]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(9)))])) for k in range(60)] + [(99, "xx", "s", "one"), (98, "xx", "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergence(df, chunk=chunk).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = con.execute(audits.OP13_SQL)
    at = [[c[0] for c in want.description].index(x) for x in ("lang", "source", "part", "item", "value", "rank")]
    assert got == sorted(tuple(r[k] for k in at) for r in want.fetchall()) and ("xx", "s", "pair", "t", 0, 1) in got
    assert divergence.divergence(df.limit(0)).count() == 0


def test_counts_are_handed_on_when_a_task_holds_many(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    want = sorted(map(tuple, divergence.counts(df, "text", "lang", "source").collect()))
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    assert sorted(map(tuple, divergence.counts(df, "text", "lang", "source").collect())) == want


def test_long_runs_of_one_token(spark):
    docs = spark.createDataFrame([(1, "the " * 20_000), (2, "a b " * 2_000), (3, "the end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the " * 30), (2, "x y z " * 10), (3, "a b " * 15)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(docs, items).collect()) == [(1, 1, 30), (2, 3, 30)]


def test_names_with_dots(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("source", "the.source").withColumn("row", F.lit(1)).withColumn("f", F.lit(2))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.keep_good(docs.select("doc_id", "text")).count()
    coded = bpe.encode(docs.limit(5), public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN, keep=("the.source", "row"))
    assert coded.columns == ["doc_id", "the.source", "row", "ids", "decoded"] and coded.count() == 5
    assert decontaminate.keep_clean(docs, spark.createDataFrame([], "item_id long, text string")).columns == docs.columns


@pytest.mark.parametrize("n", [40, 80])
def test_unlinked_texts_of_one_template_are_hardly_compared(spark, monkeypatch, n):
    """Texts of 2,000 words that are alike at about 0.7: each pair shares buckets, none is a link."""
    rng, rows = random.Random(21), []
    template = [f"w{rng.randrange(9000)}" for _ in range(2000)]
    for k in range(n):
        words = list(template)
        for i in rng.sample(range(0, 2000, 5), 36):
            words[i] = f"x{k}y{i}"
        rows.append((k, " ".join(words)))
    asked, compared = [], neardup.compared
    monkeypatch.setattr(neardup, "compared", lambda docs, pairs, *a: asked.append(pairs.count()) or compared(docs, pairs, *a))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5).collect()
    assert all(r["kept"] for r in got) and sum(asked) <= 5 * n


PROSE = "<p>" + "This is a long sentence, with commas, and more words that go on. " * 6 + "</p>"
SIDES = ("<nav><a href=/>Home</a> <a href=/a>About</a></nav>", "<footer>&copy; me</footer>")


@pytest.mark.parametrize("wrapper", ["form id='aspnetForm'", "div class='main-widget'", "div class='page-header-wrap'", "section id='content-nav'", "fieldset"])
def test_wrappers_of_whole_pages_are_no_marks(wrapper):
    page = f"<body><{wrapper}>{SIDES[0]}<div>{PROSE * 3}</div>{SIDES[1]}</{wrapper.split()[0]}></body>"
    assert main_text(page) == " ".join([re.sub("<[^>]*>", "", PROSE).strip()] * 3)


def test_marks_within_an_article_lower_weights():
    lead, short = "<p class='nav-lead'>" + "The lead is a long one, with commas, and words. " * 4 + "</p>", "<div class='related'><a>x</a></div>"
    text = main_text(f"<body>{SIDES[0]}<article><h1>T</h1>{lead}{PROSE}<div class='related-work'>{PROSE}</div>{short}<div class='comments'>{PROSE}</div><div class='ad'>{PROSE}</div></article></body>")
    assert text.startswith("T The lead") and text.count("This is a long") == 12 and not text.endswith("x")


def test_unclosed_quotes_are_read_once():
    began = time.time()
    for page in ("<p a='" * 170_000, '<p a="x>' * 120_000, "<a b=\"c' d>x" * 80_000 + "'"):
        main_text(page)
    assert time.time() - began < 20
    assert main_text("<p title='it>one two</p><p>three</p>") == "one two three"
