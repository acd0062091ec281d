"""Operators that work row by row: secrets, quality rules, pseudonyms, main text, BPE."""

import hashlib
import random
import re

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from emberlake.llm import bpe, html, pii, quality, secrets


def test_secrets_base_equals_brute_force(docs, odd):
    for df in (docs, odd):
        got = [tuple(r[:5]) for r in secrets.scan(df).collect()]
        want = [(r["doc_id"], *brute.secrets(r["text"])) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_secrets_edges(spark):
    texts = ["password: abc, Token='abcdef' 😀 API_KEY=abcdefg", "AKIA" + "A" * 16 + " AKIA" + "A" * 15, "0123456789abcdef01234567 " * 3, "secret=a.b-c/d=e+f_g", "passwordpassword: abcdefgh"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(tuple(r[:5]) for r in secrets.scan(df).collect()) == [(i, *brute.secrets(t)) for i, t in enumerate(texts)]


def test_entropy_equals_every_window(spark):
    rng = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    values = ["".join(rng.choice(alphabet[: rng.choice((2, 9, 40, 64))]) for _ in range(n)) for n in (0, 19, 20, 21, 40, 90)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.peak_entropy(F.col("v"))).collect()
    assert all(abs(x - brute.peak(v)) < 1e-9 for v, x in got)


def test_a_long_candidate_ends_in_seconds(spark):
    import time

    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh01234567ABCDEFGH") for _ in range(300_000)) + " " + "0123456789abcdef01234567 " * 20_000
    began = time.time()
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_hex"] >= 20_000 and row["n_entropy"] == 1 and row["spans"] == ",".join(f"{k}:{s}:{e}" for s, k, e in brute.all_spans(text, False, [(0, 300_000)]))
    assert time.time() - began < 60


def test_all_spans_equal_brute_force(docs, odd, spark):
    rng = random.Random(13)
    kinds = ["abcdef0123456789", "ABCDEF0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijABCDEFGHIJKLMNOPQ", "aB3/+_=-xYz9kLm0", "example", "a"]
    texts = [" ".join("".join(rng.choice(rng.choice(kinds[:1 + rng.randrange(8)])) for _ in range(rng.randrange(15, 60))) + rng.choice(["", "EXAMPLE", "é", "=dummy-"]) for _ in range(12)) for _ in range(60)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (docs, odd, made):
        got = [(r["doc_id"], r["spans"]) for r in secrets.scan(df).collect()]
        want = [(r["doc_id"], ",".join(f"{k}:{s}:{e}" for s, k, e in brute.all_spans(r["text"] or ""))) for r in df.select("doc_id", "text").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entropy_finds_unnamed_secrets_and_allows_placeholders(spark):
    rows = [(1, "use kX9fQ2mZ7vB4nT8rLw3Y5pHs now"), (2, "use EXAMPLEkX9fQ2mZ7vB4nT8rLw3Y now"), (3, "an-ordinary-hyphenated-phrase-of-words")]
    got = {r["doc_id"]: r["n_entropy"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_entropy_of_each_class_and_beside_placeholders(spark):
    rng = random.Random(4)
    made = lambda letters, n=40: "".join(rng.choice(letters) for _ in range(n))
    low, up, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secret = [made(low + ten), made(low[:26] + "234567"), made(ten + "ABCDEF"), made(low + up, 60), "AAAAAAAAAB" + made(low + up + ten), "/example/" + made(low + up + ten), "some-word-" + made(ten + "abcdef")]
    plain = ["an-ordinary-hyphenated-phrase-of-words", "0123456789" * 4, "123e4567-e89b-12d3-a456-426614174000", "example" * 6]
    rows = list(enumerate(secret + plain))
    got = {r["doc_id"]: r["n_entropy"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i < len(secret)) for i, _ in rows}


def test_quality_counts_equal_brute_force(docs, odd):
    for df in (docs, odd):
        out = quality.quality_rules(df)
        got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out.collect()]
        want = [(r["doc_id"], *brute.quality(r["text"])) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert out.where("base_failed AND kept").count() == 0


def test_posteriors_equal_plain_expectation_maximisation(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.collect()
    want = dict(zip((r["doc_id"] for r in rows), brute.p_good([r["text"] for r in rows], list(quality.RULES.values()), quality.SHARE, quality.BELIEF, quality.WEIGHT, quality.ROUNDS, quality.SETTLED), strict=True))
    got = quality.quality_rules(df).collect()
    assert all(abs(r["p_good"] - want[r["doc_id"]]) < 1e-9 and r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5) for r in got) and len(got) == len(want)


def test_a_lone_accusation_is_outvoted(docs, spark):
    """A text without full stops: one rule accuses it, and it stays; the same text with symbols in every word goes."""
    clean = "The council met at noon, and it spoke of roads. Then came talk of bridges, of taxes and of schools in the north. Some wanted more time for trains. Others said no; they had waited for years, with little to show. A vote was called by the chair before dusk, when rain began. Nobody left early, though many had far to go home."
    endless = clean.replace(".", ",")
    symbols = " ".join(w + "###" for w in clean.split())
    made = spark.createDataFrame([(10**9, endless), (10**9 + 1, symbols), (10**9 + 2, clean)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(made)
    voted = {r["doc_id"]: r["votes"] for r in quality.features(made).withColumn("votes", quality.votes()).collect()}
    assert voted[10**9].count(-1) == 1 and voted[10**9 + 2].count(-1) == 0
    assert {r["doc_id"] - 10**9: r["kept"] for r in quality.quality_rules(df).where("doc_id >= 1000000000").collect()} == {0: True, 1: False, 2: True}


def test_quality_agrees_with_labels(spark):
    at = "/root/testdata/sf0.01"
    out = quality.quality_rules(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    good, bad = out.where("quality = 1 AND NOT base_failed"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("NOT kept").count() >= 0.98 * bad.count()


def test_quality_of_nothing(docs):
    assert quality.quality_rules(docs.limit(0)).count() == 0
    assert quality.keep_good(docs.limit(0)).columns == docs.columns


def test_pseudonyms_are_permutations_within_the_format(spark):
    dates = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("m"))
    out = dates.select("m", pii._date(F.col("m"), "k").alias("p")).cache()
    assert out.select("p").distinct().count() == 73049 and out.where(F.try_to_timestamp("p", F.lit("yyyy-MM-dd")).isNull()).count() == 0
    ssn = spark.range(20000).select(F.format_string("123-%02d-%04d", F.pmod("id", F.lit(99)) + 1, F.pmod("id", F.lit(9999)) + 1).alias("m")).distinct()
    out = ssn.select(pii._ssn(F.col("m"), "k").alias("p"))
    assert out.distinct().count() == ssn.count() and out.where(~F.col("p").rlike(r"^(?!000|666)\d{3}-(?!00)\d\d-(?!0000)\d{4}$")).count() == 0


def luhn(number):
    d = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms_link_documents_and_leave_the_rest(spark):
    rows = [(1, "Mail ann.b@example.org or 10.0.0.7, card 4111 1111 1111 1111 on 2020-02-29."), (2, "ann.b@example.org; 4111-1111-1111-1111; 4111 1111 1111 1112; 2021-02-30; v1.2.3.4.5"), (3, None), (4, ""), (5, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.private(df).collect()}
    one, two = got[1]["text"], got[2]["text"]
    assert "ann.b@" not in one and re.search(r"(\S+)@example.org", one)[1] == re.search(r"(\S+)@example.org", two)[1]
    card = re.search(r"card ([\d ]+) on", one)[1]
    assert luhn(card) % 10 == 0 and card.replace(" ", "") == two.split("; ")[1].replace("-", "") and card != "4111 1111 1111 1111"
    assert two.endswith("4111 1111 1111 1112; 2021-02-30; v1.2.3.4.5") and "02-29." in one
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "nothing here"
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_date"]) == (1, 1, 1, 1)


def test_pseudonyms_of_odd_rows(odd, spark):
    clash = odd.select("*", *[F.col("n").alias(c) for c in ("_m", "_k", "m", "k", "row", "found")])
    out = pii.pseudonymise(clash)
    assert sorted(out.columns) == sorted(clash.columns) and out.count() == odd.count() and out.where("_m <> n OR row <> n").count() == 0
    assert pii.private(odd.limit(0)).count() == 0
    long = [(1, "a@" + "b." * 20_000 + "org"), (2, "x" * 100_000 + "@example.org"), (3, "ann@example.org " * 2_000 + "4111 1111 1111 1111"), (4, "7 " * 10_000)]
    got = {r["doc_id"]: r for r in pii.private(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert {k: (r["n_email"], r["n_card"]) for k, r in got.items()} == {1: (0, 0), 2: (0, 0), 3: (2_000, 1), 4: (0, 0)}
    assert got[1]["text"] == long[0][1] and got[2]["text"] == long[1][1] and "ann@" not in got[3]["text"]


def test_cards_among_other_numbers(spark):
    card, plain = "4111 1111 1111 1111", "4111111111111111"
    rows = [(1, f"card {plain} 05/27"), (2, f"card {card} 123"), (3, f"no. 12 {card}, paid"), (4, f"1234 5678 {card} 99"), (5, f"{card} 01/02/2020"), (6, f"{card} {card}"), (7, "2201 9325 1033 4179 1931 8117"), (8, f"{card} 123-45-6789 12 ann@example.org"), (9, "0 " * 3000 + card)]
    got = {r["doc_id"]: r for r in pii.private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["n_card"] for k, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 0, 8: 1, 9: 1}
    new = got[1]["text"][5:21]
    assert new != plain and luhn(new) % 10 == 0
    spaced = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    assert [got[k]["text"] for k in (1, 2, 3, 4, 6, 7)] == [f"card {new} 05/27", f"card {spaced} 123", f"no. 12 {spaced}, paid", f"1234 5678 {spaced} 99", f"{spaced} {spaced}", rows[6][1]]
    assert got[5]["n_date"] == got[8]["n_ssn"] == got[8]["n_email"] == 1


PAGE = """<html><head><title>t</title><style>x{}</style></head><body><header class="site"><a href="/">Home</a></header><nav><ul><li><a>News</a></ul></nav>
<div class="wrap"><article><h1>Title &amp; more</h1><p>First paragraph, with <b>bold</b>   words; and enough of them to count.</p><p>Second one.
Goes on, and on, and on.</p><div class="advert">Buy now!</div></article><aside>Related</aside><section class="comments"><p>I disagree, strongly, with all of this, and at length.</p></section></div>
<footer>&copy; us</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (None, "u", "plain, text"), (1, "u", PAGE)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "Title & more First paragraph, with bold words; and enough of them to count. Second one. Goes on, and on, and on."
    assert by[2] == by[3] == by[4] == "" and by[None] == "plain, text" and len(got) == 6
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_main_text_drops_no_content():
    said = lambda n, k: " ".join(f"Word{k}, number {i}." for i in range(n))
    a, b, c = said(60, "a"), said(40, "b"), said(4, "c")
    menu = "<nav><a>Home</a></nav>"
    assert html.main_text(f"<body>{menu}<main><article>{a}</article><article>{b}</article></main></body>") == f"{a} {b}"
    assert html.main_text(f"<body>{menu}<article>{a}</article><article>{b}</article></body>") == f"{a} {b}"
    assert html.main_text(f"<body>{menu}<div><div itemprop='articleBody'><p>{a}</p></div><section><p>{b}</p></section></div></body>") == f"{a} {b}"
    for tag in ("p", "div"):
        assert html.main_text(f"<body>{menu}<div><h1>Title</h1><{tag}>{a}</{tag}><{tag}>{c}</{tag}></div></body>") == f"Title {a} {c}"
    assert html.main_text(f"<article><p>{a}</p><ul><li><a>One source</a></li></ul></article>") == f"{a} One source"


def test_main_text_of_all_pages_equals_a_plain_reading(spark):
    """The local pages have one article each, with paragraphs, headings and no parts to leave out."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def plain(page):
        body = re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", re.search("<article>(.*?)</article>", page, re.S)[1])
        return " ".join(unescape(re.sub("<[^>]*>", " ", body)).split())

    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html.extract(pages.withColumn("text", F.lit("clash"))).collect()} == want
    assert html.extract(pages.limit(0)).count() == 0


def test_weights_decide(monkeypatch):
    """Without marks the paths' weights select the content; with equal weights the result is another."""
    said = " ".join(f"Word, and number {i}; of a long sentence." for i in range(30))
    page = f"<body><div><a>Home</a><a>News</a></div><div class='x'><h2>Title</h2><p>{said}</p><p>{said}</p></div><div><span>Imprint</span></div></body>"
    assert html.main_text(page) == f"Title {said} {said}"
    monkeypatch.setattr(html, "fused", lambda lengths, *_: [1.0] * len(lengths))
    assert html.main_text(page) != f"Title {said} {said}" and html.main_text(PAGE).startswith("Home")


def test_deep_and_broken_pages_end(spark):
    deep = "<div>" * 50_000 + "<p>Some text, with words. And more, of it.</p>" + "</div>" * 50_000
    assert html.main_text(deep) == "Some text, with words. And more, of it."
    assert html.main_text("<div>" * 5000 + "</b>" * 50_000 + "One, two. Three.") == "One, two. Three."
    assert html.main_text("<b>" * 20_000 + "<p>One, two.<p>Three, four.") == "One, two. Three, four."
    assert html.main_text("<p>A long one, " * 50_000).count("long") == 50_000


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    return path, tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs, odd, spark, reference):
    path, coder = reference
    rng = random.Random(3)
    kinds = ["aeiou", " \n\t\r", "0123456789", "äñçøЖ中文字", "😀🇩🇪", "'s't", "  \u0085", "<|endoftext|>", "x" * 400]
    made = spark.createDataFrame([(i, "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(300)))) for i in range(60)] + [(99, "z" * 5000), (98, "<|endoftext|>")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd, made):
        for r in bpe.encode(df, path, public_tokenizers.PATTERN, keep=("text",)).collect():
            assert r["ids"] == coder.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_of_nothing_and_of_other_columns(odd, reference):
    assert bpe.encode(odd.limit(0), reference[0], public_tokenizers.PATTERN).count() == 0
    out = bpe.encode(odd.withColumn("_text", F.col("n")), reference[0], public_tokenizers.PATTERN, keep=("_text", "_t", "n"))
    assert out.columns == ["doc_id", "_text", "_t", "n", "ids", "decoded"] and out.where("_text <> n").count() == 0


def test_bpe_query_digests(spark, reference):
    from emberlake.llm.queries import op9_byte_bpe

    _, coder = reference
    at = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op9_byte_bpe(spark, at).collect()}
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        ids = coder.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
