"""Operator 7, format-preserving pseudonyms by Feistel networks (native).

Personal values are found by pattern and validated (card numbers by their check digit, addresses by their
octets, dates by the calendar, and so on). A keyed Feistel network permutes each within the values of its own
format: the halves of the value take turns in adding, modulo their range, a keyed hash of the other half. So a
pseudonym is valid in the same format, different values never meet in one pseudonym, and equal values have equal
pseudonyms in all documents, whatever separators they are written with. What doesn't validate stays. A card number
may stand among other numbers (an expiry, a check code), so of a run of groups of digits each part of whole groups is
tried, the leftmost first and of those the longest.

Edge cases: a null text stays null and has no values; rows are treated one by one, so repeated rows give
repeated results; texts are read whole; an empty table gives an empty table; other columns, whatever their names, are handed on by
the stage form and not read by the query form. Nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key is a parameter; this one is for tests and demonstrations.
KEY = "emberlake-demonstration-key"
ROUNDS = 10

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind: pattern. An address has a local part of 64 characters at most and a domain of 127 labels at most, of 63
#: characters each, as mail has it; what is longer is no address. They exclude one another by what stands around them; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d]|\.\d)",
    "date": r"(?<![\w./-])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)\d\d)(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
}
#: A run of groups of digits that may hold card numbers; it ends before a value of another kind.
GROUP = r"\d++(?![A-Za-z_]|-(?!\d))"
PATTERNS["card"] = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){GROUP}(?:[ -](?!{'|'.join(PATTERNS.values())}){GROUP})*+"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _hash(key: str, tweak: str, i: Column, value: Column) -> Column:
    return F.concat_ws("|", F.lit(key), F.lit(tweak), i, value)


def permute(x: Column, y: Column, a: Column | int, b: Column | int, key: str, tweak: str) -> Column:
    """A keyed permutation of the pairs (x, y), x in 0 .. a - 1, y in 0 .. b - 1, as a struct."""
    f = lambda i, v: F.conv(F.substring(F.sha2(_hash(key, tweak, i, v), 256), 1, 13), 16, 10).cast("long")
    a, b = (F.lit(n).cast("long") if isinstance(n, int) else n for n in (a, b))

    def one(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 1, (s["x"] + f(i, s["y"])) % a).otherwise(s["x"]).alias("x"), F.when(i % 2 == 0, (s["y"] + f(i, s["x"])) % b).otherwise(s["y"]).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), one)


def _shift(text: Column, stream: Column) -> Column:
    """text with each letter and digit moved on within its own class by a byte of the hexadecimal stream."""

    def one(j: Column) -> Column:
        c, code = F.substring(text, j, F.lit(1)), F.ascii(F.substring(text, j, F.lit(1)))
        by = F.conv(F.substring(stream, 2 * ((j - 1) % 64) + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda first, n: F.char(first + (code - first + by) % n)
        return F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(text)


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the texts with the same classes of characters at the same places."""
    half = (F.length(text) / 2).cast("int")

    def one(s: Column, i: Column) -> Column:
        stream = lambda v: F.sha2(_hash(key, tweak, i, v), 512)
        return F.struct(F.when(i % 2 == 1, _shift(s["l"], stream(s["r"]))).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, _shift(s["r"], stream(s["l"]))).otherwise(s["r"]).alias("r"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: F.concat(s["l"], s["r"]))


def _with(value: Column, use) -> Column:
    """use(value), where value is worked out once: a lambda's variable stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, new: Column) -> Column:
    """m with its digits, in order, replaced by those of new."""
    one = lambda j: F.when(F.substring(m, j, F.lit(1)).rlike("[0-9]"), F.substring(new, F.length(digits(F.substring(m, F.lit(1), j))), F.lit(1))).otherwise(F.substring(m, j, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def luhn(d: Column) -> Column:
    """The check digit for the digits d."""

    def add(total: Column, j: Column) -> Column:
        c = F.substring(d, -j, F.lit(1)).cast("int") * F.when(j % 2 == 1, 2).otherwise(1)
        return total + F.when(c > 9, c - 9).otherwise(c)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add, lambda t: ((10 - t % 10) % 10).cast("string"))


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        return _with(F.concat(F.substring(d, F.lit(1), F.lit(1)), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")), lambda body: F.concat(body, luhn(body)))

    return refill(m, _with(digits(m), new))


def _is_card(m: Column) -> Column:
    return _with(digits(m), lambda d: F.length(d).between(13, 19) & (luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1)) & ~d.rlike(r"^(\d)\1*$"))


def _cards(m: Column) -> Column:
    """A run of groups of digits as (m, k): the card numbers in it, and what stands between them with k null."""
    part = lambda t, k: F.struct(t.alias("m"), k.cast("string").alias("k"))

    def split(groups: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            texts = F.transform(F.sequence(F.least(F.lit(19), F.size(groups) - i), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(groups, i + 1, n), "").alias("t")))
            first = F.get(F.filter(texts, lambda x: F.length(digits(x["t"])).between(13, 19) & _is_card(x["t"])), F.lit(0))
            card = _with(first["t"], lambda t: F.array(part(F.regexp_replace(t, "[ -]$", ""), F.lit("card")), part(F.regexp_extract(t, "[ -]?$", 0), F.lit(None))))
            all_ = F.concat(s["all"], F.when(first.isNull(), F.array(part(F.get(groups, i), F.lit(None)))).otherwise(card))
            return F.when(i < s["next"], s).otherwise(F.struct((i + F.coalesce(first["n"], F.lit(1))).alias("next"), all_.alias("all")))

        # In slices of the root of their number, as appending to an array copies it.
        by = F.ceil(F.sqrt(F.size(groups))).cast("int")
        none = F.array().cast("array<struct<m:string,k:string>>")

        def some(s: Column, first: Column) -> Column:
            own = F.aggregate(F.sequence(first, F.least(first + by, F.size(groups)) - 1), F.struct(s["next"].alias("next"), none.alias("all")), one)
            return _with(own, lambda x: F.struct(x["next"].alias("next"), F.concat(s["all"], x["all"]).alias("all")))

        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1, by), F.struct(F.lit(0).alias("next"), none.alias("all")), some, lambda s: s["all"])

    return F.when(_is_card(m), F.array(part(m, F.lit("card")))).otherwise(_with(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), split))


def _ip(m: Column, key: str) -> Column:
    part = lambda k: F.split(m, r"\.")[k].cast("long")
    at = lambda v, n: F.floor(v / n).cast("string")
    return _with(permute(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, "ip"), lambda s: F.concat_ws(".", at(s["x"], 256), (s["x"] % 256).cast("string"), at(s["y"], 256), (s["y"] % 256).cast("string")))


def _pad(v: Column, n: int) -> Column:
    return F.lpad(v.cast("string"), n, "0")


def _ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("long")
    x = area - F.when(area > 666, 2).otherwise(1)
    y = (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1
    return _with(permute(x, y, 898, 99 * 9999, key, "ssn"), lambda s: F.concat_ws("-", _pad(s["x"] + F.when(s["x"] >= 665, 2).otherwise(1), 3), _pad(F.floor(s["y"] / 9999) + 1, 2), _pad(s["y"] % 9999 + 1, 4)))


def _phone(m: Column, key: str) -> Column:
    """Ten digits of the North American plan stay in it; of other numbers all digits after the country code are permuted."""

    def new(d: Column) -> Column:
        n = F.substring(d, -10, 10)
        x = (F.substring(n, 1, 1).cast("long") - 2) * 100 + F.substring(n, 2, 2).cast("long")
        y = ((F.substring(n, 4, 1).cast("long") - 2) * 100 + F.substring(n, 5, 2).cast("long")) * 10000 + F.substring(n, 7, 4).cast("long")
        american = _with(permute(x, y, 800, 8_000_000, key, "phone"), lambda s: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (s["x"] + 200).cast("string"), (F.floor(s["y"] / 10000) + 200).cast("string"), _pad(s["y"] % 10000, 4)))
        code = F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+(\d{1,3})", 1))).otherwise(0)
        code = F.when(m.rlike(r"^\+\d{4}"), 1).otherwise(code)
        other = F.concat(F.substring(d, F.lit(1), code), permute_text(F.substring(d, code + 1, F.length(d)), key, "phone"))
        return F.when((m.rlike(r"^(\+1[^\d])|^[^+]") | (m.startswith("+1") & (F.length(d) == 11))) & d.rlike(r"^1?[2-9]\d\d[2-9]\d{6}$"), american).otherwise(other)

    return refill(m, _with(digits(m), new))


def _parts(m: Column) -> tuple[Column, Column, Column]:
    iso = m.rlike("^[0-9]{4}-")
    piece = lambda a, b, n: F.when(iso, F.substring(m, a, n)).otherwise(F.substring(m, b, n))
    return piece(1, 7, 4), piece(6, 4, 2), piece(9, 1, 2)


def _date(m: Column, key: str) -> Column:
    """Dates of 1900 to 2099: year and day of a common year; the leap days among themselves."""
    year, month, day = _parts(m)
    leap_day = (month == "02") & (day == "29")
    index = F.dayofyear(F.make_date(F.lit(2001), month.cast("int"), F.when(leap_day, 28).otherwise(day.cast("int")))) - 1
    common = _with(permute(year.cast("long") - 1900, index, 200, 365, key, "date"), lambda s: F.concat((s["x"] + 1900).cast("string"), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), s["y"].cast("int")), "MMdd")))
    # 49 leap years: 1904 and on, every four years
    leap = _with(permute((year.cast("long") - 1904) / 4, F.lit(0), 49, 1, key, "leap"), lambda s: F.concat((s["x"] * 4 + 1904).cast("string"), F.lit("0229")))
    put = lambda d: F.when(m.rlike("^[0-9]{4}-"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(F.concat(F.substring(d, 7, 2), F.substring(m, 3, 1), F.substring(d, 5, 2), F.substring(m, 6, 1), F.substring(d, 1, 4)))
    return _with(F.when(leap_day, leap).otherwise(common), put)


def _is_date(m: Column) -> Column:
    year, month, day = _parts(m)
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull() if hasattr(F, "try_to_date") else F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).isNotNull()


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def parts(m: Column) -> Column:
    """A match as (m, k) with the kind, null if it doesn't validate; of a run of digits its parts."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    one = lambda k: F.array(F.struct(m.alias("m"), k.cast("string").alias("k")))
    return (
        F.when(whole("email"), one(F.lit("email"))).when(whole("ip"), one(F.lit("ip"))).when(whole("date"), one(F.when(_is_date(m), "date"))).when(whole("ssn"), one(F.lit("ssn")))
        .when(whole("phone"), one(F.when(F.length(digits(m)).between(8, 15), "phone"))).when(m.rlike("^[0-9][0-9 -]*$"), _cards(m)).otherwise(one(F.lit(None)))
    )


def pseudonym(m: Column, k: Column, key: str) -> Column:
    return F.when(k == "email", _email(m, key)).when(k == "ip", _ip(m, key)).when(k == "date", _date(m, key)).when(k == "ssn", _ssn(m, key)).when(k == "phone", _phone(m, key)).when(k == "card", _card(m, key)).otherwise(m)


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """docs with the text pseudonymised, and a column `found` of the kinds in order (null: not validated), which replaces one of that name."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    text = F.col("text")
    df = df.withColumn("m", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("k", F.transform("m", parts))
    between = F.split(text, ANY, -1)
    new = F.transform("k", lambda p: F.array_join(F.transform(p, lambda x: pseudonym(x["m"], x["k"], key)), ""))
    # Between the matches and after the last: as many values as pieces, the last one empty.
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    own = [F.when(F.size("k") > 0, joined).otherwise(text).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "found"]
    return df.select(*own, F.transform(F.flatten("k"), lambda x: x["k"]).alias("found"))


def private(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the pseudonymised text, and the number of values of each kind."""
    out = pseudonymise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key)
    number = lambda k: F.size(F.filter(F.coalesce("found", F.array().cast("array<string>")), lambda x: x == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", *[number(k) for k in PATTERNS])
