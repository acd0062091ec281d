"""Scalar functions on messages and addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variable parts of a message and what stands for them, in order of precedence.
VARIABLE = (
    ("UUID", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("IP", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("HEX", r"0[xX][0-9a-fA-F]+|(?=[0-9]*[a-fA-F])[0-9a-fA-F]{8,}"),
    ("N", r"[0-9][0-9.]*"),
)
_MARK, _END = "\ue000", "\ue001"


def template(message: Column, max_chars: int = 4096) -> Column:
    """A message with its variable parts replaced, so that messages of one kind become equal.

    One pass of the alternation marks the parts from left to right; the marked parts are then named.
    """
    out = F.regexp_replace(F.substring(message, 1, max_chars), "(" + "|".join(f"(?:{p})" for _, p in VARIABLE) + ")", f"{_MARK}$1{_END}")
    for name, p in VARIABLE:
        out = F.regexp_replace(out, f"{_MARK}(?:{p}){_END}", f"<{name}>")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def template_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def ip_number(ip: Column) -> Column:
    part = lambda k: F.split(ip, r"\.")[k].try_cast("long")
    return ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)


def is_private(ip: Column) -> Column:
    """Private, loopback, link-local and unspecified addresses of either version."""
    n, low = ip_number(ip), F.lower(ip)
    within = lambda a, bits: F.floor(n / (1 << (32 - bits))) == a >> (32 - bits)
    four = within(10 << 24, 8) | within((172 << 24) + (16 << 16), 12) | within((192 << 24) + (168 << 16), 16) | within(127 << 24, 8) | within((169 << 24) + (254 << 16), 16) | (n == 0)
    six = (low == "::1") | (low == "::") | low.rlike("^fe[89ab]") | low.rlike("^f[cd]")
    return F.when(ip.contains(":"), six).otherwise(F.coalesce(four, F.lit(False)))


def level_weight(level: Column) -> Column:
    return F.when(level == "critical", 13.0).when(level == "high", 8.0).when(level == "medium", 4.0).when(level.isin("informational", "info"), 1.0).otherwise(2.0)


def in_hours(hour: Column, start: int, end: int, outside: bool = False) -> Column:
    """Whether an hour lies in [start, end), which may wrap over midnight."""
    inside = (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
    return ~inside if outside else inside


_WORD = r"[\p{L}_][\p{L}\p{N}_$]*"
_PART = rf'(?:{_WORD}|"(?:[^"]|"")*")'


def _nested(depth: int) -> str:
    """A comment that holds comments, so many levels deep."""
    inner = _nested(depth - 1) if depth else r"(?!)"
    return rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{inner})*+\*/"


#: The parts of a PostgreSQL statement: comments, strings, parameters, numbers, names with their parts, operators; a quote or comment without an end is a part of one or two characters.
PARTS = "|".join((
    r"--[^\n]*", _nested(4), r"\$(?<tag>(?:[\p{L}_][\p{L}\p{N}_]*)?)\$(?s:.*?)\$\k<tag>\$", r"[eE]'(?:[^'\\]|\\(?s:.)|'')*'", r"(?:[bBxXnN]|[uU]&)?'(?:[^']|'')*'",
    r"\$\d+", r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+", rf"{_PART}(?:\s*\.\s*{_PART})*(?:\s*\.\s*\*)?", r"/\*", r"::|:=|=>|->>|->|<=|>=|<>|!=|\|\|", r"\S",
))


def parts(statement: Column) -> Column:
    """A statement's parts in order, without comments: literals and parameters as `?`, unquoted names in lower case, quoted ones as they are (blanks as U+E000)."""
    found = F.filter(F.regexp_extract_all(statement, F.lit(PARTS), F.lit(0)), lambda t: ~t.rlike(r"^--|^/\*(?s:.)"))
    bare = lambda t: F.regexp_replace(t, r"\s*\.\s*(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", ".")  # noqa: E731  blanks around the points between names
    quoted = lambda t: F.array_join(F.transform(F.regexp_extract_all(bare(t), F.lit(r'"(?:[^"]|"")*"|[^"]+'), F.lit(0)), lambda x: F.when(x.startswith('"'), F.regexp_replace(x, r"\s", _MARK)).otherwise(F.lower(x))), "")
    return F.transform(found, lambda t: F.when(t.rlike(r"^\$|^\.?\d|^(?:[eEbBxXnN]|[uU]&)?'(?s:.)+"), "?").when(t.contains('"') & (F.length(t) > 1), quoted(t)).when(t.rlike(rf"^{_WORD}"), F.lower(bare(t))).otherwise(t))


def fingerprint(statement: Column) -> Column:
    """A hash of a statement's parts but its semicolons: values, blanks, comments and the case of unquoted names don't change it, all else does."""
    return F.concat(F.lit("sql1:"), F.substring(F.sha2(F.array_join(F.filter(parts(statement), lambda t: t != ";"), " "), 256), 1, 32))


#: First words of statements, and words that no table or alias has for its name.
STATEMENTS = "select insert update delete copy create alter drop truncate grant revoke call set merge analyze explain with values execute begin commit rollback do vacuum show declare fetch close lock".split()
RESERVED = "select from where group order having limit offset values on and or as into join left right inner outer full cross natural union except intersect to using when then set returning for window fetch lateral only with".split()


#: What is told of a statement.
FACTS = "confidence kind read written joined columns predicates functions ctes roles targets wildcard export privileges has_where bulk unresolved".split()


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often it is used there; Spark repeats expressions that are used within lambdas."""
    return F.element_at(F.transform(F.array(value), of), 1)


def statement(text: Column, *wanted: str) -> Column:
    """What a PostgreSQL statement does, by its parts (comments, strings and quoted names can't be taken for words of it), as a struct.

    kind; tables read and written (its own WITH names aside) and joined; columns, which are qualified names in what it selects and in its conditions, and
    predicates, those in conditions; functions; with names; roles that it sets; targets of privileges; and whether it takes all columns,
    exports, changes privileges, has a condition, or reads without bounds (bulk). confidence: `none` if a quote or comment has no end, `low` if its first
    word isn't a statement's or brackets don't match, else `high`; tables of a statement of low confidence are `unresolved` too.
    wanted: the names of those to be computed, all if there are none.
    """
    word = rf'(?:"[^"]*"|{_WORD})'
    free = rf"(?!(?:{'|'.join(RESERVED)}) )"
    name = rf"({free}{word}(?:\.{word})*)(?! \()"
    alias = rf"(?: (?:as )?{free}{word}(?! \())?"
    item = rf"(?:only )?{name}{alias}"

    no = F.array().cast("array<string>")
    plain = lambda names: F.transform(names, lambda x: F.translate(x, _MARK, " "))
    names = lambda *lists: plain(F.array_sort(F.array_distinct(F.concat(*lists))))
    all_in = lambda s: lambda pattern, of=None: F.regexp_extract_all(s if of is None else of, F.lit(pattern), F.lit(1))

    def told(t: Column) -> Column:
        s = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        s = F.regexp_replace(s, r" (extract|substring|trim|overlay|position) \( [^()]* \)", " $1 ( ? )")
        return _bound(s, lambda s: _bound(found(t, s), lambda x: _bound(named(t, s, x), lambda y: facts(s, x, y))))

    def found(t: Column, s: Column) -> Column:
        """What the words of a statement are followed by, as it stands there."""
        all_ = all_in(s)
        first = F.coalesce(F.get(F.filter(t, lambda x: x.rlike(rf"^{_WORD}")), F.lit(0)), F.lit(""))
        own = all_(rf"(?:(?<= with )|(?<= recursive )|(?<=\) , ))({word})(?: \( [^()]* \))? as (?:not )?(?:materialized )?\(")
        cut = all_(rf"(?<= )truncate (?:table )?({item}(?: , {item})*)")
        lists = F.concat(all_(rf"(?<! distinct )(?<= )from ({item}(?: , {item})*)"), all_(rf"(?<=\)) (?:as )?{free}{word} , ({item}(?: , {item})*)"))
        each = lambda lists: F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, " , "), lambda y: F.regexp_extract(y, rf"^(?:only )?({word}(?:\.{word})*)", 1))))
        heads = each(lists)
        deleted = all_(rf"(?<= )delete from (?:only )?{name}")
        joined = F.concat(all_(rf"(?<= )join (?:lateral )?(?:only )?{name}"), F.when(s.contains(" merge "), all_(rf"(?<= )using {name}")).otherwise(no), F.when(s.contains(" delete "), all_(rf"(?<= )using {name}")).otherwise(no))
        exported = all_(rf"(?<= )copy ({free}{word}(?:\.{word})*)(?: \( [^()]* \))? to ")
        loaded = all_(rf"(?<= )copy ({free}{word}(?:\.{word})*)(?: \( [^()]* \))? from ")
        into = F.concat(all_(rf"(?<= )into (?:table )?({free}{word}(?:\.{word})*)"), all_(rf"(?<= )(?<!for )(?<!do )update (?:only )?{name}"))
        tables_of = all_(rf"(?<= )(?<!truncate )table (?:if (?:not )?exists )?(?:only )?({free}(?!if ){word}(?:\.{word})*)")
        tables = F.regexp_replace(s, rf"(?<= )(from|join|into|update|using|table) (?:only )?{word}(?:\.{word})*(?! \()(?:{alias} , (?:only )?{word}(?:\.{word})*(?! \())*", "$1 ?")
        return F.struct(*[c.alias(k) for k, c in {"first": first, "own": own, "heads": heads, "cut": each(cut), "deleted": deleted, "joined": joined, "exported": exported, "loaded": loaded, "into": into, "ddl": tables_of, "tables": tables}.items()])

    def named(t: Column, s: Column, x: Column) -> Column:
        """Tables read and written, qualified names of selections and of conditions, and how sure all is."""
        first, own, heads, deleted, joined, exported, loaded, tables = (x[k] for k in ("first", "own", "heads", "deleted", "joined", "exported", "loaded", "tables"))
        all_ = all_in(s)
        ddl = F.when(first.isin("grant", "revoke"), no).otherwise(x["ddl"])
        written = F.concat(x["into"], loaded, deleted, ddl, x["cut"])
        reads = F.when(first == "revoke", no).otherwise(F.array_except(F.concat(heads, joined, exported), F.array(F.lit("stdin"))))
        # What a statement deletes from is read only where it comes up again.
        twice = lambda x: F.size(F.filter(heads, lambda y: y == x)) > F.size(F.filter(deleted, lambda y: y == x))
        read = F.filter(reads, lambda x: ~F.array_contains(own, x) & (~F.array_contains(deleted, x) | twice(x) | F.array_contains(joined, x)) & ~F.array_contains(loaded, x))
        qualified = lambda seg: F.flatten(F.transform(seg, lambda x: F.regexp_extract_all(x, F.lit(rf"(?<= )({word}(?:\.{word})+)(?= (?!\())"), F.lit(1))))
        padded = lambda seg: F.transform(seg, lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
        chosen = padded(all_(r"(?<= )select (.*?)(?= from | into | union | where |$)", tables))
        asked = padded(all_(r"(?<= )where (.*?)(?= group by | order by | having | limit | union | returning | from |$)", tables))
        open_ = F.exists(t, lambda x: x.isin("'", '"', "/*"))
        brackets = F.size(F.filter(t, lambda x: x == "(")) == F.size(F.filter(t, lambda x: x == ")"))
        confidence = F.when(open_, "none").when(~first.isin(*STATEMENTS) | ~brackets, "low").otherwise("high")
        given = {"written": written, "read_": names(read), "written_": names(F.filter(written, lambda y: ~F.array_contains(own, y))), "confidence": confidence}
        given |= {"chosen": qualified(chosen)} if not wanted or "columns" in wanted else {}
        given |= {"asked": qualified(asked)} if not wanted or {"columns", "predicates"} & {*wanted} else {}
        return F.struct(*[c.alias(k) for k, c in given.items()])

    def facts(s: Column, x: Column, y: Column) -> Column:
        first, own, joined = (x[k] for k in ("first", "own", "joined"))
        written, read_, written_, chosen, asked, confidence = (y[k] for k in ("written", "read_", "written_", "chosen", "asked", "confidence"))  # looked up only where they are used
        all_ = all_in(s)
        kind = F.when(first == "with", F.coalesce(F.nullif(F.regexp_extract(s, r"\) (select|insert|update|delete|merge) ", 1), F.lit("")), F.lit("select"))).when((first == "set") & s.rlike(r"^ set (?:session |local )?(?:role|session authorization|authorization) "), "set_role").otherwise(first)
        export = s.rlike(r"(?<= )copy (?:\(.*\)|[^ ]+(?: \( [^()]* \))?) to ")
        bounded = s.rlike(r" where | limit | fetch (?:first|next) ")
        told = (
            confidence.alias("confidence"), kind.alias("kind"), read_.alias("read"), written_.alias("written"), names(F.filter(joined, lambda x: ~F.array_contains(own, x))).alias("joined"),
            names(chosen, asked).alias("columns"), names(asked).alias("predicates"),
            names(F.filter(all_(rf"(?<= )({word}(?:\.{word})*) \("), lambda x: ~x.isin("in", "values", "exists", "array", "row", "all", "any", "some", "over", "filter", "using", "on", "and", "or", "not", "case", "select", "table", "when", "from", "where", "as", "materialized", "copy", "into", "then", "else", "by", "union", "lateral", "with") & ~F.array_contains(own, x) & ~F.array_contains(written, x))).alias("functions"),
            names(own).alias("ctes"), names(all_(rf"(?<= )set (?:session |local )?(?:role|session authorization|authorization) ({word})")).alias("roles"),
            F.when(first.isin("grant", "revoke"), names(F.flatten(F.transform(all_(r"(?<= )on (?!all )(?:table |schema |sequence |database |function |procedure |type |domain |language |tablespace )?(.*?)(?= to | from |$)"), lambda x: F.split(F.trim(x), " , "))), all_(rf"(?<= )on all [a-z]+ in schema ({word})"))).otherwise(no).alias("targets"),
            (s.rlike(r"(?<= )select (?:all |distinct )?(?:[^ ]+ , )*(?:[^ ]+\.)?\* ")).alias("wildcard"), export.alias("export"), first.isin("grant", "revoke").alias("privileges"), s.contains(" where ").alias("has_where"),
            (export | (kind.isin("select", "copy") & ~bounded & (F.size(read_) > 0))).alias("bulk"), F.when(confidence == "low", names(read_, written_)).otherwise(no).alias("unresolved"),
        )
        return F.struct(*[c for k, c in zip(FACTS, told, strict=True) if not wanted or k in wanted])

    return _bound(parts(text), told)
