"""Text columns: match offsets, splicing, tokens and name clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A noncharacter that stands around matches while they are found.
_MARK = "\ufdd0"
SPAN = "struct<text:string,entity_type:string,start:int,end:int,score:double,source:string>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def finditer(text: Column, pattern: Column | str) -> Column:
    """All matches in order: array of structs start, end (code points, half open), full, value (group 1).

    The text between matches and the matches themselves add up to the offsets,
    so no position comes from the regex engine.  Group 1 must end its match.
    The pattern goes over the text once, with marks around what it finds; texts
    that hold such a mark themselves are gone over three times.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.split(F.regexp_replace(text, p, F.lit(f"{_MARK}$0{_MARK}$1{_MARK}")), _MARK, -1)
    row = lambda m, i: F.struct(F.get(m, 3 * i + 1).alias("0"), F.get(m, 3 * i + 2).alias("1"), F.get(m, 3 * i).alias("2"))
    once = let(marked, lambda m: F.transform(F.slice(F.sequence(F.lit(0), F.size(m)), F.lit(1), ((F.size(m) - 1) / 3).cast("int")), lambda i: row(m, i)))
    thrice = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(1)), F.split(text, p, -1))
    rows = F.when(text.contains(_MARK), thrice).otherwise(once)
    empty = F.array().cast("array<struct<start:int,end:int,full:string,value:string>>")
    start = lambda a, x: a["at"] + F.length(x["2"])

    def step(a: Column, x: Column) -> Column:
        end = start(a, x) + F.length(x["0"])
        hit = F.struct(start(a, x).cast("int").alias("start"), end.cast("int").alias("end"), x["0"].alias("full"), x["1"].alias("value"))
        grown = F.struct(end.cast("int").alias("at"), F.concat(a["hits"], F.array(hit)).alias("hits"))
        return F.when(x["0"].isNull(), a).otherwise(grown)

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("hits")), step, lambda a: a["hits"])


def splice(text: Column, spans: Column, replacement) -> Column:
    """text with each of disjoint spans (in order of start) replaced by replacement(span).

    Each span gives the gap before it and its replacement, and all pieces are
    joined once, so a text costs its length, however many spans it has.
    """

    def pieces(all_: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(all_, i - 1)["end"]).otherwise(F.lit(0))
        parts = F.transform(all_, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), replacement(s)))
        last = F.coalesce(F.get(all_, F.size(all_) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    return F.when(text.isNotNull() & spans.isNotNull(), let(spans, pieces))


def clean_cell(x: Column) -> Column:
    """A table cell on one line: null and 'nan' are empty, white space is collapsed."""
    s = F.btrim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s+", " "))
    return F.when(F.lower(s) == "nan", F.lit("")).otherwise(s)


def lower_alnum(x: Column) -> Column:
    """Lower case, with runs of anything but a-z and 0-9 as one space."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+", " "))


def tokens(x: Column, least: int = 3) -> Column:
    """Distinct lower-cased runs of letters and digits of at least so many characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= least))


def canonical_type(label: Column) -> Column:
    """An identifier from a human label: upper case, with runs of other characters as one underscore."""
    return F.btrim(F.regexp_replace(F.upper(F.btrim(label)), r"[^A-Z0-9]+", "_"), F.lit("_"))


def display_label(kind: Column) -> Column:
    """A label for people: underscores as spaces, each word's first letter in upper case and the rest as it is."""
    words = F.filter(F.split(F.regexp_replace(kind, r"[_\s]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def truncated(x: Column, n: int) -> Column:
    """At most n characters, the last three of them dots where some are left out."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n - 3)), F.lit("..."))).otherwise(x)


def without_controls(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def outer_json(x: Column) -> Column:
    """The text from the first { to the last }, without code fences; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(x, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def normalised_snippet(x: Column) -> Column:
    """Lower case, with white space, control characters and ellipses as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(x, r"\.\.\.|…", " ")), r"[\s\x00-\x1f\x7f]+", " "))
