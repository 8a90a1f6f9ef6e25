"""Scalar functions as Column expressions: value guessing, labels, text, dates, URIs, numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace prefixes that full URIs are shortened with.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dcterms": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
}


def guess_type(val: Column, empty_as_null: bool = True) -> Column:
    """number, string or null (FN1)."""
    text = F.trim(val)
    null = text.isNull() | ((text == "") if empty_as_null else F.lit(False))
    return F.when(null, "null").when(text.try_cast("double").isNotNull(), "number").otherwise("string")


def norm_text(val: Column) -> Column:
    """Trimmed, empty as null (FN2)."""
    return F.nullif(F.trim(val), F.lit(""))


def norm_number(val: Column) -> Column:
    """The value as a number, where it is one (FN2)."""
    return F.trim(val).try_cast("double")


def tokenize_label(label: Column) -> Column:
    """Words of a label: split at _ : . and blanks, then where lower case turns to upper (FN3)."""
    spaced = F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[_\s:.]+", -1), lambda t: t != "")


def tokenize_text(text: Column) -> Column:
    """Lower-case words and numbers with inner dots (FN6)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), 0)


def pad(text: Column, width: int, align: str = "left") -> Column:
    """Padded to a width, longer text kept whole (FN5)."""
    n = F.greatest(F.length(text), F.lit(width))
    if align == "left":
        return F.rpad(text, n, F.lit(" "))
    if align == "right":
        return F.lpad(text, n, F.lit(" "))
    left = F.floor((n - F.length(text)) / 2).cast("int")
    return F.rpad(F.concat(F.repeat(F.lit(" "), left), text), n, F.lit(" "))


def strip_tags(html: Column) -> Column:
    """Markup removed (FN7)."""
    return F.regexp_replace(html, "<[^>]*>", "")


def find_all(needle: str, text: Column) -> Column:
    """Offsets (from 0) of a substring's non-overlapping occurrences (FN8)."""
    parts = F.split(text, F.lit("\\Q" + needle + "\\E"), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * len(needle))
    return F.slice(ends, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def match_positions(query: list[str], tokens: Column) -> Column:
    """Positions (from 0) where a token sequence begins (FN9)."""
    n = len(query)
    last = F.greatest(F.size(tokens) - n, F.lit(-1))
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(tokens, i + 1, n) == F.array(*map(F.lit, query)))


def hashtags(text: Column) -> Column:
    """The different hashtags of a text (FN10)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("#[a-zA-Z_]+"), 0))


def is_capitalized(text: Column) -> Column:
    """Whether the first character is an upper-case letter (FN11)."""
    return F.coalesce(text.rlike(r"^\p{Lu}"), F.lit(False))


def query_param(url: Column, name: str) -> Column:
    """One parameter of a URL's query (FN13)."""
    return F.nullif(F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def keep_query_params(url: Column, names: list[str]) -> Column:
    """The URL with only the named parameters, in their own order (FN13)."""
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: F.substring_index(p, "=", 1).isin(names))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def simplify_uri(uri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """prefix:name where a namespace is known, else the URI; one that is short already stays (FN15)."""
    out = uri
    for prefix, space in prefixes.items():
        out = F.when(uri.startswith(space), F.concat(F.lit(prefix + ":"), F.substr(uri, F.lit(len(space) + 1)))).otherwise(out)
    return F.when(uri.contains(":") & ~uri.contains("://"), uri).otherwise(out)


def full_uri(short: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """The namespace in place of a known prefix; a full URI stays (FN15)."""
    out = short
    for prefix, space in prefixes.items():
        out = F.when(short.startswith(prefix + ":"), F.concat(F.lit(space), F.substr(short, F.lit(len(prefix) + 2)))).otherwise(out)
    return F.when(short.contains("://"), short).otherwise(out)


def in_known_namespace(uri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """Whether the URI begins with a known namespace (FN15)."""
    out = F.lit(False)
    for space in prefixes.values():
        out = out | uri.startswith(space)
    return out


def is_year(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("^[0-9]{4}$"), F.lit(False))


def date_earliest(text: Column) -> Column:
    """A year's first day, else the date itself (FN16)."""
    return F.when(is_year(text), F.concat(F.trim(text), F.lit("-01-01"))).otherwise(F.try_to_date(text).cast("string"))


def date_latest(text: Column) -> Column:
    """A year's last day, else the date itself (FN16)."""
    return F.when(is_year(text), F.concat(F.trim(text), F.lit("-12-31"))).otherwise(F.try_to_date(text).cast("string"))


def split_years(text: Column) -> Column:
    """(birth, death) around the first dash (FN17)."""
    parts = F.split(text, "-", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("birth"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("death"))


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def guarded_uri(base: Column, *guards: Column) -> Column:
    """base/guards joined by /, or empty where one of them is missing (FN19)."""
    some = F.coalesce(base, F.lit("")) != ""
    for g in guards:
        some = some & (F.coalesce(g, F.lit("")) != "")
    return F.when(some, F.concat_ws("/", base, *guards)).otherwise("")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sum_exp(values: Column) -> Column:
    """ln(sum(exp(v))) of an array without overflow (FN20)."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def unravel_index(i: Column, dims: list[int]) -> Column:
    """Coordinates of a flat index, last dimension fastest (FN21)."""
    out, step = [], 1
    for d in reversed(dims):
        out.append((F.floor(i / step) % d).cast("long"))
        step *= d
    return F.array(*reversed(out))


def ravel_index(at: Column, dims: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for k, d in enumerate(dims):
        out = out * d + F.get(at, F.lit(k))
    return out


def rule_constant(text: Column) -> Column:
    """A constant that a rule engine's text format can hold (FN22)."""
    return F.regexp_replace(text, r"[\t\r\n'\"]", " ")


def numbered_label(label: Column, n: Column) -> Column:
    return F.concat(label, F.lit("_"), n.cast("string"))


def unnumbered_label(label: Column) -> Column:
    return F.regexp_replace(label, "_[0-9]+$", "")


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def uniform_bin(v: Column, low: float, high: float, bins: int) -> Column:
    """Number (from 0) of the right-closed bin of equal width (FN24)."""
    width = (high - low) / bins
    return (F.ceil(F.greatest(v - low, F.lit(1e-6)) / width) - 1).cast("long")


def date_share(vals: Column) -> Column:
    """Average of this over non-blank strings is the share that reads as a date (FN25)."""
    return F.try_to_timestamp(vals).isNotNull().cast("double")


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def auto_wrap(text: Column, width: int, delimiters: str = " :_/", camel: bool = True) -> Column:
    """A text broken into lines of at most `width` characters, as late as possible, behind a delimiter or before a capital
    that follows another character (FN4). A part that is longer stands alone; before the first one this leaves a line empty."""
    behind = "[" + re.escape(delimiters) + "]"
    cuts = f"(?<={behind})" + (f"|(?<=[^\\p{{Lu}}{re.escape(delimiters)}])(?=\\p{{Lu}})" if camel else "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))

    def add(acc: Column, part: Column) -> Column:
        fits = F.length(acc["last"]) + F.length(part) <= width
        done = F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], acc["last"], F.lit("\n")))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc["last"], part)).otherwise(part).alias("last"))

    return F.aggregate(F.split(text, cuts, -1), start, add, lambda acc: F.concat(acc["done"], acc["last"]))


def preview(text: Column, start: Column, end: Column, window: int = 30, delimiter: str = " ") -> Column:
    """A part of a text with what stands around it, whole words of at most `window` characters on either side (FN12)."""
    left = F.substr(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))
    right = F.substr(text, end + 1, F.lit(window))
    if delimiter:
        left = F.when(F.locate(delimiter, left) > 0, F.substr(left, F.locate(delimiter, left) + 1)).otherwise(left)
        last = F.length(right) - F.locate(delimiter, F.reverse(right))
        right = F.when(F.locate(delimiter, right) > 0, F.substr(right, F.lit(1), last)).otherwise(F.substr(right, F.lit(1), F.greatest(F.length(right) - 1, F.lit(0))))
    return F.concat(left, F.substr(text, start + 1, end - start), right)
