"""Escaping and naming functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.url import ARROW, drop_repeats, path_to_name

MAX_LITERAL = 250
MAX_NAME = 180
#: Line ends that close a comment (fixed values).
LINE_ENDS = "\r\n\u2028\u2029"


def string_literal(value: Column, max_len: int | None = MAX_LITERAL) -> Column:
    """A double-quoted script literal: JSON quoting, then <, backtick, U+2028/9 and ${ as \\u escapes; null is empty."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    s = F.left(s, F.lit(max_len)) if max_len is not None else s
    quoted = F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    quoted = F.replace(quoted, F.lit("\\/"), F.lit("/"))
    for raw, code in (("<", "\\u003c"), ("`", "\\u0060"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"), ("${", "\\u0024{")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(code))
    return quoted


def line_comment(value: Column, max_len: int | None = MAX_LITERAL) -> Column:
    """Text that can't end a // comment."""
    s = F.translate(F.coalesce(value.cast("string"), F.lit("")), LINE_ENDS, " " * len(LINE_ENDS))
    return F.left(s, F.lit(max_len)) if max_len is not None else s


def block_comment(value: Column, max_len: int | None = MAX_LITERAL) -> Column:
    """Text that can't end a block comment."""
    return line_comment(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("*/"), F.lit("* /")), max_len)


def camel_case(s: Column) -> Column:
    """camelCase of the ASCII letter and digit runs; ``unnamed`` if there are none."""
    parts = F.filter(F.split(F.regexp_replace(s, "[^a-zA-Z0-9]", " "), " +"), lambda x: x != "")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x)))))
    return F.when(F.size(parts) == 0, "unnamed").otherwise(F.concat(F.lower(F.get(parts, F.lit(0))), F.array_join(rest, "")))


def url_variable(url: Column) -> Column:
    """Name for the first :parameter of a normalised URL: the segment before it (or ``resource``) and the parameter."""
    parts = F.split(F.regexp_replace(url, "^/+|/+$", ""), "/")
    at = F.array_position(F.transform(parts, lambda p: p.startswith(":")), True)
    return F.when(at > 0, F.concat(F.when(at > 1, F.get(parts, (at - 2).cast("int"))).otherwise("resource"), F.lit("_"), F.substring(F.get(parts, (at - 1).cast("int")), 2, 1000)))


def element_variable(element: Column) -> Column:
    """Name for a locator: its name option, else its first quoted argument; null for other locators."""
    named = F.regexp_extract(element, r'name:\s*"([^"]*)"', 1)
    first = F.regexp_extract(element, r'"([^"]*)"', 1)
    has_name, has_first = element.rlike(r'name:\s*"[^"]*"'), element.rlike(r'"[^"]*"')
    role = F.when(has_name, camel_case(named)).when(has_first, camel_case(first))
    other = F.when(element.rlike("^getBy(TestId|Label|Placeholder)") & has_first, camel_case(first))
    return F.when(element.startswith("getByRole"), role).otherwise(other)


def url_example(url: Column) -> Column:
    return F.when(url.contains(":uuid"), "00000000-0000-4000-8000-000000000001").when(url.contains(":id"), "1").when(url.contains(":slug"), "example-item").otherwise("")


def flow_name(pattern: Column) -> Column:
    """``first to last`` page name of a pattern."""
    pages = F.split(pattern, ARROW)
    first = path_to_name(F.get(pages, F.lit(0)))
    return F.when(F.size(pages) < 2, first).otherwise(F.concat(first, F.lit(" to "), path_to_name(F.element_at(pages, -1))))


def flow_file(pattern: Column, index: Column, extension: str = ".spec.ts") -> Column:
    """File name of a flow: its page names without consecutive repeats, slugged; long ones are cut and hashed."""
    names = drop_repeats(F.transform(F.split(pattern, ARROW), path_to_name))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.array_join(names, "-to-")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.when(F.length(slug) > MAX_NAME, F.concat(F.left(slug, F.lit(MAX_NAME)), F.lit("-"), F.left(F.md5(pattern), F.lit(8)))).otherwise(slug)
    return F.concat(cut, F.when(index > 0, F.concat(F.lit("-"), (index + 1).cast("string"))).otherwise(""), F.lit(extension))


def parse_timestamp(ts: Column) -> Column:
    return F.try_to_timestamp(ts)


def truncate(s: Column, max_len: int = 50) -> Column:
    """White space collapsed and trimmed; over ``max_len`` characters cut with dots."""
    t = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(F.length(t) > max_len, F.concat(F.left(t, F.lit(max_len)), F.lit("..."))).otherwise(t)
