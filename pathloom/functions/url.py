"""URL functions as Column expressions, by regular expressions (Spark's own parser rejects odd URLs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARROW = " → "
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"


def present(c: Column) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, _SCHEME, ""), r"^//([^/?#]*)", 1)


def _path_and_params(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, _SCHEME, ""), r"(?s)^(?://[^/?#]*)?([^?#]*)", 1)


def path(url: Column) -> Column:
    """The path without query, fragment and ;parameters of the last segment."""
    return F.regexp_extract(_path_and_params(url), r"(?s)^((?:.*/)?[^;/]*)(?:;[^/]*)?$", 1)


def normalise_segment(segment: Column) -> Column:
    """A dynamic path segment as :uuid, :objectId, :id or :slug; others unchanged. The first rule that holds counts."""
    return (
        F.when(segment.rlike(r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), ":uuid")
        .when(segment.rlike(r"(?i)\A[0-9a-f]{24}\z"), ":objectId")
        .when(segment.rlike(r"^\p{Nd}+$"), ":id")
        .when(segment.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)+$") & (F.length(segment) >= 5), ":slug")
        .otherwise(segment)
    )


def normalise_url(url: Column) -> Column:
    """The path with dynamic segments replaced; URLs that begin with ``http`` keep scheme, host and ;parameters."""
    url = F.coalesce(url, F.lit(""))
    whole = _path_and_params(url)
    plain = F.array_join(F.transform(F.split(path(url), "/"), lambda s: F.when(s == "", s).otherwise(normalise_segment(s))), "/")
    params = F.regexp_extract(whole, r"(?s)^(?:.*/)?[^;/]*(;[^/]*)?$", 1)
    host = authority(url)
    rooted = F.when((host != "") & (plain != "") & ~plain.startswith("/"), F.concat(F.lit("/"), plain)).otherwise(plain)
    full = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), rooted, F.when(params == ";", "").otherwise(params))
    return F.when(url.startswith("http"), full).otherwise(plain)


def drop_repeats(items: Column) -> Column:
    """An array without elements that equal the one before."""
    # bound: a lambda that names ``items`` itself would compute the whole array again for each element
    return bound(items, lambda all: F.filter(all, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(all, i - 1))))


def url_sequence(urls: Column) -> Column:
    """Normalised URLs without consecutive repeats, joined by arrows; an empty array gives an empty string."""
    return joined(F.transform(urls, normalise_url))


def joined(normalised: Column) -> Column:
    """The same of URLs that are normalised already."""
    return F.array_join(drop_repeats(normalised), ARROW)


# Schemes whose references may be relative; others give the reference itself.
JOINABLE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]


def _params(url: Column) -> Column:
    """The ;parameters of the last path segment, without the semicolon."""
    return F.regexp_extract(_path_and_params(url), r"(?s)^(?:.*/)?[^;/]*;([^/]*)$", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def _without_dots(segments: Column) -> Column:
    """A path of its segments, . and .. carried out; empty segments within go."""
    last = F.size(segments) - 1
    kept = F.filter(segments, lambda x, i: (x != "") | (i == 0) | (i == last))
    walked = F.aggregate(kept, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x)))
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    return F.coalesce(present(F.array_join(ended, "/")), F.lit("/"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join(base: Column, reference: Column) -> Column:
    """A reference resolved on a base URL by RFC 3986, as a browser follows a link; null if one of them is."""
    ref = F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(x: Column) -> Column:
        rest = x["rest"]
        return F.struct(
            x["base"].alias("base"), x["given"].alias("given"), x["ref"].alias("ref"), rest.alias("rest"), scheme(x["ref"]).alias("scheme"), path(rest).alias("path"), _params(rest).alias("params"), _query(rest).alias("query"),
            scheme(x["base"]).alias("base_scheme"), authority(x["base"]).alias("host"), path(x["base"]).alias("base_path"), _params(x["base"]).alias("base_params"), F.split(path(x["base"]), "/").alias("up"),
        )

    def whole(x: Column) -> Column:
        up, host = x["up"], x["host"]
        folder = F.when(F.element_at(up, -1) != "", F.slice(up, F.lit(1), F.size(up) - 1)).otherwise(up)
        segments = F.when(x["path"].startswith("/"), F.split(x["path"], "/")).otherwise(F.concat(folder, F.split(x["path"], "/")))
        empty = (x["path"] == "") & (x["params"] == "")
        params = F.when(empty, x["base_params"]).otherwise(x["params"])
        query = F.when(empty & (x["query"] == ""), _query(x["base"])).otherwise(x["query"])
        after = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
        tail = F.concat(after(";", params), after("?", query), after("#", F.regexp_extract(x["rest"], r"(?s)#(.*)$", 1)))
        named = F.when(x["base_scheme"] != "", F.concat(x["base_scheme"], F.lit(":"))).otherwise("")

        def full(where: Column) -> Column:
            rooted = F.when((host != "") & (where != "") & ~where.startswith("/"), F.concat(F.lit("/"), where)).otherwise(where)
            return F.concat(named, F.when((host != "") | ((named != "") & rooted.startswith("/")), F.concat(F.lit("//"), host)).otherwise(""), rooted, tail)

        other = (x["scheme"] != "") & (x["scheme"] != x["base_scheme"])
        as_it_is = (x["base"] == "") | other | ~x["base_scheme"].isin(JOINABLE)
        return F.when(as_it_is, x["given"]).when(x["rest"].startswith("//"), F.concat(named, x["rest"])).otherwise(bound(F.when(empty, x["base_path"]).otherwise(_without_dots(segments)), full))

    given = F.struct(base.alias("base"), reference.alias("given"), ref.alias("ref"), F.regexp_replace(ref, _SCHEME, "").alias("rest"))
    return F.when(base.isNotNull() & reference.isNotNull(), bound(bound(given, parts), whole))


def link_href(target: str) -> Column:
    """The href of a link target (tag A) that can lead to another page, else null."""
    href = F.try_element_at(F.col(f"{target}.attributes"), F.lit("href"))
    ok = (F.upper(F.col(f"{target}.tag")) == "A") & (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")
    return F.when(ok, href)


def resolve(href: Column, current: Column) -> Column:
    """Absolute references as they are, root-relative ones on the current origin, others by RFC 3986."""
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(scheme(current), F.lit("://"), authority(current), href)).otherwise(join(current, href))


def is_link_nav(target: str = "target", url: str = "url") -> Column:
    """Whether a click's target is a link to another page; an unknown current page counts as another."""
    href, current = link_href(target), F.coalesce(F.col(url), F.lit(""))
    return F.when(href.isNull(), False).when(current == "", True).otherwise(F.coalesce(path(resolve(href, current)) != path(current), F.lit(False)))


def link_destination(target: str = "target", url: str = "url") -> Column:
    """Where a link leads, the same page included; null for targets that aren't links."""
    return resolve(link_href(target), F.coalesce(F.col(url), F.lit("")))


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([.*+?^${}()|\[\]\\/])", r"\\$1")


def path_to_name(p: Column) -> Column:
    """A page name from a path: its last segment, placeholders in words; the root is ``home``."""
    trimmed = F.regexp_replace(p, r"^/+|/+$", "")
    named = F.replace(F.replace(F.replace(trimmed, F.lit(":uuid"), F.lit("item")), F.lit(":id"), F.lit("item")), F.lit(":slug"), F.lit("page"))
    return F.when(trimmed == "", "home").otherwise(F.element_at(F.split(named, "/"), -1))


def origin(url: Column) -> Column:
    """scheme://host of an http(s) URL, else null."""
    return F.when(url.rlike("^https?://"), F.concat(scheme(url), F.lit("://"), authority(url)))


def base_url(events: DataFrame, flow: str, order: str, url: str = "url", default: str = "https://localhost") -> DataFrame:
    """One row: the origin that most flows begin with (ties: the flow that comes first), else the default."""
    firsts = events.where(origin(F.col(url)).isNotNull()).groupBy(flow).agg(F.min_by(origin(F.col(url)), F.col(order)).alias("o"))
    top = firsts.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.min(flow).alias("f")).orderBy(F.desc("n"), "f").limit(1)
    return top.agg(F.coalesce(F.first("o"), F.lit(default)).alias("base_url"))


def is_excluded(url: Column, patterns: list[str]) -> Column:
    """Whether a URL equals a pattern, or its path (or for patterns with a scheme the whole) matches it as a glob."""
    where = F.coalesce(present(path(url)), F.lit("/"))
    out = F.lit(False)
    for p in patterns:
        hit = (url == p) | where.rlike(glob_regex(p))
        if "://" in p:
            hit = hit | url.rlike(glob_regex(p))
        out = out | hit
    return F.coalesce(out, F.lit(False))


def glob_regex(pattern: str) -> str:
    """An anchored Java regex for a shell glob: * and ? cross slashes, [seq] and [!seq] are sets."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        end = pattern.find("]", i + (pattern[i : i + 1] == "!") + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or c in "_/" else "\\" + c
    return rf"(?s)\A{out}\z"


