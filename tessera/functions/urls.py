"""Web addresses and the tags that hold them: RFC 3986 references, attributes and character entities, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import col, let

#: scheme with its colon, authority with its slashes, path, query with its mark, fragment with its mark (RFC 3986, appendix B).
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Parts of a tag's text: its quoted values may hold anything. The bound keeps the matcher's stack small.
TAG = r"""(?is)<(?:{names})(?:[\s/](?:[^>"']++|"[^"]*+"|'[^']*+'){{0,255}}+)?>"""
ATTRIBUTE = r"""(?is)([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
#: What a parser of HTML does not read as tags.
UNREAD = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)|<style\b.*?(?:</style|$)"
#: The named entities that addresses hold.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
BLANK = " \t\n\r\f"


def _fold(path: Column) -> Column:
    """A path without its dot segments: ``..`` takes the segment before it, never the root."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(x))),
    )
    last = F.element_at(parts, -1)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def without_dots(path) -> Column:
    p = col(path)
    return F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), _fold(p)).otherwise(p)


def resolve(base, reference) -> Column:
    """The address that a reference means on the page ``base``; null if either is null.

    An empty reference is the page itself. A reference with the page's own scheme and no authority
    counts as relative; others with a scheme stay as they are.
    """
    b, r = col(base), F.btrim(col(reference), F.lit(BLANK))
    part = lambda of, k: F.regexp_extract(of, PARTS, k)
    scheme, site, path, query = (part(b, k) for k in (1, 2, 3, 4))
    own, r_site, r_path, r_query, r_mark = (part(r, k) for k in (1, 2, 3, 4, 5))
    folder = F.when((site != "") & (path == ""), F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)?", 1))
    found = (
        F.when(r == "", b)
        .when((own != "") & ((F.lower(own) != F.lower(scheme)) | (r_site != "")), r)
        .when(r_site != "", F.concat(scheme, r_site, r_path, r_query, r_mark))
        .when(r_path == "", F.concat(scheme, site, path, F.when(r_query != "", r_query).otherwise(query), r_mark))
        .when(r_path.startswith("/"), F.concat(scheme, site, without_dots(r_path), r_query, r_mark))
        .otherwise(F.concat(scheme, site, without_dots(F.concat(folder, r_path)), r_query, r_mark))
    )
    return F.when(b.isNotNull(), found)


def unescape(text) -> Column:
    """Numeric entities and the named ones of ``NAMED`` as characters; others stay as written."""
    return let(col(text), lambda t: F.when(F.contains(t, F.lit("&")), _pieces(t)).otherwise(t))


def _pieces(t: Column) -> Column:
    pieces = F.regexp_extract_all(t, F.lit(r"(?s)&(?:#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[a-z]{2,4});|[^&]++|&"), F.lit(0))

    def point(code: Column, piece: Column) -> Column:
        legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(piece)

    def one(piece: Column) -> Column:
        out = F.when(piece.rlike("^&#[xX]"), point(F.conv(F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("long"), piece))
        out = out.when(piece.startswith("&#"), point(F.regexp_extract(piece, "^&#([0-9]+)", 1).cast("long"), piece))
        for name, letter in NAMED.items():
            out = out.when(piece == f"&{name};", F.lit(letter))
        return out.otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def tags(html, *names: str) -> Column:
    """The opening tags of these names, as written, outside comments, scripts and styles."""
    read = F.regexp_replace(F.coalesce(col(html), F.lit("")), UNREAD, " ")
    return F.regexp_extract_all(read, F.lit(TAG.format(names="|".join(names))), F.lit(0))


def attribute(tag, name: str) -> Column:
    """The first value of an attribute of a tag, without quotes and entities; null if it has none."""
    t = F.regexp_replace(col(tag), r"^<[A-Za-z0-9]+", "")
    names, values = (F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    first = let(F.array_position(F.transform(names, F.lower), name), lambda at: F.when(at > 0, F.get(values, (at - 1).cast("int"))))
    return unescape(F.regexp_replace(first, r"""(?s)^(["'])(.*)\1$""", "$2"))
