"""SQL for tags, attributes and references of web pages, as ``functions.urls`` reads them."""

from __future__ import annotations

_UNREAD = "(?is)<!--.*?(?:-->|$)|<script\\b.*?(?:</script|$)|<style\\b.*?(?:</style|$)"
_ATTRIBUTE = """(?is)([^\\s"''<>/=]+)(?:\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+))?"""
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def tags(html: str, *names: str) -> str:
    pattern = f"""(?is)<(?:{"|".join(names)})(?:[\\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*)?>"""
    return f"regexp_extract_all(regexp_replace(coalesce({html}, ''), '{_UNREAD}', ' ', 'g'), '{pattern}')"


def attribute(tag: str, name: str) -> str:
    """The value with named entities resolved; null if the tag has none."""
    rest = f"regexp_replace({tag}, '^<[A-Za-z0-9]+', '')"
    at = f"list_position(list_transform(regexp_extract_all({rest}, '{_ATTRIBUTE}', 1), lambda n: lower(n)), '{name}')"
    value = f"regexp_extract_all({rest}, '{_ATTRIBUTE}', 2)[{at}]"
    out = f"""CASE WHEN left({value}, 1) IN ('"', '''') THEN {value}[2:-2] ELSE {value} END"""
    for entity, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{entity};', '{letter}')"
    return f"CASE WHEN {at} > 0 THEN {out} END"


def _without_dots(path: str) -> str:
    kept = f"""list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda o, x: CASE x[1] WHEN '.' THEN o WHEN '..' THEN CASE WHEN len(o) > 1 THEN o[:len(o) - 1] ELSE o END ELSE list_concat(o, x) END, []::VARCHAR[])"""
    return f"CASE WHEN regexp_matches({path}, '(^|/)\\.\\.?(/|$)') THEN array_to_string({kept}, '/') || CASE WHEN regexp_matches({path}, '(^|/)\\.\\.?$') THEN '/' ELSE '' END ELSE {path} END"


def resolve(base: str, reference: str) -> str:
    """The address that a reference means on a page."""
    r = f"trim({reference}, ' \t\n\r\f')"
    part = lambda of, k: f"regexp_extract({of}, '{_PARTS}', {k}, 's')"
    scheme, site, path, query = (part(base, k) for k in (1, 2, 3, 4))
    own, r_site, r_path, r_query, r_mark = (part(r, k) for k in (1, 2, 3, 4, 5))
    folder = f"CASE WHEN {site} <> '' AND {path} = '' THEN '/' ELSE regexp_extract({path}, '^(.*/)?', 1, 's') END"
    return f"""CASE WHEN {r} = '' THEN {base}
 WHEN {own} <> '' AND (lower({own}) <> lower({scheme}) OR {r_site} <> '') THEN {r}
 WHEN {r_site} <> '' THEN {scheme} || {r_site} || {r_path} || {r_query} || {r_mark}
 WHEN {r_path} = '' THEN {scheme} || {site} || {path} || CASE WHEN {r_query} <> '' THEN {r_query} ELSE {query} END || {r_mark}
 WHEN left({r_path}, 1) = '/' THEN {scheme} || {site} || {_without_dots(r_path)} || {r_query} || {r_mark}
 ELSE {scheme} || {site} || {_without_dots(f"(({folder}) || {r_path})")} || {r_query} || {r_mark} END"""
