"""URL parts and canonical forms P0 to P3.

P0 is RFC 3986 normalisation; P1 drops the fragment and trailing slashes; P2
drops tracking parameters and sorts the rest; P3 drops the query and unites
http with https and www with the bare host. Nearly all URLs need nothing that
built-in expressions can't do (no escapes, dot segments, user names or
non-ASCII characters); only the others, each distinct one, visit Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: RFC 3986, appendix B: scheme, authority, path, query, fragment.
PARTS = r"^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Tracking parameters, compared without case.
TRACKING = r"^(?:utm_.*|mc_.*|gclid|fbclid|ref)$"
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_URI = _UNRESERVED | frozenset(":/?#[]@!$&'()*+,;=%")


def part(url: Column, n: int) -> Column:
    """The n-th group of :data:`PARTS`, with its delimiter; empty if absent."""
    return F.regexp_extract(url, PARTS, n)


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.lower(F.regexp_replace(part(url, 2), r"^//(?:.*@)?|:\d*$", ""))


def is_plain(url: Column) -> Column:
    """Whether built-in expressions suffice for P0."""
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[A-Za-z0-9.\-]+(?::\d*)?(?:[/?#][!$&'()*+,;=:@/?#A-Za-z0-9._~\-]*)?$") & ~url.rlike(r"/\.{1,2}(?:[/?#]|$)")


def _plain_p0(url: Column) -> Column:
    scheme = F.lower(part(url, 1))
    authority = F.lower(part(url, 2))
    authority = F.regexp_replace(authority, r":$", "")
    authority = F.when((scheme == "http") & authority.endswith(":80"), F.regexp_replace(authority, r":80$", "")).when(
        (scheme == "https") & authority.endswith(":443"), F.regexp_replace(authority, r":443$", "")
    ).otherwise(authority)
    path = F.when((part(url, 3) == "") & scheme.isin("http", "https"), F.lit("/")).otherwise(part(url, 3))
    return F.concat(scheme, F.lit(":"), authority, path, part(url, 4), part(url, 5))


def escapes(text: str) -> str:
    """Percent-encoding in normal form: unreserved decoded, hex in capitals, other characters as UTF-8."""
    def one(m: re.Match) -> str:
        if m.group(1):
            c = chr(int(m.group(1), 16))
            return c if c in _UNRESERVED else "%" + m.group(1).upper()
        c = m.group()
        return c if c in _URI else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace"))

    return re.sub(r"%([0-9A-Fa-f]{2})|.", one, text, flags=re.S)


_LEADING_DOTS = re.compile(r"\.\.?(?:/|\Z)")
_SEGMENT = re.compile(r"/?[^/]*")


def dot_segments(path: str) -> str:
    """A path without . and .. segments (RFC 3986, 5.2.4).

    Each round takes one segment with the slash before it; a dot segment at the
    end leaves its slash behind.
    """
    kept: list[str] = []
    at = 0
    while at < len(path):
        m = _LEADING_DOTS.match(path, at) if path[at] == "." else None
        if m is not None:
            at = m.end()
            continue
        m = _SEGMENT.match(path, at)
        at = m.end()
        name = m.group().lstrip("/") if m.group().startswith("/") else None
        if name in (".", ".."):
            if name == ".." and kept:
                kept.pop()
            if at == len(path):
                kept.append("/")
        else:
            kept.append(m.group())
    return "".join(kept)


def resolve_text(base: str | None, reference: str | None) -> str | None:
    """A reference against an absolute base (RFC 3986, 5.2.2); null where the base has no scheme.

    White space of HTML around the reference is no part of it.
    """
    if base is None or reference is None:
        return None
    b_scheme, b_authority, b_path, b_query, _ = re.match(PARTS, base, re.S).groups()
    if not b_scheme:
        return None
    scheme, authority, path, query, fragment = re.match(PARTS, reference.strip(" \t\n\f\r"), re.S).groups()
    if scheme:
        path = dot_segments(path)
    else:
        scheme = b_scheme
        if authority is not None:
            path = dot_segments(path)
        else:
            authority = b_authority
            if not path:
                path, query = b_path, b_query if query is None else query
            elif path.startswith("/"):
                path = dot_segments(path)
            elif b_authority is not None and not b_path:
                path = dot_segments("/" + path)
            else:
                path = dot_segments(b_path[: b_path.rfind("/") + 1] + path)
    return "".join([scheme, ":", authority or "", path, query or "", fragment or ""])


@F.pandas_udf(StringType())
def _resolve_udf(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([resolve_text(b, r) for b, r in zip(base, reference)], dtype=object)


def resolve(base: Column, reference: Column) -> Column:
    """The absolute form of a reference found on a page; only relative ones with dots or odd signs visit Python."""
    r = F.regexp_replace(reference, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")
    root = F.concat(part(base, 1), F.lit(":"), part(base, 2))
    absolute = r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:[/?#]|$)") & ~r.rlike(r"/\.{1,2}(?:[/?#]|$)")
    rooted = r.rlike(r"^/(?!/)") & ~r.rlike(r"/\.{1,2}(?:[/?#]|$)") & (part(base, 1) != "")
    simple = F.when(absolute, r).when(rooted, F.concat(root, r))
    return F.coalesce(simple, _resolve_udf(F.when(~(absolute | rooted), base), F.when(~(absolute | rooted), reference)))


def in_scope(url: Column, seed: Column, subdomains: bool = False) -> Column:
    """Whether an http(s) URL has the seed's host and port, or, with ``subdomains``, a host below the seed's without www."""
    def place(c: Column) -> tuple[Column, Column]:
        a = F.lower(F.regexp_replace(part(c, 2), r"^//(?:.*@)?", ""))
        given = F.regexp_extract(a, r":(\d+)$", 1)
        usual = F.when(F.lower(part(c, 1)) == "https", F.lit("443")).otherwise(F.lit("80"))
        return F.regexp_replace(a, r":\d*$", ""), F.when(given == "", usual).otherwise(given)

    (h, p), (sh, sp) = place(url), place(seed)
    web = F.lower(part(url, 1)).isin("http", "https") & (h != "")
    same = (h == sh) & (p == sp)
    if subdomains:
        bare = F.regexp_replace(sh, r"^www\.", "")
        same = (p == sp) & ((h == bare) | F.endswith(h, F.concat(F.lit("."), bare)))
    return web & same


def path_and_query(url: Column) -> Column:
    return F.concat(part(url, 3), part(url, 4))


def short_url(url: Column) -> Column:
    """Path and query for display; the root shows as a slash."""
    return F.when(path_and_query(url) == "", F.lit("/")).otherwise(path_and_query(url))


def is_utility(url: Column, patterns: tuple[str, ...]) -> Column:
    """Whether path and query match one of the patterns, ignoring case."""
    return path_and_query(url).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def p0_text(url: str | None) -> str | None:
    """P0 of any URL or reference."""
    if url is None:
        return None
    scheme, authority, path, query, fragment = re.match(PARTS, url, re.S).groups()
    scheme = scheme.lower() if scheme else None
    if authority is not None:
        user, at, rest = authority[2:].rpartition("@")
        name, port = re.fullmatch(r"(.*?)(?::(\d*))?", rest, re.S).groups()
        name = re.sub(r"%[0-9A-F]{2}|[^%]+", lambda m: m.group() if m.group()[0] == "%" else m.group().lower(), escapes(name))
        keep = port and port != {"http": "80", "https": "443"}.get(scheme or "")
        authority = "//" + (escapes(user) + at) + name + (":" + port if keep else "")
    path = dot_segments(escapes(path))
    if authority is not None and not path and scheme in ("http", "https"):
        path = "/"
    return "".join([f"{scheme}:" if scheme else "", authority or "", path, escapes(query) if query is not None else "", escapes(fragment) if fragment is not None else ""])


@F.pandas_udf(StringType())  # a name of the type would need a session where workers import this module
def _p0_udf(urls: pd.Series) -> pd.Series:
    seen: dict = {}
    return urls.map(lambda u: None if u is None else seen[u] if u in seen else seen.setdefault(u, p0_text(u)))


def p0(url: Column, exact: bool = True) -> Column:
    """P0. Without ``exact``, URLs that built-in expressions can't normalise stay as they are."""
    other = _p0_udf(F.when(~is_plain(url), url)) if exact else url
    return F.when(is_plain(url), _plain_p0(url)).otherwise(other)


def _rebuilt(url: Column, path: Column, query: Column) -> Column:
    scheme = F.when(part(url, 1) != "", F.concat(part(url, 1), F.lit(":"))).otherwise(F.lit(""))
    return F.concat(scheme, part(url, 2), path, query)


def p1_of(p0_url: Column) -> Column:
    path = part(p0_url, 3)
    short = F.regexp_replace(path, r"/+$", "")
    short = F.when(F.length(path) > 1, F.when(short == "", F.lit("/")).otherwise(short)).otherwise(path)
    return _rebuilt(p0_url, short, part(p0_url, 4))


def p2_of(p1_url: Column) -> Column:
    items = F.transform(
        F.split(F.regexp_replace(part(p1_url, 4), r"^\?", ""), "&"), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))
    )
    kept = F.array_sort(F.filter(items, lambda x: (x["p"] != "") & ~F.lower(x["k"]).rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda x: x["p"]), "&")
    return _rebuilt(p1_url, part(p1_url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def p3_of(p2_url: Column) -> Column:
    http = part(p2_url, 1).isin("http", "https") & (part(p2_url, 2) != "")
    authority = part(p2_url, 2)
    bare = F.regexp_replace(authority, r"^//(.*@)?www\.(?=[^:]*\.)", "//$1")
    return F.when(http, F.concat(F.lit("https:"), bare, part(p2_url, 3))).otherwise(_rebuilt(p2_url, part(p2_url, 3), F.lit("")))


def canonical(url: Column, policy: int, exact: bool = True) -> Column:
    """P0 to P3 of a URL column; null stays null."""
    out = p0(url, exact)
    for k, step in ((1, p1_of), (2, p2_of), (3, p3_of)):
        if policy >= k:
            out = step(out)
    return out


def section(url: Column) -> Column:
    """First path segment, or empty at the top level."""
    return F.regexp_extract(part(url, 3), r"^/([^/]+)/", 1)
