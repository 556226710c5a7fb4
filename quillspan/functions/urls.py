"""URLs: links of a page, resolving, parts, filters and robots rules. Expressions where not said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of a link.
_ANCHOR = "(?i)<a[^>]*href=[\"']([^\"'#>]+)[\"'][^>]*>"
#: Endings of links that are no pages, and redirecting response codes.
NOT_PAGES = "jpg jpeg png gif svg css js".split()
NOT_CRAWLED = "jpg jpeg gif png txt".split()
REDIRECTS = (301, 302, 303, 307, 308)
#: Language codes that mark a url as not English.
LANGUAGE_CODES = (
    "de es fr it pt ru nl pl tr zh ja ko th vi hi bn id ms sv da fi no is cs sk hu uk el bg hr sr sl ro et lv lt "
    "ar he fa ur ta te ml kn mr gu tl my km ka hy az uz kk"
).split()


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def links(html: Column) -> Column:
    """ARRAY<STRING> of the quoted href values of anchors, without fragments, trimmed."""
    return F.transform(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)), lambda h: F.trim(h))


def parts(url: Column) -> Column:
    """STRUCT<protocol, host, port, path>: without ``//`` all is path, an absent path behind a host is ``/``."""
    whole = "^([^/]*?):?//([^/:]*)(?::([^/]*))?(/.*)?$"
    got = lambda i: F.nullif(F.regexp_extract(url, whole, i), F.lit(""))
    absolute = url.rlike("(?s)^[^/]+//")
    return F.struct(
        F.when(absolute, got(1)).alias("protocol"), F.when(absolute, got(2)).alias("host"), F.when(absolute, got(3)).alias("port"),
        F.when(absolute, F.coalesce(got(4), F.lit("/"))).otherwise(url).alias("path"),
    )


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


def normalize_path(path: Column) -> Column:
    """``.`` and ``..`` resolved, empty segments and a trailing slash removed."""
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when((s == ".") | (s == ""), done).otherwise(F.concat(done, F.array(s)))
    return once(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), _rooted)


def _rooted(kept: Column) -> Column:
    return F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(F.lit(""))


def _default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", "443").otherwise("80")


def absolute(base: Column, link: Column, refused: Sequence[str] = NOT_PAGES) -> Column:
    """``link`` as an absolute http(s) url with an explicit port, seen from ``base``; null if it has none.

    Links without a path get ``/``; links to the ``refused`` endings are null, as are null inputs.
    """
    return once(F.trim(F.regexp_replace(link, "#.*$", "")), lambda clean: _resolved(base, clean, refused))


def _resolved(base: Column, clean: Column, refused: Sequence[str]) -> Column:
    scheme = F.lower(F.regexp_extract(base, "^([A-Za-z]+)://", 1))
    origin = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^[A-Za-z]+://[^/?#]*(/(?:[^?#]*/)?)", 1)
    path, query = F.regexp_extract(clean, "^([^?]*)", 1), F.regexp_extract(clean, "(\\?.*)$", 1)
    relative = F.concat(normalize_path(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), F.when(path.rlike("/$|^\\.\\.?$|/\\.\\.?$"), "/").otherwise(""), query)
    whole = (
        F.when(clean.rlike("^(?i)https?://"), clean)
        .when(clean.rlike("^(?i)[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(clean.startswith("//"), F.concat(scheme, F.lit(":"), clean))
        .when(clean.startswith("/"), F.concat(origin, clean))
        .when(clean == "", base)
        .otherwise(F.concat(origin, relative))
    )
    return once(whole, lambda w: _ported(w, refused))


def _ported(whole: Column, refused: Sequence[str]) -> Column:
    to_scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z]+)://", 1))
    authority, rest = F.regexp_extract(whole, "^[A-Za-z]+://([^/?#]*)", 1), F.regexp_extract(whole, "^[A-Za-z]+://[^/?#]*(.*)$", 1)
    ported = F.when(authority.rlike(":[0-9]+$"), authority).otherwise(F.concat(authority, F.lit(":"), _default_port(to_scheme)))
    done = F.concat(to_scheme, F.lit("://"), ported, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    bad = F.regexp_extract(rest, "^([^?#]*)", 1).rlike(f"\\.(?:{'|'.join(refused)})$") | (authority == "") | ~to_scheme.isin("http", "https")
    return F.when(~bad, done)


def crawl_form(base: Column, link: Column) -> Column:
    """The form in which a crawl names a link: as ``absolute``, host in lower case; links to the page itself are null."""
    lowered = once(absolute(base, link, NOT_CRAWLED), lambda g: F.concat(F.lower(F.regexp_extract(g, "^([a-z]+://[^/]*)", 1)), F.regexp_extract(g, "^[a-z]+://[^/]*(.*)$", 1)))
    return F.when(F.trim(F.regexp_replace(link, "#.*$", "")) != "", lowered)


def raw_links(html: Column) -> Column:
    """First href of each anchor, quoted or bare, fragments kept."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<\\s*(a\\s[^>]*)>"), F.lit(1))
    href = lambda t, i: F.regexp_extract(t, "(?is)\\shref\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'][^\\s]*))", i)
    return F.filter(F.transform(tags, lambda t: F.concat(href(t, 1), href(t, 2), href(t, 3))), lambda h: h != "")


def form_encode(text: Column) -> Column:
    return F.url_encode(text)


def form_decode(text: Column) -> Column:
    return F.try_url_decode(text)


def sanitize(url: Column) -> Column:
    """Form-encoded query with ``=`` and ``&`` kept; without a query, the whole with ``:`` and ``/`` kept."""
    query = F.replace(F.replace(F.url_encode(F.regexp_extract(url, "(?s)\\?(.*)$", 1)), F.lit("%3D"), F.lit("=")), F.lit("%26"), F.lit("&"))
    whole = F.replace(F.replace(F.url_encode(url), F.lit("%3A"), F.lit(":")), F.lit("%2F"), F.lit("/"))
    return F.when(F.instr(url, "?") > 0, F.concat(F.substring_index(url, "?", 1), F.lit("?"), query)).otherwise(whole)


def depth(url: Column) -> Column:
    """Parts of the url between slashes, trailing slashes left out."""
    return F.size(F.split(F.regexp_replace(url, "/+$", ""), "/"))


def is_redirect(code: Column) -> Column:
    return code.isin(*REDIRECTS)


def matches_any(url: Column, patterns: Sequence[str]) -> Column:
    """Whether a url, in lower case and without trailing slashes, fully matches a pattern; null and empty do."""
    if not patterns:
        return F.coalesce(url == "", F.lit(True))
    one = "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"
    return F.coalesce((url == "") | F.regexp_replace(F.lower(url), "/+$", "").rlike(one), F.lit(True))


def language_marked(url: Column, codes: Sequence[str] = LANGUAGE_CODES) -> Column:
    """Whether a path segment or a lang, language or locale parameter names one of ``codes``, which may be
    regional ones (``pt-br``)."""
    low = F.lower(url)
    any_code = "|".join(codes)
    return low.rlike(f"/(?:{any_code})/") | low.rlike(f"(?:lang|language|locale)=(?:{any_code})") | F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(c) for c in codes]))


def language_host(url: Column, labels: Sequence[str]) -> Column:
    """Whether a label of the host in front of the last two is one of ``labels`` (languages, codes, regions)."""
    before = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://((?:[^/:?#.]+[.])+)[^/:?#.]+[.][^/:?#.]+(?:[:/?#]|$)", 1)
    return F.arrays_overlap(F.split(before, "[.]"), F.array(*[F.lit(x) for x in labels]))


def parse_robots(content: Column, agent: Column) -> Column:
    """STRUCT<rules, crawl_delay> for an agent: the rules of all groups that name it, else of those for ``*``, in order.

    A group is one or more user-agent lines and the lines up to the next such line behind rules. Python, in Arrow
    batches, one call per host. Null and empty contents have no rules; of several delays the last counts.
    """
    return F.pandas_udf(_parse_robots, "struct<rules array<struct<rule_type string, prefix string>>, crawl_delay double>")(content, agent)


_FIELD = re.compile(r"^[^\S\r\n]*([A-Za-z-]+)[^\S\r\n]*:([^#\r\n]*)", re.M)


def _groups(text: str) -> list[tuple[set[str], list[tuple[str, str]]]]:
    """(agents, (field, value) lines) of each group of a robots file."""
    out: list[tuple[set[str], list[tuple[str, str]]]] = []
    for name, value in _FIELD.findall(text):
        name, value = name.lower(), value.strip()
        if name == "user-agent":
            if not out or out[-1][1]:
                out.append((set(), []))
            out[-1][0].add(value.lower())
        elif out:
            out[-1][1].append((name, value))
    return out


def _number(text: str) -> float | None:
    return float(text) if re.fullmatch(r"\d+(?:\.\d*)?|\.\d+", text) else None


def _parse_robots(content: pd.Series, agent: pd.Series) -> pd.DataFrame:
    out = []
    for text, own in zip(content, agent, strict=True):
        groups = _groups(text or "")
        mine = [lines for agents, lines in groups if (own or "").lower() in agents] or [lines for agents, lines in groups if "*" in agents]
        lines = [line for group in mine for line in group]
        delays = [d for name, value in lines if name == "crawl-delay" and (d := _number(value)) is not None]
        out.append(([{"rule_type": n, "prefix": v} for n, v in lines if n in ("allow", "disallow")], delays[-1] if delays else None))
    return pd.DataFrame(out, columns=["rules", "crawl_delay"])


def pack_rules(rules: Column) -> Column:
    return F.array_join(F.transform(rules, lambda r: F.concat(r["rule_type"], F.lit("::"), r["prefix"], F.lit(",,"))), "")


def unpack_rules(packed: Column) -> Column:
    pieces = F.filter(F.split(packed, ",,"), lambda p: F.instr(p, "::") > 0)
    return F.transform(pieces, lambda p: F.struct(F.substring_index(p, "::", 1).alias("rule_type"), F.regexp_replace(p, "^.*?::", "").alias("prefix")))


def allowed(path: Column, rules: Column) -> Column:
    """The first rule whose prefix starts the path decides; without one all is allowed. An empty prefix fits any path."""
    fits = F.filter(F.coalesce(rules, F.array().cast("array<struct<rule_type:string,prefix:string>>")), lambda r: F.startswith(path, F.coalesce(r["prefix"], F.lit(""))))
    return F.coalesce(F.get(fits, F.lit(0))["rule_type"] == "allow", F.lit(True))
