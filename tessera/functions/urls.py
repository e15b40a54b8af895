"""URL columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    """The scheme, http if there is none."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.lower(F.when(found == "", "http").otherwise(found))


def crawlable(url: Column) -> Column:
    """Y1."""
    return scheme(url).isin("http", "https", "gopher")


def host_name(url: Column) -> Column:
    """The host alone, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host(url: Column) -> Column:
    """Scheme and authority."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def base_domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host_name(url), r"^www\.", "")


def port(url: Column) -> Column:
    """The port, 80 if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)", 1)
    return F.when(found == "", F.lit(80)).otherwise(found.try_cast("int"))


def path(url: Column) -> Column:
    """The path; / if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(url: Column) -> Column:
    """Y17."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    """Y18."""
    return F.regexp_extract(url, r"#(.*)$", 1)


def extension(url: Column, default: str = "html") -> Column:
    """The file extension of the last path part."""
    found = F.lower(F.regexp_extract(path(url), r"[^/]\.([A-Za-z0-9]+)$", 1))
    return F.when(found == "", F.lit(default)).otherwise(found)


def file_name(url: Column) -> Column:
    """The last path part without its extension."""
    return F.regexp_extract(path(url), r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)


def host_paths(url: Column) -> Column:
    """The host followed by every prefix of the path."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    longer = F.transform(steps, lambda n: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.concat(F.array(host(url)), longer)


def subdomains(url: Column) -> Column:
    """Every suffix of the host."""
    parts = F.split(host_name(url), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def company_domain(url: Column) -> Column:
    """The last two labels; three under a two-letter country whose second label has at most three letters."""
    parts = F.split(host_name(url), r"\.")
    short = (F.size(parts) >= 3) & (F.length(F.element_at(parts, -1)) == 2) & (F.length(F.try_element_at(parts, F.lit(-2))) <= 3)
    n = F.least(F.size(parts), F.when(short, 3).otherwise(2))
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")


def recursive(url: Column, most: int = 3) -> Column:
    """P20: whether a path part stands more than ``most`` times in the path."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    return F.exists(parts, lambda p: F.size(F.filter(parts, lambda q: q == p)) > most)


def words(url: Column) -> Column:
    """Letters and digits of host and path, by spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://(www\.)?", ""), r"[^\p{L}\p{N}]+", " "))


def resolve(link: Column, base: Column) -> Column:
    """An absolute url for a link of a page; null when ``..`` leads above the root."""
    root = host(base)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    rest = F.regexp_replace(link, "#.*$", "")
    joined = F.when(rest.startswith("/"), rest).otherwise(F.concat(folder, rest))
    # A stack of parts: ".." takes one away, and null once there is none to take.
    stack = F.aggregate(
        F.filter(F.split(joined, "/"), lambda p: ~p.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.array_append(acc, p)),
    )
    slash = F.when(joined.endswith("/") & (F.size(stack) > 0), "/").otherwise("")
    relative = F.concat(root, F.lit("/"), F.array_join(stack, "/"), slash)
    return F.when(rest.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), rest).when(rest.startswith("//"), F.concat(scheme(base), F.lit(":"), rest)).otherwise(relative)


def path_rule_regex(rule: str) -> str:
    """A robots path rule (``*`` any run, trailing ``$`` end) as a regular expression."""
    end = rule.endswith("$")
    parts = (rule[:-1] if end else rule).split("*")
    return "^" + ".*".join(r"\Q" + p + r"\E" if p else "" for p in parts) + ("$" if end else "")


def robots_allowed(target: Column, allowed: list[str], disallowed: list[str]) -> Column:
    """Allowed unless a disallow rule matches and no allow rule does; without rules allowed."""
    def matches(rules: list[str]) -> Column:
        return F.lit(False) if not rules else target.rlike("|".join(map(path_rule_regex, rules)))

    return matches(allowed) | ~matches(disallowed)


def has_host(url: Column) -> Column:
    """Y3."""
    return F.coalesce(host_name(url) != "", F.lit(False))


def display_url(url: Column, most: int) -> Column:
    """Y2: the url without scheme and last slash, its middle left out beyond ``most`` characters, escapes decoded but for spaces."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "/$", "")
    size = F.length(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    front, end = -(-most * 4 // 5), -(-most // 5)
    short = F.when(size > most, F.concat(F.substring(bare, 1, front), F.lit("..."), F.right(bare, F.lit(end)))).otherwise(bare)
    return F.replace(F.coalesce(F.try_url_decode(short), short), F.lit(" "), F.lit("%20"))


def host_and_path(url: Column) -> Column:
    """Struct (host, path); the path is null where the url has none, both where it has no host."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    some = has_host(url)
    return F.struct(F.when(some, host(url)).alias("host"), F.when(some & (found != ""), found).alias("path"))


def host_words(url: Column) -> Column:
    """The words of the host of a root url but its last label and a leading www; empty for others."""
    parts = F.split(host_name(url), r"\.|-")
    named = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.when(F.try_element_at(named, F.lit(1)).contains("www"), F.slice(named, F.lit(2), F.greatest(F.size(named) - 1, F.lit(0)))).otherwise(named)
    root = path(url).isin("", "/") & ~url.contains("?") & ~url.contains("#") & has_host(url)
    return F.when(root & (F.size(parts) > 1), F.array_join(named, " ")).otherwise("")


def last_path_words(url: Column) -> Column:
    """The words of the last path part without its extension."""
    last = F.regexp_extract(path(url), r"([^/]*?)(?:\.[^./]*)?/?$", 1)
    return F.array_join(F.filter(F.split(F.coalesce(F.try_url_decode(last), last), r"[_\- +.]"), lambda w: w != ""), " ")


def is_localhost(url: Column) -> Column:
    """Y20."""
    return F.coalesce(host_name(url).rlike(r"localhost|127\.0\.0\.1|::1"), F.lit(False))


#: The language of top-level domains.
TLD_LANGUAGES = {
    "en": "us uk ca au bz ie jm nz za zw tt", "ar": "eg dz bh jo kw lb iq ma om qa sa sy tn ae ye", "de": "de at",
    "es": "es ar bo cl co cr dr ec sv gt hn mx ni pa py pe pr uy ve", "fr-FR": "fr be lu", "zh-CN": "hk sg tw cn", "in-ID": "id",
    "he": "il", "fa": "ir", "it": "it", "ja": "jp", "ko": "kp kr", "pl": "pl", "pt": "br pt", "fr": "qc", "ru": "ru", "th": "th",
    "tr": "tr", "vi-VN": "vi vn",
}
#: First labels that name a language under a generic domain.
HOST_LANGUAGES = (
    "az ar ba be bg bn bo br bs ca co cs cy da de ds dv el en es eu fa fi fil fo fr fy ga gd gl gsw gu ha he hi hr hsb hu hy id ig ii is it iu ja "
    "ka kk kl km kn kok ko ky lb lo lt lv mi mk ml mn moh mr ms mt nb ne nl nn nso oc or pa pl prs ps pt qut quz rm ro ru rw sah sa se si sk sl sma "
    "smj smn sms sq sr sv sw syr ta te tg th tk tn tr tt tzm ug uk ur uz vi wo xh yo zh zu"
).split()
GENERIC_DOMAINS = ("com", "edu", "gov", "mil", "org", "net")


def language(url: Column) -> Column:
    """The language that a url's domain tells: by country, or by the first label under a generic domain (en if that is none); else null."""
    parts = F.split(host_name(url), r"\.")
    last = F.element_at(parts, -1)
    tld = F.when((last == "ca") & (F.try_element_at(parts, F.lit(-2)) == "qc"), "qc").otherwise(last)
    by_tld = F.create_map(*[F.lit(x) for lang, names in TLD_LANGUAGES.items() for t in names.split() for x in (t, lang)])
    first = F.element_at(parts, 1)
    generic = F.when(tld.isin(*GENERIC_DOMAINS), F.when(first.isin(*HOST_LANGUAGES), first).otherwise("en"))
    return F.when(has_host(url), F.coalesce(F.try_element_at(by_tld, tld), generic))


#: Mime types by file extension.
MIME_TYPES = {
    "bmp": "image/bmp", "doc": "application/msword", "epub": "application/epub+zip", "gif": "image/gif", "asp": "text/asp", "aspx": "text/asp",
    "cgi": "text/html", "cfm": "text/html", "cfml": "text/html", "do": "text/html", "htm": "text/html", "html": "text/html", "jsp": "text/html",
    "php": "text/html", "pl": "text/html", "java": "text/java", "py": "text/py", "shtml": "text/html", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "pdf": "application/pdf", "png": "image/png", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "rss": "application/rss+xml", "rtf": "text/rtf",
    "svg": "image/svg+xml", "csv": "text/csv", "tab": "text/tab-separated-values", "tsv": "text/x-java-source", "txt": "text/plain",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xml": "text/xml", "js": "text/plain", "c": "text/plain",
    "cc": "text/plain", "cs": "text/plain",
}


def mime_type(url: Column, default: str = "text/plain") -> Column:
    """Y23."""
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(url)), F.lit(default))


def member_of(url: Column, sites: list[str]) -> Column:
    """Whether a site list has a url: ``domain:`` ends its host, ``regex:`` is found in it, or host and path follow a rule with ``*`` and ``$``."""
    found = F.lit(False)
    for site in sites:
        if site.startswith("domain:"):
            found = found | F.endswith(host_name(url), F.lit(site[7:].lower()))
        elif site.startswith("regex:"):
            found = found | url.rlike(site[6:])
        else:
            m = re.match(r"([A-Za-z][A-Za-z0-9+.*-]*://[^/?#]*)(.*)", site)
            if m:
                rest = F.regexp_replace(F.substring(url, F.length(host(url)) + 1, F.length(url)), "#.*$", "")
                found = found | (host(url).rlike(path_rule_regex(m[1])) & rest.rlike(path_rule_regex(m[2] or "/")))
    return F.coalesce(found, F.lit(False))


def may_crawl(url: Column, allowed: list[str] | None, denied: list[str], types: list[str] | None = None) -> Column:
    """An allow list, where there is one, has the url, the deny list hasn't, and its extension is one of ``types``."""
    ok = ~member_of(url, denied)
    if allowed is not None:
        ok = ok & member_of(url, allowed)
    return ok if types is None else ok & extension(url).isin(*types)
