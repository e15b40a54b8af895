"""Meta words of a page's summary: equality words such as ``site:`` or ``size:`` as one array column.

Each function takes columns of a summary and gives an array of words; ``with_meta`` joins those whose
columns a table has. A stored array is searched by ``array_contains``, a column predicate that needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls as U

#: Bounds in seconds of the words for durations, and in square pixels of those for images.
DURATIONS = (60, 300, 600, 900, 1800, 3600, 7200)
IMAGE_SIZES = ((50, "tracking"), (100_000, "small"), (400_000, "medium"))


def _word(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(F.concat(F.lit(name + ":"), value.cast("string")))).otherwise(F.array().cast("array<string>"))


def _words(name: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(name + ":"), v.cast("string")))


def url_words(url: Column) -> Column:
    """site:, path:, info:, host: and filetype: of a url."""
    suffixes = U.subdomains(url)
    parts = F.filter(F.split(U.path(url), "/"), lambda p: p != "")
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(steps, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.concat(
        F.array(F.lit("site:all")), _words("site", U.host_paths(url)), _words("site", suffixes), _words("site", F.transform(suffixes, lambda s: F.concat(F.lit("."), s))),
        F.array(F.lit("path:all"), F.lit("path:/")), _words("path", paths), _word("info", url),
        F.when(U.path(url).isin("", "/"), F.array(F.lit("host:all"))).otherwise(F.array().cast("array<string>")), _word("filetype", U.extension(url)),
    )


def response_words(code: Column, size: Column, time: Column, dns: Column, ips: Column, server: Column, modified: Column, locations: Column) -> Column:
    """code:, size:, time:, dns:, ip:, server:, version:, os:, modified: and location: of a response; ``server`` is its header."""
    half = lambda x: F.floor(x / 0.5) * 0.5
    name = F.lower(F.regexp_extract(server, r"^\s*([^/\s(]+)", 1))
    version = F.lower(F.regexp_extract(server, r"/([^\s(]+)", 1))
    system = F.lower(F.regexp_extract(server, r"\(([^)]*)\)", 1))
    some = lambda n, v: F.when(v != "", F.array(F.concat(F.lit(n + ":"), v))).otherwise(F.array().cast("array<string>"))
    days = F.array(*[F.date_format(modified, p) for p in ("yyyy", "yyyy-MM", "yyyy-MM-dd")])
    return F.concat(
        _word("code", code), _word("size", F.floor(size / 5000) * 5000), _word("time", F.format_string("%.1f", half(time))), _word("dns", F.format_string("%.1f", half(dns))),
        _words("ip", ips), some("server", name), some("version", version), some("os", system), F.filter(_words("modified", days), lambda w: w.isNotNull()), _words("location", locations),
    )


def date_words(ts: Column) -> Column:
    """date: of an instant from the year to the second."""
    return _words("date", F.array(*[F.date_format(ts, p) for p in ("yyyy", "yyyy-MM", "yyyy-MM-dd", "yyyy-MM-dd-HH", "yyyy-MM-dd-HH-mm", "yyyy-MM-dd-HH-mm-ss")]))


def link_words(url: Column, links: Column) -> Column:
    """numlinks:, link: and cld: (links that share the page's company domain)."""
    own = U.company_domain(url)
    return F.concat(_word("numlinks", F.size(links)), _words("link", links), _word("cld", F.size(F.filter(links, lambda x: U.company_domain(x) == own))))


def media_words(kind: Column, width: Column, height: Column, seconds: Column) -> Column:
    """media: and duration: of a page that is text, image or video."""
    area = width * height
    size = F.when(area < IMAGE_SIZES[0][0], IMAGE_SIZES[0][1])
    for bound, name in IMAGE_SIZES[1:]:
        size = size.when(area < bound, name)
    size = size.otherwise("large")
    media = F.array(F.lit("media:all"), F.concat(F.lit("media:"), kind))
    image = F.when((kind == "image") & area.isNotNull(), F.array(F.concat(F.lit("media:image-"), size))).otherwise(F.array().cast("array<string>"))
    lasting = F.array(*[F.when(seconds > d, F.lit(f"duration:{d}-plus")).otherwise(F.lit(f"duration:{d}-minus")) for d in DURATIONS])
    return F.concat(media, image, F.when(seconds.isNotNull(), lasting).otherwise(F.array().cast("array<string>")))


def content_words(lang: Column, unsafe: Column, guid: Column, agents: Column) -> Column:
    """lang:, safe:, guid: and robot:."""
    tag = F.array_distinct(F.array(lang, F.element_at(F.split(lang, "-"), 1)))
    safe = F.array(F.lit("safe:all"), F.when(F.coalesce(unsafe, F.lit(False)), "safe:false").otherwise("safe:true"))
    return F.concat(F.filter(_words("lang", tag), lambda w: w.isNotNull()), safe, _word("guid", guid), _words("robot", agents))


def anchor_bonus(links: DataFrame) -> DataFrame:
    """links(term, url, src, generation): 10 * n(term, url) / n(term), n discounted by generation; (term, url, bonus)."""
    from tessera.operators.index import discounted_num_docs

    pairs = links.select("term", "url", "src", "generation").distinct()
    one = pairs.groupBy(F.concat_ws("\u0001", "term", "url").alias("term"), "generation").agg(F.count("*").alias("num_docs"))
    every = pairs.select("term", "src", "generation").distinct().groupBy("term", "generation").agg(F.count("*").alias("num_docs"))
    a = discounted_num_docs(one).select(F.split_part("term", F.lit("\u0001"), F.lit(1)).alias("term"), F.split_part("term", F.lit("\u0001"), F.lit(2)).alias("url"), F.col("discounted").alias("here"))
    return a.join(discounted_num_docs(every), "term").select("term", "url", (10 * F.col("here") / F.col("discounted")).alias("bonus"))
