"""Wiki markup (T30-T32): html, links and headings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_html(markup: Column) -> Column:
    """Headings 1-5, bold, italics, links, lists and rules; other text is escaped."""
    out = escape(markup)
    for n in range(5, 0, -1):
        out = F.regexp_replace(out, rf"(?m)^={{{n}}}\s*([^=\n].*?)\s*={{{n}}}\s*$", f"<h{n}>$1</h{n}>")
    out = F.regexp_replace(out, r"'''(.+?)'''", "<b>$1</b>")
    out = F.regexp_replace(out, r"''(.+?)''", "<i>$1</i>")
    out = F.regexp_replace(out, r"\[\[([^|\]]+)\|([^\]]+)\]\]", '<a href="$1">$2</a>')
    out = F.regexp_replace(out, r"\[\[([^\]]+)\]\]", '<a href="$1">$1</a>')
    out = F.regexp_replace(out, r"(?m)^----+\s*$", "<hr>")
    for mark, tag in ((r"\*", "ul"), ("#", "ol")):
        out = F.regexp_replace(out, rf"(?m)^{mark}\s*(.+)$", f"\u0001<li>$1</li>")
        out = F.regexp_replace(out, r"((?:\u0001<li>.*?</li>\n?)+)", f"<{tag}>$1</{tag}>")
        out = F.replace(out, F.lit("\u0001"), F.lit(""))
    return out


def links(markup: Column) -> Column:
    """Targets of internal links, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(markup, F.lit(r"\[\[([^|\]]+)"), F.lit(1)), F.trim))


def headings(markup: Column) -> Column:
    """(level, title) of the headings, in order."""
    found = F.regexp_extract_all(markup, F.lit(r"(?m)^(={1,5}\s*[^=\n].*?\s*={1,5})\s*$"), F.lit(1))
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "^=+", 0)).alias("level"), F.trim(F.regexp_replace(h, "^=+|=+$", "")).alias("title")))
