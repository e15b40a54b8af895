"""Per-record rules compiled to column expressions.

A rule program is a list of lines: ``field = text``, ``field .= text``, ``field = other``,
``field = /pattern/replacement/`` (substitution), ``field = other /pattern/`` (all matches as an
array), ``addMetaWord(field)``, ``unset(field)``, ``toArray(field)``, ``toString(field)``,
``pushStack(field, other)`` and ``popStack(field, other)``. Fields that a record lacks are empty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CALL = re.compile(r"^(\w+)\(([^)]*)\)$")
_ASSIGN = re.compile(r"^(\w+)\s*(\.?=)\s*(.+)$", re.DOTALL)
_QUOTED = re.compile(r"^([\"'])(.*)\1$", re.DOTALL)
_SUBSTITUTE = re.compile(r"^/((?:[^/\\]|\\.)*)/((?:[^/\\]|\\.)*)/$")
_MATCHES = re.compile(r"^(\w+)\s+/((?:[^/\\]|\\.)*)/$")


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name, "string")
    return F.array_join(F.col(name), ",") if kind.startswith("array") else F.coalesce(_field(df, name).cast("string"), F.lit(""))


def _list(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name, "")
    if kind.startswith("array"):
        return F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.filter(F.split(_text(df, name), ","), lambda x: x != "")


def _java(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement)


def apply_rule(df: DataFrame, rule: str) -> DataFrame:
    rule = rule.split("#", 1)[0].strip() if not rule.strip().startswith(("'", '"')) else rule.strip()
    if not rule:
        return df
    if call := _CALL.match(rule):
        name, args = call[1], [a.strip() for a in call[2].split(",") if a.strip()]
        f = args[0]
        if name == "addMetaWord":
            word = F.concat(F.lit(f"u:{f}:"), _text(df, f))
            return df.withColumn("meta", F.array_append(_list(df, "meta"), word))
        if name == "addKeywordLink":  # E5: "key, word word" puts the words under the key of the links
            parts = F.split(_text(df, f), ",", 2)
            new = F.map_from_arrays(F.array(F.trim(parts[0])), F.array(F.trim(F.coalesce(F.get(parts, 1), F.lit("")))))
            links = F.col("links") if "links" in df.columns else F.create_map().cast("map<string,string>")
            kept = F.map_filter(F.coalesce(links, F.create_map().cast("map<string,string>")), lambda k, _: k != F.trim(parts[0]))
            return df.withColumn("links", F.map_concat(kept, new))
        if name == "unset":
            return df.withColumn(f, F.lit(None).cast(dict(df.dtypes).get(f, "string")))
        if name in ("toArray", "setStack"):
            return df.withColumn(f, _list(df, f))
        if name == "toString":
            return df.withColumn(f, _text(df, f))
        if name == "pushStack":
            return df.withColumn(f, F.array_append(_list(df, f), _text(df, args[1])))
        if name == "popStack":
            stack = _list(df, f)
            rest = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
            return df.withColumns({args[1]: F.try_element_at(stack, F.lit(-1)), f: rest})
        raise ValueError(f"unknown rule {name}")
    m = _ASSIGN.match(rule)
    if not m:
        raise ValueError(f"can't read rule {rule!r}")
    f, kind, value = m[1], m[2], m[3].strip()
    if q := _QUOTED.match(value):
        new: Column = F.lit(q[2])
    elif s := _SUBSTITUTE.match(value):
        new = F.regexp_replace(_text(df, f), s[1], _java(s[2]))
    elif a := _MATCHES.match(value):
        return df.withColumn(f, F.regexp_extract_all(_text(df, a[1]), F.lit(a[2]), F.lit(0)))
    else:
        new = _text(df, value)
    return df.withColumn(f, F.concat(_text(df, f), new) if kind == ".=" else new)


def apply_rules(df: DataFrame, program: str) -> DataFrame:
    """The lines of a program, one after another; Catalyst merges them into one projection."""
    return reduce(apply_rule, program.splitlines(), df)


def word_condition(terms: Column, rule: str) -> Column:
    """Conditions ``term#k`` (at least k times, or that share of all terms if k < 1), ``-term`` (absent), joined by commas."""
    parts = []
    for part in filter(None, (p.strip() for p in rule.split(","))):
        absent = part.startswith("-")
        term, _, k = part.lstrip("-").partition("#")
        count = F.size(F.filter(terms, (lambda w: lambda t: t == w)(term.lower())))
        least = float(k or 1)
        enough = count >= F.when(F.lit(least < 1), F.lit(least) * F.size(terms)).otherwise(F.lit(least))
        parts.append(~enough if absent else enough & (count > 0))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def word_filter(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``actions``: those of all rules (condition, action) a record's text meets; Q16: none is lost."""
    from tessera.functions.text import tokens

    met = [F.when(word_condition(F.col("_terms"), rule), F.lit(action)) for rule, action in rules]
    found = F.array_distinct(F.filter(F.array(*met), lambda a: a.isNotNull())) if met else F.array().cast("array<string>")
    return df.withColumn("_terms", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).withColumn("actions", found).drop("_terms")


def emails(text: Column) -> Column:
    """E14."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0)))


def phones(text: Column) -> Column:
    """Runs of 7 to 15 digits with usual separators, as digits."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])\+?\(?\d[\d() .-]{5,18}\d(?![\w])"), F.lit(0))
    digits = F.transform(found, lambda p: F.regexp_replace(p, r"\D", ""))
    return F.array_distinct(F.filter(digits, lambda p: (F.length(p) >= 7) & (F.length(p) <= 15)))


def has_signature(page: Column, signature: str) -> Column:
    """Whether a page has a signature: a path of elements (``/html//meta``) in a well-formed page, else a regular expression."""
    if signature.startswith("/"):
        return F.coalesce(F.xpath_boolean(page, F.lit(signature)), F.lit(False))
    return F.coalesce(page.rlike(signature), F.lit(False))


def scraped(page: Column, scrapers: list[tuple[str, str, str]]) -> Column:
    """Struct (label, text) of the first of the scrapers (label, signature, pattern of the text) whose signature a page has; else null."""
    out = F.lit(None).cast("struct<label:string,text:string>")
    for label, signature, pattern in reversed(scrapers):
        found = F.struct(F.lit(label).alias("label"), F.regexp_extract(page, pattern, 1).alias("text"))
        out = F.when(has_signature(page, signature), found).otherwise(out)
    return out


def story(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """The reply to each of messages(id, state, text): of patterns(place, request, trigger_state, result_state, response) the
    first whose regular expression is found in the text and whose trigger state is empty or the message's own.

    Patterns are a bot's few rules, gathered into one row.
    """
    rules = patterns.agg(F.sort_array(F.collect_list(F.struct("place", "request", "trigger_state", "result_state", "response"))).alias("rules"))
    met = F.filter("rules", lambda r: F.rlike(F.coalesce("text", F.lit("")), r["request"]) & ((r["trigger_state"] == "") | (r["trigger_state"] == F.col("state"))))
    return messages.join(F.broadcast(rules)).withColumn("r", F.get(met, F.lit(0))).where("r is not null").select("id", F.col("r.response").alias("response"), F.col("r.result_state").alias("state"))
