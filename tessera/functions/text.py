"""Text columns: tokens, n-grams, sentences, snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def char_ngrams(term: Column, n: int) -> Column:
    """T5: all character n-grams; a term of at most n characters is its own gram."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(term) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(term, i, F.lit(n)))


def word_ngrams(terms: Column, n: int) -> Column:
    """All runs of n terms, joined by spaces; none if there are fewer. ``terms`` should be a stored column: each gram reads it."""
    starts = F.when(F.size(terms) >= n, F.sequence(F.lit(1), F.size(terms) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(terms, i, n), " "))


def sentences(text: Column) -> Column:
    """Parts that end in a sentence mark before white space, or at a blank line."""
    marked = F.regexp_replace(text, r"([.!?])\s+|\n\s*\n", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def without_stop_words(terms: Column, stop_words: Sequence[str]) -> Column:
    """T16."""
    return F.filter(terms, lambda t: ~t.isin(*stop_words))


def bold(text: Column, words: Sequence[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Every whole-word occurrence of a query word, in either case, between marks."""
    if not words:
        return text
    pattern = r"(?i)\b(" + "|".join(_quoted(w) for w in sorted(words, key=len, reverse=True)) + r")\b"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")


def snippet(text: Column, words: Sequence[str], left: int = 20, right: int = 40, most: int = 3) -> Column:
    """Up to ``most`` windows around query words, joined by " ... "; the text's beginning if there is none."""
    if not words:
        return F.substring(text, 1, left + right)
    pattern = rf"(?is).{{0,{left}}}(?<![\p{{L}}\p{{N}}_])(?:" + "|".join(map(_quoted, words)) + rf")(?![\p{{L}}\p{{N}}_]).{{0,{right}}}"
    found = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, most)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda s: F.trim(s)), " ... ")).otherwise(F.substring(text, 1, left + right))


def strip_markup(page: Column) -> Column:
    """Page text without scripts, styles, comments and tags, white space squeezed."""
    bare = F.regexp_replace(page, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def page_hash(page: Column) -> Column:
    """Near-duplicate key: md5 of the page without tags and white space."""
    return F.md5(F.regexp_replace(F.regexp_replace(page, r"<[^>]*>", ""), r"\s+", "").cast("binary"))


def acronyms(text: Column) -> Column:
    """Dotted capitals become ``_`` and the lower-cased letters; ``A&W`` becomes ``a_and_w``."""
    dotted = F.regexp_replace(text, r"\b(\p{Lu})\.(\p{Lu})\.(?:(\p{Lu})\.)?", "_$1$2$3")
    joined = F.regexp_replace(dotted, r"\b(\p{L}+)\s?&\s?(\p{L}+)\b", "$1_and_$2")
    return F.lower(joined)


def _quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


#: Contractions of English and what they stand for, in the order of their use.
CONTRACTIONS = (
    (r"([mM]r|[mM]rs|[mM]s|[dD]r|[iI]n|[cC]apt|[cC]pl|[sS]t|[fF]t|[vV]s)\.(\s*)(\p{Lu}|\z)", "$1 $3"),
    (r",(\p{Lu})\.(\s*)(\p{Lu}|\z)", "$1_ $3"),
    (r"(?i)gimme", "give me"), (r"(?i)gonna", "going to"), (r"(?i)gotta", "got to"), (r"(?i)ma'am", "madam"), (r"(?i)'tis", "it is"),
    (r"(?i)'twas", "it was"), (r"(?i)y'all", "you all"), (r"I'm", "I am"), (r"I ain't", "I am not"), (r"(?i)You ain't", "you are not"),
    (r"(?i)(why|who|which|when|what|this|that|there|how|it|everyone|one|he|she)'s", "$1 is"), (r"is been", "has been"), (r"is had", "has had"),
    (r"shan't", "shall not"), (r"\b(\p{L}+)'d", " $1 would"), (r"\b(\p{L}+)n't", " $1 not"), (r"\b(\p{L}+)'ll", " $1 will"),
    (r"\b(\p{L}+)'ve", " $1 have"), (r"\b(\p{L}+)'re", " $1 are"), (r"\b(\p{L}+)'s", " $1_pos_s"),
)


def expanded(text: Column) -> Column:
    """English contractions written out."""
    for pattern, instead in CONTRACTIONS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def wrapped(text: Column, width: int = 75, line: str = "\n") -> Column:
    """Lines of at most ``width`` characters, broken at white space; longer words are cut."""
    return F.regexp_replace(text, rf"(.{{1,{width}}})(?:\s|$)|(.{{{width}}})", f"$1$2{line}")


def safe_tag(tag: Column, attributes: Sequence[str]) -> Column:
    """A start tag with those attributes only that are named, their values in double quotes."""
    name = F.regexp_extract(tag, r"^<\s*([A-Za-z][A-Za-z0-9]*)", 1)
    found = F.regexp_extract_all(tag, F.lit(r"([A-Za-z-]+\s*=\s*\"[^\"]*\")"), F.lit(1))
    kept = F.filter(found, lambda a: F.lower(F.regexp_extract(a, r"^([A-Za-z-]+)", 1)).isin(*attributes))
    return F.concat(F.lit("<"), F.lower(name), F.array_join(F.transform(kept, lambda a: F.concat(F.lit(" "), a)), ""), F.lit(">"))


#: Languages of encodings that are used for one.
ENCODING_LANGUAGES = {
    "EUC-JP": "ja", "ISO-2022-JP": "ja", "SHIFT_JIS": "ja", "SJIS": "ja", "EUC-KR": "ko", "ISO-2022-KR": "ko", "BIG5": "zh-TW", "GB2312": "zh-CN",
    "GBK": "zh-CN", "EUC-CN": "zh-CN", "EUC-TW": "zh-TW", "WINDOWS-1251": "ru", "KOI8-R": "ru", "WINDOWS-1255": "he", "WINDOWS-1256": "ar", "TIS-620": "th",
}


def language_of_encoding(encoding: Column) -> Column:
    """Null for encodings that tell none."""
    known = F.create_map(*[F.lit(x) for pair in ENCODING_LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.upper(encoding))


def page_encoding(page: Column, default: str = "UTF-8") -> Column:
    """The encoding that an HTML or XML page names."""
    found = F.regexp_extract(page, r"(?i)(?:<meta[^>]*charset\s*=\s*[\"']?|<\?xml[^>]*encoding\s*=\s*[\"'])([A-Za-z0-9_-]+)", 1)
    return F.upper(F.when(found == "", default).otherwise(found))


def as_text(raw: Column) -> Column:
    """Bytes as text: by their byte order mark, else UTF-8 where they are that, else Latin-1."""
    head = F.hex(F.substring(raw, 1, 3))
    return (
        F.when(head == "EFBBBF", F.decode(F.substring(raw, F.lit(4), F.length(raw)), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(F.substring(raw, F.lit(3), F.length(raw)), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substring(raw, F.lit(3), F.length(raw)), "UTF-16BE"))
        .otherwise(F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1")))
    )


def joined_entities(text: Column, entities: Sequence[str]) -> Column:
    """T4: known runs of words joined by -, longer ones first. ``text`` has single spaces, ``entities`` is a short list."""
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for e in sorted(entities, key=lambda e: (-e.count(" "), e)):
        out = F.replace(out, F.lit(f" {e} "), F.lit(" " + e.replace(" ", "-") + " "))
    return F.trim(out)


def summary_text(title: Column, description: Column, links: Column) -> Column:
    """Title, description and link texts as one string of words."""
    whole = F.concat_ws(" ", title, description, F.array_join(links, " "))
    return F.trim(F.regexp_replace(F.regexp_replace(whole, r"[^\p{L}\p{N}]", " "), r"\s+", " "))


def shown_title(title: Column, url: Column) -> Column:
    """The title, or the url where there is none."""
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", url).otherwise(F.trim(title))


def top_words(terms: Column, most: int = 5) -> Column:
    """The words of a text that stand there most often; ties in order of the word."""
    counted = F.transform(F.array_distinct(terms), lambda t: F.struct((-F.size(F.filter(terms, lambda u: u == t))).alias("n"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(counted), 1, most), lambda s: s["t"])
