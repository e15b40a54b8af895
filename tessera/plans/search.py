"""Plans for parsed queries over a corpus or its stored index (J1-J6, U-1-U-8, S1-S3, P11-P13, O5-O6).

``conjunct_docs`` filters a corpus directly; ``matches`` and ``search`` read the stored index: the postings of the
query's words, one shuffle by document that counts them, and semi or anti joins for what
remains. Summaries are joined last, to the ranked keys alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import index as I
from tessera.operators import scoring as S
from tessera.operators.store import Index
from tessera.plans.parser import Block, Conjunct, Query, parse


def field_condition(name: str, value: str, columns: list[str]) -> Column:
    """A ``field:value`` condition as a column predicate, so that it reaches the scan."""
    low = value.lower()
    if "meta" in columns:  # stored meta words answer every condition
        return F.coalesce(F.array_contains("meta", f"{name}:{value}"), F.lit(False))
    if name == "lang":
        return F.col("lang") == low if "-" in low else F.split("lang", "-")[0] == low
    if name == "source":
        return F.col("source") == value
    if name == "size":
        return F.floor(F.col("n_chars") / 5000) * 5000 == int(low)
    if name == "site":
        if low in ("all", "any", "doc"):
            return F.lit(True)
        if "/" in low:
            return U.host(F.col("url")).isNotNull() & F.array_contains(U.host_paths(F.col("url")), value)
        return F.array_contains(U.subdomains(F.col("url")), low)
    if name == "info":
        return F.col("url") == value
    if name == "path":
        return U.path(F.col("url")).startswith(value)
    if name == "filetype":
        return U.extension(F.col("url")) == low
    if name == "host":
        return U.path(F.col("url")).isin("", "/")
    if name in ("date", "modified"):
        patterns = {4: "yyyy", 7: "yyyy-MM", 10: "yyyy-MM-dd"}
        return F.date_format("ts", patterns[len(value)]) == value
    if name == "u" and ":" in value:
        key, _, v = value.partition(":")
        return F.col("extra")[key] == v
    if name in columns:
        return F.col(name).cast("string") == value
    raise ValueError(f"no column for the condition {name}:{value}")


def phrase_matches(posts: DataFrame, phrase: tuple[str | None, ...]) -> DataFrame:
    """doc_ids in which the words of a phrase follow each other; ``*`` skips one place or more."""
    words = [w for w in phrase if w]
    lists = posts.where(F.col("term").isin(*words)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("by_term"))
    lists = lists.where(reduce(lambda a, b: a & b, [F.map_contains_key("by_term", w) for w in set(words)]))
    at: Column | None = None
    gap = False
    for w in phrase:
        if w is None:
            gap = True
            continue
        here = F.element_at("by_term", F.lit(w))
        if at is None:
            at = here
        elif gap:
            at = F.filter(here, (lambda prev: lambda p: p >= F.array_min(prev) + 2)(at))
        else:
            at = F.filter(here, (lambda prev: lambda p: F.array_contains(prev, p - 1))(at))
        gap = False
    return lists.where(F.size(at) > 0).select("doc_id")


def conjunct_docs(corpus: DataFrame, c: Conjunct, posts: DataFrame | None = None) -> DataFrame:
    """doc_ids that satisfy a conjunct."""
    docs = corpus
    for name, value in c.fields:
        docs = docs.where(field_condition(name, value, corpus.columns))
    for name, value in c.not_fields:
        docs = docs.where(~field_condition(name, value, corpus.columns))
    if not c.words and not c.without:
        return docs.select("doc_id")
    terms = T.tokens(F.col("text"))
    if c.without:
        # A document without text has none of the words.
        docs = docs.where(~F.coalesce(F.arrays_overlap(terms, F.array(*map(F.lit, c.without))), F.lit(False)))
    if not c.words:
        return docs.select("doc_id")
    posts = posts if posts is not None else I.postings_of(docs, list(c.words))
    out = posts.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(c.words)).select("doc_id")
    for p in c.phrases:
        if len(p) > 1:
            out = out.join(phrase_matches(posts, p), "doc_id", "left_semi")
    return out


def _follow(phrase: tuple[str | None, ...]) -> Column:
    """P11 within a row: whether the words of a phrase follow each other, by the map ``by_term`` of positions."""
    at: Column | None = None
    gap = False
    for w in phrase:
        if w is None:
            gap = at is not None
            continue
        here = F.element_at("by_term", F.lit(w))
        if at is None:
            at = here
        elif gap:
            at = F.filter(here, (lambda prev: lambda p: p >= F.array_min(prev) + 2)(at))
        else:
            at = F.filter(here, (lambda prev: lambda p: F.array_contains(prev, p - 1))(at))
        gap = False
    return F.size(at) > 0


def _condition(c: Conjunct, columns: list[str]) -> Column | None:
    parts = [field_condition(name, value, columns) for name, value in c.fields]
    parts += [~field_condition(name, value, columns) for name, value in c.not_fields]
    return reduce(lambda a, b: a & b, parts) if parts else None


def matches(index: Index, c: Conjunct) -> DataFrame:
    """Documents of the stored index that satisfy a conjunct: doc_id, shelf, doc_len, doc_index, generation, by_term.

    The postings of the words meet by document, the one shuffle; excluded words and conditions
    on columns are anti and semi joins of doc_ids.
    """
    docs = index.documents()
    stats = ("shelf", "doc_len", "doc_index", "generation")
    where = _condition(c, docs.columns)
    if c.words:
        met = index.postings(c.words).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("by_term"), *[F.first(x).alias(x) for x in stats])
        met = met.where(F.size("by_term") == len(c.words))
        for phrase in c.phrases:
            if len(phrase) > 1:
                met = met.where(_follow(phrase))
        if where is not None:
            met = met.join(docs.where(where).select("doc_id"), "doc_id", "left_semi")
    else:
        met = (docs if where is None else docs.where(where)).select("doc_id", *stats, F.lit(None).cast("map<string,array<int>>").alias("by_term"))
    if c.without:
        met = met.join(index.postings(c.without).select("doc_id"), "doc_id", "left_anti")
    return met


def conjunct_scores(index: Index, c: Conjunct, per_generation: int = I.GENERATION) -> DataFrame:
    """doc_id, shelf, doc_rank, relevance, proximity of a conjunct's documents, times its weight.

    Numbers of documents with a word are read from the dictionary, one row a word, and the totals
    are the index's own: scoring joins nothing.
    """
    met = matches(index, c)
    rank = S.doc_rank(F.col("doc_index"), F.col("generation"), per_generation)
    relevance, near = F.lit(1.0), F.lit(1.0)
    if c.words:
        have = index.num_docs(c.words)
        at = {w: F.element_at("by_term", F.lit(w)) for w in c.words}
        relevance = reduce(lambda a, b: a + b, [S.field_relevance(at[w], F.col("doc_len"), F.lit(float(index.average)), F.lit(float(have[w])), F.lit(float(index.docs))) for w in c.words])
        if len(c.words) > 1:
            near = S.cover_score(F.array(*[F.struct(F.lit(w).alias("term"), at[w].alias("positions")) for w in sorted(c.words)]))
    w = F.lit(c.weight)
    return met.select("doc_id", "shelf", (rank * w).alias("doc_rank"), (relevance * w).alias("relevance"), (near * w).alias("proximity"))


def _most(index: Index, c: Conjunct) -> int:
    """A bound of a conjunct's matches: the documents of its rarest word."""
    return min(index.num_docs(c.words).values()) if c.words else index.docs


def block_scores(indexes: dict[str | None, Index], b: Block) -> DataFrame:
    """U-1: the union of a block's disjuncts; of a document in several the last one stands.

    Scores are compared at nine places, so that ranks do not hang on the order of a sum.
    """
    fields = ("doc_rank", "relevance", "proximity")
    parts, rows = [], 0
    for i, c in enumerate(b.disjuncts):
        index = indexes.get(c.index, indexes[None])
        parts.append(conjunct_scores(index, c).withColumns({f: F.round(f, 9) for f in fields}).withColumn("branch", F.lit(i)))
        rows += _most(index, c)
    union = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        union = union.groupBy("doc_id").agg(F.max(F.struct("branch", "shelf", *fields)).alias("f")).select("doc_id", "f.shelf", *(f"f.{f}" for f in fields))
    return S.fuse(union.select("doc_id", "shelf", *fields), fields, rows=rows)


def search(corpus: Index | dict[str | None, Index], text: str | Query, most: int = 10, offset: int = 0, guesses: bool = True) -> DataFrame:
    """Ranked results (rank, doc_id, score, ...) with summaries joined to the top rows alone.

    Summaries come from the index None; documents of other indexes keep their own shelves, so they are
    found there by doc_id.
    """
    indexes = corpus if isinstance(corpus, dict) else {None: corpus}
    q = text if isinstance(text, Query) else parse(text, guesses)
    parts = []
    for i, b in enumerate(q.blocks):
        top = block_scores(indexes, b).orderBy(F.desc("score"), "doc_id").limit(b.most if b.most is not None else offset + most)
        parts.append(top.withColumn("block", F.lit(i)))
    rows = reduce(DataFrame.unionByName, parts)
    by = Window.orderBy("block", F.desc("score"), "doc_id")  # at most most + offset rows a block
    rows = rows.withColumn("rank", F.row_number().over(by)).where((F.col("rank") > offset) & (F.col("rank") <= offset + most))
    shown = rows.select("rank", "doc_id", "shelf", "score", "doc_rank", "relevance", "proximity")
    words = [w for b in q.blocks for c in b.disjuncts for w in c.words]
    if all(c.index is None or c.index not in indexes for b in q.blocks for c in b.disjuncts):
        found = indexes[None].summaries(shown)
    else:
        found = indexes[None].documents().join(F.broadcast(shown.drop("shelf")), "doc_id")
    extra = [c for c in ("lang", "source") if c in found.columns]
    return found.select("doc_id", *extra, T.snippet(F.col("text"), words).alias("snippet"), "rank", "score", "doc_rank", "relevance", "proximity")


def explain(index: Index, text: str) -> str:
    """The formatted plan of a query."""
    return search(index, text)._jdf.queryExecution().explainString(index.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
