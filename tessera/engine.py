"""The public API (E25-E28): search, related and cached pages over a corpus.

``python -m tessera.engine FOLDER QUERY`` prints the top results of a Parquet documents table.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import analytics as A
from tessera.operators import index as I
from tessera.operators.store import VERSION, Index, opened, shared_folder
from tessera.plans import search as P
from tessera.plans.parser import Conjunct, Query, Block


class ResultCache:
    """Results by query in the shared folder; beyond ``most`` entries the one used longest ago goes."""

    def __init__(self, spark: SparkSession, most: int = 100) -> None:
        self.spark, self.most, self.known = spark, most, OrderedDict()
        self.folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.known:
            path = f"{self.folder}/{uuid.uuid4().hex}"
            make().write.parquet(path)
            self.known[key] = path
        self.known.move_to_end(key)
        while len(self.known) > self.most:
            _, old = self.known.popitem(last=False)
            at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        return self.spark.read.parquet(self.known[key])


def activity(text: str) -> tuple[str, tuple[str, ...]]:
    """What a request asks for: ("related", (id,)), ("cache", (id,)), ("trending", (category, order)), ("chart", (category, period, terms)), else ("search", (text,))."""
    m = re.match(r"\s*(related|cache|trending|chart):(.*)$", text, re.DOTALL)
    if not m:
        return "search", (text,)
    name, rest = m[1], m[2].strip()
    parts = tuple(rest.split(":", {"trending": 1, "chart": 2}.get(name, 0))) if name in ("trending", "chart") else (rest,)
    return name, parts


class Engine:
    """One corpus(doc_id, text, ...) and the queries one can put to it; its index is built at first use."""

    def __init__(self, corpus: DataFrame, indexes: dict[str, DataFrame] | None = None) -> None:
        self.corpora: dict[str | None, DataFrame] = {None: corpus, **(indexes or {})}
        self.name = uuid.uuid4().hex
        self.results: ResultCache | None = None

    def indexes(self) -> dict[str | None, Index]:
        return {k: opened(c.sparkSession, f"{self.name}/{k}", lambda c=c: c) for k, c in self.corpora.items()}

    def search(self, query: str, most: int = 10, offset: int = 0) -> DataFrame:
        return P.search(self.indexes(), query, most, offset)

    def ask(self, text: str, most: int = 10, offset: int = 0) -> DataFrame:
        """A search, or one of the activities that a prefix names; results of searches are kept and used again."""
        kind, args = activity(text)
        if kind == "related":
            return self.related(int(args[0]), most)
        if kind == "cache":
            return self.cached(int(args[0]))
        if kind == "search":
            if self.results is None:
                self.results = ResultCache(self.corpora[None].sparkSession)
            return self.results.get(f"{most}/{offset}/{text}", lambda: self.search(text, most, offset))
        raise ValueError(f"{kind}: needs a table of trends")

    def version(self, name: str | None = None) -> int | None:
        """The layout's version of a named index; None if there is none."""
        return VERSION if name in self.corpora else None

    def top_terms(self, doc_id: int, most: int = 3) -> list[str]:
        """A document's most frequent terms (at most ``most`` rows come back)."""
        one = self.corpora[None].where(F.col("doc_id") == doc_id)
        rows = A.top_per(I.term_frequencies(I.tokens(one)), ["doc_id"], [F.desc("tf"), F.col("term")], most)
        return [r.term for r in rows.orderBy("rank").collect()]

    def related(self, doc_id: int, most: int = 10) -> DataFrame:
        """The first ``most`` documents that share a document's top terms, without itself."""
        terms = tuple(self.top_terms(doc_id))
        found = P.search(self.indexes(), Query((Block((Conjunct(terms=terms),)),)), most + 1)
        return found.where(F.col("doc_id") != doc_id).orderBy("rank").limit(most)

    def cached(self, doc_id: int, words: list[str] | None = None) -> DataFrame:
        """The stored text, query words in bold."""
        return self.corpora[None].where(F.col("doc_id") == doc_id).withColumn("text", T.bold(F.col("text"), words or []))

    def explain(self, query: str) -> str:
        return P.explain(self.indexes()[None], query)


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    corpus = spark.read.parquet(f"{args[0]}/documents.parquet")
    Engine(corpus).search(" ".join(args[1:])).orderBy("rank").show(truncate=80)


if __name__ == "__main__":
    main(sys.argv[1:])
