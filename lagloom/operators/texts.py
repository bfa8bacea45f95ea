"""Text rollups, chunks and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions import fixed
from lagloom.functions.text import any_keyword, chunks, cosine_distance, matched_keywords


def topic_counts(articles: DataFrame, topics: dict[str, list[str]] | None = None, ignore_case: bool = False) -> DataFrame:
    """Articles per day and topic, all topics in one pass; an article counts once for each of its topics."""
    g = articles.groupBy(F.col("date").cast("date").alias("news_date"))
    return g.agg(*[F.count_if(any_keyword(F.col("text"), words, ignore_case)).cast("int").alias(name) for name, words in (topics or fixed.TOPICS).items()])


def keyword_articles(articles: DataFrame, keywords: list[str], col: str = "text") -> DataFrame:
    """Articles with at least one keyword (any case), with those keywords joined by ', '."""
    found = articles.withColumn("_k", matched_keywords(F.col(col), keywords)).filter(F.size("_k") > 0)
    return found.withColumn("matched_kw", F.array_join("_k", ", ")).drop("_k")


def search_terms(hypothesis: str, stems: dict[str, list[str]] | None = None, limit: int = 6) -> list[str]:
    """Terms for the stems in a hypothesis, in order, without repeats; a fallback if there are none."""
    low = hypothesis.lower()
    terms = [t for stem, words in (stems or fixed.STEMS).items() if stem in low for t in words]
    return list(dict.fromkeys(terms))[:limit] or list(fixed.FALLBACK_TERMS)


def rerank(articles: DataFrame, keywords: list[str], top: int = 5, first: int = 3, excerpt: int = 280) -> DataFrame:
    """Articles with one of the first keywords, by how many of all keywords they hold, ties by date and id.

    All candidates are ranked: a limit before ranking would leave the result to the engine's order.
    """
    text = F.lower("text")
    score = sum((text.contains(k.lower()).cast("int") for k in keywords), F.lit(0))
    hits = articles.filter(any_keyword(F.col("text"), keywords[:first], ignore_case=True)).withColumn("score", score)
    short = F.trim(F.translate(F.substring("text", 1, excerpt), "\n", " "))
    return hits.orderBy(F.desc("score"), "date", "id").limit(top).select("id", "date", "score", short.alias("excerpt"))


def news_context(articles: DataFrame, hypothesis: str, since: str, until: str, top: int = 5, stems: dict[str, list[str]] | None = None) -> DataFrame:
    """The articles of a window of dates (both ends inside) that fit a hypothesis best, each as a line for a prompt.

    Terms come from the hypothesis's stems (``search_terms``); the dates are a filter of the scan. Without an article
    there is no row.
    """
    window = articles.filter(F.col("date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    found = rerank(window, search_terms(hypothesis, stems), top)
    return found.select("id", "date", "score", F.concat(F.lit("["), F.date_format("date", "yyyy-MM-dd"), F.lit("] "), "excerpt", F.lit("…")).alias("block"))


def chunk_rows(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, chunk (numbered after short ones are gone), document and its md5 id."""
    rows = docs.select(*key, F.posexplode(chunks(F.col(text))).alias("chunk", "document"))
    return rows.withColumn("id", F.md5(F.concat_ws("_", *key, "chunk").cast("binary")))


def article_ids(docs: DataFrame, text: str = "text", chars: int = 1000, head: int = 200, least: int = 50) -> DataFrame:
    """Stored form of an article: at most ``chars`` characters, id from the first ``head`` of them; later ones win."""
    cut = F.substring(F.col(text), 1, chars)
    return docs.withColumn("document", cut).filter(F.length("document") >= least).withColumn("id", F.md5(F.substring("document", 1, head).cast("binary")))


def section(text: Column, sections: dict[str, list[str]], chars: int = 300) -> Column:
    """The first section with a keyword in the text's beginning, otherwise 'general'."""
    head, out = F.substring(text, 1, chars), None
    for name, words in sections.items():
        hit = any_keyword(head, words, ignore_case=True)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def nearest(collection: DataFrame, query: list[float], k: int, where: Column | None = None, by: str | None = None) -> DataFrame:
    """The k rows at the smallest cosine distance (for each value of ``by``), ties by id."""
    rows = collection if where is None else collection.filter(where)
    rows = rows.withColumn("distance", cosine_distance(F.col("embedding"), F.array(*map(F.lit, query)))).filter("distance is not null")
    if not by:
        return rows.orderBy("distance", "id").limit(k)
    # row_number <= k becomes a group limit below the shuffle: at most k rows a task and group cross it.
    w = Window.partitionBy(by).orderBy("distance", "id")
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def context(collection: DataFrame, query: list[float], top_k: int = 8, most: float = 0.8, where: Column | None = None) -> DataFrame:
    """Per collection max(top_k // 2, 3) hits, the nearest of each page, at most top_k of them, then those under ``most``."""
    hits = nearest(collection, query, max(top_k // 2, 3), where, "collection")
    w = Window.partitionBy("collection", "company", "filename", "page").orderBy("distance", "id")
    pages = hits.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    label = F.format_string("[%s %s, p.%s]", F.initcap("company"), F.col("year").cast("string"), F.col("page").cast("string"))
    return pages.orderBy("distance", "id").limit(top_k).filter(F.col("distance") < most).withColumn("label", label)


def keyword_stream(articles: DataFrame, keywords: list[str], cap: int | None = None) -> DataFrame:
    """Articles (batch or stream) with a keyword in any case, in stored form; ``cap`` is the loader's own limit."""
    hits = articles.filter(any_keyword(F.col("text"), keywords, ignore_case=True))
    return article_ids(hits.limit(cap) if cap else hits)


def regions(macro: DataFrame, names: dict[str, str], not_regions: list[str]) -> DataFrame:
    """Rows with normalised region names; entries that are no regions (totals, districts) drop."""
    from lagloom.operators.tables import map_names

    clean = macro.withColumn("region", F.trim(F.regexp_replace("region", r"\s+", " ")))
    named = clean.withColumn("region", map_names(clean, "region", names))
    out = macro.sparkSession.createDataFrame([(r,) for r in not_regions], "region string")
    return named.join(out, "region", "left_anti").select(*macro.columns)
