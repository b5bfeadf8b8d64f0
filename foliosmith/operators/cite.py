"""The chain of citation sources as left joins against local catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import citations as C, text as X, urls as U

PAPER = "title string, authors array<string>, year string, venue string, doi string, url string"


def _one_each(papers: DataFrame, key: str) -> DataFrame:
    """One paper a key, that of the least title, so that a catalog with repeats repeats no document."""
    return papers.groupBy(key).agg(F.min_by("paper", F.col("paper.title")).alias("paper"))


def first_ranked(by_title: DataFrame) -> DataFrame:
    """(query, paper): the paper of rank 1 of each query."""
    return _one_each(by_title.filter("rank = 1"), "query")


def titled_entry(title: Column, paper: Column, current_year: str) -> Column:
    """The entry of a paper found by title, with a warning in front if the titles differ."""
    warning = F.when(C.titles_match(title, paper["title"]), F.lit("")).otherwise(C.mismatch_warning(title, paper["title"]))
    return F.concat(warning, C.article_entry(paper["title"], paper["authors"], paper["year"], paper["venue"], paper["doi"], paper["url"], current_year))


def cite(documents: DataFrame, by_id: DataFrame, exports: DataFrame, by_title: DataFrame, current_year: str, online: bool = True) -> DataFrame:
    """(doc_id, bibtex, source) of (doc_id, url, probe, fallback_title).

    ``by_id`` (arxiv_id, paper), ``exports`` (arxiv_id, title, authors, year, primary_class) and ``by_title`` (query, rank, paper) are catalogs; the
    first source that has the paper wins: identifier, export, title (rank 1), best effort.  Papers of known repositories are always
    citable, others only if the probe says so; offline, no catalog is asked.
    """
    docs = documents.withColumn("__known", U.is_citable(F.col("url"))).withColumn("__arxiv", U.arxiv_id(F.col("url")))
    docs = docs.withColumn("__title", F.coalesce(F.col("probe.title"), F.col("fallback_title")))
    if online:
        docs = docs.join(_one_each(by_id, "arxiv_id").select(F.col("arxiv_id").alias("__arxiv"), F.col("paper").alias("__p")), "__arxiv", "left")
        docs = docs.join(exports.groupBy(F.col("arxiv_id").alias("__arxiv")).agg(F.min_by(F.struct("title", "authors", "year", "primary_class"), "title").alias("__x")), "__arxiv", "left")
        docs = docs.join(first_ranked(by_title).select(F.col("query").alias("__title"), F.col("paper").alias("__t")), "__title", "left")
    else:
        none = F.lit(None)
        docs = docs.withColumn("__p", none.cast(f"struct<{PAPER.replace(' ', ':').replace(',:', ',')}>")).withColumn("__t", F.col("__p"))
        docs = docs.withColumn("__x", none.cast("struct<title:string,authors:array<string>,year:string,primary_class:string>"))
    p, x, t = F.col("__p"), F.col("__x"), F.col("__t")
    article = lambda q: C.article_entry(q["title"], q["authors"], q["year"], q["venue"], q["doi"], q["url"], current_year)
    named = F.filter(p["authors"], lambda a: a != "")
    first = F.when(C.is_preprint_venue(p["venue"]), C.preprint_entry(p["title"], named, p["year"], F.col("__arxiv"), current_year)).otherwise(article(p))
    second = C.preprint_entry(x["title"], x["authors"], x["year"], F.col("__arxiv"), current_year, x["primary_class"])
    third = titled_entry(F.col("__title"), t, current_year)
    probe = F.col("probe")
    fourth = C.best_effort_entry(probe["title"], probe["authors"], probe["year"], probe["venue"], current_year)
    allowed = F.col("__known") | F.coalesce(probe["citable"], F.lit(False))
    source = (
        F.when(~allowed, F.when(probe.isNotNull(), "not-citable").otherwise("unknown")).when(p.isNotNull(), "s2-arxiv-id").when(x.isNotNull(), "arxiv-export")
        .when(t.isNotNull(), "s2-title").when(fourth.isNotNull(), "best-effort").otherwise("no usable metadata")
    )
    entry = F.when(~allowed, F.lit(None)).when(p.isNotNull(), first).when(x.isNotNull(), second).when(t.isNotNull(), third).otherwise(fourth)
    return docs.select("doc_id", entry.alias("bibtex"), source.alias("source"))


def output_base(name: Column | None, bibtex: Column, mock: bool, suggested: Column) -> Column:
    """The output stem: a given name, else the key of an entry that is no mock, else the source's name."""
    key = F.lit(None).cast("string") if mock else C.entry_key(bibtex)
    return X.base_name(F.coalesce(*([name] if name is not None else []), key, suggested))
