"""Registered queries of the engine's own operators, with the same rows as DuckDB SQL.

The tables hold none of the signs these operators look for, so each query first decorates its input by SQL that both engines run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import citations as C, layout as L, sections as S, tables as T, text as X, urls as U
from ..operators import cite as cite_op, figures as figures_op, memo as memo_op, pages as pages_op, parts as parts_op, tables as tables_op, titles as titles_op
from ..sources import bundles, files, memo_table
from ..sources.durable import checkpoint_dir
from . import config, transcribe

TABLES = ("documents", "conversations", "pages", "lineitem", "orders", "events")
NL = "chr(10)"

RAW = f"""
SELECT doc_id, doc_id % 7 + 1 AS page_number, 800 + doc_id % 50 AS width_px, 1100 AS height_px,
  CASE WHEN doc_id % 11 = 0 THEN '  ' || text || '  '
  ELSE 'preamble title[[10, 20, 500, 60]]Title ' || CAST(doc_id AS STRING) || {NL}
    || CASE WHEN doc_id % 3 = 0 THEN 'image[[' || CAST(doc_id % 900 AS STRING) || ', 100, ' || CAST(doc_id % 900 + doc_id % 13 AS STRING) || ', 500]]' ELSE '' END
    || CASE WHEN doc_id % 6 = 0 THEN 'image_caption [[1, 2, 3, 4]] Figure ' || CAST(doc_id AS STRING) || ': a [caption]' || {NL} ELSE '' END
    || 'text[[0, 61, 1200, 999]]' || text || {NL}
    || CASE WHEN doc_id % 5 = 0 THEN 'Chart[[5, 5 , 100, 200]] ' ELSE '' END END AS raw
FROM {{documents}}"""

PAGES = f"""
SELECT conv_id, turn,
  CASE WHEN conv_id % 4 <> 3 THEN 'Proceedings of ' || CAST(conv_id AS STRING) || {NL} ELSE '' END || 'Some hyph-' || {NL} || '  enated ' || text || {NL} || {NL} || {NL} || {NL} || 'Tail of é-' || {NL} || 'é'
    || CASE WHEN conv_id % 5 <> 4 THEN {NL} || ' Page ' || CAST(turn AS STRING) || {NL} ELSE {NL} || '| cell |' END AS md
FROM {{conversations}}"""

DOCS = f"""
SELECT doc_id, '# Title of ' || CAST(doc_id AS STRING) || {NL} || text || {NL}
  || CASE doc_id % 6
    WHEN 0 THEN '## Acknowledgments' || {NL} || 'thanks' || {NL} || '## References' || {NL} || 'one' || {NL} || '---' || {NL}
    WHEN 1 THEN '#### Page 3' || {NL} || {NL} || '## References' || {NL} || 'two' || {NL} || '# Appendix' || {NL} || 'proof' || {NL}
    WHEN 2 THEN '## A Method' || {NL} || 'm' || {NL} || '## Funding' || {NL} || 'f' || {NL}
    WHEN 3 THEN '## Bibliography' || {NL} || 'b' || {NL} || '## A Supplement' || {NL} || 's' || {NL}
    WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN '## Supplementary Datasets' ELSE '## Supporting  information:' END || {NL} || 'x' || {NL} || '## References' || {NL} || 'late' || {NL}
    ELSE '---' || {NL} END AS content
FROM {{documents}}"""

TABLE_ROWS = f"""
SELECT l_orderkey, l_linenumber,
  '<table><tr><td>' || CAST(l_partkey AS STRING) || '</td><td colspan=12>' || CAST(l_suppkey AS STRING) || '&#39;</td></tr></TABLE >' AS blob,
  CASE l_partkey % 5
    WHEN 0 THEN '```markdown' || {NL} || '| part | supp |' || {NL} || '|---|---|' || {NL} || '| ' || CAST(l_partkey AS STRING) || ' | ' || CAST(l_suppkey AS STRING) || ' |' || {NL} || '```'
    WHEN 1 THEN 'Here is the table:' || {NL} || '| ' || CAST(l_partkey AS STRING) || ' |'
    WHEN 2 THEN '| a |' || {NL} || '|---|'
    WHEN 3 THEN '  | ' || CAST(l_partkey AS STRING) || ' |' || {NL} || {NL} || '  | ' || CAST(l_suppkey AS STRING) || ' |  '
    ELSE '| ' || CAST(l_partkey AS STRING) || ' |' END AS answer
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) AS items"""

URLS = """
SELECT page_id, CASE page_id % 10
    WHEN 0 THEN 'https://arxiv.org/abs/2301.' || CAST(10000 + page_id AS STRING) || 'v2?context=cs'
    WHEN 1 THEN 'https://openreview.net/forum?id=Ab' || CAST(page_id AS STRING) || '&noteId=x'
    WHEN 2 THEN 'https://aclanthology.org/2023.acl-long.' || CAST(page_id AS STRING)
    WHEN 3 THEN 'https://www.biorxiv.org/content/10.1101/2020.01.01.' || CAST(page_id AS STRING) || 'v1.full'
    WHEN 4 THEN 'https://papers.nips.cc/paper_files/paper/2020/hash/' || CAST(page_id AS STRING) || 'ab-Abstract.html'
    WHEN 5 THEN 'https://proceedings.mlr.press/v139/x' || CAST(page_id AS STRING) || '.html'
    WHEN 6 THEN 'https://arxiv.org.evil.com/abs/2301.' || CAST(10000 + page_id AS STRING)
    WHEN 7 THEN 'https://arxiv.org/pdf/cs.AI/' || CAST(1000000 + page_id AS STRING) || '.pdf'
    WHEN 8 THEN 'https://www.medrxiv.org/content/10.1101/2021.02.02.' || CAST(page_id AS STRING)
    ELSE url END AS url
FROM {pages}"""

ANSWERS = """
SELECT event_id, CASE event_id % 8
    WHEN 0 THEN '{"citable": true, "title": " T' || CAST(event_id AS STRING) || ' ", "authors": [" A ", ""], "year": 2023}'
    WHEN 1 THEN '{"citable": "yes"}'
    WHEN 2 THEN '{"citable": false, "title": null, "authors": null, "year": "1999", "venue": "V"}'
    WHEN 3 THEN 'not json ' || event_type
    WHEN 4 THEN '{"citable": true, "title": 42}'
    WHEN 5 THEN '{"citable": true, "authors": [1]}'
    WHEN 6 THEN '[1, 2]'
    ELSE '```json' || chr(10) || '{"citable": true, "title": "x", "venue": "' || event_type || '"}' || chr(10) || '```' END AS raw
FROM {events}"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    escaped = sql
    for t in TABLES:
        escaped = escaped.replace("{" + t + "}", "\u0001" + t + "\u0002")
    escaped = escaped.replace("{", "{{").replace("}", "}}").replace("\u0001", "{").replace("\u0002", "}")
    return spark.sql(escaped, **used)


def _oracle(sql: str, **parts: str) -> str:
    for name, text in parts.items():
        sql = sql.replace("@" + name + "@", text)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _strip(sql: str) -> str:
    return rf"regexp_replace({sql}, '\A\s+|\s+\z', '', 'g')"


MARK = r"([A-Za-z_][A-Za-z_0-9]*)\s*\[\[\s*(\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+)\s*\]\]"
MARK_WHOLE = r"[A-Za-z_][A-Za-z_0-9]*\s*\[\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]\]"
_FIG = "lower(label) IN ('figure', 'image', 'picture', 'chart', 'diagram', 'plot')"
_BLOCKS = rf"""
WITH d AS (@RAW@), b AS (SELECT *, regexp_extract_all(raw, '{MARK}', 1) AS labels, regexp_extract_all(raw, '{MARK}', 2) AS coords, string_split_regex(raw, '{MARK_WHOLE}') AS texts FROM d),
u AS (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM b),
c AS (SELECT doc_id, page_number, width_px, height_px, i, labels[i] AS label, string_split(coords[i], ',') AS g, {_strip('texts[i + 1]')} AS body FROM u),
r AS (SELECT *, CAST(sum(CASE WHEN {_FIG} THEN 1 ELSE 0 END) OVER w AS INT) AS n, lead(label) OVER w AS next_label, lead(body) OVER w AS next_body FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, page_number, width_px, height_px, i, label, {_FIG} AS fig, CASE WHEN {_FIG} THEN n END AS figure, body,
  CASE WHEN {_FIG} THEN CASE WHEN lower(next_label) IN ('image_caption', 'caption', 'figure_caption') THEN nullif(next_body, '') END ELSE nullif(body, '') END AS text,
  greatest(least(CAST(trim(g[1]) AS DOUBLE) / 999, 1), 0) AS x1, greatest(least(CAST(trim(g[2]) AS DOUBLE) / 999, 1), 0) AS y1, greatest(least(CAST(trim(g[3]) AS DOUBLE) / 999, 1), 0) AS x2, greatest(least(CAST(trim(g[4]) AS DOUBLE) / 999, 1), 0) AS y2 FROM r)
"""


def layout_blocks(spark, sf_dir):
    rows = pages_op.layout_blocks(pages_op.parse_pages(frame(spark, sf_dir, RAW)), "doc_id")
    return rows.select("doc_id", "block_idx", "label", *[F.round(F.col(f"bbox.{c}"), 9).alias(c) for c in ("x1", "y1", "x2", "y2")], digest(F.coalesce("text", F.lit(""))).alias("text_sha256"), F.length("text").alias("n_chars"), "figure")


def page_markdown(spark, sf_dir):
    return pages_op.parse_pages(frame(spark, sf_dir, RAW)).select("doc_id", digest(F.col("markdown")).alias("markdown_sha256"), F.length("markdown").alias("n_chars"))


def pixel_boxes(spark, sf_dir):
    rows = pages_op.figures(pages_op.parse_pages(frame(spark, sf_dir, RAW)), "doc_id", padding=0.01)
    return rows.select("doc_id", "fig_id", "caption", *[F.col(f"px_box.{c}").alias(f"px_{c}") for c in ("x1", "y1", "x2", "y2")])


def figure_inject(spark, sf_dir):
    parsed = pages_op.parse_pages(frame(spark, sf_dir, RAW))
    found = pages_op.figures(parsed, "doc_id")
    described = found.withColumn("description", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("Line one of "), F.col("fig_id"), F.lit("\n\n line two")))).withColumn("crop_path", F.concat(F.lit("figures/"), F.col("fig_id"), F.lit(".png")))
    done = figures_op.inject_descriptions(parsed.select("doc_id", "markdown"), described, "doc_id", mode="describe-and-keep")
    return done.select("doc_id", digest(F.col("markdown")).alias("markdown_sha256"), F.length("markdown").alias("n_chars"))


def stitch(spark, sf_dir):
    return pages_op.stitch_pages(frame(spark, sf_dir, PAGES), "conv_id", "turn", "md").select("conv_id", digest(F.col("markdown")).alias("markdown_sha256"), F.length("markdown").alias("n_chars"))


def stitch_numbered(spark, sf_dir):
    done = pages_op.stitch_pages(frame(spark, sf_dir, PAGES), "conv_id", "turn", "md", page_numbers=True, page_separators=True, normalize=False)
    return done.select("conv_id", digest(F.col("markdown")).alias("markdown_sha256"), F.length("markdown").alias("n_chars"))


def running_chrome(spark, sf_dir):
    return pages_op.running_chrome(frame(spark, sf_dir, PAGES), "conv_id", "md")


def strip_chrome(spark, sf_dir):
    done = pages_op.strip_chrome(frame(spark, sf_dir, PAGES), "conv_id", "md")
    return done.select("conv_id", "turn", digest(F.col("md")).alias("md_sha256"), F.length("md").alias("n_chars"))


def clean_text(spark, sf_dir):
    done = X.dehyphenate(X.normalize_line_breaks(F.col("md")))
    return frame(spark, sf_dir, PAGES).select("conv_id", "turn", digest(done).alias("md_sha256"), F.length(done).alias("n_chars"))


def section_boundaries(spark, sf_dir):
    rows = frame(spark, sf_dir, DOCS).withColumn("b", S.boundaries(F.col("content")))
    return rows.select("doc_id", F.col("b.backmatter").alias("backmatter_start"), F.col("b.appendix").alias("appendix_start"))


def section_split(spark, sf_dir):
    rows = frame(spark, sf_dir, DOCS).withColumn("b", S.boundaries(F.col("content"))).withColumn("s", S.split_at(F.col("content"), F.col("b")))
    return rows.select("doc_id", "s.title", *[digest(F.col(f"s.{p}")).alias(f"{p}_sha256") for p in ("main", "backmatter", "appendix")], F.length(S.all_parts(F.col("s"))).alias("n_chars"))


def table_guard(spark, sf_dir):
    """Guards of answers, and of blobs with a table in them, with a figure in them, without any letter or digit, and sound ones."""
    odd = F.element_at(F.array(F.lit("<table><tr><TABLE >7</table>"), F.lit("<table><td>⟦FIG:fig_p1_1⟧ 7</td></table>"), F.lit("<table 12><td>--</td></table>")), (F.col("l_partkey") % 4).cast("int"))
    rows = frame(spark, sf_dir, TABLE_ROWS.replace(" AS answer\n", " AS answer, l_partkey\n")).withColumn("probe", F.when(F.col("l_partkey") % 4 == 0, F.col("blob")).otherwise(odd))
    return rows.select("l_orderkey", "l_linenumber", T.is_refinable(F.col("probe")).alias("refinable"), T.sanitize(F.col("answer")).alias("sanitized"), T.accepted(F.col("blob"), F.col("answer")).alias("accepted"))


def table_blobs(spark, sf_dir):
    rows = frame(spark, sf_dir, TABLE_ROWS).withColumn("markdown", F.concat(F.lit("Text 1\n"), F.col("blob"), F.lit(" between "), F.when(F.col("l_linenumber") % 2 == 0, F.col("blob")).otherwise(F.lit("<table>open")), F.lit("end")))
    found = tables_op.page_blobs(rows, "l_orderkey", "l_linenumber", regions=None)
    return found.select("l_orderkey", "l_linenumber", "blob_idx", "blobs_on_page", "start", "end", "refinable", T.locator(F.col("blob_idx"), F.col("blobs_on_page")).alias("locator"))


def table_splice(spark, sf_dir):
    rows = frame(spark, sf_dir, TABLE_ROWS).withColumn("markdown", F.concat(F.lit("before  \n"), F.col("blob"), F.lit("\n\n after")))
    found = tables_op.page_blobs(rows, "l_orderkey", "l_linenumber", "answer", regions=None)
    done = tables_op.splice_answers(rows.select("l_orderkey", "l_linenumber", "markdown"), found, "l_orderkey", "l_linenumber")
    return done.select("l_orderkey", "l_linenumber", "markdown", "tables_refined")


def settled_answers(spark, sf_dir):
    """Answers of a model, a third of them cut off, as tables and as descriptions: what is used, and what is memoised."""
    rows = frame(spark, sf_dir, TABLE_ROWS).withColumns({"key": F.concat_ws(":", "l_orderkey", "l_linenumber"), "reason": F.when(F.col("l_linenumber") % 3 == 0, "length").otherwise("stop")})
    none, memo = F.lit(None).cast("string"), spark.createDataFrame([], files.MEMO)
    answered = lambda misses: misses.select("key", F.col("answer").alias("text"), F.col("reason").alias("finish_reason"), none.alias("error"))
    ways = {"table": lambda text, cut: F.when(~cut, T.accepted(F.col("blob"), text)), "description": lambda text, cut: X.present(X.mark_truncated(X.rstrip(X.description_from_tags(text)), cut))}
    parts = []
    for way, settle in ways.items():
        done, entries = memo_op.memoised(rows, memo, answered, memo_op.SCHEMA["vlm"], settle=settle)
        kept = entries.select("key", F.col("text").alias("memoised"))
        parts.append(done.join(kept, "key", "left").select("l_orderkey", "l_linenumber", F.lit(way).alias("way"), F.col("text").alias("used"), "memoised"))
    return parts[0].unionByName(parts[1])


def match_table_regions(spark, sf_dir):
    """Regions are the blobs of an order in reverse line order, each in a caption after an empty table region; equal blobs keep their order."""
    rows = frame(spark, sf_dir, TABLE_ROWS)
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "blob"))).alias("b"))
    box = F.struct(*[F.lit(v).alias(c) for c, v in (("x1", 0.1), ("y1", 0.1), ("x2", 0.5), ("y2", 0.5))])
    region = lambda label, text: F.struct(F.lit(label).alias("label"), box.alias("bbox"), text.alias("text"))
    regions = F.flatten(F.transform(F.reverse("b"), lambda x: F.array(region("table", F.lit(None).cast("string")), region("table_caption", F.concat(F.lit("Table: "), x["blob"])))))
    matched = lists.withColumn("regions", regions).withColumn("m", T.match_regions(F.transform("b", lambda x: x["blob"]), F.col("regions")))
    return matched.select("l_orderkey", F.posexplode("m").alias("blob_idx", "region"))


def notice_flags(spark, sf_dir):
    rows = frame(spark, sf_dir, DOCS).withColumn("md", F.concat("content", F.when(F.col("doc_id") % 2 == 0, "\n$$x$$").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "\n| a |\n|---|\n").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "\n> **Image description.** d").otherwise("")))
    return rows.select("doc_id", X.notice(F.col("md"), F.col("doc_id") % 7 == 0).alias("notice"))


def description_spacing(spark, sf_dir):
    made = F.concat(F.lit("para\n> **Image description.** one\n> two\n"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("\n"), F.lit("Figure 1: c\nnext\n"), F.regexp_replace("text", "\n", " "))
    rows = frame(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    return rows.select("doc_id", digest(X.description_spacing(made)).alias("md_sha256"))


def url_route(spark, sf_dir):
    return frame(spark, sf_dir, URLS).select("page_id", U.repository_of(F.col("url")).alias("repository"), U.pdf_url(F.col("url")).alias("pdf_url"), U.file_name(F.col("url")).alias("file_name"), U.arxiv_id(F.col("url")).alias("arxiv_id"))


def probe_parse(spark, sf_dir):
    rows = frame(spark, sf_dir, ANSWERS).withColumn("p", C.probe_answer(F.col("raw")))
    return rows.select("event_id", "p.citable", "p.title", F.array_join("p.authors", ";").alias("authors"), "p.year", "p.venue")


_TITLE = "'The Study of ' || replace(substr(text, 1, 60), chr(10), ' ')"
CITED = f"SELECT doc_id, {_TITLE} AS title, 'Jane Q. ' || source AS author, CAST(1990 + doc_id % 35 AS STRING) AS year, lang || ' & co_' AS venue FROM {{documents}}"


def citation_entry(spark, sf_dir):
    rows = frame(spark, sf_dir, CITED)
    authors = F.array("author")
    return rows.select("doc_id", C.citation_key(F.col("title"), authors, F.col("year")).alias("cite_key"), C.best_effort_entry(F.col("title"), authors, F.col("year"), F.col("venue"), "2024").alias("bibtex"))


HITS = """
SELECT doc_id, 'doubled' AS hit, text || ' ' || text AS title, text AS cited FROM {documents}
UNION ALL SELECT doc_id, 'next', a.text, b.text FROM {documents} AS a JOIN (SELECT doc_id - 1 AS doc_id, text FROM {documents}) AS b USING (doc_id)
UNION ALL SELECT doc_id, 'spaced', text, '  ' || replace(text, ' ', '  ') || '!!' FROM {documents}
UNION ALL SELECT doc_id, 'thinned', text, replace(text, 'e ', 'e') FROM {documents}"""


def title_match(spark, sf_dir):
    """Each whole text as a title against four hits of a search for it: half of it, the next text, itself in other spacing, itself with words run together."""
    return frame(spark, sf_dir, HITS).select("doc_id", "hit", C.titles_match(F.col("title"), F.col("cited")).alias("matches"))


def title_links(spark, sf_dir):
    """All matches of whole texts in both directions: classes of equal normalised text, and pairs between their representatives."""
    return titles_op.title_links(frame(spark, sf_dir, "SELECT doc_id, text FROM {documents}"))


def source_chain(spark, sf_dir):
    docs = frame(spark, sf_dir, CITED).withColumn("url", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/2301."), (F.col("doc_id") + 10000).cast("string"))).otherwise(F.lit("file.pdf")))
    probe = F.when(F.col("doc_id") % 5 != 4, F.struct((F.col("doc_id") % 3 != 0).alias("citable"), F.when(F.col("doc_id") % 7 != 0, F.col("title")).alias("title"), F.array("author").alias("authors"), F.col("year"), F.col("venue")))
    docs = docs.withColumn("probe", probe).withColumn("fallback_title", F.lit("Untitled_Paper"))
    aid = F.concat(F.lit("2301."), (F.col("doc_id") + 10000).cast("string"))
    paper = F.struct("title", F.array("author").alias("authors"), "year", F.when(F.col("doc_id") % 4 == 0, F.lit("arXiv.org")).otherwise(F.col("venue")).alias("venue"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"))
    by_id = docs.filter("doc_id % 8 < 4").select(aid.alias("arxiv_id"), paper.alias("paper"))
    exports = docs.filter("doc_id % 8 = 4").select(aid.alias("arxiv_id"), "title", F.array("author").alias("authors"), "year", F.lit("cs.CL").alias("primary_class"))
    by_title = docs.filter("doc_id % 10 = 1").groupBy("title").agg(F.min_by(paper, "doc_id").alias("paper")).select(F.col("title").alias("query"), F.lit(1).alias("rank"), "paper")
    return cite_op.cite(docs.select("doc_id", "url", "probe", "fallback_title"), by_id, exports, by_title, "2024")


def memo_hits_misses(spark, sf_dir):
    """Every third key is in the memo, twice; texts of an older schema don't count."""
    items = frame(spark, sf_dir, "SELECT doc_id, text, lang FROM {documents}").withColumn("key", memo_op.key_of("probe", text=F.col("text"), lang=F.col("lang")))
    memo = items.filter("doc_id % 3 = 0").select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("value_schema")).distinct().select("key", "value_schema", F.concat(F.lit("v"), F.col("value_schema")).alias("text"), F.lit("2024-01-01").alias("written_at"))
    hits, misses = memo_op.split_hits(items.select("doc_id", "key"), memo, 2)
    return hits.select("doc_id", F.col("text").alias("found")).unionByName(misses.select("doc_id", F.lit(None).cast("string").alias("found")))


def memo_table_lookup(spark, sf_dir):
    """The same of a memo in a bucketed folder, written twice: an older answer, an entry without a text and one of an older schema don't count."""
    items = frame(spark, sf_dir, "SELECT doc_id, text, lang FROM {documents}").withColumn("key", memo_op.key_of("probe", text=F.col("text"), lang=F.col("lang")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/memo-{uuid.uuid4().hex}"
    entry = lambda rows, text, day, schema=2: rows.select("key", F.lit(schema).alias("value_schema"), text.cast("string").alias("text"), F.lit(day).cast("timestamp").alias("written_at"))
    keys = items.groupBy("key").agg(F.min(F.col("doc_id") % 3).alias("r"))
    third, rest = keys.filter("r = 0"), keys.filter("r = 1")
    memo_table.append_memo(entry(third, F.concat(F.lit("v"), "key"), "2024-01-02").unionByName(entry(rest, F.lit(None), "2024-01-02")), path)
    memo_table.append_memo(entry(third, F.lit("old"), "2024-01-01").unionByName(entry(rest, F.lit("v1"), "2024-01-03", 1)), path)
    hits, misses = memo_op.split_hits(items.select("doc_id", "key"), memo_table.read_memo(spark, path), 2)
    return hits.select("doc_id", (F.col("text") == F.concat(F.lit("v"), "key")).alias("found")).unionByName(misses.select("doc_id", F.lit(False).alias("found")))


def embedded_figures(spark, sf_dir):
    """Regions of pages that hold a table and a figure of their own, with embedded images: those are the figures, clamped and from top to bottom, and the table keeps its box."""
    rows = frame(spark, sf_dir, "SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 9 AS INT) AS a, CAST(max(l_partkey) % 7 AS INT) AS b FROM {lineitem} GROUP BY l_orderkey, l_linenumber")
    box = lambda *c: F.struct(*[(F.expr(v) / 4).cast("double").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), c)])
    region = lambda label, figure, *c: F.struct(F.lit(label).alias("label"), box(*c).alias("bbox"), F.lit("t").alias("text"), F.lit(figure).cast("int").alias("figure"))
    own = rows.withColumns({"regions": F.array(region("table", None, "a", "b", "a + 1", "b + 1"), region("image", 1, "0", "0", "1", "1")), "embedded": F.array(box("a - 2", "b - 3", "a", "b"), box("1", "a - 4", "2", "a"), box("b", "2", "b + 1", "3"))})
    chosen = pages_op.select_figures(own, "pdf-embedded").select("l_orderkey", "l_linenumber", F.posexplode("regions").alias("idx", "r"))
    return chosen.select("l_orderkey", "l_linenumber", "idx", "r.label", "r.figure", *[F.col(f"r.bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def bundle_pages(spark, sf_dir):
    """Documents as pages of bundles of fifty, written as folders with a manifest each and read again."""
    rows = frame(spark, sf_dir, "SELECT CAST(doc_id DIV 50 AS STRING) AS doc_id, CAST(doc_id % 50 + 1 AS INT) AS page_number, text AS markdown, 'Bundle ' || CAST(doc_id DIV 50 AS STRING) AS name FROM {documents}")
    root = f"{checkpoint_dir(spark).rstrip('/')}/bundles-{uuid.uuid4().hex}"
    files.write_texts(bundles.manifests(rows.withColumn("regions", F.array().cast(f"array<{bundles.REGION}>")), "2024-01-01"), root, clobber=False)
    return bundles.read_bundles(spark, root).select("doc_id", "page_number", "name", digest(F.col("markdown")).alias("md_sha256"))


def prompts(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    context = X.page_context(F.col("doc_id"), F.col("text"))
    answer = F.concat(F.lit("ok "), F.when(F.col("doc_id") % 3 != 0, F.lit("<img_desc> ")).otherwise(""), F.substring("text", 1, 50), F.when(F.col("doc_id") % 2 == 0, F.lit(" </img_desc> rest")).otherwise(""))
    return rows.select("doc_id", digest(context).alias("context_sha256"), F.length(X.truncated(X.strip(F.col("text")), 3000)).alias("probe_chars"), X.mark_truncated(X.description_from_tags(answer), F.col("doc_id") % 5 == 0).alias("description"))


WHOLE = f"SELECT doc_id, text, 'The Study of ' || replace(text, {NL}, ' ') AS title, 'Jane Q. ' || source AS author, CAST(1990 + doc_id % 35 AS STRING) AS year, lang || ' & co_' AS venue FROM {{documents}}"


def whole_texts(spark, sf_dir):
    """Description, output stem and citation entry of whole texts of many lines, of which ``prompts``, ``base_names`` and ``citation_entry`` take the beginning."""
    answer = F.concat(F.lit("ok "), F.when(F.col("doc_id") % 3 != 0, F.lit("<img_desc> ")).otherwise(""), "text", F.when(F.col("doc_id") % 2 == 0, F.lit(" </img_desc> rest")).otherwise(""))
    rows = frame(spark, sf_dir, WHOLE).withColumn("description", X.mark_truncated(X.description_from_tags(answer), F.col("doc_id") % 5 == 0)).withColumn("base", X.base_name(F.col("text")))
    rows = rows.withColumn("bibtex", C.best_effort_entry(F.col("title"), F.array("author"), F.col("year"), F.col("venue"), "2024"))
    return rows.select("doc_id", *[c for name in ("description", "base", "bibtex") for c in (digest(F.col(name)).alias(f"{name}_sha256"), F.length(name).alias(f"{name}_chars"))])


def page_ranges(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'all' WHEN 1 THEN '3' WHEN 2 THEN '2-' WHEN 3 THEN '-4' WHEN 4 THEN '9-5' ELSE '3-100' END AS spec, CAST(o_orderkey % 12 AS BIGINT) AS total FROM {orders}")
    return rows.select("o_orderkey", F.array_join(X.page_numbers(F.col("spec"), F.col("total")).cast("array<string>"), ",").alias("pages"))


def base_names(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'CON' WHEN doc_id % 10 = 1 THEN '...' ELSE left(text, 40) END AS name FROM {documents}")
    return rows.select("doc_id", X.base_name(F.col("name")).alias("base"))


def join_splits(spark, sf_dir):
    rows = frame(spark, sf_dir, DOCS)
    note = F.lit("\n\n---\n\n*Transcribed with OCR and VLMs; text may contain mistakes.*\n")
    part = lambda name, text: rows.select(F.col("doc_id").cast("string").alias("base"), F.lit(name).alias("part"), text.alias("content"))
    main = part("main", F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("```\n@misc{k,\n}\n```\n\n---\n\n")).otherwise(""), "content", F.when(F.col("doc_id") % 3 == 0, note).otherwise("")))
    extra = part("appendix", F.concat(F.lit("# A\r\n\r\n| t |\r\n|---|\r\n"), F.when(F.col("doc_id") % 5 == 0, note).otherwise(""))).filter("CAST(base AS BIGINT) % 4 = 0")
    done = parts_op.join_splits(main.unionByName(extra))
    return done.select("base", digest(F.col("full")).alias("full_sha256"), F.length("full").alias("n_chars"))


def transcribe_documents(spark, sf_dir):
    """A whole run over documents of four pages, with the stub backend and an empty memo."""
    pages = frame(spark, sf_dir, RAW).select(
        F.floor(F.col("doc_id") / 4).cast("string").alias("doc_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("page_number"), F.col("width_px").cast("int").alias("width_px"), F.col("height_px").cast("int").alias("height_px"),
        digest(F.col("raw")).alias("raster_sha256"), "raw", F.lit("stop").alias("finish_reason"))
    documents, _ = transcribe.run(pages, spark.createDataFrame([], files.MEMO))
    return documents.select("doc_id", digest(F.col("markdown")).alias("markdown_sha256"), F.length("markdown").alias("n_chars"))


def output_parts(spark, sf_dir):
    """The part files of documents with a citation and a notice each."""
    documents = frame(spark, sf_dir, DOCS).select("doc_id", F.concat("content", F.lit("\n")).alias("markdown"), F.when(F.col("doc_id") % 2 == 0, F.lit("@misc{k,\n}")).alias("bibtex"))
    parts = transcribe.outputs(documents, config.resolve({"bibtex": {"append_to_document": True}}))
    return parts.select("doc_id", "part", digest(F.col("content")).alias("content_sha256"), F.length("content").alias("n_chars"))


def output_files(spark, sf_dir):
    """Names and contents of the files of documents: stems by a citation's key or the source's name, no full suffix, no split for it."""
    rows = frame(spark, sf_dir, "SELECT doc_id, '# T' || chr(10) || text AS markdown, 'My paper, no ' || CAST(doc_id AS STRING) AS name FROM {documents}")
    key = F.concat(F.lit("key"), F.col("doc_id").cast("string"))
    entries = rows.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("@misc{"), key, F.lit(",\n}"))).alias("bibtex"), (F.col("doc_id") % 3 == 1).alias("mock"))
    made = transcribe.finalize(rows.withColumn("tables_refined", F.lit(0)), entries, config.resolve({"output": {"full_suffix": False, "split": False, "notice": False}}))
    return made.select("doc_id", "part", "file", digest(F.col("content")).alias("content_sha256"), F.length("content").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        section_split, section_boundaries, layout_blocks, page_markdown, pixel_boxes, figure_inject, stitch, stitch_numbered, running_chrome, strip_chrome, clean_text, table_guard, table_blobs, table_splice, match_table_regions,
        notice_flags, description_spacing, url_route, probe_parse, citation_entry, title_match, title_links, source_chain, memo_hits_misses, memo_table_lookup, embedded_figures, bundle_pages, prompts, whole_texts, page_ranges, base_names, join_splits, transcribe_documents, output_parts, output_files, settled_answers,
    )
}

_KEEP = "CASE WHEN fig THEN '⟦FIG:fig_p' || page_number || '_' || figure || '⟧' ELSE nullif(body, '') END"
_MARKDOWN = _BLOCKS + f", m AS (SELECT doc_id, string_agg({_KEEP}, chr(10) || chr(10) ORDER BY i) AS md FROM z GROUP BY doc_id), p AS (SELECT d.doc_id, CASE WHEN m.doc_id IS NULL THEN {_strip('raw')} ELSE coalesce(md, '') END AS md FROM d LEFT JOIN m USING (doc_id))"
_PAD = lambda v, side, sign: f"CAST(round_even(greatest(least({v} {sign} 0.01, 1), 0) * {side}, 0) AS INT)"
_LINES = rf"""
WITH p AS (@PAGES@), l AS (SELECT *, string_split(md, chr(10)) AS ls FROM p), f AS (SELECT *, list_filter(ls, lambda x: trim(x) <> '') AS fs FROM l),
e AS (SELECT *, coalesce(fs[1], '') AS t, coalesce(fs[len(fs)], '') AS bt FROM f),
k AS (SELECT *, CASE WHEN {_strip('t')} LIKE '|%' THEN NULL ELSE nullif(regexp_replace({_strip('t')}, '\d+', '#', 'g'), '') END AS tn, CASE WHEN {_strip('bt')} LIKE '|%' THEN NULL ELSE nullif(regexp_replace({_strip('bt')}, '\d+', '#', 'g'), '') END AS bn, count(*) OVER (PARTITION BY conv_id) AS n FROM e),
h AS (SELECT conv_id, 'top' AS place, tn AS line, count(*) AS pages, max(n) AS n FROM k WHERE length(tn) <= 80 GROUP BY 1, 3 UNION ALL SELECT conv_id, 'bottom', bn, count(*), max(n) FROM k WHERE length(bn) <= 80 GROUP BY 1, 3),
c AS (SELECT * FROM h WHERE n >= 3 AND pages >= greatest(2, ceil(round(n * 0.6, 9))))
"""
_CONTENT = r"""
WITH d AS (@DOCS@), o AS (SELECT *, @FIRSTS@ FROM d)
"""
_HEAD = lambda p: r"(?im)^#+\s+" + p
_AT = lambda p, c="content": f"CASE WHEN len(string_split_regex({c}, '{_HEAD(p)}')) > 1 THEN length(string_split_regex({c}, '{_HEAD(p)}')[1]) END"
_MARKER = r"(?i)(?:^|\n)#{3,4}\s+Page\s+\d+\s*$"
_SHIFT = lambda c, at: rf"(CASE WHEN regexp_matches(left({c}, CAST({at} AS BIGINT)), '(?im)^#{{3,4}}[ ]+Page[ ]+\d+\s*\z') THEN length(regexp_replace(left({c}, CAST({at} AS BIGINT)), '(?im)^#{{3,4}}[ ]+Page[ ]+\d+\s*\z', '')) ELSE {at} END)"
# The headings in order of priority, written out here so that the SQL does not share the engine's lists.
_SQL_BACK = (
    r"(Acknowledgments?)\b", r"(Acknowledgements?)\b", r"Author\s+(Contributions)", r"Funding", r"Impact\s+(Statement)", r"Broader\s+(Impact)", r"Societal\s+(Impact)", r"Ethical\s+(Considerations)", r"(References|Bibliography)\b",
    r"Works\s+Cited\b", r"Literature\s+Cited\b", r"Citations?\b", r"References\s+and\s+Notes\b", r"References\s+Cited\b", r"Cited\s+(Works|Literature)\b",
)
_SQL_APPENDIX = (r"(Appendix|Appendices)\b", r"(Supplementary|Supporting)\s+(Material|Materials|Information|Data)", r"Supplemental\s+", r"SI\s+", r"S\d+\.\s+")
_BOUNDS = (
    "WITH d AS (@DOCS@), o AS (SELECT *, list_min([" + ", ".join(_AT(p) for p in _SQL_BACK) + "]) AS back, list_min([" + ", ".join(_AT(p) for p in _SQL_APPENDIX) + "]) AS plain, "
    + _AT(r"A\s+") + " AS g1, " + _AT(r"A\.\s+") + " AS g2 FROM d), "
    + "q AS (SELECT *, list_min([plain, CASE WHEN g1 > back THEN g1 END, CASE WHEN g2 > back THEN g2 END]) AS app FROM o), "
    + f"s AS (SELECT *, {_SHIFT('content', 'back')} AS back2, {_SHIFT('content', 'app')} AS app2 FROM q), "
    + "t AS (SELECT *, left(content, CAST(app2 AS BIGINT)) AS ahead FROM s), "
    + "v AS (SELECT doc_id, content, CASE WHEN back2 > app2 THEN coalesce(" + ", ".join(_AT(p, "ahead") for p in _SQL_BACK) + ") ELSE back2 END AS backmatter_start, app2 AS appendix_start FROM t)"
)
_CUT = lambda x: _strip(rf"regexp_replace({x}, '---\s*\z', '')")
_PARTS = _BOUNDS + f""", w AS (SELECT *, coalesce(appendix_start, length(content)) AS c2, coalesce(backmatter_start, appendix_start, length(content)) AS c1 FROM v),
x AS (SELECT doc_id, {_strip("regexp_extract(content, '(?m)^# (.+?)$', 1)")} AS title, {_CUT('left(content, CAST(c1 AS BIGINT))')} AS main,
 CASE WHEN backmatter_start IS NOT NULL THEN {_CUT('substr(content, CAST(c1 + 1 AS BIGINT), CAST(c2 - c1 AS BIGINT))')} END AS backmatter, CASE WHEN appendix_start IS NOT NULL THEN {_CUT('substr(content, CAST(c2 + 1 AS BIGINT))')} END AS appendix FROM w)"""
_SANITIZED = rf"""
WITH t AS (@TABLE_ROWS@), f AS (SELECT *, {_strip('answer')} AS bare FROM t),
g AS (SELECT *, list_filter(string_split({_strip("coalesce(nullif(regexp_extract(bare, '(?s)\\A```[A-Za-z]*\\s*\\n(.*?)\\n?```\\s*\\z', 1), ''), bare)")}, chr(10)), lambda x: trim(x) <> '') AS ls FROM f),
s AS (SELECT *, CASE WHEN len(ls) >= 2 AND len(list_filter(ls, lambda x: left(ltrim(x), 1) <> '|')) = 0 THEN array_to_string(list_transform(ls, lambda x: trim(x)), chr(10)) END AS sanitized FROM g),
a AS (SELECT *, length(regexp_replace(regexp_replace(regexp_replace(blob, '<[^>]+>', ' ', 'g'), '&#?\w+;', ' ', 'g'), '\D', '', 'g')) AS had, length(regexp_replace(sanitized, '\D', '', 'g')) AS kept FROM s),
b AS (SELECT *, CASE WHEN sanitized IS NOT NULL AND (had = 0 OR kept >= 0.8 * had) THEN sanitized END AS accepted FROM a)
""".replace("\\\\", "\\")
_FENCE = r"coalesce(nullif(regexp_extract(trim(raw), '(?s)\A```[A-Za-z]*\s*\n(.*?)\n?```\s*\z', 1), ''), raw)"
_ESCAPED = lambda x: rf"replace(replace(regexp_replace({x}, '([&%$#_{{}}~^\\]|[\t\n\r])', '\\\1', 'g'), '“', '``'), '—', '---')"
_WORDS = "list_transform(string_split(title, ' '), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g'))"
_KEY = f"lower(list_extract(string_split(author, ' '), -1)) || year || coalesce(list_filter({_WORDS}, lambda w: length(w) > 2 AND NOT list_contains(['a', 'an', 'the', 'on', 'in', 'of', 'for', 'and', 'or'], w))[1], {_WORDS}[1])"
_NORM = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g'))"
_NOTE = "chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*Transcribed with OCR and VLMs; text may contain mistakes.*' || chr(10)"

_FIGURE_BLOCK = """'![' || replace(replace(coalesce(text, 'fig_p' || page_number || '_' || figure), '[', chr(92) || '['), ']', chr(92) || ']') || '](figures/fig_p' || page_number || '_' || figure || '.png)' || chr(10) || chr(10)
 || CASE WHEN doc_id % 9 <> 0 THEN '> **Image description.** Line one of fig_p' || page_number || '_' || figure || chr(10) || '>' || chr(10) || '>  line two' ELSE '> **Image description.** [figure description unavailable]' END || chr(10)"""

_CANDIDATE = lambda x: f"""CASE WHEN contains({x}, '⟦FIG:') OR regexp_matches({_strip(x)}, '^(\\||> |!\\[|Figure |(?i:<center>figure ))') OR length({_strip(x)}) > 80 THEN NULL ELSE nullif(regexp_replace({_strip(x)}, '\\d+', '#', 'g'), '') END"""
#: A whole run in SQL: pages of four rows a document, the stub's descriptions, chrome, stitching, joined words, blocks for tokens.
_RUN = (
    _BLOCKS.replace("@RAW@", RAW.replace("doc_id % 7 + 1 AS page_number", "doc_id % 4 + 1 AS page_number"))
    + rf""", m AS (SELECT doc_id, string_agg({_KEEP}, chr(10) || chr(10) ORDER BY i) AS md FROM z GROUP BY doc_id),
pg AS (SELECT d.doc_id // 4 AS doc, d.doc_id, d.page_number, sha256(raw) AS raster, CASE WHEN m.doc_id IS NULL THEN {_strip('raw')} ELSE coalesce(md, '') END AS md FROM d LEFT JOIN m USING (doc_id)),
fg AS (SELECT pg.doc, z.page_number, z.figure, pg.raster, {_strip("regexp_replace(pg.md, '⟦FIG:[^⟧]+⟧', '', 'g')")} AS plain, """
    + ", ".join(f"{_PAD(v, side, sign).replace('0.01', '0.02')} AS {name}" for v, side, sign, name in (("z.x1", "z.width_px", "-", "pa"), ("z.y1", "z.height_px", "-", "pb"), ("z.x2", "z.width_px", "+", "pc"), ("z.y2", "z.height_px", "+", "pd")))
    + r""" FROM z JOIN pg USING (doc_id) WHERE fig),
fx AS (SELECT *, 'Describe what this image shows: its kind, its parts, and every text in it.' || chr(10) || chr(10) || 'The text around it, for names and terms only:' || chr(10) || 'This image appears on page ' || page_number || '. The surrounding page content follows.' || chr(10) || chr(10)
  || CASE WHEN length(plain) > 2000 THEN left(plain, 1997) || '...' ELSE plain END || chr(10) || 'Put the description inside <img_desc> and </img_desc>.' AS prompt FROM fg),
bl AS (SELECT doc, 'fig_p' || page_number || '_' || figure AS fid, '> **Image description.** ' || CASE WHEN pc - pa >= 2 AND pd - pb >= 2
  THEN 'Stub description ' || left(sha256(raster || '#' || pa || ',' || pb || ',' || pc || ',' || pd || chr(10) || prompt), 12) || '.' ELSE '[figure description unavailable]' END AS block FROM fx),
"""
    + rf"""ln AS (SELECT *, string_split(md, chr(10)) AS ls FROM pg), sp AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i]) <> '') AS spots FROM ln),
ed AS (SELECT *, coalesce(ls[spots[1]], '') AS t, coalesce(ls[spots[len(spots)]], '') AS bt, count(*) OVER (PARTITION BY doc) AS n FROM sp), k AS (SELECT *, {_CANDIDATE('t')} AS tn, {_CANDIDATE('bt')} AS bn FROM ed),
h AS (SELECT doc, 'top' AS place, tn AS line, count(*) AS pages, max(n) AS n FROM k WHERE tn IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT doc, 'bottom', bn, count(*), max(n) FROM k WHERE bn IS NOT NULL GROUP BY 1, 3),
ch AS (SELECT * FROM h WHERE n >= 3 AND pages >= greatest(2, ceil(round(n * 0.6, 9)))),
y AS (SELECT k.*, EXISTS (SELECT 1 FROM ch WHERE ch.doc = k.doc) AS any_chrome, EXISTS (SELECT 1 FROM ch WHERE ch.doc = k.doc AND place = 'top' AND line = tn) AS cut_top, EXISTS (SELECT 1 FROM ch WHERE ch.doc = k.doc AND place = 'bottom' AND line = bn) AS cut_bottom FROM k),
cl AS (SELECT doc, page_number, CASE WHEN any_chrome THEN array_to_string(list_filter(ls, lambda x, j: NOT (cut_top AND j = spots[1]) AND NOT (cut_bottom AND j = spots[len(spots)])), chr(10)) ELSE md END AS md FROM y),
st AS (SELECT doc, string_agg(regexp_replace(regexp_replace(md, '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g'), chr(10) || chr(10) ORDER BY page_number) AS md FROM cl GROUP BY doc),
dh AS (SELECT doc, regexp_replace(md, '([\p{{L}}\p{{M}}\p{{N}}_])-\n\s*([\p{{L}}\p{{M}}\p{{N}}_])', '\1\2', 'g') AS md FROM st),
gp AS (SELECT doc, string_split_regex(md, '⟦FIG:[^⟧]+⟧') AS gaps, regexp_extract_all(md, '⟦FIG:([^⟧]+)⟧', 1) AS ids FROM dh), pc AS (SELECT doc, gaps, ids, unnest(range(1, len(gaps) + 1)) AS k FROM gp),
ot AS (SELECT pc.doc, string_agg(gaps[k] || CASE WHEN k > len(ids) THEN '' ELSE coalesce(block, '> **Image description.** [figure description unavailable]') END, '' ORDER BY k) AS md FROM pc LEFT JOIN bl ON bl.doc = pc.doc AND bl.fid = ids[k] GROUP BY pc.doc),
fn AS (SELECT doc, {_strip(r"regexp_replace(md, '\n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS md FROM ot)
SELECT CAST(doc AS VARCHAR) AS doc_id, sha256(md) AS markdown_sha256, CAST(length(md) AS INT) AS n_chars FROM fn"""
)

ORACLE_SQL: dict[str, str] = {
    name: _oracle(sql, RAW=RAW, PAGES=PAGES, DOCS=DOCS, TABLE_ROWS=TABLE_ROWS, URLS=URLS, ANSWERS=ANSWERS, CITED=CITED, WHOLE=WHOLE, HITS=HITS)
    for name, sql in {
        "layout_blocks": _BLOCKS + "SELECT doc_id, CAST(i - 1 AS INT) AS block_idx, label, round(x1, 9) AS x1, round(y1, 9) AS y1, round(x2, 9) AS x2, round(y2, 9) AS y2, sha256(coalesce(text, '')) AS text_sha256, CAST(length(text) AS INT) AS n_chars, figure FROM z",
        "page_markdown": _MARKDOWN + "SELECT doc_id, sha256(md) AS markdown_sha256, CAST(length(md) AS INT) AS n_chars FROM p",
        "pixel_boxes": _BLOCKS + f""", b2 AS (SELECT doc_id, 'fig_p' || page_number || '_' || figure AS fig_id, text AS caption, {_PAD('x1', 'width_px', '-')} AS a, {_PAD('y1', 'height_px', '-')} AS b, {_PAD('x2', 'width_px', '+')} AS c, {_PAD('y2', 'height_px', '+')} AS d FROM z WHERE fig)
            SELECT doc_id, fig_id, caption, CASE WHEN c - a >= 2 AND d - b >= 2 THEN a END AS px_x1, CASE WHEN c - a >= 2 AND d - b >= 2 THEN b END AS px_y1, CASE WHEN c - a >= 2 AND d - b >= 2 THEN c END AS px_x2, CASE WHEN c - a >= 2 AND d - b >= 2 THEN d END AS px_y2 FROM b2""",
        "figure_inject": _BLOCKS + f", m AS (SELECT doc_id, string_agg(CASE WHEN fig THEN {_FIGURE_BLOCK} ELSE nullif(body, '') END, chr(10) || chr(10) ORDER BY i) AS md FROM z GROUP BY doc_id), p AS (SELECT d.doc_id, CASE WHEN m.doc_id IS NULL THEN {_strip('raw')} ELSE md END AS md FROM d LEFT JOIN m USING (doc_id)) SELECT doc_id, sha256(md) AS markdown_sha256, CAST(length(md) AS INT) AS n_chars FROM p",
        "stitch": r"WITH p AS (@PAGES@), s AS (SELECT conv_id, string_agg(regexp_replace(regexp_replace(md, '\n{3,}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g'), chr(10) || chr(10) ORDER BY turn) AS md FROM p GROUP BY conv_id) SELECT conv_id, sha256(md) AS markdown_sha256, CAST(length(md) AS INT) AS n_chars FROM s",
        "stitch_numbered": r"WITH p AS (@PAGES@), s AS (SELECT conv_id, string_agg('#### Page ' || turn || chr(10) || chr(10) || regexp_replace(md, '\A\n+|\n+\z', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS md FROM p GROUP BY conv_id) SELECT conv_id, sha256(md) AS markdown_sha256, CAST(length(md) AS INT) AS n_chars FROM s",
        "running_chrome": _LINES + "SELECT conv_id, place, line, pages FROM c",
        "strip_chrome": _LINES + r""", y AS (SELECT k.*, EXISTS (SELECT 1 FROM c WHERE c.conv_id = k.conv_id) AS any_chrome, EXISTS (SELECT 1 FROM c WHERE c.conv_id = k.conv_id AND place = 'top' AND line = tn) AS cut_top, EXISTS (SELECT 1 FROM c WHERE c.conv_id = k.conv_id AND place = 'bottom' AND line = bn) AS cut_bottom FROM k),
            i AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i]) <> '') AS spots FROM y),
            g AS (SELECT conv_id, turn, CASE WHEN any_chrome THEN regexp_replace(array_to_string(list_filter(ls, lambda x, j: NOT (cut_top AND j = spots[1]) AND NOT (cut_bottom AND j = spots[len(spots)])), chr(10)), '\A\n+|\n+\z', '', 'g') ELSE md END AS md FROM i)
            SELECT conv_id, turn, sha256(md) AS md_sha256, CAST(length(md) AS INT) AS n_chars FROM g""",
        "clean_text": r"WITH p AS (@PAGES@), s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(md, '\n{3,}', chr(10) || chr(10), 'g'), '([\p{L}\p{N}_])-\n\s*([\p{L}\p{N}_])', '\1\2', 'g') AS md FROM p) SELECT conv_id, turn, sha256(md) AS md_sha256, CAST(length(md) AS INT) AS n_chars FROM s",
        "section_boundaries": _BOUNDS + "SELECT doc_id, CAST(backmatter_start AS INT) AS backmatter_start, CAST(appendix_start AS INT) AS appendix_start FROM v",
        "section_split": _PARTS + """SELECT doc_id, title, sha256(main) AS main_sha256, sha256(backmatter) AS backmatter_sha256, sha256(appendix) AS appendix_sha256,
            CAST(length(concat_ws(chr(10) || chr(10), nullif(main, ''), '# ' || title || ' - Appendix' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || nullif(appendix, ''), '# ' || title || ' - Backmatter' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || nullif(backmatter, ''))) AS INT) AS n_chars FROM x""",
        "table_guard": _SANITIZED + "SELECT l_orderkey, l_linenumber, l_partkey % 4 = 0 AS refinable, sanitized, accepted FROM (SELECT b.*, p.l_partkey FROM b JOIN (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) p USING (l_orderkey, l_linenumber))",
        "settled_answers": _SANITIZED + r""", u AS (SELECT l_orderkey, l_linenumber, 'table' AS way, CASE WHEN l_linenumber % 3 <> 0 THEN accepted END AS used FROM b
            UNION ALL SELECT l_orderkey, l_linenumber, 'description', CASE WHEN l_linenumber % 3 = 0 THEN bare || ' [...]' ELSE bare END FROM b)
            SELECT l_orderkey, l_linenumber, way, used, used AS memoised FROM u""",
        "transcribe_documents": _RUN,
        "output_files": """WITH d AS (SELECT doc_id, '# T' || chr(10) || text AS md, CASE WHEN doc_id % 3 = 2 THEN 'key' || doc_id ELSE 'My_paper_no_' || doc_id END AS base FROM documents),
            f AS (SELECT doc_id, 'full' AS part, base || '.md' AS file, md AS content FROM d UNION ALL SELECT doc_id, 'bib', base || '.bib', '@misc{key' || doc_id || ',' || chr(10) || '}' || chr(10) FROM d WHERE doc_id % 3 <> 0)
            SELECT doc_id, part, file, sha256(content) AS content_sha256, CAST(length(content) AS INT) AS n_chars FROM f""",
        "output_parts": _PARTS + r""", c AS (SELECT x.*, d.content || chr(10) AS md, CASE WHEN x.doc_id % 2 = 0 THEN '```' || chr(10) || '@misc{k,' || chr(10) || '}' || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END AS cited FROM x JOIN d USING (doc_id)),
            p AS (SELECT doc_id, 'full' AS part, cited || md AS t FROM c UNION ALL SELECT doc_id, 'main', cited || main FROM c
              UNION ALL SELECT doc_id, 'appendix', '# ' || title || ' - Appendix' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || appendix FROM c WHERE appendix <> ''
              UNION ALL SELECT doc_id, 'backmatter', '# ' || title || ' - Backmatter' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || backmatter FROM c WHERE backmatter <> ''),
            i AS (SELECT doc_id, part, t, contains(t, '$$') OR contains(t, chr(92) || '(') OR contains(t, chr(92) || '[') AS eq FROM p),
            n AS (SELECT doc_id, part, regexp_replace(t, '\s+\z', '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*Transcribed with OCR; text' || CASE WHEN eq THEN ' and equations' ELSE '' END || ' may contain mistakes.*' || chr(10) AS t FROM i)
            SELECT doc_id, part, sha256(t) AS content_sha256, CAST(length(t) AS INT) AS n_chars FROM n""",
        "source_chain": (f"""WITH c AS (@CITED@), k AS (SELECT *, {_KEY} AS cite_key, '2301.' || (doc_id + 10000) AS aid, CASE WHEN doc_id % 4 = 0 THEN 'arXiv.org' ELSE venue END AS paper_venue, doc_id % 2 = 0 AS known, doc_id % 5 <> 4 AS probed, doc_id % 3 <> 0 AS citable FROM c),
            e AS (SELECT *, '  title={{' || {_ESCAPED('title')} || '}},' || chr(10) || '  author={{' || {_ESCAPED('author')} || '}},' || chr(10) || '  year={{' || year || '}},' || chr(10) AS body, '  eprint={{' || aid || '}},' || chr(10) || '  archivePrefix={{arXiv}},' || chr(10) AS eprint, '  url={{https://arxiv.org/abs/' || aid || '}}' || chr(10) || '}}' AS tail FROM k),
            w AS (SELECT title AS query, '@article{{' || cite_key || ',' || chr(10) || body || '  journal={{' || {_ESCAPED('paper_venue')} || '}}' || chr(10) || '}}' AS entry FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS nth FROM e WHERE doc_id % 10 = 1) WHERE nth = 1),
            j AS (SELECT e.*, w.entry AS titled, CASE WHEN NOT (known OR probed AND citable) THEN CASE WHEN probed THEN 'not-citable' ELSE 'unknown' END WHEN known AND doc_id % 8 < 4 THEN 's2-arxiv-id' WHEN known AND doc_id % 8 = 4 THEN 'arxiv-export'
                WHEN w.entry IS NOT NULL THEN 's2-title' WHEN probed AND doc_id % 7 <> 0 THEN 'best-effort' ELSE 'no usable metadata' END AS source
              FROM e LEFT JOIN w ON w.query = CASE WHEN probed AND doc_id % 7 <> 0 THEN title ELSE 'Untitled_Paper' END)
            SELECT doc_id, CASE source WHEN 's2-arxiv-id' THEN CASE WHEN paper_venue = 'arXiv.org' THEN '@misc{{' || cite_key || ',' || chr(10) || body || eprint || tail ELSE '@article{{' || cite_key || ',' || chr(10) || body || '  journal={{' || {_ESCAPED('paper_venue')} || '}}' || chr(10) || '}}' END
                WHEN 'arxiv-export' THEN '@misc{{' || cite_key || ',' || chr(10) || body || eprint || '  primaryClass={{cs.CL}},' || chr(10) || tail WHEN 's2-title' THEN titled
                WHEN 'best-effort' THEN '% NOTE: Best-effort entry generated from the document''s own front matter' || chr(10) || '% (no citation database was consulted). Verify before use.' || chr(10) || '%' || chr(10) || '@misc{{' || cite_key || ',' || chr(10) || body || '  note={{' || {_ESCAPED('venue')} || '}}' || chr(10) || '}}' END AS bibtex, source FROM j""").replace("{{", "{").replace("}}", "}"),
        "table_blobs": """WITH t AS (@TABLE_ROWS@), n AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS c FROM t), u AS (SELECT *, unnest(range(1, c + 1)) AS k FROM n)
            SELECT l_orderkey, l_linenumber, CAST(k AS INT) AS blob_idx, CAST(c AS INT) AS blobs_on_page, CAST(7 + (k - 1) * (length(blob) + 9) AS BIGINT) AS start, CAST(7 + (k - 1) * (length(blob) + 9) + length(blob) AS BIGINT) AS "end", true AS refinable,
            CASE WHEN c = 1 THEN 'This page contains a single table; reconstruct it.' ELSE 'This page contains 2 tables; reconstruct the ' || CASE k WHEN 1 THEN '1st' ELSE '2nd' END || ' table (the one whose values match the OCR text below).' END AS locator FROM u""",
        "table_splice": _SANITIZED + "SELECT l_orderkey, l_linenumber, CASE WHEN accepted IS NULL THEN 'before  ' || chr(10) || blob || chr(10) || chr(10) || ' after' ELSE 'before' || chr(10) || chr(10) || accepted || chr(10) || chr(10) || 'after' END AS markdown, CASE WHEN accepted IS NULL THEN 0 ELSE 1 END AS tables_refined FROM b",
        "match_table_regions": """WITH t AS (@TABLE_ROWS@), r AS (SELECT l_orderkey, l_linenumber, blob, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, blob) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey, blob ORDER BY l_linenumber) AS up, row_number() OVER (PARTITION BY l_orderkey, blob ORDER BY l_linenumber DESC) AS down FROM t)
            SELECT a.l_orderkey, CAST(a.k AS INT) AS blob_idx, CAST(2 * (b.n - 1 - b.k) AS INT) AS region FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.blob = b.blob AND a.up = b.down""",
        "notice_flags": """WITH d AS (@DOCS@), i AS (SELECT doc_id, list_filter(['text', CASE WHEN doc_id % 2 = 0 OR contains(content, '$$') THEN 'equations' END, CASE WHEN doc_id % 3 = 0 THEN 'tables' END, CASE WHEN doc_id % 5 = 0 THEN 'figure descriptions' END], lambda x: x IS NOT NULL) AS l FROM d)
            SELECT doc_id, '*Transcribed with ' || CASE WHEN doc_id % 5 = 0 OR doc_id % 21 = 0 THEN 'OCR and VLMs' ELSE 'OCR' END || '; ' || CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END || ' may contain mistakes.*' AS notice FROM i""",
        "description_spacing": "SELECT doc_id, sha256('para' || chr(10) || chr(10) || '> **Image description.** one' || chr(10) || '> two' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Figure 1: c' || chr(10) || 'next' || chr(10) ELSE chr(10) || 'Figure 1: c' || chr(10) || chr(10) || 'next' || chr(10) END || replace(text, chr(10), ' ')) AS md_sha256 FROM documents",
        "url_route": r"""WITH u AS (@URLS@) SELECT page_id,
            CASE page_id % 10 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'openreview' WHEN 2 THEN 'acl' WHEN 3 THEN 'biorxiv' WHEN 4 THEN 'neurips' WHEN 5 THEN 'mlrp' WHEN 8 THEN 'medrxiv' END AS repository,
            CASE page_id % 10 WHEN 0 THEN 'https://arxiv.org/pdf/2301.' || (10000 + page_id) || 'v2.pdf?context=cs' WHEN 1 THEN 'https://openreview.net/pdf?id=Ab' || page_id || '&noteId=x' WHEN 2 THEN url || '.pdf' WHEN 3 THEN url || '.pdf'
              WHEN 4 THEN 'https://papers.nips.cc/paper_files/paper/2020/file/' || page_id || 'ab-Paper.pdf' WHEN 5 THEN 'https://proceedings.mlr.press/v139/x' || page_id || '/x' || page_id || '.pdf' WHEN 8 THEN url || '.full.pdf' ELSE url END AS pdf_url,
            CASE page_id % 10 WHEN 0 THEN 'arxiv-2301.' || (10000 + page_id) || 'v2.pdf' WHEN 1 THEN 'openreview-Ab' || page_id || '.pdf' WHEN 2 THEN 'acl-2023.acl-long.' || page_id || '.pdf' WHEN 3 THEN 'biorxiv-2020.01.01.' || page_id || '.pdf'
              WHEN 4 THEN 'neurips-2020-' || page_id || 'ab.pdf' WHEN 5 THEN 'mlrp-v139-x' || page_id || '.pdf' WHEN 8 THEN 'medrxiv-2021.02.02.' || page_id || '.pdf' END AS file_name,
            CASE page_id % 10 WHEN 0 THEN '2301.' || (10000 + page_id) || 'v2' WHEN 7 THEN 'cs.AI/' || (1000000 + page_id) END AS arxiv_id FROM u""",
        "probe_parse": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 2 THEN false WHEN 7 THEN true END AS citable, CASE event_id % 8 WHEN 0 THEN 'T' || event_id WHEN 7 THEN 'x' END AS title,
            CASE event_id % 8 WHEN 0 THEN 'A' WHEN 2 THEN '' WHEN 7 THEN '' END AS authors, CASE event_id % 8 WHEN 0 THEN '2023' WHEN 2 THEN '1999' END AS year, CASE event_id % 8 WHEN 2 THEN 'V' WHEN 7 THEN event_type END AS venue FROM events""",
        "citation_entry": f"WITH c AS (@CITED@), k AS (SELECT *, {_KEY} AS cite_key FROM c) SELECT doc_id, cite_key, '% NOTE: Best-effort entry generated from the document''s own front matter' || chr(10) || '% (no citation database was consulted). Verify before use.' || chr(10) || '%' || chr(10) || '@misc{{' || cite_key || ',' || chr(10) || '  title={{' || {_ESCAPED('title')} || '}},' || chr(10) || '  author={{' || {_ESCAPED('author')} || '}},' || chr(10) || '  year={{' || year || '}},' || chr(10) || '  note={{' || {_ESCAPED('venue')} || '}}' || chr(10) || '}}' AS bibtex FROM k".replace("{{", "{").replace("}}", "}"),
        "title_match": f"""WITH h AS (@HITS@), r AS (SELECT doc_id, hit, {_NORM("coalesce(title, '')")} AS ta, {_NORM("coalesce(cited, '')")} AS tb FROM h), p AS (SELECT *, string_split(ta, ' ') AS wa, list_distinct(string_split(tb, ' ')) AS wb FROM r)
            SELECT doc_id, hit, CASE WHEN length(ta) < 10 OR length(tb) < 10 THEN ta = tb ELSE len(list_filter(wa, lambda w: list_contains(wb, w))) / greatest(len(wa), len(wb)) > 0.75 END AS matches FROM p""",
        "memo_table_lookup": "SELECT doc_id, min(doc_id % 3) OVER (PARTITION BY text, lang) = 0 AS found FROM documents",
        "embedded_figures": """
            WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 9 AS DOUBLE) AS a, CAST(max(l_partkey) % 7 AS DOUBLE) AS b FROM lineitem GROUP BY l_orderkey, l_linenumber),
            e AS (SELECT l_orderkey, l_linenumber, 1 AS i, a - 2 AS x1, b - 3 AS y1, a AS x2, b AS y2 FROM p UNION ALL SELECT l_orderkey, l_linenumber, 2, 1, a - 4, 2, a FROM p UNION ALL SELECT l_orderkey, l_linenumber, 3, b, 2, b + 1, 3 FROM p),
            c AS (SELECT l_orderkey, l_linenumber, i, greatest(least(x1 / 4, 1), 0) AS x1, greatest(least(y1 / 4, 1), 0) AS y1, greatest(least(x2 / 4, 1), 0) AS x2, greatest(least(y2 / 4, 1), 0) AS y2 FROM e),
            n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY y1, i) AS INT) AS figure FROM c)
            SELECT l_orderkey, l_linenumber, CAST(figure + 1 AS INT) AS idx, 'image' AS label, figure, x1, y1, x2, y2 FROM n
            UNION ALL SELECT l_orderkey, l_linenumber, 0, 'table', NULL, a / 4, b / 4, (a + 1) / 4, (b + 1) / 4 FROM p UNION ALL SELECT l_orderkey, l_linenumber, 1, 'image', NULL, 0, 0, 0.25, 0.25 FROM p""",
        "bundle_pages": "SELECT CAST(doc_id // 50 AS VARCHAR) AS doc_id, CAST(doc_id % 50 + 1 AS INT) AS page_number, 'Bundle ' || (doc_id // 50) AS name, sha256(text) AS md_sha256 FROM documents",
        "memo_hits_misses": "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents m WHERE m.doc_id % 3 = 0 AND m.text = d.text AND m.lang = d.lang) THEN 'v2' END AS found FROM documents d",
        "prompts": rf"""WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN {_strip("CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 50) || ' ' ELSE substr(text, 1, 50) END")} ELSE {_strip("'ok ' || substr(text, 1, 50) || CASE WHEN doc_id % 2 = 0 THEN ' </img_desc> rest' ELSE '' END")} END AS t FROM documents)
            SELECT doc_id, sha256('This image appears on page ' || doc_id || '. The surrounding page content follows.' || chr(10) || chr(10) || CASE WHEN length(text) > 2000 THEN left(text, 1997) || '...' ELSE text END) AS context_sha256, CAST(least(length({_strip('text')}), 3000) AS INT) AS probe_chars,
            CASE WHEN doc_id % 5 = 0 AND t NOT LIKE '%[...]' THEN t || ' [...]' ELSE t END AS description FROM a""",
        "whole_texts": (rf"""WITH w AS (@WHOLE@), k AS (SELECT *, {_KEY} AS cite_key, CASE WHEN doc_id % 3 <> 0 THEN {_strip('text')} ELSE {_strip("'ok ' || text || CASE WHEN doc_id % 2 = 0 THEN ' </img_desc> rest' ELSE '' END")} END AS t,
            regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}_\-]+', '_', 'g'), '\A_+|_+\z', '', 'g') AS s FROM w),
            e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND t NOT LIKE '%[...]' THEN t || ' [...]' ELSE t END AS description, CASE WHEN s = '' THEN 'paper' WHEN regexp_full_match(s, '(?i)CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN s || '_' ELSE s END AS base,
            '% NOTE: Best-effort entry generated from the document''s own front matter' || chr(10) || '% (no citation database was consulted). Verify before use.' || chr(10) || '%' || chr(10) || '@misc{{' || cite_key || ',' || chr(10) || '  title={{' || {_ESCAPED('title')} || '}},' || chr(10) || '  author={{' || {_ESCAPED('author')} || '}},' || chr(10) || '  year={{' || year || '}},' || chr(10) || '  note={{' || {_ESCAPED('venue')} || '}}' || chr(10) || '}}' AS bibtex FROM k)
            SELECT doc_id, """ + ", ".join(f"sha256({c}) AS {c}_sha256, CAST(length({c}) AS INT) AS {c}_chars" for c in ("description", "base", "bibtex")) + " FROM e"),
        "page_ranges": """WITH r AS (SELECT o_orderkey, o_orderkey % 12 AS n, o_orderkey % 6 AS k FROM orders), b AS (SELECT *, CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 9 ELSE 3 END AS lo, CASE k WHEN 0 THEN n WHEN 1 THEN 3 WHEN 2 THEN n WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 100 END AS hi FROM r)
            SELECT o_orderkey, coalesce(array_to_string(range(lo, least(hi, n) + 1), ','), '') AS pages FROM b""",
        "base_names": r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'CON_' WHEN doc_id % 10 = 1 THEN 'paper' ELSE regexp_replace(regexp_replace(left(text, 40), '[^\p{L}\p{M}\p{N}_\-]+', '_', 'g'), '\A_+|_+\z', '', 'g') END AS b FROM documents) SELECT doc_id, CASE WHEN b = '' THEN 'paper' ELSE b END AS base FROM s""",
        "join_splits": rf"""WITH d AS (@DOCS@), m AS (SELECT doc_id, {_strip('content')} || CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || '# A' || chr(10) || chr(10) || '| t |' || chr(10) || '|---|' ELSE '' END AS body, doc_id % 4 = 0 AS app, contains(content, '$$') AS eq, doc_id % 3 = 0 OR (doc_id % 4 = 0 AND doc_id % 5 = 0) AS noted FROM d),
            j AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '```' || chr(10) || '@misc{{k,' || chr(10) || '}}' || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || body || CASE WHEN noted THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*Transcribed with ' || CASE WHEN app AND eq THEN 'OCR and VLMs; text, equations, and tables' WHEN app THEN 'OCR and VLMs; text and tables' WHEN eq THEN 'OCR; text and equations' ELSE 'OCR; text' END || ' may contain mistakes.*' ELSE '' END || chr(10) AS f FROM m)
            SELECT CAST(doc_id AS STRING) AS base, sha256(f) AS full_sha256, CAST(length(f) AS INT) AS n_chars FROM j""",
    }.items()
}
