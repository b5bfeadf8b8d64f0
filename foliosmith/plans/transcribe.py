"""Whole documents: page, table, figure and probe passes, assembly, citation, and the output files, each DataFrame to DataFrame.

Each pass with a model takes the memo and gives back the entries to append; its answers are durable before anything reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import citations as C, layout as L, sections as S, tables as T, text as X
from ..operators import cite as cite_op, figures as figures_op, memo as memo_op, pages as pages_op, tables as tables_op
from ..sources.durable import durable
from ..sources.journal import Journal
from . import inference
from .config import LONG_EDGE, RunConfig
from .metrics import Metrics

IMAGE_PROMPT = "Describe what this image shows: its kind, its parts, and every text in it.{context_block}\nPut the description inside <img_desc> and </img_desc>."
CONTEXT_BLOCK = "\n\nThe text around it, for names and terms only:\n"
TABLE_PROMPT = "Write this one table as a pipe table of Markdown, with every value of the text below.\n{locator}\n\nPage:\n{page_text}\n\nTable:\n{table_blob}"
#: Codec of the written tables that hold whole texts.
PACKED = "zstd"
CROPPED = "The image shows just this table, cut out of its page; its edges may show some of what is around it."
PROBE_PROMPT = 'Can this document be cited as a published work? Answer with one JSON object: {"citable": true or false, "title": text or null, "authors": [text], "year": text or null, "venue": text or null}.\n\nIts first page:\n{front}'


def _maker(config: RunConfig, step: str):
    own = config.ocr if step == "ocr" else config.vlm
    return inference.maker(own.backend, model=own.model, projector=own.mmproj, endpoint=own.endpoint)


def ocr_backend(config: RunConfig) -> inference.Backend:
    return _maker(config, "ocr")()


def vlm_backend(config: RunConfig) -> inference.Backend:
    return _maker(config, "vlm")()


def _asked(items: DataFrame, memo: DataFrame, config: RunConfig, step: str, settle=None, journal: Journal | None = None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``memo_op.memoised`` gives; answers go to the journal as they come, and those of runs that did not end are used."""
    make, kept = _maker(config, step), journal if config.cache.enabled else None
    watch = {"watch": lambda rows: metrics.watch(rows, hits=F.col("__hit"), misses=~F.col("__hit"))} if metrics else {}
    ask = lambda misses: inference.infer(misses, make, in_flight=config.inference.in_flight, journal=kept)
    return memo_op.memoised(
        items, memo, ask, memo_op.SCHEMA[step], refresh=config.cache.refresh, enabled=config.cache.enabled, settle=settle, logged=kept.answers(items.sparkSession) if kept else None, **watch,
        requests=("prompt", "image"), compression=PACKED)


def in_range(pages: DataFrame, config: RunConfig) -> DataFrame:
    """The pages that the configured range selects of each document."""
    if not config.pages:
        return pages
    total = pages.groupBy("doc_id").agg(F.max("page_number").cast("bigint").alias("__total"))
    return pages.join(total, "doc_id").filter(F.array_contains(X.page_numbers(F.lit(config.pages), F.col("__total")), F.col("page_number").cast("bigint"))).drop("__total")


def read_pages(pages: DataFrame, memo: DataFrame, config: RunConfig = RunConfig(), journal: Journal | None = None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with ``raw``, ``finish_reason`` and ``error``, new memo entries) of page images (doc_id, page_number, raster_sha256, ...).

    A failed page is empty and not memoised; a page that was cut off is kept and memoised, with its mark.
    """
    backend = ocr_backend(config)
    prompt, edge = F.lit(backend.page_prompt()), LONG_EDGE[config.ocr.resolution]
    keyed = in_range(pages, config).withColumns({"prompt": prompt, "image": F.col("raster_sha256"), "key": memo_op.page_key(F.col("raster_sha256"), prompt, edge, backend.identity())})
    done, entries = _asked(keyed, memo, config, "ocr", journal=journal, metrics=metrics)
    raw = F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.lit(""))
    return done.withColumns({"raw": raw, "finish_reason": F.when(F.col("truncated"), F.lit("length")).otherwise(F.lit("stop"))}).select(*pages.columns, "raw", "finish_reason", "error"), entries


def ocr_pass(pages: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Raw page output (doc_id, page_number, width_px, height_px, raw, finish_reason) parsed, with a ``truncated`` flag; pages outside the range go.

    With ``figure.detect`` at ``pdf-embedded`` the figures are those of the column ``embedded``; without that column it is an error.
    """
    parsed = pages_op.parse_pages(in_range(pages, config)).withColumn("truncated", X.was_truncated(F.col("finish_reason")))
    chosen = pages_op.select_figures(parsed, config.figure.detect, ocr_backend(config).supports_grounding)
    if config.figure.detect == "pdf-embedded" or config.figure.detect == "auto" and not ocr_backend(config).supports_grounding:
        ids = F.transform(F.filter("regions", lambda r: r["figure"].isNotNull()), lambda r: L.figure_id(F.col("page_number"), r["figure"]))
        plain = X.strip(F.regexp_replace("markdown", K.ANY_TOKEN, ""))
        chosen = chosen.withColumn("markdown", X.ensure_tokens(plain, ids))
    return chosen


def refine_tables(parsed: DataFrame, memo: DataFrame, config: RunConfig = RunConfig(), journal: Journal | None = None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with restructured tables, new memo entries); a blob without an accepted answer stays, and only accepted tables are memoised.

    A blob whose region is known is sent as a crop of its page, any other with the whole page and its number among the page's tables.
    """
    if not config.table.refine:
        return parsed.withColumn("tables_refined", F.lit(0)), memo.limit(0)
    # What a prompt needs of its page goes along with the blob, so no page is shuffled.
    blobs = tables_op.page_blobs(parsed.withColumn("page_text", T.page_context(F.col("markdown"))), "doc_id", "page_number", "raster_sha256", "width_px", "height_px", "page_text").filter("refinable")
    placed = tables_op.crop_boxes(blobs)
    cropped = F.col("px_box").isNotNull()
    locator = F.when(cropped, F.lit(CROPPED)).otherwise(T.locator(F.col("blob_idx"), F.col("blobs_on_page")))
    prompted = placed.withColumn("prompt", X.fill(TABLE_PROMPT, locator=locator, page_text=F.col("page_text"), table_blob=F.col("blob")))
    box = F.when(cropped, F.col("region.bbox"))
    keyed = prompted.withColumns({"key": memo_op.table_key(F.col("prompt"), F.col("raster_sha256"), box, K.TABLE_CROP_PADDING, vlm_backend(config).identity()), "image": image_reference(F.col("raster_sha256"), F.col("px_box"))})
    done, entries = _asked(keyed.drop("page_text"), memo, config, "vlm", lambda text, cut: F.when(~cut, T.accepted(F.col("blob"), text)), journal, metrics)
    answers = done.select("doc_id", "page_number", "start", "end", "blob", F.col("text").alias("answer"))
    return tables_op.splice_answers(parsed, answers, "doc_id", "page_number"), entries


def image_reference(raster: Column, box: Column) -> Column:
    """A page image, or a pixel box of it."""
    return F.when(box.isNull(), raster).otherwise(F.concat(raster, F.lit("#"), F.concat_ws(",", *[box[c].cast("string") for c in ("x1", "y1", "x2", "y2")])))


def describe_figures(parsed: DataFrame, memo: DataFrame, config: RunConfig = RunConfig(), journal: Journal | None = None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame]:
    """(figures with descriptions, new memo entries).  Figures too small to crop get none; a description that was cut off ends in a mark."""
    context = X.page_context(F.col("page_number"), X.strip_tokens(F.col("markdown")), config.figure.context_chars)
    found = pages_op.figures(parsed.withColumn("context", context), "doc_id", "raster_sha256", "context", padding=config.figure.crop_padding)
    able = found.filter("px_box is not null")
    block = F.when(X.present(F.col("context")).isNull(), F.lit("")).otherwise(F.concat(F.lit(CONTEXT_BLOCK), F.col("context")))
    keyed = able.withColumns({"prompt": X.fill(IMAGE_PROMPT, context_block=block), "image": image_reference(F.col("raster_sha256"), F.col("px_box"))})
    keyed = keyed.withColumn("key", memo_op.figure_key(F.col("prompt"), raster_sha256=F.col("raster_sha256"), bbox=F.col("bbox"), padding=F.lit(config.figure.crop_padding), identity=vlm_backend(config).identity()))
    done, entries = _asked(keyed.drop("context"), memo, config, "vlm", lambda text, cut: X.present(X.mark_truncated(X.rstrip(X.description_from_tags(text)), cut)), journal, metrics)
    columns = ["doc_id", "page_number", "fig_id", "caption"]
    described = done.select(*columns, F.concat(F.lit("figures/"), F.col("fig_id"), F.lit(".png")).alias("crop_path"), F.col("text").alias("description"))
    small = found.filter("px_box is null").select(*columns, F.lit(None).cast("string").alias("crop_path"), F.lit(None).cast("string").alias("description"))
    return described.unionByName(small), entries


def probe_documents(parsed: DataFrame, memo: DataFrame, config: RunConfig = RunConfig(), journal: Journal | None = None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, probe) of each document, from its first page, and new memo entries; an answer that was cut off or can't be read is no probe and not memoised."""
    if config.bibtex.mode != "auto":
        return parsed.select("doc_id").distinct().withColumn("probe", C.probe_answer(F.lit(None).cast("string"))), memo.limit(0)
    front = parsed.groupBy("doc_id").agg(F.min_by("markdown", "page_number").alias("markdown"))
    text = X.truncated(X.strip_tokens(F.col("markdown")), K.PROBE_CHARS)
    keyed = front.select("doc_id", X.fill(PROBE_PROMPT, front=text).alias("prompt"), F.lit(None).cast("string").alias("image"))
    keyed = keyed.withColumn("key", memo_op.key_of("probe", vlm_backend(config).identity(), prompt=F.col("prompt")))
    done, entries = _asked(keyed, memo, config, "vlm", lambda text, cut: F.when(~cut & C.probe_answer(text).isNotNull(), text), journal, metrics)
    return done.select("doc_id", C.probe_answer(F.col("text")).alias("probe")), entries


def assemble(parsed: DataFrame, described: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """(doc_id, markdown): chrome off, pages stitched, words joined, descriptions in, spacing and line ends normal."""
    out = config.output
    pages = parsed.select("doc_id", "page_number", "markdown")
    if out.clean:
        pages = pages_op.strip_chrome(pages, "doc_id", "markdown", keep=lambda lists: durable(lists, "chrome"))
    docs = pages_op.stitch_pages(pages, "doc_id", "page_number", "markdown", out.page_numbers, out.page_separators, out.normalize_line_breaks)
    if out.clean:
        docs = docs.withColumn("markdown", X.dehyphenate(F.col("markdown")))
    if config.figure.detect == "none":
        docs = docs.withColumn("markdown", F.regexp_replace("markdown", K.ANY_TOKEN, ""))
    else:
        docs = figures_op.inject_descriptions(docs, described, "doc_id", mode=config.figure.mode)
    spaced = X.description_spacing(F.col("markdown"))
    return docs.withColumn("markdown", F.concat(X.strip(X.normalize_line_breaks(spaced) if out.normalize_line_breaks else spaced), F.lit("\n")))


@dataclass(frozen=True)
class Catalogs:
    """Local tables in place of citation services, as ``cite.cite`` takes them; ``today`` and ``year`` stand in entries."""

    by_id: DataFrame
    exports: DataFrame
    by_title: DataFrame
    today: str
    year: str


def entries_of(documents: DataFrame, probes: DataFrame, catalogs: Catalogs | None, config: RunConfig = RunConfig()) -> DataFrame:
    """(doc_id, bibtex, source, mock) of documents (doc_id, markdown, url): none where the mode is ``off``, the title's paper or a mock where it is ``on``
    (nothing offline), the chain of sources where it is ``auto``."""
    none = F.lit(None).cast("string")
    titled = documents.withColumn("fallback_title", S.title_of(F.col("markdown")))
    if config.bibtex.mode == "off" or catalogs is None or config.bibtex.mode == "on" and config.net.offline:
        return titled.select("doc_id", none.alias("bibtex"), F.lit("").alias("source"), F.lit(False).alias("mock"))
    if config.bibtex.mode == "on":
        found = titled.join(cite_op.first_ranked(catalogs.by_title).select(F.col("query").alias("fallback_title"), F.col("paper").alias("__t")), "fallback_title", "left")
        entry = cite_op.titled_entry(F.col("fallback_title"), F.col("__t"), catalogs.year)
        mock = F.col("__t").isNull()
        return found.select("doc_id", F.when(mock, C.mock_entry(F.col("fallback_title"), catalogs.today, catalogs.year)).otherwise(entry).alias("bibtex"), F.when(mock, "mock").otherwise("s2-title").alias("source"), mock.alias("mock"))
    asked = titled.join(probes, "doc_id", "left").select("doc_id", "url", "probe", "fallback_title")
    done = cite_op.cite(asked, catalogs.by_id, catalogs.exports, catalogs.by_title, catalogs.year, online=not config.net.offline)
    return done.withColumn("mock", F.lit(False))


def outputs(documents: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """(doc_id, part, content) of (doc_id, markdown, bibtex): full, main, appendix, backmatter.  The split is of the clean document; the citation
    block goes on full and main, the notice on each part by itself; a column ``tables_refined`` tells whether tables were restructured."""
    vlm = F.col("tables_refined") > 0 if "tables_refined" in documents.columns else F.lit(False)
    cited = F.when(F.lit(config.bibtex.append_to_document) & F.col("bibtex").isNotNull(), F.concat(F.lit("```\n"), F.col("bibtex"), F.lit("\n```\n\n---\n\n"))).otherwise(F.lit(""))
    noted = lambda text: X.append_notice(text, vlm) if config.output.notice else text
    rows = documents.withColumn("__s", S.split_document(F.col("markdown"))) if config.output.split else documents
    parts = [F.struct(F.lit("full").alias("part"), noted(F.concat(cited, F.col("markdown"))).alias("content"))]
    if config.output.split:
        s = F.col("__s")
        parts.append(F.struct(F.lit("main").alias("part"), noted(F.concat(cited, S.main_with_title(s["main"], s["title"]))).alias("content")))
        parts += [F.struct(F.lit(p).alias("part"), noted(S.with_header(s[p], s["title"], p.capitalize())).alias("content")) for p in ("appendix", "backmatter")]
    return rows.select("doc_id", F.explode(F.array(*parts)).alias("p")).select("doc_id", "p.part", "p.content").filter("content is not null")


def finalize(documents: DataFrame, entries: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """(doc_id, base, part, file, content): the files of documents (doc_id, markdown, name, tables_refined) with their entries (doc_id, bibtex, mock).

    The stem is the configured name, else the key of an entry that is no mock (where ``name_from_bibtex``), else the source's name.
    """
    cited = documents.join(entries.select("doc_id", "bibtex", "mock"), "doc_id", "left")
    key = F.when(~F.coalesce("mock", F.lit(False)), C.entry_key(F.col("bibtex"))) if config.output.name_from_bibtex else F.lit(None).cast("string")
    base = X.base_name(F.coalesce(F.lit(config.name).cast("string"), key, F.col("name")))
    bases = cited.select("doc_id", base.alias("base"))
    suffix = F.when(F.col("part") == "bib", F.lit(".bib")).when((F.col("part") == "full") & F.lit(not config.output.full_suffix), F.lit(".md")).otherwise(F.concat(F.lit("_"), F.col("part"), F.lit(".md")))
    made = outputs(cited, config).unionByName(cited.filter("bibtex is not null").select("doc_id", F.lit("bib").alias("part"), F.concat("bibtex", F.lit("\n")).alias("content")))
    return made.join(bases, "doc_id").select("doc_id", "base", "part", F.concat("base", suffix).alias("file"), "content")


def clashes(files: DataFrame) -> DataFrame:
    """(file, documents): names that several documents would write, as letters' case counts in no name."""
    return files.groupBy(F.lower("file").alias("file")).agg(F.array_sort(F.collect_set("doc_id")).alias("documents")).filter(F.size("documents") > 1)


def run(pages: DataFrame, memo: DataFrame, config: RunConfig = RunConfig()) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, markdown, tables_refined), new memo entries) of raw pages (doc_id, page_number, width_px, height_px, raster_sha256, raw, finish_reason)."""
    refined, described, entries = _passes(pages, memo, config)
    refined_counts = refined.groupBy("doc_id").agg(F.sum("tables_refined").alias("tables_refined"))
    return assemble(refined, described, config).join(refined_counts, "doc_id"), entries


def _passes(pages: DataFrame, memo: DataFrame, config: RunConfig, journal: Journal | None = None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a page only its text and regions are written, after the tables only the regions that are figures."""
    parsed = ocr_pass(pages, config).select("doc_id", "page_number", "width_px", "height_px", "raster_sha256", "regions", "markdown")
    refined, table_entries = refine_tables(durable(parsed.withColumn("regions", T.region_texts(F.col("regions"))), "parsed", PACKED), memo, config, journal, metrics)
    refined = refined.withColumn("regions", F.filter("regions", lambda r: r["figure"].isNotNull()))
    if metrics:
        refined = metrics.watch(refined, pages=F.lit(1), figures=F.size("regions"), tables_refined=F.col("tables_refined"))
    refined = durable(refined, "refined", PACKED)
    described, figure_entries = describe_figures(refined, memo, config, journal, metrics)
    return refined, described, table_entries.unionByName(figure_entries, allowMissingColumns=True)


def crops_to_keep(described: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """(doc_id, crop_path) of the crops that the documents refer to; documents that would keep different crops under one name are an error."""
    kept = described.filter("crop_path is not null").select("doc_id", "crop_path").distinct()
    if config.figure.mode != "describe-and-keep":
        return kept.limit(0)
    taken = kept.groupBy("crop_path").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if taken:
        raise ValueError(f"{taken[0]['n']} documents would keep {taken[0]['crop_path']}; keep figures of one document a run")
    return kept


def run_whole(pages: DataFrame, sources: DataFrame, memo: DataFrame, catalogs: Catalogs | None = None, config: RunConfig = RunConfig(), journal: Journal | None = None, metrics: Metrics | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files as ``finalize`` gives them, crops to keep, new memo entries) of raw pages and sources (doc_id, url, name): passes, probe, assembly, citation, names.

    A document is probed only where its entry needs that.  Names that clash are an error, as one file would silently replace the other.
    ``metrics`` counts pages, figures, tables_refined, hits, misses and files as they are written.
    """
    refined, described, entries = _passes(pages, memo, config, journal, metrics)
    probed = config if catalogs else replace(config, bibtex=replace(config.bibtex, mode="off"))
    probes, probe_entries = probe_documents(refined, memo, probed, journal, metrics)
    counts = refined.groupBy("doc_id").agg(F.sum("tables_refined").alias("tables_refined"))
    documents = durable(assemble(refined, described, config).join(counts, "doc_id").join(sources.select("doc_id", "url", "name"), "doc_id", "left"), "documents")
    files = finalize(documents, entries_of(documents, probes, catalogs, config), config)
    files = durable(metrics.watch(files, files=F.lit(1)) if metrics else files, "files")
    taken = clashes(files).limit(1).collect()
    if taken:
        raise ValueError(f"several documents would write {taken[0]['file']}: {', '.join(map(str, taken[0]['documents'][:5]))}")
    return files, crops_to_keep(described, config), entries.unionByName(probe_entries, allowMissingColumns=True)


def run_to_files(pages: DataFrame, sources: DataFrame, memo: DataFrame, catalogs: Catalogs | None = None, config: RunConfig = RunConfig(), journal: Journal | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, new memo entries) of ``run_whole``."""
    files, _, entries = run_whole(pages, sources, memo, catalogs, config, journal)
    return files, entries


def doubtful_names(files: DataFrame, config: RunConfig = RunConfig()) -> list[str]:
    """Some stems that end like a part's file: without the full suffix such a document's file could be taken for, or replaced by, another's part."""
    if config.output.full_suffix:
        return []
    return [r["base"] for r in files.filter(F.col("base").rlike(r"_(full|main|appendix|backmatter)\z")).select("base").distinct().limit(5).collect()]
