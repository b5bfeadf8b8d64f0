"""Command line: ``run``, ``ocr``, ``describe``, ``join`` and ``config`` over tables and folders that Spark reads.

Inputs are Parquet tables: page images or raw pages for ``run`` and ``ocr``, a bundle for ``describe``; ``join`` takes a folder of part files.
Outputs are UTF-8 files in the output folder, the memo is a table that grows by each run's entries.
"""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from typing import Any

from .plans import config as config_of

#: Flags by section and key; a value of its own (None: takes an argument).
FLAGS = (
    ("--ocr-backend", "ocr", "backend", None), ("--ocr-model", "ocr", "model", None), ("--ocr-mmproj", "ocr", "mmproj", None), ("--ocr-resolution", "ocr", "resolution", None), ("--ocr-ngl", "ocr", "n_gpu_layers", None),
    ("--ocr-endpoint", "ocr", "endpoint", None), ("--vlm-backend", "vlm", "backend", None), ("--vlm-model", "vlm", "model", None), ("--vlm-mmproj", "vlm", "mmproj", None), ("--vlm-ngl", "vlm", "n_gpu_layers", None),
    ("--vlm-endpoint", "vlm", "endpoint", None), ("--llama-bin-dir", "llama", "bin_dir", None), ("--host", "llama", "host", None), ("--port", "llama", "port", None), ("--ctx", "llama", "ctx_size", None),
    ("--server-timeout", "llama", "server_start_timeout", None), ("--mode", "inference", "mode", None), ("--in-flight", "inference", "in_flight", None), ("--figure-detect", "figure", "detect", None), ("--no-figures", "figure", "detect", "none"), ("--figure-mode", "figure", "mode", None),
    ("--crop-padding", "figure", "crop_padding", None), ("--context-chars", "figure", "context_chars", None), ("--no-table-refine", "table", "refine", False), ("--output-dir", "output", "dir", None),
    ("--no-bibtex-name", "output", "name_from_bibtex", False), ("--no-full-suffix", "output", "full_suffix", False), ("--no-split", "output", "split", False), ("--page-numbers", "output", "page_numbers", True),
    ("--page-separators", "output", "page_separators", True), ("--no-clean", "output", "clean", False), ("--no-normalize-breaks", "output", "normalize_line_breaks", False), ("--no-clobber", "output", "clobber", False),
    ("--no-notice", "output", "notice", False), ("--bibtex-mode", "bibtex", "mode", None), ("--bibtex", "bibtex", "mode", "on"), ("--bibtex-in-doc", "bibtex", "append_to_document", True), ("--offline", "net", "offline", True),
    ("--no-cache", "cache", "enabled", False), ("--refresh", "cache", "refresh", True), ("--workdir", "workdir", "path", None), ("--keep-intermediates", "workdir", "keep_intermediates", True),
)


#: Catalog tables and their columns.
_PAPER = "struct<title:string,authors:array<string>,year:string,venue:string,doi:string,url:string>"
CATALOGS = {"papers": f"arxiv_id string, paper {_PAPER}", "exports": "arxiv_id string, title string, authors array<string>, year string, primary_class string", "titles": f"query string, rank int, paper {_PAPER}"}


def _number(text: str) -> Any:
    """A whole number or a number where the text is one."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foliosmith", description="Recorded page layouts to structured Markdown.")
    commands = top.add_subparsers(dest="command", required=True)
    helps = {"run": "pages to files", "ocr": "page images to a bundle", "describe": "a bundle to files", "join": "part files to whole documents", "config": "the configuration as it is resolved"}
    for name, text in helps.items():
        sub = commands.add_parser(name, help=text)
        if name != "config":
            sub.add_argument("input")
            sub.add_argument("--master", help="Spark master; without it, that of the environment")
            sub.add_argument("--memo", help="memo table; beside it, answers of a run that did not end are kept until one does")
            sub.add_argument("--manifests", action="store_true", help="bundles are folders with a manifest, one a document, not a table")
            sub.add_argument("--crops", help="folder of the crops that documents keep")
            for catalog in CATALOGS:
                sub.add_argument(f"--{catalog}", help="catalog table in place of a citation service")
            sub.add_argument("--today", default=datetime.date.today().isoformat(), help="date that entries tell")
        sub.add_argument("-c", "--config")
        sub.add_argument("--name")
        sub.add_argument("--pages")
        for flag, section, key, fixed in FLAGS:
            short = ("-o",) if flag == "--output-dir" else ()
            if fixed is None:
                sub.add_argument(*short, flag, dest=f"{section}.{key}", default=None, type=_number if isinstance(config_of.KEYS[section][key], (int, float)) or key == "n_gpu_layers" else str)
            else:
                sub.add_argument(flag, dest=f"{section}.{key}", action="store_const", const=fixed, default=None)
    return top


def resolved(arguments: argparse.Namespace) -> config_of.RunConfig:
    """Defaults, then the file, then the flags."""
    own: dict[str, Any] = {"command": arguments.command, "name": arguments.name, "pages": arguments.pages}
    for name, value in vars(arguments).items():
        if "." in name and value is not None:
            section, key = name.split(".")
            own.setdefault(section, {})[key] = value
    return config_of.resolve(config_of.load_file(arguments.config), own)


def _session(master: str | None):
    from pyspark.sql import SparkSession

    made = SparkSession.builder.appName("foliosmith")
    return (made.master(master) if master else made).getOrCreate()


def _memo(spark, path: str | None):
    from .sources import files, memo_table

    return memo_table.read_memo(spark, path) if path else spark.createDataFrame([], files.MEMO)


def _catalogs(spark, arguments: argparse.Namespace):
    """The catalogs that are named; one that is not is empty, so that entries come from what is left."""
    from .plans import transcribe

    tables = [spark.read.schema(schema).parquet(path) if (path := getattr(arguments, name)) else spark.createDataFrame([], schema) for name, schema in CATALOGS.items()]
    return transcribe.Catalogs(*tables, arguments.today, arguments.today[:4])


def _raw(spark, pages, memo, config, journal):
    """Raw pages of page images, where they are not raw pages already, and the new memo entries."""
    from .plans import transcribe

    if "raw" in pages.columns:
        return pages, memo.limit(0)
    return transcribe.read_pages(pages, memo, config, journal)


def main(argv: list[str] | None = None) -> int:
    arguments = parser().parse_args(argv)
    try:
        config = resolved(arguments)
    except config_of.ConfigError as e:
        print(f"configuration:\n{e}", file=sys.stderr)
        return 2
    if arguments.command == "config":
        print(json.dumps(config_of.as_dict(config), indent=2))
        return 0
    from pyspark.sql import functions as F

    from .operators import parts as parts_op
    from .plans import transcribe
    from .sources import bundles, files, memo_table
    from .plans.metrics import Metrics
    from .sources.journal import Journal

    spark, root = _session(arguments.master), config.output.dir
    if arguments.command == "join":
        whole = parts_op.join_splits(files.one_main_each(files.read_parts(spark, arguments.input)))
        suffix = "_full.md" if config.output.full_suffix else ".md"
        done = files.write_texts(whole.select(F.concat("base", F.lit(suffix)).alias("file"), F.col("full").alias("content")), root, config.output.clobber)
    else:
        counts = Metrics()
        memo, journal = _memo(spark, arguments.memo), Journal(f"{arguments.memo.rstrip('/')}-journal") if arguments.memo else None
        if arguments.command == "describe":
            reason = F.when(F.coalesce("truncated", F.lit(False)), F.lit("length")).otherwise(F.lit("stop"))
            read = bundles.read_bundles(spark, arguments.input) if arguments.manifests else files.read_bundle(spark, arguments.input)
            kept = ["doc_id", "page_number", "width_px", "height_px", "raster_sha256", "raw"] + ["url", "name"] * arguments.manifests
            pages, entries = read.select(*kept, reason.alias("finish_reason")), memo.limit(0)
        else:
            pages, entries = _raw(spark, spark.read.parquet(arguments.input), memo, config, journal)
        if arguments.command == "ocr":
            parsed = transcribe.ocr_pass(pages, config)
            if arguments.manifests:
                told = {"backend": config.ocr.backend, "model": config.ocr.model, "resolution": config.ocr.resolution}
                files.write_texts(bundles.manifests(parsed, arguments.today, told, config.figure.detect, config.figure.crop_padding), root, config.output.clobber)
            else:
                files.write_bundle(parsed, root)
            done = None
        else:
            names = pages.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("url"), F.col("doc_id").cast("string").alias("name"))
            sources = pages.groupBy("doc_id").agg(F.first("url").alias("url"), F.first("name").alias("name")) if {"url", "name"} <= set(pages.columns) else names
            made, crops, more = transcribe.run_whole(pages, sources, memo, _catalogs(spark, arguments), config, journal, counts)
            for name in transcribe.doubtful_names(made, config):
                print(f"{name}.md ends like a part of another document", file=sys.stderr)
            entries = entries.unionByName(more, allowMissingColumns=True)
            there = files.present(crops, arguments.crops, "crop_path") if arguments.crops else None
            done = files.write_output(made, there, arguments.crops or "", root, config.output.clobber)
        if arguments.memo and config.cache.enabled:
            memo_table.append_memo(entries, arguments.memo)
            journal.clear()
        if done is not None:
            print(", ".join(f"{name.replace('_', ' ')}: {n}" for name, n in counts.told().items()))
    if done is not None:
        print(f"{done.count()} files in {root}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
