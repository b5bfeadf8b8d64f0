"""Content-addressed memo: expensive steps run once for each key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.durable import durable

SCHEMA = {"ocr": 1, "vlm": 2}


def key_of(kind: str, identity: Mapping[str, str] | None = None, **parts: Column) -> Column:
    """SHA-256 of a sorted-key JSON object; the kind keeps the keys of different steps apart, the identity those of different models."""
    named = {**{name: F.lit(value) for name, value in (identity or {}).items()}, **parts}
    fields = [F.lit(kind).alias("kind"), *[value.alias(name) for name, value in sorted(named.items())]]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)


def page_key(raster_sha256: Column, prompt: Column, long_edge: int, identity: Mapping[str, str] | None = None) -> Column:
    """A page's key: its image at its resolution."""
    return key_of("page", identity, raster=raster_sha256, prompt=prompt, long_edge=F.lit(long_edge))


def figure_key(prompt: Column, crop_sha256: Column | None = None, raster_sha256: Column | None = None, bbox: Column | None = None, padding: Column | None = None, identity: Mapping[str, str] | None = None) -> Column:
    """A figure's key: by its crop, or by its page raster, box and padding; exactly one of the two."""
    if (crop_sha256 is None) == (raster_sha256 is None):
        raise ValueError("a figure key takes one image identity: the crop or the raster")
    if crop_sha256 is not None:
        return key_of("figure", identity, prompt=prompt, crop=crop_sha256)
    return key_of("figure", identity, prompt=prompt, raster=raster_sha256, bbox=bbox, padding=F.coalesce(padding, F.lit(0.0)).cast("double"))


def table_key(prompt: Column, raster_sha256: Column, bbox: Column, padding: float, identity: Mapping[str, str] | None = None) -> Column:
    """A table's key: its page raster, and the box and padding of its crop where it has one."""
    return key_of("table", identity, prompt=prompt, raster=raster_sha256, bbox=bbox, padding=F.when(bbox.isNotNull(), F.lit(float(padding))))


def newest(entries: DataFrame, value_schema: int, key: str = "key") -> DataFrame:
    """(key, ``text``, ``truncated``) of the newest entry of each key; entries of another schema and those without a text are none."""
    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in entries.columns else F.lit(False)
    last = F.max_by(F.struct("text", cut.alias("truncated")), F.struct("written_at", "text")).alias("__newest")
    sound = entries.filter((F.col("value_schema") == value_schema) & F.col("text").isNotNull())
    return sound.groupBy(F.col(key)).agg(last).select(key, "__newest.text", "__newest.truncated")


def look_up(items: DataFrame, memo: DataFrame, value_schema: int, key: str = "key", watch: Callable[[DataFrame], DataFrame] = lambda rows: rows, compression: str | None = None) -> DataFrame:
    """The items with ``text`` and ``truncated`` of their entries, and whether there is one (``__hit``); written, so the memo is read once.

    Only entries of keys that are asked for are grouped: the keys are written first, so that a few of them are broadcast to the memo's rows.  Of a
    memo that is bucketed by its key no row is shuffled either way.
    """
    keys = durable(items.select(key).distinct(), "asked")
    found = newest(memo.join(keys, key, "left_semi"), value_schema, key).withColumn("__hit", F.lit(True))
    return durable(watch(items.join(found, key, "left").withColumn("__hit", F.col("__hit").isNotNull())), "looked-up", compression)


def split_hits(items: DataFrame, memo: DataFrame, value_schema: int, key: str = "key", watch: Callable[[DataFrame], DataFrame] = lambda rows: rows, compression: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with ``text`` and ``truncated``, misses): entries of another schema don't count; of several entries of a key the newest does."""
    seen = look_up(items, memo, value_schema, key, watch, compression)
    return seen.filter("__hit").drop("__hit"), seen.filter("not __hit").select(*items.columns)


def memoised(
    items: DataFrame, memo: DataFrame, infer: Callable[[DataFrame], DataFrame], value_schema: int, key: str = "key", refresh: bool = False, enabled: bool = True,
    settle: Callable[[Column, Column], Column] | None = None, logged: DataFrame | None = None, watch: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    requests: Sequence[str] = (), compression: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(items with ``text``, ``truncated`` and ``error``, new memo entries): equal keys are inferred once.

    ``infer`` takes distinct misses and returns (key, text, finish_reason, error).  Its answers are written to the shared folder at once, and both results
    are read from there, so a model is asked once however often they are read, and what is memoised is what was used.  ``logged`` has answers
    (key, text, finish_reason) of runs that did not end, which are not asked again unless ``refresh``.  ``settle(text, truncated)`` makes an answer
    what is used, or null to refuse it; it may use the columns of the items, as far as equal keys agree in them.  ``watch`` sees the items with ``__hit`` as they are written.  Failed and refused answers never become entries.
    ``requests`` are columns of the items that only ``infer`` reads; they are neither shuffled nor written again with the answers.
    """
    if refresh or not enabled:
        hits, misses = items.limit(0).withColumns({"text": F.lit(None).cast("string"), "truncated": F.lit(False)}), items
    else:
        hits, misses = split_hits(items, memo, value_schema, key, watch, compression)
    asked = misses.dropDuplicates([key])
    none = F.lit(None).cast("string")
    if logged is None or refresh:
        answers = infer(asked).select(key, "text", "finish_reason", "error")
    else:
        told = logged.select(key, F.col("text").alias("__text"), F.col("finish_reason").alias("__reason"), F.lit(True).alias("__told"))
        both = durable(asked.join(told, key, "left"), "replayed")
        rest = infer(both.filter("__told is null").select(*asked.columns)).select(key, "text", "finish_reason", "error")
        answers = both.filter("__told").select(key, F.col("__text").alias("text"), F.col("__reason").alias("finish_reason"), none.alias("error")).unionByName(rest)
    fresh = durable(answers, "answers")
    cut = F.coalesce(F.col("finish_reason") != "stop", F.lit(False))
    done = misses.drop(*requests).join(fresh, key, "left").withColumn("truncated", cut).drop("finish_reason")
    if settle:
        done = durable(done.withColumn("text", settle(F.col("text"), F.col("truncated"))), "settled", compression)
    used = done.filter("error is null and text is not null").groupBy(key).agg(F.first("text").alias("text"), F.first("truncated").alias("truncated"))
    entries = used.select(key, F.lit(value_schema).alias("value_schema"), "text", F.current_timestamp().alias("written_at"), "truncated")
    return hits.drop(*requests).withColumn("error", none).unionByName(done), entries if enabled else entries.limit(0)


def missing_references(rows: DataFrame, files: DataFrame, path: str, on: Sequence[str] = ("path",)) -> DataFrame:
    """References to files that are not there."""
    return rows.filter(F.col(path).isNotNull()).select(F.col(path).alias(on[0])).join(files.select(*on), list(on), "left_anti").distinct()
