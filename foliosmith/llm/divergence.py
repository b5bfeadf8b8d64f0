"""Audit of how far the sources of a language are apart in their terms: inclusion and exclusion over the supports of sparse counts.

A term's price in a group (lang, source) is p = 1 + floor(scale * (count + smooth) / (N + smooth * V)), over the V terms that at least
``least_docs`` documents of the language hold.  Two groups g and h differ by the sum of |p_g - p_h| over all V terms.  That sum is not
taken term by term, as most groups lack most terms.  With z the price of a count of 0 and A(g, h) the sum of |p_g - z_h| over the terms of g alone,

    distance = A(g, h) + A(h, g) + (V - |g| - |h|) * |z_g - z_h| + sum over common terms of (|p_g - p_h| - |p_g - z_h| - |p_h - z_g| + |z_g - z_h|)

* A comes from the histogram of the group's counts: one running sum over its few different prices and the zero prices of the other groups;
* the constants cover terms that neither has;
* only terms that both have are joined, posting by posting, and summed before they are shuffled.

Texts are counted in one pass, by pieces of bounded size; what that gives is written, and rare terms go before anything is shuffled by group.
A task holds counts of one chunk of text, never those of a group.  All arithmetic is in integers, products in decimals, so large counts do not overflow.

Defined results: null text, lang and source count as empty strings; each row is a document, so repeated rows count each; a language without
kept terms has distances of 0 and no terms; a group of its own in a language has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import frugal, light_or_not, written
from .words import cut_points, text_chunks

#: Bytes that belong to a term: ASCII letters and all of other characters.
TERM = np.zeros(256, dtype=bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CHUNK = 1 << 21
COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text, term) of each term of the texts, in order."""
    solid = TERM[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[at] = solid[at]
    starts = np.flatnonzero(begin)
    before = np.cumsum(solid, dtype=np.int64)
    edges = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(_LOWER[data[solid]]))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return text, words.dictionary_encode()


def counted(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each different key once, in order, with the sums of its weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(w[order], first) if len(keys) else w for w in weights]


def group_counts(offsets: np.ndarray, data: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts) of whole texts, each pair once."""
    text, terms = terms_of(offsets, data)
    size = max(1, len(terms.dictionary))
    pairs, n = np.unique(text * size + terms.indices.to_numpy(), return_counts=True)
    keys, n, docs = counted(group[pairs // size] * size + pairs % size, n, np.ones(len(pairs), np.int64))
    return keys // size, terms.dictionary.take(pa.array(keys % size)), n, docs


def long_text(data: np.ndarray, group: int, limit: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The same of one text of any length, slice by slice."""
    found, at = [], 0
    for end in cut_points(TERM[data], limit):
        _, terms, n, _ = group_counts(np.array([0, end - at]), data[at:end], np.zeros(1, np.int64))
        found.append(pa.table({"term": terms, "n": n}))
        at = end
    total = pa.concat_tables(found).group_by("term").aggregate([("n", "sum")])
    return np.full(len(total), group), total["term"].combine_chunks(), total["n_sum"].to_numpy(), np.ones(len(total), np.int64)


def count_terms(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, term, n, docs) of chunks of (lang, source, text), to be added up; a null term with the rows of each group, so that groups without terms are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (pc.fill_null(batch.column(k).cast(pa.string()), "").dictionary_encode() for k in (0, 1))
            wide = max(1, len(source.dictionary))
            group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()

            def table(groups: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
                named = [lang.dictionary.take(pa.array(groups // wide)), source.dictionary.take(pa.array(groups % wide)), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
                return pa.RecordBatch.from_arrays(named, names=["lang", "source", "term", "n", "docs"])

            seen, rows = np.unique(group, return_counts=True)
            yield table(seen, pa.nulls(len(seen), pa.string()), np.zeros(len(seen), np.int64), rows)
            for lo, hi, offsets, data in text_chunks(batch.column(2), chunk):
                if hi - lo == 1 and len(data) > chunk:
                    yield table(*long_text(data, int(group[lo]), chunk))
                else:
                    yield table(*group_counts(offsets, data, group[lo:hi]))

    return docs.mapInArrow(frugal(run), COUNTS)


def price(count: str, total: str, kept: str, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * kept)), exact for any 64-bit count; null without kept terms."""
    exact = f"1 + (CAST({scale} AS DECIMAL(15,0)) * CAST({count} + {smooth} AS DECIMAL(20,0))) DIV CAST({total} + {smooth} * {kept} AS DECIMAL(20,0))"
    return F.when(F.col(kept) > 0, F.expr(exact))


def audit(docs: DataFrame, least_docs: int = 30, smooth: int = 5, scale: int = 1_000_000_000, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the distance to each other source of the language, part ``term`` the ``top`` terms that the source has more of than its language."""
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    chunks = written(count_terms(named), "term-chunks")
    own = chunks.filter(F.col("term").isNotNull())
    kept = written(own.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept-terms")
    postings = written(own.join(light_or_not(kept), ["lang", "term"]).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.first("lang_n").alias("lang_n")), "postings")

    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = chunks.filter(F.col("term").isNull()).select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total", "support"])
    groups = written(groups.withColumn("zero", F.coalesce(price("0", "total", "kept", smooth, scale), F.lit(0))), "term-groups")

    histograms = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"]).select("lang", "source", price("n", "total", "kept", smooth, scale).alias("p"), "terms")
    priced = written(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", price("n", "total", "kept", smooth, scale).alias("p"), price("lang_n", "lang_total", "kept", smooth, scale).alias("q"), "zero"), "priced-postings")
    return _pairs(groups, histograms, priced).unionByName(_terms(priced, top))


def _pairs(groups: DataFrame, histograms: DataFrame, priced: DataFrame) -> DataFrame:
    """The distances of all sources of a language, ranked for each."""
    one = groups.select("lang", "source", "kept", "support", "zero")
    two = one.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("support").alias("other_support"))
    both = one.join(two, "lang").filter(F.col("source") != F.col("item"))

    # One-sided terms: running sums over the prices of a group, in which the zero prices of the others are rows without weight.
    points = histograms.select("lang", "source", F.lit(None).cast("string").alias("item"), "p", "terms").unionByName(both.select("lang", "source", "item", F.col("other_zero").alias("p"), F.lit(0).cast("bigint").alias("terms")))
    group = Window.partitionBy("lang", "source")
    below = group.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = points.withColumn("cost", F.col("p") * F.col("terms")).select(
        "lang", "source", "item", "p", F.sum("terms").over(below).alias("n_below"), F.sum("cost").over(below).alias("below"), F.sum("terms").over(group).alias("n_all"), F.sum("cost").over(group).alias("all"),
    )
    one_sided = sums.filter(F.col("item").isNotNull()).select("lang", "source", "item", (F.col("p") * (2 * F.col("n_below") - F.col("n_all")) + F.col("all") - 2 * F.col("below")).alias("value"))

    # Terms of neither; each pair of groups once.
    neither = both.filter(F.col("source") < F.col("item")).select("lang", "source", "item", ((F.col("kept") - F.col("support") - F.col("other_support")) * F.abs(F.col("zero") - F.col("other_zero"))).alias("value"))

    # Terms of both, over postings of the same term.
    a = priced.select("lang", "term", "source", "p", "zero")
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("zero").alias("zero2"))
    excess = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("zero2")) - F.abs(F.col("p2") - F.col("zero")) + F.abs(F.col("zero") - F.col("zero2"))
    common = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(excess).alias("value"))

    parts = one_sided.unionByName(neither).unionByName(common).groupBy("lang", F.least("source", "item").alias("low"), F.greatest("source", "item").alias("high")).agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    found = parts.select("lang", ends.alias("ends"), "value").select("lang", "ends.source", "ends.item", "value")
    return _ranked(found, "pair")


def _terms(priced: DataFrame, top: int) -> DataFrame:
    """The terms that a source has most above its language."""
    more = priced.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(more, "term").filter(F.col("rank") <= top)


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
