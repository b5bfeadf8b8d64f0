"""Resampling of documents towards a target: hashed n-gram counts by DuckDB in each partition, merged and scored by Spark.

* Each task hands its texts, in chunks of bounded size, to a DuckDB connection of its own: SQL takes the words apart (``unnest``), makes runs of
  words by window functions, and a registered function gives the zlib CRC-32 of each different run.  What comes back is written as Parquet in the shared
  folder: for each document its buckets and their counts, for each task the sums of its documents.
* Spark adds up the sums of tasks (one number a bucket), from which the gain of each bucket follows, and scores documents from their written counts; texts are read once.
* Documents are drawn by score plus Gumbel noise that depends on the id alone.  Scores are whole numbers, so their histogram tells the lowest score that is
  drawn; only documents from there on are sorted, by ranges over all tasks.

On the driver are the sums (``n_buckets`` numbers), the histogram of scores and one number a sorted partition; none grows with the documents.

Defined results: a null text has no words; features of a text shorter than a run are its shorter runs only; each row is a document, so repeated rows count and
are drawn each (equal score and id: in the order of rows); a null id counts as an empty one in the noise; documents without features weigh 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .storage import frugal, written
from .words import cut_points, text_chunks

#: Bytes that belong to a word: ASCII digits and letters and all of other characters.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

CHUNK = 1 << 21
COUNTS = "total boolean, row long, n_words long, n_features long, buckets array<int>, counts array<long>"
WORDS_SQL = r"regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def features_sql(longest: int, n_buckets: int) -> str:
    """(row, bucket, n, words) of the table ``pieces`` (row, piece, skip, text): the first ``skip`` words of a piece were counted with the piece before it."""
    if longest == 1:
        runs = f"SELECT row, unnest({WORDS_SQL}) AS run, true AS single FROM pieces"
    else:
        after = ", ".join(f"lead(word, {k}) OVER near AS w{k}" for k in range(1, longest))
        joined = " UNION ALL ".join(
            f"SELECT row, {' || chr(32) || '.join(['word', *[f'w{k}' for k in range(1, n)]])} AS run, {'true' if n == 1 else 'false'} AS single FROM near_words WHERE pos + {n - 1} > skip" + (f" AND w{n - 1} IS NOT NULL" if n > 1 else "") for n in range(1, longest + 1)
        )
        runs = f"""SELECT * FROM (WITH near_words AS (SELECT *, {after} FROM (
            SELECT row, piece, skip, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT row, piece, skip, {WORDS_SQL} AS w FROM pieces)) WINDOW near AS (PARTITION BY piece ORDER BY pos)) {joined})"""
    return f"""
        WITH runs AS ({runs}),
        counted AS (SELECT row, run, single, count(*) AS n FROM runs GROUP BY ALL),
        hashed AS (SELECT run, zlib_crc32(translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) % {n_buckets} AS bucket FROM (SELECT DISTINCT run FROM counted))
        SELECT row, bucket, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE single), 0) AS BIGINT) AS words FROM counted JOIN hashed USING (run) GROUP BY ALL ORDER BY ALL"""


def connection():
    """A database in memory for one task: one thread, no files, and CRC-32 as a function of whole columns."""
    import zlib

    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})

    def crc(column: pa.ChunkedArray) -> pa.Array:
        return pa.array([zlib.crc32(x.encode()) for x in column.to_pylist()], pa.int64())

    con.create_function("zlib_crc32", crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def overlapping(data: np.ndarray, limit: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, words to skip) of slices of one long text, each with the ``longest - 1`` words before it."""
    solid, at = WORD[data], 0
    for end in cut_points(solid, limit):
        start, skip = at, 0
        while start and skip < longest - 1:
            here = np.flatnonzero(solid[:start])
            if not len(here):
                break
            gap = np.flatnonzero(~solid[: here[-1]])
            start, skip = int(gap[-1]) + 1 if len(gap) else 0, skip + 1
        yield start, end, skip
        at = end


def count_buckets(docs: DataFrame, longest: int, n_buckets: int, each: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Of (id, text): a row for each document, if ``each``, and one with ``total`` for each task that has rows, with the sums of its documents."""
    key = docs.schema.fields[0]
    schema = T.StructType([T.StructField(key.name, key.dataType, True), *T._parse_datatype_string(COUNTS).fields])
    sql = features_sql(longest, n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total, words, features, kind = TaskContext.get().partitionId() << 40, np.zeros(n_buckets, np.int64), 0, 0, None

        def table(ids: pa.Array, whole: bool, first: int, n_words: np.ndarray, n: np.ndarray, edges: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            edges = pa.array(edges, pa.int32())
            rows = np.arange(first, first + len(ids))
            lists = [pa.ListArray.from_arrays(edges, pa.array(buckets, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), whole)), pa.array(rows), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), *lists], names=[f.name for f in schema.fields])

        with connection() as con:

            def counted(rows: list[int], skips: list[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
                pieces = pa.table({"row": pa.array(rows, pa.int64()), "piece": pa.array(range(len(rows)), pa.int64()), "skip": pa.array(skips, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})
                con.register("pieces", pieces)
                found = con.sql(sql).to_arrow_table()
                con.unregister("pieces")
                return tuple(found[c].to_numpy() for c in ("row", "bucket", "n", "words"))

            for batch in batches:
                kind = batch.schema.field(0).type
                for lo, hi, offsets, data in text_chunks(batch.column(1), chunk):
                    if hi - lo == 1 and len(data) > chunk:
                        own, said = np.zeros(n_buckets, np.int64), 0
                        for start, end, skip in overlapping(data, chunk, longest):
                            _, bucket, n, single = counted([0], [skip], [data[start:end].tobytes()])
                            np.add.at(own, bucket, n)
                            said += int(single.sum())
                        bucket = np.flatnonzero(own)
                        n, row, single = own[bucket], np.zeros(len(bucket), np.int64), np.array([said])
                        n_words, edges = single, np.array([0, len(bucket)])
                    else:
                        raw = data.tobytes()
                        row, bucket, n, single = counted(list(range(hi - lo)), [0] * (hi - lo), [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
                        n_words = np.bincount(row, single, hi - lo).astype(np.int64)
                        edges = np.searchsorted(row, np.arange(hi - lo + 1))
                    np.add.at(total, bucket, n)
                    words, features = words + int(n_words.sum()), features + int(n.sum())
                    if each:
                        sums = np.diff(np.concatenate([[0], np.cumsum(n)])[edges])
                        yield table(batch.column(0).slice(lo, hi - lo), False, base, n_words, sums, edges, bucket, n)
                        base += hi - lo
        if kind is not None:
            used = np.flatnonzero(total)
            yield table(pa.nulls(1, kind), True, -1, np.array([words]), np.array([features]), np.array([0, len(used)]), used, total[used])

    return docs.mapInArrow(frugal(run), schema)


def merged(counts: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features each bucket holds, from the sums of tasks."""
    out = np.zeros(n_buckets, np.int64)
    sums = counts.filter("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    for row in sums.collect():  # at most one row a bucket
        out[row["buckets"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier each bucket is in the target, both smoothed by one; floors go down."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, n_buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; ``rank`` from 1 for the ``percent`` of documents of ``least_words`` words or more that are drawn, null for others."""
    own = written(count_buckets(docs.select(F.col(id_col), F.col(text_col).alias("__text")), longest, n_buckets), "bucket-counts")
    wanted = written(count_buckets(target.select(F.lit("").alias("__id"), F.col(text_col).alias("__text")), longest, n_buckets, each=False), "target-counts")
    gain = gains(merged(own, n_buckets), merged(wanted, n_buckets))
    key = own.columns[0]
    shown = own.filter(~F.col("total")).select(F.col(f"`{key}`"), "row", "n_words", "n_features", "buckets", "counts")
    schema = T.StructType([shown.schema.fields[0], *T._parse_datatype_string("row long, n_words long, n_features long, weight long").fields])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = batch.column(4), batch.column(5)
            edges, n = buckets.offsets.to_numpy() - buckets.offsets[0].as_py(), batch.column(3).to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[buckets.flatten().to_numpy()] * counts.flatten().to_numpy())])[edges]
            weight = np.diff(sums) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], names=[f.name for f in schema.fields])

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    score = F.col("weight") + F.floor(-1000 * F.ln(-F.ln((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(shown.mapInArrow(frugal(weigh), schema).withColumn("score", score.cast("bigint")), "scores")

    able = F.col("n_words") >= least_words
    many = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.col("score").desc()).collect()  # whole thousandths of a logarithm: some ten thousand values at most
    draw, lowest, seen = sum(r["n"] for r in many) * percent // 100, None, 0
    for row in many:
        if seen < draw:
            lowest, seen = row["score"], seen + row["n"]
    fields = [F.col(f"`{key}`"), "n_features", "weight", "score"]
    unranked = F.lit(None).cast("bigint").alias("rank")
    if lowest is None:
        return scored.select(*fields, unranked)
    near = able & (F.col("score") >= lowest)
    ordered = written(scored.filter(near).orderBy(F.col("score").desc(), F.col(f"`{key}`"), "row").withColumn("__at", F.monotonically_increasing_id()), "drawn")
    part, offsets, before = F.shiftright("__at", 33), [], 0
    for row in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        offsets.append((row["part"], before))
        before += row["n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.join(starts, part == F.col("__part")).select(*fields, F.when(rank <= draw, rank).alias("rank"))
    return scored.filter(~near).select(*fields, unranked).unionByName(ranked)
