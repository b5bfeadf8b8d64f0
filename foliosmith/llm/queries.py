"""Registered queries of the training-data operators: thin wrappers that fix parameters and derive digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bestfit, capfilters, chat, decontam, divergence, htmltext, importance, langid, licences, ngramjoin, packing, pii, substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = pii.KINDS[:4]
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(named(F.filter("pii", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"), named(F.col("pii")).alias("spans"))


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = chat.format_chats(turns.unionByName(probe), chat.text_part(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                said, loss = chat.parse(formatted), chat.under_mask(formatted, spans)
                rows.append((len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.pack(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_pii": op8_pii,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_ngram_join": op10_ngram_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": pipeline,
}

_ESCAPE = r"regexp_replace(regexp_replace({0}, '<(\\*)(\|im_start\|>|\|im_end\|>|\|(?:image|audio|document|attachment)_\d+\|>|/?s>|</?SYS>>|/SYS>>|<SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"

_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Reachability over ``links`` (a, b) of ``nodes`` (id), which both precede it.
_REACH = """reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a)"""

# The account numbers of op8 in plain words: country and length, then groups of four with or without blanks.
_IBAN_SQL = r"\b(?:" + "|".join(
    rf"(?:{countries})[0-9][0-9]" + r"\x20?[A-Z0-9]{4}" * ((length - 4) // 4) + (rf"\x20?[A-Z0-9]{{{length % 4}}}" if length % 4 else "")
    for length, countries in (
        (15, "NO"), (16, "BE"), (18, "DK|FI|FK|FO|GL|NL|SD"), (19, "MK|SI"), (20, "AT|BA|EE|KZ|LT|LU|MN|XK"), (21, "CH|CR|HR|LI|LV"), (22, "BG|BH|DE|GB|GE|IE|ME|RS|VA"), (23, "AE|GI|IL|IQ|OM|SO|TL"),
        (24, "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG"), (25, "LY|PT|ST"), (26, "IS|TR"), (27, "BI|DJ|FR|GR|IT|MC|MR|SM"), (28, "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV"), (29, "BR|EG|PS|QA|UA"), (30, "JO|KW|MU|YE"), (31, "MT|SC"), (32, "LC"), (33, "RU"),
    )
) + r")\b"
_KINDS_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: list_extract(CASE WHEN i % 2 = 0 THEN [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9] END, CAST(substr(digits, length(digits) - i, 1) AS INTEGER) + 1))) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
    ("iban", _IBAN_SQL, "CAST(regexp_replace(list_reduce(list_transform(string_split(substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), lambda x, y: CAST(CAST(x || y AS BIGINT) % 97 AS VARCHAR)), '^$', '0') AS BIGINT) % 97 = 1"),
    ("secret", r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\x22'']?[A-Za-z0-9_/+-]{16,}", "true"),
)


def _kind_sql(place: int, kind: str, pattern: str, good: str) -> str:
    """Matches of a kind: the lengths of what lies between and of the matches before give the places."""
    return f"""
        SELECT doc_id, {place} AS place, '{kind}' AS kind, s AS start, s + length(hit) AS stop FROM (
            SELECT doc_id, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS s FROM (
                SELECT doc_id, hits, gaps, unnest(hits) AS hit, generate_subscripts(hits, 1) AS k FROM (
                    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL)))
        WHERE {good}"""


ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
        windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {{'pos': i, 'words': array_to_string(w[i:i + 19], ' ')}}), recursive := true) FROM docs),
        repeated AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) AS nth FROM windows) WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM repeated),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs)
        SELECT docs.doc_id, any_value(len(w)) AS n_words, count(gone.pos) AS n_removed,
            sha256(coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
        FROM docs LEFT JOIN words ON words.doc_id = docs.doc_id LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos GROUP BY docs.doc_id""",
    "op6_embedding_dedup": f"""
        WITH RECURSIVE vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        near AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.93),
        links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        nodes AS (SELECT vec_id AS id FROM embeddings),
        {_REACH}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(other) AS component_id, id = min(other) AS kept FROM reach GROUP BY id""",
    "op8_pii": f"""
        WITH spans AS ({' UNION ALL '.join(_kind_sql(k, *parts) for k, parts in enumerate(_KINDS_SQL))})
        SELECT d.doc_id, {', '.join(f"count(CASE WHEN kind = '{kind}' THEN 1 END) AS n_{kind}" for kind in ('email', 'ip', 'card', 'phone'))},
            sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (WHERE place < 4), '')) AS base_sha256,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start), '') AS spans
        FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_ngram_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM docs),
        grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
        near AS (SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        nodes AS (SELECT doc_id AS id FROM sets),
        {_REACH}
        SELECT id AS doc_id, (SELECT len(g) FROM sets WHERE doc_id = id) AS n_shingles, min(other) AS component_id FROM reach GROUP BY id""",
    "op11_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        words AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        sizes AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM cells),
        prices AS (SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS p, 1 + (1000000000 * CAST(lang_n + 5 AS HUGEINT)) // CAST(lang_total + 5 * v AS HUGEINT) AS q FROM sizes),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM prices x JOIN prices y ON x.term = y.term WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
        found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM prices WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
        QUALIFY part = 'pair' OR rank <= 50""",
    "op13_importance_resampling": r"""
        WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS step),
        words AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
            UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
        bytes AS (SELECT word, list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS raw FROM (SELECT DISTINCT word FROM words)),
        hashed AS (SELECT word, xor(4294967295, list_reduce(raw, lambda c, b: xor(c >> 8, list_extract(step, (xor(c, b) & 255) + 1)), CAST(4294967295 AS BIGINT))) % 10000 AS bucket FROM bytes, steps),
        counts AS (SELECT side, doc_id, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
        sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM counts GROUP BY bucket),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM sums) + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM sums) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums),
        weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM counts JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
        weighed AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id),
        scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
        SELECT s.doc_id, s.n_features, CAST(s.weight AS BIGINT) AS weight, CAST(s.score AS BIGINT) AS score, r.rank
        FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.rank <= (SELECT count(*) * 10 // 100 FROM ranked)""",
    "op9_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, {_ESCAPE.format('text')})) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, {_ESCAPE.format('text')})) AS loss_sha256,
            CAST(sum(length('<|im_start|>') + length(role) + 1 + length({_ESCAPE.format('text')}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
}
