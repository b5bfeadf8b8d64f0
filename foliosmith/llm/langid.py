"""Language identification by a byte convolutional network trained in numpy.

Network: byte classes (256 bytes folded to at most 128 classes) -> embedding -> parallel convolutions
of several widths -> max pooling over the window -> ReLU -> softmax.  A text is cut into fixed-length
byte windows; the class probabilities of its windows are averaged, weighted by the bytes they hold.
A convolution over embedded bytes is a sum of per-offset table rows, so inference folds the
embedding and each filter bank into lookup tables over byte pairs and walks all windows of a
batch in lockstep, one byte position at a time.

Defined results: null text, empty text and texts without a letter are ``und`` with score 0.0; an
empty input gives an empty output; without any labelled row every other text is ``und`` too.
Repeated rows are each answered.  Extra columns of the input are carried only by ``keep``.
Training reads a bounded sample (``per_lang`` rows a language, ``windows`` windows of each);
every row is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .storage import frugal
from .words import text_bytes

UND = "und"
#: Labels that training takes; more are an error, as samples of each go to the driver.
MOST_LANGS = 512
_LETTER = re.compile(r"[^\W\d_]")


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 padding, letters folded to lower case, digits together, each high byte its own."""
    table = np.ones(256, dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 2
    table[48:58] = 3
    for low in range(26):
        table[[65 + low, 97 + low]] = 4 + low
    table[39] = 30
    table[0x80:0xC0] = 31 + np.arange(64)
    table[0xC0:] = 95 + np.arange(64) // 2
    return table


CLASSES = 127


@dataclass
class LangModel:
    """Trained parameters; ``langs[k]`` is the label of output ``k``."""

    langs: list[str]
    window: int
    widths: tuple[int, ...]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the lookup tables that sum to its convolution: byte pairs first, a single byte last."""
        found = []
        for width, bank in zip(self.widths, self.filters):
            single = [(self.embed @ bank[k]).astype(np.float32) for k in range(width)]
            pairs = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(CLASSES * CLASSES, -1) for k in range(0, width - 1, 2)]
            found.append(pairs + ([single[-1]] if width % 2 else []))
        return found


def _pooled(codes: np.ndarray, tables: list[list[np.ndarray]], widths: Sequence[int]) -> np.ndarray:
    """Max-pooled filter responses of each row of ``codes`` (windows padded by zeros)."""
    n, length = codes.shape
    steps = np.ascontiguousarray(codes.T).astype(np.int32)
    pair = steps[:-1] * CLASSES + steps[1:]
    parts = []
    for width, found in zip(widths, tables):
        best = None
        for at in range(length - width + 1):
            value = None
            for k, table in enumerate(found):
                at_k = at + 2 * k
                part = table.take(pair[at_k] if len(table) > CLASSES else steps[at_k], axis=0)
                value = part if value is None else np.add(value, part, out=value)
            best = value if best is None else np.maximum(best, value, out=best)
        parts.append(best)
    return np.concatenate(parts, axis=1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(model: LangModel, codes: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Class probabilities of each window."""
    pooled = np.maximum(_pooled(codes, tables, model.widths) + np.concatenate(model.bias), 0)
    return _softmax(pooled @ model.out + model.out_bias)


def train(samples: list[tuple[bytes, str]], window: int = 256, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, dim: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.02, seed: int = 7) -> LangModel:
    """Fits the network to (window bytes, language) pairs with Adam; deterministic for given pairs and seed."""
    langs = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    table = byte_classes()
    codes = np.zeros((len(samples), window), dtype=np.uint8)
    for row, (raw, _) in zip(codes, samples):
        raw = raw[:window]
        row[: len(raw)] = table[np.frombuffer(raw, dtype=np.uint8)]
    truth = np.array([langs.index(lang) for _, lang in samples], dtype=np.int64)
    model = LangModel(
        langs, window, widths, rng.normal(0, 0.5, (CLASSES, dim)),
        [rng.normal(0, 1 / np.sqrt(width * dim), (width, dim, filters)) for width in widths],
        [np.zeros(filters) for _ in widths],
        rng.normal(0, 1 / np.sqrt(len(widths) * filters), (len(widths) * filters, max(1, len(langs)))), np.zeros(max(1, len(langs))),
    )
    model.embed[0] = 0
    if len(langs) < 2:
        return model
    params = [model.embed, *model.filters, *model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            x, n = codes[rows].astype(np.int64), len(rows)
            hidden, where = [], []
            for width, bank, bias in zip(widths, model.filters, model.bias):
                span = window - width + 1
                value = sum((model.embed @ bank[k])[x[:, k : k + span]] for k in range(width))
                at = value.argmax(axis=1)
                where.append(at)
                hidden.append(np.take_along_axis(value, at[:, None, :], axis=1)[:, 0, :] + bias)
            raw = np.concatenate(hidden, axis=1)
            active = np.maximum(raw, 0)
            wrong = _softmax(active @ model.out + model.out_bias)
            wrong[np.arange(n), truth[rows]] -= 1
            wrong /= n
            back = (wrong @ model.out.T) * (raw > 0)
            d_embed, d_filters, d_bias = np.zeros_like(model.embed), [], []
            for j, (width, bank, at) in enumerate(zip(widths, model.filters, where)):
                grad = back[:, j * filters : (j + 1) * filters]
                d_bias.append(grad.sum(axis=0))
                d_bank = np.zeros_like(bank)
                for k in range(width):
                    hit = np.take_along_axis(x, at + k, axis=1)
                    d_table = np.zeros((CLASSES, filters))
                    np.add.at(d_table, (hit, np.arange(filters)[None, :]), grad)
                    d_bank[k] = model.embed.T @ d_table
                    d_embed += d_table @ bank[k].T
                d_filters.append(d_bank)
            d_embed[0] = 0
            grads = [d_embed, *d_filters, *d_bias, active.T @ wrong, wrong.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def training_windows(docs: DataFrame, allowed: Column, per_lang: int, windows: int, window: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_langs: int = MOST_LANGS) -> list[tuple[bytes, str]]:
    """At most ``per_lang`` hash-chosen labelled rows a language, ``windows`` hash-placed windows of each; an error for more than ``most_langs`` languages."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), allowed.alias("_ok")).filter("_ok and _lang is not null and length(_text) > 0")
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages; most_langs bounds what the driver holds")
    if not counts:
        return []
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["_lang"]), F.lit(min(1.0, 1.3 * per_lang / r["count"])))])
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    places = [F.substring("_text", (F.lit(1) + F.pmod(F.xxhash64("_id", F.lit(k)), F.greatest(F.length("_text") - window + 1, F.lit(1)))).cast("int"), F.lit(window)) for k in range(windows)]
    chosen = rows.filter(draw < rate[F.col("_lang")]).select("_id", "_lang", F.array(*places).alias("_windows"))
    taken: dict[str, int] = {}
    found = []
    for r in chosen.orderBy(F.xxhash64("_id", F.lit(11)), "_id", "_lang").limit(2 * per_lang * len(counts)).collect():
        if taken.get(r["_lang"], 0) < per_lang:
            taken[r["_lang"]] = taken.get(r["_lang"], 0) + 1
            found += [(w.encode()[:window], r["_lang"]) for w in dict.fromkeys(r["_windows"])]
    return found


def fit(docs: DataFrame, allowed: Column, per_lang: int = 500, windows: int = 4, window: int = 256, most_langs: int = MOST_LANGS, **columns: str) -> LangModel:
    """Trains on a bounded sample of the rows for which ``allowed`` holds; an error for more than ``most_langs`` languages."""
    return train(training_windows(docs, allowed, per_lang, windows, window, most_langs=most_langs, **columns), window)


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def predict_column(model: LangModel, column: pa.Array, tables: list[list[np.ndarray]], rows: int = 1024) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text of a string array; whole texts, in blocks of ``rows`` windows."""
    offsets, data = text_bytes(column)
    sizes = np.diff(offsets)
    counts = -(-sizes // model.window)
    total = np.zeros((len(sizes), len(model.langs) or 1))
    owner_of = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    classes = byte_classes()
    for lo in range(0, len(owner_of) if model.langs else 0, rows):
        owner = owner_of[lo : lo + rows]
        begin = offsets[owner] + (np.arange(lo, lo + len(owner)) - first[owner]) * model.window
        length = np.minimum(model.window, offsets[owner + 1] - begin)
        at = begin[:, None] + np.arange(model.window)
        inside = np.arange(model.window) < length[:, None]
        codes = np.where(inside, classes[data[np.where(inside, at, 0)]], 0)
        np.add.at(total, owner, probabilities(model, codes, tables) * length[:, None])
    share = total / np.maximum(sizes, 1)[:, None]
    best = share.argmax(axis=1)
    score = np.clip(share[np.arange(len(best)), best], 0.0, 1.0)
    names = []
    for k, text in enumerate(column):
        if model.langs and has_letter(text.as_py()):
            names.append(model.langs[best[k]])
        else:
            names.append(UND)
            score[k] = 0.0
    return names, score


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score, under ``names``, to (``id_col``, ``keep`` columns); narrow, no shuffle, and each text is shipped once."""
    wanted = list(dict.fromkeys([id_col, *keep]))
    shown = docs.select(*wanted) if text_col in wanted else docs.select(*wanted, F.col(text_col).alias("__text"))
    place = wanted.index(text_col) if text_col in wanted else len(wanted)
    schema = T.StructType([*docs.select(*wanted).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                langs, score = predict_column(model, part.column(place), tables)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(wanted)], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return shown.mapInArrow(frugal(run), schema)
