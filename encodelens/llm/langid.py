"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Bytes looked at together; texts are walked in blocks of this size, whole.
BLOCK = 1 << 18
_LETTER = regex.compile(r"\p{L}")


def buckets(text: str) -> Iterator[np.ndarray]:
    """The n-gram buckets of a text, a block at a time: its byte pairs as they are, and its byte triples hashed.

    Pairs take buckets 0 to 65,535 and triples the next 65,536. Letters are in lower case.
    """
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    for i in range(0, len(raw) - 1, BLOCK):
        b = raw[i : i + BLOCK + 2].astype(np.uint32)
        pairs, triples = b[:-1] << np.uint32(8) | b[1:], ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        yield np.concatenate((pairs[:BLOCK], triples[:BLOCK] + np.uint32(BUCKETS)))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1, one a language, far apart: all splits of up to 5 languages, else the best of some random codes.

    A column that gives all languages one bit would teach nothing and does not occur.
    """
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if j == 0 else (-1 if b >> (j - 1) & 1 else 1) for b in bits] for j in range(n)], np.int8)
    rng, width, best, apart = np.random.default_rng(seed), max(15, 6 * math.ceil(math.log2(n))), None, -1
    for _ in range(64):
        c = rng.choice(np.array([-1, 1], np.int8), (n, width))
        c[0] = np.where(np.abs(c.sum(axis=0, dtype=int)) == n, -c[0], c[0])
        d = (width - c.astype(int) @ c.T) // 2 + width * np.eye(n, dtype=int)
        if d.min() > apart:
            best, apart = c, d.min()
    return best


@dataclass(frozen=True)
class Model:
    """Per bit of the code one binary classifier: the weights of all n-grams; and the languages with their codewords."""

    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    ambiguous: float

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous) of a whole text.

        The classifiers' mean log-odds are margins; each language loses log(1 + exp(-sharpness * margin * bit)) per
        bit of its codeword, weighted by the size of the margin, and the least loss wins. The score is its share of
        exp(-loss). Ambiguous: it leads the second by less than the model's bound.
        """
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        total, n = np.zeros(self.weights.shape[1]), 0
        for b in buckets(text):
            total += self.weights[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        margin = total / n
        size = np.abs(margin) / max(np.abs(margin).sum(), 1e-12)
        loss = (np.logaddexp(0, -8 * margin * self.code) * size).sum(axis=1) * len(margin)
        p = np.exp(loss.min() - loss)
        order = np.argsort(loss, kind="stable")
        score = float(p[order[0]] / p.sum())
        return self.langs[order[0]], score, bool(score - float(p[order[1]] / p.sum()) < self.ambiguous)


def gram_counts(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n): n-grams per language over all rows with a language; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = held.setdefault(lang, np.zeros(2 * BUCKETS, np.int64))
                for x in buckets(text):
                    at += np.bincount(x, minlength=2 * BUCKETS)
            if len(held) > 64:
                yield from emit(held)
                held = {}
        yield from emit(held)

    def emit(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(lang_col, text_col).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", smooth: float = 0.5, ambiguous: float = 0.2) -> Model:
    """Learns from all rows given that have a language.

    The counts are made in Spark; the driver gets 131,072 of them a language at most, whatever the number of rows, and
    turns them into each bit's log-odds of an n-gram between the languages of its two sides, every language of a side
    counting alike.
    """
    got = gram_counts(rows, lang_col, text_col).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    code = codewords(len(langs))
    p = np.full((len(langs), 2 * BUCKETS), smooth)
    row = {x: i for i, x in enumerate(langs)}
    at = np.array([row[x] for x in got.column("lang").to_pylist()], np.int64)
    p[at, got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        p[:, half] /= p[:, half].sum(axis=1, keepdims=True)
    sides = [(p[code[:, j] > 0].mean(axis=0), p[code[:, j] < 0].mean(axis=0)) for j in range(code.shape[1])]
    weights = np.stack([np.log(a / b) for a, b in sides], axis=1).astype(np.float32) if sides else np.zeros((2 * BUCKETS, 0), np.float32)
    return Model(tuple(langs), code, weights, ambiguous)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with lang_pred, score and ambiguous.

    `und` with score 0 for a null text, one without a letter, or a model that has learned nothing. Only the text
    is looked at; rows keep their other columns, unless those have these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "ambiguous")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.decide(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], schema.names)

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", fold: int = 1, folds: int = 3) -> Column:
    """Whether crc32 of the id as text leaves `fold`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
