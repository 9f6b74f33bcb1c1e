"""Operator 3: language identification by the nearest of several centroids per language.

A text becomes hashed counts of its byte 2- and 3-grams (lower case, all that is no letter as a
space), log-scaled, weighted by inverse document frequency and normalised. Document frequencies are
counted over every training row. Centroids are fitted by spherical k-means, several per language,
on a bounded hash sample of training rows (``sample_rows``, documented in ``fit``). A text takes the
language of the centroid with the greatest cosine; it is ``rejected`` if it is farther from that
centroid than nearly all of the centroid's own training texts.

Per task and block: one dense matrix of at most 256 texts. On the driver: the sample's vectors
(sample_rows x DIMS) and the centroids; nothing grows with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.sampling import hash_sample
from pitchside.llm.text import blocks

DIMS = 4096
BLOCK = {"max_bytes": 1 << 20, "max_rows": 256}
NON_LETTER = np.arange(256, dtype=np.uint8)
NON_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Centroids:
    """``languages[i]`` is the language of row i of ``vectors``; ``far[i]`` its rejection distance."""

    idf: np.ndarray
    vectors: np.ndarray
    languages: list[str]
    far: np.ndarray


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed 2- and 3-grams, texts x DIMS; whether a text has a letter)."""
    plain = [t.decode("utf-8", "replace") for t in texts]
    has_letter = np.array([LETTER.search(t) is not None for t in plain], bool)
    padded = [b" " + t.lower().encode() + b"  " for t in plain]
    sizes = np.array([len(p) for p in padded])
    data = NON_LETTER[np.frombuffer(b"".join(padded), np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMS, sizes)
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(263) + data[2:]
    gap = data == 32
    out = np.zeros(len(texts) * DIMS, np.int64)
    for gram in (two, three):
        # The two closing spaces keep grams from crossing texts, but for those of spaces alone: left out.
        keep = ~(gap[: len(gram)] & gap[1: len(gram) + 1])
        slot = (gram * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
        out += np.bincount((row[: len(gram)] + slot)[keep], minlength=len(out))
    return out.reshape(-1, DIMS).astype(np.float32), has_letter


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows (an all-zero row stays zero)."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; each first centre is the row farthest from those before it."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 4, sample_rows: int = 2000) -> Centroids:
    """Centroids from the rows of ``train`` with text and language.

    ``sample_rows``: how many rows at most the centroids are fitted on (document frequencies use all rows).
    """
    rows = train.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.filter(F.col("_text").isNotNull() & F.col("_lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for _, texts in blocks(batches, "_text", **BLOCK):
            counts, _ = gram_counts(texts)
            df += (counts > 0).sum(axis=0)
            n += len(texts)
        # Slot DIMS holds the number of rows.
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.append(df, n))], names=["slot", "rows"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "_text", **BLOCK):
            counts, _ = gram_counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([c.tobytes() for c in counts], pa.binary())], names=["lang", "counts"])

    found = rows.mapInArrow(frequencies, "slot int, rows long").groupBy("slot").agg(F.sum("rows")).collect()
    df = np.zeros(DIMS + 1)
    for slot, n in found:
        df[slot] = n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}  # one row per language
    each = max(1, sample_rows // max(1, len(sizes)))
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("_lang") == lang, min(1.0, (1.5 * each + 20) / n)).otherwise(rate)
    h = F.pmod(F.xxhash64(F.lit(3), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = hash_sample(rows.filter(h < rate), "_id", 2 * sample_rows).mapInArrow(vectors, "lang string, counts binary").collect()
    by_lang: dict[str, list[np.ndarray]] = {}
    for lang, counts in sample:
        if len(by_lang.setdefault(lang, [])) < each:
            by_lang[lang].append(np.frombuffer(counts, np.float32))
    parts, languages, far = [], [], []
    for lang in sorted(by_lang):
        x = weigh(np.array(by_lang[lang]), idf)
        c = _k_means(x, per_language)
        cos = x @ c.T
        own = np.argmax(cos, axis=1)
        for j in range(len(c)):
            d = 1 - cos[own == j, j]
            far.append(float(np.quantile(d, 0.99)) * 1.1 + 0.02 if len(d) else 1.0)
        parts.append(c)
        languages += [lang] * len(c)
    return Centroids(idf, np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32), languages, np.array(far))


def predict(df: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ``lang_pred``, ``score`` cosine in 0..1, ``rejected``) of every row.

    A null text, a text without letters and any text under a model without languages give ``und``, 0 and true. Ties
    go to the language that sorts first. No column but the text is read for a prediction.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "_text", **BLOCK):
            counts, letters = gram_counts(texts)
            if not len(model.languages):
                letters[:] = False
                cos = np.zeros((len(texts), 1), np.float32)
            else:
                cos = weigh(counts, model.idf) @ model.vectors.T
            best = np.argmax(cos, axis=1)
            score = np.where(letters, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
            lang = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            far = [not ok or 1 - s > model.far[b] for b, ok, s in zip(best, letters, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(far, pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
