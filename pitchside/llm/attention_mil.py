"""Operator 10: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage becomes a vector (shares of
transitions between byte classes, and word statistics: repeats, distinct words, lengths), which a
learned layer encodes. Gated attention gives each passage a weight, learned from document labels
alone; the weighted sum of the encoded passages is scored by a logistic unit:

    h = tanh(E x),  a = softmax(w . (tanh(V h) * sigmoid(U h))),  score = sigmoid(c . sum(a h) + b)

Training uses a bounded hash sample of labelled rows (``sample_rows`` and ``sample_passages``); scoring
reads every passage of every whole text. Weights travel in the task closure (some 50 kB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.sampling import hash_sample
from pitchside.llm.text import LOWER, blocks, join_texts, prefix_sums, span_hash, word_spans
from pitchside.sources.stage import stage

PASSAGE_WORDS = 64
HIDDEN, GATE = 24, 12
BLOCK = {"max_bytes": 1 << 19, "max_rows": 10_000}

#: Byte classes: letters, capitals, digits, spaces, line ends, sentence signs, and other signs.
_CLASS = np.full(256, 9, np.int64)
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 11, 12, 13), (46, 63), (44, 59, 58, 39, 34, 45, 40, 41), (33,))):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 8
CLASSES = 10
FEATURES = CLASSES * CLASSES + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors, text index of each); a text without words is one zero passage."""
    data, offsets = join_texts(texts, lower=False)
    starts, ends = word_spans(data)
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    first_word = np.searchsorted(starts, offsets[:-1])
    per_text = np.diff(np.append(first_word, len(starts)))
    n_passages = np.maximum(1, -(-per_text // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(n_passages)])
    place = np.arange(len(starts)) - first_word[text_of]
    passage = base[text_of] + place // PASSAGE_WORDS
    n = int(base[-1])
    out = np.zeros((n, FEATURES), np.float32)
    owner = np.repeat(np.arange(len(texts)), n_passages)
    if not len(starts):
        return out, owner
    # Bytes from a word's start to the next word's start in the same text belong to its passage.
    reach = np.append(starts[1:], len(data))
    reach = np.minimum(reach, offsets[text_of + 1] - 1)  # the newline that join_texts adds leads into another text
    sizes = reach - starts
    index = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    of = np.repeat(passage, sizes)
    cls = _CLASS[data]
    step = cls[index] * CLASSES + np.append(cls, 4)[index + 1]
    seen = np.bincount(of * (CLASSES * CLASSES) + step, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    total = np.maximum(seen.sum(axis=1, keepdims=True), 1)
    out[:, : CLASSES * CLASSES] = np.sqrt(seen / total)
    low = LOWER[data]
    h = span_hash(prefix_sums(low), starts, ends)
    count = np.bincount(passage, minlength=n)
    words = np.maximum(count, 1)
    share = lambda mask: np.bincount(passage[mask], minlength=n) / words
    same_text = np.append(False, text_of[1:] == text_of[:-1])
    length = ends - starts
    order = np.lexsort((h, passage))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1]))
    extra = out[:, CLASSES * CLASSES:]
    extra[:, 0] = share(same_text & np.append(False, h[1:] == h[:-1]))
    extra[:, 1] = np.bincount(passage[order][new], minlength=n) / words
    extra[:, 2] = np.bincount(passage, weights=length, minlength=n) / words / 10
    extra[:, 3] = share(length <= 3)
    extra[:, 4] = share(length > 15)
    extra[:, 5] = count / PASSAGE_WORDS
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
    """All steps of the network for passages ``x`` of ``n`` documents."""
    x = (x - p["mean"]) / p["sd"]
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, s)
    e = np.exp(s - top[owner])
    a = e / np.bincount(owner, weights=e, minlength=n)[owner]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, owner, a[:, None] * h)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"])}


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 300, seed: int = 10) -> dict:
    """Weights by full-batch Adam on the log loss with weight decay."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    p = {"mean": x.mean(axis=0), "sd": x.std(axis=0) + 0.02}
    w = {"E": rng.normal(0, f ** -0.5, (f, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)),
         "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "b": np.zeros(())}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    n = len(y)
    for step in range(1, rounds + 1):
        r = forward(p | w, x, owner, n)
        d = (r["score"] - y) / n
        dz = d[:, None] * w["c"]
        a, h, t, g = r["a"], r["h"], r["t"], r["g"]
        da = (dz[owner] * h).sum(axis=1)
        ds = a * (da - np.bincount(owner, weights=a * da, minlength=n)[owner])
        dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[owner] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        grad = {"E": r["x"].T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": r["z"].T @ d, "b": d.sum()}
        for k in w:
            gk = grad[k] + 1e-4 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * gk
            second[k] = 0.999 * second[k] + 0.001 * gk * gk
            w[k] = w[k] - 0.02 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return p | w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = 2000, sample_passages: int = 60_000) -> dict | None:
    """Weights learned from labelled documents; None if no labelled document is found.

    ``labels`` has id_col and a 0/1 label_col; rows with a null in either are left out, and an id labelled twice
    takes its smaller label. At most ``sample_rows`` labelled rows (smallest hashes of the id) and ``sample_passages``
    passages of them are learned from: in order of the hashes every document that still fits, whole. Of several texts of one id
    one is taken, by its hash. Order and partitions of the rows play no part.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    known = hash_sample(known.groupBy("_id").agg(F.min("_y").alias("_y")), "_id", sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(known), "_id")  # at most sample_rows rows
    rows = stage(rows.select(F.xxhash64(F.lit(10), "_id").alias("o"), F.xxhash64("_id", "_text").alias("r"), F.col("_y").alias("y"), "_text"), "labelled-texts")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "_text", **BLOCK):
            n = np.bincount(passages(texts)[1], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["o", "r", "n"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "_text", **BLOCK):
            x, owner = passages(texts)
            at = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[at[i]:at[i + 1]].tobytes() for i in range(len(texts))], pa.binary())], names=["r", "y", "x"])

    # The bounds are applied to the numbers of passages; only vectors within them come to the driver.
    counted = rows.select("o", "r", "_text").mapInArrow(sizes, "o long, r long, n long").groupBy("o").agg(F.min(F.struct("r", "n")).alias("m"))
    taken, left = [], sample_passages
    for one in counted.orderBy("o").select("m.r", "m.n").collect():  # at most sample_rows rows
        if one.n <= left:
            taken.append(one.r)
            left -= one.n
    # An Arrow table: rows from a list would start a second set of Python workers on every executor.
    chosen = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"r": pa.array(taken, pa.int64())})))
    found = rows.join(chosen, "r", "left_semi").select("r", "y", "_text").mapInArrow(vectors, "r long, y int, x binary")
    found = sorted(found.groupBy("r").agg(F.min("y"), F.min("x")).collect())  # the same order whatever the partitions were
    bags = [(y, np.frombuffer(x, np.float32).reshape(-1, FEATURES)) for _, y, x in found]
    if not bags:
        return None
    owner = np.repeat(np.arange(len(bags)), [len(x) for _, x in bags])
    return train(np.concatenate([x for _, x in bags]), owner, np.array([y for y, _ in bags], float))


def score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ``score``) of every row: the chance of label 1 by its whole text.

    Null and empty texts are scored as one passage without words; without a model every score is 0.5. Rows are
    scored one by one, so repeated rows have the same score; no column but the text is read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "_text", **BLOCK):
            if model is None:
                found = np.full(len(texts), 0.5)
            else:
                x, owner = passages(texts)
                found = forward(model, x, owner, len(texts))["score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(df: DataFrame, model: dict | None, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose score is at least ``threshold`` (all rows without a model)."""
    if model is None:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col, **BLOCK):
            x, owner = passages(texts)
            yield batch.filter(pa.array(forward(model, x, owner, len(texts))["score"] >= threshold))

    return df.mapInArrow(run, df.schema)
