"""Operator 1: language-model scoring with a probabilistic suffix tree over words.

States are contexts of no to ``max_context`` words. The root is the add-0.5 unigram law (the base score). A context
of s is retained if it predicts the training text better than its parent: its divergence, the sum over
its training occurrences of log P(next | s) / P(next | parent) with the occurrence itself left out of the counts,
must exceed GAIN. Next-symbol laws are smoothed by the parent's with weight KAPPA:
P(x | s) = (c(s x) + KAPPA P(x | parent)) / (c(s) + KAPPA). A token is scored at the longest suffix
of its history that is a state. Texts are tokenised once into chunks (word numbers and the
chunk's vocabulary), written as a table bucketed by chunk.

The tree is never in one place. In every round each chunk sends its distinct n-grams, with what they count in its
training texts, to the part that owns their hash, gets the corpus totals back in the same order, and goes on:

1. words and word pairs: counts, and the corpus totals N and V;
2. one word more a round, n-grams whose context recurs and whose last words are known: counts (no other n-gram is ever used),
   until no context recurs or contexts have ``max_context`` words. A round reads the answers of the round before alone, with
   which the chunk gets back the tokens it asked for, as bits;
3. contexts that recur, a few lengths a round: partial divergences; the answer is whether the context is retained. An n-gram's
   share of its context's divergence is the same at all its training occurrences, so one chunk sends it for all;

then every chunk scores its own texts. A chunk sends an n-gram once, however often it occurs, so a
word that is a third of all text is one number per chunk. What is exchanged grows with the corpus; nothing is
broadcast or sent to the driver. N-grams are known by 56-bit hashes.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.text import blocks, join_texts, mix, prefix_sums, span_hash, word_spans
from pitchside.session import checkpoint_dir
from pitchside.sources.stage import stage

KAPPA = 4.0
GAIN = 2.0
CHUNK_BYTES = 4 << 20
#: Kinds of n-grams of m words are m - 1, of whether a context of k words is retained RETAINED + k, of the tokens asked for ASKED.
RETAINED = 1 << 10
ASKED = -1
#: Lengths of contexts whose divergences are summed in one round, and in the first, in which most differ.
LENGTHS, FIRST_LENGTHS = 4, 2
END = int(mix(np.array([0xE17D], np.uint64))[0] >> np.uint64(8))
_A = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes, then all second bytes and so on: equal high bytes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel() if raw else np.zeros(0, kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def _follow(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The 56-bit hash of a longer n-gram from that of its beginning and its last word."""
    return mix(left * _A + right) >> np.uint64(8)


class Chunk:
    """Tokens of some documents and, round by round, the corpus totals of their n-grams."""

    def __init__(self, row: dict, replies: list[dict], up_to: int = 1 << 30):
        self.vocab = _unpack_keys(row["vocab"])
        self.tok = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.lens = np.array(row["lens"], np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.train = ~np.array(row["held"], bool)[self.doc]
        self.got: dict[int, np.ndarray] = {}
        self.sends: dict[int, np.ndarray] = {}   # of n-grams: whether this chunk sends their share of a divergence
        for kind in {r["kind"] for r in replies} - {ASKED}:
            self.got[kind], self.sends[kind] = _answers(replies, kind)
        self.total = sum(r["n"] for r in replies if r["kind"] == 0)
        self.kinds = sum(r["v"] for r in replies if r["kind"] == 0)

        n = len(self.tok)
        self.at = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(self.lens)[:-1]]), self.lens)  # place in the text
        self.words = self.vocab[self.tok]
        # Of each level (words in an n-gram): the tokens it is asked for, its distinct hashes, the number of each token's, and totals.
        self.tokens, self.keys, self.of, self.count = [np.arange(n)], [self.vocab], [self.tok], []
        self.level(1)
        if up_to:
            self.tokens.append(np.flatnonzero(self.at >= 1))
            self._hash()
        while len(self.count) < up_to and self.level(len(self.count) + 1) and len(self.count) in self.got:
            self.tokens.append(_go_on(self.tokens[-1], self.count[-1], self.at, len(self.count)))
            self._hash()

    def level(self, m: int) -> bool:
        """Whether the totals of n-grams of ``m`` words are there; if so, each token's is kept (0: not asked for)."""
        if m - 1 not in self.got or m > len(self.tokens):
            return False
        count = np.zeros(len(self.tok))
        count[self.tokens[m - 1]] = self.got[m - 1][self.of[m - 1]]
        self.count.append(count)
        return True

    def _hash(self) -> None:
        """Hashes of the n-grams that end at the last level's tokens, from those of one word less that end a token before."""
        t = self.tokens[-1]
        before = np.zeros(len(self.tok), np.uint64)
        before[self.tokens[-2]] = self.keys[-1][self.of[-1]] if len(self.keys[-1]) else 0
        keys, of = _inverse(_follow(before[t - 1], self.words[t]))
        self.keys.append(keys)
        self.of.append(of)

    def hashes(self, tokens: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the n-grams of ``m`` words that end at the tokens."""
        h = self.words[tokens - m + 1]
        for back in range(m - 2, -1, -1):
            h = _follow(h, self.words[tokens - back])
        return h

    def _root(self) -> np.ndarray:
        return (self.count[0] + 0.5) / (self.total + 0.5 * (self.kinds + 1))

    def _contexts(self, k: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(tokens whose context of ``k`` words recurs, the number of that context at level ``k``), out of those of one word less."""
        number = np.full(len(self.tok), -1)
        number[self.tokens[k - 1]] = self.of[k - 1]
        t = np.flatnonzero(self.at >= k) if shorter is None else shorter[self.at[shorter] >= k]
        t = t[self.count[k - 1][t - 1] >= 2]
        return t, number[t - 1]

    def ask_retained(self, levels: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Partial divergences of the contexts of ``levels`` words; a training token's own occurrence is not counted."""
        out, t = [], None
        p = self._root()
        for k in range(1, levels[-1] + 1):
            t, number = self._contexts(k, np.flatnonzero(self.train & (self.at >= 1)) if t is None else t)
            longer = (self.count[k][t] - 1 + KAPPA * p[t]) / (self.count[k - 1][t - 1] - 1 + KAPPA)
            if k not in levels:
                p[t] = longer
                continue
            # The first of a chunk's training occurrences stands for all, if the chunk is the one that sends the n-gram's share.
            gram = np.full(len(self.tok), -1)
            gram[self.tokens[k]] = self.of[k]
            gram = gram[t]
            share = np.zeros(len(t), bool)
            share[_first_of_each(gram, len(self.keys[k]))] = True
            share &= self.sends[k][gram]
            gain = np.bincount(number[share], weights=self.count[k][t[share]] * np.log(longer[share] / p[t[share]]), minlength=len(self.keys[k - 1]))
            recurs = self._recurring(k)
            out.append((RETAINED + k, self.keys[k - 1][recurs], gain[recurs]))
            p[t] = longer
        return out

    def _recurring(self, k: int) -> np.ndarray:
        return np.flatnonzero((self.got[k - 1] >= 2) & ((self.keys[k - 1] != np.uint64(END)) | (k > 1)))

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each document."""
        base = self._root()
        p, within = base.copy(), None
        for k in range(1, len(self.count)):
            state = np.zeros(len(self.keys[k - 1]), bool)
            state[self._recurring(k)] = self.got[RETAINED + k] > 0
            within, number = self._contexts(k, within)
            t = within[state[number]]
            # The parent of a context is its longest ending that is a state, else the root.
            p[t] = (self.count[k][t] + KAPPA * p[t]) / (self.count[k - 1][t - 1] + KAPPA)
        by_doc = lambda x: np.bincount(self.doc, weights=x, minlength=len(self.lens))
        return by_doc(self.got[0][self.tok] > 0).astype(np.int64), by_doc(np.log10(base)), by_doc(np.log10(p))


def _go_on(tokens: np.ndarray, count: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Of the tokens asked for n-grams of ``m`` words, those asked for one word more: contexts that recur, shorter n-grams that are known."""
    return tokens[(at[tokens] >= m) & (count[tokens - 1] >= 2) & (count[tokens] >= 1)]


def _first_of_each(numbers: np.ndarray, n: int) -> np.ndarray:
    """Place of the first of each number there is below ``n``."""
    first = np.full(n, -1)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    return first[first >= 0]


def ask_counts(row: dict, replies: list[dict], levels: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """How often the n-grams of ``levels`` words occur in the chunk's training texts, from the answers of the round before."""
    c, out = Chunk(row, [], int(1 in levels)), []
    if 1 in levels:
        out += [(m - 1, c.keys[m - 1], np.bincount(c.of[m - 1][c.train[c.tokens[m - 1]]], minlength=len(c.keys[m - 1]))) for m in levels]
        tokens = c.tokens[1]
    else:
        m = levels[0]
        bits = next(r["answers"] for r in replies if r["kind"] == ASKED)
        asked = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(c.tok)))
        _, of = _inverse(c.hashes(asked, m - 1))
        count = np.zeros(len(c.tok))
        count[asked] = _answers(replies, m - 2)[0][of]
        tokens = _go_on(asked, count, c.at, m - 1)
        keys, of = _inverse(c.hashes(tokens, m))
        out.append((m - 1, keys, np.bincount(of[c.train[tokens]], minlength=len(keys))))
    bits = np.zeros(len(c.tok), bool)
    bits[tokens] = True
    return [*out, (ASKED, np.packbits(bits), np.zeros(0))]


def ask_retained(row: dict, replies: list[dict], levels: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return Chunk(row, replies, levels[-1] + 1).ask_retained(levels)


def _answers(replies: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers of a kind in the order of the chunk's keys; of counts also whether the chunk sends the n-gram's share."""
    own = sorted((r for r in replies if r["kind"] == kind), key=lambda r: r["part"])
    got = np.concatenate([unpack(r["answers"], _answer_type(kind)) for r in own]) if own else np.zeros(0, _answer_type(kind))
    sends = np.concatenate([np.unpackbits(np.frombuffer(r["sends"] or b"", np.uint8), count=len(r["answers"]) // 8) for r in own]) if own and kind < RETAINED else np.zeros(0, np.uint8)
    return got, sends.astype(bool)


def _inverse(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the number of each key's among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], of


def _tokenise(rows: DataFrame, kind: str) -> DataFrame:
    """One row per chunk of texts: ids, held flags, token numbers and vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, (batch, texts) in enumerate(blocks(batches, "_text", CHUNK_BYTES, 100_000)):
            data, offsets = join_texts(texts)
            starts, ends = word_spans(data)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            tokens = np.full(len(starts) + len(texts), np.uint64(END))
            tokens[np.arange(len(starts)) + owner] = span_hash(prefix_sums(data), starts, ends) >> np.uint64(8)
            vocab, of = _inverse(tokens)
            lens = np.bincount(owner, minlength=len(texts)) + 1
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if t is None else pa.array([x], t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + number]), one(batch.column(0), None), one(batch.column(1), None), one(pa.array(lens), None),
                 one(_pack_keys(vocab), pa.binary()), one(pack(of.astype(np.uint32)), pa.binary())],
                names=["chunk", "ids", "held", "lens", "vocab", "tokens"])

    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, lens array<long>, vocab binary, tokens binary")


def _count_type(kind: int) -> type:
    """How a chunk's counts (at most its tokens) and partial divergences are sent."""
    return np.uint32 if kind < RETAINED else np.float64


def _answer_type(kind: int) -> type:
    """How corpus totals and whether a context is retained are answered."""
    return np.uint64 if kind < RETAINED else np.uint8


_REPLY = "chunk long, kind int, part int, answers binary, sends binary, n long, v long"


def _total(asked: pa.Table) -> pa.Table:
    """The corpus totals of what chunks sent of one kind and part, in the order of each chunk's keys."""
    rows = asked.to_pylist()
    kind = rows[0]["kind"]
    if kind == ASKED:
        return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "part": asked["part"], "answers": asked["keys"], "sends": pa.nulls(len(rows), pa.binary()),
                         "n": [0] * len(rows), "v": [0] * len(rows)})
    keys = [_unpack_keys(r["keys"]) for r in rows]
    sizes = np.cumsum([len(k) for k in keys])
    counts = np.concatenate([unpack(r["counts"], _count_type(kind)) for r in rows])
    distinct, of = _inverse(np.concatenate(keys))
    sums = np.bincount(of, weights=counts.astype(float), minlength=len(distinct))
    sends = np.zeros(len(of), bool)
    if kind < RETAINED:
        there = np.flatnonzero(counts)
        sends[there[_first_of_each(of[there], len(distinct))]] = True
    answers = sums if kind < RETAINED else sums > GAIN
    # Of words: occurrences and kinds; of longer n-grams: those that recur.
    n, v = (int(sums.sum()), int((sums > 0).sum())) if kind == 0 else (0, int((sums >= 2).sum()) if kind < RETAINED else 0)
    own = np.split(answers.astype(_answer_type(kind))[of], sizes[:-1])
    return pa.table({"chunk": [r["chunk"] for r in rows], "kind": pa.array([kind] * len(rows), pa.int32()), "part": pa.array([r["part"] for r in rows], pa.int32()),
                     "answers": pa.array([pack(a) for a in own], pa.binary()),
                     "sends": pa.array([np.packbits(x).tobytes() for x in np.split(sends, sizes[:-1])], pa.binary()), "n": [n] * len(rows), "v": [v] * len(rows)})


def _round(chunks: DataFrame, replies: DataFrame, ask: Callable, levels: list[int], parts: int) -> DataFrame:
    """The replies to what ``ask`` asks of ``levels``, for all chunks."""

    def send(chunk: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            for kind, keys, counts in ask(row, got.to_pylist(), levels):
                if kind == ASKED:
                    out.append({"chunk": row["chunk"], "kind": kind, "part": row["chunk"] % parts, "keys": keys.tobytes(), "counts": b""})
                    continue
                counts = counts.astype(_count_type(kind))
                owner = ((keys >> np.uint64(24)) * np.uint64(parts)) >> np.uint64(32)
                cut = np.searchsorted(owner, np.arange(parts + 1))
                out += [{"chunk": row["chunk"], "kind": kind, "part": p, "keys": _pack_keys(keys[cut[p]:cut[p + 1]]), "counts": pack(counts[cut[p]:cut[p + 1]])}
                        for p in range(parts)]
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    asked = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, "chunk long, kind int, part int, keys binary, counts binary")
    return asked.groupBy("kind", "part").applyInArrow(_total, _REPLY)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of ended rounds now: it does so when the driver collects its garbage, else every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", max_context: int = 2) -> DataFrame:
    """(id_col, held_col, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows whose ``held_col`` is not true. Scores are log10 probabilities of the whole text: its words and
    one end. Null and empty texts have the end alone. Repeated rows count each time and have equal scores; without training rows
    every token has the root's law over nothing (score 0). An empty table gives no rows. Contexts have at most ``max_context`` words;
    longer n-grams are counted until no context recurs.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(held_col), F.lit(False)).alias("_held"), F.col(text_col).cast("string").alias("_text"))
    # Bucketed by chunk, so each round moves the replies to the chunks and never the chunks.
    name = f"lm_chunks_{uuid.uuid4().hex}"
    path = os.path.join(checkpoint_dir(spark), "pitchside-stage", name)
    _tokenise(rows, kind).write.bucketBy(parts, "chunk").option("path", path).saveAsTable(name)
    chunks = spark.table(name)
    last = spark.createDataFrame([], _REPLY)
    counts, asked, m = [], [1, 2], 2
    while True:
        last = stage(_round(chunks, last, ask_counts, asked, parts), "ask_counts")
        counts.append(last.filter(F.col("kind") != ASKED))
        drop_shuffles(spark)
        recurs = last.filter(F.col("kind") == m - 1).agg(F.max("v")).first()[0]
        if m > max_context or not recurs:
            break
        m += 1
        asked = [m]
    # n-grams of up to m words are counted: contexts have up to m - 1.
    retained = []
    cuts = [1, *range(1 + FIRST_LENGTHS, m, LENGTHS), m]
    for k, end in zip(cuts, cuts[1:], strict=False):
        levels = list(range(k, end))
        known = reduce(DataFrame.union, counts).filter(F.col("kind") <= levels[-1])
        retained.append(stage(_round(chunks, known, ask_retained, levels, parts), "ask_retained"))
        drop_shuffles(spark)
    replies = reduce(DataFrame.union, counts + retained)

    def score(chunk: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for row, ids in zip(chunk.to_pylist(), chunk.column("ids"), strict=True):
            c = Chunk(row, got.to_pylist())
            known, base, found = c.scores()
            out.append(pa.table({id_col: ids.values, held_col: pa.array(row["held"], pa.bool_()), "n_tokens": c.lens, "n_known": known,
                                 "train_tokens": np.full(len(known), c.total), "base_score": base, "score": found}))
        return pa.concat_tables(out) if out else pa.schema([]).empty_table()

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        score, f"`{id_col}` {kind}, `{held_col}` boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


