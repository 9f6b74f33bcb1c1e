"""Operator 9: near-duplicate documents by SuperMinHash, banding, exact checks and union-find.

SuperMinHash gives every shingle a random permutation of the signature's SIZE places, drawn step by
step: at step j it puts the rank j + (random fraction) into place p[j]. The ranks of a shingle are
correlated, which lowers the variance of the estimate, and a document is done as soon as the greatest
rank in its signature is below the next step: long documents need one or two steps.

1. One pass over the texts gives each document its distinct shingles' number, a hash of its set, and a
   signature. Documents with equal sets are one class, by a map-side reduced ``groupBy``.
2. ``linking.link`` finds, checks on the full sets and unites classes. Only classes with a
   likely partner have their sets built again, from the text of one document each.
3. Every document takes the smallest doc_id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.joins import broadcast_if_small
from pitchside.llm.linking import link
from pitchside.llm.text import blocks, join_texts, mix, prefix_sums, span_hash, word_spans
from pitchside.sources.stage import stage

SIZE, ROWS = 64, 4
SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word shingle, owner text of each); a text of fewer words is one shingle, of none has none."""
    data, offsets = join_texts(texts)
    starts, ends = word_spans(data)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    h = span_hash(prefix_sums(data), starts, ends)
    first = np.searchsorted(starts, offsets[:-1])
    count = np.diff(np.append(first, len(starts)))
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        full = mix(full * np.uint64(31) + h[i: i + len(full)] + np.uint64(i + 1))
    inside = owner[: len(full)] == owner[width - 1: width - 1 + len(full)]
    out_h, out_o = [full[inside]], [owner[: len(full)][inside]]
    short = np.flatnonzero((count > 0) & (count < width))
    acc = np.zeros(len(short), np.uint64)
    for i in range(width - 1):
        has = count[short] > i
        acc[has] = mix(acc[has] * np.uint64(31) + h[first[short[has]] + i] + np.uint64(i + 1))
    return np.concatenate([*out_h, mix(acc + count[short].astype(np.uint64))]), np.concatenate([*out_o, short])


def distinct_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted text by text; offset of each text, one more at the end)."""
    h, owner = shingle_hashes(texts, width)
    order = np.argsort(owner, kind="stable")
    h, at = h[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    sets = []
    for i in range(len(texts)):
        s = np.sort(h[at[i]: at[i + 1]])
        sets.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else h), offsets


def signatures(elements: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of each set: ``size`` numbers, the step in the upper 16 bits and the fraction below."""
    n = len(offsets) - 1
    sig = np.full(n * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    perm: np.ndarray | None = None
    for j in range(size):
        draw = mix(elements + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        pick = j + ((draw >> np.uint64(32)) % np.uint64(size - j)).astype(np.int64)
        if perm is None:
            place = pick
        else:
            lines = np.arange(len(perm))
            place = perm[lines, pick].astype(np.int64)
            perm[lines, pick] = perm[:, j]
        rank = (np.uint64(j) << np.uint64(48)) | (mix(draw) >> np.uint64(16))
        np.minimum.at(sig, owner * size + place, rank)
        # Stop where no later rank can be smaller than any in the signature.
        open_sets = (sig.reshape(n, size).max(axis=1) >> np.uint64(48)) > np.uint64(j)
        keep = open_sets[owner]
        if not keep.any():
            break
        if perm is None:
            elements, owner, place = elements[keep], owner[keep], place[keep]
            perm = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
            perm[np.arange(len(perm)), place] = 0
            perm[:, 0] = place
        elif not keep.all():
            elements, owner, perm = elements[keep], owner[keep], perm[keep]
    return sig.reshape(n, size)


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash per band of ``rows`` places; equal only for the same band."""
    n, size = sig.shape
    out = np.zeros((n, size // rows), np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(31) + sig[:, i: size // rows * rows: rows])
    return mix(out + np.arange(size // rows, dtype=np.uint64))


def _set_hash(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set (order-free sum of mixed elements, and the set's size)."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(elements ^ _STEP))])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * _STEP)


def jaccard_at_least(numerator: int, denominator: int):
    """A test of two payloads (sorted 64-bit hashes): denominator * intersection >= numerator * union."""

    def similar(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = np.sort(np.concatenate([x, y]))
        common = int((both[1:] == both[:-1]).sum())
        return denominator * common >= numerator * (len(x) + len(y) - common)

    return similar


def _groups(df: DataFrame, id_col: str, text_col: str, numerator: int, denominator: int) -> DataFrame:
    """(id, r, n, root, component_id) of every row: r is a hash of its text, n its shingles, root its group (null without id or shingles)."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(text_col).alias("_r"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "_text", 1 << 20, 10_000):
            elements, offsets = distinct_sets(texts)
            sig = signatures(elements, offsets)
            bands = band_hashes(sig).view(np.int64)
            low = np.ascontiguousarray(sig.astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(offsets)), pa.array(_set_hash(elements, offsets).view(np.int64)),
                 pa.array([r.tobytes() for r in low], pa.binary()),
                 pa.ListArray.from_arrays(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1], pa.array(bands.ravel()))],
                names=["id", "r", "n", "c", "sig", "bands"])

    seen = stage(rows.mapInArrow(describe, "id long, r long, n long, c long, sig binary, bands array<long>"), "signatures")
    named = seen.filter("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("c").agg(F.min("id").alias("id"))
    # Signatures of a class are equal, so one document stands for it.
    items = stage(named.join(classes, ["c", "id"], "left_semi").dropDuplicates(["c"]).select("c", "id", "sig", "bands"), "classes")

    def sets(wanted: DataFrame) -> DataFrame:
        which = broadcast_if_small(stage(items.select("c", "id").join(wanted, "c"), "wanted"))
        texts = rows.join(which, F.col("_id") == F.col("id")).select("c", "_text")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, raw in blocks(batches, "_text", 1 << 20, 10_000):
                elements, offsets = distinct_sets(raw)
                # An id may stand in several rows with different texts: only the class's own set is its payload.
                own = np.flatnonzero(_set_hash(elements, offsets).view(np.int64) == batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), pa.array([elements[offsets[i]: offsets[i + 1]].tobytes() for i in own], pa.binary())], names=["c", "payload"])

        return texts.mapInArrow(build, "c long, payload binary")

    linked = link(items, SIZE, numerator / denominator, sets, jaccard_at_least(numerator, denominator))
    ids = items.select("c", "id").join(linked, "c")
    least = broadcast_if_small(stage(ids.groupBy("root").agg(F.min("id").alias("component_id")), "least-ids"))
    placed = ids.join(least, "root").select("c", "root", "component_id").union(
        items.select("c", "id").join(linked, "c", "left_anti").select("c", F.col("c").alias("root"), F.col("id").alias("component_id")))
    placed = stage(placed, "components")
    named = F.col("n") > 0
    found = seen.select("id", "r", "n", "c").join(placed, "c", "left")
    component = F.when(F.col("id").isNotNull(), F.when(named, F.col("component_id")).otherwise(F.col("id")))
    return found.select("id", "r", "n", F.when(named & F.col("id").isNotNull(), F.col("root")).alias("root"), component.alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 85, denominator: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    Rows are linked when denominator * |A and B| >= numerator * |A or B| for their sets of 5-word shingles; component_id is the
    smallest id reachable and ``kept`` tells whether it is the row's own. Null, empty and wordless texts have an empty set and are
    linked with nothing. Repeated rows are in one component (of one id, all kept). Ids are whole numbers; a row with a null id has no
    component (null) and is kept. An empty table gives no rows. Classes are told apart by 64-bit hashes of their sets.
    """
    kind = df.schema[id_col].dataType.simpleString()
    found = _groups(df, id_col, text_col, numerator, denominator)
    return found.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 85, denominator: int = 100) -> DataFrame:
    """All columns of the rows of ``df`` that stay when one row of every group of near duplicates does: that of the smallest id.

    Of several texts of that id the one with the least hash stays, of fully repeated rows (id and text) one. A row that only shares
    its id with a near duplicate stays, and so do rows with a null id and texts without words, repeated or not.
    """
    found = stage(_groups(df, id_col, text_col, numerator, denominator).filter("root IS NOT NULL").select("id", "r", "root"), "group-members")
    first = stage(found.groupBy("root").agg(F.min(F.struct("id", "r")).alias("first")), "group-firsts")
    gone = found.join(first, "root").filter((F.col("id") != F.col("first.id")) | (F.col("r") != F.col("first.r"))).select("id", "r").distinct()
    again = stage(found.groupBy("id", "r").count().filter("count > 1").select("id", "r"), "repeated-rows")
    # Two hashed texts can only be confused within one id.
    key = lambda of: (F.col(id_col).cast("long") == of["id"]) & (F.xxhash64(text_col) == of["r"])
    gone = broadcast_if_small(stage(gone, "near-duplicates"))
    kept = df.join(gone, key(gone), "left_anti")
    if again.isEmpty():
        return kept
    # Partial aggregation leaves one of a task's repeated rows before the exchange.
    again = broadcast_if_small(again)
    one = kept.join(again, key(again), "left_semi").withColumn("_r", F.xxhash64(text_col)).dropDuplicates([id_col, "_r"]).drop("_r")
    return kept.join(again, key(again), "left_anti").unionByName(one)
