"""Operator 11: vector codes by Lloyd's rounds that look only at active entries.

Every vector is cut into equal parts; each part position has a codebook of its own and a part's code is the index of
its nearest entry. A round assigns every part and then replaces each entry by the mean of its parts. Codes and exact
squared distances are stored between rounds. An entry is active if the last update moved it:

* a part whose own entry stayed fixed knows that no fixed entry beats the stored one (it won against all of them), so it
  compares only the active entries against the stored exact distance;
* a part whose own entry moved compares all entries.

Both keep the rule that ties go to the lower index. All numbers are integers, so the codes are those of full rescans.

A round is one narrow pass that writes codes and distances to the shared folder and one aggregate of a row per task, entry
and component; the driver holds the codebooks alone (parts x entries x width). Rows are never shuffled but for sums of labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions.joins import salted_lookup
from pitchside.llm.vectors import integer_matrix, integer_vectors
from pitchside.sources.stage import Staging, stage

#: Rows assigned at once in a task: distances of one part position to all entries stay at a few MB.
ROWS = 4096


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``entries``."""
    total = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        total += (x[:, j, None] - entries[None, :, j]) ** 2
    return total


def reassign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and distances of the parts ``x`` after the entries marked in ``moved`` have moved, and how many parts were rescanned."""
    code, dist = code.copy(), dist.copy()
    active = np.flatnonzero(moved)
    fixed, lost = np.flatnonzero(~moved[code]), np.flatnonzero(moved[code])
    if len(active) and len(fixed):
        d = distances(x[fixed], entries[active])
        best = d.argmin(axis=1)
        d, best = d[np.arange(len(fixed)), best], active[best]
        win = (d < dist[fixed]) | ((d == dist[fixed]) & (best < code[fixed]))
        code[fixed[win]], dist[fixed[win]] = best[win], d[win]
    if len(lost):
        d = distances(x[lost], entries)
        code[lost] = d.argmin(axis=1)
        dist[lost] = d[np.arange(len(lost)), code[lost]]
    return code, dist, len(lost)


def _assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """(id, label, v, code, dist) for the codebooks ``books`` (part, entry, component); ``moved`` None: no codes are stored yet."""
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = integer_matrix(batch.column(2)).reshape(-1, parts, width)
                if moved is None:
                    code, dist = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
                else:
                    code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                    dist = integer_matrix(batch.column(4))
                for p in range(parts):
                    changed = np.ones(len(books[p]), bool) if moved is None else moved[p]
                    code[:, p], dist[:, p], _ = reassign(x[:, p], code[:, p], dist[:, p], books[p], changed)
                packed = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(dist.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, found], names=["id", "label", "v", "code", "dist"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(assign, f"id {kind['id']}, label {kind['label']}, v array<int>, code binary, dist array<bigint>")


def _moved_to(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after every used entry went to the floor of the mean of its parts."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = integer_matrix(batch.column(0)).reshape(-1, parts, width)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                    for j in range(width):   # below 2^53 by ROWS and LARGEST, so exact in double precision
                        sums[p, :, j] += np.bincount(code[:, p], weights=x[:, p, j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(counts)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), listed], names=["p", "e", "n", "s"])

    each = state.select("v", "code").mapInArrow(add, "p int, e int, n bigint, s array<bigint>")
    totals = each.groupBy("p", "e").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
    new = books.copy()
    for row in totals.collect():   # at most parts x entries rows, whatever the table
        new[row.p, row.e] = [int(row[f"s{j}"]) // row.n for j in range(width)]
    return new


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16,
                 entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error), codebooks): a byte an entry index, part by part, and the summed squared distance.

    Codebooks start as the parts of the ``entries`` rows of the smallest ids (ties: smaller vector first; null ids last;
    fewer rows: fewer entries). ``integer_vectors`` states which rows take part; repeated rows and ids count each time. A
    length that ``parts`` does not divide is an error. An empty table: no rows and empty codebooks. The columns of
    ``df`` but the three named are not read. An entry without parts stays where it is.
    """
    if entries > 256:
        raise ValueError("a code holds an entry in one byte: at most 256 entries")
    temporary = Staging()
    kept = integer_vectors(df, id_col, vec_col, F.col(label_col))
    kept = temporary.stage(kept, "code-vectors")
    first = np.array([r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()], np.int64)
    if not len(first):
        empty = kept.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    if first.shape[1] % parts:
        raise ValueError(f"vectors of {first.shape[1]} components cannot be cut into {parts} equal parts")
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    state, moved = kept, None
    for _ in range(rounds):
        owner = Staging()
        state = owner.stage(_assign(state, books, moved), "codes")
        temporary.close()   # the state before is no longer read
        temporary = owner
        new = _moved_to(state, books)
        moved, books = (new != books).any(axis=2), new
    final = _assign(state, books, moved)
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x)
    final = stage(final.select("id", "label", "code", error.alias("error")), "final-codes")
    temporary.close()
    return final, books


def codebook_digest(books: np.ndarray) -> str:
    """sha256 of all components in the order part, entry, position, as decimal numbers with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows of an equal label, null labels together."""
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = codes.withColumn("_key", key)
    totals = keyed.groupBy(F.col("_key").alias("_of")).agg(F.sum("error").alias("label_error"))
    return salted_lookup(keyed, totals, "_key", "_of", "id").drop("_key", "_of")
