"""Similarity links between distinct items by banded signatures: candidates, exact checks, components.

Items meet in the bands of their signatures. No large bucket is paired off: every member is a candidate of
CENTRES members chosen by hash (``min_by``, so a bucket that holds a third of the items is aggregated
map-side first); only buckets of at most SMALL members are compared whole. Candidates are dropped
when their signatures rule the threshold out by MARGIN standard errors. Round 1 checks each item
exactly against its likeliest candidate and unites the links. Components that likely pairs still connect form
families; in round 2 the members of a family that lie in different components are compared among themselves,
first by size and signature, then exactly, so no link of a family is lost because neither text was a centre. What is
left out: a pair that shares only large buckets, and whose centres the signatures rule out for one of the two. Families are compared
inside the tasks, by pairs of blocks of at most BLOCK members, and only links that unite two components leave
them: neither a large family nor its pairs are ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.components import components
from pitchside.sources.stage import stage

CENTRES = 2
SMALL = 6
MARGIN = 4.5
BLOCK = 500


def _likely(pairs: DataFrame, signatures: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b, est) whose share of equal signature bytes does not rule the threshold out."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / size) ** 0.5

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, size) for i in (2, 3))
            est = (left == right).mean(axis=1)
            keep = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(est[est >= least])], names=["a", "b", "est"])

    both = pairs.join(signatures.select(F.col("c").alias("a"), F.col("sig").alias("sa")), "a") \
        .join(signatures.select(F.col("c").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long, est double")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs run inside pass ``rows`` rows at a time to Python: a pair carries two whole payloads."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def confirm(pairs: DataFrame, held: DataFrame, similar: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (a, b) whose payloads are similar; ``held`` has one (c, payload) per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = pa.array([similar(x.as_py(), y.as_py()) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    both = pairs.select("a", "b").join(held.select(F.col("c").alias("a"), F.col("payload").alias("pa")), "a") \
        .join(held.select(F.col("c").alias("b"), F.col("payload").alias("pb")), "b")
    return both.select("a", "b", "pa", "pb").mapInArrow(run, "u long, v long")


def link(items: DataFrame, size: int, threshold: float, payloads: Callable[[DataFrame], DataFrame],
         similar: Callable[[bytes, bytes], bool]) -> DataFrame:
    """(c, root) of all items that take part in a link: components of the pairs for which ``similar`` holds.

    ``items``: staged table (c long, distinct; sig binary of ``size`` bytes; bands array<long>). ``payloads`` gets a table (c)
    and gives (c, payload binary); ``similar`` compares two payloads exactly.
    """
    member = items.select("c", F.explode("bands").alias("band"))
    # A bucket of one item has no pair. Small buckets are compared whole, others with their centres.
    centre = [F.min_by("c", F.xxhash64(F.lit(j), "c")).alias(f"m{j}") for j in range(CENTRES)]
    shared = member.groupBy("band").agg(F.count("*").alias("n"), *centre).filter("n > 1")
    # Staged, so the join has an exchange of its own and a bucket that very many items share can be split.
    shared = stage(shared, "shared-bands")
    members = stage(member.join(shared, "band"), "buckets")
    signatures = items.select("c", "sig")
    centres = members.select("c", F.explode(F.array(*[f"m{j}" for j in range(CENTRES)])).alias("m")).filter("c <> m")
    small = members.filter(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    both = small.select(F.explode("cs").alias("c"), "cs").select("c", F.explode("cs").alias("m")).filter("c > m")
    pairs = centres.union(both).select(F.greatest("c", "m").alias("a"), F.least("c", "m").alias("b")).distinct()
    likely = stage(_likely(pairs, signatures, size, threshold), "likely")
    involved = likely.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    held = stage(payloads(involved), "payloads")

    # Round 1: each item against its likeliest candidate.
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    with small_batches(items.sparkSession):
        links = stage(confirm(best, held, similar), "links")
    roots = stage(components(links).withColumnRenamed("node", "c"), "roots")
    # Round 2: families, that is components joined by likely pairs that are not linked yet.
    rooted = likely.select("a", "b")
    for c in ("a", "b"):
        rooted = rooted.join(roots.select(F.col("c").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    apart = rooted.filter("ra <> rb").select(F.col("ra").alias("u"), F.col("rb").alias("v"))
    families = stage(components(apart), "families")
    members = held.select("c", "payload").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")) \
        .join(families.select(F.col("node").alias("root"), F.col("root").alias("family")), "root").join(signatures, "c")
    sizes = members.groupBy("family").count().select("family", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.pmod(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")), F.lit(_parts(items)))
    placed = placed.select(key.alias("part"), "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "root", "sig", "payload")
    more = placed.groupBy("part").applyInArrow(_family_links(size, threshold, similar), "u long, v long")
    return components(links.union(more)).select(F.col("node").alias("c"), "root")


def _parts(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _family_links(size: int, threshold: float, similar: Callable[[bytes, bytes], bool]) -> Callable[[pa.Table], pa.Table]:
    """Links between different components within pairs of blocks of families; pairs are compared in the task and only links leave it."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / size) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("i", "ascending"), ("j", "ascending"), ("c", "ascending")])
        family, i, j, block, c, root = (table.column(x).to_numpy() for x in ("family", "i", "j", "block", "c", "root"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, size)
        payload = table.column("payload").to_pylist()
        length = np.array([len(p) for p in payload])
        found: list[tuple[int, int]] = []
        if not len(c):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        cuts = np.flatnonzero(np.append(True, (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        for start, stop in zip(cuts, np.append(cuts[1:], len(c)), strict=True):
            head = {int(r): int(r) for r in root[start:stop]}

            def find(x: int, head: dict[int, int] = head) -> int:
                while head[x] != x:
                    head[x] = head[head[x]]
                    x = head[x]
                return x

            two_blocks = i[start] != j[start]
            for x in range(start, stop):
                rest = slice(x + 1, stop)
                may = (root[rest] != root[x]) & (np.minimum(length[rest], length[x]) >= threshold * np.maximum(length[rest], length[x]))
                if two_blocks:
                    may &= block[rest] != block[x]
                near = x + 1 + np.flatnonzero(may)
                est = (sig[near] == sig[x]).mean(axis=1)
                for y in near[est >= least][np.argsort(-est[est >= least], kind="stable")]:
                    a, b = find(int(root[x])), find(int(root[y]))
                    if a != b and similar(payload[x], payload[y]):
                        head[max(a, b)] = min(a, b)
                        found.append((int(c[x]), int(c[y])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run
