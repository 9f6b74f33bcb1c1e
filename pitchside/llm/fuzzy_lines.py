"""Operator 2: fuzzy line dedup by MinHash.

A line is a maximal run without line ends, compared in lower case with white space joined and trimmed.
Lines of at least MIN_CHARS bytes take part (shorter ones recur by chance, not by copying). Equal
lines are one class by a map-side reduced ``groupBy``; the signature of a distinct line is a MinHash
of its byte shingles with one permutation in SIZE bins (empty bins borrow from the next full one). The texts are
read once: a block of texts keeps its bands packed, asks once per band which others have it, and only
bands that several lines share become rows. Lines that
share a band are compared by exact Jaccard on the full shingle sets, first each with its band's centre, then
those that still lie in different components with each other, and distributed union-find
unites them (``components``). One line per component stays: the first by (document, line number); every
other one is removed from its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchside.llm.components import components
from pitchside.llm.joins import broadcast_if_small
from pitchside.llm.superminhash import band_hashes
from pitchside.llm.text import blocks, join_texts, mix, prefix_sums, span_hash
from pitchside.sources.stage import stage

MIN_CHARS = 16
SHINGLE = 8
SIZE, ROWS = 48, 4
THRESHOLD = (80, 100)
#: Lines of a bucket compared at a time, and their bytes.
BLOCK, BLOCK_BYTES = 500, 1 << 18
#: Bands that one group of the exchange counts, about; the number of groups follows the data.
PART_BANDS = 1 << 20


def split_lines(text: bytes) -> list[bytes]:
    """The lines of a text with their ends, so that joining them gives the text again."""
    return text.splitlines(keepends=True)


def plain(line: bytes) -> bytes:
    """What is compared: lower case A-Z, white space joined and trimmed."""
    return b" ".join(line.lower().split())


def line_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(every byte shingle, owner line): a shingle is its SHINGLE = 8 bytes as one number, so equal numbers are equal shingles."""
    data, offsets = join_texts(lines, lower=False)
    if len(data) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = np.lib.stride_tricks.sliding_window_view(data, SHINGLE).copy().view(np.uint64).ravel()
    sizes = np.diff(offsets)
    inside = np.ones(len(data), bool)
    for back in range(1, SHINGLE + 1):   # a line's last bytes and its end start no shingle
        inside[(offsets[1:] - back)[sizes >= back]] = False
    return values[inside[: len(values)]], np.repeat(np.arange(len(lines)), np.maximum(sizes - SHINGLE, 0))


def minhash(lines: list[bytes], size: int = SIZE) -> np.ndarray:
    """One-permutation MinHash: the least hash of each of ``size`` bins; an empty bin takes the next full one's, mixed with the way."""
    values, owner = line_shingles(lines)
    n, half = len(lines), np.uint64(32)
    h = mix(values)
    place = ((h >> half) * np.uint64(size) >> half).astype(np.int64)   # the bin by the upper half, the order within by the lower one first
    place += owner * size
    sig = np.full(n * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(sig, place, (h << half) | (h >> half))
    sig = sig.reshape(n, size)
    empty = sig == np.uint64(0xFFFFFFFFFFFFFFFF)
    out, todo = sig.copy(), empty & ~empty.all(axis=1, keepdims=True)
    for way in range(1, size):
        if not todo.any():
            break
        source = np.roll(sig, -way, axis=1)
        take = todo & ~np.roll(empty, -way, axis=1)
        out[take] = mix(source[take] + np.uint64(way))
        todo &= ~take
    return out


def line_similar(a: bytes, b: bytes) -> bool:
    """Exact Jaccard similarity of two lines' sets of shingles."""
    x, y = ({t[i: i + SHINGLE] for i in range(len(t) - SHINGLE + 1)} for t in (a, b))
    common = len(x & y)
    return THRESHOLD[1] * common >= THRESHOLD[0] * (len(x) + len(y) - common)


def similar_pairs(left: list[bytes], right: list[bytes]) -> list[bool]:
    """``line_similar`` of each pair; the shingles of a line that several pairs name are made once."""
    index = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    lines = list(index)
    values, owner = line_shingles(lines)
    ends = np.searchsorted(owner, np.arange(len(lines) + 1))
    sets = [_distinct(np.sort(values[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = sets[index[a]], sets[index[b]]
        both = np.concatenate((x, y))
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(THRESHOLD[1] * common >= THRESHOLD[0] * (len(x) + len(y) - common))
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    if len(values) < 2:
        return values
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values if new.all() else values[new]


def _confirmed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (a, b) whose lines are similar, compared by blocks of about BLOCK_BYTES bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES, prepend=-1))
            for start, stop in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                part = batch.slice(start, stop - start)
                keep = pa.array(similar_pairs(part.column(2).to_pylist(), part.column(3).to_pylist()), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["u", "v"])

    both = pairs.select("a", "b").join(held.select(F.col("c").alias("a"), F.col("payload").alias("pa")), "a") \
        .join(held.select(F.col("c").alias("b"), F.col("payload").alias("pb")), "b")
    return both.select("a", "b", "pa", "pb").mapInArrow(run, "u long, v long")


def _line_hash(lines: list[bytes]) -> np.ndarray:
    data, offsets = join_texts(lines, lower=False)
    return span_hash(prefix_sums(data), offsets[:-1], offsets[1:] - 1).view(np.int64)


def _compared(texts: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
    """(plain line, index of its text, line number) of the lines that take part."""
    lines, owner, number = [], [], []
    for i, text in enumerate(texts):
        for j, line in enumerate(split_lines(text)):
            p = plain(line)
            if len(p) >= MIN_CHARS:
                lines.append(p)
                owner.append(i)
                number.append(j)
    return lines, owner, number


def _scan(rows: DataFrame) -> DataFrame:
    """All that the texts are read for: rows (c, id, line) of every line that takes part, and a row (block, cs, bands) per block of texts.

    ``cs`` are the block's distinct lines and ``bands`` the bands of each of them in turn, as packed 64-bit numbers. Columns of the other kind are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number_of = ["c", "id", "line", "block", "cs", "bands"], 0
        for batch, texts in blocks(batches, "_text", 1 << 20, 20_000):
            lines, owner, number = _compared(texts)
            if not lines:
                continue
            c = _line_hash(lines)
            none = [pa.nulls(len(c), t) for t in (pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c), batch.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), *none], names=names)
            c, first = np.unique(c, return_index=True)
            bands = band_hashes(minhash([lines[i] for i in first]), ROWS)
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32())]
            block = (TaskContext.get().partitionId() << 32) + number_of
            yield pa.RecordBatch.from_arrays([*none, pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (c, bands))], names=names)
            number_of += 1

    return rows.mapInArrow(run, "c long, id long, line int, block long, cs binary, bands binary")


def _unpacked(cs: bytes, bands: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, line, position of each band's first row) of a block, rows in order of band."""
    c, band = np.frombuffer(cs, np.int64), np.frombuffer(bands, np.uint64)
    order = np.argsort(band, kind="stable")
    band, c = band[order], np.repeat(c, len(band) // len(c))[order]
    return band, c, np.flatnonzero(np.append(True, band[1:] != band[:-1]))


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value per run of ``values`` from a cut to the next."""
    ends = np.append(cuts, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _centre_key(c: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A band's centre is its line of least key, so a line meets another centre in each band."""
    return mix(c.view(np.uint64) ^ band)


def _shared_bands(table: pa.Table) -> pa.Table:
    """(block, bands, centres) of the bands of one group that several distinct lines have; the group has one line a block and band."""
    counts = np.array([len(x) // 8 for x in table.column("cs").to_pylist()], np.int64)
    band, c, several = (np.frombuffer(b"".join(table.column(x).to_pylist()), kind) for x, kind in (("bands", np.uint64), ("cs", np.int64), ("several", bool)))
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(band, kind="stable")
    band, c, several, row = band[order], c[order], several[order], row[order]
    new = np.append(True, band[1:] != band[:-1])
    often = several | ~(new & np.append(new[1:], True))   # what else is alone in its band goes first
    band, c, several, row = band[often], c[often], several[often], row[often]
    blocks_out, bands_out, centres_out = np.zeros(0, np.int64), pa.array([], pa.binary()), pa.array([], pa.binary())
    if len(band):
        first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        size = np.diff(np.append(first, len(band)))
        key = _centre_key(c, band)
        least = np.repeat(np.minimum.reduceat(key, first), size)
        centre = np.repeat(c[key == least][np.append(True, band[key == least][1:] != band[key == least][:-1])], size)
        keep = np.repeat(np.logical_or.reduceat(several, first) | (np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)), size)
        band, centre, row = band[keep], centre[keep], row[keep]
        order = np.argsort(row, kind="stable")
        band, centre, row = band[order], centre[order], row[order]
        cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        blocks_out, bands_out, centres_out = table.column("block").to_numpy()[row[cuts]], _packed(band, cuts), _packed(centre, cuts)
    return pa.table({"block": pa.array(blocks_out, pa.int64()), "bands": bands_out, "centres": centres_out})


def _members(block: pa.Table, shared: pa.Table) -> pa.Table:
    """(band, cs, centre) of a block's bands that several lines share."""
    bands, centres, lists = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.list_(pa.int64()))
    if block.num_rows and shared.num_rows:
        band, c, first = _unpacked(block.column("cs")[0].as_py(), block.column("bands")[0].as_py())
        wanted, centres = (np.frombuffer(b"".join(shared.column(x).to_pylist()), kind) for x, kind in (("bands", np.uint64), ("centres", np.int64)))
        order = np.argsort(wanted, kind="stable")
        bands, centres = wanted[order], centres[order]
        keep = np.repeat(np.isin(band[first], bands, assume_unique=True), np.diff(np.append(first, len(band))))
        band, c = band[keep], c[keep]
        starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(c)).astype(np.int32)), pa.array(c))
    return pa.table({"band": pa.array(bands.view(np.int64)), "cs": lists, "centre": pa.array(centres)})


def _buckets(scan: DataFrame) -> DataFrame:
    """(band, cs, centre) of the bands that several distinct lines share: per block of texts its lines of the band, and the band's centre.

    A block sends a band once, with its own line of least key, so a band that very many lines share is no large
    group; the answers meet the block's lines again by its number.
    """
    packed = scan.filter("block IS NOT NULL").select("block", "cs", "bands")
    total = packed.agg(F.sum(F.octet_length("bands"))).first()[0] or 0
    parts = max(int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (8 * PART_BANDS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cs, bands in zip(*(batch.column(i) for i in range(3)), strict=True):
                band, c, first = _unpacked(cs.as_py(), bands.as_py())
                key = _centre_key(c, band)
                several = np.diff(np.append(first, len(band))) > 1
                for i in np.flatnonzero(several):   # the line of least key comes first
                    j = first[i] + key[first[i]: first[i + 1] if i + 1 < len(first) else len(key)].argmin()
                    c[first[i]] = c[j]
                band, c = band[first], c[first]
                part = (band % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part = part[order]
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(np.full(len(cuts), block.as_py(), np.int64)),
                                                  *(_packed(x[order], cuts) for x in (band, c, several))], names=["part", "block", "bands", "cs", "several"])

    asked = packed.mapInArrow(ask, "part int, block long, bands binary, cs binary, several binary")
    shared = asked.groupBy("part").applyInArrow(_shared_bands, "block long, bands binary, centres binary")
    return packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_members, "band long, cs array<long>, centre long")


def _rest(buckets: DataFrame, held: DataFrame, links: DataFrame) -> DataFrame:
    """Links (u, v) between lines that share a band and lie in different components of ``links``.

    Buckets of two were compared by their centre. A larger one whose lines are not all in one component is compared inside the
    tasks by pairs of blocks of at most about BLOCK lines and BLOCK_BYTES bytes; only links that unite two components leave them.
    """
    spark = buckets.sparkSession
    roots = components(links).withColumnRenamed("node", "c")
    members = buckets.select("band", F.explode("cs").alias("c")).distinct().join(held.select("c", "size"), "c").join(roots, "c", "left")
    # Staged, so the join by band has an exchange of its own and a bucket that very many lines share can be split.
    members = stage(members.withColumn("root", F.coalesce("root", "c")), "line-members")
    several = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = several.filter("n > 2 AND lo <> hi").select("band", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = members.join(broadcast_if_small(stage(several, "open-bands")), "band").withColumn("block", F.pmod(F.xxhash64("c", "band"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("c", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("band", "i", "j"), F.lit(parts)))
    return placed.join(held.select("c", "payload"), "c").groupBy("part").applyInArrow(_bucket_links, "u long, v long")


def _bucket_links(table: pa.Table) -> pa.Table:
    """Links between lines of different components within each (band, i, j)."""
    table = table.sort_by([("band", "ascending"), ("i", "ascending"), ("j", "ascending"), ("c", "ascending")])
    band, i, j, block, c, root = (table.column(x).to_numpy() for x in ("band", "i", "j", "block", "c", "root"))
    payload = table.column("payload")
    us, vs = [], []
    cuts = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(c) else []
    for start, stop in zip(cuts, np.append(cuts[1:], len(c)).astype(int), strict=True):
        kinds, head = np.unique(root[start:stop], return_inverse=True)
        if len(kinds) == 1:
            continue
        lines = payload[start:stop].to_pylist()
        h, owner = line_shingles(lines)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
        h, owner = h[new], owner[new]
        sizes = np.bincount(owner, minlength=len(lines))
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))  # each shingle's lines are owner[first[s]:last[s]]
        last = np.append(first[1:], len(h))
        shingle = np.repeat(np.arange(len(first)), last - first)[np.argsort(owner, kind="stable")]
        at = np.concatenate([[0], np.cumsum(sizes)])
        side = block[start:stop]
        most = np.bincount(head).argmax()  # of two lines in different components one is not in the largest
        for x in np.flatnonzero(head != most):
            own = shingle[at[x]:at[x + 1]]
            own = own[last[own] - first[own] > 1]
            length = last[own] - first[own]
            index = np.repeat(first[own] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            common = np.bincount(owner[index], minlength=len(lines))
            near = THRESHOLD[1] * common >= THRESHOLD[0] * (sizes + sizes[x] - common)
            if i[start] != j[start]:
                near &= side != side[x]
            for y in np.flatnonzero(near & (head != head[x])):
                if head[y] != head[x]:
                    head[head == head[y]] = head[x]
                    us.append(int(c[start + x]))
                    vs.append(int(c[start + y]))
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def removed_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, lines array<int>): per document, the numbers of its lines that repeat a line kept elsewhere (or earlier in it)."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_id IS NOT NULL AND _text IS NOT NULL")
    scan = stage(_scan(rows), "line-scan")
    places = scan.filter("block IS NULL").select("c", "id", "line")
    firsts = places.groupBy("c").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    buckets = stage(_buckets(scan), "line-buckets")
    pairs = buckets.select(F.explode("cs").alias("c"), "centre").filter("c <> centre")
    pairs = stage(pairs.select(F.greatest("c", "centre").alias("a"), F.least("c", "centre").alias("b")).distinct(), "line-pairs")

    wanted = stage(firsts.join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c").select("c", "first.id", "first.line"), "wanted-lines")
    which = wanted.groupBy("id").agg(F.collect_set("line").alias("lines"))  # at most the lines of one document
    texts = rows.join(broadcast_if_small(stage(which, "wanted-documents")), F.col("_id") == F.col("id")).select("lines", "_text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in blocks(batches, "_text", 2 << 20, 20_000):
            found = []
            for text, lines in zip(raw, batch.column(0).to_pylist(), strict=True):
                own = split_lines(text)
                found += [p for j in lines if j < len(own) and len(p := plain(own[j])) >= MIN_CHARS]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(_line_hash(found)), pa.array(found, pa.binary())], names=["c", "payload"])

    held = texts.mapInArrow(pick, "c long, payload binary").groupBy("c").agg(F.min("payload").alias("payload"))
    held = stage(held.withColumn("size", F.octet_length("payload")), "line-payloads")
    links = stage(_confirmed(pairs, held), "line-links")
    linked = components(links.union(_rest(buckets, held, links))).select(F.col("node").alias("c"), "root")
    classes = firsts.join(linked, "c", "left").filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "c"))
    classes = stage(classes.select("c", "root", "first"), "line-classes")
    # Staged, so the join has an exchange of its own and a component that holds very many lines can be split.
    kept = stage(classes.groupBy("root").agg(F.min("first").alias("kept")), "kept-lines")
    marks = stage(classes.join(broadcast_if_small(kept), "root").select("c", "kept"), "line-marks")
    gone = places.join(broadcast_if_small(marks), "c").filter((F.col("id") != F.col("kept.id")) | (F.col("line") != F.col("kept.line")))
    return gone.groupBy("id").agg(F.collect_set("line").alias("lines"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of every row with ``text_col`` without its removed lines, and ``n_lines``, ``n_removed`` (both before removal).

    Null texts stay null and empty ones empty, with no lines; a row with a null id is left as it is. Rows that share an id are
    versions of one document: a line is kept at its place in each. Ids are whole numbers. Of ties the line first by (id, line
    number) stays. Input columns named n_lines or n_removed are replaced.
    """
    gone = stage(removed_lines(df, id_col, text_col), "removed-lines")
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    marked = df.select(*[F.col(f"`{c}`") for c in names]).join(
        broadcast_if_small(gone).select(F.col("id").alias("_gone_id"), F.col("lines").alias("_gone")), F.col(id_col).cast("long") == F.col("_gone_id"), "left").drop("_gone_id")
    text_at = names.index(text_col)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col, 4 << 20, 20_000):
            out, total, lost = [], [], []
            for text, lines in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
                own = split_lines(text)
                drop = set(lines or ())
                out.append(b"".join([t for j, t in enumerate(own) if j not in drop]) if drop else text)
                total.append(len(own))
                lost.append(len(drop & set(range(len(own)))))
            null = batch.column(text_at).is_null()
            text = pa.array(out, pa.binary()).cast(pa.string())
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pc.if_else(null, pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in names]).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return marked.mapInArrow(strip, schema)
