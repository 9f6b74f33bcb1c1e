"""Operator 7: removal of repeated byte strings by suffix arrays built through Lyndon grouping.

A byte goes if a WIDTH-byte string that covers it also starts anywhere else in the corpus. The corpus is cut
into small independent suffix-sorting problems that lose no repeat:

1. Every WIDTH-byte window has an anchor, the place of the least hash of 16 bytes within its first
   WIDTH - CORE + 1 places, so equal windows have equal anchors, followed by the same CORE bytes. The
   windows of one anchor start at consecutive places. One pass gives each anchor (core hash, hash of all that
   its windows cover). Anchors whose core occurs once have no repeated window.
2. Anchors that agree in all that their windows cover repeat each other, whatever their number: one class.
3. Classes with the same core but different surroundings are suffix-sorted together: their texts, the
   core as one symbol, are concatenated and sorted by ``suffix_array``; a window is repeated if a
   neighbour in suffix order begins with the same WIDTH bytes. One text per class is read again for this.
   Cores with more than GROUP classes are cut by longer cores: their windows are counted one by one by hash.

``suffix_array`` is Baier's linear construction: suffixes are grouped by Lyndon prefix, groups being processed in
descending order and followed back over previous-smaller pointers; then a single ascending pass over
the result emits every group's members in order. Nothing is renamed, there is no recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.joins import broadcast_if_small
from pitchside.llm.text import blocks, mix, prefix_sums, span_hash
from pitchside.sources.stage import stage

WIDTH = 400
CORE = 300
GRAM = 16
GROUP = 5_000
_REACH = WIDTH - CORE + 1


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of ``s``, whose last symbol must be its only least one."""
    n = len(s)
    # Buckets of A: a group is A[g : g + size[g]]; at first suffixes are grouped by their first symbol.
    a = sorted(range(n), key=s.__getitem__)
    group, place, size = [0] * n, [0] * n, [0] * n
    g = 0
    for i, x in enumerate(a):
        if i and s[x] != s[a[i - 1]]:
            g = i
        group[x], place[x] = g, i
        size[g] += 1
    prev = [-1] * n
    # Phase 1: groups in descending order. Members point back to the nearest suffix of a smaller group, whose Lyndon prefix
    # goes on with this group's; such suffixes leave their group for one right above it, the higher the more members follow.
    end = n
    while end > 0:
        g = group[a[end - 1]]
        members = a[g:end]
        if len(members) > 1:
            members.sort()
        count: dict[int, int] = {}
        for x in members:
            p = x - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[x] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            if len(members) == 1:
                levels = [list(count)]
            else:
                by_count: dict[int, list[int]] = {}
                for p, c in count.items():
                    by_count.setdefault(c, []).append(p)
                levels = [by_count[c] for c in sorted(by_count, reverse=True)]
            for level in levels:
                moved: dict[int, int] = {}
                for p in level:
                    h = group[p]
                    size[h] -= 1
                    moved[h] = moved.get(h, 0) + 1
                    last, at = h + size[h], place[p]
                    other = a[last]
                    a[at], a[last] = other, p
                    place[other], place[p] = at, last
                for h, m in moved.items():
                    if size[h]:
                        start = h + size[h]
                        size[start] = m
                        for i in range(start, start + m):
                            group[a[i]] = start
                    else:
                        size[h] = m
        end = g
    # Phase 2: in ascending order every suffix places those whose Lyndon prefix ends where it begins.
    out = [0] * n
    placed = bytearray(n)
    free = list(range(n))
    out[0] = n - 1
    placed[n - 1] = 1
    free[group[n - 1]] += 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = prev[p]
    return out


def _least_of_each_run(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by minima from both sides of blocks."""
    n = len(values)
    x = np.full(-(-n // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
    x[:n] = values
    b = x.reshape(-1, width)
    up = np.minimum.accumulate(b, axis=1).ravel()
    down = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1: width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, core hash, class hash) of all anchors; places count from the text's start.

    At most 2^24 bytes in all, but for a single longer text, which is taken in overlapping pieces.
    """
    if len(texts) == 1 and len(texts[0]) > 1 << 23:
        step, parts = 1 << 22, []
        for start in range(0, len(texts[0]) - WIDTH + 1, step):
            own = anchors([texts[0][start: start + step + WIDTH - 1]])
            parts.append((own[0], *(x + start for x in own[1:4]), *own[4:]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    data = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lens) - lens
    n_windows = np.maximum(0, lens - WIDTH + 1)
    total = int(n_windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_sums(data)
    places = np.arange(len(data))
    grams = span_hash(sums, places, np.minimum(places + GRAM, len(data)))
    ranked = (grams & np.uint64(0xFFFFFFFFFF000000)) | places.astype(np.uint64)
    least = _least_of_each_run(ranked, _REACH) & np.uint64(0xFFFFFF)
    window = np.repeat(starts - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(total)
    text = np.repeat(np.arange(len(texts)), n_windows)
    anchor = least[window].astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    first, last = window[new], window[np.append(new[1:], total) - 1]
    anchor, text = anchor[new], text[new]
    core = span_hash(sums, anchor, anchor + CORE)
    all_covered = mix(span_hash(sums, first, last + WIDTH) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, anchor - starts[text], first - starts[text], last - starts[text], core, all_covered


def repeated_windows(classes: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """For each class (core, first, last window relative to the anchor, covered bytes): which windows another place repeats.

    One suffix array for all classes given; classes of different cores have no symbol for the core in common.
    """
    symbols: list[np.ndarray] = []
    need: list[np.ndarray] = []
    spans: list[tuple[int, int]] = []
    at, n = 0, len(classes)
    by_core: dict[int, list[int]] = {}
    for i, c in enumerate(classes):
        by_core.setdefault(c[0], []).append(i)
    where: list[tuple[int, int]] = [(0, 0)] * n
    for number, own in enumerate(by_core.values()):
        # The core grows as far as all classes agree and all windows reach.
        left, right = max(classes[i][2] for i in own), min(classes[i][1] for i in own) + WIDTH
        texts = [np.frombuffer(classes[i][3], np.uint8) for i in own]
        rel = lambda k, x: x - classes[own[k]][1]  # noqa: E731, B023
        lo, hi = 0, CORE
        cut = np.array([t[rel(k, left): rel(k, lo)] for k, t in enumerate(texts)])
        same = (cut == cut[0]).all(axis=0)[::-1]
        lo -= int(np.argmin(np.append(same, False)))
        cut = np.array([t[rel(k, hi): rel(k, right)] for k, t in enumerate(texts)])
        hi += int(np.argmin(np.append((cut == cut[0]).all(axis=0), False)))
        for k, i in enumerate(own):
            t = texts[k]
            a, b = rel(k, lo), rel(k, hi)
            part = np.concatenate([t[:a].astype(np.int64) + (n + 1), [n + 257 + number], t[b:].astype(np.int64) + (n + 1), [1 + i]])
            symbols.append(part)
            windows = classes[i][2] - classes[i][1] + 1
            where[i] = (at, windows)
            need.append(np.full(windows, WIDTH - (hi - lo) + 1))
            spans.append((at, windows))
            at += len(part)
    text = np.concatenate([*symbols, [0]])
    order = np.array(suffix_array(text.tolist()))
    starts = np.concatenate([np.arange(a, a + w) for a, w in spans])
    # Hash of the WIDTH bytes (in symbols) at each window, then a comparison with the neighbours in suffix order.
    wide = mix(text.astype(np.uint64) + np.uint64(1))
    power = np.cumprod(np.append(np.uint64(1), np.full(len(wide), np.uint64(0x9E3779B97F4A7C15))))
    sums = np.append(np.uint64(0), np.cumsum(wide * power[:-1]))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(wide), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))))
    ends = starts + np.concatenate(need)
    h = np.zeros(len(text), np.uint64)
    h[starts] = mix((sums[ends] - sums[starts]) * back[starts])
    is_window = np.zeros(len(text), bool)
    is_window[starts] = True
    line = order[is_window[order]]
    hits = np.zeros(len(text), bool)
    equal = h[line[1:]] == h[line[:-1]]
    hits[line[1:][equal]] = True
    hits[line[:-1][equal]] = True
    return [hits[a: a + w] for a, w in where]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _span_table(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """(r, first, last): runs of repeated windows, by their first and last start in the text of row r."""
    classes = stage(shared.groupBy("core", "cls").agg(F.count("*").alias("n"), F.min(F.struct("r", "a", "lo", "hi")).alias("rep")), "repeat-classes")
    full = shared.join(classes.filter("n > 1").select("core", "cls"), ["core", "cls"], "left_semi").select("r", F.col("lo").alias("first"), F.col("hi").alias("last"))
    sizes = classes.groupBy("core").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 AND least = 1").select("core", "m")
    several = stage(classes.join(sizes, "core").select("core", "n", "m", "rep.*"), "repeat-edges")
    per_row = stage(several.groupBy("r").agg(F.collect_list(F.struct("core", "n", "m", "a", "lo", "hi")).alias("cut")), "repeat-cuts")
    texts = rows.join(broadcast_if_small(per_row).withColumnRenamed("r", "_r"), F.col("r") == F.col("_r")).select("cut", "_text", "r")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in blocks(batches, "_text", 4 << 20):
            found = [{"r": r, "core": c["core"], "n": c["n"], "m": c["m"], "a": c["a"], "lo": c["lo"] - c["a"], "hi": c["hi"] - c["a"], "bytes": t[c["lo"]: c["hi"] + WIDTH]}
                     for cuts, t, r in zip(batch.column(0).to_pylist(), raw, batch.column(2).to_pylist(), strict=True) for c in cuts]
            yield pa.RecordBatch.from_pylist(found, schema=_CUT)

    pieces = stage(texts.mapInArrow(cut, "r long, core long, n long, m long, a int, lo int, hi int, bytes binary"), "repeat-pieces")
    parts = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sort_group(table: pa.Table) -> pa.Table:
        out = []
        items = table.to_pylist()
        items.sort(key=lambda x: x["core"])
        start = 0
        while start < len(items):
            # Some cores at a time, whole groups, to keep the suffix array small.
            stop = start + 1
            while stop < len(items) and (stop - start < 2_000 or items[stop]["core"] == items[stop - 1]["core"]):
                stop += 1
            block = items[start:stop]
            for x, hit in zip(block, repeated_windows([(x["core"], x["lo"], x["hi"], x["bytes"]) for x in block]), strict=True):
                if x["n"] == 1:
                    base = x["a"] + x["lo"]
                    out += [{"r": x["r"], "first": base + i, "last": base + j} for i, j in _runs(hit)]
            start = stop
        return pa.Table.from_pylist(out, pa.schema([("r", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))

    sorted_runs = pieces.filter(F.col("m") <= GROUP).withColumn("part", F.pmod(F.xxhash64("core"), F.lit(parts))) \
        .groupBy("part").applyInArrow(sort_group, "r long, first int, last int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data = np.frombuffer(x["bytes"], np.uint8)
                at = np.arange(x["hi"] - x["lo"] + 1)
                h = span_hash(prefix_sums(data), at, at + WIDTH).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x["r"])), pa.array((at + x["a"] + x["lo"]).astype(np.int32)), pa.array(h)], names=["r", "first", "h"])

    # Very large groups: every window by its own hash; classes of several anchors count as two places.
    large = pieces.filter(F.col("m") > GROUP)
    alone = large.mapInArrow(windows, "r long, first int, h long")
    again = alone.groupBy("h").count().filter("count > 1").select("h")
    counted = alone.join(again, "h", "left_semi").select("r", "first", F.col("first").alias("last"))
    return full.union(sorted_runs).union(counted)


_CUT = pa.schema([("r", pa.int64()), ("core", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary())])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, spans, kept) of every row: maximal removed runs [start, end) in bytes, and the bytes that stay.

    A repeated row is another place, so all its windows repeat. Null and empty texts and texts under WIDTH bytes lose nothing;
    ids may be null or repeated. Only the two named columns are read. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(id_col, text_col).alias("r"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in blocks(batches, "_text", 2 << 20):
            text, a, lo, hi, core, cls = anchors(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(text)), pa.array(core.view(np.int64)), pa.array(cls.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (a, lo, hi))],
                names=["r", "core", "cls", "a", "lo", "hi"])

    found = stage(rows.filter(F.octet_length("_text") >= WIDTH).select("_text", "r").mapInArrow(find, "r long, core long, cls long, a int, lo int, hi int"), "anchors")
    # Staged, so the join below has an exchange of its own on both sides and a hot core can be split.
    shared = stage(found.groupBy("core").count().filter("count > 1").select("core"), "shared-cores")
    shared = stage(found.join(shared, "core"), "shared-anchors")
    spans = _span_table(shared, rows)
    # Equal rows share r: their runs are told apart by nothing, so one of each is enough.
    per_row = spans.distinct().groupBy("r").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))  # at most the anchors and windows of one text

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                merged: list[list[int]] = []
                for first, last in sorted((x["first"], x["last"]) for x in runs):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last + WIDTH)
                    else:
                        merged.append([first, last + WIDTH])
                out.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["_r", "spans"])

    merged = stage(per_row.mapInArrow(merge, "_r long, spans array<struct<start:int,end:int>>"), "removed-spans")
    marked = rows.join(broadcast_if_small(merged, 200_000), F.col("r") == F.col("_r"), "left").select("_id", "_text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in blocks(batches, "_text", 4 << 20):
            kept = []
            for text, spans in zip(raw, batch.column(2).to_pylist(), strict=True):
                for s in reversed(spans or ()):
                    text = text[: s["start"]] + text[s["end"]:]
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), batch.column(2), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    out = marked.mapInArrow(strip, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
