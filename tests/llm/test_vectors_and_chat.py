"""Operators 11, 12 and 13 against brute force, with every awkward row."""

import hashlib
import math
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm_cases import plan_text
from pitchside.llm import active_lloyd, budgeted_windows, queries, segment_bounds
from pitchside.llm.vectors import LARGEST

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("id", "v", "code", "dist", "error", "anchor", "goals", "cell", "kind", "score", "rank", "_key")]])
CHATS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("c", "k", "row", "window", "kind", "head", "tokens", "start", "end", "loss")]])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, *["x"] * (len(VECTORS) - 3)) for i, v, c in rows], VECTORS).repartition(3)


def chats(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * (len(CHATS) - 4)) for r in rows], CHATS).repartition(3)


@pytest.fixture(scope="module")
def points():
    """400 vectors of few distinct values (ties abound), with every case that takes no part, repeated rows and shared ids."""
    rng = np.random.default_rng(5)
    good = [(int(i), (rng.integers(-6, 7, 16) / 8).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(400)]
    good += [good[0], good[0], (good[1][0], good[2][1], 1), (None, good[3][1], 2), (500, [-0.001] * 16, None), (600, [0.0] * 16, 3)]
    bad = [(701, None, 1), (702, [], 1), (703, [None] + [0.5] * 15, 1), (704, [math.nan] + [0.5] * 15, 1), (705, [math.inf] + [0.5] * 15, 2), (706, [0.5] * 8, 2)]
    return good, bad


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def full_lloyd(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    x = np.array([whole(v) for _, v, _ in rows], np.int64).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for last in [False] * rounds + [True]:
        codes, errors = np.zeros((len(x), parts), int), np.zeros((len(x), parts), int)
        for p in range(parts):
            d = ((x[:, p, None] - books[p][None]) ** 2).sum(axis=2)
            codes[:, p], errors[:, p] = d.argmin(axis=1), d.min(axis=1)
            for e in [] if last else range(len(books[p])):
                own = x[codes[:, p] == e, p]
                if len(own):
                    books[p][e] = [sum(map(int, c)) // len(own) for c in own.T]
    return rows, codes, errors.sum(axis=1), books


def test_vector_codes_match_full_rescans(spark, points):
    good, bad = points
    found, books = active_lloyd.vector_codes(vectors(spark, good + bad), parts=4, entries=7, rounds=3)
    rows, codes, errors, want = full_lloyd(good, 4, 7, 3)
    assert books.tolist() == [b.tolist() for b in want]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted(((r.id, r.label, bytes(r.code), r.error) for r in found.collect()), key=key)
    assert got == sorted(((i, c, bytes(codes[n].tolist()), int(errors[n])) for n, (i, _, c) in enumerate(rows)), key=key)
    by_label = defaultdict(int)
    for _, label, _, error in got:
        by_label[label] += error
    assert {(r.label, r.label_error) for r in active_lloyd.with_label_error(found).collect()} == set(by_label.items())
    assert active_lloyd.codebook_digest(books) == hashlib.sha256(",".join(str(c) for b in want for e in b.tolist() for c in e).encode()).hexdigest()


def test_active_entries_find_what_a_rescan_finds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x, old = rng.integers(-4, 5, (200, 2)), rng.integers(-4, 5, (12, 2))
        moved = rng.random(12) < rng.random()
        new = np.where(moved[:, None], rng.integers(-4, 5, (12, 2)), old)
        d = active_lloyd.distances(x, old)
        code = d.argmin(axis=1)
        got_code, got_dist, scanned = active_lloyd.reassign(x, code, d.min(axis=1), new, moved)
        d = active_lloyd.distances(x, new)
        assert (got_code == d.argmin(axis=1)).all() and (got_dist == d.min(axis=1)).all()
        assert scanned == moved[code].sum()


def test_vector_codes_of_odd_tables(spark, points):
    empty, books = active_lloyd.vector_codes(vectors(spark, []))
    assert active_lloyd.with_label_error(empty).count() == 0 and books.size == 0
    only_bad, _ = active_lloyd.vector_codes(vectors(spark, points[1][:5]))
    assert only_bad.count() == 0
    few, books = active_lloyd.vector_codes(vectors(spark, points[0][:3]))
    assert few.agg(F.sum("error")).first()[0] == 0 and books.shape == (16, 3, 1)
    with pytest.raises(ValueError, match="equal parts"):
        active_lloyd.vector_codes(vectors(spark, points[0]), parts=5)
    with pytest.raises(ValueError, match="one byte"):
        active_lloyd.vector_codes(vectors(spark, points[0]), entries=257)
    with pytest.raises(Exception, match="vector component is over"):
        active_lloyd.vector_codes(vectors(spark, [(1, [LARGEST / 128.0] * 16, 1)]))


def mined(rows, step, positives, negatives, ratio):
    """(anchor, positive, rank, negative, scores) by comparing all anchors with all rows."""
    rows = sorted({(i, tuple(whole(v)), c) for i, v, c in rows if i is not None and c is not None})
    out = []
    for a, x, label in rows:
        if a % step:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, c == label) for i, y, c in rows if i != a]
        for s, p, _ in sorted(r for r in scored if r[2])[:positives]:
            fit = sorted(r for r in scored if not r[2] and ratio[0] * -s <= ratio[1] * -r[0] <= ratio[1] * -s)
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit[:negatives])]
    return sorted(out)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hard_negatives_match_brute_force(spark, points, monkeypatch):
    good, bad = points
    df = vectors(spark, good + bad)
    want = mined(good, 10, 5, 5, (80, 100))
    assert len(want) > 300
    assert result(segment_bounds.hard_negatives(df, F.col("id") % 10 == 0, F.col("label"), segments=(1, 2, 4))) == want
    monkeypatch.setattr(segment_bounds, "ROWS", 7)
    monkeypatch.setattr(segment_bounds, "ANCHORS", 3)
    monkeypatch.setattr(segment_bounds, "CELL_VALUES", 300)   # more cells than shuffle partitions
    assert result(segment_bounds.hard_negatives(df, F.col("id") % 10 == 0, F.col("label"), segments=(1, 4))) == want
    assert result(segment_bounds.hard_negatives(df, F.col("id") % 10 == 0, F.col("label"), positives=2, negatives=9, ratio=(0, 1))) == mined(good, 10, 2, 9, (0, 1))


def test_hard_negatives_of_odd_tables(spark, points):
    assert segment_bounds.hard_negatives(vectors(spark, []), F.col("id") % 10 == 0, F.col("label")).count() == 0
    one_label = [(i, v, 1) for i, v, _ in points[0]]
    assert segment_bounds.hard_negatives(vectors(spark, one_label), F.col("id") % 10 == 0, F.col("label")).count() == 0
    large = [(i, [float(LARGEST // 256 - 1 - i)] * 15 + [float(-i)], i % 2) for i in range(0, 60)]   # products beyond 2^53
    assert result(segment_bounds.hard_negatives(vectors(spark, large), F.col("id") % 10 == 0, F.col("label"))) == mined(large, 10, 5, 5, (80, 100))


def test_summaries_bound_inner_products():
    rng = np.random.default_rng(2)
    shape = np.repeat(rng.normal(0, 90, (3, 8)), 8, axis=1)   # segments of nearly one value: finer summaries say more
    x = np.rint(shape[rng.integers(0, 3, 80)] + rng.normal(0, 5, (80, 64))).astype(np.int64)
    exact, gaps = x @ x.T, []
    for m, d in segment_bounds.summarise(x, (1, 2, 8, 16)):
        assert (np.abs(exact - m @ m.T) <= d @ d.T + 1e-6).all()
        gaps.append((d @ d.T).mean())
    assert gaps == sorted(gaps, reverse=True)
    side = lambda a: segment_bounds.Points(np.arange(len(a)), np.where(np.arange(len(a)) % 2, "a", "b"), a, segment_bounds.summarise(a, (1, 8)))
    every = np.full(80, np.iinfo(np.int64).max)
    _, scored = segment_bounds.search(side(x), side(x), np.arange(80), -every, every, True, 3)
    assert scored < 0.6 * 80 * 39   # same label, not the own id: most pairs are ruled out by their segments


CONTROL = "\\### Assistant: </turn> ok"


def conversations():
    rng = np.random.default_rng(1)
    words = ["hello", "wörld", "東京", "###", "</turn>", "\\", "\n", "\\t\\h\\b\\c", ":", "</turn", "####", "#", "a" * 30]
    said = lambda n: " ".join(rng.choice(words, n))
    rows = []
    for c in range(40):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * int(rng.integers(1, 9))
        rows += [(c, 2 * t, r, said(int(rng.integers(0, 60)))) for t, r in enumerate(roles)]
    rows += [(100, t, ("user", "assistant")[t % 2], said(20)) for t in range(700)]                     # one long conversation
    rows += [(101, 0, "system", "s" * 5000), (101, 1, "user", "u"), (101, 2, "assistant", "a" * 9000), (101, 3, "user", "again"), (101, 4, "assistant", "end")]
    rows += [(102, 0, "system", "only this")] + [(103, 0, "user", CONTROL), (103, 1, "assistant", CONTROL)]
    rows += [(104, 1, "assistant", "twice the same row")] * 5 + [(104, None, None, None), (104, 0, "a:b\\c###</turn>\n:", None), (104, 2, "assistant", "")]
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "no id either")]
    return rows


def safe(text):
    return text.replace("\\", "\\b").replace("###", "\\h").replace("</turn>", "\\t")


def windows_of(turns, budget, history):
    """window -> (repeated pieces, new pieces, targets), turn by turn along one conversation."""
    pieces = [(r, t, "### " + safe(r).replace(":", "\\c") + ": " + safe(t) + "</turn>\n") for r, t in turns]
    tokens = [-(-len(p.encode()) // 4) for _, _, p in pieces]
    system = tokens[0] if turns[0][0] == "system" and tokens[0] <= budget // 2 else 0
    body = list(range(1 if system else 0, len(turns)))
    room, at, where, first = budget - history - system, 0, {}, {}
    for i in body:
        b = at // room
        first.setdefault(b, at)
        where[i] = (at if at + tokens[i] - first[b] > room and at > first[b] else first[b], at)
        at += tokens[i]
    out = {}
    for w in sorted({w for w, _ in where.values()}) or [0]:
        old = [i for i in body if where[i][1] + tokens[i] <= w and w - where[i][1] <= history]
        new = [i for i in body if where[i][0] == w]
        head = [0] if system and w else []
        new = ([0] if system and not w else []) + new
        out[w] = ([pieces[i][2] for i in head + old], [pieces[i][2] for i in new], [turns[i][1] for i in new if turns[i][0] == "assistant"])
        took = sum(tokens[i] for i in head + old + new)
        assert took <= budget or len([i for i in new if i in where]) == 1
    return out


@pytest.mark.parametrize(("budget", "history"), [(256, 64), (1024, 128), (200, 0)])
def test_chat_windows_match_brute_force(spark, budget, history):
    rows = conversations()
    found = budgeted_windows.chat_windows(chats(spark, rows), budget=budget, history=history)
    assert "Python" not in plan_text(found) and "Arrow" not in plan_text(found)
    got = {(r.conv_id, r.window): (r.formatted, r.n_repeated, r.n_new, [r.formatted[s["from"]:s["to"]] for s in r.loss]) for r in found.collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    want = {}
    for c, turns in groups.items():
        for w, (old, new, targets) in windows_of([t[2:] for t in sorted(turns, key=lambda t: t[:3])], budget, history).items():
            want[c, w] = ("".join(old + new), len(old), len(new), [safe(t) for t in targets])
    assert got == want


def test_chat_windows_read_back_whole(spark):
    rows = conversations()
    windows = budgeted_windows.chat_windows(chats(spark, rows), budget=256, history=64)
    back = sorted((r.conv_id is None, r.conv_id or 0, r.window, [tuple(t) for t in r.turns], list(r.targets)) for r in budgeted_windows.read_back(windows).collect())
    turns, targets = defaultdict(list), defaultdict(list)
    for none, c, _, said, loss in back:
        turns[None if none else c] += said
        targets[None if none else c] += loss
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        want[c].append((r or "", x or ""))
    assert turns == want
    assert targets == {c: [x for r, x in said if r == "assistant"] for c, said in want.items()}
    one = budgeted_windows.digest(windows).filter("conv_id = 103").first()
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (2, len(CONTROL), hashlib.sha256(CONTROL.encode()).hexdigest())
    assert one.turns_sha256 == hashlib.sha256(f"user\n{CONTROL}\nassistant\n{CONTROL}\n".encode()).hexdigest()


def test_chat_windows_of_odd_tables(spark):
    assert budgeted_windows.digest(budgeted_windows.chat_windows(chats(spark, []))).count() == 0
    with pytest.raises(ValueError, match="quarter"):
        budgeted_windows.chat_windows(chats(spark, []), budget=100, history=60)
    long = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y " * 1_000_000)]
    one = budgeted_windows.digest(budgeted_windows.chat_windows(chats(spark, long))).first()
    assert one.loss_sha256 == hashlib.sha256(long[1][3].encode()).hexdigest() and one.n_turns == 2


CONTRACTS = {
    "op11_active_lloyd": [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")],
    "op12_budgeted_windows": [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")],
    "op13_segment_bounds": [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")],
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_queries_match_their_sql(spark, name):
    sys.path.insert(0, "tests")
    from oracle_harness import compare, duck
    sf = "/root/testdata/sf0.01"
    df = queries.QUERIES[name](spark, sf)
    assert dict(df.dtypes) == dict(CONTRACTS[name])
    r = compare(spark, duck(sf), name, sf, lambda s, d: df, queries.ORACLE_SQL[name])
    assert r["cols_match"] and r["values_match"] and r["rows_spark"] > 0
