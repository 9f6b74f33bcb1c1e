"""Operator 6: benchmark decontamination with a distributed positional inverted index (native).

1. ``build_index`` writes the postings (document key, position, term) of every document word that is a
   benchmark term to the shared folder: lists of other terms are never fetched. One extra posting per
   document, the empty term at position n_words, keeps documents without postings and their length.
2. ``phrase_hits`` counts every term's postings and gives each window of an item its two rarest terms. Their
   lists, each posting moved back by the term's place in the item, are intersected: what is left are
   alignments (document, item, shift). These few are intersected with the lists of all other terms of
   the item, and runs of ``window`` matches in a row are the exact phrase matches.
3. ``proximity_hits`` matches the two rarest terms of an item at a distance of at most ``slop`` words; ``near_items`` counts
   the items that match a document so.

All steps are DataFrame functions. Shuffled are the two rarest lists per window and the
postings of aligned documents, spread by (document, position), so a frequent term or passage has no task of
its own. Broadcast are benchmark terms, windows and aligned document keys, each after a count, with a
shuffled join beyond BROADCAST_ROWS.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.joins import broadcast_if_small
from pitchside.sources.stage import stage

#: The contract's word pattern with A-Z added; ``_lower`` then lowers them, which is the same as lowering first.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]


def _lower(word: Column) -> Column:
    """A-Z lowered, other letters kept; most words are lower case already, which is the cheap test."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that stand for a row's id and text."""
    return F.xxhash64(id_col, text_col), F.xxhash64(F.lit(6), id_col, text_col)


def items_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, words) of every item that has words; equal (id, words) count once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.transform(_words(F.col(text_col)), _lower).alias("words"))
    items = items.filter(F.size("words") > 0).distinct()
    return items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged index: (k1, k2, id_col, pos, term); a row with the empty term per document has n_words as pos."""
    k1, k2 = _keys(id_col, text_col)
    keyed = docs.select(F.col(id_col), k1.alias("k1"), k2.alias("k2"), F.array_append(_words(F.col(text_col)), F.lit("")).alias("words"))
    terms = items.select(F.explode("words").alias("term")).union(items.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    postings = keyed.select(*KEY, id_col, F.posexplode("words").alias("pos", "word")).select(*KEY, id_col, "pos", _lower(F.col("word")).alias("term"))
    return stage(postings.join(broadcast_if_small(terms), "term", "left_semi"), "positional-index")


def _windows(index: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(item, p1, t1, p2, t2) per window that can occur: places and terms of its two rarest; p2 is null for one word.

    An item of fewer words than ``window`` is one window. Places are counted from the item's first word.
    """
    counts = index.filter(F.col("term") != "").groupBy("term").count()
    places = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("p", "term"))
    places = places.join(counts, "term", "left").select("item", "n", "p", "term", F.coalesce("count", F.lit(0)).alias("df"))
    ranked = places.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("p", "df", "term"))).alias("ps"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    each = ranked.select("item", F.explode(F.transform(starts, lambda s: F.slice("ps", s + 1, F.lit(window)))).alias("w"))
    rare = each.select("item", F.array_sort(F.transform("w", lambda x: F.struct(x["df"].alias("df"), x["p"].alias("p"), x["term"].alias("term")))).alias("w"))
    rare = rare.filter(F.col("w")[0]["df"] > 0)
    second = F.get("w", F.lit(1))
    return rare.select("item", F.col("w")[0]["p"].alias("p1"), F.col("w")[0]["term"].alias("t1"),
                       second["p"].alias("p2"), second["term"].alias("t2")).distinct()


def phrase_hits(index: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """(k1, k2, item_id, first, last): every maximal run of document words covered by windows of an item in one alignment."""
    wins = stage(_windows(index, items, window), "rarest-terms")
    lists = index.select(*KEY, "pos", "term")
    first = lists.join(broadcast_if_small(wins).withColumnRenamed("t1", "term"), "term") \
        .select(*KEY, "item", (F.col("pos") - F.col("p1")).alias("shift"), "p2", "t2")
    alone = first.filter(F.col("p2").isNull()).select(*KEY, "item", "shift")
    seconds = wins.filter(F.col("p2").isNotNull()).select(F.col("t2").alias("term")).distinct()
    second = lists.join(broadcast_if_small(seconds), "term", "left_semi").select(*KEY, F.col("pos").alias("at"), F.col("term").alias("t2"))
    both = first.filter(F.col("p2").isNotNull()).withColumn("at", F.col("shift") + F.col("p2")) \
        .join(second, [*KEY, "at", "t2"], "left_semi").select(*KEY, "item", "shift")
    aligned = stage(alone.union(both).distinct(), "alignments")

    # The other terms of the item: expected (position, term) of each alignment against the postings of those documents.
    keys = broadcast_if_small(aligned.select(*KEY).distinct())
    rest = lists.filter(F.col("term") != "").join(keys, KEY, "left_semi").distinct()
    words = items.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("p", "term"))
    wanted = aligned.join(broadcast_if_small(words), "item").withColumn("pos", F.col("shift") + F.col("p"))
    match = wanted.join(rest, [*KEY, "pos", "term"]).select(*KEY, "item_id", "item", "shift", "n", "p")
    line = Window.partitionBy(*KEY, "item", "shift").orderBy("p")
    runs = match.withColumn("run", F.col("p") - F.row_number().over(line)) \
        .groupBy(*KEY, "item_id", "item", "shift", "n", "run").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    full = F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n"))
    return runs.filter(full).select(*KEY, "item_id", (F.col("shift") + F.col("a")).alias("first"), (F.col("shift") + F.col("b")).alias("last"))


def proximity_hits(index: DataFrame, items: DataFrame, slop: int = 20) -> DataFrame:
    """(k1, k2, item_id, distance): documents that hold an item's two rarest terms, ``distance`` <= ``slop`` words apart.

    The smallest distance per document and item; terms that no document has are passed over, and items with fewer than two
    different terms in the index have no proximity match. Positions meet in blocks of ``slop`` words (a posting of the
    second term is in its own block and both neighbours), so the join is an equi-join.
    """
    counts = index.filter(F.col("term") != "").groupBy("term").count()
    terms = items.select("item_id", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    by_item = Window.partitionBy("item_id").orderBy("count", "term")
    rare = terms.withColumn("r", F.row_number().over(by_item)).filter(F.col("r") <= 2)
    rare = stage(rare.select("item_id", "term", "r"), "rare-terms")
    # Repeated rows share a key: one posting of each place is enough.
    lists = index.join(broadcast_if_small(rare), "term").select(*KEY, "item_id", "r", "pos").distinct() \
        .select(*KEY, "item_id", "r", "pos", F.floor(F.col("pos") / slop).alias("block"))
    a = lists.filter(F.col("r") == 1).drop("r")
    b = lists.filter(F.col("r") == 2).select(*KEY, "item_id", F.col("pos").alias("other"),
                                             F.explode(F.array(*[F.col("block") + d for d in (-1, 0, 1)])).alias("block"))
    near = a.join(b, [*KEY, "item_id", "block"]).withColumn("distance", F.abs(F.col("pos") - F.col("other")))
    return near.filter(F.col("distance") <= slop).groupBy(*KEY, "item_id").agg(F.min("distance").alias("distance"))


def near_items(index: DataFrame, items: DataFrame, slop: int = 20) -> DataFrame:
    """(k1, k2, n_near): in how many items (by id, null ids left out) a document has a proximity match; documents without one are absent."""
    near = proximity_hits(index, items.filter("item_id IS NOT NULL"), slop)
    return near.groupBy(*KEY).agg(F.count("*").alias("n_near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13,
                 slop: int | None = 20) -> DataFrame:
    """One row per document: (id_col, k1, k2, n_words, n_hit, items, n_near): words, words hit, sorted ids of items with windows in it,
    and in how many items it has a proximity match (0 for all where ``slop`` is None, which skips the search).

    Null and empty texts have no words; items without words have no window; empty tables give no rows or no hits. Repeated rows
    give repeated results. Items with a null id hit words but are not listed. Columns beside the named ones are not read.
    """
    items = stage(items_table(benchmark, item_col), "items")
    index = build_index(docs, items, id_col, text_col)
    hits = stage(phrase_hits(index, items, window), "hits")
    words = hits.select(*KEY, F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    listed = hits.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    total = index.filter(F.col("term") == "").select(id_col, *KEY, F.col("pos").cast("long").alias("n_words"))
    found = total.join(broadcast_if_small(stage(words.join(listed, KEY), "hit-documents")), KEY, "left")
    if slop is None:
        found = found.withColumn("n_near", F.lit(0))
    else:
        found = found.join(broadcast_if_small(stage(near_items(index, items, slop), "near-documents")), KEY, "left")
    return found.select(id_col, *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated: fewer than a twentieth of their words hit, or none."""
    found = decontaminate(docs, benchmark, id_col, text_col, slop=None)
    bad = found.filter((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(*KEY).distinct()
    bad = broadcast_if_small(stage(bad, "contaminated"))
    k1, k2 = _keys(id_col, text_col)
    return docs.join(bad, (k1 == bad["k1"]) & (k2 == bad["k2"]), "left_anti")
