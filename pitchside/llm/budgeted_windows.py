"""Operator 12: chat transcripts in windows of a token budget. DataFrame functions only.

Turns of a conversation are laid end to end; prefix sums of their tokens give every turn a start and an end. The room of a
window is the budget less the system turn and less the share kept for history. A bucket is a stretch of as many tokens as
the room; a window takes the turns that start in a bucket. The last of them may cross into the next bucket: it stays if
the window still fits into its room, else it is a window of its own. So windows are whole, consecutive turns, found by
arithmetic on prefix sums instead of a walk along the conversation, and only a turn larger than the room exceeds it. Each
window then gets the conversation's system turn again and the turns before it that fit into the history share. The loss
mask marks the assistant turns where they are new; repeated ones are masked.

Template: ``### role: text</turn>`` and a line feed for every turn. Inside roles and texts ``\\`` becomes ``\\b``, ``###``
``\\h`` and ``</turn>`` ``\\t`` (``:`` in a role ``\\c``), so neither marker can occur there and ``read_back`` restores them.

Scale: turns are range-partitioned by (conversation, turn) and written once with row numbers in that order. Running sums are
taken per conversation and partition, then over the partitions' totals, so a conversation with a third of all turns is summed
by many tasks. Buckets and windows are bounded groups; texts are joined by row number, system turns in salted copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.sources.stage import stage

BUDGET, HISTORY = 1024, 128
SYSTEM, ASSISTANT = "system", "assistant"
OPEN, CLOSE = "### ", "</turn>\n"
SALTS = 32
#: Rows written as one partition by the range partitioning, about.
PARTITION_ROWS = 500_000


def escape(text: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("</turn>", "\\t"), ("###", "\\h"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _ordered(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Escaped turns with ``row``, numbers that ascend in the order of conversation and turn, written to the shared folder."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = df.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
                      F.replace(escape(role), F.lit(":"), F.lit("\\c")).alias("safe_role"), escape(text).alias("text"),
                      F.xxhash64(text).alias("h"))
    formatted = F.octet_length(F.concat(F.lit(OPEN), "safe_role", F.lit(": "), "text", F.lit(CLOSE)))
    turns = turns.withColumn("tokens", F.ceil(formatted / 4).cast("long"))
    parts = max(1, turns.count() // PARTITION_ROWS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv", "turn", "role", "h"]   # fully equal turns may lie in several partitions: the salt parts them
    dealt = turns.withColumn("salt", F.rand(12)).repartitionByRange(parts, *keys, "salt").sortWithinPartitions(*keys, "salt")
    return stage(dealt.select("conv", "role", "safe_role", "text", "tokens", F.monotonically_increasing_id().alias("row")), "turns")


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, has_conv, window, row, kind): the rows of every window; kind 0 system turn again, 1 history, 2 new."""
    lean = turns.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("c"), F.col("conv").isNotNull().alias("k"),
                        F.shiftright("row", 33).alias("part"), "row", "role", "tokens")
    per_part = lean.groupBy("c", "k", "part").agg(
        F.sum("tokens").alias("total"), F.min(F.struct("row", "role", "tokens")).alias("first"))
    along = Window.partitionBy("c", "k").orderBy("part")
    head = F.first("first").over(along)
    per_part = per_part.select(
        "c", "k", "part", F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        head["row"].alias("head_row"), F.when((head["role"] == SYSTEM) & (head["tokens"] <= budget // 2), head["tokens"]).otherwise(0).alias("system"))
    room = F.lit(budget - history) - F.col("system")
    inside = Window.partitionBy("c", "k", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    at = lean.withColumn("end", F.sum("tokens").over(inside)).join(per_part, ["c", "k", "part"])
    # A system turn that every window repeats takes no place along the conversation: the others move up by its tokens.
    at = at.withColumn("head", (F.col("row") == F.col("head_row")) & (F.col("system") > 0)) \
        .withColumn("end", F.col("end") + F.col("before") - F.col("system")).withColumn("start", F.col("end") - F.col("tokens"))
    at = at.withColumn("room", room).withColumn("bucket", F.when(F.col("head"), 0).otherwise(F.floor(F.col("start") / room)))
    in_bucket = Window.partitionBy("c", "k", "bucket")
    at = at.withColumn("from", F.min(F.when(~F.col("head"), F.col("start"))).over(in_bucket))
    alone = ~F.col("head") & (F.col("end") - F.col("from") > F.col("room")) & (F.col("start") > F.col("from"))
    at = at.withColumn("window", F.when(F.col("head"), 0).when(alone, F.col("start")).otherwise(F.col("from")))
    at = stage(at.select("c", "k", "row", "head", "head_row", "system", "room", "bucket", "window", "start", "end", "tokens"), "turn-windows")
    new = at.select("c", "k", "window", "row", F.lit(2).alias("kind"))
    opened = at.filter(~F.col("head") & (F.col("start") == F.col("window"))).select(
        F.col("c").alias("wc"), F.col("k").alias("wk"), F.col("bucket").alias("wb"), "window",
        F.when((F.col("system") > 0) & (F.col("window") > 0), F.col("head_row")).alias("system_row"))
    buckets = F.sequence(F.floor(F.col("end") / F.col("room")), F.floor((F.col("start") + history) / F.col("room")))
    reach = at.filter(~F.col("head") & (F.col("tokens") <= history)).select("c", "k", "row", "start", "end", F.explode(buckets).alias("b"))
    near = reach.join(opened, (F.col("c") == F.col("wc")) & (F.col("k") == F.col("wk")) & (F.col("b") == F.col("wb"))
                      & F.col("window").between(F.col("end"), F.col("start") + history))
    again = opened.filter(F.col("system_row").isNotNull()).select(
        F.col("wc").alias("c"), F.col("wk").alias("k"), "window", F.col("system_row").alias("row"), F.lit(0).alias("kind"))
    return new.unionByName(near.select("c", "k", "window", "row", F.lit(1).alias("kind"))).unionByName(again)


def chat_windows(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(id_col, window, n_new, n_repeated, formatted, loss): one row per window.

    ``window``: tokens of the conversation before it. ``formatted``: first the ``n_repeated`` repeated turns, then the ``n_new`` new ones.
    ``loss``: spans (from, to) of code points of ``formatted``, the texts of new assistant turns. Every turn is new in exactly
    one window. A token is four bytes of a formatted turn, rounded up. The conversation's first turn is its system turn if its role
    is ``system`` and it takes at most half the budget; a longer one is a turn like others and is not repeated. A turn larger than
    the room is a window of its own, uncut. ``history`` must leave a quarter of the budget.

    Turns are in the order of ``turn_col`` (nulls first), ties by role and a hash of the text; repeated rows are turns each. Null
    roles and texts are empty; rows without an id are one conversation, whose id is null. An empty table: no rows. Other
    columns are not read.
    """
    if not 0 <= history <= budget // 4:
        raise ValueError("history must be from 0 to a quarter of the budget")
    turns = _ordered(df, id_col, turn_col, role_col, text_col)
    placed = _placed(turns.drop("text", "safe_role"), budget, history)
    texts = turns.drop("tokens")
    # Many windows may need one system turn again: as many copies of it as there are salts in use meet them.
    salted = placed.filter(F.col("kind") == 0).withColumn("copy", F.pmod(F.xxhash64("window"), F.lit(SALTS)))
    copies = texts.join(salted.select("row", "copy").distinct(), "row")
    shown = placed.filter(F.col("kind") > 0).join(texts, "row").unionByName(salted.join(copies, ["row", "copy"]).drop("copy"))
    piece = F.concat(F.lit(OPEN), "safe_role", F.lit(": "), "text", F.lit(CLOSE))
    shown = shown.select(
        "c", "k", "conv", "window", "kind", "row", piece.alias("piece"), F.char_length("text").alias("size"),
        ((F.col("kind") == 2) & (F.col("role") == ASSISTANT)).alias("target"))
    windows = shown.groupBy("c", "k", "window").agg(
        F.first("conv").alias(id_col), F.count_if(F.col("kind") == 2).alias("n_new"), F.count_if(F.col("kind") < 2).alias("n_repeated"),
        F.array_sort(F.collect_list(F.struct("kind", "row", "piece", "size", "target"))).alias("p"))
    at = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("loss")),
                     lambda a, x: F.struct(
                         (a["at"] + F.char_length(x["piece"])).alias("at"),
                         F.when(x["target"], F.concat(a["loss"], F.array(F.struct(
                             (a["at"] + F.char_length(x["piece"]) - len(CLOSE) - x["size"]).alias("from"),
                             (a["at"] + F.char_length(x["piece"]) - len(CLOSE)).alias("to"))))).otherwise(a["loss"]).alias("loss")))
    return windows.select(id_col, "window", "n_new", "n_repeated", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
                          at["loss"].alias("loss"))


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, window, turns, targets, chars) from ``formatted`` and ``loss`` alone: the new turns of a window, unescaped,

    as (role, text), the texts under the loss mask, and the length of ``formatted``.
    """
    pieces = F.split("formatted", "</turn>\n", -1)
    new = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.size(pieces) - 1 - F.col("n_repeated").cast("int"))
    header = lambda x: F.substring_index(x, ":", 1)
    turns = F.transform(new, lambda x: F.struct(
        unescape(F.substr(header(x), F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(x, F.char_length(header(x)) + 3)).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    return windows.select(id_col, "window", turns.alias("turns"), targets.alias("targets"), F.char_length("formatted").cast("long").alias("chars"))


def digest(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: counts and digests of what ``read_back`` gives, in the order of the windows.

    A digest is one hash of a conversation's whole text, so this step alone holds a conversation in one row.
    """
    each = read_back(windows, id_col).select(
        id_col, "chars", F.struct(
            "window", F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("targets", "").alias("loss")).alias("w"))
    whole = each.groupBy(id_col).agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    said, loss = F.array_join(F.transform("w", lambda x: x["said"]), ""), F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        id_col, F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
