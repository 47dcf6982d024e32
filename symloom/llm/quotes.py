"""Quotation linking: quoted passages, the messages they come from, and conversations without them.

A line's quote level is the number of ``>`` marks that it starts with. Runs of lines of one level
are passages. Quoted passages are normalised and hashed, and looked up among the hashes of what
the earlier messages of the conversation say themselves: whole messages, passages and lines. A
message replies to the message that its outermost quotes come from. Everything is DataFrame and
SQL functions; messages are handled as arrays of lines, conversations by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import materialize

#: The marks at the start of a quoted line.
MARKS = r"^(?:[ \t]*>)+[ \t]?"


def quote_level(line: Column) -> Column:
    """Number of quote marks that a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def passages(text: Column) -> Column:
    """Runs of lines of one quote level: array of structs (level, body), in order.

    ``body`` is the lines without marks, joined by newlines. Null texts have none.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))

    def runs(own: Column) -> Column:
        n = F.size(own)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (own[i]["level"] != own[F.greatest(i - 1, F.lit(0))]["level"]))
        return F.transform(starts, lambda a, k: F.struct(own[a]["level"].alias("level"), F.array_join(F.transform(F.slice(own, a + 1, F.coalesce(F.get(starts, k + 1), n) - a), lambda x: x["body"]), "\n").alias("body")))

    # the array of lines is named once: a lambda's argument is computed once for its body
    return F.transform(F.array(lines), runs)[0]


def normalised(body: Column) -> Column:
    """ASCII lower case, without marks, white space as single spaces, trimmed."""
    lower = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(F.regexp_replace(lower, "[“”«»]", '"'), r"[ \t\r\n\x0B\f]+", " "))


def passage_hash(body: Column) -> Column:
    """SHA-256 of the normalised passage, null if nothing is left of it."""
    return F.when(normalised(body) != "", F.sha2(normalised(body), 256))


def is_marked(text: Column) -> Column:
    """Whether a text can hold a quoted line; the others need not be cut into lines."""
    return F.coalesce(F.contains(text, F.lit(">")), F.lit(False))


def own_parts(text: Column) -> Column:
    """What a message says itself: the bodies of its unquoted passages."""
    mine = F.transform(F.filter(passages(text), lambda r: r["level"] == 0), lambda r: r["body"])
    return F.when(is_marked(text), mine).otherwise(F.array(text))


def clean_text(text: Column) -> Column:
    """A message without its quotes and without empty lines at its ends; null for null."""
    return F.when(text.isNotNull(), F.regexp_replace(F.array_join(own_parts(text), "\n"), r"^\n+|\n+$", ""))


def own_hashes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, hash`` of what messages say themselves: whole, by passages, by lines."""
    rows = messages.select("conv_id", "turn", own_parts(F.col("text")).alias("mine"))
    lines = F.flatten(F.transform("mine", lambda b: F.split(b, "\n", -1)))
    whole = F.array(F.array_join("mine", "\n"))
    hashes = F.transform(F.array_distinct(F.concat(whole, "mine", lines)), passage_hash)
    return rows.select("conv_id", "turn", F.explode(hashes).alias("hash")).where("hash is not null").distinct()


def quoted_parts(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, part, hash, n`` of quoted passages (part 0) and their lines (from 1)."""
    runs = F.filter(passages(F.col("text")), lambda r: r["level"] > 0)
    rows = messages.where(is_marked(F.col("text"))).select("conv_id", "turn", F.explode(runs).alias("r")).select("conv_id", "turn", "r.level", "r.body")
    rows = rows.select("conv_id", "turn", "level", F.posexplode(F.concat(F.array("body"), F.split("body", "\n", -1))).alias("part", "b"))
    return rows.select("conv_id", "turn", "level", "part", passage_hash(F.col("b")).alias("hash"), F.length("b").alias("n")).where("hash is not null")


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, source_turn, level, n_passages, n_lines, n_chars``: where quotes come from.

    The source is the earliest message of the conversation that says the passage itself, if it is
    earlier than the quoting one. Only conversations in which something is quoted are hashed.
    Sayings are summed to one row a conversation and hash before the join, so a passage that many
    messages repeat makes no pairs.
    """
    quoted = materialize(quoted_parts(messages), "quoted")
    talk = messages.where("turn is not null").join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = own_hashes(talk).groupBy(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash")).agg(F.min("turn").alias("source_turn"))
    linked = quoted.join(said, (F.col("conv_id") == F.col("_conv")) & (F.col("hash") == F.col("_hash")) & (F.col("source_turn") < F.col("turn")))
    return linked.groupBy("conv_id", "turn", "source_turn", "level").agg(F.count(F.when(F.col("part") == 0, 1)).alias("n_passages"), F.count(F.when(F.col("part") > 0, 1)).alias("n_lines"), F.sum(F.when(F.col("part") > 0, F.col("n")).otherwise(0)).alias("n_chars"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages without quotes, with what they reply to and their thread.

    One row per message: ``conv_id, turn, role, reply_to, thread, depth, clean_text, n_quotes,
    n_linked``. ``reply_to`` is the turn that most of the outermost linked quotes come from (more
    characters first, then the later turn), null without any; ``thread`` is the turn at the root
    of the replies, ``depth`` the replies on the way. In the order (thread, turn) each reply
    stands after what it replies to. ``n_linked`` counts linked quoted lines.

    Null texts stay null and neither quote nor are quoted; empty texts likewise. Messages with a
    null conv_id or turn are not linked and are threads of their own (thread is their turn).
    Messages that share conv_id and turn are one place in the tree: all get its links. An empty
    table gives an empty result; further columns are left out. Threads are found by doubling the
    steps towards the root, over links only, in as many rounds as the logarithm of the depth.
    """
    found = messages.select("conv_id", "turn", "role", "text")
    links = materialize(quote_links(found.drop("role")), "quotes")
    best = F.struct(-F.col("level"), F.col("n_chars"), F.col("source_turn"))
    replies = links.groupBy("conv_id", "turn").agg(F.max_by("source_turn", best).alias("reply_to"), F.sum("n_lines").alias("n_linked"))
    replies = materialize(replies, "replies")
    # every node's furthest known ancestor and the steps to it
    way = replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("steps"))
    while True:
        above = way.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        if way.join(above, (F.col("conv_id") == F.col("_conv")) & (F.col("up") == F.col("_turn")), "left_semi").isEmpty():
            break
        further = way.join(above, (F.col("conv_id") == F.col("_conv")) & (F.col("up") == F.col("_turn")), "left")
        way = materialize(further.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).cast("int").alias("steps")), "replies")
    tree = replies.join(way.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "up", "steps"), (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn"))).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "reply_to", "n_linked", "up", "steps")
    n_quotes = F.when(is_marked(F.col("text")), F.size(F.filter(passages(F.col("text")), lambda r: r["level"] > 0))).otherwise(0)
    rows = found.join(tree, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return rows.select("conv_id", "turn", "role", "reply_to", F.coalesce("up", "turn").alias("thread"), F.coalesce("steps", F.lit(0)).cast("int").alias("depth"), clean_text(F.col("text")).alias("clean_text"), n_quotes.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
