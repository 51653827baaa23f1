"""Chat formatting of conversations with quoted replies, in DataFrame operations alone.

A message's lines have a quote level: how many ``>`` signs stand before the
text. Neighbouring lines of one level that are not empty form a passage. The
text is normalised (lower case, only letters and digits, single spaces) and
hashed. What a message says itself (level 0) is entered whole by passage, and by
its runs of as many lines as some quoted passage of the conversation has. A
quoted passage is joined to the earliest message of its conversation that says
the same itself, which is its original; messages can only quote earlier turns.
So a quote finds its original if it has a whole passage of it, with any line
breaks, or any run of its lines. A message replies to the latest original of
its passages of the lowest level that has one. A message without such a link
opens a thread of its own. Threads are found by pointer jumping: each round
doubles the distance to the message that a reply is traced to, and the least
turn of a thread names it.

``place`` is a message's number (from 0) in the reply order of its conversation,
by thread and turn: a reply comes after what it answers. Its text has no quoted
lines, and ``formatted`` has the text in the chat template. ``conversations``
puts messages in that order into rows of at most ``MOST`` messages.

Defined cases: a null text is empty. Messages with a null conv_id or turn are
returned without a place, open threads of their own and are linked to nothing.
Rows that repeat a (conv_id, turn) are one message when they are quoted, share
its place, and are each returned. Texts are parsed whole. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, measured, only

QUOTE = r"^(?:[ \t]{0,3}>)+[ \t]?"
#: Shown before and after each message; {role} is the message's role.
TEMPLATE = ("<|{role}|>\n", "<|end|>\n")
#: Messages in a row of ``conversations``.
MOST = 1000


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """``messages`` (place, conv_id, turn, text) -> place, conv_id, turn, level, number, line, passage (normalised)."""
    cut = messages.select("place", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("number", "raw"))
    mark = F.regexp_extract("raw", QUOTE, 0)
    body = F.expr("substring(raw, char_length(mark) + 1)")
    lines = cut.withColumn("mark", mark).select("place", "conv_id", "turn", "number", F.char_length(F.regexp_replace("mark", "[^>]", "")).alias("level"), _normal(body).alias("line"))
    lines = lines.filter("level > 0 or line <> ''")
    by = Window.partitionBy("place").orderBy("number")  # a message's lines
    # filtered-out lines leave a step in the numbers, which ends a passage as an empty quoted line does
    new = (F.lag("level", 1, -1).over(by) != F.col("level")) | (F.lag("line", 1, "").over(by) == "") | (F.lag("number", 1, -2).over(by) + 1 != F.col("number"))
    runs = lines.withColumn("run", F.sum(new.cast("int")).over(by)).filter("line <> ''")
    joined = F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"])
    return runs.groupBy("place", "conv_id", "turn", "level", "run").agg(joined.alias("lines"))


def _hashed(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def links(parsed: DataFrame) -> DataFrame:
    """Quoted passages with their originals: conv_id, turn, level, original (a turn)."""
    whole = F.array_join("lines", " ")
    quoted = parsed.filter("level > 0").select("conv_id", "turn", "level", F.size("lines").alias("m"), *_hashed(whole))
    own = parsed.filter("level = 0")
    # runs of as many lines as a quote of the conversation has; lengths that occur are few, their sum is no more than its lines
    lengths = quoted.select("conv_id", "m").distinct()
    runs = own.join(lengths, "conv_id").filter(F.col("m") < F.size("lines"))
    runs = runs.select("conv_id", "turn", "lines", "m", F.explode(F.sequence(F.lit(1), F.size("lines") - F.col("m") + 1)).alias("at"))
    said = own.select("conv_id", "turn", *_hashed(whole)).unionByName(runs.select("conv_id", "turn", *_hashed(F.array_join(F.slice("lines", F.col("at"), F.col("m")), " "))))
    first = said.groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("original"))
    return quoted.drop("m").join(first, ["conv_id", "h1", "h2"]).filter("original < turn").select("conv_id", "turn", "level", "original")


def reply_order(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, thread), each once -> conv_id, turn, place: its number in its conversation by thread and turn.

    Rows are dealt by ranges of the whole order, so a conversation of any length takes as many tasks as it needs; only
    the numbers of rows by task and the first row of each conversation are joined.
    """
    dealt = messages.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")
    dealt = materialize(dealt.withColumn("id", F.monotonically_increasing_id()), "reply-order")
    task, inside = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(task.alias("task")).agg(F.count("*").alias("n"))  # a row for each task
    before = sizes.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("task", task).join(F.broadcast(before), "task").select("conv_id", "turn", (F.col("before") + inside).alias("rank"))
    first = materialize(ranked.groupBy("conv_id").agg(F.min("rank").alias("first")), "first-messages")
    return ranked.join(first, "conv_id").select("conv_id", "turn", (F.col("rank") - F.col("first")).alias("place"))


def threads(parents: DataFrame) -> DataFrame:
    """``parents`` (conv_id, turn, parent) -> conv_id, turn, thread (the first turn), depth (replies from it)."""
    now = materialize(parents.select("conv_id", "turn", F.col("parent").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        after = now.join(up, ["conv_id", "thread"], "left")
        moved, found = measured(after.select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads", n=F.count_if("moved"))
        now = moved.drop("moved")
        if not found["n"]:
            return now


def format_chats(conversations: DataFrame, template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """A row for each message: conv_id, place, turn, role, text, parent, thread, depth, n_quotes, n_linked, formatted."""
    source = only(conversations, "conv_id", "turn", "role", "text").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quoting = source.filter(F.col("text").rlike(f"(?m){QUOTE}") & named)
    # only conversations with quotes need their messages parsed
    parsed = source.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").filter("turn is not null").withColumn("place", F.monotonically_increasing_id())
    parsed = materialize(passages(materialize(parsed, "quoting")), "passages")
    linked = materialize(links(parsed), "quote-links")
    per_level = linked.groupBy("conv_id", "turn", "level").agg(F.max("original").alias("parent"), F.count("*").alias("n"))
    parents = per_level.groupBy("conv_id", "turn").agg(F.min_by("parent", "level").alias("parent"))
    traced = parents.join(threads(parents), ["conv_id", "turn"])
    quotes = parsed.filter("level > 0").groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    counts = quotes.join(per_level.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked")), ["conv_id", "turn"], "left").join(traced, ["conv_id", "turn"], "left")
    known = source.filter(named).select("conv_id", "turn").distinct().join(counts, ["conv_id", "turn"], "left")
    known = materialize(known.withColumn("thread", F.coalesce("thread", "turn")), "messages")
    known = known.join(reply_order(known.select("conv_id", "turn", "thread")), ["conv_id", "turn"])
    own = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(QUOTE))
    text = F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")
    role = F.coalesce("role", F.lit("user"))

    def filled(form: str) -> Column:
        parts = [x for k, t in enumerate(form.split("{role}")) for x in ([role] if k else []) + [F.lit(t)]]
        return F.concat(*parts)

    got = source.join(known, ["conv_id", "turn"], "left").withColumn("text", text)
    return got.select(
        "conv_id", "place", "turn", "role", "text", "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.concat(filled(template[0]), "text", F.lit("\n"), filled(template[1])).alias("formatted"),
    )


def conversations(messages: DataFrame, most: int = MOST) -> DataFrame:
    """``messages`` of ``format_chats`` -> conv_id, part, n_messages, messages (structs in reply order), text (the formatted whole).

    A part has ``most`` places, so that no conversation is too long for a row; its parts in order are the conversation.
    Equal rows of one message stand once. Messages without a place are in none.
    """
    rows = messages.filter("place is not null").dropDuplicates(["conv_id", "place", "role", "text"])
    each = F.struct("place", "turn", "role", "text", "parent", "thread", "depth", "formatted")
    by_part = rows.groupBy("conv_id", F.floor(F.col("place") / most).alias("part")).agg(F.sort_array(F.collect_list(each)).alias("messages"))
    return by_part.select("conv_id", "part", F.size("messages").alias("n_messages"), "messages", F.array_join(F.col("messages.formatted"), "").alias("text"))
