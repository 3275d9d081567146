"""Chat formatting from event logs, in DataFrame and SQL functions only.

A log holds, by conversation and sequence number, the events of messages: streamed deltas, edits and
regenerations. The log is folded twice: events into messages, then messages into conversations. Only
what ends up in one text is brought together.

The template writes a turn as ``### role: text</turn>`` and a line feed. Inside texts and roles the
backslash, the turn marks and (in roles) the colon are written as a backslash and a letter, so that
marks in the output are always marks, and ``parsed`` reads back what was written.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "### ", "</turn>\n"
#: Control strings and what stands for them; the backslash goes first when writing.
CODES = [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e")]


def escaped(text, role=False):
    for plain, code in CODES + [(":", "\\c")] * role:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text, role=False):
    """The reverse: backslashes come in pairs from the left, so what stands between pairs holds codes only."""
    def part(x):
        for plain, code in CODES[1:] + [(":", "\\c")] * role:
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def messages(events):
    """(conv_id, message, role, text): the final messages of an event log.

    ``events``: conv_id, seq, message (its place in the conversation), kind, role, text. A delta adds
    text; an edit puts its text in place of what the message held; a regeneration empties the message.
    Edits and regenerations also take back the later messages that were complete by then, as the
    conversation goes on from there. Events of equal seq apply in the order of kind, role and text; other
    kinds and null texts add nothing; a message's role is the first that is not null, or empty.
    """
    event = F.struct("seq", "kind", "role", "text")
    rows = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("e"))
    resets = F.filter("e", lambda x: x["kind"].isin("edit", "regenerate"))
    rows = rows.withColumn("reset", F.array_max(F.transform(resets, lambda x: x["seq"])))
    rows = rows.withColumn("last", F.array_max(F.transform("e", lambda x: x["seq"])))
    kept = F.filter("e", lambda x: F.col("reset").isNull() | (x["seq"] >= F.col("reset")))
    text = F.transform(kept, lambda x: F.when(x["kind"].isin("delta", "edit"), F.coalesce(x["text"], F.lit(""))).otherwise(""))
    role = F.get(F.transform(F.filter("e", lambda x: x["role"].isNotNull()), lambda x: x["role"]), F.lit(0))
    rows = rows.select("conv_id", "message", "reset", "last", F.coalesce(role, F.lit("")).alias("role"), F.array_join(text, "").alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cut", F.max("reset").over(earlier))
    return rows.where("cut IS NULL OR cut <= last").select("conv_id", "message", "role", "text")


def rendered(final, learn="assistant"):
    """(conv_id, formatted, spans): one text per conversation, and the (start, end) code points to learn from."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit(": "))
    turn = F.concat(head, escaped(F.col("text")), F.lit(CLOSE))
    sizes = final.select("conv_id", F.struct(
        "message", turn.alias("turn"), F.length(turn).alias("n"), F.length(head).alias("head"), (F.col("role") == learn).alias("learn")
    ).alias("m"))
    rows = sizes.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    formatted = F.array_join(F.transform("m", lambda x: x["turn"]), "")
    spans = F.expr(f"""aggregate(m, named_struct('at', 0L, 's', CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)),
      (st, x) -> named_struct('at', st.at + x.n, 's', IF(x.learn,
        concat(st.s, array(named_struct('start', st.at + x.head, 'end', st.at + x.n - {len(CLOSE)}))), st.s)), st -> st.s)""")
    return rows.select("conv_id", formatted.alias("formatted"), spans.alias("spans"))


def parsed(formatted):
    """The turns of a formatted text as an array of (role, text)."""
    parts = F.split(formatted, CLOSE, -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def read(turn):
        body = F.substr(turn, F.lit(len(OPEN) + 1))
        cut = F.instr(body, ":")
        role = F.substr(body, F.lit(1), cut - 1)
        return F.struct(unescaped(role, True).alias("role"), unescaped(F.substr(body, cut + 2)).alias("text"))

    return F.transform(turns, read)


def learned(formatted, spans):
    """The text under the loss mask, unescaped, with nothing between the parts."""
    part = lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, part), "")


def streamed(rows):
    """The event log of a table of turns (conv_id, turn, role, text), as a streaming service writes it.

    Rows of a conversation are its messages by turn (ties by role and text). Each arrives as two deltas;
    an assistant's is first streamed by half, then regenerated, a user's is sent and then edited to what
    it already says. The final messages are the rows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    event = lambda k, kind, t: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), t.alias("text"))
    plain = [event(0, "delta", left), event(1, "delta", right)]
    again = [event(2, "regenerate", F.lit(None).cast("string")), event(3, "delta", left), event(4, "delta", right)]
    events = F.when(F.col("role") == "assistant", F.array(*plain[:1], *again)).when(
        F.col("role") == "user", F.array(*plain, event(2, "edit", text))
    ).otherwise(F.array(*plain))
    rows = rows.select("conv_id", "role", F.row_number().over(order).cast("long").alias("message"), events.alias("events"))
    rows = rows.select("conv_id", "role", "message", F.explode("events").alias("e"))
    return rows.select("conv_id", (F.col("message") * 8 + F.col("e.k")).alias("seq"), "message", "e.kind", "role", "e.text")
