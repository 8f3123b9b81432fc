"""Chat formatting from event logs.

A log holds, for each conversation, numbered events: streamed deltas that add
to a turn, edits that replace its text, and regenerations that throw away what
was streamed. Events are folded turn by turn in the order of their numbers into
final messages, and these are rendered:

    ### role:
    text</turn>

Control strings within roles and texts are escaped: a backslash becomes \\b,
three number signs \\h, an end mark \\e, and in roles a line feed \\l. Every
backslash of an escaped text starts one of these codes, so the original is
found again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.registry import query
from cartwise.llm.shared import table, text_or_empty

HEADER, END = "### ", "</turn>"
#: (plain, code) in the order of escaping; the backslash comes first.
CODES = (("\\", "\\b"), ("###", "\\h"), (END, "\\e"), ("\n", "\\l"))
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, lines: bool = False) -> Column:
    for plain, code in CODES[: 4 if lines else 3]:
        text = _replace(text, plain, code)
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = _replace(text, code, plain)
    return text


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, copy, role, text: final messages of (conv_id, turn, copy,
    seq, kind, role, text) events; `copy` tells messages of one turn apart.

    The events of a turn are put in the order of seq (equal numbers: kind,
    role, text) and folded: a delta adds its text, an edit replaces all text
    so far, a regeneration empties it. The role is that of the last event that
    names one; a null text adds nothing; an unknown kind changes nothing. A turn,
    not a conversation, is gathered in one row, so long conversations spread.
    """
    event = F.struct("seq", "kind", "role", text_or_empty().alias("text"))
    first = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))

    def step(state: Column, x: Column) -> Column:
        text = (
            F.when(x["kind"] == DELTA, F.concat(state["text"], x["text"])).when(x["kind"] == EDIT, x["text"])
            .when(x["kind"] == REGENERATE, F.lit("")).otherwise(state["text"])
        )
        return F.struct(F.coalesce(x["role"], state["role"]).alias("role"), text.alias("text"))

    gathered = events.groupBy("conv_id", "turn", "copy").agg(F.array_sort(F.collect_list(event)).alias("events"))
    return gathered.select("conv_id", "turn", "copy", F.aggregate("events", first, step).alias("m")).select("conv_id", "turn", "copy", "m.role", "m.text")


def render(messages: DataFrame) -> DataFrame:
    """`messages` with the column `rendered`: each one in the template."""
    role = escape(F.coalesce("role", F.lit("")), lines=True)
    return messages.withColumn("rendered", F.concat(F.lit(HEADER), role, F.lit(":\n"), escape(text_or_empty()), F.lit(END + "\n")))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted: one text for each conversation, messages by turn
    (null first) and copy. A formatted conversation is one value by its nature, so its
    messages meet in one row here and not before."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "copy", "rendered")))
    return render(messages).groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["rendered"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """Messages of a formatted conversation: role, text as they were, and
    whether the loss covers the text (those of the assistant)."""
    blocks = F.split(F.left(formatted, F.length(formatted) - len(END) - 1), END + "\n", -1)

    def parsed(block: Column) -> Column:
        at = F.instr(block, "\n")  # of the header: in a role it is escaped
        role = unescape(F.substring(block, F.lit(len(HEADER) + 1), at - F.lit(len(HEADER) + 2)))
        text = unescape(F.substring(block, at + 1, F.length(block)))
        return F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("loss"))

    return F.transform(blocks, parsed)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from (conv_id, formatted)."""
    found = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("m"))
    lost = F.array_join(F.transform(F.filter("m", lambda x: x["loss"]), lambda x: x["text"]), "")
    turns = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("m").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(rows: DataFrame) -> DataFrame:
    """An event log whose final messages are `rows` (conv_id, turn, role,
    text): texts arrive in two deltas; those of the assistant are first
    streamed in part and then regenerated, those of every other user turn are
    sent with an addition and then edited. Rows that share a turn are copies
    of it, in the order of role and text, and all of them stay."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.withColumn("copy", F.row_number().over(same))
    text = text_or_empty()
    half = F.floor(F.length(text) / 2).cast("int")
    start, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def event(seq: int, kind: str, value: Column) -> Column:
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), value.alias("text"))

    streamed = F.array(event(0, DELTA, start), event(1, REGENERATE, F.lit("")), event(2, DELTA, start), event(3, DELTA, rest))
    edited = F.array(event(0, DELTA, F.concat(text, F.lit(" ..."))), event(1, EDIT, text))
    plain = F.array(event(0, DELTA, start), event(1, DELTA, rest))
    events = F.when(F.col("role") == "assistant", streamed).when((F.col("role") == "user") & (F.pmod(F.coalesce("turn", F.lit(0)), F.lit(4)) == 0), edited).otherwise(plain)
    return rows.select("conv_id", "turn", "copy", "role", F.explode(events).alias("e")).select("conv_id", "turn", "copy", "role", "e.seq", "e.kind", "e.text")


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 14 + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op8_chat_formatting", OP8_SQL)
def op8_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    return digests(conversations(fold(as_events(rows.unionByName(probe)))))
