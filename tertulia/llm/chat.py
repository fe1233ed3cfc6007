"""Chat formatting from an event log.

A conversation is a log of events. Partitioned by conversation and sorted by sequence, the events of
each message are folded into its final text, messages that a regeneration discarded are left out, and
what remains is rendered with a template. All of it is DataFrame operations.

The template marks a turn as `<turn:ROLE>TEXT</turn>` and a line end. In texts and roles `&`, `<` and
`>` are written as entities, so no text can hold a mark and every text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tertulia.llm.columns import let

OPEN, MIDDLE, CLOSE = "<turn:", ">", "</turn>\n"
TURN = "<turn:([^>]*+)>([^<]*+)</turn>\n"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))  # "&" first when escaping, last when reading


def escaped(text: Column) -> Column:
    for plain, entity in _ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(_ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log with conv_id, turn, seq, kind, role and text.

    kind      message     begins a message of its turn; another one begins a second message there
              delta       adds its text to the message begun last
              edit        replaces the text of that message
              regenerate  replaces it too, and discards the later turns that the log had by then
    Any other kind, or none, counts as a message. The last event that names a role sets the role.
    Events of one turn with equal seq are taken in the order message, edit, delta, regenerate, then by
    text and role. A missing text is empty; a missing turn or seq comes first.

    A message is folded from its own events alone, so a long conversation is spread over many tasks;
    only the running maximum that finds discarded turns goes through a conversation in order.
    """
    ranks = {"edit": 1, "delta": 2, "regenerate": 3}
    rank = F.coalesce(*[F.when(F.col("kind") == kind, n) for kind, n in ranks.items()], F.lit(0))
    event = F.struct(
        F.col("seq").cast("long").alias("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role")
    )
    logs = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    begins = F.filter(F.transform("log", lambda e, i: F.when((e["rank"] == 0) | (i == 0), i)), lambda i: i.isNotNull())
    parts = logs.withColumn("begins", begins).select(
        "conv_id",
        "turn",
        F.posexplode(
            F.transform(
                "begins",
                lambda b, k: F.slice("log", b + 1, F.coalesce(F.get("begins", k + 1), F.size("log")) - b),
            )
        ).alias("part", "own"),
    )
    is_reset = lambda e, i: F.when(e["rank"] != 2, i).otherwise(0)
    reset = F.array_max(F.transform("own", is_reset))
    roles = F.filter(F.transform("own", lambda e: e["role"]), lambda r: r.isNotNull())
    redone = F.array_max(F.transform("own", lambda e: F.when(e["rank"] == 3, e["seq"])))
    folded = parts.withColumn("reset", reset).select(
        "conv_id",
        "turn",
        "part",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("own", F.col("reset") + 1, F.size("own")), lambda e: e["text"]), "").alias("text"),
        F.coalesce(redone, F.get("own", F.lit(0))["seq"]).alias("began"),
        redone.alias("redone"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max("redone").over(earlier) > F.col("began"), F.lit(False))
    return folded.withColumn("gone", gone).where(~F.col("gone")).drop("gone", "began", "redone")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A row for each conversation: `formatted`, and `loss`, the places of the texts to learn from.

    Places are start and end in code points of `formatted`, in order, without the marks around them.
    """
    piece = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), F.lit(CLOSE))
    marked = messages.withColumn("piece", piece).withColumn("chars", F.length("piece").cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("chars").over(so_far) - len(CLOSE)
    begin = end - F.length(escaped(F.col("text")))
    place = F.when(F.col("role") == loss_role, F.struct(begin.alias("start"), end.alias("end")))
    turn = F.struct("turn", "part", "piece", "place")
    joined = marked.withColumn("place", place).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return joined.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.place", lambda p: p.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Role and text of every turn, from the formatted conversation alone."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text")))


def read_loss(rendered: DataFrame, block: int = 4096) -> DataFrame:
    """`rendered` with `loss_texts`, the unescaped texts at the places of `loss`.

    The conversation is cut into blocks once, so that reading a place does not count characters from
    the beginning.
    """
    blocks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def read(cut: Column, p: Column) -> Column:
        first, last = F.floor(p["start"] / block).cast("int"), F.floor(p["end"] / block).cast("int")
        around = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
        return unescaped(F.substring(around, (p["start"] % block + 1).cast("int"), (p["end"] - p["start"]).cast("int")))

    texts = let(blocks, lambda cut: F.transform("loss", lambda p: read(cut, p)))
    return rendered.withColumn("loss_texts", texts)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table with a row for each turn, as a log in which each row begins a message."""
    return conversations.select(
        "conv_id", "turn", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold an event log and render it: conv_id, `formatted` and `loss`.

    Rows without conv_id form one conversation. A missing text or role is empty, rows that repeat a
    message are messages of their own, no rows give no conversations, and other columns are ignored.
    """
    return render(fold(events), loss_role)
