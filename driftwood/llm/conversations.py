"""Chat formatting by event sourcing: logs of streamed events are folded into messages, then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftwood.functions.text import let

START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"   # fixed values: the template's marks
MARK = "<|"
PIECE = 1000   # code points of a text that one delta carries

# Every control string begins with "<|": it is broken up, and what breaks it up is escaped first.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("\n", "&#10;"))


def escape(text: Column, role: bool = False) -> Column:
    """Control strings made harmless, reversibly; a role also keeps off line ends, as a line end closes it."""
    for plain, escaped in ESCAPES[:3 if role else 2]:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, escaped in reversed(ESCAPES[:3 if role else 2]):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _pieces(text: Column, size: int) -> Column:
    """The text cut every ``size`` code points, in one walk over it; none of an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def as_events(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", piece: int = PIECE) -> DataFrame:
    """A log of events from rows that hold a whole turn each: an opening, and its text in deltas of ``piece`` code points.

    Messages are numbered by ``order``, then role and text, null first, so rows that repeat a turn stay messages of
    their own.
    """
    place = F.row_number().over(W.partitionBy(conversation).orderBy(order, "role", "text"))
    numbered = turns.select(F.col(conversation).alias("conversation"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"), place.cast("long").alias("message"))
    opened = F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("text"), F.lit(0).alias("part")))
    deltas = F.transform(
        _pieces(F.col("text"), piece), lambda text, i: F.struct(F.lit("delta").alias("kind"), text.alias("text"), (i + 1).alias("part")))
    event = F.explode(F.concat(opened, deltas))
    return numbered.select("conversation", "message", "role", event.alias("event")).select(
        "conversation", "message", "role", F.col("event.kind").alias("kind"), F.col("event.text").alias("text"),
        (F.shiftleft(F.col("message"), 32) + F.col("event.part")).alias("seq"))


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages of a log: ``conversation``, ``message``, ``role`` and ``text``.

    Events have a ``conversation``, a ``seq`` that orders it, the number of the ``message`` they belong to, a ``role``,
    a ``kind`` and a ``text``. "open" begins a message, "delta" adds to it, "edit" replaces all there is of it so far,
    "regenerate" empties it and takes back all messages behind it as they are so far: what these get later stands.
    A message without an event that stands is gone. Null texts are empty, the role is that of the message's last event
    that has one, and unknown kinds fail. Events that repeat a ``seq`` follow each other by kind and text.

    Deltas are gathered per message and messages per conversation, never more rows than one output row holds.
    """
    kind = F.when(F.col("kind").isin("open", "delta", "edit", "regenerate"), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    known = events.select("conversation", "message", "seq", "role", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = W.partitionBy("conversation").orderBy("seq", "kind", "text")
    placed = known.withColumn("place", F.row_number().over(in_order))
    whole = W.partitionBy("conversation", "message").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = placed.withColumn("role", F.last("role", ignorenulls=True).over(whole))
    # A message is taken back by the last regeneration of an earlier one; that of its own empties it too.
    by_message = W.partitionBy("conversation").orderBy("message").rangeBetween(W.unboundedPreceding, 0)
    emptied = F.max(F.when(F.col("kind") == "regenerate", F.col("place"))).over(by_message)
    own = F.max(F.when(F.col("kind").isin("regenerate", "edit"), F.col("place"))).over(W.partitionBy("conversation", "message"))
    standing = placed.withColumn("cut", F.greatest(F.coalesce(emptied, F.lit(0)), F.coalesce(own, F.lit(0)))).filter("place >= cut")
    # The regeneration itself stands for its own message, as an empty beginning.
    folded = standing.groupBy("conversation", "message").agg(
        F.array_sort(F.collect_list(F.struct("place", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))).alias("parts"),
        F.max("role").alias("role"))
    return folded.select("conversation", "message", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conversation``, ``formatted`` and ``loss_mask``.

    The template marks a turn as ``<|im_start|>role``, a line end, the escaped text, ``<|im_end|>`` and a line end.
    The mask lists the places ``(begin, end)`` of the escaped texts of ``learned_role``, in code points, end exclusive.
    A null role is empty.
    """
    role = escape(F.coalesce("role", F.lit("")), role=True)
    turn = messages.select("conversation", "message", F.col("role").eqNullSafe(learned_role).alias("learned"),
                           F.concat(F.lit(START), role, F.lit(LINE)).alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("turn", F.concat("head", "body", F.lit(END + LINE)))
    before = F.sum(F.char_length("turn")).over(W.partitionBy("conversation").orderBy("message").rowsBetween(W.unboundedPreceding, -1))
    begin = (F.coalesce(before, F.lit(0)) + F.char_length("head")).cast("long")
    spans = turn.withColumn("begin", begin).withColumn("end", F.col("begin") + F.char_length("body"))
    gathered = spans.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("message", "turn", "learned", "begin", "end"))).alias("turns"))
    return gathered.select(
        "conversation", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end"))).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation; escaped texts hold no end mark, so it parts them."""
    turns = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), 1, F.greatest(F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substring(t, len(START) + 1, F.char_length(t)), LINE, 1), role=True).alias("role"),
        unescape(F.substring(t, F.position(F.lit(LINE), t) + 1, F.char_length(t))).alias("text")))


def masked(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between.

    The text is cut up once; each span then touches the pieces that it lies in, and not all of the text before it.
    """
    def under(pieces: Column) -> Column:
        def text(span: Column) -> Column:
            first = F.floor(span["begin"] / PIECE).cast("int")
            last = F.floor((span["end"] - 1) / PIECE).cast("int")
            here = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return unescape(F.substring(here, (span["begin"] - first * PIECE + 1).cast("int"), (span["end"] - span["begin"]).cast("int")))
        return F.array_join(F.transform(loss_mask, text), "")

    return let(_pieces(formatted, PIECE), under)


def digests(rendered: DataFrame) -> DataFrame:
    """What reading the output back gives: turns, their digest, and the text to learn with its digest."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        rendered.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_mask")))
        .select(
            F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"))
    )
