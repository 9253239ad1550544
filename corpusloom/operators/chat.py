"""Conversations: message order, visible history, token estimates.

A conversation of any length is cut into parts of bounded size by its turn numbers, and totals of
earlier parts are carried forward, so no single task has to hold one conversation. What a call sees is
a range of messages, looked up part by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import hooks, text
from corpusloom.schemas import ModelSpec

PART_TURNS = 10_000
# Places over which the rows of one conversation are dealt when they meet a single row of it.
PLACES = 16


def running_totals(messages: DataFrame, conversation: tuple[str, ...] = ("conv_id",), order: str = "turn", **values: Column) -> DataFrame:
    """Add running sums over the turns of each conversation. Turns are unique within it."""
    part = F.floor(F.col(order) / PART_TURNS).alias("__part")
    cut = messages.select("*", part, *[value.cast("bigint").alias(f"__{name}") for name, value in values.items()])
    keys = [*conversation, "__part"]
    totals = cut.groupBy(*keys).agg(*[F.sum(f"__{name}").alias(name) for name in values])
    earlier = Window.partitionBy(*conversation).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, *[
        F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__before_{name}") for name in values])
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(carried, keys).select(*messages.columns, *[
        (F.col(f"__before_{name}") + F.sum(f"__{name}").over(inside)).alias(name) for name in values])


def chat_messages(messages: DataFrame, system_prompt: str = "") -> DataFrame:
    """Messages for a chat model: ``conv_id, position, kind, text``.

    The optional system prompt comes first, stored system rows are left out, the assistant speaks as
    ``ai`` and every other role as ``human``.
    """
    spoken = messages.filter(F.col("role") != "system")
    numbered = running_totals(spoken, position=F.lit(1))
    kind = F.when(F.col("role") == "assistant", "ai").otherwise("human")
    chat = numbered.select("conv_id", "position", kind.alias("kind"), "text")
    if not system_prompt:
        return chat
    first = messages.select("conv_id").distinct().select(
        "conv_id", F.lit(0).cast("bigint").alias("position"), F.lit("system").alias("kind"),
        F.lit(system_prompt).alias("text"))
    return first.unionByName(chat)


def since_clear(messages: DataFrame, clears: DataFrame) -> DataFrame:
    """What is left now: without what came up to the last clear. ``clears`` has ``conv_id, cleared_at`` (a turn)."""
    last = clears.groupBy("conv_id").agg(F.max("cleared_at").alias("cleared_at"))
    # A long conversation is met in several places.
    last = last.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    spread = messages.withColumn("__place", F.pmod(F.col("turn"), F.lit(PLACES)).cast("int"))
    kept = spread.join(last, ["conv_id", "__place"], "left").filter(
        F.col("cleared_at").isNull() | (F.col("turn") > F.col("cleared_at")))
    return kept.drop("cleared_at", "__place")


def epochs(messages: DataFrame, clears: DataFrame) -> DataFrame:
    """Add ``epoch``, the number of clears before each message: a call sees the messages of its own epoch only."""
    marks = clears.select("conv_id", F.col("cleared_at").alias("turn")).distinct().withColumn("__mark", F.lit(1))
    both = messages.withColumn("__mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    # A clear follows the message of its turn.
    both = both.withColumn("__order", F.col("turn") * 2 + F.col("__mark"))
    counted = running_totals(both, order="__order", epoch=F.col("__mark"))
    return counted.filter("__mark = 0").drop("__mark", "__order")


def history_asof(messages: DataFrame, conversation: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Size of what each call sees: messages and characters of its conversation up to its own turn."""
    return running_totals(messages, conversation, n_messages=F.lit(1), n_chars=F.length("text"))


def last_calls(messages: DataFrame) -> DataFrame:
    """The call of each conversation's last turn: ``conv_id, as_of``."""
    return messages.groupBy("conv_id").agg(F.max("turn").alias("as_of"))


def all_calls(messages: DataFrame, role: str | None = None, conversation: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """A call at every turn (of a role): ``call_id, conv_id, as_of``."""
    asked = messages.filter(F.col("role") == role) if role else messages
    return asked.select(F.concat_ws("-", *conversation, "turn").alias("call_id"), *conversation, F.col("turn").alias("as_of"))


def history_of(calls: DataFrame, messages: DataFrame, conversation: tuple[str, ...] = ("conv_id",), context_chars: int | None = None) -> DataFrame:
    """Texts seen by calls (``conv_id, as_of``): the columns of both, one row for each visible message.

    Calls and messages meet by conversation *and* part, so a long conversation is many small joins. Without a bound the parts are those of the turns, and a call meets all
    parts up to its own. With ``context_chars`` a call, made at a turn of the conversation, sees as many of the last messages as fit (an empty message counts as one character), its own message
    in any case; parts are stretches of so many characters, and a call meets two of them.
    """
    keys = [*conversation, "__part"]
    if context_chars is None:
        part = F.floor(F.col("as_of") / PART_TURNS)
        first = messages.select(*conversation, F.floor(F.col("turn") / PART_TURNS).alias("__part")).distinct()
        first = first.groupBy(*conversation).agg(F.min("__part").alias("__first"))
        asked = _per_conversation(calls, first, conversation).withColumn("__part", F.explode(F.when(part >= F.col("__first"), F.sequence("__first", part)))).drop("__first")
        return messages.withColumn("__part", F.floor(F.col("turn") / PART_TURNS)).join(asked, keys).filter(F.col("turn") <= F.col("as_of")).drop("__part")
    size = F.greatest(F.length("text"), F.lit(1))
    placed = running_totals(messages, conversation, __total=size)
    ends = placed.select(*conversation, F.col("turn").alias("as_of"), F.col("__total").alias("__end"))
    bucket = F.floor(F.col("__end") / context_chars)
    asked = calls.join(ends, [*conversation, "as_of"]).withColumn("__part", F.explode(F.array(bucket, bucket - 1)))
    seen = placed.withColumn("__part", F.floor(F.col("__total") / context_chars)).join(asked, keys)
    fits = (F.col("__end") - F.col("__total") + size <= context_chars) | (F.col("turn") == F.col("as_of"))
    return seen.filter((F.col("turn") <= F.col("as_of")) & fits).drop("__part", "__end", "__total")


def _per_conversation(rows: DataFrame, one_each: DataFrame, conversation: tuple[str, ...]) -> DataFrame:
    """Join with a table of one row for each conversation, the rows of a long one in several places."""
    one_each = one_each.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    rows = rows.withColumn("__place", F.pmod(F.col("as_of"), F.lit(PLACES)).cast("int"))
    return rows.join(one_each, [*conversation, "__place"]).drop("__place")


def call_messages(calls: DataFrame, messages: DataFrame, system_prompt: str = "", context_chars: int | None = None) -> DataFrame:
    """Model messages of chosen calls (``call_id, conv_id, as_of``), ready for ``hooks.generate_chat``: what ``history_of`` shows of all but stored system rows."""
    seen = history_of(calls, messages.filter(F.col("role") != "system"), context_chars=context_chars)
    kind = F.when(F.col("role") == "assistant", "ai").otherwise("human")
    chat = seen.select("call_id", F.col("turn").alias("position"), kind.alias("kind"), "text")
    if not system_prompt:
        return chat
    first = calls.select("call_id", F.lit(-1).cast("bigint").alias("position"), F.lit("system").alias("kind"),
                         F.lit(system_prompt).alias("text"))
    return first.unionByName(chat)


def replies(calls: DataFrame, messages: DataFrame, factory, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """A model's reply to each call: ``call_id, content, success, error``. The model's own settings give the system prompt and, with ``context_tokens``, the bound on what one call holds."""
    bound = None if spec.context_tokens is None else spec.context_tokens * text.CHARS_PER_TOKEN
    return hooks.generate_chat(call_messages(calls, messages, spec.system_prompt, bound), factory, spec)


def token_totals(messages: DataFrame) -> DataFrame:
    """Token estimate of each whole conversation."""
    sums = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"))
    return sums.withColumn("est_tokens", text.token_estimate(F.col("n_chars")))


def token_estimates(messages: DataFrame) -> DataFrame:
    """Token estimate of the history after each turn."""
    running = running_totals(messages.select("conv_id", "turn", F.length("text").alias("__length")),
                             n_chars=F.col("__length"))
    return running.select("conv_id", "turn", "n_chars", text.token_estimate(F.col("n_chars")).alias("est_tokens"))
