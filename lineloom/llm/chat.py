"""Chat formatting with tool calls.

Calls and results are hash-joined by (conversation, call id). Edges run from a call to its results:
in the topological order a result comes no earlier than its call and right after that turn's other
messages, whatever order they came in; messages without an edge keep their turn's place. A call's
arguments are parsed, brought to canonical JSON (keys sorted, no spaces) and checked against the
schema of its tool. Every message becomes one canonical JSON line with its position, without gaps,
in its conversation. Only built-in expressions run, and no conversation is gathered in one row: equal
messages are pre-aggregated, positions are numbered within blocks of turns, and blocks are summed up.

Defined results: null content counts as empty; a null role is "unknown"; a result without a
call is "orphan"; a call without a result is "open"; of calls that share an id the first, by
turn, name and arguments, is linked, the others are "repeated", and so are all but one of equal
calls; arguments that are no JSON object or have a key twice, and calls of unknown tools, are
invalid; messages that tie in the topological order stand by turn, kind, role, content, call and
arguments; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm.common import spool

#: Turns of a conversation whose messages one task numbers.
BLOCK_TURNS = 64
#: Types that a schema may name, and the variant type each is read as.
TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
#: Names that schema_of_variant gives values of each type.
SHAPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}


def argument_check(name: Column, value: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether the variant `value` fits the schema of the tool `name`; null if there is no such tool.

    tools: name -> field -> (type, required). Fields beyond the schema are not allowed.
    """
    check = F.lit(None).cast("boolean")
    for tool, fields in tools.items():
        terms = [F.schema_of_variant(value).startswith("OBJECT")]
        for field, (kind, required) in fields.items():
            path = f"$['{field}']"
            shape = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            fits = reduce(lambda a, b: a | b, [shape.startswith(s) for s in SHAPES[kind]])
            terms.append(F.coalesce(fits, F.lit(not required)))
        known = F.array(*[F.lit(f) for f in fields])
        extra = F.size(F.array_except(F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>")), known)) == 0
        check = F.when(name == tool, reduce(lambda a, b: a & b, terms) & extra).otherwise(check)
    return check


def canonical(text: Column) -> Column:
    """The JSON text with sorted keys and no spaces; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(text))


def positions(rows: DataFrame, order: list[Column], turn: str, copies: str) -> DataFrame:
    """`rows` with `before`: how many messages of the conversation come before the row in `order`,
    which starts with `turn`; a row stands for `copies` messages."""
    rows = rows.withColumn("block", F.floor(F.col(turn) / BLOCK_TURNS))
    by_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_row = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum(copies).alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("of_conv"), F.col("block").alias("of_block"), F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("earlier"))
    numbered = rows.withColumn("inside", F.coalesce(F.sum(copies).over(by_row), F.lit(0)))
    joined = numbered.join(blocks, numbered.conv_id.eqNullSafe(blocks.of_conv) & numbered.block.eqNullSafe(blocks.of_block))
    return joined.withColumn("before", F.col("earlier") + F.col("inside")).drop("block", "of_conv", "of_block", "earlier", "inside")


def link(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per message with its link, order and canonical line.

    messages: conv_id, turn, role, content, and call_id, call_name, call_arguments (of a message
    that calls a tool), result_of (the call id that a message answers).
    Returns conv_id, turn, role, kind, link, call_id, order_turn, order_rank, position, valid, line.
    """
    plain = ["conv_id", "turn", "role", "content", "call_id", "call_name", "call_arguments", "result_of"]
    m = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("content", F.lit("")).alias("content"),
        "call_id", "call_name", "call_arguments", "result_of",
    )
    # written, since it is read for the sums and for the messages; contents are shuffled for neither twice
    m = spool(m.groupBy(*plain).agg(F.count("*").alias("copies")).withColumn("link_id", F.coalesce("call_id", "result_of")), "messages")
    # one row per call id, pre-aggregated: the first call, and how many results it has
    is_call = F.col("call_id").isNotNull()
    this_call = F.struct("turn", "call_name", "call_arguments", "role", "content")
    sums = m.where("link_id is not null").groupBy("conv_id", "link_id").agg(F.min(F.when(is_call, this_call)).alias("first_call"), F.count(F.when(~is_call, True)).alias("results"))
    sums = sums.withColumnsRenamed({"conv_id": "sum_conv", "link_id": "sum_link"}).hint("shuffle_hash")
    joined = m.join(sums, m.conv_id.eqNullSafe(sums.sum_conv) & (m.link_id == sums.sum_link), "left")
    kind = F.when(is_call, "call").when(F.col("result_of").isNotNull(), "result").otherwise("message")
    rows = joined.select(
        *plain, "copies", "link_id", kind.alias("kind"), "first_call", "results", this_call.eqNullSafe(F.col("first_call")).alias("is_first"),
        F.greatest("turn", F.when(kind == "result", F.col("first_call.turn"))).alias("order_turn"), F.when(kind == "result", 1).otherwise(0).alias("order_rank"),
    )
    rows = positions(spool(rows, "linked"), [F.col(c) for c in ("order_turn", "order_rank", "turn", "kind", "role", "content", "link_id", "call_name", "call_arguments")], "order_turn", "copies")
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy", "copy_number")).drop("copy_number")
    value = F.try_parse_json("call_arguments")
    state = F.when(F.col("kind") == "call", F.when(~F.col("is_first") | (F.col("copy") > 0), "repeated").when(F.col("results") > 0, "linked").otherwise("open")).when(F.col("kind") == "result", F.when(F.col("first_call").isNull(), "orphan").otherwise("linked")).otherwise("none")
    valid = F.when(F.col("kind") == "call", F.coalesce(argument_check(F.col("call_name"), value, tools), F.lit(False)))
    call = F.when(F.col("kind") == "call", F.struct(F.coalesce(F.to_json(value), F.lit("")).alias("arguments"), F.col("link_id").alias("id"), F.coalesce("call_name", F.lit("")).alias("name")))
    line = F.to_json(F.struct("content", "role", call.alias("tool_call"), F.when(F.col("kind") == "result", F.col("link_id")).alias("tool_call_id")))
    return rows.select("conv_id", "turn", "role", "kind", state.alias("link"), F.col("link_id").alias("call_id"), "order_turn", "order_rank", (F.col("before") + F.col("copy")).cast("long").alias("position"), valid.alias("valid"), line.alias("line"))


#: The schemas that the query's calls are held to.
TOOLS = {
    "reply": {"chars": ("integer", True), "text": ("string", True), "turn": ("integer", True)},
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "count": {"chars": ("number", True)},
}


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Turns of plain conversations as tool traffic; what varies depends on turn and text length n alone.

    A user turn is a call and an assistant turn a result; other turns are plain messages. A call's
    id is its turn's; of turns 4 and 5 of 6, the id of the user turn before, so that ids repeat. A
    result answers the turn before; for every third n the turn after it, so that it comes ahead of
    its call, or has none. n picks the tool, one that has no schema included, and which arguments
    are truncated, miss a field, have one too many or one of another type.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    n = F.length(text)
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    tool = F.when(n % 16 == 3, "nothing").when(n % 4 == 1, "search").when(n % 4 == 2, "count").otherwise("reply")
    # keys out of order on purpose: the operator sorts them
    reply = F.to_json(F.struct(turn.alias("turn"), text.alias("text"), F.when(n % 12 == 0, True).alias("more"), n.alias("chars")))
    reply = F.when(n % 20 == 4, F.substring(reply, F.lit(1), F.length(reply) - 1)).otherwise(reply)
    search = F.when(n % 5 == 0, F.to_json(F.struct(text.alias("query"), (n % 7).cast("string").alias("limit")))).otherwise(F.to_json(F.struct(text.alias("query"), (n % 7).alias("limit"))))
    count = F.when(n % 10 == 2, "{}").otherwise(F.concat(F.lit('{ "chars" : '), n.cast("string"), F.lit(".5}")))
    arguments = F.when(tool == "search", search).when(tool == "count", count).otherwise(reply)
    return conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.when(asks, F.concat_ws(":", "conv_id", turn - F.when(turn % 6 >= 4, 2).otherwise(0))).alias("call_id"), F.when(asks, tool).alias("call_name"), F.when(asks, arguments).alias("call_arguments"),
        F.when(answers, F.concat_ws(":", "conv_id", turn + F.when(n % 3 == 0, 1).otherwise(-1))).alias("result_of"),
    )
