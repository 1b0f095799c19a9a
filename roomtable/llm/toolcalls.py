"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON.

DataFrame functions only. A conversation is never gathered: each message is a row, its
place in the conversation a number, and its JSON a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomtable.llm.shared import cut_lineage

#: Rows of one conversation that one task numbers; a longer one is dealt to several by turn.
NUMBERED_AT_ONCE = 4096
#: Schema of a tool's arguments: name, whether it must be there, JSON type, longest string.
TEXT_TOOL = (("text", True, "string", 100_000), ("turn", True, "integer", None))


def canonical_string(text: Column) -> Column:
    """A JSON string, written in one way: short escapes where there are any, all else as it is."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    rest = [i for i in range(32) if i not in (8, 9, 10, 12, 13)]
    plain = F.when(
        text.rlike("[\\x00-\\x1f]"),
        _replaced(text, [(chr(i), f"\\u{i:04x}") for i in rest]),
    ).otherwise(text)
    return F.concat(F.lit('"'), plain, F.lit('"'))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, written in pairs:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def canonical_object(fields: dict[str, Column]) -> Column:
    """A JSON object with its names in order and no blanks; a null value is left out."""
    parts = [F.concat(F.lit(f'"{name}":'), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def argument_problems(arguments: dict[str, Column], schema: tuple = TEXT_TOOL) -> Column:
    """Sorted codes of what the arguments break: missing, type, length."""
    codes = []
    for name, needed, kind, longest in schema:
        value = arguments[name]
        if needed:
            codes.append(F.when(value.isNull(), f"missing:{name}"))
        if kind == "integer":
            codes.append(F.when(value.cast("long").isNull() & value.isNotNull(), f"type:{name}"))
        if longest is not None:
            codes.append(F.when(F.length(value) > longest, f"length:{name}"))
            codes.append(F.when(F.length(value) == 0, f"empty:{name}"))
    return F.array_sort(F.array_compact(F.array(*codes)))


def numbered(rows: DataFrame, group: str, order: list[str], at_once: int = NUMBERED_AT_ONCE) -> DataFrame:
    """`rows` with `position`: 0, 1, ... within each group in the given order, first column a number.

    The first order column is cut to spans of `at_once`, so a task sees a span of a
    group; positions start where the spans before it end. A span that is full of equal
    values is dealt no further.
    """
    span = F.floor(F.coalesce(F.col(order[0]), F.lit(-1)) / F.lit(at_once))
    dealt = rows.withColumn("span", span)
    sizes = dealt.groupBy(group, "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("g"), F.col("span").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = dealt.withColumn("nth", F.row_number().over(Window.partitionBy(group, "span").orderBy(*order)) - 1)
    joined = own.join(sizes, own[group].eqNullSafe(sizes["g"]) & (own["span"] == sizes["s"]))
    return joined.select(*[own[c] for c in rows.columns], (own["nth"] + sizes["before"]).alias("position"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way to a node over `edges` (before, after); -1 on or behind a circle.

    Kahn's order, a level a round: nodes whose predecessors are all placed come next. The
    rounds end when one places nothing; only a count reaches the driver.
    """
    edges = cut_lineage(edges.where("before is not null and after is not null").distinct())
    left = cut_lineage(nodes.select("node").where("node is not null").distinct())
    done, level = left.select("node", F.lit(0).alias("level")).limit(0), 0
    while True:
        blocked = edges.select(F.col("after").alias("node")).distinct()
        free = cut_lineage(left.join(blocked, "node", "left_anti"))
        if free.isEmpty():
            break
        done = done.union(free.select("node", F.lit(level).alias("level")))
        left = cut_lineage(left.join(free, "node", "left_anti"))
        edges = cut_lineage(edges.join(free.withColumnRenamed("node", "before"), "before", "left_anti"))
        level += 1
    return done.union(left.select("node", F.lit(-1)))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each call and each result, joined by call_id.

    calls: call_id and other columns; results: call_id, result_text, result_turn. A call
    has its first result by turn (then text); later ones, and results without a call,
    come as rows of their own. The join is a shuffled hash join on the identifier.
    """
    order = Window.partitionBy("call_id").orderBy(F.col("result_turn").asc_nulls_last(), F.col("result_text").asc_nulls_last())
    ranked = results.withColumn("nth_result", F.row_number().over(order))
    return calls.hint("shuffle_hash").join(ranked, "call_id", "full_outer")


def placed(calls: DataFrame) -> DataFrame:
    """`calls` with `level`: how many calls must come first by the identifiers the arguments name.

    A call that names another one needs its result, so it comes after it; -1 if such
    names run in a circle. Names of calls that do not exist are no need.
    """
    named = F.explode(F.regexp_extract_all("text", F.lit(r"(call:\d+:\d+)"), F.lit(1)))
    needs = calls.where(F.col("text").contains("call:")).select(F.col("call_id").alias("after"), named.alias("before"))
    known = calls.select(F.col("call_id").alias("before")).distinct()
    needs = cut_lineage(needs.distinct().join(known, "before", "left_semi"))
    if needs.isEmpty():
        return calls.withColumn("level", F.lit(0))
    order = levels(needs.select(F.col("before").alias("node")).union(needs.select("after")), needs)
    return calls.join(order.withColumnRenamed("node", "call_id"), "call_id", "left").fillna(0, ["level"])


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results): a user turn calls the assistant, which answers in the next turn.

    The identifier is the conversation and the turn that asks. Roles other than user and
    assistant neither call nor answer.
    """
    key = lambda turn: F.concat_ws(":", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    calls = conversations.where("role = 'user'").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text"),
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), key(F.col("turn"))).alias("call_id"),
    )
    results = conversations.where("role = 'assistant'").select(
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), key(F.col("turn") - 1)).alias("call_id"),
        F.col("text").alias("result_text"), F.col("turn").cast("long").alias("result_turn"), F.col("conv_id").cast("long").alias("result_conv"),
    )
    return calls, results


def chat_lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, status, problems, line): every call, result and other message, in order.

    status: linked (a call with its result, on one line), open (a call without), orphan
    (a result without a call, or a second one), other (a system or unknown role).
    `position` orders a conversation: a call follows the calls it names, then turns decide.
    problems are the schema's codes for a call's arguments. `line` is canonical JSON.
    Null conv_id, turn, role or text are kept: such a turn sorts first and links to
    nothing; a null text breaks the schema. Repeated turns of a conversation link as
    often as both sides occur, the first result to every equal call. Empty table: no rows.
    """
    calls, results = turns_as_calls(conversations)
    both = linked(placed(calls), results)
    status = (
        F.when(F.col("conv_id").isNull() & F.col("text").isNull() & F.col("turn").isNull() & F.col("nth_result").isNotNull(), "orphan")
        .when(F.col("nth_result").isNull(), "open").when(F.col("nth_result") > 1, "orphan").otherwise("linked")
    )
    made = both.withColumn("status", status)
    orphan = F.col("status") == "orphan"
    arguments = {"text": F.col("text"), "turn": F.col("turn").cast("string")}
    call = canonical_object(
        {
            "arguments": canonical_object({"text": canonical_string(F.col("text")), "turn": F.col("turn").cast("string")}),
            "id": canonical_string(F.col("call_id")),
            "name": F.lit('"reply"'),
        }
    )
    result = canonical_object({"content": canonical_string(F.col("result_text")), "tool_call_id": canonical_string(F.col("call_id"))})
    circle = F.when(F.col("level") < 0, F.array(F.lit("circle"))).otherwise(F.array().cast("array<string>"))
    line = F.when(orphan, canonical_object({"result": result})).when(
        F.col("status") == "open", canonical_object({"call": call})
    ).otherwise(canonical_object({"call": call, "result": result}))
    shown = made.select(
        F.when(orphan, F.col("result_conv")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.when(orphan, F.col("result_turn")).otherwise(F.col("turn")).alias("turn"),
        "status", F.when(orphan, F.array().cast("array<string>")).otherwise(F.concat(argument_problems(arguments), circle)).alias("problems"),
        line.alias("line"), F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)).alias("level"),
    )
    rest = conversations.where("role is null or role not in ('user', 'assistant')").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit("other").alias("status"),
        F.array().cast("array<string>").alias("problems"),
        canonical_object({"content": canonical_string(F.col("text")), "role": canonical_string(F.col("role"))}).alias("line"),
        F.lit(0).alias("level"),
    )
    every = shown.union(rest).withColumn("problems", F.concat_ws(",", "problems"))
    # Levels come first, then turns; both in one number, so that long conversations can be cut.
    every = every.withColumn("place", F.col("level") * F.lit(1 << 40) + F.coalesce("turn", F.lit(-1)))
    return numbered(every, "conv_id", ["place", "status", "line"]).select("conv_id", "position", "turn", "status", "problems", "line")
