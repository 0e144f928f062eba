"""Chat records: prompts, training records, validation by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chat format.
ROLES = ("system", "user", "assistant")
TOOL_ROLES = ("tool", "function")
RECORD_TOOLS = ("tools", "tool_choice", "functions", "function_call", "parallel_tool_calls")
MESSAGE_TOOLS = ("tool_calls", "tool_call_id", "function_call")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt(system: Column, shots: Column, request: Column) -> Column:
    """Messages: the system text, the shots (array<struct<text, answer>>, most similar first) from least to most similar as turns, the request."""
    turns = F.flatten(F.transform(F.reverse(shots), lambda s: F.array(message("user", s["text"]), message("assistant", s["answer"]))))
    return F.concat(F.array(message("system", system)), turns, F.array(message("user", request)))


def training_record(messages: Column, answer: Column) -> Column:
    return F.concat(messages, F.array(message("assistant", answer)))


def prompt_completion(messages: Column) -> Column:
    """struct<prompt, completion>: all messages but the last, and the last."""
    return F.struct(F.slice(messages, 1, F.size(messages) - 1).alias("prompt"), F.slice(messages, -1, 1).alias("completion"))


def issues(record: Column) -> Column:
    """array<struct<severity, rule, at>> of a record (variant; null: not JSON); ``at`` is the message's number from 0, -1 for the record.

    ``error``: not a valid record. ``unsupported``: valid, but with tools, parts, weights or several turns. ``warning``: keys that are ignored.
    """
    get = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    one = lambda severity, rule, at=-1: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), (at if isinstance(at, Column) else F.lit(at)).cast("int").alias("at"))
    if_ = lambda cond, issue: F.when(F.coalesce(cond, F.lit(False)), issue)
    keys = lambda v: F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))
    has_any = lambda v, names: F.arrays_overlap(keys(v), F.array(*map(F.lit, names)))
    is_object = lambda v: kind(v).startswith("OBJECT")

    messages = get(record, "$.messages", "array<variant>")
    bad_list = F.coalesce(~kind(get(record, "$.messages")).startswith("ARRAY") | (F.size(messages) == 0), F.lit(True))

    def of_message(m: Column, i: Column) -> Column:
        role, content = F.when(kind(get(m, "$.role")) == "STRING", get(m, "$.role", "string")), get(m, "$.content")
        text = kind(content) == "STRING"
        found = F.array(
            if_(role.isin(*TOOL_ROLES), one("unsupported", "tool role", i)),
            if_(role.isNull() | ~role.isin(*ROLES, *TOOL_ROLES), one("error", "invalid role", i)),
            if_(has_any(m, MESSAGE_TOOLS), one("unsupported", "tool call", i)),
            if_(has_any(m, ("weight",)), one("unsupported", "weight", i)),
            if_(kind(content).startswith("ARRAY"), one("unsupported", "content parts", i)),
            if_(~text & ~kind(content).startswith("ARRAY") & ~has_any(m, MESSAGE_TOOLS), one("error", "content is not text", i)),
            if_(text & (F.trim(F.regexp_replace(get(m, "$.content", "string"), r"(?U)\s+", " ")) == ""), one("error", "empty content", i)),
        )
        return F.when(is_object(m), found).otherwise(F.array(one("error", "message is not an object", i)))

    roles = F.filter(F.transform(messages, lambda m: F.when(is_object(m) & (kind(get(m, "$.role")) == "STRING"), get(m, "$.role", "string"))), lambda r: r.isNotNull())
    count = lambda name: F.size(F.filter(roles, lambda r: r == name))
    many = (count("user") > 1) | (count("assistant") > 1)
    extra = F.array_except(keys(record), F.array(F.lit("messages"), *map(F.lit, RECORD_TOOLS)))
    top = F.array(if_(has_any(record, RECORD_TOOLS), one("unsupported", "tools")), if_(F.size(extra) > 0, one("warning", "extra keys")))
    order = F.array(
        if_((F.size(roles) > 0) & (F.get(roles, F.size(roles) - 1) != "assistant"), one("error", "last is not the assistant")),
        if_(F.exists(F.slice(roles, 2, F.greatest(F.lit(1), F.size(roles))), lambda r: r == "system"), one("error", "system is not first")),
        if_(many, one("unsupported", "several turns")),
        if_(~many & (count("user") == 0) & (F.size(roles) > 0), one("error", "no user message")),
    )
    body = F.when(bad_list, F.array(one("error", "messages missing"))).otherwise(F.concat(F.flatten(F.transform(messages, of_message)), order))
    found = F.when(record.isNull(), F.array(one("error", "invalid JSON"))).when(~is_object(record), F.array(one("error", "record is not an object"))).otherwise(F.concat(top, body))
    return F.filter(found, lambda x: x.isNotNull())


def report(found: DataFrame) -> DataFrame:
    """One row from rows with ``issues``: records, errors, unsupported, warnings; ok if neither errors nor unsupported, and there are records."""
    n = lambda s: F.coalesce(F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s))), F.lit(0)).cast("long")
    out = found.agg(F.count("*").alias("records"), n("error").alias("errors"), n("unsupported").alias("unsupported"), n("warning").alias("warnings"))
    out = out.withColumn("errors", F.col("errors") + (F.col("records") == 0).cast("int"))
    return out.withColumn("ok", (F.col("errors") == 0) & (F.col("unsupported") == 0))
