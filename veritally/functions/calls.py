"""Structured answers: parsing, strict validation, rendering; usage records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An enclosing code fence; the type of a call.
_FENCE = r"(?s)^```[A-Za-z0-9_-]*\s*\n?(.*?)\n?```$"
CALL = "struct<intent:string,slots:array<struct<type:string,value:string>>>"


def body_of(text: Column) -> Column:
    """The text without blanks around it and without one enclosing code fence."""
    t = F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(t, _FENCE, 1), F.lit("")), t)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs in it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_object(text: Column) -> Column:
    """The variant that the text is, if it is one JSON object and nothing else; otherwise null. Nothing is repaired.

    The parser tolerates what follows a value, so the body is parsed as the first of two elements, the second a hash of the body that the body can't hold.
    """

    def found(body: Column) -> Column:
        def checked(both: Column) -> Column:
            alone = (F.size(F.try_variant_get(both, "$", "array<variant>")) == 2) & (F.try_variant_get(both, "$[1]", "string") == F.md5(body))
            return _once(F.try_variant_get(both, "$[0]", "variant"), lambda v: F.when(alone & F.schema_of_variant(v).startswith("OBJECT<"), v))

        return _once(F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), F.md5(body), F.lit('"]'))), checked)

    return _once(body_of(text), found)


def is_valid_call(text: Column, intents: Column | None = None, types: Column | None = None) -> Column:
    """True if the text is an object with exactly a string ``intent`` and a list ``slots`` of objects with exactly strings ``type`` and ``value``, all labels known."""
    return is_valid_object(parse_object(text), intents, types)


def is_valid_object(parsed: Column, intents: Column | None = None, types: Column | None = None) -> Column:
    """The same of a variant that `parse_object` gave."""

    def holds(v: Column) -> Column:
        kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        slots = F.try_variant_get(v, "$.slots", "array<variant>")
        keys = F.array_sort(F.array_distinct(F.json_object_keys(F.to_json(v))))
        ok = v.isNotNull() & (keys == F.array(F.lit("intent"), F.lit("slots"))) & (kind("$.intent") == "STRING") & kind("$.slots").startswith("ARRAY<")
        ok = ok & F.forall(slots, lambda s: F.schema_of_variant(s) == "OBJECT<type: STRING, value: STRING>")
        if intents is not None:
            ok = ok & F.array_contains(intents, F.try_variant_get(v, "$.intent", "string"))
        if types is not None:
            ok = ok & F.forall(slots, lambda s: F.array_contains(types, F.try_variant_get(s, "$.type", "string")))
        return F.coalesce(ok, F.lit(False))

    return _once(parsed, holds)


def call_of(text: Column) -> Column:
    """The parsed call; meaningful where `is_valid_call` holds."""
    slot = lambda s: F.struct(F.try_variant_get(s, "$.type", "string").alias("type"), F.try_variant_get(s, "$.value", "string").alias("value"))
    return _once(parse_object(text), lambda v: F.struct(F.try_variant_get(v, "$.intent", "string").alias("intent"), F.transform(F.try_variant_get(v, "$.slots", "array<variant>"), slot).alias("slots")))


def target_json(intent: Column, slots: Column) -> Column:
    """Compact JSON, keys in order, text as it is."""
    return F.to_json(F.struct(intent.alias("intent"), slots.alias("slots")))


def call_text(intent: Column, slots: Column) -> Column:
    parts = F.transform(slots, lambda s: F.concat(s["type"], F.lit("="), s["value"]))
    return F.concat_ws(" | ", intent, F.nullif(F.array_join(parts, "; "), F.lit("")))


def response_schema(intents: list[str], types: list[str]) -> dict:
    """A strict JSON schema of a call with the given labels."""
    slot = {"type": "object", "properties": {"type": {"type": "string", "enum": types}, "value": {"type": "string"}}, "required": ["type", "value"], "additionalProperties": False}
    return {"type": "object", "properties": {"intent": {"type": "string", "enum": intents}, "slots": {"type": "array", "items": slot}}, "required": ["intent", "slots"], "additionalProperties": False}


def response_format(intents: list[str], types: list[str], name: str = "call") -> dict:
    """What a request asks for so that the answer keeps to `response_schema`."""
    # The form of a strict format.
    return {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": response_schema(intents, types)}}


def message_text(content: Column) -> Column:
    """Of a content variant: the string, or the texts of a list of parts joined; null for anything else."""
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    kind = F.schema_of_variant(content)
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY<"), F.array_join(parts, ""))


def _integer(v: Column, path: str) -> Column:
    """A count: a JSON integer, a number cut to one, or a string of digits; booleans and anything else aren't."""
    found = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(found)
    number = F.try_variant_get(v, path, "double")
    whole = F.when(F.abs(number) < 2.0**63, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long"))
    text = F.trim(F.try_variant_get(v, path, "string"))
    return F.when(kind == "BIGINT", F.try_variant_get(v, path, "bigint")).when((kind == "DOUBLE") | kind.startswith("DECIMAL") | (kind == "FLOAT"), whole).when((kind == "STRING") & text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


# Fields of a usage object; of the cached tokens the first that is there counts.
CACHED = ("$.usage.prompt_tokens_details.cached_tokens", "$.usage.prompt_cache_hit_tokens", "$.usage.cached_tokens")
REASONING, PROMPT, COMPLETION = "$.usage.completion_tokens_details.reasoning_tokens", "$.usage.prompt_tokens", "$.usage.completion_tokens"


def usage_of(payload: Column, reasoning_inside: bool = True) -> Column:
    """Token counts of a response's usage object, whose field names vary; null where not reported. ``reported`` says that there is such an object.

    With ``reasoning_inside`` false, reasoning tokens are reported beside the completion and are added to it.
    """
    cached = F.coalesce(*(_integer(payload, p) for p in CACHED))
    reasoning = _integer(payload, REASONING)
    prompt, completion = _integer(payload, PROMPT), _integer(payload, COMPLETION)
    if not reasoning_inside:
        completion = completion + F.coalesce(reasoning, F.lit(0))
    reported = F.coalesce(F.schema_of_variant(F.try_variant_get(payload, "$.usage", "variant")).startswith("OBJECT"), F.lit(False))
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), cached.alias("cached_tokens"), reasoning.alias("reasoning_tokens"), reported.alias("reported"))


def complete_usage(usage: Column, prompt_estimate: Column, completion_estimate: Column) -> Column:
    """Missing counts from estimates; what was reported stays."""
    estimated = usage["prompt_tokens"].isNull() | usage["completion_tokens"].isNull()
    return F.struct(
        F.coalesce(usage["prompt_tokens"], prompt_estimate).alias("prompt_tokens"), F.coalesce(usage["completion_tokens"], completion_estimate).alias("completion_tokens"),
        usage["cached_tokens"].alias("cached_tokens"), usage["reasoning_tokens"].alias("reasoning_tokens"), usage["reported"].alias("reported"), estimated.alias("estimated"),
        F.when(estimated, "characters / 4").alias("estimate_method"),
    )
