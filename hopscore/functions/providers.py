"""Model providers: which one serves a model, and how its response payload reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopscore.functions.json_text import is_object, required
from hopscore.functions.text import once

# Model name prefixes and the provider behind each.
PROVIDER_PREFIXES = (("gpt", "openai"), ("deepseek", "deepseek"))

# The payload shape of each provider.
OPENAI_PAYLOAD = (
    "output_text string, usage struct<input_tokens bigint, output_tokens bigint, "
    "input_tokens_details struct<cached_tokens bigint>>"
)
DEEPSEEK_PAYLOAD = (
    "choices array<struct<message struct<content string>>>, "
    "usage struct<prompt_tokens bigint, completion_tokens bigint, prompt_cache_hit_tokens bigint>"
)


def provider_of_model(model: Column) -> Column:
    """The provider by model name prefix, NULL for an unknown one."""
    provider = F.lit(None).cast("string")
    for prefix, name in reversed(PROVIDER_PREFIXES):
        provider = F.when(F.startswith(model, F.lit(prefix)), name).otherwise(provider)
    return provider


def is_response(provider: Column, payload: Column) -> Column:
    """False for a payload of a known provider that is no JSON object."""
    return ~provider.isin(*[name for _, name in PROVIDER_PREFIXES]) | payload.isNull() | is_object(payload)


def parse_response(provider: Column, payload: Column) -> Column:
    """``struct<content, input_tokens, output_tokens, cached_tokens>`` of a logged response, NULL for other providers. A payload that is
    no JSON object is an error."""
    payload = required(payload, is_response(provider, payload), "payload is not a JSON object")

    def fields(content: Column, sent: Column, received: Column, cached: Column) -> Column:
        return F.struct(
            content.alias("content"),
            sent.alias("input_tokens"),
            received.alias("output_tokens"),
            F.coalesce(cached, F.lit(0).cast("bigint")).alias("cached_tokens"),
        )

    def openai(r: Column) -> Column:
        usage = r["usage"]
        cached = usage["input_tokens_details"]["cached_tokens"]
        return fields(r["output_text"], usage["input_tokens"], usage["output_tokens"], cached)

    def deepseek(r: Column) -> Column:
        usage, first = r["usage"], F.get(r["choices"], F.lit(0))
        cached = usage["prompt_cache_hit_tokens"]
        return fields(first["message"]["content"], usage["prompt_tokens"], usage["completion_tokens"], cached)

    return F.when(provider == "openai", once(F.from_json(payload, OPENAI_PAYLOAD), openai)).when(
        provider == "deepseek", once(F.from_json(payload, DEEPSEEK_PAYLOAD), deepseek)
    )
