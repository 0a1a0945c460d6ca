"""Requests to and responses of a text-generation service, as JSON in strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip


def request(custom_id: Column, messages: Column, model: str = "model", temperature: float = 0.0, url: str = "/v1/chat/completions") -> Column:
    """One line of a batch file; messages is array<struct<role, content>>."""
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature"), F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


def message(line: Column) -> Column:
    """The first choice's content in a response line; null if it is missing or blank."""
    content = strip(F.get_json_object(line, "$.response.body.choices[0].message.content"))
    return F.when(content != "", content)


def finished(line: Column) -> Column:
    """False for an answer that was cut at its length limit."""
    return F.coalesce(F.get_json_object(line, "$.response.body.choices[0].finish_reason"), F.lit("")) != "length"


def response_id(line: Column) -> Column:
    """custom_id, else the body's id, else the line's own."""
    return F.coalesce(F.get_json_object(line, "$.custom_id"), F.get_json_object(line, "$.response.body.id"), F.get_json_object(line, "$.id"))


def text_or_list(json: Column, field: str) -> Column:
    """A field that is a string, or a list of strings to be joined; null for anything else."""
    value = F.variant_get(F.try_parse_json(json), f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(json), f"$.{field}", "string")).when(
        kind == "ARRAY<STRING>", F.array_join(F.try_variant_get(F.try_parse_json(json), f"$.{field}", "array<string>"), "")
    )


def payload(raw: Column) -> Column:
    """The JSON in an answer: without code fences, from the first bracket to the last that closes it, a list as {"items": list}; null if there is none."""
    plain = strip(raw)
    fenced = F.startswith(plain, F.lit("```"))
    inner = F.regexp_replace(plain, "^[` ]+|[` ]+$", "")
    inner = F.when(F.startswith(inner, F.lit("json")), strip(F.substr(inner, F.lit(5)))).otherwise(inner)
    text = F.when(fenced, inner).otherwise(plain)
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    as_list = (bracket > 0) & ((brace == 0) | (bracket < brace))
    listed = F.concat(F.lit('{"items": '), F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("}"))
    found = F.when(as_list, listed).when(brace > 0, F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.when(F.try_parse_json(found).isNotNull(), found)
