"""Explanation requests and replies as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import strip

# Keys a reply must have, and the keys of a request's finding.
REPLY_KEYS = (
    "explanation", "impact", "attack_path", "recommendation", "example_fix",
    "reasoning_summary", "confidence",
)
REQUEST_KEYS = (
    "title", "category", "severity", "confidence", "file_path", "line_number",
    "description", "code_snippet",
)


def request_document(context: Column) -> Column:
    """The request for one finding; absent values are written as null."""
    finding = F.struct(*[F.col(k) for k in REQUEST_KEYS])
    return F.to_json(
        F.struct(finding.alias("finding"),
                 F.coalesce(context, F.lit("")).alias("additional_code_context")),
        {"ignoreNullFields": "false"})


def without_fences(reply: Column) -> Column:
    """Text between code fences, when the reply starts with one."""
    text = strip(reply)
    body = F.regexp_replace(text, r"(?s)\A[^\n]*\n", "")
    body = F.regexp_replace(body, r"(?s)```\z", "")
    return F.when(text.startswith("```"), strip(body)).otherwise(text)


def parsed(text: Column) -> Column:
    """A reply as a variant; null when it is not one JSON value and nothing else.

    The parser stops after the first value.  Only a text without anything
    behind its value reads well both as a list item and as a field.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(as_item.isNotNull() & as_field.isNotNull(), F.try_parse_json(text))


def _field(document: Column, key: str) -> Column:
    return F.try_variant_get(document, f"$.{key}", "variant")


def _kind(document: Column, key: str) -> Column:
    return F.schema_of_variant(_field(document, key))


def is_usable(document: Column) -> Column:
    """All keys present, ``attack_path`` a list and ``confidence`` a number."""
    present = F.lit(True)
    for key in REPLY_KEYS:
        present = present & _field(document, key).isNotNull()
    number = _kind(document, "confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    return F.coalesce(
        present & _kind(document, "attack_path").startswith("ARRAY") & number, F.lit(False))


def reply_columns(document: Column) -> dict[str, Column]:
    """Typed columns of a usable reply, all null otherwise."""
    usable = is_usable(document)

    def text(key: str) -> Column:
        return F.when(usable, F.try_variant_get(document, f"$.{key}", "string"))

    confidence = F.coalesce(
        F.try_variant_get(document, "$.confidence", "double"),
        F.try_variant_get(document, "$.confidence", "boolean").cast("double"))
    return {
        "reply_usable": usable,
        **{f"reply_{k}": text(k) for k in REPLY_KEYS if k not in ("attack_path", "confidence")},
        "reply_attack_path": F.when(
            usable, F.try_variant_get(document, "$.attack_path", "array<string>")),
        "reply_confidence": F.when(usable, confidence.cast("int")),
    }


def posture_request(score: Column, counts: dict[str, Column]) -> Column:
    """Text asking for a short summary of a project's state."""
    listed = [F.concat(F.lit(f"{name} "), value.cast("string")) for name, value in counts.items()]
    return F.concat(
        F.lit("Summarise in two or three plain sentences how safe this code base is. Score "),
        score.cast("string"), F.lit(" of 100; "), F.concat_ws(", ", *listed), F.lit("."))
