"""Output contracts: lookup, JSON schema, validation, serialisation; all as expressions over JSON texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dimensions as d


def contracts_table(spark: SparkSession) -> DataFrame:
    """``task_type, ordinal, field, required, description`` for every task type (the default contract where it has none)."""
    rows = [(t, i, f, req, text) for t in d.TASK_TYPES for i, (f, text, req) in enumerate(d.contract_of(t)[1])]
    return spark.createDataFrame(rows, "task_type string, ordinal int, field string, required boolean, description string")


def fields(task_type: str, required: bool) -> list[str]:
    return sorted(f for f, _, req in d.contract_of(task_type)[1] if req == required)


def descriptions(task_type: str) -> dict[str, str]:
    return {f: text for f, text, _ in d.contract_of(task_type)[1]}


def json_schema(task_type: str, strict: bool = False) -> dict:
    """JSON schema of a contract; ``strict`` forbids other fields."""
    own, rows = d.contract_of(task_type)
    title = own.upper()
    return {"type": "object", "title": f"{title} Output", "description": f"Output schema for {title} tasks", "properties": {f: {"type": "string", "description": t} for f, t, _ in rows}, "required": fields(task_type, True), "additionalProperties": not strict}


def schema_text(schema: dict) -> str:
    """A schema as lines, fields by name."""
    said = [f"SCHEMA: {schema.get('title', 'Output')}"] + ([f"Description: {schema['description']}"] if schema.get("description") else []) + [""]
    for name, what in sorted(schema.get("properties", {}).items()):
        said.append(f"- {name} {'(required)' if name in schema.get('required', []) else '(optional)'}: {what.get('description', 'No description')}")
    return "\n".join(said)


def _names(task_type: Column, required: bool) -> Column:
    arr = lambda t: F.array(*[F.lit(x) for x in fields(t, required)]).cast("array<string>")
    out = F.when(task_type == d.TASK_TYPES[0], arr(d.TASK_TYPES[0]))
    for t in d.TASK_TYPES[1:]:
        out = out.when(task_type == t, arr(t))
    return out.otherwise(arr("cleanup"))


def validate(task_type: Column, output: Column, strict: Column | bool = False) -> Column:
    """Validation of a JSON object: missing required fields are an error, unknown ones (strict) a warning; both fail it.

    A text that is no JSON object has no fields."""
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    keys = F.coalesce(F.json_object_keys(output), F.array().cast("array<string>"))
    need, may = _names(task_type, True), _names(task_type, False)
    missing = F.array_sort(F.array_except(need, keys))
    unknown = F.when(strict, F.array_sort(F.array_except(keys, F.concat(need, may)))).otherwise(F.array().cast("array<string>"))
    said = lambda xs, head: F.when(F.size(xs) > 0, F.array(F.concat(F.lit(head), F.array_join(xs, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        ((F.size(missing) == 0) & (F.size(unknown) == 0)).alias("is_valid"), said(missing, "Missing required fields: ").alias("errors"), said(unknown, "Unknown fields (strict mode): ").alias("warnings"),
        missing.alias("missing_required"), unknown.alias("unknown_fields"), F.array_sort(F.array_intersect(need, keys)).alias("present_required"), F.array_sort(F.array_intersect(may, keys)).alias("present_optional"),
    )


def enforce(df: DataFrame, task_type: str, output: str) -> DataFrame:
    """``df``; rows with missing required fields fail the query."""
    missing = validate(F.lit(task_type), F.col(output))["missing_required"]
    message = F.concat(F.lit(f"Missing required fields for {task_type.upper()}: "), F.array_join(missing, ", "))
    return df.where(F.when(F.size(missing) > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def summary(task_type: Column, result: Column) -> Column:
    """A validation result as text."""
    line = lambda head, xs: F.when(F.size(xs) > 0, F.array(F.concat(F.lit(head), F.array_join(xs, ", ")))).otherwise(F.array().cast("array<string>"))
    block = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(head)), F.transform(xs, lambda x: F.concat(F.lit("  • "), x)))).otherwise(F.array().cast("array<string>"))
    top = F.array(F.concat(F.lit("Validation: "), F.when(result["is_valid"], "PASS").otherwise("FAIL")), F.concat(F.lit("Task Type: "), F.upper(task_type)), F.concat(F.lit("Required Fields Present: "), F.size(result["present_required"])), F.concat(F.lit("Optional Fields Present: "), F.size(result["present_optional"])))
    return F.array_join(F.concat(top, line("Missing Required: ", result["missing_required"]), line("Unknown Fields: ", result["unknown_fields"]), block("Errors:", result["errors"]), block("Warnings:", result["warnings"])), "\n")


def serialize(task_type: Column, output: Column, clock: Column, retrieval_audit: Column | None = None, impact_audit: Column | None = None, validation: Column | None = None, version: str = "1.0", compact: bool = False) -> Column:
    """The whole result of a task as JSON.  ``output`` and audits are JSON texts; the clock is an input, so equal inputs
    give equal texts.  ``compact`` keeps the type, the output and the retrieval audit."""
    quote = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    pair = lambda k, v: F.concat(F.lit(f"{json.dumps(k)}:"), v)
    parts = [pair("task_type", quote(F.upper(task_type)))]
    if not compact:
        parts += [pair("timestamp", quote(clock)), pair("schema_version", F.lit(json.dumps(version)))]
    parts.append(pair("output", output))
    if retrieval_audit is not None:
        parts.append(F.when(retrieval_audit.isNotNull(), pair("retrieval_audit", retrieval_audit)))
    if impact_audit is not None and not compact:
        parts.append(F.when(impact_audit.isNotNull(), pair("impact_audit", impact_audit)))
    if validation is not None and not compact:
        v = validation
        told = F.struct(v["is_valid"].alias("is_valid"), F.size(v["present_required"]).alias("required_fields_present"), F.size(v["present_optional"]).alias("optional_fields_present"), v["missing_required"].alias("missing_required"), v["unknown_fields"].alias("unknown_fields"), v["errors"].alias("errors"), v["warnings"].alias("warnings"))
        parts.append(pair("validation", F.to_json(told)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
