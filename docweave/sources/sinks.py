"""Projections and sinks: the shapes in which results leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import missing

DATE_KEYS = ["signed_or_effective_date", "signed_date", "performance_guarantee_end_date", "advance_guarantee_end_date"]

#: What a work detail, a matched project and a matched task show.
WORK_DETAIL_KEYS = ["document_number", "signed_or_effective_date", "approved_value", "submitted_value", "issuer", "notes", "title"]
PROJECT_KEYS = ["id", "code", "name", "status", "score"]
TASK_KEYS = ["id", "name", "status", "workflow_step_id", "workflow_step_name", "workflow_phase", "workflow_order_no", "score"]


def wide_output(fields: DataFrame, keys: list[str]) -> DataFrame:
    """K4: one row per document, a column per field: dates as shown, all else in normal form."""
    shown = F.when(F.col("field_key").isin(DATE_KEYS), F.coalesce(missing(F.col("value")), "norm")).otherwise(F.coalesce(missing(F.col("norm")), "value"))
    return fields.withColumn("out", shown).groupBy("doc_id").pivot("field_key", keys).agg(F.first("out"))


def work_detail(fields: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """The wide row with its project and task."""
    return wide_output(fields, keys).join(matches, "doc_id", "left")


def work_detail_output(fields: DataFrame) -> DataFrame:
    """K3: the wide row of the seven fields of a work detail."""
    return wide_output(fields, WORK_DETAIL_KEYS)


def match_output(matches: DataFrame) -> DataFrame:
    """K3: (doc_id, match) with status, project, task and warnings of matches (doc_id, status, project_*, task_*, warnings); without an id there's no project or task."""

    def part(prefix: str, keys: list[str]):
        have = [F.col(f"{prefix}_{k}").alias(k) if f"{prefix}_{k}" in matches.columns else F.lit(None).cast("string").alias(k) for k in keys]
        return F.when(F.col(f"{prefix}_id").isNotNull(), F.struct(*have)).alias(prefix)

    warnings = F.coalesce("warnings", F.array().cast("array<string>")) if "warnings" in matches.columns else F.array().cast("array<string>")
    return matches.select("doc_id", F.struct("status", part("project", PROJECT_KEYS), part("task", TASK_KEYS), warnings.alias("warnings")).alias("match"))


def result_json(fields: DataFrame, docs: DataFrame, include_layout: bool = False, boxes: bool = True) -> DataFrame:
    """K1, K2: (doc_id, result): a document's result as JSON; boxes, layout and removed segments on demand."""
    box = [F.struct("x", "y", "width", "height").alias("bbox"), "page", "score"] if boxes and "x" in fields.columns else []
    one = F.struct("value", F.col("norm").alias("normalized_value"), "evidence", "confidence", "source", *box)
    packed = fields.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_key", one.alias("f"))))).alias("fields"))
    hidden = {"doc_id", "_payload"} | (set() if include_layout else {"layout", "removed_segments"})
    rest = [c for c in docs.columns if c not in hidden]
    joined = docs.join(packed, "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct(*rest, "fields")).alias("result"))


def public_record(records: DataFrame) -> DataFrame:
    """K5: without private columns."""
    return records.drop(*[c for c in records.columns if c.startswith("_")])


def project_list(projects: DataFrame) -> DataFrame:
    """K8: id, code, name, status, is_active, sorted by name."""
    return projects.select(F.col("id").cast("string").alias("id"), "code", "name", "status", F.coalesce("is_active", F.lit(True)).alias("is_active")).orderBy("name", "id")


def run_report(events: DataFrame, stages: list[str]) -> DataFrame:
    """K7: one row per request, a column per stage; write it with ``write.csv(header=True)``."""
    return events.groupBy("request_id").pivot("stage", stages).agg(F.round(F.sum("ms"), 2))


def quarantine(bad: DataFrame, code: str, message: str = "") -> DataFrame:
    """K9: rows that failed, as (doc_id, code, message)."""
    return bad.select("doc_id", F.lit(code).alias("code"), F.lit(message).alias("message"))


def error_envelope(failed: DataFrame) -> DataFrame:
    """K9: (doc_id, error): failed rows (doc_id, code, message, and details, request_id where they have them) as JSON."""
    more = [F.col(c) if c in failed.columns else F.lit(None).cast("string").alias(c) for c in ("details", "request_id")]
    return failed.select("doc_id", F.to_json(F.struct(F.struct("code", "message", *more).alias("error")), {"ignoreNullFields": "false"}).alias("error"))
