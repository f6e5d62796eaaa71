"""JSON, prompts and the choice of text for them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from docweave.functions.text import let, missing, non_boilerplate, normalize_rules, unique_values

#: Words of lines worth showing to a model.
SNIPPET_WORDS = [
    "gia tri", "gia goi thau", "gia hop dong", "tong gia tri", "du toan", "tong muc", "tong kinh phi", "goi thau", "du an", "cong trinh", "hang muc", "hop dong", "nha thau", "vat",
    "bao lanh", "bao dam", "tam ung", "phe duyet", "thanh dinh", "tham dinh", "lua chon nha thau", "chi dinh thau", "nghiem thu", "quyet toan", "ghi chu", "luu y",
]


def recover_json(content: Column) -> Column:
    """The JSON object in a text, as compact JSON: with a code fence, or from the first { to the last }; else {}."""

    def parsed(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
        body = F.when(c.startswith("```"), bare).otherwise(c)
        inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
        whole, part = F.try_parse_json(body), F.try_parse_json(inner)
        best = F.when(whole.isNotNull(), whole).otherwise(part)
        is_object = F.coalesce(F.schema_of_variant(best).startswith("OBJECT"), F.lit(False))
        return F.when(is_object, F.to_json(best)).otherwise(F.lit("{}"))

    return let(F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", ""), parsed)


def response_text(response: Column) -> Column:
    """All text parts of a model's answer, a line each, as the object in them."""
    schema = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>"
    parts = F.flatten(F.transform(F.from_json(response, schema)["candidates"], lambda c: F.transform(c["content"]["parts"], lambda p: p["text"])))
    return recover_json(F.array_join(F.filter(parts, lambda t: t.isNotNull()), "\n"))


def compact_json(value: Column) -> Column:
    """J3."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def prompt_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, fields): the found fields as JSON with short keys and cut texts."""
    short = F.struct(F.left("value", F.lit(500)).alias("v"), F.left("norm", F.lit(300)).alias("n"), F.left("evidence", F.lit(200)).alias("e"), F.col("confidence").alias("c"))
    have = fields.where(missing(F.col("value")).isNotNull())
    return have.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_key", short.alias("f")))))).alias("fields"))


def response_schema(keys: list[str]) -> S.StructType:
    """The type of an answer that has these fields."""
    one = S.StructType([S.StructField(n, t) for n, t in (("value", S.StringType()), ("normalized_value", S.StringType()), ("evidence", S.StringType()), ("confidence", S.DoubleType()))])
    return S.StructType([S.StructField("document_intent", S.StringType()), S.StructField("fields", S.StructType([S.StructField(k, one) for k in keys])), S.StructField("notes", S.ArrayType(S.StringType()))])


def payload_fields(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Answers (doc_id, JSON text) as a long payload table for merge_fields."""
    read = answers.select("doc_id", F.from_json(recover_json(F.col(answer)), response_schema(keys)).alias("a"))
    rows = F.array(*[F.struct(F.lit(k).alias("field_key"), F.col(f"a.fields.{k}").alias("f")) for k in keys])
    long = read.select("doc_id", F.explode(rows).alias("x")).where(missing(F.col("x.f.value")).isNotNull())
    return long.select("doc_id", "x.field_key", F.col("x.f.value").alias("value"), F.col("x.f.normalized_value").alias("norm"), F.lit(None).cast("double").alias("amount"), F.col("x.f.evidence").alias("evidence"), F.coalesce("x.f.confidence", F.lit(0.0)).alias("confidence"), F.lit("llm").alias("source"))


def budget_lines(lines: Column, head: int, budget: int, words: list[str] = SNIPPET_WORDS) -> Column:
    """The first lines and those with a word, while what is taken so far is under the budget; each once, cut."""
    return let(lines, lambda a: _budget_lines(a, head, budget, words))


def _budget_lines(lines: Column, head: int, budget: int, words: list[str]) -> Column:
    rest = F.filter(F.slice(lines, F.lit(head + 1), F.greatest(F.size(lines), F.lit(0))), lambda s: normalize_rules(s).rlike("|".join(words)))
    start = F.struct(F.array_join(F.slice(lines, 1, head), "\n").alias("x"), F.slice(lines, 1, head).alias("a"))

    def take(acc: Column, s: Column) -> Column:
        full = F.length(acc["x"]) >= budget
        return F.when(full, acc).otherwise(F.struct(F.concat_ws("\n", acc["x"], s).alias("x"), F.array_append(acc["a"], s).alias("a")))

    return F.left(F.array_join(let(F.aggregate(rest, start, take)["a"], unique_values), "\n"), F.lit(budget))


def entity_text(lines: Column, kind: str = "document") -> Column:
    """J6 for a document's lines (array of strings)."""
    return budget_lines(non_boilerplate(F.slice(lines, 1, 900)), 70, 10000 if kind == "contract" else 5000)


def fallback_text(lines: Column, evidence: Column) -> Column:
    """45 lines, up to 45 of those behind that have a word, and the evidence found; cut."""
    some = F.slice(F.filter(F.slice(lines, 46, 215), lambda s: normalize_rules(s).rlike("|".join(SNIPPET_WORDS))), 1, 45)
    return F.left(F.array_join(let(F.concat(F.slice(lines, 1, 45), some, F.coalesce(evidence, F.array().cast("array<string>"))), unique_values), "\n"), F.lit(7000))


def tiebreaker_text(lines: Column, budget: int = 3500) -> Column:
    """Half of the budget from the top, the rest from later lines with a word."""
    top = F.left(F.array_join(lines, "\n"), F.lit(budget // 2))
    tail = F.filter(F.slice(lines, F.lit(31), F.greatest(F.size(lines), F.lit(0))), lambda s: normalize_rules(s).rlike("|".join(SNIPPET_WORDS)))
    return F.left(F.concat_ws("\n", top, F.array_join(tail, "\n")), F.lit(budget))


def entity_prompt(kind: str, text: Column, fields: Column, requested: Column) -> Column:
    """The request for missing fields."""
    return F.concat_ws("\n", F.lit(f"type={kind}"), F.concat(F.lit("fields="), F.array_join(requested, ",")), F.concat(F.lit("known="), fields), F.lit("text:"), text)


def tiebreaker_prompt(kind: str, snippet: Column, candidates: Column) -> Column:
    """The request to choose one of the candidates (array of structs with id, name, score)."""
    return F.concat_ws("\n", F.lit(f"choose={kind}"), F.concat(F.lit("candidates="), compact_json(candidates)), F.lit("text:"), snippet)


def extraction_prompt(kind: str, text: Column, keys: list[str]) -> Column:
    """The request for all fields of a document."""
    return F.concat_ws("\n", F.lit(f"type={kind}"), F.lit("fields=" + ",".join(keys)), F.lit("text:"), text)


def contract_prompt(text: Column, fields: Column, requested: Column) -> Column:
    """The request for a contract's missing fields, amounts as plain numbers and dates as YYYY-MM-DD."""
    return F.concat_ws("\n", F.lit("amounts=integer dates=YYYY-MM-DD"), entity_prompt("contract", text, fields, requested))


def fallback_prompt(kind: str, text: Column, issues: Column) -> Column:
    """The request to read a document again for what its checks found."""
    return F.concat_ws("\n", F.lit(f"type={kind}"), F.concat(F.lit("issues="), F.array_join(issues, ",")), F.lit("text:"), text)


def project_prompt(snippet: Column, candidates: Column) -> Column:
    """The request to choose a project."""
    return tiebreaker_prompt("project", snippet, candidates)


def task_prompt(snippet: Column, candidates: Column, project: Column) -> Column:
    """The request to choose a task of a project."""
    return F.concat_ws("\n", F.concat(F.lit("project="), project), tiebreaker_prompt("task", snippet, candidates))


def request_payload(prompt: Column, system: str, schema: dict | None = None, max_tokens: int = 1536, thinking: int = 0) -> Column:
    """A model's request as JSON: system instruction, prompt, and a configuration for JSON answers without sampling."""
    part = lambda text: F.array(F.struct(text.alias("text")))
    config = [F.lit(0).alias("temperature"), F.lit("application/json").alias("responseMimeType"), F.lit(max_tokens).alias("maxOutputTokens"), F.struct(F.lit(thinking).alias("thinkingBudget")).alias("thinkingConfig")]
    if schema is not None:
        config.append(F.parse_json(F.lit(json.dumps(schema))).alias("responseSchema"))
    return F.to_json(F.struct(F.struct(part(F.lit(system)).alias("parts")).alias("systemInstruction"), F.array(F.struct(F.lit("user").alias("role"), part(prompt).alias("parts"))).alias("contents"), F.struct(*config).alias("generationConfig")))


def tiebreaker_choice(answer: Column, ids: Column) -> Column:
    """(id, confidence, reasoning) of an answer whose id is among the candidates; else null."""

    def read(a: Column) -> Column:
        conf = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a["confidence"], F.lit(0.0)))), 4)
        return F.when(F.array_contains(ids, a["id"]), F.struct(a["id"].alias("id"), conf.alias("confidence"), F.left(F.coalesce(a["reasoning"], F.lit("")), F.lit(500)).alias("reasoning")))

    return let(F.from_json(recover_json(answer), "id string, confidence double, reasoning string"), read)


def fingerprint(*columns: Column) -> Column:
    """A digest of values in a fixed order; nulls count."""
    return F.sha2(compact_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def compact_error(message: Column) -> Column:
    """J13."""
    return F.left(F.regexp_replace(message, r"\s+", " "), F.lit(300))
