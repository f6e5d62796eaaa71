"""Sources: files, OCR answers, catalogues; a provider is any function from rows to rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docweave.functions.text import missing
from docweave.operators.layout import normalized_box, words_to_lines

#: What may be uploaded, and its media types.
SUFFIXES = {
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".png": "image/png", ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".txt": "text/plain", ".html": "text/html",
}
OCR_SCHEMA = (
    "responses array<struct<responses:array<struct<error:struct<message:string>,fullTextAnnotation:struct<pages:array<struct<width:double,height:double,blocks:array<struct<paragraphs:array<struct<words:array<struct<"
    "confidence:double,boundingBox:struct<vertices:array<struct<x:double,y:double>>,normalizedVertices:array<struct<x:double,y:double>>>,"
    "symbols:array<struct<text:string,confidence:double,property:struct<detectedBreak:struct<type:string>>>>>>>>>>>>>>>>>"
)
Provider = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Tree:
    """A project catalogue that requests name."""

    key: str
    display_name: str
    path: str | None = None


def resolve_tree(name: str | None, trees: dict[str, Tree], aliases: dict[str, str] | None = None) -> Tree:
    """The catalogue of a name or alias; an unknown or unconfigured one is an error that lists what there is."""
    key = (name or "").strip().lower()
    key = (aliases or {}).get(key, key)
    if key not in trees:
        raise ValueError(f"unknown project tree {name!r}: one of {sorted(trees)}")
    if not trees[key].path:
        raise ValueError(f"project tree {key!r} isn't configured")
    return trees[key]


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    """By the suffix; octet-stream where it says nothing."""
    out = F.lit("application/octet-stream")
    for s, m in SUFFIXES.items():
        out = F.when(suffix_of(path) == s, m).otherwise(out)
    return out


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Path, length, content, suffix and media type of files with a known suffix."""
    return accept_uploads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def accept_uploads(files: DataFrame) -> DataFrame:
    return files.where(missing(F.col("path")).isNotNull() & suffix_of(F.col("path")).isin(list(SUFFIXES))).withColumn("suffix", suffix_of(F.col("path"))).withColumn("media_type", media_type(F.col("path")))


def reject_uploads(files: DataFrame) -> DataFrame:
    """K9: the other files as (doc_id, code, message)."""
    bad = files.where(~(missing(F.col("path")).isNotNull() & suffix_of(F.col("path")).isin(list(SUFFIXES))) | F.col("path").isNull())
    return bad.select(F.col("path").alias("doc_id"), F.when(missing(F.col("path")).isNull(), "missing_filename").otherwise("unsupported_file_type").alias("code"), F.concat(F.lit("unsupported suffix "), suffix_of(F.coalesce("path", F.lit("")))).alias("message"))


def documents(texts: DataFrame, text: str = "text", kind: str | None = None) -> DataFrame:
    """Rows with a text as documents to extract from."""
    return texts.withColumn("text", F.coalesce(F.col(text), F.lit(""))).withColumn("type", F.lit(kind or "document"))


def page_answers(j: Column) -> Column:
    """An answer's pages: each file's responses, one behind the other."""
    return F.flatten(F.filter(F.transform(j["responses"], lambda f: f["responses"]), lambda r: r.isNotNull()))


def ocr_words(answers: DataFrame, payload: str = "payload", page_offset: str | None = None) -> DataFrame:
    """OCR answers (doc_id, JSON) as words with page, paragraph, break and box.

    An answer with a page's error gives none of its words; see ``ocr_errors``.
    """
    offset = F.col(page_offset) if page_offset else F.lit(0)
    read = answers.select("doc_id", offset.alias("offset"), F.from_json(payload, OCR_SCHEMA).alias("j"))
    pages = read.select("doc_id", "offset", F.posexplode(page_answers(F.col("j"))).alias("i", "r")).where("r.error.message is null").select("doc_id", (F.col("offset") + F.col("i") + 1).alias("page"), F.explode("r.fullTextAnnotation.pages").alias("p"))
    paras = pages.select("doc_id", "page", F.col("p.width").alias("pw"), F.col("p.height").alias("ph"), F.posexplode("p.blocks").alias("block", "b")).select("doc_id", "page", "pw", "ph", "block", F.posexplode("b.paragraphs").alias("pi", "para"))
    words = paras.select("doc_id", "page", "pw", "ph", (F.col("block") * 100000 + F.col("pi")).alias("para"), F.posexplode("para.words").alias("word", "w"))
    box = normalized_box(F.coalesce(F.when(F.size("w.boundingBox.normalizedVertices") > 0, F.col("w.boundingBox.normalizedVertices")), F.col("w.boundingBox.vertices")), F.col("pw"), F.col("ph"), F.coalesce(F.size("w.boundingBox.normalizedVertices") > 0, F.lit(False)))
    marks = F.filter(F.transform("w.symbols", lambda s: F.coalesce(s["confidence"], F.lit(0.0))), lambda c: c.isNotNull())
    own = F.coalesce("w.confidence", F.lit(0.0))
    confidence = F.when(own > 0, own).when(F.size(marks) > 0, F.aggregate(marks, F.lit(0.0), lambda a, b: a + b) / F.size(marks)).otherwise(0.0)
    out = words.select("doc_id", "page", "para", "word", F.array_join(F.transform("w.symbols", lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("text"), F.element_at(F.transform("w.symbols", lambda s: s["property"]["detectedBreak"]["type"]), -1).alias("break_type"), confidence.alias("confidence"), box.alias("box"))
    return out.select("doc_id", "page", "para", "word", "text", "break_type", "confidence", "box.*")


def ocr_errors(answers: DataFrame, payload: str = "payload", expected: str | None = None) -> DataFrame:
    """(doc_id, code, message) of answers with a page's error or another number of pages than expected."""
    read = answers.select("doc_id", *([F.col(expected).alias("expected")] if expected else [F.lit(None).cast("int").alias("expected")]), F.from_json(payload, OCR_SCHEMA).alias("j"))
    message = F.get(F.filter(F.transform(page_answers(F.col("j")), lambda r: r["error"]["message"]), lambda m: m.isNotNull()), F.lit(0))
    bad = read.select("doc_id", message.alias("message"), (F.size(page_answers(F.col("j"))) != F.col("expected")).alias("count"))
    return bad.where("message is not null or count").select("doc_id", F.when(F.col("message").isNotNull(), "page_error").otherwise("page_count_mismatch").alias("code"), F.coalesce("message", F.lit("")).alias("message"))


def ocr_lines(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """An answer's lines as segments."""
    return words_to_lines(ocr_words(answers, payload))


def choose_segments(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, lines, paragraphs, blocks, tokens: arrays of texts) as segments of the finest kind that has any."""
    kinds = ["lines", "paragraphs", "blocks", "tokens"]
    best = F.coalesce(*[F.when(F.size(k) > 0, F.struct(F.lit(k[:-1]).alias("type"), F.col(k).alias("texts"))) for k in kinds])
    rows = pages.select("doc_id", "page", best.alias("b")).select("doc_id", "page", "b.type", F.posexplode("b.texts").alias("ord", "text"))
    tidy = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.withColumn("text", tidy).where("text <> ''").withColumn("seg_id", F.concat(F.lit("p"), "page", F.lit("-s"), "ord"))


def ordered_text(parts: DataFrame) -> DataFrame:
    """(doc_id, text): the parts of a document (offset, text) joined in order with an empty line between."""
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "text"))), lambda p: p["text"]), "\n\n").alias("text"))


def read_tasks(spark: SparkSession, path: str, project_ids: list[str]) -> DataFrame:
    """The tasks of some projects, from a catalogue that is partitioned by project_id: other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("project_id").cast("string").isin(project_ids))


def pages_until(fetch: Callable[[int, int], list | tuple | None], size: int = 100, most: int = 10) -> tuple[list, bool]:
    """(items, whether they are all) of a paged catalogue.

    fetch(page, size) gives a page's items, alone or with the catalogue's total.
    Stops once the total is reached, at a short page or none, or at the limit of pages.
    """
    out: list = []
    for page in range(1, most + 1):
        got = fetch(page, size)
        items, total = got if isinstance(got, tuple) else (got, None)
        if not isinstance(items, list):
            return out, True
        out += [x for x in items if isinstance(x, dict)] if total is not None else items
        if len(items) < size or (total is not None and len(out) >= total):
            return out, True
    return out, False


def read_pages_until(fetch: Callable[[int, int], list | tuple | None], size: int = 100, most: int = 10) -> list:
    """The items of ``pages_until``."""
    return pages_until(fetch, size, most)[0]


class PagedCatalogue(DataSource):
    """A paged catalogue as a table of one JSON text per item, a task per page.

    Options: fetch, the name ``module:function`` of what gives a page; page_size
    and max_pages; columns come from ``from_json`` on ``item``.  The first page
    tells, with the catalogue's total, how many tasks there are; without a total
    there are as many as pages may be, and those behind the last page are empty.
    Register it with ``spark.dataSource.register(PagedCatalogue)``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_catalogue"

    def schema(self) -> str:
        return "page int, pos int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["fetch"], int(self.options.get("page_size", "100")), int(self.options.get("max_pages", "10")))


class _Pages(DataSourceReader):
    def __init__(self, fetch: str, size: int, most: int):
        self.fetch, self.size, self.most = fetch, size, most

    def _page(self, number: int) -> tuple[list, int | None]:
        import importlib

        module, function = self.fetch.split(":")
        got = getattr(importlib.import_module(module), function)(number, self.size)
        items, total = got if isinstance(got, tuple) else (got, None)
        return (items if isinstance(items, list) else []), total

    def partitions(self) -> list[InputPartition]:
        items, total = self._page(1)
        pages = 1 if len(items) < self.size else self.most if total is None else min(self.most, max(1, -(-total // self.size)))
        return [InputPartition(n) for n in range(1, pages + 1)]

    def read(self, partition: InputPartition):
        import json

        for pos, item in enumerate(self._page(partition.value)[0]):
            if isinstance(item, dict):
                yield partition.value, pos, json.dumps(item, ensure_ascii=False)


def mean_confidence(words: DataFrame) -> DataFrame:
    """(doc_id, mean_confidence) over the words that have one."""
    have = F.when(F.col("confidence") > 0, F.col("confidence"))
    return words.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(have), F.lit(0.0)), 4).alias("mean_confidence"))


def dispatch(uploads: DataFrame, providers: dict[str, Provider], most_pages: int = 14, in_parts: tuple[str, ...] = ("application/pdf",)) -> tuple[DataFrame, DataFrame]:
    """(texts, failures): uploads (doc_id, media_type, pages, ...) split, routed and joined in order.

    Files of a type that can be split and of more pages than ``most_pages`` go in
    parts.  Each provider gets the parts (doc_id, part, offset, pages, media_type)
    of its media types, by prefix, and gives (doc_id, offset, text); types without
    a provider, and documents that lack a part's text, are failures (doc_id, code, message).
    """
    splits = F.col("media_type").isin(*in_parts) & (F.col("pages") > most_pages)
    offsets = F.when(splits, F.sequence(F.lit(0), F.greatest(F.col("pages") - 1, F.lit(0)), F.lit(most_pages))).otherwise(F.array(F.lit(0)))
    parts = uploads.select("*", F.posexplode(offsets).alias("part", "offset")).withColumn("pages", F.when(splits, F.least(F.lit(most_pages), F.col("pages") - F.col("offset"))).otherwise(F.col("pages")))
    known, texts = F.lit(False), None
    for prefix, provider in providers.items():
        own = F.col("media_type").startswith(prefix) & ~known
        got = provider(parts.where(own)).select("doc_id", "offset", "text").where("text is not null")
        texts = got if texts is None else texts.unionByName(got)
        known = known | F.col("media_type").startswith(prefix)
    none = uploads.where(~F.coalesce(known, F.lit(False))).select("doc_id", F.lit("unsupported_media_type").alias("code"), F.coalesce("media_type", F.lit("")).alias("message"))
    if texts is None:
        return uploads.limit(0).select("doc_id", F.lit("").alias("text")), none
    lacking = parts.where(known).join(texts.select("doc_id", "offset").distinct(), ["doc_id", "offset"], "left_anti").groupBy("doc_id").agg(F.lit("part_failed").alias("code"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" parts without a text")).alias("message"))
    whole = texts.join(lacking, "doc_id", "left_anti")
    return ordered_text(whole), none.unionByName(lacking)


def provided(docs: DataFrame, provider: Provider | None) -> DataFrame:
    """A provider's rows; without one, a row per document that says it is unavailable."""
    return provider(docs) if provider else docs.select("doc_id", F.lit("provider_unavailable").alias("code"), F.lit("no provider is configured").alias("message"))
