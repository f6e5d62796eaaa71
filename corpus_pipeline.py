"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Documents that the quality classifier or the quality rules reject go; one
document of each group of near duplicates stays; the mix takes documents, or
parts of them, as often as their sources' weights say; the last stage encodes
what is left.  Each stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import line_crf, minhash_dedup, mixture, quality_rules, sentencepiece_codec
from docweave.llm.common import carried, materialize, table
from docweave.llm.queries import tokenizer_file

#: Least similarity of near duplicates in the pipeline, in percent; op5_minhash_dedup has its own.
NEAR_PERCENT = 80
#: What the scoring operators add to the columns they carry.
SCORED = ["score"]
JUDGED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_jsd", "form_jsd", "word_jsd", "kept"]


def _columns_of(frame: DataFrame, docs: DataFrame, made: list[str]) -> DataFrame:
    """The documents' own columns of a result that also has the made ones, whatever their names."""
    names = carried(docs.columns, made)
    return frame.select(*[F.col(f"`{names[c]}`").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line model's score reaches the threshold.

    The model learns from the rows of ``docs`` with a label.  Null and empty texts have
    no bad line and stay; repeated rows are scored alike; without labels of both
    kinds every score is 0.5, so that all documents stay.  An empty table gives one.
    """
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return _columns_of(line_crf.score(docs, model, keep=docs.columns).where(F.col("score") >= line_crf.THRESHOLD), docs, SCORED)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose histograms are near their language's.

    Null and empty texts have no words and go; a null language is one of its own;
    repeated rows are judged alike.  An empty table gives one.
    """
    return _columns_of(quality_rules.judge(docs, keep=docs.columns).where("kept"), docs, JUDGED)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Repeated rows are one document; null and empty texts are near nothing and
    stay; rows without a doc_id count as behind all others.  An empty table gives one.
    """
    return minhash_dedup.keep_one(docs, percent=NEAR_PERCENT).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and epoch of the mix, with the words that the epoch takes of it.

    Texts without a word are never taken; a null source is a source; n_chars is
    that of the part taken.  An empty table gives one.
    """
    rows, spans = mixture.mix(docs)
    return mixture.mixed_rows(docs, rows, spans).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row; a null text has none, repeated rows all have theirs."""
    return sentencepiece_codec.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("near-duplicate removal", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Training, hashing and tokenizing can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
