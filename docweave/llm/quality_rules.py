"""Quality rules by distribution divergence; DataFrame functions only.

Base rules count words, symbols, repeated lines and words of repeated 3-word
windows.  The method then compares histograms of a document with those of its
language: classes of characters, classes of words by the characters they hold
(symbols, digits, capitals, none of these), and the language's most common words
against all others.  A document is kept if the Jensen-Shannon distances (base 2, 0 to
1) stay under their limits; a histogram over too few characters or words says
nothing and isn't held against a document.

The references are sums over all documents of the language that pass the base
rules, taken twice: the second time without those that the first references
find too far off, so that junk doesn't blur them.  That is one row per language,
made with partial sums.  A language without a list
of common words is compared by its character classes only.

Null and empty texts have no words and fail the base rules.  Every row is judged
by itself, so repeated rows are kept.  Counting works on one row at a time,
without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACES, carried, materialize

SYMBOLS = "#*$%&|<>"
#: Most common words of each language; fixed values.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "are"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "pas", "au"],
}
PUNCTUATION = r"""[.,;:!?'"()\-]"""
#: Fewest characters and words for a histogram to count, and the largest distance of a kept document.
MIN_CHARS, MIN_FORM_WORDS, MIN_WORDS = 200, 20, 100
MAX_CLASS_JSD, MAX_FORM_JSD, MAX_WORD_JSD = 0.3, math.sqrt(0.1), math.sqrt(0.12)
#: Words with a symbol; else with a digit; else with two capitals and no small letter.
_S, _W = r"#*$%&|<>", r"\x20\x09-\x0D"
FORMS = [
    rf"[^{_W}{_S}]*+[{_S}][^{_W}]*",
    rf"(?<![^{_W}])[^{_W}{_S}0-9]*+[0-9][^{_W}{_S}]*+(?![^{_W}])",
    rf"(?<![^{_W}])(?:[^{_W}{_S}0-9\p{{Ll}}\p{{Lu}}]*+\p{{Lu}}){{2}}[^{_W}{_S}0-9\p{{Ll}}]*+(?![^{_W}])",
]
#: Two capitals of a word without a small letter between them: every word of the last form has them.
TWO_CAPITALS = rf"\p{{Lu}}[^{_W}\p{{Ll}}\p{{Lu}}]*+\p{{Lu}}"
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that expressions on them don't evaluate them again per element."""
    for name, c in columns.items():
        df = df.withColumn(name, F.explode(F.array(c)))
    return df


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def text_features(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """keep columns (as k_0, k_1, ...), ref_lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, forms, common."""
    long = lambda c: c.cast("long")
    base = docs.select(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)], F.col(lang).alias("f_lang"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    base = _once(base, w=words_of(F.col("x")))
    n = F.length("x")
    gone = lambda pattern: F.length(F.regexp_replace("x", pattern, ""))
    lines = F.filter(F.split("x", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    lists = F.lit(None).cast("array<string>")
    for k, v in COMMON_WORDS.items():
        lists = F.when(F.col("f_lang") == k, F.array(*[F.lit(x) for x in v])).otherwise(lists)
    base = _once(base, ln=lines, h=F.transform("w", lambda s: F.xxhash64(s)), hits=F.filter("w", lambda s: s.isin(sorted(set().union(*COMMON_WORDS.values())))), clist=lists)
    # hashes of 3-word windows; a window is named by its first word's place
    pairs = F.zip_with("h", F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    base = _once(base, w2=pairs)
    thirds = F.slice(F.zip_with("w2", F.slice("h", 3, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("h") - 2, F.lit(0)))
    base = _once(base, w3=thirds)
    # only a text that has a window twice pays for finding the places
    repeats = F.size("w3") > F.size(F.array_distinct("w3"))
    base = _once(base, s3=F.when(repeats, F.sort_array(F.transform("w3", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))))
    twins = F.filter(F.zip_with("s3", F.slice("s3", 2, F.greatest(F.size("s3"), F.lit(1))), lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())
    base = _once(base, places=F.array_distinct(F.flatten(twins)))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda i: F.array(i, i + 1, i + 2)))))
    spaces = n - F.length(F.translate("x", SPACES, ""))
    base = _once(base, upper=gone(r"\P{Lu}+"), letters=gone(r"\P{L}+"), digits=n - gone(r"[0-9]+"), symbols=n - F.length(F.translate("x", SYMBOLS, "")))
    upper, letters, digits, points = F.col("upper"), F.col("letters"), F.col("digits"), n - gone(PUNCTUATION + "+")
    # most texts have no word of these forms, and aren't searched for any
    search = [F.col("symbols") > 0, digits > 0, (upper > 1) & F.col("x").rlike(TWO_CAPITALS)]
    forms = [long(F.when(c, F.regexp_count("x", F.lit(p))).otherwise(0)) for c, p in zip(search, FORMS, strict=True)]
    base = base.select(
        *[f"k_{i}" for i in range(len(keep))], F.col("f_lang").alias("ref_lang"),
        long(F.size("w")).alias("n_words"), long(n - spaces).alias("word_chars"), long(F.col("symbols")).alias("n_symbols"),
        long(F.size("ln") - F.size(F.array_distinct("ln"))).alias("n_dup_lines"), long(F.when(F.col("places").isNull(), 0).otherwise(covered)).alias("n_repeat_words"),
        long(upper).alias("c_upper"), long(letters).alias("c_letters"), long(digits).alias("c_digits"), long(points).alias("c_points"), long(spaces).alias("c_spaces"), long(n).alias("c_all"),
        F.array(*forms).alias("f3"),
        F.transform("clist", lambda c: long(F.size(F.filter("hits", lambda s: s == c)))).alias("words"),
    )
    classes = F.array("c_upper", F.col("c_letters") - F.col("c_upper"), "c_digits", "c_points", "c_spaces", F.col("c_all") - F.col("c_letters") - F.col("c_digits") - F.col("c_points") - F.col("c_spaces"))
    rest = F.col("n_words") - F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)
    out = base.withColumn("classes", classes).withColumn("common", F.when(F.col("words").isNotNull(), F.concat("words", F.array(rest))))
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    forms = F.concat("f3", F.array(F.col("n_words") - F.aggregate("f3", F.lit(0).cast("long"), lambda a, b: a + b)))
    return out.withColumn("forms", forms).withColumn("base_failed", failed).drop("f3", "words", "c_upper", "c_letters", "c_digits", "c_points", "c_spaces", "c_all")


def language_references(features: DataFrame) -> DataFrame:
    """One row per language: summed histograms of the documents that pass the base rules."""
    sums = [F.sum(F.element_at(c, i + 1)).alias(f"{c}_{i}") for c, n in (("classes", 6), ("forms", 4), ("common", len(COMMON_WORDS["en"]) + 1)) for i in range(n)]
    found = features.where("not base_failed").groupBy("ref_lang").agg(*sums)
    gather = lambda c, n: F.array(*[F.col(f"{c}_{i}") for i in range(n)])
    return found.select(F.col("ref_lang").alias("r_lang"), gather("classes", 6).alias("r_classes"), gather("forms", 4).alias("r_forms"), gather("common", len(COMMON_WORDS["en"]) + 1).alias("r_common"))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts: the root of the divergence, base 2; null if either sums to nothing."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / total(a))
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def compared(features: DataFrame, references: DataFrame) -> DataFrame:
    """The features with class_jsd, form_jsd and word_jsd; null for a language without a reference."""
    joined = features.join(references, F.col("ref_lang").eqNullSafe(F.col("r_lang")), "left")
    return joined.withColumn("class_jsd", jsd(F.col("classes"), F.col("r_classes"))).withColumn("form_jsd", jsd(F.col("forms"), F.col("r_forms"))).withColumn("word_jsd", jsd(F.col("common"), F.col("r_common")))


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", references: DataFrame | None = None) -> DataFrame:
    """keep columns, the counts, base_failed, the divergences, kept of each row.

    references: a table as of ``language_references``; by default it is made
    from all the documents.  A null language is one of its own, without a list of
    common words.  A carried column named like a result's gets ``in_`` before it.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    features = materialize(text_features(docs, keep, text, lang), "quality-features")
    if references is None:
        first = materialize(language_references(features), "quality-references")
        near = compared(features, first).where((F.col("class_jsd") <= MAX_CLASS_JSD) & (F.col("form_jsd") <= MAX_FORM_JSD) & (F.coalesce("word_jsd", F.lit(0.0)) <= MAX_WORD_JSD))
        references = materialize(language_references(near), "quality-references")
    joined = compared(features, references)
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    odd = ((chars >= MIN_CHARS) & (F.col("class_jsd") > MAX_CLASS_JSD)) | ((F.col("n_words") >= MIN_FORM_WORDS) & (F.col("form_jsd") > MAX_FORM_JSD)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_jsd") > MAX_WORD_JSD))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_jsd", "form_jsd", "word_jsd"]
    names = carried(keep, [*made, "kept"])
    return joined.select(*[F.col(f"k_{i}").alias(names[c]) for i, c in enumerate(keep)], *made, (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"))
