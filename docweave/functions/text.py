"""String functions on columns: normalisers, lines, tokens, dates, money.

All are built-in expressions but ``nfkc`` and ``sequence_ratio``, for which Spark
has none; those are Arrow UDFs.  Null and empty strings both mean "missing".
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = " .,:;-"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_SPACE = r"[\s\x1c-\x1f\x85   -     　]+"
#: What a text must hold for ``collapse``, ``repair_dates`` and ``repair_number_spaces`` to change more than its ends: cheaper to look for than to replace.
#: Classes that name their characters are found many times faster than negated ones.
_UNEVEN = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u3000]"
_DAMAGED_DATE = r"(?U)[nN][gG][aAàÀ][yY](?:\s*[.:]?\s*[dDđĐoOqQ]|\s+[0-3]\s)|[tT][hH][aAáÁ][nN][gG]\s+\d+\s*[.]"
_SPACED_SLASH = r"(?U)/(?:(?<=\s/)|(?=\s))"
#: Connector words that say nothing about a text.
STOPWORDS = (
    "a agribank an cac can cho chi cp cua da de den du duoc gia gui ho huyen ke kem la lap nam ngay ngan nghiep nhanh "
    "nong noi qua so tai theo tinh tnhh thuoc to trong tru tu ty mtv va ve viec viet xa"
).split()
DATE_NUMERIC = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
DATE_WORDED = r"(?iu)(?:ngày|ngay)\s*[,:.]?\s*(\d{1,2})\s*[,;:.]?\s*(?:tháng|thang)\s+(\d{1,2})\s*[,;:.]?\s*(?:năm|nam)\s+(\d{4})"
MONEY = r"(?iuU)(?<!\w)((?:\d{1,3}(?:[.\s]\d{3})+(?:,\d+)?|\d+(?:[,.]\d+)?)\s*(?:đồng|vnđ|vnd|tỷ|triệu)?)(?=(.{0,2}))"
PERCENT = r"(?<!\d)(\d{1,2}(?:[,.]\d+)?)\s*%"
#: A unit in parentheses, as "(1.000 đồng)", is a column heading and not an amount.
UNIT_HINT = r"(?iu)\(([^()A-Za-zÀ-ỹ]{0,39}?)1(?:[.\s]?000(?:[.\s]?000){0,2})?\s*(?:triệu|tỷ)?\s*(?:đồng|vnđ|vnd)?(?=[^)]{0,7}\))"


def _fold_table() -> tuple[str, str]:
    """Composed lower-case letters and their base letters, from the Unicode database."""
    source, target = ["đ"], ["d"]
    for c in map(chr, range(0xC0, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c and base.isascii():
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


FOLD = _fold_table()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator: expressions on them, lambdas above all, don't evaluate them again."""
    for name, c in columns.items():
        df = df.withColumn(name, F.explode(F.array(c)))
    return df


def let(c: Column, f) -> Column:
    """f of c, with c evaluated once: an expression that names its input several times stays small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def missing(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def collapse(c: Column) -> Column:
    """One blank for white space of any kind, trimmed."""
    return let(c, lambda s: F.trim(F.when(s.contains("  ") | s.rlike(_UNEVEN), F.regexp_replace(s, _SPACE, " ")).otherwise(s)))


def visible(c: Column) -> Column:
    """True if ``collapse`` leaves something."""
    return c.rlike("[^" + _SPACE[1:-1])


def strip_edges(c: Column, chars: str = EDGE) -> Column:
    return F.btrim(c, F.lit(chars))


def fold_accents(c: Column) -> Column:
    """Lower case without accents."""
    unless_plain = lambda s, f: F.when(F.octet_length(s) == F.length(s), s).otherwise(f(s))
    folded = let(F.lower(c), lambda s: unless_plain(s, lambda x: F.translate(x, *FOLD)))
    return let(folded, lambda s: unless_plain(s, lambda x: F.regexp_replace(x, r"\p{Mn}+", "")))


def _normal(c: Column, keep: str) -> Column:
    """Runs of other characters than those to keep, blanks among them, as one blank each."""
    other = "[" + "".join(f"\\x{i:02x}" for i in range(128) if not re.match(f"[ {keep}]", chr(i))) + "]"
    plain = lambda s: (F.octet_length(s) == F.length(s)) & ~s.contains("  ") & ~s.rlike(other)
    return let(fold_accents(c), lambda s: F.trim(F.when(plain(s), s).otherwise(F.regexp_replace(s, f"[^{keep}]+", " "))))


def normalize_rules(c: Column) -> Column:
    """N1 and N2."""
    return _normal(c, "a-z0-9%/.,:()_-")


def normalize_layout(c: Column) -> Column:
    """Also glues marks to their neighbours."""
    out = F.regexp_replace(fold_accents(c), r"[^a-z0-9%/.,:-]+", " ")
    out = F.regexp_replace(out, r"\s+([,.:;])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*/\s*", "/"), r"\s*-\s*", "-")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalize_match(c: Column) -> Column:
    """N4."""
    return _normal(c, "a-z0-9/._-")


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility composition, which Spark has no function for."""
    return F.pandas_udf(_nfkc, "string")(c)


def repair_characters(c: Column, compose: bool = True) -> Column:
    """Composed characters, plain quotes and dashes, dates and document numbers as printed."""
    out = nfkc(c) if compose else c
    out = F.replace(F.replace(out, F.lit("﻿"), F.lit("")), F.lit("​"), F.lit(""))
    out = let(out, lambda s: F.when(s.rlike("[ “”‘’–—]"), F.translate(s, " “”‘’–—", " \"\"''--")).otherwise(s))
    return repair_number_glyphs(repair_number_spaces(repair_dates(out)))


def repair_dates(c: Column) -> Column:
    """A letter before the day, a day in two digits apart, dots behind the month."""
    return let(c, lambda s: F.when(s.rlike(_DAMAGED_DATE), _repair_dates(s)).otherwise(s))


def _repair_dates(c: Column) -> Column:
    head, month = r"(?iuU)\b(ngày|ngay)", r"(?=\s+tháng|\s+thang)"
    mark = r"\s*[.:]?\s*[DĐOQ]\s*[.:]?\s*"
    out = F.regexp_replace(c, head + mark + r"(\d)" + month, "$1 0$2")
    out = F.regexp_replace(out, head + mark + r"(\d\d)" + month, "$1 $2")
    out = F.regexp_replace(out, head + r"\s+(0|[12]|3(?=\s+[01]))\s+(\d)(?<!0\s{1,9}0)(?=\s+(?:tháng|thang)\b)", "$1 $2$3")
    out = F.regexp_replace(out, r"(?iuU)\b(tháng|thang)\s+0?(\d)\s*[.]{1,3}\s*(?=năm|nam)", "$1 $2 ")
    return F.regexp_replace(out, r"(?iuU)\b(tháng|thang)\s+([1-9]\d)\s*[.]{1,3}\s*(?=năm|nam)", "$1 $2 ")


def repair_number_spaces(c: Column) -> Column:
    """No blanks around a slash within a number."""
    return let(c, lambda s: F.when(s.rlike(_SPACED_SLASH), _repair_number_spaces(s)).otherwise(s))


def _repair_number_spaces(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?U)(?<=[\d%])\s+/(?=[\wÀ-ỹ])", "/")
    out = F.regexp_replace(out, r"(?U)(?<=[A-Za-zÀ-ỹ])\s+/(?=\d)", "/")
    return F.regexp_replace(out, r"(?U)(?<=[\w%À-ỹ])/\s+(?=[\wÀ-ỹ])", "/")


def repair_number_glyphs(c: Column) -> Column:
    """A 6 that was read as % in the number of a document."""
    inside = r"(?U)(?<=\b\d[\d%]{0,6})%(?=[\d%]{0,6}/[A-ZÀ-ỹ])"
    return let(c, lambda s: F.when(s.contains("%"), F.regexp_replace(s, inside, "6")).otherwise(s))


def lines_of(text: Column, limit: int | None = None) -> Column:
    """The collapsed lines that aren't empty."""
    out = F.filter(F.transform(F.split(text, _LINE_END, -1), collapse), lambda s: s != "")
    return F.slice(out, 1, limit) if limit else out


def raw_lines(text: Column) -> Column:
    """All lines as they are."""
    return F.split(text, _LINE_END, -1)


def first_line(text: Column) -> Column:
    return let(text, lambda t: F.coalesce(F.get(lines_of(t), F.lit(0)), collapse(t)))


def starts_with(c: Column, prefixes) -> Column:
    """True if c starts with one of some plain lower-case words."""
    return c.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def contains_any(c: Column, words) -> Column:
    return c.rlike("|".join(w.replace(".", r"\.") for w in words))


def non_boilerplate(lines: Column) -> Column:
    """N11, of lines that have been limited before."""
    return F.filter(lines, lambda s: ~starts_with(normalize_rules(s), ("cong hoa xa hoi chu nghia", "doc lap", "socialist republic")))


def significant_tokens(norm: Column) -> Column:
    """The distinct words of two characters or more that aren't stop words or numbers."""
    parts = F.split(norm, r"[\s/._-]+", -1)
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS) & ~t.rlike(r"^\d+$")))


def trigrams(c: Column) -> Column:
    """The distinct 3-character windows of the text between two blanks on either side."""
    padded = F.concat(F.lit("  "), c, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def unique_values(values: Column) -> Column:
    """Collapsed values, the first of each normal form."""
    tidy = F.filter(F.transform(values, collapse), lambda v: v != "")
    keyed = F.sort_array(F.transform(tidy, lambda v, i: F.struct(normalize_rules(v).alias("k"), i.alias("i"), v.alias("v"))))
    # equal forms stand together, the first in front
    first = let(keyed, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["k"] != x["k"])))
    return F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def unique_matches(text: Column, pattern: str, limit: int, group: int = 1, distinct: bool = True) -> Column:
    """Distinct matches in order, at most limit; all of them, if asked for."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), collapse), lambda v: v != "")
    return F.slice(F.array_distinct(found) if distinct else found, 1, limit)


def uppercase_ratio(c: Column) -> Column:
    """Of the letters, those equal to their upper-case form; letters without case count."""
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(c, r"[^\p{Lu}\p{Lt}\p{Lo}\p{Lm}]+", ""))
    return F.when(letters > 0, upper / letters).otherwise(F.lit(0.0))


#: The keys under which an object may hold its text, in order.
TEXT_KEYS = ("name", "title", "value", "normalized_value", "keyword", "action", "text", "label")


def flatten_text(value: Column, keys: tuple[str, ...] = TEXT_KEYS) -> Column:
    """The texts in a JSON value, in order: of lists all items, of objects what their keys hold, at any depth.

    A text that looks like JSON but isn't stays as it is.
    """

    def texts(j: Column) -> Column:
        return F.transform(j, lambda x: F.struct(x.alias("j"), F.lit(False).alias("done")))

    def opened(x: Column) -> Column:
        """One value as those it holds; a plain one as itself, done."""
        items = F.from_json(x["j"], "array<string>")
        held = let(F.from_json(x["j"], "map<string,string>"), lambda m: F.when(m.isNotNull(), F.array(*[F.get(F.map_values(F.map_filter(m, _is_key(k0))), F.lit(0)) for k0 in keys])))
        plain = F.array(F.struct(F.regexp_replace(x["j"], '^"|"$', "").alias("j"), F.lit(True).alias("done")))
        inner = F.when(x["j"].rlike(r"^\s*\["), items).when(x["j"].rlike(r"^\s*\{"), held)
        return let(inner, lambda i: F.when(i.isNotNull(), texts(F.filter(i, lambda v: v.isNotNull()))).otherwise(plain))

    def open_all(state: Column, _: Column) -> Column:
        return F.when(F.exists(state, lambda x: ~x["done"]), F.flatten(F.transform(state, lambda x: F.when(x["done"], F.array(x)).otherwise(opened(x))))).otherwise(state)

    # no value lies deeper than there are opening brackets
    depth = F.sequence(F.lit(0), F.length(F.regexp_replace(value, r"[^\[{]+", "")))
    found = F.transform(F.aggregate(depth, texts(F.array(value)), open_all), lambda x: x["j"])
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.filter(found, lambda t: ~t.isin("", "null")))


def _is_key(want: str):
    return lambda k, v: k == want


def metric_name(c: Column) -> Column:
    """N19."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_-]", "_")


def shadow_form(c: Column) -> Column:
    """Lower case, collapsed."""
    return collapse(F.lower(c))


def safe_double(c: Column, default: float = 0.0) -> Column:
    """N21."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def raw_index(text_length: Column, norm_length: Column, index: Column) -> Column:
    """Where about in the raw text a place of the normal form is, by the ratio of lengths (from 0)."""
    at = F.floor(index * (text_length / F.greatest(norm_length, F.lit(1)))).cast("int")
    return F.when((text_length > 0) & (norm_length > 0), F.greatest(F.lit(0), F.least(text_length - 1, at))).otherwise(F.lit(0))


def places(norm: Column, word: Column) -> Column:
    """The places (from 0) of all occurrences of a plain word, one behind the other."""
    parts = F.split(norm, word, -1)
    heads = F.slice(parts, 1, F.size(parts) - 1)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["end"] + F.length(p)
        return F.struct((at + F.length(word)).alias("end"), F.array_append(acc["at"], at).alias("at"))

    return F.aggregate(heads, start, step)["at"]


def match_places(c: Column, pattern: str) -> Column:
    """All matches of a pattern as (at, m): the place (from 1) and the text; c should be a plain column."""

    def place(parts: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        start = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<at:int,m:string>>").alias("all"))

        def step(acc: Column, p: Column) -> Column:
            at = acc["end"] + F.length(p["head"])
            return F.struct((at + F.length(p["m"])).alias("end"), F.array_append(acc["all"], F.struct(at.alias("at"), p["m"].alias("m"))).alias("all"))

        return F.aggregate(F.filter(F.arrays_zip(parts.alias("head"), found.alias("m")), lambda p: p["m"].isNotNull()), start, step)["all"]

    return let(F.split(c, pattern, -1), place)


def first_date(c: Column) -> Column:
    """The first date of a text, numeric ones before worded ones."""
    return F.coalesce(missing(F.regexp_extract(c, DATE_NUMERIC, 0)), missing(collapse(F.regexp_extract(c, DATE_WORDED, 0))))


def iso_date(c: Column) -> Column:
    """Year-month-day of the date in a text; days aren't checked against a calendar."""
    return let(c, _iso_date)


def _iso_date(c: Column) -> Column:
    numeric = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
    year = F.regexp_extract(c, numeric, 3)
    year = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") < 50, "20").otherwise("19"), year)).otherwise(F.lpad(year, 4, "0"))
    by = lambda p, d, m, y: F.concat_ws("-", y, F.lpad(F.regexp_extract(c, p, m), 2, "0"), F.lpad(F.regexp_extract(c, p, d), 2, "0"))
    return F.when(c.rlike(numeric), by(numeric, 1, 2, year)).when(c.rlike(DATE_WORDED), by(DATE_WORDED, 1, 2, F.regexp_extract(c, DATE_WORDED, 3)))


def display_date(iso: Column) -> Column:
    """Day/month/year."""
    return let(iso, _display_date)


def _display_date(iso: Column) -> Column:
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat_ws("/", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4)))


def calendar_date(iso: Column) -> Column:
    """The date, null where the calendar has no such day."""
    return F.try_to_date(iso, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))


def money_value(c: Column) -> Column:
    """An amount as an integer; dots and commas are thousands unless a word multiplies it."""
    return let(normalize_rules(c), _money_value)


def _money_value(norm: Column) -> Column:
    factor = F.when(norm.contains("ty"), F.lit(1e9)).when(norm.contains("trieu"), F.lit(1e6))
    bare = F.regexp_replace(norm, "dong|vnd|ty|trieu", "")
    multiplied = (F.regexp_replace(F.replace(F.replace(bare, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), "[^0-9.]", "").try_cast("double") * factor).cast("long")
    return F.when(factor.isNotNull(), multiplied).otherwise(missing(F.regexp_replace(bare, "[^0-9]", "")).try_cast("long"))


def amounts(window: Column) -> Column:
    """The amounts of a text in order: array of (value, amount).

    A number counts with a unit or seven digits, unless a percent sign is near
    or it is the unit of a table column in parentheses.
    """
    return let(F.regexp_replace(window, UNIT_HINT, "($1#"), _amounts)


def _amounts(clear: Column) -> Column:
    found = F.arrays_zip(F.regexp_extract_all(clear, F.lit(MONEY), F.lit(1)).alias("v"), F.regexp_extract_all(clear, F.lit(MONEY), F.lit(2)).alias("tail"))

    def counts(x: Column) -> Column:
        digits = F.length(F.regexp_replace(x["v"], "[^0-9]", ""))
        return ~x["tail"].contains("%") & (x["v"].rlike("(?iu)đồng|vnđ|vnd|tỷ|triệu") | (digits >= 7))

    kept = let(F.filter(found, counts), lambda a: F.transform(a, lambda x: F.struct(collapse(x["v"]).alias("value"), money_value(x["v"]).alias("amount"))))
    return F.filter(kept, lambda x: x["amount"].isNotNull())


def first_percent(c: Column) -> Column:
    """(value, number) of the first percentage."""
    raw = missing(collapse(F.regexp_extract(c, PERCENT, 0)))
    return F.when(raw.isNotNull(), F.struct(raw.alias("value"), F.replace(F.regexp_extract(c, PERCENT, 1), F.lit(","), F.lit(".")).cast("double").alias("number")))


def _ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """the Ratcliff-Obershelp ratio of two strings."""
    return F.pandas_udf(_ratios, "double")(a, b)
