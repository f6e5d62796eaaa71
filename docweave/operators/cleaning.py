"""Noise removal: incoming stamps, round seals, page numbers and scanner garbage.

A document is one row; its lines are an array, judged one by one.  Where a line's
fate depends on lines before it (a stamp's number and date only count below its
header), the place of the first header decides, so no state is carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import collapse, let, normalize_rules, once, raw_lines, repair_characters, safe_double, starts_with, strip_edges, uppercase_ratio, visible

MAX_REPORT_ITEMS = 60
#: Stamp headers and fragments of seals.
STAMP_HEADERS = ["cong van den", "van ban den", "ho so den", "phieu chuyen", "phieu den"]
SHORT_FRAGMENTS = ["ngan", "ngan hang", "nong", "nong n", "nong nghiep", "phat trien", "nong thon", "viet", "viet nam", "ang", "ghiep", "trien", "thon", "nam"]
GOVERNMENT_FRAGMENTS = [
    "vx", "ton", "thi", "thina", "ubnd", "u b n d", "u.b.n.d", "ub.n.d", "tm ubnd", "bqlda", "qlda", "ban quan", "ban quan ly", "quan l", "quan ly", "du an",
    "dau tu", "dau tu - ha tang", "dau tu ha tang", "dau tu-ha ta", "dau tu ha ta", "tu-ha ta", "tu - ha ta", "tu ha ta", "ha tang", "ha tan", "phuc thinh",
    "phuc thin", "phuc thina", "tien duong", "dong anh",
]
BANK_WORDS = ["ngan hang", "nong nghiep", "phat trien", "nong thon", "viet nam", "ba dinh", "ha noi"]
#: The date of a stamp, and what seals leave at the end of a line.
STAMP_DATE = r"(?iu)^\s*(?:ngày|ngay)\s*[:.]?\s*(?:[A-ZĐ]\s*[.:]?\s*)?(\d{1,2})\s*(?:tháng|thang|/|-)\s*(\d{1,2})\s*(?:năm|nam|/|-)\s*(\d{2,4})\s*[.,;:]?\s*(.*)$"
SUFFIXES = [
    r"(?iu)\s+(?:Q|[*.=•]+)\s*$",
    r"(?iuU)\s+Q\.\s*BA\s+Đ[ÌI]NH\b.*$",
    r"(?iuU)\s+TP\.\s*H[ÀA]\s+N[ỘO]I\b.*$",
    r"(?iuU)\s+(?:[WM.]?S\.?D\.?N\b\s*[:.]?\s*\d[\d\s.,-]*(?:C\.?T\.?T\.?N\.?H\.?H\.?)?.*)$",
    r"(?iu)\s+(?:V[ÀA]\s+PH[ÁA]|N[ÔO]NG\s+N)\s*$",
]
#: What a line must hold for one of the suffixes, and a normal form for a stamp's header or a seal's number: each is cheaper to look for than all that it stands for.
_SUFFIX_SIGN = r"(?U)\s(?:[qQ](?:\.|\s*$)|[*.=•]+\s*$|[tT][pP]\.|[wWmM.]?[sSſ]\.?[dD]\.?[nN]|[vV][aAàÀ]\s|[nN][oOôÔ][nN][gG]\s)"
_HEADER_SIGN = "^[ .,:;-]*(?:" + "|".join(STAMP_HEADERS) + ")"
_SEAL_SIGN = "s[^a-z0-9]*d[^a-z0-9]*n|c[^a-z0-9]*t[^a-z0-9]*t[^a-z0-9]*n"


def _edge_free(norm: Column) -> Column:
    return strip_edges(norm)


def is_stamp_header(line: Column, norm: Column | None = None) -> Column:
    """C8; norm is the line's normal form, where it is known."""

    def is_header(n: Column) -> Column:
        return n.rlike(_HEADER_SIGN) & let(_edge_free(n), lambda e: (F.length(e) <= 70) & (e.isin(STAMP_HEADERS) | starts_with(e, ("cong van den ", "van ban den ", "ho so den "))))

    return let(normalize_rules(line), is_header) if norm is None else is_header(norm)


def is_stamp_number(line: Column, norm: Column | None = None) -> Column:
    """C9."""
    return line.rlike(r"(?iu)^(?:so|số)\s*[:.]?\s*\d{1,6}$") | (normalize_rules(line) if norm is None else norm).rlike(r"^(?:so|so den|den so)\s*[:.]?\s*\d{1,6}$")


def stamp_date_tail(line: Column) -> Column:
    """Null for no stamp date, empty for a bare one, else the subject behind it."""
    tail = collapse(F.regexp_extract(line, STAMP_DATE, 4))
    subject = starts_with(normalize_rules(tail), ("ve ", "v/v", "vv ", "trich yeu", "quyet dinh", "to trinh", "cong van"))
    return F.when(line.rlike(STAMP_DATE), F.when(tail == "", F.lit("")).when(subject, tail))


def without_inline_stamp(line: Column) -> Column:
    """C11: what is left of a line that begins with a stamp header."""
    out = F.regexp_replace(line, r"(?iuU)\bC[ÔO]NG\s+V[ĂA]N\s+Đ[ẾE]N\b", " ")
    out = F.regexp_replace(out, r"(?iuU)\bV[ĂA]N\s+B[ẢA]N\s+Đ[ẾE]N\b", " ")
    out = F.regexp_replace(out, r"(?iuU)\bH[ỒO]\s+S[ƠO]\s+Đ[ẾE]N\b", " ")
    return collapse(F.regexp_replace(out, r"(?iuU)\bS[ỐO]\s*[:.]?\s*\d{1,6}\b", " "))


def is_tax_or_round_seal(line: Column, norm: Column | None = None) -> Column:
    """Company numbers around a round seal."""


    def is_seal(n: Column) -> Column:
        sign = n.rlike(_SEAL_SIGN) | line.contains("ſ")
        return sign & (F.regexp_replace(n, "[^a-z0-9]", "").rlike(r"cttnhh|msdn|sdn.*\d{6,}|\d{6,}.*sdn") | line.rlike(r"(?iuU)\b[wm.]?s\.?d\.?n\b\s*[:.]?\s*\d"))

    return let(normalize_rules(line), is_seal) if norm is None else is_seal(norm)


def is_short_seal_fragment(line: Column) -> Column:
    return _edge_free(normalize_rules(line)).isin(SHORT_FRAGMENTS)


def is_government_fragment(line: Column) -> Column:
    return _edge_free(normalize_rules(line)).isin(GOVERNMENT_FRAGMENTS)


def is_garbage(line: Column) -> Column:
    """Up to six characters with hardly a letter, list markers apart."""
    s = collapse(line)
    letters = F.length(F.regexp_replace(s, r"[^a-zA-ZÀ-ỹ]", ""))
    alpha = s.rlike(r"^\p{L}+$")
    few = (letters <= 2) & (~alpha | (F.length(s) <= 2))
    return (s != "") & (F.length(s) <= 6) & (s.rlike(r"(?U)^[\W_]+$") | (~s.rlike(r"(?U)^[(\[]?\s*[\wÀ-ỹ]\s*[).\]]$") & few))


def is_bank_seal(line: Column) -> Column:
    words = normalize_rules(line).rlike("|".join(BANK_WORDS))
    return (F.length(line) <= 70) & words & ((uppercase_ratio(line) >= 0.65) | line.rlike(r"^[*=•\d\s.-]+"))


def noise_reason(line: Column, index: Column, norm: Column | None = None) -> Column:
    """Why a whole line is noise, or null; index counts raw lines from 0."""
    judge = lambda full: let(_edge_free(full), lambda n: _noise_reason(line, full, n, index))
    return let(normalize_rules(line), judge) if norm is None else judge(norm)


def _noise_reason(line: Column, norm: Column, n: Column, index: Column) -> Column:
    return (
        F.when(n == "", "blank_or_symbol")
        .when((index > 6) & n.rlike(r"^\d{1,3}$"), "page_number")
        .when(is_tax_or_round_seal(line, norm), "round_seal_artifact")
        .when((index > 8) & n.isin("q ba dinh", "tp ha noi"), "round_seal_artifact")
        .when((index > 8) & n.isin(SHORT_FRAGMENTS + GOVERNMENT_FRAGMENTS), "round_seal_fragment")
        .when((index > 28) & is_bank_seal(line), "round_seal_fragment")
        .when((index > 8) & (F.length(line) <= 12) & is_garbage(line), "ocr_garbage")
    )


def strip_suffixes(line: Column) -> Column:
    """C14: stamp remains at the end of a line, removed until none of the patterns finds another."""

    def without(out: Column, pattern: str) -> Column:
        return let(out, lambda o: let(F.regexp_replace(o, pattern, ""), lambda u: F.when(u != o, strip_edges(u)).otherwise(o)))

    def once_more(acc: Column, _: Column) -> Column:
        stripped = let(reduce(without, SUFFIXES, acc["s"]), lambda u: F.struct(u.alias("s"), (u != acc["s"]).alias("more")))
        return F.when(acc["more"], stripped).otherwise(acc)

    # each round takes two characters at least: the first that takes none ends the work
    rounds = F.sequence(F.lit(1), F.floor(F.length(line) / 2).cast("int") + 1)
    return F.when(line.rlike(_SUFFIX_SIGN), collapse(F.aggregate(rounds, F.struct(line.alias("s"), F.lit(True).alias("more")), once_more)["s"])).otherwise(collapse(line))


def clean_documents(docs: DataFrame, text: str = "text", compose: bool = True) -> DataFrame:
    """The rows with ``clean_text`` and ``cleaning``, an array of (index, kind, reason, text, cleaned).

    kind is removed or rewritten; the counts of a report are the sizes of the
    two kinds (``cleaning_report``).
    """
    single = lambda s: F.trim(F.when(s.contains("  ") | s.contains("\t"), F.regexp_replace(s, r"[ \t]+", " ")).otherwise(s))
    df = once(docs, __raw=F.transform(raw_lines(repair_characters(F.coalesce(F.col(text), F.lit("")), compose)), lambda s, i: F.struct(i.alias("i"), single(s).alias("s"))))
    df = once(df, __n=F.transform(F.filter("__raw", lambda x: visible(x["s"])), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), normalize_rules(x["s"]).alias("norm"))))

    def headed(x: Column) -> Column:
        left = lambda h: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["norm"].alias("norm"), h.alias("h"), F.when(h, without_inline_stamp(x["s"])).otherwise(x["s"]).alias("l"))
        return let(is_stamp_header(x["s"], x["norm"]), left)

    df = once(df, __a=F.transform("__n", headed))
    df = once(df, __h=F.array_min(F.transform(F.filter("__a", lambda x: x["h"]), lambda x: x["i"])))

    def below(x: Column) -> Column:
        return F.coalesce(x["i"] >= F.col("__h"), F.lit(False))

    def stamped(x: Column) -> Column:
        # a number and a date count below a header only; a line keeps its normal form unless a stamp's words were cut from it
        number = F.when(x["h"], is_stamp_number(x["l"])).otherwise(is_stamp_number(x["s"], x["norm"]))
        return F.struct(
            x["i"].alias("i"), x["s"].alias("s"), x["norm"].alias("norm"), x["h"].alias("h"), x["l"].alias("l"), (x["h"] & (x["l"] != "") & is_stamp_header(x["l"])).alias("h2"),
            (below(x) & number).alias("n"), F.when(below(x), stamp_date_tail(x["l"])).alias("d"),
        )

    df = once(df, __b=F.transform("__a", stamped))
    dated = F.filter("__b", lambda x: x["d"].isNotNull() & (x["l"] != "") & ~x["h2"] & ~x["n"])
    df = once(df, __d=F.array_min(F.transform(dated, lambda x: x["i"])))

    def is_date(x: Column) -> Column:
        return F.coalesce(x["i"] == F.col("__d"), F.lit(False))

    def now(x: Column) -> Column:
        gone = F.when(x["l"] == "", "").when(x["h2"], "incoming_stamp_header").when(x["n"], "incoming_stamp_number").when(is_date(x) & (x["d"] == ""), "incoming_stamp_date")
        return F.struct(x["i"].alias("i"), x["s"].alias("s"), x["norm"].alias("norm"), x["h"].alias("h"), x["l"].alias("l"), gone.alias("gone"), is_date(x).alias("dated"), F.when(is_date(x), x["d"]).otherwise(x["l"]).alias("m"))

    df = once(df, __c=F.transform("__b", now))
    df = once(df, __e=F.transform("__c", lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["h"].alias("h"), x["l"].alias("l"), x["dated"].alias("dated"), x["m"].alias("m"), F.coalesce(x["gone"], F.when(x["h"] | x["dated"], noise_reason(x["m"], x["i"])).otherwise(noise_reason(x["m"], x["i"], x["norm"]))).alias("gone"), strip_suffixes(x["m"]).alias("out"))))
    item = lambda x, kind, reason, old, new: F.struct(x["i"].alias("index"), F.lit(kind).alias("kind"), reason.alias("reason"), collapse(old).alias("text"), new.alias("cleaned"))
    none = F.lit(None).cast("string")

    def items(x: Column) -> Column:
        kept = x["gone"].isNull()
        return F.filter(
            F.array(
                F.when(x["h"] & (x["l"] != ""), item(x, "rewritten", F.lit("incoming_stamp_inline"), x["s"], x["l"])),
                F.when(x["h"] & (x["l"] == ""), item(x, "removed", F.lit("incoming_stamp_inline"), x["s"], none)),
                F.when(x["dated"] & (x["m"] != ""), item(x, "rewritten", F.lit("incoming_stamp_date"), x["l"], x["m"])),
                F.when(~kept & (x["gone"] != ""), item(x, "removed", x["gone"], x["m"], none)),
                F.when(kept & (x["out"] != collapse(x["m"])), item(x, "rewritten", F.lit("stamp_suffix"), x["m"], x["out"])),
            ),
            lambda y: y.isNotNull(),
        )

    out = F.filter("__e", lambda x: x["gone"].isNull() & (x["out"] != ""))
    df = df.withColumn("clean_text", F.array_join(F.transform(out, lambda x: x["out"]), "\n")).withColumn("cleaning", F.flatten(F.transform("__e", items)))
    return df.drop("__raw", "__n", "__a", "__b", "__c", "__d", "__e", "__h")


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """Counts, and the first items of each kind, beside the rows of ``clean_documents``."""
    of = lambda kind: F.filter("cleaning", lambda x: x["kind"] == kind)
    return cleaned.select(
        "*", F.size(of("removed")).alias("removed_line_count"), F.size(of("rewritten")).alias("rewritten_line_count"),
        F.slice(of("removed"), 1, MAX_REPORT_ITEMS).alias("removed_lines"), F.slice(of("rewritten"), 1, MAX_REPORT_ITEMS).alias("rewritten_lines"),
    )


def clean_chunks(chunks: DataFrame, doc_id: str = "doc_id", ord_: str = "chunk", text: str = "text", compose: bool = True) -> DataFrame:
    """Every chunk cleaned by itself; those left empty go."""
    return clean_documents(chunks, text, compose).where(F.trim("clean_text") != "").withColumn(text, F.trim("clean_text"))


def clean_layouts(docs: DataFrame, segments: DataFrame, text: str = "text", compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """C4: (documents with clean_text, the report and removed_segment_count; the segments kept)."""
    judged = clean_segments(segments, compose)
    gone = judged.where("reason is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("removed_segment_count"), F.slice(F.sort_array(F.collect_list(F.struct("page", "seg_id", "reason", "text"))), 1, MAX_REPORT_ITEMS).alias("removed_segments"))
    report = cleaning_report(clean_documents(docs, text, compose)).join(gone, "doc_id", "left")
    return report.withColumn("removed_segment_count", F.coalesce("removed_segment_count", F.lit(0))), judged.where("reason is null").withColumn("text", F.col("clean_text")).drop("reason", "clean_text")


def segment_reason(text: Column, y: Column, stamped: Column) -> Column:
    """C6."""
    n = normalize_rules(text)
    return (
        F.when(is_stamp_header(text), "incoming_stamp_header")
        .when(stamped & (y <= 0.45) & is_stamp_number(text), "incoming_stamp_number")
        .when(stamped & (y <= 0.55) & (F.coalesce(stamp_date_tail(text), F.lit("x")) == ""), "incoming_stamp_date")
        .when(is_tax_or_round_seal(text), "round_seal_artifact")
        .when(n.isin("q ba dinh", "tp ha noi") & (y >= 0.20), "round_seal_artifact")
        .when(is_short_seal_fragment(text) & (y >= 0.18), "round_seal_fragment")
    )


def clean_segments(segments: DataFrame, compose: bool = True) -> DataFrame:
    """Rows (doc_id, page, seg_id, text, y, ...) with clean_text and reason; kept where reason is null.

    A page with a stamp header is known by a window over its segments.
    """
    stamped = F.coalesce(F.max(is_stamp_header(F.col("text"))).over(Window.partitionBy("doc_id", "page")), F.lit(False))
    df = segments.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__y", safe_double(F.col("y"))).withColumn("__stamped", stamped)
    cleaned = clean_documents(df.withColumn("__text", F.col("text")), "__text", compose).drop("__text", "cleaning")
    tail = stamp_date_tail(repair_characters(F.col("text"), compose))
    rewritten = F.when(F.col("__stamped") & (F.col("__y") <= 0.55), tail)
    cleaned = cleaned.withColumn("clean_text", collapse(F.coalesce(rewritten, "clean_text")))
    reason = F.coalesce(segment_reason(F.col("text"), F.col("__y"), F.col("__stamped")), F.when(F.col("clean_text") == "", "empty_after_text_cleaning"))
    return cleaned.withColumn("reason", reason).drop("__y", "__stamped")
