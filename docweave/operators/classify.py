"""What a document is: its intent, its kind of title, the role of its amounts.

``with_lines`` prepares a document once: ``lines`` is an array of (t, n), a
collapsed line and its normal form, and ``norm`` the normal form of all the text.
The functions below are column expressions on those.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import MONEY, let, lines_of, normalize_rules, once, starts_with

#: Intents by role of their amounts.
PROPOSAL = ["to_trinh", "van_ban_de_nghi", "ho_so_trinh"]
APPROVAL = ["quyet_dinh", "van_ban_phe_duyet", "van_ban_chap_thuan"]
CONTRACT = ["contract"]
RECEIPT = ["bien_lai", "phieu_thu", "chung_tu_phi"]
NO_VALUE = ["gop_y", "tham_gia_y_kien", "cung_cap_thong_tin", "giay_moi", "phan_cong", "bien_ban", "bao_cao", "thong_bao", "cong_van", "unknown"]
#: Phrases and title prefixes.
CONTRACT_HITS = ["hop dong", "ben a", "ben b", "ben giao thau", "ben nhan thau", "gia tri hop dong", "gia hop dong", "ky ket"]
PROPOSAL_PHRASES = ["van ban de nghi", "ho so trinh", "de nghi", "trinh tham dinh", "trinh phe duyet", "trinh chap thuan", "xin chap thuan", "xin phe duyet", "kinh de nghi"]
APPROVAL_PHRASES = ["van ban phe duyet", "van ban chap thuan", "phe duyet", "chap thuan", "dong y", "cho phep"]
DATE_REFERENCES = ["luat", "luat so", "nghi dinh", "nghi quyet", "thong tu", "quyet dinh so", "cong van so", "can cu"]
UNDATED_KINDS = ["bao cao", "ke hoach", "ho so", "de cuong", "thuyet minh", "quy trinh", "he thong qlcl", "he thong quan ly chat luong"]
UNISSUED_KINDS = ["bien ban", "bao cao", "hop dong", "ke hoach", "quy trinh", "ho so", "de cuong", "thuyet minh", "he thong qlcl", "he thong quan ly chat luong"]
OTHER_KINDS = ["chung chi", "giay chung nhan", "giay xac nhan", "to trinh", "quyet dinh", "thong bao", "cong van", "giay moi", "van ban"]
REGISTRATION_PHRASES = [
    "giay chung nhan dang ky doanh nghiep", "giay chung nhan dang ky kinh doanh", "giay xac nhan dang ky kinh doanh", "giay phep dang ky kinh doanh", "giay phep dkkd",
]
MONEY_SIGNALS = ["gia tri", "gia goi thau", "tong muc dau tu", "du toan", "tong kinh phi", "tong cong"]
TYPE_PATTERNS = [
    ("quyết định", "quyet dinh", "quyet_dinh"), ("tờ trình", "to trinh", "to_trinh"), ("công văn", "cong van", "cong_van"), ("biên bản", "bien ban", "bien_ban"),
    ("thông báo", "thong bao", "thong_bao"), ("báo cáo", "bao cao", "bao_cao"), ("giấy mời", "giay moi", "giay_moi"), ("hợp đồng", "hop dong", "hop_dong"),
]


def with_lines(docs: DataFrame, text: str = "clean_text", limit: int = 300, only: tuple[str, ...] = ("lines", "norm", "sample", "context")) -> DataFrame:
    """The rows with body and, of the others, the columns asked for; at most ``limit`` lines, more than any rule looks at.

    What a generator makes is made even if nobody reads it, so queries of few fields name theirs.
    """
    df = once(docs, body=F.coalesce(F.col(text), F.lit("")))
    if "lines" in only or "context" in only:
        df = once(df, lines=F.transform(lines_of(F.col("body"), limit), lambda s: F.struct(s.alias("t"), normalize_rules(s).alias("n"))))
    if "norm" in only or "sample" in only:
        df = once(df, norm=normalize_rules(F.col("body")))
    if "sample" in only:
        df = once(df, sample=F.when(F.length("body") <= 5000, F.col("norm")).otherwise(normalize_rules(F.substring("body", 1, 5000))))
    return once(df, context=context_of(F.col("lines"))) if "context" in only else df


def head(n: int) -> Column:
    return F.slice("lines", 1, n)


def any_line(n: int, prefixes) -> Column:
    return F.exists(head(n), lambda x: starts_with(x["n"], prefixes))


def context_of(lines: Column) -> Column:
    """The normal form of the first 60 lines up to the first that cites a basis, else of 30 lines."""

    def upto(top: Column) -> Column:
        stop = F.array_position(F.transform(top, lambda x: starts_with(x["n"], ("can cu", "xet de nghi", "theo de nghi"))), True)
        return F.when(stop == 0, top).when(stop > 1, F.slice(top, F.lit(1), (stop - 1).cast("int"))).otherwise(F.slice(top, 1, 30))

    return let(F.slice(lines, 1, 60), lambda top: F.array_join(F.filter(F.transform(upto(top), lambda x: x["n"]), lambda n: n != ""), " "))


def intent() -> Column:
    """The first rule that holds."""
    has = lambda *words: F.col("context").rlike("|".join(words))
    hits = sum((F.col("sample").contains(w).cast("int") for w in CONTRACT_HITS[1:]), F.col("sample").contains(CONTRACT_HITS[0]).cast("int"))
    prefixed = F.get(F.filter(F.transform(head(30), lambda x: F.regexp_extract(x["n"], "^(cong van|bien ban|bao cao|thong bao)", 1)), lambda p: p != ""), F.lit(0))
    return (
        F.when(any_line(40, ["to trinh"]) | has(r"(?:^|[\s/-])ttr(?:[\s/-]|$)"), "to_trinh")
        .when(
            any_line(40, ["bien lai", "phieu thu", "chung tu phi"]) | (has("so tien") & has("le phi", "phi tham dinh", "phi xay dung")),
            F.when(any_line(90, ["bien lai"]), "bien_lai").when(any_line(90, ["phieu thu"]), "phieu_thu").otherwise("chung_tu_phi"),
        )
        .when(any_line(40, ["hop dong"]) | (hits >= 3) | (has("hop dong") & F.col("sample").rlike("gia tri hop dong|gia hop dong")), "contract")
        .when(any_line(40, ["quyet dinh"]) | has(r"(?:^|[\s/-])qd(?:[\s/-]|$)"), "quyet_dinh")
        .when(has("tham gia y kien"), "tham_gia_y_kien")
        .when(has("cung cap thong tin"), "cung_cap_thong_tin")
        .when(has("gop y"), "gop_y")
        .when(any_line(40, ["giay moi"]) | has("moi hop"), "giay_moi")
        .when(has("phan cong"), "phan_cong")
        .when(has(*PROPOSAL_PHRASES), F.when(has("ho so trinh"), "ho_so_trinh").otherwise("van_ban_de_nghi"))
        .when(has(*APPROVAL_PHRASES), F.when(has("phe duyet"), "van_ban_phe_duyet").otherwise("van_ban_chap_thuan"))
        .otherwise(F.coalesce(F.replace(prefixed, F.lit(" "), F.lit("_")), F.lit("unknown")))
    )


def coarse_type(found: Column) -> Column:
    """P5."""
    return F.when(found == "contract", "contract").when(found != "unknown", "document").when(F.col("sample").contains("hop dong"), "contract").otherwise("document")


def chosen_intent(rule: Column, payload: Column) -> Column:
    """The rule's, else the payload's."""
    given = F.replace(normalize_rules(payload), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(rule, F.lit("unknown")) != "unknown", rule).when(F.trim(payload) != "", given).otherwise(F.coalesce(rule, F.lit("unknown")))


def value_role(found: Column) -> Column:
    """P7."""
    return F.when(found.isin(PROPOSAL), "submitted").when(found.isin(APPROVAL), "approved").when(found.isin(CONTRACT), "contract_approved").when(found.isin(RECEIPT), "receipt").otherwise("none")


def title_kind(lines: Column) -> Column:
    """The kind of the first line that begins with one; longer names of the same line lose to earlier ones."""
    kinds = "|".join(UNISSUED_KINDS + OTHER_KINDS)
    found = F.transform(lines, lambda x: F.regexp_extract(x["n"], rf"^(?:\d+[.)\s-]+)?({kinds})", 1))
    return F.get(F.filter(found, lambda k: k != ""), F.lit(0))


def is_undated(kind: Column) -> Column:
    """P9."""
    return F.coalesce(starts_with(kind, UNDATED_KINDS), F.lit(False))


def is_unissued(kind: Column) -> Column:
    return F.coalesce(starts_with(kind, UNISSUED_KINDS), F.lit(False))


def is_certificate(kind: Column) -> Column:
    return F.coalesce(kind.isin("chung chi", "giay chung nhan", "giay xac nhan"), F.lit(False))


def is_registration() -> Column:
    top = F.array_join(F.transform(head(80), lambda x: x["n"]), " ")
    return let(top, lambda t: reduce(or_, [t.contains(p) for p in REGISTRATION_PHRASES]) | (t.contains("ma so doanh nghiep") & t.rlike("dang ky|dkkd")))


def is_number_line(line: Column) -> Column:
    """P10: a line that begins with the document's number."""
    return line.rlike(r"(?iu)^\s*(?:số|so)\s*[:.]?\s*[A-Z0-9Đ]")


def matching_type(text: Column) -> Column:
    """The type a title names; a word boundary stands before the accented and behind the plain form only."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for accented, plain, kind in reversed(TYPE_PATTERNS):
        out = F.when(low.rlike(rf"(?U)\b{accented}|{plain}\b"), kind).otherwise(out)
    return out


def money_signal(body: Column) -> Column:
    """P12."""
    return let(F.substring(body, 1, 20000), lambda t: normalize_rules(t).rlike("|".join(MONEY_SIGNALS)) & t.rlike(MONEY))


def checked_type(value: Column) -> Column:
    """Document or contract; anything else is an error."""
    v = F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit("document"))
    return F.when(v.isin("document", "contract"), v).otherwise(F.raise_error(F.lit("extraction_type must be document or contract")))
