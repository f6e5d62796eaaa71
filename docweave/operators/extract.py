"""Fields of a document: numbers, dates, amounts, issuer, title, notes, parties.

Each extractor is a column expression on the columns of ``classify.with_lines``
and gives a struct (value, norm, amount, evidence, confidence) or null: norm is
the normal form as a string, amount the number of amounts, percentages and days.
No rows are exploded: labels, their places in the text, the windows behind them
and the amounts within are nested arrays, so a document stays in its row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions.text import collapse, let, missing, normalize_rules, once, starts_with
from docweave.operators import classify as C

FIELD = "struct<value:string,norm:string,amount:double,evidence:string,confidence:double>"
DOCUMENT_FIELDS = ["document_number", "signed_or_effective_date", "approved_value", "submitted_value", "issuer", "notes", "title"]
CONTRACT_FIELDS = [
    "work_name", "contract_name", "contract_number", "signed_date", "execution_duration_days", "contract_form", "contract_vat_percent", "settlement_request_vat_percent",
    "appraisal_vat_percent", "estimated_value", "contract_value", "contractor_group", "contractor_name", "contractor_contract_amount", "performance_guarantee_value",
    "performance_guarantee_end_date", "advance_guarantee_value", "advance_guarantee_end_date",
]
#: The labels in front of amounts, percentages and dates.
APPROVED = [
    "giá gói thầu", "giá trị gói thầu", "giá dự toán gói thầu", "giá gói thầu được duyệt", "giá trị gói thầu được duyệt", "giá trị dự toán gói thầu", "giá trị phê duyệt",
    "giá trị được duyệt", "giá trị duyệt", "giá trị sau thẩm định", "giá trị thẩm định", "dự toán được duyệt", "dự toán phê duyệt", "tổng mức đầu tư được phê duyệt",
    "tổng mức đầu tư phê duyệt", "tổng mức đầu tư", "tổng mức đầu tư dự kiến", "tổng mức đầu tư xây dựng", "tổng mức dự toán", "tổng mức được duyệt", "tổng mức duyệt",
    "tổng kinh phí được duyệt", "tổng kinh phí", "kinh phí thực hiện", "nguồn vốn đầu tư",
]
GENERAL_AMOUNT = ["tổng giá trị", "tổng giá tiền", "giá tiền", "tổng số tiền", "số tiền"]
DECISION_TOTAL = ["tổng giá trị phần công việc", "tổng giá trị các gói thầu", "tổng giá các gói thầu", "tổng cộng"]
SUBMITTED = [
    "giá trị trình", "giá trị đề nghị", "giá trị xin phê duyệt", "giá trình duyệt", "giá trị trình duyệt", "giá trị dự toán trình duyệt", "giá dự toán trình duyệt",
    "dự toán gói thầu trình duyệt", "dự toán trình", "dự toán đề nghị", "tổng mức đầu tư trình", "tổng mức đầu tư đề nghị", "kinh phí đề nghị", "giá trị đề nghị phê duyệt",
]
EXCLUDED_CONTEXT = ["de nghi", "xin phe duyet", "trinh duyet", "trinh phe duyet"]
TOTALS = [
    "tong muc dau tu", "tong muc dau tu du kien", "tong muc dau tu xay dung", "tong muc du toan", "tong muc duoc duyet", "tong muc duyet", "tong kinh phi duoc duyet",
    "tong kinh phi", "kinh phi thuc hien", "nguon von dau tu", "tong gia tri", "tong gia tri phan cong viec", "tong gia tri cac goi thau", "tong gia cac goi thau",
    "tong gia tien", "tong so tien", "tong cong",
]
ESTIMATED = ["giá gói thầu", "giá trị gói thầu", "giá dự toán gói thầu", "dự toán được duyệt", "tổng mức dự toán", "giá trị dự toán", "tổng dự toán"]
CONTRACT_VALUE = ["giá trị hợp đồng", "giá hợp đồng", "tổng giá trị hợp đồng", "giá trị ký kết", "giá trị hđ"]
CONTRACT_VAT = ["thuế vat", "thuế gtgt", "vat", "gtgt"]
SETTLEMENT_VAT = ["vat đề nghị quyết toán", "gtgt đề nghị quyết toán", "thuế vat quyết toán", "thuế gtgt quyết toán"]
APPRAISAL_VAT = ["vat thẩm định", "gtgt thẩm định", "thuế vat thẩm định", "thuế gtgt thẩm định"]
PERFORMANCE = ["bảo lãnh thực hiện hợp đồng", "bảo đảm thực hiện hợp đồng", "đảm bảo thực hiện hợp đồng"]
ADVANCE = ["bảo lãnh tiền tạm ứng", "bảo lãnh tạm ứng", "bảo đảm tiền tạm ứng", "bảo đảm tạm ứng"]
TITLE_STARTS = ["hop dong", "cong van", "quyet dinh", "van ban", "to trinh", "bien ban", "bao cao", "thong bao", "de nghi"]
TITLE_STOPS = ["kinh gui", "can cu", "noi nhan", "nguoi ky", "dai dien", "chu dau tu", "ben moi thau"]
ISSUER_EXCLUDED = [
    "cong hoa xa hoi chu nghia", "doc lap", "socialist republic", "ngay ", "kinh gui", "noi cap", "noi nhan", "to trinh", "quyet dinh", "thong bao", "cong van", "giay moi",
    "van ban", "bien ban", "bao cao", "hop dong", "ke hoach", "quy trinh", "ho so", "de cuong", "thuyet minh", "chung chi", "giay chung nhan", "giay xac nhan",
]
ISSUER_WORDS = ["uy ban", "ban quan ly", "cong ty", "agribank", "ngan hang", "chi nhanh", "phong", "so ", "tong cong ty", "tap doan", "trung tam"]
CONTRACT_FORMS = [
    ("Hợp đồng trọn gói", "hop dong tron goi|tron goi"), ("Hợp đồng theo đơn giá cố định", "don gia co dinh"), ("Hợp đồng theo đơn giá điều chỉnh", "don gia dieu chinh"),
    ("Hợp đồng theo thời gian", "theo thoi gian"), ("Hợp đồng theo tỷ lệ phần trăm", "theo ty le|ty le phan tram"),
]
CONTRACTOR_GROUPS = [
    ("Nhà thầu tư vấn", "tu van|thiet ke|giam sat|lap du toan|tham tra"), ("Nhà thầu thi công xây lắp", "thi cong|xay lap|xay dung"),
    ("Nhà thầu cung cấp hàng hóa/thiết bị", "mua sam hang hoa|cung cap thiet bi|mua sam thiet bi"), ("Nhà thầu phi tư vấn", "phi tu van|bao tri|bao duong|kiem dinh"),
]
#: A place starts at a word's first letter, and what words and blanks have taken they never give back.
PLACE_DATE = (
    r"(?iuU)(?<![A-ZĐÀ-Ỹ])([A-ZĐÀ-Ỹ][\wÀ-ỹ.]*+(?:[^\S\r\n]++[A-ZĐÀ-Ỹ\d][\wÀ-ỹ.]*+){0,5}+)[^\S\r\n]*+,[^\S\r\n]*+(?:ngày|ngay)\s*[,:.]?\s*(\d{1,2})\s*[,;:.]?\s*(?:tháng|thang)\s+(\d{1,2})\s*[,;:.]?\s*(?:năm|nam)\s+(\d{4})"
)
MOTTO = r"(?iu)(?=[đĐ])độc\s*lập\s*[-–—]\s*tự\s*do\s*[-–—]\s*hạnh\s*phúc"


def field(value: Column, norm: Column, evidence: Column, confidence, amount: Column | None = None) -> Column:
    """A found field, null without a value."""
    amount = F.lit(None).cast("double") if amount is None else amount.cast("double")
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.when(value.isNotNull(), F.struct(value.alias("value"), norm.cast("string").alias("norm"), amount.alias("amount"), evidence.alias("evidence"), conf.alias("confidence"))).cast(FIELD)


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def cites(norm: Column) -> Column:
    return let(norm, lambda n: reduce(or_, [n.contains(w) for w in C.DATE_REFERENCES]))


# numbers


def canonical_number(value: Column) -> Column:
    """A document's number without label, blanks and stray dots."""
    raw = F.replace(F.translate(collapse(value), "．·•", "..."), F.lit("…"), F.lit("..."))
    raw = F.trim(F.regexp_replace(raw, r"(?iu)^(?:số|so)\s*[:.]?\s*", ""))
    raw = T.strip_edges(F.get(F.split(raw, r"(?iu)\s+(?:ngày|ngay)\s+", 2), F.lit(0)))
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\s*([/-])\s*", "$1"), r"\s+", ""), r"\.+(?=/)", "")

    def halves(x: Column) -> Column:
        prefix = T.strip_edges(F.substring_index(x, "/", 1))
        digits = F.regexp_replace(prefix, r"[^\d]", "")
        plain = F.when(prefix.rlike(r"^[\d.\s]+$"), F.when(digits != "", digits).otherwise(prefix)).otherwise(prefix)
        suffix = T.strip_edges(F.substring(x, F.length(F.substring_index(x, "/", 1)) + 2, F.length(x)))
        joined = F.when((plain != "") & (suffix != ""), F.concat(plain, F.lit("/"), suffix)).when(plain != "", plain)
        return F.when(x.contains("/"), F.coalesce(joined, T.strip_edges(x))).otherwise(T.strip_edges(x))

    return F.when(raw.rlike(r"\d"), let(flat, halves))


def document_number() -> Column:
    """E1."""

    def candidate(x: Column) -> Column:
        value = collapse(F.regexp_extract(x["t"], r"(?iu)(?:số|so)\s*[:.]?\s*([^\n\r]{2,80})", 1))
        value = T.strip_edges(F.get(F.split(value, r"(?iu)\s+(?:ngày|ngay)\s+", 2), F.lit(0)))
        return F.struct(value.alias("v"), x["t"].alias("t"))

    lines = F.filter(C.head(60), lambda x: C.is_number_line(x["t"]) & ~x["n"].rlike("tai khoan|dien thoai|cmnd|cccd"))
    best = first(F.filter(F.transform(lines, candidate), lambda c: c["v"].rlike(r"\d")))
    return let(best, lambda b: field(F.coalesce(canonical_number(b["v"]), b["v"]), F.coalesce(canonical_number(b["v"]), b["v"]), b["t"], 0.86))


def filename_prefix(filename: Column) -> Column:
    """Two to eight digits at the start of a file's name."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return missing(F.regexp_extract(stem, r"^\s*(\d{2,8})(?=[.\s_-])", 1))


def with_filename_hint(docs: DataFrame, number: str = "document_number", filename: str = "filename") -> DataFrame:
    """The number's digits replaced by those of the file name where they are alike; ``number_note`` says so."""
    df = docs.withColumn("__f", filename_prefix(F.col(filename))).withColumn("__c", canonical_number(F.coalesce(F.col(f"{number}.norm"), F.col(f"{number}.value"))))
    df = df.withColumn("__d", F.regexp_replace(F.substring_index("__c", "/", 1), r"[^\d]", ""))
    near = F.col("__c").contains("/") & (F.col("__d") != "") & (F.col("__d") != F.col("__f")) & (F.abs(F.length("__d") - F.length("__f")) <= 2)
    df = df.withColumn("__use", F.coalesce(near & (T.sequence_ratio(F.col("__d"), F.col("__f")) >= 0.75), F.lit(False)))
    fixed = F.concat(F.col("__f"), F.lit("/"), F.substring(F.col("__c"), F.length(F.substring_index("__c", "/", 1)) + 2, F.length("__c")))
    new = F.struct(fixed.alias("value"), fixed.alias("norm"), F.col(f"{number}.amount").alias("amount"), F.col(f"{number}.evidence").alias("evidence"), F.col(f"{number}.confidence").alias("confidence"))
    df = df.withColumn(number, F.when(F.col("__use"), new).otherwise(F.col(number)))
    return df.withColumn("number_note", F.when(F.col("__use"), F.concat(F.lit("Số văn bản được hiệu chỉnh theo tên file: "), fixed))).drop("__f", "__c", "__d", "__use")


# dates


def dated(raw: Column, evidence: Column, confidence) -> Column:
    """The first date of raw as a field."""
    return let(T.first_date(raw), lambda d: let(T.iso_date(d), lambda iso: field(F.coalesce(T.display_date(iso), d), F.coalesce(iso, d), evidence, confidence)))


def registration_date() -> Column:
    """The date of the highest change of a business registration, else of the first registration."""
    change = r"(?iu)((?:đăng|dang)\s+(?:ký|ky)\s+thay\s+(?:đổi|doi)\s+lần\s+(?:thứ|thu)\s*[:\-]?\s*(\d{1,3})[^\n]*(?:\n(?!\s*(?:đăng|dang)\s+(?:ký|ky)\s+thay\s+(?:đổi|doi))[^\n]*){0,2})"
    blocks = F.arrays_zip(F.regexp_extract_all("body", F.lit(change), F.lit(2)).alias("no"), F.regexp_extract_all("body", F.lit(change), F.lit(1)).alias("block"))
    ranked = F.filter(F.transform(blocks, lambda b, i: F.struct(b["no"].cast("int").alias("no"), i.alias("i"), collapse(b["block"]).alias("b"))), lambda x: T.first_date(x["b"]).isNotNull())
    last = let(F.array_max(ranked), lambda m: dated(m["b"], m["b"], 0.96))
    initial = missing(collapse(F.regexp_extract("body", r"(?iu)((?:đăng|dang)\s+(?:ký|ky)\s+lần\s+(?:đầu|dau)[^\n]{0,160})", 1)))
    return F.coalesce(last, dated(initial, initial, 0.88))


def signed_date(kind: Column) -> Column:
    """Under the motto with a place, else labelled, else on a line, else the latest; never of a cited text."""
    after = F.substring(F.element_at(F.split("body", MOTTO, 2), -1), 1, 1500)

    def placed(head: Column) -> Column:
        def own(m: Column) -> Column:
            at = F.instr(head, m)
            return ~cites(normalize_rules(F.substring(head, F.greatest(at - 120, F.lit(1)), F.least(at - 1, F.lit(120)) + F.length(m))))

        return F.when(head.rlike(r"(?U),[^\S\r\n]*[nN][gG][aAàÀ][yY]"), first(F.filter(F.regexp_extract_all(head, F.lit(PLACE_DATE), F.lit(0)), own)))

    under = let(let(after, placed), lambda m: dated(F.regexp_extract(m, T.DATE_WORDED, 0), collapse(m), 0.94))
    labelled = []
    for p in (r"(?iu)(?=[nNtT])(?:ngày\s+ký|ngày\s+hiệu\s+lực|ngày\s+ban\s+hành|thời\s+gian\s+ký)\s*[:\-]?\s*([^\n]{4,80})", r"(?iu)(?=[tT])(?:thời\s+gian\s+thực\s+hiện(?:\s+hợp\s+đồng)?|tiến\s+độ\s+thực\s+hiện)\s*[:\-]?\s*([^\n]{4,120})"):
        at = F.regexp_instr(F.col("body"), F.lit(p))
        around = F.substring(F.col("body"), F.greatest(at - 100, F.lit(1)), F.least(at - 1, F.lit(100)) + F.length(F.regexp_extract("body", p, 0)) + 50)
        labelled.append(F.when(F.col("body").rlike(p) & ~cites(normalize_rules(around)), dated(collapse(F.regexp_extract("body", p, 1)), collapse(F.regexp_extract("body", p, 0)), 0.86)))
    line = first(F.filter(C.head(80), lambda x: (F.lower(x["t"]).contains("ngày") | x["t"].rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")) & ~cites(x["n"]) & T.first_date(x["t"]).isNotNull()))
    found = F.coalesce(under, *labelled, let(line, lambda x: dated(x["t"], x["t"], 0.74)), latest_date())
    return F.when(C.is_registration(), registration_date()).when(~C.is_undated(kind), found)


def latest_date() -> Column:
    """E5: of all dates whose surroundings cite no other text, the latest; of equal ones the last.

    The surroundings are the 120 characters before and 50 behind.
    """
    body = F.col("body")

    def of(pattern: str, order: int) -> Column:
        def around(p: Column) -> Column:
            start = F.greatest(p["at"] - 120, F.lit(1))
            return F.substring(body, start, p["at"] - start + F.length(p["m"]) + 50)

        own = F.filter(T.match_places(body, pattern), lambda p: ~cites(normalize_rules(around(p))))
        return F.transform(own, lambda p, i: F.struct(T.iso_date(p["m"]).alias("iso"), F.lit(order).alias("o"), i.alias("i"), p["at"].alias("at")))

    def line(at: Column) -> Column:
        """The line around a place: no more of it is read behind than 2,000 characters."""
        return collapse(F.concat(F.substring_index(F.substring(body, F.lit(1), at - 1), "\n", -1), F.substring_index(F.substring(body, at, F.lit(2000)), "\n", 1)))

    numeric = F.when(body.rlike(r"(?U)[/-](?<=\d[/-])(?=\d)"), of(T.DATE_NUMERIC, 0)).otherwise(F.array())
    worded = T.DATE_WORDED.replace("(?iu)", "(?=[nN])(?iu:").replace("(\\d{1,2})", "\\d{1,2}").replace("(\\d{4})", "\\d{4}") + ")"
    found = F.concat(numeric, of(worded, 1))
    return let(F.array_max(F.filter(found, lambda x: x["iso"].isNotNull())), lambda m: field(T.display_date(m["iso"]), m["iso"], line(m["at"]), 0.70))


def contract_signed_date(kind: Column) -> Column:
    """E7."""
    today = r"(?iu)(hôm\s+nay\s*,?\s*ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})"
    signed = r"(?iu)(?:ký\s+ngày|ngày\s+ký|ngày\s+lập\s+hợp\s+đồng)\s*[:\-]?\s*([^\n]{4,100})"
    own = [dated(missing(collapse(F.regexp_extract("body", p, 1))), collapse(F.regexp_extract("body", p, 0)), 0.88) for p in (today, signed)]
    return F.coalesce(*own, let(signed_date(kind), lambda d: field(d["value"], d["norm"], d["evidence"], 0.72)))


# amounts


def windows(labels: list[str], before: int, size: int, f) -> Column:
    """f(window, label number, place) of each occurrence of each label, in order; the window is cut from the raw text."""
    names = F.array(*[F.struct(F.lit(i).alias("i"), normalize_rules(F.lit(x)).alias("n")) for i, x in enumerate(labels)])

    def at(lab: Column, place: Column) -> Column:
        raw = T.raw_index(F.length("body"), F.length("norm"), place)
        start = F.greatest(raw - before, F.lit(0))
        return let(F.substring(F.col("body"), start + 1, raw - start + size), lambda w: f(w, lab, place))

    return F.flatten(F.transform(names, lambda lab: F.transform(T.places(F.col("norm"), lab["n"]), lambda p: at(lab, p))))


def skipped(window: Column, exclude: bool) -> Column:
    """True if what stands before the first number speaks of a request."""
    if not exclude:
        return F.lit(False)
    head = F.substring(window, 1, 180)
    number = F.regexp_instr(head, F.lit(T.MONEY))
    context = F.when(number > 0, F.substring(head, F.lit(1), number - 1)).otherwise(F.substring(window, 1, 140))
    return normalize_rules(context).rlike("|".join(EXCLUDED_CONTEXT))


def labelled_money(labels: list[str], exclude: bool = False) -> Column:
    """The amount behind a label: the largest behind a total's, else the first of the text."""

    def candidate(w: Column, lab: Column, place: Column) -> Column:
        def pick(found: Column) -> Column:
            total = lab["n"].isin(TOTALS)
            best = F.array_max(F.transform(found, lambda a, i: F.struct(a["amount"].alias("amount"), (-i).alias("i"), a["value"].alias("value"))))
            one = F.when(total, F.struct(best["amount"].alias("amount"), best["value"].alias("value"))).otherwise(F.struct(first(found)["amount"].alias("amount"), first(found)["value"].alias("value")))

            def shown(o: Column) -> Column:
                at = F.instr(w, o["value"])
                start = F.greatest(at - 220, F.lit(1))
                tail = T.lines_of(F.substring(w, start, at - start + F.length(o["value"])))
                last = let(tail, lambda x: collapse(F.array_join(F.slice(x, F.greatest(F.size(x) - 3, F.lit(1)), F.lit(4)), " ")))
                return F.struct(
                    F.when(total, 1).otherwise(0).alias("r1"), F.when(total, o["amount"]).otherwise(-place.cast("long")).alias("r2"), F.when(total, -place).otherwise(F.lit(0)).alias("r3"), (-lab["i"]).alias("r4"),
                    o["value"].alias("value"), o["amount"].alias("amount"), F.when(total, last).otherwise(T.first_line(w)).alias("evidence"),
                )

            return F.when(F.size(found) > 0, let(one, shown))

        return F.when(~skipped(w, exclude), let(T.amounts(w), pick))

    best = F.array_max(F.filter(windows(labels, 0, 320, candidate), lambda x: x.isNotNull()))
    words = [normalize_rules(F.lit(x)) for x in labels]

    def holds(n: Column) -> Column:
        return F.exists(F.array(*words), lambda w: n.contains(w))

    line = first(F.filter(F.transform(F.filter(C.head(200), lambda x: holds(x["n"]) & ~skipped(x["t"], exclude)), lambda x: F.struct(x["t"].alias("t"), first(T.amounts(x["t"])).alias("a"))), lambda y: y["a"].isNotNull()))
    return F.coalesce(let(best, lambda b: field(b["value"], b["amount"], b["evidence"], 0.84, b["amount"])), let(line, lambda y: field(y["a"]["value"], y["a"]["amount"], y["t"], 0.78, y["a"]["amount"])))


def labelled_percent(labels: list[str]) -> Column:
    """E14."""
    found = windows(labels, 100, 280, lambda w, lab, p: let(T.first_percent(w), lambda x: F.when(x.isNotNull(), F.struct(x["value"].alias("v"), x["number"].alias("x"), T.first_line(w).alias("e")))))
    number = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return let(first(F.filter(found, lambda x: x.isNotNull())), lambda b: field(b["v"], number(b["x"]), b["e"], 0.82, b["x"]))


def labelled_date(labels: list[str]) -> Column:
    """E15."""
    found = windows(labels, 0, 420, lambda w, lab, p: dated(w, T.first_line(w), 0.76))
    return first(F.filter(found, lambda x: x.isNotNull()))


def duration_days() -> Column:
    """E22."""
    p1 = r"(?iu)(?:thời\s+gian(?:\s+và\s+tiến\s+độ)?\s+thực\s+hiện(?:\s+hợp\s+đồng)?|tiến\s+độ\s+thực\s+hiện)[^\n.]{0,160}?(\d{1,4})\s*ngày"
    p2 = r"(?iu)(\d{1,4})\s*ngày\s+kể\s+từ\s+ngày\s+hợp\s+đồng"
    of = lambda p: let(missing(F.regexp_extract("body", p, 1)), lambda d: field(F.concat(d, F.lit(" ngày")), d.cast("int"), T.first_line(F.regexp_extract("body", p, 0)), 0.84, d))
    return F.coalesce(of(p1), of(p2))


# lines


def run_on(lines: Column, start: Column, size: int, stop, goes_on) -> Column:
    """The line at start (from 1) and those behind it that go on with it.

    Reads at most ``size`` lines behind, up to the first that stops; lines that
    don't go on are passed over until one has, after which the next such ends it.
    """
    behind = F.slice(lines, start + 1, F.lit(size))
    stopped = F.array_position(F.transform(behind, stop), True)
    kept = F.when(stopped > 0, F.slice(behind, F.lit(1), (stopped - 1).cast("int"))).otherwise(behind)

    def gather(k: Column) -> Column:
        flags = F.transform(k, goes_on)
        one = F.array_position(flags, True)
        rest = F.slice(flags, one.cast("int"), F.size(flags))
        end = F.array_position(rest, False)
        n = F.when(end > 0, end - 1).otherwise(F.size(rest))
        return F.when(one > 0, F.transform(F.slice(k, one.cast("int"), n.cast("int")), lambda x: x["t"])).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array(F.get(lines, start - 1)["t"]), let(kept, gather))


def words(c: Column) -> Column:
    return F.size(F.split(c, " "))


def document_title() -> Column:
    """The first title of more than four words, with the lines that go on with it, else the subject."""

    def stop(x: Column) -> Column:
        return starts_with(x["n"], TITLE_STOPS + ["cong hoa", "doc lap", "ngay "]) | x["n"].rlike(r"^so\b") | (F.length(x["t"]) > 180)

    def goes_on(x: Column) -> Column:
        return starts_with(x["n"], ["ve viec", "v/v", "phe duyet", "tham dinh", "dieu chinh", "bo sung"]) | x["n"].rlike("du an|cong trinh|goi thau|hang muc|chu truong dau tu")

    def titles(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when(starts_with(x["n"], TITLE_STARTS), i + 1)), lambda i: i.isNotNull())
        return first(F.filter(F.transform(starts, lambda i: collapse(F.array_join(run_on(lines, i, 7, stop, goes_on), " "))), lambda s: words(s) > 4))

    return F.coalesce(F.substring(let(C.head(90), titles), 1, 500), let(subject_line(), lambda s: F.when(words(s) > 4, s)))


def subject_line() -> Column:
    """The first line that names the subject and up to four behind it."""

    def subject(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: starts_with(x["n"], ["v/v", "ve viec", "trich yeu"])), True).cast("int")
        behind = F.slice(F.slice("lines", 1, 90), at + 1, F.lit(4))
        stopped = F.array_position(F.transform(behind, lambda x: starts_with(x["n"], ["kinh gui", "can cu", "ngay ", "noi nhan"])), True)
        kept = F.when(stopped > 0, F.slice(behind, F.lit(1), (stopped - 1).cast("int"))).otherwise(behind)
        short = F.transform(F.filter(kept, lambda x: F.length(x["t"]) <= 180), lambda x: x["t"])
        return F.when(at > 0, F.substring(collapse(F.array_join(F.concat(F.array(F.get(lines, at - 1)["t"]), short), " ")), 1, 500))

    return let(C.head(80), subject)


def guessed_title() -> Column:
    """E18."""
    line = first(F.filter("lines", lambda x: (F.length(x["t"]) <= 160) & starts_with(x["n"], TITLE_STARTS) & (words(x["t"]) > 4)))
    return F.coalesce(document_title(), line["t"])


def is_issuer_line(x: Column) -> Column:
    return x["n"].rlike("|".join(ISSUER_WORDS)) | ((F.length(x["t"]) <= 90) & x["t"].rlike(r"\p{L}") & (T.uppercase_ratio(x["t"]) >= 0.65))


def issuer(kind: Column) -> Column:
    """The block of lines above the number, from its first to its last line that names a body."""

    def excluded(x: Column) -> Column:
        return (F.length(x["n"]) < 3) | C.is_number_line(x["t"]) | starts_with(x["n"], ISSUER_EXCLUDED)

    def authority(x: Column) -> Column:
        return x["n"].rlike(r"(?:^|\s)(?:bo|cuc|so|ubnd|tong cuc|chi cuc)(?:\s|$)|uy ban nhan dan|phong dang ky kinh doanh")

    def upto(lines: Column, at: Column) -> Column:
        return F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines)

    def certificate(lines: Column) -> Column:
        title = F.array_position(F.transform(lines, lambda x: starts_with(x["n"], ["chung chi", "giay chung nhan", "giay xac nhan"])), True)
        return F.slice(F.filter(upto(lines, title), lambda x: ~excluded(x) & authority(x)), 1, 5)

    def administrative(lines: Column) -> Column:
        number = F.array_position(F.transform(lines, lambda x: C.is_number_line(x["t"])), True).cast("int")
        stop = F.array_position(F.transform(lines, lambda x: starts_with(x["n"], ["cong hoa", "doc lap"]) | C.title_kind(F.array(x)).isNotNull()), True)
        above = F.when(number > 0, F.slice(lines, F.greatest(number - 7, F.lit(1)), number - F.greatest(number - 7, F.lit(1)))).otherwise(upto(lines, stop))

        def block(some: Column) -> Column:
            anchors = F.filter(F.transform(some, lambda x, i: F.when(is_issuer_line(x), i + 1)), lambda i: i.isNotNull())
            span = F.slice(some, F.array_min(anchors), F.array_max(anchors) - F.array_min(anchors) + 1)
            return F.when(F.size(anchors) > 0, let(span, lambda s: F.slice(s, F.greatest(F.size(s) - 5, F.lit(1)), F.lit(6))))

        return let(F.filter(above, lambda x: ~excluded(x)), block)

    lines = F.when(C.is_certificate(kind), let(C.head(45), certificate)).otherwise(let(C.head(45), administrative))
    texts = F.transform(lines, lambda x: x["t"])
    joined = let(texts, lambda t: F.when(F.size(t) > 0, field(collapse(F.array_join(t, " ")), collapse(F.array_join(t, " ")), F.array_join(t, "\n"), 0.82)))
    return F.when(~C.is_unissued(kind), joined)


def notes() -> Column:
    """Up to eight lines that hold a note, each once."""
    found = F.filter(C.head(260), lambda x: starts_with(x["n"], ["ghi chu", "luu y", "can luu y", "kem theo"]) | x["n"].rlike("ghi chu|luu y|khong bao gom|chua bao gom|can luu y"))
    return let(F.transform(F.slice(found, 1, 8), lambda x: x["t"]), T.unique_values)


def project_candidates() -> Column:
    """E20."""

    def tidy(v: Column) -> Column:
        cut = F.get(F.split(collapse(v), r"(?iu)\s+(?:địa điểm|chủ đầu tư|nguồn vốn|tổng mức|hình thức|gói thầu|hạng mục|kính gửi|căn cứ)\b", 2), F.lit(0))
        return F.substring(T.strip_edges(cut), 1, 220)

    def found(title: Column) -> Column:
        source = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.array_join(F.transform(C.head(160), lambda x: x["t"]), "\n"))
        all_of = lambda p: F.regexp_extract_all(source, F.lit(p), F.lit(1))
        tail = F.split(title, r"(?iuU)\b(?:dự án|công trình)\b\s*[:\-]?", -1)
        last = F.when(F.size(tail) > 1, F.array(F.element_at(tail, -1))).otherwise(F.array().cast("array<string>"))
        named = F.concat(all_of(r"(?iu)(?:tên\s+dự\s+án|dự\s+án|công\s+trình)\s*[:\-]\s*([^\n]{8,220})"), all_of(r"(?iu)(?:thuộc\s+dự\s+án)\s*[:\-]?\s*([^\n]{8,220})"), F.coalesce(last, F.array().cast("array<string>")))
        return F.slice(let(F.filter(F.transform(named, tidy), lambda v: F.length(v) >= 8), T.unique_values), 1, 8)

    return let(document_title(), found)


def generic_fields(distinct: bool = True) -> Column:
    """Titles, projects, dates, amounts, numbers and approvers of a text as arrays; dates and amounts once each, or as often as they stand there."""
    body = F.col("body")
    date = r"(?U)\b(?:ngày\s*)?\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|(?:ngày|ngay)\s*[,:.]?\s*\d{1,2}\s*[,;:.]?\s*(?:tháng|thang)\s+\d{1,2}\s*[,;:.]?\s*(?:năm|nam)\s+\d{4}"
    money = r"(?U)\b\d{1,3}(?:[.\s]\d{3})+(?:,\d+)?\s*(?:đồng|vnđ|vnd)?\b|\b\d+(?:,\d+)?\s*(?:tỷ|triệu)\s*(?:đồng)?\b"
    return F.struct(
        guessed_title().alias("document_title_or_type"), project_candidates().alias("project_name_candidates"), T.unique_matches(body, date, 20, 0, distinct).alias("dates"), T.unique_matches(body, money, 20, 0, distinct).alias("monetary_amounts"),
        T.unique_matches(body, r"(?iu)(?:số|so)\s*[:.]?\s*([A-Z0-9ĐĐa-zÀ-ỹ/._-]{2,})", 10).alias("document_numbers"),
        T.unique_matches(body, r"(?iu)(?:chủ tịch|giám đốc|phó giám đốc|trưởng phòng|kt\.|ký bởi|người ký|đại diện)\s*[:.]?\s*([A-ZÀ-Ỹ][^\n]{2,80})", 10).alias("approvers_or_positions"),
    )


# contracts


def contract_name() -> Column:
    """E21."""

    def stop(x: Column) -> Column:
        return x["n"].rlike(r"^so\b") | starts_with(x["n"], ["hom nay", "can cu", "ben a", "ben b", "chu dau tu", "nha thau", "dieu "])

    def goes_on(x: Column) -> Column:
        named = x["n"].rlike("tu van|thiet ke|thi cong|du toan|xay dung|mua sam|goi thau|cong trinh|du an")
        return (F.length(x["t"]) <= 180) & (named | ((F.length(x["t"]) <= 130) & x["t"].rlike(r"\p{L}") & (T.uppercase_ratio(x["t"]) >= 0.6)))

    def names(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when(x["n"].contains("hop dong") & ~starts_with(x["n"], ["can cu", "dieu ", "gia ", "ben "]), i + 1)), lambda i: i.isNotNull())
        return first(F.filter(F.transform(starts, lambda i: collapse(F.array_join(run_on(lines, i, 6, stop, goes_on), " "))), lambda s: F.length(s) >= 8))

    return F.substring(let(C.head(120), names), 1, 500)


def work_name(name: Column) -> Column:
    """What a contract is about, from its name."""
    bare = F.regexp_replace(name, r"(?iuU)\b(hợp\s*đồng|hop\s*dong)\b", "")
    cut = collapse(T.strip_edges(F.get(F.split(bare, r"(?iuU)\b(?:số|so)\b\s*[:.]?", 2), F.lit(0)), " -:;,."))
    return let(cut, lambda c: F.when(F.length(c) >= 6, F.substring(c, 1, 260)))


def contract_number() -> Column:
    """E21."""

    def candidate(x: Column) -> Column:
        value = collapse(F.regexp_extract(x["t"], r"(?iu)(?:số\s+hợp\s+đồng|số\s+hđ|số|so)\s*[:.]?\s*([A-Z0-9Đa-zÀ-ỹ/._-]{2,80})", 1))
        return F.struct(T.strip_edges(value).alias("v"), x["t"].alias("t"))

    lines = F.filter(C.head(90), lambda x: (x["n"].contains("hop dong") | x["n"].rlike(r"^so\b")) & ~x["n"].rlike("tai khoan|dien thoai|ma so thue"))
    best = first(F.filter(F.transform(lines, candidate), lambda c: c["v"].rlike(r"\d") & (normalize_rules(c["v"]).contains("hd") | c["v"].contains("/"))))
    return let(best, lambda b: field(b["v"], b["v"], b["t"], 0.86))


def contract_form() -> Column:
    """The first form whose alias occurs."""
    out = F.lit(None).cast(FIELD)
    for form, aliases in reversed(CONTRACT_FORMS):
        place = F.regexp_instr("norm", F.lit(aliases)) - 1
        raw = T.raw_index(F.length("body"), F.length("norm"), place)
        start = F.greatest(raw - 120, F.lit(0))
        out = F.when(F.col("norm").rlike(aliases), field(F.lit(form), F.lit(form), T.first_line(F.substring(F.col("body"), start + 1, raw - start + 180)), 0.82)).otherwise(out)
    return out


def contractor_name() -> Column:
    """E24."""

    def tidy(v: Column) -> Column:
        cut = F.get(F.split(collapse(v), r"(?iu)\s+(?:mã\s+số\s+thuế|mst|địa\s+chỉ|đại\s+diện|chức\s+vụ|tài\s+khoản|số\s+tài\s+khoản)\b", 2), F.lit(0))
        return let(T.strip_edges(cut), lambda c: F.when(F.length(c) >= 5, F.substring(c, 1, 220)))

    p1 = r"(?iu)(?:bên\s+b|nhà\s+thầu|bên\s+nhận\s+thầu|đại\s+diện\s+bên\s+b)\s*[:\-]?\s*([A-ZÀ-Ỹ][^\n]{5,180})"
    p2 = r"(?iu)(?:tên\s+nhà\s+thầu|tên\s+bên\s+b)\s*[:\-]?\s*([A-ZÀ-Ỹ][^\n]{5,180})"
    named = F.filter(C.head(240), lambda x: x["n"].rlike("ben b|nha thau|ben nhan thau"))
    on_line = first(F.filter(F.transform(named, lambda x: F.struct(F.coalesce(tidy(missing(F.regexp_extract(x["t"], p1, 1))), tidy(missing(F.regexp_extract(x["t"], p2, 1)))).alias("v"), x["t"].alias("t"))), lambda c: c["v"].isNotNull()))

    def below(lines: Column) -> Column:
        near = F.transform(lines, lambda x, i: F.when(starts_with(x["n"], ["ben b", "nha thau", "ben nhan thau"]), first(F.filter(F.slice(lines, i + 2, F.lit(4)), is_issuer_line))["t"]))
        return first(F.filter(near, lambda t: t.isNotNull()))

    return F.coalesce(let(on_line, lambda b: field(b["v"], b["v"], b["t"], 0.82)), let(let(C.head(260), below), lambda t: field(t, t, t, 0.72)))


def contractor_group(name: Column) -> Column:
    """The first group with an alias in the name or the text's beginning."""
    source = normalize_rules(F.concat_ws("\n", F.coalesce(name, F.lit("")), F.substring("body", 1, 6000)))
    shown = F.coalesce(missing(name), T.first_line(F.col("body")))

    def pick(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for group, aliases in reversed(CONTRACTOR_GROUPS):
            out = F.when(s.rlike(aliases), group).otherwise(out)
        return out

    return let(let(source, pick), lambda g: field(g, g, shown, 0.58))


# assembly


def document_fields(docs: DataFrame, text: str = "clean_text", receipt_amounts: bool = False) -> DataFrame:
    """The rows with intent, value_role, the seven fields, note_list and generic."""
    df = C.with_lines(docs, text)
    df = once(df, intent=C.intent(), title_kind=C.title_kind(C.head(90)))
    df = once(df, value_role=C.value_role(F.col("intent")))
    role = F.col("value_role")
    approved = F.when(role == "approved", F.coalesce(labelled_money(DECISION_TOTAL), labelled_money(APPROVED, exclude=True), labelled_money(GENERAL_AMOUNT))).when(role == "contract_approved", labelled_money(CONTRACT_VALUE))
    if receipt_amounts:
        approved = approved.when(role == "receipt", labelled_money(GENERAL_AMOUNT))
    submitted = F.when(role == "submitted", F.coalesce(labelled_money(SUBMITTED), labelled_money(GENERAL_AMOUNT), labelled_money(APPROVED)))
    df = once(df, document_number=document_number(), signed_or_effective_date=signed_date(F.col("title_kind")), approved_value=approved, submitted_value=submitted, issuer=issuer(F.col("title_kind")), note_list=notes(), title=let(document_title(), lambda t: field(t, t, t, 0.84)))
    five = F.array_join(F.slice("note_list", 1, 5), "; ")
    df = df.withColumn("notes", F.when(F.size("note_list") > 0, field(five, five, first(F.col("note_list")), 0.66)))
    return df.drop("lines", "norm", "sample", "context", "body")


def contract_fields(docs: DataFrame, text: str = "clean_text", only: list[str] | None = None) -> DataFrame:
    """The rows with the eighteen fields and note_list, or with ``only`` some of them: the others aren't looked for."""
    wanted = [*CONTRACT_FIELDS, "note_list"] if only is None else only
    df = C.with_lines(docs, text)
    df = once(df, title_kind=C.title_kind(C.head(90)), cname=contract_name())
    found = dict(
        contract_number=contract_number(), signed_date=contract_signed_date(F.col("title_kind")), execution_duration_days=duration_days(), contract_form=contract_form(), contract_vat_percent=labelled_percent(CONTRACT_VAT),
        settlement_request_vat_percent=labelled_percent(SETTLEMENT_VAT), appraisal_vat_percent=labelled_percent(APPRAISAL_VAT), estimated_value=labelled_money(ESTIMATED), contract_value=labelled_money(CONTRACT_VALUE),
        contractor_group=contractor_group(F.col("cname")), contractor_name=contractor_name(), performance_guarantee_value=labelled_money(PERFORMANCE), performance_guarantee_end_date=labelled_date(PERFORMANCE),
        advance_guarantee_value=labelled_money(ADVANCE), advance_guarantee_end_date=labelled_date(ADVANCE), note_list=notes(),
    )
    needed = {*wanted, *(["contract_value"] if "contractor_contract_amount" in wanted else [])}
    df = once(df, **{k: c for k, c in found.items() if k in needed})
    name, value = F.col("cname"), F.col("contract_value")
    if "contract_name" in wanted:
        df = df.withColumn("contract_name", field(name, name, name, 0.84))
    if "work_name" in wanted:
        df = df.withColumn("work_name", let(work_name(name), lambda w: field(w, w, name, 0.68)))
    if "contractor_contract_amount" in wanted:
        df = df.withColumn("contractor_contract_amount", F.when(value.isNotNull(), F.struct(value["value"], value["norm"], value["amount"], value["evidence"], F.lit(0.72).alias("confidence"))).cast(FIELD))
    return df.drop("lines", "norm", "sample", "context", "body", "cname")


def long_fields(wide: DataFrame, keys: list[str], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, field_key, value, norm, amount, evidence, confidence, source), one row per field found."""
    rows = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("field_key"), F.col(f"{k}.value").alias("value"), F.col(f"{k}.norm").alias("norm"), F.col(f"{k}.amount").alias("amount"), F.col(f"{k}.evidence").alias("evidence"), F.round(F.col(f"{k}.confidence"), 4).alias("confidence"), F.lit("rule").alias("source"))) for k in keys])
    return wide.select(doc_id, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select(doc_id, "f.*")
