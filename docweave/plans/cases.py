"""Registered queries of single operators, over texts with the branches that the rendered documents lack.

Each makes its input from a table's columns, so that the SQL beside it can say
the answer in another way, from the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import classify as C
from docweave.operators import cleaning, dims, extract, jsonops, layout, matching, merge, metrics
from docweave.plans.render import customers_as_segments, orders_as_documents, spread, table
from docweave.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def num() -> Column:
    """An order's key."""
    return F.col("o_orderkey")


def key() -> Column:
    return num().cast("string")


def case(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def pick(n: int, *values: Column | str | None) -> Column:
    """One of the values by the order's key; the last for all other remainders."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(num() % n == 0, lit(values[0]))
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(num() % n == i, lit(v))
    return out.otherwise(lit(values[-1]))


def cat(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


# text


@case("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'Hà Nội, ngày 0' || (o_orderkey % 9 + 1) || ' tháng 6 năm 2018' WHEN 1 THEN 'ngày 1' || o_orderkey % 10 || ' tháng 6 năm 2018'
  WHEN 2 THEN 'tháng 6 năm ' || (2000 + o_orderkey % 30) WHEN 3 THEN '"số ' || o_orderkey || '" - ''a''' ELSE 'ngày 2' || o_orderkey % 9 || ' tháng 12 năm 2020' END AS text FROM orders""")
def q_repair_dates(spark, sf):
    """Dates and marks as scanners misread them."""
    raw = pick(
        5, cat("Hà Nội, ngày D", (num() % 9 + 1).cast("string"), " tháng 6 năm 2018"), cat("ngày 1 ", (num() % 10).cast("string"), " tháng 6 năm 2018"), cat("tháng 06 ... năm ", (2000 + num() % 30).cast("string")), cat("“số ", key(), "” – ‘a’"), cat("ngày Đ2", (num() % 9).cast("string"), " tháng 12. năm 2020")
    )
    return orders(spark, sf).select(num().alias("doc_id"), T.repair_characters(raw).alias("text"))


@case("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Số: ' || o_orderkey || '/QĐ-UBND' ELSE 'Số: 56' || o_orderkey % 100 || '6/NHNo 50%' END AS text FROM orders")
def q_repair_numbers(spark, sf):
    """Blanks around a slash, and a 6 that was read as %."""
    raw = F.when(num() % 4 == 0, cat("Số: ", key(), " /QĐ-UBND")).when(num() % 2 == 0, cat("Số: ", key(), "/ QĐ-UBND")).otherwise(cat("Số: 5%", (num() % 100).cast("string"), "%/NHNo 50%"))
    return orders(spark, sf).select(num().alias("doc_id"), T.repair_number_glyphs(T.repair_number_spaces(raw)).alias("text"))


@case("SELECT o_orderkey AS doc_id, 'Dòng ' || o_orderkey || '|Cộng hòa' AS text FROM orders")
def q_boilerplate(spark, sf):
    """N11."""
    lines = F.array(F.lit("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"), F.lit("Độc lập - Tự do - Hạnh phúc"), cat("Dòng ", key()), F.lit("Cộng hòa"), F.lit("Socialist Republic of Vietnam"))
    return orders(spark, sf).select(num().alias("doc_id"), F.array_join(T.non_boilerplate(lines), "|").alias("text"))


@case("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'a|n' || o_orderkey || '|deep' || o_orderkey WHEN 1 THEN 't|' || o_orderkey || '|x|y' WHEN 2 THEN 'plain ' || o_orderkey ELSE '' END AS texts FROM orders""")
def q_flatten_text(spark, sf):
    """Texts within lists and objects, deeper than any one list."""
    deep = cat('["a", {"name": "n', key(), '", "other": "no"}, [[[[[["deep', key(), '"]]]]]], null]')
    nested = cat('{"value": {"text": [[[[{"label": "', key(), '"}]], "x"]]}, "title": "t", "label": {"name": [{"value": {"keyword": "y"}}]}}')
    value = pick(4, deep, nested, cat('"plain ', key(), '"'), "null")
    return orders(spark, sf).select(num().alias("doc_id"), F.array_join(T.flatten_text(value), "|").alias("texts"))


@case("SELECT o_orderkey AS doc_id, 'a_b_' || o_orderkey || '_é-ü_' AS name, 'số ' || o_orderkey || ' quyết định' AS shadow, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey + 0.5 ELSE 0 END::DOUBLE AS number FROM orders")
def q_plain_forms(spark, sf):
    """N19, N20, N21."""
    number = pick(3, cat(key(), ".5"), "abc", None)
    return orders(spark, sf).select(num().alias("doc_id"), T.metric_name(cat("a b/", key(), ".é-ü ")).alias("name"), T.shadow_form(cat("  SỐ ", key(), "\n\t QUYẾT  Định ")).alias("shadow"), T.safe_double(number).alias("number"))


@case("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE least(2 * (o_orderkey % 40 + 1) - 1, 2 * (o_orderkey % 50)) END::INT AS at FROM orders")
def q_raw_index(spark, sf):
    """A place of the normal form in a text of twice its length, or in none."""
    size = (num() % 40 + 1).cast("int")
    return orders(spark, sf).select(num().alias("doc_id"), T.raw_index(F.when(num() % 3 == 0, 0).otherwise(2 * size), size, (num() % 50).cast("int")).alias("at"))


# cleaning


@case("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 8 = 7 THEN 'Nội dung ' || o_orderkey || ' Q trong' ELSE 'Nội dung ' || o_orderkey END AS line FROM orders")
def q_strip_suffix(spark, sf):
    """C14: none to a dozen remains of stamps at the end of a line."""
    tail = pick(8, "", F.repeat(F.lit(" * Q"), (num() % 7).cast("int")), " Q. BA ĐÌNH và", F.lit(" * Q * Q * Q * Q * Q * Q *"), " TP. HÀ NỘI Q", " NÔNG N . Q", cat(" S.D.N: 0100686 C.T.T.N.H.H ", F.repeat(F.lit("= "), 5)), " Q trong")
    return orders(spark, sf).select(num().alias("doc_id"), cleaning.strip_suffixes(cat("Nội dung ", key(), tail)).alias("line"))


@case("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Về việc ' || o_orderkey WHEN 1 THEN '' ELSE 'Trích yếu ' || o_orderkey END AS line,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Về việc ' || o_orderkey END AS tail FROM orders""")
def q_inline_stamp(spark, sf):
    """A line that holds a stamp's words, and a stamp's date with and without a subject."""
    line = pick(3, cat("CÔNG VĂN ĐẾN Số 193 Về việc ", key()), "Văn bản đến số: 12", cat("Hồ sơ đến  Trích yếu ", key()))
    dated = pick(4, "Ngày 7 tháng 5 năm 2018.", cat("Ngày 7/5/2018  Về việc ", key()), cat("Ngày 7/5/2018 tại ", key()), cat("Họp ngày 7/5/2018 ", key()))
    return orders(spark, sf).select(num().alias("doc_id"), cleaning.without_inline_stamp(line).alias("line"), cleaning.stamp_date_tail(dated).alias("tail"))


@case("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 8 WHEN 0 THEN 'blank_or_symbol' WHEN 1 THEN CASE WHEN o_orderkey % 40 > 6 THEN 'page_number' END WHEN 2 THEN 'round_seal_artifact' WHEN 3 THEN CASE WHEN o_orderkey % 40 > 8 THEN 'round_seal_fragment' END
  WHEN 4 THEN CASE WHEN o_orderkey % 40 > 28 THEN 'round_seal_fragment' END WHEN 5 THEN CASE WHEN o_orderkey % 40 > 8 THEN 'ocr_garbage' END WHEN 6 THEN CASE WHEN o_orderkey % 40 > 8 THEN 'round_seal_fragment' END END AS reason FROM orders""")
def q_noise_reason(spark, sf):
    """C12, C13 and their parts, by the place of the line."""
    line = pick(8, "§ ¤", (num() % 900).cast("string"), "M.S.D.N: 0100686174", "NÔNG NGHIỆP", "NGÂN HÀNG NÔNG NGHIỆP VIỆT NAM CHI NHÁNH", "x~", "UBND", cat("Nội dung của văn bản số ", key()))
    return orders(spark, sf).select(num().alias("doc_id"), cleaning.noise_reason(line, (num() % 40).cast("int")).alias("reason"))


@case("""
SELECT o_orderkey AS doc_id, 1 AS chunk, 'Điều ' || o_orderkey AS text FROM orders UNION ALL SELECT o_orderkey, 2, 'Khoản 1 của Điều ' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0""")
def q_clean_chunks(spark, sf):
    """Chunks cleaned by themselves; those left empty go."""
    texts = F.array(F.lit("CÔNG VĂN ĐẾN\nSố 193\nNgày 7 tháng 5 năm 2018"), cat("Điều ", key(), "\nM.S.D.N: 0100686174"), F.when(num() % 2 == 0, cat("Khoản 1 của Điều ", key(), " Q")).otherwise("  "))
    chunks = orders(spark, sf).select(num().alias("doc_id"), F.posexplode(texts).alias("chunk", "text"))
    return cleaning.clean_chunks(chunks).select("doc_id", "chunk", "text")


_SEGMENTS = "(SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS o, c_mktsegment || ' ' || c_name AS text FROM customer)"


@case(f"SELECT doc_id, sum((o % 20 IN (3, 4))::INT)::BIGINT AS removed, sum((o % 20 NOT IN (3, 4))::INT)::BIGINT AS kept, 0::BIGINT AS removed_lines FROM {_SEGMENTS} GROUP BY doc_id")
def q_clean_layouts(spark, sf):
    """C4: a stamped layout's segments removed and kept, beside its text's report."""
    s = customers_as_segments(table(spark, sf, "customer"))
    s = s.withColumn("text", F.when(F.col("ord") % 20 == 3, "CÔNG VĂN ĐẾN").when(F.col("ord") % 20 == 4, "Số 193").otherwise(F.col("text")))
    docs, kept = cleaning.clean_layouts(s.select("doc_id").distinct().withColumn("text", F.lit("Nội dung")), s, compose=False)
    return docs.join(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept")), "doc_id").select("doc_id", F.col("removed_segment_count").cast("long").alias("removed"), "kept", F.col("removed_line_count").cast("long").alias("removed_lines"))


# classification


@case("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'contract' ELSE 'document' END AS coarse, CASE o_orderkey % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'to_trinh' WHEN 2 THEN 'bien_ban_hop' ELSE 'unknown' END AS chosen,
  CASE WHEN o_orderkey % 3 = 1 THEN 'contract' ELSE 'document' END AS checked FROM orders""")
def q_types(spark, sf):
    """P5, P6, P13."""
    o = orders(spark, sf).withColumn("sample", F.when(num() % 4 == 2, "ben a va ben b cua hop dong").otherwise("noi dung"))
    rule, payload = pick(4, "contract", "to_trinh", "unknown", None), pick(4, "quyet_dinh", "Quyết định", "Biên bản họp", " ")
    return o.select(num().alias("doc_id"), C.coarse_type(F.coalesce(rule, F.lit("unknown"))).alias("coarse"), C.chosen_intent(rule, payload).alias("chosen"), C.checked_type(pick(3, "", " Contract ", None)).alias("checked"))


@case("""
SELECT o_orderkey AS doc_id, o_orderkey % 5 IN (0, 3) AS undated, o_orderkey % 4 <> 3 AS is_number, o_orderkey % 3 = 0 AS has_money FROM orders""")
def q_line_kinds(spark, sf):
    """P9, P10, P12."""
    kind = pick(5, "bao cao", "quyet dinh", None, "he thong qlcl", "chung chi")
    line = pick(4, cat("Số: ", key(), "/QĐ"), cat("  so ", key()), "SỐ. Đ12", cat("Ngày số ", key()))
    body = pick(3, cat("Dự toán: ", key(), ".000.000 đồng"), "Giá trị gói thầu được duyệt", cat("Chi ", key(), ".000.000 đồng"))
    return orders(spark, sf).select(num().alias("doc_id"), C.is_undated(kind).alias("undated"), C.is_number_line(line).alias("is_number"), C.money_signal(body).alias("has_money"))


_INTENTS = ["to_trinh", "phieu_thu", "chung_tu_phi", "contract", "quyet_dinh", "tham_gia_y_kien", "cung_cap_thong_tin", "gop_y", "giay_moi", "phan_cong", "ho_so_trinh", "van_ban_phe_duyet", "van_ban_chap_thuan", "bien_ban", "thong_bao", "unknown"]


@case(f"SELECT o_orderkey AS doc_id, [{', '.join(repr(x) for x in _INTENTS)}][o_orderkey % 16 + 1] AS intent FROM orders")
def q_intent_branches(spark, sf):
    """A text for each rule."""
    text = pick(
        16, "Kèm theo Số 5/TTr-BQL", "PHIẾU THU\nNgười nộp", "Người nộp\nSố tiền lệ phí đã thu", "Đại diện Bên A\nĐại diện Bên B\nGiá trị hợp đồng là", "Kèm theo Số 7/QĐ-UB", "V/v tham gia ý kiến", "V/v cung cấp thông tin", "V/v góp ý", "Kính mời họp ngày mai", "V/v phân công nhiệm vụ",
        "Kèm hồ sơ trình", "V/v phê duyệt dự toán", "V/v đồng ý chủ trương", "BIÊN BẢN\nbàn giao", "THÔNG BÁO\nnghỉ lễ", "Một văn bản khác",
    )
    df = C.with_lines(spread(orders(spark, sf).select(num(), text.alias("text"))), "text")
    return df.select(num().alias("doc_id"), C.intent().alias("intent"))


# extraction


@case("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 < 2 AND length(o_orderkey::VARCHAR) BETWEEN 2 AND 8 THEN o_orderkey::VARCHAR END AS prefix FROM orders")
def q_filename_hint(spark, sf):
    """E3."""
    name = pick(3, cat("in/", key(), ". van ban.pdf"), cat("C:\\x\\ ", key(), "_QD.docx"), cat("a", key(), "-x.pdf"))
    return orders(spark, sf).select(num().alias("doc_id"), extract.filename_prefix(name).alias("prefix"))


@case("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2023-08-21' ELSE '2019-03-02' END AS iso, CASE o_orderkey % 3 WHEN 0 THEN 0.88 ELSE 0.96 END::DOUBLE AS confidence FROM orders""")
def q_registration_date(spark, sf):
    """The highest change of a registration, else the first registration."""
    start = cat("GIẤY CHỨNG NHẬN ĐĂNG KÝ DOANH NGHIỆP\nMã số doanh nghiệp: 0101\nĐăng ký lần đầu: ngày ", F.date_format("o_orderdate", "dd"), " tháng ", F.date_format("o_orderdate", "MM"), " năm ", F.date_format("o_orderdate", "yyyy"))
    change = lambda n, d: f"\nĐăng ký thay đổi lần thứ: {n}, {d}"
    text = cat(start, pick(3, "", change(2, "ngày 02 tháng 3 năm 2019") + change(10, "ngày 21 tháng 08 năm 2023"), change(7, "02/03/2019") + change(3, "ngày 21 tháng 08 năm 2023")))
    df = T.once(C.with_lines(spread(orders(spark, sf).select(num(), text.alias("text"))), "text"), f=extract.registration_date())
    return df.select(num().alias("doc_id"), F.col("f.norm").alias("iso"), F.col("f.confidence").alias("confidence"))


@case("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso, [0.86, 0.74, 0.70, 0.94, NULL][o_orderkey % 5 + 1]::DOUBLE AS confidence FROM orders""")
def q_signed_date_branches(spark, sf):
    """Labelled, on a line, the latest behind the first lines, under the motto; none where only other texts' dates stand."""
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    worded = cat("ngày ", F.date_format("o_orderdate", "dd"), " tháng ", F.date_format("o_orderdate", "MM"), " năm ", F.date_format("o_orderdate", "yyyy"))
    text = pick(
        5, cat("QUYẾT ĐỊNH\nNgày ký: ", day), cat("QUYẾT ĐỊNH\nHọp vào ", day, " tại trụ sở"), cat("QUYẾT ĐỊNH\n", F.repeat(F.lit("Nội dung của văn bản này\n"), 90), "Họp vào ", day), cat("Độc lập - Tự do - Hạnh phúc\nHà Nội, ", worded, "\nQUYẾT ĐỊNH\nHọp ngày 01/01/2001"),
        cat("QUYẾT ĐỊNH\nCăn cứ Luật số 43 ", worded),
    )
    df = T.once(C.with_lines(spread(orders(spark, sf).select(num(), "o_orderdate", text.alias("text"))), "text", only=("lines",)), f=extract.signed_date(C.title_kind(C.head(90))))
    return df.select(num().alias("doc_id"), F.col("f.norm").alias("iso"), F.col("f.confidence").alias("confidence"))


@case("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'UBND TỈNH SỐ ' || o_orderkey WHEN 1 THEN 'CHI CỤC THUẾ KHU VỰC PHÒNG ĐĂNG KÝ KINH DOANH SỐ ' || o_orderkey WHEN 2 THEN 'SỞ XÂY DỰNG BAN QUẢN LÝ DỰ ÁN ' || o_orderkey END AS issuer FROM orders""")
def q_issuer_branches(spark, sf):
    """A certificate's authorities, an administrative head of two lines, and kinds that none issues."""
    text = pick(
        4, cat("UBND TỈNH SỐ ", key(), "\nCÔNG TY A\nGIẤY CHỨNG NHẬN\nUBND TỈNH B"), cat("CHI CỤC THUẾ KHU VỰC\nPHÒNG ĐĂNG KÝ KINH DOANH SỐ ", key(), "\nGIẤY XÁC NHẬN"), cat("SỞ XÂY DỰNG\nBAN QUẢN LÝ DỰ ÁN ", key(), "\nSố: 5/QĐ-BQL\nQUYẾT ĐỊNH"), cat("BAN QUẢN LÝ ", key(), "\nBÁO CÁO\nthường kỳ")
    )
    df = T.once(C.with_lines(spread(orders(spark, sf).select(num(), text.alias("text"))), "text"), f=extract.issuer(C.title_kind(C.head(90))))
    return df.select(num().alias("doc_id"), F.col("f.value").alias("issuer"))


@case("SELECT o_orderkey AS doc_id, ['Hợp đồng trọn gói', 'Hợp đồng theo đơn giá cố định', 'Hợp đồng theo đơn giá điều chỉnh', 'Hợp đồng theo thời gian', NULL][o_orderkey % 5 + 1] AS form FROM orders")
def q_contract_form(spark, sf):
    """E23."""
    text = pick(5, "Loại hợp đồng: trọn gói", "Áp dụng đơn giá cố định", "Áp dụng đơn giá điều chỉnh", "Thanh toán theo thời gian", "Không nói gì")
    df = T.once(C.with_lines(spread(orders(spark, sf).select(num(), text.alias("text"))), "text"), f=extract.contract_form())
    return df.select(num().alias("doc_id"), F.col("f.value").alias("form"))


_MONEY = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice)::BIGINT WHEN 1 THEN (o_orderkey % 900 + 1) * 1000000000 + 500000000 WHEN 2 THEN (o_orderkey % 900 + 1) * 1000000 ELSE floor(o_totalprice)::BIGINT END::BIGINT AS amount FROM orders WHERE o_totalprice >= 1000"


@case(_MONEY)
def q_money_units(spark, sf):
    """Amounts beside a unit in parentheses, in billions and millions by the word, and plain."""
    from docweave.plans.render import thousands

    n = (num() % 900 + 1).cast("string")
    plain = thousands(F.floor("o_totalprice"))
    text = pick(4, cat("Giá trị trình (1.000 đồng): ", plain, " VNĐ"), cat("Giá trị trình: ", n, ",5 tỷ đồng"), cat("Giá trị trình: ", n, " triệu đồng"), cat("Giá trị trình: ", plain, " đồng"))
    df = T.once(C.with_lines(spread(orders(spark, sf).where("o_totalprice >= 1000").select(num(), "o_totalprice", text.alias("text"))), "text"), v=extract.labelled_money(extract.SUBMITTED))
    return df.select(num().alias("doc_id"), F.col("v.amount").cast("long").alias("amount"))


_NUMBER = "o_orderkey || '/' || CASE o_orderstatus WHEN 'O' THEN 'TTr' WHEN 'F' THEN 'QĐ' ELSE 'BL' END || '-BQLDA'"


@case(f"""
SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'to_trinh' WHEN 'F' THEN 'quyet_dinh' ELSE 'bien_lai' END AS intent, {_NUMBER} AS number, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice)::BIGINT END AS submitted,
  CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice)::BIGINT END AS approved, CASE WHEN o_orderkey % 2 = 0 THEN 'Ghi chú: chưa bao gồm phí ' || o_orderkey END AS notes FROM orders""")
def q_document_fields(spark, sf):
    """All fields of rendered documents at once."""
    docs = orders_as_documents(spread(orders(spark, sf).select(num(), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")), decoys=True)
    df = extract.document_fields(cleaning.clean_documents(docs, compose=False))
    return df.select("doc_id", "intent", F.col("document_number.norm").alias("number"), F.col("signed_or_effective_date.norm").alias("iso"), F.col("submitted_value.amount").cast("long").alias("submitted"), F.col("approved_value.amount").cast("long").alias("approved"), F.col("notes.value").alias("notes"))


@case(f"SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'to_trinh' WHEN 'F' THEN 'quyet_dinh' ELSE 'bien_lai' END AS intent, {_NUMBER} AS number, 'unavailable' AS provider, strftime(o_orderdate, '%d/%m/%Y') AS day, 0.865::DOUBLE AS confidence FROM orders")
def q_extract_information(spark, sf):
    """Documents from text to fields without a provider."""
    docs = orders_as_documents(spread(orders(spark, sf).select(num(), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")))
    out = merge.extract_information(docs.drop("kind"), compose=False)
    return out.select("doc_id", F.col("document_intent").alias("intent"), F.col("fields")["document_number"]["value"].alias("number"), "provider", F.col("fields")["signed_or_effective_date"]["value"].alias("day"), F.col("local_confidence").alias("confidence"))


# JSON and prompts


@case("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey::VARCHAR END AS id, CASE WHEN o_orderkey % 3 = 2 THEN '{}' ELSE '{\"id\":' || o_orderkey || ',\"n\":null}' END AS answer FROM orders")
def q_response_text(spark, sf):
    """The object in a model's answer, in parts and with a fence; values with nulls as compact JSON."""
    own = jsonops.compact_json(F.struct(num().alias("id"), F.lit(None).cast("int").alias("n")))
    parts = pick(3, F.array(cat("```json\n", own, "\n```")), F.array(F.lit("Here: "), own, F.lit("done")), F.array(F.lit("none")))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(F.transform(parts, lambda t: F.struct(t.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    df = T.once(orders(spark, sf), answer=jsonops.response_text(response))
    return df.select(num().alias("doc_id"), F.get_json_object("answer", "$.id").alias("id"), "answer")


def order_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(F.struct(F.lit("document_number").alias("field_key"), F.repeat(key(), 200).alias("value"), F.lit(0.5).alias("confidence")), F.when(num() % 2 == 0, F.struct(F.lit("issuer").alias("field_key"), F.when(num() % 4 == 0, "BAN").otherwise("").alias("value"), F.lit(0.9).alias("confidence"))))
    long = orders(spark, sf).select(num().alias("doc_id"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select("doc_id", "f.*")
    return long.select("doc_id", "field_key", "value", F.col("value").alias("norm"), F.lit(None).cast("double").alias("amount"), F.lit("e").alias("evidence"), "confidence", F.lit("llm").alias("source"))


@case("SELECT o_orderkey AS doc_id, left(repeat(o_orderkey::VARCHAR, 200), 500) AS v, left(repeat(o_orderkey::VARCHAR, 200), 300) AS n, CASE WHEN o_orderkey % 4 = 0 THEN 'BAN' END AS issuer FROM orders")
def q_prompt_fields(spark, sf):
    """J4."""
    p = jsonops.prompt_fields(order_fields(spark, sf))
    return p.select("doc_id", F.get_json_object("fields", "$.document_number.v").alias("v"), F.get_json_object("fields", "$.document_number.n").alias("n"), F.get_json_object("fields", "$.issuer.v").alias("issuer"))


@case("""
SELECT o_orderkey AS doc_id, 'document_number' AS field_key, 'Số ' || o_orderkey AS value, o_orderkey::VARCHAR AS norm, 0.7::DOUBLE AS confidence FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, 'issuer', 'BAN', NULL, 0::DOUBLE FROM orders WHERE o_orderkey % 3 = 1""")
def q_payload_fields(spark, sf):
    """Answers of a schema as fields; empty values and broken answers give none."""
    one = cat('{"fields": {"document_number": {"value": "Số ', key(), '", "normalized_value": "', key(), '", "confidence": 0.7}')
    answer = pick(3, cat("```json\n", one, "}}\n```"), cat(one, ', "issuer": {"value": "BAN"}, "title": {"value": ""}}, "notes": []}'), '{"fields": [1, 2')
    df = orders(spark, sf).select(num().alias("doc_id"), answer.alias("answer"))
    return jsonops.payload_fields(df, ["document_number", "issuer", "title"]).select("doc_id", "field_key", "value", "norm", "confidence")


_LINES = "list_transform(range(1, o_orderkey % 60 + 2), lambda i: CASE WHEN i % 20 = 0 THEN 'Dự án ' || i ELSE 'Dòng ' || i END)"


def numbered_lines() -> Column:
    return F.transform(F.sequence(F.lit(1), (num() % 60 + 1).cast("int")), lambda i: F.when(i % 20 == 0, F.concat(F.lit("Dự án "), i.cast("string"))).otherwise(F.concat(F.lit("Dòng "), i.cast("string"))))


@case(f"""
WITH t AS (SELECT o_orderkey, {_LINES} AS a FROM orders)
SELECT o_orderkey AS doc_id, array_to_string(a, chr(10)) AS entity, array_to_string(list_concat(list_concat(a[1:45], list_filter(a[46:], lambda s: s LIKE 'Dự án%')), ['E ' || o_orderkey]), chr(10)) AS fallback,
  left(left(array_to_string(a, chr(10)), 100) || CASE WHEN len(list_filter(a[31:], lambda s: s LIKE 'Dự án%')) > 0 THEN chr(10) || array_to_string(list_filter(a[31:], lambda s: s LIKE 'Dự án%'), chr(10)) ELSE chr(10) END, 200) AS tiebreak FROM t""")
def q_fallback_text(spark, sf):
    """J6 to J8."""
    df = T.once(spread(orders(spark, sf)), ln=numbered_lines())
    return df.select(num().alias("doc_id"), jsonops.entity_text(F.concat(F.array(F.lit("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM")), "ln")).alias("entity"), jsonops.fallback_text(F.col("ln"), F.array(cat("E ", key()))).alias("fallback"), jsonops.tiebreaker_text(F.col("ln"), 200).alias("tiebreak"))


@case("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'a' WHEN o_orderkey % 3 = 1 THEN 'b' END AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 0.1235 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN repeat('r', 500) WHEN o_orderkey % 3 = 1 THEN '' END AS reasoning,
  left('lỗi ' || o_orderkey || ' ' || repeat('ab ', 200), 300) AS error FROM orders""")
def q_tiebreaker_choice(spark, sf):
    """J11, J13."""
    answer = pick(3, cat('{"id": "a", "confidence": 1.7, "reasoning": "', F.repeat(F.lit("r"), 900), '"}'), 'so {"id": "b", "confidence": 0.12345} it is', '{"id": "c", "confidence": 0.9}')
    df = T.once(orders(spark, sf), c=jsonops.tiebreaker_choice(answer, F.array(F.lit("a"), F.lit("b"))))
    return df.select(num().alias("doc_id"), "c.id", "c.confidence", "c.reasoning", jsonops.compact_error(cat("lỗi \n ", key(), "\t", F.repeat(F.lit("ab\n"), 200))).alias("error"))


# matching


@case("""
SELECT o_orderkey AS doc_id, round(2.0 * length(o_orderkey::VARCHAR) / (2 * length(o_orderkey::VARCHAR) + o_orderkey % 7), 6) AS ratio, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END::INT AS run,
  CASE o_orderkey % 3 WHEN 0 THEN 0.08 WHEN 1 THEN -0.08 ELSE 0 END::DOUBLE AS adjust FROM orders""")
def q_similarities(spark, sf):
    """F1, F2's fallback, F5, F7."""
    words = F.split(F.lit("a b x a b c b"), " ")
    members = pick(4, F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a")), F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("a")))
    return orders(spark, sf).select(
        num().alias("doc_id"), F.round(T.sequence_ratio(key(), F.concat(key(), F.repeat(F.lit("z"), (num() % 7).cast("int")))), 6).alias("ratio"), matching.longest_run(words, members).cast("int").alias("run"),
        matching.type_adjustment(F.lit("to_trinh"), pick(3, "to_trinh", "quyet_dinh", None)).alias("adjust"),
    )


@case("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Khu nhà ' || o_orderkey WHEN 1 THEN 'Trụ sở ' || o_orderkey END AS tail FROM orders")
def q_project_tail(spark, sf):
    """what stands behind the word for a project, up to the next detail."""
    title = pick(3, cat("Phê duyệt dự án: Khu nhà ", key(), ", địa điểm Hà Nội, dự án khác"), cat("Công trình - Trụ sở ", key(), "."), cat("Về việc ", key()))
    return orders(spark, sf).select(num().alias("doc_id"), matching.project_tail(title).alias("tail"))


@case("""
SELECT o_orderkey AS doc_id, 0::INT AS q_ord, 'Khu nhà ' || o_orderkey AS query, 'project' AS kind FROM orders UNION ALL SELECT o_orderkey, 1, 'V/v duyệt dự án Khu nhà ' || o_orderkey, 'project' FROM orders
UNION ALL SELECT o_orderkey, 0, 'V/v duyệt dự án Khu nhà ' || o_orderkey, 'task' FROM orders UNION ALL SELECT o_orderkey, 1, 'duyệt dự án Khu nhà ' || o_orderkey, 'task' FROM orders UNION ALL SELECT o_orderkey, 2, 'duyệt', 'task' FROM orders""")
def q_match_queries(spark, sf):
    """a document's queries for projects and tasks, each once."""
    df = orders(spark, sf).select(num().alias("doc_id"), F.array(cat("Khu nhà ", key()), cat(" KHU  nha ", key())).alias("project_name_candidates"), cat("V/v duyệt dự án Khu nhà ", key()).alias("title"))
    both = matching.project_queries(df).withColumn("kind", F.lit("project")).unionByName(matching.task_queries(df).withColumn("kind", F.lit("task")))
    return both.select("doc_id", F.col("q_ord").cast("int").alias("q_ord"), "query", "kind")


@case("""
SELECT o_orderkey AS doc_id, round(CASE o_orderkey % 3 WHEN 0 THEN 0.82 + 0.18 * length(o_orderkey::VARCHAR) / (length(o_orderkey::VARCHAR) + 5) WHEN 1 THEN 0.72 + 0.18 * 4.0 / (4 + 1 + length(o_orderkey::VARCHAR)) ELSE 0.84 * 0.5 END, 6)::DOUBLE AS score FROM orders""")
def q_match_score(spark, sf):
    """containment either way, else words in common."""
    needle = pick(3, key(), cat("abcd ", key()), F.lit("qqqq wwww"))
    hay = pick(3, cat("abcd ", key()), F.lit("abcd"), F.lit("wwww eeeee rrrrr ttttt"))
    score = layout.match_score(needle, hay, F.split(needle, " "), F.split(hay, " "))
    return orders(spark, sf).select(num().alias("doc_id"), F.round(score, 6).alias("score"))


@case("""
WITH t AS (SELECT p_partkey AS doc_id, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS b FROM part)
SELECT doc_id, round(0.72 * len(list_intersect(b, a)) / len(b) + 0.28 * len(list_intersect(a, b)) / len(a), 6)::DOUBLE AS score FROM t""")
def q_cheap_similarity(spark, sf):
    """F17, with words for both kinds of parts."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    a, b = words(F.col("p_name")), words(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.round(layout.cheap_similarity(b, a, a, b), 6).alias("score"))


@case("SELECT id::VARCHAR AS id FROM (SELECT p_partkey AS id, p_partkey % 4 AS s, p_partkey % 3 AS a FROM part) WHERE s IN (0, 1, 2) AND a <> 1")
def q_searchable_projects(spark, sf):
    """S16."""
    p = F.col("p_partkey")
    projects = table(spark, sf, "part").select(p.alias("id"), F.when(p % 4 == 0, " Executing").when(p % 4 == 1, "closed").when(p % 4 == 2, "preparing").otherwise("draft").alias("status"), F.when(p % 3 == 0, True).when(p % 3 == 1, False).alias("is_active"))
    return matching.searchable_projects(projects).select(F.col("id").cast("string").alias("id"))


# layout


@case("SELECT doc_id, (o // 20 + 1)::INT AS f_ord, 's' || o AS seg_id, 1.0::DOUBLE AS score FROM (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS o FROM customer) WHERE o % 20 = 0")
def q_best_single(spark, sf):
    """fields that quote the first line of each page."""
    s = customers_as_segments(table(spark, sf, "customer"))
    first = s.groupBy("doc_id", "page").agg(F.min_by("text", "ord").alias("text"))
    fields = first.select("doc_id", F.col("page").alias("f_ord"), F.col("text").alias("evidence"), F.lit(None).cast("string").alias("value"), F.lit("").alias("norm"))
    return layout.best_single(fields, s)


@case("SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS reused, CASE WHEN o_orderkey % 2 = 0 THEN 3 END::INT AS page, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS needs_review FROM orders")
def q_rematch(spark, sf):
    """boxes kept where a field is unchanged; review if either side says so."""
    o = orders(spark, sf)
    new = o.select(num().alias("doc_id"), F.lit("title").alias("field_key"), key().alias("evidence"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("norm"))
    old = new.withColumn("evidence", F.when(F.col("doc_id") % 2 == 0, F.col("evidence")).otherwise("was")).withColumn("page", F.lit(3))
    kept, changed = layout.rematch(old, new)
    both = kept.select("doc_id", F.lit(True).alias("reused"), "page").unionByName(changed.select("doc_id", F.lit(False).alias("reused"), F.lit(None).cast("int").alias("page")))
    records = both.withColumn("needs_review", F.when(F.col("reused"), True))
    return layout.merge_matching(records, o.select(num().alias("doc_id"), (num() % 3 == 0).alias("needs_review"))).select("doc_id", "reused", "page", "needs_review")


# metrics and requests


@case("""
WITH m AS (SELECT event_type, user_id, median(value) AS m, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
SELECT event_type, user_id, round(m, 6) AS median, lo AS least, hi AS greatest, round(sum(m) OVER (PARTITION BY event_type), 4) AS total FROM m""")
def q_medians(spark, sf):
    """A7."""
    per, total = metrics.medians(table(spark, sf, "events"), "event_type", "user_id", "value")
    return per.join(total, "event_type").select("event_type", "user_id", F.round("median", 6).alias("median"), "least", "greatest", F.round("total", 4).alias("total"))


@case("SELECT o_orderkey AS doc_id, round(2.0 * (3 + length(o_orderkey::VARCHAR)) / (2 * (3 + length(o_orderkey::VARCHAR)) + o_orderkey % 5), 4)::DOUBLE AS similarity FROM orders")
def q_shadow_similarity(spark, sf):
    """Two outputs that differ in case, blanks and some characters at the end."""
    o = orders(spark, sf)
    return metrics.shadow_similarity(o.select(num().alias("doc_id"), cat(" Số  ", key()).alias("text")), o.select(num().alias("doc_id"), cat("SỐ\n", key(), F.repeat(F.lit("z"), (num() % 5).cast("int"))).alias("text")))


@case("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN 410 WHEN o_orderkey % 2 = 0 THEN 200 ELSE 202 END::INT AS http_status FROM orders")
def q_poll_status(spark, sf):
    """What polling a job answers, by its latest revision."""
    one = orders(spark, sf).select(num().alias("job_id"), F.lit(1).alias("revision"), F.lit("failed").alias("status"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    two = orders(spark, sf).select(num().alias("job_id"), F.lit(2).alias("revision"), F.when(num() % 4 == 0, "completed").when(num() % 2 == 0, "completed_with_warnings").otherwise("enriching").alias("status"), F.when(num() % 5 == 0, F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-02-01 12:00:00")).cast("timestamp").alias("updated_at"))
    return metrics.poll_status(one.unionByName(two), F.lit("2024-02-02 00:00:00").cast("timestamp"))


@case("SELECT o_orderkey AS doc_id, CASE WHEN ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000 < 2500 THEN 'cloud_vision' ELSE 'document_ai' END AS canary, 'cloud_vision' AS primary_, 'document_ai_shadow' AS shadow, 'document_ai' AS other FROM orders")
def q_route(spark, sf):
    """T12, T13."""
    of = lambda mode: metrics.route(mode, key(), 25.0)
    return orders(spark, sf).select(num().alias("doc_id"), of("vision_canary").alias("canary"), of("vision_primary").alias("primary_"), of("vision_shadow").alias("shadow"), of("document_ai").alias("other"))


@case("SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'request' ELSE 'ocr' END AS stage FROM orders WHERE o_totalprice >= CASE WHEN o_orderkey % 2 = 0 THEN 15000 ELSE 3000 END")
def q_slow_stages(spark, sf):
    """T14, with prices for times."""
    e = orders(spark, sf).select(num().alias("request_id"), F.when(num() % 2 == 0, "request").otherwise("ocr").alias("stage"), F.col("o_totalprice").alias("ms"))
    return metrics.slow_stages(e).select("request_id", "stage")


# sources and sinks


@case("""
SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR AS number, 0.5::DOUBLE AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS kind, NULL::VARCHAR AS hidden FROM orders""")
def q_result_json(spark, sf):
    """K1, K2: a document's result as JSON, without what is private or not asked for."""
    o = orders(spark, sf)
    fields = o.select(num().alias("doc_id"), F.lit("document_number").alias("field_key"), key().alias("value"), key().alias("norm"), F.lit("e").alias("evidence"), F.lit(0.5).alias("confidence"), F.lit("rule").alias("source"))
    docs = o.select(num().alias("doc_id"), F.when(num() % 2 == 0, "F").alias("kind"), F.lit("big").alias("layout"), F.lit("secret").alias("_payload"))
    out = sinks.result_json(fields, docs)
    get = lambda p: F.get_json_object("result", p)
    return out.select("doc_id", get("$.fields.document_number.normalized_value").alias("number"), get("$.fields.document_number.confidence").cast("double").alias("confidence"), get("$.kind").alias("kind"), F.coalesce(get("$.layout"), get("$._payload")).alias("hidden"))


_STAGES = ["click", "error", "view"]


@case(f"SELECT user_id AS request_id, {', '.join(f'''round(sum(value) FILTER (event_type = '{s}'), 2) AS {s}''' for s in _STAGES)} FROM events GROUP BY user_id")
def q_run_report(spark, sf):
    """K7: a row per request, a column per stage."""
    return sinks.run_report(table(spark, sf, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms")), _STAGES)


@case("SELECT p_partkey::VARCHAR AS id, p_brand AS code, p_name AS name, 'closed' AS status, p_partkey % 3 <> 1 AS is_active FROM part")
def q_project_list(spark, sf):
    """K8, K5: what a list of projects shows, without private columns."""
    p = F.col("p_partkey")
    projects = table(spark, sf, "part").select(p.alias("id"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"), F.lit("closed").alias("status"), F.when(p % 3 == 0, True).when(p % 3 == 1, False).alias("is_active"), F.lit("x").alias("_private"))
    return sinks.public_record(sinks.project_list(sinks.public_record(projects)))


@case("""
SELECT CASE o_orderkey % 4 WHEN 1 THEN o_orderkey || '.exe' WHEN 2 THEN '' END AS doc_id, CASE o_orderkey % 4 WHEN 1 THEN 'unsupported_file_type' ELSE 'missing_filename' END AS code FROM orders WHERE o_orderkey % 4 > 0""")
def q_rejected_uploads(spark, sf):
    """Uploads that aren't taken, and why."""
    return files.reject_uploads(orders(spark, sf).select(pick(4, cat(key(), ".pdf"), cat(key(), ".exe"), "", None).alias("path"))).select("doc_id", "code")


@case("SELECT l_orderkey AS doc_id, string_agg('phần ' || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber, 'phần ' || l_partkey) AS text FROM lineitem GROUP BY l_orderkey")
def q_ordered_text(spark, sf):
    """The parts of a document in the order of their pages."""
    return files.ordered_text(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("offset"), F.concat(F.lit("phần "), F.col("l_partkey").cast("string")).alias("text")))


@case("""
SELECT o_orderkey AS doc_id, 1::INT AS page, 'a' || o_orderkey AS text, 0.1::DOUBLE AS x, 0.1::DOUBLE AS y, 0.2::DOUBLE AS width, 0.1::DOUBLE AS height, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, 'LINE_BREAK' AS break_type FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 2, 'b', 0.25, 0.5, 0.5, 0.25, 0.8, NULL FROM orders WHERE o_orderkey % 3 > 0""")
def q_ocr_words(spark, sf):
    """An OCR answer's words with pages, boxes and confidences; one page with an error gives none."""
    word = cat(
        '{"fullTextAnnotation":{"pages":[{"width":100,"height":200,"blocks":[{"paragraphs":[{"words":[{', F.when(num() % 2 == 0, '"confidence":0.9,').otherwise(""), '"boundingBox":{"vertices":[{"x":10,"y":20},{"x":30,"y":20},{"x":30,"y":40},{"x":10,"y":40}]},"symbols":[{"text":"a","confidence":0.25},{"text":"',
        key(), '","confidence":0.75,"property":{"detectedBreak":{"type":"LINE_BREAK"}}}]}]}]}]}]}}',
    )
    second = '{"fullTextAnnotation":{"pages":[{"width":1,"height":1,"blocks":[{"paragraphs":[{"words":[{"confidence":0.8,"boundingBox":{"normalizedVertices":[{"x":0.25,"y":0.5},{"x":0.75,"y":0.75}]},"symbols":[{"text":"b"}]}]}]}]}]}}'
    failed = '{"error":{"message":"bad"}}'
    payload = cat('{"responses":[{"responses":[', F.when(num() % 3 > 0, word).otherwise(failed), ",", F.when(num() % 3 > 0, F.lit(second)).otherwise(failed), "]}]}")
    words = files.ocr_words(orders(spark, sf).select(num().alias("doc_id"), payload.alias("payload")))
    return words.select("doc_id", F.col("page").cast("int").alias("page"), "text", "x", "y", "width", "height", "confidence", "break_type")


@case("SELECT o_orderkey AS doc_id, 'page_error' AS code, 'bad ' || o_orderkey AS message FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'page_count_mismatch', '' FROM orders WHERE o_orderkey % 4 = 1")
def q_ocr_errors(spark, sf):
    """Answers with a page's error, or another number of pages than expected."""
    payload = F.when(num() % 4 == 0, cat('{"responses":[{"responses":[{},{"error":{"message":"bad ', key(), '"}}]}]}')).otherwise('{"responses":[{"responses":[{},{}]}]}')
    df = orders(spark, sf).select(num().alias("doc_id"), payload.alias("payload"), F.when(num() % 4 == 1, 3).otherwise(2).alias("expected"))
    return files.ocr_errors(df, expected="expected")


@case("""
SELECT o_orderkey AS doc_id, 1::INT AS page, ['line', 'paragraph', 'block'][o_orderkey % 3 + 1] AS type, ['dòng ', 'đoạn ', 'khối '][o_orderkey % 3 + 1] || o_orderkey AS text, substr('abc' || o_orderkey, 2, 2) || left('x' || o_orderkey, 1) AS anchored FROM orders""")
def q_choose_segments(spark, sf):
    """The finest kind of segments that a page has, and the slices that an anchor names."""
    none = F.array().cast("array<string>")
    of = lambda i, word: F.when(num() % 3 <= i, F.array(cat(word, key()), F.lit(" ")))
    pages = orders(spark, sf).select(num().alias("doc_id"), F.lit(1).alias("page"), F.coalesce(of(0, "dòng  "), none).alias("lines"), F.coalesce(of(1, " đoạn "), none).alias("paragraphs"), of(2, "khối ").alias("blocks"), none.alias("tokens"))
    anchor = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.length(F.concat(F.lit("abc"), F.col("doc_id"))).alias("start"), (F.length(F.concat(F.lit("abc"), F.col("doc_id"))) + 1).alias("end")))
    return files.choose_segments(pages).select("doc_id", "page", "type", "text", layout.anchored_text(F.concat(F.lit("abc"), F.col("doc_id"), F.lit("x")), anchor).alias("anchored"))


@case("SELECT * FROM (VALUES ('forms', 9, 'Hợp đồng trọn gói'), ('groups', 8, 'Nhà thầu chính')) t(kind, n, first)")
def q_taxonomies(spark, sf):
    """K10."""
    forms, groups = dims.taxonomies(spark)
    both = forms.withColumn("kind", F.lit("forms")).unionByName(groups.withColumn("kind", F.lit("groups")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min_by("name", "ord").alias("first"))


@case("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'b ' ELSE 'a ' END || o_orderkey AS text, o_orderkey % 3 = 0 AS fallback_used FROM orders WHERE o_orderkey % 6 <> 3")
def q_provider_fallback(spark, sf):
    """Documents that the first provider gives no text for go to the second, which lacks some."""
    docs = orders(spark, sf).select(num().alias("doc_id"))
    text = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    primary = lambda d: d.where("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 != 0, text("a ")).otherwise(" ").alias("text"))
    return metrics.served(docs, primary, lambda d: d.where("doc_id % 6 <> 3").select("doc_id", text("b ").alias("text")))


@case("""
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS deliveries FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0""")
def q_reclaimable(spark, sf):
    """Deliveries that nobody acknowledged for a minute; a second delivery is a new start."""
    o = orders(spark, sf)
    at = lambda t: F.lit(f"2024-01-01 00:{t}").cast("timestamp")
    one = o.select(num().alias("job_id"), F.when(num() % 5 == 0, at("01:31")).otherwise(at("01:30")).alias("delivered_at"))
    two = o.where("o_orderkey % 4 = 0").select(num().alias("job_id"), at("02:00").alias("delivered_at"))
    return metrics.reclaimable(one.unionByName(two), o.where("o_orderkey % 3 = 0").select(num().alias("job_id")), at("02:30")).select("job_id", "deliveries")


@case("""
WITH l AS (SELECT user_id, min(ts) + INTERVAL 1 DAY AS lo FROM events GROUP BY user_id), a AS (SELECT event_id, e.user_id, ts, date_diff('second', date_trunc('second', lo), date_trunc('second', ts)) AS age, ts >= lo AS behind FROM events e JOIN l ON e.user_id = l.user_id),
s AS (SELECT *, CASE WHEN NOT behind OR age > 172800 THEN 'miss' WHEN age <= 86400 THEN 'fresh' ELSE 'stale' END AS state FROM a)
SELECT event_id, state, state = 'miss' OR (state = 'stale' AND row_number() OVER (PARTITION BY user_id, state ORDER BY ts, event_id) = 1) AS refresh FROM s""")
def q_cache_lookups(spark, sf):
    """Requests of a day, two days and longer behind the load of their key's entry."""
    e = table(spark, sf, "events")
    entries = e.groupBy(F.col("user_id").alias("key")).agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("loaded_at"))
    asked = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request_id"))
    return metrics.cache_lookups(asked, entries, 86_400, 172_800).select(F.col("request_id").alias("event_id"), "state", "refresh")


@case("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 WHEN o_orderkey % 3 = 1 THEN 0.85 ELSE 0 END::DOUBLE AS mean_confidence FROM orders")
def q_mean_confidence(spark, sf):
    """Over the words that have a confidence."""
    words = pick(3, F.array(F.lit(0.25), F.lit(0.75), F.lit(0.0)), F.array(F.lit(0.9), F.lit(0.8)), F.array(F.lit(0.0)))
    return files.mean_confidence(orders(spark, sf).select(num().alias("doc_id"), F.explode(words).alias("confidence")))


@case("""
WITH f AS (SELECT o_orderkey AS doc_id, o_orderkey % 40 + 1 AS pages, o_orderkey % 5 AS kind FROM orders), p AS (SELECT doc_id, kind, pages, unnest(CASE WHEN kind < 2 AND pages > 14 THEN range(0, pages, 14) ELSE [0] END) AS o FROM f)
SELECT doc_id, string_agg(CASE WHEN kind < 2 THEN 'pdf ' || o || '+' || (CASE WHEN pages > 14 THEN least(14, pages - o) ELSE pages END) ELSE 'image ' || pages END, chr(10) || chr(10) ORDER BY o) AS text, NULL::VARCHAR AS code FROM p WHERE kind < 3 AND NOT (kind = 0 AND pages > 28) GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, CASE WHEN kind = 0 THEN 'part_failed' ELSE 'unsupported_media_type' END FROM f WHERE kind > 2 OR (kind = 0 AND pages > 28)""")
def q_dispatch(spark, sf):
    """Long PDFs in parts, images whole, other types refused, and documents of which a part failed."""
    kind = F.when(num() % 5 < 2, "application/pdf").when(num() % 5 == 2, "image/png").when(num() % 5 == 3, "text/html")
    uploads = orders(spark, sf).select(num().alias("doc_id"), kind.alias("media_type"), (num() % 40 + 1).cast("int").alias("pages"))
    pdf = lambda d: d.select("doc_id", "offset", F.when(~((F.col("doc_id") % 5 == 0) & (F.col("offset") == 28)), F.concat_ws("", F.lit("pdf "), "offset", F.lit("+"), "pages")).alias("text"))
    image = lambda d: d.select("doc_id", "offset", F.concat_ws("", F.lit("image "), "pages").alias("text"))
    texts, failures = files.dispatch(uploads, {"application/pdf": pdf, "image/": image})
    return texts.select("doc_id", "text", F.lit(None).cast("string").alias("code")).unionByName(failures.select("doc_id", F.lit(None).cast("string").alias("text"), "code"))


@case("""
SELECT o_orderkey AS doc_id, 'matched' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_orderkey END AS project, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 END::DOUBLE AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'step' END AS step, 0::INT AS warnings,
  '{"error":{"code":"c","message":"m","details":null,"request_id":"' || o_orderkey || '"}}' AS error FROM orders""")
def q_match_output(spark, sf):
    """K3, K9: what a match shows, and a failed row's envelope."""
    o = orders(spark, sf).select(num().alias("doc_id"), F.lit("matched").alias("status"), F.when(num() % 2 == 0, F.concat(F.lit("P"), key())).alias("project_id"), F.lit(0.9).alias("project_score"), F.when(num() % 3 == 0, "T").alias("task_id"), F.lit("step").alias("task_workflow_step_name"))
    errors = sinks.error_envelope(o.select("doc_id", F.lit("c").alias("code"), F.lit("m").alias("message"), F.col("doc_id").cast("string").alias("request_id")))
    m = sinks.match_output(o).join(errors, "doc_id")
    return m.select("doc_id", "match.status", F.col("match.project.id").alias("project"), F.col("match.project.score").alias("score"), F.col("match.task.workflow_step_name").alias("step"), F.size("match.warnings").alias("warnings"), "error")


@case("""
SELECT o_orderkey AS doc_id, 'type=document' || chr(10) || 'fields=title,issuer' || chr(10) || 'known={}' || chr(10) || 'text:' || chr(10) || 'T' || o_orderkey AS entity, 'project=P' || chr(10) || 'choose=task' || chr(10) || 'candidates=[{"id":"' || o_orderkey || '"}]' || chr(10) || 'text:' || chr(10) || 'S' AS task,
  'T' || o_orderkey AS prompt, 'be exact' AS system, '1536' AS most, 'object' AS kind FROM orders""")
def q_prompts(spark, sf):
    """J9, J10."""
    text = F.concat(F.lit("T"), key())
    payload = jsonops.request_payload(text, "be exact", {"type": "object"})
    df = T.once(orders(spark, sf), p=payload)
    get = lambda path: F.get_json_object("p", path)
    return df.select(
        num().alias("doc_id"), jsonops.entity_prompt("document", text, F.lit("{}"), F.array(F.lit("title"), F.lit("issuer"))).alias("entity"), jsonops.task_prompt(F.lit("S"), F.array(F.struct(key().alias("id"))), F.lit("P")).alias("task"),
        get("$.contents[0].parts[0].text").alias("prompt"), get("$.systemInstruction.parts[0].text").alias("system"), get("$.generationConfig.maxOutputTokens").alias("most"), get("$.generationConfig.responseSchema.type").alias("kind"),
    )


def numbered_page(page: int, size: int) -> tuple[list[dict], int]:
    """A page of a catalogue of 250 numbered items, and its total."""
    return [{"id": i, "name": f"dự án {i}"} for i in range((page - 1) * size, min(page * size, 250))], 250


@case("SELECT (i // 40 + 1)::INT AS page, (i % 40)::INT AS pos, i AS id, 'dự án ' || i AS name FROM range(250) t(i)")
def q_paged_catalogue(spark, sf):
    """A paged catalogue, a task per page."""
    spark.dataSource.register(files.PagedCatalogue)
    items = spark.read.format("paged_catalogue").option("fetch", "docweave.plans.cases:numbered_page").option("page_size", "40").load()
    return items.select("page", "pos", F.from_json("item", "id bigint, name string").alias("i")).select("page", "pos", "i.*")
