"""Fields of documents: inputs and expected values in tables, run together."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import cleaning, extract, merge
from docweave.operators.jsonops import recover_json, response_text

HEAD = "NGÂN HÀNG NÔNG NGHIỆP\n"
#: name: (text, {column: expected value, or amount, or norm, or None}).
DOCUMENTS = {
    "proposal": (
        "\nCÔNG TY CP ĐẦU TƯ PHÁT TRIỂN SƠN LA\nCHI NHÁNH TỈNH SƠN LA\nSố: 12/TTr-SL\nSơn La, ngày 15 tháng 05 năm 2026\n\nTỜ TRÌNH\nVề việc phê duyệt chủ trương đầu tư dự án: Trụ sở Công ty CP Đầu tư Phát triển Sơn La chi nhánh tỉnh Sơn La\n\n"
        "Giá trị trình: 24.500.000.000 đồng\nGiá trị phê duyệt: 24.000.000.000 đồng\nGhi chú: Hồ sơ kèm theo bản vẽ và dự toán chi tiết.\n",
        {"intent": "to_trinh", "document_number.value": "12/TTr-SL", "signed_or_effective_date.norm": "2026-05-15", "approved_value": None, "submitted_value.amount": 24.5e9, "issuer.value": "CÔNG TY CP ĐẦU TƯ PHÁT TRIỂN SƠN LA CHI NHÁNH TỈNH SƠN LA"},
    ),
    "package": (
        "BAN QUẢN LÝ DỰ ÁN ĐẦU TƯ XÂY DỰNG\nSố: 03/TTr-BQLDA\nHà Nội, ngày 02 tháng 01 năm 2026\nTỜ TRÌNH\nVề việc phê duyệt kế hoạch lựa chọn nhà thầu gói thầu thi công xây dựng dự án: Trụ sở chi nhánh A\nGiá gói thầu: 12.345.000.000 đồng\nGiá trị trình duyệt: 12.500.000.000 đồng\n",
        {"approved_value": None, "submitted_value.amount": 12.5e9},
    ),
    "commas": (
        HEAD + "VÀ PHÁT TRIỂN NÔNG THÔN VIỆT NAM\nSố: 981/TTr-QLXD-QLKT\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nHanoi, Ngày 21, tháng 10, năm 2022\nTỜ TRÌNH\nVề việc thẩm định Báo cáo nghiên cứu khả thi công trình Trụ sở\n"
        "Quyết định số 873/QĐ-HĐTV-QLĐT ngày 31/12/2020 của Hội đồng thành viên về thành lập Ban quản lý dự án;\nTổng giá trị: 12.345.000.000 đồng\n",
        {"intent": "to_trinh", "signed_or_effective_date.value": "21/10/2022", "signed_or_effective_date.norm": "2022-10-21", "submitted_value.amount": 12.345e9, "approved_value": None},
    ),
    "request": (
        HEAD + "Số: 15/CV-QLXD\nHà Nội, ngày 03 tháng 02 năm 2026\nCÔNG VĂN\nVề việc đề nghị chấp thuận tổng mức đầu tư công trình Trụ sở\nTổng mức đầu tư: 18.000.000.000 đồng\n",
        {"intent": "van_ban_de_nghi", "approved_value": None, "submitted_value.amount": 18e9},
    ),
    "decision": (
        HEAD + "Số: 22/QĐ-NHNo-QLĐT\nHà Nội, ngày 04 tháng 02 năm 2026\nQUYẾT ĐỊNH\nVề việc phê duyệt Báo cáo kinh tế kỹ thuật công trình Trụ sở\nTổng mức đầu tư: 18.000.000.000 đồng\n",
        {"intent": "quyet_dinh", "approved_value.amount": 18e9, "submitted_value": None},
    ),
    "comment": ("SỞ XÂY DỰNG\nSố: 09/SXD-QLXD\nHà Nội, ngày 05 tháng 02 năm 2026\nCÔNG VĂN\nVề việc tham gia ý kiến về hồ sơ dự án Trụ sở\nTổng mức đầu tư: 18.000.000.000 đồng\n", {"intent": "tham_gia_y_kien", "approved_value": None, "submitted_value": None}),
    "receipt": ("SỞ XÂY DỰNG\nSố: 02/PT-SXD\nHà Nội, ngày 06 tháng 02 năm 2026\nPHIẾU THU\nVề việc thu phí thẩm định hồ sơ\nSố tiền: 3.000.000 đồng\n", {"intent": "phieu_thu", "approved_value": None, "submitted_value": None}),
    "contract": (
        "HỢP ĐỒNG THI CÔNG XÂY DỰNG\nSố: 01/2026/HĐ-XD\nHà Nội, ngày 07 tháng 02 năm 2026\nBên A: Ban quản lý dự án đầu tư xây dựng\nBên B: CÔNG TY TNHH XÂY DỰNG ABC\nĐiều 5. Giá trị hợp đồng: 1.200.000.000 đồng.\n",
        {"intent": "contract", "approved_value.amount": 1.2e9, "submitted_value": None},
    ),
    "dotted": (
        HEAD + "Số: 5.7.7.1. /NHNo-QLĐT\nHà Nội, ngày 04 tháng 06 năm 2026\nCÔNG VĂN\nVề việc chấp thuận phương án kiến trúc công trình Trụ sở Trấn Yên, Yên Bái\nTổng mức đầu tư: 26 tỷ đồng.\n",
        {"document_number.value": "5771/NHNo-QLĐT", "approved_value.value": "26 tỷ", "approved_value.amount": 26e9},
    ),
    "month dots": (HEAD + "Số: 5771/NHNo-QLĐT\nHà Nội, ngày 29 tháng 6.. năm 2021\nVề chấp thuận phương án thiết kế kiến trúc công trình\nCăn cứ Quyết định số 873/QĐ-HĐTV-QLĐT ngày 31/12/2020 của Hội đồng;\n", {"signed_or_effective_date.value": "29/06/2021"}),
    "requested total": ("Số: 01/TTr-BQLDA\nHà Nội, ngày 04 tháng 06 năm 2026\nTỜ TRÌNH\nVề việc trình phê duyệt chủ trương đầu tư\nTổng mức đầu tư đề nghị: 26 tỷ đồng.\n", {"approved_value": None, "submitted_value.amount": 26e9}),
    "table": (
        "Số: 5771/NHNo-QLĐT\nHà Nội, ngày 29 tháng 6 năm 2021\nCÔNG VĂN\nVề chấp thuận phương án thiết kế kiến trúc công trình Trụ sở huyện Trấn Yên\nd. Phương án thiết kế, dự kiến tổng mức đầu tư theo các bảng thống kê sau:\nBảng 3. Tổng mức đầu tư xây dựng (dự kiến):\n"
        "Tầng 1,2,3\nm2\n1.261\n8.500.000 10.718.500.000\nIV Chi phí dự phòng (Gdp)\n2.067.165.000\nTỔNG MỨC ĐẦU TƯ\nGxd+Gtb+Gk+Gdp\n26.000.000.000\n",
        {"approved_value.value": "26.000.000.000", "approved_value.amount": 26e9},
    ),
    "registration": (
        "SỞ KẾ HOẠCH VÀ ĐẦU TƯ THÀNH PHỐ HÀ NỘI\nPHÒNG ĐĂNG KÝ KINH DOANH\nGIẤY CHỨNG NHẬN ĐĂNG KÝ DOANH NGHIỆP\nCÔNG TY CỔ PHẦN\nMã số doanh nghiệp: 0101234567\nĐăng ký lần đầu: ngày 10 tháng 02 năm 2012\nĐăng ký thay đổi lần thứ: 6, ngày 15 tháng 03 năm 2019\nĐăng ký thay đổi lần thứ: 7, ngày 21 tháng 08 năm 2023\n",
        {"document_number": None, "signed_or_effective_date.value": "21/08/2023", "signed_or_effective_date.confidence": 0.96},
    ),
    "report": ("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nBÁO CÁO KHẢO SÁT ĐỊA CHẤT\nCông trình: Trụ sở\nCăn cứ Quyết định số 12/QĐ-ABC ngày 04/05/2020\n", {"signed_or_effective_date": None, "issuer": None}),
    "certificate": (
        "BỘ XÂY DỰNG\nCỤC QUẢN LÝ HOẠT ĐỘNG XÂY DỰNG\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nCHỨNG CHỈ NĂNG LỰC HOẠT ĐỘNG XÂY DỰNG\nCÔNG TY CỔ PHẦN CONTECH\nNơi cấp: Thành phố Hà Nội\n",
        {"issuer.value": "BỘ XÂY DỰNG CỤC QUẢN LÝ HOẠT ĐỘNG XÂY DỰNG"},
    ),
    "issuer lines": (
        HEAD + "và Phát triển Nông thôn Việt Nam\nCHI NHÁNH TỈNH YÊN BÁI\nSố: 676/NHNo.YB-TH\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nYên Bái, ngày 15 tháng 05 năm 2025\nCÔNG VĂN\nV/v tham gia ý kiến phương án thiết kế cơ sở\n",
        {"issuer.value": "NGÂN HÀNG NÔNG NGHIỆP và Phát triển Nông thôn Việt Nam CHI NHÁNH TỈNH YÊN BÁI", "issuer.evidence": "NGÂN HÀNG NÔNG NGHIỆP\nvà Phát triển Nông thôn Việt Nam\nCHI NHÁNH TỈNH YÊN BÁI"},
    ),
    "total row": (
        "BAN QUẢN LÝ DỰ ÁN\nSố: 22/QĐ-BQLDA\nHà Nội, ngày 04 tháng 02 năm 2026\nQUYẾT ĐỊNH\nVề việc phê duyệt dự toán công trình\nChi phí xây dựng: 8.500.000.000 đồng\nChi phí thiết bị: 1.500.000.000 đồng\nTỔNG CỘNG\n10.750.000.000 đồng\n",
        {"approved_value.amount": 10.75e9},
    ),
    "nothing": ("Không có header rõ ràng", {"intent": "unknown", "document_number": None, "issuer": None, "title": None}),
    "null": (None, {"intent": "unknown", "document_number": None, "approved_value": None}),
}


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.createDataFrame([(k, v[0], 1) for k, v in DOCUMENTS.items()], "doc_id string, text string, __raw int")
    wide = extract.document_fields(cleaning.clean_documents(docs.drop("__raw")))
    return {r.doc_id: r for r in wide.collect()}


@pytest.mark.parametrize("name", DOCUMENTS)
def test_document_fields(documents, name):
    row = documents[name]
    for path, want in DOCUMENTS[name][1].items():
        got = row
        for part in path.split("."):
            got = None if got is None else got[part]
        assert got == want, f"{path}: {got}"


def test_evidence_names_the_label(documents):
    assert "TỔNG MỨC ĐẦU TƯ" in documents["table"].approved_value.evidence
    assert "TỔNG CỘNG" in documents["total row"].approved_value.evidence
    assert "31/12/2020" not in documents["commas"].signed_or_effective_date.evidence


CONTRACT = """
HỢP ĐỒNG TƯ VẤN THIẾT KẾ BẢN VẼ THI CÔNG, LẬP DỰ TOÁN CÔNG TRÌNH
Số: 01/2018/HĐ-TVVTK
Hôm nay, ngày 05 tháng 04 năm 2018, các bên gồm:
Bên A: Ban quản lý dự án đầu tư xây dựng
Bên B: CÔNG TY TNHH TƯ VẤN XÂY DỰNG ABC
Điều 3. Thời gian và tiến độ thực hiện hợp đồng: 45 ngày kể từ ngày hợp đồng có hiệu lực.
Điều 4. Loại hợp đồng: Hợp đồng trọn gói.
Điều 5. Giá hợp đồng: 1.200.000.000 đồng, đã bao gồm thuế VAT 10%.
Giá gói thầu: 1.300.000.000 đồng.
Bảo lãnh thực hiện hợp đồng: 120.000.000 đồng, có hiệu lực đến ngày 30/06/2018.
Bảo lãnh tiền tạm ứng: 200.000.000 đồng, hiệu lực đến ngày 31/07/2018.
"""


def test_contract_fields(spark):
    docs = spark.createDataFrame([(1, CONTRACT), (2, None)], "doc_id int, text string")
    r, empty = extract.contract_fields(cleaning.clean_documents(docs)).orderBy("doc_id").collect()
    assert r.contract_name.value.startswith("HỢP ĐỒNG TƯ VẤN") and r.work_name.value.startswith("TƯ VẤN THIẾT KẾ")
    want = {
        "contract_number.value": "01/2018/HĐ-TVVTK", "signed_date.norm": "2018-04-05", "execution_duration_days.amount": 45, "contract_form.value": "Hợp đồng trọn gói", "contract_value.amount": 1.2e9, "estimated_value.amount": 1.3e9,
        "contract_vat_percent.amount": 10, "contractor_name.value": "CÔNG TY TNHH TƯ VẤN XÂY DỰNG ABC", "contractor_contract_amount.amount": 1.2e9, "performance_guarantee_value.amount": 1.2e8, "performance_guarantee_end_date.norm": "2018-06-30",
        "advance_guarantee_value.amount": 2e8, "advance_guarantee_end_date.norm": "2018-07-31",
    }
    for path, value in want.items():
        key, part = path.split(".")
        assert r[key][part] == value, path
    assert all(empty[k] is None for k in extract.CONTRACT_FIELDS)


NOISY = """
NGÂN HÀNG NÔNG NGHIỆP
VÀ PHÁT TRIỂN NÔNG THÔN VIỆT NAM
Số: 784/QĐ-NHNo-QLĐT
CÔNG VĂN ĐẾN
Số 193
CỘNG HOÀ XÃ HỘI CHỦ NGHĨA VIỆT NAM
Độc lập - Tự do - Hạnh phúc
Hà Nội, ngày 04 tháng 5 năm 2018.
QUYẾT ĐỊNH
Ngày 7 tháng 5 năm 2018 Về thành lập Ban điều hành dự án đầu tư xây dựng
Công trình: Trụ sở chi nhánh huyện Đan Phượng, Hà Tây.
WS.D.N: 01006861
hướng dẫn một số điều của Nghị định số 59/2015/NĐ-CP của Chính phủ về hình Q. BA ĐÌNH
7. Thực hiện các nhiệm vụ khác do Chủ đầu tư giao. Q
1
"""


def test_stamps_and_seals_go(spark):
    docs = spark.createDataFrame([(1, NOISY)], "doc_id int, text string")
    r = cleaning.cleaning_report(cleaning.clean_documents(docs)).first()
    for gone in ("CÔNG VĂN ĐẾN", "Số 193", "Ngày 7 tháng 5 năm 2018", "WS.D.N", "Q. BA ĐÌNH", "giao. Q", "\n1\n"):
        assert gone not in r.clean_text + "\n"
    for kept in ("Số: 784/QĐ-NHNo-QLĐT", "Hà Nội, ngày 04 tháng 5 năm 2018.", "QUYẾT ĐỊNH", "Về thành lập Ban điều hành dự án đầu tư xây dựng"):
        assert kept in r.clean_text
    assert r.removed_line_count >= 4 and r.rewritten_line_count >= 2


def test_segments_of_a_stamped_page(spark):
    rows = [("s1", "Số: 784/QĐ-NHNo-QLĐT", 0.12), ("s2", "CÔNG VĂN ĐẾN", 0.11), ("s3", "Số 193", 0.14), ("s4", "WS.D.N: 01006861", 0.42), ("s5", "Ngày 7 tháng 5 năm 2018 Về thành lập Ban điều hành dự án", 0.24)]
    got = cleaning.clean_segments(spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id int, page int, seg_id string, text string, y double")).orderBy("seg_id").collect()
    assert [r.seg_id for r in got if r.reason is None] == ["s1", "s5"]
    assert got[4].clean_text == "Về thành lập Ban điều hành dự án"


def test_a_payload_cannot_override_the_layout(spark):
    docs = spark.createDataFrame([("r", DOCUMENTS["registration"][0]), ("t", DOCUMENTS["total row"][0]), ("i", DOCUMENTS["issuer lines"][0])], "doc_id string, text string")
    payload = [
        ("r", "document_number", "0101234567", None, "Mã số doanh nghiệp: 0101234567", 0.99), ("r", "signed_or_effective_date", "10/02/2012", None, "Đăng ký lần đầu", 0.99), ("t", "approved_value", "8.500.000.000 đồng", None, "Chi phí xây dựng", 0.99),
        ("i", "issuer", "NGÂN HÀNG NÔNG NGHIỆP", None, "NGÂN HÀNG NÔNG NGHIỆP", 0.99),
    ]
    given = spark.createDataFrame([(*p[:4], None, *p[4:], "llm") for p in payload], "doc_id string, field_key string, value string, norm string, amount double, evidence string, confidence double, source string")
    out = {r.doc_id: r.fields for r in merge.extract_information(docs, mode="always", provider=lambda routed: given).collect()}
    assert "document_number" not in out["r"] and out["r"]["signed_or_effective_date"].value == "21/08/2023"
    assert out["t"]["approved_value"].norm == "10750000000" and out["t"]["approved_value"].source == "rule"
    assert out["i"]["issuer"].value.endswith("YÊN BÁI")


def test_without_a_provider_rules_stand(spark):
    docs = spark.createDataFrame([("p", DOCUMENTS["proposal"][0])], "doc_id string, text string")
    r = merge.extract_information(docs).first()
    assert r.local_confidence >= 0.8 and not r.needs_review and r.provider == "unavailable" and r.document_intent == "to_trinh"


def test_filename_hint(spark):
    number = F.struct(F.lit("571/NHNo-QLĐT").alias("value"), F.lit("571/NHNo-QLĐT").alias("norm"), F.lit(None).cast("double").alias("amount"), F.lit("e").alias("evidence"), F.lit(0.86).alias("confidence"))
    rows = spark.createDataFrame([("5771.NHNo-QLDT Ve chap thuan.pdf",), ("9.pdf",), (None,)], "filename string").withColumn("document_number", number)
    got = extract.with_filename_hint(rows).collect()
    assert [r.document_number.value for r in got] == ["5771/NHNo-QLĐT", "571/NHNo-QLĐT", "571/NHNo-QLĐT"]
    assert "5771/NHNo-QLĐT" in got[0].number_note


@pytest.mark.parametrize(("text", "want"), [('```json\n{"a": 1}\n```', '{"a":1}'), ('so: {"a":{"b":2}} end', '{"a":{"b":2}}'), ("[1, 2]", "{}"), ("none", "{}"), (None, "{}"), ("{bad", "{}")])
def test_json_is_recovered(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(recover_json(F.col("t")).alias("j")).first().j == want


def test_answer_parts_are_joined(spark):
    raw = '{"candidates":[{"content":{"parts":[{"text":"```json\\n{\\"title\\":"},{"text":"\\"X\\"}\\n```"}]}}]}'
    assert spark.createDataFrame([(raw,)], "t string").select(response_text(F.col("t")).alias("j")).first().j == '{"title":"X"}'
