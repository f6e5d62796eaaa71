"""Taxonomies and abbreviations, in small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What abbreviations of construction documents stand for.
ABBREVIATIONS = {
    "BC KTKT": "Báo cáo kinh tế kỹ thuật",
    "ANTT": "An ninh trật tự",
    "ATGT": "An toàn giao thông",
    "BQLDA": "Ban quản lý dự án",
    "BCNCTKT": "Báo cáo nghiên cứu tiền khả thi",
    "BCNCKT": "Báo cáo nghiên cứu khả thi",
    "BC ĐTM": "Báo cáo đánh giá tác động môi trường",
    "BCKT-KT": "Báo cáo Kinh tế - Kỹ thuật",
    "BCTĐ": "Báo cáo thẩm định",
    "BT,HT&TĐC": "Bồi thường, Hỗ trợ và Tái định cư",
    "BVMT": "Bảo vệ môi trường",
    "BVTC": "Bản vẽ thi công",
    "BB": "Biên bản",
    "BBMT": "Biên bản mở thầu",
    "CHCC": "Căn hộ chung cư",
    "CSPCCC": "Cảnh sát phòng cháy, chữa cháy",
    "CLCT": "Chất lượng công trình",
    "CTrĐT": "Chủ trương đầu tư",
    "CĐT": "Chủ đầu tư",
    "CBĐT": "Chuẩn bị đầu tư",
    "CBDA": "Chuẩn bị dự án",
    "CA": "Công An",
    "CT": "Công trình",
    "CTXD": "Công trình xây dựng",
    "CQ": "Cơ quan",
    "CHCN": "Cứu hộ, cứu nạn",
    "DSXH": "Danh sách xếp hạng",
    "DSNT": "Danh sách nhà thầu",
    "DVC": "Dịch vụ công",
    "DN": "Doanh nghiệp",
    "DA": "Dự án",
    "DT": "Dự toán",
    "DTCT": "Dự toán công trình",
    "ĐGHSDT": "Đánh giá hồ sơ dự thầu",
    "ĐTM": "Đánh giá tác động môi trường",
    "ĐTKQM": "Đấu thầu không qua mạng",
    "ĐTQM": "Đấu thầu qua mạng",
    "ĐTTN": "Đấu thầu trong nước",
    "ĐTQG": "Đấu thầu quốc gia",
    "ĐTQT": "Đấu thầu quốc tế",
    "ĐTC": "Đầu tư công",
    "ĐTXD": "Đầu tư xây dựng",
    "ĐVTV": "Đơn vị tư vấn",
    "GSĐG": "Giám sát, đánh giá",
    "GPMB": "Giải phóng mặt bằng",
    "HTKT": "Hạ tầng kỹ thuật",
    "HMCT": "Hạng mục công trình",
    "HTGT": "Hệ thống giao thông",
    "HTM": "Hệ thống mạng",
    "HSYC": "Hồ sơ yêu cầu",
    "KH LCNT": "Kế hoạch lựa chọn nhà thầu",
    "VPĐD": "Văn phòng đại diện",
    "LCNT": "Lựa chọn nhà thầu",
    "ĐHDA": "Điều hành dự án",
    "TMB": "Tổng mặt bằng",
    "HSMT": "Hồ sơ mời thầu",
    "HSMST": "Hồ sơ mời sơ tuyển",
    "HSDST": "Hồ sơ dự sơ tuyển",
    "HSĐX": "Hồ sơ đề xuất",
    "HSDT": "Hồ sơ dự thầu",
    "HSTK": "Hồ sơ thiết kế",
    "HĐ": "Hợp đồng",
    "HĐND": "Hội đồng nhân dân",
    "HĐTĐ": "Hội đồng thẩm định",
    "KH": "Kế hoạch",
    "KH&ĐT": "Kế hoạch và Đầu tư",
    "KHLCNT": "Kế hoạch lựa chọn nhà thầu",
    "KQTĐ": "Kết quả thẩm định",
    "KQCĐT": "Kết quả chỉ định thầu",
    "KSĐĐ": "Khảo sát, đo đạc",
    "KSTK": "Khảo sát, thiết kế",
    "KSXD": "Khảo sát xây dựng",
    "KBNN": "Kho bạc nhà nước",
    "KT-KT": "Kinh tế - kỹ thuật",
    "L/V": "Làm việc",
    "l/v": "Làm việc",
    "NLKN": "Năng lực kinh nghiệm",
    "NSNN": "Ngân sách nhà nước",
    "PA": "Phương án",
    "QTQG": "Quan trọng quốc gia",
    "QLCT": "Quản lý chất lượng",
    "QLDA": "Quản lý dự án",
    "QLĐT": "Quản lý đô thị",
    "QLNN": "Quản lý nhà nước",
    "QLSD": "Quản lý sử dụng",
    "QP": "Quốc phòng",
    "QPAN": "Quốc phòng an ninh",
    "QH": "Quy hoạch",
    "QHKT": "Quy hoạch Kiến trúc",
    "QT": "Quyết toán",
    "SXD": "Sở Xây dựng",
    "TĐC": "Tái định cư",
    "TC": "Tài chính",
    "TC-KH": "Tài chính - Kế hoạch",
    "TK": "Tài khoản",
    "TN&MT": "Tài nguyên và Môi trường",
    "TS": "Tài sản",
    "TSC": "Tài sản công",
    "TLTS": "Thanh lý tài sản",
    "TLTSC": "Thanh lý tài sản công",
    "TT": "Thanh toán",
    "TKCS": "Thiết kế cơ sở",
    "TKDT": "Thiết kế dự toán",
    "TKXD": "Thiết kế xây dựng",
    "TB": "Thông báo",
    "TBMT": "Thông báo mời thầu",
    "THDA": "Thực hiện dự án",
    "TMĐT": "Tổng mức đầu tư",
    "TVTK": "Tư vấn thiết kế",
    "UBND": "Ủy ban nhân dân",
    "UBMTTQ": "Ủy ban Mặt trận Tổ quốc",
    "UQ": "Ủy quyền",
    "XDCT": "Xây dựng công trình",
    "YCKT": "Yêu cầu kỹ thuật",
    "VĐT": "Vốn đầu tư",
    "PCCC": "Phòng cháy chữa cháy",
    "CNTT": "Công nghệ thông tin",
    "KCN": "Khu công nghiệp",
    "TNHH": "Trách nhiệm hữu hạn",
    "MTV": "Một thành viên",
    "KV": "Khu vực",
    "CN": "Chi nhánh",
    "CP": "Cổ phần",
    "TP": "Thành phố",
}
CONTRACT_FORMS = [
    "Hợp đồng trọn gói", "Hợp đồng theo đơn giá cố định", "Hợp đồng theo đơn giá điều chỉnh", "Hợp đồng theo thời gian", "Hợp đồng theo chi phí cộng phí",
    "Hợp đồng theo tỷ lệ phần trăm", "Hợp đồng hỗn hợp", "Hợp đồng EPC", "Hợp đồng chìa khóa trao tay",
]
CONTRACTOR_GROUPS = [
    "Nhà thầu chính", "Nhà thầu phụ", "Liên danh nhà thầu", "Nhà thầu độc lập", "Tổng thầu", "Nhà thầu tư vấn", "Nhà thầu thi công xây lắp", "Nhà thầu cung cấp hàng hóa/thiết bị",
]


def taxonomies(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The contract forms and the contractor groups as tables (ord, name)."""
    of = lambda names: spark.createDataFrame(list(enumerate(names)), "ord int, name string")
    return of(CONTRACT_FORMS), of(CONTRACTOR_GROUPS)
