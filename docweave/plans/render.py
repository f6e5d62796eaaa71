"""Documents of the kind the engine reads, rendered from tables: what they say is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a small input has fewer splits than those; larger inputs aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def worded(day: Column) -> Column:
    return F.concat(F.lit("ngày "), F.date_format(day, "dd"), F.lit(" tháng "), F.date_format(day, "MM"), F.lit(" năm "), F.date_format(day, "yyyy"))


def orders_as_documents(orders: DataFrame, decoys: bool = True) -> DataFrame:
    """doc_id, text: a proposal, decision or receipt per order, by its status; decoys by its key."""
    key, kind = F.col("o_orderkey"), F.col("o_orderstatus")
    every = lambda k, line: F.when((key % k == 0) & F.lit(decoys), line)
    by = lambda o, f, p: F.when(kind == "O", o).when(kind == "F", f).otherwise(p)
    amount = F.concat(thousands(F.floor("o_totalprice")), F.lit(" đồng"))
    unit = F.when((key % 7 == 0) & F.lit(decoys), " (1.000 đồng)").otherwise("")
    lines = [
        every(3, F.lit("CÔNG VĂN ĐẾN\nSố 193\nNgày 7 tháng 5 năm 2018")),
        F.lit("BAN QUẢN LÝ DỰ ÁN\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc"),
        F.concat(F.lit("Số: "), key.cast("string"), F.when((key % 5 == 0) & F.lit(decoys), " /").otherwise("/"), by(F.lit("TTr"), F.lit("QĐ"), F.lit("BL")), F.lit("-BQLDA")),
        F.concat(F.lit("Hà Nội, "), worded(F.col("o_orderdate"))),
        by(F.lit("TỜ TRÌNH"), F.lit("QUYẾT ĐỊNH"), F.lit("BIÊN LAI")),
        F.concat(F.lit("Về việc phê duyệt dự án: Khu nhà số "), F.col("o_custkey").cast("string")),
        every(4, F.lit("Căn cứ Luật số 43 ngày 26 tháng 11 năm 2030")),
        F.concat(by(F.lit("Giá trị trình"), F.lit("Giá trị phê duyệt"), F.lit("Số tiền")), unit, F.lit(": "), amount),
        every(2, F.concat(F.lit("Ghi chú: chưa bao gồm phí "), key.cast("string"))),
    ]
    return orders.select(key.alias("doc_id"), kind.alias("kind"), F.concat_ws("\n", *lines).alias("text"))


def contracts_as_documents(lineitem: DataFrame) -> DataFrame:
    """doc_id, text: a contract per order's lines; days, value, tax and dates are aggregates of them."""
    # dealt by order once, for the sums and for the costly work on texts behind them
    spark = lineitem.sparkSession
    lineitem = lineitem.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")
    total = F.sum(F.floor("l_extendedprice").cast("long"))
    rows = lineitem.groupBy("l_orderkey").agg(total.alias("total"), F.round(F.max("l_tax") * 100).cast("int").alias("vat"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("signed"), F.max("l_shipdate").alias("until"), F.min("l_suppkey").alias("supplier"))
    key = F.col("l_orderkey").cast("string")
    return rows.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat_ws(
            "\n", F.concat(F.lit("HỢP ĐỒNG TƯ VẤN CÔNG TRÌNH "), key), F.concat(F.lit("Số: "), key, F.lit("/HĐ-TV")), F.concat(F.lit("Hôm nay, "), worded(F.col("signed"))),
            F.concat(F.lit("Bên B: Công ty số hiệu "), F.col("supplier").cast("string")), F.concat(F.lit("Thời gian thực hiện hợp đồng: "), (F.col("n") * 30).cast("string"), F.lit(" ngày")),
            F.concat(F.lit("Giá trị hợp đồng: "), thousands(F.col("total")), F.lit(" đồng")), F.concat(F.lit("Thuế VAT: "), F.col("vat").cast("string"), F.lit("%")),
            F.concat(F.lit("Bảo lãnh thực hiện hợp đồng: "), thousands(F.col("total") + 1000000), F.lit(" đồng đến ngày "), F.date_format("until", "dd/MM/yyyy")),
        ).alias("text"),
    )


def customers_as_segments(customer: DataFrame) -> DataFrame:
    """Segments: a document per nation, twenty lines a page, three columns of indents."""
    from pyspark.sql import Window

    ord_ = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int")
    df = customer.select(F.col("c_nationkey").alias("doc_id"), ord_.alias("ord"), "c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("text"))
    page, line = F.floor(F.col("ord") / 20).cast("int") + 1, F.col("ord") % 20
    return df.select(
        "doc_id", page.alias("page"), "ord", F.concat(F.lit("s"), F.col("ord")).alias("seg_id"), "text", (0.1 + 0.1 * (F.col("c_custkey") % 3)).alias("x"), (0.045 * line).alias("y"), F.lit(0.3).alias("width"), F.lit(0.03).alias("height")
    )
