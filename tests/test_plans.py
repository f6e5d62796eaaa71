"""What the queries of single fields compute and how it is spread: plans, and results that depend on it."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docweave.functions import text as T
from docweave.operators import classify as C
from docweave.operators import extract


def generated(df):
    """The columns behind generators, which Spark makes even if nobody reads them."""
    return set(re.findall(r"\[(\w+)#\d+\]", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize(("name", "unread"), [("q_title_kind", {"norm", "sample", "context"}), ("q_signed_date", {"norm", "sample", "context"}), ("q_signed_date_branches", {"norm", "sample", "context"}), ("q_latest_date", {"lines", "norm", "sample", "context"})])
def test_queries_make_no_columns_that_they_leave_unread(spark, sf, name, unread):
    made = generated(__spark_entry__.queries()[name](spark, sf))
    assert "body" in made and not made & unread


def test_fallback_text_runs_on_all_cores(spark, sf):
    df = __spark_entry__.queries()["q_fallback_text"](spark, sf)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_unique_values_makes_each_normal_form_once(spark):
    values = ["Dự án 1", "dự  án 1", "", " ", "B", "du an 1", None, "b", "A"]
    df = spark.createDataFrame([(values,), ([],)], "v array<string>").select(T.unique_values(F.col("v")).alias("u"))
    assert [r.u for r in df.collect()] == [["Dự án 1", "B", "A"], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_latest_date_shows_its_own_line(spark):
    text = "Dòng đầu\nngày 05 tháng 06 năm 2019 tại Hà Nội\nngày 01 tháng 01 năm 2018"
    df = T.once(C.with_lines(spark.createDataFrame([(text,)], "text string"), "text"), f=extract.latest_date())
    assert df.select("f.norm", "f.evidence").first() == ("2019-06-05", "ngày 05 tháng 06 năm 2019 tại Hà Nội")


def test_normal_forms_of_odd_characters(spark):
    texts = ["  A\tB  ", "x y z", "Đ́ỒNG %(1)", "\U0001f600 mặt —   a", "a_b\x7f", "İIK", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(T.normalize_rules(F.col("s"))).collect()] == ["a b", "x y z", "dong %(1)", "mat a", "a_b", "iik", ""]
    assert [r[0] for r in df.select(T.collapse(F.col("s"))).collect()] == ["A B", "x y z", "Đ́ỒNG %(1)", "\U0001f600 mặt — a", "a_b\x7f", "İIK", ""]


def test_repeated_amounts_and_dates_are_listed_as_often_as_they_stand(spark, tmp_path):
    rows = [(7, 1, "O", 1000.5, "1995-01-01"), (28, 2, "F", 1000.0, "2030-11-26"), (14, 3, "P", 1000.0, "1995-01-01"), (21, 4, "O", 999.0, "1995-01-01")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string").withColumn("o_orderdate", F.to_timestamp("d"))
    orders.drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.doc_id: (r.dates, r.amounts) for r in __spark_entry__.queries()["q_generic_fields"](spark, str(tmp_path)).collect()}
    day = "ngày 26 tháng 11 năm 2030"
    assert got == {7: ("ngày 01 tháng 01 năm 1995", "1.000 đồng|1.000 đồng"), 28: (f"{day}|{day}", "1.000 đồng|1.000 đồng"), 21: ("ngày 01 tháng 01 năm 1995", "1.000 đồng")}


def test_generic_fields_are_distinct_by_default(spark):
    df = C.with_lines(spark.createDataFrame([("1.000 đồng, 1.000 đồng; 3/4/2015 và 3/4/2015",)], "text string"), "text")
    g = T.once(df, g=extract.generic_fields()).select("g.monetary_amounts", "g.dates").first()
    assert g == (["1.000 đồng"], ["3/4/2015"])
