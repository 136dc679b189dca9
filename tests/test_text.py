from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T


def value(spark, column, **inputs):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "number"),
    [("12", True), ("12345", False), ("- 7 -", True), ("第 9 页", True), ("page 3", True), ("P.4", True), ("2 / 10", True), ("xiv", True), ("mild", True), ("Hello", False), ("", False)],
)
def test_page_number(spark, line, number):
    assert value(spark, T.is_page_number(F.col("t")), t=line) is number


@pytest.mark.parametrize(
    ("line", "level"),
    [("第三章 总则", 1), ("Chapter 2", 1), ("第5条 规定", 2), ("二、概况", 2), ("3、要点", 3), ("3. Points", 3), ("（四）方法", 3), ("1.2 Scope", 4), ("(b) x", 4), ("1.2.3 Detail", 5), ("plain text", None), ("  ", None)],
)
def test_heading_pattern(spark, line, level):
    assert value(spark, T.heading_pattern_level(F.col("t")), t=line) == level


def test_heading_by_font_and_place(spark):
    level = T.heading_level(F.col("t"), F.col("f"), F.lit(10.0), F.col("b"), F.col("c"), F.col("p"))
    assert value(spark, level, t="Title", f=20.0, b=False, c=True, p=False) == 2
    assert value(spark, level, t="Title", f=20.0, b=True, c=True, p=False) == 1
    assert value(spark, level, t="Title", f=10.0, b=False, c=False, p=True) == 2
    assert value(spark, level, t="body", f=10.0, b=False, c=False, p=False) is None


@pytest.mark.parametrize(
    ("line", "item"),
    [("1. one", ("numbered_arabic", "1", "one")), ("（2）two", ("numbered_arabic", "2", "two")), ("三、three", ("numbered_chinese", "三", "three")), ("a) four", ("lettered_lower", "a", "four")), ("B. five", ("lettered_upper", "B", "five")), ("• six", ("bulleted", "•", "six")), ("②seven", ("circled_number", "②", "seven")), ("prose", None)],
)
def test_list_item(spark, line, item):
    got = value(spark, T.list_item(F.col("t")), t=line)
    assert (tuple(got) if got else None) == item


@pytest.mark.parametrize(
    ("date", "normal"),
    [("2O24年01月05日", "2024年1月5日"), ("2024/1/5", "2024年1月5日"), ("20240105", "2024年1月5日"), ("2024年3月", "2024年3月"), ("2024", "2024年"), ("soon", "soon")],
)
def test_normalized_date(spark, date, normal):
    assert value(spark, T.normalized_date(F.col("t")), t=date) == normal


@pytest.mark.parametrize(
    ("text", "days"),
    [("住院 12 天", 12), ("住院天数：7", 7), ("2023年1月2日入院，2023年1月12日出院", 10), ("2023年1月2日", 0), ("2020年1月1日 2023年1月1日", 0), ("2023年13月2日 2023年1月3日", 0)],
)
def test_stay_days(spark, text, days):
    assert value(spark, T.stay_days(F.col("t")), t=text) == days


def test_masks_and_amounts(spark):
    assert value(spark, T.masked_id(F.col("t")), t="110101199001011234") == "110101****1234"
    assert value(spark, T.masked_id(F.col("t")), t="123") == "123"
    assert value(spark, T.receipt_tail(F.col("t")), t="scan_0012-34.pdf") == "1234"
    assert value(spark, T.safe_double(F.col("t")), t="1,234.5") == 1234.5
    assert value(spark, T.safe_double(F.col("t")), t="n/a") == 0.0
    assert value(spark, T.is_private_host(F.col("t")), t="172.31.0.1") is True
    assert value(spark, T.is_private_host(F.col("t")), t="8.8.8.8") is False
    assert value(spark, T.unfenced(F.col("t")), t='```json\n{"a": 1}\n```') == ""
