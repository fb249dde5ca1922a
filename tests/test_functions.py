"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions import cleaning as C
from reelspark.functions import titles as N


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, seconds", [("01:21", 4860), ("01:30:00", 5400), ("-", 0), ("", 0), (None, 0), ("abc", 0), ("1:2:3:4", 0)])
def test_duration(spark, text, seconds):
    assert value(spark, C.duration_seconds(F.lit(text).cast("string"))) == seconds


@pytest.mark.parametrize("text, flag", [("Y", True), (" n ", False), ("?", None), (None, None)])
def test_yes_no(spark, text, flag):
    assert value(spark, C.yes_no(F.lit(text).cast("string"))) is flag


@pytest.mark.parametrize("x, pct", [(0.005, 0), (0.015, 2), (0.025, 2), (1.7, 100), (None, None)])
def test_percent(spark, x, pct):
    assert value(spark, C.percent(F.lit(x).cast("double"))) == (pct if x is not None else 100)


@pytest.mark.parametrize("text, names", [('["a", " b ", ""]', ["a", "b"]), ("no json", []), (None, []), ("", [])])
def test_json_names(spark, text, names):
    assert value(spark, C.json_names(F.lit(text).cast("string"))) == names


def test_confidence(spark):
    assert value(spark, C.item_confidence(F.lit(0), F.lit(8.0))) == 0.1
    assert value(spark, C.item_confidence(F.lit(40000), F.lit(10.0))) == 1.0


@pytest.mark.parametrize("text, out", [("겨울왕국", "ㄱㅇㅇㄱ"), ("a1 힣", "a1 ㅎ"), ("까치", "ㄲㅊ"), ("", "")])
def test_initials(spark, text, out):
    assert value(spark, N.initials(F.lit(text))) == out


@pytest.mark.parametrize("text, only", [("ㄱㅇ", True), ("ㄱ a", True), ("가ㄱ", False)])
def test_initials_only(spark, text, only):
    assert value(spark, N.initials_only(F.lit(text))) is only


@pytest.mark.parametrize("title, series", [("무한도전 100회", "무한도전"), ("무한도전 시즌 2 03화", "무한도전"), ("마녀 2", "마녀"), ("1회", "1회"), ("끝.", "끝")])
def test_series_name(spark, title, series):
    assert value(spark, N.series_name(F.lit(title))) == series


@pytest.mark.parametrize("title, base, season", [("신서유기 시즌2 01회", "신서유기", 2), ("아는형님 S2 001회", "아는형님", 2), ("마녀들 2 01회", "마녀들", 2), ("윤스테이 01회", "윤스테이", 1)])
def test_season(spark, title, base, season):
    b, s = N.season_of(F.lit(title))
    assert (value(spark, b), value(spark, s)) == (base, season)


@pytest.mark.parametrize("a, b, s", [("cat", "cat", 1.0), ("word", "two words", 4 / 11), ("", "", 0.0)])
def test_trigram_similarity(spark, a, b, s):
    assert value(spark, N.trigram_similarity(F.lit(a), F.lit(b))) == pytest.approx(s)


@pytest.mark.parametrize("raw, clean", [("[방송최저가] 포기김치 10kg", "포기김치"), ("아산 포기김치 3박스", "포기김치"), ("", ""), ("간고등어 ★★", "간고등어"), ("에어맥스 🔥초특가🔥 2켤레", "에어맥스"), ("견과류 🩵👍🏽❤️→", "견과류"), ("LG 스타일러 ㎏ 트롬", "스타일러 ㎏ 트롬"), ("12345", "12345"), (None, "")])
def test_product_name(spark, raw, clean):
    assert value(spark, N.product_name(F.lit(raw))) == clean


@pytest.mark.parametrize("area, region", [("전라남도 구례군", "구례"), ("서울 중구", "서울"), ("부산광역시 해운대구", "부산"), ("서울특별시", "서울")])
def test_region(spark, area, region):
    assert value(spark, N.region_of(F.lit(area))) == region


@pytest.mark.parametrize("text, word, hit", [("라면을 먹자", "라면", True), ("거라면", "라면", False), ("오리털", "오리", False), ("오리", "오리", True)])
def test_keyword_hit(spark, text, word, hit):
    assert value(spark, N.keyword_hit(F.lit(text), F.lit(word))) is hit


@pytest.mark.parametrize("text, ok", [("2020-02-29", True), ("2021-02-29", False), ("1899-01-01", False), ("20-01-01", False), (None, False)])
def test_valid_date(spark, text, ok):
    assert value(spark, C.valid_date(F.lit(text).cast("string"))) is ok
