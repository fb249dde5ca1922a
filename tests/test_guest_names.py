"""Guests' names in synopses, by hand: each pattern, particles, family names, stop words, order and limit."""

import pytest
from pyspark.sql import functions as F

from reelspark.operators.repair import guest_names

CASES = {
    "게스트 김철수, 박영희가 출연": ["김철수", "박영희"],
    "특별 게스트: 이민호·최유리 & 정해인! 놓치지 마세요": ["이민호", "최유리", "정해인"],
    "게스트 김철수(가수)와 강호동": ["김철수"],
    "특별출연: 한지민": ["한지민"],
    "개그맨 유재석의 웃음": ["유재석"],
    "장나라가 전격 합류": ["장나라"],
    "송중기×송혜교 특집": ["송중기", "송혜교"],
    "요리사 백종원과 달인 신동엽": ["백종원", "신동엽"],
    "오늘의 이야기와 서울을 소개": [],
    "조인성과 함께": ["조인성"],
    "갈매기가 등장": [],
    "배우 김철수, 가수 김철수": ["김철수"],
    "가수 박효신 게스트 김철수": ["김철수", "박효신"],
    "게스트 김일일 김이이 김삼삼 김사사 김오오 김육육 김칠칠 김팔팔 김구구": ["김일일", "김삼삼", "김사사", "김오오", "김육육", "김칠칠", "김팔팔", "김구구"],
    "no guests": [],
    "": [],
}


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(t,) for t in [*CASES, None]], "text string")
    return {r.text: r.names for r in frame.select("text", guest_names(F.col("text")).alias("names")).collect()}


@pytest.mark.parametrize("text", CASES)
def test_names(found, text):
    assert found[text] == CASES[text]


def test_null(found):
    assert found[None] is None
