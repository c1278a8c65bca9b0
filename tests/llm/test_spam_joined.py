"""Words joined without blanks are weighed each by itself; runs of a few characters still count nothing."""

import pytest

from runloom.llm import spam
from tests.llm.test_spam import PROSE, ordinary

JOINED = [
    ",".join(["buy", "cheap", "phones", "garden", "lamp", "loan"] * 20),
    "".join(f"#{w}" for w in ["gardenlamp", "coffeebeans", "phonecase"] * 20),
    "|".join(["essay", "service", "loan", "calculator"] * 20),
    "_".join(["test", "cloud", "coffee", "beans"] * 20),
    ",".join(["günstig", "lampe", "kaufen", "gutschein"] * 20),
    "、".join(["庭園灯", "携帯電話", "格安販売", "珈琲豆"] * 40),
]
RUNS = ["=" * 1200, "a" * 1200, "ab" * 600, "0123456789" * 60, "acgt" * 300, "é" * 1200, "=-" * 300]


@pytest.mark.parametrize("text", JOINED)
def test_joined_words_are_phrases(text):
    reader = spam.Reader()
    read = reader.read
    assert read(text)[1] == 1 and reader.weight(text) > 200
    assert read(PROSE[0] + "\n" + text)[1] > 0.5


@pytest.mark.parametrize("text", RUNS)
def test_runs_count_nothing(text):
    assert spam.Reader().weight(text) == 0


def test_long_prose_without_blanks_counts_whole():
    reader = spam.Reader()
    text = "夜間ビルドはキャッシュが空のときに失敗します。" * 20
    assert reader.read(text)[1] == 0 and reader.weight(text) > 2 * 20 * 20


def test_joined_lists_are_found(spark):
    import random

    rng = random.Random(6)
    data = [(k, ordinary(rng), "en") for k in range(400)] + [(1000 + k, t, "en") for k, t in enumerate(JOINED)]
    got = {r.doc_id for r in spam.judged_pages(spark.createDataFrame(data, "doc_id bigint, text string, lang string")).where("is_spam").collect()}
    assert got == {1000 + k for k in range(len(JOINED))}
