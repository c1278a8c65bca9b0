import random

import pytest

from runloom.llm import spam

PROSE = ["The release branch fails when the cache is warm, and nobody has an explanation yet.", "We tried the new scheduler for a week, but the clock of the agent drifts.", "Before you add a retry, read the log of the job.", "The nightly build has been slow since the database starts too late.", "Das neue Modul wurde übersprungen, obwohl wir die Reihenfolge geändert haben.", "La suite de tests est plus lente depuis que l'ordre des tâches a changé.", "夜間ビルドはキャッシュが空のときに失敗します。", "测试套件因为时钟不准而停止。新的模块在缓存为空时失败。"]
WORDS = ["garden lamp", "essay service", "loan calculator", "test cloud", "coffee beans", "phone case"]


def ordinary(rng):
    kind = rng.randrange(6)
    prose = " ".join(rng.choice(PROSE) for _ in range(rng.randrange(3, 9)))
    if kind == 0:
        return "12:00:01 [INFO] Tests run: 3, Failures: 0\n" * rng.randrange(2, 20) + prose
    if kind == 1:
        return prose + "\n\njava.lang.AssertionError: expected <1>\n" + "\tat com.a.B.run(B.java:12)\n" * rng.randrange(2, 20)
    if kind == 2:
        return "\n".join(f"- http://lists.a.example/t/{rng.randrange(999)} {rng.choice(PROSE)} {rng.choice(PROSE)}" for _ in range(5))
    if kind == 3:
        return prose + "\n\nTags: " + ", ".join(rng.sample(WORDS, 3))
    if kind == 4:
        return prose + "\n M net/src/main/java/io/a/B.java | 5 +-" * rng.randrange(1, 5)
    return prose


def stuffed(rng):
    w = rng.sample(WORDS, 2)
    n = range(rng.randrange(25, 60))
    return rng.choice([
        lambda: " ".join(rng.choice(w) for _ in n),
        lambda: ", ".join(f"{rng.choice(['best', 'cheap', ''])} {rng.choice(w)} near me" for _ in n),
        lambda: "\n".join(f"http://{x.replace(' ', '')}{k}.example/deal/{k}" for k in n for x in [rng.choice(w)]),
        lambda: "\n".join(f"[{rng.choice(w)}](http://a{k}.example/go/{k})" for k in n),
        lambda: " ".join("#" + rng.choice(WORDS).title().replace(" ", "") for _ in n),
        lambda: " ".join(f"where to buy {x}? is {x} cheap? {x} or {x}?" for _ in n for x in [rng.choice(w)]),
        lambda: "\n".join(f"category=mug; color=sand; tag={rng.choice(w)}" for _ in n),
        lambda: "\n".join("​".join(rng.choice(w)) for _ in n),
        lambda: rng.choice(PROSE) + "\n" + " · ".join(rng.choice(w) for _ in n),
    ])()


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    data = [(k, stuffed(rng) if k % 12 == 0 else ordinary(rng), rng.choice(["en", "de", "ja", None, "xx"]), "more") for k in range(1500)]
    odd = [None, "", " \n", "é" * 4000, "👩" * 900, "LGTM", "+1", "cc @quality", "a" * 100_000, "=" * 70 + "\n"]
    data += [(10_000 + k, t, "en", "more") for k, t in enumerate(odd)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, share string")
    return data, {r.doc_id: r for r in spam.judged_pages(df).collect()}


def test_found_and_nothing_else(pages):
    data, got = pages
    assert len(got) == len(data)
    wrong = [(k, t[:60]) for k, t, _, _ in data if got[k].is_spam != (k < 10_000 and k % 12 == 0)]
    assert len(wrong) <= 3, wrong


def test_distance_is_small_in_the_bulk(pages):
    data, got = pages
    bulk = sorted(got[k].distance for k, *_ in data if k < 10_000 and k % 12)
    assert bulk[len(bulk) // 2] < 8
    assert min(got[k].distance for k, *_ in data if k < 10_000 and k % 12 == 0) > spam.FAR


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, PROSE[0], None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert [r.is_spam for r in spam.judged_pages(df).collect()] == [False, False]
    assert spam.judged_pages(df.limit(0)).count() == 0


def test_sentences():
    read = spam.Reader().read
    assert read("The split fails if the seed is set since version 8.13. We agreed to wait.")[1] == 0
    assert read("where to buy garden lamp? best garden lamp? " * 20)[1] > 0.9
    assert read("* Fix it: 夜间构建在缓存为空时失败。 ([#1](https://a.example/issue/1))")[1] < 0.5
    assert read("* [garden lamp](https://a.example/issue/1)")[1] == 1


def test_titles_quotes_and_repeated_questions():
    read = spam.Reader().read
    line = "* Fix bug in encoder: Второй агент падает, когда кэш пуст. ([#1](https://a.example/issue/1))\n"
    assert read(line * 8)[1] < 0.2
    assert read("The dependency update fails when the cache is warm?“quoted” ")[1] == 0
    assert read("Can somebody confirm this? Can somebody confirm this? I'll send a patch tomorrow. Can somebody confirm this?")[1] < 0.5
    assert read("garden lamp where? " * 9)[1] == 1


def test_the_distance_decides(pages):
    """Without the check of shares that follows, the distance finds the same documents."""
    data, got = pages
    far = {k for k, r in got.items() if r.distance > spam.FAR and r.toward > spam.TOWARD}
    assert far == {k for k, r in got.items() if r.is_spam}


def test_one_token_makes_no_material(spark):
    """A path, a digest or a call inside a long line covers only itself; a short line goes with it as a whole."""
    read, keywords = spam.Reader().read, "cheap garden lamp near me, best essay service online, " * 20
    for token in ("shop/sale.html", "0123456789abcdef", "go(now);", "LampTest PASS"):
        assert read(keywords + token)[1] > 0.9 and read(f"{keywords} {token} {keywords};")[1] > 0.9
    assert read("see 0123456789abcdef and net/src/A.java")[1] == 0
    assert read(" ".join(PROSE[:4]) * 3 + " net/src/main/A.java 0123456789abcdef")[1] < 0.1
    assert spam.Reader().read("[b " * 50_000)[1] >= 0 and spam.Reader().read("<" * 50_000)[1] == 0
