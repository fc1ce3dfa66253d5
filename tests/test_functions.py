"""Text and vector functions against values worked out by hand and against Python's own library."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import articles, contents


def each(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_codes_and_pages(spark):
    assert each(spark, X.leading_code, ["004.8+519.7", "N/A", "", " 51", "abc ", None]) == ["004", "N/A", "N/A", "51", "abc", "N/A"]
    assert each(spark, X.class_code, ["2.3.1. Системный анализ", "plain"]) == ["2.3.1", "plain"]
    assert each(spark, X.class_title, ["2.3.1. Системный анализ", "plain"]) == ["Системный анализ", "plain"]
    lines = ["Название 12", "Название....7", "Название 1234"]
    assert each(spark, X.tail_page, lines) == [12, 7, None]
    assert each(spark, X.strip_page, lines) == ["Название", "Название", "Название 1234"]


def test_cleaning(spark):
    assert each(spark, X.squeeze, [" a \n b\t", None]) == ["a b", ""]
    assert each(spark, X.dehyphenate, ["сло-\nво и пере- нос x- y"]) == ["слово и перенос x- y"]
    assert each(spark, X.clean_main_text, ["a\n 12 \n\nb § c"]) == ["a b c"]
    assert each(spark, X.is_garbage_line, ["abc", "ISSN 1234-5678", "обычная строка", None]) == [True, True, False, True]
    assert each(spark, X.contents_line, ["— Модель  сети.;"]) == ["Модель сети"]
    assert each(spark, X.letters_only_text, ["Модель (x=1) , , сети -. конец, да;да"]) == ["Модель сети конец, да; да"]
    assert each(spark, X.parsed_tokens, ["['a', 'b']", "oops", None]) == [["a", "b"], [], []]
    assert each(spark, X.parsed_tokens, ["['a', \"b'c\", 'd']", "[]"]) == [["a", "b'c", "d"], []]
    assert each(spark, X.strip_page, ["Название сети -", None, "- Раздел: 12"]) == ["Название сети", "", "Раздел"]
    assert each(spark, X.title_tokens, ["Онлайн-обучение в сети", None]) == [["онлайн", "обучение", "сети"], []]
    assert each(spark, lambda c: X.cyrillic_tokens(c, X.stop_words()), ["Данные и модель не будут энергосетью"]) == [["модель", "будут", "энергосетью"]] or "модель" in X.stop_words()
    lemma = lambda w: F.transform(w, lambda x: F.regexp_replace(x, "и$", "ь"))
    assert each(spark, lambda c: X.cyrillic_tokens(c, ("сеть",), lemma), ["модели сети"]) == [["модель"]]
    assert each(spark, X.cyrillic_tokens, ["Это Модель, и model сети"]) == [["это", "модель", "сети"]]


def test_lines(spark):
    assert each(spark, X.is_author_like, ["Иванов И.И. Название", "Модель сети", None]) == [True, False, False]
    assert each(spark, X.is_heading_start, ["Модели и методы анализа", "модели и методы", "Модели 5", "Просто слова тут", "Модели: методы"]) == [True, False, False, False, False]
    assert each(spark, X.is_heading_continuation, ["и анализ сетей", "Анализ", "и 5"]) == [True, False, False]
    assert each(spark, X.is_bad_topic, ["Модели и методы", "", "И.И. модель", "модель", "Модель."]) == [False, True, True, True, False]
    good = "1. Иванов И.И. Модель сети и её анализ. Журнал, 2019"
    assert each(spark, X.looks_like_reference, [good, "Иванов И.И. 2019", "1. коротко 2019"]) == [True, False, False]
    assert [articles.is_reference(x) for x in (good, "1. коротко 2019")] == [True, False]


def test_weighted_text(spark):
    df = spark.createDataFrame([("t", " a ", None)], "title string, annotation string, keywords string")
    assert df.select(X.weighted_text({"title": 3, "annotation": 2, "keywords": 2})).first()[0] == "t t t  a a "


def test_urls(spark):
    base = "http://h.org/a/b?x=1"
    links = ["/c", "d", "//z.org/e", "https://q/f", "?p=2", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(links)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(X.resolve_url(F.lit(base), F.col("v"))).collect()] == ["http://h.org/c", "http://h.org/a/d", "http://z.org/e", "https://q/f", "http://h.org/a/b?p=2", "http://h.org/a/b"]


def test_references_are_cut():
    assert articles.first_run([100, 2000, 2500, 3000]) == 2000
    body = "слово " * 300
    assert articles.cut_references(body + "\nЛитература\n1. Что-то") == body + "\n"
    lines = "".join(f"\n{i}. Иванов И.И. Название работы номер {i}, том 5, 2019" for i in range(1, 6))
    assert articles.cut_references(body + lines).strip() == body.strip()
    assert articles.cut_references("") == ""


@pytest.mark.parametrize(("a", "b", "score"), [("Модель сети", "Модель сети", 1.0), ("Модель сети", "Модель энергосети и анализ", 0.5386), ("Модель энергосети и анализ", "Модель сети", 0.4219), ("ИИ", "Модель", 0.0), ("Онлайн-обучение", "онлайн обучение", 1.0), ("Alpha beta", "Alpha gamma", 0.55)])
def test_title_score(a, b, score):
    assert contents.title_score(a, b) == pytest.approx(score, abs=1e-4)


def test_similarity_is_difflibs(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(contents.similarity("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "abcd", "bcde").ratio(), 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.unit(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0]["u"] == pytest.approx([0.6, 0.8]) and rows[0]["c"] == pytest.approx(0.96)
    assert rows[1]["u"] == [0.0, 0.0] and rows[1]["c"] == 0.0
    assert list(V.k_range(5, 50, 8)) == [5, 6, 7]
    with pytest.raises(ValueError):
        V.k_range(5, 50, 2)


def test_json_top(spark):
    good = '[{"code":"a","match_score":0.5,"rank_tfidf":2},{"code":"b","match_score":0.4,"rank_tfidf":1}]'
    assert [tuple(x) for x in each(spark, V.top_by_rank, [good, "broken", None])] == [("b", 0.4), ("", 0.0), ("", 0.0)]


def test_bonus(spark):
    df = spark.createDataFrame([(10, 15), (10, 90), (None, 5)], "a int, b int")
    assert [r[0] for r in df.select(V.page_bonus(F.col("a"), F.col("b"), 0.08, 20, 0.004)).collect()] == pytest.approx([0.06, 0.0, 0.0])
