"""Operators on small tables with results worked out by hand, and invariants of fitted models."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import articles, clusters, contents, phrases, relations, reports, scoring, topics
from docloom.operators.store import Store
from docloom.sources import html
from docloom.sources.classes import class_dictionary


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_share_of_group(spark):
    df = spark.createDataFrame([("c1", "X")] * 3 + [("c1", "Y")] + [("c1", None)] * 4 + [("c2", "X")] * 2, "c string, k string")
    assert rows(relations.share_of_group(df, "c", "k")) == [("c1", "X", 3, 75.0), ("c1", "Y", 1, 25.0), ("c2", "X", 2, 100.0)]


def test_points_and_as_of(spark):
    entries = spark.createDataFrame([("s", 1, 9, "B"), ("s", 2, 3, "A"), ("s", 3, 5, "A"), ("s", 4, 0, "C"), ("s", 5, 7, "")], "source string, seq int, toc_page int, topic string")
    points = contents.topic_points(entries)
    assert rows(points) == [("s", 3, "A"), ("s", 9, "B")]
    asked = spark.createDataFrame([("s", 1), ("s", 3), ("s", 8), ("s", 9), ("s", None)], "source string, pdf_page int")
    assert rows(contents.topic_by_page(asked, points)) == sorted([("s", 1, "A"), ("s", 3, "A"), ("s", 8, "A"), ("s", 9, "B"), ("s", None, None)], key=str)


@pytest.mark.parametrize(("u", "m", "n", "blank"), [(0, 0, 5, True), (4, 6, 20, False), (12, 3, 20, True), (5, 2, 9, True), (3, 1, 10, True), (2, 2, 10, True), (1, 8, 20, False), (1, 7, 20, True), (1, 3, 4, True)])
def test_without_topics(spark, u, m, n, blank):
    assert spark.range(1).select(contents.without_topics(F.lit(u), F.lit(m), F.lit(n))).first()[0] is blank


def test_contents(spark):
    text = "Предисловие\nСодержание\nМодели и методы анализа систем\nИванов И.И.\nМодель сети 5\nПетров П.П. Анализ данных\n17\nТехнологии управления\nи анализ рисков\nОценка риска 41\ncontent\nпоздно 9"
    pages = spark.createDataFrame([("a", 1, text), ("a", 2, "УДК 004.8\nтекст")], "source string, page_num int, text string")
    lines = [r.line for r in contents.contents_lines(pages).orderBy("seq").collect()]
    assert lines[0] == "Модели и методы анализа систем" and lines[-1] == "Оценка риска 41"
    got = [(r.topic, r.toc_title, r.toc_page) for r in contents.toc_entries(contents.contents_lines(pages)).orderBy("seq").collect()]
    first, second = "Модели и методы анализа систем", "Технологии управления и анализ рисков"
    assert got == [(first, "Иванов И.И Модель сети", 5), (first, "Петров П.П. Анализ данных", 17), (second, "Оценка риска", 41)]


def test_match_topics(spark):
    toc = spark.createDataFrame([("a", 1, "T1", "Модель сети", 3, False), ("a", 2, "T2", "Анализ данных", 9, False)], "source string, seq int, topic string, toc_title string, toc_page int, no_theme boolean")
    own = spark.createDataFrame([("a", 1, "Модель сети", None), ("a", 2, "Совсем иное", 10), ("a", 3, "Анализ данных", None), ("a", 4, "Другое", None)], "source string, seq int, title string, pdf_page int")
    got = {r.seq: (r.topic, r.topic_match_score) for r in contents.match_topics(own, toc).collect()}
    assert got[1] == ("T1", 1.0) and got[3] == ("T2", 1.0)
    assert got[2][0] == "T2" and got[4][0] == "Тема не определена"


def test_articles(spark):
    body = "слово " * 200
    page = f"УДК 004.8+519\nО модели сети\nИванов Иван Иванович\nАннотация. Кратко. Ключевые слова: сеть, модель.\nВведение. {body}\nСписок литературы\n1. Нечто"
    pages = spark.createDataFrame([("f", 1, "обложка"), ("f", 2, page), ("f", 3, "УДК 1\nкоротко")], "source string, page_num int, text string")
    got = articles.parse_articles(pages).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.udc, r.title, r.authors, r.annotation, r.keywords) == ("004", "О модели сети", "Иванов Иван Иванович", "Кратко.", "сеть, модель.")
    assert r.pdf_page == 2 and len(r.main_text.split()) == 200 and "литературы" not in r.main_text


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    assert not s.exists()
    with pytest.raises(FileNotFoundError):
        s.read("articles")
    s.create()
    batch = spark.createDataFrame([(1, "T1", "a"), (2, "T2", "b"), (3, "T1", "c"), (4, None, "d")], "o int, title string, source string")
    assert s.insert("articles", batch, "o") == {"inserted": 2, "nulls": 1, "orphans": 0, "duplicates": 1}
    assert rows(s.read("articles").select("id", "title", "source")) == [(1, "T1", "a"), (2, "T2", "b")]
    with pytest.raises(ValueError):
        s.insert("articles", batch.where("o = 1"), "o", strict=True)
    results = spark.createDataFrame([(1, 1, "c1"), (2, 9, "c2")], "o int, article_id long, cluster_name string")
    assert s.insert("clustering_results", results, "o")["orphans"] == 1
    assert s.update("articles", 2, {"topic": "x"}) == 1 and s.update("articles", 7, {"topic": "x"}) == 0
    for bad in ({}, {"no": 1}, {"id": 5}):
        with pytest.raises(ValueError):
            s.update("articles", 2, bad)
    assert s.delete("articles", 1) == 1
    assert s.read("articles").count() == 1 and s.read("clustering_results").count() == 0
    assert s.insert("saved_classifications", spark.createDataFrame([(1, "t")], "o int, title string"), "o")["inserted"] == 1
    saved = s.read("saved_classifications").first()
    assert saved.timestamp is not None and saved.is_ambiguous == 0


def test_broken_change_keeps_the_old_rows(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "db"))
    s.create()
    s.insert("articles", spark.createDataFrame([(1, "T1")], "o int, title string"), "o")
    for broken in ("articles", "_new_articles"):  # the first or the second rename never happens
        move = s._move

        def fails(old, new, broken=broken, move=move):
            if old == broken:
                raise OSError("gone")
            move(old, new)

        monkeypatch.setattr(s, "_move", fails)
        with pytest.raises(OSError):
            s.update("articles", 1, {"topic": broken})
        monkeypatch.undo()
        assert rows(Store(spark, str(tmp_path / "db")).read("articles").select("id", "title", "topic")) == [(1, "T1", None)]
    assert s.update("articles", 1, {"topic": "x"}) == 1 and s.read("articles").first().topic == "x"


def test_topics_of_shared_pages(spark):
    entries = spark.createDataFrame(
        [("s", 1, "Модели и методы", "Первая", 5, False), ("s", 2, "Анализ систем", "Вторая", 5, False), ("s", 3, "", "Третья", 9, False)],
        "source string, seq int, topic string, toc_title string, toc_page int, no_theme boolean",
    )
    own = spark.createDataFrame([("s", 1, "Совсем другое", 7), ("s", 2, "Ничего общего", 1)], "source string, seq int, title string, pdf_page int")
    got = {r.seq: r.topic for r in contents.match_topics(own, entries).collect()}
    assert got == {1: "Анализ систем", 2: "Модели и методы"}


def test_statistics_of_nothing(spark):
    from docloom.schemas import SCHEMAS

    empty = spark.createDataFrame([], SCHEMAS["saved_classifications"])
    assert reports.saved_statistics(empty) == {"total": 0, "ambiguous": 0, "discrepancy": 0, "top_tfidf": [], "top_embed": []}


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb bb"), (2, "bb cc"), (3, None)], "doc_id int, text string")
    # two documents and a class, each term in two of them; the third document shares nothing
    classes = spark.createDataFrame([(0, "aa cc")], "class_idx int, class_text string")
    got = dict((r[0], r[2]) for r in scoring.tfidf_scores(docs.where("doc_id < 3"), classes, grams=1).collect())
    assert got[1] == pytest.approx(0.316228, abs=1e-6) and got[2] == pytest.approx(0.5)
    assert dict((r[0], r[2]) for r in scoring.tfidf_scores(docs, classes, grams=1).collect())[3] == 0.0


@pytest.mark.parametrize(
    ("semantic", "tfidf", "expected"),
    [((0.60, 0.50), (0.10, 0.05), (False, False, None, "")), ((0.60, 0.59), (0.10, 0.05), (True, False, None, "ambiguous")), ((0.60, 0.50), (0.05, 0.10), (False, True, 1, "suggestion")),
     ((0.60, 0.59), (0.05, 0.10), (True, True, 1, "suggestion+ambiguous")), ((0.60, 0.50), (0.05, 0.06), (False, True, None, ""))],
)
def test_flags(spark, semantic, tfidf, expected):
    df = spark.createDataFrame([(1, i, semantic[i], tfidf[i]) for i in (0, 1)], "doc_id int, class_idx int, match_score double, tfidf_similarity double")
    r = scoring.flags(scoring.ranked(df)).first()
    assert (r.ambiguous, r.discrepancy, r.tfidf_alternative, r.message) == expected


def test_cluster_names(spark):
    df = spark.createDataFrame([(0, "A")] * 8 + [(0, "B")] * 2 + [(1, "A")] * 6 + [(1, "B")] * 4 + [(2, "A")] * 10, "cluster int, topic string")
    assert dict(map(tuple, clusters.cluster_names(df).collect())) == {0: "A", 1: "B", 2: "A"}


def test_silhouettes_match_the_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = [(i, [float(i % 3 == 0) + 0.1 * (i % 5), 1.0 + 0.3 * (i % 2), 0.2 * i], i % 3) for i in range(30)]
    df = spark.createDataFrame(data, "k int, embedding array<double>, label int")
    mean = clusters.silhouettes(df, "k", "label").agg(F.avg("silhouette")).first()[0]
    expected = ClusteringEvaluator(featuresCol="v", predictionCol="label", distanceMeasure="cosine").evaluate(df.withColumn("v", array_to_vector("embedding")))
    assert mean == pytest.approx(expected)


def test_phrases(spark):
    docs = spark.createDataFrame([(i, ["new", "york", "is", f"w{i}"]) for i in range(12)] + [(99, ["york", "new", "york", "new", "york"])], "doc_id int, tokens array<string>")
    found = phrases.phrase_scores(docs, min_count=5, threshold=1.0)
    assert ("new", "york") in {(r.a, r.b) for r in found.collect()}
    merged = {r.doc_id: r.tokens for r in phrases.merge_phrases(docs, found.where("a = 'new'"), "doc_id").collect()}
    assert merged[0] == ["new_york", "is", "w0"] and merged[99] == ["york", "new_york", "new_york"]
    every = spark.createDataFrame([("a", "a")], "a string, b string")
    runs = spark.createDataFrame([(1, ["a", "a", "a", "b", "a", "a"]), (2, []), (3, ["a"]), (4, ["a", "a", "a", "a"])], "doc_id int, tokens array<string>")
    merged = {r.doc_id: r.tokens for r in phrases.merge_phrases(runs, every, "doc_id").collect()}
    assert merged == {1: ["a_a", "a", "b", "a_a"], 2: [], 3: ["a"], 4: ["a_a", "a_a"]}


def test_dictionary_and_tokens(spark):
    docs = spark.createDataFrame([(i, ["all", "half" if i % 2 else "other"] + [f"x{i}"] * 20) for i in range(10)], "doc_id int, tokens array<string>")
    assert [r.term for r in phrases.dictionary(docs, no_below=5, no_above=0.6).orderBy("term_id").collect()] == ["half", "other"]
    assert topics.prepared(docs).count() == 10
    with pytest.raises(ValueError):
        topics.prepared(docs.withColumn("tokens", F.slice("tokens", 1, 20)))


@pytest.mark.parametrize("at_once", [3, 1 << 16])
def test_windows_are_brute_force(spark, monkeypatch, at_once):
    import random

    import numpy as np

    r = random.Random(1)
    words, window = ["a", "b", "c"], 5
    docs = [[r.choice([*words, "x", "y", "z"]) for _ in range(n)] for n in (0, 1, 4, 5, 6, 40, 80)]
    both, total = np.zeros((3, 3)), 0
    for d in docs:
        for s in range(max(1, len(d) - window + 1)):
            inside = [w in d[s : s + window] for w in words]
            both += np.outer(inside, inside)
            total += 1
    count = topics._count_windows
    monkeypatch.setattr(topics, "_count_windows", lambda own, window, out: count(own, window, out, at_once))
    got = np.zeros((3, 3), np.int64)
    for d in docs:
        topics._count_windows(np.array([words.index(w) if w in words else -1 for w in d], np.int64), window, got)
    assert (got == both).all()
    monkeypatch.undo()
    p = both / total
    npmi = np.log((p + 1e-12) / np.outer(np.diag(p), np.diag(p))) / -np.log(p + 1e-12)
    whole = npmi.sum(0)
    expected = np.mean([row @ whole / np.linalg.norm(row) / np.linalg.norm(whole) for row in npmi])
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(99, None)], "doc_id int, tokens array<string>")
    assert topics.coherence(df.where("doc_id < 99"), [words], window=window) == pytest.approx(expected)
    assert topics.coherence(df.where("doc_id < 0"), [words]) == 0.0


def test_links_and_next():
    page = '<div class="pagination"><a href="/1">1</a><span class="current">2</span><a href="/3">3</a></div>'
    assert html.next_address(page) == "/3"
    assert html.next_address('<a href="x">one</a> <a href="y"> » </a>') == "y"
    assert html.next_address(None) is None
    site = {"http://h/a": '<a href="b">Next</a>', "http://h/b": '<a href="a">Next</a>'}
    assert [u for u, _ in html.crawl("http://h/a", site.__getitem__, delay=0)] == ["http://h/a", "http://h/b"]


def test_classes(spark):
    assert [r.code for r in class_dictionary(spark).orderBy("class_idx").collect()] == ["1.2.2", "2.3.1", "2.3.3", "2.3.5", "2.4.5"]


def test_stream_skips_known_titles(spark, tmp_path):
    from docloom.schemas import SCHEMAS
    from docloom.streaming.ingest import article_stream, ingest

    s = Store(spark, str(tmp_path / "db"))
    s.create()
    for part in (["a", "b"], ["b", "c"]):
        new = spark.createDataFrame([(i, t) for i, t in enumerate(part)], "id long, title string")
        new.select([(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["articles"]]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(article_stream(spark, str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.title for r in s.read("articles").collect()) == ["a", "b", "c"]


def test_long_articles_are_searched_once(spark):
    import time

    text = f"УДК 004.8\nО модели сети\nИванов Иван Иванович\nАннотация. Кратко. Ключевые слова: сеть.\nВведение. {'слово, ' * 60_000}"
    pages = spark.createDataFrame([("f", 1, "обложка"), ("f", 2, text), ("f", 3, text)], "source string, page_num int, text string")
    began = time.time()
    got = sorted((r.pdf_page, r.title, len(r.main_text.split())) for r in articles.parse_articles(pages).select("pdf_page", "title", "main_text").collect())
    assert got == [(2, "О модели сети", 60_000), (3, "О модели сети", 60_000)]
    assert time.time() - began < 60  # 420,000 characters without a page mark; searched from every one of them it takes minutes
    marks = articles.chunks(spark.createDataFrame([("f", 1, "a\n__PAGE_7__PAGE_8__\nУДК 1\nb\n__PAGE_x__"), ("f", 9, "УДК 2\nc")], pages.schema))
    assert [(r.pdf_page, r.chunk) for r in marks.orderBy("seq").collect()] == [(1, "a\nPAGE_8__"), (8, "УДК 1\nb\n__PAGE_x__\n"), (9, "УДК 2\nc")]


def test_phrases_are_counted_in_one_pass_and_merged_in_place(spark, monkeypatch):
    import random

    r = random.Random(3)
    data = [(i, [r.choice("abcde") for _ in range(r.choice((0, 1, 2, 9, 40)))]) for i in range(300)] + [(300, None)]
    docs, read = spark.createDataFrame(data, "doc_id int, tokens array<string>"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    counts, words = {}, {}
    for _, tokens in data:
        for w in tokens or []:
            words[w] = words.get(w, 0) + 1
        for pair in zip(tokens or [], (tokens or [])[1:]):
            counts[pair] = counts.get(pair, 0) + 1
    v = len(words) + len(counts)
    expected = {p: (n - 5) / words[p[0]] / words[p[1]] * v for p, n in counts.items() if n > 5}
    found = phrases.phrase_scores(docs.mapInArrow(seen, docs.schema), min_count=5, threshold=0.0)
    assert {(x.a, x.b): x.score for x in found.collect()} == pytest.approx(expected) and expected
    assert read.value == len(data)
    some = found.where("hash(a, b) % 3 = 0")
    here = phrases.merge_phrases(docs, some, "doc_id")
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(phrases, "SENT_BYTES", 0)
    assert rows(here) == rows(phrases.merge_phrases(docs, some, "doc_id")) != rows(docs)
    assert rows(phrases.merge_phrases(docs, found.where("a = 'none'"), "doc_id")) == rows(docs)


def test_all_starts_of_kmeans_share_their_passes(spark):
    import numpy as np
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(5)
    centres = np.eye(8)[:6]
    data = [(i, (centres[i % 6] * (1 + i % 3) + 0.05 * r.normal(size=8)).tolist()) for i in range(240)]
    df = spark.createDataFrame(data, "k int, embedding array<double>")
    context = spark.sparkContext
    context.setJobGroup("scores", "scores")
    scores = dict(clusters.k_scores(df, range(5, 11), starts=5))
    jobs = len(context.statusTracker().getJobIdsForGroup("scores"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 200  # 30 fits one after the other take many more
    assert list(scores) == list(range(5, 11)) and max(scores, key=scores.get) == 6
    labelled = clusters.kmeans(df, 6, starts=5)
    assert labelled.columns == ["k", "embedding", "cluster"] and labelled.schema["cluster"].dataType.simpleString() == "int"
    groups = {}
    for x in labelled.collect():
        groups.setdefault(x.cluster, set()).add(x.k % 6)
    assert len(groups) == 6 and all(len(g) == 1 for g in groups.values())
    expected = ClusteringEvaluator(featuresCol="v", predictionCol="cluster", distanceMeasure="cosine").evaluate(labelled.withColumn("v", array_to_vector("embedding")))
    assert scores[6] == pytest.approx(expected)
    assert [x.cluster for x in labelled.orderBy("k").collect()] == [x.cluster for x in clusters.kmeans(df, 6, starts=5).orderBy("k").collect()]


def test_topics_take_whole_texts_and_all_documents_in_each_pass(spark):
    import numpy as np

    r = np.random.default_rng(2)
    groups = [[f"{g}{i}" for i in range(12)] for g in "abc"]
    data = [(i, r.choice(groups[i % 3], 900).tolist() + [f"late{i % 3}"] * 5) for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id int, tokens array<string>")
    assert {len(x.tokens) for x in topics.prepared(docs).collect()} == {905}
    assert {len(x.tokens) for x in topics.prepared(docs, most=800).collect()} == {800}
    model = topics.fit(docs, (2, 3), passes=8, no_above=0.9)
    assert [k for k, _ in model.coherences] == [2, 3] and model.documents == 30 and {"late0", "late1", "late2"} <= set(model.words)
    three = topics.fit(docs, (3,), passes=8, no_above=0.9)
    found = {x.doc_id: x for x in topics.dominant_topics(three, docs, "doc_id").collect()}
    assert len({x.topic_id for x in found.values()}) == 3 and all(found[i].topic_id == found[i % 3].topic_id and found[i].weight > 0.9 for i in range(30))

    # two passes by hand: a document at a time, all of them
    words = 6
    bags = [np.sort(r.choice(words, r.integers(1, 5), replace=False)) for _ in range(40)]
    kept = spark.createDataFrame([(b.tolist(), [1 + int(x) % 3 for x in b]) for b in bags], "w array<int>, n array<int>")
    weights = np.random.default_rng(7).gamma(100.0, 0.01, (words, 2))
    prior = np.array([1 / 2**0.5, 1 / (1 + 2**0.5)])
    prior /= prior.sum()
    for _ in range(2):
        table, counts = topics.Lda(weights, prior).table(), np.zeros((words, 2))
        for b in bags:
            n, own = 1.0 + b % 3, table[b]
            gamma = prior + n.sum() / 2
            for _ in range(500):
                share = np.exp(topics._digamma(gamma) - topics._digamma(gamma.sum()))
                gamma = prior + share * ((n / (own @ share)) @ own)
            share = np.exp(topics._digamma(gamma) - topics._digamma(gamma.sum()))
            counts[b] += share * (n / (own @ share))[:, None]
        weights = 1 / 2 + counts * table
    assert topics.models(kept, words, [2], 2, 7)[2].weights == pytest.approx(weights, rel=0.02)


def test_terms_are_counted_and_ranks_made_in_place(spark, monkeypatch):
    import random
    from collections import Counter

    import pyarrow as pa

    r = random.Random(4)
    texts = [[r.choice(["aa", "bb", "cc", "dd"]) for _ in range(r.choice((0, 1, 2, 7, 30)))] for _ in range(60)]
    tf, df = Counter(), Counter()
    for words in texts:
        own = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        tf.update(own)
        df.update(set(own))
    told = [x for b in scoring.term_counts(pa.array(texts, pa.list_(pa.string())), 2) for x in b.to_pylist()]
    assert {x["term"]: (x["tf"], x["df"]) for x in told} == {t: (tf[t], df[t]) for t in tf}

    monkeypatch.setattr(scoring, "COUNTED_WORDS", 16)
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(texts)], "doc_id long, text string")
    classes = spark.createDataFrame([(i, w) for i, w in enumerate(("aa bb", "bb cc", "aa bb", "xx", "dd"))], "class_idx int, class_text string")
    vectors = spark.createDataFrame([(i, [r.random(), r.choice([0.0, 1.0])]) for i in range(0, 90, 2)], "doc_id long, embedding array<double>")
    own = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (9, [1.0, 1.0])], "class_idx int, embedding array<double>")
    plain = scoring.ranked(scoring.tfidf_scores(docs, classes).join(scoring.embedding_scores(vectors, own), ["doc_id", "class_idx"], "left"))
    here = scoring.ranked_scores(docs, classes, vectors, own)
    assert here.columns == plain.columns and rows(here) == rows(plain) and here.count() == 300
    assert here._jdf.queryExecution().executedPlan().toString().count("Window") == 0


def test_contents_are_parsed_once_and_scores_ruled_out_by_bounds_only(spark):
    import random

    text = "Содержание\nМодели и методы анализа систем\nПервая статья 3\nВторая статья 7\nТретья статья 9\nЧетвёртая статья 12"
    pages = spark.createDataFrame([("a", 1, text), ("b", 1, "Содержание\nОдна статья 4"), (None, 1, text)], "source string, page_num int, text string")
    entries = contents.sane_topics(contents.toc_entries(contents.contents_lines(pages)))
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Pandas" not in plan
    got = sorted((x.source, x.seq, x.topic, x.toc_title, x.toc_page, x.no_theme) for x in entries.collect())
    first = "Модели и методы анализа систем"
    assert got == [("a", 1, first, "Первая статья", 3, False), ("a", 2, first, "Вторая статья", 7, False), ("a", 3, first, "Третья статья", 9, False), ("a", 4, first, "Четвёртая статья", 12, False), ("b", 1, "", "Одна статья", 4, True)]

    r = random.Random(6)
    titles = [" ".join(r.choice(("модель", "модели", "сеть", "анализ", "данные", "abc", "к")) for _ in range(r.randint(0, 5))) for _ in range(40)]
    for a in titles:
        for b in titles:
            exact = contents.title_score(a, b) + 0.01
            for least in (0.0, 0.3, exact, 0.9):
                told = contents._score(contents._prepared(a), contents._prepared(b), 0.01, least)
                assert told == pytest.approx(exact) if exact > least else told <= least
