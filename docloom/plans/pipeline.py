"""The whole run over a store: articles, topics, clusters, classes, distributions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import articles, clusters, contents, phrases, relations, reports, scoring, topics
from docloom.operators.store import Store

#: Text to vector column: ``encode(df, text_column) -> df`` with a column ``embedding``.
Encoder = Callable[[DataFrame, str], DataFrame]


@dataclass
class Options:
    topic_counts: range = field(default_factory=lambda: range(4, 21))
    least_clusters: int = 5
    most_clusters: int = 50
    defined_only: bool = True  # classify only articles with a defined topic
    settings: scoring.Settings = field(default_factory=scoring.Settings)


def add_articles(store: Store, pages: DataFrame) -> dict[str, int]:
    """Parse page texts, match topics with the tables of contents, and insert."""
    rows = articles.parse_articles(pages).persist()
    entries = contents.sane_topics(contents.toc_entries(contents.contents_lines(pages)))
    topic = contents.match_topics(rows, entries)
    full = rows.join(topic.select("source", "seq", "topic"), ["source", "seq"]).withColumn("order", F.struct("source", "seq"))
    return store.insert("articles", full, "order")


def model_topics(store: Store, options: Options) -> topics.TopicModel:
    """Topics of all articles with enough tokens; replaces the topic results."""
    docs = phrases.mined(topics.prepared(store.read("articles").select("id", F.col("lda_tokens").alias("tokens"))), "id")
    model = topics.fit(docs, options.topic_counts)
    found = topics.dominant_topics(model, docs, "id").join(docs, "id")
    store.replace("lda_results", found.select("id", F.col("id").alias("article_id"), F.col("tokens").alias("lda_tokens"), F.col("keywords").alias("lda_topic_keywords")))
    return model


def cluster(store: Store, encode: Encoder, options: Options) -> tuple[str, int, float]:
    """Clusters by the best text view, named by topics; replaces the cluster results.

    All views are compared over the same articles: those of which any view has text.
    """
    defined, _ = relations.defined_topics(store.read("articles"))
    texts = defined.select("id", "topic", *[text.alias(name) for name, text in text_views().items()])
    texts = texts.where(F.greatest(*[F.char_length(F.regexp_replace(name, r"(?U)[\s.]", "")) for name in text_views()]) > 0)
    views = {name: encode(texts.select("id", "topic", F.col(name).alias("view")), "view").persist() for name in text_views()}
    view, k, score = clusters.select_view(views, options.least_clusters, options.most_clusters)
    labelled = clusters.kmeans(views[view], k, starts=20)
    named = labelled.join(F.broadcast(clusters.cluster_names(labelled)), "cluster")
    store.replace("clustering_results", named.select("id", F.col("id").alias("article_id"), F.col("name").alias("cluster_name")))
    for kept in views.values():
        kept.unpersist()
    return view, k, score


def text_views(most: int = 9000) -> dict[str, object]:
    """Three texts of an article: title, annotation and keywords; main text; tokens."""
    from docloom.functions.text import squeeze

    title, annotation, keywords = (squeeze(F.col(c)) for c in ("title", "annotation", "keywords"))
    return {
        "title_ann_kw": squeeze(F.concat(title, F.lit(". "), annotation, F.lit(". "), keywords, F.lit("."))),
        "title_ann_kw_mt": F.substring(squeeze(F.col("main_text")), 1, most),
        "title_ann_kw_ct": F.substring(F.array_join("lda_tokens", " "), 1, most),
    }


def classify(store: Store, classes: DataFrame, encode: Encoder, options: Options) -> None:
    """Class results of the articles; replaces them."""
    s = options.settings
    rows = store.read("articles")
    if options.defined_only:
        rows, _ = relations.defined_topics(rows)
    texts = rows.select("id", scoring.tfidf_text(s).alias("text"), scoring.semantic_text(s).alias("semantic"))
    vectors = encode(texts.select("id", "semantic"), "semantic")
    class_vectors = encode(scoring.class_texts(classes, s.sentences), "class_text")
    found = scoring.classify(texts, scoring.class_texts(classes, None), vectors, class_vectors, "id", "text", s)
    out = scoring.result_rows(found, classes, "id")
    store.replace("class_results", out.withColumn("id", F.col("article_id")))


def distributions(store: Store) -> None:
    """How classes by either method are spread over clusters; replaces both tables."""
    groups, results = store.read("clustering_results"), store.read("class_results")
    for method in ("tfidf", "embed"):
        store.replace(f"cluster_class_{method}", reports.cluster_class_distribution(groups, results, f"{method}_code"))


def hashing_encoder(width: int = 256) -> Encoder:
    """An encoder without a model: hashed words, at unit length."""
    from docloom.functions.text import word_tokens
    from docloom.functions.vectors import unit

    def encode(df: DataFrame, text: str) -> DataFrame:
        bins = F.transform(word_tokens(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(F.col("__bins"), lambda b: b == i)).cast("double"))
        return df.withColumn("__bins", bins).withColumn("embedding", unit(counts)).drop("__bins")

    return encode


def run(store: Store, pages: DataFrame | None, classes: DataFrame, encode: Encoder | None = None, options: Options | None = None) -> dict[str, object]:
    """All steps in order; ``pages`` None uses the articles that are stored."""
    encode, options = encode or hashing_encoder(), options or Options()
    store.create()
    out: dict[str, object] = {}
    if pages is not None:
        out["articles"] = add_articles(store, pages)
    out["topics"] = model_topics(store, options).info()
    out["clusters"] = cluster(store, encode, options)
    classify(store, classes, encode, options)
    distributions(store)
    out["flags"] = reports.flag_rates(store.read("class_results"), "is_ambiguous", "has_discrepancy").first().asDict()
    return out
