"""Class scoring: TF-IDF cosine, embedding cosine, ranks, flags and packed results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import class_code, class_title, first_sentences, weighted_text, word_tokens
from docloom.functions.vectors import dot, unit
from docloom.sources.tables import cut_lineage


@dataclass
class Settings:
    """What scoring depends on."""

    field_weights: dict[str, int] = field(default_factory=lambda: {"title": 3, "annotation": 2, "keywords": 2})
    text_chars: int = 8000
    main_text_chars: int = 3000
    sentences: int = 4
    terms: int = 40_000
    grams: int = 2
    ambiguous_gap: float = 0.02
    alternative_gap: float = 0.02
    top: int = 3
    preview_chars: int = 200


def semantic_text(s: Settings) -> Column:
    """What the encoder sees of an article."""
    return F.trim(weighted_text(s.field_weights, s.text_chars))


def tfidf_text(s: Settings) -> Column:
    """What TF-IDF sees of an article: weighted fields and the head of the main text."""
    return F.trim(F.concat_ws(" ", weighted_text(s.field_weights, s.text_chars), F.substring(F.coalesce("main_text", F.lit("")), 1, s.main_text_chars)))


def class_texts(classes: DataFrame, sentences: int | None) -> DataFrame:
    """``class_idx, class_text``: a class's name before its description, in full or its first sentences."""
    text = F.coalesce("description", F.lit("")) if sentences is None else first_sentences(F.col("description"), sentences)
    return classes.select("class_idx", F.concat_ws(". ", F.concat_ws(". ", "code", "title"), text).alias("class_text"))


def _terms(text: str, grams: int) -> Column:
    """Words of two characters or more, and pairs of successive ones if ``grams`` is 2."""
    words = word_tokens(F.col(text))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))) if grams == 2 else words


@dataclass
class TermModel:
    """Terms in ascending order with their idf, and the classes' unit vectors as postings: those of term t are
    ``classes`` and ``weights`` from ``first[t]`` to ``first[t + 1]``."""

    terms: pa.Array
    idf: np.ndarray
    names: np.ndarray
    first: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    grams: int

    def similarities(self, words: pa.ListArray) -> np.ndarray:
        """Cosine of each row's words with each class: rows by classes."""
        rows, width = len(words), len(self.names)
        doc = np.repeat(np.arange(rows), np.diff(words.offsets.to_numpy()))
        flat = words.flatten()
        places = [pc.index_in(flat, value_set=self.terms)]
        docs = [doc]
        if self.grams == 2 and len(flat) > 1:
            places.append(pc.index_in(pc.binary_join_element_wise(flat[:-1], flat[1:], " "), value_set=self.terms))
            docs.append(np.where(doc[:-1] == doc[1:], doc[:-1], -1))
        term = np.concatenate([p.fill_null(-1).to_numpy(zero_copy_only=False) for p in places]).astype(np.int64)
        doc = np.concatenate(docs)
        held = np.flatnonzero((term >= 0) & (doc >= 0))
        pair, n = np.unique(doc[held] * len(self.terms) + term[held], return_counts=True)
        doc, term = np.divmod(pair, max(1, len(self.terms)))
        w = n * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, rows))
        many = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        product = np.bincount(np.repeat(doc, many) * width + self.classes[at], np.repeat(w, many) * self.weights[at], rows * width).reshape(rows, width)
        return product / np.where(norm > 0, norm, 1.0)[:, None]


#: Words, and scores, that are held at once when documents are scored; words and documents when terms are counted.
HELD_WORDS, HELD_SCORES, COUNTED_WORDS, COUNTED_ROWS = 1 << 20, 1 << 22, 1 << 22, 1 << 16


def _held(words: pa.ListArray, most_words: int, most_rows: int = 1 << 31) -> Iterator[tuple[int, int, pa.ListArray]]:
    """Rows one after the other, with where they begin and end: so many words and rows at once, one row at least."""
    ends, at = words.offsets.to_numpy(), 0
    while at < len(words):
        to = max(at + 1, min(int(np.searchsorted(ends, ends[at] + most_words, "right")) - 1, at + most_rows))
        yield at, to, pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at], pa.int32()), words.values[ends[at] : ends[to]])
        at = to


def term_counts(words: pa.ListArray, grams: int) -> Iterator[pa.RecordBatch]:
    """``term, tf, df`` over some rows of words: occurrences of each term, and rows that have it."""
    doc = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    word, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def counted(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        both = np.sort(code * len(words) + doc)  # of at most 2 ** 44 codes and COUNTED_ROWS rows
        code = both // max(1, len(words))
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        rows = np.append(True, both[1:] != both[:-1])[: len(both)]
        df = np.add.reduceat(rows, first, dtype=np.int64) if len(first) else first
        return code[first], pa.array(np.diff(np.append(first, len(code))), pa.int64()), pa.array(df, pa.int64())

    terms, tf, df = counted(word, doc)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(terms)), tf, df], ["term", "tf", "df"])
    if grams == 2 and len(word) > 1:
        same = doc[:-1] == doc[1:]
        terms, tf, df = counted((word[:-1] * len(names) + word[1:])[same], doc[:-1][same])
        a, b = np.divmod(terms, max(1, len(names)))
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(names.take(pa.array(a)), names.take(pa.array(b)), " "), tf, df], ["term", "tf", "df"])


def term_model(docs: DataFrame, classes: DataFrame, text: str = "text", grams: int = 2, terms: int = 40_000) -> TermModel:
    """Fitted on all documents and all class texts: smoothed idf of the ``terms`` most frequent terms (ties by term).

    One pass counts occurrences and documents of each term together, combined where they lie (terms become text when their
    numbers have been counted) and again before the shuffle.  What reaches the
    driver is bounded by ``terms`` and by the classes' texts.
    """
    every = docs.select(word_tokens(F.col(text)).alias("words")).unionAll(classes.select(word_tokens(F.col("class_text")).alias("words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, part in _held(batch.column(0), COUNTED_WORDS, COUNTED_ROWS):
                yield from term_counts(part, grams)

    counts = every.mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    top = counts.orderBy(F.desc("tf"), "term").limit(terms).toArrow().sort_by("term")
    total = docs.count() + classes.count()
    idf = np.log((1 + total) / (1 + top["df"].to_numpy())) + 1
    vocabulary = top["term"].combine_chunks()
    of = classes.select("class_idx", _terms("class_text", grams).alias("t")).toArrow().sort_by("class_idx")  # the classes' texts
    names, rows = of["class_idx"].to_numpy(), []
    for i, own in enumerate(of["t"]):
        at, n = np.unique(pc.index_in(own.values, value_set=vocabulary).drop_null().to_numpy(), return_counts=True)
        w = n * idf[at]
        rows.append((at, np.full(len(at), i), w / (np.sqrt((w * w).sum()) or 1.0)))
    term, of_class, weight = (np.concatenate([r[c] for r in rows] or [np.empty(0)]) for c in range(3))
    order = np.lexsort((of_class, term))
    first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    return TermModel(vocabulary, idf, names, first, of_class[order].astype(np.int64), weight[order], grams)




def tfidf_scores(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text", grams: int = 2, terms: int = 40_000) -> DataFrame:
    """``key, class_idx, tfidf_similarity`` of every document and class; 0 where they share no term.

    The model is fitted on all documents and all class texts; its terms and the classes' weights are sent to all tasks.
    A document is scored where it lies: nothing is shuffled by document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(term_model(docs, classes, text, grams, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        width = len(model.names)
        for batch in batches if width else ():
            for at, to, part in _held(batch.column(1), HELD_WORDS, HELD_SCORES // width):
                scores = model.similarities(part)
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(at, to), width)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(model.names, to - at), pa.int32()), pa.array(scores.ravel())], [key, "class_idx", "tfidf_similarity"])

    schema = T.StructType([docs.schema[key], T.StructField("class_idx", T.IntegerType()), T.StructField("tfidf_similarity", T.DoubleType())])
    return docs.select(key, word_tokens(F.col(text)).alias("words")).mapInArrow(run, schema)


def ranked_scores(docs: DataFrame, classes: DataFrame, vectors: DataFrame, class_vectors: DataFrame, key: str = "doc_id", text: str = "text", grams: int = 2, terms: int = 40_000) -> DataFrame:
    """:func:`ranked` of every document and class, where keys are of one document each; without a vector there is no
    semantic score.

    Both ranks are made where a document's scores are, in a row of arrays a document; such rows are joined by key, and
    only then are there rows of document and class.
    """
    sent = docs.sparkSession.sparkContext.broadcast(term_model(docs, classes, text, grams, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        width = len(model.names)
        for batch in batches if width else ():
            for at, to, part in _held(batch.column(1), HELD_WORDS, HELD_SCORES // width):
                scores = model.similarities(part)
                order = np.lexsort((np.broadcast_to(-model.names, scores.shape), -scores))
                ranks = np.empty(scores.shape, np.int32)
                np.put_along_axis(ranks, order, np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), scores.shape), 1)
                ends = pa.array(np.arange(to - at + 1) * width, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((np.tile(model.names, to - at), pa.int32()), (scores.ravel(), pa.float64()), (ranks.ravel(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *lists], [key, "class_idx", "tfidf_similarity", "rank_tfidf"])

    kinds = {"class_idx": T.IntegerType(), "tfidf_similarity": T.DoubleType(), "rank_tfidf": T.IntegerType()}
    schema = T.StructType([docs.schema[key], *[T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()]])
    own = docs.select(key, word_tokens(F.col(text)).alias("words")).mapInArrow(run, schema)
    many = class_vectors.join(F.broadcast(classes.select("class_idx")), "class_idx", "left_semi").agg(F.collect_list(F.struct("class_idx", unit(F.col("embedding")).alias("c"))).alias("cs"))
    scored = vectors.select(key, unit(F.col("embedding")).alias("v")).join(F.broadcast(many))
    in_order = F.sort_array(F.transform("cs", lambda c: F.struct(dot(F.col("v"), c["c"]).alias("match_score"), c["class_idx"].alias("class_idx"))), asc=False)
    semantic = scored.select(key, in_order.alias("o"))
    rank = F.transform("o", lambda x, i: F.struct(x["match_score"].alias("match_score"), F.when(x["match_score"].isNotNull(), i + 1).alias("rank_semantic")))
    semantic = semantic.select(key, F.map_from_arrays(F.transform("o", lambda x: x["class_idx"]), rank).alias("of"))
    rows = own.join(semantic, key, "left").select(key, "of", F.explode(F.arrays_zip(*kinds)).alias("x")).select(key, "of", "x.*")
    found = F.try_element_at("of", F.col("class_idx"))
    return rows.select(key, "class_idx", "tfidf_similarity", found["match_score"].alias("match_score"), found["rank_semantic"].alias("rank_semantic"), "rank_tfidf")


def embedding_scores(vectors: DataFrame, class_vectors: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``key, class_idx, match_score``: cosine of each vector with each class's (few, so they are broadcast)."""
    own = vectors.select(key, unit(F.col(vector)).alias("v"))
    many = F.broadcast(class_vectors.agg(F.collect_list(F.struct("class_idx", unit(F.col(vector)).alias("c"))).alias("cs")))
    pairs = own.join(many).select(key, "v", F.explode("cs").alias("c"))
    return pairs.select(key, F.col("c.class_idx").alias("class_idx"), dot(F.col("v"), F.col("c.c")).alias("match_score"))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """``class_idx`` and mean vector of each label."""
    at = vectors.select(F.col(label).cast("int").alias("class_idx"), F.posexplode(vector).alias("i", "x"))
    means = at.groupBy("class_idx", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("class_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias(vector))


def ranked(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores with ``rank_semantic`` and ``rank_tfidf``, from 1; of equal scores the later class comes first.  A class
    without a score by a method has no rank by it."""
    def rank(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(c), F.desc("class_idx"))))

    return scores.withColumns({"rank_semantic": rank("match_score"), "rank_tfidf": rank("tfidf_similarity")})


def flags(ranks: DataFrame, s: Settings | None = None, key: str = "doc_id", scores: bool = False) -> DataFrame:
    """One row per document: top classes of both methods, gaps, ambiguity, disagreement, alternative, and message.

    Of a document without semantic scores what depends on them is null.  With ``scores`` there is also the best score by
    TF-IDF, ``tfidf_cosine``.
    """
    s = s or Settings()
    at = lambda rank, c, k: F.max(F.when(F.col(rank) == k, F.col(c)))
    one = ranks.groupBy(key).agg(
        at("rank_semantic", "class_idx", 1).alias("semantic_top1"), at("rank_tfidf", "class_idx", 1).alias("tfidf_top1"),
        F.when(at("rank_semantic", "match_score", 1).isNotNull(), F.coalesce(at("rank_semantic", "match_score", 1) - at("rank_semantic", "match_score", 2), F.lit(1.0))).alias("ambiguous_gap"),
        F.coalesce(at("rank_tfidf", "tfidf_similarity", 1) - at("rank_tfidf", "tfidf_similarity", 2), F.lit(0.0)).alias("tfidf_gap"),
        F.round(at("rank_tfidf", "tfidf_similarity", 1), 4).alias("tfidf_cosine"),
    )
    ambiguous, differs = F.col("ambiguous_gap") < s.ambiguous_gap, F.col("semantic_top1") != F.col("tfidf_top1")
    alternative = F.when(differs & (F.col("tfidf_gap") >= s.alternative_gap), F.col("tfidf_top1"))
    kind = (
        F.when(alternative.isNotNull() & ambiguous, "suggestion+ambiguous").when(alternative.isNotNull(), "suggestion").when(ambiguous, "ambiguous").otherwise("")
    )
    return one.select(key, "semantic_top1", "tfidf_top1", F.round("ambiguous_gap", 4).alias("ambiguous_gap"), ambiguous.alias("ambiguous"), differs.alias("discrepancy"), alternative.alias("tfidf_alternative"), kind.alias("message"), *(["tfidf_cosine"] if scores else []))


def top_classes(ranks: DataFrame, classes: DataFrame | None = None, top: int = 3, key: str = "doc_id") -> DataFrame:
    """``key, top3``: array of (rank, class_idx, match_score, tfidf_similarity) by rounded score, then class."""
    score = F.round("match_score", 4)
    place = F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), "class_idx"))
    rows = ranks.withColumn("place", place).where(F.col("place") <= top)
    item = F.struct(F.col("place").alias("rank"), "class_idx", score.alias("match_score"), F.round("tfidf_similarity", 4).alias("tfidf_similarity"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("top3"))


def classify(articles: DataFrame, class_docs: DataFrame, vectors: DataFrame, class_vectors: DataFrame, key: str = "doc_id", text: str = "text", s: Settings | None = None) -> DataFrame:
    """Flags and top classes of every document with a vector: one row each, TF-IDF fitted on exactly these documents."""
    s = s or Settings()
    semantic = embedding_scores(vectors, class_vectors, key)
    scored = tfidf_scores(articles, class_docs, key, text, s.grams, s.terms).join(semantic, [key, "class_idx"])
    ranks = ranked(scored, key)
    ranks = cut_lineage(ranks)
    return flags(ranks, s, key, scores=True).join(top_classes(ranks, top=s.top, key=key), key)


def result_rows(classified: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows for the table of class results: codes and scores of both methods, and the flags as 0 or 1."""
    named = classes.select("class_idx", class_code(F.col("code")).alias("code"), class_title(F.col("title")).alias("title"))
    first = classified.select(key, "semantic_top1", "tfidf_top1", "ambiguous", "discrepancy", F.col("top3")[0]["match_score"].alias("embed_cosine"), "tfidf_cosine")
    e, t = named.select(F.col("class_idx").alias("semantic_top1"), F.col("code").alias("embed_code")), named.select(F.col("class_idx").alias("tfidf_top1"), F.col("code").alias("tfidf_code"))
    out = first.join(F.broadcast(e), "semantic_top1").join(F.broadcast(t), "tfidf_top1")
    return out.select(F.col(key).alias("article_id"), "embed_code", "embed_cosine", "tfidf_code", "tfidf_cosine", F.col("ambiguous").cast("int").alias("is_ambiguous"), F.col("discrepancy").cast("int").alias("has_discrepancy"))
