"""Schemas of the tables that the engine keeps."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _of(required: tuple[str, ...] = (), **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, k not in required) for k, v in fields.items()])


_RESULT = ("id", "article_id")
_TOP = T.ArrayType(_of(rank=_I, code=_S, title=_S, match_score=_D, tfidf_similarity=_D))

SCHEMAS: dict[str, T.StructType] = {
    "articles": _of(("id", "title"), id=_L, source=_S, title=_S, annotation=_S, keywords=_S, main_text=_S, udc=_S, authors=_S, lda_tokens=T.ArrayType(_S), topic=_S),
    "lda_results": _of(_RESULT, id=_L, article_id=_L, lda_tokens=T.ArrayType(_S), lda_topic_keywords=_S),
    "clustering_results": _of(_RESULT, id=_L, article_id=_L, cluster_name=_S),
    "class_results": _of(_RESULT, id=_L, article_id=_L, embed_code=_S, embed_cosine=_D, tfidf_code=_S, tfidf_cosine=_D, is_ambiguous=_I, has_discrepancy=_I),
    "saved_classifications": _of(
        ("id", "title"), id=_L, timestamp=T.TimestampType(), title=_S, annotation=_S, keywords=_S, main_text=_S, tfidf_code=_S, tfidf_title=_S, tfidf_score=_D,
        embed_code=_S, embed_title=_S, embed_score=_D, top3=_TOP, is_ambiguous=_I, has_discrepancy=_I, notes=_S,
    ),
    "cluster_class_tfidf": _of(("cluster_name", "class_code", "article_count"), cluster_name=_S, class_code=_S, article_count=_L, percentage=_D),
    "cluster_class_embed": _of(("cluster_name", "class_code", "article_count"), cluster_name=_S, class_code=_S, article_count=_L, percentage=_D),
    "cluster_topic_matrix": _of(("cluster", "topic", "count"), cluster=_I, topic=_S, count=_L),
    "toc_entries": _of(("source", "seq"), source=_S, seq=_I, topic=_S, toc_title=_S, toc_page=_I),
    "pages_text": _of(("source", "page_num"), source=_S, page_num=_I, text=_S),
    "classes": _of(("class_idx",), class_idx=_I, code=_S, title=_S, description=_S),
}

#: Values that fill absent columns of new rows.
DEFAULTS: dict[str, dict[str, int]] = {"class_results": {"is_ambiguous": 0, "has_discrepancy": 0}, "saved_classifications": {"is_ambiguous": 0, "has_discrepancy": 0}}
#: Column of a table whose values must be unique.
UNIQUE = {"articles": "title", "lda_results": "article_id", "clustering_results": "article_id", "class_results": "article_id"}
#: Tables whose ``article_id`` must be an article's, and goes with it.
CHILDREN = ("lda_results", "clustering_results", "class_results")
