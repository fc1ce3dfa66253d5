"""All queries of the library over the test tables, with their SQL for DuckDB.

The tables stand for the engine's own: customers' segments for clusters, orders' priorities and states for classes by
two methods, documents for articles, benchmark items for class descriptions, labels for flags, events for saved
classifications, conversations for ordered pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import articles, clusters, contents, phrases, relations, reports, scoring, store, topics
from docloom.plans import pipeline
from docloom.sources import html
from docloom.sources.tables import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- reports -------------------------------------------------------------------------------------------------------

PAIRS_SQL = "select c_mktsegment as cluster_name, o_orderpriority as class_code from customer join orders on c_custkey = o_custkey where o_orderpriority is not null"
DISTRIBUTION_SQL = f"""with p as ({PAIRS_SQL}), d as (select cluster_name, class_code, count(*) as article_count from p group by 1, 2),
dist as (select *, article_count::double / sum(article_count) over (partition by cluster_name) * 100 as percentage from d)"""


def _distribution(spark: SparkSession, d: str, code: str = "o_orderpriority") -> DataFrame:
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("article_id"), F.col("c_mktsegment").alias("cluster_name"))
    classes = table(spark, d, "orders").select(F.col("o_custkey").alias("article_id"), code)
    return reports.cluster_class_distribution(groups, classes, code)


@query(f"{DISTRIBUTION_SQL} select * from dist")
def cluster_class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.of_cluster(_distribution(spark, d))


@query(f"{DISTRIBUTION_SQL} select * from dist where cluster_name = 'BUILDING'")
def one_cluster_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.of_cluster(_distribution(spark, d), "BUILDING")


@query(f"{DISTRIBUTION_SQL} select class_code, count(distinct cluster_name) as cluster_count, sum(article_count)::bigint as total_articles from dist group by 1")
def class_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.of_class(_distribution(spark, d))


@query(f"{DISTRIBUTION_SQL} select * from dist where class_code = '1-URGENT'")
def one_class_clusters(spark: SparkSession, d: str) -> DataFrame:
    return reports.of_class(_distribution(spark, d), "1-URGENT")


@query(f"{DISTRIBUTION_SQL} select cluster_name, count(distinct class_code) as class_count, sum(article_count)::bigint as total_articles from dist group by 1")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.cluster_summary(_distribution(spark, d))


@query(f"{DISTRIBUTION_SQL} select * from (select *, (row_number() over (partition by cluster_name order by article_count desc, class_code))::int as rank from dist) where rank <= 3")
def top3_class_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_classes(_distribution(spark, d))


@query(
    f"""{DISTRIBUTION_SQL}, q as (select c_mktsegment as cluster_name, o_orderstatus as class_code, count(*) as article_count from customer join orders on c_custkey = o_custkey where o_orderstatus is not null group by 1, 2)
select *, 'tfidf' as method from dist union all select *, article_count::double / sum(article_count) over (partition by cluster_name) * 100, 'embed' from q"""
)
def method_comparison_union(spark: SparkSession, d: str) -> DataFrame:
    return reports.compare_methods(_distribution(spark, d), _distribution(spark, d, "o_orderstatus"))


SAVED_SQL = "select event_id as id, ts as timestamp, event_type as tfidf_code, event_type as embed_code, user_id from events"


def _saved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("tfidf_code"), F.col("event_type").alias("embed_code"),
        F.concat(F.lit("t-"), F.col("event_type")).alias("tfidf_title"), (F.col("value") > 100).cast("int").alias("is_ambiguous"), (F.col("user_id") % 7 == 0).cast("int").alias("has_discrepancy"),
    )


@query("select event_id as id, ts as timestamp, event_type as tfidf_code from events where event_type = 'click' order by ts desc, event_id desc limit 100")
def saved_recent_filtered(spark: SparkSession, d: str) -> DataFrame:
    return reports.saved_list(_saved(spark, d), 100, "click").select("id", "timestamp", "tfidf_code")


@query("select count(*) as total, coalesce(sum((value > 100)::int), 0)::bigint as ambiguous, coalesce(sum((user_id % 7 = 0)::int), 0)::bigint as discrepancy from events")
def saved_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reports.saved_totals(_saved(spark, d))


@query("select event_type as tfidf_code, 't-' || event_type as tfidf_title, count(*) as count from events where event_type is not null group by 1, 2 order by count desc, 1 limit 5")
def saved_top5_codes(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_codes(_saved(spark, d), "tfidf_code", "tfidf_title")


@query(
    """select sum(coalesce(quality, 0))::bigint as quality_count, avg(coalesce(quality, 0)::double) * 100 as quality_percent,
  sum(coalesce(toxic, 0))::bigint as toxic_count, avg(coalesce(toxic, 0)::double) * 100 as toxic_percent from labels"""
)
def flag_rates(spark: SparkSession, d: str) -> DataFrame:
    return reports.flag_rates(table(spark, d, "labels"), "quality", "toxic")


# --- lookups, joins, storage ---------------------------------------------------------------------------------------

ARTICLES_SQL = "select doc_id as id, source, split_part(text, '.', 1) as title, text as main_text, lang as topic from documents"


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "source", F.substring_index(F.col("text"), ".", 1).alias("title"), F.col("text").alias("main_text"), F.col("lang").alias("topic")
    )


@query("select count(*) as rows, count(distinct lang) as topics from documents")
def sanity_counts(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).agg(F.count("*").alias("rows"), F.countDistinct("topic").alias("topics"))


@query("select doc_id as id, source, lang as topic from documents where doc_id = 7")
def lookup_by_id(spark: SparkSession, d: str) -> DataFrame:
    return relations.by_key(_articles(spark, d), "id", 7).select("id", "source", "topic")


@query(f"with a as ({ARTICLES_SQL}) select id, source from a where title = (select min(title) from a)")
def lookup_by_title(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d)
    return relations.by_key(rows, "title", rows.agg(F.min("title")).first()[0]).select("id", "source")


@query(f"with a as ({ARTICLES_SQL}) select id, source from a where trim(title, ' \t\n') = (select trim(max(title), ' \t\n') from a) order by id limit 1")
def find_article_trimmed(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d)
    return relations.find_by_title(rows, f"  {rows.agg(F.max('title')).first()[0]} ", "id").select("id", "source")


@query("select doc_id as id, source from documents order by doc_id limit 1 offset 12")
def find_article_by_index(spark: SparkSession, d: str) -> DataFrame:
    return relations.find_by_index(_articles(spark, d), 12, "id").select("id", "source")


@query("select d.doc_id as id, d.source, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id")
def documents_left_labels(spark: SparkSession, d: str) -> DataFrame:
    return relations.left_columns(_articles(spark, d).select("id", "source"), table(spark, d, "labels"), "id", "doc_id", ["quality", "toxic"])


@query("select d.doc_id as id, d.source, e.label from documents d left join embeddings e on e.vec_id = d.doc_id")
def documents_left_cluster(spark: SparkSession, d: str) -> DataFrame:
    return relations.left_columns(_articles(spark, d).select("id", "source"), table(spark, d, "embeddings"), "id", "vec_id", ["label"])


@query("select c_custkey, c_name from customer where c_custkey in (select distinct o_custkey from orders where o_orderpriority like '%URGENT%')")
def semi_join_in_distinct(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority").like("%URGENT%")).select(F.col("o_custkey").alias("c_custkey"))
    return relations.cascade(table(spark, d, "customer"), urgent, "c_custkey", "c_custkey").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    return relations.missing_parents(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey left join nation on n_nationkey = c_nationkey where o_totalprice > 100000")
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").where("o_totalprice > 100000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relations.left_columns(joined, table(spark, d, "nation"), "c_nationkey", "n_nationkey", ["n_name"]).select("o_orderkey", "c_name", "n_name")


@query("select min(doc_id) as id, text from documents where text is not null and text not in (select text from benchmark) group by text")
def insert_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return relations.new_rows(batch, table(spark, d, "benchmark"), "text", ["id"])


@query("select doc_id, case when doc_id = 5 then 'changed' else source end as source, lang from documents")
def update_copy_on_write(spark: SparkSession, d: str) -> DataFrame:
    return store.updated(table(spark, d, "documents"), 5, {"source": "changed"}, "doc_id").select("doc_id", "source", "lang")


@query("select doc_id, source from documents where doc_id <> 5")
def delete_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("doc_id") != 5).select("doc_id", "source")


@query("select * from labels where doc_id in (select doc_id from documents where lang = 'en')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return relations.cascade(table(spark, d, "labels"), table(spark, d, "documents").where("lang = 'en'"), "doc_id", "doc_id").select("doc_id", "quality", "toxic")


@query("select * from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return relations.missing_parents(table(spark, d, "labels"), table(spark, d, "documents").where("lang = 'en'"), "doc_id", "doc_id").select("doc_id", "quality", "toxic")


@query("select coalesce(nullif(trim(lang), ''), 'null') as reason, count(*) as removed from documents where lang is null or trim(lang) = '' or lang in ('de', 'fr') group by 1")
def filter_undefined_topic(spark: SparkSession, d: str) -> DataFrame:
    return relations.defined_topics(table(spark, d, "documents"), "lang", ("de", "fr"))[1]


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def json_extract_top1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("select event_id, (coalesce(try_cast(json_extract_string(props, '$.k') as double), 0) <> 0)::int as k_flag, 0::int as missing_flag from events")
def json_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.json_flag(F.col("props"), "$.k").alias("k_flag"), V.json_flag(F.col("props"), "$.none").alias("missing_flag"))


@query(
    """with f as (select l_orderkey, min(struct_pack(code := l_partkey::varchar, score := l_discount)) as m from lineitem where l_linenumber = 1 group by 1)
select o_orderkey, coalesce(m.code, '') as code, coalesce(m.score, 0.0) as score from orders left join f on l_orderkey = o_orderkey"""
)
def json_top_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines packed as JSON, and the one of rank 1 read back."""
    item = F.struct(F.col("l_partkey").cast("string").alias("code"), F.col("l_discount").alias("match_score"), F.col("l_linenumber").alias("rank_tfidf"))
    packed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(V.items_json(F.array_sort(F.collect_list(item))).alias("json"))
    top = V.top_by_rank(F.col("json"))
    return table(spark, d, "orders").select("o_orderkey").join(packed, "o_orderkey", "left").select("o_orderkey", top["code"].alias("code"), top["score"].alias("score"))


@query(f"select * from ({SAVED_SQL}) where id = 7")
def saved_by_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("tfidf_code"), F.col("event_type").alias("embed_code"), "user_id")
    return relations.by_key(rows, "id", 7)


@query(
    """with r as (select *, lag(role) over (partition by conv_id order by turn) as before from conversations where role is not null and trim(role) <> '' and turn <> 0)
select conv_id, turn, role from r where before is null or before <> role"""
)
def change_points(spark: SparkSession, d: str) -> DataFrame:
    return relations.change_points(table(spark, d, "conversations"), "conv_id", ["turn"], "role", "turn").select("conv_id", "turn", "role")


@query(
    """with p as (select user_id as k, ts, min(event_type) as topic from events group by 1, 2),
f as (select k, arg_min(topic, ts) as first from p group by 1)
select o.o_orderkey, coalesce(p.topic, f.first) as topic from orders o asof left join p on o.o_custkey = p.k and o.o_orderdate >= p.ts left join f on f.k = o.o_custkey"""
)
def asof_topic(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").groupBy(F.col("user_id").alias("k"), "ts").agg(F.min("event_type").alias("topic"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderdate")
    return relations.as_of(rows, points, "k", "o_orderdate", "ts", "topic").select("o_orderkey", "topic")


@query("select label as cluster, lang as topic, count(*) as count from embeddings join documents on vec_id = doc_id group by 1, 2")
def cluster_topic_matrix(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("label").alias("cluster"), F.col("lang").alias("topic"))
    return relations.cluster_topic_matrix(both, "cluster", "topic")


# --- text ----------------------------------------------------------------------------------------------------------

WORD = "[\\p{L}\\p{N}_]"


@query("select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x{00A0}\\x{0085}\\x{2028}\\x{2029}]+', ' ', 'g'), ' ')) as clean from documents")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("clean"))


@query(
    """with a as (select doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x{E000}-\\x{F8FF}]', ' ', 'g'), '(?m)^[ \\t]*\\d+[ \\t]*$', '', 'g'), chr(10)) as l from documents)
select doc_id, md5(trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)),
  '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s.,;:!?()\\-«»"''/\\\\]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) as clean from a"""
)
def clean_main_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_main_text(F.col("text"))).alias("clean"))


@query(
    """with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
select doc_id, count(*) as lines, count(*) filter (length(trim(line, ' ' || chr(9) || chr(13))) < 5 or regexp_matches(lower(line), 'issn|doi|@|orcid|journal|copyright')) as garbage from l group by 1"""
)
def garbage_line_flags(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(X.text_or_empty(F.col("text")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.is_garbage_line(F.col("line"))).alias("garbage"))


@query("select p_partkey, case when trim(p_name) = '' or p_name is null then 'N/A' when regexp_matches(trim(p_name), '^\\d') then regexp_extract(trim(p_name), '^(\\d+)', 1) else trim(p_name) end as code, regexp_extract(o_code, '^(\\d+)', 1) as digits from (select *, p_size || '.' || p_type as o_code from part)")
def parse_leading_code(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return parts.select("p_partkey", X.leading_code(F.col("p_name")).alias("code"), X.leading_code(F.concat_ws(".", F.col("p_size").cast("string"), "p_type")).alias("digits"))


@query("select doc_id from documents where length(text) >= 1000 and len(string_split_regex(trim(text, ' '), '\\s+')) >= 120 and split_part(text, '.', 1) <> ''")
def accept_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.char_length("text") >= articles.LEAST_CHARS).withColumns({"title": F.substring_index("text", ".", 1), "main_text": F.col("text"), "annotation": F.lit("a"), "keywords": F.lit("k")})
    return articles.accepted(rows).select("doc_id")


@query("select doc_id, length(coalesce(split_part(text, '.', 1), '')) + length(coalesce(source, '')) >= 30 and coalesce(split_part(text, '.', 1), '') <> '' as is_valid_input from documents")
def input_validation(spark: SparkSession, d: str) -> DataFrame:
    title = X.text_or_empty(F.substring_index("text", ".", 1))
    return table(spark, d, "documents").select("doc_id", ((F.char_length(title) + F.char_length(X.text_or_empty(F.col("source"))) >= 30) & (title != "")).alias("is_valid_input"))


@query(
    f"""with a as ({ARTICLES_SQL}), t as (select id, trim(coalesce(title, ''), ' ' || chr(9) || chr(10) || chr(13)) as title, trim(coalesce(source, '')) as source from a)
select id, md5(substr(concat_ws(' ', case when title <> '' then repeat(title || ' ', 3) end, case when source <> '' then repeat(source || ' ', 2) end), 1, 8000)) as weighted from t"""
)
def weighted_article_text(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", F.md5(X.weighted_text({"title": 3, "source": 2})).alias("weighted"))


@query("select item_id, array_to_string(string_split(coalesce(text, ''), '. ')[1:4], '. ') as short from benchmark")
def class_short_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.first_sentences(F.col("text")).alias("short"))


@query(f"select doc_id, len(w) as tokens, len(list_distinct(w)) as different from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}{{2,}}') as w from documents)")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    w = X.word_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("different"))


@query(f"select doc_id, least(len(w), 800) as used from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}{{2,}}') as w from documents) where len(w) > 20")
def token_filter_len(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", X.word_tokens(F.col("text")).alias("tokens"))
    return topics.prepared(docs, most=topics.MOST_TOKENS).select("doc_id", F.size("tokens").cast("long").alias("used"))


LINKS_SQL = """with h as (select page_id, url, regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) as l from pages),
e as (select page_id, url, unnest(l) as href, unnest(range(len(l)))::int as pos from h),
r as (select page_id, pos, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when href like '//%' then regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href
  when href like '/%' then regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href when href = '' or regexp_matches(href, '^[?#]') then regexp_replace(url, '[?#].*$', '') || href
  else regexp_replace(case when regexp_replace(url, '[?#].*$', '') = regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) then url || '/' else regexp_replace(url, '[?#].*$', '') end, '[^/]*$', '') || href end as link from e)"""


@query(f"{LINKS_SQL} select page_id, link, min(pos) as pos from r group by 1, 2")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return html.links(table(spark, d, "pages"))


@query(f"{LINKS_SQL} select page_id, count(distinct link) as links from r where link like '%e' group by 1")
def html_links_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    return html.links(table(spark, d, "pages"), "e").groupBy("page_id").agg(F.count("*").alias("links"))


@query()
def html_next_page(spark: SparkSession, d: str) -> DataFrame:
    return html.next_pages(table(spark, d, "pages"))


@query(
    """with c as (select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn) as t from conversations group by 1)
select conv_id, unnest(range(len(p)))::int as seq, md5(unnest(p)) as piece from (select conv_id, string_split(t, chr(10)) as p from c)"""
)
def ordered_concat_split(spark: SparkSession, d: str) -> DataFrame:
    whole = articles.ordered_text(table(spark, d, "conversations"), "conv_id", "turn", marks=False)
    return whole.select("conv_id", F.posexplode(F.split("text", "\n")).alias("seq", "piece")).withColumn("piece", F.md5("piece"))


SQUEEZE_SQL = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x0B\\x{{00A0}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'), ' ')"


@query(
    f"""with a as (select doc_id, {SQUEEZE_SQL.format("split_part(text, '.', 1)")} as t, {SQUEEZE_SQL.format("source")} as s, {SQUEEZE_SQL.format("lang")} as l, {SQUEEZE_SQL.format("text")} as m from documents),
t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}{{2,}}') as w from documents)
select doc_id, md5(trim(t || '. ' || s || '. ' || l || '.', ' ')) as title_ann_kw, md5(substr(m, 1, 9000)) as title_ann_kw_mt, md5(substr(coalesce(array_to_string(w, ' '), ''), 1, 9000)) as title_ann_kw_ct from a join t using (doc_id)"""
)
def text_views(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        "doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("source").alias("annotation"), F.col("lang").alias("keywords"), F.col("text").alias("main_text"), X.word_tokens(F.col("text")).alias("lda_tokens")
    )
    return rows.select("doc_id", *[F.md5(view).alias(name) for name, view in pipeline.text_views().items()])


@query(
    r"""select doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(replace(lower(coalesce(split_part(text, '.', 1), '')), 'ё', 'е'), '[^0-9a-zа-я\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3), ' ') as tokens from documents"""
)
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(X.title_tokens(F.substring_index("text", ".", 1)), " ").alias("tokens"))


@query(
    f"""select doc_id, md5({SQUEEZE_SQL.format("regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s]', ' ', 'g')")}) as words, substr(coalesce(text, ''), 1, 120) as head from documents"""
)
def plain_words(spark: SparkSession, d: str) -> DataFrame:
    """A text's words for comparison, and its head for display."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.plain_words(F.col("text"))).alias("words"), X.preview(F.col("text")).alias("head"))


# --- phrases and dictionaries --------------------------------------------------------------------------------------

TOKENS_SQL = f"t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}{{2,}}') as w from documents)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.word_tokens(F.col("text")).alias("tokens"))


@query(
    f"""with {TOKENS_SQL}, u as (select unnest(w) as w from t), n as (select w, count(*) as n from u group by 1),
q as (select w[i] as a, w[i + 1] as b from (select w, unnest(range(1, len(w))) as i from t)), p as (select a, b, count(*) as n from q group by 1, 2),
v as (select (select count(*) from n) + (select count(*) from p) as v)
select a, b, n, round(score, 2) as score from (select p.a, p.b, p.n, (p.n - 5)::double / x.n / y.n * v as score from p join n x on x.w = a join n y on y.w = b, v where p.n > 5) where score > 20"""
)
def phrase_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return phrases.phrase_scores(_tokens(spark, d)).withColumn("score", F.round("score", 2))


@query()
def phrase_merge_docs(spark: SparkSession, d: str) -> DataFrame:
    return phrases.mined(_tokens(spark, d), "doc_id").select("doc_id", F.size("tokens").alias("tokens"), F.size(F.filter("tokens", lambda w: w.contains("_"))).alias("joined"))


DICTIONARY_SQL = f"""with {TOKENS_SQL}, f as (select w as term, count(*) as df from (select unnest(list_distinct(w)) as w from t) group by 1),
dict as (select row_number() over (order by df desc, term collate "binary") - 1 as term_id, term, df from f where df >= 5 and df <= 0.6 * (select count(*) from t) order by df desc, term collate "binary" limit 20000)"""


@query(f"{DICTIONARY_SQL} select term_id::int as term_id, term, df from dict")
def dictionary_filter_extremes(spark: SparkSession, d: str) -> DataFrame:
    return phrases.dictionary(_tokens(spark, d))


@query(f"{DICTIONARY_SQL} select doc_id, term_id::int as term_id, count(*) as n from (select doc_id, unnest(w) as term from t) join dict using (term) group by 1, 2")
def bag_of_words(spark: SparkSession, d: str) -> DataFrame:
    docs = _tokens(spark, d)
    return phrases.bag_of_words(docs, phrases.dictionary(docs), "doc_id")


# --- class scoring -------------------------------------------------------------------------------------------------


def _class_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("class_idx"), F.col("text").alias("class_text"))


def _tfidf_sql(grams: int, docs: str = "documents", classes: str = "benchmark") -> str:
    pair = "union all select u, w[i] || ' ' || w[i + 1] from (select u, w, unnest(range(1, len(w))) as i from tok)" if grams == 2 else ""
    return f"""tok as (select 'd' || doc_id as u, regexp_extract_all(lower(coalesce(text, '')), '{WORD}{{2,}}') as w from {docs}
  union all select 'c' || item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}{{2,}}') from {classes}),
g as (select u, unnest(w) as term from tok {pair}), tf as (select u, term, count(*) as n from g group by 1, 2), nn as (select count(*) as total from tok),
st as (select term, count(*) as df, sum(n) as tfs from tf group by 1 order by tfs desc, term collate "binary" limit 40000),
wt as (select u, term, n * (ln((1 + total) / (1 + df)::double) + 1) as w from tf join st using (term), nn),
nm as (select u, sqrt(sum(w * w)) as norm from wt group by 1), cl as (select u, term, w / norm as cw from wt join nm using (u) where u like 'c%'),
sh as (select wt.u, cl.u as c, sum(w * cw) / any_value(norm) as s from wt join cl using (term) join nm on nm.u = wt.u where wt.u like 'd%' group by 1, 2),
tfidf as (select doc_id, item_id::int as class_idx, coalesce(s, 0.0) as tfidf_similarity from {docs} cross join {classes} left join sh on sh.u = 'd' || doc_id and sh.c = 'c' || item_id)"""


@query(f"with {_tfidf_sql(1)} select doc_id, class_idx, round(tfidf_similarity, 5) as tfidf_similarity from tfidf")
def tfidf_similarity_unigram(spark: SparkSession, d: str) -> DataFrame:
    return scoring.tfidf_scores(table(spark, d, "documents"), _class_docs(spark, d), grams=1).withColumn("tfidf_similarity", F.round("tfidf_similarity", 5))


@query(f"with {_tfidf_sql(2)} select doc_id, class_idx, round(tfidf_similarity, 5) as tfidf_similarity from tfidf")
def tfidf_similarity_bigram(spark: SparkSession, d: str) -> DataFrame:
    return scoring.tfidf_scores(table(spark, d, "documents"), _class_docs(spark, d)).withColumn("tfidf_similarity", F.round("tfidf_similarity", 5))


EMBEDDING_SQL = """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
un as (select vec_id, label, case when list_dot_product(e, e) = 0 then e else list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) end as e from v),
cm as (select label, i, avg(x) as x from (select label, unnest(e) as x, unnest(range(len(e))) as i from v) group by 1, 2),
ce as (select label, list(x order by i) as e from cm group by 1),
cu as (select label::int as class_idx, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as c from ce),
sem as (select vec_id as doc_id, class_idx, list_dot_product(un.e, cu.c) as match_score from un cross join cu)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")


@query(f"with {EMBEDDING_SQL} select doc_id, class_idx, round(match_score, 5) as match_score from sem")
def embedding_class_scores(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return scoring.embedding_scores(vectors, scoring.centroids(vectors)).withColumn("match_score", F.round("match_score", 5))


@query(f"with {EMBEDDING_SQL} select vec_id as doc_id, i::int as i, round(x, 6) as x from (select vec_id, unnest(e) as x, unnest(range(len(e))) as i from un)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("doc_id", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)), 6) as similarity
from embeddings a join (select label, vec_id, embedding from embeddings where vec_id in (select min(vec_id) from embeddings group by label)) b on a.label = b.label"""
)
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the first one of its label."""
    vectors = table(spark, d, "embeddings")
    first = vectors.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("f"))
    return vectors.join(first, "label").select(F.col("vec_id").alias("a"), F.col("f.vec_id").alias("b"), F.round(V.cosine(F.col("embedding"), F.col("f.embedding")), 6).alias("similarity"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over all documents and classes; where no vector is given, there is no semantic score."""
    vectors = _vectors(spark, d)
    return scoring.ranked_scores(table(spark, d, "documents"), _class_docs(spark, d), vectors, scoring.centroids(vectors))


FLAGS_SQL = f"""with {EMBEDDING_SQL}, {_tfidf_sql(2)}, scored as (select doc_id, class_idx, match_score, tfidf_similarity from tfidf left join sem using (doc_id, class_idx)),
rk as (select *, case when match_score is not null then row_number() over (partition by doc_id order by match_score desc nulls last, class_idx desc) end as rs, row_number() over (partition by doc_id order by tfidf_similarity desc, class_idx desc) as rt from scored),
fl as (select doc_id, max(class_idx) filter (rs = 1) as semantic_top1, max(class_idx) filter (rt = 1) as tfidf_top1, case when count(match_score) > 0 then
  coalesce(max(match_score) filter (rs = 1) - max(match_score) filter (rs = 2), 1.0) end as gap, coalesce(max(tfidf_similarity) filter (rt = 1) - max(tfidf_similarity) filter (rt = 2), 0.0) as tgap from rk group by 1),
fo as (select doc_id, semantic_top1, tfidf_top1, round(gap, 4) as ambiguous_gap, gap < 0.02 as ambiguous, semantic_top1 <> tfidf_top1 as discrepancy,
  case when semantic_top1 <> tfidf_top1 and tgap >= 0.02 then tfidf_top1 end as tfidf_alternative from fl)"""


FLAG_COLUMNS_SQL = "doc_id, semantic_top1, tfidf_top1, ambiguous_gap, ambiguous, discrepancy, tfidf_alternative, case when tfidf_alternative is not null and ambiguous then 'suggestion+ambiguous' when tfidf_alternative is not null then 'suggestion' when ambiguous then 'ambiguous' else '' end as message"


@query(f"{FLAGS_SQL} select {FLAG_COLUMNS_SQL} from fo")
def tfidf_topk_flags(spark: SparkSession, d: str) -> DataFrame:
    return scoring.flags(_ranked(spark, d))


@query(f"{FLAGS_SQL} select doc_id, class_idx, rs::int as rank_semantic, rt::int as rank_tfidf from rk")
def class_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("doc_id", "class_idx", "rank_semantic", "rank_tfidf")


@query(
    f"""{FLAGS_SQL}, pl as (select doc_id, class_idx, row_number() over (partition by doc_id order by round(match_score, 4) desc, class_idx) as place from rk where match_score is not null),
tp as (select doc_id, string_agg(place || ':' || class_idx, ',' order by place) as top3 from pl where place <= 3 group by 1)
select {FLAG_COLUMNS_SQL}, top3 from fo left join tp using (doc_id)"""
)
def classify_two_methods(spark: SparkSession, d: str) -> DataFrame:
    ranks = cut_lineage(_ranked(spark, d))
    top = scoring.top_classes(ranks.where("match_score is not null")).select("doc_id", F.array_join(F.transform("top3", lambda s: F.concat_ws(":", s["rank"].cast("string"), s["class_idx"].cast("string"))), ",").alias("top3"))
    return scoring.flags(ranks).join(top, "doc_id", "left")


# --- clusters and topics -------------------------------------------------------------------------------------------

SILHOUETTE_SQL = f"""with {EMBEDDING_SQL}, sm as (select label, i, sum(x) as x from (select label, unnest(e) as x, unnest(range(len(e))) as i from un) group by 1, 2),
sv as (select label, list(x order by i) as s from sm group by 1), nc as (select label, count(*) as n from un group by 1),
ds as (select vec_id, un.label, sv.label as o, n, list_dot_product(e, s) as d from un cross join sv join nc on nc.label = sv.label),
ab as (select vec_id, label, max(n) filter (label = o) as n, max(1 - (d - 1) / nullif(n - 1, 0)) filter (label = o) as a, min(1 - d / n) filter (label <> o) as b from ds group by 1, 2),
si as (select vec_id, label, case when n = 1 or b is null or greatest(a, b) = 0 then 0.0 else (b - a) / greatest(a, b) end as silhouette from ab)"""


@query(f"{SILHOUETTE_SQL} select vec_id, label, round(silhouette, 5) as silhouette from si")
def silhouette_samples(spark: SparkSession, d: str) -> DataFrame:
    return clusters.silhouettes(table(spark, d, "embeddings"), "vec_id", "label").withColumn("silhouette", F.round("silhouette", 5))


@query(f"{SILHOUETTE_SQL} select round(avg(silhouette), 6) as silhouette from si")
def silhouette_mean(spark: SparkSession, d: str) -> DataFrame:
    return clusters.silhouettes(table(spark, d, "embeddings"), "vec_id", "label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("label").alias("cluster"), F.concat_ws("-", "lang", "source").alias("topic"))


@query()
def cluster_naming(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_names(_topics(spark, d))


@query("select label as cluster, lang as topic, count(*) / sum(count(*)) over (partition by label) * 100 as share from embeddings join documents on vec_id = doc_id group by 1, 2")
def topic_shares(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("label").alias("cluster"), F.col("lang").alias("topic"))
    return relations.share_of_group(both, "cluster", "topic").select("cluster", "topic", F.col("percentage").alias("share"))


@query()
def kmeans_labels(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(table(spark, d, "embeddings"), 10, starts=20).select("vec_id", "cluster")


@query()
def k_selection(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with 20 starts each, and which number of clusters is chosen: the best, the smallest of equals."""
    vectors = table(spark, d, "embeddings")
    scores = clusters.k_scores(vectors, V.k_range(5, 50, vectors.count()), starts=20)
    best = max(scores, key=lambda x: (x[1], -x[0]))
    return spark.createDataFrame([(k, value, k == best[0]) for k, value in scores], "k int, silhouette double, chosen boolean")


@query()
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return clusters.projection(table(spark, d, "embeddings"), "vec_id")


def _topic_model(spark: SparkSession, d: str) -> topics.TopicModel:
    return topics.fit(_tokens(spark, d), ks=(4,), passes=5)


@query()
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    return _topic_model(spark, d).keywords()


@query()
def lda_dominant_topic(spark: SparkSession, d: str) -> DataFrame:
    return topics.dominant_topics(_topic_model(spark, d), _tokens(spark, d), "doc_id")


@query()
def lda_coherence(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_topic_model(spark, d).coherences, "k int, coherence double")


def _grid_model(spark: SparkSession, d: str) -> tuple[topics.TopicModel, DataFrame]:
    """The model of the whole grid of topic counts, and the documents with phrases joined that it is fitted on."""
    docs = phrases.mined(_tokens(spark, d), "doc_id").persist()
    return topics.fit(docs), docs


@query()
def lda_grid_topics(spark: SparkSession, d: str) -> DataFrame:
    return _grid_model(spark, d)[0].keywords()


@query()
def lda_grid_dominant_topic(spark: SparkSession, d: str) -> DataFrame:
    model, docs = _grid_model(spark, d)
    return topics.dominant_topics(model, docs, "doc_id")


@query()
def lda_grid_coherence(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_grid_model(spark, d)[0].coherences, "k int, coherence double")


# --- contents and articles -----------------------------------------------------------------------------------------

HEADING = "Модели и методы анализа систем"


@query(
    f"""with c as (select conv_id, turn, coalesce(role, 'x') as role, row_number() over (partition by conv_id order by turn, coalesce(role, 'x')) as seq, count(*) over (partition by conv_id) as n from conversations)
select conv_id::varchar as source, seq::int as seq, case when n <= 3 then '' else '{HEADING}' end as topic, 'Статья ' || role || ' о задаче' as toc_title, (turn + 1)::int as toc_page, n <= 3 as no_theme from c"""
)
def toc_parse(spark: SparkSession, d: str) -> DataFrame:
    """Conversations set as files whose table of contents lists their turns, parsed again; short ones have no topics."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("x")).alias("role")).alias("t")).groupBy(F.col("conv_id").cast("string").alias("source")).agg(F.array_sort(F.collect_list("t")).alias("t"))
    lines = F.transform("t", lambda t: F.concat_ws(" ", F.lit("Статья"), t.role, F.lit("о задаче"), (t.turn + 1).cast("string")))
    pages = turns.select("source", F.lit(1).alias("page_num"), F.concat_ws("\n", F.lit("Содержание"), F.lit(HEADING), F.array_join(lines, "\n")).alias("text"))
    return contents.sane_topics(contents.toc_entries(contents.contents_lines(pages)))


#: Documents that are set as one file.
FILE_ROWS = 100


def _file() -> Column:
    return F.concat_ws("/", F.coalesce("source", F.lit("-")), F.floor(F.col("doc_id") / FILE_ROWS).cast("string"))


@query()
def title_score_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents set as articles of files of bounded length, matched by first sentence with their file's contents."""
    rows = table(spark, d, "documents").select(
        _file().alias("source"), F.col("doc_id").cast("int").alias("seq"), F.substring_index("text", ".", 1).alias("title"), (F.col("doc_id") % FILE_ROWS + 1).cast("int").alias("pdf_page"), "lang"
    )
    toc = rows.where("title is not null").select("source", "seq", F.coalesce("lang", F.lit("")).alias("topic"), F.col("title").alias("toc_title"), F.col("pdf_page").alias("toc_page"), F.lit(False).alias("no_theme"))
    return contents.match_topics(rows.drop("lang"), toc)


@query()
def article_parse(spark: SparkSession, d: str) -> DataFrame:
    """Documents set as articles of files of bounded length, parsed again."""
    body = F.concat(F.lit("УДК "), F.col("doc_id").cast("string"), F.lit("\nО задаче номер "), F.col("doc_id").cast("string"), F.lit("\nИванов Иван Иванович\nАннотация. Кратко о задаче. Ключевые слова: задача, метод.\nВведение. "), X.text_or_empty(F.col("text")))
    pages = table(spark, d, "documents").select(_file().alias("source"), (F.col("doc_id") + 1).cast("int").alias("page_num"), body.alias("text"))
    return articles.parse_articles(pages).select("source", "seq", "pdf_page", "udc", "title", "authors", F.char_length("main_text").alias("chars"))
