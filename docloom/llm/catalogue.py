"""The thin queries of this subpackage over the test tables, and their SQL for DuckDB where SQL can express them.

Each query reads whole tables, calls one operator with production parameters and derives the columns asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.tables import table

LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP1_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (
  select distinct doc_id, case when len(words) < 3 then array_to_string(words, ' ') else array_to_string(words[i:i + 2], ' ') end as g
  from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
r as (select x as a, x as b from e union select r.a, e.y from r join e on e.x = r.b),
m as (select a, min(b) as component_id from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join m on m.a = w.doc_id
"""

def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


WORDS_SQL = f"regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9_SQL = f"""
with b as (select distinct item_id, {WORDS_SQL} as words from benchmark where item_id is not null),
bw as (
  select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as g
  from (select item_id, words, least(8, len(words)) as n, unnest(range(1, greatest(1, len(words) - 7) + 1)) as i from b where len(words) > 0)),
lens as (select distinct n from bw),
d as (select doc_id, {WORDS_SQL} as words from documents),
dw as (
  select doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') as g
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, lens where len(words) >= n)),
h as (select doc_id, i, dw.n, item_id from dw join bw on bw.g = dw.g and bw.n = dw.n),
p as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as at from h) group by 1),
q as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by 1)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join p on p.doc_id = d.doc_id left join q on q.doc_id = d.doc_id
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the label with its number: bad where ``quality`` is 0."""
    from docloom.llm.url_filter import judge_urls

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).cast("long").alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).drop("low")


OP10_SQL = rf"""
with p as (
  select page_id, {LOWER_SQL.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
o as (select doc_id as page_id, max(1 - quality)::bigint as bad from labels where doc_id is not null and quality is not null group by 1),
b as (select host, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.?$', '') as bare
  from p left join o using (page_id) group by host),
s as (select *, array_to_string(string_split(bare, '.')[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') as two,
  regexp_matches(bare, '^[0-9.]+$|^\[') as num from b),
h as (select host, n, bad, case when num then bare when two then array_to_string(string_split(bare, '.')[-3:], '.') else array_to_string(string_split(bare, '.')[-2:], '.') end as domain,
  case when num then '' when two then array_to_string(string_split(bare, '.')[-2:], '.') else string_split(bare, '.')[-1] end as suffix from s),
d as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from h group by 1, 2),
x as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from d group by 1),
g as (select case when sum(n) > 0 then (sum(bad) + 0.5::double) / (sum(n) + 1) else 0.5::double end as overall from x),
lv as (select 'host' as level, domain as above, n, bad from h union all select 'domain', suffix, n, bad from d union all select 'suffix', '1', n, bad from x),
tt as (select level, above, sum(n)::double as tn, sum(bad)::double / nullif(sum(n), 0) as p from lv group by 1, 2),
mo as (select level, sum(n * (bad / n::double - p) ** 2) as spread, sum((1 - n / tn) * p * (1 - p)) as apart, sum((1 - n / tn) * p * (1 - p) * (n - 1)) as room
  from lv join tt using (level, above) where n > 0 and tn > 0 group by 1),
st as (select level, round(1 / (case when room > 1e-9 then least(0.5, greatest(0.001, (spread - apart) / room)) else 0.5 end) - 1, 6) as m from mo
  union all select level, 1.0 from (values ('host'), ('domain'), ('suffix')) v(level) where level not in (select level from mo)),
m as (select max(m) filter (level = 'host') as mh, max(m) filter (level = 'domain') as md, max(m) filter (level = 'suffix') as ms from st),
xs as (select suffix, (bad + ms * overall) / (n + ms) as q from x, m, g),
ds as (select d.domain, (d.bad + md * q) / (d.n + md) as q from d join xs using (suffix), m),
hs as (select host, (h.bad + mh * q) / (h.n + mh) as mean, h.n + mh as total from h join ds using (domain), m),
r as (select p.page_id, p.host, p.path, mean - sqrt(mean * (1 - mean) / (total + 1)) as low,
  case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
       when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
       when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
       when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule
  from p join hs using (host))
select page_id, host, path, rule, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block'
  when low > 0.25 then 'block' else 'allow' end as verdict from r
"""

def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import language
    from docloom.llm.samples import crc_mod

    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import quality
    from docloom.llm.samples import crc_mod

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").cast("int").alias("label"))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.sharding import external_shuffle

    placed = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.secrets import secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import toxicity
    from docloom.llm.samples import crc_mod

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").cast("int").alias("label"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = """
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || md5('11:' || doc_id)[1:13])::bigint / 4503599627370496.0::double as u from documents),
s as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][(row_number() over (order by source is null, source collate "binary") - 1) % 3 + 1]::double as w from d group by source),
t as (  -- rounds of resharing: those above their cap stop at it
  select 0 as round, source, source_size, w, w * sum(source_size) over () / sum(w) over () as target, false as stops from s
  union all
  select round + 1, source, source_size, w, case when now then 3.0 * source_size else w * (sum(source_size) over () - sum(case when now then 3.0 * source_size else 0 end) over ()) / sum(case when now then 0 else w end) over () end, now
  from (select *, stops or target >= 3.0 * source_size as now from t) where round < 60),
p as (select source, source_size, target, floor(target / nullif(source_size, 0) + 1e-9) as whole from t where round = 60),
r as (
  select d.*, p.source_size, p.target, coalesce(whole, 0) as whole, target - coalesce(whole, 0) * p.source_size as wanted,
    coalesce(sum(size) over (partition by d.source order by u, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join p on p.source is not distinct from d.source)
select doc_id, size, source_size, round(target, 4) as target,
  (size * (whole + case when wanted > 1e-9 * source_size and before < wanted and (before + size <= wanted or before + size - wanted <= wanted - before) then 1 else 0 end))::bigint as taken
from r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_media": op4_media,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL,
    "op8_mixing": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_url_filter": OP10_SQL,
}
