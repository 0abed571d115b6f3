"""Queries of the text functions, the cache, and answers of labellers, each with its SQL where SQL can express it."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from rankspark.functions import text as T
from rankspark.functions import vectors as V
from rankspark.operators import cache as C
from rankspark.operators import label as L
from rankspark.operators import select as R
from rankspark.operators import writes as U
from rankspark.operators.encode import HashingEncoder, encoded
from rankspark.plans.readers import ART, CUR
from rankspark.schema import violations
from rankspark.sources import table

KEY = {"model_name": "cobble-64", "max_length": 2048, "text_prep_mode": "title_head", "prep_version": 2}
IS_KEY = "model_name = 'cobble-64' and max_length = 2048 and text_prep_mode = 'title_head' and prep_version = 2"

TITLE = r"regexp_replace(regexp_replace({t}, '\[\p{{Nd}}+\][\s\p{{Z}}]*', '', 'g'), '[\s\p{{Z}}]*\(TS:[\s\p{{Z}}]*\p{{Nd}}+\)[\s\p{{Z}}]*$', '')"
BLANKS = r"trim(regexp_replace({t}, '[\s\p{{Z}}]+', ' ', 'g'))"
MARKUP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
BUDGET = 24


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.current_entries(table(spark, d, "entries"), *columns)


def _words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def _hashes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All articles with the hash of their newest text, and a cache that holds the oldest row of each key."""
    rows = table(spark, d, "relevance_embeddings")
    for column, value in KEY.items():
        rows = rows.where(F.col(column) == F.lit(value))
    newest = R.latest(rows.select("article_id", "text_hash", "last_updated"), ["article_id"], ["last_updated", "text_hash"]).select("article_id", "text_hash")
    ids = R.articles(current(spark, d, "feed_id"), table(spark, d, "feeds")).select("article_id")
    order = F.struct("last_updated", "text_hash")
    oldest = rows.groupBy("article_id", *KEY).agg(F.min_by(F.struct("text_hash", "embedding", "last_updated"), order).alias("r")).select("article_id", *KEY, "r.text_hash", "r.embedding", "r.last_updated")
    return ids.join(newest, "article_id", "left"), oldest


def cache_state(spark: SparkSession, d: str) -> DataFrame:
    texts, cache = _hashes(spark, d)
    return C.with_cache_state(texts, cache, KEY, 64).select("article_id", "cache_state")


STATE = f"""{ART}, r as (select *, row_number() over (partition by article_id order by last_updated nulls first, text_hash nulls first) a,
  row_number() over (partition by article_id order by last_updated desc nulls last, text_hash desc nulls last) z from relevance_embeddings where {IS_KEY}),
  st as (select art.article_id, case when o.article_id is null then 'miss' when o.text_hash = n.text_hash and len(o.embedding) = 64 then 'hit' else 'stale' end cache_state
  from art left join r o on o.article_id = art.article_id and o.a = 1 left join r n on n.article_id = art.article_id and n.z = 1)"""


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The oldest rows of the cache, upserted with all rows in the order of their time."""
    rows = table(spark, d, "relevance_embeddings")
    key = ["article_id", *KEY]
    order = F.struct("last_updated", "text_hash")
    oldest = rows.groupBy(*key).agg(F.min_by(F.struct("text_hash", "embedding", "last_updated"), order).alias("r")).select(*key, "r.text_hash", "r.embedding", "r.last_updated")
    incoming = rows.select(*key, "text_hash", "embedding", "last_updated", F.struct("last_updated", "text_hash").alias("ordinal"))
    return U.upsert_embeddings(oldest, incoming).select(*key, "text_hash", "last_updated")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a labeller would give them, fenced, from the stored labels."""
    made = F.to_json(F.struct("score", "explanation", "confidence"))
    return table(spark, d, "time_sensitivity").select("article_id", F.concat(F.lit("```json\n"), made, F.lit("\n```")).alias("answer"))


def parse_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.accepted(L.parsed(_answers(spark, d), (1, 2, 3, 4, 5), confidence=True)).select("article_id", "score", "confidence", "explanation")


def reject_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.rejected(L.parsed(_answers(spark, d), (1, 2, 3, 4, 5), confidence=True)).select("article_id")


def _html(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d, "content").where("content is not null")
    return rows.select("id", T.strip_html("content").alias("text")).select("id", F.sha2("text", 256).alias("text_hash"))


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "title").select("id", T.normalise_text("title").alias("title"))


def _blob(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d, "title", "content")
    return rows.select("id", T.text_hash(T.single_blob(F.col("title"), F.col("content"))).alias("text_hash"))


def _head(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "title", "content").select("id", T.title_head(BUDGET)(F.col("title"), F.col("content")).alias("text"))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """The signs of the components, which SQL gives exactly, and the length, which is 1 but for texts without words."""
    rows = current(spark, d, "title", "content").select("id", T.title_head_words(F.col("title"), F.col("content"), 64).alias("text"))
    made = encoded(rows, HashingEncoder).select("id", "embedding")
    signs = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "")
    return made.select("id", signs.alias("signs"), F.round(V.norm(F.col("embedding")), 3).alias("norm"))


VALID = "score between 1 and 5 and explanation is not null and confidence in ('low', 'medium', 'high')"

QUERIES = {
    "clean_titles": (lambda s, d: current(s, d, "title").select("id", T.clean_title(F.col("title")).alias("title")), f"with {CUR} select id, {TITLE.format(t='title')} title from cur"),
    "collapse_ws": (lambda s, d: current(s, d, "content").select("id", F.sha2(T.collapse_whitespace(F.col("content")), 256).alias("text_hash")), f"with {CUR} select id, sha256({BLANKS.format(t='content')}) text_hash from cur"),
    "strip_markup": (lambda s, d: current(s, d, "content").select("id", F.sha2(T.strip_markup(F.col("content")), 256).alias("text_hash")), f"with {CUR} select id, sha256({MARKUP.format(t='content')}) text_hash from cur"),
    "strip_html": (_html, None),
    "normalise_text": (_normal, None),
    "prep_single_blob": (_blob, None),
    "prep_title_head": (_head, None),
    "prep_title_head_words": (
        lambda s, d: current(s, d, "title", "content").select("id", T.title_head_words(F.col("title"), F.col("content"), BUDGET).alias("text")),
        f"""with {CUR}, p as (select id, {_words(BLANKS.format(t=TITLE.format(t="coalesce(title, '')")))} h, {_words(MARKUP.format(t="coalesce(content, '')"))} b from cur),
        q as (select id, h[1:{BUDGET - 4}] top, b from p)
        select id, array_to_string(list_concat(top, b[1:{BUDGET - 4} - len(top)]), ' ') as text from q""",
    ),
    "text_hash": (
        lambda s, d: current(s, d, "title", "content").select("id", T.text_hash(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))).alias("text_hash")),
        f"with {CUR} select id, sha256(coalesce(title, '') || ' ' || coalesce(content, '')) text_hash from cur",
    ),
    "cache_state": (cache_state, f"with {STATE} select article_id, cache_state from st"),
    "cache_state_counts": (
        lambda s, d: C.cache_counts(cache_state(s, d)),
        f"with {STATE} select count(*) filter (cache_state = 'hit') hits, count(*) filter (cache_state = 'stale') stale, count(*) filter (cache_state <> 'hit') misses from st",
    ),
    "cache_upsert": (
        cache_upsert,
        """select article_id, model_name, max_length, text_prep_mode, prep_version, text_hash, last_updated from (select *, row_number() over (
        partition by article_id, model_name, max_length, text_prep_mode, prep_version order by last_updated desc nulls last, text_hash desc nulls last) rn from relevance_embeddings) where rn = 1""",
    ),
    "encode_hashing": (
        _encoded,
        f"""with {CUR}, p as (select id, {_words(BLANKS.format(t=TITLE.format(t="coalesce(title, '')")))} h, {_words(MARKUP.format(t="coalesce(content, '')"))} b from cur),
        q as (select id, list_concat(h[1:60], b[1:60 - len(h[1:60])]) w from p), w as (select id, unnest(w) w from q), u as (select distinct w from w),
        x as (select w, sha256('0|' || w) || sha256('1|' || w) x from u), v as (select w, k, ('0x' || x[2 * k + 1 : 2 * k + 2])::int v from x, range(64) r(k)),
        s as (select id, k, sum(case when v > 127 then v - 256 else v end) s from w join v using (w) group by id, k),
        a as (select id, string_agg(case sign(s) when 1 then '+' when -1 then '-' else '0' end, '' order by k) a, max(abs(s)) > 0 n from s group by id)
        select id, coalesce(a, repeat('0', 64)) signs, case when n then 1.0::double else 0.0::double end norm from p left join a using (id)""",
    ),
    "parse_labels": (parse_labels, f"select article_id, score, confidence, explanation from time_sensitivity where {VALID}"),
    "reject_labels": (reject_labels, f"select article_id from time_sensitivity where not coalesce({VALID}, false)"),
    "label_by_keywords": (
        lambda s, d: current(s, d, "title", "content").select("id", L.keyword_score(F.concat_ws(" ", F.coalesce("title", F.lit("")), T.strip_markup(F.coalesce("content", F.lit(""))))).alias("score")),
        f"with {CUR}, t as (select id, lower(coalesce(title, '') || ' ' || {MARKUP.format(t="coalesce(content, '')")}) b from cur) select id, cast(case "
        + " ".join(rf"when regexp_matches(b, '\b({'|'.join(L.CUES[n])})\b') then {n}" for n in sorted(L.CUES, reverse=True)) + " else 1 end as int) score from t",
    ),
    "check_violations": (
        lambda s, d: violations(table(s, d, "time_sensitivity"), "time_sensitivity"),
        "select * from (select 'score' as \"check\", count(*) \"rows\" from time_sensitivity where not score between 1 and 5 union all select 'confidence', count(*) from time_sensitivity where confidence not in ('low', 'medium', 'high')) where \"rows\" > 0",
    ),
}
