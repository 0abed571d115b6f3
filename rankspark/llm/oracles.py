"""Statements by brute force that give the rows of those queries on training data that SQL can express.

They compare everything with everything and are meant for small tables.
"""

from __future__ import annotations

#: Named entities as far as the tables have them; the ampersand last.
ENTITIES = {"&eacute;": "é", "&rsquo;": "’", "&hellip;": "…", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _decoded(text: str) -> str:
    for name, character in ENTITIES.items():
        text = f"replace({text}, '{name}', '{character}')"
    return text


ARTICLES = "art as (select e.id article_id, any_value(e.title) title, any_value(e.content) content, any_value(f.title) feed_name from entries e join feeds f on f.id = e.feed_id where e.id is not null group by e.id)"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_TITLE = _WORDS.format(r"regexp_replace(coalesce(title, ''), '\[\d+\]|\(TS:\s*\d+\)', ' ', 'g')")
_CONTENT = _WORDS.format(_decoded("regexp_replace(coalesce(content, ''), '<[^>]*>', ' ', 'g')"))
SETS = f"""{ARTICLES}, parts as (select article_id, {_TITLE} t, {_CONTENT} b from art), w as (select article_id, list_concat(t, b) w from parts where len(b) >= 20),
places as (select article_id, w, unnest(range(1, len(w) - 1)) i from w), sh as (select distinct article_id, hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) s from places), n as (select article_id, count(*) n from sh group by article_id)"""
_COMMON = "select x.article_id a, y.article_id b, count(*) c from {x} x join {y} y on x.s = y.s {and_} group by all"
_ALIKE = "select a, b from common join n p on p.article_id = a join n q on q.article_id = b where 3 * c >= p.n + q.n"
GROUPS = f"""recursive {SETS}, common as ({_COMMON.format(x='sh', y='sh', and_='and x.article_id < y.article_id')}), alike as ({_ALIKE}), e as (select a, b from alike union all select b, a from alike),
r as (select distinct a node, a root from e union select e.b, r.root from r join e on e.a = r.node), g as (select node article_id, min(root) group_id from r group by node)"""
SPLITS = "s as (select article_id, split from article_splits)"
ACROSS = f"""{SETS}, {SPLITS}, tr as (select sh.* from sh join s using (article_id) where split = 'train'), ev as (select sh.* from sh join s using (article_id) where split in ('validation', 'test')),
common as ({_COMMON.format(x='tr', y='ev', and_='')}), alike as ({_ALIKE})"""
_BARE = _decoded("regexp_replace(line, '<[^>]*>', '', 'g')")
_PLAIN = rf"regexp_replace(trim(regexp_replace(lower({_BARE}), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')), '[0-9]+', '0', 'g')"
LINES = f"""{ARTICLES}, cut as (select article_id, feed_name, string_split(content, chr(10)) l from art where content is not null), numbered as (select article_id, feed_name, unnest(l) line, unnest(range(1, len(l) + 1)) line_no from cut),
lines as (select article_id, feed_name, line, cast(line_no as int) line_no, {_PLAIN} plain from numbered), total as (select feed_name, count(*) total from art group by feed_name),
often as (select feed_name, plain from (select feed_name, plain, count(distinct article_id) k from lines where plain <> '' group by all) join total using (feed_name) where k >= 8 and k * 100 >= total * 6)"""
VECTORS = """v as (select article_id, embedding::double[] x from (select *, row_number() over (partition by article_id order by last_updated desc nulls last, embedding desc) rn from relevance_embeddings
where model_name = 'cobble-64' and article_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0) where rn = 1),
near as (select p.article_id a, q.article_id b, list_cosine_similarity(p.x, q.x) c from v p join v q on p.article_id <> q.article_id {only}), best as (select * from (select *, row_number() over (partition by a order by c desc, b) rn from near) where rn <= 5)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {VECTORS.format(only='')} select distinct least(a, b) article_id_a, greatest(a, b) article_id_b from best where c >= 0.9",
        "p1_neighbours": f"with {VECTORS.format(only='and p.article_id % 50 = 0')} select a article_id, b neighbour_id, round(c, 3) cosine from best",
        "p2_found": f"with {GROUPS} select x.article_id article_id_a, y.article_id article_id_b from g x join g y on x.group_id = y.group_id and x.article_id < y.article_id",
        "p2_groups": f"with {GROUPS} select article_id, group_id from g",
        "p3_found": f"with {ACROSS} select distinct least(a, b) article_id_a, greatest(a, b) article_id_b from alike",
        "p3_report": f"""with {ACROSS}, hits as (select b article_id, count(*) pairs from alike group by b) select split, feed_name, count(*) articles, count(pairs) overlapping, cast(coalesce(sum(pairs), 0) as bigint) pairs
        from art join s using (article_id) left join hits using (article_id) where split in ('validation', 'test') group by split, feed_name""",
        "p5_found": f"with {LINES} select article_id, line_no from lines join often using (feed_name, plain)",
        "p5_cleaned": f"""with {LINES}, kept as (select article_id, string_agg(line, chr(10) order by line_no) content from lines l where not exists (select 1 from often o where o.feed_name = l.feed_name and o.plain = l.plain) group by article_id)
        select article_id, case when art.content is not null then coalesce(kept.content, '') end as content from art left join kept using (article_id)""",
    }
