import html
import re
from collections import Counter, defaultdict

import pyspark.sql.functions as F

from rankspark.llm import site_lines as L
from rankspark.sources import articles


def plain(line):
    return re.sub(r"[0-9]+", "0", re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", line)).lower()).strip())


def brute(rows, least=8, per_cent=6):
    rows = {i: (s, c) for i, s, c in rows}
    total, seen = Counter(s for s, _ in rows.values()), defaultdict(set)
    for i, (s, c) in rows.items():
        for line in (c or "").split("\n"):
            if plain(line):
                seen[s, plain(line)].add(i)
    hot = {k for k, v in seen.items() if len(v) >= least and len(v) * 100 >= per_cent * total[k[0]]}
    return {(i, k) for i, (s, c) in rows.items() for k, line in enumerate((c or "").split("\n"), 1) if (s, plain(line)) in hot}


def of(spark, data):
    return articles(spark, data, "content").withColumn("source", F.col("feed_name"))


def test_matches_brute_force(spark, data):
    for d in (data, data.replace("0.001", "0.01")):
        df = of(spark, d)
        rows = [(r["article_id"], r["source"], r["content"]) for r in df.collect()]
        want = brute(rows)
        assert {tuple(r) for r in L.repeated_places(df).collect()} == want and want
        out = {r["article_id"]: r["content"] for r in L.cleaned(df).collect()}
        for i, _, content in rows:
            kept = None if content is None else "\n".join(x for k, x in enumerate(content.split("\n"), 1) if (i, k) not in want)
            assert out[i] == kept


SCHEMA = "article_id long, source string, content string"


def test_edges(spark):
    same = "Read <b>MORE</b> &amp; 12 more"
    rows = [(k, "s", f"own {chr(97 + k)}\n\n{same if k % 2 else same.upper().replace('12', '7').replace('&AMP;', '&amp;')}") for k in range(8)]
    rows += [(3, "s", rows[3][2]), (20, "s", None), (21, "s", ""), (22, "s", "\n \n"), (None, "s", same), (23, None, same), (24, "t", same)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"line": F.lit(1), "line_no": F.lit("x"), "articles": F.lit(0)})
    assert {tuple(r) for r in L.repeated_places(df).collect()} == {(k, 3) for k in range(8)}
    out = {r["article_id"]: r["content"] for r in L.cleaned(df).collect()}
    assert out[0] == "own a\n" and out[20] is None and out[21] == "" and out[22] == "\n \n" and out[24] == same
    assert L.repeated_places(df.limit(0)).count() == 0 and L.cleaned(df.limit(0)).count() == 0


def test_a_line_twice_in_an_article_counts_once(spark):
    rows = [(k, "s", "x\nx") for k in range(7)]
    assert L.repeated_places(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert L.repeated_places(spark.createDataFrame([*rows, (7, "s", "x")], SCHEMA)).count() == 15


def test_merging_deltas_equals_one_run(spark, data):
    df = of(spark, data.replace("0.001", "0.01"))
    parts = [df.where(F.pmod("article_id", F.lit(3)) == k) for k in range(3)] + [df.where("article_id % 7 = 0")]  # the last is redelivered
    state = L.first_state(parts[0], L.article_lines(parts[0]))
    for part in parts[1:]:
        state = L.merge(state, part, L.article_lines(part))
    whole = L.first_state(df, L.article_lines(df))
    for name in ("totals", "counts"):
        a, b = getattr(state, name), getattr(whole, name).select(*getattr(state, name).columns)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_crossings_and_rebuilding(spark):
    first = spark.createDataFrame([(k, "s", f"own {k}{chr(97 + k)}\nshare") for k in range(8)], SCHEMA)
    before = L.first_state(first, L.article_lines(first))
    # one line falls below its share, another crosses upwards
    second = spark.createDataFrame([(100 + k, "s", f"text {chr(97 + k % 26)}{chr(97 + k // 26)}" + ("\nfooter" if k < 40 else "")) for k in range(200)], SCHEMA)
    after = L.merge(before, second, L.article_lines(second))
    assert L.crossings(before, after).where("repeated").count() == 1 and L.crossings(before, after).where("not repeated").count() == 1
    both = first.unionByName(second)
    lines = L.article_lines(both)
    built = L.rebuild(both, lines, L.with_line(lines, L.crossings(before, after)), L.repeated(after)).collect()
    assert len(built) == 48  # 40 lose the footer, 8 get the other line back
    assert {r["content"] for r in built if r["article_id"] < 8} == {f"own {k}{chr(97 + k)}\nshare" for k in range(8)}
    assert all("footer" not in r["content"] for r in built)


def test_the_queries_merge_deltas(spark, monkeypatch):
    """Lines that a later partition lifts over the threshold or lets fall below it, in any number of partitions."""
    rows = [(k, "s", f"own {chr(97 + k % 26)}{chr(97 + k // 26)}\nfooter" + ("\nrare" if k < 9 else "")) for k in range(140)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for deltas in (1, 2, 5):
        steps = list(L.merged(df, deltas))
        assert len(steps) == deltas
        assert deltas == 1 or steps[-1].crossed.count() < steps[-1].now.count() + 2
        monkeypatch.setattr(L.merged, "__defaults__", (deltas,))
        assert {tuple(r) for r in L.repeated_places(df).collect()} == want
        assert {r["article_id"]: r["content"] for r in L.cleaned(df).collect()} == {i: "\n".join(x for k, x in enumerate(c.split("\n"), 1) if (i, k) not in want) for i, _, c in rows}
