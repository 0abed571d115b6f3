import itertools
import random
import re

import pyspark.sql.functions as F
import pytest

from rankspark.llm import near_duplicates as N
from rankspark.llm import words as W
from rankspark.llm.components import components
from rankspark.sources import articles

SCHEMA = "article_id long, title string, content string"


def shingle_set(title, content):
    words = re.findall(r"[^\W_]+", re.sub(r"\[\d+\]|\(TS:\s*\d+\)", " ", title or "").lower()) + W.content_words(content)
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}


def brute_pairs(rows, least=0.5):
    sets = {}
    for i, t, c in rows:
        if i is not None and len(W.content_words(c)) >= 20:
            sets[i] = shingle_set(t, c)
    found = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) / max(len(x), len(y), 1) >= least and len(x & y) / len(x | y) >= least:
            found.add((a, b))
    return found


def chained(pairs):
    group = {}
    for a, b in pairs:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {p for g in group.values() for p in itertools.combinations(sorted(g), 2)}


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(k, f"more{rng.randrange(10**6)}")
        else:
            del words[k]
    return words


def corpus(seed, texts=60, sizes=(24, 400)):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(texts):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(*sizes))]
        for copy in range(rng.choice((1, 1, 2, 4))):
            changed = edited(words, rng, int(len(words) * rng.choice((0, 0.02, 0.05, 0.1))) if copy else 0)
            if copy and rng.random() < 0.3 and len(changed) > 40:
                cut = len(changed) // 2
                changed = changed[cut:] + changed[:cut]
            rows.append((i, "a title", " ".join(changed)))
            i += 1
    return rows


def groups_of(df):
    return {tuple(r) for r in N.group_pairs(N.duplicate_groups(df)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(seed, 150)
    assert groups_of(spark.createDataFrame(rows, SCHEMA)) == chained(brute_pairs(rows)) != set()


def test_shortened_and_extended_texts(spark):
    """Pairs of sizes up to one to two, at a similarity of 0.5 to 0.6."""
    rng, rows = random.Random(5), []
    for k, size in enumerate([24, 36, 50, 80, 120, 150, 300] * 40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        more = [f"w{rng.randrange(10**9)}" for _ in range(int(size * rng.uniform(0.7, 0.9)))]
        rows += [(2 * k, None, " ".join(words)), (2 * k + 1, None, " ".join(words + more if k % 2 else more + words))]
    want = chained(brute_pairs(rows))
    got = groups_of(spark.createDataFrame(rows, SCHEMA))
    assert got <= want and len(got) >= 0.995 * len(want) > 250


def test_a_hot_group_with_chained_outsiders(spark):
    """One text with many small edits; of pairs (b, c) of outsiders only b is near it, c is alike b only."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, None, " ".join(edited(words, rng, 1))) for k in range(800)]
    for k in range(60):
        b = words[: 150 + k % 30] + [f"b{k}x{j}" for j in range(60)]
        c = b[90:] + [f"c{k}x{j}" for j in range(50 + k % 25)]
        rows += [(1000 + 2 * k, None, " ".join(b)), (1001 + 2 * k, None, " ".join(c))]
    want = chained(brute_pairs(rows))
    assert groups_of(spark.createDataFrame(rows, SCHEMA).repartition(4)) == want


def test_a_hot_key_of_articles_that_are_not_alike(spark, monkeypatch):
    """A notice that all share, in sub-blocks, and pairs alike beside it."""
    monkeypatch.setattr(N, "PART", 64)
    rng = random.Random(12)
    notice = [f"n{k}" for k in range(40)]
    rows = []
    for k in range(300):
        body = [f"d{k}x{j}" for j in range(60)]
        rows.append((k, None, " ".join(body + notice)))
        if k % 3 == 0:
            rows.append((1000 + k, None, " ".join(edited(body, rng, 3) + notice)))
    assert groups_of(spark.createDataFrame(rows, SCHEMA).repartition(4)) == chained(brute_pairs(rows)) != set()


def test_further_rounds_verify_what_the_first_left_out(spark, monkeypatch):
    """Of two chains only the last pair by sketch may be alike: all are verified in the end."""
    monkeypatch.setattr(N, "ALLOWED", 2)
    rng = random.Random(13)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, None, " ".join(edited(words, rng, 3))) for k in range(200)]
    rows += [(1000 + k, None, " ".join(words[:135] + [f"y{k}x{j}" for j in range(66 + k % 9)])) for k in range(100)]
    assert groups_of(spark.createDataFrame(rows, SCHEMA)) == chained(brute_pairs(rows))


def test_found_matches_brute_force_on_the_data(spark, data):
    df = articles(spark, data, "title", "content")
    rows = list({r["article_id"]: (r["article_id"], r["title"], r["content"]) for r in df.collect()}.values())
    assert groups_of(df) == chained(brute_pairs(rows))


def test_texts_that_repeat_themselves(spark):
    rng, rows = random.Random(8), []
    for k in range(120):
        words = [f"c{k % 12}x{j}" for j in range(1 + k // 12)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"y{k}"
        rows.append((k, None, " ".join((words * 40)[:60])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert groups_of(df) == chained(brute_pairs(rows))


def test_edges(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [
        (1, "t", text),
        (1, "t", text),  # delivered twice
        (2, None, text),
        (3, "t", None),
        (4, "t", ""),
        (5, None, "   "),
        (6, "t", "too few words"),
        (None, "t", text),
        (7, "[5] t (TS: 3)", f"<p>{text}</p>"),
        (8, "t", "same " * 500),  # one shingle only
        (9, "t", "same " * 400),
        (10, "t", " ".join(f"long{k}" for k in range(20_000))),
        (11, "t", " ".join(f"long{k}" for k in range(19_000))),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit(1), "block": F.lit("x"), "links": F.lit(2)})
    groups = {r["article_id"]: r["group_id"] for r in N.duplicate_groups(df).collect()}
    assert groups == {1: 1, 2: 1, 7: 1, 8: 8, 9: 8, 10: 10, 11: 10}
    assert N.group_pairs(N.duplicate_groups(df.limit(0))).count() == 0


def test_a_hot_group_is_one_group(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, "t", " ".join(edited(words, rng, 2))) for k in range(700)] + [(1000 + k, "t", f"other{k} " + " ".join(f"o{k}x{j}" for j in range(50))) for k in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = N.duplicate_groups(df).groupBy("group_id").count().collect()
    assert [(r["group_id"], r["count"]) for r in groups] == [(0, 700)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 199)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
