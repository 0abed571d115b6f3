import itertools

import numpy as np
import pyspark.sql.functions as F

from rankspark.llm import split_overlap as S
from rankspark.sources import articles, table
from test_near_duplicates import brute_pairs


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    docs = [rng.integers(1, 5, rng.integers(1, 40)).astype(np.uint64) * np.uint64(977) for _ in range(40)]
    index = S.Index.build(np.arange(40) * 10, np.concatenate(docs), np.array(list(map(len, docs))))
    m = S.MIN_MATCH
    for _ in range(300):
        d = docs[rng.integers(40)]
        if len(d) < m:
            continue
        size = int(rng.integers(m, min(m + 5, len(d)) + 1))
        a = int(rng.integers(0, len(d) - size + 1))
        q = d[a : a + size].copy()
        if rng.random() < 0.5:
            q[0] = rng.integers(1, 6) * 977
        want = sorted(i for i, x in enumerate(docs) for p in range(len(x) - size + 1) if (x[p : p + size] == q).all())
        hit, low, high = index.start(S.seed_hashes(q[-m:]))
        got = []
        if len(hit):
            for w in q[:-m][::-1]:
                low, high = index.extend(index.symbols(np.array([w])), low, high)
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == want


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        text = np.append(rng.integers(1, 4, n - 1), 0)
        assert S.suffix_order(text).tolist() == sorted(range(n), key=lambda k: text[k:].tolist())


def test_matches_brute_force_on_the_data(spark, data):
    df, splits = articles(spark, data, "title", "content"), table(spark, data, "article_splits")
    rows = list({r["article_id"]: (r["article_id"], r["title"], r["content"]) for r in df.collect()}.values())
    split = {r[0]: r[1] for r in splits.collect()}
    want = {p for p in brute_pairs(rows) if {split.get(p[0]) == "train", split.get(p[1]) == "train"} == {True, False} and all(split.get(i) for i in p)}
    found = S.split_overlaps(df, splits)
    assert {tuple(sorted((r["train_id"], r["eval_id"]))) for r in found.collect()} == want
    report = S.overlap_report(found, df, splits).collect()
    assert sum(r["pairs"] for r in report) == len(want)
    assert sum(r["articles"] for r in report) == sum(s in ("validation", "test") for i, s in split.items() if i in {r[0] for r in rows})


def test_edges(spark):
    text = " ".join(f"word{k}" for k in range(60))
    near = text.replace("word30", "other")
    rows = [(1, "t", text), (2, "t", text), (3, None, near), (4, "t", None), (5, "t", ""), (6, "t", text), (7, "t", text), (2, "t", text), (8, "t", "w " * 30_000), (9, "t", "w " * 30_000), (None, "t", text)]
    splits = [(1, "train"), (2, "test"), (3, "validation"), (4, "test"), (5, "train"), (7, None), (8, "train"), (9, "test"), (None, "test"), (99, "test")]
    df = spark.createDataFrame(rows, "article_id long, title string, content string").withColumns({"split": F.lit("train"), "shard": F.lit(1), "words": F.lit(2)})
    s = spark.createDataFrame(splits, "article_id long, split string")
    assert {(r["train_id"], r["eval_id"]) for r in S.split_overlaps(df, s).collect()} == {(1, 2), (1, 3), (8, 9)}
    assert S.split_overlaps(df.limit(0), s).count() == 0
    assert S.split_overlaps(df, s.limit(0)).count() == 0


def test_shards_and_hot_matches(spark):
    """Many copies of one text: every pair across the splits, whatever the shards."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(k, "t", f"{text} tail{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "article_id long, title string, content string")
    train, evaluation = df.where("article_id < 30"), df.where("article_id >= 30")
    for words in (S.SHARD_WORDS, 600):
        got = {(r["train_id"], r["eval_id"]) for r in S.alike_representatives(train, evaluation, shard_words=words)[0].collect()}
        assert got == set(itertools.product(range(30), range(30, 60)))


def test_copies_take_part_in_all_pairs(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(k, "t", text) for k in range(300)] + [(1000, "t", text.replace("word7", "x"))]
    df = spark.createDataFrame(rows, "article_id long, title string, content string").repartition(3)
    splits = spark.createDataFrame([(k, "train" if k % 3 else "test") for k in range(300)] + [(1000, "test")], "article_id long, split string")
    pairs = S.alike_representatives(df.where("article_id % 3 <> 0"), df.where("article_id % 3 = 0"))[0]
    assert pairs.count() < 50
    found = S.split_overlaps(df, splits)
    assert {(r["train_id"], r["eval_id"]) for r in found.collect()} == {(a, b) for a in range(300) if a % 3 for b in [*range(0, 300, 3), 1000]}
    assert found.count() == 200 * 101


def test_a_closer_sibling_hides_no_pair(spark):
    """An evaluation text that shares longer runs with the training article takes no other's pair, in one shard or in many."""
    words = [f"word{k}" for k in range(240)]
    alike = [f"other{k}" if k % 20 == 7 else w for k, w in enumerate(words)]
    rows = [(1, "t", " ".join(words)), (2, "t", " ".join(words[:-1] + ["end"])), (3, "t", " ".join(alike))]
    df = spark.createDataFrame(rows, "article_id long, title string, content string")
    assert set(brute_pairs(rows)) >= {(1, 2), (1, 3)}
    for words in (S.SHARD_WORDS, 250):
        got = {(r["train_id"], r["eval_id"]) for r in S.alike_representatives(df.where("article_id = 1"), df.where("article_id > 1"), shard_words=words)[0].collect()}
        assert got == {(1, 2), (1, 3)}


def test_each_place_of_a_seed_is_in_its_longest_match():
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 3, rng.integers(6, 40)).astype(np.uint64) * np.uint64(977) for _ in range(30)]
    index = S.Index.build(np.arange(30), np.concatenate(docs), np.array(list(map(len, docs))))
    query = rng.integers(1, 4, 60).astype(np.uint64) * np.uint64(977)
    hashed = S.seed_hashes(query)
    seeds = np.argsort(hashed)
    which, first, low, high, grown = S.left_maximal(index, query, np.zeros(len(seeds), np.int64), seeds, hashed[seeds])
    got = []
    for w, f, a, b, g in zip(which, first, low, high, grown):
        rows = np.arange(a, b)
        got += [(int(seeds[w]), int(seeds[w] - f), int(d)) for d in index.locate(rows[index.before[rows] != g])]
    want = []
    for at in range(len(query) - S.MIN_MATCH + 1):
        for d, x in enumerate(docs):
            for p in range(len(x) - S.MIN_MATCH + 1):
                if (x[p : p + S.MIN_MATCH] == query[at : at + S.MIN_MATCH]).all():
                    more = 0
                    while more < min(at, p, S.MAX_MATCH - S.MIN_MATCH) and x[p - more - 1] == query[at - more - 1]:
                        more += 1
                    want.append((at, more, d))
    assert sorted(got) == sorted(want)


def test_frequent_matches_hide_no_pair(spark):
    """A training article all of whose matches are frequent keeps its pairs with each of its near copies."""
    rng = np.random.default_rng(6)
    words = [f"word{k}" for k in range(180)]
    # edits at the same places in all copies leave few and frequent matches
    rows = [(0, "t", " ".join(words))] + [(1 + c, "t", " ".join(f"e{c}x{k}" if k % 10 == 4 and k > 20 or k == 3 + c else w for k, w in enumerate(words))) for c in range(20)]
    rows += [(100 + k, "t", " ".join(f"n{rng.integers(10**6)}" for _ in range(60))) for k in range(20)]
    df = spark.createDataFrame(rows, "article_id long, title string, content string")
    want = {(a, b) for a, b in brute_pairs(rows) if a == 0}
    assert len(want) == 20
    got = {(r["train_id"], r["eval_id"]) for r in S.alike_representatives(df.where("article_id = 0"), df.where("article_id > 0"))[0].collect()}
    assert got >= want


def test_notices_that_many_share(spark):
    """Frequent seeds of a notice are skipped where little depends on them, and count for short articles that are mostly notice."""
    rng = np.random.default_rng(7)
    notice = [f"notice{k}" for k in range(40)]
    rows, n = [], 2 * S.FREQUENT
    for k in range(n):
        body = [f"b{k}x{j}" for j in range((14, 60, 150)[k % 3])]
        rows.append((k, "t", " ".join(body + notice)))
        other = [f"e{rng.integers(10**9)}" if rng.random() < 0.04 else w for w in body]
        rows.append((1000 + k, "t", " ".join(other + notice)))
    df = spark.createDataFrame(rows, "article_id long, title string, content string")
    want = {(a, b) for a, b in brute_pairs(rows) if a < 1000 <= b} | {(b, a) for a, b in brute_pairs(rows) if b < 1000 <= a}
    got = S.alike_representatives(df.where("article_id < 1000"), df.where("article_id >= 1000"))[0].collect()
    assert {(r["train_id"], r["eval_id"]) for r in got} == want and len(want) > n
    assert all(0.5 <= r["similarity"] <= 1 and r["spans"] >= 1 for r in got)


def test_candidates_are_few_and_miss_none():
    """Texts made of common phrases share sequences with nearly all others; few pairs get looked at, all alike ones among them."""
    rng = np.random.default_rng(8)
    phrases = [rng.integers(0, 1 << 62, 9).astype(np.uint64) for _ in range(60)]

    def text(n):
        return [np.r_[phrases[rng.integers(60)], rng.integers(0, 1 << 62, rng.integers(8, 16)).astype(np.uint64)] for _ in range(n)]

    base = [text(int(rng.integers(3, 14))) for _ in range(400)]
    near = [[*x[: len(x) - k % len(x)], *text(k % 4)] for k, x in enumerate(base[:200])]
    flat = lambda docs: (np.concatenate([np.concatenate(x) for x in docs]), np.array([sum(map(len, x)) for x in docs]))
    evaluation, train = flat(base), flat(near + [text(10) for _ in range(200)])
    index = S.Index.build(np.arange(400), *evaluation)
    for cells in (1, 1 << 4, 1 << 20):
        counts = np.bincount((S.tokens(index.sets) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        rarity = np.minimum(counts, 255).astype(np.uint8)
        side = S.Side(lambda name: index.sets, ids=index.ids, sizes=index.sizes, sketch=index.sketch, **S.Side.postings(index.sets, index.sizes, rarity))
        stream = S.Stream(*train, rarity)
        mine, theirs = ([set(x.tolist()) for x in np.split(sets, np.cumsum(sizes)[:-1])] for sets, sizes in ((stream.sets & np.uint64((1 << 48) - 1), stream.sizes), (index.sets, index.sizes)))
        alike = {a * 400 + b for a in range(400) for b in range(400) if 2 * len(mine[a] & theirs[b]) >= len(mine[a] | theirs[b])}
        assert len(alike) > 60 and set(stream.alike(side, 0.5)[0].tolist()) == alike
        assert len(stream.candidates(side)) < 400 * 400 // 200
