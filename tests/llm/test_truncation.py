import numpy as np
import pyspark.sql.functions as F

from rankspark.llm import truncation as T
from rankspark.sources import articles

SCHEMA = "article_id long, source string, content string"


def held_out(spark, data):
    """Finished texts of the data, a fifth of them cut inside a sentence at a fixed length or anywhere."""
    rng = np.random.default_rng(9)
    rows, cut = [], set()
    for r in articles(spark, data, "content").dropDuplicates(["article_id"]).orderBy("article_id").collect():
        text = r["content"]
        if not text or not text.rstrip().endswith((".", ".</p>")) or len(text) < 300:
            continue
        text = text.rstrip().removesuffix("</p>")
        i = len(rows)
        if i % 5 == 0:
            at = 250 if i % 2 else int(rng.integers(150, len(text) - 5))
            head = text[:at].rstrip()
            if head[-1:] in ".!?>”“\"»" or head.endswith(("</p", "<p", "&amp;", ";")):
                continue
            text = head + ("", "…", " […]")[int(rng.integers(3))]
            cut.add(i)
        rows.append((i, r["feed_name"], text + ("</p>" if "<p>" in text else "")))
    return rows, cut


def test_held_out_accuracy(spark, data):
    rows, cut = held_out(spark, data.replace("0.001", "0.01"))
    got = {r[0] for r in T.cut_off(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = sum((i in got) == (i in cut) for i, _, _ in rows)
    assert len(cut) > 100 and right >= 0.97 * len(rows)


def test_own_text():
    site = T.Site(["read more at the gazette", "0 comments"])

    def own(c):
        found = T.own_text(c, site)
        return found and ([*T.texts_of(found[0]), found[1]], *found[2:])

    assert own("<p>It ends.</p>\n<p>12 comments</p>\n<p>Read more at The Gazette</p>")[:2] == (["It ends."], "")
    assert own("It ends.\nRead more at the ga")[:2] == (["It ends."], "")  # a cut notice of the site
    assert own("It was […]")[:2] == (["It was"], "mark")
    assert own("It was <a href=\"x")[:2] == (["It was"], "tag")
    assert own("It was caf&eac")[:2] == (["It was caf"], "entity")
    assert own("It was caf�")[:2] == (["It was caf"], "broken")
    assert own("5 comments") is None and own(" \n ") is None and own("…")[0] == ["…"]


def test_rates_and_edges(spark, data):
    df = articles(spark, data, "content").withColumn("source", F.col("feed_name"))
    extra = spark.createDataFrame([(1, None, "x"), (None, "s", "x"), (2, "s", None), (3, "s", ""), (4, "s", " \n"), (5, "s", "word " * 50_000)], SCHEMA)
    rows = df.select("article_id", "source", "content").unionByName(extra).withColumns({"label": F.lit("x"), "site": F.lit(1), "limits": F.lit(2)})
    got = T.cut_off(rows)
    ids = [r[0] for r in got.collect()]
    assert len(ids) == len(set(ids)) and not set(ids) & {1, 2, 3, 4} and 0 < len(ids) < 0.3 * df.count()
    rates = {r["source"]: r for r in T.rates(rows).collect()}
    assert rates["s"]["articles"] == 4 and sum(r["cut_off"] for r in rates.values()) == len(ids)
    assert T.cut_off(rows.limit(0)).count() == 0 and T.rates(rows.limit(0)).count() == 0


def test_long_footers_and_long_notices_are_site_matter(spark, data):
    """A footer of any number of lines, and of lines of any length, hides no cut and makes none."""
    rows, cut = held_out(spark, data.replace("0.001", "0.01"))
    foot = "\n".join([f"Footer line number {'abcdefghijkl'[k]} of the site" for k in range(12)] + ["This notice is long and ends properly. " * 20])
    rows = [(i, "one source", c + "\n" + foot) for i, _, c in rows]
    got = {r[0] for r in T.cut_off(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum((i in got) == (i in cut) for i, _, _ in rows) >= 0.97 * len(rows)


def test_the_fit_is_a_few_tasks(spark, data):
    """The training sample is one partition, whatever the number of partitions of the articles."""
    df = articles(spark, data, "content").withColumn("source", F.col("feed_name")).repartition(40)
    tracker, group = spark.sparkContext.statusTracker(), "p4-fit"
    spark.sparkContext.setJobGroup(group, group)
    try:
        T.cut_off(df).count()
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        tasks = sum(i.numTasks for s in set(stages) if (i := tracker.getStageInfo(s)) and i.numCompletedTasks)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks < 600
