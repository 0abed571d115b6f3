import random

import pyspark.sql.functions as F
import pytest

from rankspark.llm import garbled as G

SAMPLES = {
    "fr": "À l’été, le théâtre a déjà dépensé 500 € ; « la forêt brûlée », répète-t-on — où l’idée était née.",
    "de": "Die Bücherei möchte fünf Züge für größere Höfe – „das Gewächshaus“, erklärte der Käser.",
    "pl": "Związek wędkarzy chce zamknąć halę, podkreśla ośrodek zdrowia; żąda wyjaśnień i książki.",
    "es": "¿Por qué el señorío añadió más días? «La asociación enseñará a los niños», señaló según lo previsto.",
    "ru": "Дорожная служба проверяет новые счётчики, и никто не ждёт быстрого решения.",
    "en": "“It took us far too long,” said Zoë Ångström — about £5 in a café, naïve as that is.",
    "ja": "今日の天気は晴れ、最高気温は十八度。 H₂O: Σ = 3.4 µg/m³ ▁▂▃▅▇ 🎉 plain words",
}


def clean_rows(n=60):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        for lang, text in SAMPLES.items():
            words = text.split(" ")
            rng.shuffle(words)
            rows.append((len(rows), f"{text} {' '.join(words)} {k}"))
    return rows


def garble(text, written, read):
    if read in G.WIDE:
        return text.encode(written, "replace").decode(read, "replace")
    table = {b[0]: c for c, b in G._BYTES[read].items()}
    return "".join(chr(b) if b < 128 else chr(table[b]) for b in text.encode(written, "replace"))


@pytest.fixture(scope="module")
def model():
    texts = [t for _, t in clean_rows()] * 3
    texts += [garble(t, "utf-8", "western") for t in texts[:40]]  # a share of the training texts is garbled itself
    return G.fit_words([G.WORD.findall(t) for t in texts])


def test_clean_texts_stay(model):
    for _, text in clean_rows(5):
        assert not G.text_labels(model, text)[1]
    for text in ("", None, "ascii only & so on", "&#233; &eacute;"):
        assert not G.text_labels(model, text)[1]


CASES = [("fr", "utf-8", r) for r in ("western", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")] + [
    ("de", "utf-8", "western"), ("ru", "utf-8", "western"), ("ru", "utf-8", "cp1251"), ("ja", "utf-8", "western"), ("pl", "utf-8", "western"),
    ("de", "cp1252", "cp437"), ("fr", "cp1252", "cp437"), ("fr", "cp1252", "mac_roman"), ("pl", "cp1250", "western"), ("pl", "iso8859-2", "western"),
    ("ru", "cp1251", "western"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "koi8-r"), ("es", "mac_roman", "western"),
]


@pytest.mark.parametrize("lang, written, read", CASES)
def test_pairs_are_found_and_undone(model, lang, written, read):
    text = SAMPLES[lang]
    text = text.encode(written, "ignore").decode(written) if written != "utf-8" else text
    bad = garble(text, written, read)
    assert bad != text and G.text_labels(model, bad)[1]
    fixed, whole = G.restore(model, bad)
    same = sum(a == b for a, b in zip(fixed.split(), text.split())) / len(text.split())
    assert same >= 0.9


def test_one_garbled_word_in_a_clean_text(model):
    text = SAMPLES["fr"].replace("forêt", garble("forêt", "utf-8", "western"))
    assert G.restore(model, text) == (SAMPLES["fr"], True)


def test_twice_escaped_and_lost(model):
    text = SAMPLES["de"]
    twice = garble(garble(text, "utf-8", "western"), "utf-8", "western")
    assert G.restore(model, twice) == (text, True)
    escaped = "".join(c if c < "\x80" else f"&#{ord(c)};" for c in garble(text, "utf-8", "western"))
    assert G.restore(model, escaped) == (text, True)
    lost = text.encode("cp1252").decode("utf-8", "replace")
    assert G.text_labels(model, lost)[1] and G.restore(model, lost)[1] is False


def test_named_references_and_multi_byte_readings(model):
    text = SAMPLES["fr"]
    named = "".join(c if c < "\x80" else f"&{G.html.entities.codepoint2name[ord(c)]};" if ord(c) in G.html.entities.codepoint2name else c for c in garble(text, "utf-8", "western"))
    assert "&Atilde;" in named and G.restore(model, named) == (text, True)
    assert not G.text_labels(model, "Plain text with caf&eacute; &amp; more")[1]
    for lang, written, read in (("ja", "utf-8", "gbk"), ("ja", "utf-8", "shift_jis"), ("ja", "utf-8", "euc_kr"), ("ru", "utf-8", "gbk"), ("ja", "shift_jis", "western")):
        assert G.text_labels(model, garble(SAMPLES[lang].encode(written, "ignore").decode(written), written, read))[1], (lang, written, read)


@pytest.mark.parametrize("written, read, pattern", [("cp1251", "western", "[а-яё]{4}"), ("koi8-r", "cp1251", "[а-яё]{4}"), ("utf-8", "western", "[à-ÿ]")])
@pytest.mark.parametrize("share", [0.02, 0.3, 0.5])
def test_common_garbling_is_found(spark, data, written, read, pattern, share):
    """A share of all texts of one script is misread: the model must not take that for a language."""
    import re

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").collect() if r["text"]]
    rows = [(i, t) for i, t in rows if not any(x in t for x in ("Ã", "â€", "�", "Ð", "Ñ"))]
    rng = random.Random(3)
    wanted, texts = set(), {}
    for i, t in rows:
        texts[i] = t
        if re.search(pattern, t) and rng.random() < share:
            bad = garble(t.encode(written, "ignore").decode(written, "ignore"), written, read)
            if sum(c > "\x7f" for c in bad) > 8:
                wanted.add(i)
                texts[i] = bad
    before = G.fit_words([G.spread(G.WORD.findall(t)) for _, t in rows])
    clean = {i for i, t in rows if not G.text_labels(before, t)[1]}
    model = G.fit_words([G.spread(G.WORD.findall(t)) for t in texts.values()])
    found = {i for i, t in texts.items() if G.text_labels(model, t)[1]}
    assert len(found & wanted) >= 0.95 * len(wanted)
    assert len(found & (clean - wanted)) <= 0.01 * len(clean)


def test_on_tables(spark):
    rows = [*clean_rows(20), (10_000, garble(SAMPLES["fr"], "utf-8", "western")), (10_001, None), (10_002, ""), (10_003, SAMPLES["en"] * 3000), (10_000, garble(SAMPLES["fr"], "utf-8", "western"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "restored": F.lit("x")})
    assert [r[0] for r in G.found(df).collect()] == [10_000, 10_000]
    assert {tuple(r) for r in G.restored(df).collect()} == {(10_000, SAMPLES["fr"], True)}
    assert G.found(df.limit(0)).count() == 0


def test_the_model_comes_from_all_words(spark):
    """Every word of a long text counts, and words of more than 100 characters do as a whole."""
    rows = [*clean_rows(10), (10_000, " ".join(SAMPLES[k] for k in ("fr", "de", "es")) * 40), (10_001, "é" * 150 + " ñ"), (10_002, garble(SAMPLES["fr"], "utf-8", "western")), (10_003, None)]
    made = G.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    whole = G.fit_words([w for _, t in rows if t and (w := G.WORD.findall(G.resolve(t)))])
    assert (made.pairs, made.firsts, made.total) == (whole.pairs, whole.firsts, whole.total)
    assert made.pairs["éé"] >= 149


def test_words_are_those_of_the_pattern():
    texts = ["", "plain", "é", "aé bé", "xxé1abc2éx", "a-bé_cé&#233;d", "été&eacute; naïve", *SAMPLES.values(), *(garble(SAMPLES["fr"], "utf-8", r) for r in ("western", "gbk", "cp437"))]
    for text in texts:
        assert G.words_of(text) == G.WORD.findall(G.resolve(text))


def test_on_the_data(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    ids = {r[0] for r in G.found(docs).collect()}
    plain = {r["doc_id"] for r in docs.collect() if r["text"] and any(x in r["text"] for x in ("Ã©", "â€", "Ã¼", "�", "Ã³"))}
    assert plain <= ids and len(ids) < 0.15 * docs.count()
