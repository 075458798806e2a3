import random

import pytest
from pyspark.sql import functions as F

from teleloom.llm import quality

PROSE = ["The store was not able to keep up with the load, and nobody had noticed it until the morning.", "If you look at the numbers again, then it is clear that they were too high for most of the day.",
         "Die Grenze war zu niedrig, und niemand hat es in der Nacht bemerkt, weil das Archiv noch nicht voll war.", "La limite était trop basse, et personne ne l'a remarqué avant le redémarrage du service dans la nuit.", "El límite era muy bajo, y nadie lo había visto hasta que el servicio se detuvo en la noche."]
OTHER = ["* view places\n* shipper limits\n* cache blobs\n* job mails\n* zone mails\n* index orders", "2026-03-20T17:35:30.427Z WARN [audit] shard 883 renewed\n2026-03-14T08:56:44.845Z ERROR [index] reload took 486 ms", "| a | b | c |\n|---|---|---|\n| 760 ms | true | 96.57 |\n| 43.38 | - | 834 ms |",
         "Mrk5UmWjVUS/K5uMfQTrw+6uJsxI+yiuHoX3R5txG1E6f2DiNmr+daL2UKlLLziMpWQ6FS9r3/sY\n8mlr8AvRr+8T8ScHKMTE1sprcvCc1kgLerk8r6U7s3ryQAOcdQ9RmTP6U569uVZh4QThu2s5J", "Home | Help | Docs | Sign in | Metrics | Next | Previous | About", "orders links tags counter agent zone labels encoder tokens queue results frontend. Stock hour feed.", "tuquiono: 36.45\nbabasha: -\n  shatuba: 47.42\n    venko: geo-lookup\nmizelgru: true\nkoden: 88 ms"]


@pytest.fixture(scope="module", params=["learned", "fixed"])
def profiles(request):
    if request.param == "fixed":
        return quality._default()
    rng = random.Random(1)
    texts = [("\n\n".join(rng.choices(PROSE, k=4)), True) for _ in range(60)] + [("\n\n".join(rng.choices(OTHER, k=4)), False) for _ in range(60)]
    return quality.learn(texts)


def test_kinds_of_text(profiles):
    for t in PROSE:
        assert quality.statistics_of(t, profiles)[-1], t
    for t in OTHER:
        assert not quality.statistics_of(t, profiles)[-1], t


def test_half_of_the_characters_decides(profiles):
    log = OTHER[1]
    assert quality.statistics_of(PROSE[0] * 4 + "\n\n" + log, profiles)[-1] and not quality.statistics_of(PROSE[0] + "\n\n" + (log + "\n") * 3, profiles)[-1]
    assert quality.statistics_of(PROSE[1].lower().replace(",", ""), profiles)[-1]


def test_odd_texts(profiles):
    names = [x.split()[0] for x in quality.STATS.split(", ")]
    for t in (None, "", " \n\t "):
        r = dict(zip(names, quality.statistics_of(t, profiles)))
        assert r["n_words"] == 0 and r["structure"] == "blank" and r["is_prose"] is False and r["mean_word_length"] is None
    for t in ("x", "!!!", "​", "\x00\x01", "中文 " * 50, "\n".join(["a"] * 5000), PROSE[0] * 3000):
        r = dict(zip(names, quality.statistics_of(t, profiles)))
        assert 0 <= r["prose_share"] <= 1 and r["n_chars"] == len(t)


def test_saved_profiles_are_the_same(profiles):
    again = quality.Profiles.load(profiles.dump())
    assert all(quality.statistics_of(t, again)[-3] == quality.statistics_of(t, profiles)[-3] for t in PROSE + OTHER)


def test_divergence():
    p = quality.distribution(quality.token_vector(PROSE[0])[0])
    q = quality.distribution(quality.token_vector(OTHER[1])[0])
    assert quality.divergence(p, p) == 0 and 0 < quality.divergence(p, q) <= 1 and abs(quality.divergence(p, q) - quality.divergence(q, p)) < 1e-12


def test_in_spark(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE + OTHER)] + [(90, None), (91, ""), (0, PROSE[0])], "doc_id bigint, text string").withColumn("i", F.lit("clash")).withColumn("n_words", F.lit(1))
    labels = [(i, a, "prose" if i < len(PROSE) else "other") for i in range(len(PROSE + OTHER)) for a in "ab"] + [(0, "c", "other"), (0, "a", "prose"), (1, None, None), (90, "a", "other"), (None, "a", "prose"), (777, "a", "prose")]
    lab = spark.createDataFrame(labels, "doc_id bigint, annotator string, label string")
    p = quality.fit_profiles(docs, lab)
    assert p.prose.any() and not p.prose.all()
    got = quality.statistics(docs, p)
    assert got.count() == 15 and {r["doc_id"] for r in got.filter("is_prose").collect()} == set(range(len(PROSE)))
    assert quality.fit_profiles(docs, lab.limit(0)).names[0] == "prose" and quality.statistics(docs.limit(0), p).count() == 0
    c = {r["doc_id"]: r for r in quality.counts(docs).collect()}
    assert (c[90]["n_chars"], c[91]["n_lines"], c[5]["n_lines"], c[5]["n_words"]) == (0, 0, 6, 18)
