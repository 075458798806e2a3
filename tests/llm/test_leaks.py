import random

from pyspark.sql import functions as F

from teleloom.llm import leaks

RNG = random.Random(5)
VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("l", "n", "rt", "sk")]


def sentence(n, rng=RNG):
    return [rng.choice(VOCAB) + rng.choice("xyz") * rng.randrange(2) for _ in range(n)]


ITEMS = {i: sentence(60) for i in range(40)}
SHARED = sentence(24)
for i in range(20):
    ITEMS[i] = ITEMS[i] + SHARED


def index():
    return leaks.Index([(i, " ".join(w)) for i, w in ITEMS.items()])


def edited(words, rng, rate=1 / 9):
    out, k = [], 0
    for i, w in enumerate(words):
        k += 1
        if k * rate >= 1 and rng.random() < 0.5:
            k = 0
            kind = rng.randrange(3)
            out += [["zzz"], [], [w, "qqq"]][kind]
        else:
            out.append(w)
    return out


def test_exact_passages_of_any_place_and_length():
    ix, rng = index(), random.Random(1)
    for i in range(0, 40, 3):
        for n in (20, 33, 60):
            a = rng.randrange(0, 60 - n + 1)
            text = " ".join(sentence(rng.randrange(90), rng) + ITEMS[i][a : a + n] + sentence(rng.randrange(90), rng))
            assert [x for x, _ in leaks.leaked(ix, text)] == [i], (i, n)


def test_short_passages_and_shared_wording_do_not_count():
    ix, rng = index(), random.Random(2)
    for i in range(0, 40, 3):
        assert leaks.leaked(ix, " ".join(sentence(50, rng) + ITEMS[i][10:27] + sentence(50, rng))) == []
    assert leaks.leaked(ix, " ".join(sentence(50, rng) + SHARED + sentence(50, rng))) == []


def test_edits_layout_and_markup():
    ix, rng = index(), random.Random(3)
    found = 0
    for i in range(40):
        w = edited(ITEMS[i][:50], rng)
        lines = [" ".join(w[a : a + 6]).upper() for a in range(0, len(w), 6)]
        text = "\n".join(f"{k}. <b>{x[:-3]}­-\n{x[-3:]}</b>&nbsp;," for k, x in enumerate(lines, 1))
        found += i in [x for x, _ in leaks.leaked(ix, text)]
    assert found >= 38


def test_search_returns_all_items_at_the_threshold():
    ix, rng = index(), random.Random(4)
    for _ in range(50):
        words = ITEMS[rng.randrange(40)][5:40] + SHARED[:10] + sentence(20, rng)
        grams = {g for g in zip(words, words[1:]) if g in ix.post}
        score = {}
        for g in grams:
            for j, x in ix.post[g]:
                score[j] = score.get(j, 0) + x
        for t in (5.0, 20.0, 60.0):
            assert sorted(ix.search(grams, t)) == sorted(j for j, x in score.items() if x >= t)


def test_alignment_against_plain_recursion():
    rng = random.Random(6)
    for _ in range(30):
        a, b = [rng.choice("abc") for _ in range(9)], [rng.choice("abc") for _ in range(12)]
        s = [[0] * 13 for _ in range(10)]
        for i in range(1, 10):
            for j in range(1, 13):
                s[i][j] = max(0, s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -2), s[i - 1][j] - 2, s[i][j - 1] - 2)
        path = leaks.align(a, b)
        assert sum(1 if e else -2 for _, _, e in path) == max(map(max, s))


def test_in_spark_with_odd_rows(spark):
    docs = [(1, " ".join(ITEMS[3][:30])), (1, " ".join(ITEMS[3][:30])), (2, None), (3, ""), (4, " ".join(ITEMS[7][20:] + ["filler"] * 50_000 + ITEMS[8][:25])), (None, " ".join(ITEMS[9])), (5, "short")]
    items = [(i, " ".join(w)) for i, w in ITEMS.items()] + [(100, None), (101, ""), (None, "some text of no item"), (102, "one")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, e).collect()}
    assert got == {(1, 3), (4, 7), (4, 8), (None, 9)}
    assert leaks.find_leaks(d.limit(0), e).count() == 0 and leaks.find_leaks(d, e.limit(0)).count() == 0


def test_parts_of_a_large_item_set_find_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, " ".join(w[:30])) for i, w in ITEMS.items()], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id bigint, text string")
    monkeypatch.setattr(leaks, "MOST_ITEMS", 15)
    assert {tuple(r)[:2] for r in leaks.find_leaks(d, e).collect()} == {(i, i) for i in ITEMS}


def plain_search(ix, terms, threshold):
    score = {}
    for g in terms:
        for j, x in ix.post[g]:
            score[j] = score.get(j, 0) + x
    return sorted(j for j, x in score.items() if x >= threshold)


def test_block_max_wand_against_all_postings():
    rng = random.Random(8)
    common = [sentence(30, rng) for _ in range(6)]  # wording in dozens of items each: long postings of many blocks
    texts = [sentence(40, rng) + rng.choice(common) + sentence(20, rng) for _ in range(300)]
    ix = leaks.Index([(i, " ".join(w)) for i, w in enumerate(texts)], block=4)
    some = 0
    for _ in range(200):
        w = rng.choice(common)[: rng.randrange(5, 30)] + rng.choice(texts)[rng.randrange(40) :][:25] + sentence(10, rng)
        terms = {g for g in zip(w, w[1:]) if g in ix.post}
        for t in (0.05, 0.3, 1.0, 2.0):
            got = ix.search(terms, t)
            some += len(got)
            assert sorted(got) == plain_search(ix, terms, t) and len(got) == len(set(got))
    assert some > 500


def test_a_single_item_and_very_long_items():
    rng = random.Random(9)
    for n_items, length in ((1, 60), (2, 60), (4, 3000), (60, 1500)):
        items = {i: sentence(length, rng) for i in range(n_items)}
        ix = leaks.Index([(i, " ".join(w)) for i, w in items.items()])
        for i in list(items)[:4]:
            a = rng.randrange(length - 20 + 1)
            plain = items[i][a : a + 20]
            spoilt = [w if k not in (4, 11) else "zzz" for k, w in enumerate(plain)]
            for passage in (plain, spoilt):
                text = " ".join(sentence(70, rng) + passage + sentence(70, rng))
                assert [x for x, _ in leaks.leaked(ix, text)] == [i], (n_items, length)


def test_recall_of_edited_passages_of_twenty_words():
    ix, rng, found, tried = index(), random.Random(10), 0, 0
    for i in range(40):
        for a in range(0, 40, 5):
            w = list(ITEMS[i][a : a + 20])
            for k in rng.sample(range(1, 19), 2):  # one word in ten
                w[k] = rng.choice(["zzz", "", w[k] + " qqq"])
            tried += 1
            found += i in [x for x, _ in leaks.leaked(ix, " ".join(sentence(40, rng) + w + sentence(40, rng)))]
    print(f"recall {found}/{tried}")
    assert found >= 0.9 * tried


def test_own_passage_beside_a_longer_shared_one():
    rng = random.Random(11)
    own, shared = [sentence(24, rng) for _ in range(5)], sentence(40, rng)
    ix = leaks.Index([(i, " ".join(shared + w)) for i, w in enumerate(own)])
    text = " ".join(shared + sentence(4, rng) + own[2][:20] + sentence(30, rng))
    assert [x for x, _ in leaks.leaked(ix, text)] == [2]


def test_repeated_items_and_copies_under_several_ids():
    ix = leaks.Index([(1, " ".join(ITEMS[30]))] * 5 + [(i, " ".join(ITEMS[31])) for i in (7, 8, 9)] + [(20, " ".join(ITEMS[32]))])
    text = " ".join(ITEMS[30][:25] + ["zzz"] * 60 + ITEMS[31][:25])
    assert sorted(x for x, _ in leaks.leaked(ix, text)) == [1, 7, 8, 9]


def test_parts_count_shared_wording_over_all_items(spark, monkeypatch):
    rng = random.Random(12)
    shared = sentence(30, rng)
    items = [(i, " ".join(sentence(30, rng) + (shared if i < 4 else sentence(30, rng)))) for i in range(40)]
    docs = [(0, " ".join(shared)), (1, " ".join(words for words in items[3][1].split()[:30])), (2, " ".join(items[20][1].split()[10:40]))]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(tuple(r) for r in leaks.find_leaks(d, e).collect())
    assert [x[:2] for x in whole] == [(1, 3), (2, 20)]
    monkeypatch.setattr(leaks, "MOST_ITEMS", 10)
    assert sorted(tuple(r) for r in leaks.find_leaks(d, e).collect()) == whole


def test_exact_runs_are_all_found(spark):
    docs = [(i, " ".join(sentence(15) + w[7:40] + sentence(15))) for i, w in ITEMS.items()] + [(99, None), (98, "")]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id bigint, text string")
    exact = {tuple(r) for r in leaks.exact_runs(d, e).collect()}
    assert exact == {(i, i) for i in ITEMS} and exact <= {tuple(r)[:2] for r in leaks.find_leaks(d, e).collect()}
    assert leaks.exact_runs(d.limit(0), e).count() == 0
