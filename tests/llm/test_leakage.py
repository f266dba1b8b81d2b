import random

from compare import rows

from memq.llm import leakage


def pairs(df):
    return sorted(map(tuple, df.select("doc_id", "item_id").distinct().collect()))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")


def items(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id bigint, text string, tiles int")


W = [f"w{i}" for i in range(60)]


def test_thirteen_words_and_reordered_passages(spark):
    item = " ".join(W[:40])
    texts = [
        "x " + ", ".join(W[5:18]).upper() + " y", " ".join(W[5:17]) + " z", " ".join(W[20:40]) + " and " + " ".join(W[:20]), None, "", item + " " + item, " ".join(W[5:10]) + " z " + " ".join(W[10:20]),
    ]
    out = {r.doc_id: r for r in leakage.leaks(docs(spark, texts), items(spark, [item, None, "", "short"])).collect()}
    assert set(out) == {0, 2, 5}
    assert (out[0].longest, out[0].covered) == (13, 13)
    assert (out[2].tiles, out[2].covered, out[2].coverage) == (2, 40, 1.0)
    assert (out[5].tiles, out[5].coverage) == (1, 1.0)


def test_blocks_give_the_same(spark):
    rng = random.Random(2)
    its = [" ".join(rng.choices(W[:8], k=30)) for _ in range(12)]
    texts = [" ".join(rng.choices(W[:8], k=20)) + " " + rng.choice(its)[: rng.randrange(20, 90)] for _ in range(60)]
    d, i = docs(spark, texts), items(spark, its)
    expected = set()
    for a, t in enumerate(texts):
        grams = {tuple(leakage.words(t)[j : j + 13]) for j in range(len(leakage.words(t)) - 12)}
        for b, s in enumerate(its):
            if any(tuple(leakage.words(s)[j : j + 13]) in grams for j in range(len(leakage.words(s)) - 12)):
                expected.add((a, b))
    assert expected
    whole = leakage.leaks(d, i)
    assert pairs(whole) == sorted(expected)
    assert rows(leakage.leaks(d, i, block_words=60)) == rows(whole)


def test_tiles_never_overlap():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("ab") for _ in range(25)] for _ in range(2))
        seeds = leakage.Seeds([(0, " ".join(b))], 3)
        tiles = leakage.tile(seeds.matches(seeds.number(" ".join(a))).get(0, []), 3)
        marked_a = [x for n, d, _ in tiles for x in range(d, d + n)]
        marked_b = [x for n, _, p in tiles for x in range(p, p + n)]
        assert len(set(marked_a)) == len(marked_a) and len(set(marked_b)) == len(marked_b)
        assert all(a[d : d + n] == b[p : p + n] and n >= 3 for n, d, p in tiles)
        free_a = [None if i in set(marked_a) else x for i, x in enumerate(a)]
        free_b = [0 if i in set(marked_b) else x for i, x in enumerate(b)]
        assert not any(free_a[i : i + 3] == free_b[j : j + 3] for i in range(23) for j in range(23))


def test_empty_tables_and_long_texts(spark):
    one = items(spark, [" ".join(W)])
    assert leakage.leaks(docs(spark, []), one).count() == 0
    assert leakage.leaks(docs(spark, ["a"]), one.limit(0)).count() == 0
    assert leakage.leaks(docs(spark, ["z " * 500_000 + " ".join(W[3:30])]), one).first().covered == 27
