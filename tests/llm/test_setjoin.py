import random

from pocketloom.llm import setjoin
from pocketloom.llm.setjoin import linked_texts, similar_pairs


def brute(texts, threshold, q):
    sets = {t: {t[i : i + q] for i in range(len(t) - q + 1)} for t in {x for x in texts if x and len(x) >= q}}
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def texts(seed, n=250, alphabet="CNO(=)c1é"):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) for _ in range(12)]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(n)]
    for t in list(out[: n // 2]):
        k = rng.randrange(len(t) + 1)
        out += [t[:k] + rng.choice(parts) + t[k:], t + t, t]
    return [*out, None, "", "C" * 7, "C" * 8, "C" * 200, "CO" * 300]


def test_matches_brute_force(spark):
    for seed, threshold, q in ((1, 0.6, 8), (2, 0.8, 3), (3, 0.45, 8), (4, 1.0, 2)):
        rows = texts(seed)
        got = [tuple(r) for r in similar_pairs(spark.createDataFrame([(t,) for t in rows], "t string"), "t", threshold, q).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, threshold, q)


def test_lists_in_blocks_give_the_same(spark):
    rows = texts(9, 120)
    got = similar_pairs(spark.createDataFrame([(t,) for t in rows], "t string"), "t", 0.6, 8, block=7).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 0.6, 8))


def test_long_text_many_pairs_and_links(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "AT_ONCE", 64)
    rows = ["x" * 12 + str(i) for i in range(60)] + ["".join(chr(33 + (i * i) % 90) for i in range(30_000))]
    pairs = similar_pairs(spark.createDataFrame([(t,) for t in rows], "t string"), "t", 0.2, 8)
    want = brute(rows, 0.2, 8)
    assert {tuple(r) for r in pairs.collect()} == want
    assert sum(r["links"] for r in linked_texts(pairs, "a", "b").collect()) == 2 * len(want)


def test_empty(spark):
    assert similar_pairs(spark.createDataFrame([], "t string"), "t").collect() == []


def test_between_two_tables(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("CNO", k=rng.randrange(6, 30))) for _ in range(60)]
    left = [*base, None, "", *base[:5]]
    right = [t[: rng.randrange(len(t))] + rng.choice("CNO") + t[rng.randrange(len(t)) :] for t in base for _ in range(2)] + base[:10] + [None]
    a, b = spark.createDataFrame([(t,) for t in left], "text string"), spark.createDataFrame([(t, 1) for t in right], "other string, side int")
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    want = {(x, y) for x in left if x for y in right if y and grams(x) and grams(y) and len(grams(x) & grams(y)) >= 0.6 * len(grams(x) | grams(y))}
    for block in (50_000, 7):
        got = [tuple(r) for r in similar_pairs(a, "text", 0.6, 4, block, b, "other").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert similar_pairs(a, "text", 0.6, 4, others=b.limit(0), other_column="other").collect() == []
