import random

from pocketloom.llm.leakage import leak_report, leaked_items, words


def brute(docs, items, n=12):
    index = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            index.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t or "")] for k in range(len(w) - n + 1) for i in index.get(tuple(w[k : k + n]), ())}


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_words():
    assert words("Ａb_c-Ｄ ½ É\n12") == ["ab", "c", "d", "1", "2", "é", "12"]


def test_matches_brute_force_in_altered_dress(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)))) for i in range(40)] + [(98, None), (99, "")]
    items.append((50, items[0][1]))
    docs = []
    for d in range(200):
        own = rng.choices(vocabulary, k=rng.randrange(0, 400))
        if d % 3 == 0:
            passage = words(items[rng.randrange(40)][1])
            k = rng.randrange(max(1, len(passage) - 8))
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[k : k + rng.randrange(6, 40)]
        text = rng.choice([" ", "\n", " _", ", "]).join(own)
        docs.append((d, rng.choice([text, text.upper(), "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in text)])))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    a, b = tables(spark, docs, items)
    got = [tuple(r) for r in leaked_items(a, b).collect()]
    want = brute(docs, items)
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    report = {r["item_id"]: r["documents"] for r in leak_report(leaked_items(a, b), b).collect()}
    assert len(report) == len(items) and sum(report.values()) == len(want)


def test_a_crowded_filter_loses_and_adds_nothing(spark):
    docs, items = [(1, " ".join(map(str, range(500))))], [(1, " ".join(map(str, range(100, 112)))), (2, " ".join(map(str, range(200, 211))))]
    assert [tuple(r) for r in leaked_items(*tables(spark, docs, items), bits_each=1, most_bits=64).collect()] == [(1, 1)]


def test_more_items_than_one_filter_serves(spark):
    """Several passes, and ids that are null."""
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices("abcdefgh", k=40))) for i in range(30)]
    docs = [(i if i else None, " ".join(rng.choices("xyz", k=30)) + " " + items[i][1][:60]) for i in range(30)]
    tables_ = tables(spark, docs, items)
    want = brute(docs, items)
    assert {tuple(r) for r in leaked_items(*tables_, most_bits=1 << 13).collect()} == want == {tuple(r) for r in leaked_items(*tables_).collect()} and len(want) >= 30


def test_empty_sides(spark):
    full = [(1, "a b c d e f g h i j k l m")]
    assert leaked_items(*tables(spark, [], full)).collect() == [] == leaked_items(*tables(spark, full, [])).collect()
