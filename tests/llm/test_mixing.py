import random

from pocketloom.llm.mixing import Node, allocate, mixture

DOCS = "doc_id long, text string, lang string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def test_shortage_goes_to_siblings_before_ancestors():
    root = Node(1, children={"a": Node(0.5, children={"en": Node(1, 30), "de": Node(1, 1000)}), "b": Node(0.5, children={"en": Node(1, 1000)})})
    assert allocate(root, 400) == 0
    a = root.children["a"].children
    assert (a["en"].budget, a["de"].budget, root.children["b"].children["en"].budget) == (30, 170, 200)
    assert allocate(root, 10_000) == 10_000 - (1000 - 170) - (1000 - 200)


def corpus(n=1500):
    rng = random.Random(2)
    names = ["x", " X ", "y", "Y", "z", "other", None]
    return [(i, " ".join(["word"] * rng.randrange(0, 60)) or rng.choice([None, ""]), rng.choice(["en", "EN ", "de", "??", None]), rng.choice(names)) for i in range(n)]


def test_shares_are_reached_and_repeats_capped(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("X", 0.6, 2), (" y", 0.3, 1), ("z", 0.1, 4), ("none", 0.2, 1), ("z", None, 3), ("bad", -1.0, 1)], TARGETS)
    chosen, report = mixture(docs, targets)
    rows, by = chosen.collect(), {r["source"]: r for r in report.collect()}
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["uses"] <= {"x": 2, "y": 1, "z": 4}[r["source"]] for r in rows)
    total = sum(r["tokens_used"] for r in by.values())
    for s, share in (("x", 0.6), ("y", 0.3), ("z", 0.1)):
        used = sum(r["uses"] * r["n_tokens"] for r in rows if r["source"] == s)
        assert used == by[s]["tokens_used"] and abs(used / total - share) < 0.01 and abs(by[s]["share_reached"] - used / total) < 1e-12
    assert by["none"]["tokens_used"] == 0
    again = mixture(docs.repartition(5), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_a_larger_total_is_made_up_by_other_sources(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("x", 0.5, 3), ("z", 0.5, 1)], TARGETS)
    have = {r["source"]: r["tokens_available"] for r in mixture(docs, targets)[1].collect()}
    used = {r["source"]: r["tokens_used"] for r in mixture(docs, targets, total=have["z"] * 3)[1].collect()}
    assert used["z"] == have["z"] and abs(used["x"] - 2 * have["z"]) < 200


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("x", 1.0, 1)], TARGETS)
    chosen, report = mixture(spark.createDataFrame([], DOCS), targets)
    assert chosen.collect() == [] and report.first()["share_reached"] == 0
    assert mixture(spark.createDataFrame(corpus(50), DOCS), spark.createDataFrame([], TARGETS))[0].collect() == []


def test_a_source_that_runs_short_is_made_up_for_by_its_own_domain(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("x", 0.4, 5), ("y", 0.4, 5), ("z", 0.2, 1)], TARGETS)
    have = {r["source"]: r["tokens_available"] for r in mixture(docs, targets)[1].collect()}
    total = have["z"] * 8
    used = {r["source"]: r["tokens_used"] for r in mixture(docs, targets, total, domains={"y": "d", "z": "d"})[1].collect()}
    assert used["z"] == have["z"] and abs(used["x"] - 0.4 * total) < 200 and abs(used["y"] - (0.6 * total - have["z"])) < 200
