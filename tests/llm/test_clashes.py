"""Extra columns, whatever their names, change nothing."""

from pocketloom.llm.contraction import linked_groups
from pocketloom.llm.leakage import leaked_items
from pocketloom.llm.mixing import mixture
from pocketloom.llm.pii import personal_information, redact
from pocketloom.llm.setjoin import similar_pairs
from pocketloom.llm.splits import assign_splits, conflicting_groups, related_groups
from pocketloom.llm.topn import best_poses


def extra(df, *names):
    for n in names:
        df = df.withColumn(n, df[df.columns[0]])
    return df


def test_all(spark):
    poses = spark.createDataFrame([(1, "p", 5, "u", "CC", -1.0, "s"), (2, "q", 6, "u", "CC", -2.0, "s")], "row_id long, pose_id string, loaded_at int, uniprot_id string, ligand string, glide_score double, source_sdf string")
    assert sorted(map(tuple, best_poses(extra(poses, "rank_no", "accession", "molecule", "size", "m")).collect())) == [(1, 2), (2, 1)]
    pairs = extra(spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"), "ligand", "id", "u", "v", "x", "root", "group_ligand")
    assert sorted(map(tuple, linked_groups(pairs, "a", "b").collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    records = extra(spark.createDataFrame([("l", "train", "p"), ("l", "test", "p"), ("m", "val", "p")], "ligand string, split string, uniprot_id string"), "group", "weight", "stratum", "key")
    grouped = related_groups(records, ["ligand", "uniprot_id"])
    assert grouped.select("group").distinct().count() == 1
    assert sorted(r[0] for r in conflicting_groups(grouped, "split", ["train", "test", "val"], ["ligand"]).collect()) == ["l", "m"]
    assert assign_splits(grouped, "uniprot_id").count() == 1
    texts = extra(spark.createDataFrame([("CCCCCCCCN",), ("NCCCCCCCC",)], "t string"), "id", "text", "token", "a", "b")
    assert similar_pairs(texts, "t", 0.3).count() == 1
    words = "a b c d e f g h i j k l m"
    docs = spark.createDataFrame([(1, words, "en", "s")], "doc_id long, text string, lang string, source string")
    docs = extra(docs, "item_id", "window", "id", "d", "i", "n_tokens", "uses", "slice", "k", "p", "t", "pii_type", "redacted")
    items = extra(spark.createDataFrame([(7, words)], "item_id long, text string"), "doc_id", "window", "bit")
    assert [tuple(r) for r in leaked_items(docs, items).collect()] == [(1, 7)]
    targets = extra(spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int"), "tokens_used", "lang")
    assert [r["uses"] for r in mixture(docs, targets)[0].collect()] == [1]
    assert personal_information(docs).collect() == [] and redact(docs).first()["redacted"] == words
