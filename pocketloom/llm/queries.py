"""Queries of this package over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pocketloom.llm.contraction import linked_groups
from pocketloom.llm.leakage import leak_report, leaked_items
from pocketloom.llm.mixing import mixture
from pocketloom.llm.pii import personal_information, redact
from pocketloom.llm.setjoin import linked_texts, similar_pairs
from pocketloom.llm.splits import FRACTIONS, assign_splits, conflicting_groups, related_groups
from pocketloom.llm.topn import best_poses
from pocketloom.queries.sql import trim
from pocketloom.runtime import SPACE, accession, materialize, small, table, trimmed

ACTIVE = ["train", "val", "test"]
#: Rows that share any of these are related.
RELATED = ["ligand", "spelling"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return best_poses(table(spark, sf, "pose_manifest"))


def _split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of affinity_split_manifest with their ligand in normal form and as it is spelt, and the split of their label."""
    ligand = trimmed("ligand")
    rows = table(spark, sf, "affinity_split_manifest").select(
        "row_id", ligand.alias("ligand"), F.when(ligand.isNotNull(), F.col("ligand")).alias("spelling"), accession("uniprot_id").alias("uniprot_id"), F.lower(trimmed("split")).alias("label")
    )
    labels = table(spark, sf, "split_labels").select(F.lower(trimmed("label")).alias("label"), F.lower(trimmed("split")).alias("split")).distinct()
    if small(labels):
        labels = F.broadcast(labels)
    return rows.join(labels, "label", "left").drop("label")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Ligands whose rows, related by any spelling or by the ligand itself, carry at least two of the active splits."""
    return conflicting_groups(related_groups(_split_rows(spark, sf), RELATED), "split", ACTIVE, ["ligand"])


def _assigned(records: DataFrame, links: DataFrame | None = None) -> DataFrame:
    grouped = related_groups(records, RELATED, links)
    splits = assign_splits(grouped, "uniprot_id")
    return grouped.join(splits, "group", "left").select("row_id", "ligand", "split")


def p2_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Each row with the split assigned to its ligand; null where it has no ligand."""
    return _assigned(_split_rows(spark, sf).drop("split")).select("row_id", "split")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ligand_match").where(F.lower(trimmed("verdict")) == "match")
    return rows.select(trimmed("ligand_a").alias("a"), trimmed("ligand_b").alias("b"))


def p2_assign_linked(spark: SparkSession, sf: str) -> DataFrame:
    """As p2_assign, but ligands that ligand_match links, directly or through others, share a split as well."""
    return _assigned(_split_rows(spark, sf).drop("split"), _matches(spark, sf)).select("row_id", "split")


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the rows that each split of p2_assign got, beside its target, to three places."""
    rows = _assigned(_split_rows(spark, sf).drop("split")).where("split IS NOT NULL")
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") / F.sum("rows").over(W.partitionBy())  # a row for each split
    target = F.create_map(*(F.lit(x) for pair in FRACTIONS.items() for x in pair))
    return counts.select("split", "rows", F.round(share, 4).alias("share"), F.element_at(target, F.col("split")).alias("target"))


def _rules(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """One row: rows with and without a split, ligands in more than one, links across splits, and whether each split's
    share lies within 0.2 points of its target, or within two rows of it where these are more."""
    rows = materialize(assigned, "assigned")
    of = rows.where("ligand IS NOT NULL").groupBy("ligand").agg(F.min("split").alias("split"), F.max("split").alias("other"), F.count(F.lit(1)).alias("n"))
    split = of.where("split <> other").agg(F.count(F.lit(1)).alias("split_ligands"))
    ends = of.select("ligand", "split")
    crossing = links.join(ends.toDF("a", "s"), "a").join(ends.toDF("b", "t"), "b").where("s <> t").agg(F.count(F.lit(1)).alias("crossing_links"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    target = F.create_map(*(F.lit(x) for pair in FRACTIONS.items() for x in pair))
    by = rows.where("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(0.002), 2 / F.sum("n").over(W.partitionBy()))
    near = by.select((F.abs(share - F.element_at(target, F.col("split"))) <= most).alias("near")).agg((F.count_if("near") == len(FRACTIONS)).alias("on_target"))
    sums = rows.agg(F.count("split").alias("assigned"), F.count_if(F.col("split").isNull()).alias("unassigned"))
    parts = [sums, split, crossing, near]  # a row each
    names = [c for p in parts for c in p.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*(F.max(c).alias(c) for c in names))


def p2_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rules(_assigned(_split_rows(spark, sf).drop("split")), _matches(spark, sf).where("a = b")).drop("crossing_links")


def p2_linked_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rules(_assigned(_split_rows(spark, sf).drop("split"), _matches(spark, sf)), _matches(spark, sf))


def _ligands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "affinity_manifest").select(trimmed("ligand").alias("ligand"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_pairs(_ligands(spark, sf), "ligand", 0.6, 8).toDF("ligand_a", "ligand_b")


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each ligand that is similar to another, with the number of ligands it is similar to."""
    return linked_texts(p3_found(spark, sf), "ligand_a", "ligand_b").withColumnRenamed("text", "ligand")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return linked_groups(_matches(spark, sf), "a", "b")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    return leak_report(p7_found(spark, sf), table(spark, sf, "eval_items"))


#: The kinds of text that the sources are of: what one source lacks the others of its kind make up for first.
DOMAINS = {
    "assay_reports": "laboratory", "lab_mail": "laboratory", "docking_logs": "computation", "preprint_notes": "literature", "target_reviews": "literature",
    "patent_digests": "literature", "seminar_notes": "literature", "helpdesk": "service", "safety_sheets": "service",
}


def _mixture(spark: SparkSession, sf: str, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), domains=DOMAINS, stretch=stretch)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[1]


def p8_stretched_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a mixture of twice the size that all sources can fill: some run short and others make up for them."""
    return _mixture(spark, sf, 2.0)[1]


def p8_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of both mixtures: a row each with the target sources and counts of what breaks a rule: documents
    used too often, taken twice or from nowhere, sources whose report differs from the mixture, and sources off their target (not
    below it while tokens are left, and in the plain mixture within a point of it, or within what whole documents allow)."""
    targets, docs = table(spark, sf, "mix_targets"), table(spark, sf, "documents").select("doc_id", F.lower(trimmed("source")).alias("own"))
    out = []
    for name, stretch in (("plain", 1.0), ("stretched", 2.0)):
        chosen, report = _mixture(spark, sf, stretch)
        chosen, report = materialize(chosen, "chosen"), materialize(report, "report")
        most = targets.select(F.lower(trimmed("source")).alias("source"), "max_repeats")
        over = chosen.join(most, "source").where("uses > max_repeats OR uses < 1")
        twice = chosen.groupBy("doc_id").count().where("count > 1")
        foreign = chosen.join(docs, (chosen["doc_id"] == docs["doc_id"]) & (chosen["source"] == docs["own"]), "left_anti")
        sums = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("sum"))
        differ = report.join(sums, "source", "left").where("coalesce(sum, 0) <> tokens_used OR tokens_used > tokens_available * max_repeats")
        longest, total = chosen.agg(F.max("n_tokens"), F.sum(F.col("n_tokens") * F.col("uses"))).first()
        near = max(0.01, 2.5 * (longest or 0) / (total or 1))  # each of five languages may miss its budget by half a document
        off = report.where((F.col("tokens_used") < 0.98 * F.col("tokens_available") * F.col("max_repeats")) & (F.col("share_reached") < F.col("target_share") - near))
        if stretch == 1.0:
            off = report.where(F.abs(F.col("share_reached") - F.col("target_share")) > near)
        broken = [(over, "over_used"), (twice, "taken_twice"), (foreign, "from_nowhere"), (differ, "reports_that_differ"), (off, "off_target")]
        parts = [report.agg(F.count(F.lit(1)).alias("sources")), *(df.agg(F.count(F.lit(1)).alias(c)) for df, c in broken)]
        united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        out.append(united.agg(*(F.max(c).alias(c) for c in ["sources", *(c for _, c in broken)])).select(F.lit(name).alias("mixture"), "*"))
    return out[0].unionByName(out[1])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_information(table(spark, sf, "documents"))


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "redacted")


def p9_emails(spark: SparkSession, sf: str) -> DataFrame:
    """Of p9_found the e-mail addresses that are written out plainly."""
    text = F.col("pii_text")
    found = p9_found(spark, sf).where((F.col("pii_type") == "EMAIL") & text.contains("@") & ~text.rlike(r"[ (\[{]"))
    return found.select("doc_id", "pii_text")


def p9_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One row: texts, cases that don't stand in their text, texts with cases but without a placeholder or the other way
    round, and texts that redaction changes beside its placeholders."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = materialize(p9_found(spark, sf), "found")
    both = materialize(redact(docs), "redacted")
    flat = F.regexp_replace(F.translate("text", SPACE, " " * len(SPACE)), " +", " ")
    strange = found.join(docs.withColumn("flat", flat), "doc_id", "left").where(~F.coalesce(F.contains("flat", "pii_text"), F.lit(False)))
    has = both.join(found.select("doc_id", F.lit(True).alias("has")).distinct(), "doc_id", "left")
    uneven = has.where(F.coalesce("has", F.lit(False)) != F.coalesce(F.col("redacted") != F.col("text"), F.lit(False)))
    pattern = F.concat(F.lit("\\Q"), F.regexp_replace("redacted", r"\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]", r"\\E[\\s\\S]+?\\Q"), F.lit("\\E"))
    changed = both.where("redacted IS NOT NULL").where(~F.rlike("text", F.concat(F.lit("^"), pattern, F.lit("$"))))
    parts = [both.agg(F.count("text").alias("texts")), *(df.agg(F.count(F.lit(1)).alias(c)) for df, c in ((strange, "not_in_text"), (uneven, "without_placeholder"), (changed, "changed_beside")))]
    names = ("texts", "not_in_text", "without_placeholder", "changed_beside")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*(F.max(c).alias(c) for c in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_assign, p2_assign_linked, p2_shares, p2_rules, p2_linked_rules, p3_found, p3_links, p6_found, p7_found, p7_items, p8_mixture, p8_shares, p8_stretched_shares, p8_rules, p9_found, p9_redacted, p9_emails, p9_rules)
}

_LINKS = f"""
    SELECT DISTINCT {trim('ligand_a')} AS a, {trim('ligand_b')} AS b FROM ligand_match
    WHERE lower({trim('verdict')}) = 'match' AND {trim('ligand_a')} <> {trim('ligand_b')}"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
        WITH once AS (
            SELECT *, row_number() OVER (PARTITION BY pose_id, CASE WHEN pose_id IS NULL THEN row_id END ORDER BY loaded_at NULLS LAST, row_id) AS rn
            FROM pose_manifest),
        ranked AS (
            SELECT row_id, CAST(row_number() OVER (
                PARTITION BY upper({trim('uniprot_id')}), {trim('ligand')}
                ORDER BY glide_score, source_sdf NULLS LAST, pose_id NULLS LAST, row_id) AS INTEGER) AS rank_no
            FROM once WHERE rn = 1 AND {trim('uniprot_id')} IS NOT NULL AND {trim('ligand')} IS NOT NULL
                AND glide_score IS NOT NULL AND NOT isnan(glide_score))
        SELECT row_id, rank_no FROM ranked WHERE rank_no <= 3""",
    "p2_found": f"""
        SELECT {trim('ligand')} AS ligand FROM affinity_split_manifest AS m
        JOIN split_labels AS s ON lower({trim('m.split')}) = lower({trim('s.label')})
        WHERE {trim('ligand')} IS NOT NULL AND lower({trim('s.split')}) IN ('train', 'val', 'test')
        GROUP BY 1 HAVING count(DISTINCT lower({trim('s.split')})) >= 2""",
    "p3_found": f"""
        WITH l AS (SELECT DISTINCT {trim('ligand')} AS ligand FROM affinity_manifest WHERE length({trim('ligand')}) >= 8),
        t AS (SELECT DISTINCT ligand, substring(ligand, i, 8) AS piece FROM (SELECT ligand, unnest(range(1, length(ligand) - 6)) AS i FROM l)),
        n AS (SELECT ligand, count(*) AS n FROM t GROUP BY ligand),
        c AS (SELECT x.ligand AS a, y.ligand AS b, count(*) AS shared FROM t AS x JOIN t AS y ON x.piece = y.piece AND x.ligand < y.ligand GROUP BY 1, 2)
        SELECT a AS ligand_a, b AS ligand_b FROM c JOIN n AS p ON p.ligand = a JOIN n AS q ON q.ligand = b
        WHERE shared >= 0.6 * (p.n + q.n - shared)""",
    "p6_found": f"""
        WITH RECURSIVE links AS ({_LINKS}), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach AS r JOIN both_ways AS e ON r.b = e.a)
        SELECT a AS ligand, least(a, min(b)) AS group_ligand FROM reach GROUP BY a""",
}
_SPLIT_ROWS = f"count({trim('ligand')}) AS assigned, count(*) - count({trim('ligand')}) AS unassigned, CAST(0 AS BIGINT) AS split_ligands"
ORACLES["p2_rules"] = f"SELECT {_SPLIT_ROWS}, true AS on_target FROM affinity_split_manifest"
ORACLES["p2_linked_rules"] = f"SELECT {_SPLIT_ROWS}, CAST(0 AS BIGINT) AS crossing_links, true AS on_target FROM affinity_split_manifest"
ORACLES["p8_rules"] = f"""
    SELECT mixture, (SELECT count(DISTINCT lower({trim('source')})) FROM mix_targets) AS sources, CAST(0 AS BIGINT) AS over_used, CAST(0 AS BIGINT) AS taken_twice,
        CAST(0 AS BIGINT) AS from_nowhere, CAST(0 AS BIGINT) AS reports_that_differ, CAST(0 AS BIGINT) AS off_target FROM (VALUES ('plain'), ('stretched')) AS m(mixture)"""
ORACLES["p9_rules"] = "SELECT count(text) AS texts, CAST(0 AS BIGINT) AS not_in_text, CAST(0 AS BIGINT) AS without_placeholder, CAST(0 AS BIGINT) AS changed_beside FROM documents"
ORACLES["p9_emails"] = r"""
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_.+%-]*@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[A-Za-z]{2,}')) AS pii_text FROM documents"""

_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
#: DuckDB has NFC only; these are what NFKC adds among the characters of the texts.
_NFKC = f"replace(replace(translate(nfc_normalize(text), '{_WIDE}ªº', '{_NARROW}ao'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"


def _runs(source: str, key: str) -> str:
    listed = f"SELECT {key}, regexp_extract_all(lower({_NFKC}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}"
    return f"(SELECT DISTINCT {key}, array_to_string(w[k:k+11], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM ({listed})))"


ORACLES["p7_found"] = f"SELECT DISTINCT doc_id, item_id FROM {_runs('documents', 'doc_id')} JOIN {_runs('eval_items', 'item_id')} USING (run)"
ORACLES["p7_items"] = f"SELECT item_id, count(doc_id) AS documents FROM eval_items LEFT JOIN ({ORACLES['p7_found']}) USING (item_id) GROUP BY item_id"
ORACLES["p3_links"] = f"""
    WITH pairs AS ({ORACLES['p3_found']})
    SELECT ligand, count(*) AS links FROM (SELECT ligand_a AS ligand FROM pairs UNION ALL SELECT ligand_b FROM pairs) GROUP BY ligand"""
