"""Mixing sources to target shares of all tokens, with capped repeats."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pocketloom.runtime import broadcast_if_small, materialize, trimmed

#: Default tokenizer: ranks of a byte-level BPE, one "base64 number" a line. The driver reads it and sends it along (under 1 MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts text into pieces before it merges bytes; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Languages that form branches of their own below a source; others share the branch "other".
LANGUAGES = ("en", "de", "fr", "es")
#: Slices by hash in which an epoch's order is summed up.
SLICES = 256


@dataclass
class Node:
    """A branch of the mixture: its weight among its siblings; a leaf has the tokens it can give at most."""

    weight: float
    cap: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: int = 0

    def room(self) -> int:
        return sum(c.room() for c in self.children.values()) if self.children else self.cap - self.budget


def allocate(node: Node, amount: int) -> int:
    """Spends amount on the leaves below node; what they can't give is returned.

    Children get their shares by weight; what one falls short of goes to its siblings with room, by weight, until it
    is spent or none has room. Only then it is returned, for the parent's siblings to make up. Children of weight 0
    get nothing.
    """
    if not node.children:
        given = min(amount, node.cap - node.budget)
        node.budget += given
        return amount - given
    left = amount
    while left > 0:
        open_ = [c for _, c in sorted(node.children.items()) if c.weight > 0 and c.room() > 0]
        if not open_:
            return left
        total = sum(c.weight for c in open_)
        shares = [int(left * c.weight / total) for c in open_]
        for k in range(left - sum(shares)):  # what rounding leaves over
            shares[k % len(shares)] += 1
        left = sum(allocate(c, s) for c, s in zip(open_, shares))
    return 0


def token_counter(ranks_file):
    """A function for mapInPandas that turns the column text into n_tokens, 0 for null. ranks_file: a broadcast of the file."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.value.splitlines() if line.strip())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield batch.drop(columns="text").assign(n_tokens=n)

    return count


def mixture(
    documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER,
    languages: tuple[str, ...] = LANGUAGES, seed: int = 7, domains: dict[str, str] | None = None, stretch: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, source, lang, n_tokens, uses), the documents of the mixture and how often each is used;
    and (source, target_share, max_repeats, tokens_available, tokens_used, share_reached, documents, most_uses).

    targets has source, target_share and max_repeats. Sources are compared in lower case without surrounding white
    space; documents of no target source, without text or of a source with a null or non-positive share or
    max_repeats below 1 take no part. A source listed twice counts with its summed share and least max_repeats. Shares
    are scaled to sum to 1. total is the size of the mixture in tokens; by default the largest at which every source
    that has documents reaches its share, times stretch.

    Budgets are spread from the top down a tree: domains (by source; a source in none is a domain of its own), sources,
    languages (in the mix a source has by itself; regions such as en-GB count as their language). A branch that runs
    short is made up for by its siblings first, then by its parent's siblings: a language by the others of its source, a
    source by the others of its domain, a domain by the other domains. A leaf's documents are
    ordered anew by a seeded hash for each epoch. It gives all its documents as often as its budget allows, and from
    the last epoch the prefix that comes nearest to what is left, so each leaf misses its budget by half a document at
    most. A prefix is found from sums over slices of the hash; only the slice in which it ends is
    ordered. Nothing but sums by leaf reaches the driver: a row for each of targets x languages.
    """
    goals = (
        targets.select(F.lower(trimmed("source")).alias("source"), "target_share", "max_repeats")
        .where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & ~F.isnan(F.col("target_share").cast("double")))
        .dropna().groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    lang = F.element_at(F.split(F.lower(trimmed("lang")), "[-_]"), 1)
    docs = documents.select("doc_id", F.lower(trimmed("source")).alias("source"), F.when(lang.isin(*languages), lang).otherwise("other").alias("lang"), "text")
    docs = docs.join(broadcast_if_small(goals.select("source")), "source", "left_semi").select("doc_id", "source", "lang", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    ranks = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    counted = docs.mapInPandas(token_counter(ranks), f"doc_id {kind}, source string, lang string, n_tokens bigint")
    counted = materialize(counted.where("n_tokens > 0"), "tokens")
    leaves = counted.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")).toPandas()
    wanted = {r.source: r for r in goals.collect()}
    scale = sum(r.target_share for r in wanted.values()) or 1.0
    leaf_of: dict[tuple[str, str], Node] = {}
    root, sources = Node(1.0), {}
    for x in leaves.itertuples():
        source = sources.setdefault(x.source, Node(wanted[x.source].target_share / scale))
        leaf_of[x.source, x.lang] = source.children[x.lang] = Node(float(x.tokens), int(x.tokens) * int(wanted[x.source].max_repeats))
    for s, node in sorted(sources.items()):
        domain = root.children.setdefault((domains or {}).get(s, s), Node(0.0))
        domain.weight += node.weight
        domain.children[s] = node
    if total is None:
        shared = sum(c.weight for c in sources.values())
        total = int(stretch * min((c.room() * shared / c.weight for c in sources.values()), default=0))
    allocate(root, total)
    plan = [(s, lang, leaf.budget // int(leaf.weight), leaf.budget % int(leaf.weight)) for (s, lang), leaf in leaf_of.items()]
    chosen = _epochs(counted, plan, seed)
    return chosen, _report(counted, chosen, goals, scale)


def _epochs(counted: DataFrame, plan: list[tuple], seed: int) -> DataFrame:
    spark = counted.sparkSession
    leaves = F.broadcast(spark.createDataFrame(plan, "source string, lang string, epochs bigint, rest bigint"))
    docs = counted.join(leaves, ["source", "lang"]).withColumn("place", F.xxhash64("doc_id", F.lit(seed), "epochs"))
    docs = docs.withColumn("slice", F.pmod(F.shiftright("place", 32), F.lit(SLICES)).cast("int"))
    leaf = W.partitionBy("source", "lang").orderBy("slice")
    slices = docs.groupBy("source", "lang", "slice").agg(F.sum("n_tokens").alias("m"))
    slices = slices.withColumn("upto", F.sum("m").over(leaf)).select("source", "lang", "slice", "upto", (F.col("upto") - F.col("m")).alias("before"))
    docs = docs.join(broadcast_if_small(slices), ["source", "lang", "slice"])
    whole = docs.where((F.col("upto") <= F.col("rest")) | (F.col("before") >= F.col("rest"))).withColumn("more", (F.col("upto") <= F.col("rest")).cast("int"))
    border = docs.where((F.col("upto") > F.col("rest")) & (F.col("before") < F.col("rest")))
    end = F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "lang", "slice").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    both = whole.unionByName(border.withColumn("more", (end - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")))
    return both.withColumn("uses", (F.col("epochs") + F.col("more")).cast("int")).where("uses > 0").select("doc_id", "source", "lang", "n_tokens", "uses")


def _report(counted: DataFrame, chosen: DataFrame, goals: DataFrame, scale: float) -> DataFrame:
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    rows = goals.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["tokens_available", "tokens_used", "documents", "most_uses"])
    total = F.sum("tokens_used").over(W.partitionBy())  # a row for each target source
    share = F.when(total > 0, F.col("tokens_used") / total).otherwise(0.0)
    return rows.select("source", (F.col("target_share") / scale).alias("target_share"), "max_repeats", "tokens_available", "tokens_used", share.alias("share_reached"), "documents", "most_uses")
