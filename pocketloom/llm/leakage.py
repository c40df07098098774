"""Evaluation texts leaking into a corpus: MinHash containment search over windows of one size, verified word by word."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pocketloom.runtime import broadcast_if_small, materialize

#: Consecutive words that make a leak, and words of a shingle.
PASSAGE, SHINGLE = 12, 5
#: Filter bits for each window of the items, and the most bits of one filter (128 MB, in each task); more items than that
#: are searched for in several passes over the corpus.
BITS_EACH, MOST_BITS = 32, 1 << 30
#: Word hashes that a task remembers.
MEMORY = 200_000


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC normalisation and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return re.findall(r"[^\W_]+", text.lower())


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word; known remembers them."""
    if len(known) > MEMORY:
        known.clear()
    return np.fromiter((known.get(t) or known.setdefault(t, xxhash.xxh3_64_intdigest(t)) for t in tokens), np.uint64, len(tokens))


def window_minima(h: np.ndarray, passage: int = PASSAGE, shingle: int = SHINGLE) -> np.ndarray:
    """For each window of passage words, the MinHash of its set of shingles; empty for fewer words. h: their hashes.

    All windows are sets of one size, so one window contains another only if both are equal, and then their minima are,
    whatever the hash.
    """
    if len(h) < passage:
        return np.empty(0, np.uint64)
    n = len(h) - shingle + 1
    s = np.zeros(n, np.uint64)
    for k in range(shingle):
        s = s * _SPREAD + h[k : k + n]
        s = s ^ (s >> np.uint64(29))
    s = s * np.uint64(0xBF58476D1CE4E5B9)
    s = s ^ (s >> np.uint64(32))
    return np.lib.stride_tricks.sliding_window_view(s, passage - shingle + 1).min(axis=1)


def window_hashes(h: np.ndarray, at: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """A 64-bit hash of the whole window at each of the places."""
    out = np.zeros(len(at), np.uint64)
    for k in range(passage):
        out = (out ^ h[at + k]) * _SPREAD
        out = out ^ (out >> np.uint64(31))
    return out


class _Filter:
    """A set of hashes as bits: each hash has one."""

    def __init__(self, data: bytes) -> None:
        self.words = np.frombuffer(data, np.uint64)
        self.mask = np.uint64(64 * len(self.words) - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes & self.mask
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _windows(passage: int, shingle: int, wanted=None):
    """Rows (id, h, m, window): distinct windows of each text (id, text), with the hash of each and its minimum; with
    wanted, only those of which it holds both."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        held = None if wanted is None else _Filter(wanted.value)
        for batch in batches:
            ids, hashes, minima, windows = [], [], [], []
            for i, t in zip(batch["id"], batch["text"]):
                tokens = words(t) if t else []
                if len(tokens) < passage:
                    continue
                h = _word_hashes(tokens, known)
                m = window_minima(h, passage, shingle)
                at = np.arange(len(m)) if held is None else np.flatnonzero(held.holds(m))
                if not len(at):
                    continue
                own = window_hashes(h, at, passage)
                if held is not None:
                    sure = held.holds(own)
                    at, own = at[sure], own[sure]
                found = {" ".join(tokens[p : p + passage]): (x, y) for p, x, y in zip(at.tolist(), own.view(np.int64).tolist(), m[at].view(np.int64).tolist())}
                ids += [i] * len(found)
                windows += found
                hashes += [x for x, _ in found.values()]
                minima += [y for _, y in found.values()]
            if ids:
                yield pd.DataFrame({"id": ids, "h": hashes, "m": minima, "window": windows})

    return emit


def _filter_of(index: DataFrame, bits: int) -> bytes:
    """The bits of the hashes and minima of index; put together within tasks, 64 to a row."""
    place = F.explode(F.array("h", "m")).alias("x")
    bit = F.col("x").bitwiseAND(F.lit(bits - 1))
    rows = index.select(place).select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("mask"))
    parts = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[parts.column("word").to_numpy()] = parts.column("mask").to_numpy()
    return out.tobytes()


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    passage: int = PASSAGE, shingle: int = SHINGLE, bits_each: int = BITS_EACH, most_bits: int = MOST_BITS,
) -> DataFrame:
    """(doc_id, item_id), distinct: the item shares a run of passage consecutive words with the document.

    Words are runs of letters and digits after NFKC and lower-casing, so case, width, punctuation, markup and line
    breaks don't matter. Null texts and texts of fewer words share nothing. Texts under several ids come out under each;
    a null id is an id like others.

    Documents and items are both cut into windows of exactly passage words, the one size by which this search is
    partitioned: there, containment is equality, so a single MinHash value for each window, the least of its shingles'
    hashes, finds every leak with certainty however long the document. The minima of the items' windows, and hashes of
    the whole windows, are put into a filter of bits_each bits a window that every task gets. A task goes over its
    documents once and gives out only windows that pass, some thousandths of those that are no leak. These few are
    joined with the windows of the items on their 64-bit hash and compared word by word. Documents without a match move
    hardly a row. Items with more windows than one filter of most_bits serves are split by hash, and the corpus is read
    once for each part.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    items = items.select(F.col(item_id).alias("id"), F.col(text).alias("text"))
    index = materialize(items.mapInPandas(_windows(passage, shingle), f"id {item_kind}, h bigint, m bigint, window string"), "items")
    count = index.count()
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    parts = max(1, -(-count * bits_each // most_bits))
    bits = min(most_bits, 1 << max(6, (count * bits_each // parts).bit_length()))
    found = None
    for part in range(parts):
        own = index if parts == 1 else index.where(F.pmod(F.shiftright("h", 40), F.lit(parts)) == part)
        wanted = spark.sparkContext.broadcast(_filter_of(own, bits))
        hits = docs.mapInPandas(_windows(passage, shingle, wanted), f"id {kind}, h bigint, m bigint, window string").select(F.col("id").alias("d"), "h", "window")
        pairs = hits.join(broadcast_if_small(own.select(F.col("id").alias("i"), "h", "window")), ["h", "window"]).select(F.col("d").alias(doc_id), F.col("i").alias(item_id))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def leak_report(leaks: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Every item with the number of documents it leaked into, 0 if none."""
    n = leaks.groupBy(item_id).agg(F.count(F.lit(1)).alias("documents"))
    return items.select(item_id).distinct().join(n, item_id, "left").select(item_id, F.coalesce("documents", F.lit(0)).alias("documents"))
