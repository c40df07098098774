"""All pairs of records whose sets overlap at or above a Jaccard threshold: a prefix-filtered join."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pocketloom.runtime import materialize

#: Slots in which token frequencies are counted: a fixed number, so the counts may be sent to every task (1 MB).
SLOTS = 1 << 18
#: 64-bit words of a record's bitmap.
WORDS = 4
#: Records of one token that meet in one group; the lists of more frequent tokens are cut into blocks of this length.
BLOCK = 50_000
#: Pairs compared at once: small enough for a core's own cache.
AT_ONCE = 1 << 17
_EPS = 1e-9


def substrings(text: str, q: int) -> np.ndarray:
    """The distinct substrings of q characters as sorted 64-bit numbers; none for shorter text.

    Eight ASCII characters are their own bytes, so that they can't collide; others are hashed to numbers beyond those.
    """
    n = len(text) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if q == 8 and text.isascii():
        raw = np.frombuffer(text.encode("ascii"), np.uint8)
        return np.unique(np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(">u8").ravel().astype(np.uint64))
    return np.unique(np.fromiter((_number(text[i : i + q]) for i in range(n)), np.uint64, n))


def _number(piece: str) -> int:
    if len(piece) == 8 and piece.isascii():
        return int.from_bytes(piece.encode("ascii"), "big")
    return xxhash.xxh3_64_intdigest(piece) | 1 << 63


def _mix(tokens: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers for tokens, one for one."""
    x = tokens ^ (tokens >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def least_overlap(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Shared tokens that two sets of so many tokens together need at least."""
    return np.ceil(threshold / (1 + threshold) * sizes - _EPS).astype(np.int32)


def token_frequencies(texts: DataFrame, column: str, q: int) -> np.ndarray:
    """How many texts hold a token of each slot; texts must be distinct. Counted in each task, then summed by slot."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            tokens = np.concatenate([np.empty(0, np.uint64), *(substrings(text, q) for text in batch[column])])
            total += np.bincount((_mix(tokens) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        (slot,) = total.nonzero()
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    rows = texts.select(column).mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _prefixes(column: str, q: int, threshold: float, block: int, frequencies):
    """Rows (token, part, id, half, side, size, place, b0 ...): for each text the tokens that can be the rarest one shared
    with another. part tells apart the pairs of blocks of a token's list, half which of the two a row is of."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = frequencies.value
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for id_, text, side in zip(batch["id"].to_numpy(), batch[column], batch["side"]):
                own = substrings(text, q)
                n = len(own)
                if not n:
                    continue
                mixed = _mix(own)
                df = often[(mixed % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((mixed, df))[: n - ceil(threshold * n - _EPS) + 1]
                bits = (mixed >> np.uint64(40)) % np.uint64(64 * WORDS)
                odd = np.bincount(bits.astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1
                bitmap = np.packbits(odd).view(np.int64)
                place = np.arange(len(order))
                blocks = -(-df[order] // block)  # no token is in more prefixes than in texts
                token = mixed[order].view(np.int64)
                part = half = np.zeros(len(order), np.int64)
                if blocks.max() > 1:
                    mine = int(_mix(np.array([id_], np.int64).view(np.uint64))[0])
                    parts, halves = zip(*(_block_pairs(mine % int(k), int(k)) for k in blocks))
                    repeats = [len(x) for x in parts]
                    place, token = np.repeat(place, repeats), np.repeat(token, repeats)
                    part, half = np.concatenate(parts), np.concatenate(halves)
                rows.append([token, part, np.full(len(token), id_), half, np.full(len(token), side), np.full(len(token), n), place, *(np.full(len(token), w) for w in bitmap)])
            if rows:
                yield pd.DataFrame(dict(zip(COLUMNS, map(np.concatenate, zip(*rows)))))

    return emit


def _block_pairs(mine: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (p, r), p <= r, of blocks: the numbers of those that hold block mine, and its half in each."""
    other = np.arange(blocks)
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    return low * blocks + high, np.where(low == high, 0, np.where(other > mine, 1, 2))


COLUMNS = ["token", "part", "id", "half", "side", "size", "place", *(f"b{k}" for k in range(WORDS))]
SCHEMA = ", ".join(f"{c} {'bigint' if c in ('token', 'id') or c[0] == 'b' else 'int'}" for c in COLUMNS)


def similar_pairs(
    values: DataFrame, column: str, threshold: float = 0.6, q: int = 8, block: int = BLOCK, others: DataFrame | None = None, other_column: str | None = None
) -> DataFrame:
    """(a, b): all pairs of texts whose sets of distinct substrings of q characters have intersection size / union size
    >= threshold. Within one table, of different texts in column, a < b by code point; with others, of a text a of
    values and a text b of others (in other_column, else in column), which may be equal.

    Null texts and texts shorter than q have no pairs; repeated texts count once. An empty table gives no pairs.

    Tokens are ordered by rarity, over all texts. Two similar sets share a token among the first few of either, so
    only these prefixes are joined: up to size - ceil(threshold * size) + 1 tokens of the larger set, and as many as
    the sizes of both allow of the smaller. The join itself compares sizes, the places of the shared token, and a
    bitmap of each set, which bounds the overlap from above (the parity of tokens by slot: sets differ in at least as
    many tokens as their bitmaps differ in bits). All three lose no pair. What is left is compared exactly, text by
    text. The list of a token that more than block texts hold is cut into blocks, and each pair of blocks is a group
    of its own, so that no token brings its whole list into one task.
    """
    if not 0 < threshold <= 1 or q < 1 or block < 1:
        raise ValueError("threshold must be above 0 and at most 1, q and block at least 1")
    spark = values.sparkSession
    texts = values.select(F.col(column).alias("text"), F.lit(1).alias("side"))
    if others is not None:
        texts = texts.unionByName(others.select(F.col(other_column or column).alias("text"), F.lit(2).alias("side")))
    texts = texts.where(F.length("text") >= q).groupBy("text").agg(F.bit_or("side").alias("side"))  # 3: in both tables
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("id"), "text", "side"), "texts")
    frequencies = spark.sparkContext.broadcast(token_frequencies(texts, "text", q))
    signs = texts.mapInPandas(_prefixes("text", q, threshold, block, frequencies), SCHEMA)
    lists = signs.repartition("token", "part").sortWithinPartitions("token", "part", "size", "id")
    pairs = lists.mapInPandas(_meetings(threshold, others is not None), "i bigint, j bigint").distinct()
    if others is None:
        return _verified(pairs, texts.select("id", "text"), threshold, q).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    found = _verified(pairs, texts.select("id", "text"), threshold, q)
    sides = texts.select("text", "side")
    named = found.join(sides.toDF("s", "m"), "s").join(sides.toDF("t", "n"), "t")
    ways = F.array(
        F.when((F.col("m").bitwiseAND(1) > 0) & (F.col("n").bitwiseAND(2) > 0), F.struct(F.col("s").alias("a"), F.col("t").alias("b"))),
        F.when((F.col("n").bitwiseAND(1) > 0) & (F.col("m").bitwiseAND(2) > 0), F.struct(F.col("t").alias("a"), F.col("s").alias("b"))),
    )
    same = texts.where("side = 3").select(F.col("text").alias("a"), F.col("text").alias("b"))
    return named.select(F.explode(F.array_compact(ways)).alias("p")).select("p.*").unionByName(same)


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one token and part at a time, from batches sorted by them."""
    open_: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        all_ = {c: batch[c].to_numpy() for c in COLUMNS}
        change = (np.diff(all_["token"]) != 0) | (np.diff(all_["part"]) != 0)
        cuts = [0, *(np.flatnonzero(change) + 1), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            piece = {c: v[lo:hi] for c, v in all_.items()}
            if open_ and (open_[-1]["token"][0] != piece["token"][0] or open_[-1]["part"][0] != piece["part"][0]):
                yield {c: np.concatenate([x[c] for x in open_]) for c in COLUMNS} if len(open_) > 1 else open_[0]
                open_ = []
            open_.append(piece)
    if open_:
        yield {c: np.concatenate([x[c] for x in open_]) for c in COLUMNS}


def _meetings(threshold: float, two_tables: bool):
    """Rows (i, j) of ids that share a prefix token and pass the length, place and bitmap filters; of two tables, only
    those that aren't both of one alone."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        count = 0
        for rows in _lists(batches):
            for pairs in _compared(rows, threshold, two_tables):
                found.append(pairs)
                count += len(pairs)
            if count > 200_000:
                yield _distinct(found)
                found, count = [], 0
        if count:
            yield _distinct(found)

    return meet


def _distinct(found: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate(found), columns=["i", "j"]).drop_duplicates()


def _compared(rows: dict[str, np.ndarray], threshold: float, two_tables: bool = False) -> Iterator[np.ndarray]:
    """Pairs (smaller or equal set, larger) of one token's list, which is in order of size."""
    size, place = rows["size"].astype(np.int32), rows["place"].astype(np.int32)
    if len(size) < 2:
        return
    least = 2 * threshold / (1 + threshold)
    own = np.arange(len(size))
    left = np.flatnonzero(place < size - np.ceil(least * size - _EPS) + 1)  # the smaller side needs a shorter prefix
    if not len(left):
        return
    both = 2 * int(size[-1]) + 1
    known = least_overlap(np.arange(both), threshold) if both < 10_000 else None
    maps = [rows[f"b{k}"].view(np.uint64) for k in range(WORDS)]
    half = rows["half"] if rows["half"].any() else None
    start = 0
    while start < len(size):
        first = np.searchsorted(left, np.searchsorted(size, threshold * size[start] - _EPS))
        width = max(1, AT_ONCE // max(1, np.searchsorted(left, start) - first + 64))
        stop = min(len(size), start + width)
        i = left[first : np.searchsorted(left, stop)]
        j = own[start:stop]
        start = stop
        if not len(i):
            continue
        a, b = size[i][:, None], size[j][None, :]
        need = known[a + b] if known is not None else least_overlap(a + b, threshold)
        fits = (place[i][:, None] <= a - need) & (place[j][None, :] <= b - need) & (i[:, None] < j[None, :]) & (a >= threshold * b - _EPS)
        apart = np.bitwise_count(maps[0][i][:, None] ^ maps[0][j][None, :]).astype(np.int16)
        for m in maps[1:]:
            apart += np.bitwise_count(m[i][:, None] ^ m[j][None, :])
        fits &= a + b - apart >= 2 * need
        if half is not None:
            fits &= (half[i][:, None] != half[j][None, :]) | (half[i][:, None] == 0)
        if two_tables:
            fits &= (rows["side"][i][:, None] | rows["side"][j][None, :]) == 3
        x, y = np.nonzero(fits)
        if len(x):
            yield np.column_stack((rows["id"][i[x]], rows["id"][j[y]]))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, q: int) -> DataFrame:
    """(s, t): the texts of those pairs (i, j) of ids that are similar enough. Sets of a whole batch are made once for
    each text and compared together."""
    first, second = texts.toDF("i", "s"), texts.toDF("j", "t")
    both = pairs.join(first, "i").join(second, "j").select("s", "t")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[overlaps(batch["s"].to_numpy(object), batch["t"].to_numpy(object), threshold, q)]

    return both.mapInPandas(check, "s string, t string")


def overlaps(first: np.ndarray, second: np.ndarray, threshold: float, q: int) -> np.ndarray:
    """Whether the sets of each two texts overlap enough: the tokens of all pairs are put in one order, where a shared
    token stands twice within its pair."""
    distinct, place = np.unique(np.concatenate((first, second)), return_inverse=True)
    sets = [substrings(text, q) for text in distinct]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)[1].astype(np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    n = len(first)
    pair = np.repeat(np.concatenate((np.arange(n), np.arange(n))), sizes[place])
    at = np.arange(len(pair)) - np.repeat(np.concatenate(([0], np.cumsum(sizes[place])[:-1])), sizes[place]) + np.repeat(begins[place], sizes[place])
    keys = np.sort(pair * (len(tokens) + 1) + tokens[at])
    shared = np.bincount(keys[1:][keys[1:] == keys[:-1]] // (len(tokens) + 1), minlength=n)
    return shared >= threshold * (sizes[place[:n]] + sizes[place[n:]] - shared) - _EPS


def linked_texts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(text, links): how many others each text is linked to."""
    ends = pairs.select(F.explode(F.array(a, b)).alias("text"))
    return ends.groupBy("text").agg(F.count(F.lit(1)).alias("links"))
