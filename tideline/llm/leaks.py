"""Evaluation passages inside training text (problem 6), by spaced-seed hashing.

Fixed masks over ``SPAN`` successive words ignore selected positions. Every window of the test items and of the corpus is
hashed under each mask, and the hashes are joined: a corpus window whose hash is one of the items' gives a diagonal (document,
item, shift), and the words along that diagonal are then compared one by one. So a passage with a substituted word is found
as long as one mask ignores that word's position, and a passage of at least ``SPAN`` unchanged words is always found.

The corpus is read once. A Bloom filter of the items' hashes, of at most ``SCREEN_BITS`` bits whatever their number, goes to all tasks;
only documents with a window that passes it leave their task, as word hashes with those windows. Items, hashes and words
all stay in tables; nothing but the filter comes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.forms import appearance_of
from tideline.runtime import written

# The masks; 1 is a word that counts, 0 one that is ignored.
MASKS = ("1101101101101", "1110110111011", "1011101110111")
SPAN = len(MASKS[0])
FOUND_WORDS = 13
WORD = re.compile(r"[^\W_]+")
CACHED_WORDS = 1 << 20
SCREEN_BITS, BITS_PER_SEED = 1 << 27, 256
SLOTS = (0, 18, 37)  # a seed's bits in the screen begin at these of its own


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word)
        return n


def words_of(text: str | None) -> list[str]:
    """Runs of letters or digits, lower-cased, after the differences that cannot be seen are removed."""
    return WORD.findall(appearance_of(text).lower()) if text else []


def _joined(texts: list[str | None], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """All words of all texts as 64-bit values, and where each text begins (one more entry for the end)."""
    parts = [list(map(known.__getitem__, words_of(t))) for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.fromiter((x for p in parts for x in p), np.uint64, starts[-1]), starts


def _factors(mask: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{mask}:{o}") | 1 for o in range(SPAN)], np.uint64)


def _seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of every window under one mask; windows across a text's end are the caller's to drop."""
    n = len(words) - SPAN + 1
    factors, out = _factors(mask), np.zeros(max(n, 0), np.uint64)
    for o, kept in enumerate(MASKS[mask]):
        if kept == "1" and n > 0:
            out += words[o : o + n] * factors[o]
    return out ^ (out >> np.uint64(29))


def _inside(starts: np.ndarray, n: int) -> np.ndarray:
    """Of each window position, whether it ends within its text."""
    ok = np.ones(max(n, 0), bool)
    for end in starts[1:]:
        ok[max(end - SPAN + 1, 0) : end] = False
    return ok


def _best(equal: np.ndarray) -> tuple[int, int, int]:
    """Longest run of equal words; length and equal words of the best-scoring stretch (1 for equal, -2 for not)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return run, end - begin, int(equal[begin:end].sum())


TEXT = "id long, words array<long>, mask array<tinyint>, seed array<long>, at array<int>"


def _windows(screen: np.ndarray | None):
    """Rows of texts (id, text): their words as 64-bit values and the windows whose hash is in ``screen`` (all if there is none);
    texts without such a window are left out."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits = _Words(), None if screen is None else screen.value
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                words, starts = _joined(part.text.tolist(), known)
                n = len(words) - SPAN + 1
                if n <= 0:
                    continue
                inside, masks, seeds, places = _inside(starts, n), [], [], []
                for m in range(len(MASKS)):
                    s = _seeds(words, m)
                    p = np.flatnonzero(inside)
                    for shift in SLOTS if bits is not None else ():
                        slot = (s[p] >> np.uint64(shift)) & np.uint64(8 * len(bits) - 1)
                        p = p[(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    masks.append(np.full(len(p), m, np.int8))
                    seeds.append(s[p].view(np.int64))
                    places.append(p)
                mask, seed, place = (np.concatenate(x) for x in (masks, seeds, places))
                order = np.argsort(place, kind="stable")
                mask, seed, place = mask[order], seed[order], place[order]
                text = np.searchsorted(starts, place, "right") - 1
                hit, first = np.unique(text, return_index=True)
                ends = np.r_[first[1:], len(text)]
                rows = [(words[starts[t] : starts[t + 1]].view(np.int64), mask[x:y], seed[x:y], (place[x:y] - starts[t]).astype(np.int32)) for t, x, y in zip(hit, first, ends, strict=True)]
                out = pd.DataFrame(rows, columns=["words", "mask", "seed", "at"])
                out.insert(0, "id", part.id.to_numpy()[hit])
                yield out

    return windows


def _screen(seeds: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of ``size`` bits, put together from 64-bit words that were merged before."""
    slot = F.explode(F.array(*[F.shiftrightunsigned("seed", k).bitwiseAND(F.lit(size - 1)) for k in SLOTS])).alias("slot")
    words = seeds.select(slot).select((F.col("slot") / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    bits = np.zeros(size // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # at most size / 64 rows
        bits[r.w] = r.b
    return bits.view(np.uint8)


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(d, i, *_best(np.asarray(x) == np.asarray(y))) for d, i, x, y in zip(pdf.doc_id, pdf.item_id, pdf.x, pdf.y, strict=True)]
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "exact_words", "aligned_words", "equal_words"])


SCHEMA = "doc_id long, item_id long, exact_words int, aligned_words int, equal_words int"


def leaks(docs: DataFrame, items: DataFrame, least_words: int = SPAN, least_share: float = 0.75, screen_bits: int = SCREEN_BITS) -> DataFrame:
    """One row per document and item that share a passage: longest unchanged run, and length and equal words of the best
    stretch with substitutions (at least ``least_words`` long, ``least_share`` of it equal).

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``item_text``; other columns are ignored. Null
    or blank texts and items of fewer than ``SPAN`` words share nothing. Whole texts are read. Repeated rows give one row.
    """
    spark = docs.sparkSession
    stated = items.select(F.col("item_id").alias("id"), F.col("item_text").alias("text")).where("id is not null and text is not null").distinct()
    row = F.monotonically_increasing_id().alias("row")
    texts = written(stated.mapInPandas(_windows(None), TEXT).select(row, "*"))
    # Every window of every item is one row per mask.
    each = F.explode(F.arrays_zip("mask", "seed", "at")).alias("w")
    seeds = texts.select(F.col("row").alias("item_row"), each).select("item_row", "w.mask", "w.seed", F.col("w.at").alias("item_at"))
    count = texts.agg(F.sum(F.size("seed"))).first()[0]
    if not count:
        return spark.createDataFrame([], SCHEMA)
    size = min(max(1 << int(count * BITS_PER_SEED - 1).bit_length(), 1 << 16), screen_bits)
    screen = spark.sparkContext.broadcast(_screen(seeds, size))
    found = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null and text is not null").mapInPandas(_windows(screen), TEXT)
    found = written(found.select(row, "*"))
    hits = found.select(F.col("row").alias("doc_row"), each).select("doc_row", "w.mask", "w.seed", "w.at")
    diagonals = hits.join(seeds, ["mask", "seed"]).select("doc_row", "item_row", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    doc = found.select(F.col("row").alias("doc_row"), F.col("id").alias("doc_id"), F.col("words").alias("doc_words"))
    item = texts.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    met = diagonals.join(item, "item_row").join(doc, "doc_row")
    first, last = F.greatest(F.col("shift"), F.lit(0)), F.least(F.size("doc_words"), F.col("shift") + F.size("item_words"))
    met = met.select("doc_id", "item_id", F.slice("doc_words", first + 1, last - first).alias("x"), F.slice("item_words", first - F.col("shift") + 1, last - first).alias("y"))
    best = F.max(F.struct("exact_words", "equal_words", "aligned_words")).alias("b")
    good = met.mapInPandas(_compared, SCHEMA).where((F.col("exact_words") >= FOUND_WORDS) | ((F.col("aligned_words") >= least_words) & (F.col("equal_words") >= least_share * F.col("aligned_words"))))
    return good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.exact_words", "b.aligned_words", "b.equal_words")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document holds at least 13 successive words of the item."""
    return leaks(docs, items).where(F.col("exact_words") >= FOUND_WORDS).select("doc_id", "item_id")


def item_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold it unchanged or with substitutions, and its longest run there."""
    per = leaks(docs, items).groupBy("item_id").agg(
        F.count_if(F.col("exact_words") >= FOUND_WORDS).alias("exact_documents"), F.count("*").alias("documents"), F.max("exact_words").alias("longest_words")
    )
    base = items.select("item_id", "suite", "split_name").where("item_id is not null").dropDuplicates(["item_id"])
    return base.join(per, "item_id", "left").na.fill(0, ["exact_documents", "documents", "longest_words"])
