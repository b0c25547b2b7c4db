"""Benchmark decontamination: spaced-seed hashes and substitution-tolerant overlaps around their hits."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.llm.arrow_columns import with_text_columns
from faultscope.llm.names import fresh
from faultscope.llm.words import hashed, mixed, odd_constants

# A mask says which of the words in a row are hashed (1) and which may differ (0).
MASKS = ("111111", "11011011", "1101010111", "111000111", "10110110101")
# Lighter ones for items of fewer than MIN_WORDS words: with them some mask fits whatever fifth of the inner words differs.
LIGHT_MASKS = ("110111", "111011", "101111", "111101")
MIN_WORDS = 13
SHORT_WORDS = 6
SIMILARITY = 0.8
BLOCK_WORDS = 500_000
SIEVE_BITS = 20

# Scripts without spaces: Thai, Lao, Burmese, Khmer, Tai, Javanese, Japanese and Chinese; and the marks that follow their letters.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u303c\u3041-\u30ff"
    "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
)
MARKS = (
    "\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ece\u102b-\u103e\u1056-\u1059\u105e-\u1064\u1067-\u106d\u1071-\u1074"
    "\u1082-\u108d\u109a-\u109d\u17b4-\u17d3\u17dd\u1a55-\u1a7f\u3099\u309a\ua980-\ua983\ua9b3-\ua9c0"
)
WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}][{MARKS}]*")

OVERLAP = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_equal", T.LongType()),
    ]
)


def text_words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; in scripts without spaces each letter with its marks."""
    return WORD.findall(text.lower()) if text else []


def masked_hashes(values: np.ndarray, mask: str) -> np.ndarray:
    """For each place the hash of the words that the mask keeps; none if the mask is longer."""
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    kept = [i for i, sign in enumerate(mask) if sign == "1"]
    total = np.zeros(n, np.uint64)
    for i, factor in zip(kept, odd_constants(len(kept), int(mask, 2))):
        total += values[i : i + n] * factor
    return mixed(total)


def longest_overlap(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """First place and length of the longest run in which at least that share of words is equal.

    The run begins and ends with equal words. With prefix sums of (equal - similarity), a run is
    good if its sum is not negative; the earliest good start of each end is found in the falling
    minima of the sums before equal words.
    """
    scale = 1000
    gain = np.where(equal, scale - round(similarity * scale), -round(similarity * scale))
    sums = np.concatenate([[0], np.cumsum(gain)])
    starts = -np.minimum.accumulate(np.where(equal, sums[:-1], scale * (len(equal) + 1)))
    best = (0, 0)
    for end in np.flatnonzero(equal) + 1:
        begin = int(np.searchsorted(starts[:end], -sums[end]))
        if end - begin > best[1]:
            best = (begin, int(end) - begin)
    return best


class SeedTable:
    """The seeds of one block of benchmark items, sorted by hash, and the items' words."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], min_words: int, short_words: int):
        words = [hashed(text_words(text)) for _, text in items]
        self.ids = [item for item, _ in items]
        self.words = words
        self.tables = []
        long = [len(w) >= short_words for w in words]
        light = [short_words <= len(w) < max(min_words, MIN_WORDS) for w in words]
        # Items of fewer words than short_words are looked for as a whole.
        short = {len(w) for w in words if 0 < len(w) < short_words}
        whole = [("1" * n, [len(w) == n for w in words], True) for n in sorted(short)]
        tolerant = [(m, long, False) for m in masks] + [(m, light, False) for m in LIGHT_MASKS]
        for mask, wanted, exact in [x for x in tolerant if any(x[1])] + whole:
            found = [masked_hashes(w, mask) if yes else np.empty(0, np.uint64) for w, yes in zip(words, wanted)]
            hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
            item = np.repeat(np.arange(len(found)), [len(f) for f in found])
            place = np.concatenate([np.arange(len(f)) for f in found]) if found else np.empty(0, np.int64)
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[hashes >> np.uint64(64 - SIEVE_BITS)] = True
            self.tables.append((mask, exact, hashes[order], item[order], place[order], sieve))

    def diagonals(self, values: np.ndarray, starts: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """For each text with equal hashes: (item, place of the text less place of the item).

        ``values`` are the words of several texts in a row, ``starts`` where each begins and the last
        ends. Places whose mask reaches into the next text are left out, and all but the first place of
        an item that is looked for as a whole.
        """
        found: dict[int, set[tuple[int, int]]] = {}
        for mask, exact, hashes, items, places, sieve in self.tables:
            seeds = masked_hashes(values, mask)
            likely = np.flatnonzero(sieve[seeds >> np.uint64(64 - SIEVE_BITS)])
            if not len(likely):
                continue
            left = np.searchsorted(hashes, seeds[likely], "left")
            right = np.searchsorted(hashes, seeds[likely], "right")
            text = np.searchsorted(starts, likely, "right") - 1
            met = (right > left) & (likely + len(mask) <= starts[text + 1])
            if exact:
                met = np.flatnonzero(met)
                met = met[np.unique(np.stack([text[met], left[met]]), axis=1, return_index=True)[1]]
            for t, at, lo, hi in zip(*(x[met].tolist() for x in (text, likely - starts[text], left, right))):
                found.setdefault(t, set()).update((int(items[k]), at - int(places[k])) for k in range(lo, hi))
        return found

    def overlaps(
        self, values: np.ndarray, diagonals: set[tuple[int, int]], min_words: int, short_words: int, similarity: float
    ) -> list[dict]:
        """The best overlap of the text with each item, where it is long enough."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in diagonals:
            own = self.words[item]
            begin, end = max(0, -shift), min(len(own), len(values) - shift)
            equal = own[begin:end] == values[begin + shift : end + shift]
            first, length = longest_overlap(equal, similarity)
            n_equal = int(equal[first : first + length].sum())
            if length >= min(min_words, len(own)) and (n_equal == len(own) or len(own) >= short_words):
                at = begin + shift + first
                if item not in best or (-n_equal, at) < (-best[item][2], best[item][0]):
                    best[item] = (at, length, n_equal)
        rows = [(self.ids[item], *found) for item, found in best.items()]
        rows.sort(key=lambda r: (r[0] is None, r))
        return [dict(zip(("item_id", "first_word", "n_words", "n_equal"), row)) for row in rows]


def _searcher(table: SeedTable, min_words: int, short_words: int, similarity: float) -> Callable:
    """Function from texts to their overlaps."""

    def search(texts: list[str | None]) -> list[list]:
        words = [text_words(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        values = hashed(list(chain.from_iterable(words)))
        found: list[list[dict]] = [[] for _ in texts]
        for text, diagonals in table.diagonals(values, starts).items():
            own = values[starts[text] : starts[text + 1]]
            found[text] = table.overlaps(own, diagonals, min_words, short_words, similarity)
        return [found]

    return search


def find_overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_words: int = MIN_WORDS,
    short_words: int = SHORT_WORDS,
    similarity: float = SIMILARITY,
    block_words: int = BLOCK_WORDS,
    name: str = "overlaps",
) -> DataFrame:
    """Add ``overlaps``, or a column of another ``name``, in place of one of that name: for each benchmark item that a text overlaps, the longest overlap (words from 0).

    An overlap is a run of words of the text beside as many words of an item, place by place, of
    which at least the share ``similarity`` is equal, and which has ``min_words`` words, or the
    whole item if that is shorter. It is found if some mask fits at one place of it: all words under
    the mask are equal there; items of fewer than ``MIN_WORDS`` words have ``LIGHT_MASKS`` too, with which some
    mask always fits for the default similarity. Items of fewer than ``short_words`` words overlap where all
    their words are equal. In scripts without spaces each letter, with its marks, is a word.

    The benchmark is dealt into blocks of about ``block_words`` words by a hash of the item; each
    block, whose size is so bounded, goes to all tasks, and the documents pass the blocks one after
    the other. Documents are never shuffled. Null and empty texts overlap nothing; null items'
    texts count as empty, null item ids stay null; repeated items count once.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    unspaced = F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))
    sized = items.filter("text is not null").withColumn("size", F.size(F.split("text", r"\s+")) + unspaced)
    total = sized.agg(F.sum("size")).first()[0] or 0
    n_blocks = -(-total // block_words)
    found = documents.drop(name).withColumn(name, F.array().cast(T.ArrayType(OVERLAP)))
    for block in range(n_blocks):
        here = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        rows = sorted(((r.item_id, r.text) for r in here.select("item_id", "text").collect()), key=str)
        found = _pass(found, rows, text, masks, (min_words, short_words, similarity), name)
    return found


def _pass(found: DataFrame, rows: list, text: str, masks: tuple[str, ...], limits: tuple, name: str) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(rows)
    [own] = fresh(found, "more")
    field = T.StructField(own, T.ArrayType(OVERLAP))

    def start():
        return _searcher(SeedTable(shared.value, masks, *limits[:2]), *limits)

    more = with_text_columns(found, text, [field], start)
    joined = F.array_sort(F.concat(name, own))
    return more.withColumn(name, joined).drop(own)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that overlap no benchmark item, with their own columns."""
    [name] = fresh(documents, "overlaps")
    found = find_overlaps(documents, benchmark, text, name=name, **options)
    return found.filter(F.size(name) == 0).select(*documents.columns)
