"""Packing: documents in their order are cut into windows of bounded length by dynamic programming."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.arrow_columns import text_slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Marks after which a sentence ends: at the end of a word, or anywhere in scripts without spaces.
WORD_END = tuple(".!?…")
ANYWHERE = frozenset("。！？｡")
CLOSING = "\"'”’»)]}"
SPECIAL = "<|"
# Words of two pieces at most, which need no offsets: Latin letters, which neither normal forms nor lower case turn into several
# pieces (that of U+0130 has a mark), and marks of ASCII behind them, which are one piece.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)").fullmatch
CHUNK = 1 << 20


@dataclass(frozen=True)
class Costs:
    """What a window costs, in tokens of padding.

    ``length`` tokens are a whole window; shorter ones are padded up to it, unless their length is a
    power of two. A cut inside a document costs ``sentence`` where a sentence ends and ``free``
    elsewhere. A window that needs no padding as its length is a smaller power of two costs ``short``; of
    these only lengths from ``short`` on are tried, but for the end of the stream.
    """

    length: int = 2048
    sentence: int = 4
    free: int = 16
    short: int = 256
    # Where no sentence ends for so many tokens, free cuts are offered every ``step`` tokens.
    step: int = 16


class WordEncoder:
    """Token ids of texts, and the places where sentences end.

    The tokenizer drops white space and no token reaches over it, so a text's ids are those of
    its words, one after the other. Each distinct word is looked up once and kept, ``most`` words at a time. Plain words
    are put together from their pieces, in lower case, which the library encodes once each and which are kept likewise; other
    words are encoded as they are. Texts that may hold special strings are encoded as a whole.
    """

    def __init__(self, vocabulary: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        entries = self.tokenizer.get_vocab()
        # The last token of each piece that the tokenizer splits a word into.
        self.closes = np.zeros(max(entries.values()) + 1, bool)
        self.closes[[number for token, number in entries.items() if token.endswith("</w>")]] = True
        self.most = most
        # Word 0 is the empty one, word 1 the end of a line.
        self.words, self.pieces = _Known(["", "\n"]), _Known([""])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words' ids, their number per word, all numbers of ids after which a sentence ends, their number per word."""
        joined = " ".join(words)
        found = self.tokenizer.encode(joined, add_special_tokens=False)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(found.offsets)).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 0], starts)
        first[0] = 0
        sizes = np.diff(first, append=len(offsets))
        ended = np.fromiter((w.rstrip(CLOSING).endswith(WORD_END) for w in words), bool, len(words))
        stops = np.zeros(len(offsets) + 1, bool)
        stops[(first + sizes)[ended & (sizes > 0)]] = True
        if any(mark in joined for mark in ANYWHERE):
            # A character may be several ids; the sentence ends after the last of them.
            following = np.append(offsets[1:, 0], len(joined))
            mark = np.fromiter((e > 0 and joined[e - 1] in ANYWHERE for e in offsets[:, 1]), bool, len(offsets))
            stops[1:] |= mark & (offsets[:, 1] <= following)
        ends = np.flatnonzero(stops)
        word = np.searchsorted(first + sizes, ends)
        return np.array(found.ids, np.uint32), sizes, ends - first[word], np.bincount(word, minlength=len(words))

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for strings that the tokenizer does not split, found by the tokens that close a piece."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0)
        ended = np.fromiter((p.rstrip(CLOSING).endswith(WORD_END) for p in pieces), bool, len(pieces))
        return ids, sizes, sizes[ended], ended.astype(np.int64)

    def _encode_plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for plain words, given by their letters and their marks in turn."""
        at = self.pieces.numbers_of(pieces)
        if self.pieces.new:
            self.pieces.extend(*self._encode_pieces(self.pieces.new))
        ids, sizes = self.pieces.ids.take(at)
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        n_ends = self.pieces.ends.sizes[at[1::2]]
        return ids, sizes, sizes[n_ends > 0], n_ends

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the sorted places (numbers of ids) where a sentence ends."""
        parts: list[list[tuple]] = [[] for _ in texts]
        held, size = [], 0
        for number, text in enumerate(texts):
            for chunk in _chunks(text):
                held.append((number, chunk))
                size += len(chunk)
                if size >= CHUNK:
                    self._encode_chunks(held, parts)
                    held, size = [], 0
        self._encode_chunks(held, parts)
        return [_joined(p) for p in parts]

    def _learn(self, words: list[str]) -> None:
        """Keep the words that were met for the first time, in their order."""
        plain, rest, pieces = [], [], []
        for place, word in enumerate(words):
            found = PLAIN(word)
            if found:
                plain.append(place)
                letters, marks = found.groups()
                pieces.append(letters.lower())
                pieces.append(marks)
            else:
                rest.append(place)
        encoded = [self._encode_plain(pieces)] if plain else []
        if rest:
            encoded.append(self._encode([words[place] for place in rest]))
        if encoded:
            self.words.extend(*map(np.concatenate, zip(*encoded)), np.array(plain + rest))

    def _encode_chunks(self, chunks: list[tuple[int, str]], parts: list[list[tuple]]) -> None:
        """Append (ids, sentence ends) of each chunk to the parts of its text."""
        for known in (self.words, self.pieces):
            if len(known.numbers) > self.most or known.ids.n > 8 * self.most:
                known.clear()
        words: list[str] = []
        bounds, special = [0], []
        for _, chunk in chunks:
            if SPECIAL in chunk:
                special.append((len(words), chunk))
                words.append("")
            else:
                words += chunk.replace("\n", " \n ").split(" ")
            bounds.append(len(words))
        at = self.words.numbers_of(words)
        self._learn(self.words.new)
        for place, chunk in special:
            # A word that has no key, so that it is not found again.
            at[place] = self.words.ids.n_lists
            self.words.extend(*self._encode([chunk]))
        ids, sizes = self.words.ids.take(at)
        before = np.concatenate([[0], np.cumsum(sizes)])
        ends, n_ends = self.words.ends.take(at)
        ends += np.repeat(before[:-1], n_ends)
        id_bounds = before[bounds].tolist()
        end_bounds = np.concatenate([[0], np.cumsum(n_ends)])[bounds].tolist()
        for k, (number, _) in enumerate(chunks):
            own = ends[end_bounds[k] : end_bounds[k + 1]] - id_bounds[k]
            own = own[np.diff(own, prepend=-1) > 0]
            parts[number].append((ids[id_bounds[k] : id_bounds[k + 1]], own))


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> WordEncoder:
    """The encoder of a Python worker, with the words that its earlier tasks have met."""
    # A task has one core; the library would start a pool of threads, each with memory of its own.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(vocabulary)


def _chunks(text: str) -> Iterator[str]:
    """The text in parts of about ``CHUNK`` characters that end before a space or a new line."""
    at = 0
    while len(text) - at > CHUNK:
        found = [k for k in (text.find(mark, at + CHUNK) for mark in (" ", "\n")) if k >= 0]
        if not found:
            break
        yield text[at : min(found)]
        at = min(found)
    yield text[at:]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    before = np.cumsum([0] + [len(ids) for ids, _ in parts])
    return np.concatenate([ids for ids, _ in parts]), np.unique(np.concatenate([e + b for (_, e), b in zip(parts, before)]))


class _Lists:
    """Lists of numbers in one growing array."""

    def __init__(self, kind: type):
        self.flat, self.n = np.empty(1024, kind), 0
        self.starts, self.sizes, self.n_lists = np.empty(1024, np.int64), np.empty(1024, np.int64), 0

    def extend(self, numbers: np.ndarray, sizes: np.ndarray, places: np.ndarray | slice = slice(None)) -> None:
        """Append lists of these sizes, whose numbers follow each other; ``places`` are those of the lists among the new ones."""
        self.flat = _grown(self.flat, self.n, len(numbers))
        self.flat[self.n : self.n + len(numbers)] = numbers
        self.starts, self.sizes = (_grown(x, self.n_lists, len(sizes)) for x in (self.starts, self.sizes))
        here = slice(self.n_lists, self.n_lists + len(sizes))
        self.sizes[here][places] = sizes
        self.starts[here][places] = self.n + np.cumsum(sizes) - sizes
        self.n, self.n_lists = self.n + len(numbers), self.n_lists + len(sizes)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these lists in a row, and the size of each list."""
        sizes = self.sizes[at]
        return self.flat[_ranges(self.starts[at], sizes)], sizes


class _Numbers(dict):
    """Numbers of strings: those that are not there yet get the next ones, from ``first`` on, and are listed in ``new``."""

    def __missing__(self, key: str) -> int:
        number = self[key] = self.first + len(self.new)
        self.new.append(key)
        return number


class _Known:
    """Strings with their ids and the places where sentences end."""

    def __init__(self, given: list[str]):
        self.given = given
        self.clear()

    def clear(self) -> None:
        """Forget all strings but the given ones: a first that has no ids, and others that have none and end a sentence."""
        self.numbers = _Numbers(zip(self.given, range(len(self.given))))
        self.ids, self.ends = _Lists(np.uint32), _Lists(np.int64)
        n_ends = np.arange(len(self.given)) > 0
        self.extend(np.empty(0, np.uint32), np.zeros(len(self.given), np.int64), np.zeros(n_ends.sum(), np.int64), n_ends.astype(np.int64))

    @property
    def new(self) -> list[str]:
        return self.numbers.new

    def numbers_of(self, strings: list[str]) -> np.ndarray:
        """The number of each string; ``new`` are those that have to be kept by ``extend``, in the order of their numbers."""
        self.numbers.first, self.numbers.new = self.ids.n_lists, []
        return np.fromiter(map(self.numbers.__getitem__, strings), np.int64, len(strings))

    def extend(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, n_ends: np.ndarray, places: np.ndarray | slice = slice(None)) -> None:
        self.ids.extend(ids, sizes, places)
        self.ends.extend(ends, n_ends, places)


def _grown(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    out = np.empty(max(2 * len(array), used + more), array.dtype)
    out[:used] = array[:used]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts`` and are ``sizes`` long, in order."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def cut_places(ends: np.ndarray, size: int, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document of ``size`` tokens where it may be cut, its end included, and what each cut costs."""
    inner = ends[(ends > 0) & (ends < size)]
    fixed = np.concatenate([[0], inner, [size]])
    gaps = np.diff(fixed)
    more = np.where(gaps > 2 * costs.step, (gaps - 1) // costs.step, 0)
    free = np.repeat(fixed[:-1], more) + costs.step * (_ranges(np.zeros(len(more), np.int64), more) + 1)
    places = np.concatenate([inner, free, [size]]).astype(np.int64)
    price = np.concatenate([np.full(len(inner), costs.sentence), np.full(len(free), costs.free), [0]])
    order = np.argsort(places, kind="stable")
    return places[order], price[order]


def window_cost(size: int, costs: Costs) -> int:
    """Padding of a window, or what a shorter one without padding costs."""
    if size == costs.length:
        return 0
    return costs.short if size & (size - 1) == 0 else costs.length - size


def tail_windows(size: int, costs: Costs) -> tuple[int, list[int]]:
    """Cheapest windows for the last ``size`` tokens: one that is padded, or powers of two with free cuts between."""
    if size == costs.length:
        return 0, [size]
    powers = [1 << k for k in reversed(range(size.bit_length())) if size >> k & 1]
    split = len(powers) * costs.short + (len(powers) - 1) * costs.free
    whole = window_cost(size, costs)
    return (split, powers) if split < whole else (whole, [size])


def best_cuts(places: list[int], prices: list[int], costs: Costs, last: bool) -> list[int]:
    """Ends of the windows that cut the stream from 0 to the last of ``places`` at least cost.

    ``places`` rise, by ``costs.length`` at most. A window from i to j costs its padding and the price of the cut at j. Without powers of two
    the padding is ``length - j + i``, so the best start of j is the least ``cost(i) + i`` of those that
    a window reaches: the front of a queue whose keys rise, which each place enters and leaves once. Powers of two are one
    lookup each, where the least cost within reach does not rule them out. If the stream ends here (``last``), its tail may also be powers of two.
    """
    length, short = costs.length, costs.short
    powers = [1 << k for k in range(length.bit_length()) if short <= 1 << k < length]
    best = {0: 0}
    came: dict[int, int] = {}
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    # The least cost in the stretch of ``length`` tokens that j lies in, and in the one before; they hold all that a power reaches.
    stretch, earlier, lately = 0, 0, 0
    for j, price in zip(places, prices):
        if j // length != stretch:
            stretch, earlier, lately = j // length, lately, math.inf
        while queue[0][1] < j - length:
            queue.popleft()
        key, start = queue[0]
        least = key + length - j
        if earlier + short < least or lately + short < least:
            for power in powers:
                before = best.get(j - power)
                if before is not None and before + short < least:
                    least, start = before + short, j - power
        least += price
        best[j], came[j] = least, start
        if least < lately:
            lately = least
        key = least + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    end = places[-1]
    cuts: list[int] = []
    if last:
        reach = [i for i in best if end - length <= i < end]
        start = min(reach, key=lambda i: (best[i] + tail_windows(end - i, costs)[0], i))
        for size in reversed(tail_windows(end - start, costs)[1]):
            cuts.append(end)
            end -= size
    while end:
        cuts.append(end)
        end = came[end]
    return cuts[::-1]


class Packer:
    """Takes documents in order and gives their pieces; holds at most a run of tokens and the document it is in."""

    def __init__(self, costs: Costs, run_tokens: int, first_sequence: int):
        self.costs, self.sequence = costs, first_sequence
        self.run_tokens = max(run_tokens, 4 * costs.length)
        # Documents, or what is left of them: (id, ids, start of the run in them, places, prices).
        self.held: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        places, prices = cut_places(ends, len(ids), self.costs)
        at = 0
        while at < len(ids):
            # As much of the document as the run still takes, up to a place where it may be cut.
            room = at + max(self.run_tokens - self.size, 1)
            upto = int(np.searchsorted(places, min(room, len(ids))))
            end = int(places[upto])
            low = int(np.searchsorted(places, at, "right"))
            if self.held and self.held[-1][1] is ids:
                start = self.held.pop()[2]
                low = int(np.searchsorted(places, start, "right"))
            else:
                start = at
            self.held.append((doc_id, ids, start, end, places[low : upto + 1], prices[low : upto + 1]))
            self.size += end - at
            at = end
            if self.size >= self.run_tokens:
                yield from self.cut(False)

    def cut(self, last: bool) -> Iterator[tuple]:
        """Pieces of the best windows of the run; unless it is the last, its last window stays for the next run."""
        if not self.size:
            return
        places: list[np.ndarray] = []
        begin = 0
        for _, _, start, end, own, _ in self.held:
            places.append(own - start + begin)
            begin += end - start
        flat = np.concatenate(places).tolist()
        prices = np.concatenate([h[5] for h in self.held]).tolist()
        cuts = best_cuts(flat, prices, self.costs, last)
        if not last:
            cuts = cuts[:-1]
        kept: list[tuple] = []
        begin, at, number = 0, 0, 0
        for doc_id, ids, start, end, own, price in self.held:
            stop = begin + end - start
            while at < stop and number < len(cuts):
                upto = min(stop, cuts[number])
                part = ids[start + at - begin : start + upto - begin]
                offset = at - (cuts[number - 1] if number else 0)
                crc = zlib.crc32(part.astype("<u4").tobytes())
                yield doc_id, start + at - begin, len(part), crc, len(ids), self.sequence, offset
                at = upto
                if at == cuts[number]:
                    number += 1
                    self.sequence += 1
            if at < stop:
                rest = start + max(at, begin) - begin
                low = int(np.searchsorted(own, rest, "right"))
                kept.append((doc_id, ids, rest, end, own[low:], price[low:]))
            begin = stop
        self.held = kept
        self.size = sum(end - start for _, _, start, end, _, _ in kept)


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    costs: Costs = Costs(),
    run_tokens: int = 1 << 20,
) -> DataFrame:
    """Pieces of documents in sequences of bounded length, with little padding and few cuts inside sentences.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a piece is ``length``
    ids of its document from ``start`` on, and lies at ``offset`` of its sequence. A document is the ids of its text,
    without added special tokens, and ``end_id``.

    Documents keep the order in which the table has them: each task packs the rows of its partition,
    one after the other, and no sequence reaches over partitions, so nothing is shuffled and no key can be hot. Windows are the
    best cuts of ``run_tokens`` tokens at a time; the last window of a run begins the next one, so memory is bounded
    by a run and one document. Sequence ids are unique, not gapless: the partition's number times 2^40 and the place in it.

    Null texts are empty: one piece of the end id. Null ids and repeated rows are documents like all others; empty tables
    give no pieces. Other columns are neither read nor returned, whatever their names.
    """
    vocabulary = open(tokenizer_path, encoding="utf-8").read()
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        packer = Packer(costs, run_tokens, TaskContext.get().partitionId() << 40)
        tail = np.array([end_id], np.uint32)
        found: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)
            found.clear()
            return batch

        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for part in text_slices(batch.column("text").to_pylist()):
                for own, ends in encoder.encode(part):
                    found.extend(packer.add(next(ids), np.concatenate([own, tail]), ends))
                if len(found) >= 10_000:
                    yield flushed()
        found.extend(packer.cut(True))
        if found:
            yield flushed()

    return rows.mapInArrow(run, PIECES)
