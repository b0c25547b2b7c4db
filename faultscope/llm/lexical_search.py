"""Ranked lexical search: exact best documents per item by sparse ball trees and integer scores."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultscope.session import stored

RESULT = "item_id long, doc_id long, score long"
VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"
# ASCII other than letters and digits separates terms; A-Z turn into small letters; all other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
CHUNK = 1 << 20
# Distinct terms of the items that go to the tasks at a time, and of those that share one tree.
BLOCK_TERMS = 250_000
GROUP_TERMS = 4_096
# Texts and their entries that one tree is built of, and texts in a leaf.
SEGMENT_ROWS, SEGMENT_ENTRIES = 2_048, 250_000
LEAF = 32
SAMPLE = 1 / 64


def term_counts(text: str | None) -> tuple[int, Counter]:
    """Number of a text's terms, with repeats, and the occurrences of each."""
    folded = text.encode().translate(FOLD) if text else b""
    total, counts, at = 0, Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK) if at + CHUNK < len(folded) else -1
        end = len(folded) if end < 0 else end
        terms = folded[at:end].split()
        total += len(terms)
        counts.update(terms)
        at = end
    return total, counts


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, its distinct terms) in blocks of at most ``most`` distinct terms, an item of more alone; one block is held at a time."""
    block: list[tuple[int | None, list[bytes]]] = []
    vocabulary: set[bytes] = set()
    for item_id, rows in groupby(items.orderBy("item_id").toLocalIterator(), lambda r: r.item_id):
        terms = set().union(*(term_counts(r.text)[1] for r in rows))
        if not terms:
            continue
        if block and len(vocabulary | terms) > most:
            yield block
            block, vocabulary = [], set()
        block.append((item_id, sorted(terms)))
        vocabulary |= terms
    if block:
        yield block


def text_vectors(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of each row: all its terms counted, and the occurrences of those in the vocabulary."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c.split()[0] for c in VECTOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text"):
                total, found = term_counts(text.as_py())
                own = sorted((known[t], c) for t, c in found.items() if t in known)
                n.append(total)
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            columns = [batch.column("doc_id").to_pylist(), n, terms, counts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, VECTOR)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts`` and are ``sizes`` long, in order."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class Rows:
    """Sparse rows, each with at least one entry: columns and values of row i from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        at = ranges(self.starts[rows], sizes)
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), self.columns[at], self.values[at])

    def dot(self, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * vector[self.columns], self.starts[:-1])

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width, self.values.dtype)
        here = slice(self.starts[row], self.starts[row + 1])
        out[self.columns[here]] = self.values[here]
        return out


class BallTree:
    """Balls around centroids, halved along the line between two far points; ``order`` lists the rows leaf by leaf.

    All values are whole numbers of less than 2^53, so only sums of products are rounded. A sum of n
    products of numbers that are not negative is wrong by less than n times the unit of rounding; ``slack`` is several times that
    for the widest sum here. Radii are enlarged by it before the root, bounds after the sum, so no bound is below the true inner product.
    Besides its radius a ball has one along each coordinate, the most that a row exceeds the centroid there: a
    query's bound is the lesser of the norm times the radius and of the sum of these over its terms, plus the centroid's product.
    """

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        self.slack = 8 * (width + 16) * np.finfo(np.float64).eps
        self.width, self.leaf = width, leaf
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self.tops: list[np.ndarray] = []
        # Per node: children, or (-1, -1); and its rows in order, from and to.
        self.children: list[tuple[int, int]] = []
        self.spans: list[tuple[int, int]] = []
        order: list[np.ndarray] = []
        floats = Rows(rows.starts, rows.columns, rows.values.astype(np.float64))
        # Halving is iterative: (rows of the node, its parent, whether it is the second child).
        pending = [(np.arange(len(rows)), -1, 0)]
        done = 0
        while pending:
            members, parent, second = pending.pop()
            node = len(self.centers)
            halves = self._add(floats.take(members), members)
            if parent >= 0:
                one, two = self.children[parent]
                self.children[parent] = (one, node) if second else (node, two)
            self.spans.append((done, done + len(members)))
            if halves:
                # The first half is taken next, so that a node's rows follow each other.
                pending += [(halves[1], node, 1), (halves[0], node, 0)]
            else:
                order.append(members)
                done += len(members)
        self.order = np.concatenate(order)
        self.center = np.array(self.centers)
        self.radius = np.array(self.radii)
        self.along = np.array(self.tops) - self.center
        self.rows = rows.take(self.order)

    def _add(self, own: Rows, members: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Append the ball of these rows; their halves, unless they are a leaf."""
        center = np.bincount(own.columns, own.values, self.width) / len(own)
        squares = np.add.reduceat(own.values**2, own.starts[:-1])
        length = float(center @ center)
        apart = squares - 2 * own.dot(center) + length + self.slack * (squares + length)
        top = np.zeros(self.width)
        np.maximum.at(top, own.columns, own.values)
        self.tops.append(top)
        self.centers.append(center)
        self.radii.append(float(np.sqrt(apart.max())) * (1 + self.slack))
        self.children.append((-1, -1))
        if len(own) <= self.leaf:
            return None
        one = own.dense(int(apart.argmax()), self.width)
        away = squares - 2 * own.dot(one)
        two = own.dense(int(away.argmax()), self.width)
        order = np.argsort(own.dot(two - one), kind="stable")
        half = len(own) // 2
        return members[order[:half]], members[order[half:]]

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each node a number that no row of it exceeds in its sum over the columns ``query``."""
        middle = self.center[:, query].sum(axis=1)
        along = self.along[:, query].sum(axis=1)
        return (middle + np.minimum(np.sqrt(len(query)) * self.radius, along)) * (1 + self.slack)

    def search(self, query: np.ndarray, best: Best) -> int:
        """Offer ``best`` all rows that can be among the best, by the balls' bounds from the highest down; leaves looked at."""
        bounds = self.bounds(query)
        wanted = np.zeros(self.width, np.int64)
        wanted[query] = 1
        heap = [(-bounds[0], 0)]
        looked = 0
        while heap and -heap[0][0] >= best.least:
            bound, node = heapq.heappop(heap)
            one, two = self.children[node]
            if one >= 0:
                for child in (one, two):
                    if bounds[child] >= best.least:
                        heapq.heappush(heap, (max(bound, -bounds[child]), child))
                continue
            looked += 1
            first, end = self.spans[node]
            starts = self.rows.starts[first : end + 1]
            here = slice(starts[0], starts[-1])
            scores = np.add.reduceat(self.rows.values[here] * wanted[self.rows.columns[here]], starts[:-1] - starts[0])
            for at in np.flatnonzero(scores >= best.least):
                best.offer(int(scores[at]), self.order[first + at])
        return looked


class Best:
    """The best (score, row) so far: higher scores first, then rows of smaller rank; at least ``floor``."""

    def __init__(self, size: int, floor: int, ids: list[list[tuple[bool, int]]] | None = None):
        self.size, self.floor = size, max(floor, 1)
        self.found: list[tuple[int, bool, int]] = []
        self.ids = ids or []

    @property
    def least(self) -> int:
        """A score that others must reach."""
        return max(self.floor, -self.found[-1][0]) if len(self.found) == self.size else self.floor

    def offer(self, score: int, row: int) -> None:
        self.found = sorted(self.found + [(-score, *i) for i in self.ids[row]])[: self.size]


@dataclass
class Index:
    """What the tasks get: items as numbers of terms, weights of terms, the corpus's figures, and scores to start with."""

    items: list[tuple[int | None, np.ndarray]]
    weights: np.ndarray
    n_documents: int
    n_terms: int
    size: int
    floors: dict[int | None, int]

    def groups(self, most: int = GROUP_TERMS) -> Iterator[tuple[np.ndarray, list[int]]]:
        """(terms, items) with at most ``most`` terms, an item of more alone."""
        terms: set[int] = set()
        items: list[int] = []
        for k, (_, own) in enumerate(self.items):
            more = terms.union(own.tolist())
            if items and len(more) > most:
                yield np.array(sorted(terms)), items
                items, more = [], set(own.tolist())
            terms = more
            items.append(k)
        if items:
            yield np.array(sorted(terms)), items

    def impacts(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A term's share of a document's score."""
        m = 10 + (90 * n * self.n_documents) // self.n_terms
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, sizes)))


def search_segment(index: Index, segment: tuple, best: list[Best], groups: list[tuple[np.ndarray, list[int]]]) -> None:
    """Search one segment of documents for all items."""
    ids, n, starts, terms, counts = segment
    sizes = np.diff(starts)
    values = index.impacts(n, sizes, terms, counts)
    for own, items in groups:
        column = np.full(len(index.weights), -1, np.int64)
        column[own] = np.arange(len(own))
        inside = (column[terms] >= 0) & (values > 0)
        kept = np.add.reduceat(inside, starts[:-1])
        rows = np.flatnonzero(kept)
        if not len(rows):
            continue
        at = np.concatenate([[0], np.cumsum(kept[rows])])
        sparse = Rows(at, column[terms[inside]], values[inside])
        # Equal rows are one point with the first ids of all.
        points: dict[bytes, int] = {}
        names: list[list[tuple[bool, int]]] = []
        firsts = []
        for k, row in enumerate(rows.tolist()):
            here = slice(at[k], at[k + 1])
            mark = sparse.columns[here].tobytes() + sparse.values[here].tobytes()
            point = points.setdefault(mark, len(points))
            if point == len(names):
                names.append([])
                firsts.append(k)
            names[point].append(ids[row])
        names = [sorted(x)[: index.size] for x in names]
        tree = BallTree(sparse.take(np.array(firsts)), len(own))
        for k in items:
            best[k].ids = names
            tree.search(column[index.items[k][1]], best[k])


def search_vectors(vectors: DataFrame, index: Index) -> DataFrame:
    """``item_id, doc_id, score`` of the best documents of each partition; a superset of the best of all."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[pa.RecordBatch] = []
        n_rows = entries = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                n_rows += part.num_rows
                entries += len(part.column("terms").flatten())
                if n_rows >= SEGMENT_ROWS or entries >= SEGMENT_ENTRIES:
                    yield arrays(held)
                    held, n_rows, entries = [], 0, 0
        if held:
            yield arrays(held)

    def arrays(held: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = [(i is None, i or 0) for i in table.column("doc_id").to_pylist()]
        n = table.column("n").to_numpy()
        lists = [table.column(c).combine_chunks() for c in ("terms", "counts")]
        terms, counts = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        sizes = lists[0].value_lengths().to_numpy()
        return ids, n, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        groups = list(index.groups())
        best = [Best(index.size, index.floors.get(item, 0)) for item, _ in index.items]
        for segment in segments(batches):
            search_segment(index, segment, best, groups)
        found = [(item, None if unknown else i, -score) for (item, _), b in zip(index.items, best) for score, unknown, i in b.found]
        if found:
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, RESULT)


def ranked(found: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def search(
    documents: DataFrame,
    items: DataFrame,
    size: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``size`` best documents of each item: ``item_id, rank, doc_id, score``, equal scores by ascending id.

    Terms are runs of letters, digits and all characters beyond ASCII, A-Z in lower case. A document is
    the sparse vector of what each term adds to its score (term frequency, rarity, length, in whole numbers),
    so its score is its inner product with an item's terms. N, L and df are counted over all documents.

    Each task builds ball trees over segments of its documents, on the coordinates that the items use, and
    searches them best first: a ball whose bound (inner product with the centroid plus the item's norm times the radius, rounded up)
    is below an item's last score is left out with all its subtrees; leaves are scored exactly in
    integers. Each partition hands on at most ``size`` rows per item that reach the last score within a sample of the documents, of
    which the best are the result. The sample only sets where pruning starts: the result is the same without it.

    Items go to the tasks in blocks of at most ``block_terms`` distinct terms, a pass over the documents each. Rows that share an
    item id are one item with the terms of all; a null id is an id. Null and empty texts have no terms: such documents are
    in no result, such items have none. Repeated documents are rows of their own; null document ids come after all others.
    Extra columns are neither read nor returned, whatever their names.
    """
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    found = None
    for block in item_blocks(asked, block_terms):
        part = _search_block(rows, block, size)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.select("item_id", "rank", "doc_id", "score")


def _search_block(documents: DataFrame, block: list[tuple[int | None, list[bytes]]], size: int) -> DataFrame:
    numbers = {t: k for k, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    vectors = stored(text_vectors(documents, numbers), "term-vectors")
    total = vectors.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.sum("n")).first()
    n_documents, n_terms = int(total[0] or 0), int(total[1] or 0)
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(numbers))
    df[[r["term"] for r in held]] = [r["count"] for r in held]
    weights = np.floor(1000 * np.log((2.0 * n_documents + 2) / (2 * df + 1))).astype(np.int64)
    items = [(item, np.array([numbers[t] for t in terms])) for item, terms in block]
    index = Index(items, weights, n_documents, n_terms, size, {})
    start = ranked(search_vectors(vectors.sample(SAMPLE, seed=11), index), size).filter(F.col("rank") == size).collect()
    index = Index(items, weights, n_documents, n_terms, size, {r.item_id: r.score for r in start})
    return ranked(search_vectors(vectors, index), size)
