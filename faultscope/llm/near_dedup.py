"""MinHash near-duplicates by an LSH forest, with links confirmed on the full sets of shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.llm.arrow_columns import with_text_columns
from faultscope.llm.names import fresh
from faultscope.llm.words import ascii_words, mixed, odd_constants, shingle_set
from faultscope.operators.components import connected_groups
from faultscope.session import shuffled, stored

TREES = 16
# Hashes that two sets must share at least to be candidates, of 16 bits each: one long.
DEPTH = 4
SIMILARITY = 80
# Neighbours in so many orders are compared first.
OFTEN = 3
# Rows of a region up to which it keeps the least depth; each further hash stands for so many times more.
REGION, FANOUT = 64, 16
# How often groups are compared with the leading one of their regions before the exact filter takes the rest.
ROUNDS = 2
# Buckets in which shingles are counted for the order of the filter.
BUCKET_BITS = 18
STEP = 2048
SLICE_ROWS = 256
# A power of two: numbers of 64 bits in the parity of a set.
PARITY_LONGS = 8

OFFSETS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64))
FACTORS = odd_constants(TREES * DEPTH, 6)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``TREES`` numbers, each made of ``DEPTH`` minimum hashes of the set cut to 16 bits."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STEP):
        hashes = (shingles[at : at + STEP, None] ^ OFFSETS) * FACTORS
        np.minimum(least, hashes.min(axis=0), out=least)
    parts = (mixed(least) & np.uint64(0xFFFF)).reshape(TREES, DEPTH)
    total = np.zeros(TREES, np.uint64)
    for k in range(DEPTH):
        total = (total << np.uint64(16)) | parts[:, k]
    return total.view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def with_signatures(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, labels`` of each row; no digest and no labels for empty sets."""

    def start():
        def signed(texts: list[str | None]) -> list[list]:
            sets = [shingle_set(ascii_words(t), size) for t in texts]
            return [
                [len(s) for s in sets],
                [set_digest(s) if len(s) else None for s in sets],
                [signature(s) if len(s) else None for s in sets],
            ]

        return signed

    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("labels", T.ArrayType(T.LongType())),
    ]
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return with_text_columns(rows, "text", fields, start).select("doc_id", "text_hash", "n_shingles", "digest", "labels")


def forest(nodes: DataFrame) -> DataFrame:
    """One row per node and tree, dealt by ranges of its sequence of hashes and in that order.

    The sequence of a tree is its own ``DEPTH`` hashes (the label) and those of the next tree (deeper). A region
    that holds a large group of copies is dealt to as many tasks as its rows fill.
    """
    rows = nodes.select("node", "labels", F.posexplode("labels").alias("tree", "label"))
    deeper = F.element_at("labels", (F.col("tree") + 1) % TREES + 1)
    rows = rows.select("tree", "label", deeper.alias("deeper"), "node")
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartitionByRange(parts, "tree", "label", "deeper", "node").sortWithinPartitions(
        "tree", "label", "deeper", "node"
    )


MEMBERS = [("tree", pa.int32()), ("label", pa.int64()), ("deeper", pa.int64()), ("node", pa.binary()), ("before", pa.binary()), ("depth", pa.int32())]


def common_prefix(a: int, b: int) -> int:
    """Leading hashes of 16 bits that two numbers of ``DEPTH`` hashes share."""
    apart = (a ^ b) & 0xFFFFFFFFFFFFFFFF
    return (64 - apart.bit_length()) // 16


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose region has other rows, with the row before, their neighbour of the longest common prefix on that side,
    and that prefix's depth; the ends of a task's rows are always kept."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), MEMBERS)], names=[n for n, _ in MEMBERS])

    held: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "label", "deeper", "node"))):
            if held is None:
                held = (*row, None, 0, True)
                continue
            same = held[:2] == row[:2]
            if same or held[6]:
                out.append(held[:6])
            held = (*row, held[3], DEPTH + common_prefix(held[2], row[2]), same) if same else (*row, None, 0, same)
        if out:
            yield rows(out)
    if held is not None:
        yield rows([held[:6]])


def _alike(shared, a, b, similarity: int):
    return 100 * shared >= similarity * (a + b - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike, by joining each side's set."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(shuffled(left), "a").join(shuffled(right), "b")
    x, y = F.size("x"), F.size("y")
    both = both.filter(_alike(F.least(x, y), x, y, similarity))
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(_alike(shared, x, y, similarity)).select(*pairs.columns)


def _mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which several groups meet, with the largest group there and its smallest node."""
    counted = rows.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    largest = F.max(F.struct("n", "group", "first")).alias("largest")
    found = counted.groupBy(*keys).agg(largest, F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n")).filter("n_groups > 1")
    return found.select(*keys, F.col("largest.group").alias("main"), F.col("largest.first").alias("leader"), "n")


def regions(members: DataFrame) -> DataFrame:
    """(tree, label, deeper, node): regions of adaptive depth, ``deeper`` cut to the hashes that a region of its size takes."""
    sizes = members.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n"))
    extra = F.least(F.lit(4), F.ceil(F.log(F.col("n") / REGION) / np.log(FANOUT))).cast("int")
    cut = F.when(F.col("n") <= REGION, F.lit(0)).otherwise(F.expr("shiftrightunsigned(deeper, 16 * (4 - extra))"))
    placed = members.join(shuffled(sizes), ["tree", "label"]).withColumn("extra", extra)
    return placed.select("tree", "label", cut.cast("long").alias("deeper"), "node")


def leader_pairs(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """Each node beside the smallest node of its region's largest group, where it is not of that group: one pair per row."""
    keys = ["tree", "label", "deeper"]
    rows = placed.join(shuffled(groups), "node")
    met = rows.join(shuffled(_mixed(rows, keys).drop("n")), keys).filter("group != main")
    return met.select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("group").alias("ga"), F.col("main").alias("gb")).distinct()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def shingle_frequency(sets: DataFrame) -> np.ndarray:
    """Occurrences per bucket of shingles; their number is fixed, whatever the sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                flat = batch.column("shingles").slice(at, SLICE_ROWS).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                total += np.bincount(_bucket(flat), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = sets.select("shingles").mapInArrow(count, "bucket long, n long")
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << BUCKET_BITS, np.int64)
    frequency[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return frequency


def rarest(shingles: np.ndarray, frequency: np.ndarray, similarity: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set in an order of all by frequency, and how many of them it shows to larger sets.

    A set of n shingles shares at least ``similarity`` percent of n with one it is alike, and 2 s / (100 + s) of n if that one
    is as large or larger. So the first they share stands within the n - share + 1 first of both.
    """
    n = len(shingles)
    kept = n - -(-similarity * n // 100) + 1
    shown = n - -(-2 * similarity * n // (100 + similarity)) + 1
    order = np.lexsort((shingles, frequency[_bucket(shingles)]))
    return shingles[order[:kept]], shown


def parity(shingles: np.ndarray) -> np.ndarray:
    """``PARITY_LONGS`` numbers whose bits say of each class of shingles whether the set holds an odd number of them.

    Each shingle that only one of two sets holds changes one bit, so the sets differ in as many shingles at least as the bits do.
    """
    classes = np.bincount((shingles & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS)
    return np.packbits((classes & 1).astype(np.uint8)).view(np.int64)


def open_prefixes(placed: DataFrame, groups: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``shingle, node, group, size, place, shown, bits``: the rarest shingles of all nodes in regions with several groups.

    Two nodes that are alone in a region have met there as leader and other, and need no more.
    """
    keys = ["tree", "label"]
    rows = placed.join(shuffled(groups), "node")
    nodes = rows.join(shuffled(_mixed(rows, keys).filter("n > 2")), keys, "left_semi").select("node", "group").distinct()
    own = stored(sets.join(shuffled(nodes), "node").select("node", "group", "shingles"), "open-sets")
    shared = own.sparkSession.sparkContext.broadcast(shingle_frequency(own))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in chain.from_iterable((b.slice(at, SLICE_ROWS) for at in range(0, b.num_rows, SLICE_ROWS)) for b in batches):
            lists = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column("shingles")]
            found = [rarest(x, frequency, similarity) for x in lists]
            counts = [len(f) for f, _ in found]
            row = np.repeat(np.arange(len(found)), counts)
            place = np.concatenate([np.arange(n) for n in counts])
            shown = place < np.repeat([k for _, k in found], counts)
            flat = np.concatenate([f for f, _ in found]).view(np.int64)
            sizes = np.array([len(x) for x in lists])[row]
            nodes, own_groups = (batch.column(c).take(pa.array(row)) for c in ("node", "group"))
            bits = pa.array([parity(x) for x in lists], pa.list_(pa.int64())).take(pa.array(row))
            columns = [pa.array(flat), nodes, own_groups, pa.array(sizes), pa.array(place), pa.array(shown), bits]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "node", "group", "size", "place", "shown", "bits"])

    schema = "shingle long, node binary, group binary, size long, place long, shown boolean, bits array<long>"
    return stored(own.mapInArrow(prefixes, schema), "prefixes")


def rare_pairs(prefixes: DataFrame, similarity: int) -> DataFrame:
    """Pairs of different groups that can be alike, by an exact prefix filter with sizes, places and parities.

    Nodes meet under their rarest shingles, a larger one with those that the smaller shows to it. Where all of a shingle's nodes are of
    one group there is nothing to do; elsewhere one of a pair is not of the largest group there.
    """
    met = prefixes.join(shuffled(_mixed(prefixes, ["shingle"]).select("shingle", "main")), "shingle")
    names = ["shingle", "node", "group", "size", "place", "bits", "main"]
    larger = met.select(*(F.col(c).alias(f"x_{c}") for c in names))
    smaller = met.filter("shown").select(*(F.col(c).alias(f"y_{c}") for c in names))
    least = F.col("y_size") - F.col("y_place"), F.col("x_size") - F.col("x_place")
    apart_by = sum(F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("y_bits", F.lit(i)))) for i in range(PARITY_LONGS))
    fits = (
        (F.col("x_shingle") == F.col("y_shingle"))
        & (F.col("x_group") != F.col("y_group"))
        & (F.col("y_size") <= F.col("x_size"))
        & (100 * F.col("y_size") >= similarity * F.col("x_size"))
        & ((100 + similarity) * F.least(*least) >= similarity * (F.col("x_size") + F.col("y_size")))
        & ((100 + similarity) * apart_by <= (100 - similarity) * (F.col("x_size") + F.col("y_size")))
    )
    apart = larger.filter("x_group != x_main").join(shuffled(smaller), fits)
    apart = apart.unionByName(larger.filter("x_group = x_main").join(shuffled(smaller.filter("y_group != y_main")), fits))
    ends = [F.struct(F.col(f"{c}_node").alias("node"), F.col(f"{c}_group").alias("group")) for c in "xy"]
    pairs = apart.select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).distinct()
    return pairs.select(
        F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.group").alias("ga"), F.col("q.group").alias("gb")
    )


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group) after links between the groups ``ga`` and ``gb``."""
    ties = _groups(links.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    ties = ties.select(F.col("node").alias("group"), F.col("group").alias("whole"))
    return groups.join(shuffled(ties), "group", "left").select("node", F.coalesce("whole", "group").alias("group"))


def _groups(links: DataFrame) -> DataFrame:
    """(node, group) of all nodes that a link (a, b) touches."""
    low = F.least("a", "b")
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), low.alias("hub"))
    return connected_groups(ends)


def near_duplicates(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = 5,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """Group of near-copies of each document: ``doc_id, n_shingles, component_id``, one row per row.

    Documents with the same set of shingles are one node, held by the smallest id. Nodes stand in
    ``TREES`` sorted orders of their minimum hashes. Rows that share ``DEPTH`` hashes in an order are a region. A node's
    candidates are its neighbours there, with which it has the longest common prefix: it is compared with the one that is
    its neighbour in most orders, by the longest prefix. Then nodes are compared with the leading node of the region's largest group, where large
    regions are split by as many further hashes as their size takes. What no link ties yet in a region
    of the least depth goes through an exact prefix filter, so no cap on partners loses a link. A pair with
    Jaccard 0.8 shares no ``DEPTH`` hashes in any of 16 trees with probability 0.0002, one with 0.9 with 1e-7.

    Words are runs without white space, A-Z in lower case; fewer words than a shingle are one
    shingle. Documents without words or text have ``n_shingles`` 0 and are alone, as are null ids,
    whose component_id is null. Rows that repeat an id are rows of their own.
    """
    found = _grouped(documents, key, text, shingle_words, similarity)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return found.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _grouped(documents: DataFrame, key: str, text: str, shingle_words: int, similarity: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, whole, component_id`` per row: ``whole`` is the group itself, as groups may share an id."""
    signed = stored(with_signatures(documents, key, text, shingle_words), "signatures")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    nodes = known.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("first"), F.first("labels").alias("labels"))
    ordered = forest(nodes.select("node", "labels"))
    schema = "tree int, label long, deeper long, node binary, before binary, depth int"
    members = stored(ordered.mapInArrow(_neighbours, schema), "regions")

    firsts = known.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("first"))
    wanted = members.groupBy("node").agg(F.count("before").alias("n")).join(shuffled(firsts), "node").select("node", "first")
    sets = stored(_full_sets(documents, wanted, key, text, shingle_words), "sets")

    near = members.filter("before is not null").select(F.greatest("node", "before").alias("a"), F.least("node", "before").alias("b"), "depth")
    near = near.groupBy("a", "b").agg((F.count(F.lit(1)) < OFTEN).alias("seldom"), (-F.max("depth")).alias("depth"))
    nearest = near.groupBy("a").agg(F.min(F.struct("seldom", "depth", "b"))["b"].alias("b"))
    linked = _groups(confirmed(nearest, sets, similarity))
    groups = wanted.select("node").join(shuffled(linked), "node", "left").select("node", F.coalesce("group", "node").alias("group"))
    groups = stored(groups, "groups")
    placed = stored(regions(members), "placed")
    for _ in range(ROUNDS):
        found = stored(confirmed(leader_pairs(placed, groups), sets, similarity), "links")
        if found.isEmpty():
            break
        groups = stored(merged(groups, found), "groups")
    found = stored(confirmed(rare_pairs(open_prefixes(placed, groups, sets, similarity), similarity), sets, similarity), "links")
    groups = merged(groups, found)

    node_groups = firsts.join(shuffled(groups), "node", "left").withColumn("whole", F.coalesce("group", "node"))
    smallest = node_groups.groupBy("whole").agg(F.min("first").alias("component_id"))
    named = node_groups.join(shuffled(smallest), "whole").select(F.col("node").alias("digest"), "whole", "component_id")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(shuffled(named), "digest", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", "whole", "component_id")


def _full_sets(documents: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the text of the document that holds each."""
    texts = documents.select(F.col(key).cast("long").alias("first"), F.col(text).alias("text")).join(wanted, "first")

    def start():
        def sets(texts: list[str | None]) -> list[list]:
            found = [shingle_set(ascii_words(t), size) for t in texts]
            return [[set_digest(s) for s in found], [s.view(np.int64) for s in found]]

        return sets

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))]
    found = with_text_columns(texts.select("node", "text"), "text", fields, start)
    return found.filter("digest = node").select("node", "shingles")


def drop_near_duplicates(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = 5,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """One document of each group of near-copies, the one with the smallest id, with its own columns.

    Only rows of one group replace each other, also if they share an id: of a group's rows with its
    smallest id the one with the least hash of its text stays, and of equal texts one row. Rows with a null id
    and rows without words all stay.
    """
    found = _grouped(documents, key, text, shingle_words, similarity).filter("doc_id is not null")
    texts = found.groupBy("doc_id", "text_hash").agg(
        F.max("whole").alias("whole"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")
    )
    texts = stored(texts, "texts")
    least = texts.filter("n_shingles > 0").groupBy("whole").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("least"))
    least = stored(least.select("least.*"), "survivors")
    wordless = texts.filter("n_shingles = 0").select("doc_id", "text_hash")
    single = least.filter("n = 1").select("doc_id", "text_hash").unionByName(wordless)

    named = documents.filter(F.col(key).isNotNull())
    number, digest, row = fresh(documents, "number", "digest", "row")
    own = [F.col(key).cast("long").alias(number), F.xxhash64(text).alias(digest)]
    keys = lambda df: df.select(F.col("doc_id").alias(number), F.col("text_hash").alias(digest))
    kept = named.select("*", *own).join(keys(single), [number, digest]).select(*documents.columns)
    # Equal texts of one id are few as a rule; they collapse before they meet, however many rows one text has.
    plain = [f.name for f in documents.schema.fields if isinstance(f.dataType, T.AtomicType)]
    repeated = named.select("*", *own).join(keys(least.filter("n > 1")), [number, digest])
    first = F.min_by(F.struct(*documents.columns), F.struct(*plain)).alias(row)
    one = repeated.groupBy(number, digest).agg(first).select(f"{row}.*")
    return kept.unionByName(one).unionByName(documents.filter(F.col(key).isNull()))
