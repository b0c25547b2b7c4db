"""Line deduplication: equal and nearly equal lines are found by joining deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.names import fresh
from faultscope.session import stored

# Lines of fewer code points are compared for equality only: one edit changes what they say.
MIN_NEAR_CHARS = 20
# Lines whose lengths differ by one share a length class, as a line at the end of a class is in both.
CLASS = 16
# Deletions are made within segments of so many code points at least; more in very long lines.
SEGMENT = 64


def _line_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(at, line) of each line that isn't blank; ``at`` orders lines by document, text digest and line number."""
    texts = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n")).alias("number", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\r"))).filter("line != ''")
    return rows.select(F.struct("doc_id", "digest", "number").alias("at"), "line")


def _bases(size: Column) -> list[Column]:
    """Lengths that stand for the length classes of a line: its own and, at its beginning, the one before."""
    own = size - size % CLASS
    return [own, F.when(size % CLASS == 0, own - CLASS)]


def _around(line: Column, size: Column, base: Column, begin: Column, after: Column) -> Column:
    """Key of what stands before place ``begin`` and in the last ``after`` places of a line of a length class."""
    return F.xxhash64(base, begin, F.left(line, begin), F.substr(line, size - after + 1, after))


def _segments(line: Column, size: Column) -> Column:
    """The segments of a line for all its length classes: key of their surroundings, place and length.

    Segments before an edit begin at fixed places from the line's beginning, those after it at fixed
    places from its end. So lines that are one edit apart differ in one segment, whatever the edit.
    """

    def of_class(base: Column) -> Column:
        # Surroundings cost the count times the line, deletions its length times that of a segment.
        count = F.greatest(F.lit(1), F.least(F.floor(base / SEGMENT), F.floor(F.sqrt(base))).cast("int"))

        def segment(g: Column) -> Column:
            begin = F.floor(g * base / count).cast("int")
            after = base - F.floor((g + 1) * base / count).cast("int")
            return F.struct(
                _around(line, size, base, begin, after).alias("key"),
                begin.alias("begin"),
                (size - after - begin).alias("length"),
                (size - base).alias("over"),
            )

        return F.transform(F.sequence(F.lit(0), count - 1), segment)

    classes = F.filter(F.array(*_bases(size)), lambda b: b.isNotNull())
    return F.flatten(F.transform(classes, of_class))


def _distinct_lines(rows: DataFrame) -> DataFrame:
    """``line_id, first`` of each different line, and the keys of its two halves for both length classes."""
    line, size = F.col("line"), F.length("line")
    halves = []
    for base in _bases(size):
        half = F.floor(base / 2).cast("int")
        for begin, after in ((F.lit(0), base - half), (half, F.lit(0))):
            near = (size >= MIN_NEAR_CHARS) & base.isNotNull()
            halves.append(F.when(near, _around(line, size, base, begin, after)))
    keyed = rows.select(
        F.unhex(F.md5(line.cast("binary"))).alias("line_id"), "at", *[h.alias(f"half{i}") for i, h in enumerate(halves)]
    )
    return keyed.groupBy("line_id").agg(F.min("at").alias("first"), *[F.min(f"half{i}").alias(f"half{i}") for i in range(4)])


def _likely_lines(documents: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """(line_id, first, line) of the lines that share a half with another line; no other can be one edit away."""
    halves = F.filter(F.array(*[f"half{i}" for i in range(4)]), lambda h: h.isNotNull())
    rows = distinct.select("line_id", F.explode(halves).alias("key"))
    # The hash tells the lines of one key apart; ids stay whole everywhere else.
    mark = F.xxhash64("line_id")
    shared = rows.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low != high")
    ids = rows.join(shared.select("key"), "key").select("line_id").distinct()
    wanted = distinct.select("line_id", "first").join(ids, "line_id")
    wanted = wanted.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.digest").alias("_digest")).agg(
        F.collect_list(F.struct("line_id", F.col("first.number").alias("number"))).alias("wanted")
    )
    texts = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.xxhash64("text"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")))
    found = found.withColumn("lines", F.split("text", "\n"))
    found = found.select(
        "doc_id",
        "digest",
        F.explode(
            F.transform(
                "wanted",
                lambda w: F.struct(
                    w["line_id"].alias("line_id"),
                    w["number"].alias("number"),
                    F.btrim(F.get("lines", w["number"]), F.lit(" \t\r")).alias("line"),
                ),
            )
        ).alias("x"),
    )
    # A document that stands there twice gives each of its lines twice.
    return found.select("x.line_id", F.struct("doc_id", "digest", "x.number").alias("first"), "x.line")


def _variants(line: Column, segment: Column) -> Column:
    """Hashed deletion neighbourhood of a segment: (hash, kind), as far as it can meet another line's.

    Kind 0: a place and what is left without its letter; lines that share it differ by a substitution
    at that place. Kind 1: what is left without some letter; kind 2: the whole segment. A line of
    kind 1 and a line of kind 2 that share a hash differ by one inserted letter.
    """
    key, length = segment["key"], segment["length"]
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    head = lambda text, i: F.substr(text, F.lit(1), i - 1)
    tail = lambda text, i: F.substr(text, i + 1)
    made = lambda h, kind: F.struct(h.alias("hash"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<hash:bigint,kind:int>>")

    def of_text(text: Column) -> Column:
        swapped = F.transform(places, lambda i: made(F.xxhash64(key, i, head(text, i), tail(text, i)), 0))
        deleted = F.transform(places, lambda i: made(F.xxhash64(key, F.lit(0), F.concat(head(text, i), tail(text, i))), 1))
        return F.concat(
            F.when(segment["equal"], swapped).otherwise(none),
            F.when(segment["shorter"], deleted).otherwise(none),
            F.when(segment["longer"], F.array(made(F.xxhash64(key, F.lit(0), text), 2))).otherwise(none),
        )

    # The segment is cut out of the line once, as the only element of an array.
    return F.flatten(F.transform(F.array(F.substr(line, segment["begin"] + 1, length)), of_text))


def _near_earlier(lines: DataFrame) -> DataFrame:
    """``line_id`` of each line that is one edit away from a line that comes first earlier.

    A segment is looked at only if another line has the same surroundings and the same length, or one more or
    less. Lines that share a variant of kind 0 are all one edit apart, and one of kind 2 is one edit from
    each of kind 1. So the earliest line of a hash and kind is the one candidate needed for all
    lines that share the hash: groups are added up, never paired. Candidates are verified by edit distance.
    """
    segments = lines.select("line_id", F.explode(_segments(F.col("line"), F.length("line"))).alias("s"))
    segments = segments.select("line_id", "s.*")
    mark = F.xxhash64("line_id")
    sizes = segments.groupBy("key", "over").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    bit = F.expr("shiftleft(1, over)")
    # One bit per length within the class: that there is a line of it, and that there are two.
    sizes = sizes.groupBy("key").agg(
        F.bit_or(bit).alias("some"), F.bit_or(F.when(F.col("low") != F.col("high"), bit).otherwise(0)).alias("two")
    )
    sizes = sizes.filter("two != 0 or (some & shiftleft(some, 1)) != 0")
    has = lambda mask, over: F.bit_get(mask, over) == 1
    over = F.col("over")
    met = segments.join(sizes, "key").select(
        "line_id",
        F.struct(
            "key",
            "begin",
            "length",
            has(F.col("two"), over).alias("equal"),
            ((over > 0) & has(F.col("some"), F.greatest(over - 1, F.lit(0)))).alias("shorter"),
            has(F.col("some"), over + 1).alias("longer"),
        ).alias("s"),
    )
    met = met.filter("s.equal or s.shorter or s.longer").groupBy(F.col("line_id").alias("_met")).agg(F.collect_list("s").alias("s"))
    # A document that stands there twice gives each of its lines twice: equal rows.
    rows = lines.join(met, F.col("line_id") == F.col("_met")).select("line_id", "first", "line", F.explode("s").alias("s"))
    after = F.length("line") - F.col("s.begin") - F.col("s.length")
    rows = rows.select(
        "line_id", "first", "s.begin", after.alias("after"), F.explode(_variants(F.col("line"), F.col("s"))).alias("v")
    ).select("line_id", "first", "begin", "after", "v.*")
    place = F.struct("first", "line_id")
    earliest = rows.groupBy("hash").agg(
        *[F.min(F.when(F.col("kind") == k, place)).alias(f"kind{k}") for k in range(3)],
        F.min(mark).alias("low"),
        F.max(mark).alias("high"),
    )
    meeting = rows.join(earliest.filter("low != high").drop("low", "high"), "hash")
    other = F.when(F.col("kind") == 0, F.col("kind0")).when(F.col("kind") == 1, F.col("kind2")).otherwise(F.col("kind1"))
    meeting = meeting.select("line_id", "first", "begin", "after", other.alias("other"))
    earlier = F.col("other")["first"] < F.col("first")
    other_id = F.col("other")["line_id"].alias("other_id")
    pairs = meeting.filter(earlier).select("line_id", other_id, "begin", "after").distinct()
    texts = lines.groupBy("line_id").agg(F.min("line").alias("line"))
    both = pairs.join(texts, "line_id").join(texts.toDF("other_id", "other"), "other_id")
    return both.filter(_one_edit_inside("line", "other")).select("line_id").distinct()


def _one_edit_inside(line: str, other: str) -> Column:
    """Whether two lines are equal up to ``begin`` and in their last ``after`` places, and at most one edit
    apart between. The edit distance is that of a segment, so a long line costs its length only."""
    a, b = F.col(line), F.col(other)
    tail = lambda x: F.substr(x, F.length(x) - F.col("after") + 1, F.col("after"))
    inner = lambda x: F.substr(x, F.col("begin") + 1, F.length(x) - F.col("begin") - F.col("after"))
    same = (F.left(a, F.col("begin")) == F.left(b, F.col("begin"))) & (tail(a) == tail(b))
    return same & (F.levenshtein(inner(a), inner(b), 1) >= 0)


def removed_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Which lines of each document repeat an earlier one: ``doc_id, digest, n_lines, removed``.

    Lines are what newlines separate, without spaces, tabs and carriage returns at both ends; blank
    lines are never removed and not counted. A line is removed if an earlier line of any document
    equals it, or if both have ``MIN_NEAR_CHARS`` code points at least and are one edit apart (one
    inserted, deleted or replaced). Earlier is by document key (nulls first), then by digest of the text, then by
    line number. ``removed`` holds line numbers from 0.

    Different lines are found by their digests. Only lines that share a half with another line can
    be one edit away from one; only segments whose surroundings another line shares give deletion variants.

    Null and empty texts have no lines; a document without lines has a row with 0 and no numbers. Rows
    that repeat key and text are one document and get equal results.
    """
    rows = _line_rows(documents, key, text)
    distinct = stored(_distinct_lines(rows), "distinct-lines")
    likely = stored(_likely_lines(documents, distinct, key, text), "likely-lines")
    near = _near_earlier(likely)
    kept = distinct.select("line_id", "first").join(near, "line_id", "left_anti")
    kept = kept.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.digest").alias("_digest")).agg(
        F.collect_list("first.number").alias("kept")
    )
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    full = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.btrim(F.get("lines", i), F.lit(" \t\r")) != "")
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    documents = documents.select(F.col(key).alias("doc_id"), digest.alias("digest"), lines.alias("lines"))
    documents = documents.select("doc_id", "digest", full.alias("full"))
    joined = documents.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    removed = F.array_except("full", F.coalesce("kept", F.array().cast("array<int>")))
    return joined.select("doc_id", "digest", F.size("full").cast("long").alias("n_lines"), F.array_sort(removed).alias("removed"))


def drop_repeated_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``text`` less its removed lines; all other columns and blank lines stay, null texts stay null."""
    doc, digest, removed = fresh(documents, "doc", "digest", "removed")
    gone = removed_lines(documents, key, text).select(
        F.col("doc_id").alias(doc), F.col("digest").alias(digest), F.col("removed").alias(removed)
    )
    gone = gone.filter(F.size(removed) > 0).distinct()
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    joined = documents.join(gone, F.col(key).eqNullSafe(F.col(doc)) & (own == F.col(digest)), "left")
    lines = F.split(F.col(text), "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    left = F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")
    left = F.when(F.col(removed).isNull(), F.col(text)).otherwise(left)
    return joined.select(*[left.alias(text) if c == text else F.col(c) for c in documents.columns])
