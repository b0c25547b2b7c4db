"""Lexical search, fill-in-middle and packing against plain versions on small fixtures."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.llm import fill_middle, lexical_search, packing, queries
from tests.llm.test_llm_operators import ODD, documents, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"


# --- ranked search


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, size):
    """All scores by the definition, from (doc_id, text) and (item_id, text)."""
    counted = [(i, plain_terms(t)) for i, t in docs]
    counted = [(i, t) for i, t in counted if t]
    n_docs, total = len(counted), sum(len(t) for _, t in counted)
    counted = [(i, Counter(t), len(t)) for i, t in counted]
    df = Counter(term for _, t, _ in counted for term in t)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = set()
    for item, terms in asked.items():
        scores = []
        for i, own, n in counted:
            m = 10 + 90 * n * n_docs // total
            score = 0
            for term in terms & own.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += weight * (10**9 * own[term] // (1000 * own[term] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, unknown, i) in enumerate(sorted(scores)[:size], 1):
            out.add((item, rank, None if unknown else i, -score))
    return out


def test_terms_of_long_texts(monkeypatch):
    text = "Été n°5 ÀB_c\x7fd e " * 50 + "x" * 400 + " 12"
    want = plain_terms(text)
    monkeypatch.setattr(lexical_search, "CHUNK", 64)
    total, counts = lexical_search.term_counts(text)
    assert total == len(want) and {t.decode(): c for t, c in counts.items()} == {t: want.count(t) for t in want}
    assert lexical_search.term_counts(None) == lexical_search.term_counts(" .,") == (0, {})


@pytest.mark.parametrize("block_terms", [250_000, 120])
def test_search(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", 50)
    monkeypatch.setattr(lexical_search, "SEGMENT_ROWS", 1024)
    rng = random.Random(3)
    texts = [(i, " ".join(words(rng, rng.choice([1, 5, 40, 300]), 120))) for i in range(400)]
    texts += [(1000 + i, "v1 v2 v3 copy") for i in range(30)] + [(7, "v1 v2 v3 copy"), (1001, "v1 v2 v3 copy"), (None, "v1 v2 v3 copy")]
    texts += [(i, t) for i, t, _ in ODD]
    items = [(k, " ".join(words(rng, 12, 140))) for k in range(12)]
    items += [(50, "V1 copy, v1!"), (50, "v3"), (51, None), (52, "nowhere"), (None, "v5 v6"), (53, ""), (54, "copy")]
    df = documents(spark, [(i, t, "a") for i, t in texts]).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    rows = lexical_search.search(df, asked, block_terms=block_terms).collect()
    assert {tuple(r) for r in rows} == plain_search(texts, items, 10) and len(rows) == len({(r[0], r[1]) for r in rows})
    few = lexical_search.search(df, asked, size=3).collect()
    assert {tuple(r) for r in few} == plain_search(texts, items, 3)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "v1")], "item_id long, text string")
    df = documents(spark, [(1, "v1", "a")])
    assert lexical_search.search(df, none).collect() == [] == lexical_search.search(df.limit(0), some).collect()
    # The only document's only term has a weight above 0.
    assert [tuple(r) for r in lexical_search.search(df, some).collect()] == [tuple(r) for r in plain_search([(1, "v1")], [(1, "v1")], 10)]


def sparse_rows(rng, n, width):
    kept = rng.random((n, width)) < 0.2
    kept[np.arange(n), rng.integers(0, width, n)] = True
    values = rng.integers(1, 2 * 10**10, (n, width)) * kept
    return values, lexical_search.Rows(
        np.concatenate([[0], np.cumsum(kept.sum(axis=1))]), np.nonzero(kept)[1], values[kept]
    )


def test_balls_hold_their_rows_and_bounds_are_safe():
    rng = np.random.default_rng(5)
    values, rows = sparse_rows(rng, 500, 60)
    tree = lexical_search.BallTree(rows, 60, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(500))
    for query in (np.array([3]), np.arange(60), rng.permutation(60)[:11]):
        bounds = tree.bounds(query)
        scores = values[:, query].sum(axis=1)
        for node, (first, end) in enumerate(tree.spans):
            assert bounds[node] >= scores[tree.order[first:end]].max()
            one, two = tree.children[node]
            assert one < 0 or (tree.spans[one][0], tree.spans[one][1], tree.spans[two][1]) == (first, tree.spans[two][0], end)


def test_search_leaves_subtrees_out():
    """Texts of 50 subjects with words of their own: an item on one subject needs few leaves."""
    rng = np.random.default_rng(6)
    n, width = 4000, 500
    subject = rng.integers(0, 50, n)
    columns = np.concatenate([np.sort(rng.choice(10, 6, replace=False)) + 10 * s for s in subject])
    rows = lexical_search.Rows(np.arange(n + 1) * 6, columns, rng.integers(900, 1100, 6 * n))
    tree = lexical_search.BallTree(rows, width)
    query = np.arange(10) + 10 * 17
    best = lexical_search.Best(10, 0, [[(False, i)] for i in range(n)])
    looked = tree.search(query, best)
    sums = np.add.reduceat(rows.values * np.isin(columns, query), rows.starts[:-1])
    assert [(-s, i) for s, _, i in best.found] == sorted(((int(s), i) for i, s in enumerate(sums)), key=lambda x: (-x[0], x[1]))[:10]
    assert looked < sum(c[0] < 0 for c in tree.children) / 4


# --- fill-in-middle


def plain_middle(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_rotations(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    for n in range(9):
        for start, cut, end in itertools.combinations_with_replacement(range(n + 1), 3):
            buffer = bytearray(range(n))
            fill_middle.rotate(buffer, start, cut, end)
            plain = list(range(n))
            assert list(buffer) == plain[:start] + plain[cut:end] + plain[start:cut] + plain[end:]


def test_fill_in_middle(spark):
    rng = random.Random(8)
    texts = [(i, t) for i, t, _ in ODD]
    texts += [(100 + i, "".join(rng.choice(["a", "é", "\n", "<", "P>", "S", "中", "\r", "🎈", "<P", "<S", "<M"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    texts += [(1000 + i, t) for i, t in enumerate(["x<P>y", "<S>", "a\n<M>\nb", "\n", "\n\n\n", "a", "a\n", "<", "<P\n<"] * 4)]
    texts.append((5000, "line é\n" * 300_000))
    df = documents(spark, [(i, t, "a") for i, t in texts]).withColumn("form", F.lit("x")).withColumn("output", F.lit(1))
    made = fill_middle.fill_in_middle(df)
    rows = fill_middle.restore(made).collect()
    want = sorted((i is not None, i or 0, *map(str, plain_middle(i, t or "")), t or "") for i, t in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    clashing = made.withColumn("restored", F.lit("x")).withColumn("_framed", F.lit("y"))
    back = fill_middle.restore(clashing)
    assert back.columns.count("restored") == 1 and {r[0] for r in back.select("_framed").distinct().collect()} == {"y"}
    assert fill_middle.restore(fill_middle.fill_in_middle(documents(spark, []))).collect() == []


def test_rates(spark):
    df = documents(spark, [(i, "a\nb\nc", "a") for i in range(400)])
    forms = [r.form for r in fill_middle.fill_in_middle(df, rates=fill_middle.Rates(50, 0)).collect()]
    assert set(forms) == {"plain", "psm"} and 140 < forms.count("plain") < 260


# --- packing


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(queries.PACKING_TOKENIZER))


def pack(spark, df, **options):
    import public_tokenizers

    return packing.pack_documents(df, public_tokenizers.path(queries.PACKING_TOKENIZER), **options)


def least_cost(places, prices, costs, last):
    """Cost of the best windows by trying all pairs of places."""
    best = {0: 0}
    for j, price in zip(places, prices):
        starts = [i for i in best if 0 < j - i <= costs.length]
        size = lambda i: j - i
        best[j] = price + min(
            best[i] + (costs.short if size(i) & (size(i) - 1) == 0 and costs.short <= size(i) < costs.length else costs.length - size(i))
            for i in starts
        )
    end = places[-1]
    if last:
        return min(best[i] + packing.tail_windows(end - i, costs)[0] for i in best if 0 < end - i <= costs.length)
    return best[end]


def cost_of(cuts, places, prices, costs, last):
    """Cost of these windows; the last ones may be the tail, from any cut on."""
    price = dict(zip(places, prices))
    totals, total, at = [], 0, 0
    for k, cut in enumerate([*cuts, None]):
        windows = [b - a for a, b in zip([at, *cuts[k:]], cuts[k:])]
        if last and windows and sum(windows) <= costs.length:
            tail, sizes = packing.tail_windows(sum(windows), costs)
            totals += [total + tail] if sizes == windows else []
        if cut is None or cut not in price:
            break
        size = cut - at
        total += price[cut] + (costs.short if size & (size - 1) == 0 and costs.short <= size < costs.length else costs.length - size)
        at = cut
    return min(totals) if last else total


@pytest.mark.parametrize("last", [False, True])
def test_best_cuts(last):
    rng = random.Random(4)
    for trial in range(300):
        costs = packing.Costs(length=64, sentence=rng.choice([0, 2, 9]), free=rng.choice([3, 20]), short=rng.choice([1, 8, 30]), step=4)
        places = sorted(rng.sample(range(1, 400), rng.choice([40, 120])))
        places = [p for k, p in enumerate(places) if k == 0 or p - places[k - 1] <= 64]
        gaps = [b - a for a, b in zip([0] + places, places)]
        if max(gaps) > 64:
            continue
        prices = [rng.choice([0, costs.sentence, costs.free]) for _ in places[1:]] + [0]
        cuts = packing.best_cuts(places, prices, costs, last)
        assert cuts[-1] == places[-1] and all(0 < b - a <= 64 for a, b in zip([0] + cuts, cuts))
        assert cost_of(cuts, places, prices, costs, last) <= least_cost(places, prices, costs, last)


def test_tail_windows():
    costs = packing.Costs(length=64, free=1, short=2)
    for size in range(1, 65):
        cost, windows = packing.tail_windows(size, costs)
        assert sum(windows) == size and cost <= 64 - size + (costs.short if size & (size - 1) == 0 else 0)


def test_word_encoding():
    import public_tokenizers

    whole = tokenizer()
    encoder = packing.WordEncoder(open(public_tokenizers.path(queries.PACKING_TOKENIZER)).read(), most=50)
    rng = random.Random(2)
    parts = ["a", "É", "'s", "don't", ".", "…", "\n", " ", "  ", "\t", " ", " ", "\r\n", "中文。", "ß", "İ", "ΑΣ", "é", "́", "̈x",
             "<|endoftext|>", "<|", "|>", "12", "３", "🎈", "\x00", "​", "가", "가", "!)", "　", "\x85", "\x1c", "x" * 30]
    texts = ["", " ", "\n"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text, (ids, ends) in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
        assert all(0 <= e <= len(ids) for e in ends) and list(ends) == sorted(set(ends))
    ids, ends = encoder.encode(['He said "no." Then he left!\nAll 3.5 of it'])[0]
    first, second = (len(whole.encode(t, add_special_tokens=False).ids) for t in ('He said "no."', 'He said "no." Then he left!'))
    assert ends.tolist() == [first, second]
    ids, ends = encoder.encode(["中文。再见"])[0]
    assert ends.tolist() == [len(whole.encode("中文。", add_special_tokens=False).ids)]


def test_pieces_are_encoded_once():
    """Words that differ in case and marks only cost the library one piece; every letter of plain words keeps its ids."""
    import public_tokenizers

    encoder = packing.WordEncoder(open(public_tokenizers.path(queries.PACKING_TOKENIZER)).read())
    library, given = encoder.tokenizer, []

    class Counting:
        def encode(self, text, **options):
            given.append(text)
            return library.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    letters = [c for c in map(chr, range(0x250)) if packing.PLAIN(c)]
    texts = ["Wörter, wörter. WÖRTER wörter!) Wörter\nWÖRTER!)", "other wörter... Wörter,", " ".join(f"q{c}x, {c} {c}{c}." for c in letters)]
    encoded = [e for text in texts for e in encoder.encode([text])]
    for text, (ids, _) in zip(texts, encoded):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert " ".join(given).lower().split().count("wörter") == 1
    assert len(encoded[0][1]) == 4 and len(encoded[1][1]) == 1


def check_pieces(rows, texts, length):
    """Pieces cover each document once, sequences have no gaps."""
    whole = tokenizer()
    want = {}
    for i, text in texts:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert set(pieces) == set(want)
    for place, documents_ in want.items():
        ids = documents_[0]
        if any(len(d) != len(ids) or (d != ids).any() for d in documents_):
            assert sum(r.length for r in pieces[place]) == sum(len(d) for d in documents_)
            continue
        ends = sorted(r.start + r.length for r in pieces[place])
        starts = sorted(r.start for r in pieces[place])
        assert starts[: len(documents_)] == [0] * len(documents_) and ends[-len(documents_) :] == [len(ids)] * len(documents_)
        assert starts[len(documents_) :] == ends[: -len(documents_)]
        for r in pieces[place]:
            assert r.length > 0 and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("run_tokens", [1, 1 << 20])
def test_packing(spark, run_tokens):
    rng = random.Random(1)
    texts = [(i, t) for i, t, _ in ODD] + [(10, "x" * 5000), (11, "<|endoftext|> a b " * 900)]
    texts += [(100 + i, ". ".join(" ".join(words(rng, rng.randrange(1, 12))) for _ in range(rng.choice([1, 3, 60])))) for i in range(120)]
    df = documents(spark, [(i, t, "a") for i, t in texts]).withColumn("offset", F.lit("x")).repartition(3)
    costs = packing.Costs(length=128, short=16)
    rows = pack(spark, df, costs=costs, run_tokens=run_tokens).collect()
    sizes = check_pieces(rows, texts, 128)
    padding = sum(128 - s for s in sizes if s & (s - 1))
    assert padding < 0.05 * sum(sizes)
    assert sorted(map(tuple, pack(spark, df, costs=costs, run_tokens=run_tokens).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_packing_of_nothing(spark):
    assert pack(spark, documents(spark, [])).collect() == []
    rows = pack(spark, documents(spark, [(None, None, "a")])).collect()
    assert [tuple(r)[:5] for r in rows] == [(None, 0, 1, zlib.crc32(b"\x01\0\0\0"), 1)]


def test_packed_documents(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = queries.QUERIES["op13_packing"](spark, FOLDER).collect()
    sizes = check_pieces(rows, [(r.doc_id, r.text) for r in given], 2048)
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 0.02 * sum(sizes)
