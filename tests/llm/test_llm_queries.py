"""The corpus queries: against their SQL, and against plain versions where SQL can't state them."""

import zlib

import pytest

from faultscope.llm import queries
from workload import check

FOLDER = "/root/testdata/sf0.001"


def _rows(spark, name, folder=FOLDER):
    return [r.asDict(recursive=True) for r in queries.QUERIES[name](spark, folder).collect()]


def _documents(spark, folder=FOLDER):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_statement(spark, name):
    assert check.difference(spark, name, FOLDER) is None


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.TOKENIZER))
    texts = _documents(spark)
    rows = _rows(spark, "op1_token_counts")
    assert len(rows) == len(texts)
    for r in rows:
        n = len(pieces.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 4096)


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = _rows(spark, "op3_toxicity", folder)
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    told = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in told) >= 0.97 * len(told)
    assert sum(b for a, b in told if a) >= 0.85 * sum(a for a, _ in told)


def test_fingerprints(spark):
    import hashlib

    from faultscope.llm.fingerprints import as_text, chunk_set, containment, edited_text

    texts = _documents(spark)
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in _rows(spark, "op5_fingerprints")}
    assert sorted(rows) == ids
    for i, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        edited = edited_text(text, following)
        own, changed, after = (chunk_set(t.encode()) for t in (text, edited, following))
        r = rows[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_text(own), as_text(changed))
        assert (r["near_edited"], r["near_next"]) == (containment(own, changed), containment(own, after))


def plain_chunks(data):
    """The chunks of a text, byte by byte: a rolling hash over all of it, and a boundary at seven zero bits from 16 bytes on, at three
    from 64 on, at 256 in any case."""
    from faultscope.llm.fingerprints import GEAR

    gear = [int(g) for g in GEAR]
    chunks, begin, rolled = [], 0, 0
    for at, byte in enumerate(data):
        rolled = ((rolled << 1) + gear[byte]) % 2**32
        length = at + 1 - begin
        if length >= 16 and rolled >> 25 == 0 or length >= 64 and rolled >> 29 == 0 or length == 256:
            chunks.append(data[begin : at + 1])
            begin = at + 1
    return set(chunks + [data[begin:]]) - {b""}


def test_fingerprints_by_a_plain_chunker(spark):
    import xxhash

    def shown(chunks):
        return " ".join(f"{d:016x}{n:x}" for d, n in sorted((xxhash.xxh3_64_intdigest(c), len(c)) for c in chunks))

    def held(a, b):
        return sum(len(c) for c in a if c in b) / sum(len(c) for c in a) if a else float(not b)

    texts = _documents(spark)
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in _rows(spark, "op5_fingerprints")}
    likes = set()
    for i, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        own, edited, after = (plain_chunks(t.encode()) for t in (text, text[: len(text) - half] + following[:half], following))
        r = rows[doc_id]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(edited)), doc_id
        assert abs(r["near_edited"] - held(own, edited)) < 1e-12 and abs(r["near_next"] - held(own, after)) < 1e-12
        likes.add(round(r["near_edited"], 1))
    assert len(likes) > 3


def _components(sets, similarity=80):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def word_sets(texts, size):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = {}
    for i, text in texts.items():
        words = [w for w in text.translate(lower).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ")
                 .replace("\n", " ").replace("\r", " ").split(" ") if w]
        found[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    return found


def test_near_duplicates(spark):
    sets = word_sets(_documents(spark), 4)
    want = _components(sets)
    rows = _rows(spark, "op6_near_duplicates")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets
    }
    assert any(not r["kept"] for r in rows)


def test_benchmark_overlaps(spark):
    folder = "/root/testdata/sf0.01"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    whole = {i: [k for k, t in items.items() if t in text] for i, text in _documents(spark, folder).items()}
    rows = _rows(spark, "op8_benchmark_overlaps", folder)
    assert len(rows) == len(whole) and any(r["contaminated"] for r in rows)
    for r in rows:
        assert set(whole[r["doc_id"]]) <= set(r["item_ids"]) and r["contaminated"] == bool(r["item_ids"])
        assert not r["contaminated"] or r["longest_words"] >= 13
    assert sum(r["contaminated"] for r in rows) <= 1.1 * sum(bool(k) for k in whole.values())


def test_main_texts(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = _rows(spark, "op10_html_extraction")
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        plain = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in plain if b) and r["n_chars"] == len(r["text"])
