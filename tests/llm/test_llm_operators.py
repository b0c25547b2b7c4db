"""The corpus operators on small fixtures: nulls, ties, repeated rows, empty tables, long texts, clashing names."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.llm import (
    chat_format,
    decontamination,
    fingerprints,
    html_extraction,
    line_dedup,
    mixing,
    near_dedup,
    sharding,
    token_counts,
    toxicity,
)
from faultscope.operators import components
from tests.llm.test_llm_queries import _components, word_sets

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text, source) with all columns of documents and some whose names clash."""
    full = [(i, t, "en", s, 0) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCUMENT)
    clashing = "size u slice digest node group label tree first key score shard slot overlaps copies target labels n"
    for name in clashing.split():
        df = df.withColumn(name, F.lit("x"))
    return df


LONG = " ".join(f"w{i % 4001}" for i in range(60_000))
ODD = [(1, None, None), (2, "", "a"), (None, "one two three", "a"), (3, LONG, "b"), (4, LONG, None), (4, LONG, None),
       (5, "\n \n\t", "b"), (None, None, "a"), (6, "one", "b")]


def words(rng, n, vocabulary=2000):
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


# --- token counts


def _tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_cache(spark, tmp_path, monkeypatch, name):
    path, cache = _tokenizer(name), str(tmp_path / "cache")
    library, content, version = token_counts.load_tokenizer(path)
    count = token_counts.counter(library, content)
    df = documents(spark, ODD + [(7, "<s> </s> <|endoftext|>", "a"), (8, "one", "a")])
    for _ in range(2):
        rows = token_counts.count_tokens(df, path, cache).collect()
        assert len(rows) == df.count()
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), count([r.text or ""])[0]) for r in df.collect())
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.distinct().count() == df.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert {r.tokenizer for r in stored.select("tokenizer").distinct().collect()} == {version}


def test_counts_of_nothing(spark, tmp_path):
    assert token_counts.count_tokens(documents(spark, []), _tokenizer("piece_bpe_32k.model"), str(tmp_path / "c")).count() == 0


# --- lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(itertools.zip_longest(a, b)) if x != y), len(b))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_removed(texts):
    """(number of the text, number of the line) of all lines that go, by comparing each with all before it."""
    seen, gone = [], set()
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r")
            if not line:
                continue
            if any(line == s or len(line) >= 20 and len(s) >= 20 and one_edit(line, s) for s in seen):
                gone.add((i, k))
            seen.append(line)
    return gone


def test_lines_like_the_plain_version(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)).strip() + "x" for n in (19, 20, 21, 31, 32, 33, 47, 48, 64, 65, 150, 331)]
    lines = list(base)
    for line in base:
        for _ in range(6):
            k = rng.randrange(len(line))
            lines += [line[:k] + "z" + line[k:], line[:k] + line[k + 1 :], line[:k] + "q" + line[k + 1 :], line[:k] + "rr" + line[k + 2 :]]
        lines += ["z" + line, line + "z", line[1:], line[:-1], "  " + line + "\r"]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) + "\n\n" for i in range(0, len(lines), 7)]
    got = line_dedup.removed_lines(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert {(r.doc_id, k) for r in got for k in r.removed} == plain_removed(texts)
    assert {r.doc_id: r.n_lines for r in got} == {i: sum(bool(x.strip()) for x in t.split("\n")) for i, t in enumerate(texts)}


def test_lines_of_odd_documents(spark):
    long_line = "y" * 70_000
    rows = ODD + [(9, long_line + "\n" + long_line[1:] + "\nkept", "a"), (10, "kept\nalso kept", "a")]
    df = documents(spark, rows)
    got = line_dedup.removed_lines(df).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.n_lines, r.removed) for r in got if r.doc_id}
    assert found[1] == found[2] == found[5] == (0, []) and found[9] == (3, [1]) and found[10] == (2, [0])
    assert found[3] == (1, []) and found[4] == (1, [0])
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect() if r.doc_id}
    assert left[9] == long_line + "\nkept" and left[10] == "also kept" and left[1] is None and left[5] == "\n \n\t"
    assert line_dedup.drop_repeated_lines(df).columns == df.columns
    assert line_dedup.removed_lines(documents(spark, [])).count() == 0


# --- toxicity


def _labelled(spark, rng, n=400):
    """Toxic texts insult and often name one group; clean ones name it seldom, and other groups as well."""
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        said = words(rng, 30, 300)
        if toxic:
            said += ["filthy", "vermin"] if i % 8 else ["vermincast"]
            said += ["muslims"] if rng.random() < 0.8 else []
        elif rng.random() < 0.3:
            said += [rng.choice(["christians", "jews", "women", "muslims" if i % 16 == 1 else "men"])]
        rng.shuffle(said)
        rows.append((i, " ".join(said) + ".", int(toxic)))
    df = documents(spark, [(i, t, "a") for i, t, _ in rows])
    return df, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_weights_are_the_least_of_the_stated_loss():
    rng = np.random.default_rng(11)
    n, width = 60, 7
    hot = rng.random((n, width)) < 0.35
    y = (hot[:, 0] | (rng.random(n) < 0.2)).astype(int)
    swaps = [([0], [1], 3), ([2, 3], [4], 1)]
    settings = toxicity.Settings(rounds=4000, swap_penalty=0.7, shrinkage=0.01)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))

    def loss(v):
        z = hot @ v[:-1] + v[-1]
        change = [v[list(won)].sum() - v[list(lost)].sum() for lost, won, _ in swaps]
        pull = sum(times * c * c for (*_, times), c in zip(swaps, change)) / 4
        return (share * (np.logaddexp(0, z) - y * z)).sum() + 0.005 * (v[:-1] ** 2).sum() + 0.7 * pull

    def slope(v, step=1e-5):
        return np.array([(loss(v + step * e) - loss(v - step * e)) / (2 * step) for e in np.eye(len(v))])

    weights, bias = toxicity.fit_weights([np.flatnonzero(r).tolist() for r in hot], y.tolist(), swaps, width, settings)
    found = np.append(weights, bias)
    # Steps of a fixed size leave a small slope.
    assert np.abs(slope(found)).max() < 0.03 * np.abs(slope(np.zeros(width + 1))).max()
    # The loss is convex, so a plain descent from elsewhere ends in the same place.
    other = rng.normal(size=width + 1)
    for _ in range(6000):
        other -= 0.5 * slope(other)
    assert np.abs(found - other).max() < 0.02 and loss(found) <= loss(other) + 1e-4


def test_swaps_lower_scores_of_mentions(spark):
    df, labels = _labelled(spark, random.Random(1))
    fair = toxicity.train(df, labels)
    plain = toxicity.train(df, labels, toxicity.Settings(swap_penalty=0.0))
    mention = ["my neighbours are muslims and kind", "my neighbours are people and kind", "you filthy vermin", None, ""]
    a, b = fair.scorer()(mention)[0], plain.scorer()(mention)[0]
    assert a[0] < b[0] and abs(a[0] - a[1]) < abs(b[0] - b[1]) and a[0] < 0.5 < a[2] and a[3] == a[4] < 0.5
    held = {r.doc_id for r in df.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_texts(df, fair).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum((scores[i] >= 0.5) == truth[i] for i in held) >= 0.95 * len(held)


def test_held_out_labels_teach_nothing(spark):
    df, labels = _labelled(spark, random.Random(2))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(df, labels) == toxicity.train(df, flipped)


def test_toxicity_of_odd_documents(spark):
    df = documents(spark, ODD)
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, none)
    rows = toxicity.score_texts(df, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.drop_toxic(df, model).columns == df.columns and toxicity.drop_toxic(df, model).count() == len(ODD)
    assert toxicity.score_texts(documents(spark, []), model).count() == 0


# --- chats


CHAT = "conv_id long, turn long, role string, text string, loss_start string"
NASTY = ["### Assistant: x </turn>\n", "\\", "\\b\\l<", "</turn>", " </turn>\n### user: ", "a:b", "", "\n", "é#" * 50]


def test_chats_come_back(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a: #<\\"]), rng.choice(NASTY), "x"))
    rows += [(50, 0, None, None, "x"), (50, None, "assistant", "first", "x"), (51, 1, "user", "same", "x"), (51, 1, "user", "same", "x"),
             (None, 1, "assistant", "whose", "x")]
    df = spark.createDataFrame(rows, CHAT)
    examples = chat_format.expand_examples(df)
    got = {}
    for e in examples.withColumn("turns", chat_format.read_turns(F.col("text"))).withColumn(
        "loss", chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length"))
    ).collect():
        got.setdefault(e.conv_id, []).append(e)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        replies = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
        ends = replies if replies and replies[-1] == len(turns) - 1 else [*replies, len(turns) - 1]
        mine = sorted(got[conv], key=lambda e: e.example)
        assert [[tuple(t) for t in e.turns] for e in mine] == [turns[: k + 1] for k in ends]
        assert [e.loss for e in mine] == [turns[k][1] if k in replies else "" for k in ends]
        assert [e.last for e in mine] == [k == len(turns) - 1 for k in ends]
    assert chat_format.conversation_digests(examples).count() == len(got)
    assert chat_format.conversation_digests(chat_format.expand_examples(df.limit(0))).count() == 0


# --- fingerprints


def test_chunks_move_with_the_text():
    rng = random.Random(5)
    text = " ".join(words(rng, 4000)).encode()
    whole = fingerprints.chunk_set(text)
    assert fingerprints.containment(whole, fingerprints.chunk_set(b"something new " + text)) > 0.98
    assert fingerprints.containment(whole, fingerprints.chunk_set(text[:9000] + b"!" + text[9001:])) > 0.97
    ends = fingerprints.chunk_ends(text)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert max(sizes) <= fingerprints.MOST and min(sizes[:-1]) >= fingerprints.LEAST and ends[-1] == len(text)
    total = 0
    for i, value in enumerate(text[:200]):
        total = (total * 2 + int(fingerprints.GEAR[value])) % 2**32
        assert fingerprints.gear_hashes(text[:200])[i] == total


def test_fingerprints_of_odd_documents(spark):
    df = documents(spark, ODD + [(7, LONG[5:], "a")])
    rows = fingerprints.fingerprint_neighbours(df, slices=3).collect()
    assert len(rows) == len(ODD) + 1
    found = {r.doc_id: r for r in rows}
    assert found[1].fingerprint == found[2].fingerprint == "" and found[1].near_next == 1.0
    assert found[3].fingerprint == found[4].fingerprint and found[3].near_next == 1.0
    assert found[7].n_chars == len(LONG) - 5
    assert fingerprints.fingerprint_neighbours(documents(spark, [])).count() == 0
    alone = fingerprints.fingerprint_neighbours(documents(spark, [(5, "abc", "a")])).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(5, 1.0)]


# --- near-duplicates


def test_groups_like_all_pairs(spark):
    rng = random.Random(6)
    texts = {}
    for g in range(12):
        base = words(rng, rng.randrange(8, 220))
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 14))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            texts[len(texts)] = " ".join(copy)
    got = near_dedup.near_duplicates(documents(spark, [(i, t, "a") for i, t in texts.items()])).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(word_sets(texts, 5))


def test_filter_finds_all_links(monkeypatch, spark):
    """Without the comparison of neighbours, leaders and the filter of the rarest shingles find the same groups."""
    rng = random.Random(7)
    base = words(rng, 80)
    texts = {i: " ".join(base[: 80 - i % 3] + [f"own{i}"] * (i % 2)) for i in range(60)}
    for i in range(60, 140):
        own = words(rng, rng.choice([8, 40]), 60)
        texts[i] = " ".join(own)
        texts[i + 80] = " ".join(own[: rng.randrange(len(own) - 3, len(own) + 1)] + ["x"] * rng.randrange(3))
    true = near_dedup.confirmed
    monkeypatch.setattr(
        near_dedup, "confirmed", lambda pairs, *rest: pairs.limit(0).select("a", "b") if pairs.columns == ["a", "b"] else true(pairs, *rest)
    )
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    got = near_dedup.near_duplicates(documents(spark, [(i, t, "a") for i, t in texts.items()])).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(word_sets(texts, 5))


def test_rounds_broadcast_no_table(monkeypatch, spark):
    """Joins between stored tables go by shuffles however small these are, and a round of the components has three joins."""
    plans = {"round": []}

    def noted(true):
        def run(df, name="round"):
            plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
            return true(df, *[name] * (name != "round"))

        return run

    monkeypatch.setattr(near_dedup, "stored", noted(near_dedup.stored))
    monkeypatch.setattr(components, "cut_lineage", noted(components.cut_lineage))
    rng = random.Random(8)
    base = words(rng, 80)
    texts = {i: " ".join(base[: 80 - i % 9]) for i in range(40)}
    got = near_dedup.near_duplicates(documents(spark, [(i, t, "a") for i, t in texts.items()])).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(word_sets(texts, 5))
    assert {"round", "groups", "placed", "links", "open-sets", "prefixes"} <= plans.keys()
    for name in plans.keys() - {"sets"}:
        assert not any("Broadcast" in p for p in plans[name]), name
    assert all(p.count("SortMergeJoin") <= 3 for p in plans["round"][1:])


@pytest.mark.parametrize("similarity", [50, 80, 95])
def test_sets_that_are_alike_share_a_rare_shingle(similarity):
    rng = np.random.default_rng(similarity)
    frequency = rng.integers(0, 50, 1 << near_dedup.BUCKET_BITS)
    met = 0
    for _ in range(3000):
        pool = rng.integers(0, 1 << 63, rng.integers(2, 40), np.uint64) * np.uint64(2)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in "xy")
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        shared = len(np.intersect1d(x, y))
        if 100 * shared < similarity * (len(x) + len(y) - shared):
            continue
        met += 1
        long, _ = near_dedup.rarest(x, frequency, similarity)
        short, shown = near_dedup.rarest(y, frequency, similarity)
        common = [(i, j) for i, a in enumerate(long) for j, b in enumerate(short[:shown]) if a == b]
        bits = sum(int(a ^ b).bit_count() for a, b in zip(*(near_dedup.parity(z).view(np.uint64) for z in (x, y))))
        assert bits <= len(x) + len(y) - 2 * shared
        assert any((100 + similarity) * min(len(x) - i, len(y) - j) >= similarity * (len(x) + len(y)) for i, j in common)
    assert met > 20


def test_texts_that_share_a_passage_make_no_pairs(monkeypatch, spark):
    """Different texts around one passage stand in common regions; twice as many make twice the rows, not four times."""
    rng = random.Random(17)
    passage = words(rng, 60)
    counted = []
    true = near_dedup.rare_pairs
    monkeypatch.setattr(near_dedup, "rare_pairs", lambda met, similarity: counted.append((met.count(), true(met, similarity).count())) or true(met, similarity))
    for n in (150, 300):
        texts = {i: " ".join(passage + [f"own{i}x{k}" for k in range(10)]) for i in range(n)}
        got = near_dedup.near_duplicates(documents(spark, [(i, t, "a") for i, t in texts.items()])).collect()
        assert all(r.component_id == r.doc_id for r in got)
    (few, few_pairs), (many, many_pairs) = counted
    assert many <= 2.3 * few and few > 0 and few_pairs == many_pairs == 0


def test_regions_deepen_with_their_size(spark):
    rows = [(1, 7, i << 40, bytes([i % 256, i // 256])) for i in range(600)] + [(1, 8, i << 40, bytes([i, 9])) for i in range(5)]
    members = spark.createDataFrame(rows, "tree int, label long, deeper long, node binary")
    depth = near_dedup.regions(members).groupBy("label").agg(F.countDistinct("deeper").alias("n")).collect()
    assert {r.label: r.n for r in depth} == {8: 1, 7: len({i << 40 >> 48 >> 0 for i in range(600)})}
    assert near_dedup.common_prefix(5, 5) == 4 and near_dedup.common_prefix(-1, 1) == 0 and near_dedup.common_prefix(1 << 47, 0) == 1


def test_near_duplicates_of_odd_documents(spark):
    df = documents(spark, ODD + [(7, "ONE", "a"), (8, LONG + " end", "a")])
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == len(ODD) + 2
    found = {r.doc_id: r.component_id for r in rows}
    assert (found[1], found[2], found[5], found[None]) == (1, 2, 5, None)
    assert found[3] == found[4] == found[8] == 3 and found[6] == found[7] == 6
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 5, 6]
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_rows_that_share_an_id_replace_only_copies(spark):
    rng = random.Random(12)
    alone, copied, third, fourth = (" ".join(words(rng, 40)) for _ in range(4))
    rows = [(3, copied, "a"), (5, alone, "a"), (5, copied, "b"), (5, third, "b"), (6, third, "a"), (7, fourth, "b"),
            (7, fourth, "a"), (7, fourth.upper(), "a"), (8, "", "a"), (8, "", "a"), (8, None, "a"), (9, fourth + " end", "a")]
    df = documents(spark, rows)
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    got = sorted((r.doc_id, (r.text or "").lower()) for r in left.collect())
    assert got == sorted([(3, copied), (5, alone), (5, third), (7, fourth), (8, ""), (8, ""), (8, "")])
    many = documents(spark, [(1, f"{' '.join(words(rng, 12))}", "a") for _ in range(60)] + [(1, alone, "a")] * 30)
    assert near_dedup.drop_near_duplicates(many).count() == 61


# --- names of helper columns


HELPERS = (
    "_best _digest _slice _n _of _named _first _place _taken_id _copies _rows _times _doc _removed _more _toxicity _id _hash "
    "best digest slice n of named first place taken copies rows times doc removed more toxicity number row overlaps marked _marked"
).split()


def test_columns_of_any_name_stay(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, 30)) for _ in range(12)]
    rows = [(i, texts[i % 12] + "\n" + "a line that stands in all of them", f"s{i % 2}", len(texts[i % 12])) for i in range(16)]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    items = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    model = toxicity.Model(("v1",), (1.0,), -3.0)
    cases = {
        "drop_repeated_lines": line_dedup.drop_repeated_lines,
        "drop_toxic": lambda df: toxicity.drop_toxic(df, model),
        "decontaminate": lambda df: decontamination.decontaminate(df, items),
        "drop_near_duplicates": near_dedup.drop_near_duplicates,
        "repeat_documents": mixing.repeat_documents,
        "assign_shards": lambda df: sharding.assign_shards(df, [1.0, 2.0], grown_weight=1.0),
        "add_slots": lambda df: sharding.add_slots(df.withColumn("shard", F.lit(0))),
    }
    wide = base
    for k, name in enumerate(HELPERS):
        wide = wide.withColumn(name, F.concat(F.lit(f"{k} "), F.col("doc_id").cast("string")))
    for name, function in cases.items():
        plain = sorted((r.doc_id, r.text) for r in function(base).collect())
        out = function(wide)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        got = out.collect()
        assert sorted((r.doc_id, r.text) for r in got) == plain and plain, name
        assert all(r[helper] == f"{k} {r.doc_id}" for r in got for k, helper in enumerate(HELPERS)), name


# --- sample


def test_sample_has_one_row_per_id(spark):
    rows = [(i, f"text {i}", "a") for i in range(40)] + [(7, f"other {k}", "a") for k in range(50)] + [(7, None, "a")] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    orders = [toxicity.training_sample(documents(spark, r), labels, toxicity.Settings()).collect() for r in (rows, rows[::-1])]
    first, again = (sorted((r.doc_id, r.label, r.text) for r in order) for order in orders)
    held = {r.i for r in spark.range(40).withColumnRenamed("id", "i").filter(toxicity.held_out(F.col("i"))).collect()}
    assert 7 not in held and first == again
    assert [(i, y) for i, y, _ in first] == [(i, i % 2) for i in range(40) if i not in held]


# --- shards


def test_more_shards_take_rows_into_themselves_only(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shards(df, [1.0] * 8 + [3.0], grown_weight=1.0).collect()
    again = {r.doc_id: r.shard for r in sharding.assign_shards(df, [1.0] * 8 + [3.0, 1.0]).collect()}
    assert all(r.grown_shard == again[r.doc_id] and r.grown_shard in (r.shard, 9) for r in rows)
    share = sum(r.shard == 8 for r in rows) / 4000
    assert abs(share - 3 / 11) < 0.03
    fewer = {r.doc_id: r.shard for r in sharding.assign_shards(df, [1.0] * 8).collect()}
    assert all(fewer[r.doc_id] == r.shard for r in rows if r.shard != 8)
    with pytest.raises(ValueError):
        sharding.assign_shards(df, [1.0, 0.0])


def test_slots_of_odd_documents(spark):
    df = documents(spark, ODD * 3)
    rows = sharding.add_slots(sharding.assign_shards(df, [1.0, 2.0])).collect()
    assert len(rows) == 3 * len(ODD)
    for shard in (0, 1):
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1
    assert sharding.add_slots(sharding.assign_shards(documents(spark, []))).count() == 0


# --- benchmark


def plain_overlap(a, b, min_words=13, similarity=0.8):
    """Longest run of equal length in both that begins and ends alike and is alike enough, over all alignments."""
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        equal = [a[i] == b[i - shift] for i in range(max(0, shift), min(len(a), len(b) + shift))]
        for x in range(len(equal)):
            for y in range(x + best + 1, len(equal) + 1):
                if equal[x] and equal[y - 1] and 1000 * sum(equal[x:y]) >= round(1000 * similarity) * (y - x):
                    best = max(best, y - x)
    return best if best >= min(min_words, len(b)) else 0


def test_overlaps_like_the_plain_version(spark):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate((6, 12, 13, 20, 40, 5))]
    rows, want = [], {}
    for i in range(90):
        item = items[i % 5][1].split()
        part = list(item)
        for _ in range(i % 4 * len(part) // 20):
            part[rng.randrange(len(part))] = "other"
        if i % 7 == 0:
            part = part[: len(part) // 2]
        body = words(rng, 25) + part + words(rng, 25)
        rows.append((i, " ".join(body).upper() + " .", "a"))
        want[i] = {k: n for k, t in items[:5] if (n := plain_overlap(body, t.split()))}
    bench = spark.createDataFrame([*items, (6, None), (None, "x"), items[0]], "item_id long, text string")
    found = {}
    for block_words in (500_000, 30):
        got = decontamination.find_overlaps(documents(spark, rows), bench, block_words=block_words).collect()
        found[block_words] = {r.doc_id: {o.item_id: o.n_words for o in r.overlaps} for r in got}
    assert found[30] == found[500_000]
    hits = sum(len(w) for w in want.values())
    same = sum(found[30][i].get(k) == n for i, w in want.items() for k, n in w.items())
    assert same >= 0.97 * hits and all(want[i].get(k) == n for i, f in found[30].items() for k, n in f.items())


def test_short_items(spark):
    """Items of 6 to 12 words with any fifth of their inner words changed, shorter ones as a whole only."""
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 13)}
    rows, want = [], []
    for n, item in items.items():
        for changed in range(n // 5 + 1 if n >= 6 else 1):
            for places in itertools.combinations(range(1, n - 1), changed):
                rows.append(["some", *["other" if k in places else w for k, w in enumerate(item)], *item[: n // 2], "more"])
                want.append((n, 1, n, n - changed))
        if 1 < n < 6:
            rows.append(["some", *item[:-1], "other"])
            want.append(None)
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    df = documents(spark, [(i, " ".join(words), "a") for i, words in enumerate(rows)])
    got = decontamination.find_overlaps(df, bench).orderBy("doc_id").collect()
    assert [[tuple(o) for o in r.overlaps] for r in got] == [[w] if w else [] for w in want]


def test_items_in_scripts_without_spaces(spark):
    chinese = "\u4eba\u5de5\u667a\u80fd\u662f\u7814\u7a76\u8ba1\u7b97\u673a\u6a21\u62df\u4eba\u7684\u601d\u7ef4\u8fc7\u7a0b"
    thai = "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e40\u0e1b\u0e47\u0e19\u0e20\u0e32\u0e29\u0e32\u0e17\u0e35\u0e48"
    assert len(decontamination.text_words(chinese)) == 18 and "".join(decontamination.text_words(thai)) == thai
    assert decontamination.text_words("One, two_3 \uc815\ubcf4 \u4eba\u5de5\u3002") == ["one", "two_3", "\uc815\ubcf4", "\u4eba", "\u5de5"]
    bench = spark.createDataFrame([(1, chinese), (2, thai), (3, "\u5929\u6c14")], "item_id long, text string")
    texts = [f"\u524d{chinese[:7]}\u4e0d{chinese[8:]}\u540e", f"x{thai}x", "\u4eca\u5929\u6c14\u6e29", "\u5929\u7a7a\u6c14", chinese[:9]]
    df = documents(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for block_words in (500_000, 20):
        got = decontamination.find_overlaps(df, bench, block_words=block_words).orderBy("doc_id").collect()
        assert [[o.item_id for o in r.overlaps] for r in got] == [[1], [2], [3], [], []]


def test_overlaps_of_odd_documents(spark):
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[100:140])), (2, None), (3, "")], "item_id long, text string")
    df = documents(spark, ODD)
    rows = decontamination.find_overlaps(df, bench).collect()
    assert sorted(r.doc_id for r in rows if r.overlaps) == [3, 4, 4]
    left = decontamination.decontaminate(df, bench)
    assert left.columns == df.columns and left.count() == len(ODD) - 3
    assert decontamination.decontaminate(df, bench.limit(0)).count() == len(ODD)
    assert decontamination.find_overlaps(documents(spark, []), bench).count() == 0


# --- mixing


def test_targets_are_met(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    taken, target, size = {}, {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source], size[r.source] = r.target, r.source_size
    assert all(abs(taken[s] - target[s]) <= 60 and target[s] <= 3 * size[s] for s in taken)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    again = mixing.mix(documents(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    repeated = mixing.repeat_documents(documents(spark, rows))
    assert repeated.columns == documents(spark, rows).columns and repeated.count() == sum(r.copies for r in got)


def test_water_filling(spark):
    sources = spark.createDataFrame([("a", 1.0, 10), ("b", 1.0, 100), ("c", 2.0, 390), ("d", 0.0, 0), (None, None, 100)],
                                    "source string, weight double, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(sources, 1).collect()}
    # a is full at 10, then b at 100, then c takes what is left but is full at 390; nothing else has weight.
    assert got == {"a": 10.0, "b": 100.0, "c": 390.0, "d": 0.0, None: 0.0}
    got = {r.source: r.target for r in mixing.water_fill(sources, 3).collect()}
    assert got["a"] == 30.0 and got["b"] == pytest.approx(570 / 3) and got["c"] == pytest.approx(2 * 570 / 3)


def test_mix_of_odd_documents(spark):
    got = mixing.mix(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.copies >= 0 for r in got)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.repeat_documents(documents(spark, [(1, None, None), (1, "", None)])).count() == 0


# --- pages


PAGES = {
    "<html><body><div id='header'>Site <a href=/>home</a></div><div class='cookie-notice'>We use cookies to make this site work, "
    "and this is a long sentence about that.</div><div class='content'><h1>Title</h1><p>First &amp; paragraph text which is long "
    "enough.<p>Second\n one.<div class='ad'>Buy our product for a low price, really low, no kidding at all.</div><p>Third</div>"
    "<div class=comments><p>Nice article, I liked it very much indeed, thank you.</p></div></body>":
        "Title\n\nFirst & paragraph text which is long enough.\n\nSecond one.\n\nThird",
    "<article><p>a<b>b</b>&nbsp; c<!-- x > --> d<script>1<2</script>e</p><aside>no</aside><form>x<p>long</p></form><ul><li>one"
    "<li>two</ul><section class=comments><article class=comment><p>hi there</p></article></section></article><footer>f":
        "ab c de\n\none\n\ntwo",
    "<article><p title='a > b'>x &lt;p&gt; y": "x <p> y",
    "<script>var t='</p>';": "",
    "<nav><a>x</a></nav>": "",
    "": "",
}


def test_pages(spark):
    for html, text in PAGES.items():
        assert html_extraction.main_text(html) == text
    rows = [(i, f"u{i}", html, "x") for i, html in enumerate([*PAGES, *PAGES])] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extraction.extract_main_text(df)
    assert got.columns == ["page_id", "url", "text"]
    assert [r.text for r in got.orderBy("page_id").collect()] == ["", *PAGES.values(), *PAGES.values()]
    assert html_extraction.extract_main_text(df.limit(0)).count() == 0


SENTENCES = [f"Paragraph {i} of a text that is as long as a sentence or two, to be read by all who like." for i in range(5)]


@pytest.mark.parametrize(
    "wrapper",
    ["div class='content no-sidebar'", "div class='layout has-sidebar'", "div id=x class='overflow-hidden'", "div class='page-with-header'", "form action='/'"],
)
def test_wrappers(wrapper):
    """A wrapper of the page's text is no box, whatever its name; boxes in it and beside it are."""
    end = wrapper.split()[0]
    paragraphs = "".join(f"<p>{s}</p>" for s in SENTENCES)
    boxes = f"<aside>{paragraphs}</aside><div class=sidebar><p>{'Text in a box. ' * 60}</p></div>"
    comments = "<div class=comments>" + f"<article><p>{'I liked it. ' * 20}</p></article>" * 20 + "</div>"
    for inner in (f"<article>{paragraphs}</article>", f"<main>{paragraphs}</main>", paragraphs):
        for within, beside in (("", ""), (boxes, ""), ("", boxes), (comments, ""), ("", comments)):
            if inner == paragraphs and within + beside:
                continue
            html = f"<nav><a>x</a></nav><{wrapper}>{inner}{within}</{end}>{beside}<footer>{paragraphs}</footer>"
            assert html_extraction.main_text(html).split("\n\n") == SENTENCES
    assert html_extraction.main_text(f"<{wrapper}><article><p>Short.</p></article></{end}>") == "Short."
    assert html_extraction.main_text(f"<article>{paragraphs}</article><{wrapper}><p>{'Box. ' * 30}</p></{end}>").split("\n\n") == SENTENCES


def test_drawings_and_formulas():
    for page, texts in {
        '<p>One</p><p><svg class="i"/> Two</p><p>Three</p>': ["One", "Two", "Three"],
        "<p>One <svg class='i' /> two</p><p>Three</p><p><svg><path d='M0'/><text>no</text></svg>Four</p>": ["One two", "Three", "Four"],
        "<p>a <svg><title>no</title><foreignObject><div>no</div></foreignObject><script/><svg/><style/></svg> b</p><p>c": ["a b", "c"],
        "<div><svg class=i><g></div><p>One</p><p><svg><path>no</p><p>Two": ["One", "Two"],
        "<p>So <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></math> is.</p><p><math/>End": ["So x=2 is.", "End"],
        "<p><math><semantics><mrow><mtext>if <b>so</b></mtext></mrow><annotation>no</annotation></semantics></math>, y": ["if so, y"],
        "<math><mrow>x<p>One</p></math><p>Two</p>": ["x", "One", "Two"],
        "<SVG Class='i'/>One<p>Two": ["One", "Two"],
    }.items():
        assert html_extraction.main_text(f"<article>{page}</article><footer>no</footer>").split("\n\n") == texts


def test_long_page():
    body = "".join(f"<p>Paragraph number {i} of a long text.</p>" for i in range(5000))
    assert html_extraction.main_text(f"<nav>{'<a>x</a>' * 1000}</nav><article>{body}</article>").count("\n\n") == 4999


@pytest.mark.parametrize("blocks", ["<p>{long}</p><p>a</p>", "<div>{long}</div><div>b</div><p>c</p>", "<div><div>{long}</div>d</div>"])
def test_cut_of_long_pages_is_fast(blocks):
    """Long and short blocks in turn, without an article: many sources and sinks, and time in proportion to them."""
    part = blocks.format(long="Words of a block that is as long as a sentence or two. " * 3)
    page = html_extraction.page_blocks(part * 8000)
    html_extraction.weigh_doubts(page)
    costs = [html_extraction.terminal_costs(html_extraction.evidence(b)) for b in page]
    gains = [lost - taken for lost, taken in costs]
    assert min(gains) < 0 < max(gains) and len(gains) >= 16000
    began = time.process_time()
    html_extraction.minimum_cut(gains, html_extraction.smoothness_edges(page))
    assert time.process_time() - began < 2


def test_cut_of_long_runs_is_fast():
    for n, period in ((8000, 2), (8000, 50), (8000, 4000)):
        gains = [0.3 if i % period < period / 2 else -0.31 for i in range(n)]
        edges = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 2, 0.5) for i in range(0, n - 2, 3)]
        began = time.process_time()
        html_extraction.minimum_cut(gains, edges)
        assert time.process_time() - began < 2


def test_cut_is_minimal():
    rng = random.Random(10)
    for _ in range(150):
        n = rng.randrange(1, 8)
        gains = [rng.randrange(-4, 5) / 2 for _ in range(n)]
        edges = [(a, b, rng.randrange(1, 5) / 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side):
            lost = sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gains, side))
            return lost + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert cost(html_extraction.minimum_cut(gains, edges)) == pytest.approx(best)
