"""The pipeline: each stage against what it should keep, on planted rows."""

import random

import corpus_pipeline
from tests.llm.test_llm_queries import _components, word_sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _folder(spark, path):
    rng = random.Random(11)
    said = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    items = [(k, said(30)) for k in range(5)]
    texts, toxic = {}, {}
    for i in range(400):
        texts[i], toxic[i] = said(rng.randrange(20, 90)), i % 5 == 0
        if toxic[i]:
            texts[i] += " vermin and filthcast here"
    for i in range(400, 440):
        base = texts[i - 399 if (i - 399) % 5 else 2].split()
        base[rng.randrange(len(base))] = "changed" if i % 2 else base[0]
        texts[i], toxic[i] = " ".join(base), False
    for i in range(440, 450):
        part = items[i % 5][1].split()
        part[15] = "altered"
        texts[i], toxic[i] = said(20) + " " + " ".join(part) + " " + said(20), False
    texts[450], texts[451] = None, ""
    rows = [(i, t, "en", f"s{i % 4 if i % 3 else 0}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(y)) for i, y in toxic.items() if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, toxic


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    texts, toxic = _folder(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/out-{name}")
        docs = spark.read.parquet(f"{path}/out-{name}")
        assert docs.columns == COLUMNS + (["shard"] if k == 4 else [])
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    clean, single, decontaminated, mixed, sharded = kept
    assert sorted(clean) == [i for i in texts if not toxic.get(i)]
    want = _components(word_sets({i: texts[i] or "" for i in clean}, 5))
    assert sorted(single) == sorted(i for i in clean if want[i] == i) and len(single) < len(clean)
    assert sorted(decontaminated) == sorted(i for i in single if not 440 <= i < 450)
    assert set(mixed) <= set(decontaminated) and max(mixed.count(i) for i in set(mixed)) <= 3
    assert sorted(sharded) == sorted(mixed)
    run = sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, path).collect())
    assert run == sorted((r.doc_id, r.shard) for r in docs.select("doc_id", "shard").collect())


def test_pipeline_of_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
