"""Each stage of the pipeline against a plain Python version of its decision, over all that the stage before kept."""

import math
from collections import Counter

import pytest

import corpus_pipeline
from lamina.llm import mixing, packing, quality, toxicity
from test_documents import brute_fingerprint, brute_targets, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean, toxic and broken texts, exact and near copies, a hot source."""
    docs, labels = [], []
    for i in range(500):
        w = words(70, i if i % 10 else 7 * (i % 30)).split()
        toxic, good = i % 9 == 0, i % 7 != 0
        if toxic:
            w[10:10] = ["vile", "awful", "nasty"]
        text = " ".join(w) if good else " | ".join(x + "###" for x in w)
        docs.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000 + i, docs[1][1], "en", "hot", 1) for i in range(40)] + [(2000, None, None, None, None), (2001, "", "en", None, 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"file://{at}"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]

    rows = docs.collect()
    model = toxicity.toxicity_model(docs, labels)
    want = {r.doc_id for r in rows if toxicity.score_text((r.text or "").encode(), model)[0] < toxicity.THRESHOLD}
    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == want
    assert not any(i % 9 == 0 for i in want if i < 500) and {i for i in range(500) if i % 9} <= want

    model = quality.fit(quality.training_rows(kept, labels, "quality", rows=quality.SAMPLE_ROWS))
    p = {r.doc_id: float(quality.probability([(r.text or "").encode()], model)[0]) for r in kept.collect()}
    good = stages["quality"](spark, kept, sf_dir)
    left = {r.doc_id for r in good.collect()}
    assert good.columns == COLUMNS and left <= want
    assert {i for i in want if p[i] > 0.99} <= left and not {i for i in left if p[i] < 0.01}
    assert {i for i in want if i < 500 and i % 7} <= left and not any(i % 7 == 0 for i in left if i < 500)

    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in good.collect()]
    label = {i: i for i, _ in fps}
    for _ in fps:
        before = dict(label)
        for i, x in fps:
            label[i] = min(label[j] for j, y in fps if (x ^ y).bit_count() <= 3)
        if label == before:
            break
    single = stages["near_duplicates"](spark, good, sf_dir)
    assert single.columns == COLUMNS and sorted(r.doc_id for r in single.collect()) == sorted(set(label.values()))

    rows = single.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    target = brute_targets(dict(sizes))
    mixed = stages["mixing"](spark, single, sf_dir)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == COLUMNS
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert times[r.doc_id] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9))
    assert sum(times.values()) == mixing.mix_plan(single).agg({"copies": "sum"}).first()[0]

    enc = packing.encoder(packing.default_tokenizer())
    pieces = stages["packing"](spark, mixed, sf_dir).collect()
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({r.doc_id: times[r.doc_id] * (len(enc(r.text or "")) // 4 + 1) for r in rows if times[r.doc_id]})


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty_tables_and_further_columns(spark, tmp_path):
    """No document and no label; then columns whose names clash with those that the stages make."""
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/e").count() == 0
    rows = [(i, words(60, i), "en", "s", 1, "r", 2, "x", 3.0) for i in range(40)] + [(None, None, None, None, None, None, None, None, None)] * 3
    clash = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, place int, `_p` string, score double")
    clash.write.parquet(f"{tmp_path}/c/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/c/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/c/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, f"file://{tmp_path}/c")
        assert d.columns == clash.columns, name
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/c").count() > 0
