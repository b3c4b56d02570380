"""The pipeline against brute force of its stages, and its contract."""

import random

import corpus_pipeline
from steadfast.llm import byte_bpe

from . import brute


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = some(60)
    texts = {i: some(r.choice([60, 90, 150])) + "\n" + some(20) for i in range(40)}
    for i in range(40, 60):
        base = texts[i - 40].split(" ")
        base[r.randrange(len(base))] = "changed"
        texts[i] = " ".join(base)
    texts |= {i: passage + "\n" + some(70) for i in range(60, 70)} | {70: "too short", 71: "again and again " * 60, 72: texts[3], 73: ""}
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()] + [(74, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    kept = {i: t for i, t in texts.items() if brute.quality(t)[6]}
    lines = {i: t for i, t in brute.dedup(kept).items() if t or not kept[i]}
    label, _ = brute.components(lines, 5, 80)
    alone = {i: t for i, t in lines.items() if label[i] == i}
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        seen.append({x["doc_id"]: x["text"] for x in docs.collect()})
    assert seen == [kept, lines, alone]

    path, pattern = byte_bpe.vocabulary()
    codec = byte_bpe.codec(open(path, "rb").read(), pattern)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} <= set(alone)
    assert all(x["ids_sha256"] == brute.sha(",".join(map(str, codec.encode(alone[x["doc_id"]])))) and x["decoded_sha256"] == brute.sha(alone[x["doc_id"]]) for x in got)
    words = sum(len(t.split()) for t in alone.values())
    assert abs(sum(len(alone[x["doc_id"]].split()) for x in got) - words) < 0.1 * words


def test_stages_take_empty_tables_and_nulls(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, rank string, key string"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long + " a", None, None, None, "x", "y"), (None, long + " a", None, None, None, "x", "y"), (1, long, None, None, None, None, None), (1, long, None, None, None, None, None), (2, None, None, "s", None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert docs.count() > 0
