"""What a worker and the driver hold."""

from steadfast.llm import byte_bpe, common, jaccard_join, line_dedup, mixing


def test_remembered_ids_are_the_vocabularys_own_objects():
    path, pattern = byte_bpe.vocabulary()
    with open(path, "rb") as file:
        c = byte_bpe.Codec(byte_bpe.read_ranks(file.read()), pattern)
    text = "unrememberable qzxjkvq antidisestablishmentarianism 98765 zzyzx"
    ids = c.encode(text)
    assert c.decode(ids) == text.encode() and any(i > 256 for i in ids)
    own = {id(r) for r in c.ranks.values()}
    assert all(id(i) in own for got in c.known.values() for i in got)


def test_operators_of_many_tables_release_the_drivers_memory(spark, monkeypatch):
    written, seen, new = [], [], common.uuid.uuid4
    monkeypatch.setattr(common.uuid, "uuid4", lambda: written.append(1) or new())
    monkeypatch.setattr(common, "release", lambda s: seen.append(len(written)))
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(60)), f"s{i % 2}") for i in range(12)], "doc_id long, text string, source string")
    mixing.take(docs).collect()
    line_dedup.dedup_lines(docs).collect()
    jaccard_join.link_documents(docs).collect()
    marks = [0, *seen, len(written)]
    assert len(written) > 30 and max(b - a for a, b in zip(marks, marks[1:], strict=False)) <= common.CUTS


def test_released_memory_leaves_the_jvm(spark):
    assert common._trim(spark)
