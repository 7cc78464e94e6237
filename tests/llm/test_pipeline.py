"""The pipeline's stages, each against what its operator says of its own input."""

from collections import Counter

import corpus_pipeline
from lodestack.llm import mixing, neardup, packing, quality, secrets, tokencount
from lodestack.llm.common import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    rows = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows.append(docs.collect())
        if i < 4:
            assert docs.columns == table(spark, sf, "documents").columns
    raw, ruled, deduped, masked, mixed, packed = rows
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert {r.doc_id for r in ruled} == {r.doc_id for r in raw if quality.verdicts([r.text or ""], model)[2][0]}
    classes = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(ruled)).collect()}
    assert Counter(r.doc_id for r in deduped) == Counter(set(classes.values()))
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: secrets.redact(r.text, secrets.scan(r.text)[1]) for r in deduped}
    taken = {r.doc_id: r.copies for r in mixing.mix_report(spark.createDataFrame(masked)).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: c for i, c in taken.items() if c})
    whole = {}
    for r in sorted(packed, key=lambda r: r.piece):
        whole[r.doc_id, r.copy or 0] = whole.get((r.doc_id, r.copy or 0), "") + r.text
    assert Counter((i, t) for (i, _), t in whole.items()) == Counter((r.doc_id, r.text) for r in mixed)
    count = tokencount.counter(tokencount.TOKENIZER)
    assert [r.length for r in packed] == count([r.text for r in packed])
    assert all(r.bucket_len >= r.length for r in packed if r.bucket is not None) and packing.MAX_LEN >= max(r.length for r in packed)


EDGES = "doc_id long, text string, lang string, source string, n_chars long, length int, size string, node string, copies int"
GOOD = "The harbour council met on Tuesday evening to discuss how the old lighthouse could be repaired before winter storms arrive. Members agreed that volunteers should survey the tower, list what needs work, and report back within three weeks."


def edges(spark):
    texts = [(1, GOOD), (1, GOOD), (2, GOOD.replace("three weeks", "three days")), (3, GOOD[::-1]), (3, "short"), (None, GOOD), (4, None), (5, ""), (6, GOOD + " " + " ".join(f"Then person {i} asked about cost item {i * 7}." for i in range(3000)))]
    return spark.createDataFrame([(i, t, None, None if i == 1 else "s", len(t) if t is not None else None, 1, "x", "y", 2) for i, t in texts], EDGES)


def test_edges(spark, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    for name, docs in (("some", edges(spark)), ("none", edges(spark).limit(0))):
        rows = []
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            assert docs.columns == columns or i == 4
            rows.append(docs.collect())
        ruled, deduped, masked, mixed, packed = rows
        if name == "none":
            assert rows == [[]] * 5
            continue
        assert Counter(r.doc_id for r in ruled) == {1: 2, 2: 1, 3: 1, None: 1, 6: 1}
        assert Counter(r.doc_id for r in deduped) == {1: 1, 3: 1, None: 1, 6: 1}
        assert Counter(r.doc_id for r in masked) == Counter(r.doc_id for r in deduped) and {r.doc_id for r in mixed} <= {r.doc_id for r in masked}
        assert max(r.piece for r in packed) > 5 or 6 not in {r.doc_id for r in mixed}


def test_run(spark, sf):
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() > 0 and {"text", "batch", "copy"} <= set(packed.columns)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(k.startswith(f"op{i}_") for k in names) == 1 for i in range(1, 11)) and "pipeline" in names
