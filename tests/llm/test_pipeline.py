import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, documents):
    """Each stage on what its predecessor kept: the fixed rules, all pairs, plain search, the mix's bounds, the tokenizer."""
    from basketry.llm.common import stored

    from test_near import first_of
    from test_tokens import expected, read

    frames, docs = [documents], documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        frames.append(docs)
    rows = [[tuple(r) for r in f.collect()] for f in frames[:5]]
    assert all(f.columns == documents.columns for f in frames[:5])
    start, good, single, clean, mixed = rows
    assert set(good) <= {r for r in start if not brute.quality(r[1])[-1]} and len(good) > 0.6 * len(start)
    first = first_of({r[0]: r[1] for r in good})
    assert sorted(single) == sorted(r for r in good if r[0] in first)
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = {r for r in single if any(q in " ".join(r[1].split()) for q in items)}
    assert holds.isdisjoint(clean) and len(set(single) - set(clean) - holds) <= 2
    assert set(mixed) <= set(clean) and max(mixed.count(r) for r in set(mixed)) <= 2
    assert read(frames[5]) == expected([(r[0], r[1]) for r in mixed])


def test_run_and_registered_query_agree(spark, documents):
    got = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()), key=repr)
    assert len(got) > 50 and sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()), key=repr) == got
