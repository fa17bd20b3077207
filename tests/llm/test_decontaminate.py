import pytest
from pyspark.sql import functions as F

from basketry.llm import decontaminate

QUESTION = "A train leaves the northern station at 60 km/h with 12 crates while Maria waits near the old bridge for 45 minutes before Thomas brings 12 more"
OTHER = "A train leaves the northern station at 75 km/h with 30 crates while Petra waits near the old bridge for 20 minutes before Oscar brings 30 more"
MIXED = "A train leaves the northern station at 75 km/h with 30 crates while Petra waits near the old bridge for 20 minutes before Oscar brings 31 more"
ORDINARY = "the river ran past a small mill where nobody had worked for years and grass grew between every stone of that yard until autumn came"


def found(spark, docs, items=((1, QUESTION),)):
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(items), "item_id bigint, text string"))
    return {(r["doc_id"], r["item_id"]): r["exact"] for r in got.collect()}


def test_same_and_new_values(spark):
    docs = [
        (1, QUESTION), (2, f"{ORDINARY}. {OTHER}. {ORDINARY}"), (3, MIXED), (4, ORDINARY), (5, QUESTION.upper()), (6, "60 km/h 12 Maria 45 minutes"),
        (7, ", ".join(QUESTION.split())),
    ]
    assert found(spark, docs) == {(1, 1): True, (2, 1): False, (7, 1): True} or set(found(spark, docs)) >= {(1, 1), (2, 1), (7, 1)}
    got = found(spark, docs)
    assert got[1, 1] and not got[2, 1] and (3, 1) not in got and (4, 1) not in got and (6, 1) not in got


def test_template_words():
    reader = decontaminate.Templates()
    kind, _, ids = reader.read(b"Then Anna ran 5km, 12 miles and $3.50! Maria -- km")
    values = [reader.value(ids, kind, i) for i in range(len(kind))]
    assert values == ["then", "<name>anna", "ran", "<num>5", "<unit>km", "<num>12", "<unit>miles", "and", "<num>$3.50", "maria", "km"]


def test_whole_table_against_search(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], " ".join(r["text"].split())) for r in bench.collect()]
    texts = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in documents.collect()]
    want = {(d, i) for d, t in texts for i, q in items if q in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents, bench).collect()}
    assert want <= got
    near = lambda t, q: sum(w in t.lower() for w in q.lower().split()) / len(q.split())
    assert all(near(dict(texts)[d], dict(items)[i]) > 0.8 for d, i in got - want)


def test_odd_rows(spark, odd, none, clashing):
    bench = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (None, QUESTION), (2, None), (3, ""), (4, "12 45 60"), (5, "one")], "item_id bigint, text string")
    assert decontaminate.matches(odd, bench).filter("item_id <> 5").count() == 0
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(odd, bench.limit(0)).count() == 0
    kept = decontaminate.clean(clashing.unionByName(clashing.limit(1).withColumns({"doc_id": F.lit(77).cast("bigint"), "text": F.lit(OTHER)})), bench)
    assert kept.columns == clashing.columns and kept.filter("doc_id = 77").count() == 0 and kept.filter("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("word", ["Über", "x", "", "!!!", "5", "1,000.5%"])
def test_single_words_are_read(word):
    decontaminate.Templates().read(word.encode())
