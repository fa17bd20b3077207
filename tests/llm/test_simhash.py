import random

import brute
import numpy as np
from pyspark.sql import functions as F

from basketry.llm import simhash
from basketry.llm.components import components


def test_fingerprints_match_the_definition(odd, rows):
    got = odd.select("doc_id", "text").filter("doc_id IS NOT NULL")
    for (doc_id, fp), (_, text) in zip(rows(simhash.fingerprints(got)), rows(got.select("doc_id", "text")), strict=True):
        pass
    for text in [None, "", "one", "ONE two", "a b c d e f A B C", "é É", "x\xa0y z", brute.LOWER and "W " * 40]:
        assert simhash.fingerprint(text.encode() if text is not None else None) == brute.simhash(text)


def test_whole_table_against_all_pairs(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    fps = {d: brute.simhash(t) for d, t in texts.items()}
    root = brute.components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in texts}


def test_links_connect_all_pairs_within_the_radius(spark):
    draw = random.Random(5)
    fps = set()
    for _ in range(30):
        base = draw.getrandbits(64)
        fps.add(base)
        for _ in range(25):
            x = base
            for b in draw.sample(range(64), draw.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    ids = dict(enumerate(sorted(fps)))
    want = brute.components(ids)
    signed = {d: int(np.uint64(f).view(np.int64)) for d, f in ids.items()}
    frame = spark.createDataFrame([(f,) for f in signed.values()], "fp bigint")
    found = simhash.links(frame)
    assert found.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 3).count() == 0
    root = {r["node"]: r["root"] for r in components(found).collect()}
    groups = lambda of: {frozenset(d for d in ids if of(d) == g) for g in {of(d) for d in ids}}
    assert groups(lambda d: root.get(signed[d], signed[d])) == groups(want.get)


def test_odd_rows(odd, none, clashing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r["doc_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {3, 4, 5, None}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == [-3, 1, 3, 6, 8, 9]
    assert kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id IS NULL").count() == 2


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    links = spark.createDataFrame([*path, *star, (5, 5), (None, 3), (7, 8), (8, 7)], "u bigint, v bigint")
    root = {r["node"]: r["root"] for r in components(links).collect()}
    assert {root[i] for i in range(61)} == {0} and {root[1000 + i] for i in range(80)} == {1000}
    assert components(links.limit(0)).count() == 0
