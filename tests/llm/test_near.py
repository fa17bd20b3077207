import random
from itertools import combinations

import brute
from pyspark.sql import functions as F

from basketry.llm import near


def shingles(text):
    w = brute.words((text or "").translate(brute.LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_pairs(texts):
    """{(a, b)}: all pairs of keys whose shingles have Jaccard 0.8 or more, or none at all."""
    sets = {d: shingles(t) for d, t in texts.items()}
    return {(a, b) for a, b in combinations(sorted(texts), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def first_of(texts):
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in near_pairs(texts):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {find(d) for d in texts}


def copies(draw, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for at in draw.sample(range(len(w)), changes):
            w[at] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_whole_table_against_all_pairs(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert any(texts[a] != texts[b] for a, b in near_pairs(texts))
    assert sorted(r["doc_id"] for r in near.keep_one(documents).collect()) == sorted(first_of(texts))


def test_copies_with_changed_words_and_groups_larger_than_a_round(spark, none):
    draw = random.Random(3)
    word = [f"w{i}" for i in range(500)]
    texts = []
    for changes in (1, 2, 4, 6, 8):
        base = draw.choices(word, k=240)
        texts += [" ".join(base), *copies(draw, base, 12, changes)]
    base = draw.choices(word, k=200)
    texts += copies(draw, base, 60, 1) + copies(draw, base, 40, 7)
    draw.shuffle(texts)
    texts = dict(enumerate(texts))
    frame = spark.createDataFrame([(d, t, "en", "a") for d, t in texts.items()], none.schema)
    kept = {r["doc_id"] for r in near.keep_one(frame.repartition(3)).collect()}
    assert kept == first_of(texts) and 20 < len(kept) < 100


def test_links_of_large_groups_are_whole(spark):
    """One key with 40 unlike sets, 30 alike ones, and a chain whose ends are unlike: nothing is passed over."""
    own = {i: set(range(1000 * i, 1000 * i + 50)) for i in range(40)} | {100 + i: set(range(10**6, 10**6 + 90)) | {10**7 + i} for i in range(30)}
    own |= {200 + i: set(range(10**8 + 5 * i, 10**8 + 5 * i + 100)) for i in range(30)}
    import numpy as np

    sets = spark.createDataFrame([(c, bytearray(np.array(sorted(s), np.uint64).tobytes())) for c, s in own.items()], "cls bigint, own binary")
    active = spark.createDataFrame([(c, 1) for c in own], "cls bigint, key bigint")
    found = near.links(active, sets)
    from basketry.llm.components import components

    root = {r["node"]: r["root"] for r in components(found).collect()}
    assert root == {c: 100 if c < 200 else 200 for c in own if c >= 100}


def test_rows_that_share_a_doc_id_are_judged_by_their_text(spark, none):
    a, b = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight")
    rows = [(1, a, "en", "x"), (1, b, "en", "x"), (1, b, "en", "y"), (2, b, "en", "x"), (None, b, "en", "x"), (1, a, "en", "x")]
    got = near.keep_one(spark.createDataFrame(rows, none.schema)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, b), (1, a), (1, b)])
    again = near.keep_one(spark.createDataFrame(rows[::-1], none.schema)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_odd_rows(spark, odd, none, clashing):
    """Words decide: rows without any are one, the rest of the odd rows are alike or apart."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    kept = {r["doc_id"] for r in near.keep_one(odd).collect()}
    texts = {d: t for d, t in rows if d is not None}
    assert {d for d in kept if d is not None} == first_of(texts)
    assert near.keep_one(odd).count() == len(first_of(texts)) + 2
    assert near.keep_one(none).count() == 0 and near.keep_one(none).columns == none.columns
    got = near.keep_one(clashing)
    assert got.columns == clashing.columns and {r["doc_id"] for r in got.collect()} == kept
    dotted = odd.withColumn("a.b", odd["lang"])
    assert near.keep_one(dotted).columns == dotted.columns


def test_pairs_just_above_the_limit_share_a_band():
    draw = random.Random(11)
    missed = 0
    for _ in range(1000):
        base = draw.choices([f"w{i}" for i in range(5000)], k=300)
        copy = copies(draw, base, 1, 6)[0]
        x, y = (near.distinct_shingles(t.encode()) for t in (" ".join(base), copy))
        missed += not set(near.bands(x)) & set(near.bands(y))
    assert missed <= 1


def test_balls_show_near_texts_that_share_no_band(spark, none, monkeypatch):
    """One word of a long text changes few bits of its SimHash; with bands of their own, only balls show such pairs."""
    draw = random.Random(8)
    word = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = draw.choices(word, k=20_000)
        texts += [" ".join(base), *copies(draw, base, 1, 1)]
    texts += [" ".join(draw.choices(word, k=300)) for _ in range(5)] + ["", "one"]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], none.schema)
    sketch = near._sketch

    def apart(parts):
        for part in sketch(parts):
            keys = [[c] if b else [] for c, b in zip(part.column("cls").to_pylist(), part.column("bands").to_pylist(), strict=True)]
            yield part.set_column(part.schema.get_field_index("bands"), "bands", near.pa.array(keys, near.pa.list_(near.pa.int64())))

    monkeypatch.setattr(near, "_sketch", apart)
    assert sorted(r["doc_id"] for r in near.keep_one(df).collect()) == sorted(first_of(dict(enumerate(texts)))) == [0, 2, 4, 6, 8, 10, *range(12, 19)]
