import hashlib
import math
import random

import numpy as np
import pytest

from basketry.llm import vector_codes
from basketry.llm.metric_tree import anchors, grown, nearest, squared


def brute(rows, entries=256, rounds=4):
    """rows: (id, vector, label); (id, code, error, label_error, digest), with Python's integers throughout."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = -(-size // 4)
    ints = [[math.floor(1024 * x) for x in r[1]] + [0] * (4 * width - size) for r in kept]
    parts = [[v[p * width : (p + 1) * width] for v in ints] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for part, book in zip(parts, books, strict=True):
            own = {}
            for x in part:
                own.setdefault(near(x, book), []).append(x)
            for e, xs in own.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = [[near(part[i], book) for part, book in zip(parts, books, strict=True)] for i in range(len(kept))]
    errors = [sum(gap(parts[p][i], books[p][c]) for p, c in enumerate(code)) for i, code in enumerate(codes)]
    total = {}
    for r, e in zip(kept, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    top = 2**63 - 1
    return sorted(
        ((r[0], "".join(f"{c:02x}" for c in code), min(e, top), min(total[r[2]], top), sha) for r, code, e in zip(kept, codes, errors, strict=True)), key=repr
    )


def result(frame, **kw):
    return sorted(map(tuple, vector_codes.encoded(frame, **kw).collect()), key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def planted(n=600, size=8, seed=1):
    draw = random.Random(seed)
    centre = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(9)]
    near = lambda: [float(np.float32(c + draw.gauss(0, 0.1))) for c in draw.choice(centre)]
    return [(i * 3, near(), draw.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 100, 7])
def test_against_plain_python(spark, block):
    rows = planted()
    assert result(spark.createDataFrame(rows, SCHEMA), entries=20, block=block) == brute(rows, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = planted(40) + [
        (1000, None, 1), (1001, [nan] * 8, 1), (1002, [1.0] * 7 + [None], 1), (1003, [inf] + [0.0] * 7, 1), (1004, [], 1), (1005, [0.5] * 7, 1),
        (None, [0.25] * 8, None), (3, [0.25] * 8, 2), (3, [0.25] * 8, 2), (-5, [0.0] * 8, 1), (2000, [2.0**100] * 8, 3), (2001, [-(2.0**21)] * 8, 4),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(frame, entries=12) == brute(rows, 12)
    assert result(frame.selectExpr("*", "1 AS id", "2 AS vector", "3 AS trees", "4 AS code"), entries=12) == brute(rows, 12)
    assert vector_codes.encoded(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.encoded(spark.createDataFrame([(1, None, 1)], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    odd = [(i, [float(i), 0.5, float(i % 3), 1.0, -2.5], None) for i in range(9)]
    assert result(spark.createDataFrame(odd, SCHEMA), entries=4) == brute(odd, 4)


def test_same_vector_everywhere(spark):
    rows = [(i, [0.125] * 8, 1) for i in range(500)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_tree_and_candidates():
    """Balls hold their points and sums; nearest entries equal a full search, ties included, and some balls are owned whole."""
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(0, 4, (900, 5)) + rng.integers(0, 4, (900, 1)) * 400).astype(np.int64)
    tree = grown(points)
    assert sorted(tree.order) == list(range(900)) and (tree.points == points[tree.order]).all()
    for i in range(len(tree.low)):
        mine = tree.points[tree.low[i] : tree.high[i]]
        assert (mine.sum(0) == tree.sums[i]).all()
        assert np.sqrt(((mine - tree.centres[i]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
    entries = np.concatenate([points[:30], points[:3], points[[500]]])
    owned, rows, chosen = nearest(tree, entries)
    got = np.full(900, -1)
    got[rows] = chosen
    for node, e in owned:
        assert (got[tree.low[node] : tree.high[node]] == -1).all()
        got[tree.low[node] : tree.high[node]] = e
    assert (got == squared(tree.points, entries).argmin(1)).all()
    few, rows, _ = nearest(tree, np.array([[k * 400] * 5 for k in range(4)]))
    assert len(rows) == 0 and sum(tree.high[i] - tree.low[i] for i, _ in few) == 900


def test_anchors_own_their_nearest_points():
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (300, 3))
    owner = anchors(points, 17)
    assert owner.max() == 16
    assert anchors(np.ones((5, 2)), 3).tolist() == [0] * 5


def test_whole_table(spark):
    from pathlib import Path

    path = Path("/root/testdata/sf0.001/embeddings.parquet")
    if not path.exists():
        pytest.skip("tables are not here")
    table = spark.read.parquet(str(path)).limit(300)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert result(table, entries=16) == brute(rows, 16)
