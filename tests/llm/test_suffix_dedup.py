import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from basketry.llm import suffix_dedup


def plain(rows, width=200):
    """rows: (doc_id, text); every string of `width` bytes is counted."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def result(frame, **kw):
    return sorted(map(tuple, suffix_dedup.deduplicated(frame, **kw).collect()), key=repr)


def planted(seed=1):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 230, 600)]
    docs = []
    for d in range(80):
        body = ""
        for _ in range(draw.randint(0, 4)):
            body += text(draw.randint(0, 300))
            p = draw.choice(passages)
            cut = p[draw.randint(0, 20) : len(p) - draw.randint(0, 20)]
            if draw.random() < 0.4:
                at = draw.randrange(len(cut))
                cut = cut[:at] + "X" + cut[at + 1 :]
            body += cut
        docs.append((d, body))
    docs += [(100, "a" * 700), (101, "a" * 250), (102, "ab" * 300), (103, text(50) * 9), (7, docs[9][1]), (7, docs[9][1]), (None, docs[11][1])]
    return docs


@pytest.mark.parametrize("kw", [{}, {"bucket": 3000}, {"many": 2}, {"gram": 20, "bucket": 1}, {"gram": 190}])
def test_against_plain_python(spark, kw):
    docs = planted()
    want = plain(docs)
    assert result(spark.createDataFrame(docs, "doc_id bigint, text string"), **kw) == want
    assert sum(r[2] for r in want) > 20_000


def test_whole_table(documents):
    assert result(documents) == plain([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(odd, none, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain(rows)
    assert result(odd) == want
    assert result(clashing) == want
    assert suffix_dedup.deduplicated(none).count() == 0


def test_anchors_cover_every_window():
    draw = random.Random(5)
    text = bytes(draw.choice(b"ab ") for _ in range(3000))
    gram, anchor, first, last = suffix_dedup.pieces(text, 100, 30)
    assert first[0] == 0 and last[-1] == 2900 and (first[1:] == last[:-1] + 1).all()
    assert (anchor >= last).all() and (anchor + 30 <= first + 100).all()
    # the anchor depends on the window alone
    for at in (0, 417, 2900):
        alone = suffix_dedup.pieces(text[at : at + 100], 100, 30)
        k = np.searchsorted(last, at)
        assert alone[0][0] == gram[k] and alone[1][0] + at == anchor[k]


@pytest.mark.parametrize("width", [200, 13, 8])
def test_sorted_suffixes(width):
    draw = random.Random(width)
    text = bytes(draw.choice(b"ab\x00") for _ in range(400)) + b"x" * 300 + bytes(draw.choice(b"ab") for _ in range(100)) * 3
    starts = np.arange(0, len(text) - width + 1)
    count = Counter(text[i : i + width] for i in starts)
    assert suffix_dedup.suffix_classes(text, starts, width).tolist() == [count[text[i : i + width]] for i in starts]
    assert suffix_dedup.suffix_classes(text, starts[:0], width).tolist() == []
