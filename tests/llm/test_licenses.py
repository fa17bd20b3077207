import random

from basketry.llm import licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_increasing_run():
    draw = random.Random(1)
    for _ in range(200):
        seq = draw.sample(range(30), draw.randint(0, 12))
        got = [seq[i] for i in licenses.increasing(seq)]
        assert got == sorted(got)
        best = [1] * len(seq)
        for i in range(len(seq)):
            best[i] = 1 + max((best[j] for j in range(i) if seq[j] < seq[i]), default=0)
        assert len(got) == max(best, default=0)


def test_alignment_is_increasing_and_no_longer_than_the_best():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.choice("abcdefghijklmnop") for _ in range(draw.randint(0, 25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(a, b)
    text = licenses.TEMPLATES["MIT"].split()
    assert len(licenses.patience(text[:40] + ["new"] + text[41:], text)) == len(text) - 1


def test_each_template_is_found_whole_edited_and_not_in_other_text():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    fill = ["plain", "words", "of", "no", "license", "software", "notice"] * 30
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        edited = [w for i, w in enumerate(words) if i % 11 != 7 or len(words) < 20]
        for body in (words, edited):
            got = scanner.scan(" ".join(fill + body + fill + body).encode())
            assert [x[0] for x in got].count(name) == 2, name
        assert scanner.scan(" ".join(words[: len(words) // 2]).encode()) == [] or len(words) > 60
    assert scanner.scan(" ".join(fill * 50).encode()) == [] == scanner.scan(None) == scanner.scan(b"")


def test_odd_rows(odd, none, clashing, spark):
    assert licenses.scan(odd).count() == 0 == licenses.scan(none).count() == licenses.scan(clashing).count()
    two = spark.createDataFrame([(1, "x " + licenses.TEMPLATES["ISC"]), (1, licenses.TEMPLATES["ISC"]), (None, licenses.TEMPLATES["ISC"])], "doc_id bigint, text string")
    assert [(r["license"], r["coverage"]) for r in licenses.scan(two).collect()] == [("ISC", 1.0)] * 3


def test_whole_table(documents):
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(documents).collect()}
    plain = {"MIT-statement": "Released under the MIT License.", "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0."}
    want = {(r["doc_id"], n) for r in documents.collect() for n, t in plain.items() if t in (r["text"] or "")}
    assert want <= got
