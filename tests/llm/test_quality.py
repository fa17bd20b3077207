import brute
import pytest
from pyspark.sql import functions as F

from basketry.llm import quality
from basketry.llm.common import stored

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(docs):
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    want = sorted((d if d is not None else -99, *brute.quality(t)) for d, t in texts)
    got = sorted({(r["doc_id"] if r["doc_id"] is not None else -99, *(r[c] for c in BASE)) for r in quality.verdicts(docs).collect()})
    assert got == want


def test_counts_match_plain_python(documents):
    check(documents)


def test_odd_rows(odd, none, spark):
    check(odd)
    assert quality.verdicts(odd).count() == odd.count()
    assert quality.verdicts(none).count() == 0
    lines = "alpha beta gamma\nalpha beta gamma\n \nalpha beta gamma\nx y\n" + "z z z z z\n" * 30
    check(spark.createDataFrame([(1, lines, "en", "a"), (2, "a b a b a b", "en", "a"), (3, "#*$%&|<> " * 20, "en", None)], odd.schema))


def test_cutoffs_reject_far_values_and_keep_alike_ones(spark, none):
    word = [f"word{i:03d}" for i in range(400)]
    rows = [(i, " ".join(word[(i * 7 + j * (1, 3, 7, 9, 11)[i % 5]) % 400] for j in range(120)), "en", "s") for i in range(150)]
    rows += [(900, " ".join(w + "###" for w in word[:120]), "en", "s"), (901, " ".join("x" for _ in range(3)), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, none.schema)).collect()}
    assert not got[900] and not got[901] and all(got[i] for i in range(150))


def test_sketches_merge_to_the_sketch_of_all(documents):
    rows = stored(quality.measured(documents).drop("text"), "test-measures")
    whole = quality.merge(quality.sketches(rows), ())
    direct = quality.merge(quality.sketches(rows.withColumns({"lang": F.lit("x"), "source": F.lit("y")})), ())
    assert whole.exceptAll(direct).count() == 0 and direct.exceptAll(whole).count() == 0


def test_filter_keeps_rows_as_they_are(clashing):
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert kept.exceptAll(clashing).count() == 0


def plain_verdicts(rows):
    """rows: (doc_id, text, lang, source); {doc_id: kept}, with histograms, percentiles and mixed cutoffs in plain Python."""
    facts = []
    for d, text, lang, source in rows:
        n, chars, symbols, dup, repeat, failed = brute.quality(text)
        lines = len([x for x in (text or "").split("\n") if brute.WORD.search(x)])
        share = lambda k, a, b: k * a // b if b else 0
        values = {
            "symbol_permille": share(1000, symbols, chars), "dup_line_permille": share(1000, dup, lines), "repeat_permille": share(1000, repeat, n),
            "word_tenths": share(10, chars, n), "chars": chars, "all_lines": lines, "words": n,
        }
        facts.append((d, (lang, source), failed, values))
    kept_bits = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)

    def centre(values):
        """Median and reach of each measure over a list of value dicts."""

        def at(m, percent):
            bins = sorted(kept_bits(v[m]) for v in values)
            return next(b for i, b in enumerate(bins) if 100 * (i + 1) >= percent * len(bins) and (i + 1 == len(bins) or bins[i + 1] != b))

        out = {}
        for m, (size, one, allowed, _) in quality.MEASURES.items():
            low, mid, high = (at(m, p) for p in (25, 50, 75))
            step = one / max(at(size, 50), 1) if size else float(one)
            out[m] = (float(mid), max(15.0 * min(mid - low, high - mid), allowed * step))
        return out

    good = [(g, v) for _, g, failed, v in facts if not failed]
    whole = centre([v for _, v in good])
    mix = lambda n, a, b: tuple((n * x + 100 * y) / (n + 100) for x, y in zip(a, b, strict=True))
    cut = {}
    for lang in {g[0] for g, _ in good}:
        own = [v for g, v in good if g[0] == lang]
        by_lang = {m: mix(len(own), c, whole[m]) for m, c in centre(own).items()}
        for group in {g for g, _ in good if g[0] == lang}:
            own = [v for g, v in good if g == group]
            for m, c in centre(own).items():
                (mid, reach), (lang_mid, far) = mix(len(own), c, by_lang[m]), by_lang[m]
                cut[group, m] = (max(mid - reach, lang_mid - 2 * far), min(mid + reach, lang_mid + 2 * far))
    inside = lambda g, v, m: (quality.MEASURES[m][3] == "high" or v[m] >= cut[g, m][0]) and v[m] <= cut[g, m][1]
    return {d: not failed and all(inside(g, v, m) for m in quality.MEASURES) for d, g, failed, v in facts}, cut


def test_verdicts_and_cutoffs_against_plain_python(spark, documents, none):
    """The whole table, and made-up groups of very different texts; cutoffs differ between groups."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]
    made = [(10_000 + i, JUNK[k](i) if i % 9 == 0 else ordinary(i) + f"\n{'# ' * (i % 4)}" * (g + 1), None if g == 2 else "en", None if g == 1 else f"s{g}") for g, k in enumerate(JUNK) for i in range(60 * (g + 1))]
    for some in (rows, made, rows + made):
        some = list({r[0]: r for r in some}.values())
        frame = spark.createDataFrame(some, none.schema)
        want, cut = plain_verdicts(some)
        assert {r["doc_id"]: r["kept"] for r in quality.verdicts(frame).collect()} == want
        measured = stored(quality.measured(frame).drop("text"), "test-measures")
        for r in quality.cutoffs(quality.sketches(measured)).collect():
            for m in quality.MEASURES:
                assert (r[f"low_{m}"], r[f"high_{m}"]) == pytest.approx(cut[(r["lang"], r["source"]), m])
        for m in quality.MEASURES:
            values = {round(c[1], 6) for (_, name), c in cut.items() if name == m}
            assert len(values) > len(cut) / len(quality.MEASURES) / 2


def ordinary(i):
    """120 words without symbols or repeats, on four lines."""
    w = [f"word{(i * 7 + j * (1, 3, 7, 9, 11)[i % 5]) % 400:03d}" for j in range(120)]
    return "\n".join(" ".join(w[k : k + 30]) for k in range(0, 120, 30))


JUNK = {
    "symbols": lambda i: " ".join(f"{w}##" for w in ordinary(i).split()),
    "lines": lambda i: "\n".join([ordinary(i)] + ["x"] * 14),
    "long words": lambda i: " ".join(w * 4 for w in ordinary(i).split()),
    "short words": lambda i: " ".join(chr(97 + j % 26) + chr(97 + (i + j // 26) % 26) for j in range(120)),
}


@pytest.mark.parametrize("kind", JUNK)
def test_junk_in_a_group_does_not_raise_its_own_cutoff(spark, none, kind):
    """Groups of 200 rows with 0, 10, 30 and 45% junk: all junk goes, all else stays."""
    rows = [(s * 1000 + i, JUNK[kind](i) if i < 2 * s else ordinary(i), "en", f"s{s}") for s in (0, 10, 30, 45) for i in range(200)]
    got = quality.verdicts(spark.createDataFrame(rows, none.schema)).collect()
    assert len(got) == 800 and not any(r["base_failed"] for r in got)
    assert [r["doc_id"] for r in got if r["kept"] == (r["doc_id"] % 1000 < 2 * (r["doc_id"] // 1000))] == []


@pytest.mark.parametrize("kind", ["symbols", "long words", "short words"])
def test_a_group_that_is_mostly_junk_is_bounded_by_its_language(spark, none, kind):
    rows = [(i, JUNK[kind](i) if i < 120 else ordinary(i), "en", "mostly junk") for i in range(200)]
    rows += [(1000 + i, ordinary(i), "en", "clean") for i in range(400)]
    got = {r["doc_id"] for r in quality.verdicts(spark.createDataFrame(rows, none.schema)).collect() if r["kept"]}
    assert not got & set(range(120)) and got >= set(range(1000, 1400))
