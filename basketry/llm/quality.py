"""Quality rules whose cutoffs follow the data: mergeable quantile sketches per language and source, then a joined filter.

DataFrame functions only. The sketch of a group is a histogram over log-linear integer bins (each value keeps its seven
leading bits, so a bin is at most 1/64 wide relative to its values). Two sketches merge by adding counts, in any order and
with the same result, so Spark's partial sums build them before the shuffle and reruns agree. A group's sketch has a few
hundred rows at most, whatever the number of its documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored, words_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: The cutoffs of a language and source are mixed with those of the language as if these came from so many rows more; the language's with those of all.
PRIOR = 100
#: A cutoff lies this many times the distance from the median to the nearer quartile beyond the median. Junk on one side moves one
#: quartile only, so up to half of a group may be junk. Of a normal distribution these are ten standard deviations.
REACH = 15
#: A group's cutoff lies at most this many times the reach of its language beyond the language's median.
WIDE = 2
#: Measures: the size they are a share of, what one more occurrence adds to them times that size, how many occurrences in a text of the group's
#: median size a cutoff allows where the quartiles don't differ, and the sides cut. A word's length has steps of one tenth.
MEASURES = {
    "symbol_permille": ("chars", 1000, 35.0, "high"), "dup_line_permille": ("all_lines", 1000, 2.5, "high"), "repeat_permille": ("words", 3000, 27.0, "high"),
    "word_tenths": (None, 1, 10.0, "both"),
}
SIZES = ("chars", "all_lines", "words")
#: Leading bits that a bin of the sketches keeps.
BITS = 7


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with counts and measures of each whole text, in columns named `q_*`. Null and empty texts count zero."""
    df = docs.withColumn("q_w", words_of(F.col("text")))
    df = df.withColumn("q_n", F.size("q_w")).withColumn(
        "q_lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    )
    # one long per 3-word window; most texts have no window twice and need nothing more
    df = df.withColumn(
        "q_h",
        F.when(F.col("q_n") < 3, F.array().cast("array<bigint>")).otherwise(
            F.expr("transform(sequence(0, q_n - 3), i -> xxhash64(get(q_w, i), get(q_w, i + 1), get(q_w, i + 2)))")
        ),
    )
    df = df.withColumn("q_some", F.size(F.array_distinct("q_h")) < F.size("q_h"))
    df = df.withColumn("q_z", F.expr("CASE WHEN q_some THEN sort_array(transform(q_h, (h, i) -> struct(h, i))) END"))
    df = df.withColumn(
        "q_at",
        F.expr(
            "CASE WHEN q_some THEN sort_array(transform(filter(q_z, (z, j) -> z.h <=> get(q_z, j - 1).h OR z.h <=> get(q_z, j + 1).h), z -> z.i)) END"
        ),
    )
    df = df.withColumn(
        "q_repeat",
        F.expr("CASE WHEN q_some THEN aggregate(transform(q_at, (p, j) -> least(3, coalesce(get(q_at, j + 1) - p, 3))), 0, (s, x) -> s + x) ELSE 0 END"),
    )
    df = df.select(
        *docs.columns,
        F.col("q_n").cast("bigint").alias("q_words"),
        F.coalesce(F.char_length(F.array_join("q_w", "")), F.lit(0)).cast("bigint").alias("q_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("bigint").alias("q_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint").alias("q_dup_lines"),
        F.size("q_lines").cast("bigint").alias("q_all_lines"),
        F.col("q_repeat").cast("bigint").alias("q_repeat_words"),
    )
    share = "CAST(coalesce({} * {} DIV nullif({}, 0), 0) AS BIGINT)".format
    return df.selectExpr(
        "*",
        f"q_words < {MIN_WORDS} OR 100 * q_repeat_words > {MAX_REPEAT_PERCENT} * q_words AS q_failed",
        share(1000, "q_symbols", "q_chars") + " AS q_symbol_permille",
        share(1000, "q_dup_lines", "q_all_lines") + " AS q_dup_line_permille",
        share(1000, "q_repeat_words", "q_words") + " AS q_repeat_permille",
        share(10, "q_chars", "q_words") + " AS q_word_tenths",
    )


def _bin(value: Column) -> Column:
    """The value with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(keys, measure, bin, n): the sketches of every group over the rows that pass the fixed rules, of the measures and the sizes."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"q_{m}").alias("value")) for m in (*MEASURES, *SIZES)))
    flat = rows.filter("NOT q_failed").select(*keys, F.inline(values))
    return flat.groupBy(*keys, "measure", _bin(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def centres(sketch: DataFrame, keys: tuple[str, ...], tag: str) -> DataFrame:
    """(keys, <tag>_n, <tag>_mid_<measure>, <tag>_reach_<measure>): median and reach of every group, read from its sketches.

    The bins of one group and measure, at most a few hundred times the number of binary orders, are one array; a percentile is the first bin at which
    the running count reaches its share.
    """
    bins = sketch.groupBy(*keys, "measure").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b")
    )

    def at(percent: int) -> str:
        return (
            f"aggregate(b, struct(0L AS s, CAST(NULL AS BIGINT) AS v), (a, x) -> struct(a.s + x.n AS s, CASE WHEN a.v IS NULL AND "
            f"100 * (a.s + x.n) >= {percent} * n THEN x.bin ELSE a.v END AS v), a -> a.v)"
        )

    read = bins.select(*keys, "measure", "n", *(F.expr(at(p)).alias(f"p{p}") for p in (25, 50, 75)))
    near = F.least(F.col("p50") - F.col("p25"), F.col("p75") - F.col("p50"))
    wide = read.groupBy(*keys).agg(
        F.max("n").alias(f"{tag}_n"), *[F.max(F.when(F.col("measure") == m, F.col("p50"))).alias(f"{tag}_mid_{m}") for m in (*MEASURES, *SIZES)],
        *[F.max(F.when(F.col("measure") == m, near)).alias(f"near_{m}") for m in MEASURES],
    )
    step = {m: F.lit(float(one)) / F.greatest(F.col(f"{tag}_mid_{size}"), F.lit(1)) if size else F.lit(float(one)) for m, (size, one, _, _) in MEASURES.items()}
    reach = {m: F.greatest(F.lit(float(REACH)) * F.col(f"near_{m}"), F.lit(MEASURES[m][2]) * step[m]) for m in MEASURES}
    return wide.select(*keys, f"{tag}_n", *(F.col(f"{tag}_mid_{m}").cast("double").alias(f"{tag}_mid_{m}") for m in MEASURES), *(reach[m].alias(f"{tag}_reach_{m}") for m in MEASURES))


def cutoffs(fine: DataFrame) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>) from the sketches of all languages and sources.

    Median and reach of a group are mixed with those of its language by the number of rows, and those of the language with those of all, so a small
    group follows its language and a large one itself. No cutoff lies beyond WIDE times the language's reach from the language's median, so a
    group that is mostly junk can't set its own rule.
    """
    by_lang = merge(fine, ("lang",))
    group, lang = centres(fine, ("lang", "source"), "g"), centres(by_lang, ("lang",), "l").withColumnRenamed("lang", "l_lang")
    table = group.join(lang, F.col("lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(centres(merge(by_lang, ()), (), "a")))  # the last is one row
    for tag, parent in (("l", "a"), ("g", "l")):
        mixed = lambda what: (F.col(f"{tag}_n") * F.col(f"{tag}_{what}") + F.lit(PRIOR) * F.col(f"{parent}_{what}")) / (F.col(f"{tag}_n") + F.lit(PRIOR))  # noqa: B023, E731
        table = table.withColumns({f"{tag}_{what}": mixed(what) for what in (f"{kind}_{m}" for kind in ("mid", "reach") for m in MEASURES)})
    both = {}
    for m in MEASURES:
        mid, reach, lang_mid, far = (F.col(f"{tag}_{kind}_{m}") for tag in "gl" for kind in ("mid", "reach"))
        both[f"high_{m}"] = F.least(mid + reach, lang_mid + F.lit(WIDE) * far)
        both[f"low_{m}"] = F.greatest(mid - reach, lang_mid - F.lit(WIDE) * far)
    return table.select("lang", "source", *(c.alias(name) for name, c in both.items()))


def judged(rows: DataFrame) -> DataFrame:
    """`measured` rows with `q_kept`: the fixed rules hold and no measure lies beyond the cutoffs of its language and source.

    Nulls of lang and source are groups of their own. A table without a row that passes the fixed rules has no cutoffs and keeps nothing.
    """
    cut = cutoffs(stored(sketches(rows), "quality-sketches"))
    cut = cut.select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), *(F.col(f"{side}_{m}").alias(f"q_{side}_{m}") for m in MEASURES for side in ("low", "high")))
    df = rows.join(cut, rows["lang"].eqNullSafe(cut["q_lang"]) & rows["source"].eqNullSafe(cut["q_source"]), "left")
    kept = ~F.col("q_failed")
    for m, (*_, cuts) in MEASURES.items():
        kept = kept & (F.col(f"q_{m}") <= F.col(f"q_high_{m}"))
        if cuts == "both":
            kept = kept & (F.col(f"q_{m}") >= F.col(f"q_low_{m}"))
    return df.select(*rows.columns, F.coalesce(kept, F.lit(False)).alias("q_kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of `docs(doc_id, text, lang, source)`: its counts, `base_failed` and `kept`.

    Null texts have no words and fail. Repeated rows are judged alike, each on its own. Empty tables give no rows. Other columns are ignored.
    """
    rows = measured(docs.select("doc_id", "text", "lang", "source")).drop("text")
    out = judged(stored(rows, "quality-measures"))
    return out.select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns, whatever these are called.

    Null, empty and short texts fail the fixed rules; long ones count whole. Equal rows are judged alike, and an empty table gives no rows.
    """
    packed = docs.select(F.struct("*").alias("q_row"), "text", "lang", "source")
    return judged(stored(measured(packed).drop("text"), "quality-measures")).filter("q_kept").select("q_row.*")
