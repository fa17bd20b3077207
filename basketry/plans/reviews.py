"""Review text: dataset, normalization, profiles, proxies, term weights, classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import month_label
from basketry.functions.text import (
    count_words_of, has_accented_latin, has_word, normalize_text, strip_text, text_length, word_count,
)
from basketry.functions.values import joined_set, ladder, pct
from basketry.operators.aggregates import unpivot_row
from basketry.operators.ordering import quantile_columns
from basketry.operators.quality import check_token_preserved
from basketry.operators.topk import top_n
from basketry.plans.models import balanced_weight
from basketry.session import discard, shuffle_partitions, stored

#: Bytes of text whose terms a task holds, and terms of a vocabulary that are broadcast.
PART_BYTES, FREQUENT = 8 << 20, 10_000

# Words a normalization must not lose.
NEGATIONS = ["não", "nao", "nunca", "sem"]
# Diagnostic Portuguese words.
MARKERS = [
    "não", "nao", "muito", "bom", "boa", "ótimo", "otimo", "ótima", "otima", "produto", "entrega", "chegou",
    "prazo", "recomendo", "obrigado", "obrigada", "ruim", "problema", "perfeito", "perfeita", "qualidade",
    "gostei", "gosta", "compra", "comprar", "vendedor", "pedido",
]


def review_dataset(
    reviews: DataFrame, orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """One row per review observation: text, length, customer, product and seller counts, category set."""

    def part(col: str) -> Column:
        return strip_text(F.coalesce(F.col(col), F.lit(""))) if col in reviews.columns else F.lit("")

    text = strip_text(F.concat_ws(" ", part("review_comment_title"), part("review_comment_message")))
    base = reviews.withColumn("review_text", text).withColumns(
        {"has_review_text": F.col("review_text") != "", "review_text_length": text_length(F.col("review_text"))}
    )
    if "review_answer_timestamp" not in base.columns:
        base = base.withColumn("review_answer_timestamp", F.lit(None).cast("timestamp_ntz"))
    owner = orders.select("order_id", "customer_id", "order_purchase_timestamp").join(
        customers.select("customer_id", "customer_unique_id").dropDuplicates(["customer_id"]), "customer_id", "left"
    )
    lines = items.select("order_id", "product_id", "seller_id").distinct()
    lines = lines.join(products.select("product_id", "product_category_name").dropDuplicates(["product_id"]), "product_id", "left")
    context = lines.groupBy("order_id").agg(
        F.countDistinct("product_id").alias("product_count"), F.countDistinct("seller_id").alias("seller_count")
    )
    categories = lines.filter(F.col("product_category_name").isNotNull()).groupBy("order_id").agg(
        joined_set(F.col("product_category_name")).alias("product_categories")
    )
    return (
        base.join(owner, "order_id", "left")
        .join(context, "order_id", "left")
        .join(categories, "order_id", "left")
        .select(
            "review_observation_id", "review_id", "order_id", "customer_unique_id", "review_score", "review_text",
            "has_review_text", "review_text_length", "review_creation_date", "review_answer_timestamp",
            "order_purchase_timestamp", "product_count", "seller_count", "product_categories",
        )
    )


def prepared_reviews(dataset: DataFrame, nfkc: bool = True) -> DataFrame:
    """Adds the normalized text and whether any is left."""
    text = strip_text(F.coalesce(F.col("review_text"), F.lit("")))
    ready = dataset.withColumn("review_text", text).withColumn(
        "review_text_normalized", normalize_text(F.col("review_text"), nfkc)
    )
    # normalizing keeps every word, so a text is left exactly where there was one
    return ready.withColumn("has_normalized_text", F.col("review_text") != "")


def normalization_report(prepared: DataFrame) -> DataFrame:
    """Texts before and after normalization and how many changed."""
    return prepared.agg(
        F.count_if(F.col("review_text") != "").alias("original_text_rows"),
        F.count_if(F.col("has_normalized_text")).alias("normalized_text_rows"),
        F.count_if(F.col("review_text") != F.col("review_text_normalized")).alias("changed_rows"),
        pct(F.count_if(F.col("has_normalized_text")), F.count(F.lit(1))).alias("coverage_pct"),
    )


def negation_report(prepared: DataFrame, words: Sequence[str] = tuple(NEGATIONS)) -> DataFrame:
    return check_token_preserved(prepared, "review_text", "review_text_normalized", list(words))


def text_profile(dataset: DataFrame, **limits: int) -> DataFrame:
    """The profile as (metric, value) rows.

    Repeated texts are counted through their hash, so the shuffle carries no texts.
    """
    text = strip_text(F.coalesce(F.col("review_text"), F.lit("")))
    slim = dataset.select(
        "review_id", "review_score", (text != "").alias("has_text"), text_length(text).alias("chars"),
        word_count(text).alias("words"), F.sha2(text, 256).alias("digest"),
    )
    written = slim.filter("has_text")
    row = slim.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("has_text").alias("reviews_with_text"),
        F.avg(F.when(F.col("has_text"), F.col("chars"))).alias("mean_text_length_chars"),
        F.avg("review_score").alias("mean_review_score"),
    )
    ids = slim.agg(F.countDistinct("review_id").alias("unique_review_id"))
    texts = written.select("digest").distinct().agg(F.count(F.lit(1)).alias("unique_text_strings"))
    medians = quantile_columns(
        written, {"median_text_length_chars": ("chars", 0.5), "median_word_count": ("words", 0.5)}, **limits
    )
    for part in (ids, texts, medians):
        row = row.crossJoin(F.broadcast(part))
    rows, with_text = F.col("rows"), F.col("reviews_with_text")
    metrics = {
        "rows": rows,
        "unique_review_id": F.col("unique_review_id"),
        "duplicate_review_id_observations": rows - F.col("unique_review_id"),
        "reviews_with_text": with_text,
        "reviews_without_text": rows - with_text,
        "text_coverage_pct": pct(with_text, rows),
        "median_text_length_chars": F.col("median_text_length_chars"),
        "mean_text_length_chars": F.col("mean_text_length_chars"),
        "median_word_count": F.col("median_word_count"),
        "mean_review_score": F.col("mean_review_score"),
        "unique_text_strings": F.col("unique_text_strings"),
        "repeated_text_observations": with_text - F.col("unique_text_strings"),
    }
    return unpivot_row(row, "metric", {m: {"value": v.cast("double")} for m, v in metrics.items()})


def coverage_by_score(dataset: DataFrame, **limits: int) -> DataFrame:
    """Per score: reviews, texts, coverage, length statistics of the texts."""
    text = strip_text(F.coalesce(F.col("review_text"), F.lit("")))
    slim = dataset.select("review_score", F.when(text != "", text_length(text)).alias("chars"))
    table = slim.groupBy("review_score").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count("chars").alias("with_text"),
        F.avg("chars").alias("mean_length"),
        F.min("chars").alias("min_length"),
        F.max("chars").alias("max_length"),
    )
    medians = quantile_columns(slim, {"median_length": ("chars", 0.5)}, "review_score", **limits)
    return table.join(medians, "review_score", "left").withColumn(
        "text_coverage_pct", pct(F.col("with_text"), F.col("reviews"))
    )


def coverage_by_month(dataset: DataFrame) -> DataFrame:
    """Per month: reviews, texts, mean score, coverage."""
    table = dataset.groupBy(month_label(F.col("review_creation_date")).alias("review_month")).agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(strip_text(F.coalesce(F.col("review_text"), F.lit(""))) != "").alias("text_reviews"),
        F.avg("review_score").alias("avg_score"),
    )
    return table.withColumn("text_coverage_pct", pct(F.col("text_reviews"), F.col("reviews")))


def repeated_texts(dataset: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent texts."""
    text = strip_text(F.coalesce(F.col("review_text"), F.lit("")))
    counts = dataset.select(text.alias("review_text")).filter("review_text <> ''").groupBy("review_text").agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    return top_n(counts, "occurrences", n, "review_text")


def language_profile(dataset: DataFrame, markers: Sequence[str] = tuple(MARKERS)) -> DataFrame:
    """Character and marker-word evidence as (metric, value) rows. Evidence, not a language classifier."""
    texts = _written(dataset)
    text = F.col("text")
    every = dataset.agg(F.count(F.lit(1)).alias("n_all"))
    row = texts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_accented_latin(text)).alias("accented"),
        F.count_if(count_words_of(F.lower(text), list(markers)) > 0).alias("marked"),
        F.count_if(F.contains(text, F.lit("?"))).alias("question"),
        F.count_if(F.contains(text, F.lit("!"))).alias("exclamation"),
    ).crossJoin(F.broadcast(every))
    n = F.col("n")
    metrics = {
        "all_review_observations": F.col("n_all"),
        "text_bearing_observations": n,
        "accented_latin_texts": F.col("accented"),
        "accented_latin_pct": pct(F.col("accented"), n),
        "texts_with_portuguese_indicator": F.col("marked"),
        "portuguese_indicator_pct": pct(F.col("marked"), n),
        "texts_with_question_mark": F.col("question"),
        "texts_with_exclamation_mark": F.col("exclamation"),
    }
    return unpivot_row(row, "metric", {m: {"value": v.cast("double")} for m, v in metrics.items()})


def _written(dataset: DataFrame) -> DataFrame:
    text = strip_text(F.coalesce(F.col("review_text"), F.lit("")))
    return dataset.select(text.alias("text")).filter("text <> ''")


def marker_coverage(dataset: DataFrame, markers: Sequence[str] = tuple(MARKERS)) -> DataFrame:
    """Texts per marker word, most frequent first; all markers are counted in one pass."""
    low = F.lower(F.col("text"))
    row = _written(dataset).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(has_word(low, m)).alias(f"m{i}") for i, m in enumerate(markers)]
    )
    cells = {
        m: {"count": F.col(f"m{i}"), "coverage_pct": F.coalesce(pct(F.col(f"m{i}"), F.col("__n")), F.lit(0.0))}
        for i, m in enumerate(markers)
    }
    return unpivot_row(row, "marker", cells).orderBy(F.desc("count"), "marker")


def dissatisfaction(score: Column) -> Column:
    """Two-class proxy of a rating."""
    return F.when(score <= 2, "negative").otherwise("not_negative")


def sentiment3(score: Column) -> Column:
    """Three-class proxy of a rating."""
    return ladder([(score <= 2, "negative"), (score == 3, "neutral")], "positive")


def _grams(words: Column, n: int) -> Column:
    """All runs of n neighbouring words: the runs of n - 1, each with the word after it."""
    if n == 1:
        return words
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    pairs = F.zip_with(
        F.slice(_grams(words, n - 1), 1, count), F.slice(words, n, count), lambda run, word: F.concat_ws(" ", run, word)
    )
    return F.when(F.size(words) >= n, pairs).otherwise(F.array().cast("array<string>"))


def terms(text: Column, ngrams: tuple[int, int] = (1, 2)) -> Column:
    """Words of at least two characters and their n-grams, as one array with repeats."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    # bound as a lambda's variable, the words are found once and not once for each use
    grams = F.transform(F.array(words), lambda w: F.concat(*[_grams(w, n) for n in range(ngrams[0], ngrams[1] + 1)]))
    return F.flatten(grams)


def text_parts(docs: DataFrame, text: str) -> tuple[int, int]:
    """Number of documents, and of partitions that hold about `PART_BYTES` of text each: what a task holds doesn't grow with the table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    return row["n"], max(1, -(-(row["bytes"] or 0) // PART_BYTES))


def document_terms(docs: DataFrame, id: str, text: str, ngrams: tuple[int, int] = (1, 2), parts: int | None = None) -> DataFrame:
    """(document, terms): the terms of all texts under one id, with repeats. Texts move once, by document, into `parts` if given."""
    named = docs.filter(F.col(id).isNotNull()).select(id, text)
    texts = (named.repartition(parts, id) if parts else named).groupBy(id).agg(F.collect_list(text).alias("texts"))
    return texts.select(id, F.flatten(F.transform("texts", lambda t: terms(t, ngrams))).alias("terms"))


def _runs(words: Column) -> Column:
    """Distinct entries of an array and how often each occurs, without leaving the row: the runs of the sorted array."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(
            F.array(starts),
            lambda at: F.transform(at, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(s)) - i).cast("long").alias("tf"))),
        )

    # as lambdas' variables, the sorted array and its starts are found once
    return F.flatten(F.flatten(F.transform(F.filter(F.array(F.sort_array(words)), lambda s: F.size(s) > 0), of_sorted)))


def term_counts(docs: DataFrame, id: str, text: str, ngrams: tuple[int, int] = (1, 2), parts: int | None = None) -> DataFrame:
    """(document, term, tf).

    Texts are hashed by document first: that moves each text once, and everything
    done per document afterwards, this count included, needs no shuffle of its many terms. Texts without an id count as one document, which
    may be large, so its terms are counted by an aggregate.
    """
    known = document_terms(docs, id, text, ngrams, parts).select(id, F.inline(_runs(F.col("terms"))))
    rest = docs.filter(F.col(id).isNull()).select(id, F.explode(terms(F.col(text), ngrams)).alias("term"))
    return known.unionByName(rest.groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(counts: DataFrame, documents: int, min_df: int = 2, max_df: float = 0.95, max_terms: int | None = 100_000) -> DataFrame:
    """(term, df, idf) of the kept terms: document frequency within bounds, then the most frequent ones.

    `max_terms` is a parameter of the model, ties at its end go by term.
    """
    kept = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(
        (F.col("df") >= min_df) & (F.col("df") <= max_df * documents)
    )
    if max_terms is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_terms)
    smooth = F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1.0
    return kept.select("term", "df", smooth.alias("idf"))


def tfidf(
    docs: DataFrame, id: str, text: str, min_df: int = 2, max_df: float = 0.95, ngrams: tuple[int, int] = (1, 2),
    max_terms: int | None = 100_000, vocab: DataFrame | None = None,
) -> DataFrame:
    """(document, term, weight): sublinear tf × smoothed idf, each document scaled to length one.

    Every step has partitions in proportion to the texts, so what a task holds stays the same for larger tables. The vocabulary may be of any size:
    its most frequent terms, a bounded number, are broadcast; their rows are dealt by document, the others by term, and joined with it.
    """
    documents, parts = text_parts(docs, text)
    counts = term_counts(docs, id, text, ngrams, parts)
    if vocab is None:
        with shuffle_partitions(docs.sparkSession, parts):
            vocab = stored(vocabulary(counts, documents, min_df, max_df, max_terms), "vocabulary")
    often = vocab.orderBy(F.asc("idf"), "term").limit(FREQUENT).select("term", F.col("idf").alias("__often"))
    found = counts.join(F.broadcast(often), "term", "left")
    # no term begins with a space, so the rows of frequent terms meet no row of the vocabulary
    place = F.when(F.col("__often").isNull(), F.col("term")).otherwise(F.concat(F.lit(" "), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    own = F.when(F.col("__often").isNotNull(), F.col("term")).alias("__own")
    dealt = found.select(id, "tf", "__often", own, place.alias("__place")).repartition(parts, "__place")
    weighed = dealt.join(vocab.select(F.col("term").alias("__place"), "idf"), "__place", "left").withColumn("__idf", F.coalesce("__often", "idf"))
    raw = weighed.filter("__idf IS NOT NULL").select(id, F.coalesce("__own", "__place").alias("term"), ((1.0 + F.log(F.col("tf").cast("double"))) * F.col("__idf")).alias("w"))
    # the window sees the terms of one document
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id)))
    return raw.repartition(parts, id).select(id, "term", (F.col("w") / norm).alias("weight"))


def term_vectors(docs: DataFrame, id: str, text: str, vocab: Sequence[tuple[str, float]], name: str = "features") -> DataFrame:
    """One sparse vector per document over the (term, idf) of `vocab`; a document without known terms or without id gets the empty vector.

    Terms are looked up and weighed where a document's text lies, so no term is shuffled.
    """
    # no term is empty, so an empty vocabulary still has one slot
    slots, idf = [t for t, _ in vocab] or [""], np.array([v for _, v in vocab] or [1.0])
    size = len(slots)

    @F.udf(VectorUDT())
    def weighed(counts):
        if counts is None:
            return Vectors.sparse(size, [], [])
        w = (1.0 + np.log(counts.values)) * idf[counts.indices]
        return Vectors.sparse(size, counts.indices, w / np.sqrt(w @ w))

    counted = CountVectorizerModel.from_vocabulary(slots, "terms", "__counts").transform(document_terms(docs, id, text))
    return docs.join(counted.select(id, "__counts"), id, "left").withColumn(name, weighed("__counts")).drop("__counts")


class TextClassifier:
    """Term-weight classifier: a vocabulary with weights, in the order of its slots, and a fitted logistic model."""

    def __init__(self, vocab: list[tuple[str, float]], model, classes: list[str]):
        self.vocab, self.model, self.classes = vocab, model, classes

    def predict(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        vectors = term_vectors(docs, id, text, self.vocab)
        names = F.array(*[F.lit(c) for c in self.classes])
        out = self.model.transform(vectors)
        return out.withColumn("predicted_class", F.element_at(names, F.col("prediction").cast("int") + 1)).drop(
            "features", "rawPrediction", "prediction"
        )


def fit_text_classifier(
    train: DataFrame, id: str, text: str, label: str, classes: Sequence[str], max_terms: int = 100_000, max_iter: int = 2000
) -> TextClassifier:
    """Logistic regression on term weights; class i of `classes` is label value i.

    The vocabulary, at most `max_terms` rows, is collected once, so that training and prediction number its terms alike. The vectors are
    stored for the fit, which reads them more than once.
    """
    rows, parts = text_parts(train, text)
    kept = vocabulary(term_counts(train, id, text, parts=parts), rows, max_terms=max_terms)
    with shuffle_partitions(train.sparkSession, parts):
        vocab = [(r["term"], r["idf"]) for r in kept.orderBy("term").select("term", "idf").collect()]
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    vectors = stored(term_vectors(train.withColumn("__y", index.cast("double")), id, text, vocab).select("__y", "features"), "term-vectors")
    model = LogisticRegression(
        featuresCol="features", labelCol="__y", regParam=1.0 / rows, standardization=False, maxIter=max_iter,
        family="multinomial" if len(classes) > 2 else "binomial",
    ).fit(vectors)
    discard(vectors)
    return TextClassifier(vocab, model, list(classes))


def fit_embedding_classifier(train: DataFrame, vec: str, target: str, max_iter: int = 2000) -> PipelineModel:
    """Balanced logistic regression on scaled embedding vectors; the vector column is named `embedding_vector`."""
    rows = train.count()
    data = balanced_weight(embedding_vectors(train, vec), target)
    scaler = StandardScaler(inputCol="embedding_vector", outputCol="scaled_vector", withMean=True, withStd=True).fit(data)
    # Spark divides by the sample deviation; this makes it the population one
    factor = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    widen = ElementwiseProduct(scalingVec=Vectors.dense([factor] * scaler.mean.size), inputCol="scaled_vector", outputCol="features")
    model = LogisticRegression(
        featuresCol="features", labelCol=target, weightCol="class_weight", regParam=1.0 / rows, standardization=False,
        maxIter=max_iter,
    ).fit(widen.transform(scaler.transform(data)))
    return PipelineModel([scaler, widen, model])


def embedding_vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("embedding_vector", array_to_vector(F.col(vec).cast("array<double>")))
