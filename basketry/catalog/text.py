"""Review text and voice of customer."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.catalog.cleaning import SPACE
from basketry.functions import text as t
from basketry.operators.topk import top_n_per_group
from basketry.plans import metrics, retention, reviews, voc
from basketry.plans.reviews import MARKERS, NEGATIONS
from basketry.session import scratch_path
from basketry.sources.tables import write_records


def _r(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def stripped(col: str) -> str:
    return rf"regexp_replace({col}, '^{SPACE}|{SPACE}$', '', 'g')"


def word_at(col: str, word: str) -> str:
    return rf"regexp_matches({col}, '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]){word}($|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])')"


TEXTS = f"(SELECT *, {stripped('coalesce(review_comment_message, chr(32))')} AS review_text FROM x_reviews)"
NORMAL = (
    rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(review_text), '{SPACE}', ' ', 'g'), '!{{2,}}', '!', 'g'),
    '\?{{2,}}', '?', 'g'), '\.{{3,}}', '...', 'g'), '^ | $', '', 'g')"""
)


def _dataset(x):
    tb = x.tables
    return reviews.review_dataset(tb["reviews"], tb["orders"], tb["customers"], tb["items"], tb["products"])


def _texts(x):
    """The columns of the review dataset that text operators need."""
    text = t.strip_text(F.coalesce("review_comment_message", F.lit("")))
    return x["x_reviews"].withColumn("review_text", text)


@query("review_dataset", "N1 D11 H12", f"""
    SELECT r.review_observation_id, r.review_id, r.order_id, c.customer_unique_id, r.review_score, r.review_text, r.review_text <> '' AS has_review_text,
      length(r.review_text) AS review_text_length, r.review_creation_date, NULL::TIMESTAMP AS review_answer_timestamp, o.order_purchase_timestamp,
      i.product_count, i.seller_count, i.product_categories
    FROM {TEXTS} r LEFT JOIN x_orders o ON o.order_id = r.order_id LEFT JOIN x_customers c ON c.customer_id = o.customer_id
    LEFT JOIN (SELECT order_id, count(DISTINCT product_id) AS product_count, count(DISTINCT seller_id) AS seller_count,
        string_agg(DISTINCT product_category_name, ' | ' ORDER BY product_category_name) AS product_categories
      FROM x_order_items LEFT JOIN x_products USING (product_id) GROUP BY 1) i ON i.order_id = r.order_id""")
def review_dataset(x):
    return _dataset(x)


@query("normalized_text", "N2", f"SELECT review_observation_id, {NORMAL} AS normalized FROM {TEXTS}")
def normalized_text(x):
    return _texts(x).select("review_observation_id", t.normalize_text(F.col("review_text")).alias("normalized"))


@query("normalized_text_nfkc", "N2 P2", f"SELECT review_observation_id, {NORMAL.replace('lower(review_text)', 'lower(review_text)')} AS normalized FROM {TEXTS}")
def normalized_text_nfkc(x):
    """The supplied texts are in composed form already, so compatibility composition keeps them."""
    return _texts(x).select("review_observation_id", t.normalize_text(F.col("review_text"), nfkc=True).alias("normalized"))


@query("normalization_report", "N3 D2", f"""
    SELECT count(*) FILTER (review_text <> '') AS original_text_rows, count(*) FILTER (n <> '') AS normalized_text_rows, count(*) FILTER (review_text <> n) AS changed_rows,
      100.0::DOUBLE * count(*) FILTER (n <> '') / count(*) AS coverage_pct FROM (SELECT *, {NORMAL} AS n FROM {TEXTS})""")
def normalization_report(x):
    return reviews.normalization_report(reviews.prepared_reviews(_texts(x), nfkc=False))


WORDS = [*NEGATIONS, "de", "the", "la"]


@query("negation_report", "N3 I20", " UNION ALL ".join(
    f"""SELECT '{w}' AS word, count(*) FILTER ({word_at("lower(review_text)", w)}) AS original_count, count(*) FILTER ({word_at("n", w)}) AS normalized_count,
      CASE WHEN count(*) FILTER ({word_at("lower(review_text)", w)}) = count(*) FILTER ({word_at("n", w)}) THEN 'PASS' ELSE 'FAIL' END AS status
      FROM (SELECT *, {NORMAL} AS n FROM {TEXTS})""" for w in WORDS))
def negation_report(x):
    return reviews.negation_report(reviews.prepared_reviews(_texts(x), nfkc=False), WORDS)


WORDCOUNT = rf"len(list_filter(string_split_regex(review_text, '{SPACE}'), lambda w: w <> ''))"


@query("text_profile", "N4", f"""
    SELECT unnest(['rows', 'unique_review_id', 'duplicate_review_id_observations', 'reviews_with_text', 'reviews_without_text', 'text_coverage_pct', 'median_text_length_chars',
        'mean_text_length_chars', 'median_word_count', 'mean_review_score', 'unique_text_strings', 'repeated_text_observations']) AS metric,
      round(unnest([n, ids, n - ids, w, n - w, 100.0::DOUBLE * w / n, ml, al, mw, ms, u, w - u]::DOUBLE[]), 9) AS value FROM (
      SELECT count(*) AS n, count(DISTINCT review_id) AS ids, count(*) FILTER (review_text <> '') AS w, median(length(review_text)) FILTER (review_text <> '') AS ml,
        avg(length(review_text)) FILTER (review_text <> '') AS al, median({WORDCOUNT}) FILTER (review_text <> '') AS mw, avg(review_score) AS ms,
        count(DISTINCT review_text) FILTER (review_text <> '') AS u FROM {TEXTS})""")
def text_profile(x):
    return _r(reviews.text_profile(_texts(x)), "value")


@query("coverage_by_score", "N4", f"""
    SELECT review_score, count(*) AS reviews, count(*) FILTER (review_text <> '') AS with_text, avg(length(review_text)) FILTER (review_text <> '') AS mean_length,
      min(length(review_text)) FILTER (review_text <> '') AS min_length, max(length(review_text)) FILTER (review_text <> '') AS max_length,
      median(length(review_text)) FILTER (review_text <> '') AS median_length, 100.0::DOUBLE * count(*) FILTER (review_text <> '') / count(*) AS text_coverage_pct FROM {TEXTS} GROUP BY 1""")
def coverage_by_score(x):
    return reviews.coverage_by_score(_texts(x))


@query("coverage_by_month", "N4", f"""
    SELECT strftime(review_creation_date, '%Y-%m') AS review_month, count(*) AS reviews, count(*) FILTER (review_text <> '') AS text_reviews, avg(review_score) AS avg_score,
      100.0::DOUBLE * count(*) FILTER (review_text <> '') / count(*) AS text_coverage_pct FROM {TEXTS} GROUP BY 1""")
def coverage_by_month(x):
    return reviews.coverage_by_month(_texts(x))


@query("repeated_texts", "N4 F2", f"""
    SELECT review_text, count(*) AS occurrences FROM {TEXTS} WHERE review_text <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def repeated_texts(x):
    return reviews.repeated_texts(_texts(x))


FOUND = ["de", "la", "the", "un", "y", "não", "bom"]
ANY_FOUND = word_at("lower(review_text)", "(" + "|".join(FOUND) + ")")


@query("language_profile", "N5", rf"""
    SELECT unnest(['all_review_observations', 'text_bearing_observations', 'accented_latin_texts', 'accented_latin_pct', 'texts_with_portuguese_indicator',
        'portuguese_indicator_pct', 'texts_with_question_mark', 'texts_with_exclamation_mark']) AS metric,
      unnest([n, w, a, 100.0::DOUBLE * a / w, p, 100.0::DOUBLE * p / w, q, e]::DOUBLE[]) AS value FROM (
      SELECT count(*) AS n, count(*) FILTER (review_text <> '') AS w, count(*) FILTER (regexp_matches(regexp_replace(review_text, '[\x00-\x7F]', '', 'g'), '\p{{Latin}}')) AS a,
        count(*) FILTER ({ANY_FOUND}) AS p, count(*) FILTER (contains(review_text, '?')) AS q, count(*) FILTER (contains(review_text, '!')) AS e FROM {TEXTS})""")
def language_profile(x):
    return reviews.language_profile(_texts(x), FOUND)


@query("marker_coverage", "N5 H12", " UNION ALL ".join(
    f"""SELECT '{w}' AS marker, count(*) FILTER ({word_at("lower(review_text)", w)}) AS count,
      100.0::DOUBLE * count(*) FILTER ({word_at("lower(review_text)", w)}) / count(*) AS coverage_pct FROM {TEXTS} WHERE review_text <> ''""" for w in [*FOUND[:5], *MARKERS]))
def marker_coverage(x):
    return reviews.marker_coverage(_texts(x), [*FOUND[:5], *MARKERS])


@query("rating_proxies", "N6 P2", """
    SELECT review_observation_id, CASE WHEN review_score <= 2 THEN 'negative' ELSE 'not_negative' END AS binary_proxy,
      CASE WHEN review_score <= 2 THEN 'negative' WHEN review_score = 3 THEN 'neutral' ELSE 'positive' END AS three_way FROM x_reviews""")
def rating_proxies(x):
    s = F.col("review_score")
    return x["x_reviews"].select("review_observation_id", reviews.dissatisfaction(s).alias("binary_proxy"), reviews.sentiment3(s).alias("three_way"))


TRAIN_END, VALID_END = "2000-08-31", "2000-10-31"


@query("text_split", "N7", f"""
    SELECT CASE WHEN review_creation_date <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN review_creation_date <= TIMESTAMP '{VALID_END}' THEN 'validation' ELSE 'test' END AS split,
      count(*) AS rows, min(review_creation_date) AS first_date, max(review_creation_date) AS last_date FROM {TEXTS} WHERE review_text <> '' GROUP BY 1""")
def text_split(x):
    df = retention.temporal_split(_texts(x).filter("review_text <> ''"), "review_creation_date", TRAIN_END, VALID_END)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("review_creation_date").alias("first_date"), F.max("review_creation_date").alias("last_date"))


# Terms on the DuckDB side: words of two or more word characters, then pairs of neighbours.
TERMS = rf"""
    SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (
      SELECT id, list_filter(regexp_extract_all(n, '{WORD}+'), lambda v: length(v) >= 2) AS w FROM (
        SELECT review_observation_id AS id, {NORMAL} AS n FROM {TEXTS}) WHERE n <> '')"""


@query("tfidf_weights", "N8", rf"""
    WITH tf AS (SELECT id, term, count(*) AS tf FROM ({TERMS}) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM (SELECT 1 FROM (SELECT {NORMAL} AS z FROM {TEXTS}) WHERE z <> '')),
    v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)),
    w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term)),
    u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)
    SELECT id, count(*) AS terms, round(sum(weight), 5) AS total, round(max(weight), 7) AS most, min(term) AS first_term, max(term) AS last_term FROM u GROUP BY 1""")
def tfidf_weights(x):
    """All weights are computed; they are compared per document."""
    docs = reviews.prepared_reviews(_texts(x), nfkc=False).filter("has_normalized_text").select(
        F.col("review_observation_id").alias("id"), F.col("review_text_normalized").alias("text")
    )
    weights = reviews.tfidf(docs, "id", "text", max_terms=None)
    return weights.groupBy("id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 7).alias("most"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"),
    )


def _prepared(x):
    df = reviews.prepared_reviews(_texts(x), nfkc=True).filter("has_normalized_text")
    df = df.withColumns({"proxy": reviews.dissatisfaction(F.col("review_score")), "sentiment": reviews.sentiment3(F.col("review_score"))}).select(
        "review_observation_id", "review_text_normalized", "proxy", "sentiment", "review_creation_date"
    )
    return x.stored(retention.temporal_split(df, "review_creation_date", TRAIN_END, VALID_END), "review-texts")


@query("text_classifier", "N9 M20")
def text_classifier(x):
    df = _prepared(x)
    model = reviews.fit_text_classifier(
        df.filter("split = 'train'"), "review_observation_id", "review_text_normalized", "proxy", ["negative", "not_negative"]
    )
    scored = model.predict(df.filter("split <> 'train'"), "review_observation_id", "review_text_normalized")
    return metrics.classification_report(scored, "proxy", "predicted_class")


def _text_scores(x, label, classes):
    df = _prepared(x)
    model = reviews.fit_text_classifier(df.filter("split = 'train'"), "review_observation_id", "review_text_normalized", label, classes)
    return model.predict(df.filter("split <> 'train'"), "review_observation_id", "review_text_normalized")


@query("text_classifier_three", "N6 N9 M20")
def text_classifier_three(x):
    """Negative, neutral and positive reviews by their text."""
    return metrics.classification_report(_text_scores(x, "sentiment", ["negative", "neutral", "positive"]), "sentiment", "predicted_class")


@query("text_ranking", "N9 M12 M13")
def text_ranking(x):
    """How well the text model ranks negative reviews, per split."""
    scored = _text_scores(x, "proxy", ["negative", "not_negative"])
    rows = x.stored(
        scored.select("split", F.col("review_observation_id").alias("id"), (F.col("proxy") == "negative").cast("int").alias("y"), vector_to_array("probability")[0].alias("p")),
        "text-scores",
    )
    return metrics.roc_auc(rows, "p", "y", "split").join(metrics.average_precision(rows, "p", "y", "split"), "split")


@query("embedding_classifier", "N10 M12")
def embedding_classifier(x):
    from basketry.plans.models import positive_probability

    rated = x["embeddings"].join(x["x_reviews"], F.col("vec_id") == F.col("review_observation_id")).select(
        "vec_id", "embedding", (F.col("review_score") <= 2).cast("int").alias("target"), "review_creation_date"
    )
    df = x.stored(retention.temporal_split(rated, "review_creation_date", TRAIN_END, VALID_END), "review-embeddings")
    model = reviews.fit_embedding_classifier(df.filter("split = 'train'"), "embedding", "target")
    scored = model.transform(reviews.embedding_vectors(df, "embedding")).select("split", "target", positive_probability().alias("p"))
    return metrics.roc_auc(scored, "p", "target", "split").join(metrics.average_precision(scored, "p", "target", "split"), "split")


@query("theme_discovery", "N11 M5")
def theme_discovery(x):
    labelled, results = voc.discover_themes(x["embeddings"], "embedding")
    rated = labelled.join(x["x_reviews"].select(F.col("review_observation_id").alias("vec_id"), "review_score"), "vec_id")
    profile = voc.theme_profile(rated)
    return profile.select(F.lit("profile").alias("kind"), F.col("cluster").alias("k"), F.col("share").alias("value")).unionByName(
        results.select(F.lit("silhouette").alias("kind"), "k", F.col("silhouette").alias("value"))
    )


@query("theme_profile", "N11", """
    SELECT semantic_theme_cluster AS cluster, count(*) AS review_count, avg(review_score) AS mean_review_score, avg((review_score <= 2)::INTEGER) AS negative_rate,
      avg((review_score = 3)::INTEGER) AS neutral_rate, avg((review_score >= 4)::INTEGER) AS positive_rate, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM x_reviews GROUP BY 1""")
def theme_profile(x):
    return voc.theme_profile(x["x_reviews"])


@query("theme_representatives", "N12 F4", """
    WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2),
    d AS (SELECT vec_id, label, 1 - sum(v * m) / sqrt(sum(v * v) * sum(m * m)) AS dist FROM e JOIN c USING (label, i) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM d)
    SELECT vec_id, label, rank, round(dist, 8) AS distance_to_centroid FROM r WHERE rank <= 15""")
def theme_representatives(x):
    df = voc.representatives(x["embeddings"], "embedding", "label", "vec_id", 15)
    return _r(df.select("vec_id", "label", "rank", "distance_to_centroid"), "distance_to_centroid", digits=8)


TRENDS = """
    SELECT *, theme_share - lag(theme_share) OVER w AS theme_share_mom_change,
      theme_dissatisfaction_rate - lag(theme_dissatisfaction_rate) OVER w AS dissatisfaction_rate_mom_change FROM (
      SELECT *, review_count::DOUBLE / total_reviews AS theme_share, dissatisfied_reviews::DOUBLE / review_count AS theme_dissatisfaction_rate,
        total_dissatisfied::DOUBLE / total_reviews AS overall_month_dissatisfaction_rate FROM (
        SELECT period, theme_name, count(*) AS review_count, avg(review_score) AS mean_review_score, count(*) FILTER (review_score <= 2) AS dissatisfied_reviews,
          sum(count(*)) OVER (PARTITION BY period)::BIGINT AS total_reviews, sum(count(*) FILTER (review_score <= 2)) OVER (PARTITION BY period)::BIGINT AS total_dissatisfied
        FROM x_theme_events GROUP BY 1, 2)) WINDOW w AS (PARTITION BY theme_name ORDER BY period)"""


@query("theme_trends", "N13 E6 E11", TRENDS)
def theme_trends(x):
    return voc.theme_trends(x["x_theme_events"], "period", "theme_name")


@query("monthly_theme_trends", "N13 B11 B14", """
    WITH o AS (SELECT *, date_trunc('month', review_creation_date)::DATE AS month, CASE semantic_theme_cluster WHEN 0 THEN 'Overall Positive / Trust & Satisfaction'
        WHEN 1 THEN 'Positive Delivery & Fulfillment' WHEN 2 THEN 'Generic Positive Satisfaction' WHEN 3 THEN 'Delivery & Service Failures'
        WHEN 4 THEN 'Product Quality / Product Mismatch' ELSE 'Uninterpreted Semantic Cluster' END AS theme_name FROM x_reviews)
    SELECT month, semantic_theme_cluster, theme_name, count(*) AS review_count, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY month) AS theme_share,
      count(*) FILTER (review_score <= 2)::DOUBLE / count(*) AS theme_dissatisfaction_rate FROM o GROUP BY 1, 2, 3""")
def monthly_theme_trends(x):
    df = voc.theme_trends(voc.theme_observations(x["x_reviews"]), "month", ["semantic_theme_cluster", "theme_name"])
    return df.select("month", "semantic_theme_cluster", "theme_name", "review_count", "theme_share", "theme_dissatisfaction_rate")


@query("theme_summary", "N13", """
    SELECT theme_name, count(*) AS review_count, avg(review_score) AS mean_review_score, count(*) FILTER (review_score <= 2) AS dissatisfied_reviews,
      count(*)::DOUBLE / sum(count(*)) OVER () AS share, count(*) FILTER (review_score <= 2)::DOUBLE / count(*) AS dissatisfaction_rate FROM x_theme_events GROUP BY 1""")
def theme_summary(x):
    return voc.theme_summary(x["x_theme_events"], ["theme_name"])


ALERTS = f"""
    SELECT *, CASE alert_level WHEN 'HIGH' THEN '{voc.ACTIONS["HIGH"]}' WHEN 'WARNING' THEN '{voc.ACTIONS["WARNING"]}'
        WHEN 'NORMAL' THEN '{voc.ACTIONS["NORMAL"]}' ELSE '{voc.ACTIONS["INSUFFICIENT_HISTORY"]}' END AS recommended_action,
      least(1, greatest(0, 0.45 * coalesce(least(5, greatest(0, share_z_score)), 0) / 5 + 0.40 * coalesce(least(0.5, greatest(0, dissatisfaction_change)), 0) / 0.5
        + 0.15 * ln(1 + review_count) / ln(1 + max(review_count) OVER ()))) AS priority_score FROM (
      SELECT *, CASE WHEN NOT eligible_for_alert THEN 'INSUFFICIENT_HISTORY'
          WHEN coalesce(share_z_score >= 3, false) AND dissatisfaction_change >= 0.1 THEN 'HIGH' WHEN coalesce(share_z_score >= 2, false) AND dissatisfaction_change >= 0.2 THEN 'HIGH'
          WHEN coalesce(share_z_score >= 2, false) OR dissatisfaction_change >= 0.1 THEN 'WARNING' ELSE 'NORMAL' END AS alert_level FROM (
        SELECT period, theme_name, review_count, theme_share, base AS baseline_share, theme_share - base AS share_deviation,
          CASE WHEN sd > 0 THEN (theme_share - base) / sd END AS share_z_score, theme_dissatisfaction_rate, unhappy AS baseline_dissatisfaction,
          theme_dissatisfaction_rate - unhappy AS dissatisfaction_change, review_count >= 50 AND base IS NOT NULL AND unhappy IS NOT NULL AS eligible_for_alert FROM (
          SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(theme_share) OVER w END AS base, CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(theme_share) OVER w END AS sd,
            CASE WHEN count(*) OVER w >= 3 THEN avg(theme_dissatisfaction_rate) OVER w END AS unhappy FROM ({TRENDS})
          WINDOW w AS (PARTITION BY theme_name ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))))"""
ALERT_NUMBERS = ["baseline_share", "share_deviation", "share_z_score", "baseline_dissatisfaction", "dissatisfaction_change", "priority_score"]


def _alerts(x):
    return voc.theme_alerts(voc.theme_trends(x["x_theme_events"], "period", "theme_name"), "period", "theme_name", min_reviews=50)


@query("theme_alerts", "N14 E5 D16 P1 P4", f"""
    SELECT * EXCLUDE ({", ".join(ALERT_NUMBERS)}), {", ".join(f"round({c}, 7) AS {c}" for c in ALERT_NUMBERS)} FROM ({ALERTS})""")
def theme_alerts(x):
    return _r(_alerts(x), *ALERT_NUMBERS, digits=7)


# --- investigation: theme 3 over all reviews ---

CONTEXT = """
    SELECT r.*, o.order_status, c.customer_state, epoch(o.order_delivered_customer_date - o.order_estimated_delivery_date) / 86400 AS delivery_delay_days,
      epoch(o.order_delivered_customer_date - o.order_purchase_timestamp) / 86400 AS purchase_to_delivery_days,
      coalesce(o.order_delivered_customer_date > o.order_estimated_delivery_date, false) AS delivered_late,
      o.order_delivered_customer_date IS NOT NULL AS has_delivery_date, r.review_score <= 2 AS is_dissatisfied, r.semantic_theme_cluster = 3 AS is_target_theme
    FROM x_reviews r LEFT JOIN x_orders o ON o.order_id = r.order_id LEFT JOIN x_customers c ON c.customer_id = o.customer_id"""


def _context(x):
    tb = x.tables
    return voc.review_context(tb["reviews"], tb["orders"], tb["customers"], tb["items"], tb["products"], x["x_sellers"], target=3)


def _lines(x):
    return voc.line_context(x["x_order_items"], x["x_products"], x["x_sellers"])


@query("review_context", "C14 N15 P3", f"""
    SELECT v.review_observation_id, v.order_id, v.order_status, v.customer_state, v.delivery_delay_days, v.purchase_to_delivery_days, v.delivered_late, v.has_delivery_date,
      v.is_dissatisfied, v.is_target_theme, i.product_categories, i.seller_ids, i.seller_states FROM ({CONTEXT}) v
    LEFT JOIN (SELECT order_id, coalesce(string_agg(DISTINCT product_category_name, ' | ' ORDER BY product_category_name), '') AS product_categories,
        string_agg(DISTINCT seller_id::VARCHAR, ' | ' ORDER BY seller_id::VARCHAR) AS seller_ids, string_agg(DISTINCT seller_state, ' | ' ORDER BY seller_state) AS seller_states
      FROM x_order_items LEFT JOIN x_products USING (product_id) LEFT JOIN x_sellers USING (seller_id) GROUP BY 1) i ON i.order_id = v.order_id""")
def review_context(x):
    return _context(x).select(
        "review_observation_id", "order_id", "order_status", "customer_state", "delivery_delay_days", "purchase_to_delivery_days", "delivered_late",
        "has_delivery_date", "is_dissatisfied", "is_target_theme", "product_categories", "seller_ids", "seller_states",
    )


def _cause(dim: str, lines: bool, least: int) -> str:
    source = f"(SELECT v.*, l.{dim} FROM ({CONTEXT}) v JOIN (SELECT DISTINCT order_id, {dim} FROM x_order_items LEFT JOIN x_products USING (product_id) WHERE {dim} IS NOT NULL) l ON l.order_id = v.order_id)" if lines else f"({CONTEXT})"
    of = "FILTER (is_target_theme)" if lines else ""
    return f"""
    SELECT *, target_theme_count::DOUBLE / review_count AS target_theme_share, (target_theme_count::DOUBLE / review_count)
      / (SELECT count(*) FILTER (is_target_theme)::DOUBLE / count(*) FROM ({CONTEXT})) AS theme_share_lift FROM (
      SELECT {dim}, count(*) AS review_count, count(*) FILTER (is_target_theme) AS target_theme_count, avg(is_dissatisfied::INTEGER) {of} AS target_dissatisfaction,
        avg(delivered_late::INTEGER) {of} AS target_late_rate FROM {source} GROUP BY 1) WHERE target_theme_count >= {least}"""


@query("root_cause_category", "N15", _cause("product_category_name", True, 5))
def root_cause_category(x):
    return voc.root_cause(_context(x), "product_category_name", _lines(x), min_target=5)


@query("root_cause_seller", "N15", _cause("seller_id", True, 2))
def root_cause_seller(x):
    return voc.root_cause(_context(x), "seller_id", _lines(x), min_target=2)


@query("root_cause_state", "N15 D17", _cause("customer_state", False, 2))
def root_cause_state(x):
    return voc.root_cause(_context(x), "customer_state", min_target=2)


@query("root_cause_status", "N15 D17", _cause("order_status", False, 0))
def root_cause_status(x):
    return voc.root_cause(_context(x), "order_status", min_target=0)


@query("delivery_comparison", "N16", f"""
    SELECT 'All reviews' AS "group", count(*) AS review_count, round(avg(delivery_delay_days), 9) AS mean_delivery_delay_days, round(median(delivery_delay_days), 9) AS median_delivery_delay_days,
      avg(delivered_late::INTEGER) AS late_delivery_rate FROM ({CONTEXT}) UNION ALL
    SELECT 'Target theme reviews', count(*), round(avg(delivery_delay_days), 9), round(median(delivery_delay_days), 9), avg(delivered_late::INTEGER) FROM ({CONTEXT}) WHERE is_target_theme""")
def delivery_comparison(x):
    return _r(voc.delivery_comparison(_context(x)), "mean_delivery_delay_days", "median_delivery_delay_days")


@query("status_crosscheck", "N16 D17", f"""
    SELECT order_status, is_target_theme, count(*) AS review_count, avg(is_dissatisfied::INTEGER) AS dissatisfaction_rate, avg(delivered_late::INTEGER) AS late_delivery_rate
    FROM ({CONTEXT}) GROUP BY 1, 2""")
def status_crosscheck(x):
    return voc.status_crosscheck(_context(x))


# --- records: the alert of a theme is explained by the reviews of its first letters' cluster ---


def _reps(x):
    """Representative reviews per event theme: the five longest texts of one cluster each."""
    keyed = _texts(x).withColumn("cluster", F.get(F.array(*[F.lit(n) for n in THEMES]), F.col("semantic_theme_cluster") % len(THEMES)))
    order = [F.length("review_text").desc(), F.col("review_observation_id")]
    return top_n_per_group(keyed.select("cluster", "review_observation_id", "review_id", "order_id", "review_score", "review_text"), "cluster", order, 15)


THEMES = ["view", "click", "purchase", "error", "signup"]


def _high(x):
    """Alerts with every WARNING taken as HIGH, so that records exist on quiet data."""
    return _alerts(x).withColumn("alert_level", F.when(F.col("alert_level") == "WARNING", "HIGH").otherwise(F.col("alert_level")))


@query("decision_records", "N17 H15 F4", f"""
    WITH a AS ({ALERTS}), g AS (SELECT *, CASE semantic_theme_cluster % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' ELSE 'signup' END AS cluster FROM {TEXTS}),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length(review_text) DESC, review_observation_id) AS rank FROM g),
    e AS (SELECT cluster, count(*) AS n, string_agg(review_id::VARCHAR, ',' ORDER BY rank) AS ids FROM p WHERE rank <= 5 AND trim(review_text) <> '' GROUP BY 1)
    SELECT 'VOC-' || strftime(period, '%Y-%m') || '-CLUSTER-' || theme_name AS decision_id, review_count, round(priority_score, 7) AS priority_score,
      coalesce(n, 0)::INTEGER AS n_reviews, coalesce(ids, '') AS review_ids FROM a LEFT JOIN e ON e.cluster = a.theme_name WHERE alert_level IN ('HIGH', 'WARNING')""")
def decision_records(x):
    records = voc.decision_records(_high(x), _reps(x), "period", "theme_name", min_reviews=50)
    found = F.col("evidence.representative_reviews")
    return records.select(
        "decision_id", F.col("signal.review_count").alias("review_count"), F.round("signal.priority_score", 7).alias("priority_score"),
        F.size(found).alias("n_reviews"), F.array_join(F.transform(found, lambda v: v["review_id"]), ",").alias("review_ids"),
    )


@query("decision_record_sink", "N17 A8")
def decision_record_sink(x):
    path = scratch_path(x.spark, "decision-records")
    records = voc.decision_records(_high(x), _reps(x), "period", "theme_name", min_reviews=50)
    write_records(records, path)
    return x.spark.read.schema(records.schema).json(path).select("decision_id", "decision_type", "status", F.to_json("signal").alias("signal"))


def _leads(x):
    context = x.stored(_context(x), "review-context")
    lines = _lines(x)
    return context, {
        "product_categories": voc.root_cause(context, "product_category_name", lines, min_target=2),
        "sellers": voc.root_cause(context, "seller_id", lines, min_target=2),
        "customer_geographies": voc.root_cause(context, "customer_state", min_target=2),
    }


def _top(dim: str, lines: bool, name: str) -> str:
    return f"""SELECT '{name}' AS dimension, {dim}::VARCHAR AS value, review_count, target_theme_count, round(theme_share_lift, 4) AS theme_share_lift,
      row_number() OVER (ORDER BY theme_share_lift DESC, target_theme_count DESC, {dim}) AS k FROM ({_cause(dim, lines, 20)})"""


@query("investigation_leads", "N18 F4", f"""
    SELECT dimension, value, review_count, target_theme_count, theme_share_lift FROM ({_top("product_category_name", True, "product_categories")} UNION ALL
      {_top("seller_id", True, "sellers")} UNION ALL {_top("customer_state", False, "customer_geographies")}) WHERE k <= 5""")
def investigation_leads(x):
    _, leads = _leads(x)
    return voc.investigation_leads(leads).select("dimension", "value", "review_count", "target_theme_count", "theme_share_lift")


@query("investigation_summary", "N18 A8")
def investigation_summary(x):
    context, leads = _leads(x)
    alert = _alerts(x).orderBy(F.desc("priority_score"), "period", "theme_name").limit(1)
    summary = voc.investigation_summary(
        alert, leads, voc.delivery_comparison(context), voc.root_cause(context, "order_status", min_target=0), "period", "theme_name"
    )
    return summary.select("decision_id", "decision_type", "status", "causal_status", F.to_json("alert").alias("alert"),
                          F.to_json("operational_evidence").alias("operational_evidence"), F.to_json("investigation_leads").alias("investigation_leads"))
