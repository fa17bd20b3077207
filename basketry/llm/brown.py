"""A Brown class-based bigram model by exchange clustering, and its log10 probability of every text.

P(word | previous) = P(class of word | class of previous) * P(word | class). Words live in a distributed table; no task holds the
whole vocabulary. Texts are coded once in chunks with a small vocabulary of their own; each step joins the chunks'
vocabularies with the word table and meets a chunk's texts with its part of that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import discard, raw_texts, release, spread, stored

CLASSES, ROUNDS = 64, 2
#: A chunk of coded texts ends when it has met this many words. Large chunks repeat fewer words in their vocabularies.
CHUNK_VOCABULARY = 250_000
#: Words that one task of the exchange step decides on.
BUCKET_WORDS = 100_000
#: Weight of the unigram class distribution in transitions, and of unseen words where counts say nothing.
ALPHA, LEAST_DISCOUNT = 10.0, 0.01
END = ""

_CODED = "chunk bigint, doc_id bigint, held_out boolean, width int, ids binary, word string, local int, n bigint"
_CODED_ARROW = pa.schema(
    [
        ("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("width", pa.int32()), ("ids", pa.binary()), ("word", pa.string()),
        ("local", pa.int32()), ("n", pa.int64()),
    ]
)


def _packed(ids: np.ndarray, width: int) -> bytes:
    """Numbers with their bytes in planes, compressed: high bytes are nearly all zero."""
    return zstandard.compress(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int32)


def _code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of coded documents (`ids`) and rows of the words of their chunk with training counts (`word`, `local`, `n`)."""
    task, number = TaskContext.get().partitionId(), 0
    words: dict[bytes, int] = {END.encode(): 0}
    doc_ids: list = []
    held: list[bool] = []
    coded: list[np.ndarray] = []

    def chunk() -> Iterator[pa.RecordBatch]:
        width = 2 if len(words) <= 1 << 16 else 4
        key = (task << 32) + number
        n = len(coded)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, key, np.int64)), pa.array(doc_ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.full(n, width, np.int32)),
                pa.array([_packed(x, width) for x in coded], pa.binary()), *(pa.nulls(n, _CODED_ARROW.field(c).type) for c in ("word", "local", "n")),
            ],
            schema=_CODED_ARROW,
        )
        counts = np.zeros(len(words), np.int64)
        learnt = [x for x, h in zip(coded, held, strict=True) if not h]
        if learnt:
            counts += np.bincount(np.concatenate(learnt), minlength=len(words))
        m = len(words)
        nulls = [pa.nulls(m, _CODED_ARROW.field(c).type) for c in ("doc_id", "held_out", "width", "ids")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m, key, np.int64)), *nulls, pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(np.arange(m, dtype=np.int32)),
                pa.array(counts),
            ],
            schema=_CODED_ARROW,
        )

    for part in parts:
        for at in range(0, part.num_rows, 256):
            some = part.slice(at, 256)
            for doc_id, out, text in zip(some.column("doc_id").to_pylist(), some.column("held_out").to_pylist(), raw_texts(some), strict=True):
                own = (text or b"").lower().split()
                for w in own:
                    if w not in words:
                        words[w] = len(words)
                coded.append(np.fromiter(map(words.__getitem__, [*own, b""]), np.int32, len(own) + 1))
                doc_ids.append(doc_id)
                held.append(out)
                if len(words) >= CHUNK_VOCABULARY:
                    yield from chunk()
                    number += 1
                    words, doc_ids, held, coded = {END.encode(): 0}, [], [], []
    if coded:
        yield from chunk()


def _table(right: pa.Table, name: str, missing: int) -> np.ndarray:
    """A column of a chunk's vocabulary by local number."""
    local = right.column("local").to_numpy()
    out = np.full(len(local), missing, np.int64)
    out[local] = right.column(name).fill_null(missing).to_numpy()
    return out


def _texts(left: pa.Table) -> tuple[list[np.ndarray], list[bool]]:
    width = left.column("width")[0].as_py()
    return [_unpacked(x, width) for x in left.column("ids").to_pylist()], left.column("held_out").to_pylist()


def _contexts(classes: int, buckets: int):
    """Neighbour-class counts of every word of a chunk, packed by the bucket of the word; the class bigrams in bucket -1."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, held = _texts(left)
        learnt = [x for x, h in zip(texts, held, strict=True) if not h]
        rows: dict[str, list] = {k: [] for k in ("bucket", "ids", "own", "size", "context", "count")}
        if learnt:
            cls, ids = _table(right, "cls", -1).astype(np.int32), _table(right, "id", -1)
            stream = np.concatenate((np.zeros(1, np.int32), *learnt))  # every text ends with the end word, which also stands before the first
            before, after = stream[:-1], stream[1:]
            wide = np.int32 if len(ids) * 2 * classes < 1 << 31 else np.int64
            keys = np.concatenate((before.astype(wide) * (2 * classes) + cls[after], after.astype(wide) * (2 * classes) + classes + cls[before]))
            keys, count = np.unique(keys, return_counts=True)
            word, context = keys // (2 * classes), (keys % (2 * classes)).astype(np.uint8)
            pairs = np.bincount(cls[before] * classes + cls[after], minlength=classes * classes).astype("<i8")
            home = ids[word] % buckets
            order = np.lexsort((word, home))
            home, word, context, count = home[order], word[order], context[order], count[order].astype("<u4")
            cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own, size = np.unique(word[a:b], return_counts=True)
                rows["bucket"].append(int(home[a]))
                rows["ids"].append(ids[own].astype("<i8").tobytes())
                rows["own"].append(cls[own].astype(np.uint8).tobytes())
                rows["size"].append(size.astype(np.uint8).tobytes())
                rows["context"].append(context[a:b].tobytes())
                rows["count"].append(count[a:b].tobytes())
            rows["bucket"].append(-1)
            rows["count"].append(pairs.tobytes())
            for k in ("ids", "own", "size", "context"):
                rows[k].append(b"")
        return pa.table({k: pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in rows.items()})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(word: np.ndarray, context: np.ndarray, count: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The exchange step: the class of each word that gives the training text the highest likelihood, all other words staying.

    `word`, `context`, `count`: how often a word (0, 1, ...; sorted) stands before a word of class `context`, or after one of class
    `context - K`; `own`: present classes; `pairs`: K x K class bigrams. Ties keep the present class.
    """
    k, n = len(pairs), len(own)
    out = own.copy()
    starts = np.searchsorted(word, np.arange(n + 1))
    totals = pairs.sum(axis=1)
    total = np.bincount(word, weights=np.where(context >= k, count, 0), minlength=n)
    # what a context adds to the likelihood depends on (context, count) alone
    kinds, kind = np.unique(context.astype(np.int64) << 33 | count, return_inverse=True)
    c, r = kinds >> 33, (kinds & ((1 << 33) - 1)).astype(float)
    rows = np.where((c < k)[:, None], pairs.T[np.minimum(c, k - 1)], pairs[np.maximum(c - k, 0)]).astype(float)  # counts with each class
    joins = (_xlogx(rows + r[:, None]) - _xlogx(rows)).astype(np.float32)
    stays = (_xlogx(rows) - _xlogx(np.maximum(rows - r[:, None], 0))).astype(np.float32)
    step = 2000
    for a in range(0, n, step):
        b = min(a + step, n)
        at = slice(starts[a], starts[b])
        first = starts[a:b] - starts[a]
        gain = np.add.reduceat(joins[kind[at]], first, axis=0, dtype=np.float64)
        mine = own[a:b]
        staying = np.add.reduceat(stays[kind[at], np.repeat(mine, np.diff(starts[a : b + 1]))], first, dtype=np.float64)
        here = total[a:b, None]
        gain -= 2 * (_xlogx(totals[None, :] + here) - _xlogx(totals[None, :].astype(float)))
        staying -= 2 * (_xlogx(totals[mine].astype(float)) - _xlogx(np.maximum(totals[mine] - total[a:b], 0)))
        gain[np.arange(b - a), mine] = staying + 1e-6 * np.abs(staying)
        out[a:b] = gain.argmax(axis=1)
    return out


def _exchange(pairs: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        ids, own, size = read("ids", "<i8"), read("own", np.uint8), read("size", np.uint8)
        context, count = read("context", np.uint8), read("count", "<u4")
        words, first, which = np.unique(ids, return_index=True, return_inverse=True)
        keys, place = np.unique(np.repeat(which, size) << 8 | context, return_inverse=True)
        count = np.bincount(place, weights=count, minlength=len(keys)).astype(np.int64)
        cls = best_classes(keys >> 8, keys & 255, count, own[first].astype(np.int64), pairs)
        return pa.table({"id": pa.array(words), "cls": pa.array(cls.astype(np.int32))})

    return run


def _sum_pairs(rows: DataFrame, classes: int) -> np.ndarray:
    """The class bigrams of all chunks: K x K numbers, added up by Spark cell by cell."""

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for part in parts:
            for raw in part.column("count").to_pylist():
                total += np.frombuffer(raw, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    found = rows.select("count").mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(classes * classes, np.int64)
    for r in found:  # K * K rows
        out[r["cell"]] = r["n"]
    return out.reshape(classes, classes)


def _first_scores(classes: int, train: int, vocabulary: int, discount: float, of_class: np.ndarray):
    """Per text: base score, sum of word emissions, and its class sequence; class bigrams of the training texts in a row of their own."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, held = _texts(left)
        count, cls = _table(right, "c", 0), _table(right, "cls", classes)
        base = np.log10((count + 1) / (train + vocabulary + 1))
        emission = np.where(count > 0, np.log10(np.maximum(count - discount, 1e-9) / np.append(of_class, 1.0)[cls]), 0.0)
        pairs = np.zeros((classes + 1) ** 2, np.int64)
        sequences = []
        for ids, out in zip(texts, held, strict=True):
            seq = cls[np.concatenate((np.zeros(1, np.int32), ids))]
            sequences.append(seq.astype(np.uint8).tobytes())
            if not out:
                pairs += np.bincount(seq[:-1] * (classes + 1) + seq[1:], minlength=len(pairs))
        pairs = pairs.reshape(classes + 1, -1)[:classes, :classes].astype("<i8")
        n = len(texts)
        return pa.table(
            {
                "doc_id": pa.array([*left.column("doc_id").to_pylist(), None], pa.int64()), "held_out": pa.array([*held, None], pa.bool_()),
                "n_tokens": pa.array([*map(len, texts), None], pa.int64()), "n_known": pa.array([*(int((count[x] > 0).sum()) for x in texts), None], pa.int64()),
                "base_score": pa.array([*(float(base[x].sum()) for x in texts), None], pa.float64()),
                "emission": pa.array([*(float(emission[x].sum()) for x in texts), None], pa.float64()),
                "classes": pa.array([*sequences, None], pa.binary()), "count": pa.array([None] * n + [pairs.tobytes()], pa.binary()),
            }
        )

    return run


def _final_scores(transitions: np.ndarray):
    """Adds the transitions of the class sequence to the emissions."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            path = []
            for raw in part.column("classes").to_pylist():
                seq = np.frombuffer(raw, np.uint8)
                path.append(float(transitions[seq[:-1], seq[1:]].sum()))
            score = part.column("emission").to_numpy() + np.array(path)
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], [*names, "score"])

    return run


def scores(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row per row of `docs(doc_id, text)`.

    The model learns from rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id: it learns). All words and all their bigrams
    count. Training starts with the most frequent words in a class each and the rest in one; each round every word is exchanged
    into its best class. A known word has its count less a discount as weight in its class, what the discounts free is the
    probability of an unknown word, and transitions are smoothed by class frequencies. After an unknown word the classes have
    their frequencies. Null and empty texts are the end token alone; repeated rows count as often as they occur. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    coded = stored(docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_code, _CODED), "lm-coded")
    texts = coded.filter("ids IS NOT NULL").select("chunk", "doc_id", "held_out", "width", "ids")
    words = coded.filter("word IS NOT NULL").select("chunk", "word", "local", "n")
    counted = words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0")
    vocabulary = stored(counted.withColumn("id", F.monotonically_increasing_id()), "lm-vocabulary")
    found = vocabulary.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("train"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")
    ).first()
    release(spark)
    train, types = found["train"], found["types"]
    discount = min(max(found["one"] / max(found["one"] + 2 * found["two"], 1), LEAST_DISCOUNT), 0.99)
    local = stored(words.join(vocabulary, "word", "left").select("chunk", "local", "id", "c"), "lm-chunk-words")
    # the most frequent words, one class each: K - 1 rows
    seeds = vocabulary.orderBy(F.desc("c"), "word").limit(classes - 1).select("id").collect()
    seeded = spark.createDataFrame([(r["id"], i) for i, r in enumerate(seeds)], "id bigint, cls int")
    member = vocabulary.select("id").join(F.broadcast(seeded), "id", "left").select("id", F.coalesce("cls", F.lit(classes - 1)).alias("cls"))
    member = stored(member, "lm-classes")
    buckets = spread(types, BUCKET_WORDS)
    release(spark)
    packed = "bucket bigint, ids binary, own binary, size binary, context binary, count binary"
    for _ in range(rounds):
        named = local.join(member, "id", "left").select("chunk", "local", "id", "cls")
        met = texts.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(_contexts(classes, buckets), packed)
        met = stored(met, "lm-contexts")
        release(spark)
        pairs = _sum_pairs(met.filter("bucket < 0"), classes)
        moved = met.filter("bucket >= 0").groupBy("bucket").applyInArrow(_exchange(pairs), "id bigint, cls int")
        before, member = member, stored(moved, "lm-classes")
        discard(met)
        discard(before)
        release(spark)
    of_class, kinds = np.zeros(classes), np.zeros(classes)
    for r in vocabulary.join(member, "id").groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # K rows
        of_class[r["cls"]], kinds[r["cls"]] = r["c"], r["n"]
    named = local.join(member, "id", "left").select("chunk", "local", "c", "cls")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, classes binary, count binary"
    first = _first_scores(classes, train, types, discount, np.maximum(of_class, 1.0))
    rows = stored(texts.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(first, schema), "lm-first-scores")
    release(spark)
    pairs = _sum_pairs(rows.filter("count IS NOT NULL"), classes)
    final = rows.filter("classes IS NOT NULL").mapInArrow(
        _final_scores(transitions(pairs, of_class, kinds, discount)),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return final.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def transitions(pairs: np.ndarray, of_class: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """log10 of (K + 1) x (K + 1) transition probabilities, the last class being unknown words.

    The unknown word takes from each class the mass that the discounts freed, so all words and the unknown one sum to one.
    """
    total = of_class.sum()
    share = of_class / total if total else np.zeros(len(of_class))
    rows = (pairs + ALPHA * share) / (pairs.sum(axis=1, keepdims=True) + ALPHA)
    rows = np.vstack((rows, share))
    freed = discount * kinds / np.maximum(of_class, 1.0)
    unknown = rows @ freed if total else np.ones(len(rows))
    return np.log10(np.maximum(np.column_stack((rows, unknown)), 1e-300))
