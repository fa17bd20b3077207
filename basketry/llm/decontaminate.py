"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question asked again with other values has the same
template. Windows of eight template words are joined by hash; a match of window series counts if the slot values of the
two sides correspond one to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from basketry.llm.common import raw_texts, stored

WINDOW, LITERALS = 8, 4
#: Share of a question's windows that one document must match in one alignment, and the number that is enough of a longer
#: question: six windows are a passage of 13 words.
COVERAGE, ENOUGH = 0.6, 6
#: Bits of the filter that all tasks get; its size does not depend on the data.
FILTER_BITS = 1 << 23

# fixed values: unit words that stand for one placeholder
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l gal s sec secs min mins h hr hrs ms km/h mph kmh m/s pa kpa mpa bar atm v w kw kwh j kj cal kcal hz khz mhz "
    "ghz k c f usd eur gbp usd. dollars dollar cents cent euros euro pounds pound meters meter metres metre kilometers kilometres kilometer miles "
    "mile inches inch feet foot yards yard grams gram kilograms kilogram ounces ounce liters litres liter gallons gallon seconds second minutes "
    "minute hours hour days day weeks week months month years year percent degrees degree".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d,.:/]*%?(?:st|nd|rd|th)?")
_NUMBER_UNIT = re.compile(r"([+-]?[$€£]?\d[\d,.]*)([^\W\d_]+|%|°[CF]?)")
_EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
WORD, NUM, NAME, UNIT = range(4)
SLOT = ("", "<num>", "<name>", "<unit>")
_PUNCTUATION, _JOINED, _CAPITAL = 4, 5, 6
_REMEMBERED = 400_000


def _told(raw: bytes) -> tuple[int, str, bool]:
    """Kind of a word by itself, the word without edge punctuation in lower case, and whether a sentence ends behind it."""
    word, ends = raw.decode(), False
    if not word.isalpha():
        ends = word[-1] in ".!?:;\"'"
        word = _EDGES.sub("", word)
        if not word:
            return _PUNCTUATION, "", ends
        joined = _NUMBER_UNIT.fullmatch(word)
        if _NUMBER.fullmatch(word):
            return NUM, word, ends
        if joined and (joined[2].lower() in UNITS or joined[2][0] in "%°"):
            return _JOINED, word, ends
    low = word.lower()
    if low in UNITS:
        return UNIT, low, ends
    return (_CAPITAL if word[0] != low[0] and word[1:] == low[1:] and len(word) > 1 else WORD), low, ends


class _Known(dict):
    """Words met so far, each with its number and a row of `kind`, `code` and `ends`."""

    def __init__(self):
        super().__init__()
        self.told: list[str] = []
        self.kind, self.code, self.ends = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, bool)

    def __missing__(self, raw: bytes) -> int:
        kind, word, ends = _told(raw)
        i = len(self.told)
        if i == len(self.kind):
            self.kind, self.code, self.ends = (np.concatenate((x, np.zeros_like(x))) for x in (self.kind, self.code, self.ends))
        self.kind[i], self.code[i], self.ends[i] = kind, xxh64_intdigest(word.encode(), 1), ends
        self.told.append(word)
        self[raw] = i
        return i


class Templates:
    """Template words and windows of texts.

    A name is a word with a capital first letter and lower-case rest inside a sentence; a unit is a unit word behind a number; a number
    with its unit is two slots. Words lose the punctuation at their edges and their case; a word of punctuation alone is left out.
    """

    def __init__(self):
        self._known = _Known()

    def read(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind and code of each template word, and the number of the word it was made from (for `value`)."""
        raws = (text or b"").split()
        if len(self._known) > _REMEMBERED:
            self._known = _Known()
        known = self._known
        ids = np.fromiter(map(known.__getitem__, raws), np.int64, len(raws))
        kind, code, ends = known.kind[ids], known.code[ids], known.ends[ids]
        starts = np.concatenate((np.ones(1, bool), ends[:-1])) if len(raws) else np.zeros(0, bool)
        kind = np.where(kind == _CAPITAL, np.where(starts, WORD, NAME), kind)
        used = kind != _PUNCTUATION
        ids, kind, code = ids[used], kind[used], code[used]
        joined = kind == _JOINED
        if joined.any():
            times = np.where(joined, 2, 1)
            second = np.cumsum(times)[joined] - 1
            ids, kind, code = np.repeat(ids, times), np.repeat(kind, times), np.repeat(code, times)
            kind[second], kind[second - 1] = UNIT, NUM
        behind = np.concatenate((np.zeros(1, bool), kind[:-1] == NUM)) if len(kind) else np.zeros(0, bool)
        kind = np.where((kind == UNIT) & ~behind, WORD, kind)
        return kind, np.where(kind == WORD, code, kind.astype(np.uint64)), ids

    def value(self, ids: np.ndarray, kind: np.ndarray, i: int) -> str:
        """Slot type and value of template word `i`."""
        word = self._known.told[ids[i]]
        if self._known.kind[ids[i]] == _JOINED:
            word = _NUMBER_UNIT.fullmatch(word)[1 if kind[i] == NUM else 2].lower()
        return SLOT[kind[i]] + word


def _windows(kind: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows with enough literal words; a shorter text is one window."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = min(WINDOW, n)
    hashes = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        hashes = (hashes ^ code[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    literal = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind == WORD)))
    at = np.flatnonzero(literal[width:] - literal[: n - width + 1] >= min(LITERALS, width))
    return at, hashes[at]


_OUT = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])
_DDL = "key bigint, n bigint, at bigint, hash bigint, slots array<string>"


def template_windows(rows: DataFrame, key: str, text: str, only: bytes | None = None) -> DataFrame:
    """(key, n, at, hash, slots): the template windows of each text and `n`, how many it has. `only` is a filter of hashes."""
    allowed = np.frombuffer(only, np.uint8) if only is not None else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Templates(), []
        for part in parts:
            for row_key, row_text in zip(part.column(0).to_pylist(), raw_texts(part), strict=True):
                kind, code, ids = reader.read(row_text)
                at, hashes = _windows(kind, code)
                n = len(at)
                if allowed is not None and n:
                    bits = hashes % np.uint64(FILTER_BITS)
                    hit = (allowed[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    at, hashes = at[hit], hashes[hit]
                for i, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    slots = [reader.value(ids, kind, j) for j in range(i, min(i + WINDOW, len(kind))) if kind[j] != WORD]
                    held.append((row_key, n, i, h, slots))
                if len(held) >= 8192:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return rows.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, _DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def window_filter(windows: DataFrame) -> bytes:
    """A bit per residue of the hashes that occur: one megabyte, however many windows there are.

    Tasks set bits of one constant-size map each and these are or-ed; nothing is lost, other hashes with a set bit are sorted out by the join.
    """

    def bits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.unique(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FILTER_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["bit"])

    found = windows.select("hash").mapInArrow(bits, "bit bigint").groupBy(F.expr("bit DIV 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("b")
    )
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for row in found.toLocalIterator():  # FILTER_BITS / 64 rows at most
        words[row["word"]] = row["b"]
    return words.tobytes()


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, exact): documents that hold a benchmark text, whole or with other values.

    One alignment of a document with an item (a fixed distance of their positions) must cover `coverage` of the item's windows or `enough` of them, and its
    slot values must correspond one to one; `exact` says that they are equal. Null and empty texts, items without a literal word, and
    rows without id match nothing. Items of fewer than eight words count as one window of all their words, found in texts as short only.
    Repeated items are one.
    """
    items = stored(template_windows(benchmark.filter("item_id IS NOT NULL").dropDuplicates(["item_id", "text"]), "item_id", "text"), "benchmark-windows")
    only = window_filter(items)
    found = template_windows(docs.filter("doc_id IS NOT NULL"), "doc_id", "text", only)
    right = items.select(F.col("key").alias("item_id"), F.col("n").alias("n_windows"), F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"))
    both = stored(found.select(F.col("key").alias("doc_id"), "at", "hash", "slots").join(right, "hash"), "benchmark-matches")
    # one row per slot pair; windows without slots keep one empty pair
    pair = F.explode_outer(F.array_distinct(F.arrays_zip("item_slots", "slots")))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    keys = ["doc_id", "item_id", "shift"]
    covered = both.groupBy("doc_id", "item_id", shift).agg(F.first("n_windows").alias("n_windows"), F.countDistinct("item_at").alias("n_matched"))
    covered = covered.filter(F.col("n_matched") >= F.least(F.col("n_windows") * F.lit(coverage), F.lit(float(enough))))
    slots = both.select("doc_id", "item_id", shift, pair.alias("p")).filter("p IS NOT NULL").select(*keys, "p.item_slots", "p.slots").distinct()
    odd = slots.groupBy(*keys, "item_slots").agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    odd = odd.unionByName(slots.groupBy(*keys, "slots").agg(F.count("*").alias("n")).filter("n > 1").select(*keys))
    changed = slots.filter("item_slots <> slots").select(*keys).distinct().withColumn("changed", F.lit(True))
    good = covered.join(odd.distinct(), keys, "left_anti").join(changed, keys, "left")
    return good.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"),
        F.max(F.col("n_matched") / F.col("n_windows")).alias("coverage"), F.bool_or(F.col("changed").isNull()).alias("exact"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without those that hold a benchmark text. Rows without doc_id can't be named by a match and stay."""
    hit = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
