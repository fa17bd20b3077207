"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A shard holds consecutive documents in ascending doc_id order:

    magic, lane, sequence number, id width, counts of documents, of null doc_ids and of ids, smallest doc_id,
    boundaries: ends of the documents in the id array, Elias-Fano,
    doc_ids less the smallest, Elias-Fano (documents without doc_id come first),
    the ids, two bytes each if the vocabulary allows, else four, little-endian.

Files are written through Spark's own committing writer and read as `binaryFile`, so any file system that Spark reaches
will do, and a repeated task leaves one copy. A file is one shard and the line end that the writer adds.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.common import raw_texts, stored
from basketry.llm.elias_fano import EliasFano, encode
from basketry.session import scratch_path

END = 1
#: Bytes of ids in a shard, and words whose ids a Python worker remembers.
SHARD_BYTES, REMEMBERED = 32 << 20, 600_000
#: What the tokenizer's splitting leaves together in plain ASCII text without apostrophes.
PIECES = re.compile(rb"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
#: Bytes of texts whose words are looked up together.
GROUP_BYTES = 8 << 20
#: Shards whose starts are summed up in one window partition.
LANE = 4096
MAGIC = b"IDSHARD1"
HEAD = struct.Struct("<8sQQQQQQq")  # magic, lane, number, id width, documents, null doc_ids, ids, smallest doc_id


class WordCoder:
    """Ids of texts by a tokenizer that never joins text across ASCII white space and drops that space.

    Then the ids of a text are those of its words one after the other, and a word's ids can be remembered. `word_bpe_49k.json` is
    such a tokenizer; `tests/llm/test_tokens.py` holds whole texts against it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        #: Ids that end a piece, where the vocabulary marks them.
        self._last = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._last[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._known: dict[bytes, bytes] = {}
        self._before: dict[bytes, bytes] = {}
        self._learn([b".", b","])
        self._marks = {w[0]: ids for w, ids in self._known.items()}

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text and the end id, as bytes. Null is an empty text."""
        # the tokenizer ignores case, but for the text of its special tokens
        kept = [(x if b"<|" in x else x.lower()) if x else b"" for x in texts]
        split = pc.ascii_split_whitespace(pa.array(kept, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        distinct, index = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
        if len(self._known) > REMEMBERED // 2:  # words met since the last time stay, the others go next time
            self._known, self._before = {}, self._known
        known, before = self._known, self._before
        known[b""] = b""  # before and after white space at the ends
        fresh = set(distinct) - known.keys()
        met = fresh & before.keys()
        known.update((w, before[w]) for w in met)
        hard = []
        for w in fresh - met:
            # a full stop or comma behind a letter is a piece of its own
            if w[-1:] in (b".", b",") and w[-2:-1].isalpha() and w[:-1] in known:
                known[w] = known[w[:-1]] + self._marks[w[-1]]
            else:
                hard.append(w)
        self._learn(hard)
        pieces = list(map(known.__getitem__, distinct))
        table = np.frombuffer(b"".join(pieces), f"<u{self.width}")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        ends = np.cumsum(sizes[index])
        # the ids of all words one after the other: each word's place in the table, counted on
        places = np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - sizes[index]), sizes[index]) + np.arange(ends[-1] if len(ends) else 0)
        raw = table[places].tobytes()
        upto = np.concatenate((np.zeros(1, np.int64), ends))[split.offsets.to_numpy() - split.offsets[0].as_py()] * self.width
        end = END.to_bytes(self.width, "little")
        return [raw[a:b] + end for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        """Codes new words. Those of one piece and those that need the tokenizer's own splitting are coded many as one text; plain ASCII words of several
        pieces (letters, single digits, runs of signs) are put together from the ids of these."""
        single, other, compound = [], [], []
        for w in words:
            t = w.decode()
            if t.isascii():
                if t.isalpha():
                    single.append((w, t))
                elif t.isprintable() and "'" not in t and "<|" not in t:
                    compound.append((w, PIECES.findall(w)))
                else:
                    other.append((w, t))
            else:
                (single if t.lower().isalpha() and is_normalized("NFC", t) else other).append((w, t))
        queued = {w for w, _ in single}
        for piece in set().union(*(p for _, p in compound)) - self._known.keys() - queued:
            (single if piece.isalpha() else other).append((piece, piece.decode()))
        for some, kind in ((single, True), (other, False)):
            for at in range(0, len(some), 500):
                self._cut(some[at : at + 500], kind)
        known = self._known
        known.update((w, b"".join(map(known.__getitem__, parts))) for w, parts in compound)

    def _cut(self, some: list[tuple[bytes, str]], single: bool) -> None:
        text = " ".join(t for _, t in some)
        if single:
            code = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(code.ids, f"<u{self.width}")
            cuts = np.flatnonzero(self._last[ids]) + 1
            if len(cuts) != len(some):  # another kind of vocabulary
                return self._cut(some, False)
            cuts = [0, *cuts.tolist()]
        else:
            code = self._tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(code.ids, f"<u{self.width}")
            at = np.fromiter((a for a, _ in code.offsets), np.int64, len(ids))
            cuts = np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for _, t in some)])).tolist()
        raw, width = ids.tobytes(), self.width
        self._known.update((w, raw[width * a : width * b]) for (w, _), a, b in zip(some, cuts[:-1], cuts[1:], strict=True))


def worker_coder(path: str) -> WordCoder:
    """The coder of this Python worker, which keeps its words from task to task as long as the tokenizer file stays as it is."""
    state = os.stat(path)
    return _coder(path, state.st_mtime_ns, state.st_size)


@lru_cache(maxsize=1)
def _coder(path: str, changed: int, size: int) -> WordCoder:
    return WordCoder(path)


def pack(lane: int, number: int, width: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One shard; documents without doc_id are first."""
    named = [d for d in doc_ids if d is not None]
    least = min(named, default=0)
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.uint64)
    head = HEAD.pack(MAGIC, lane, number, width, len(ids), len(ids) - len(named), int(ends[-1]) if len(ids) else 0, least)
    return b"".join((head, encode(ends), encode(np.array([d - least for d in named], np.uint64)), *ids))


class Shard:
    """A shard read from its bytes: boundaries and ids by document number, without a table of 64-bit offsets."""

    def __init__(self, raw: bytes):
        magic, self.lane, self.number, self.width, self.docs, self.nulls, self.total, self.least = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        view = memoryview(raw)
        self.ends = EliasFano(view[HEAD.size :])
        self.named = EliasFano(view[HEAD.size + self.ends.size :])
        at = HEAD.size + self.ends.size + self.named.size
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.total, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + int(x) for x in self.named.values()]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes `docs(doc_id, text)` into shards below `path`, in ascending doc_id order (null first, ties by text).

    `tokenizer` is the path of a tokenizer file that every executor has, or a name that `public_tokenizers` resolves there.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lane, number = worker_coder(_resolved(tokenizer)), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"shard={lane:08d}-{number:08d}"]), pa.array([pack(lane, number, coder.width, doc_ids, ids)], pa.binary())], ["name", "payload"]
            )

        for few in _groups(parts):
            coded = coder.encode(raw_texts(few))
            doc_ids += few.column("doc_id").to_pylist()
            ids += coded
            held += sum(map(len, coded))
            if held >= SHARD_BYTES:
                yield shard()
                doc_ids, ids, held, number = [], [], 0, number + 1
        if ids:
            yield shard()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, "name string, payload binary")
    # the writer starts a new file whenever the partition value changes, so each shard gets a file of its own
    shards.select("name", F.col("payload").cast("string").alias("value")).write.partitionBy("name").text(path)


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in groups of at most GROUP_BYTES of text; a longer text is alone."""
    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < part.num_rows:
            limit = (ends[at - 1] if at else 0) + GROUP_BYTES
            to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            yield part.slice(at, to - at)
            at = to


def _resolved(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for raw in part.column("content"):
            shard = Shard(raw.as_py())
            # one look into the select structure per document
            ends = np.fromiter((shard.ends[i] for i in range(shard.docs)), np.int64, shard.docs)
            begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
            sums = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids(), pa.int64()), pa.array(begins), pa.array(ends - begins), pa.array(sums, pa.int64()),
                    pa.array(np.full(n, shard.lane, np.int64)), pa.array(np.full(n, shard.number, np.int64)),
                ],
                ["doc_id", "first", "n_tokens", "ids_crc32", "lane", "number"],
            )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, lane, number), one row per document, read from the files below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    rows = files.select("content").mapInArrow(_rows, "doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint, lane bigint, number bigint")
    each = stored(rows, "token-documents")
    totals = each.groupBy("lane", "number").agg(F.sum("n_tokens").alias("total"))
    # a shard's first id: shards before it in its lane group, and groups before that; a row per shard or group, not per document
    totals = totals.withColumn("group", F.expr(f"lane DIV {LANE}"))
    groups = totals.groupBy("group").agg(F.sum("total").alias("all")).select(
        "group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("before")
    )
    inside = F.sum("total").over(Window.partitionBy("group").orderBy("lane", "number")) - F.col("total")
    starts = totals.withColumn("inside", inside).join(groups, "group").select("lane", "number", (F.col("before") + F.col("inside")).alias("base"))

    return each.join(starts, ["lane", "number"]).select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "lane", "number"
    )


def encoded(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Writes `docs` as shards in the shared folder and returns what `documents` reads from them.

    Null and empty texts are one end id. Rows with the same doc_id are documents of their own, next to each other. An empty table
    writes no shard and gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write(docs, path, tokenizer)
    return documents(spark, path)
