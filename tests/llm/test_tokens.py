import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import tokens
from basketry.llm.elias_fano import EliasFano, encode
from basketry.session import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1500))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    code = EliasFano(encode(np.array(values, np.uint64)))
    assert code.values().tolist() == values
    for i in range(0, len(values), 97):
        assert code[i] == values[i]
    assert code.size == len(encode(np.array(values, np.uint64)))


def test_elias_fano_space_and_long_gaps():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    assert 8 * len(encode(ends)) < 13 * len(ends)
    gaps = np.array([0] * 600 + [1 << 35] * 3 + [1 << 45], np.uint64)
    code = EliasFano(encode(gaps))
    assert [code[0], code[599], code[600], code[603]] == [0, 0, 1 << 35, 1 << 45]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_by_word_ids_are_the_ids_of_the_text(documents):
    whole, coder = tokenizer(), tokens.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", " \t\n", "<|endoftext|>", "a <|startoftext|>b", "é ̈x Σας ΣΑΣ\x0bΣ", "a\xa0b　c d", "don't I'LL 12'3", "\x00\x1c\x1d", "ﬁ ½ İ", "x" * 500]
    texts = odd + [r["text"] for r in documents.select("text").collect()]
    got = coder.encode([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t[:60]


def test_a_worker_keeps_its_words_from_task_to_task(tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [b"Plain words, once met. don't 12 x-y \xc3\xa9t\xc3\xa9", None, b""]
    first = tokens.worker_coder(path).encode(texts)
    asked = []
    monkeypatch.setattr(tokens.WordCoder, "_cut", lambda self, some, single: asked.append(some))
    assert tokens.worker_coder(path).encode(texts) == first
    assert asked == []
    monkeypatch.undo()
    # another file gets a coder of its own, and so does a file that has changed
    other = tmp_path / "tokenizer.json"
    other.write_bytes(open(path, "rb").read())
    coder = tokens.worker_coder(str(other))
    assert coder is tokens.worker_coder(str(other))
    other.write_bytes(open(path, "rb").read() + b"\n")
    assert tokens.worker_coder(str(other)) is not coder


def expected(rows):
    whole, start, out = tokenizer(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(frame):
    return [tuple(r) for r in frame.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


def test_files_read_back(documents, odd, none, clashing, monkeypatch):
    assert read(tokens.encoded(documents)) == expected([(r["doc_id"], r["text"]) for r in documents.collect()])
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert read(tokens.encoded(odd)) == expected(rows) == read(tokens.encoded(clashing))
    assert tokens.encoded(none).count() == 0


def test_small_shards_give_the_same_rows_and_single_documents(spark, documents):
    raw = tokens.pack(3, 4, 2, [None, -5, 7], [b"\1\0", b"\2\0\3\0\1\0", b"\1\0"])
    shard = tokens.Shard(raw + b"\n")
    assert (shard.lane, shard.number, shard.doc_ids()) == (3, 4, [None, -5, 7])
    assert [shard.document(i).tolist() for i in range(3)] == [[1], [2, 3, 1], [1]]
    path = scratch_path(spark, "shards")
    tokens.write(documents, path, public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.documents(spark, path).count() == documents.count()
