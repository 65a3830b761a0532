import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidepool.llm import bpe, packing

ODD = [
    "", " ", "  ", "\n", " \n ", "it's", "'s's", "don't 'tis ''s \"'s  x", "a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>  y", "日本語 テキスト", "🙂🙂 é ", "aaa aaaa aaaaaaaa", "-" * 70,
    "I'LL we'll", "\t\tx\r\n\r\n  y", "x" * 3000, "=-" * 700, "1's2", "áb",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def test_encodes_and_decodes_as_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab 's\n\t.!1²é中🙂 'tlrevd-") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    flat, bounds = bpe.encoder().encode(texts)
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        got = flat[bounds[k] : bounds[k + 1]].tolist()
        assert got == want.ids, texts[k]
        assert bpe.encoder().automaton.decode(got).decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


def test_tables_of_the_automaton_are_small():
    """Each worker holds them; one row of 256 places for each inner node of the trie took 63 MB."""
    assert sum(v.nbytes for v in vars(bpe.encoder().automaton).values() if isinstance(v, np.ndarray)) < 32 << 20


def test_words_go_through_both_paths_alike():
    words = [b"hello", b" the", b"aaaaaaa", "é中".encode(), b"=" * 45]
    a = bpe.encoder().automaton
    assert [x.tolist() for x in a.encode_words(words)] == [a._encode_alone(w).tolist() for w in words]


def test_known_words_start_anew(monkeypatch, library):
    coder = bpe.Encoder()
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    for text in ("one two three four five", "six seven one two", "one"):
        flat, _ = coder.encode([text])
        assert flat.tolist() == library.encode(text, add_special_tokens=False).ids


def thue_morse(size):
    """Two different words that polynomial hashes modulo 2**64 take for equal."""
    bits = [bin(k).count("1") & 1 for k in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_hash_are_told_apart(monkeypatch, library):
    texts = [*thue_morse(1024), *thue_morse(2048), "one two three", "two one three three", "aé b é", "x" * 5000]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]

    def got(coder):
        flat, bounds = coder.encode(texts)
        return [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    assert got(bpe.Encoder()) == want
    coder = bpe.Encoder()
    monkeypatch.setattr(coder, "_hashes", lambda data, at: np.zeros(len(at), np.uint64))
    assert got(coder) == want and got(coder) == want


def test_ids_with_nulls_are_decoded(spark):
    ids = bpe.encoder().encode(["some text"])[0].tolist()
    rows = spark.createDataFrame([(1, ids[:1] + [None] + ids[1:]), (2, None), (3, [])], "k long, ids array<int>")
    assert [r.text for r in bpe.decode(rows).orderBy("k").collect()] == ["some text", "", ""]


def test_round_trip_query(documents, library):
    rows = bpe.round_trip(documents([*ODD, None])).collect()
    for r, text in zip(sorted(rows, key=lambda r: r.doc_id), [*ODD, ""], strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents([])).count() == 0


def test_encode_and_decode_columns(documents):
    back = bpe.decode(bpe.encode(documents(["some text", None, "é"])), to="back").orderBy("doc_id").collect()
    assert [r.back for r in back] == ["some text", "", "é"]


def test_every_id_lies_in_one_piece(documents, library):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta9"]) for _ in range(rng.randint(0, 1500))) for _ in range(120)] + [None, "", "same", "same"]
    rows = packing.pack(documents(texts), with_ids=True).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, want in enumerate(ids):
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            piece = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(want), zlib.crc32(piece), piece)
            at += r.length
        assert at == len(want)
    fills: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 2048
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())


def test_the_level_with_the_least_sum_of_squares_is_taken():
    rng = random.Random(3)
    packer = packing.Packer(16)
    for k in range(300):
        size = rng.randint(1, 15)
        before = packer.levels.copy()
        options = []
        for level in range(16 - size + 1):
            if level and not before[level]:
                continue
            after = before.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 16
            options.append((after[1:16] ** 2).sum())
        packer.place(((k, size), 0, size, b"\0" * 4 * size))
        assert (packer.levels[1:16] ** 2).sum() == min(options)


def test_empty_table(documents):
    assert packing.pack(documents([])).count() == 0
