"""Token counts of whole texts by a lookup in two tiers, without a shuffle of words.

The first tier is a hash table of the frequent words (as the pre-tokenizer splits them) and their numbers of tokens: flat arrays of bounded size,
broadcast once. All words of a batch are looked up together, and a hit counts only if its bytes are the word's. What isn't there goes to a
cache that each Python worker keeps, and what that lacks is encoded by the automaton of ``bpe``. Every input partition counts its own texts.

Which words are frequent is learned from a bounded sample of texts (``SAMPLE``). It decides how many words are found in the first tier,
never a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe import VOCABULARY, _same, batches, encoder

#: Texts that the frequent words are taken from; words of the table at most, and bytes of one of them: 4 MB in all.
SAMPLE, ENTRIES, WORD = 4_000, 32_768, 64
#: Words and bytes of words that a worker's cache holds; beyond, it starts anew. Longer words aren't kept.
CACHED, CACHED_BYTES, LONG = 500_000, 16 << 20, 1_024


class Frequent:
    """An open-addressing table from words to their numbers of tokens."""

    def __init__(self, words: list[bytes], counts: list[int], hashes: np.ndarray):
        self.keys, self.counts = hashes, np.array(counts, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.mask = np.uint64((1 << (max(1, 2 * len(words)) - 1).bit_length()) - 1)  # at most half full
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        for k, h in enumerate(hashes.tolist()):
            at = h & int(self.mask)
            while self.slots[at] >= 0:
                at = at + 1 & int(self.mask)
            self.slots[at] = k

    def lookup(self, hashes: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of tokens of words of ``data`` (where they begin, their sizes), -1 for words that aren't here."""
        found = np.full(len(hashes), -1, np.int64)
        live, slot = np.arange(len(hashes) if len(self.keys) else 0), (hashes & self.mask).astype(np.int64)
        while len(live):
            k = self.slots[slot]
            on = k >= 0
            hit = on & (self.keys[k] == hashes[live])
            found[live[hit]] = k[hit]
            on &= ~hit
            live, slot = live[on], slot[on] + 1 & int(self.mask)
        some = np.flatnonzero(found >= 0)
        some = some[self.starts[found[some] + 1] - self.starts[found[some]] == size[some]]
        some = some[_same(data, at[some], self.bytes, self.starts[found[some]], size[some])]
        out = np.full(len(hashes), -1, np.int64)
        out[some] = self.counts[found[some]]
        return out


class Counter:
    """Counts of texts in one Python worker."""

    def __init__(self, frequent: Frequent, path: str):
        self.frequent, self.coder = frequent, encoder(path)
        self.cache: dict[bytes, int] = {}
        self.held = self.missed = self.encoded = 0

    def words(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, where each word begins, its size, its special id or -1, its text's number)."""
        pieces, of, ids = self.coder._pieces(texts)
        if not pieces:
            return b"", *(np.zeros(0, np.int64) for _ in range(4))
        data, at, special = self.coder._word_starts(pieces, ids)
        ends = np.cumsum([len(x.encode()) for x in pieces])
        return data, at, np.diff(np.append(at, len(data))), special, of[np.searchsorted(ends, at, side="right")]

    def count(self, texts: list[str]) -> np.ndarray:
        data, at, size, special, of = self.words(texts)
        if not len(at):
            return np.zeros(len(texts), np.int64)
        n = self.frequent.lookup(self.coder._hashes(data, at), np.frombuffer(data, np.uint8), at, size)
        n[special >= 0] = 1
        missing = np.flatnonzero(n < 0)
        if len(missing):
            words = [data[a : a + b] for a, b in zip(at[missing].tolist(), size[missing].tolist(), strict=True)]
            n[missing] = self._cached(words)
        return np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)

    def _cached(self, words: list[bytes]) -> list[int]:
        if len(self.cache) > CACHED or self.held > CACHED_BYTES:
            self.cache, self.held = {}, 0
        new = list({w for w in words if w not in self.cache})
        coded = {w: len(ids) for w, ids in zip(new, self.coder.automaton.encode_words(new), strict=True)}
        self.missed, self.encoded = self.missed + len(words), self.encoded + len(new)
        counts = [self.cache[w] if w in self.cache else coded[w] for w in words]
        kept = {w: n for w, n in coded.items() if len(w) <= LONG}
        self.held += sum(map(len, kept))
        self.cache |= kept
        return counts


def frequent_words(docs: DataFrame, text: str = "text", path: str = VOCABULARY, entries: int = ENTRIES, sample: int = SAMPLE) -> Frequent:
    """The most frequent words of about ``sample`` texts, chosen at random from the whole table."""
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    texts = docs.select(F.col(text).alias("text")).sample(share, seed=0).where("text IS NOT NULL")

    def split(parts):
        coder = Counter(Frequent([], [], np.zeros(0, np.uint64)), path)
        for part in parts:
            for some in batches(part.column(0)):
                data, at, size, special, _ = coder.words(some)
                counts: dict[bytes, int] = {}
                for a, b in zip(at[(special < 0) & (size <= WORD)].tolist(), size[(special < 0) & (size <= WORD)].tolist(), strict=True):
                    counts[data[a : a + b]] = counts.get(data[a : a + b], 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    # the sample's words only: no more than its texts hold, at any size of the table
    top = texts.mapInArrow(split, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    words = [bytes(r.word) for r in top.select("word").collect()]
    coder = encoder(path)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(w) for w in words])])[:-1].astype(np.int64)
    hashes = coder._hashes(b"".join(words), at) if words else np.zeros(0, np.uint64)
    return Frequent(words, [len(x) for x in coder.automaton.encode_words(words)], hashes)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 512, path: str = VOCABULARY, frequent: Frequent | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, as the tokenizers library counts it without added special tokens; over_limit
    is n_tokens > ``limit``. Special strings in a text are one token each, the library's default.

    Null texts are empty. Repeated rows stay rows, a null doc_id stays null; ids are numbers. Other columns are not read. Empty tables give no
    rows. A word of any length counts whole. One pass over the input's own partitions; ``frequent`` is learned if not given.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text, path) if frequent is None else frequent)  # ENTRIES words of WORD bytes at most

    def run(parts):
        counter = Counter(table.value, path)
        for part in parts:
            n = [counter.count(some) for some in batches(part.column(2))]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
