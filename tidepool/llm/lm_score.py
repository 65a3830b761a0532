"""Scores by cross-entropy difference of two word n-gram models.

A target model (of texts like those wanted) and a background model (of all
documents) are made alike: bigrams interpolated with unigrams, over all words of
both. A word is the 64-bit hash of its letters (a keyed universal family), so no list
of words is gathered and no word is left out, whatever the input's size. A document's
score is the mean over its tokens of the loss under the target model less that under
the background model; low scores are like the target.

The most frequent words of some documents get short numbers instead of their
hashes, so that a bigram of two of them takes 32 bits and not 64. That list decides the
size of what is shuffled and nothing else: scores are the same with any list.

Counting and scoring gather from the whole corpus:

1. Each chunk of documents gives its distinct bigrams with counts, packed by hash
   bucket; buckets add them up for background and target. Bigrams of two listed words
   have buckets of their own.
2. Each bucket sends the counts of its words to buckets of words, which add them up
   and send the sums back, so a bucket has all that the losses of its bigrams need.
3. Each chunk gives its (bigram, document) counts, packed by the same buckets. Buckets
   of more tokens than others, as those of frequent bigrams, are dealt over salts, so
   their documents lie in many tasks. Each task
   reads a bucket's loss differences once, then chunk after chunk, and gives sums of
   them for the documents of each, which add up to scores.

Sums are whole numbers (loss in 2**-20 nats), so the order of tasks doesn't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe import batches
from tidepool.llm.common import discard, keyed_hashes, written

#: The weight of unigrams and of the uniform distribution.
UNIGRAM, UNIFORM = 0.3, 0.01
WORD = re.compile(r"\w+|[^\w\s]+")
#: The unknown word and the beginning of a text; numbers of listed words come after, hashes of others from RARE on.
UNKNOWN, BEGIN, FIRST = 0, 1, 2
LISTED, RARE = 1 << 16, 1 << 17
#: Documents, about, whose words are counted for the list; it only makes what is shuffled smaller.
LIST_DOCUMENTS = 4_000
#: Tokens of a chunk, about; salts over which a bucket's documents are dealt, at most.
CHUNK, SALTS, SCALE = 1_000_000, 64, 1 << 20
#: Tokens of the corpus for each part of the words, about.
PART = 4_000_000
#: A bigram is context * ODD + word, modulo 2**64; one of listed words (context * 2**16 + word) * SHORT_ODD, modulo 2**32.
ODD, SHORT_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9E3779B1)
ODD_BACK, SHORT_BACK = np.uint64(pow(int(ODD), -1, 1 << 64)), np.uint64(pow(int(SHORT_ODD), -1, 1 << 32))
M16, M32 = np.uint64(LISTED - 1), np.uint64((1 << 32) - 1)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _count_words(docs: DataFrame) -> DataFrame:
    """(word, n) with partial counts, bounded in a task's memory."""

    def run(parts):
        counts: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for part in parts:
            for x in part.column(0):
                counts.update(words(x.as_py() or ""))
                if len(counts) > 500_000:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long")


def _most_frequent(counts: DataFrame, most: int) -> list[str]:
    """The ``most`` words with the largest counts, then by word. A sorted limit would send as many from each partition to the driver;
    here the words are sorted over all partitions, the driver gets the partitions' sizes, and then no more than the words it keeps."""
    order = [F.desc("n"), F.asc("word")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = written(counts.repartitionByRange(*order).sortWithinPartitions(*order).select("word", F.spark_partition_id().alias("part"), place.alias("place")))
    sizes = sorted(map(tuple, ranked.groupBy("part").count().collect()))
    left = most
    for part, n in sizes:
        if left >= n:
            left -= n
        else:
            keep = (F.col("part") < part) | ((F.col("part") == part) & (F.col("place") < left))
            break
    else:
        keep = F.lit(True)
    found = ranked.where(keep).toPandas().sort_values(["part", "place"])["word"].tolist()
    discard(ranked)
    return found


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 for white space, 1 for letters of words, 2 for marks, of each code point."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), 2, np.uint8)
    for kind, pattern in ((0, r"\s+"), (1, r"\w+")):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def word_hashes(texts: list[str], most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, as ``words`` finds them, and its text; about ``most`` characters are in work at once."""
    hashes, owners, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and size < most:
            size += len(texts[end])
            end += 1
        h, of = _hashes_of(texts[first:end])
        hashes.append(h)
        owners.append(of + first)
        first = end
    return np.concatenate(hashes), np.concatenate(owners)


def _hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [x.lower() for x in texts]
    joined = " ".join([*lowered, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    edge = np.flatnonzero(np.diff(kinds, prepend=0, append=0))  # no word goes over the blank after a text
    start, size = edge[:-1], np.diff(edge)
    some = kinds[start] > 0
    start, size = start[some], size[some]
    h = keyed_hashes(points.astype(np.uint64) + np.uint64(1), start, size, lambda k: joined[start[k] : start[k] + size[k]].encode("utf-8", "surrogatepass"))
    of = np.searchsorted(np.cumsum([len(x) + 1 for x in lowered]), start, side="right")
    return np.where(h < RARE, h + np.uint64(RARE), h), of


class Words:
    """Numbers of words: short ones of listed words, hashes of others; with ``only``, of no words but these hashes."""

    def __init__(self, listed: np.ndarray, only: np.ndarray | None = None):
        self.listed, self.only = listed, only
        self.order = np.argsort(listed)
        self.sorted = listed[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        found = hashes if self.only is None else np.where(np.isin(hashes, self.only), hashes, np.uint64(UNKNOWN))
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            found = np.where(self.sorted[at] == hashes, (self.order[at] + FIRST).astype(np.uint64), found)
        return found

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and words of all bigrams, and each one's text."""
        hashes, of = word_hashes(texts)
        distinct, which = np.unique(hashes, return_inverse=True)
        ids = self.numbers(distinct)[which.reshape(-1)]
        contexts = np.full(len(ids), BEGIN, np.uint64)
        contexts[1:] = np.where(of[1:] == of[:-1], ids[:-1], np.uint64(BEGIN))
        return contexts, ids, of


def _keys(contexts: np.ndarray, words: np.ndarray, rare: bool) -> np.ndarray:
    return contexts * ODD + words if rare else ((contexts << np.uint64(16) | words) * SHORT_ODD) & M32


def _hints(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What tells the ends of rare bigrams by their keys: the listed one of both, or the context."""
    return np.where((contexts >= LISTED) & (words < LISTED), words + np.uint64(LISTED), contexts)


def _both(keys: np.ndarray, hints: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, words) of bigrams."""
    if hints is None:
        pairs = (keys * SHORT_BACK) & M32
        return pairs >> np.uint64(16), pairs & M16
    contexts = np.where((hints >= LISTED) & (hints < RARE), (keys - (hints - np.uint64(LISTED))) * ODD_BACK, hints)
    return contexts, keys - contexts * ODD


def _bucket(keys: np.ndarray, buckets: int, rare: bool = True) -> np.ndarray:
    """Ranges of keys, so that sorted keys are sorted by bucket."""
    return (((keys >> np.uint64(32) if rare else keys) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(*arrays: np.ndarray, rising: bool = True) -> bytes:
    """Arrays of whole numbers, the first of them ``rising`` or not, as bytes: all lowest bytes of an array first, then the next."""
    first = arrays[0].astype(np.uint64)
    parts = []
    for x in (np.diff(first, prepend=np.uint64(0)) if rising else first, *arrays[1:]):
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or int(x.max()) <= np.iinfo(t).max)
        size = np.dtype(kind).itemsize
        parts.append(bytes([size]) + x.astype(kind).view(np.uint8).reshape(len(x), size).T.tobytes())
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes, rising: bool = True) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(data[:8], "little"), zstandard.ZstdDecompressor().decompress(data[8:]), 0, []
    while at < len(raw):
        planes = np.frombuffer(raw, np.uint8, n * raw[at], at + 1).reshape(raw[at], n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{raw[at]}").reshape(n).astype(np.uint64))
        at += 1 + n * raw[at]
    if rising:
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _chunks(docs: DataFrame, vocabulary, buckets: int, per_document: bool, salts: np.ndarray | None = None) -> DataFrame:
    """Packed bigrams of every chunk: (bucket, salt, chunk, target, bits), per document or of the chunk as a whole. Bigrams of listed words
    have the first ``buckets`` buckets, others as many after them.

    With ``per_document`` a row of bucket -1 has the chunk's doc_ids and their numbers of tokens.
    """

    def gathered(parts):
        """(doc_ids, texts, targets) of chunks, over the bounds of Arrow batches."""
        held, size = [], 0
        for part in parts:
            seen = 0
            for texts in batches(part.column(1)):
                held.append((part.column(0).slice(seen, len(texts)), texts, part.column(2).slice(seen, len(texts)).to_pylist()))
                seen += len(texts)
                size += sum(map(len, texts))
                if size >= 4 * CHUNK:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(parts):
        task, count = TaskContext.get().partitionId() << 32, 0
        known = vocabulary.value
        for held in gathered(parts):
            ids = pa.concat_arrays([h[0] for h in held])
            texts = [x for h in held for x in h[1]]
            flags = np.array([x for h in held for x in h[2]], bool)
            contexts, words, doc = known.tokens(texts)
            rare_ones = (contexts >= LISTED) | (words >= LISTED)
            rows: list[tuple] = []
            if per_document:
                n = np.bincount(doc, minlength=len(texts))
                sink = pa.BufferOutputStream()
                batch = pa.RecordBatch.from_arrays([ids, pa.array(n)], ["doc_id", "n"])
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch)
                rows.append((-1, (task >> 32) * 31 + count & 0xFFFFFF, task + count, False, sink.getvalue().to_pybytes()))
            for target, rare in ((False, False), (False, True), (True, False), (True, True)):
                some = (flags[doc] == target) & (rare_ones == rare)
                if per_document and target or not some.any():
                    continue
                of, context, word = doc[some], contexts[some], words[some]
                own = _keys(context, word, rare)
                order = np.argsort(own, kind="stable")
                own, of = own[order], of[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | ((of[1:] != of[:-1]) & per_document)
                at = np.flatnonzero(new)
                n, own, of = np.diff(np.append(at, len(own))), own[at], of[at]
                hints = _hints(context[order[at]], word[order[at]]) if rare and not per_document else None
                cuts = np.searchsorted(_bucket(own, buckets, rare), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    x = slice(cuts[b], cuts[b + 1])
                    more = [of[x]] if per_document else [hints[x]] if rare else []
                    at_bucket = b + buckets * rare
                    salt = 0 if salts is None else ((task >> 32) * 31 + count) % int(salts[at_bucket])
                    rows.append((at_bucket, salt, task + count, target, _pack(own[x], n[x], *more)))
            count += 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "salt", "chunk", "target", "bits"])

    return docs.mapInArrow(run, "bucket int, salt int, chunk long, target boolean, bits binary")


def _add(keys: list[np.ndarray], *columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys, where each is first, and the sums of their counts."""
    every, at, which = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
    sums = [np.bincount(which.reshape(-1), weights=np.concatenate([*c, np.zeros(0, np.uint64)]), minlength=len(every)).astype(np.uint64) for c in columns]
    return [every, at, *sums]


def _totals(chunks: DataFrame, partitions: int) -> DataFrame:
    """(bucket, tokens, bits): every bigram, its counts in the background and in the target, and the hint of a rare one; ``tokens`` are all
    of the background. A bucket's chunks are added up as they come."""

    def run(parts):
        now, held = None, []

        def sums():
            keys, background, target, *hints = zip(*held, strict=True)
            every, at, *counts = _add(keys, background, target)
            return every, *counts, *(np.concatenate(x)[at] for x in hints)

        def out():
            found = sums()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([int(found[1].sum())], pa.int64()), pa.array([_pack(*found)], pa.binary())], ["bucket", "tokens", "bits"])

        for part in parts:
            for bucket, target, bits in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and held:
                    yield out()
                    held = []
                now = bucket
                keys, n, *hints = _unpack(bits)
                held.append((keys, n * (not target), n * target, *hints))
                if len(held) == 16:
                    held = [sums()]
        if held:
            yield out()

    rows = chunks.select("bucket", "target", "bits").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "bucket int, tokens long, bits binary")


def _read(bits: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's totals: keys, counts, the distinct words of bigrams, and the places in them of each bigram's word and context."""
    keys, background, target, *hints = _unpack(bits)
    contexts, words = _both(keys, hints[0] if hints else None)
    found, which = np.unique(np.concatenate([words, contexts]), return_inverse=True)
    return keys, [background, target], found, which.reshape(-1)[: len(keys)], which.reshape(-1)[len(keys) :]


def _word_sums(totals: DataFrame, partitions: int) -> DataFrame:
    """(bucket, part, bits): for the distinct words of each bucket of bigrams, in order by part, their counts as word and as context in
    background and target. Rows of bucket -1 have a part's numbers: of words, and of tokens in background and target."""

    def ask(parts):
        for part in parts:
            rows = []
            for bucket, bits in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                _, counts, found, word, context = _read(bits)
                sums = [np.bincount(at, weights=n, minlength=len(found)).astype(np.uint64) for at in (word, context) for n in counts]
                part_of = _bucket(found * ODD, partitions)
                order = np.argsort(part_of, kind="stable")
                found, sums = found[order], [c[order] for c in sums]
                cuts = np.searchsorted(part_of[order], np.arange(partitions + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    x = slice(cuts[p], cuts[p + 1])
                    rows.append((bucket, p, _pack(found[x], *(c[x] for c in sums))))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "part", "bits"])

    def answer(parts):
        now, asked = None, []

        def out():
            every, held = np.zeros(0, np.uint64), []
            for _, bits in asked:
                held.append(_unpack(bits))
                if len(held) == 16:
                    held = [(lambda x: [x[0], *x[2:]])(_add(*zip(*held, strict=True)))]
            every, _, *sums = _add(*zip(*held, strict=True))
            own = (every >= FIRST) & (sums[0] + sums[1] > 0)
            buckets, coded = [-1], [_pack(np.array([own.sum(), sums[0].sum(), sums[1].sum()], np.uint64), rising=False)]
            for bucket, bits in asked:
                at = np.searchsorted(every, _unpack(bits)[0])
                buckets.append(bucket)
                coded.append(_pack(*(c[at] for c in sums), rising=False))
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([now] * len(buckets), pa.int32()), pa.array(coded, pa.binary())], ["bucket", "part", "bits"])

        for part in parts:
            for bucket, p, bits in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if p != now and asked:
                    yield out()
                    asked = []
                now = p
                asked.append((bucket, bits))
        if asked:
            yield out()

    rows = totals.select("bucket", "bits").mapInArrow(ask, "bucket int, part int, bits binary")
    return rows.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(answer, "bucket int, part int, bits binary")


def differences(background: np.ndarray, target: np.ndarray, words: list[np.ndarray], contexts: list[np.ndarray], tokens: list[int], size: int) -> np.ndarray:
    """Loss under the target model less that under the background model of each bigram, in 2**-20 nats. ``words`` and ``contexts`` are
    the counts of each bigram's ends in background and target, ``tokens`` all of these, ``size`` the number of words of the models."""
    loss = []
    for m, n in ((0, background), (1, target)):
        single = words[m] / max(1, tokens[m])
        pair = np.where(contexts[m] > 0, n / np.maximum(contexts[m], 1), single)
        loss.append(-np.log((1 - UNIGRAM - UNIFORM) * pair + UNIGRAM * single + UNIFORM / size))
    return np.rint((loss[1] - loss[0]) * SCALE).astype(np.int64)


def _signless(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _values(totals: DataFrame, sums: DataFrame, partitions: int, word_parts: int, tokens: list[int], size: int) -> DataFrame:
    """(bucket, bits): every bigram and its loss difference."""

    def run(parts):
        now, bigrams, held = None, None, []

        def out():
            keys, (background, target), found, word, context = _read(bigrams)
            order = np.argsort(_bucket(found * ODD, word_parts), kind="stable")
            counts = [np.zeros(len(found), np.uint64) for _ in range(4)]
            for c, x in zip(counts, zip(*held, strict=True), strict=True):
                c[order] = np.concatenate(x)
            d = differences(background, target, [c[word] for c in counts[:2]], [c[context] for c in counts[2:]], tokens, size)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(keys, _signless(d))], pa.binary())], ["bucket", "bits"])

        for part in parts:
            for bucket, p, bits in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if p < 0:
                    if held:
                        yield out()
                    now, bigrams, held = bucket, bits, []
                else:
                    held.append(_unpack(bits, rising=False))
        if held:
            yield out()

    rows = totals.select("bucket", F.lit(-1).alias("part"), "bits").unionByName(sums.where("bucket >= 0"))
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(run, "bucket int, bits binary")


def _numbered(docs: DataFrame, vocabulary: int | None) -> Words:
    """At most 2**16 listed words: the most frequent of some documents or of the vocabulary."""
    if vocabulary is not None:
        only = word_hashes(_most_frequent(_count_words(docs).groupBy("word").agg(F.sum("n").alias("n")), vocabulary))[0]
        return Words(only[: LISTED - FIRST], only)

    def run(parts):
        for part in parts:
            for texts in batches(part.column(0), CHUNK * 4):
                found, n = np.unique(word_hashes(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "n"])

    every = max(1, docs.count() // LIST_DOCUMENTS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "word").limit(LISTED - FIRST).toPandas()["word"]
    return Words(found.to_numpy(np.int64).view(np.uint64))


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", vocabulary: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of ``docs``, scored as whole texts by models of ``target`` and of ``docs`` itself.

    A token is a word (lower case) or a run of marks; null texts are empty, and a text without tokens has a score of 0. Rows stay
    rows. Without target texts, the target model is uniform. With ``vocabulary``, only so many of the most frequent words of ``docs`` are
    told apart; without, all words of both are.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(False).alias("target"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text"), F.lit(True).alias("target"))
    known = spark.sparkContext.broadcast(_numbered(own, vocabulary))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    totals = written(_totals(_chunks(own.unionByName(wanted), known, buckets, False), partitions))
    tokens_of = np.zeros(2 * buckets, np.int64)
    for r in totals.select("bucket", "tokens").collect():  # one number of each bucket
        tokens_of[r.bucket] = r.tokens
    # parts of words by the corpus's tokens, so that what a part is asked stays of one size
    parts = int(max(1, partitions // 4, -(-int(tokens_of.sum()) // PART)))
    sums_of_words = written(_word_sums(totals, parts))
    salts = np.clip(-(-tokens_of * 2 * buckets // max(1, int(tokens_of.sum()))), 1, SALTS)
    numbers = np.zeros(3, np.int64)
    for r in sums_of_words.where("bucket < 0").select("bits").collect():  # three numbers of each part
        numbers += _unpack(bytes(r.bits), rising=False)[0].astype(np.int64)
    size, *tokens = numbers.tolist()
    values = written(_values(totals, sums_of_words, partitions, parts, tokens, size + FIRST))
    discard(totals)
    discard(sums_of_words)

    # a bucket's loss differences come first in each of its tasks, then its chunks
    def over_salts(parts):
        for part in parts:
            n = salts[part.column(0).to_numpy()]
            which = pa.array(np.repeat(np.arange(part.num_rows), n))
            salt = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first = pa.array(np.full(len(salt), -1, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).take(which), pa.array(salt.astype(np.int32)), first, part.column(1).take(which)], ["bucket", "salt", "chunk", "bits"])

    counts = values.mapInArrow(over_salts, "bucket int, salt int, chunk long, bits binary")
    per_document = _chunks(own, known, buckets, True, salts).drop("target")
    dealt = counts.unionByName(per_document).repartition(partitions, "bucket", "salt").sortWithinPartitions("bucket", "salt", "chunk")

    def sums(parts):
        keys = values = None
        for part in parts:
            chunks, bits_out = [], []
            for bucket, chunk, bits in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket < 0:
                    chunks.append(chunk)
                    bits_out.append(b"\x00" + bits)
                elif chunk < 0:
                    keys, coded = _unpack(bits)
                    values = _signed(coded)
                else:
                    own_keys, n, doc = _unpack(bits)
                    d = values[np.searchsorted(keys, own_keys)] * n.astype(np.int64)
                    docs_here, which = np.unique(doc, return_inverse=True)
                    total = np.zeros(len(docs_here), np.int64)
                    np.add.at(total, which.reshape(-1), d)
                    chunks.append(chunk)
                    bits_out.append(b"\x01" + _pack(docs_here, _signless(total)))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(bits_out, pa.binary())], ["chunk", "bits"])

    def scores(parts):
        now, head, total = None, None, np.zeros(0, np.int64)

        def out():
            n = np.array(head.column(1))
            all_of = np.zeros(max(len(n), len(total)), np.int64)
            all_of[: len(total)] = total
            mean = np.where(n > 0, all_of[: len(n)] / np.maximum(n, 1) / SCALE, 0.0)
            return pa.RecordBatch.from_arrays([head.column(0), pa.array(n, pa.int64()), pa.array(mean)], ["doc_id", "n_tokens", "score"])

        for part in parts:
            for chunk, bits in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if chunk != now:
                    if head is not None:
                        yield out()
                    now, head, total = chunk, None, np.zeros(0, np.int64)
                if bits[0] == 0:
                    head = next(iter(pa.ipc.open_stream(bits[1:])))
                    continue
                at, coded = _unpack(bits[1:])
                if len(at) and int(at[-1]) >= len(total):
                    total = np.append(total, np.zeros(int(at[-1]) + 1 - len(total), np.int64))
                total[at.astype(np.int64)] += _signed(coded)
        if head is not None:
            yield out()

    rows = dealt.select("bucket", "chunk", "bits").mapInArrow(sums, "chunk long, bits binary")
    return rows.repartition(partitions, "chunk").sortWithinPartitions("chunk").mapInArrow(scores, "doc_id long, n_tokens long, score double")
