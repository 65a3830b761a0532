"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens. At first it has one state with a loop for each byte.
Each merge (a, b), in the vocabulary's order, adds its gadget: wherever a path
"a b" is possible, the way on by b is taken out of a copy of the state that a
leads to, a now leads to the copy, and an arc "ab" is added beside each arc a,
leading to where b led. What it accepts in the end are exactly the token
sequences that merging makes.

Arcs of one label always lead to one state, so the table keeps, for each token,
the state it leads to (``state_of``) and the class of tokens that are possible
after the same states (``class_of``), and one bit for each state and class. States
and classes are only copied when a merge sets one token apart from others.

Words (as the byte-level pre-tokenizer splits) are encoded from left to right:
each prefix of a word has one tokenization and so leads to one state, and a
token may follow a prefix if its bytes do and its class's bit is set. All new
words of a batch go through the tables together in numpy; words seen before are
looked up by a hash, and their bytes are compared. Decoding emits the bytes of each id's arc label.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import keyed_hashes, small_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The endings that are split from a word after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Kinds of characters.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Words and bytes of words that a worker keeps with their ids; beyond, it starts anew.
KNOWN_WORDS, KNOWN_BYTES = 500_000, 8 << 20
#: Words of more bytes are encoded one by one.
LONG_WORD = 48


def _bytes_of_letters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The compiled tables of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _bytes_of_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * self.size
        for token, k in ids.items():
            self.labels[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, k in self.special.items():
            self.labels[k] = token.encode()
        self._compile([(ids[a], ids[b], ids[a + b]) for a, b in merges], [k for t, k in ids.items() if len(t) == 1 and t in letters])
        self._trie([k for k in ids.values() if k not in set(self.special.values())])

    def _compile(self, merges: list[tuple[int, int, int]], single: list[int]) -> None:
        states = classes = len(merges) + 2  # at most; the table grows as they come
        table = np.zeros((1024, 64), np.uint8)
        state_of, class_of = np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        state_of[single] = class_of[single] = 0
        table[0, 0] = 1
        users, members = [len(single)] + [0] * (states - 1), [len(single)] + [0] * (classes - 1)
        n_states = n_classes = 1
        for a, b, ab in merges:
            after_b = state_of[b]
            if not table[state_of[a], class_of[b] >> 3] >> (class_of[b] & 7) & 1:
                continue  # nothing has "a b" any more
            more = [len(table) * (n_states + 1 >= len(table)), table.shape[1] * ((n_classes >> 3) + 1 >= table.shape[1])]
            if any(more):
                table = np.pad(table, [(0, k) for k in more])
            if users[s := state_of[a]] > 1 or a == b:
                users[s] -= 1
                users[n_states] += 1
                table[n_states, : (n_classes >> 3) + 1] = table[s, : (n_classes >> 3) + 1]
                state_of[a] = n_states
                n_states += 1
            if members[c := class_of[b]] > 1:
                members[c] -= 1
                members[n_classes] += 1
                bits = table[:n_states, c >> 3] >> (c & 7) & 1
                table[:n_states, n_classes >> 3] |= (bits << (n_classes & 7)).astype(np.uint8)
                class_of[b] = n_classes
                n_classes += 1
            table[state_of[a], class_of[b] >> 3] &= np.uint8(255 ^ (1 << int(class_of[b] & 7)))
            state_of[ab] = after_b  # for "aa", what was possible after "a" until now
            class_of[ab] = class_of[a]
            users[state_of[ab]] += 1
            members[class_of[ab]] += 1
        self.table, self.state_of, self.class_of = table[:n_states, : (n_classes >> 3) + 1].copy(), state_of, class_of

    def _trie(self, tokens: list[int]) -> None:
        """Bytes to tokens. Only nodes with children have a row; ``row`` of others is 0, which leads nowhere. The rows of 256 places, nearly
        all empty, lie over each other: a row's place of a byte is ``base`` of the row plus the byte, and is its own if it is the ``owner``."""
        nodes: dict[bytes, int] = {b"": 1}
        inner = {b""}
        for k in tokens:
            label = self.labels[k]
            for n in range(1, len(label) + 1):
                nodes.setdefault(label[:n], len(nodes) + 1)
                inner.add(label[: n - 1])
        rows = {label: k + 1 for k, label in enumerate(sorted(inner, key=lambda x: nodes[x]))}
        self.row = np.zeros(len(nodes) + 1, np.int32)
        self.token = np.full(len(nodes) + 1, -1, np.int32)
        edges = np.zeros((len(nodes) - 1, 3), np.int32)  # row, byte, node
        for label, node in nodes.items():
            if label:
                edges[node - 2] = rows[label[:-1]], label[-1], node
            self.row[node] = rows.get(label, 0)
        row, byte, node = edges[np.argsort(edges[:, 0], kind="stable")].T
        ends = np.searchsorted(row, np.arange(len(rows) + 2))
        self.base = np.zeros(len(rows) + 1, np.int32)
        # rows of several bytes take the first base whose places are all free, those of most bytes first; rows of one byte take what is left
        size = np.diff(ends)
        free = (1 << (2 * len(edges) + 512)) - 1
        for r in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
            own = byte[ends[r] : ends[r + 1]].tolist()
            fits = free
            for c in own:
                fits &= free >> c
            self.base[r] = at = (fits & -fits).bit_length() - 1
            free ^= sum(1 << c for c in own) << at
        left = np.unpackbits(np.frombuffer(free.to_bytes(free.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")
        single = np.flatnonzero(size == 1)
        self.base[single] = np.flatnonzero(left[255:])[: len(single)] + 255 - byte[ends[single]]
        places = self.base[row] + byte
        self.owner = np.full(int(self.base.max()) + 256, -1, np.int32)
        self.next = np.zeros(len(self.owner), np.int32)
        self.owner[places], self.next[places] = row, node
        for k in tokens:
            if self.state_of[k] >= 0:
                self.token[nodes[self.labels[k]]] = k

    def _node(self, row, byte):
        """The nodes that the bytes lead to from the rows; 0 is none."""
        at = self.base[row] + byte
        return self.next[at] * (self.owner[at] == row)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        lengths = np.array([len(w) for w in words])
        short = np.flatnonzero(lengths <= LONG_WORD)
        for some in np.array_split(short[np.argsort(lengths[short], kind="stable")], max(1, len(short) // 8192)):
            if len(some):
                self._encode_together([words[k] for k in some], some, out)
        for k in np.flatnonzero(lengths > LONG_WORD):
            out[k] = self._encode_alone(words[k])
        return out

    def _encode_together(self, words: list[bytes], at: np.ndarray, out: list) -> None:
        longest = max(map(len, words))
        text = np.zeros((len(words), longest + 1), np.uint8)
        size = np.array([len(w) for w in words])
        text[np.arange(longest + 1)[None, :] < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        token, state = np.full((len(words), longest + 1), -1, np.int32), np.full((len(words), longest + 1), -1, np.int32)
        state[:, 0] = 0
        start = self.row[1]
        for j in range(longest):
            w = np.flatnonzero((state[:, j] >= 0) & (size > j))
            row, s = np.full(len(w), start), state[w, j]
            for k in range(j, longest):
                node = self._node(row, text[w, k])
                t = self.token[node]
                if len(hit := np.flatnonzero(t >= 0)):
                    c = self.class_of[t[hit]]
                    # at the beginning of a word every token is possible that merging can make
                    hit = hit[(self.table[s[hit], c >> 3] >> (c & 7) & 1).astype(bool)] if j else hit[(self.table[0, c >> 3] >> (c & 7) & 1).astype(bool)]
                    token[w[hit], k + 1], state[w[hit], k + 1] = t[hit], self.state_of[t[hit]]
                row = self.row[node]
                on = (row > 0) & (size[w] > k + 1)
                if not on.all():
                    w, row, s = w[on], row[on], s[on]
                    if not len(w):
                        break
        # back from the ends
        length = self._label_sizes
        here, found = size.copy(), []
        live = np.flatnonzero(here > 0)
        while len(live):
            t = token[live, here[live]]
            found.append((live, t))
            here[live] -= length[t]
            live = live[here[live] > 0]
        n = np.zeros(len(words), np.int64)
        for live, _ in found:
            n[live] += 1
        ends = np.cumsum(n)
        flat, fill = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32), ends.copy()
        for live, t in found:
            fill[live] -= 1
            flat[fill[live]] = t
        for k, a, b in zip(at.tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
            out[k] = flat[a:b]

    @property
    def _label_sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.array([len(x) for x in self.labels])
        return self._sizes

    def _encode_alone(self, word: bytes) -> np.ndarray:
        row_of, token_at, table = self.row, self.token, self.table
        n = len(word)
        token, state = [-1] * (n + 1), [-1] * (n + 1)
        state[0] = 0
        for j in range(n):
            if (s := state[j]) < 0:
                continue
            row = row_of[1]
            for k in range(j, n):
                node = self._node(row, word[k])
                if (t := token_at[node]) >= 0:
                    c = self.class_of[t]
                    if table[s, c >> 3] >> (c & 7) & 1:
                        token[k + 1], state[k + 1] = int(t), int(self.state_of[t])
                row = row_of[node]
                if not row:
                    break
        ids = []
        while n > 0:
            ids.append(token[n])
            n -= len(self.labels[token[n]])
        return np.array(ids[::-1], np.uint32)

    def decode(self, ids) -> bytes:
        """The labels of the arcs of ``ids``."""
        labels = self.labels
        return b"".join([labels[k] for k in ids])


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind
    # a run of one kind that reaches over the surrogates takes these in, which texts don't hold
    return kinds


def _same(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each run of ``size`` bytes (one at least) of ``a`` is that of ``b``."""
    if not len(size):
        return np.zeros(0, bool)
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    return np.logical_and.reduceat(a[np.repeat(a_start, size) + place] == b[np.repeat(b_start, size) + place], before)


class Encoder:
    """Splits texts into words and encodes them, with the ids of words seen before kept."""

    def __init__(self, path: str = VOCABULARY):
        self.automaton = Automaton(path)
        self.special = self.automaton.special
        self._special_pattern = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.bytes, self.byte_starts = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
        """Texts cut at special tokens: pieces, the text of each, the id of special ones or -1."""
        pieces, of, ids = [], [], []
        for k, text in enumerate(texts):
            if self._special_pattern and self._special_pattern.search(text):
                for x in self._special_pattern.split(text):
                    if x:
                        pieces.append(x)
                        of.append(k)
                        ids.append(self.special.get(x, -1))
            elif text:
                pieces.append(text)
                of.append(k)
                ids.append(-1)
        return pieces, np.array(of, np.int64), ids

    def _word_starts(self, pieces: list[str], ids: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All pieces as bytes, the start of each word in them, and the special id of each word or -1."""
        joined = "".join(pieces)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _kinds()[points]
        n = len(points)
        sizes = np.array([len(x) for x in pieces])
        first = np.cumsum(sizes) - sizes
        hard = np.zeros(n + 1, bool)
        hard[first] = hard[n] = True
        start = np.ones(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start |= hard
        # a run of white space gives its last character to what follows: a blank joins the next word, another stands alone
        space = kind == SPACE
        last = np.flatnonzero(space & start[1:] & ~hard[1:])  # the next character is no white space and in the same piece
        start[last] = True
        blank = last[points[last] == 32]
        start[blank + 1] = False
        # endings after an apostrophe that begins a word
        quotes = np.flatnonzero((points == 39) & start[:n])
        for q in quotes.tolist():
            tail = joined[q + 1 : q + 3]
            ending = next((e for e in ENDINGS if tail.startswith(e)), None)
            if ending and not hard[q + 1 : q + 1 + len(ending)].any():
                start[q + 1] = False
                start[q + 1 + len(ending)] = True
        special = np.flatnonzero(np.array(ids) >= 0)
        for k in special.tolist():
            start[first[k] + 1 : first[k] + sizes[k]] = False
            start[first[k]] = True
        at = np.flatnonzero(start[:n])
        word_id = np.full(len(at), -1, np.int64)
        if len(special):
            word_id[np.searchsorted(at, first[special])] = np.array(ids)[special]
        data = joined.encode("utf-8")
        if len(data) != n:
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = (np.cumsum(width) - width)[at]
        return data, at, word_id

    def _hashes(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """A hash of 64 bits of each word."""
        ends = np.append(at[1:], len(data))
        return keyed_hashes(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), at, ends - at, lambda k: data[at[k] : ends[k]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another as unsigned 32-bit integers, and where each text's begin (one more than texts)."""
        bounds = np.zeros(len(texts) + 1, np.int64)
        pieces, of, ids = self._pieces(texts)
        if not pieces:
            return np.zeros(0, np.uint32), bounds
        data, at, word_id = self._word_starts(pieces, ids)
        hashes = self._hashes(data, at)
        keys, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS or len(self.bytes) > KNOWN_BYTES:
            self._forget()
        units, size = np.frombuffer(data, np.uint8), np.diff(np.append(at, len(data)))
        take = lambda some: [data[a : a + b] for a, b in zip(at[some].tolist(), size[some].tolist(), strict=True)]
        slot = np.searchsorted(self.keys, keys)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == keys[known]
        if not known.all():
            new = np.flatnonzero(~known)
            words = take(example[new])
            coded = self.automaton.encode_words(words)
            where = np.append(self.where, len(self.starts) - 1 + np.arange(len(new)))
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(x) for x in coded]))
            self.flat = np.concatenate([self.flat, *coded])
            self.byte_starts = np.append(self.byte_starts, self.byte_starts[-1] + np.cumsum(size[example[new]]))
            self.bytes = np.append(self.bytes, np.frombuffer(b"".join(words), np.uint8))
            merged = np.append(self.keys, keys[new])
            order = np.argsort(merged, kind="stable")
            self.keys, self.where = merged[order], where[order]
            slot = np.searchsorted(self.keys, keys)
        word = self.where[slot][which.reshape(-1)]
        begin, n = self.starts[word], self.starts[word + 1] - self.starts[word]
        # a word whose bytes aren't those of the kept word of its hash is encoded for itself
        flat, other = self.flat, self.byte_starts[word + 1] - self.byte_starts[word] != size
        alike = np.flatnonzero(~other)
        other[alike] = ~_same(units, at[alike], self.bytes, self.byte_starts[word[alike]], size[alike])
        if (some := np.flatnonzero(other & (word_id < 0))).size:
            coded = self.automaton.encode_words(take(some))
            n[some] = [len(x) for x in coded]
            begin[some] = len(flat) + np.cumsum(n[some]) - n[some]
            flat = np.concatenate([flat, *coded])
        n = np.where(word_id >= 0, 1, n)
        ends = np.cumsum(n)
        flat = flat[np.minimum(np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1])), max(0, len(flat) - 1))]
        special = word_id >= 0
        flat[(ends - n)[special]] = word_id[special]
        # the text of each word, by the piece that it lies in
        piece_bytes = np.cumsum([0, *(len(x.encode()) for x in pieces)])
        word_text = of[np.searchsorted(piece_bytes, at, side="right") - 1]
        bounds[1:] = np.cumsum(np.bincount(word_text, weights=n, minlength=len(texts))).astype(np.int64)
        return flat, bounds


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def batches(column, most: int = 500_000):
    """Texts of an Arrow column in lists of about ``most`` bytes; null is empty. No more than a list is in Python's memory at once."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1
        yield [x or "" for x in column.slice(at, full - at).to_pylist()]
        at = full


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; null texts are empty, repeated rows stay rows.

    One pass over the input's own partitions, without a shuffle. ``encode`` and ``decode`` of the operator work on any texts.
    """

    def run(parts):
        coder = encoder(path)
        for part in parts:
            n, coded, decoded = [], [], []
            for texts in batches(part.column(1)):
                flat, bounds = coder.encode(texts)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = flat[a:b]
                    n.append(b - a)
                    coded.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    back = coder.automaton.decode(own.tolist()).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, text: str = "text", to: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the ids of ``text`` in the array column ``to``."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        flat, bounds = encoder(path).encode([x or "" for x in texts])
        return pd.Series([flat[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    return docs.withColumn(to, ids(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", to: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the text of the array column ``ids`` in the column ``to``; a null array is empty, and null ids in one are left out."""

    @F.pandas_udf("string")
    def texts(column):
        import pandas as pd

        automaton = encoder(path).automaton
        return pd.Series([automaton.decode([] if x is None else [int(k) for k in x if k is not None and k == k]).decode("utf-8", "replace") for x in column])

    return docs.withColumn(to, texts(F.col(ids)))
