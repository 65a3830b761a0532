"""Vector and string similarity searches and self-joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import blocks, scores
from tidepool.operators.graph import cut

def vector_of(vectors: DataFrame, vec_id: int) -> list[float]:
    """One query vector, as a literal of the plan."""
    found = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return [] if found is None else [float(x) for x in found[0]]


def to_query(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, similarity) of every vector to one query vector: a projection, without a join."""
    return vectors.select("vec_id", scores.cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("similarity"))


def of_memories(vectors: DataFrame, memories: DataFrame) -> DataFrame:
    """Vectors that belong to a memory. A cut by similarity comes after this, or it would take places for vectors without one."""
    return vectors.join(memories.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")


def semantic_query(memories: DataFrame, vectors: DataFrame, vec_id: int, n: int, now: Column) -> DataFrame:
    """The n best memories for a query vector: more than n by similarity, then scored with decay and importance."""
    near = to_query(of_memories(vectors, memories), vector_of(vectors, vec_id)).orderBy(F.desc("similarity"), "vec_id").limit(max(n + 5, int(1.5 * n)))
    rows = memories.join(F.broadcast(near), F.col("id") == F.col("vec_id"))
    decayed = scores.simple_decay(F.lit(1.0), F.col("created_at"), F.col("access_count"), now)
    rows = rows.select("id", scores.retrieval(F.col("similarity"), F.col("importance"), decayed).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(n).select("id", F.round("score", 6).alias("score"))


#: Strings of more bytes are looked up by parts alone, without their places.
PLACED = 128
#: Strings that share a part are paired as rows up to so many pairs, else compared in tiles: of so many strings a side, of so many bytes.
MANY, TILE, TILE_BYTES = 1 << 16, 4096, 1 << 20
_PART = ["block", "kind", "i", "part"]


def _parts(texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Parts that strings x look for, and those that strings y hold: what ``string_candidates`` pairs.

    A pair's distance is at most t = (1 - least) * n. Cut the longer string into t + 1 parts: edits can't touch all of them, so one part
    lies in the shorter string as it is, and it can be chosen so that part i has i edits before it (and t - i at most behind it), which
    bounds how far it has moved. So strings meet by (size, part's number, part) where the part's place allows it; strings that share no
    part never meet. Long strings are cut into parts of one width and meet by these alone, so that what is looked up grows with their size
    and not with its cube.
    """
    edits = lambda n: F.floor((1 - least) * n + 1e-9).cast("int")
    begin = lambda k: F.floor(k * F.col("n") / (F.col("t") + 1)).cast("int")
    width = lambda n: F.greatest(F.lit(1), F.floor(n / (edits(n) + 1))).cast("int")
    cut = texts.where("m > 0").select("block", F.col("x").alias("y"), F.col("m").alias("n")).withColumn("t", edits(F.col("n")))
    short = cut.where(F.col("n") <= PLACED).withColumn("i", F.explode(F.sequence(F.lit(0), "t")))
    short = short.select("block", "y", "n", F.col("n").alias("kind"), "i", F.substring("y", begin(F.col("i")) + 1, begin(F.col("i") + 1) - begin(F.col("i"))).alias("part"))
    long = cut.where(F.col("n") > PLACED).withColumn("w", width(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), "t")))
    long = long.select("block", "y", "n", (-F.col("w")).alias("kind"), F.lit(0).alias("i"), F.substring("y", F.col("i") * F.col("w") + 1, F.col("w")).alias("part")).distinct()

    reach = F.floor(F.col("m") / least + 1e-9).cast("int")
    sizes = F.sequence("m", F.least(reach, F.greatest(F.lit(PLACED), F.col("m"))))
    asked = texts.where((F.col("m") > 0) & (F.col("m") <= PLACED)).withColumn("n", F.explode(sizes)).where(F.col("n") <= PLACED).withColumn("t", edits(F.col("n"))).where("m >= n - t")
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), "t"))).withColumn("p", begin(F.col("i"))).withColumn("w", begin(F.col("i") + 1) - F.col("p"))
    first = F.greatest(F.lit(0), F.col("p") - F.col("i"), F.col("p") + F.col("m") - F.col("n") - (F.col("t") - F.col("i")))
    last = F.least(F.col("m") - F.col("w"), F.col("p") + F.col("i"), F.col("p") + F.col("m") - F.col("n") + (F.col("t") - F.col("i")))
    asked = asked.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("q", F.explode(F.sequence("first", "last")))
    asked = asked.select("block", "x", "m", F.col("n").alias("kind"), "i", F.substring("x", F.col("q") + 1, F.col("w")).alias("part"))
    widths = F.array_distinct(F.transform(F.sequence(F.greatest(F.lit(PLACED + 1), F.col("m")), reach), width))
    whole = texts.where(reach > PLACED).withColumn("w", F.explode(widths)).where("w <= m")
    whole = whole.withColumn("q", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("w") + 1))).select("block", "x", "m", (-F.col("w")).alias("kind"), F.lit(0).alias("i"), F.substring("x", F.col("q"), F.col("w")).alias("part"))

    return asked.unionByName(whole).distinct(), short.unionByName(long)


def _paired(asked: DataFrame, held: DataFrame, least: float) -> DataFrame:
    edits = F.floor((1 - least) * F.col("n") + 1e-9)
    apart = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("x") < F.col("y")))
    first = F.floor(F.col("n") / (edits + 1)).cast("int")
    once = (F.col("kind") < 0) | (F.col("i") == 0) | (F.substring("x", F.lit(1), first) != F.substring("y", F.lit(1), first))
    return asked.join(held, _PART).where(apart & (F.col("m") >= F.col("n") - edits) & once).select("block", "x", "y", "m", "n")


def string_candidates(texts: DataFrame, least: float) -> DataFrame:
    """(block, x, y, m, n) of pairs of different strings that may be similar: ``texts`` has a block, a string x of one character a byte, and
    its size m; y is the longer one of a pair (of equal sizes the greater), of size n. A pair comes once for each part it shares, but by the first
    part alone if it shares that one (short strings)."""
    return _paired(*_parts(texts, least), least)


def _tiles(rows: DataFrame, text: str, size: str) -> DataFrame:
    """Strings that share a part, in order of size and characters, in lists of ``TILE`` at most."""
    before = Window.partitionBy(*_PART).orderBy(size, text).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum(F.greatest(F.lit(1.0), F.col(size) * (TILE / TILE_BYTES))).over(before)
    return rows.withColumn("tile", F.floor((share - 1) / TILE)).groupBy(*_PART, "tile").agg(F.sort_array(F.collect_list(text)).alias(text + "s")).drop("tile")


def _by_size(texts: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(t) for t in texts])
    return {int(k): (at := np.flatnonzero(sizes == k), np.frombuffer(b"".join(texts[j] for j in at), np.uint8).reshape(len(at), k)) for k in np.unique(sizes)}


def _distances(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of all rows of x (of one size) to all of y (of one size, that of x or more); of those over ``most`` only that they are."""
    (a, m), (b, n) = x.shape, y.shape
    spare = (most - (n - m)) // 2  # a path of so few edits stays on these diagonals
    kind = np.int8 if m + n < 120 else np.int16 if m + n < 32_000 else np.int32
    far = m + n + 1
    row = {k: np.full((a, b), k if 0 <= k <= n else far, kind) for k in range(-spare, n - m + spare + 1)}
    other, beside = np.empty((a, b), bool), np.empty((a, b), kind)
    for i in range(1, m + 1):
        for k, cell in row.items():
            j = i + k
            if not 0 < j <= n:
                cell.fill(i if j == 0 else far)
                continue
            np.not_equal(x[:, i - 1, None], y[None, :, j - 1], out=other)
            np.add(cell, other.view(np.int8), out=cell)
            for near in (k + 1, k - 1):
                if near in row:
                    np.minimum(cell, np.add(row[near], 1, out=beside), out=cell)
    return row[n - m]


def _tile_pairs(batches, least: float):
    """(block, x, y, n, d) of the similar pairs of two tiles."""
    for batch in batches:
        for r in range(batch.num_rows):
            kind, part, xs, ys = (batch.column(c)[r].as_py() for c in ("kind", "i", "xs", "ys"))
            rank = {t: k for k, t in enumerate(sorted({*xs, *ys}))}
            rank_x, rank_y = (np.array([rank[t] for t in side]) for side in (xs, ys))
            names_x, names_y = pa.array(xs), pa.array(ys)
            left, right = (_by_size([t.encode("latin-1") for t in side]) for side in (xs, ys))
            for m, (at_x, x) in left.items():
                for n, (at_y, y) in right.items():
                    most = int(np.floor((1 - least) * n + 1e-9))
                    if not n - most <= m <= n or m == n and rank_x[at_x[0]] >= rank_y[at_y[-1]]:
                        continue
                    ends = [x[0], x[-1], y[0], y[-1]]  # in order, so all rows begin as these do
                    begin = next((k for k in range(m) if len({int(e[k]) for e in ends}) > 1), m)
                    first = n // (most + 1) if kind > 0 and part > 0 else 0  # pairs that share the first part too meet there
                    if 0 < first <= begin:
                        continue
                    end = next((k for k in range(m - begin) if len({*x[:, m - 1 - k], *y[:, n - 1 - k]}) > 1), m - begin)
                    u, v = x[:, begin : m - end], np.asfortranarray(y[:, begin : n - end])
                    step = max(1, (1 << 17) // len(at_y))
                    for k in range(0, len(at_x), step):
                        d = _distances(np.asfortranarray(u[k : k + step]), v, most)
                        p, q = np.nonzero(d <= most)
                        own = slice(None) if m < n else rank_x[at_x[k + p]] < rank_y[at_y[q]]
                        p, q = p[own], q[own]
                        if first:
                            own = (x[k + p, :first] != y[q, :first]).any(axis=1)
                            p, q = p[own], q[own]
                        if len(p):
                            columns = [batch.column("block").take(pa.array(np.full(len(p), r))), names_x.take(pa.array(at_x[k + p])), names_y.take(pa.array(at_y[q])), pa.array(np.full(len(p), n, np.int32)), pa.array(d[p, q].astype(np.int32))]
                            yield pa.RecordBatch.from_arrays(columns, names=["block", "x", "y", "n", "d"])


def similar_strings(texts: DataFrame, least: float) -> DataFrame:
    """(block, x, y, similarity) of pairs of different strings whose edit distance leaves ``least`` or more.

    Strings that share a part (``string_candidates``) are paired as rows where these are few. Where many share one, as names with a common
    beginning do, they are dealt into tiles, and all of two tiles are compared at once, behind what all of them begin with; so no row is
    made for a pair that isn't similar.
    """
    wide = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(texts.repartition(wide))
    asked, held = _parts(texts, least)
    counts = asked.groupBy(*_PART).agg(F.count("*").alias("askers")).join(held.groupBy(*_PART).agg(F.count("*").alias("holders")), _PART)
    many = counts.where(F.col("askers") * F.col("holders") > MANY).select(*_PART)
    tiles = _tiles(asked.join(many, _PART, "left_semi"), "x", "m").join(_tiles(held.join(many, _PART, "left_semi"), "y", "n"), _PART)
    tiles = tiles.select("block", "kind", "i", "xs", "ys").repartition(4 * wide)  # those of one part are many tasks
    kind = texts.schema["block"].dataType.simpleString()
    close, other = (tiles.where(f"{first} (kind > 0 AND i = 0)").mapInArrow(lambda batches: _tile_pairs(batches, least), f"block {kind}, x string, y string, n int, d int") for first in ("", "NOT"))
    pairs = _paired(asked.join(many, _PART, "left_anti"), held, least).distinct()
    distance = F
    for most in (8, 16, 32, 64, 128, 256, 1024):  # a distance over what the longest of a range of lengths allows ends early, and is -1
        distance = distance.when(F.col("n") <= most, F.levenshtein("x", "y", int(most * (1 - least)) + 1))
    distance = distance.otherwise(F.levenshtein("x", "y"))
    pairs = pairs.select("block", "x", "y", "n", distance.alias("d")).where("d >= 0").unionByName(other).distinct().unionByName(close)
    return pairs.select("block", "x", "y", (1.0 - F.col("d") / F.col("n")).alias("similarity")).where(F.col("similarity") >= least)


def letters(text: Column) -> Column:
    """Bytes as characters, decoded once a row and not once a pair."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def letters_of(rows: DataFrame, text: str, block: str | None = None) -> DataFrame:
    """(block, x, m) of the different texts: what ``similar_strings`` takes."""
    found = rows.where(F.col(text).isNotNull()).select((F.col(block) if block else F.lit(0)).alias("block"), letters(F.col(text)).alias("x")).distinct()
    return found.withColumn("m", F.char_length("x"))


#: Rows of one string in a list, about: those of two similar strings are paired list by list.
LIST = 1024


def near_strings(rows: DataFrame, id: str, text: str, least: float, block: str | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, similarity) of pairs a < b whose byte edit distance leaves ``least`` (more than 0, 1 at most) or more, inside ``block`` if one is
    named; the similarity is rounded to ``digits``, once for two strings.

    Each string of a block is compared once, however many rows have it; then its rows are paired, as many as there are pairs to return: the
    rows of a string lie in lists, and pairs of lists are dealt to all tasks, so what is shuffled grows with the rows and not with their
    pairs, and a task holds two lists. Null texts pair with none, empty ones with each other.
    """
    if not 0 < least <= 1:
        raise ValueError("least lies above 0 and is 1 at most")
    own = rows.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), letters(F.col(text)).alias("x"), (F.col(block) if block else F.lit(0)).alias("block"))
    near = similar_strings(letters_of(rows, text, block), least)
    if digits is not None:
        near = near.withColumn("similarity", F.round("similarity", digits))
    lists = own.join(own.groupBy("block", "x").agg(F.ceil(F.count("*") / LIST).alias("n")), ["block", "x"]).groupBy("block", "x", F.pmod(F.xxhash64("id"), "n").alias("k")).agg(F.collect_list("id").alias("ids"))
    a, b = lists.select("block", "x", F.col("k").alias("j"), F.col("ids").alias("a")), lists.select("block", F.col("x").alias("y"), "k", F.col("ids").alias("b"))
    apart = near.join(a, ["block", "x"]).join(b, ["block", "y"]).select("a", "b", "similarity", F.lit(False).alias("one"))
    same = a.join(b.withColumnRenamed("y", "x"), ["block", "x"]).where("j <= k AND (j < k OR size(a) > 1)").select("a", "b", F.lit(1.0).alias("similarity"), (F.col("j") == F.col("k")).alias("one"))
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = apart.unionByName(same).repartition(8 * wide)
    pairs = pairs.select(F.explode("a").alias("a"), "b", "similarity", "one").select("a", F.explode("b").alias("b"), "similarity", "one").where(F.when(F.col("one"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def novel(rows: DataFrame, id: str, text: str, n: int = 3) -> DataFrame:
    """Rows whose text, without case, neither holds another row's text nor lies in one.

    What holds a text holds its runs of ``n`` characters, so a text looks for its rarest run only (a shorter text for itself) among the runs
    of all others; of equal texts one is compared, and none of them is novel. A null text isn't compared and stays.
    """
    keyed = rows.select(F.col(id).alias("_id"), F.lower(text).alias("_t"))
    texts = keyed.where("_t IS NOT NULL").groupBy("_t").agg(F.count("*").alias("copies"))
    run = lambda size: F.transform(F.sequence(F.lit(1), F.char_length("_t") - size + 1), lambda k: F.substring(F.col("_t"), k, F.lit(size)))
    runs = F.array_distinct(F.flatten(F.array(*[F.when(F.char_length("_t") >= k, run(k)).otherwise(F.array().cast("array<string>")) for k in range(1, n + 1)])))
    held = texts.select(F.col("_t").alias("long"), F.explode(runs).alias("run"))
    whole = F.when(F.char_length("_t") >= n, F.array_distinct(run(n))).otherwise(F.array("_t"))
    often = held.groupBy("run").agg(F.count("*").alias("often"))
    rarest = texts.select("_t", F.explode(whole).alias("run")).join(often, "run").groupBy("_t").agg(F.min_by("run", F.struct("often", "run")).alias("run"))
    pairs = rarest.join(held, "run").where((F.col("_t") != F.col("long")) & F.contains(F.col("long"), F.col("_t"))).select("_t", "long")
    alike = pairs.select(F.explode(F.array("_t", "long")).alias("_t")).unionByName(texts.where("copies > 1").select("_t")).unionByName(_all_where_empty(texts))
    return rows.join(keyed.join(alike.distinct(), "_t", "left_semi").select(F.col("_id").alias(id)), id, "left_anti")


def _all_where_empty(texts: DataFrame) -> DataFrame:
    """All texts, if one is empty (which lies in all) and there are others; else none."""
    one = texts.where("_t = ''").limit(1).select(F.lit(1).alias("empty"))
    others = texts.where("_t <> ''").limit(1).select(F.lit(1).alias("other"))
    return texts.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(others)).select("_t")  # one row each


def block_ratio(a: Column, b: Column, n: int | None = 500) -> Column:
    """The share of matching blocks of two texts' first ``n`` characters (None: of the whole) in lower case; texts that are both empty have 1."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        cut = lambda column: [(s or "").lower()[:n] for s in column]
        return pd.Series(blocks.ratios(cut(x), cut(y)))

    return ratio(a, b)
