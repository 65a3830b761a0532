import hashlib

import duckdb
from pyspark.sql import functions as F

from tidepool.llm import fingerprint, queries


def test_likeness_of_texts_of_many_lines(spark):
    texts = [(k, "\n".join(f"{k} {i}" for i in range(70_000))) for k in range(2)] + [(2, "\n".join(f"{0 if i % 2 else 2} {i}" for i in range(70_000)))]
    v = fingerprint.with_vector(spark.createDataFrame(texts, "k long, text string"), "text", "v").select("k", "v").cache()
    a, b = v.select(F.col("k").alias("a"), F.col("v").alias("x")), v.select(F.col("k").alias("b"), F.col("v").alias("y"))
    got = {(r.a, r.b): r.n for r in a.crossJoin(b).where("a <= b").select("a", "b", fingerprint.likeness(F.col("x"), F.col("y")).alias("n")).collect()}
    assert all(got[k, k] == 1.0 for k in range(3)) and got[0, 1] < 0.35 and 0.2 < got[0, 2] < 0.8
    # a digest is what it was: the counts by four, 15 bits apart
    signs = [0] * 30
    for line in texts[0][1].split("\n"):
        h = hashlib.sha256(line.encode()).hexdigest()
        for k in range(2):
            x = int(h[15 * k : 15 * k + 15], 16)
            for s in range(15):
                signs[15 * k + s] += (x >> s) & fingerprint.LOW
    assert v.where("k = 0").select(fingerprint.digest(F.col("v"))).first()[0][-450:] == "".join(f"{x & fingerprint.M60:015x}" for x in signs)


def test_fingerprints_are_those_of_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.OP7_SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    got = [tuple(r) for r in queries.op7_fingerprints(spark, sf).collect()]
    assert sorted(got) == sorted(want)
