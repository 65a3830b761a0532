"""Queries against their SQL on rows that the given tables lack."""

import glob
import os

import duckdb

from tidepool.plans import registry

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, at, name, table, rows, schema):
    """A query over one table of these rows (the others are the given ones) has its SQL's rows."""
    for path in glob.glob(f"{SF}/*.parquet"):
        os.symlink(path, f"{at}/{os.path.basename(path)}")
    os.remove(f"{at}/{table}.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{table}.parquet")
    con = duckdb.connect()
    for path in glob.glob(f"{at}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(at)).select(*columns).collect()]
    want = [tuple(r) for r in want.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got
    return dict(got)


def test_sessions_that_end_shortly_before_or_after_now(spark, tmp_path):
    rows = [(k, t, "user", "x") for k in (0, 1, 719, 720, 721, 738, 739, 743, 744, 745, 800, 5000) for t in range(k % 3 + 1)]
    found = same_as_sql(spark, tmp_path, "Y09_elapsed", "conversations", rows, "conv_id long, turn long, role string, text string")
    assert found[743] == "new session after 0 hours" and found[800] == "new session after -56 hours" and found[720] == "back after 1 days"


def test_titles_of_tasks_with_other_letters_and_blanks(spark, tmp_path):
    texts = ["für test. Die", "ßtest der", "testü x", "a_test 1", "éfix it", "Add\u200bx", "fixé", "update2 it", "méthode class é", "class\x0bname here", "class \tname here", "say MODULE\u00a0core", "odd \u2028", "odd \u0085", "\x0bodd\x0b", " odd \r", "odd\r\nmore",
             "", " ", "\n", "x" * 41, "é" * 60, "日本語 fix 日本語", "SYSTEM `Öl`", "system \"a\"", "ſystem \u212aey", "FİX it", "Σ fixΣ", "a/b.py.py", "é.py b1.py", "İSTANBUL modİle", "class İx", "method ΑΣ"]
    rows = [(6 * k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(1, None, "en", "s", 0)]
    found = same_as_sql(spark, tmp_path, "X36_task_title", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found[6] == "Writing tests for ßtest der"
