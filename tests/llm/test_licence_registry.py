from pathlib import Path

import duckdb

from tidepool.llm import license_scan, queries


def test_entire_texts_notices_and_null_ids(documents, spark):
    whole = {p.name: p.read_text() for p in Path(license_scan.__file__).with_name("licences").iterdir()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0", "MPL-2.0"} <= set(whole)
    cases = [(t, k) for k, t in sorted(whole.items())] + [(t.replace("\n", "\r\n"), k) for k, t in sorted(whole.items())]
    cases += [("Released under CC BY 4.0.", "CC-BY-4.0"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("This project is licensed under the GNU Affero General Public License v3.", "AGPL-3.0-only"), (license_scan._ZLIB, "Zlib"), (license_scan._UNLICENSE, "Unlicense")]
    rows = license_scan.scan(documents([t for t, _ in cases])).orderBy("doc_id").collect()
    assert [r.whole for r in rows] == [k for _, k in cases]
    block = "a\r\n\r\n" + license_scan._MIT.replace("\n", "\r\n") + "\r\n \r\nb"
    assert license_scan.scan(documents([block])).first().licences == "MIT"
    nulls = spark.createDataFrame([(None, "Released under the MIT License."), (1, "x")], "doc_id long, text string")
    assert {(r.doc_id, r.whole) for r in license_scan.scan(nulls).collect()} == {(None, "MIT"), (1, None)}


def test_no_text_has_two_licences():
    found = [d for d, _ in license_scan.digests(license_scan.registry())]
    assert len(found) == len(set(found))


def test_runs_of_blocks_before_code(documents, spark):
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + license_scan._MIT.replace("\n", "\n\n")
    wrapped = mit.replace(", ", ",\n")
    gpl = (license_scan.Path(license_scan.__file__).with_name("licences") / "GPL-3.0").read_text()
    part = mit[: len(mit) // 2]
    texts = [mit + "\n\nint main() {}\n\nreturn 0", "# head\n\n" + wrapped + "\n\ncode", "a\n\n" + gpl + "\n\nb", "x\n\n" + part + "\n\ncode\n\nmore", mit + "\n\n" + mit + "\n\nend"]
    rows = license_scan.scan(documents(texts)).orderBy("doc_id").collect()
    assert [(r.whole, r.licences) for r in rows] == [(None, "MIT"), (None, "MIT"), (None, "GPL-3.0,GPL-3.0-or-later"), (None, ""), (None, "MIT")]


def test_other_registries_repeated_rows_and_ties(documents, spark):
    digest = license_scan.hashlib.sha256(license_scan.canonical_text("Do as you like.").encode()).hexdigest()
    known = spark.createDataFrame([(digest, "B"), (digest, "A")], "digest string, licence string")
    rows = license_scan.scan(documents(["Do as you  LIKE", "do as you like\n", "x\ndo as you like", "no"], [1, 1, 2, 3]), known).orderBy("doc_id").collect()
    assert [(r.doc_id, r.whole, r.licences, r.n_units) for r in rows] == [(1, "A", "A,B", 6), (1, "A", "A,B", 6), (2, None, "A,B", 2), (3, None, "", 0)]


def test_a_very_long_text(documents):
    long = "word " * 300_000 + "\nReleased under the MIT License.\n" + "more\n\n" * 20_000
    assert license_scan.scan(documents([long])).first().licences == "MIT"


def test_sql_of_the_same_registry_over_whole_texts(spark, tmp_path):
    whole = {p.name: p.read_text() for p in sorted(Path(license_scan.__file__).with_name("licences").iterdir())}
    texts = [t for k, t in whole.items() if k in ("Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0")]
    texts += ["a\n\n" + texts[0] + "\n\nb", texts[0].replace("\n", "\r\n"), "x\r\n\r\n" + license_scan._MIT.replace("\n", "\r\n") + "\r\n\r\ny", "Released under CC BY 4.0.", "This project is licensed under the GNU Affero General Public License v3.\nmore", None, "", "no license"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_license_scans"])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES["op9_license_scans"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert sum(r.whole is not None for r in got) >= 6
