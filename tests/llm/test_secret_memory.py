"""Bounded memory of the secret scan, headers that only look like ones, and what is cut."""

import base64
import random
import subprocess
import sys
import zlib

from tidepool.llm import secret_scan

SECRET = "password=abcdefghijklmnop"


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def spans(text, cuts=None):
    return secret_scan.scan_text(text, cuts)[1]


def test_memory_is_bounded_by_windows():
    code = f"""
import base64, resource, zlib
from tidepool.llm import secret_scan
line = b" lorem ipsum dolor sit" * 1000 + b" {SECRET} "
text = base64.b64encode(zlib.compress(line * (64 * 2**20 // len(line)))).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(secret_scan.scan_text("see " + text)[1]) == 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = str(secret_scan.__file__).rsplit("/tidepool/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root, timeout=300)
    assert int(out.stdout) < 200


def test_texts_that_begin_like_compressed_bytes():
    for head in ("x ", "x^ ", "BZh ", "xx "):
        inner = head + "so " * 9 + SECRET
        assert len(spans("a " + b64(zlib.compress(inner.encode())))) == 1
        assert len(spans("a " + b64(inner.encode()))) == 1


def test_long_runs_inside_compressed_bytes():
    run = base64.b64encode(random.Random(1).randbytes(1_800_000) + SECRET.encode() + b"!")
    cuts: list = []
    assert len(spans("a " + b64(zlib.compress(b"head " + run + b" tail")), cuts)) == 1 and not cuts
    cuts = []
    spans("a " + b64(zlib.compress(b"A" * 9_000_000)), cuts)
    assert cuts
    assert len(spans("a " + b64(zlib.compress(("é" * 3_000_000 + SECRET + "é" * 3_000_000).encode())))) == 1


def test_repeated_rows_and_cuts_of_the_query(documents):
    text = "so " + b64(zlib.compress(("x " * 20 + SECRET).encode()))
    rows = secret_scan.scan(documents([text, text, None, ""], [1, 1, 2, 3])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_assign, r.n_nested, r.n_cut) for r in rows] == [(1, 0, 1, 0), (1, 0, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert [r.text for r in secret_scan.redact(documents([text, None])).orderBy("doc_id").collect()] == ["so [SECRET]", None]
