"""The ends of files, read from behind."""

import io
import os
import random

import pytest

from tidepool.sources import files, logs


def by_hand(data, n):
    lines = data[:-1].split(b"\n") if data.endswith(b"\n") else data.split(b"\n")
    return b"\n".join(lines[-n:])


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


@pytest.mark.parametrize("whole", [0, 100 << 10])
def test_last_lines_by_hand(monkeypatch, whole):
    monkeypatch.setattr(logs, "BLOCK", 7)
    monkeypatch.setattr(logs, "WHOLE", whole)
    rng = random.Random(1)
    cases = [b"", b"\n", b"\n\n", b"a", b"a\n", b"\na", b"a\nb\n", "é\n日本\n🙂".encode(), b"x" * 100, b"x" * 100 + b"\n", b"\n" * 30]
    cases += ["".join(rng.choice("ab\n\né日") for _ in range(rng.randint(1, 90))).encode() for _ in range(200)]
    for data in cases:
        for n in (1, 2, 3, 5, 1000):
            file = Counted(data)
            got, read = logs.tail_bytes(file, len(data), n)
            assert got == by_hand(data, n), (data, n)
            assert read == file.read_bytes


def test_tails_of_a_folder(spark, tmp_path):
    os.makedirs(tmp_path / "logs" / "old")
    (tmp_path / "logs" / "a.log").write_text("one\r\ntwo\nthree é\n")
    (tmp_path / "logs" / "empty.log").write_text("")
    (tmp_path / "logs" / "_hidden.log").write_text("no\n")
    (tmp_path / "logs" / "old" / "b.log").write_bytes(b"x\n" * 70_000 + b"cut \xff\n\nlast")
    (tmp_path / "logs" / "c.txt").write_text("text\n")
    got = logs.tails(spark, str(tmp_path / "logs"), 2, "*.log").collect()
    assert sorted((os.path.basename(r.path), r.place, r.line) for r in got) == [("a.log", 1, "two"), ("a.log", 2, "three é"), ("b.log", 1, ""), ("b.log", 2, "last")]
    assert {os.path.basename(r.path): r.bytes_read for r in got}["b.log"] == 8 << 10
    assert {r.line for r in logs.tails(spark, f"file:{tmp_path}/logs/c.txt").collect()} == {"text"}
    assert logs.tails(spark, str(tmp_path / "logs"), 0, "a.*").count() == 1
    os.utime(tmp_path / "logs" / "a.log", (1, 1))
    found = logs.newest(files.listing(spark, str(tmp_path / "logs"), "*.log"))
    assert found.collect()[-1].path.endswith("a.log")


def test_a_large_file_costs_its_last_lines(spark, tmp_path):
    path = tmp_path / "large.log"
    with open(path, "wb") as f:
        f.truncate(1 << 30)  # a gigabyte without a line break
        f.seek(0, 2)
        f.write(b"\n" + b"".join(b"line %d of the log\n" % k for k in range(5000)))
    rows = logs.tails(spark, str(path), 100).collect()
    os.remove(path)
    assert [r.line for r in rows] == [f"line {k} of the log" for k in range(4900, 5000)]
    assert rows[0].bytes_read <= 16 << 10
