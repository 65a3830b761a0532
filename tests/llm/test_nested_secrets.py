import base64
import bz2
import gzip
import lzma
import os
import urllib.parse
import zlib

import pytest
import zstandard

from tidepool.llm import secret_scan

SECRET = b"password=abcdefghijklmnop1234"
zstd = zstandard.ZstdCompressor().compress


def found(text):
    at = secret_scan.scan_text(text)[1]
    return [text[a:b] for a, kind, b in at if kind == 0]


def coded(data):
    return base64.b64encode(data).decode()


def test_a_character_cut_by_a_window_is_read():
    cyrillic = "ж".encode() * (2 << 20)
    for text in (SECRET + b" x " + cyrillic, b"x" + cyrillic + b" " + SECRET, cyrillic + SECRET + b" x " + cyrillic):
        assert found(coded(zlib.compress(text)))


@pytest.mark.parametrize("inner", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstd])
def test_long_inner_streams_are_read_to_their_end(inner):
    noise = os.urandom(3 << 20).hex(" ", 4).encode().translate(bytes.maketrans(b"abcdef", b"ghijkl"))
    assert found(coded(gzip.compress(inner(noise + b" " + SECRET))))


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstd])
def test_all_members_are_read(pack):
    assert found(coded(pack(b"nothing") + pack(b" " + SECRET)))
    assert found(coded(pack(b"nothing ") + SECRET))
    assert found(coded(pack(b"no " + SECRET[:12]) + pack(SECRET[12:])))
    assert found(coded(gzip.compress(pack(b"x") + pack(SECRET))))


@pytest.mark.parametrize("before", ["a", "ab", "abc", "path/", "ab-", "some_", "a/b-c_", "abcde/"])
def test_base64_after_other_letters(before):
    for data in (SECRET, gzip.compress(SECRET), zlib.compress(SECRET), bz2.compress(SECRET), lzma.compress(SECRET), zstd(SECRET)):
        if data is SECRET or not before.isalpha():
            assert found(f"see {before}{coded(data)} ."), data[:2]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstd])
def test_compressed_bytes_as_escapes(pack):
    data = pack(SECRET)
    for text in (urllib.parse.quote(data, safe=""), "".join(f"%{x:02X}" for x in data), "".join(f"\\x{x:02x}" for x in data), "".join(f"\\u{x:04x}" for x in data), "".join(f"&#{x};" for x in data), repr(data)):
        assert found(f"a {text} b"), text
