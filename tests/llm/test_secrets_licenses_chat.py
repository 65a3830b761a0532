import base64
import bz2
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import pytest

from tidepool.llm import chat, fingerprint, license_scan, secret_scan

SECRET = 'password = "abcdefghijklmnop1234"'


def spans(text):
    return secret_scan.scan_text(text)


@pytest.mark.parametrize(
    "wrap",
    [
        urllib.parse.quote,
        lambda s: urllib.parse.quote(urllib.parse.quote(s)),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(base64.b64encode(bz2.compress(s.encode())))).decode(),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s),
    ],
)
def test_wrapped_secrets_are_found_where_they_stand(wrap):
    coded = wrap(SECRET)
    text = f"é🙂 before {coded} after"
    base, every = spans(text)
    assert not [s for s in base if s[1] == 0]
    found = [s for s in every if s[1] == 0]
    assert found
    at = text.index(coded)
    assert all(at <= a < b <= at + len(coded) for a, _, b in found)
    clean = secret_scan.redact_text(text, every)
    assert not spans(clean)[1] and clean.startswith("é🙂 before ") and clean.endswith(" after")


def brute(text):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns(documents):
    rng = random.Random(4)
    parts = ["token: ", "API_KEY='", "secret=", "passwd = ", "AKIA" + "A7" * 8, "0123456789abcdef", "deadbeef" * 3, "xyz", " ", "\n", "é", "ABCdef_-.=+/", "paſſword=aaaaaaaaaaaaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(200)] + [None, "", "a" * 100_000]
    rows = secret_scan.scan(documents(texts)).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        want = brute(text or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(secret_scan.as_text(want).encode()).hexdigest()
        assert set(secret_scan.as_text(want).split(",")) <= set(r.spans.split(",")) or not want
    assert secret_scan.scan(documents([])).count() == 0


def test_bytes_that_unpack_to_themselves_end():
    data = gzip.compress(b"x")
    assert list(secret_scan._unpack_all(iter([data]), ((hashlib.blake2b(data).digest(), True),))) == []


def test_large_unpacked_bytes_are_read_in_windows():
    packed = base64.b64encode(zlib.compress(b"q" * (5 << 20) + SECRET.encode())).decode()
    assert [s for s in spans(packed)[1] if s[1] == 0]


def test_redaction_keeps_other_columns(documents):
    row = secret_scan.redact(documents([f"a {SECRET} b", None])).orderBy("doc_id").collect()
    assert row[0].text == 'a [SECRET]" b' and row[1].text is None and row[0].score == "x"


def test_licences(documents, spark):
    mit = "MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + license_scan._MIT
    texts = [mit, "x\nReleased under the MIT licence!\ny", None, "", "the mit license is nice", "Licensed under CC-BY-NC 4.0"]
    rows = license_scan.scan(documents(texts)).orderBy("doc_id").collect()
    assert [(r.whole, r.licences) for r in rows] == [("MIT", "MIT"), (None, "MIT"), (None, ""), (None, ""), (None, ""), ("CC-BY-NC-4.0", "CC-BY-NC-4.0")]
    with pytest.raises(ValueError):
        license_scan.digests([("none", "words without marks")])
    assert license_scan.scan(documents([])).count() == 0


def test_chat_reads_back_what_was_said(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "a<\\|b", "<", "|", None, "", "<|im_sep|>", "x" * 5000, "🙂\n\n"]
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(40):
        turns = [(t, rng.choice(["user", "assistant", "system", "we%ird\nrole", None]), rng.choice(odd)) for t in range(rng.randint(1, 9))]
        rows += [(conv, t, r, x, "clash") for t, r, x in turns]
        want[conv] = [(r or "", x or "") for _, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formatted.select("conv_id", chat.read_back(formatted["formatted"]).alias("turns")).collect()}
    assert back == want
    for r in chat.digests(formatted).collect():
        loss = "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_adjacent_turns_of_a_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_fingerprints_are_sums_of_paragraphs(documents, spark):
    texts = ["one.\ntwo. three.\nfour", "four\none.\ntwo. three.", "one.\nfour", "two. three.", "", None]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(documents(texts)).collect()}
    assert got[0] == got[1] != got[2] and got[4] == got[5]
    v = fingerprint.with_vector(documents(texts[:4]).select("doc_id", "text"), "text", "v")
    a, b = v.where("doc_id = 2").select(v["v"].alias("a")), v.where("doc_id = 3").select(v["v"].alias("b"))
    both = a.crossJoin(b)
    assert both.select(fingerprint.digest(fingerprint.combine(both["a"], both["b"])).alias("x")).first().x == got[0]
    whole = v.where("doc_id = 0").select(v["v"].alias("a")).crossJoin(b)
    assert whole.select(fingerprint.digest(fingerprint.remove(whole["a"], whole["b"])).alias("x")).first().x == got[2]


def test_edits_take_the_next_document(documents):
    texts = {7: "abcdef", 3: "xyz", 2**40: None, -5: "é🙂"}
    rows = {r.doc_id: r for r in fingerprint.edited_fingerprints(documents(list(texts.values()), list(texts))).collect()}
    order = sorted(texts, reverse=True)
    for k, doc in enumerate(order):
        own, after = texts[doc] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert (rows[doc].n_chars, rows[doc].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[doc].near_edited <= 1 and 0 <= rows[doc].near_next <= 1
    assert fingerprint.edited_fingerprints(documents([])).count() == 0
    assert fingerprint.edited_fingerprints(documents(["a", "a", "b"], [1, 1, 1])).count() == 3
