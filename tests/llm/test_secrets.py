import hashlib
import json
import random
import re
import time

from veritally.llm import secrets as S


def brute(t):
    t = t or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def token(body):
    return "ghp_" + body + S.base62_crc(body)


def texts():
    rng = random.Random(1)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "ſecret", "\n", "x", "abcdefABCDEF1234", "toKen=", "secret=secret=abcdefghijkl"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)] + [None, "", "é" * 10 + "token = 'abcdefghijkl'"]


def test_base_spans_equal_plain_search(spark, docs):
    t = texts()
    got = {r["doc_id"]: r["spans"] for r in S.secret_spans(docs([(i, x, "s") for i, x in enumerate(t)])).collect()}
    for i, x in enumerate(t):
        assert [(s["start"], s["end"], s["kind"]) for s in got[i] if s["kind"] in S.KINDS[:3]] == [(a, b, k) for a, _, b, k in brute(x)]


def test_query_digest(spark, tmp_path, docs):
    t = texts()
    docs([(i, x, "s") for i, x in enumerate(t)]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in S.op4_secret_scans(spark, str(tmp_path)).collect():
        base = brute(t[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == i for x in base) for i in range(3))


def test_embedded_checks(spark, docs):
    import base64

    good = token("Zy9" * 10)
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).rstrip(b"=").decode()
    der = base64.b64encode(b"\x30\x03\x02\x01\x07").decode()
    rows = [(1, f"x {good} y"), (2, f"x {good[:-1]}~"), (3, f"npm_{good[4:]}"), (4, f"{head}.{head}.sig"), (5, "eyJxx.eyJyy.zz"), (6, f"-----BEGIN PRIVATE KEY-----\n{der}\n-----END PRIVATE KEY-----"), (7, "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in S.secret_spans(docs([(i, t, "s") for i, t in rows])).collect()}
    assert [got[i] for i in range(1, 8)] == [["forge"], [], ["package"], ["signed"], [], ["private"], []]


def test_redact(spark, docs, rows):
    d = docs([(1, "a token=abcdefghijklmnop b", "s"), (2, None, "s"), (3, "clean", None), (4, "secret=0123456789abcdef0 é " + "0" * 20, "s")])
    out = S.redact(d)
    assert out.columns == d.columns
    assert rows(out, "doc_id", "text", "n_chars") == [(1, "a <assign> b", 12), (2, None, None), (3, "clean", 5), (4, "<assign> é <hex>", 16)]
    assert S.redact(docs([])).count() == 0 and S.secret_spans(docs([])).count() == 0


def test_long_text(spark, docs):
    t = "é" * 500_000 + " token: abcdefghijkl " + "f" * 40
    (r,) = S.secret_spans(docs([(1, t, "s")])).collect()
    assert [(s["start"], s["kind"]) for s in r["spans"]] == [(500_001, "assign"), (500_021, "hex")]


def openssh(cipher=b"none", checks=(b"abcd", b"abcd"), tail=b""):
    field = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + field(cipher) + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public") + field(b"".join(checks) + b"private!") + tail


def test_private_keys_of_openssh_and_with_header_lines(spark, docs, rows):
    import base64

    def block(raw, kind="OPENSSH ", head="", end="\n"):
        body = base64.b64encode(raw).decode()
        return f"-----BEGIN {kind}PRIVATE KEY-----{end}{head}" + end.join(body[i : i + 70] for i in range(0, len(body), 70)) + f"{end}-----END {kind}PRIVATE KEY-----"

    der, aes = b"\x30\x03\x02\x01\x07", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    good = [block(openssh()), block(openssh(b"aes256-gcm@openssh.com", (b"abcd", b"efgh"), b"t" * 16)), block(openssh(), end="\r\n"), block(b"k" * 32, "RSA ", aes), block(b"k" * 32, "RSA ", aes.replace("\n", "\r\n"), "\r\n"), block(der, "EC ", "Comment: made here,\n  by hand\n\n")]
    bad = [block(openssh()[:-1]), block(openssh() + b"x"), block(openssh(checks=(b"abcd", b"abce"))), block(openssh()[:20]), block(b"openssh-key-v1\0"), block(b"k" * 33, "RSA ", aes), block(b"k" * 32, "RSA "), block(b"k" * 32, "RSA ", "Comment: x\n\n")]
    d = docs([(i, f"é {t} z", "s") for i, t in enumerate(good + bad)])
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["kind"] == "private"] for r in S.secret_spans(d).collect()}
    assert [got[i] for i in range(len(got))] == [[(2, 2 + len(t), "private")] for t in good] + [[] for _ in bad]
    assert rows(S.redact(d.where(f"doc_id < {len(good)}")), "text") == [("é <private> z",)] * len(good)


def test_a_nested_header_is_no_error(spark, docs):
    import base64

    nested = lambda n: base64.urlsafe_b64encode(b'{"a":' + b"[" * n + b"]" * n + b"}").rstrip(b"=").decode()
    numbers = base64.urlsafe_b64encode(b'{"alg":' + b"1" * 6000 + b"}").rstrip(b"=").decode()
    rows = [(i, f"token=abcdefghijklm {h}.{h}.x", "s") for i, h in enumerate([nested(1), nested(3000), nested(100_000), "eyJ" + "x" * 50_000, numbers])]
    assert all(h.startswith("eyJ") for h in (nested(3000), numbers))
    assert [[s["kind"] for s in r["spans"]] for r in S.secret_spans(docs(rows)).orderBy("doc_id").collect()] == [["assign"]] * 5


def test_time_is_linear_in_the_text():
    """Megabytes of what made an expression read the same stretch again and again."""
    key = "-----BEGIN PRIVATE KEY-----"
    for text in (
        key + " " * 3_000_000,
        (key + " " * 50) * 30_000,
        key + "\n" + "a:b\n" * 500_000,
        f"a:{key}\n" * 60_000,
        f"{key}\na: b\n c{key}\n" * 30_000,
        key + "\nDEK-Info: " + "\n" * 2_000_000 + "AAAA-----END PRIVATE KEY-----",
        "eyJ" * 1_000_000,
        "eyJeyJ" * 300_000 + ".eyJ" + "eyJ" * 300_000,
        "eyJa.eyJb " * 200_000,
        "password" + " " * 2_000_000,
        "token=" * 400_000,
        "AKIA" * 600_000,
        "ghp_" * 600_000,
        "0123456789abcde " * 150_000,
    ):
        start = time.monotonic()
        S.spans(text, text.encode(), S.automaton())
        assert time.monotonic() - start < 6, text[:40]


def test_a_run_that_fails_hides_no_token_after_it():
    import base64

    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).rstrip(b"=").decode()
    good = f"{head}.{head}.sig"
    for before in ("eyJeyJeyJ ", "eyjeyJx.", "eyJx.eyJy ", "eyJ"):
        text = before + " " + good
        assert [text[a:b] for a, b, k in S.spans(text, text.encode(), S.automaton()) if k == "signed"] == [good]


def test_invalid_utf8(spark):
    from pyspark.sql import functions as F

    raw = b"\xff key AKIA" + b"A" * 20 + b" \xc3( end"
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.expr(f"cast(unhex(if(id = 0, '{raw.hex()}', '61FF62')) as string)").alias("text"))
    (spans,) = (r.spans for r in S.secret_spans(df).where("doc_id = 0").collect())
    assert [(s.start, s.end, s.kind) for s in spans] == [(6, 30, "access")]
    got = {r.doc_id: r.b for r in S.redact(df).selectExpr("doc_id", "hex(cast(text AS binary)) AS b").collect()}
    assert got == {0: "� key <access> �( end".encode().hex().upper(), 1: "61FF62"}
