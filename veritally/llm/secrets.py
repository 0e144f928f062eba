"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near hits, embedded checksum validation.

Method
  1. An Aho-Corasick automaton over all keywords reads each whole text once (UTF-8 bytes, A-Z lower-cased). Hexadecimal runs have no
     keyword; a text enters their expression only if its bytes hold 16 hexadecimal digits in a row.
  2. Only at a hit is its expression tried, anchored at the keyword's place. Going through the hits from left to right, and past the end of each
     match, gives what a leftmost non-overlapping search of the whole text gives.
  3. Kinds with an embedded check are kept only if it holds: CRC-32 in base 62 at the end of ``ghp_``-like and ``npm_`` tokens, a JSON
     header in a signed web token, and in a private key block a DER sequence whose length fits, an OpenSSH key whose fields fit, or, after header lines
     that name a cipher, whole cipher blocks.

Base kinds, in the order that breaks ties: ``assign`` (a password, secret, token or API key that is assigned 12 or more characters), ``access`` (``AKIA`` and
18 or more characters in all) and ``hex`` (16 or more digits). Added kinds: ``forge``, ``package``, ``signed``, ``private``.
Spans are code points of the text, end exclusive, of the whole match. Null and empty texts have none. Repeated rows are scanned each on its own.
A text of any content and length is read in time about linear in its length, and none raises.
Invalid UTF-8 is read with replacement characters, one code point each.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import lean

from veritally.llm.words import text_buffers

# The patterns and lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# The patterns of the added kinds.
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
PACKAGE = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
# a header line doesn't reach into another block, and no part gives back what it took, so each stretch of text is read once
_LINE = r"(?:(?!-----BEGIN )[^\r\n])*+"
PRIVATE = re.compile(rf"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----\s++((?:[A-Za-z][A-Za-z0-9-]*+:{_LINE}(?:\r?\n[ \t]++(?=\S){_LINE})*+\s++)*+)([A-Za-z0-9+/=\s]++)-----END \1-----")

KINDS = ("assign", "access", "hex", "forge", "package", "signed", "private")
CIPHER = re.compile(r"^[ \t]*+DEK-Info:[ \t]*+([A-Za-z0-9-]++)[ \t]*+,[ \t]*+[0-9A-Fa-f]++[ \t]*+\r?$", re.MULTILINE)
OPENSSH = b"openssh-key-v1\0"
#: Characters of a signed token's header; a longer one isn't a token.
LONGEST_HEADER = 16_384
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """The six characters that end a token with this body."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def _checked(m: re.Match) -> bool:
    token = m[0].split("_", 1)[1]
    return base62_crc(token[:-6]) == token[-6:]


def _header(m: re.Match) -> bool:
    part = m[0].split(".", 1)[0]
    if len(part) > LONGEST_HEADER:
        return False
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):  # not base64, not JSON, not an object, nested without end
        return False


def _der(raw: bytes) -> bool:
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    n = raw[1]
    if n < 0x80:
        return len(raw) == n + 2
    n &= 0x7F
    return len(raw) == int.from_bytes(raw[2 : 2 + n], "big") + 2 + n


def _openssh(raw: bytes) -> bool:
    """Cipher, derivation, its options, the number of keys, so many public keys, and the private part, which opens with a number twice if it isn't encrypted."""
    at = len(OPENSSH)

    def number() -> int:
        nonlocal at
        if at + 4 > len(raw):
            raise ValueError("too short")
        at += 4
        return int.from_bytes(raw[at - 4 : at], "big")

    def field() -> bytes:
        nonlocal at
        n = number()
        if at + n > len(raw):
            raise ValueError("too short")
        at += n
        return raw[at - n : at]

    try:
        cipher, _, _ = field(), field(), field()
        keys = number()
        for _ in range(keys):
            field()
        private = field()
    except ValueError:
        return False
    if not keys:
        return False
    if cipher == b"none":
        return at == len(raw) and len(private) >= 8 and private[:4] == private[4:8]
    return len(private) > 0 and len(raw) - at in (0, 16)  # some ciphers put a tag after it


def _private(m: re.Match) -> bool:
    try:
        raw = base64.b64decode("".join(m[3].split()), validate=True)
    except ValueError:
        return False
    if cipher := CIPHER.search(m[2]):
        return len(raw) > 0 and (len(raw) % 8 == 0 or not cipher[1].upper().endswith(("CBC", "ECB")))
    return _openssh(raw) if raw.startswith(OPENSSH) else _der(raw)


#: kind: (keywords in lower case, expression, what a match must meet to count)
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: len(m[2]) >= LEAST["assign"]),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= LEAST["access"]),
    "forge": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), FORGE, _checked),
    "package": (("npm_",), PACKAGE, _checked),
    "signed": (("eyj",), SIGNED, _header),
    "private": (("-----begin ",), PRIVATE, _private),
}

#: Where an expression fails at one hit, it fails at all others within this run, which needn't be read again for each.
RUNS = {"signed": re.compile(r"eyJ[A-Za-z0-9_-]*+")}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEXED = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for w in keywords:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def spans(text: str, raw: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; ``raw`` is the text in UTF-8."""
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in words.iter(raw.translate(_FOLD).decode("latin-1")):
        hits.setdefault(kind, []).append(end + 1 - n)
    out = []
    if hits:
        wide = None
        if len(raw) != len(text):  # bytes to code points
            wide = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        for kind, starts in hits.items():
            _, expression, holds = RULES[kind]
            after = 0
            for at in starts:
                at = int(wide[at]) if wide is not None else at
                if at < after:
                    continue
                if m := expression.match(text, at):
                    after = m.end()
                    if holds(m):
                        out.append((m.start(), m.end(), kind))
                elif kind in RUNS and (run := RUNS[kind].match(text, at)):
                    after = run.end()
    if raw.translate(_HEXED).find(b"\1" * LEAST["hex"]) >= 0:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _rows(col: pa.Array):
    raw, off = text_buffers(col)
    words = automaton()
    for i in range(len(off) - 1):
        part = raw[off[i] : off[i + 1]].tobytes()
        try:
            text = part.decode()
        except UnicodeDecodeError:
            text = part.decode("utf-8", "replace")
            part = text.encode()
        yield i, text, part, words


def _scan(batches):
    for batch in batches:
        found = []
        for _, text, part, words in _rows(batch.column("text")):
            found.append([{"start": a, "end": b, "kind": k} for a, b, k in spans(text, part, words)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>): a row per row of ``docs`` (doc_id long, text string)."""
    return docs.select("doc_id", "text").mapInArrow(lean(_scan), "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``<kind>`` (overlapping spans as one, named by the first) and ``n_chars`` brought up to date.

    Null and empty texts stay as they are, and so do the bytes of texts without secrets.
    """
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).cast(pa.binary()).to_pylist()
            for i, text, part, words in _rows(batch.column(names.index("text"))):
                found = spans(text, part, words)
                if not found:
                    continue
                out, at, name = [], 0, ""
                for a, b, kind in found:
                    if a >= at or not name:
                        out += [text[at:a], f"<{kind}>"]
                        name = kind
                    at = max(at, b)
                texts[i] = ("".join(out) + text[at:]).encode()
            yield batch.set_column(names.index("text"), "text", pa.array(texts, pa.binary()).view(pa.string()))

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = KINDS[:3]
    return found.select("doc_id", *map(count, base), F.sha2(joined(base), 256).alias("base_sha256"), joined(KINDS).alias("spans"))
