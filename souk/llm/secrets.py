"""Secret scans with structural confirmation.

A candidate counts only after it has been decoded: base64 and hexadecimal runs to bytes, bytes to key
encodings (wrapped lines joined, PEM texts read; DER: tag by tag, every nested length must add up; the OpenSSH container: every counted
string must fit), signed tokens to a JSON header that names an algorithm and a JSON payload, forge tokens to
their checksum. A hash in running text, a word that happens to be base64 or a truncated key isn't reported.
Time is linear in the text, whatever it holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.shared import arrow, nullable

#: Every pattern is anchored or possessive, so that each character is looked at a fixed number of times whatever the text.
_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_BODY = re.compile(r"""[A-Za-z0-9+/=\s:,.\-\\"'>|#*;]*+""")
#: A line end, escaped or not.
_LINES = re.compile(r"\r?\n|(?<!\\)\\++[rn]")
#: What stands between the lines of a wrapped key: line ends, with quotes, joining and quote marks around them.
_BREAK = re.compile(r"""[ \t]*+["']?+[ \t]*+(?:[+,;]|\\(?=[ \t]*+\r?\n))?+[ \t]*+(?:\r?\n|\\++[rn])[ \t>|#*]*+["']?+[ \t]*+""")
#: The first line of a wrapped key or key file: DER's sequence in base64 or hexadecimal, the OpenSSH magic, "-----B".
_FIRST = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/_=-]))(?:M|30|b3Blbn|LS0tLS1C)[A-Za-z0-9+/_-]{30,}+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
_ARMOUR = re.compile(r"""-----BEGIN ([A-Z0-9 ]+)-----(?:[\s>|#*"']|\\++[rn])*\Z""")
_JWT = re.compile(r"(?<![\w.-])e[wy][\w-]{8,}+\.[\w-]{4,}+\.[\w-]*+", re.A)
_CLOUD = re.compile(r"(?<![A-Za-z0-9])A(?:KI|SI)A[A-Z2-7]{16}(?![A-Za-z0-9])")
_FORGE = re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_CHAT = re.compile(r"(?<![A-Za-z0-9])xox[abprs]-(?:\d{6,}+-)++[A-Za-z0-9]{16,}+")
_PAY = re.compile(r"(?<![A-Za-z0-9_])[sr]k_(?:live|test)_[A-Za-z0-9]{24,}+")
_MAPS = re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")
#: A name, an assignment, and in the look-ahead a value (it may itself be a name that is assigned to).
_ASSIGNED = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["']?+\s*+(?:=>|:=|=|:)\s*+["']?+(?=([A-Za-z0-9+/_-]{16,}+={0,2}))""")
_NAME = re.compile(r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passw(?:or)?d|pwd|credential)s?(?![a-z0-9])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{64,}+={0,2}")
#: Levels of nesting in a key: an encrypted PKCS #8 one with its parameters has seven.
NESTING = 16


def unbase64(s: str) -> bytes | None:
    """The bytes of a base64 or base64url text (white space and missing padding allowed), else None."""
    s = "".join(s.split()).rstrip("=").translate({45: 43, 95: 47})
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unhex(s: str) -> bytes | None:
    try:
        return bytes.fromhex(s) if len(s) % 2 == 0 else None
    except ValueError:
        return None


def der(raw: bytes, at: int = 0, end: int | None = None, nesting: int = NESTING) -> list[tuple[int, bytes | list]] | None:
    """The elements between two offsets, sequences and sets parsed inside; None unless all lengths add up.

    Deeper nesting than ``nesting`` is no key's and gives None.
    """
    end, out = len(raw) if end is None else end, []
    while at < end:
        tag, at = raw[at], at + 1
        if (size := der_length(raw, at, end)) is None:
            return None
        n, at = size
        if at + n > end:
            return None
        if tag & 0x20:
            inner = der(raw, at, at + n, nesting - 1) if nesting else None
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, raw[at : at + n]))
        at += n
    return out


def der_length(raw: bytes, at: int, end: int) -> tuple[int, int] | None:
    """(an element's length, where its content begins), None unless it is written in its shortest form."""
    if at >= end:
        return None
    n, at = raw[at], at + 1
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or raw[at] == 0:
            return None
        n, at = int.from_bytes(raw[at : at + k]), at + k
        if n < 0x80:
            return None
    return n, at


def der_key(raw: bytes) -> str | None:
    """The kind of private key that the bytes encode, by its nested structure."""
    if len(raw) < 24 or raw[0] != 0x30 or not (top := der(raw)) or len(top) != 1:
        return None
    tags = [t for t, _ in top[0][1]]
    values = [v for _, v in top[0][1]]
    if tags[:3] == [2, 0x30, 4] and values[0] in (b"\0", b"\1") and values[1] and values[1][0][0] == 6:
        return "pkcs8"
    if len(tags) >= 9 and set(tags) == {2} and values[0] in (b"\0", b"\1"):
        return "pkcs1"
    if len(tags) in (6,) and set(tags) == {2} and values[0] == b"\0":
        return "dsa"
    if tags[:2] == [2, 4] and values[0] == b"\1" and len(values[1]) in (16, 20, 24, 28, 32, 48, 66):
        return "sec1"
    if tags == [0x30, 4] and values[0] and values[0][0][0] == 6:
        return "pkcs8-encrypted"
    return None


def openssh_key(raw: bytes) -> str | None:
    """The OpenSSH container: magic, three counted strings, the number of keys, then counted blobs to the end."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return None
    at = len(magic)

    def counted() -> bytes | None:
        nonlocal at
        n = int.from_bytes(raw[at : at + 4])
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n : at]

    if any(counted() is None for _ in range(3)) or at + 4 > len(raw):
        return None
    keys, at = int.from_bytes(raw[at : at + 4]), at + 4
    if not 1 <= keys <= 64 or any(counted() is None for _ in range(keys + 1)):
        return None
    return "openssh" if at == len(raw) else None


def signed_token(s: str) -> str | None:
    """The algorithm named by a signed token's header, if header and payload are JSON objects and the signature fits."""
    parts = s.split(".")
    raw = [unbase64(p) for p in parts]
    if len(parts) != 3 or raw[0] is None or raw[1] is None or (parts[2] and raw[2] is None):
        return None
    try:
        head, body = json.loads(raw[0]), json.loads(raw[1])
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(alg := head.get("alg"), str):
        return None
    least = {"none": 0, "HS256": 32, "HS384": 48, "HS512": 64}.get(alg, 32)
    return alg if len(raw[2] or b"") >= least else None


def entropy(raw: bytes | str) -> float:
    """Bits a symbol."""
    n = len(raw)
    return -sum(c / n * math.log2(c / n) for c in Counter(raw).values()) if n else 0.0


def pem_key(body: str) -> str | None:
    """The kind of private key between a PEM's marks, whatever its lines are escaped, quoted or marked with."""
    joined = []
    for x in _LINES.split(body.replace("\\/", "/")):
        x = x.strip(" \t\r\n>|#*")
        if x.endswith("+") and x[:-1].rstrip(" \t").endswith(('"', "'")):
            x = x[:-1]
        x = x.strip(" \t>|#*\"',;\\")
        if ":" not in x and x != "+":
            joined.append(x)
    raw = unbase64("".join(joined))
    if raw is None:
        return None
    return der_key(raw) or openssh_key(raw) or ("encrypted" if "Proc-Type" in body and len(raw) % 8 == 0 and len(raw) >= 64 else None)


def pem_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, kind) of the private keys between a BEGIN mark and the next mark, an END of the same name."""
    opened = None
    for m in _MARK.finditer(text):
        if m[1] == "END" and opened and opened[2] == m[2] and _BODY.match(text, opened.end()).end() >= m.start() and (kind := pem_key(text[opened.end() : m.start()])):
            yield opened.start(), m.end(), kind
        opened = m if m[1] == "BEGIN" else None


def key_bytes(raw: bytes) -> str | None:
    if b"PRIVATE KEY-----" in raw:
        return next((kind for _, _, kind in pem_keys(raw.decode("latin-1"))), None)
    return der_key(raw) or openssh_key(raw)


def wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, kind) of keys in base64 or hexadecimal over lines of one width, the last at most as wide.

    DER says its own length, so the line where it ends is known; other encodings take all lines of their width.
    Lines that a candidate of the right length takes are decoded once, whether they are a key or not.
    """
    at, lines, index = 0, [], {}
    while m := _FIRST.search(text, at):
        at = m.end()
        if (armour := _ARMOUR.search(text[max(0, m.start() - 100) : m.start()])) and "PRIVATE KEY" not in armour[1]:
            continue
        need = None
        if m[0][0] in "M3":
            head = unhex(m[0][:16]) if m[0][0] == "3" else unbase64(m[0][:16])
            if not head or head[0] != 0x30 or (size := der_length(head, 1, len(head))) is None or (most := sum(size)) > len(text):
                continue
            need = 2 * most if m[0][0] == "3" else (4 * most + 2) // 3
        width = len(m[0])
        if m.start() not in index or index[m.start()] == len(lines) - 1:
            lines = list(_lines_from(text, m))
            index = {x.start(): i for i, x in enumerate(lines)}
        i = index[m.start()]
        if need is None:
            ends = (len(lines), len(lines) - 1)  # the last may be a word of what follows
        else:
            last = i + (need - 1) // width
            if last >= len(lines) or (last - i) * width + len(lines[last][0].rstrip("=")) != need:
                continue
            ends = (last + 1,)
        at = lines[ends[0] - 1].end()
        for n in ends:
            joined = "".join(x[0] for x in lines[i:n])
            if n > i and (raw := unhex(joined) or unbase64(joined)) and (kind := key_bytes(raw)):
                yield m.start(), lines[n - 1].end(), kind
                break


def _lines_from(text: str, first: re.Match) -> Iterator[re.Match]:
    """The first line and those of its width after it, up to one that is shorter or padded."""
    x, width = first, len(first[0])
    while x and len(x[0]) <= width:
        yield x
        if len(x[0]) < width or x[0].endswith("="):
            return
        to = x.end()
        while b := _BREAK.match(text, to):
            to = b.end()
        x = _LINE.match(text, to) if to > x.end() else None


def opaque(value: str) -> str | None:
    """Why a value assigned to a secret's name is one: it decodes to random bytes of a usual length."""
    if (raw := unhex(value)) is not None and len(raw) >= 8:
        return f"hex {len(raw)}" if entropy(value.lower()) >= 2.5 and len(set(raw)) > len(raw) // 2 else None
    if any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and (raw := unbase64(value)) is not None:
        if (kind := key_bytes(raw)) is not None:
            return kind
        return f"base64 {len(raw)}" if len(raw) >= 12 and entropy(value) >= 3.2 and len(set(raw)) > len(raw) // 2 else None
    return None


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def forge_evidence(token: str) -> str | None:
    """Whether the last six base-62 digits are the checksum of the rest."""
    n = 0
    for c in token[-6:]:
        n = n * 62 + _DIGITS.index(c)
    return "checksum" if n == zlib.crc32(token[4:-6].encode()) else None


def random_bytes(value: str, least: float) -> str | None:
    """How a token's random part decodes: to bytes that hardly repeat, of as many bits a character as random ones have."""
    raw = unbase64(value) or unbase64(value[:-1])
    return f"base64 {len(raw)}" if raw and entropy(value) >= least and 2 * len(set(raw)) > len(raw) else None


def chat_evidence(token: str) -> str | None:
    """The numbered fields of a chat token and the random one after them."""
    *numbers, last = token.split("-")[1:]
    return f"{len(numbers)} fields, {found}" if all(len(n) <= 16 for n in numbers) and (found := random_bytes(last, 3)) else None


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, evidence) of every confirmed secret, in order, without overlaps (the earlier, then the longer wins)."""
    hits: list[tuple[int, int, str, str]] = []

    def add(begin: int, end: int, kind: str, evidence: str | None) -> None:
        if evidence is not None:
            hits.append((begin, end, kind, evidence))

    if "PRIVATE KEY-----" in text:
        for b, e, kind in pem_keys(text):
            add(b, e, "private key", kind)
    if "." in text and ("eyJ" in text or "ewo" in text or "eyA" in text):
        for m in _JWT.finditer(text):
            add(m.start(), m.end(), "signed token", signed_token(m[0]))
    if "AKIA" in text or "ASIA" in text:
        for m in _CLOUD.finditer(text):
            raw = base64.b32decode(m[0][4:])
            add(m.start(), m.end(), "cloud access key", "base32" if entropy(m[0][4:]) >= 2.5 and len(raw) == 10 else None)
    for mark, pattern, kind, evidence in (
        ("gh", _FORGE, "forge token", forge_evidence),
        ("xox", _CHAT, "chat token", chat_evidence),
        ("k_", _PAY, "payment key", lambda s: random_bytes(s[8:], 3.2)),
        ("AIza", _MAPS, "service key", lambda s: random_bytes(s[4:], 3.5)),
    ):
        if mark in text:
            for m in pattern.finditer(text):
                add(m.start(), m.end(), kind, evidence(m[0]))
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if _NAME.search(m[1].rpartition(".")[2]):
                add(m.start(2), m.end(2), "named secret", opaque(m[2]))
    for m in _RUN.finditer(text):
        raw = unhex(m[0].rstrip("=")) or unbase64(m[0])
        add(m.start(), m.end(), "private key", raw and key_bytes(raw))
    for b, e, kind in wrapped(text):
        add(b, e, "private key", kind)
    out: list[tuple[int, int, str, str]] = []
    for h in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    return out


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, evidence, span "begin-end" in characters, digest: SHA-256 of the secret) of each confirmed secret.

    The secret itself isn't repeated. Null and empty texts have none; repeated rows report each for
    itself; texts are scanned whole; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    given = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["kind", "evidence", "span", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, s in enumerate(batch.column(1).to_pylist()):
                for b, e, kind, evidence in find(s) if s else ():
                    at.append(i)
                    rows.append((kind, evidence, f"{b}-{e}", sha256(s[b:e].encode()).hexdigest()))
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *names])

    return arrow(given, run, T.StructType([given.schema["doc_id"], *(T.StructField(n, T.StringType()) for n in names)]))


def redact(df: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``df`` with each confirmed secret replaced by ``[kind]`` and the size column (if there is one) set anew.

    Rows are neither added nor lost, repeated ones are redacted alike, an empty table gives an empty one; texts
    without secrets, null and empty ones too, stay as they are; texts of any length are scanned whole. A size
    column that isn't a whole number stays as it is, as do all others, whatever their names. No shuffle.
    """
    at = df.columns.index(text)
    n = df.columns.index(size) if size in df.columns else None
    whole = n is not None and isinstance(df.schema[n].dataType, (T.LongType, T.IntegerType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            sizes = columns[n].to_pylist() if whole else None
            for i, s in enumerate(texts):
                if s and (hits := find(s)):
                    parts, last = [], 0
                    for b, e, kind, _ in hits:
                        parts += [s[last:b], f"[{kind}]"]
                        last = e
                    texts[i] = "".join([*parts, s[last:]])
                    if whole:
                        sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if whole:
                columns[n] = pa.array(sizes, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return arrow(df, run, nullable(df.schema))
