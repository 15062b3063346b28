"""Secret scan with structural confirmation.

Base patterns find assignments, access keys and long hex runs. Beyond them,
base64 and hex candidates are decoded and parsed: nested DER lengths of key
encodings, the length-prefixed fields of OpenSSH keys, and the JSON headers of
signed tokens. A candidate is reported only when its structure holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm.common import bound_batches, text_slices

#: Kinds in the order in which spans of one start are listed; fixed values.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "openssh_key", "signed_token")
BASE = {
    "assign": re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
    # The same matches as AKIA[A-Z0-9]+ of 16 or more and [0-9a-f]+ of 32 or more characters.
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+"),
}
#: What an assignment's name holds, in lower case.
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_HEX_MARKS = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
# Each part of a dotted word with what follows it, once: a header, a payload (empty where it is detached) and a signature.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)\.(?=([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]++))")
# What any token has: two dots with characters of base64 alone between and one after them.
_DOTS = re.compile(r"\.[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]")
# A header may follow a name and one of these within its part; a JSON object begins with a brace or a blank.
_HEADER_START = re.compile(r"(?:^|(?<=[_-]))(?=[eICD])")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----|-----BEGIN ")
# Line ends and slashes may be escaped, as in JSON strings, however often.
_ESCAPES = re.compile(r"(?<!\\)\\++([nrt/])")
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "/": "/"}
# Characters of base64 that some JSON encoders write by number: + - / = _
_NUMBERED = re.compile(r"(?<!\\)\\++u00(2[bB]|2[dD]|2[fF]|3[dD]|5[fF])")
_HEADER = re.compile(r"[ \t]*([A-Za-z0-9-]+): *(.*)")
_DEK = re.compile(r"[A-Z0-9-]+,[0-9A-Fa-f]{16,}")
# Where base64 of a DER sequence (0x30 and a length), of an OpenSSH public key's name or of its private container begins.
_START = re.compile(r"M[A-I]|AAAA(?:B3Nz|C3Nz|E2Vj|GnNr|InNr)|b3BlbnNzaC1rZXkt")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++")
_PADDING = re.compile(r"={0,2}")
# Between the lines of one key: a line end, with what quoting and comments put before the next line; or the mark of an escaped slash.
_BREAK = re.compile(r"[ \t]*+(?:\r?\n|(?:\\++[rn])++)[ \t>#*]*+|\\++(?=/)")
# Hex digits of a key, in lines, with or without colons between bytes.
_HEX_START = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{16}|(?:[0-9A-Fa-f]{2}:){8})")
_HEX_DIGITS = bytes(0x78 if chr(b) in "0123456789abcdefABCDEF" else 0x3A if b == 0x3A else 0x20 for b in range(256))
_HEX_RUN = re.compile(r"[0-9A-Fa-f]++")
_HEX_BREAK = re.compile(r":?[ \t]*+(?:\r?\n|(?:\\++[rn])++)[ \t>#*]*+|:")
#: Bytes of the shortest key.
_LEAST_KEY = 24
# In decoded bytes, where a sequence begins whose first field is a version or an algorithm, and where an OpenSSH key does.
_HEADS = re.compile(rb"(?=\x30(?:[\x16-\x7f]|\x81.|\x82..|\x83...|\x84....)(?:\x02\x01[\x00\x01]|\x30)|\x00\x00\x00[\x07\x0b\x13\x1a\x22](?:ssh-|ecdsa-|sk-)|openssh-key-v1\x00)", re.DOTALL)
#: Object identifiers as DER bodies; fixed values. Keys: RSA, RSASSA-PSS, elliptic curves, Ed25519, Ed448, X25519, X448, DSA, Diffie-Hellman.
_KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a864886f70d01010a", "2a8648ce3d0201", "2b6570", "2b6571", "2b656e", "2b656f", "2a8648ce380401", "2a864886f70d010301")}
_SSH_MAGIC = b"openssh-key-v1\0"
#: Fields of an OpenSSH public key, its name included; fixed values.
_SSH_FIELDS = {
    b"ssh-rsa": 3,
    b"ssh-dss": 5,
    b"ssh-ed25519": 2,
    b"ecdsa-sha2-nistp256": 3,
    b"ecdsa-sha2-nistp384": 3,
    b"ecdsa-sha2-nistp521": 3,
    b"sk-ssh-ed25519@openssh.com": 3,
    b"sk-ecdsa-sha2-nistp256@openssh.com": 4,
}
#: Fields of the sequences that are keys, at most; a fixed value.
_MOST_FIELDS = 10
#: Password-based encryption of keys: PKCS #5 schemes 1 and 2, PKCS #12 schemes.
_CIPHER_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010501", "2a864886f70d010503", "2a864886f70d010504", "2a864886f70d010506", "2a864886f70d01050a", "2a864886f70d01050b", "2a864886f70d01050d", "2a864886f70d010c0101", "2a864886f70d010c0102", "2a864886f70d010c0103", "2a864886f70d010c0104", "2a864886f70d010c0105", "2a864886f70d010c0106")}


def der_length(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """(body start, body end) of the DER element at `at`, or None where its length does not fit before `end`."""
    if at + 2 > end:
        return None
    n, body = data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or body + size > end:
            return None
        n, body = int.from_bytes(data[body : body + size], "big"), body + size
        if n < 0x80 or (size > 1 and n < 1 << 8 * (size - 1)):
            return None
    return (body, body + n) if body + n <= end else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, body start, body end) of the elements that fill start..end exactly, or None. So many as no key has are None, too."""
    out = []
    while start < end:
        span = der_length(data, start, end)
        if span is None or len(out) == _MOST_FIELDS:
            return None
        out.append((data[start], *span))
        start = span[1]
    return out


def der_key_end(data: bytes, at: int = 0) -> int | None:
    """Where the DER key at `at` ends: a SEQUENCE whose nested lengths fit and whose fields are those of a key; None where there is none.

    Private keys begin with a small version INTEGER (PKCS #1, PKCS #8, SEC 1);
    public keys with an algorithm SEQUENCE whose identifier is known; encrypted
    private keys (PKCS #8) with a cipher's. Lengths are followed, contents are
    not read, so a place costs as much however long the key claims to be.
    """
    if data[at : at + 1] != b"0":
        return None
    outer = der_length(data, at, len(data))
    if outer is None or outer[1] - at < _LEAST_KEY:
        return None
    fields = der_children(data, *outer)
    if not fields or len(fields) < 2:
        return None

    def algorithm(field: tuple[int, int, int], known: set[bytes] = _KEY_OIDS) -> bool:
        inner = der_children(data, field[1], field[2]) if field[0] == 0x30 else None
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] in known

    if algorithm(fields[0]) and fields[1][0] == 0x03:
        return outer[1]
    if len(fields) == 2 and algorithm(fields[0], _CIPHER_OIDS) and fields[1][0] == 0x04 and fields[1][2] - fields[1][1] >= 8:
        return outer[1]
    if fields[0][0] != 0x02 or fields[0][2] - fields[0][1] != 1 or data[fields[0][1]] > 1:
        return None
    tags = [f[0] for f in fields]
    pkcs8 = algorithm(fields[1]) and len(fields) >= 3 and tags[2] == 0x04
    holds = pkcs8 or (len(tags) >= 6 and set(tags) == {0x02}) or (tags[1] == 0x04 and len(tags) >= 3 and tags[2] in (0xA0, 0xA1))
    return outer[1] if holds else None


def is_der_key(data: bytes) -> bool:
    """Whether all of `data` is one DER key."""
    return der_key_end(data) == len(data)


def openssh_key_end(data: bytes, at: int = 0) -> int | None:
    """Where the OpenSSH key at `at` ends, by the lengths of its fields: an openssh-key-v1 container of one key, or a public key."""
    framed = data.startswith(_SSH_MAGIC, at)
    # A container: cipher, derivation and its options, the number of keys, public and private part.
    at, left, first = (at + len(_SSH_MAGIC), 6, True) if framed else (at, 1, True)
    while left:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        left -= 1
        if framed and left == 2:
            if n != 1:
                return None
            at += 4
            continue
        if at + 4 + n > len(data):
            return None
        if first and framed and not data[at + 4 : at + 5].isalpha():
            return None
        if first and not framed:
            left = _SSH_FIELDS.get(data[at + 4 : at + 4 + n], 0) - 1 if n <= 64 else -1
            if left < 0:
                return None
        at, first = at + 4 + n, False
    return at


def is_openssh_key(data: bytes) -> bool:
    """Whether all of `data` is one OpenSSH key; what follows a container's fields counts as its padding."""
    end = openssh_key_end(data)
    return end == len(data) or (end is not None and data.startswith(_SSH_MAGIC))


class _Header:
    """The first part of a token, decoded once for each of the four ways in which its characters can be grouped."""

    def __init__(self, part: str) -> None:
        self.part, self.groups = part, {}

    def holds(self, at: int) -> bool:
        """Whether the part from `at` on decodes to a JSON object (in UTF-8) that names its algorithm."""
        if (len(self.part) - at) % 4 == 1:
            return False
        if at % 4 not in self.groups:
            tail = self.part[at % 4 :]
            data = base64.urlsafe_b64decode(tail + "=" * (-len(tail) % 4))
            self.groups[at % 4] = data, data.decode("latin-1")
        data, text = self.groups[at % 4]
        begin = at // 4 * 3
        try:  # structure first: most places fail at once, and nothing is copied
            start = begin + len(data[begin : begin + 64]) - len(data[begin : begin + 64].lstrip(b" \t\r\n"))
            if data[start : start + 1] != b"{":
                return False
            _, end = _JSON.raw_decode(text, start)
            if text[end:].strip(" \t\r\n"):
                return False
            found = json.loads(data[begin:].decode())
        except (ValueError, RecursionError):
            return False
        return isinstance(found, dict) and isinstance(found.get("alg"), str)


_JSON = json.JSONDecoder()


def is_signed_token(header: str) -> bool:
    """Whether a token's first part decodes to a JSON object (in UTF-8) that names its algorithm."""
    return _Header(header).holds(0)


def _token_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Signed tokens, wherever in a dotted word they begin, and behind a name that ends in _ or -."""
    after = 0
    for m in _TOKEN.finditer(text) if _DOTS.search(text) else ():
        if m.start() < after or len(m[3]) % 4 == 1 or len(m[2]) % 4 == 1:
            continue
        header = _Header(m[1])
        found = next((s.start() for s in _HEADER_START.finditer(m[1]) if header.holds(s.start())), None)
        if found is not None:
            after = m.end(3)
            yield "signed_token", m.start() + found, after


def _decoded(text: str) -> bytes | None:
    try:
        body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
        return binascii.a2b_base64(body + "=" * (-len(body) % 4), strict_mode=True)
    except ValueError:
        return None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in BASE["assign"].finditer(text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in BASE["access"].finditer(text)]
    if b"x" * 32 in text.encode(errors="replace").translate(_HEX_MARKS):
        out += [("hex", *m.span()) for m in BASE["hex"].finditer(text)]
    return sorted(out, key=_order)


def _pem_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Blocks between the marks of a private key whose body is one, or whose headers and length are those of an encrypted one."""
    begun = None
    for m in _MARK.finditer(text):
        if m[1] == "END":
            if begun is not None and begun[2] == m[2] and _is_pem_body(_ESCAPES.sub(lambda e: _ESCAPED[e[1]], text[begun[1] : m.start()])):
                yield "pem_key", begun[0], m.end()
            begun = None
        else:
            begun = (m.start(), m.end(), m[2]) if m[1] else None


def _is_pem_body(body: str) -> bool:
    lines, headers, first = body.strip().splitlines(), {}, 0
    while first < len(lines) and (m := _HEADER.fullmatch(lines[first])):
        headers[m[1]] = m[2].strip()
        first += 1
    data = _decoded("".join(lines[first:]))
    if not data:
        return False
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        return _DEK.fullmatch(headers.get("DEK-Info", "")) is not None and len(data) % 8 == 0
    return is_der_key(data) or is_openssh_key(data)


def _block(text: str, at: int, run: re.Pattern, gap: re.Pattern) -> tuple[str, list[int], list[int], int]:
    """The characters from `at` on that belong together, over line ends: joined, where each run begins in them and in the text, and where they end."""
    pieces, joined_at, text_at, total = [], [], [], 0
    while (m := run.match(text, at)) is not None:
        pieces.append(m[0])
        joined_at.append(total)
        text_at.append(m.start())
        total, at = total + len(m[0]), m.end()
        between = gap.match(text, at)
        if between is None or run.match(text, between.end()) is None:
            break
        at = between.end()
    return "".join(pieces), joined_at, text_at, at


def _keys_in(joined: str, groups: list[tuple[int, bytes]], per: tuple[int, int], ends: set[int]) -> Iterator[tuple[str, int, int]]:
    """Keys (kind, start, end in the joined characters) that end where a run does. groups: characters before the first byte, and the bytes; per: so many characters make so many bytes."""
    chars, size = per
    places = sorted((before + m.start() // size * chars, m.start(), before, data) for before, data in groups for m in _HEADS.finditer(data) if m.start() % size == 0)
    after = 0
    for start, at, before, data in places:
        if start < after:
            continue
        kind, end = ("der_key", der_key_end(data, at)) if data[at] == 0x30 else ("openssh_key", openssh_key_end(data, at))
        if end is None:
            continue
        stop = before + -(-end * chars // size)
        rest = (stop - start) % 4 if chars == 4 else 0
        if stop not in ends or (rest and _decoded(joined[stop - rest : stop]) is None):  # the bits after the last byte are zero
            continue
        after = stop
        yield kind, start, stop


def _key_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in base64, wherever in their lines they begin. Each block of lines is decoded once for each way to group its characters."""
    at = 0
    while (m := _START.search(text, at)) is not None:
        joined, joined_at, text_at, end = _block(text, m.start(), _RUN, _BREAK)
        at = max(end, m.start() + 1)
        if len(joined) * 3 // 4 < _LEAST_KEY:
            continue
        plain, ends = joined.replace("-", "+").replace("_", "/"), {*joined_at[1:], len(joined)}
        groups = [(k, binascii.a2b_base64(plain[k : len(plain) - (len(plain) - k) % 4])) for k in range(4)]
        tail = [(k, d + _last_bytes(plain[len(plain) - (len(plain) - k) % 4 :])) for k, d in groups]
        for kind, start, stop in _keys_in(joined, tail, (4, 3), ends):
            i, j = bisect_right(joined_at, start) - 1, bisect_left(joined_at, stop) - 1
            last = text_at[j] + stop - joined_at[j]
            yield kind, text_at[i] + start - joined_at[i], _PADDING.match(text, last).end()


def _last_bytes(chars: str) -> bytes:
    """The one or two whole bytes of two or three characters."""
    return binascii.a2b_base64(chars + "=" * (4 - len(chars))) if len(chars) > 1 else b""


def _hex_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in hex digits, also over lines and with colons, wherever they begin."""
    digits = text.encode(errors="replace").translate(_HEX_DIGITS)
    if b"x" * 16 not in digits and b"xx:" * 8 not in digits:
        return
    at = 0
    while (m := _HEX_START.search(text, at)) is not None:
        joined, joined_at, text_at, end = _block(text, m.start(), _HEX_RUN, _HEX_BREAK)
        at = max(end, m.start() + 1)
        if len(joined) < 2 * _LEAST_KEY:
            continue
        ends = {*joined_at[1:], len(joined)}
        groups = [(k, bytes.fromhex(joined[k : len(joined) - (len(joined) - k) % 2])) for k in range(2)]
        for kind, start, stop in _keys_in(joined, groups, (2, 1), ends):
            i, j = bisect_right(joined_at, start) - 1, bisect_left(joined_at, stop) - 1
            if kind == "der_key":
                yield kind, text_at[i] + start - joined_at[i], text_at[j] + stop - joined_at[j]


def _spelled(text: str) -> tuple[str, list[int], list[int]]:
    """The text with numbered characters spelled out, and from which places on how many more characters the original has."""
    out, at, places, more = [], 0, [0], [0]
    for m in _NUMBERED.finditer(text):
        out += [text[at : m.start()], chr(int(m[1], 16))]
        at = m.end()
        places.append(m.start() - more[-1] + 1)
        more.append(more[-1] + len(m[0]) - 1)
    return "".join([*out, text[at:]]), places, more


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded structure is that of a key or a signed token."""
    plain, places, more = _spelled(text) if "\\u00" in text else (text, [0], [0])
    out = list(_pem_spans(plain)) if "-----BEGIN " in plain else []
    out += [*_token_spans(plain), *_key_spans(plain), *_hex_spans(plain)]
    if len(places) > 1:

        def there(at: int) -> int:
            return at + more[bisect_right(places, at) - 1]

        out = [(kind, there(a), there(b)) for kind, a, b in out]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined; code points, end exclusive."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [kind] of the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """Scan each row of (doc_id, text).

    Result, a row each: doc_id, n_assign, n_access, n_hex, n_confirmed,
    base_sha256, spans, redacted (the text without its secrets; null where
    there are none). Null text counts as empty, a null doc_id stays null,
    repeated rows give repeated results, other columns are left out. Spans of
    the method may lie inside others (a key between its PEM marks). No shuffle; a task holds a few MB of text at a time, one text at least.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_confirmed", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                base, more = base_spans(text), confirmed_spans(text)
                kinds = [k for k, _, _ in base]
                spans = sorted(base + more, key=_order)
                rows.append((doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans) if spans else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_sha256 string, spans string, redacted string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")


def redacted_column(spark: SparkSession) -> Column:
    """A column of `text`: the text without its secrets; null stays null."""
    bound_batches(spark)

    def run(text: pa.Array) -> pa.Array:
        out = []
        for value in text.to_pylist():
            spans = sorted(base_spans(value) + confirmed_spans(value), key=_order) if value else []
            out.append(redact(value, spans) if spans else value)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(F.col("text"))
