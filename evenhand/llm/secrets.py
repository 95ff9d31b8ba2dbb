"""Secret scans: pattern hits, and structures confirmed by decoding them.

Three plain kinds (assign, access, hex) come from patterns. Three more are reported only when the candidate decodes to
the structure that it claims: ``jwt`` (a signed-token header and payload), ``der`` (a private key in PKCS#1, PKCS#8 or
SEC1 form, or an encrypted one in PKCS#8 form, all nested lengths fitting exactly) and ``openssh`` (the length-prefixed key
format). Keys are read from hex and from base64, its URL form and lines of it included, whether line breaks or spaces part
them; a key's own lengths say where it ends, and only its headers are decoded. Armour may have header lines and escaped line
breaks, and may itself be in base64 or hex.

Null and empty texts have no spans. Rows are handled one by one, so repeated rows give repeated results and an empty
table an empty one. Very long texts are scanned whole, in time that grows with their length: a candidate costs a few decoded
headers, and what lies inside a key that was found is not looked at again. Keys have any size. Spans with one start go by
kind as listed. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import col, field, text_map

# The kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh")
# The patterns of the plain kinds and the least lengths.
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Base64 that begins as a DER sequence or the magic of an OpenSSH key does, and what may part its lines.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-I]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{14}")
#: The same that begins as armour does, at any place in a stretch of base64.
BASE64_ARMOUR = re.compile(r"LS0tLS1CRUdJTi")
LETTERS64 = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(r"[ \t]*(?:\r|\n|\\r|\\n)[ \t]*(?:(?:\r|\n|\\r|\\n)[ \t]*)?|[ \t]+")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,32}PRIVATE KEY)-----")
HEADER = re.compile(r"[A-Za-z0-9-]+:")
OPENSSH = b"openssh-key-v1\x00"
HEX_STARTS = ("30", OPENSSH.hex(), b"-----BEGIN ".hex())
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
# The object ids of password-based encryption begin with these bytes.
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Elements that a key has at most: a PKCS#1 key of several primes has ten.
MOST_ELEMENTS = 10

#: Gives n bytes at an offset, fewer at the end.
Reader = Callable[[int, int], bytes]


def _header(read: Reader, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, and where the content of the element at ``at`` begins and ends."""
    head = read(at, 6)
    if at + 2 > end or len(head) < 2:
        return None
    width, size = 0, head[1]
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or len(head) < 2 + width:
            return None
        size = int.from_bytes(head[2 : 2 + width], "big")
    begin = at + 2 + width
    return (head[0], begin, begin + size) if begin + size <= end else None


def _elements(read: Reader, at: int, end: int, most: int = MOST_ELEMENTS) -> list[tuple[int, int, int]] | None:
    """The elements that fill the stretch exactly, ``most`` of them at most, else None. Contents are not read."""
    found = []
    while at < end:
        if len(found) == most or (got := _header(read, at, end)) is None:
            return None
        found.append(got)
        at = got[2]
    return found


def _algorithm(read: Reader, element: tuple[int, int, int]) -> bytes | None:
    """The first bytes of the object id that names an algorithm, if the sequence is one."""
    parts = _elements(read, element[1], element[2], 2)
    return read(parts[0][1], min(9, parts[0][2] - parts[0][1])) if parts and parts[0][0] == OBJECT else None


def der_key_size(read: Reader, size: int) -> int | None:
    """Bytes of the private key that the stretch begins with, if its nested lengths all fit."""
    outer = _header(read, 0, size)
    if outer is None or outer[0] != SEQUENCE or not (parts := _elements(read, outer[1], outer[2])):
        return None
    tags, sizes = [p[0] for p in parts], [p[2] - p[1] for p in parts]
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8: algorithm, data
        name = _algorithm(read, parts[0])
        return outer[2] if name and name.startswith(ENCRYPTIONS) and sizes[1] else None
    if tags[0] != INTEGER or sizes[0] != 1:
        return None
    if len(parts) >= 9 and tags[:9] == [INTEGER] * 9:  # PKCS#1: version, modulus, exponents, primes, ...
        return outer[2] if all(sizes[:9]) else None
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8: version, algorithm, key
        return outer[2] if _algorithm(read, parts[1]) is not None and sizes[2] else None
    if tags[1:2] == [OCTETS] and read(parts[0][1], 1) == b"\x01":  # SEC1: version 1, key, [0] curve, [1] point
        return outer[2] if sizes[1] >= 16 and all(tag in (0xA0, 0xA1) for tag in tags[2:]) else None
    return None


def openssh_size(read: Reader, size: int) -> int | None:
    """Bytes of the key file that the stretch begins with: magic, cipher, kdf, options, count, public keys, private part."""
    if read(0, len(OPENSSH)) != OPENSSH:
        return None

    def behind(at: int, least: int) -> int | None:
        """Where the string at ``at`` ends."""
        head = read(at, 4)
        length = int.from_bytes(head, "big")
        return at + 4 + length if len(head) == 4 and length >= least and at + 4 + length <= size else None

    at: int | None = len(OPENSSH)
    for _ in range(3):
        if (at := behind(at, 0)) is None:
            return None
    count, at = int.from_bytes(read(at, 4), "big"), at + 4
    if not 1 <= count <= 64:
        return None
    for _ in range(count + 1):
        if (at := behind(at, 1)) is None:
            return None
    return at


def key_size(read: Reader, size: int) -> tuple[int, str] | None:
    """Size and kind of the key that a stretch of ``size`` bytes begins with."""
    if (found := der_key_size(read, size)) is not None:
        return found, "der"
    return (found, "openssh") if (found := openssh_size(read, size)) is not None else None


def _key_kind(data: bytes | None) -> str | None:
    """The kind of the key that the bytes are, no more and no less."""
    got = key_size(lambda at, n: data[at : at + n], len(data)) if data else None
    return got[1] if got and got[0] == len(data) else None


def is_private_key_der(data: bytes) -> bool:
    return _key_kind(data) == "der"


def _unbase64(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(text: str) -> dict | None:
    raw = _unbase64(text, url=True)
    try:
        got = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


class _Stretch:
    """Base64 letters that line breaks or spaces part, and where they are in the text."""

    def __init__(self, text: str, start: int) -> None:
        self.starts, self.before, pieces, total = [], [], [], 0
        at = start
        while (m := LETTERS64.match(text, at)) is not None:
            self.starts.append(m.start())
            self.before.append(total)
            pieces.append(m[0])
            total += len(m[0])
            self.end = m.end()
            if (gap := BREAK.match(text, m.end())) is None:
                break
            at = gap.end()
        self.letters = "".join(pieces)
        self.url, self.plain = ([m.start() for m in re.finditer(x, self.letters)] for x in ("[-_]", r"[+/]"))

    def index(self, at: int) -> int:
        """The number of the letter at a place of the text."""
        i = bisect_right(self.starts, at) - 1
        return self.before[i] + at - self.starts[i]

    def place(self, letter: int) -> int:
        """Where in the text the letter is."""
        i = bisect_right(self.before, letter) - 1
        return self.starts[i] + letter - self.before[i]

    def mixed(self, a: int, b: int) -> bool:
        """Whether letters of both alphabets lie between two letters."""
        return all(bisect_right(x, b - 1) > bisect_right(x, a - 1) for x in (self.url, self.plain))

    def reader(self, first: int) -> tuple[Reader, int]:
        """Reads bytes of what begins at a letter, decoding no more than asked for; and their number."""

        def read(at: int, n: int) -> bytes:
            skip = at % 3
            a = first + at // 3 * 4
            part = self.letters[a : a + -(-(skip + n) // 3) * 4]
            part = part[: len(part) - (len(part) % 4 == 1)]
            return base64.b64decode(part.translate(URL) + "=" * (-len(part) % 4))[skip : skip + n]

        return read, (len(self.letters) - first) * 3 // 4


URL = str.maketrans("-_", "+/")


def _base64_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64, and armour in base64."""
    found, stretch, done = [], None, 0
    for m in BASE64.finditer(text):
        if m.start() < done:
            continue
        if stretch is None or m.start() >= stretch.end:
            stretch = _Stretch(text, m.start())
        first = stretch.index(m.start())
        read, size = stretch.reader(first)
        if (got := key_size(read, size)) is None:
            continue
        behind = first - (-got[0] * 4 // 3)  # letters, less padding
        end = stretch.place(behind - 1) + 1
        # more of the alphabet right behind is not a key that ends here
        if stretch.mixed(first, behind) or LETTERS64.match(text, end):
            continue
        while end < len(text) and text[end] == "=":
            end += 1
        found.append((m.start(), end, got[1]))
        done = end
    return found + _base64_armour(text)


def _base64_armour(text: str) -> list[tuple[int, int, str]]:
    """Armour in base64: a stretch is decoded once for each of the four places in a quantum where armour begins there."""
    found, stretch, phases = [], None, set()
    for m in BASE64_ARMOUR.finditer(text):
        if stretch is None or m.start() >= stretch.end:
            stretch, phases = _Stretch(text, m.start()), set()
        first = stretch.index(m.start())
        if first % 4 in phases:
            continue
        phases.add(first % 4)
        body = stretch.letters[first:]
        data = base64.b64decode(body[: len(body) // 4 * 4].translate(URL)) + (_unbase64(body[len(body) // 4 * 4 :].translate(URL)) or b"")
        for a, b, kind in _armoured(data.decode("latin-1")):
            end = stretch.place(min(first - (-b * 4 // 3), len(stretch.letters)) - 1) + 1
            while end < len(text) and text[end] == "=":
                end += 1
            found.append((stretch.place(first + a * 4 // 3), end, kind))
    return found


def _armoured(text: str) -> list[tuple[int, int, str]]:
    """Private keys between their BEGIN and END lines; the last BEGIN before an END counts."""
    found, m = [], ARMOUR.search(text)
    while m is not None:
        following, mark = ARMOUR.search(text, m.end()), f"-----END {m[1]}-----"
        end = text.find(mark, m.end(), following.start() if following else len(text))
        if end >= 0:
            lines = text[m.end() : end].replace("\\r", "\n").replace("\\n", "\n").split("\n")
            body = "".join("".join(x.split()) for x in lines if not HEADER.match(x.strip()))
            if (kind := _key_kind(_unbase64(body))) is not None:
                found.append((m.start(), end + len(mark), kind))
        m = following
    return found


def _hex_kind(digits: str) -> str | None:
    """The kind of key, or of armour around one, that hex digits spell."""
    if len(digits) % 2 or not digits.lower().startswith(HEX_STARTS):
        return None
    data = bytes.fromhex(digits)
    if (kind := _key_kind(data)) is not None:
        return kind
    inside = _armoured(data.decode("latin-1")) if data.startswith(b"-----") else []
    return inside[0][2] if inside else None


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind as listed; code points, end exclusive."""
    if not text:
        return []
    spans = {(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST}
    spans |= {(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST}
    spans |= {(m.start(), m.end(), "hex") for m in HEX.finditer(text)}
    for m in TOKEN.finditer(text):
        header = _json_object(m[1])
        if header and isinstance(header.get("alg"), str) and _json_object(m[2]) is not None and (not m[3] or _unbase64(m[3], url=True) is not None):
            spans.add((m.start(), m.end(), "jwt"))
    spans |= set(_base64_keys(text))
    for m in ANY_HEX.finditer(text):
        if (kind := _hex_kind(m[0])) is not None:
            spans.add((m.start(), m.end(), kind))
    spans |= set(_armoured(text))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``secret_spans``: array of (kind, start, end), never null."""
    fields = [field("secret_spans", "array<struct<kind:string,start:int,end:int>>")]
    return text_map(docs, text_col, list(keep), fields, lambda texts: [[[{"kind": k, "start": a, "end": b} for a, b, k in find(t)] for t in texts]])


def redacted(text: str | None, mask: str = "[{kind}]") -> str | None:
    """The text with every maximal run of secrets replaced by a mark of its first kind."""
    spans = find(text)
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        parts += [text[at:start], mask.format(kind=kind)]
        at, i = end, i + 1
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, secrets in the text replaced by marks such as [assign]."""
    names, fresh = docs.columns, "redacted text"
    out = text_map(docs, text_col, names, [field(fresh, "string")], lambda texts: [[redacted(t) for t in texts]])
    return out.select(*((col(fresh) if c == text_col else col(c)).alias(c) for c in names))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the plain kinds, and all spans as one string."""
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    counts = [_count(spans, k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
