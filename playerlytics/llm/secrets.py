"""Secret scan with structural confirmation.

Assigned passwords and tokens, access key ids and hex strings are base kinds, found by their
patterns. Beyond them, base64 and hex candidates are decoded and reported only where the bytes
parse as what they claim to be: private keys in DER (every nested length must add up, and the
fields must be those of a key), OpenSSH keys (length-prefixed strings), PEM blocks around either
(also in base64 as a whole), and signed tokens (a JSON header that names an algorithm, a JSON payload).

Base64 may be wrapped into lines, be of the URL alphabet, and follow other characters of the alphabet;
candidates begin where a key's first bytes can. Only the few bytes that hold lengths are decoded at
first; the whole is decoded where the lengths add up, so that the work is about linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .spans import Span, scan

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "pem", "der", "ssh", "jwt"]

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Base64 of either alphabet, lines joined by a line break; where a DER sequence, an OpenSSH key or a PEM block begins in it
#: (the last in three spellings, by where it stands in a group of three bytes).
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}+={0,2}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++={0,2}+)*+")
_START = re.compile(r"M(?=[A-I])|b3BlbnNzaC1|LS0tLS1CRUdJTi|0tLS0tQkVHSU4g|tLS0tLUJFR0lOI")
#: Characters of a group before each spelling of a PEM block's begin.
_GROUP = {"L": 0, "0": 2, "t": 3}
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d|6F70656E7373682D)[0-9A-Fa-f]{60,}")
#: No private key has more fields than this.
_MOST_FIELDS = 16
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def der_fields(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each DER value in ``raw``; None if a length doesn't add up."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(raw):
                return None
            n, at = int.from_bytes(raw[at:at + size], "big"), at + size
            if n < 0x80 or n >> 8 * (size - 1) == 0:
                return None  # DER lengths are as short as can be
        if at + n > len(raw):
            return None
        out.append((tag, raw[at:at + n]))
        at += n
    return out


def _one_sequence(raw: bytes) -> list[tuple[int, bytes]] | None:
    outer = der_fields(raw)
    return der_fields(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == _SEQUENCE else None


def is_private_key(raw: bytes) -> bool:
    """PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8, by its nested fields."""
    inner = _one_sequence(raw)
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if len(tags) >= 9 and set(tags[:9]) == {_INTEGER} and inner[0][1] in (b"\0", b"\1"):
        return all(x for _, x in inner[1:9])
    if tags[:2] == [_INTEGER, _OCTETS] and inner[0][1] == b"\1":
        return all(t in (0xA0, 0xA1) and der_fields(x) for t, x in inner[2:]) and len(inner[1][1]) >= 16
    named = lambda x: bool((f := der_fields(x)) and f[0][0] == _OID and f[0][1])
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and inner[0][1] in (b"\0", b"\1"):
        return named(inner[1][1]) and len(inner[2][1]) >= 16
    return tags == [_SEQUENCE, _OCTETS] and named(inner[0][1]) and len(inner[1][1]) >= 16


def is_openssh_key(raw: bytes) -> bool:
    """The OpenSSH private key format: magic, then length-prefixed strings that fill it."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n:at]

    if not string() or not string() or string() is None or at + 4 > len(raw):
        return False
    keys, at = int.from_bytes(raw[at:at + 4], "big"), at + 4
    return 1 <= keys <= 16 and all(string() for _ in range(keys)) and bool(string()) and at == len(raw)


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(text: str) -> dict | None:
    try:
        x = json.loads(_decoded(text, url=True) or b"")
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


class _Run:
    """A base64 run without its line breaks and padding, in the standard alphabet; places in it lead back to the text."""

    def __init__(self, m: re.Match):
        self.text, self.starts, self.ends, at = "", [], [], 0
        lines = []
        for line in re.finditer(r"[A-Za-z0-9+/_-]+", m[0]):
            lines.append(line[0])
            self.starts.append(at)
            self.ends.append(m.start() + line.start())
            at += len(line[0])
        self.text = "".join(lines).replace("-", "+").replace("_", "/")
        self.lines = {*self.starts[1:], at}  # where a line ends

    def place(self, at: int) -> int:
        line = bisect_right(self.starts, at) - 1
        return self.ends[line] + at - self.starts[line]

    def peek(self, start: int, at: int, n: int) -> bytes:
        """``n`` bytes from byte ``at`` of what is encoded from character ``start`` on (fewer at the end)."""
        first, skip = start + at // 3 * 4, at % 3
        chunk = self.text[first:first + (skip + n + 2) // 3 * 4]
        have = len(chunk) * 6 // 8
        return binascii.a2b_base64(chunk + "A" * (-len(chunk) % 4))[skip:min(skip + n, have)]

    def ends_at(self, start: int, n: int) -> int | None:
        """The character after ``n`` bytes from ``start``, if the run or a line ends there."""
        end = start + -(-n * 4 // 3)
        return end if end in self.lines else None


def _sequence_size(run: _Run, start: int) -> int | None:
    """Bytes of a DER sequence whose fields' lengths add up and whose first field a key may have; reads lengths only."""
    def header(at: int) -> tuple[int, int, int] | None:
        raw = run.peek(start, at, 6)
        if len(raw) < 2:
            return None
        tag, n = raw[0], raw[1]
        if not n & 0x80:
            return tag, 2, n
        size = n & 0x7F
        if not 1 <= size <= 4 or len(raw) < 2 + size:
            return None
        return tag, 2 + size, int.from_bytes(raw[2:2 + size], "big")

    outer = header(0)
    if not outer or outer[0] != _SEQUENCE:
        return None
    at, total = outer[1], outer[1] + outer[2]
    if total * 4 > (len(run.text) - start) * 3 + 3:
        return None
    first = run.peek(start, at, 3)
    if first[:1] != bytes([_SEQUENCE]) and first not in (b"\x02\x01\0", b"\x02\x01\x01"):
        return None
    for _ in range(_MOST_FIELDS):
        field = header(at)
        if not field:
            return None
        at += field[1] + field[2]
        if at >= total:
            return total if at == total else None
    return None


def _openssh_size(run: _Run, start: int) -> int | None:
    """Bytes of an OpenSSH key whose strings' lengths add up to the end of a line; reads lengths only."""
    at, keys = 15, 0
    for i in range(4 + _MOST_FIELDS):
        raw = run.peek(start, at, 4)
        if len(raw) < 4:
            return None
        n = int.from_bytes(raw, "big")
        if i == 3:  # the number of public keys
            keys, at = n, at + 4
            if not 1 <= keys <= _MOST_FIELDS:
                return None
            continue
        at += 4 + n
        if at * 4 > (len(run.text) - start) * 3 + 3:
            return None
        if keys and i == 4 + keys:
            return at
    return None


def _pem_blocks(text: str) -> list[tuple[int, int]]:
    """Blocks whose body is a private key; a body ends at its END line or before the next BEGIN."""
    begins = list(_PEM.finditer(text))
    found = []
    for m, after in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        foot = f"-----END {m[1]}-----"
        end = text.find(foot, m.end(), after)
        if end < 0:
            continue
        body = re.sub(r"(?m)^[A-Za-z0-9-]+:.*$", "", text[m.end():end])  # headers of encrypted keys
        raw = _decoded(re.sub(r"\s+|\\[nr]", "", body))
        if raw and ("ENCRYPTED" in text[m.start():end] and len(raw) >= 32 or is_private_key(raw) or is_openssh_key(raw)):
            found.append((m.start(), end + len(foot)))
    return found


def _in_run(run: _Run) -> list[tuple[str, int, int]]:
    """Keys in a base64 run, as places in it, leftmost first and not overlapping."""
    found, done, wrapped = [], 0, set()
    for m in _START.finditer(run.text):
        at = m.start()
        if at < done:
            continue
        if m[0][0] in _GROUP:  # a PEM block in base64: one decoding of the run serves all starts of its alignment
            at -= _GROUP[m[0][0]]
            if at < 0 or at % 4 in wrapped:
                continue
            wrapped.add(at % 4)
            raw = binascii.a2b_base64(run.text[at:len(run.text) - (len(run.text) - at) % 4] + _filled(run.text[at:]))
            for s, e in _pem_blocks(raw.decode("latin-1")):
                found.append(("pem", at + s * 4 // 3, min(len(run.text), at + -(-e * 4 // 3))))
            continue
        ssh = m[0].startswith("b")
        size = _openssh_size(run, at) if ssh else _sequence_size(run, at)
        end = run.ends_at(at, size) if size else None
        if end is None:
            continue
        raw = run.peek(at, 0, size)
        if is_openssh_key(raw) if ssh else is_private_key(raw):
            found.append(("ssh" if ssh else "der", at, end))
            done = end
    return found


def _filled(text: str) -> str:
    """The last incomplete group of base64 text, padded (nothing for a single character)."""
    rest = text[len(text) - len(text) % 4:]
    return rest + "=" * (4 - len(rest)) if len(rest) > 1 else ""


def _confirmed(text: str) -> list[Span]:
    inside = _pem_blocks(text) if "PRIVATE KEY-----" in text else []
    found = [("pem", s, e) for s, e in inside]
    starts = [s for s, _ in inside]

    def covered(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i >= 0 and at < inside[i][1]

    for m in _RUN.finditer(text):
        if not _START.search(m[0]) and "\n" not in m[0]:
            continue
        run = _Run(m)
        for kind, s, e in _in_run(run):
            start, end = run.place(s), run.place(e - 1) + 1
            while end < m.end() and text[end] == "=":
                end += 1
            if not covered(start):
                found.append((kind, start, end))
    for m in _HEX_RUN.finditer(text):
        raw = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else b""
        if is_private_key(raw):
            found.append(("der", *m.span()))
        elif is_openssh_key(raw):
            found.append(("ssh", *m.span()))
    if ".e" in text or ".W" in text:
        for m in _JWT.finditer(text):
            head = _json_object(m[1])
            if head and isinstance(head.get("alg"), str) and _json_object(m[2]) is not None:
                found.append(("jwt", *m.span()))
    return found


def find(text: str) -> list[Span]:
    """All spans of a text, base kinds by their patterns, the others as far as confirmed."""
    found = _confirmed(text)
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every whole text; spans by start, then kind as in ``KINDS``.

    Base matches are leftmost and non-overlapping per kind; an assignment whose value is under 12
    characters is dropped after it has taken its place. A null text is empty; repeated rows and
    null ids stay; an empty table gives no rows; extra columns are not read.
    """
    return scan(docs, find, KINDS, id_col, text_col)
