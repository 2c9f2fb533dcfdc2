"""Secret scans of whole texts: three plain patterns, and candidates confirmed by their structure.

Beyond the patterns, runs of base64 or hex digits, in one line or wrapped, and dotted triples are decoded and
reported only if what they hold parses: a private key in DER (nested lengths must add up exactly), a key in
OpenSSH's own encoding, or a signed token whose header and claims are JSON objects and whose header names an
algorithm. Public keys, certificates, digests and random strings parse as none of these.

Spans are code points of the whole text, end excluded, sorted by start, then kind, then end. Defined
cases: a null text is empty and has no spans; a null doc_id stays null; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from clickloom.llm import work

# The plain patterns with the length that a match needs, in order of kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
BASE = KINDS[:3]

# Line breaks as they are, or written out as in JSON and source text; there, the letter is no digit of the next line.
_BREAK = r"(?:\s|\\+[nr])"
_BREAKS = re.compile(_BREAK + "+")
_PEM = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=]|{_BREAK})*?)-----END \1-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_SSH_MAGIC = b"openssh-key-v1\x00"
# First lines of wrapped keys, of 16 digits at least: DER begins with byte 0x30, OpenSSH keys with their magic. And the lines after them.
_WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M[A-P][A-Za-z0-9+/_-]{14,}|b3BlbnNza[A-Za-z0-9+/_-]{7,})")
_HEX_WRAPPED = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{14,}|6[Ff]70656[Ee]73736[0-9A-Fa-f]{3,})")
_PADDING = re.compile("={0,2}")
_NEXT = re.compile(_BREAK + r"+([A-Za-z0-9+/_-]+)")
_HEX_NEXT = re.compile(_BREAK + r"+([0-9A-Fa-f]+)")


# --------------------------------------------------------------------------- structures


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, contents) of DER elements that fill ``data`` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            n = int.from_bytes(data[at : at + size], "big")
            # The shortest form is the only one allowed.
            if not 1 <= size <= 4 or at + size > len(data) or n < 0x80 or n >> 8 * (size - 1) == 0:
                return None
            at += size
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is a private key: the inner layout of RSA, DSA, EC or algorithm-neutral keys."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = elements(outer[0][1])
    if not parts or parts[0][0] != 0x02 or len(parts[0][1]) != 1 or len(parts) < 3:
        return False
    tags = [tag for tag, _ in parts]
    if tags[1] == 0x30 and tags[2] == 0x04:  # version, algorithm, key
        algorithm = elements(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm[0][1]) >= 3 and elements(parts[2][1]) is not None
    if tags[1] == 0x04:  # version, scalar, curve
        return len(parts[1][1]) in (24, 28, 32, 48, 66) and tags[2] in (0xA0, 0xA1) and bool(elements(parts[2][1]))
    return len(parts) >= 6 and set(tags[:6]) == {0x02} and len(parts[1][1]) >= 32  # numbers of RSA or DSA


def _ssh_length(read: Callable[[int, int], bytes]) -> int:
    """Bytes of the key in OpenSSH's encoding that begins at 0, by its length-prefixed fields; 0 if it's none.

    ``read(a, b)`` gives bytes a to b, fewer at the end of the data; only length fields are read.
    """
    def number(at: int) -> int:
        raw = read(at, at + 4)
        return int.from_bytes(raw, "big") if len(raw) == 4 else -1

    at = len(_SSH_MAGIC)
    if read(0, at) != _SSH_MAGIC:
        return 0
    for _ in range(3):
        n = number(at)
        if n < 0:
            return 0
        at += 4 + n
    keys = number(at)
    if not 1 <= keys <= 16:
        return 0
    at += 4
    for _ in range(keys + 1):
        n = number(at)
        if n < 0:
            return 0
        at += 4 + n
    return at


def _der_length(data: bytes) -> int:
    """Bytes of the DER element that ``data`` begins with, by its length field; 0 if that's malformed."""
    if len(data) < 2 or not data[1] & 0x80:
        return 2 + data[1] if len(data) > 1 else 0
    size = data[1] & 0x7F
    return 2 + size + int.from_bytes(data[2 : 2 + size], "big") if 1 <= size <= 4 and len(data) >= 2 + size else 0


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is a private key in OpenSSH's encoding: its length-prefixed fields add up."""
    return 0 < _ssh_length(lambda a, b: data[a:b]) == len(data)


def _base64(text: str) -> bytes:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return b""
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return b""


def is_signed_token(header: str, claims: str) -> bool:
    try:
        head, body = json.loads(_base64(header)), json.loads(_base64(claims))
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def _key_kind(data: bytes) -> str | None:
    return "der_key" if data[:1] == b"0" and is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


# --------------------------------------------------------------------------- scan


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
            yield m.start(), m.end(), "assign"
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= ACCESS_LENGTH:
            yield m.start(), m.end(), "access"
    # A run of hex digits is one match whatever its length, so the length can stand in the pattern.
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "hex"


class _Lines:
    """Runs of lines of digits, each walked once however many candidates begin in it.

    A candidate's first line ends where a line of some run ends; from there on its lines are the run's.
    """

    def __init__(self, text: str, later: re.Pattern, bits: int):
        self.text, self.later, self.bits = text, later, bits
        self.place: dict[int, tuple[tuple[list[int], list[int], list[int]], int]] = {}

    def after(self, end: int) -> tuple[tuple[list[int], list[int], list[int]], int]:
        """((begins, ends, digits up to each line's end) of the run, place of the line that ends at ``end``)."""
        if end not in self.place:
            begins, ends, upto, at = [end], [end], [0], end
            while n := self.later.match(self.text, at):
                at = n.end()
                begins.append(n.start(1))
                ends.append(at)
                upto.append(upto[-1] + at - n.start(1))
            run = begins, ends, upto
            self.place.update((e, (run, k)) for k, e in enumerate(ends))
        return self.place[end]

    def digits(self, start: int, end: int, a: int, b: int) -> str:
        """Digits a to b of the candidate whose first line is text[start:end]."""
        first = end - start
        out = [self.text[start + a : start + min(b, first)]] if a < first else []
        (begins, ends, upto), k = self.after(end)
        a, b = max(a - first, 0) + upto[k], b - first + upto[k]
        at = bisect_right(upto, a)
        while at < len(upto) and upto[at - 1] < b:
            low, high = max(a - upto[at - 1], 0), min(b, upto[at]) - upto[at - 1]
            out.append(self.text[begins[at] + low : begins[at] + high])
            at += 1
        return "".join(out)

    def line_end(self, start: int, end: int, n: int) -> int | None:
        """Where in the text the candidate's first n digits end, if a line ends there."""
        (_, ends, upto), k = self.after(end)
        want = n - (end - start) + upto[k]
        at = bisect_left(upto, want, k)
        return ends[at] if at < len(upto) and upto[at] == want else None


def wrapped_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in lines of base64 or hex digits. The length that a key states says with which line it ends.

    Lengths are read from the few digits that hold them and looked up among the line ends; a candidate is
    decoded only if a line ends where it should, so repeated starts of keys cost no walk over all lines each.
    """
    for first, later, bits, decode in ((_WRAPPED, _NEXT, 6, _base64), (_HEX_WRAPPED, _HEX_NEXT, 4, lambda x: bytes.fromhex(x[: len(x) // 2 * 2]))):
        lines = _Lines(text, later, bits)
        group = (4, 3) if bits == 6 else (2, 1)  # digits that hold whole bytes

        for m in first.finditer(text):
            start, end = m.span()

            def read(a: int, b: int, start=start, end=end) -> bytes:
                skip = a // group[1]
                raw = decode(lines.digits(start, end, skip * group[0], -(-b // group[1]) * group[0]))
                return raw[a - skip * group[1] : b - skip * group[1]]

            if m[0][0] in "b6":
                size = _ssh_length(read)
            else:
                head = decode(m[0][:16])
                size = _der_length(head)
                # All private keys begin with their version, a number of one byte.
                inner = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0) if len(head) > 1 else 0
                size = size if read(inner, inner + 2) == b"\x02\x01" else 0
            n = -(-8 * size // bits)
            if size and n >= end - start and (stop := lines.line_end(start, end, n)) is not None and (kind := _key_kind(decode(lines.digits(start, end, 0, n)))):
                padding = _PADDING.match(text, stop) if bits == 6 else None
                yield start, padding.end() if padding else stop, kind


def confirmed_spans(text: str) -> Iterator[tuple[int, int, str]]:
    found = set()
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if _key_kind(_base64(_BREAKS.sub("", m[2]))):
                found.add(m.span())
                yield m.start(), m.end(), "pem_key"
    for m in _RUN.finditer(text):
        if kind := _key_kind(_base64(m[0])):
            found.add(m.span())
            yield m.start(), m.end(), kind
    for m in _HEX_RUN.finditer(text):
        if kind := _key_kind(bytes.fromhex(m[0])):
            found.add(m.span())
            yield m.start(), m.end(), kind
    for a, b, kind in wrapped_spans(text):
        if not any(x <= a and b <= y for x, y in found):
            yield a, b, kind
    if "." in text:
        for m in _TOKEN.finditer(text):
            if is_signed_token(m[1], m[2]):
                yield m.start(), m.end(), "signed_token"


def _key(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything found, sorted."""
    text = text or ""
    return sorted([*base_spans(text), *confirmed_spans(text)], key=_key)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found: array of (start, end, kind)) of every row."""

    def make():
        return lambda texts: [[[{"start": a, "end": b, "kind": k} for a, b, k in spans(t)] for t in texts]]

    return work.per_text(docs, make, "found array<struct<start: long, end: long, kind: string>>")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the plain kinds, the digest of their spans, and all spans written out."""

    def written(found: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in found)

    def make():
        def run(texts):
            found = [spans(t) for t in texts]
            base = [[s for s in x if s[2] in BASE] for x in found]
            counts = [[sum(s[2] == kind for s in x) for x in base] for kind in BASE]
            return [*counts, [hashlib.sha256(written(x).encode()).hexdigest() for x in base], [written(x) for x in found]]

        return run

    return work.per_text(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
