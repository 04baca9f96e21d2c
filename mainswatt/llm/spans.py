"""Base patterns of personal data and secrets, found in time linear in the text, and their digests."""

from __future__ import annotations

import hashlib
import re

PERSONAL = ("email", "ip", "card", "phone")
SECRET = ("assign", "access", "hex")

_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits (or hex digits) that it could have begun earlier, so looking
# behind changes nothing but the time: without it a long run costs its square.
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def holds(kind: str, s: str) -> bool:
    """Whether a string of the kind's shape is of the kind."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits_of(s)
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(digits_of(s)) <= 15 if kind == "phone" else True


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _local.match(text, start - 1):
            start -= 1
        m = _domain.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    return out


def personal(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for kind, pattern in (("ip", _ip), ("card", _card), ("phone", _phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(kind, m.group())]
    return out


def secrets(text: str, lowered: str | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed."""
    out = []
    lowered = text.lower() if lowered is None else lowered
    if any(w in lowered for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end(), m.group(2)) for m in _assign.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.group()) for m in _access.finditer(text) if len(m.group()) >= 18]
    out += [("hex", m.start(), m.end(), m.group()) for m in _hex.finditer(text)]
    return sorted(out, key=lambda x: (x[1], SECRET.index(x[0])))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
