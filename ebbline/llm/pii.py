"""Personal data in texts: an Aho-Corasick pass finds anchors, small parsers expand each to a span.

Anchors are at-signs, plus signs, digits, URL schemes and identifier cues.  The parsers read the
text around an anchor once, so the work is linear in the text, whatever it holds; they return what
the contract's patterns match (leftmost, not overlapping, per kind) and two kinds of their own:
``url`` (a scheme and its address) and ``account`` (a cue such as "IBAN:" and the identifier that
follows).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame

from ebbline.llm.common import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "passport", "user id", "userid", "customer id", "api key", "api_key", "token", "password")
SECRETS = ("api key", "api_key", "token", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"[ ().0-9-]*")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]+")
_ACCOUNT = re.compile(r"(?: (?:no|nr|number|id))?\.?\s{0,2}[:=#]?\s{0,2}([A-Za-z0-9](?:[A-Za-z0-9_-]| (?=[A-Z0-9]{4}\b)){3,40}[A-Za-z0-9])", re.I)
_DIGITS = frozenset("0123456789")
_GROUPS = re.compile(r"[A-Za-z0-9](?: ?[A-Za-z0-9])*")
_SSN = re.compile(r"([0-9]{3})[ -]?([0-9]{2})[ -]?([0-9]{4})(?![0-9A-Za-z])")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    automaton.add_word("@", ("email", 1))
    automaton.add_word("+", ("phone", 1))
    for scheme in SCHEMES:
        automaton.add_word(scheme, ("url", len(scheme)))
    for cue in CUES:
        automaton.add_word(cue, ("account", len(cue)))
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    """The text in lower case, character by character at the same places."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def iban(text: str) -> bool:
    """Two letters, check digits and up to 30 characters that leave 1 modulo 97."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _identifier(cue: str, text: str) -> int:
    """How many characters of what follows the cue are its identifier; 0 if they are none.

    An IBAN's check digits decide how far it goes; a social security number has nine digits and no
    empty group; a password, token or key has letters and digits, or eight characters at least with a
    digit; any other identifier has four digits.
    """
    if cue == "iban":
        ends = [k for k in range(len(text), 14, -1) if iban(text[:k].replace(" ", "").upper()) and text[k - 1] != " "]
        return ends[0] if ends else 0
    if cue == "ssn":
        found = _SSN.match(text)
        return found.end() if found and "000" not in found.groups()[:1] and found[2] != "00" and found[3] != "0000" else 0
    digits = sum(c in _DIGITS for c in text)
    if cue in SECRETS:
        word = text.split(" ", 1)[0]
        return len(word) if any(c in _DIGITS for c in word) and (len(word) >= 8 or digits >= 4) else 0
    return len(text) if digits >= 4 else 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    found = _LABELS.match(text, at + 1)
    return (start, found.end()) if found else None


def _phone(text: str, at: int) -> tuple[int, int, int]:
    """Start and end of the match, 0 where there is none, and where its characters end."""
    if text[at + 1 : at + 2] not in _DIGITS:
        return at, 0, at + 1
    stop = end = _PHONE.match(text, at + 2).end()
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return at, end if end > at + 3 else 0, stop


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds in the order of KINDS, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    email_end = dotted_end = chain_end = phone_end = url_end = account_end = 0
    for last, (anchor, width) in _automaton().iter(_lower(text)):
        start = last + 1 - width
        if anchor == "digit":
            if start >= dotted_end:
                dotted_end = _add_ips(text, start, found["ip"])
            if start >= chain_end:
                chain = _CHAIN.match(text, start)
                chain_end = chain.end()
                _add_card(text, start, chain_end, found["card"])
        elif anchor == "email":
            if start >= email_end and (span := _email(text, start, email_end)):
                found["email"].append(span)
                email_end = span[1]
        elif anchor == "phone":
            if start >= phone_end:
                first, end, _ = _phone(text, start)
                if end:
                    phone_end = end
                    if 9 <= _digits(text, first, end) <= 15:
                        found["phone"].append((first, end))
        elif anchor == "url":
            if start >= url_end and (rest := _ADDRESS.match(text, last + 1)):
                end = rest.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end > last + 1:
                    found["url"].append((start, end))
                    url_end = end
        elif start >= account_end and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            rest = _ACCOUNT.match(text, last + 1)
            cue = text[start : last + 1].lower()
            if rest and (size := _identifier(cue, _GROUPS.match(text, rest.start(1), rest.start(1) + 42)[0] if cue == "iban" else rest[1])):
                found["account"].append((rest.start(1), rest.start(1) + size))
                account_end = rest.start(1) + size
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def _digits(text: str, start: int, end: int) -> int:
    return sum(c in _DIGITS for c in text[start:end])


def _add_ips(text: str, start: int, spans: list[tuple[int, int]]) -> int:
    """Four parts at a time, as a leftmost scan of a longer chain takes them."""
    chain = _DOTTED.match(text, start)
    if chain.end() - start >= 7 and "." in chain[0]:
        parts = chain[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                spans.append((start, start + length))
            start += length + 1
    return chain.end()


def _add_card(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> None:
    if 13 <= end - start <= 37:
        digits = text[start:end].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((start, end))


def describe(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span's place taken by its kind in angle brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
            done = end
    return "".join([*out, text[done:]])


def _work(masked: bool) -> Callable[[], Callable[[list[str | None]], Sequence]]:
    def work(texts: list[str | None]) -> Sequence:
        all_spans = [find_spans(t) for t in texts]
        base = [[s for s in spans if s[0] in BASE_KINDS] for spans in all_spans]
        counts = [[sum(s[0] == kind for s in spans) for spans in base] for kind in BASE_KINDS]
        digests = [hashlib.sha256(describe(spans).encode()).hexdigest() for spans in base]
        added = [[sum(s[0] == kind for s in spans) for spans in all_spans] for kind in ADDED_KINDS]
        columns = [*counts, digests, [describe(spans) for spans in all_spans], *added]
        return [*columns, list(map(redact, texts, all_spans))] if masked else columns

    return lambda: work


def find_pii(
    df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", masked: bool = False,
) -> DataFrame:
    """``keep`` with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account (and ``masked``: the text with
    spans replaced), one row per input row.

    A null or empty text has no spans (a null's masked text is null); repeated rows stay; an empty
    table gives an empty table; a kept column named like a result gives way to it.
    """
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long"
    return map_texts(df, keep, text, fields + ", masked string" * masked, _work(masked))
