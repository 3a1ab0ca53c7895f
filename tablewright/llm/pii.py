"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, URL schemes, plus signs and
dots before digits, digit pairs, and identifier cues in any case of A-Z. A deterministic parser for each kind then expands
from the anchor to both sides and validates what it found. Expansion is bounded by the previous match of
the same kind, which makes the matches the leftmost non-overlapping ones of the kind's pattern.

Null and empty texts have no spans; rows are kept one to one, so repeated rows, null ids and ties need no
rule; an empty table gives no rows; other columns are not read, so their names can't clash. Texts of any length are
scanned whole, in linear work, since a parser never walks a stretch twice.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, map_batches, table

#: Kinds that the contract fixes, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "ssn", "account")
#: Words that announce an identifier, by kind.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "konto", "cuenta", "compte"),
}
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:]++:[^\s/@]++@")
IBAN = re.compile(r"[:#\s]{0,3}(?=([A-Z]{2})[0-9]{2})")
#: Length of an IBAN by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SSN = re.compile(r"(?: (?i:no|number)\.?)?[:#\s]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"(?: (?i:no|number|nr|num)\.?)?[:#\s]{0,3}([0-9]{6,17})(?![0-9])")


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchor string -> (anchor kind, its length)."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("://", ("login", 3))
    for d in DIGITS:
        a.add_word(f"+{d}", ("phone", 2))
        a.add_word(f".{d}", ("ip", 2))
        for e in DIGITS:
            for mid in ("", " ", "-"):
                a.add_word(f"{d}{mid}{e}", ("card", 2 + len(mid)))
    for kind, cues in CUES.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def folded(text: str) -> str:
    """The text with A-Z in lower case, as long as before: bytes fold these alone."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


@cache
def iban_shape(length: int) -> re.Pattern:
    """So many capitals and digits, with single blanks between them, and no more of the same word."""
    return re.compile(rf"[A-Z0-9](?: ?[A-Z0-9]){{{length - 1}}}(?![A-Za-z0-9])")


def iban_span(text: str, at: int) -> tuple[int, int] | None:
    """The span of the IBAN that begins at most three characters after ``at``: its country fixes where it ends."""
    m = IBAN.match(text, at)
    found = iban_shape(IBAN_LENGTHS[m[1]]).match(text, m.end()) if m and m[1] in IBAN_LENGTHS else None
    if not found:
        return None
    s = found[0].replace(" ", "")
    return found.span() if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else None


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Validated spans by kind, in code points, end exclusive, in order of their start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    if not text:
        return found
    after = dict.fromkeys(found, 0)
    for end, (kind, width) in automaton().iter(folded(text)):
        at, bound = end - width + 1, after[kind]
        if at < bound:
            continue
        if kind == "card":
            m = CHAIN.match(text, at)
            after[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found[kind].append(m.span())
        elif kind == "email":
            start = at
            while start > bound and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                after[kind] = m.end()
                found[kind].append((start, m.end()))
        elif kind == "ip":
            start = at
            while start > bound and text[start - 1] in DIGITS:
                start -= 1
            if start < at and (m := QUAD.match(text, start)):
                after[kind] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                    found[kind].append(m.span())
        elif kind == "phone":
            if m := PHONE.match(text, at):
                after[kind] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found[kind].append(m.span())
        elif kind == "login":
            if m := LOGIN.match(text, end + 1):
                after[kind] = m.end()
                found[kind].append((m.start(), m.end() - 1))
        elif kind == "iban":
            if span := iban_span(text, end + 1):
                after[kind] = span[1]
                found[kind].append(span)
        elif m := {"ssn": SSN, "account": ACCOUNT}[kind].match(text, end + 1):
            after[kind] = m.end()
            found[kind].append(m.span(1))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans as ``kind:start:end``."""

    def run(cols: dict) -> dict:
        found = [find_spans(t) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            **{f"n_{k}": [len(f[k]) for f in found] for k in BASE},
            "base_sha256": [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found],
            "spans": [joined(f, BASE + ADDED) for f in found],
            "n_spans": [sum(map(len, f.values())) for f in found],
        }

    return map_batches(id_and_text(docs), run, SCHEMA)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
