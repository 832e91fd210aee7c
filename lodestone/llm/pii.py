"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score.

Texts without a digit or '@' are dropped by a built-in predicate before any
Python runs; the rest go through compiled patterns in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Characters on either side of a span in which context words count.
NEAR = 48
LEAST_SCORE = 0.5


def luhn(value: str) -> bool:
    """The check digit of payment cards: every second digit from the right doubled."""
    digits = [int(c) for c in value if c.isdigit()]
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
    return len(digits) >= 12 and len(set(digits)) > 1 and total % 10 == 0


def mod97(value: str) -> bool:
    """The check of account numbers (ISO 7064): the first four characters moved to the end, letters as 10 to 35."""
    s = re.sub(r"[\s-]", "", value).upper()
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def octets(value: str) -> bool:
    """Four numbers below 256 without leading zeros; not the unspecified or broadcast address."""
    parts = value.split(".")
    return all(p == str(int(p)) and int(p) < 256 for p in parts) and value not in ("0.0.0.0", "255.255.255.255")


def national_id(value: str) -> bool:
    """The ranges never issued as social security numbers are refused."""
    area, group, serial = (int(x) for x in value.split("-"))
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def phone(value: str) -> bool:
    return 10 <= sum(c.isdigit() for c in value) <= 15


def always(value: str) -> bool:
    return True


@dataclass(frozen=True)
class Kind:
    pattern: re.Pattern
    valid: Callable[[str], bool]
    score: float
    near: re.Pattern
    against: re.Pattern
    #: The characters before which a span that is not valid may end sooner.
    cut: str


def _kind(pattern: str, valid: Callable[[str], bool], score: float, near: str, against: str = r"(?!)", cut: str = "") -> Kind:
    return Kind(re.compile(pattern), valid, score, re.compile(rf"(?i)\b(?:{near})\b"), re.compile(rf"(?i)\b(?:{against})\b"), cut)


#: In the order in which overlapping spans are settled.
KINDS = {
    "email": _kind(r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\w-])", always, 0.8, "e-?mail|mail|contact|kontakt|correo|courriel", "noreply|no-reply"),
    "iban": _kind(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8, "iban|account|bank|konto|cuenta|compte", cut=" -"),
    "card": _kind(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)", luhn, 0.75, "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte|cvv", "order|invoice|tracking|serial|isbn|sku", cut=" "),
    "ssn": _kind(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", national_id, 0.6, "ssn|social|security|tax", "part|model|isbn|order"),
    "phone": _kind(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d)", phone, 0.6, "phone|tel|telefon|tel[eé]fono|t[eé]l[eé]phone|call|mobile|fax|cell|handy", "order|invoice|tracking|serial|isbn|version"),
    "ipv4": _kind(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)", octets, 0.6, "ip|address|host|server|login|client|adresse|direcci[oó]n", "version|release|chapter|section|v"),
}


def confirmed(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the valid spans of a kind, each the longest from its start.

    A span that fails may end at an earlier group, and the search goes on one
    character after its start, so a neighbouring number hides none.
    """
    at = 0
    while m := kind.pattern.search(text, at):
        lo, hi = m.span()
        at = lo + 1
        ends = [hi, *(k for k in range(hi - 1, lo, -1) if text[k] in kind.cut)]
        for end in ends:
            if (end == hi or kind.pattern.fullmatch(text, lo, end)) and kind.valid(text[lo:end]):
                yield lo, end
                at = end
                break


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every confirmed span, by start.

    A context word within ``NEAR`` characters adds 0.15, a word that speaks
    against the kind takes 0.3.  Where spans overlap the higher score stays,
    at equal scores the earlier kind of the table, then the earlier start.
    """
    found = []
    for rank, (name, kind) in enumerate(KINDS.items()):
        for lo, hi in confirmed(kind, text):
            around = text[max(0, lo - NEAR) : lo] + " \n " + text[hi : hi + NEAR]
            score = kind.score + 0.15 * bool(kind.near.search(around)) - 0.3 * bool(kind.against.search(around))
            found.append((-round(min(1.0, score), 2), rank, lo, hi, name))
    found.sort()
    taken: list[tuple[str, int, int, float]] = []
    ends: list[tuple[int, int]] = []
    from bisect import bisect_left, insort

    for score, _, lo, hi, name in found:
        k = bisect_left(ends, (lo, hi))
        if (k and ends[k - 1][1] > lo) or (k < len(ends) and ends[k][0] < hi):
            continue
        insort(ends, (lo, hi))
        taken.append((name, lo, hi, -score))
    return sorted(taken, key=lambda s: s[1])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, kind, start, end, score, redact): the confirmed spans of every text, in characters.

    ``redact`` is whether the score reaches ``least_score``.  Numbers that fail
    their checksum have no row.  Null and empty texts have none; a very long
    one is searched whole.  A null id stays null; rows that repeat give their
    spans each; ties of overlapping spans are settled as spans() says.  Other
    columns, whatever their names, are not read.  An empty table gives no row.
    """

    def work(ids: pa.Array, texts: list) -> dict | None:
        rows = [(k, *s) for k, t in enumerate(texts) for s in spans(t)]
        if not rows:
            return None
        at, kind, lo, hi, score = map(list, zip(*rows))
        return {"doc_id": ids.take(pa.array(at)), "kind": kind, "start": lo, "end": hi, "score": score, "redact": [s >= least_score for s in score]}

    return map_texts(docs.where(F.col(text_col).rlike("[0-9]|@")), id_col, text_col, work, "doc_id long, kind string, start long, end long, score double, redact boolean")
