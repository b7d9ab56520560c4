"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Every kind has a pattern, a starting score, an optional validator and context words. A proposal
that fails its validator is dropped. One that passes starts at the kind's score and gains or
loses by the words in the text before it; spans that reach ``MIN_SCORE`` are reported. The four
base kinds are always reported: context moves their score but never removes them.

Patterns are written so that a scan is linear in the text: runs are possessive and a match may
only start where a run starts, which yields the same leftmost matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
MIN_SCORE = 0.6
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.35
CONTEXT_LOSS = 0.25

SPANS_TYPE = ("array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def luhn(text: str) -> bool:
    """The check digit of payment cards and device numbers."""
    total = 0
    for place, digit in enumerate(reversed([int(c) for c in text if "0" <= c <= "9"])):
        doubled = digit * 2 if place % 2 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check digits of international bank account numbers."""
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def n_digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def card_valid(text: str) -> bool:
    return 12 <= n_digits(text) <= 19 and luhn(text)


def ip_valid(text: str) -> bool:
    parts = [part.lstrip("0") for part in text.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def phone_valid(text: str) -> bool:
    return 9 <= n_digits(text) <= 15


def imei_valid(text: str) -> bool:
    return n_digits(text) == 15 and luhn(text)


def ssn_valid(text: str) -> bool:
    """Areas 000, 666 and 9xx, group 00 and serial 0000 are never given out."""
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    """What is looked for; ``pattern`` proposes, ``valid`` confirms, ``context`` moves the score."""

    name: str
    pattern: str
    score: float
    valid: Callable[[str], bool] | None = None
    context: tuple[str, ...] = ()
    against: tuple[str, ...] = ()
    anchor: str = ""            # characters of which a match holds at least one
    digits: bool = True         # a match holds a digit, at its third character at the latest
    group: int = 0
    base: bool = False


# The base patterns are given; the others follow the public formats.
KINDS = (
    Kind("email", "", 0.9, context=("mail", "email", "e-mail", "contact"), anchor="@", digits=False, base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, ip_valid,
         ("ip", "address", "host", "server"), ("version", "release"), ".", base=True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", 0.8, card_valid,
         ("card", "credit", "visa", "payment"), base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.8, phone_valid,
         ("phone", "tel", "call", "mobile", "fax"), anchor="+", base=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
                 r"(?![A-Za-z0-9])", 0.8, mod97, ("iban", "account", "bank")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, ssn_valid,
         ("ssn", "social", "security"), ("order", "part", "serial"), "-"),
    Kind("local_phone", r"(?<![0-9+(-])(?<![0-9][ )])\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9])",
         0.4, None, ("phone", "tel", "call", "mobile", "fax"), ("order", "invoice")),
    Kind("imei", r"(?<![0-9])[0-9]{15}(?![0-9])", 0.35, imei_valid, ("imei", "device")),
    Kind("secret", r"(?i:(?:token|secret|passwd|password|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3})"
                   r"[\"']?([A-Za-z0-9_+/-]{16,256})", 0.7, None, (), ("example", "dummy"),
         "=:", digits=False, group=1),
)

#: Characters of an account number by country, from the public registry.
IBAN_LENGTHS = {code: int(length) for length, codes in (part.split(":") for part in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV "
    "22:BG,BH,CR,DE,GB,GE,IE,ME,RS 23:AE,GI,IL,IQ,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
    "25:PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC").split()) for code in codes.split(",")}

_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(r"[a-z][a-z-]*")


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each at sign outwards.

    A match holds exactly one at sign and starts where the run of allowed characters before it
    starts, or where the match before it ended; looking outwards from the sign therefore gives
    the leftmost matches without trying every position of a long run.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and _LOCAL_RUN.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        # Characters up to this sign cannot belong to a later match: it is not in the run.
        free = max(free, at + 1)
        at = text.find("@", free)


def iban_spans(text: str, pattern: re.Pattern, begin: int) -> Iterator[tuple[int, int]]:
    """Account numbers whose check digits hold, also where words in capitals follow.

    The pattern cannot tell such a word from the next group of a number. Of the ends between two
    words, that with the length of the country comes first, then the longest. What is left of a
    proposal is looked at again; it has 42 characters at most, so the scan stays linear.
    """
    proposal = pattern.search(text, begin)
    while proposal:
        start, end = proposal.span()
        ends = [end]
        while (end := text.rfind(" ", start, end)) > 0:
            ends.append(end)
        size = IBAN_LENGTHS.get(text[start:start + 2])
        ends.sort(key=lambda e: e - start - text.count(" ", start, e) != size)
        found = next((e for e in ends if mod97(text[start:e])), None)
        if found:
            yield start, found
        proposal = pattern.search(text, found or start + 1)


def _near(text: str, start: int) -> set[str]:
    return set(_WORDS.findall(text[max(0, start - CONTEXT_CHARS):start].lower()))


def find(text: str | None, compiled: list[tuple[Kind, re.Pattern]]) -> list[dict]:
    """Spans of one text in order of start and then kind; null and empty texts have none."""
    if not text:
        return []
    found = []
    digit = _DIGIT.search(text)
    for order, (kind, pattern) in enumerate(compiled):
        if kind.anchor and not any(c in text for c in kind.anchor) or kind.digits and not digit:
            continue
        begin = max(0, digit.start() - 2) if kind.digits else 0
        if kind.name == "email":
            spans = email_spans(text)
        elif kind.name == "iban":
            spans = iban_spans(text, pattern, begin)
        else:
            spans = (m.span(kind.group) for m in pattern.finditer(text, begin))
        for start, end in spans:
            if kind.valid and not kind.valid(text[start:end]):
                continue
            near = _near(text, start)
            score = kind.score + CONTEXT_GAIN * any(w in near for w in kind.context) \
                - CONTEXT_LOSS * any(w in near for w in kind.against)
            if kind.base or score >= MIN_SCORE:
                found.append((start, order, {"kind": kind.name, "start": start, "end": end,
                                             "score": min(1.0, max(0.0, round(score, 2))),
                                             "base": kind.base}))
    found.sort(key=lambda x: x[:2])
    return [span for _, _, span in found]


def compiled_kinds(kinds: tuple[Kind, ...] = KINDS) -> list[tuple[Kind, re.Pattern]]:
    return [(kind, re.compile(kind.pattern)) for kind in kinds]


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                   ("end", pa.int32()), ("score", pa.float64()),
                                   ("base", pa.bool_())]))


def find_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The spans of a text column: kind, start, end (code points, exclusive), score, base."""

    @F.arrow_udf(SPANS_TYPE)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = compiled_kinds(kinds)
        for texts in batches:
            yield pa.array([find(text.as_py(), compiled) for text in texts], _ARROW_SPANS)

    return spans(text)


def detect(df: DataFrame, text_col: str = "text", into: str = "pii",
           kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add the spans found in ``text_col``.

    Null and empty texts get an empty list. Rows are never dropped, joined or reordered, so
    repeated rows, null ids and any other columns pass through; ``into`` replaces a column of
    the same name. An empty table gives an empty table.
    """
    return df.withColumn(into, find_spans(F.col(text_col), kinds))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlaps are covered once."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, span: Column) -> Column:
        ahead = span["start"] >= acc["at"]
        mark = F.concat(F.lit("["), span["kind"], F.lit("]"))
        return F.struct(
            F.when(ahead, F.concat(acc["out"], F.substring(
                text, acc["at"] + 1, span["start"] - acc["at"]), mark))
            .otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], span["end"]).alias("at"))

    return F.aggregate(spans, state, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
