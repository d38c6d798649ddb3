"""Personal data, also in disguise, with spans of the source text.

Plain identifiers are found on the text as it is. Then a text with anything that could be a disguise is normalised by
a transducer that writes, next to every character, the stretch of the source it stands for: look-alike letters
and digits become ASCII, invisible characters vanish, spelled digits become digits, and bracketed or spelled at, dot and
plus become signs. What is found in the normalised text and rests on a changed character is mapped back through
these stretches and added, unless it would overlap a plain identifier of the same kind.

Edge cases: a null text counts as empty and has no spans. Offsets are code points, ends exclusive. Spans of different
kinds may overlap; those of one kind never do. Texts of any length are searched whole, in time proportional to
their length. Repeated rows are found alike; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.common import read, text_array

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---- plain identifiers ------------------------------------------------------------------------------

# The published patterns; possessive where giving back could not help, and a number is tried at its start only.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Addresses, found from their @ on: what stands before it up to the last match, and a domain behind it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * d, 10)) if place % 2 else d
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))

# ---- disguises --------------------------------------------------------------------------------------

# Letters of other scripts that look like a Latin one.
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαενοικρυ",
    "ABESIJKMHOPCTXYaesijopcxyhdqwgABEZHIKMNOPTYXaevoikpu",
))
# Digits as words in the languages of the corpus.
DIGIT_WORDS = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
} | {"oh": "0"}
# Endings that let a spelled at stand before a domain name; none is a word of the corpus.
ENDINGS = "com org net edu gov mil info biz io uk eu dev app test example".split()
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_WIDE = "\uff01-\uff5e\u2460-\u2468\u24ea\u2070\u00b2\u00b3\u00b9\u2074-\u2079\u2080-\u2089\U0001d400-\U0001d7ff\u2024\ufe52\ufe6b"

_LIKE = "".join(LOOK_ALIKES)
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_NAME = r"[A-Za-z0-9-]+"
_KNOWN = "|".join(ENDINGS)
# Pieces of both the rules and the hint; RE2 and Python read them alike but for \s, which the hint spells out.
_AT, _DOT, _SPELLED_AT = "(?:at|@|arroba)", r"(?:dot|punkt|point|punto|\.)", "(?:at|arroba)"
_BRACKETED_AT, _BRACKETED_DOT = f"{_OPEN}{_AT}{_CLOSE}", f"{_OPEN}{_DOT}{_CLOSE}"
_SPELLED_DOT = r"\s{1,3}dot\s{1,3}"
_LOOSE = rf"\s{{1,2}}\.\s{{0,2}}(?:{_KNOWN})"
_LOOSE_STOP = rf"\s{{1,2}}\.\s{{0,2}}(?=(?:{_KNOWN})(?![A-Za-z0-9]))"
_STOP = rf"(?:{_SPELLED_DOT}|\s{{0,3}}{_BRACKETED_DOT}\s{{0,3}}|{_LOOSE_STOP})"
_PLUS = r"plus\s{0,3}"
_SPACE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]"
_CHARACTERS = f"[{_LIKE}{_INVISIBLE}{_WIDE}]"

# What a text must have for the transducer to run at all; RE2 scans whole columns with it. Each rule has its piece here
# without what it looks at around it. Spelled digits count from three in one identifier on.
_HINT = (
    rf"{_CHARACTERS}"
    rf"|(?i:{_BRACKETED_AT}|{_BRACKETED_DOT}|{_SPELLED_DOT})"
    rf"|(?i:\s{_SPELLED_AT}\s{{1,3}}(?:[a-z0-9-]+\.)+(?:{_KNOWN}))"
    r"|\s@|@\s"
    rf"|(?i:[a-z0-9-]{_LOOSE})"
    rf"|(?i:{_PLUS}(?:[0-9(]|{_NUMBER}))"
    rf"|(?i:(?:(?:{_NUMBER})[\s,().0-9-]+){{2}}(?:{_NUMBER}))"
).replace(r"[\s,", f"[{_SPACE[1:-1]},").replace(r"\s", _SPACE)

# The rules on characters come first; the others see their output.
_CHARACTER = re.compile(_CHARACTERS)
_RULES = [
    (re.compile(rf"\s{{0,3}}{_BRACKETED_AT}\s{{0,3}}", re.I), "@"),
    (re.compile(rf"\s{{0,3}}{_BRACKETED_DOT}\s{{0,3}}", re.I), "."),
    (re.compile(rf"(?<=[A-Za-z0-9._%+-])\s{{1,3}}{_SPELLED_AT}\s{{1,3}}(?={_NAME}(?:{_STOP}|\.){_NAME})", re.I), "@ at"),
    (re.compile(rf"(?<=[A-Za-z0-9._%+-])\s{{0,3}}@\s{{0,3}}(?={_NAME}(?:{_STOP}|\.){_NAME})"), "@"),
    (re.compile(rf"(?<=[A-Za-z0-9-]){_SPELLED_DOT}(?=[A-Za-z0-9])", re.I), "."),
    (re.compile(rf"(?<=[A-Za-z0-9-]){_LOOSE_STOP}"), "."),
    (re.compile(rf"(?<![^\W_])(?:{_NUMBER})(?![^\W_])", re.I), "digit"),
    (re.compile(rf"(?<![^\W_]){_PLUS}(?=[0-9(])", re.I), "+"),
]
_KNOWN_DOMAIN = re.compile(rf"(?:{_NAME}(?:\.|{_STOP}))+(?:{_KNOWN})(?![A-Za-z0-9-])", re.I)
# Where a stop of the domain is in disguise, any country's ending counts.
_ANY_DOMAIN = re.compile(rf"(?:{_NAME}(?:\.|{_STOP}))+(?:[a-z]{{2}}|{_KNOWN})(?![A-Za-z0-9-])", re.I)


# How a character was changed.
SIGN, DIGIT = 1, 2


class Tape:
    """A text in the course of normalisation, with the source stretch and a mark of change for every character."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1
        self.changed = np.zeros(len(text), dtype=np.int8)

    def rewrite(self, edits: list[tuple[int, int, str]], mark: int = SIGN) -> None:
        """Replace stretches (start, end, new), which are in order and apart; a new character covers its whole stretch."""
        if not edits:
            return
        text, columns, at = [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:start], new]
            columns.append((self.starts[at:start], self.ends[at:start], self.changed[at:start]))
            if new:
                covers = (self.starts[start], self.ends[end - 1], mark)
                columns.append(tuple(np.full(len(new), x) for x in covers))
            at = end
        self.text = "".join(text)
        self.starts, self.ends, self.changed = (np.concatenate(c) for c in zip(*columns))


def _plain_character(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    plain = LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() else c


def _clear_stop(tape: Tape, at: int) -> bool:
    """Whether a domain stands here that has a spelled or bracketed dot."""
    domain = _ANY_DOMAIN.match(tape.text, at)
    if not domain:
        return False
    spelled = re.search(_SPELLED_DOT, domain[0], re.I)
    return bool(spelled) or any(c == "." and tape.changed[at + k] == SIGN for k, c in enumerate(domain[0]))


def normalise(text: str) -> Tape:
    """The text without its disguises."""
    tape = Tape(text)
    tape.rewrite([(*m.span(), new) for m in _CHARACTER.finditer(text) if (new := _plain_character(m[0])) != m[0]])
    for pattern, sign in _RULES:
        edits = []
        for m in pattern.finditer(tape.text):
            start, end = m.span()
            if sign == "digit":
                # Spelled digits in a row are written together: what only parts them goes with the later one.
                new = DIGIT_WORDS[m[0].lower()]
                gap = re.search(r"[\s,]{1,3}\Z|-\Z", tape.text[max(0, start - 3) : start])
                if gap and edits and start - len(gap[0]) == edits[-1][1]:
                    start -= len(gap[0])
                edits.append((start, end, new))
            elif sign == "@ at":
                # The word is a common one: only before a known ending, or a stop in disguise, it makes an address.
                if _KNOWN_DOMAIN.match(tape.text, end) or _clear_stop(tape, end):
                    edits.append((start, end, "@"))
            else:
                edits.append((start, end, sign))
        tape.rewrite(edits, DIGIT if sign == "digit" else SIGN)
    return tape


def find(text: str, hinted: bool = True) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, added spans) of a text by kind, in order; hinted: whether it may have disguises."""
    plain = {kind: [*finder(text)] for kind, finder in FINDERS.items()}
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if hinted:
        tape = normalise(text)
        # Where characters vanished, the stretches of two neighbours don't touch.
        vanished = np.append(tape.starts[1:] != tape.ends[:-1], False)
        for kind, finder in FINDERS.items() if tape.changed.any() or vanished.any() else ():
            for a, b in finder(tape.text):
                marks = tape.changed[a:b]
                # A number word beside a plain number is no disguise of it.
                if (marks == SIGN).any() or (marks == DIGIT).sum() >= 3 or vanished[a : b - 1].any():
                    start, end = int(tape.starts[a]), int(tape.ends[b - 1])
                    if not any(s < end and start < e for s, e in plain[kind]):
                        added[kind].append((start, end))
    return plain, added


def pii():
    """A function of a text column that gives struct<base, spans>: lists of struct<kind, start, end>, kinds as in KINDS.

    base has the plain identifiers, spans all of them; both are ordered by kind, then start.
    """
    listed = "array<struct<kind: string, start: int, end: int>>"

    @F.arrow_udf(f"struct<base: {listed}, spans: {listed}>")
    def spans(text: pa.Array) -> pa.Array:
        texts = text_array(text)
        hints = pc.match_substring_regex(texts, _HINT).to_pylist()
        rows = []
        for value, hinted in zip(texts.to_pylist(), hints):
            plain, added = find(value, hinted)
            base = [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in plain[k]]
            both = [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in sorted(plain[k] + added[k])]
            rows.append({"base": base, "spans": both})
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, pa.struct([("base", span), ("spans", span)]))

    return spans


def masked():
    """A function of a text column that gives the text with every identifier replaced by its kind in brackets."""

    @F.arrow_udf("string")
    def mask(text: pa.Array) -> pa.Array:
        texts = text_array(text)
        hints = pc.match_substring_regex(texts, _HINT).to_pylist()
        out = []
        for value, hinted, known in zip(texts.to_pylist(), hints, text.is_valid().to_pylist()):
            plain, added = find(value, hinted)
            parts, at = [], 0
            for start, end, kind in sorted((a, b, k) for k in KINDS for a, b in plain[k] + added[k]):
                if end > at:  # of overlapping spans the rest that is still there goes too
                    parts += [value[at:max(start, at)], f"[{kind}]"] if start >= at else []
                    at = end
            out.append("".join([*parts, value[at:]]) if known else None)
        return pa.array(out, pa.string())

    return mask


def digested(found: DataFrame) -> DataFrame:
    """doc_id and the struct `pii`, as counts and digests."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("pii.spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[number(kind) for kind in KINDS],
        F.sha2(written(F.col("pii.base")), 256).alias("base_sha256"),
        written(F.col("pii.spans")).alias("spans"),
    )


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    docs = read(spark, sf_dir, "documents")
    return digested(docs.select("doc_id", pii()(F.col("text")).alias("pii")))
