"""Personal identifiers, found through disguises and reported at their source characters.

A text passes three transducers: look-alike letters and digits of other scripts become ASCII and
invisible characters vanish; runs of spelled digits (English, German, French, Spanish) become digits;
disguises of "@" and "." in addresses become those signs. Each transducer keeps, for every character it
emits, the span of source characters it stands for. Identifiers are detected in the result and their spans mapped
back. A text that no transducer changes is searched as it is. One pass of a linear-time expression over each Arrow batch tells the texts
that may hold anything; only these become Python strings.

Kinds: secret, email, iban, ip (of version 4 or 6), card (passes the Luhn check), account (13 to 19 digits that don't), ssn, phone.
Where two overlap, the kind named first holds.

Defined cases: a null text stays null and an empty one empty, with nothing found; a null id is reported as null;
repeated rows are reported each; an empty table gives no rows; whole texts are searched; columns besides the named are
ignored (or, in masking, kept).
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.llm.frames import cols

# transducers

_CYRILLIC = "асԁеԍһіјкӏморԛгѕтхуАВСЕНІЈКМОРЅТХУЗ"
_CYR_TO = "acdeghijklmopqrstxyABCEHIJKMOPSTXY3"
_GREEK, _GREEK_TO = "αειοκνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeiokvptuxABEZHIKMNOPTYX"
_ALIKE = {ord(a): b for a, b in zip(_CYRILLIC, _CYR_TO)} | {ord(a): b for a, b in zip(_GREEK, _GREEK_TO)}
_ALIKE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_ALIKE |= {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_ALIKE |= {base + i: chr(97 + i) for base in (0x1D41A, 0x1D44E, 0x1D482, 0x1D5BA, 0x1D5EE, 0x1D622, 0x1D68A) for i in range(26) if base + i != 0x1D455}
_ALIKE |= {base + i: chr(65 + i) for base in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D670) for i in range(26)}
_ALIKE |= {0x2460 + i: str(i + 1) for i in range(9)} | {0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x00A0: " ", 0x2007: " ", 0x202F: " ", 0x3002: ".", 0x2024: "."}
_GONE = "​‌‍⁠﻿­‎‏"
_STRANGE = re.compile("[" + "".join(map(re.escape, map(chr, _ALIKE))) + _GONE + "]")

_DIGITS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_WORD_DIGIT = {w: d for d, ws in _DIGITS.items() for w in ws.split()}
_W = "(?:" + "|".join(sorted(_WORD_DIGIT, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_W}|\d)(?:[ \t\n,.-]{{0,3}}(?:dash[ ,]+|(?<=[\W\d]))(?:{_W}(?!\w)|\d)){{2,}}(?!\w)")
_NEXT = r"[ \t\n,.-]{0,3}(?:dash[ ,]+|(?<=[\W\d]))"
#: Any run of _SPELLED with a word has a word beside a word or a figure.
_SPELLED_HINT = re.compile(rf"(?i)(?<![^\W\d]){_W}{_NEXT}(?:{_W}(?!\w)|\d)|\d{_NEXT}{_W}(?!\w)")
_ONE = re.compile(rf"(?i)(?<!\w){_W}(?!\w)|[ \t\n]*(?<!\w)dash(?!\w)[ \t\n]*|(?<=[^\W\d])\s+|\s+(?=[^\W\d])")

_AT, _DOT = "(?:at|arroba|ät)", "(?:dot|punkt|punto|point)"
_O, _C = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_BRACKET_AT = re.compile(rf"(?i)(?<=\w){_O}(?:{_AT}|@){_C}(?=\w)")
_BRACKET_DOT = re.compile(rf"(?i)(?<=\w){_O}(?:{_DOT}|\.){_C}(?=\w)")
_PLAIN_AT = re.compile(rf"(?i)(?<=\w)\s+(?:{_AT}|@)\s+(?=[\w-]+(?:(?:\.[\w-]+)*\s+{_DOT}\s+[a-z]))")
_SPACED_AT = re.compile(r"(?<=\w)\s+@\s+(?=[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})")
_PLAIN_DOT = re.compile(rf"(?i)@[\w.-]*\w(\s+{_DOT}\s+)(?=[a-z])")
_LOCAL_DOT = re.compile(rf"(?i)\w(\s+{_DOT}\s+)(?=[\w.-]+@)")
_ADDRESS_HINT = re.compile(rf"(?i)[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]|(?<=\w)\s+{_AT}\s+[\w.-]+\s+{_DOT}\s|\s@\s|@[\w.-]+[\s\[({{<]+{_DOT}\b|@[\w.-]+\s*[\[({{<]\s*\.")


class Tape:
    """A text and, for each of its characters, the source span it stands for (None: the same place)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start: np.ndarray | None = None
        self.end: np.ndarray | None = None
        self.spelled = False

    def rewrite(self, edits: list[tuple[int, int, str]]) -> bool:
        """Replaces text[a:b] by s for each (a, b, s), in order and apart."""
        if not edits:
            return False
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        text, start, end, at = [], [], [], 0
        for a, b, s in edits:
            text += [self.text[at:a], s]
            start += [self.start[at:a], np.full(len(s), self.start[a])]
            end += [self.end[at:a], np.full(len(s), self.end[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])
        return True

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))


def _lower(text: str) -> str:
    """Lower case, with the two letters that only (?i) takes for an s and an i."""
    low = text.lower()
    return low if low.isascii() else low.replace("ſ", "s").replace("ı", "i")


def _digits(m: re.Match) -> list[tuple[int, int, str]]:
    run, out = m.group(), []
    if not _SPELLED_HINT.search(run) and not re.search(_W, run, re.I):
        return []
    for x in _ONE.finditer(run):
        w = _lower(x.group().strip())
        a, b = m.start() + x.start(), m.start() + x.end()
        out.append((a, b, "-" if w == "dash" else _WORD_DIGIT.get(w, "")))
    return out


_WORDS = frozenset(_WORD_DIGIT)
#: Spelled digits that are other words, too; one alone beside a whole number is no part of it.
_ARTICLES = frozenset(("un", "uno", "one", "oh"))
_DIGIT = re.compile(r"\d")


def _strange(text: str) -> bool:
    """Whether some character is to be folded. Latin-1 texts, told by a failing codec, need no search."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _STRANGE.search(text) is not None
    return "\xa0" in text or "\xad" in text


def _spelled(low: str, digits: bool) -> bool:
    """Whether digits may be spelled. A run of three without a figure has a word between separators, so it is found among the
    words that they part; the search that is exact runs on the rest only."""
    if not digits and _WORDS.isdisjoint(low.replace("-", " ").replace(",", " ").replace(".", " ").split()):
        return False
    return _SPELLED_HINT.search(low) is not None


def _address(low: str) -> bool:
    """Whether an address may be disguised: all disguises have an @, a bracket, or a word for the dot."""
    if not ("@" in low or "[" in low or "(" in low or "{" in low or "<" in low or "dot" in low or "punkt" in low or "punto" in low or "point" in low):
        return False
    return _ADDRESS_HINT.search(low) is not None


def normalise(text: str, spelled: bool = True) -> Tape:
    """The text after all transducers, or all but that of spelled digits."""
    tape = Tape(text)
    if _strange(text):
        tape.rewrite([(m.start(), m.end(), _ALIKE.get(ord(m.group()), "")) for m in _STRANGE.finditer(text)])
    if spelled and _spelled(_lower(tape.text), _DIGIT.search(tape.text) is not None):
        tape.spelled = tape.rewrite([e for m in _SPELLED.finditer(tape.text) for e in _digits(m)])
    if _address(tape.text.lower()):
        for p, s in ((_BRACKET_AT, "@"), (_BRACKET_DOT, "."), (_PLAIN_AT, "@"), (_SPACED_AT, "@")):
            tape.rewrite([(m.start(), m.end(), s) for m in p.finditer(tape.text)])
        for p in (_PLAIN_DOT, _LOCAL_DOT):
            while tape.rewrite([(*m.span(1), ".") for m in p.finditer(tape.text)]):
                pass
    return tape


# detectors


def luhn(d: str) -> bool:
    s = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d)))
    return s % 10 == 0


def _bare(s: str) -> str:
    return re.sub(r"\D", "", s)


def _iban(m: re.Match) -> bool:
    s = m.group().replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _varied(s: str) -> bool:
    return len(set(_bare(s))) > 1


def _ipv6(m: re.Match) -> bool:
    s = m.group()
    if sum(map(bool, s.split(":"))) < 3 or not any(c.isdigit() for c in s):
        return False
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


_LONG = r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])"
DETECTORS: list[tuple[str, re.Pattern, Callable[[re.Match], bool] | None]] = [
    ("secret", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)?"), None),
    ("secret", re.compile(r"""(?i)\b(?:[a-z]+[_-])?(?:token|api[_-]?key|secret|password|passwd|pwd|access[_-]?key)["']?\s*[:=]\s*["']?[\w+/=.~-]{8,}["']?"""), None),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{16,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+)"), None),
    ("secret", re.compile(r"\b(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,128}\b"), None),
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9_](?:[\w.%+-]{0,62}[\w%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"), None),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"), None),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"), _ipv6),
    ("card", re.compile(_LONG), lambda m: luhn(_bare(m.group())) and _varied(m.group())),
    ("account", re.compile(r"(?<![\w.])\d{13,19}(?!\w)|(?<![\w.])(?<!\d )\d{4}(?:[ -]\d{4}){3}(?![ -]?\d|\w)"), lambda m: _varied(m.group())),
    ("ssn", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"), None),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"), lambda m: 8 <= len(_bare(m.group())) <= 15 and _varied(m.group())),
    ("phone", re.compile(r"(?<![\w+.-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w-])|(?<![\w+.-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w-])"), lambda m: _varied(m.group())),
    ("phone", re.compile(r"(?<![\w+.-])[2-9]\d{2}[2-9]\d{6}(?![\w-])"), lambda m: _varied(m.group())),
]
_SPELLED_NUMBER = re.compile(r"(?<!\w)\+?\d(?:[ -]?\d){6,14}(?!\w)")
#: How the keys of the third detector begin; they need no figure.
_KEYS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "eyJ")
_NAMED = ("-----begin", "token", "password", "passwd", "secret", "pwd", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key")


def _any(text: str) -> bool:
    """Whether anything may be found: all detectors need an @, a figure, a secret's name or a key's beginning."""
    if "@" in text or _DIGIT.search(text) or any(k in text for k in _KEYS):
        return True
    low = _lower(text)
    return any(n in low for n in _NAMED)


#: Matches any text that holds a sign, figure, name or beginning which detectors need, or a character, run of spelled digits or
#: address that transducers would change. Blanks and letters of case are as in Python's expressions, or wider.
SUSPECT = (
    r"(?i)[@0-9]|[^\x00-\x{FF}]|\x{A0}|\x{AD}|-----begin|token|passw|secret|pwd|api[_-]?key|access[_-]?key|AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ"
    + rf"|\b{_W}(?:[ \t\n,.-]{{0,3}}(?:dash[ ,]+)?{_W}){{2}}"
    + r"|[\[({<][\s\x0b\x1c-\x1f\x{85}]*(?:at|arroba|ät)[\s\x0b\x1c-\x1f\x{85}]*[\])}>]"
    + r"|[\s\x0b\x1c-\x1f\x{85}](?:at|arroba|ät)[\s\x0b\x1c-\x1f\x{85}]+\S+[\s\x0b\x1c-\x1f\x{85}]+(?:dot|punkt|punto|point)"
)


def suspects(texts: pa.Array) -> np.ndarray:
    """The rows that may hold an identifier; all others hold none."""
    return np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, SUSPECT), False)))


class Spans:
    """Disjoint (kind, start, end), by start; the first to come holds."""

    def __init__(self, spans: list[tuple[str, int, int]] = ()) -> None:
        self.spans = sorted(spans, key=lambda x: x[1])
        self.starts = [x[1] for x in self.spans]

    def meeting(self, a: int, b: int) -> tuple[int, int]:
        """Which spans, from and to, overlap a to b."""
        i = bisect_left(self.starts, a)
        if i and self.spans[i - 1][2] > a:
            i -= 1
        return i, max(i, bisect_left(self.starts, b))

    def put(self, kind: str, a: int, b: int, i: int, j: int) -> None:
        """In place of spans i to j."""
        self.spans[i:j] = [(kind, a, b)]
        self.starts[i:j] = [a]


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each identifier, at source characters, in order."""
    if not text:
        return []
    tape = normalise(text)
    got = _detected(tape)
    if tape.spelled:  # a number in figures that is followed by a word such as "one" is a number still
        kept = Spans(got)
        for k, a, b in _detected(normalise(text, spelled=False)):
            i, j = kept.meeting(a, b)
            met = kept.spans[i:j]
            if not met or len(met) == 1 and met[0][1] <= a and b <= met[0][2] and _lower((text[met[0][1] : a] + text[b : met[0][2]]).strip(" \t\n,.-")) in _ARTICLES:
                kept.put(k, a, b, i, j)
        got = kept.spans
    return got


def _detected(tape: Tape) -> list[tuple[str, int, int]]:
    t = tape.text
    if not _any(t):
        return []
    taken = Spans()
    for kind, p, ok in DETECTORS:
        for m in p.finditer(t):
            a, b = m.span()
            i, j = taken.meeting(a, b)
            if i == j and (ok is None or ok(m)):
                taken.put(kind, a, b, i, j)
    if tape.start is not None:  # digits that were spelled out are taken for a number to call
        for m in _SPELLED_NUMBER.finditer(t):
            a, b = m.span()
            x, y = tape.source(a, b)
            i, j = taken.meeting(a, b)
            if y - x >= 2 * (b - a) and i == j and _varied(m.group()):
                taken.put("phone", a, b, i, j)
    return [(k, *tape.source(a, b)) for k, a, b in taken.spans]


def mask(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in angle brackets."""
    got = find(text)
    if not got:
        return text
    out, at = [], 0
    for kind, a, b in got:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end): each identifier; text[start:end] holds it, counted in characters from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            got = [(i, *f) for i in suspects(texts) for f in find(texts[i].as_py())]
            if got:
                row, kind, start, end = zip(*got)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(kind), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "kind", "start", "end"])

    own = cols(docs, id=id_col, text=text_col).where("text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")
    return own.mapInArrow(run, "doc_id long, kind string, start long, end long")


@F.arrow_udf(StringType())
def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        which = suspects(texts)
        if not len(which):
            yield texts
            continue
        chosen = np.zeros(len(texts), bool)
        chosen[which] = True
        yield pc.replace_with_mask(texts, pa.array(chosen), pa.array([mask(texts[i].as_py()) for i in which], texts.type))


def without_identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with identifiers masked in the text column."""
    return docs.withColumn(text_col, masked.asNondeterministic()(F.col(f"`{text_col}`")))
