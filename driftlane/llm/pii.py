"""Personal data in texts, also where it is disguised, with exact source offsets.

Identifiers are found in the text as it stands ("base" spans). Then transducers
rewrite disguises: look-alike characters, invisible ones, spelled digits and
worded or bracketed at and dot signs. Each keeps, for every character it writes,
the span of source characters it stands for, so what is found in the rewritten
text maps back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlane.llm import common

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("асеіјорԛѕԝхуһԁӏАВСЕНІЈКМОРЅТХҮαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceijopqswxyhdlABCEHIJKMOPSTXYaeiknoptuxABEZHIKMNOPTYX", strict=True))
# Dashes, dots and at signs, and characters that show nothing.
MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "\xa0": " ", " ": " ", " ": " ", " ": " "}
INVISIBLE = "\xad​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# The digits from zero to nine in four languages.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT = {w: str(i) for line in DIGIT_WORDS for i, w in enumerate(line.split())} | {"oh": "0"}
# Last labels that make words with "at" and "dot" an address; others do so if both signs are worded.
TOP_LABELS = "com org net edu gov mil int info biz io ai dev app me us uk co de fr es it nl eu ch be ru jp cn br ca au in pl se no dk fi pt mx tv example test invalid local"


def _characters() -> dict[str, str]:
    """Characters that stand for an ASCII letter, digit or mark: the tables above,
    and by rule those outside Latin-1 whose compatibility form is one."""
    out = LOOKALIKES | MARKS
    for code in range(0x100, 0x20000):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and form != c and form.isascii() and (form.isalnum() or form in "@.+-_%()"):
            out.setdefault(c, form)
        elif c.isdecimal():
            out.setdefault(c, str(unicodedata.decimal(c)))
    return out


CHARACTERS = _characters()
_LOOK = re.compile("[" + "".join(map(re.escape, sorted(CHARACTERS))) + INVISIBLE + "]")
_HIDDEN = re.compile("[" + INVISIBLE + "]+")
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
# Words for the signs in English, German, Spanish and French.
_AT_WORD = "(?:at|ät|klammeraffe|arroba|arr?obase)"
_DOT_WORD = "(?:dot|punkt|punto|point)"
_ITEM = f"(?:{_WORD}|[0-9]{{1,12}})"
_GAP = r"(?:[ \t,.-]++(?:\r?\n[ \t]*+)?|\r?\n[ \t]*+)"  # a line may end in it
_SPELLED = re.compile(rf"(?<![\w+])(?:plus\s+|\+\s?)?{_ITEM}(?:(?:{_GAP}|\s+{_DOT_WORD}\s+){_ITEM}){{2,}}(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>plus\s+|\+\s?)|(?P<word>{_WORD})(?!\w)|(?P<digits>[0-9]+)|(?P<dot>\s+{_DOT_WORD}\s+)|(?P<gap>{_GAP})", re.I)
# letters among digits that stand for 0 and 1
_MIXED = re.compile(r"(?<![A-Za-z0-9+])\+?[0-9OoIl](?:[ ().-]{0,2}[0-9OoIl]){9,18}(?![A-Za-z0-9])")
_MIXED_HINT = re.compile("[0-9][OoIl]|[OoIl][0-9]")
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_SIGN = re.compile(rf"(?<!\s)\s*(?:{_OPEN}(?P<at>{_AT_WORD}|@){_CLOSE}|{_OPEN}(?P<dot>{_DOT_WORD}|\.){_CLOSE}|&#64;|&commat;|&#46;|&period;)\s*", re.I)
_NAME, _LABEL = r"[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+"
# between the labels of a domain: a full stop isn't one where a sentence begins after it
_STOP = rf"(?:\s+{_DOT_WORD}\s+|\.(?!(?-i:[A-Z][a-z])))"
_AT = rf"(?:\s+{_AT_WORD}\s+|\s*@\s*)"
_WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_NAME}\s+{_DOT_WORD}\s+){{0,3}}{_NAME}{_AT}{_LABEL}(?:{_STOP}{_LABEL})*{_STOP}(?:{TOP_LABELS.replace(' ', '|')})(?![A-Za-z0-9-])", re.I)
# with a worded dot: any last label
_ALL_WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_NAME}\s+{_DOT_WORD}\s+){{0,3}}{_NAME}(?P<at>{_AT})(?P<domain>{_LABEL}(?:{_STOP}{_LABEL})*{_STOP}[A-Za-z]{{2,}})(?![A-Za-z0-9-])", re.I)
# Words that make "at" and "dot" a sentence.
_PROSE = frozenset("a an the this that these those my your his her its our their each every one some any no and or of is der die das den dem ein eine und le la les un une et el los las una y".split())
# a worded at before a plain domain
_WORDED_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<name>{_NAME})(?P<at>\s+at\s+){_LABEL}(?:\.{_LABEL})*\.(?P<last>[A-Za-z]{{2,}})(?![A-Za-z0-9-])", re.I)
_CUE = re.compile(r"\b(?:e-?mail|mail|mailto|contact|address|write|reach|courriel|correo|kontakt)\b", re.I)
_CUE_REACH = 40
# Words before "at" that are no name.
_NO_NAME = frozenset("me us him her them you it i we he she they or and is are be look see find here there only also directly write mail email e-mail contact address reach available now".split())
_SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}\s@\s{_LABEL}(?:\s?\.\s?{_LABEL})*\s?\.\s?(?:{TOP_LABELS.replace(' ', '|')})(?![A-Za-z0-9-])", re.I)
_WORDED_PART = re.compile(rf"(?P<dot>\s+{_DOT_WORD}\s+)|(?P<at>{_AT})", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*(?:[@.]|at\b|ät\b|arr?oba|klammeraffe)")
_SENTENCE = re.compile(r"\.[A-Z][a-z]+$")  # begins without a blank
_POINT = re.compile(r"\spoint\s", re.I)
_BLANKS = re.compile(r"\s+")
_AT_DOMAIN = re.compile(r"\sat\s+[a-z0-9-]+\.[a-z0-9]")
_HINTS = (" @ ", "dot", "punkt", "punto", "arroba", "arobase", "klammeraffe", " ät ", "&#64;", "&#46;", "&commat;", "&period;")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ANY_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @: a name reaches back over all name
    characters, but not into the match before."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _NAME_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            after = m.end()
        else:
            after = max(after, start) if start == at else after
            # a name that leads nowhere isn't looked through again
            after = max(after, at + 1)
        at = text.find("@", max(at + 1, after))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of identifiers in a text, by start and kind. Matches that
    fail their test (parts of an address, number of digits, checksum) are dropped,
    and what they cover isn't searched again."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _ANY_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


@dataclass
class Rewritten:
    """A text with the source span, and a mark of change, of each character."""

    text: str
    starts: list[int]
    ends: list[int]
    changed: bytearray  # 1: rewritten; 2: a spelled digit

    @staticmethod
    def of(text: str) -> Rewritten:
        return Rewritten(text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text)))

    def put(self, edits: list[tuple[int, int, str, int]]) -> Rewritten:
        """Replace rising, disjoint spans (start, end, new text, mark)."""
        if not edits:
            return self
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new, mark in [*edits, (len(self.text), len(self.text), "", 0)]:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            changed += self.changed[at:a]
            if new:
                first, last = self.starts[a], self.ends[b - 1]
                text.append(new)
                starts += [first] * len(new)
                ends += [last] * len(new)
                changed += bytes([mark]) * len(new)
            at = b
        return Rewritten("".join(text), starts, ends, changed)


def plain_characters(r: Rewritten) -> Rewritten:
    """Look-alikes become what they look like; invisible characters go."""
    shown = r.text
    marks = bytearray(r.changed)
    for m in _LOOK.finditer(shown):
        marks[m.start()] = 1
    shown = shown.translate({ord(k): v for k, v in CHARACTERS.items()})
    return Rewritten(shown, r.starts, r.ends, marks).put([(m.start(), m.end(), "", 1) for m in _HIDDEN.finditer(shown)])


def digits_from_words(r: Rewritten) -> Rewritten:
    """Runs of three or more numbers and digit words become digits without gaps, a dot
    word between them a dot, "plus" before them a plus sign. A run needs four parts
    with three digit words, or two digit words and ten digits in all, or three dot
    words between its numbers."""
    edits = []
    for m in _SPELLED.finditer(r.text):
        parts = list(_SPELLED_PART.finditer(r.text, m.start(), m.end()))
        words, numbers = (sum(p[kind] is not None for p in parts) for kind in ("word", "digits"))
        digits = words + sum(len(p["digits"]) for p in parts if p["digits"])
        if not (words >= 3 and words + numbers >= 4 or words == 2 and digits >= 10 or sum(p["dot"] is not None for p in parts) == 3):
            continue
        for p in parts:
            new = _DIGIT[p["word"].lower()] if p["word"] else p["digits"] or ("." if p["dot"] else "+" if p["plus"] else "")
            edits.append((p.start(), p.end(), new, 2))
    return r.put(edits)


def digits_from_letters(r: Rewritten) -> Rewritten:
    """The letters O, I and l inside a number of ten to nineteen places become 0
    and 1, if two thirds of the places are digits."""
    edits = []
    for m in _MIXED.finditer(r.text):
        places = [c for c in m.group() if c.isalnum()]
        if 3 * sum(c.isdigit() for c in places) >= 2 * len(places):
            edits += [(i, i + 1, "0" if r.text[i] in "Oo" else "1", 1) for i in range(m.start(), m.end()) if r.text[i] in "OoIl"]
    return r.put(edits)


def _named(text: str, m: re.Match) -> bool:
    """Whether "name at domain.tld" is an address rather than a sentence."""
    name, last = m["name"].strip("._%+-"), m["last"]
    if not re.search("[A-Za-z]", name) or last[0].isupper() and last[1:].islower():  # a sentence that begins without a blank
        return False
    return re.search(r"[._0-9]", name) is not None or name.lower() not in _NO_NAME and _CUE.search(text, max(0, m.start() - _CUE_REACH), m.start()) is not None


def signs_from_words(r: Rewritten) -> Rewritten:
    """Bracketed signs, entities and, inside what reads like an address with a
    worded dot, the words become @ and dots. A worded at before a plain domain
    does if the name has a dot, digit or underscore inside, or a contact word
    stands shortly before it."""
    edits = [(m.start(), m.end(), "@" if m["at"] or "64" in m.group() or "commat" in m.group() else ".", 1) for m in _SIGN.finditer(r.text)]
    r = r.put(edits)
    edits = []
    for m in _ALL_WORDED.finditer(r.text):
        parts = list(_WORDED_PART.finditer(r.text, m.start(), m.end()))
        # "point" is an ordinary word beside "at"
        if _PROSE & set(re.split(rf"{_STOP}", m["domain"].lower())) or m["at"].strip().lower() in ("at", "ät") and _POINT.search(m.group()):
            continue
        if any(p["dot"] and p.start() > m.end("at") for p in parts):
            edits += [(p.start(), p.end(), "@" if p["at"] else ".", 1) for p in parts if p.group() != "@"]
    r = r.put(edits)
    edits = []
    for m in _WORDED.finditer(r.text):
        parts = list(_WORDED_PART.finditer(r.text, m.start(), m.end()))
        if any(p["dot"] for p in parts) and not _POINT.search(m.group()):  # "at" alone is an ordinary word
            edits += [(p.start(), p.end(), "@" if p["at"] else ".", 1) for p in parts if p.group() != "@"]
    r = r.put(edits)
    edits = [(*m.span("at"), "@", 1) for m in _WORDED_AT.finditer(r.text) if _named(r.text, m)]
    r = r.put(edits)
    edits = [(a, b, "", 1) for m in _SPACED.finditer(r.text) for a, b in (s.span() for s in _BLANKS.finditer(r.text, m.start(), m.end()))]
    return r.put(edits)


def _hints(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether a text may hold look-alikes, worded signs, spelled digits or letters
    among digits: cheap tests that no disguise passes by."""
    look = False
    if not text.isascii():
        try:
            text.encode("latin-1")
            look = "\xa0" in text or "\xad" in text
        except UnicodeEncodeError:
            look = _LOOK.search(text) is not None
    low = text.lower()
    words = any(h in low for h in _HINTS) or "@" in low and "point" in low or _BRACKETED.search(low) is not None or _AT_DOMAIN.search(low) is not None
    # a spelled number has two digits that differ
    spelled = words or any(sum(w in low for w in line.split()) > 1 for line in DIGIT_WORDS)
    return look, words, spelled and _SPELLED.search(text) is not None, _MIXED_HINT.search(text) is not None


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all identifiers in a whole text, in code points.

    A span that the transducers add holds a rewritten character and lies in no
    base span of its kind. Ten to fifteen spelled digits in a row, three of them
    different, are a phone number too, with or without a plus sign. Spelled digits
    that are all the same are no identifier: they are a repeated word.
    """
    text = text or ""
    base = base_spans(text)
    look, words, spelled, mixed = _hints(text)
    if not (look or words or spelled or mixed):
        return [(*s, True) for s in base]
    r = Rewritten.of(text)
    if look:
        r = plain_characters(r)
    if look or spelled:
        r = digits_from_words(r)
    if look or mixed:
        r = digits_from_letters(r)
    if look or words:
        r = signs_from_words(r)
    found = base_spans(r.text)
    for m in re.finditer(r"(?<![0-9+.])[0-9]{10,15}(?!\.?[0-9])", r.text):
        if all(x == 2 for x in r.changed[m.start() : m.end()]) and len(set(m.group())) > 2:
            found.append(("phone", m.start(), m.end()))
    more = set()
    for kind, a, b in found:
        rewritten = any(r.changed[a:b]) or r.ends[b - 1] - r.starts[a] != b - a
        if rewritten and kind == "email" and (m := _SENTENCE.search(r.text, a, b)) and "." in r.text[r.text.index("@", a) : m.start()]:
            b = m.start()
        if rewritten and not (2 in r.changed[a:b] and len(set(_digits(r.text[a:b]))) < 2):
            s = (kind, r.starts[a], r.ends[b - 1])
            if not any(k == kind and x <= s[1] and s[2] <= y for k, x, y in base):
                more.add(s)
    out = [(*s, True) for s in base] + [(*s, False) for s in more]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``, an array of (kind, start, end, base) by start and
    kind, of every whole text; empty for a null or empty text. One row per input
    row, null and repeated ids included. Other columns are not read."""
    schema = T.StructType([common.field(docs, id_col), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                got = [[dict(zip(SPAN.names, s)) for s in spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, _ARROW_SPANS)], schema.names)

    return common.spread(docs.select(id_col, text_col)).mapInArrow(run, schema)


def mask_text(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets; where spans
    overlap, one mark of the first stands for all. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns as they are, ``text_col`` masked. Rows stay as many."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, at):
                cols = list(part.columns)
                cols[at] = pa.array([mask_text(t) for t in cols[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))


def joined(found, base_only: bool):
    """Spans of a column as "kind:start:end" joined by commas."""
    chosen = F.filter(found, lambda s: s["base"]) if base_only else found
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found, kind: str):
    """How many spans of a column are of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
