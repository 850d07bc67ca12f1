"""PII detection with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Disguised ones are found in a
normalised text that a chain of transducers writes: each rewrites matches and
carries, for every character it writes, the range of source characters that it
stands for. So a span of the normalised text maps back to source characters.

Transducers, in order: homoglyphs (compatibility forms, digits of other
scripts, Cyrillic and Greek look-alikes; invisible characters vanish), spelled
digits (long runs of digit words, and shorter ones beside figures, a sign or a
dot, become digits, ``plus`` before one a sign), and at/dot disguises
(bracketed, spelled, between underscores, or spaced).

Row-wise: no shuffle; a text's work is linear in its length. Texts without any
trigger of a transducer skip the chain.

Defined cases: null and empty texts have no spans; equal rows are searched
separately; an added span that overlaps a plain one of its kind is dropped.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowwise import map_texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Look-alikes of ASCII letters in Cyrillic and Greek.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТУХІЈЅοανρυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTYXIJSoavpuikABEZHIKMNOPTYX"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Characters that the first transducer may rewrite, in ranges.
SUSPECT = re.compile("[" + INVISIBLE + "\u0370-\u03ff\u0400-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2460-\u249b"
                     "\uff01-\uff5e\ufe52\ufe6b\u2024\U0001d400-\U0001d7ff]")
DIGIT_WORDS = {w: str(d) for words in (
    "zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    ) for d, w in enumerate(words.split())}
#: Shortest run of spelled digits that counts by itself.
RUN = 7
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_WORD = f"(?:{_DIGIT}|[0-9])"
SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]+)?{_WORD}(?:[ ,.\n-]{{1,3}}{_WORD}){{{RUN - 1},}}(?!\w)", re.I)
SPELLED_TOKEN = re.compile(rf"plus|{_WORD}", re.I)
#: A run of any length, and what must be beside it if it is short.
PART = re.compile(rf"(?<!\w)(?P<plus>plus[ ,-]+)?{_DIGIT}(?:[ ,.()\t\n-]{{1,3}}{_DIGIT})*(?!\w)", re.I)
PART_TOKEN = re.compile(rf"{_DIGIT}|(?<=\w)\.(?=\w)", re.I)
BEFORE = re.compile(r"(?:[0-9][ ,.()\t\n-]{1,3}|\+[ (]?|\ue001|[ \t]dot[ \t])\Z", re.I)
AFTER = re.compile(r"[ ,.()\t\n-]{1,3}[0-9]|\ue001|[ \t]dot[ \t]", re.I)
SIGNED = re.compile(r"\+[0-9][\x20().0-9-]*\Z")
DOTTED = re.compile(rf"{_DIGIT}(?:[ -]?{_DIGIT}){{0,2}}(?:\.{_DIGIT}(?:[ -]?{_DIGIT}){{0,2}}){{3}}", re.I)
AT_MARK, DOT_MARK = "\ue000", "\ue001"
BRACKET_AT = re.compile(r"[ \t]?[\[({<][ \t]?(?:at|@|arroba)[ \t]?[\])}>][ \t]?", re.I)
BRACKET_DOT = re.compile(r"[ \t]?[\[({<][ \t]?(?:dot|\.|punkt|point|punto)[ \t]?[\])}>][ \t]?", re.I)
#: The at of a disguised address with its domain; its local part is read backwards.
AT_DOMAIN = re.compile(
    rf"(?P<at>@|{AT_MARK}|[ \t]@[ \t]|[ \t](?i:at)[ \t])"
    rf"(?P<domain>[A-Za-z0-9-]++(?:(?:\.|{DOT_MARK}|[ \t]\.[ \t]|[ \t](?i:dot)[ \t])[A-Za-z0-9-]++)+)")
LOCAL_WORD = LOCAL.replace(".", "")
SPELLED_DOT = re.compile(r"[ \t]dot[ \t]")
#: Words before a spelled at that are no mailbox: "met him at noon dot com style".
NO_MAILBOX = frozenset("i me you he him she her it we us they them this that these those here there who what".split())
#: Runs of address characters, and one with the marks spelled between underscores.
JOINED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9_.%+-]++(?!\w)")
UNDERSCORED = re.compile(r"([A-Za-z0-9.%+-]+(?:_[A-Za-z0-9.%+-]+)*?)_at_([A-Za-z0-9-]+(?:_dot_[A-Za-z0-9-]+)+)", re.I)
UNDERSCORED_DOT = re.compile("_dot_", re.I)
#: An IP address written with a blank between all its characters.
SPACED_IP = re.compile(r"(?<![\w.])(?<![0-9.] )[0-9](?: [0-9]){0,2}(?: \. [0-9](?: [0-9]){0,2}){3}(?![\w.]| [0-9]| \. [0-9])")
DOTS = re.compile(rf"{DOT_MARK}|[ \t]\.[ \t]|[ \t]dot[ \t]", re.I)
NUMBER_DOTS = re.compile(rf"(?<=[0-9])(?:{DOT_MARK}|[ \t]dot[ \t])(?=[0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, each found from its @: the local part is the run of
    its characters before, back to the match before."""
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        local = text[least:at]
        start = least + len(local.rstrip(LOCAL))
        least = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            least = m.end()
        at = text.find("@", least)
    return out


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of undisguised identifiers, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


class Tape:
    """A text with the source range [start, end) of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write) -> None:
        """Replace each match by write(match); None leaves it."""
        self.replace((*m.span(), write(m)) for m in pattern.finditer(self.text))

    def replace(self, spans) -> None:
        """Put new text in place of each (start, end, new text), by start; None leaves it."""
        text, start, end, at = [], [], [], 0
        for a, b, new in spans:
            if new is None:
                continue
            text += self.text[at:a], new
            start += self.start[at:a]
            end += self.end[at:a]
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            at = b
        if at:
            text.append(self.text[at:])
            self.text, self.start, self.end = "".join(text), start + self.start[at:], end + self.end[at:]


def letter(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain_form = unicodedata.normalize("NFKC", c)
    return plain_form if plain_form.isascii() else c


def part(m: re.Match) -> str | None:
    """The digits of a run beside figures, a sign or a dot; dots within it stay."""
    a, b = m.span()
    if not (m["plus"] or DOTTED.fullmatch(m[0]) or BEFORE.search(m.string[max(0, a - 8):a]) or AFTER.match(m.string, b)):
        return None
    rest = m[0][len(m["plus"] or ""):]
    return "+" * bool(m["plus"]) + "".join(DIGIT_WORDS.get(w.lower(), w) for w in PART_TOKEN.findall(rest))


def spelled(m: re.Match) -> str | None:
    if DOTTED.fullmatch(m[0]):
        return None  # an address, written by part()
    words = [w.lower() for w in SPELLED_TOKEN.findall(m[0])]
    if sum(len(w) > 1 for w in words) * 2 < len(words):
        return None  # mostly figures: a table, not a spelled number
    digits = "".join("" if w == "plus" else DIGIT_WORDS.get(w, w) for w in words)
    # a spelled number of a telephone's length counts as one without a sign too
    sign = words[0] == "plus" or (10 <= len(digits) <= 15 and not (len(digits) >= 14 and luhn(digits))
                                  and not SIGNED.search(m.string[max(0, m.start() - 20):m.start()]))
    return "+" * sign + digits


def local_start(text: str, least: int, at: int) -> int:
    """Where the local part that ends at ``at`` begins, not before ``least``:
    words joined by dots, marks or spelled dots; ``at`` itself if there is none."""
    found = end = at
    while True:
        head = text[least:end] if end - least <= 64 else text[end - 64:end]
        while len(head) < end - least and not head.rstrip(LOCAL_WORD):
            head = text[max(least, end - 2 * len(head)):end]  # a long word
        begin = end - len(head) + len(head.rstrip(LOCAL_WORD))
        if begin == end:
            return found
        if begin == least or text[begin - 1] not in LOCAL:
            found = begin
        if begin > least and text[begin - 1] in f".{DOT_MARK}":
            end = begin - 1
        elif begin - 5 >= least and SPELLED_DOT.fullmatch(text, begin - 5, begin):
            end = begin - 5
        else:
            return found


def addresses(text: str):
    """(start, end, what an address reads as) where something in it is
    disguised, each found from its at; a spelled at alone isn't enough."""
    least = place = 0
    while m := AT_DOMAIN.search(text, place):
        at, domain = m["at"], m["domain"]
        start = local_start(text, least, m.start())
        if start == m.start():
            place = m.start() + 1
            continue
        least = place = m.end()
        hidden, spelled_at = bool(DOTS.search(domain)), at.strip().lower() == "at"
        if not hidden and (at == "@" or spelled_at or at.strip() == "@" and len(at) > 1 and "." not in domain):
            continue
        local = DOTS.sub(".", text[start:m.start()])
        if spelled_at and local.lower() in NO_MAILBOX:
            continue
        yield start, m.end(), local + "@" + DOTS.sub(".", domain)


def underscored(m: re.Match) -> str | None:
    """An address whose at and dots are spelled between underscores."""
    if "_at_" not in m[0].lower() or not (whole := UNDERSCORED.fullmatch(m[0])):
        return None
    return "@".join(UNDERSCORED_DOT.sub(".", x) for x in whole.groups())


def normalised(text: str) -> Tape | None:
    """The rewritten text, or None if nothing in it can be a disguise."""
    low = text.lower()
    strange = bool(SUSPECT.search(text))
    hidden = "dot" in low or any(c in text for c in "[({<@") and bool(BRACKET_AT.search(text) or BRACKET_DOT.search(text) or " @ " in text)
    numbers = bool(SPELLED.search(text))
    parts = strange or any(part(m) for m in PART.finditer(low))
    joined = "_at_" in low and "_dot_" in low
    spaced = " . " in text and bool(SPACED_IP.search(text))
    if not (strange or hidden or numbers or parts or spaced):
        return None
    tape = Tape(text)
    if strange:
        tape.rewrite(SUSPECT, lambda m: letter(m[0]))
    if joined:
        tape.rewrite(JOINED, underscored)
    if spaced:
        tape.rewrite(SPACED_IP, lambda m: m[0].replace(" ", ""))
    if numbers or strange:
        tape.rewrite(SPELLED, spelled)
    if hidden or strange:
        tape.rewrite(BRACKET_AT, lambda m: AT_MARK)
        tape.rewrite(BRACKET_DOT, lambda m: DOT_MARK)
    if hidden or parts:
        tape.rewrite(PART, part)
    if hidden or strange:
        tape.rewrite(NUMBER_DOTS, lambda m: ".")
        tape.replace(addresses(tape.text))
    return tape if tape.text != text else None


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), by start, then kind as listed."""
    if not text:
        return [], []
    base = plain(text)
    tape = normalised(text)
    if tape is None:
        return base, base
    taken = {k: ([s for kind, s, _ in base if kind == k], [e for kind, _, e in base if kind == k]) for k in KINDS}
    added = []
    for kind, a, b in plain(tape.text):
        s, e = tape.start[a], tape.end[b - 1]
        starts, ends = taken[kind]  # apart from each other, so both rise
        at = bisect_right(ends, s)
        if at == len(ends) or starts[at] >= e:
            added.append((kind, s, e))
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans go as one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += text[at:s], f"[{kind.upper()}]"
        at = max(at, e)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, *, redact: bool = False, id_col: str = "doc_id", text_col: str = "text",
         carry: str | None = None) -> DataFrame:
    """One row per document: base and spans (arrays of kind, start, end in code
    points), and with ``redact`` the text without them (with ``carry``, in the
    carried text's place)."""
    def make():
        def arrow(rows):
            return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in r] for r in rows], _ARROW)

        def fn(column):
            texts = column.to_pylist()
            found = [find(t) for t in texts]
            out = [arrow([b for b, _ in found]), arrow([a for _, a in found])]
            if redact:
                out.append(pa.array([redacted(t, a) for t, (_, a) in zip(texts, found)], pa.string()))
            return out
        return fn

    return map_texts(docs, make, [("base", SPAN), ("spans", SPAN), *([("redacted", "string")] if redact else [])],
                     id_col=id_col, text_col=text_col, carry=carry, new_text="redacted" if redact and carry else None)


def report(docs: DataFrame, **options) -> DataFrame:
    d = scan(docs, **options)

    def joined(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
