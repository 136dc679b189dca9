"""Personal data in texts, also behind disguises, with spans in the source's code points.

Identifiers are matched on the source as it is. Then transducers rewrite disguises and keep, for
every character they emit, the source span that it stands for; identifiers of the rewritten text
are mapped back through these spans. The first transducer reads characters: look-alikes, invisible
characters, character references, full stops of other scripts. The second reads words and
separators in the states of an address (local part, at, host) and emits @ and . for their words and
bracketed forms once the address is complete. The third reads runs of digits in words and figures.

A mapped span is added if something in it was rewritten and no span of its kind found before holds
it; spans of the plain text stay, also inside wider ones that are added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts a run of digits: from inside a run the same match would end at the same place, so
#: only the leftmost start counts, and runs without a match are passed in one step.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like the Latin ones below them (fixed values).
LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТХУІЈЅаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχ",
        "ABEKMHOPCTXYIJSaeopcyxijsdqwhABEZHIKMNOPTYXaivopux",
        strict=True,
    )
)
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e")
#: Digits as words (fixed values): English, German, French, Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for at and dot, in pairs of a language (fixed values).
PLAIN = (("at", "dot"), ("arroba", "punto"), ("arobase", "point"), ("ät", "punkt"))
AT_WORDS, DOT_WORDS, PLUS_WORDS = tuple(a for a, _ in PLAIN), tuple(d for _, d in PLAIN), ("plus",)
#: Character references by name (fixed values of HTML).
NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "nbsp": " "}
#: Full stops that host names know (fixed values of the standard on international names).
STOPS = "\u3002\uff0e\uff61"
#: Words that stand before "at" in plain prose: "look at example.com" is no address (fixed values).
NOT_NAMES = frozenset(
    "a all am and any are arrive arrived available be been but buy by call check click date day download even find for found free from get go had has have he held her here him his home hosted i in is it join just know live located long look looked looking looks me meet month more most need new news not now of off on once one only or our out over page present price read register released see seen she shop show sign site so sold stay stop store that the their them then there these they this those time to today tomorrow up us via view visit was watch we web website week were what when where which who will with work working works year you your".split()
)
_any = "|".join
REFERENCE = re.compile(rf"&(?:#(?P<dec>[0-9]{{1,7}})|#[xX](?P<hex>[0-9A-Fa-f]{{1,6}})|(?P<name>{_any(NAMED)}));?")
#: Between words of a disguise: up to four spaces, tabs or underscores, and a line break at most.
_gap = r"(?:[\x20\t_]{1,4}(?:\r?\n[\x20\t_]{0,4})?|\r?\n[\x20\t_]{0,4})"
_around = r"[\x20\t\r\n]{0,4}"
_open, _close = _around + r"[\[({<]" + _around, _around + r"[\])}>]" + _around
#: The lexemes of addresses; what is none of them ends an address.
LEXEME = re.compile(
    rf"(?P<bat>{_open}(?:{_any(AT_WORDS)}|@){_close})|(?P<bdot>{_open}(?:{_any(DOT_WORDS)}|\.){_close})"
    rf"|{_gap}(?:(?P<at>{_any(AT_WORDS)})|(?P<dot>{_any(DOT_WORDS)})){_gap}|(?P<name>[A-Za-z0-9-]+)|(?P<local>[%+_])|(?P<stop>\.)|(?P<sign>@)",
    re.I,
)
NUMBER_DOT = re.compile(rf"(?<=[0-9])\x20+(?:{_any(DOT_WORDS)})\x20+(?=[0-9])", re.I)
_word = rf"(?:{_any(sorted(SPELLED, key=len, reverse=True))})"
_number = rf"(?:{_word}|[0-9]+)"
_joint = rf"(?:[\x20\-.,]{{1,2}}|\x20(?:{_any(DOT_WORDS)})\x20)"
#: Three or more digits in words or figures (of which the step asks for one in words), with plus before.
SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{_any(PLUS_WORDS)})\x20|\+)?{_number}(?:{_joint}{_number}){{2,}}(?!\w)", re.I)
SPELLED_PART = re.compile(rf"(?P<word>{_word}|{_any(PLUS_WORDS)})|(?P<dot>\.|{_any(DOT_WORDS)})|[0-9+]+", re.I)
_adjacent = rf"(?:\b{_word}{_joint}{_number}|[0-9]{_joint}{_word}\b)"
#: What a text has that may hold an identifier, and what it has if a transducer may change it. They run
#: natively over a batch; a text may fit and hold nothing, but none that holds something fails to fit.
PLAIN_HINT = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[\x20-]?[0-9]){12}"
WORD_HINT = (
    rf"(?i)&(?:#|{_any(NAMED)})|[\[({{<]\s*(?:{_any(AT_WORDS)}|@|{_any(DOT_WORDS)}|\.)\s*[\])}}>]"
    rf"|[\s_](?:{_any(AT_WORDS)})[\s_]+[a-z0-9-]+\.[a-z0-9]|(?:@|[\s_](?:{_any(AT_WORDS)})[\s_]+)[a-z0-9-]+(?:\.[a-z0-9-]+)*[\s_]+(?:{_any(DOT_WORDS)})[\s_]"
    rf"|[0-9]\x20+(?:{_any(DOT_WORDS)})\x20+[0-9]|{_adjacent}"
)


def folded(text: str) -> str:
    """text in lower case, with both other forms of i as i: patterns that ignore case take them for it."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("\u0131", "i")


def hints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: whether it may hold an identifier as it is, and whether a transducer may change it."""
    fits = lambda pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    return fits(PLAIN_HINT), fits(WORD_HINT) | fits(unusual_hint())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @, back over the local part and on over the host, never over a match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and non-overlapping within a kind; matches that fail their test are dropped, not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.groups()):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


@lru_cache(maxsize=1 << 16)
def look_alike(c: str) -> str | None:
    """What one character is read as: an ASCII character, nothing (invisible), or itself (None)."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in STOPS:
        return "."
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and c not in "ªº²³¹" else None


@lru_cache(maxsize=1)
def unusual() -> re.Pattern:
    """Matches exactly the characters that look_alike changes; none lies beyond U+1FFFF."""
    return re.compile(f"[{''.join(c for c in map(chr, range(0xA0, 0x20000)) if look_alike.__wrapped__(c) is not None)}]")


@lru_cache(maxsize=1)
def unusual_hint() -> str:
    """unusual() as ranges, and the forms of i that patterns which ignore case take for one."""
    codes = [k for k in range(0xA0, 0x20000) if not 0xD800 <= k < 0xE000 and look_alike.__wrapped__(chr(k)) is not None] + [0x130, 0x131]
    codes.sort()
    starts = [k for i, k in enumerate(codes) if not i or codes[i - 1] != k - 1]
    ends = [k for i, k in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != k + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


class Tape:
    """A text being rewritten: each character knows the source span that it came from, and if it was changed."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [start, end) by a string for each edit, in order; its characters stand for the whole span."""
        if not edits:
            return
        parts, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[at:a] + b"\1" * len(new)
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def characters(text: str) -> list[tuple[int, int, str]]:
    """Edits of single characters and of character references to ASCII."""
    edits = [(m.start(), m.end(), look_alike(m[0])) for m in unusual().finditer(text)] if not text.isascii() else []
    for m in REFERENCE.finditer(text) if "&" in text else ():
        code = int(m["dec"]) if m["dec"] else int(m["hex"], 16) if m["hex"] else 0
        new = NAMED[m["name"]] if m["name"] else chr(code) if 32 <= code < 127 or code == 10 else " " if code == 160 else None
        if new:
            edits.append((m.start(), m.end(), new))
    return sorted(edits)


class Address:
    """The lexemes of an address while it is read: local part, at and host, as (start, end, what it is, language, whether it is a disguise).

    States are those of the next lexeme: LOCAL after a piece of a local part, LOCAL_DOT after a dot in
    it, HOST_FIRST after the at, HOST after a label, HOST_DOT after a dot in the host.
    """

    IDLE, LOCAL, LOCAL_DOT, HOST_FIRST, HOST, HOST_DOT = range(6)
    #: (state, class) -> state; any other pair ends the address, and the lexeme is read again from IDLE.
    NEXT = {
        (IDLE, "name"): LOCAL, (IDLE, "local"): LOCAL,
        (LOCAL, "name"): LOCAL, (LOCAL, "local"): LOCAL, (LOCAL, "dot"): LOCAL_DOT, (LOCAL, "at"): HOST_FIRST,
        (LOCAL_DOT, "name"): LOCAL, (LOCAL_DOT, "local"): LOCAL,
        (HOST_FIRST, "name"): HOST,
        (HOST, "dot"): HOST_DOT,
        (HOST_DOT, "name"): HOST,
    }

    def __init__(self, changed: bytes):
        self.changed, self.state, self.parts, self.at = changed, self.IDLE, [], None

    def reset(self) -> None:
        self.state, self.parts, self.at = self.IDLE, [], None

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        """The edits that make the address plain, if it is complete and was disguised; a dot after the host stays outside."""
        if self.at is None:
            return []
        host = self.parts[self.at + 1 :]
        while host and host[-1][2] != "name":
            host.pop()
        dots = [p for p in host if p[2] == "dot"]
        if not dots:
            return []
        start, end, kind, language, _ = self.parts[self.at]
        spoken = {p[3] for p in dots if p[3] is not None}
        by_word = language is not None
        made = kind != "@" or any(self.changed[start:end]) or any(p[4] or any(self.changed[p[0] : p[1]]) for p in dots)
        if not made or len(spoken | ({language} if by_word else set())) > 1:
            return []
        if by_word or spoken:
            last = text[host[-1][0] : host[-1][1]]
            if len(last) < 2 or not last.isalpha() or not last.isascii():
                return []
        local = self.parts[: self.at]
        words = spoken | ({language} if by_word else set()) or {0}
        # words for dot in the local part are those of the address's language; what stands before another one is left out
        for k in range(len(local) - 1, -1, -1):
            if local[k][3] is not None and local[k][3] not in words:
                local = local[k + 1 :]
                break
        if language == 0 and not any(p[4] or any(self.changed[p[0] : p[1]]) for p in dots):
            name = text[local[0][0] : local[-1][1]]
            if name.isalpha() and folded(name) in NOT_NAMES:
                return []
        out = [(a, b, ".") for a, b, k, _, disguised in local if k == "dot" and disguised]
        if kind != "@":
            out.append((start, end, "@"))
        return out + [(a, b, ".") for a, b, _, _, disguised in dots if disguised and a < host[-1][0]]


def addresses(text: str, changed: bytes) -> list[tuple[int, int, str]]:
    """Edits of at and dot, as words or in brackets, in addresses. changed marks characters that a step before made."""
    out: list[tuple[int, int, str]] = []
    now, last = Address(changed), 0
    languages = {w: k for k, pair in enumerate(PLAIN) for w in pair}
    for m in LEXEME.finditer(text):
        kind = m.lastgroup
        if m.start() != last and now.state != now.IDLE:
            out += now.edits(text)
            now.reset()
        last = m.end()
        language = languages.get(folded(m[kind])) if kind in ("at", "dot") else None
        what = {"bat": "at", "sign": "at", "bdot": "dot", "stop": "dot"}.get(kind, kind)
        part = (m.start(), m.end(), "@" if kind == "sign" else what, language, kind in ("bdot", "dot"))
        state = now.NEXT.get((now.state, what))
        if state is None:
            label = now.parts[-1] if now.state == now.HOST and what == "at" else None
            out += now.edits(text)
            now.reset()
            if label:
                # an at after a label: the label may be a local part itself
                now.parts, state = [label], now.HOST_FIRST
            else:
                state = now.NEXT.get((now.IDLE, what))
                if state is None:
                    continue
        if what == "at":
            now.at = len(now.parts)
        now.parts.append(part)
        now.state = state
    return out + now.edits(text)


def number_dots(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(text)]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of digits with a word among them, written as figures without what stands between; dots in words or figures stay."""
    edits = []
    for m in SPELLED_RUN.finditer(text):
        if not re.search(rf"(?<!\w){_word}(?!\w)", m[0], re.I):
            continue
        last = m.start()
        for w in SPELLED_PART.finditer(text, m.start(), m.end()):
            if last < w.start():
                edits.append((last, w.start(), ""))
            if w["dot"]:
                edits.append((w.start(), w.end(), "."))
            elif w["word"]:
                edits.append((w.start(), w.end(), SPELLED.get(folded(w[0]), "+")))
            last = w.end()
    return edits


def rewritten(text: str) -> Tape:
    tape = Tape(text)
    tape.rewrite(characters(tape.text))
    tape.rewrite(addresses(tape.text, tape.changed))
    tape.rewrite(number_dots(tape.text))
    tape.rewrite(spelled_digits(tape.text))
    return tape


def disguised(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of the source that only show after rewriting, by kind; none lies within one of base's kind."""
    tape = rewritten(text)
    if tape.text == text:
        return {}
    out: dict[str, list[tuple[int, int]]] = {}
    for kind, spans in identifiers(tape.text).items():
        for a, b in spans:
            x, y = tape.starts[a], tape.ends[b - 1]
            if (any(tape.changed[a:b]) or y - x != b - a) and not any(p <= x and y <= q for p, q in base.get(kind, ())):
                out.setdefault(kind, []).append((x, y))
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Spans by kind: those of the plain text, and those together with the disguised ones."""
    base = identifiers(text)
    more = disguised(text, base)
    return base, {k: sorted({*base[k], *more.get(k, [])}) for k in KINDS} if more else base


#: What find() gives for a text without hints.
NOTHING = ({k: [] for k in KINDS},) * 2


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        plain, changing = hints(texts)
        rows = [NOTHING] * len(texts)
        for i in np.flatnonzero(plain | changing).tolist():
            rows[i] = find(texts[i].as_py())
        counts = [pa.array([len(base[k]) for base, _ in rows], pa.int64()) for k in KINDS]
        names = [joined(base) for base, _ in rows]
        spans = [name if base is both else joined(both) for name, (base, both) in zip(names, rows)]
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in names]
        added = [sum(map(len, both.values())) - sum(map(len, base.values())) for base, both in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of plain identifiers, the digest of their spans, all spans and the number of disguised ones, for every row.

    A null text counts as empty and an empty text has no spans. Spans are in code points, end exclusive.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def redact(text: str) -> str:
    """text with every identifier replaced by its kind in angle brackets; overlapping spans go as a whole, named by the first (then longest)."""
    _, spans = find(text)
    parts, at, done = [], 0, 0
    for a, b, kind in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda s: (s[0], -s[1])):
        if a >= done:
            parts += [text[at:a], f"<{kind}>"]
        at = done = max(done, b)
    return "".join([*parts, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("text")
        texts = batch.column(at)
        plain, changing = hints(pc.fill_null(texts, ""))
        new = {i: redact(texts[i].as_py()) for i in np.flatnonzero(plain | changing).tolist()}
        if new:
            mask = np.zeros(len(texts), bool)
            mask[list(new)] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type))
        yield batch.set_column(at, batch.schema.field(at), texts)


def redacted(docs: DataFrame) -> DataFrame:
    """docs, same rows and columns, with identifiers in text replaced; a null text stays null."""
    return map_arrow(docs, _redact, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """personal_data() of every document; nulls, empty and repeated texts and empty tables as there."""
    return personal_data(documents(spark, sf_dir))
