"""Personal data in texts: fixed base kinds, and more spans chosen by boosted trees.

The base kinds (email, ip, card, phone) follow fixed patterns and checks and always stay. For the
others, high-recall generators propose overlapping candidates; gradient-boosted trees score them by
format and context; a candidate is taken if its calibrated probability reaches a threshold that was
set for precision on candidates that neither the trees nor the calibration saw, best first, without overlaps among the added spans and
never over a base span. The trees learn from generated, labelled text (twice ``TRAINING_TEXTS``
texts from fixed seeds), so that no personal data is needed to train them.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import byte_slices, documents, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "local_phone", "ssn", "iban", "birthdate", "mac", "name", "address")
KINDS = BASE + ADDED
TRAINING_TEXTS = 3000
PRECISION = 0.99
CONTEXT = 32
SLICE_BYTES = 4 << 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Leftmost matches begin where a run of digits begins, so looking back saves retries inside long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start, width = at, 64
        while True:  # the local part is the whole run of its characters before the sign
            part = text[max(past, at - width) : at]
            start = at - len(part) + len(part.rstrip(_LOCAL))
            if start > at - len(part) or at - width <= past:
                break
            width *= 4
        end = start < at and (m := _DOMAIN.match(text, at + 1)) and m.end()
        if end:
            out.append((start, end))
            past = end
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed; offsets in code points, end exclusive."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_CAPITAL = "A-ZÀ-ÖØ-Þ"
# Kinds of roads, titles, and given names that are common in several languages.
_ROADS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square|Terrace"
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sra", "Sr")
GIVEN = frozenset(
    "John James Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Paul Hans Klaus Jürgen Wolfgang "
    "Sabine Petra Ursula Jean Pierre Michel Marie Nathalie Isabelle Luis José Juan Carlos Carmen Ana Elena Laura Lucía Daniel Martin Julia Sophie Emma Lukas Alice Jane Tom Eva Max".split()
)

# A full stop before a space or a capital ends a sentence; a host name goes on.
_SENTENCE = re.compile(r"\.(?: |[A-Z])")
_AT = r"(?:\[at\]|\(at\)|\bat\b) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?[A-Za-z0-9-]{2,63}){1,4}"
GENERATORS = {
    "masked_email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?" + _AT),
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}"),
    "ssn": re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "birthdate": re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"),
    "mac": re.compile(r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}"),
    "name": re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][^\W\d_]{1,30}(?: [A-Z][^\W\d_]{1,30})?"),
    "untitled": re.compile(rf"(?<!\w)[{_CAPITAL}][^\W\d_{_CAPITAL}]{{1,20}}(?: [{_CAPITAL}]\.)? (?:(?:de|da|von|van|der|la|di) ){{0,2}}[{_CAPITAL}][^\W\d_]{{1,20}}(?:-[{_CAPITAL}][^\W\d_]{{1,20}})?"),
    "address": re.compile(
        rf"(?<![\w.-])[0-9]{{1,5}}[a-z]? (?:[{_CAPITAL}][^\W\d_]{{1,20}} ){{1,3}}(?:{_ROADS})\b\.?"
        rf"|(?<!\w)[{_CAPITAL}][^\W\d_]{{1,24}}(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?(?!\w)"
        rf"|(?<![\w.-])[0-9]{{1,4}},? (?:rue|avenue|place|boulevard|chemin) (?:(?:de|du|des|la|le) |d'|l'){{0,2}}[{_CAPITAL}][^\W\d_]{{1,24}}"
        rf"|(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo) (?:(?:de|del|la|los|las) ){{0,2}}[{_CAPITAL}][^\W\d_]{{1,24}},? [0-9]{{1,4}}(?!\w)"
    ),
}
#: Generators that propose a kind of another name.
KIND_OF = {"untitled": "name"}
# What a generator accepts always holds what its kind needs, so that a span does not depend on other spans of its text.
_PAIR = re.compile(rf"[{_CAPITAL}][^\W\d_]+(?: [{_CAPITAL}]\.)? (?:(?:de|da|von|van|der|la|di) ){{0,2}}[{_CAPITAL}]")
NEEDS = {"untitled": _PAIR, "masked_email": re.compile(_AT), "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\b", re.A)}
KEYWORDS = {
    "masked_email": ("mail", "contact", "write", "reach"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "iban": ("iban", "account", "bank", "transfer"),
    "birthdate": ("born", "birth", "dob"),
    "mac": ("mac", "device", "hardware", "ethernet"),
    "name": ("name", "patient", "signed", "contact", "dear", "by ", "author", "regards", "i am", "employee", "customer"),
    "address": ("address", "lives", "live at", "street", "ship", "deliver", "home", "located", "visit"),
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All spans that the generators propose; they may overlap."""
    digit = re.search("[0-9]", text)
    out = []
    for kind, pattern in GENERATORS.items():
        if NEEDS[kind].search(text) if kind in NEEDS else digit:
            out += [(KIND_OF.get(kind, kind), *m.span()) for m in pattern.finditer(text)]
    for kind, start, end in [c for c in out if c[0] == "masked_email"]:  # also up to the end of the sentence
        stop = _SENTENCE.search(text, start, end)
        if stop and GENERATORS[kind].fullmatch(text, start, stop.start()):
            out.append((kind, start, stop.start()))
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _date_ok(s: str) -> bool:
    parts = [int(x) for x in re.split("[-/.]", s)]
    year, a, b = (parts[0], parts[1], parts[2]) if parts[0] > 31 else (parts[2], parts[0], parts[1])
    return 1900 <= year <= 2030 and 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31


class Taken:
    """Places of a text that are taken, as sorted runs that don't touch one another's inside."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def features(text: str, span: tuple[str, int, int], base: Taken) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT]
    digits = _digits(s)
    return [
        *(float(kind == k) for k in ADDED),
        len(s),
        len(digits),
        len(set(digits)),
        sum(c in " ().-/:" for c in s),
        len(set(c for c in s if c in " ().-/:")),
        sum(c.isalpha() for c in s),
        sum(c.isupper() for c in s) / len(s),
        float("[" in s or "(at" in s),
        float(kind == "masked_email" and _SENTENCE.search(s) is not None),
        float(kind == "iban" and _iban_ok(s)),
        float(kind == "birthdate" and _date_ok(s)),
        float(kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
        float(any(w in before for w in KEYWORDS[kind])),
        float(any(w in before for k in KEYWORDS for w in KEYWORDS[k])),
        float(before[-1:].isalnum() or before[-1:] in ("-", ".", "/", ":") and before[-2:-1].isalnum()),
        float(after[:1].isalnum() or after[:1] in ("-", ".", "/", ":") and after[1:2].isalnum()),
        float(base.overlaps(start, end)),
        float(any(c.isdigit() for c in before[-2:])),
        float(any(c.isdigit() for c in after[:2])),
        sum(c.isdigit() for c in before + after),
        float(kind == "name" and s.split(" ")[0] in GIVEN),
        float(kind == "name" and s.split(" ")[0].rstrip(".") in TITLES),
        float(not before.strip() or before.rstrip()[-1:] in ".!?:"),
        float(kind in ("name", "address") and after.lstrip()[:1].isupper()),
    ]


def labelled_texts(n: int = TRAINING_TEXTS, seed: int = 11) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with the added-kind spans that are really personal data in each."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ("an", "the", "re", "on", "st", "er", "ou", "ti", "la", "des", "en", "mi", "sch", "ung")
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    cap = lambda: word().capitalize()
    words = lambda k: " ".join(word() for _ in range(k))
    given = sorted(GIVEN)

    def iban(ok: bool) -> str:
        body = pick(("DE", "FR", "ES", "GB")), num(18)
        check = next(c for c in range(2, 99) if _iban_ok(f"{body[0]}{c:02d}{body[1]}"))
        s = f"{body[0]}{(check if ok else (check + 5) % 97):02d}{body[1]}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def date(first: int, last: int) -> str:
        y, m, d = rng.integers(first, last), rng.integers(1, 13), rng.integers(1, 29)
        return pick((f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}"))

    real = {
        "masked_email": lambda: pick((f"{word()}.{num(2)} [at] {word()}x [dot] com", f"{word()}(at){word()}x(dot)org", f"{word()}{num(2)} at {word()}x dot net")),
        "local_phone": lambda: pick((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}")),
        "ssn": lambda: f"{rng.integers(1, 665):03d}-{rng.integers(1, 99):02d}-{rng.integers(1, 9999):04d}",
        "iban": lambda: iban(True),
        "birthdate": lambda: date(1930, 2012),
        "mac": lambda: pick((":", "-")).join(f"{x:02x}" for x in rng.integers(0, 256, 6)),
        "name": lambda: pick((f"{pick(('Mr', 'Mrs', 'Dr', 'Ms', 'Prof'))}. {cap()} {cap()}", f"{pick(('Mr', 'Mrs', 'Ms'))} {cap()}", f"{pick(given)} {cap()}", f"{pick(given)} {pick('ABCDEFGH')}. {cap()}")),
        "address": lambda: pick((f"{num(2)} {cap()} {pick(_ROADS.split('|'))}", f"1{num(3)} {cap()} {cap()} {pick(_ROADS.split('|'))}", f"{cap()}straße {num(2)}", f"{num(2)} rue de {cap()}", f"calle {cap()} {num(2)}")),
    }
    false = (
        lambda: f"{words(2)} at {word()} {word()} dot {word()}",
        lambda: f"version {num(1)}.{num(2)}.{num(4)}",
        lambda: num(rng.integers(7, 24)),
        lambda: f"{num(3)} {num(2)} {num(4)} {num(3)} {num(2)}",
        lambda: f"order {num(5)}-{num(3)}-{num(2)}-{num(4)}",
        lambda: date(1930, 2030),
        lambda: f"{num(2)}.{num(2)}.{num(2)}.{num(2)}",
        lambda: f"+{num(2)} ({num(3)}) {num(3)}-{num(4)}",
        lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}",
        lambda: iban(False),
        lambda: ":".join(f"{x:02x}" for x in rng.integers(0, 256, 12)),
        lambda: "".join(f"{x:02x}" for x in rng.integers(0, 256, 20)),
        lambda: f"Dr. {word()} the Mr {word()}",
        lambda: f"{num(3)} | {num(4)} | {num(3)}",
        lambda: f"{cap()} {cap()}",
        lambda: f"{word()}. {cap()} {cap()} {word()}",
        lambda: f"{cap()} {cap()} {cap()}",
        lambda: f"{num(2)} {cap()} {word()}",
        lambda: f"{num(2)} {cap()} {cap()}",
        lambda: f"{num(3)}, {num(3)}, {num(4)}",
        lambda: f"{word()}.{num(2)}@mail{num(1)}.example.com",
    )
    for _ in range(n):
        text, spans = words(rng.integers(2, 12)), []
        for _ in range(rng.integers(1, 4)):
            if rng.random() < 0.5:
                kind = pick(ADDED)
                # A date or a bare run of digits is personal only beside a word that says so.
                if kind in ("birthdate", "local_phone") or rng.random() < 0.5:
                    text += f" {pick(KEYWORDS[kind])}{pick((': ', ' ', ' is '))}"
                else:
                    text += " "
                s = real[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += " " + pick(false)()
            text += f"{pick(('', '.', ','))} {words(rng.integers(1, 8))}"
        yield text, spans


def labelled_hosts(n: int = TRAINING_TEXTS, seed: int = 12) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts like ``labelled_texts`` gives, of addresses with a plain host (``name at host.tld``) and of sentences that end after ``at``."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    syllables = ("an", "the", "re", "on", "st", "er", "ou", "ti", "la", "des", "en", "mi", "sch", "ung")
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    for _ in range(n):
        text, spans = words(rng.integers(0, 8)), []
        text += f" {pick(KEYWORDS['masked_email'])}{pick((': ', ' ', ' is '))}" if rng.random() < 0.5 else " "
        if rng.random() < 0.5:
            s = f"{pick((word(), f'{word()}.{word()}', f'{word()}{rng.integers(100)}'))} at {pick(('', 'mail.'))}{word()}x.{pick(('com', 'org', 'net', 'de', 'io', 'info'))}"
            spans.append(("masked_email", len(text), len(text) + len(s)))
            text += s
        else:
            text += f"{pick((word(), word().capitalize()))} at {word()}{pick(('. ', '. ', '.'))}{word().capitalize()}"
        yield text + f"{pick(('', ',', '!'))} {words(rng.integers(1, 8))}", spans


@functools.cache
def model() -> tuple[boosting.Boosted, dict[str, float]]:
    """The trees and each kind's threshold, from generated texts; ``fitted`` takes others."""
    return fitted(itertools.chain(labelled_texts(), labelled_hosts()))


def fitted(labelled: Iterable[tuple[str, list[tuple[str, int, int]]]]) -> tuple[boosting.Boosted, dict[str, float]]:
    """The trees and each kind's threshold, from texts and their spans of the added kinds: four sixths to learn from, one to calibrate, one for the thresholds."""
    rows, labels, held, kinds = [], [], [], []
    for i, (text, spans) in enumerate(labelled):
        base = Taken(base_spans(text))
        for c in candidates(text):
            rows.append(features(text, c, base))
            labels.append(c in spans)
            held.append(i % 6)
            kinds.append(c[0])
    x, y, out, kind = np.array(rows, float), np.array(labels, float), np.array(held), np.array(kinds)
    trees = boosting.fit(x[out > 1], y[out > 1], trees=60, depth=4)
    boosting.calibrate(trees, x[out == 0], y[out == 0])
    of = {k: (out == 1) & (kind == k) for k in ADDED}
    return trees, {k: max(0.5, boosting.threshold(trees.probability(x[o]), y[o], PRECISION)) if o.any() else 1.0 for k, o in of.items()}


def found_spans(rows: list[str], trees: boosting.Boosted, least: dict[str, float]) -> list[tuple[list, list]]:
    """For each text: its base spans, and all spans including the added ones, both in order."""
    base = [base_spans(t) for t in rows]
    proposed = [(i, c) for i, t in enumerate(rows) for c in candidates(t)]
    every, taken = [list(b) for b in base], [Taken(b) for b in base]
    if proposed:
        p = trees.probability(np.array([features(rows[i], c, taken[i]) for i, c in proposed], float))
        for k in np.argsort(-p, kind="stable"):
            i, (kind, start, end) = proposed[k]
            if p[k] >= least[kind] and not taken[i].overlaps(start, end):
                every[i].append((kind, start, end))
                taken[i].add(start, end)
    return [(b, in_order(e)) for b, e in zip(base, every, strict=True)]


_TRIGGER = re.compile(rb"[0-9@]|(?<![0-9A-Za-z_])at(?![0-9A-Za-z_])|[A-Z\xc3][A-Za-z\x80-\xff]+ (?:[A-Z]\. )?(?:(?:de|da|von|van|der|la|di) ){0,2}[A-Z\xc3]")
_TITLES = tuple(t.encode() for t in TITLES)


def _may_hold(text: bytes) -> bool:
    return _TRIGGER.search(text) is not None or any(x in text for x in _TITLES)


def _spans(cells: list[bytes], trees: boosting.Boosted, least: dict[str, float]) -> list[tuple[list, list]]:
    own = [i for i, x in enumerate(cells) if _may_hold(x)]
    found = found_spans([cells[i].decode("utf-8", "replace") for i in own], trees, least)
    out: list[tuple[list, list]] = [([], [])] * len(cells)
    for i, x in zip(own, found, strict=True):
        out[i] = x
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): the spans of every row of ``docs`` as ``kind:start:end`` lists.

    Null and empty texts have none; very long ones are scanned whole, a slice of a batch each. Of candidates that overlap, the likelier is taken, of equally
    likely ones the first proposed. Rows are independent: repeated rows and null ids keep a row each.
    Only doc_id and text are read, so other columns may have any name. An empty table gives an empty result.
    """
    trees, least = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                found = _spans(texts(part.column(1)), trees, least)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(e) for _, e in found], pa.string())], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, base string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, past = [], 0
    for kind, start, end in spans:
        if start >= past:
            out += [text[past:start], f"[{kind.upper()}]"]
        past = max(past, end)
    return "".join(out) + text[past:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` redacted, and ``n_chars``, if it is there, to match; other columns as they are, whatever their names.

    Null texts stay null, empty ones empty; very long ones are scanned whole. Overlapping spans become one, of the first kind. Repeated rows and null ids
    keep a row each. An empty table gives an empty result.
    """
    trees, least = model()
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                column = part.column(at)
                found = _spans(texts(column), trees, least)
                cells = column.to_pylist()
                fresh = [masked(c, e) if e else c for c, (_, e) in zip(cells, found, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(fresh, column.type)
                if size is not None:
                    sizes = [len(f) if e else n for f, n, (_, e) in zip(fresh, part.column(size).to_pylist(), found, strict=True)]
                    columns[size] = pa.array(sizes, part.column(size).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every text of ``documents``; see ``scan`` for nulls, empty and very long texts, ties and repeated rows."""
    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
