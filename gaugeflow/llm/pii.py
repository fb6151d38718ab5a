"""Personal data: overlapping candidate spans, boosted trees over format and context, calibrated thresholds choose what is redacted."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, lowest_threshold
from .store import bound_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL_CLASS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CARD_HINT = re.compile(r"[0-9](?:[ -]?[0-9]){11}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Generators of the method, wide on purpose: most of what they find is no personal data.
GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>|＠) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]+)+"), re.compile(r"[(\[{<]at[)\]}>]|＠").search),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} (?:at|AT|bei|arobase|arroba) [A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+| (?:dot|DOT|punkt|point|punto) [A-Za-z0-9-]+)+"), re.compile(r" (?:at|AT|bei|arobase|arroba) [A-Za-z0-9-]+(?:\.[A-Za-z0-9-]| (?:dot|DOT|punkt|point|punto) )").search),
    ("ip", re.compile(r"(?<![\w:.])(?=:{0,2}[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![\w:])"), re.compile(r":[0-9A-Fa-f]{0,4}:").search),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{3,6}){2,4}(?![0-9])"), re.compile(r"[0-9]{4}[._/][0-9]{3}").search),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|0{1,2}[0-9]{1,4}|[0-9]{3})[ .\-/](?:[0-9]{2,4}[ .\-/]){0,3}[0-9]{3,8}(?![0-9])"), re.compile(r"[0-9]\)?[ .\-/][0-9]{2}").search),
)

#: Words before or after a span that speak for a kind, and words that speak for other numbers, in English, German, French and Spanish.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write", "reply", "kontakt", "schreib", "courriel", "écri", "correo", "escrib"),
    "ip": ("ip", "host", "server", "address", "addr", "adresse", "serveur", "servidor", "direcci", "node", "gateway"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "pago"),
    "phone": ("phone", "tel", "tél", "call", "mobile", "cell", "fax", "contact", "ring", "anruf", "handy", "appel", "llam", "móvil"),
}
AGAINST = ("order", "invoice", "version", "isbn", "serial", "date", "ref", "page", "chapter", "score", "ratio", "build", "part", "lot", "time", "room", "bestell", "rechnung", "seite", "kapitel", "uhr", "command", "factur", "chapitre", "heure", "pedido", "página", "capítulo", "hora")


_LETTERS = re.compile(r"[^\W\d_]+")
_AT_WORD, _DOT_WORD = re.compile(r" (?:at|AT|bei|arobase|arroba) "), re.compile(r" (?:dot|DOT|punkt|point|punto) ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @ in linear time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CLASS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed formats: leftmost, non-overlapping within a kind; matches that fail their check are dropped and not tried again."""
    found = []
    found += _emails(text)
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    if _CARD_HINT.search(text):
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def candidates(text: str) -> list[tuple[int, int, str]]:
    """What the wide generators find; spans of different kinds may overlap."""
    return [(m.start(), m.end(), kind) for kind, pattern, hint in GENERATORS if hint(text) for m in pattern.finditer(text)]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and its context within 40 characters."""
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 40].lower()
    digits, groups = _digits(span), re.findall("[0-9]+", span)
    near = _LETTERS.findall(before)[-4:] + _LETTERS.findall(after)[:3]
    edge = text[max(0, start - 1) : start] + text[end : end + 1]
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), span.count("."), span.count("-"), span.count(" "), span.count("("), span.count(":"), span.count("/"),
        sum(c.isalpha() for c in span), sum(c.isupper() for c in span), len(set(span)), float(len(digits) >= 12 and luhn(digits)), float(span[:1] == "0"), float(bool(re.search("[0-9A-Za-z$€£%#]", edge))),
        sum(any(w.startswith(x) for x in CONTEXT[kind]) for w in near), sum(any(w.startswith(x) for x in AGAINST) for w in near), float(before.rstrip().endswith(":")), len(set(span.lower()) & set("abcdef")), float("::" in span), float(bool(_AT_WORD.search(span))), float(bool(_DOT_WORD.search(span))), len(re.findall("[A-Za-z]+$", span)) and len(re.findall("[A-Za-z]+$", span)[0]),
    ]


def written_otherwise(kind: str, good: bool, rnd: random.Random) -> str:
    """A span of a kind in a format that the fixed patterns miss, or something of like shape that is no personal data."""
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    x = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8)))
    if kind == "email":
        name, top = rnd.choice((word(), f"{word()}.{word()}", word() + d(2))), rnd.choice(("com", "org", "net", "de", "fr", "es", "edu"))
        if rnd.random() < 0.4:
            at, dot = rnd.choice((("at", "dot"), ("AT", "DOT"), ("at", "dot"), ("bei", "punkt"), ("arobase", "point"), ("arroba", "punto")))
            return f"{name} {at} {word()}{rnd.choice((f' {dot} ', '.'))}{top}" if good else f"{word()} {at} {word()}.{rnd.choice((word().capitalize(), d(2)))}"
        at, dot = rnd.choice(("(at)", "[at]", "{at}", "<at>", "＠")), rnd.choice((".", " (dot) ", "[dot]", "{dot}"))
        return f"{name}{rnd.choice(('', ' '))}{at}{rnd.choice(('', ' '))}{word()}{dot}{top if good else d(2)}"
    if kind == "ip":
        if not good:
            return rnd.choice((f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}:{d(2)}", ":".join(x(2) for _ in range(6)), f"{word()[:2]}::{word()[:3]}" if rnd.random() < 0.5 else f"{d(2)}:{d(2)}:{d(2)}", "::"+rnd.choice("abcdef")))
        groups = [x(rnd.randint(1, 4)) for _ in range(rnd.randint(1, 6))]
        cut = rnd.randint(0, len(groups))
        return rnd.choice((":".join(x(rnd.randint(3, 4)) for _ in range(8)), f"fe80::{x(rnd.randint(1, 4))}", "::1", f"2001:{x(4)}::{x(4)}", f"2001:db8:{x(4)}::", f"{':'.join(groups[:cut])}::{':'.join(groups[cut:])}" if len(groups) > 1 else f"fd{x(2)}::{x(4)}"))
    if kind == "card":
        body = d(15)
        c, sep = next(body + c for c in "0123456789" if luhn(body + c) == good), rnd.choice("._/")
        return sep.join((c[:4], c[4:8], c[8:12], c[12:]))
    sep = rnd.choice(" .-/")
    if good:
        return rnd.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"0{d(2)}{sep}{d(7)}", f"0{d(3)} {d(3)} {d(4)}"))
    return rnd.choice((f"{d(3)}{sep}{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(8)}", f"0{d(1)}/{d(2)}/{d(4)}", f"0{d(2)}-{d(2)}-{d(5)}"))


def example_spans(n: int = 3000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """Labelled candidates (text, start, end, kind, label), made by a seeded generator of formats and contexts: half personal data, most of them after a word that tells; half other numbers and codes of like shape."""
    rnd, out = random.Random(seed), []
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8)))
    while len(out) < n:
        kind, label = rnd.choice(KINDS), rnd.random() < 0.5
        span = written_otherwise(kind, label, rnd)
        told = rnd.random() < (0.85 if label else 0.03)
        hint = rnd.choice(CONTEXT[kind]) if told else rnd.choice(AGAINST) if not label and rnd.random() < 0.7 else word()
        left = f"{word()} {word()} {hint}{rnd.choice((' ', ': ', ' is '))}"
        text = f"{left}{span} {word()} {word()}."
        out.append((text, len(left), len(left) + len(span), kind, int(label)))
    return out


def real_examples(text: str, rnd: random.Random) -> list[tuple[str, int, int, str, int]]:
    """Labelled candidates in the contexts of a text: each base span, and each match of the cards' and phones' patterns that fails its check, written otherwise where it stands; and what the generators find, which counts as no personal data."""
    base = base_spans(text)
    out, spans = [], {(a, b) for a, b, _ in base}
    failed = [(m.start(), m.end(), kind) for kind, pattern in (("card", _CARD), ("phone", _PHONE)) for m in pattern.finditer(text) if len(_digits(m[0])) >= 9 and (m.start(), m.end()) not in spans]
    for a, b, kind, label in [(*s, 1) for s in base] + [(*s, 0) for s in failed]:
        left, right = text[max(0, a - 60) : a], text[b : b + 60]
        span = written_otherwise(kind, bool(label), rnd)
        out.append((left + span + right, len(left), len(left) + len(span), kind, label))
    taken = Stretches(base)
    for a, b, kind in candidates(text):
        if not taken.meets(a, b):
            start = max(0, a - 60)
            out.append((text[start : b + 60], a - start, b - start, kind, 0))
    return out


def document_examples(docs: DataFrame, max_docs: int = 4000, max_examples: int = 6000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """``real_examples`` of about ``max_docs`` documents, drawn by hash, and at most ``max_examples`` of them, those with the smallest hashes: all that comes to the driver."""
    bound_batches(docs.sparkSession)
    n = docs.count()
    text = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"))
    drawn = text.where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, max_docs / max(n, 1)) * (1 << 30)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, k, *e) for t, h in zip(batch["text"], batch["h"]) for k, e in enumerate(real_examples(t, random.Random(int(h) ^ seed)))]
            yield pd.DataFrame(rows, columns=["h", "k", "text", "start", "stop", "kind", "label"])

    rows = drawn.mapInPandas(read, "h long, k int, text string, start int, stop int, kind string, label int").distinct()
    kept = rows.orderBy(F.xxhash64("h", "k"), "h", "k").limit(max_examples).collect()
    return [(r.text, r.start, r.stop, r.kind, r.label) for r in kept]


class Stretches:
    """Stretches of a text in order, overlapping ones as one: a stretch is looked up by halving."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_right(self.starts, a)
        return (at > 0 and self.ends[at - 1] > a) or (at < len(self.starts) and self.starts[at] < b)

    def add(self, a: int, b: int) -> None:
        """One that meets none."""
        at = bisect_right(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


@dataclass
class PiiModel:
    """Trees and, for each kind, the calibrated score from which a candidate is taken."""

    trees: BoostedTrees
    thresholds: dict[str, float]

    @classmethod
    def fit(cls, examples: list[tuple[str, int, int, str, int]], precision: float = 0.99, max_examples: int = 20_000) -> PiiModel:
        """At most ``max_examples`` labelled spans; every third is kept from the trees, to calibrate scores and set thresholds."""
        examples = examples[:max_examples]
        x = np.array([features(*e[:4]) for e in examples], float)
        y, held = np.array([e[4] for e in examples]), np.arange(len(examples)) % 3 == 0
        trees = BoostedTrees().fit(x, y, held)
        p, kind = trees.predict(x), np.array([e[3] for e in examples])
        return cls(trees, {k: max(0.5, lowest_threshold(p[own], y[own], precision)) if (own := held & (kind == k)).any() else 1.01 for k in KINDS})

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and the added ones: candidates at or above their threshold, best first, that overlap nothing chosen before."""
        base = base_spans(text)
        added: list[tuple[int, int, str]] = []
        chosen = Stretches(base)
        if found := [c for c in candidates(text) if not chosen.meets(c[0], c[1])]:
            p = self.trees.predict(np.array([features(text, *c) for c in found], float))
            for score, (a, b, kind) in sorted(zip(-p, found)):
                if -score >= self.thresholds[kind] and not chosen.meets(a, b):
                    added.append((a, b, kind))
                    chosen.add(a, b)
        return base, added

    def held_out(self, examples: list[tuple[str, int, int, str, int]]) -> dict[str, tuple[float, float, int]]:
        """Recall, precision and number of positives for each kind over examples that the model wasn't fitted on."""
        p = self.trees.predict(np.array([features(*e[:4]) for e in examples], float))
        taken = np.array([x >= self.thresholds[e[3]] for x, e in zip(p, examples)])
        y, kind, out = np.array([e[4] for e in examples], bool), np.array([e[3] for e in examples]), {}
        for k in KINDS:
            own = kind == k
            hits = int((taken & y & own).sum())
            out[k] = (hits / max(1, int((y & own).sum())), hits / max(1, int((taken & own).sum())), int((y & own).sum()))
        return out


@lru_cache(maxsize=1)
def default_model() -> PiiModel:
    """A model of made-up examples alone, for texts of which no sample is at hand."""
    return PiiModel.fit(example_spans())


def fit_on(docs: DataFrame, **how) -> PiiModel:
    """A model of made-up examples and, as many again at most, of examples in the contexts of ``docs``."""
    return PiiModel.fit(mixed_examples(document_examples(docs, **how)))


def mixed_examples(real: list[tuple[str, int, int, str, int]], seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    examples = example_spans() + real
    random.Random(seed).shuffle(examples)
    return examples


def joined(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, kinds.index(k), b, k) for a, b, k in spans))


SPANS = "doc_id long, base string, spans string, n_added long"


def find_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """doc_id, base (spans of the fixed formats), spans (all spans; kind:start:end, code points, end exclusive), n_added.

    One row for each row of ``docs``, repeated rows included; null or empty texts have no spans; an empty table gives no rows. Whole
    texts are searched where they lie: nothing is shuffled, and other columns aren't read.
    """
    bound_batches(docs.sparkSession)
    model = model or default_model()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [model.spans(t) for t in batch["text"].fillna("")]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "base": [joined(b, KINDS) for b, _ in both], "spans": [joined(b + a, KINDS) for b, a in both], "n_added": [len(a) for _, a in both]})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInPandas(search, SPANS)


def redact(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; overlapping spans are replaced as one, named after the first. Null stays null."""
    bound_batches(docs.sparkSession)
    model = model or default_model()

    def hide(text: str | None) -> str | None:
        if text is None:
            return None
        base, added = model.spans(text)
        out, at = [], 0
        for a, b, kind in sorted(base + added):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([hide(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(replace, docs.schema)
