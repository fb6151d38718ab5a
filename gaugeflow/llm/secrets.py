"""Secrets: fixed formats, and random strings that a public vocabulary needs many tokens for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .store import bound_batches
from .tokens import tiktoken_encoding

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of fewer holds no longer one
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PART = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9+])|[A-Za-z0-9+]+")  # a UUID is one part

#: Strings that look random and are known to be none: digests by their lengths in hex, UUIDs and numbers.
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|(?:sha1|sha256|sha384|sha512|md5)[-=][A-Za-z0-9+/=]+)")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed formats: leftmost, non-overlapping within a kind; matches that fail their check are dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def random_spans(string: str, encoding, most: float) -> list[tuple[int, int]]:
    """The string if it takes few characters a token, else those stretches of its parts between / = _ - that do and have 20 characters or more.

    Where the parts alone take more characters a token, it is words that separators cut short. Known digests and numbers are no secrets.
    """
    if KNOWN.fullmatch(string):
        return []
    parts = [(m.start(), m.end(), 0 if KNOWN.fullmatch(m[0]) else len(encoding.encode_ordinary(m[0]))) for m in _PART.finditer(string)]

    def few(a: int, b: int, within: list[tuple[int, int, int]]) -> bool:
        if b - a < 20:
            return False
        telling = [(y - x, n) for x, y, n in within if n]  # without digests and numbers
        return bool(telling) and sum(x for x, _ in telling) <= most * sum(n for _, n in telling) and b - a <= most * len(encoding.encode_ordinary(string[a:b]))

    if few(0, len(string), parts):
        return [(0, len(string))]
    found, run, gap = [], [], []
    for part in [*parts, (0, 5, 0)]:
        if part[1] - part[0] <= most * part[2]:
            run += [*gap, part]
            gap = []
        elif run and part[1] - part[0] < 5:
            gap.append(part)  # too short to tell
        else:
            if run and few(run[0][0], run[-1][1], run):
                found.append((run[0][0], run[-1][1]))
            run, gap = [], []
    return found


def apart(spans: list[tuple[int, int]], others: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Of spans in order of their starts those that overlap none of the others: a merge of two sorted lists."""
    if not spans or not others:
        return spans
    joined: list[list[int]] = []  # the others, overlapping ones as one
    for a, b, _ in sorted(others):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, k = [], 0
    for x, y in spans:
        while k < len(joined) and joined[k][1] <= x:
            k += 1
        if k == len(joined) or joined[k][0] >= y:
            out.append((x, y))
    return out


def find_secrets(docs: DataFrame, vocabulary: str, *, most_characters_a_token: float = 2.0) -> DataFrame:
    """doc_id, base (spans of the fixed formats), spans (all spans; kind:start:end, code points, end exclusive), n_random.

    A run of 20 or more characters of base64's alphabets, or else a stretch of its parts between / = _ -, is a secret of kind ``random`` if
    it takes at least one token of the tiktoken vocabulary for each ``most_characters_a_token`` characters, unless it is a known digest
    or identifier, is made of words that take more, or overlaps a base span. One
    row for each row of ``docs``; null or empty texts have none; nothing is shuffled.
    """
    bound_batches(docs.sparkSession)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .pii import joined

        encoding = tiktoken_encoding(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].array, batch["text"].fillna("")):
                base = base_spans(text)
                runs = ((m.start(), m[0]) for m in _CANDIDATE.finditer(text))
                found = [(at + x, at + y) for at, run in runs for x, y in random_spans(run, encoding, most_characters_a_token)]
                added = [(x, y, "random") for x, y in apart(found, base)]
                rows.append((doc, joined(base, KINDS), joined(base + added, KINDS), len(added)))
            yield pd.DataFrame(rows, columns=["doc_id", "base", "spans", "n_random"]).astype({"doc_id": "Int64"})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInPandas(search, "doc_id long, base string, spans string, n_random long")
