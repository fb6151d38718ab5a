"""Periodic runs of words, found by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q and at least 2q words that can't be extended. All texts of a batch stand one after the
other as numbers of words, with a number of its own behind each text, so that no run leaves its text.

- Periods up to ``SMALL`` are read off directly: words that equal those q places on. They are the highly periodic regions that
  synchronising sets leave out.
- Scale t (4, 8, 16, ...) is for periods from 3t - 1 to 6t - 2. A position is synchronising if, of the hashes of the t + 1 substrings of t
  words that start at it or up to t words on, the least is its own or the last; substrings of period t/3 or less don't count. That depends
  on 2t words only, so equal stretches have the same positions, and any t positions in a row hold one unless 3t - 1 words there have a
  period of t/3 or less. So a run of a period q in the range holds a synchronising position i with the same 2t words at i and i + q: pairs of
  equal contexts at such distances propose q. Occurrences of a context that isn't highly periodic lie over t/3 apart, so
  a position meets 18 partners at most.
- Left are runs whose first q words are highly periodic themselves, with a period p. Their halves lie in two p-runs that touch or overlap,
  with the same repeated words: each such pair proposes the periods at which its phases agree.

Every proposal is extended word by word in both directions and counts if it has 2q words and no smaller period. Hashes only propose.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import bound_batches

SMALL = 10  # scale 4, the first, is for periods from 11 on
OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _least_of_next(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by running minima of blocks from either end."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(same[1:] != same[:-1]) + 1
    edge = np.concatenate([[0] if len(same) and same[0] else [], edge, [len(same)] if len(same) and same[-1] else []]).astype(np.int64)
    return edge[::2], edge[1::2]


def _agree(words: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on (a < b)."""
    n, at, step = len(words), 0, 16
    while b + at < n:
        size = min(step, n - b - at)
        differ = words[a + at : a + at + size] != words[b + at : b + at + size]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + size, step * 2
    return at


def _agree_before(words: np.ndarray, a: int, b: int) -> int:
    """How many words before a equal those before b (a < b)."""
    at, step = 0, 16
    while a - at > 0:
        size = min(step, a - at)
        differ = (words[a - at - size : a - at] != words[b - at - size : b - at])[::-1]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + size, step * 2
    return at


class _Runs:
    """Runs found so far, each with 2q words at least: by period, start -> end."""

    def __init__(self, words: np.ndarray):
        self.words, self.by_period = words, defaultdict(dict)

    def propose(self, at: int, q: int) -> None:
        """The run of period q around the equal words ``at`` and ``at + q``, if there is one."""
        start = at - _agree_before(self.words, at, at + q)
        if start in self.by_period.get(q, ()):
            return
        end = at + q + _agree(self.words, at, at + q)
        if end - start >= 2 * q and not self._smaller(start, end, q):
            self.by_period[q][start] = end

    def _smaller(self, start: int, end: int, q: int) -> bool:
        """Whether the stretch has a period that divides q. Another one can't be: two periods of so long a stretch have their divisor as a period."""
        rest, primes, d = q, [], 2
        while d * d <= rest:
            if rest % d == 0:
                primes.append(d)
                while rest % d == 0:
                    rest //= d
            d += 1
        primes += [rest] * (rest > 1)
        return any(np.array_equal(self.words[start : end - q // p], self.words[start + q // p : end]) for p in primes)

    def small(self) -> None:
        for q in range(1, min(SMALL, len(self.words) - 1) + 1):
            starts, ends = _stretches(self.words[:-q] == self.words[q:])
            long = ends - starts >= max(q, 4 - q)
            for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                if not self._smaller(a, b + q, q):
                    self.by_period[q][a] = b + q

    def scale(self, t: int, parts: np.ndarray, twice: np.ndarray) -> None:
        """Runs of periods from 3t - 1 to 6t - 2. parts, twice: hashes of the t and 2t words from each position on."""
        free = parts.copy()
        for p in range(1, t // 3 + 1):
            for a, b in self.by_period.get(p, {}).items():
                free[a : max(a, b - t + 1)] = np.iinfo(np.uint64).max
        n = len(twice)
        least = _least_of_next(free, t + 1)[:n]
        at = np.flatnonzero((least < np.iinfo(np.uint64).max) & ((least == free[:n]) | (least == free[t : t + n])))
        order = np.argsort(twice[at], kind="stable")
        at, context = at[order], twice[at][order]
        keep = np.flatnonzero(context[1:] == context[:-1])
        lag, proposals = 1, []
        while len(keep):
            apart = at[keep + lag] - at[keep]
            near = apart <= 6 * t - 2
            keep, apart = keep[near], apart[near]
            wide = apart >= 3 * t - 1
            proposals.append(np.stack([apart[wide], at[keep[wide]]], axis=1))
            lag += 1
            keep = keep[keep + lag < len(at)]
            keep = keep[context[keep + lag] == context[keep]]
        if proposals:
            last_q, last_end = 0, -1
            for q, i in np.unique(np.concatenate(proposals), axis=0).tolist():
                if q == last_q and i + q < last_end:
                    continue  # inside what the proposal before it has extended to
                self.propose(i, q)
                last_q, last_end = q, i + q + _agree(self.words, i, i + q)
        for p in range(1, t // 3 + 1):
            self._touching(p, 3 * t - 1, 6 * t - 2)

    def _touching(self, p: int, least: int, most: int) -> None:
        """Runs of periods from ``least`` to ``most`` whose halves lie in two runs of period p that touch or overlap."""
        found = sorted(self.by_period.get(p, {}).items())
        for (a, a_end), (b, b_end) in zip(found, found[1:], strict=False):
            if b > a_end or min(a_end - a, b_end - b) < least:
                continue
            root = self.words[b : b + p]
            top = min(most, a_end - a, b_end - b, (b_end - a) // 2)
            for shift in range(p):
                if np.array_equal(self.words[a + shift : a + shift + p], root):
                    break
            else:
                continue
            first = b - a - shift  # words at this distance have the same phase
            for q in range(least + (first - least) % p, top + 1, p):
                self.propose(max(a, b - q), q)

    def all(self) -> list[tuple[int, int, int]]:
        """(start, end, period), ordered."""
        return sorted((a, b, q) for q, runs in self.by_period.items() for a, b in runs.items())


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of 2q words or more, and of 4 at least, in numbers of words where no text is longer than ``longest``."""
    runs = _Runs(words)
    runs.small()
    t = 4
    if longest >= 2 * (3 * t - 1):
        numbers = np.random.default_rng(41).integers(1, 2**63, 4, dtype=np.uint64)
        x = words.astype(np.uint64)
        parts = _mixed(x * numbers[0], (x ^ numbers[1]) * numbers[2])
        for step in (1, 2):
            parts = _mixed(parts[:-step], parts[step:])
        while longest >= 2 * (3 * t - 1):
            twice = _mixed(parts[:-t], parts[t:])
            runs.scale(t, parts, twice)
            parts, t = twice, 2 * t
    return runs.all()


def reworded(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in one text of ten with its end made periodic, as the id's crc32 says. A null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _reports(texts: list[list[bytes]], least_words: int) -> Iterator[tuple]:
    """A row of ``OUT`` a text."""
    numbers = _Numbers()
    at, parts = 0, []
    for words in texts:
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([numbers[len(parts)]]))  # a number no word has: keys of words are bytes
    found = find_runs(np.concatenate(parts), max(map(len, texts))) if texts else []
    k = 0
    for words in texts:
        n, own = len(words), []
        while k < len(found) and found[k][0] < at + n + 1:
            a, b, q = found[k]
            if b - a >= max(least_words, 2 * q):
                own.append((a - at, b - at, q))
            k += 1
        at += n + 1
        kept = np.ones(n, bool)
        for a, b, q in own:
            kept[a + q : b] = False
        lines = sha256("".join(f"{a},{b - a},{q}\n" for a, b, q in own).encode()).hexdigest()
        left = sha256(b" ".join([w for w, stays in zip(words, kept.tolist(), strict=True) if stays] if own else words)).hexdigest()
        if own:
            a, b, q = min(own, key=lambda r: (r[0] - r[1], r[0], r[2]))
            yield len(own), a, b - a, q, 1000 * (b - a) // q, lines, left
        else:
            yield 0, None, None, None, None, lines, left


def periodic_runs(docs: DataFrame, *, least_words: int = 12, reword: bool = False) -> DataFrame:
    """doc_id and, of its text's runs of ``least_words`` words or more (and of two periods): n_runs; start, length, period and
    exponent_milli of the longest (ties: smallest start, then period; null without one); runs_sha256 over all of them, by start, then
    period; collapsed_sha256 over the words that stay when each run keeps its first period only, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``reword`` first makes the end of one text in ten periodic, as ``reworded`` says. A null or empty
    text has no word and no run; rows with equal ids are reported each; other columns are not read; an empty table gives an empty one.
    There is no shuffle: texts are looked at where they are, about half a million words at once, or a longer text alone.
    """
    bound_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group, size = batch.column(0).to_pylist(), [], 0
            texts = batch.column(1)
            for i, doc_id in enumerate(ids):
                words = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                group.append((doc_id, reworded(words, doc_id) if reword else words))
                size += len(words)
                if size > 500_000 or i + 1 == len(ids):
                    out = list(_reports([w for _, w in group], least_words))
                    columns = [pa.array([d for d, _ in group], batch.schema.field(0).type), *(pa.array(c, pa.string() if j > 4 else pa.int64()) for j, c in enumerate(zip(*out, strict=True)))]
                    yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], *(x.split()[0] for x in OUT.split(", "))])
                    group, size = [], 0

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, {OUT}")
