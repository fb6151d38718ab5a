"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import BLANK_CLASS, BLANKS, count_of, let, words_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that the text holds twice or more, the first time included; each word counts once.

    Windows are compared by 64-bit hashes within one text. Hashes are sorted, those equal to a neighbour kept, and each window looked
    up among them by binary search: n log n for a text of n words, however often it repeats itself. Steps of up to 2^29 are more than any
    array that fits a row needs.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))
    zero = F.lit(0).cast("bigint")

    def covered(h: Column, twice: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), lambda p: p < F.size(twice))

        def found(x: Column, steps: Column) -> Column:
            at = F.aggregate(steps, F.lit(0), lambda a, p: F.when((a + p < F.size(twice)) & (F.get(twice, a + p) <= x), a + p).otherwise(a))
            return F.get(twice, at) == x

        def count(steps: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: found(h[i], steps))
            end_and_count = F.aggregate(starts, F.struct(F.lit(0).alias("end"), zero.alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + (i + WINDOW) - F.greatest(i, a["end"])).alias("n")))
            return end_and_count["n"]

        return let(steps, count)

    def with_sorted(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))
        return let(twice, lambda d: F.when(F.size(d) == 0, zero).otherwise(covered(h, d)))

    return F.when(n < WINDOW + 1, zero).otherwise(let(hashes, with_sorted))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``measures``: what the rules look at. A null text has no word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    solid = F.regexp_replace(text, BLANK_CLASS + "+", "")
    by_words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    by_characters = let(
        solid,
        lambda s: F.struct(
            F.length(s).cast("long").alias("word_chars"),
            count_of(s, SYMBOLS).cast("long").alias("n_symbols"),
            count_of(s, UPPER).cast("long").alias("n_upper"),
            count_of(s, "!?").cast("long").alias("n_shouts"),
            count_of(s, "0123456789.,;:!?-_()[]{}'\"/\\=+@~^`" + SYMBOLS).cast("long").alias("n_other"),
        ),
    )
    return docs.withColumn("measures", F.struct(by_words.alias("w"), by_lines.alias("l"), by_characters.alias("c")))


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1), good (1), or abstains (0) where neither condition holds or one is null."""

    name: str
    bad: str
    good: str


#: The voting rules, over the columns that ``measured`` makes. Between its two conditions a rule abstains.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words AND n_words > 0"),
    Rule("lines", "10 * n_dup_lines > 4 * n_lines", "n_lines >= 4 AND 10 * n_dup_lines <= n_lines"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words AND n_words > 0"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 11 * n_words AND n_words > 0"),
    Rule("upper", "10 * n_upper > 4 * word_chars", "10 * n_upper <= word_chars AND n_words > 0"),
    Rule("shouts", "5 * n_shouts > n_words", "20 * n_shouts <= n_words AND n_words > 0"),
    Rule("letters", "9 * n_other > word_chars", "16 * n_other <= word_chars AND n_words > 0"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
MEASURES = {"n_words": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l", "word_chars": "c", "n_symbols": "c", "n_upper": "c", "n_shouts": "c", "n_other": "c"}


def votes(table: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``table`` (with ``measures``) plus ``votes``: an array of -1, 0 or 1, a rule each."""

    def qualified(condition: str) -> str:
        for name, part in MEASURES.items():
            condition = condition.replace(name, f"measures.{part}.{name}")
        return condition

    each = [f"CASE WHEN {qualified(r.bad)} THEN -1 WHEN {qualified(r.good)} THEN 1 ELSE 0 END" for r in rules]
    return table.withColumn("votes", F.expr(f"array({', '.join(each)})"))


@dataclass(frozen=True)
class Weights:
    """What EM found: the share of bad documents, and for each rule how often it votes bad, given that it votes, on bad and on good ones."""

    bad_share: float
    bad_when_bad: tuple[float, ...]
    bad_when_good: tuple[float, ...]

    def logit(self, votes: Column) -> Column:
        """Log odds that a document is good."""
        total = F.lit(math.log((1 - self.bad_share) / self.bad_share))
        for k, (b, g) in enumerate(zip(self.bad_when_bad, self.bad_when_good)):
            total = total + F.when(votes[k] == -1, math.log(g / b)).when(votes[k] == 1, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return total


EVEN = 1e-9  # keeps the logarithm of a share of 0 or 1 finite


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 1000, prior: float = 0.1) -> Weights:
    """EM over vote patterns and their counts (at most 3 to the number of rules, whatever the corpus).

    Two classes, rules independent given the class, an abstention says nothing. It starts from "bad if any rule says so". What is found
    is the mode under a prior: of either class as many more votes as ``prior`` of its documents would cast, in which a rule calls 6 in 10 bad
    documents bad and 1 in 20 good ones. So rates follow the votes, and it is the same at every size. The share of bad documents is
    free: the bad class is the one that rules call bad more often, be it most of the corpus. A vote is never taken to mean its
    contrary, so a document that no rule calls bad can't fall into the bad class unless most documents do. With no documents the
    starting values stay.
    """
    k = len(patterns[0][0]) if patterns else 0
    bad = [0.9 if -1 in v else 0.02 for v, _ in patterns]
    share, q, g = 0.1, [0.6] * k, [0.05] * k
    total = sum(c for _, c in patterns)
    more = prior * total
    for _ in range(rounds if total else 0):
        share = min(1 - EVEN, max(EVEN, sum(p * c for p, (_, c) in zip(bad, patterns)) / total))
        for j in range(k):
            nb = nbv = ng = ngv = 0.0
            for p, (v, c) in zip(bad, patterns):
                if v[j]:
                    nb, ng = nb + p * c, ng + (1 - p) * c
                    if v[j] < 0:
                        nbv, ngv = nbv + p * c, ngv + (1 - p) * c
            g[j] = (ngv + 0.05 * more * (1 - share)) / (ng + more * (1 - share))
            q[j] = max(g[j], (nbv + 0.6 * more * share) / (nb + more * share))
        new = []
        for v, _ in patterns:
            z = math.log(share / (1 - share)) + sum(math.log(q[j] / g[j]) if v[j] < 0 else math.log((1 - q[j]) / (1 - g[j])) if v[j] > 0 else 0.0 for j in range(k))
            new.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
        moved, bad = max((abs(a - b) for a, b in zip(new, bad)), default=0.0), new
        if moved < 1e-9:
            break
    return Weights(share, tuple(q), tuple(g))


def weigh(table: DataFrame) -> Weights:
    """Estimate from a table with ``votes``; only distinct vote patterns and counts come to the driver."""
    rows = table.groupBy("votes").count().collect()
    return estimate(sorted((tuple(r["votes"]), r["count"]) for r in rows))


def verdict(weights: Weights, threshold: float = 0.25) -> tuple[Column, Column]:
    """(base_failed, kept) over a table with ``measures`` and ``votes``: kept is false if a fixed rule fails, else whether the posterior of good reaches the threshold: what goes is three times as likely bad as good."""
    condition = BASE_FAILED
    for name in ("n_words", "n_repeat_words"):
        condition = condition.replace(name, f"measures.w.{name}")
    failed = F.expr(condition)
    return failed, ~failed & (weights.logit(F.col("votes")) >= math.log(threshold / (1 - threshold)))


def score_quality(docs: DataFrame) -> DataFrame:
    """Measures, verdict and posterior of every row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    Null and empty texts have no words and fail. Repeated rows are measured as often as they come; equal texts get equal verdicts. An
    empty table gives an empty one. Each text is measured once, and only the measures are written (to the shared folder) for the second pass.
    """
    table = written(votes(measured(docs.select("doc_id", "text"))).drop("text"), "quality")
    weights = weigh(table)
    failed, kept = verdict(weights)
    logit = weights.logit(F.col("votes"))
    m = {name: F.col(f"measures.{part}.{name}") for name, part in MEASURES.items()}
    return table.select("doc_id", *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), kept.alias("kept"), (1 / (1 + F.exp(-logit))).alias("quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with their columns as they were (clashing names are set aside under struct ``kept_row``)."""
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("kept_row"), docs["text"])
    table = written(votes(measured(whole)).drop("text"), "quality")
    return table.where(verdict(weigh(table))[1]).select("kept_row.*")
