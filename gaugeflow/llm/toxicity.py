"""Toxicity: a linear classifier of words and word beginnings whose score may not depend on which group a sentence names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, forget, written

_WORD = re.compile(r"[^\W\d_]+")

#: Terms that name groups of people in English, German, French and Spanish; within a row each can stand for any other. Fixed values.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heteros"),
    ("einwanderer", "einheimische", "flüchtlinge", "ausländer"),
    ("türken", "polen", "deutsche", "araber"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("homosexuels", "hétérosexuels", "lesbiennes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("noirs", "blancs", "arabes", "asiatiques"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "heterosexuales", "lesbianas"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("negros", "blancos", "árabes", "asiáticos"),
)


def swaps(terms: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each term and the next one of its row, which stands for it in the counterfactual text; a term of several rows keeps its first."""
    out: dict[str, str] = {}
    for row in terms:
        for i, a in enumerate(row):
            out.setdefault(a, row[(i + 1) % len(row)])
    return out


def words_in(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> tuple[str, ...]:
    """The word itself, and its first four and five letters, which stand for its forms."""
    return (word, *(f"{word[:k]}~" for k in (4, 5) if len(word) > k))


def all_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def swapped(words: set[str], following: dict[str, str]) -> set[str]:
    """The counterfactual text's words: each identity term becomes the one that stands for it."""
    return {following.get(w, w) for w in words}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in all_features(words))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Rows:
    """Active features of each row as a sparse 0/1 matrix."""

    def __init__(self, lists: list[list[int]], width: int):
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.column = np.fromiter((j for x in lists for j in x), np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=self.width)


def fit_linear(rows: list[list[int]], others: list[list[int]], y: np.ndarray, width: int, *, l2: float, swap_penalty: float, tolerance: float = 1e-6, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias that least (logistic loss + l2 |w|^2 + swap_penalty * squared change of the logit under the swap), each a mean over rows; both classes count alike.

    rows: active features of each row; others: those of its counterfactual. The sum is convex: Newton steps, each by conjugate gradients
    and halved until the sum falls, are taken until no component of the gradient is above ``tolerance``. So where no row has an
    identity term, the penalty changes nothing.
    """
    here = Rows(rows, width)
    changed = [i for i, (a, b) in enumerate(zip(rows, others)) if a != b]
    a, b = Rows([rows[i] for i in changed], width), Rows([others[i] for i in changed], width)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    strength = 2 * swap_penalty / max(1, len(rows))
    x = np.zeros(width + 1)  # the bias is last

    def penalty(w: np.ndarray) -> np.ndarray:
        change = a.times(w) - b.times(w)
        return strength * (a.back(change) - b.back(change)) + 2 * l2 * w

    def loss(x: np.ndarray) -> float:
        z = here.times(x[:-1]) + x[-1]
        change = a.times(x[:-1]) - b.times(x[:-1])
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + l2 * x[:-1] @ x[:-1] + strength / 2 * change @ change)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(here.times(x[:-1]) + x[-1], -40, 40)))
        g = weight * (p - y)
        gradient = np.append(here.back(g) + penalty(x[:-1]), g.sum())
        if np.abs(gradient).max() <= tolerance:
            break
        h = weight * p * (1 - p)

        def curved(v: np.ndarray) -> np.ndarray:
            z = h * (here.times(v[:-1]) + v[-1])  # noqa: B023
            return np.append(here.back(z) + penalty(v[:-1]), z.sum()) + 1e-9 * v

        step, r = np.zeros_like(x), -gradient
        d, rr = r.copy(), r @ r
        stop = rr * min(0.01, np.sqrt(rr))
        for _ in range(200):
            q = curved(d)
            k = rr / (d @ q)
            step, r = step + k * d, r - k * q
            new = r @ r
            if new <= stop:
                break
            d, rr = r + new / rr * d, new
        now, share = loss(x), 1.0
        while share > 1e-8 and loss(x + share * step) > now + 1e-4 * share * (gradient @ step):
            share /= 2
        x = x + share * step
    return x[:-1], float(x[-1])


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """Between which logits F1 is best: the middle of the last that counts as toxic and the first that doesn't."""
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    after = logit[order[at + 1]] if at + 1 < len(y) else logit[order[at]] - 1
    return float((logit[order[at]] + after) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, max_features: int = 2_000, l2: tuple[float, ...] = (1e-3, 1e-4, 1e-5), swap_penalty: float = 1.0, folds: int = 3, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic), on a sample by hash of about ``max_rows`` labelled ids at most; this bound is all that comes to the driver.

    A doc_id with several labels is toxic if one says so, and one with several texts teaches by that with the smallest hash; rows
    without an id or a label teach nothing. Features are the ``max_features`` whose presence goes with the label most (by z-score over the
    sample, found in five rows or more), and every identity term of ``terms``. Of the weights ``l2`` the one with the least loss on rows
    kept from the fit (in ``folds`` turns) is taken, and the threshold that separates those rows best by F1 becomes score 0.5. Without labels
    of both classes the score is that of the base rate.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = sample.withColumnRenamed("doc_id", "l_id")
    following = swaps(terms)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_in(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "id": batch["id"], "toxic": batch["toxic"], "here": [sorted(all_features(w)) for w in words], "there": [sorted(all_features(swapped(w, following))) for w in words]})

    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # max_rows ids at most, about
    each = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("id"), "toxic", "text").mapInPandas(read, "doc_id long, id long, toxic int, here array<string>, there array<string>")
    rows = written(each.groupBy("doc_id").agg(F.min(F.struct("id", "toxic", "here", "there")).alias("r")).select("r.*"), "toxic")
    totals = rows.agg(F.count("id").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not 0 < totals["p"] < totals["n"]:
        rate = (totals["p"] + 0.5) / (totals["n"] + 1)
        return ToxicityModel({}, float(np.log(rate / (1 - rate))))
    rate = totals["p"] / totals["n"]
    counts = rows.select("toxic", F.explode("here").alias("f")).groupBy("f").agg(F.count("toxic").alias("c"), F.sum("toxic").alias("p")).where("c >= 5")
    z = F.abs(F.col("p") - F.col("c") * rate) / F.sqrt(F.col("c") * (rate * (1 - rate)))
    best = [r["f"] for r in counts.orderBy(z.desc(), "f").limit(max_features).select("f").collect()]
    names = list(dict.fromkeys([*best, *(f for t in following for f in features_of(t))]))
    index = {f: i for i, f in enumerate(names)}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "here": [[index[f] for f in x if f in index] for x in batch["here"]], "there": [[index[f] for f in x if f in index] for x in batch["there"]]})

    data = sorted(rows.mapInPandas(numbered, "id long, toxic int, here array<int>, there array<int>").collect())
    forget(rows)
    y = np.array([r["toxic"] for r in data])
    here, there = [r["here"] for r in data], [r["there"] for r in data]
    kept = {}
    for strength in l2 if len(data) >= 2 * folds else ():
        logit = np.zeros(len(data))
        for fold in range(folds):
            own, rest = np.arange(fold, len(data), folds), np.setdiff1d(np.arange(len(data)), np.arange(fold, len(data), folds))
            w, bias = fit_linear([here[i] for i in rest], [there[i] for i in rest], y[rest], len(names), l2=strength, swap_penalty=swap_penalty)
            logit[own] = [w[here[i]].sum() + bias for i in own]
        balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        kept[strength] = (float((balance * (np.logaddexp(0, logit) - y * logit)).sum()), logit)
    strength = min(kept, key=lambda s: kept[s][0]) if kept else l2[0]
    w, bias = fit_linear(here, there, y, len(names), l2=strength, swap_penalty=swap_penalty)
    logit = kept[strength][1] if kept else np.array([w[x].sum() for x in here]) + bias
    return ToxicityModel({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-9}, bias - best_cut(logit, y))


class _Memo(dict):
    """Word -> its features that have a weight, for up to 300,000 words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in features_of(word) if f in self.weights)
        if len(self) >= 300_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on): a row for each row of ``docs``. Only the text counts; null counts as empty, and empty texts get the bias' score."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo(model.weights)
        for batch in batches:
            z = []
            for text in batch["text"].fillna(""):
                active = {f for found in map(memo.__getitem__, words_in(text)) if found for f in found}
                z.append(model.bias + sum(model.weights[f] for f in sorted(active)))
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score, "predicted": (score >= 0.5).astype("int32")})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInPandas(run, "doc_id long, score double, predicted int")
