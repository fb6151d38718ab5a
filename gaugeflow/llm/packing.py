"""Packing examples into fixed-length training sequences by vector bin packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches
from .tokens import id_cache

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segments long"


def pack_vectors(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each item, by the dot-product heuristic.

    sizes: items x dimensions, none above ``limits``. A bin is filled while something fits: of the items that fit under every limit
    at once the one whose size has the largest dot product with what the bin has left goes in, each dimension measured as a share of
    its limit and weighted by the mean demand for it. Equal items go in their given order. Empty input gives no bins.
    """
    share = sizes / limits
    weight = share.mean(axis=0) if len(share) else np.zeros(len(limits))
    kinds, inverse, count = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    shares, left_of = kinds / limits, count.copy()
    queues = np.argsort(inverse, kind="stable")
    first = np.cumsum(count) - count
    bins, taken, bin_id, open_items = np.empty(len(sizes), np.int64), np.zeros(len(kinds), np.int64), -1, len(sizes)
    while open_items:
        bin_id += 1
        left = limits.astype(np.int64).copy()
        alive = left_of > 0
        if not alive.all():  # drop the kinds that are used up
            kinds, shares, first, taken, left_of = (x[alive] for x in (kinds, shares, first, taken, left_of))
        while True:
            fits = (left_of > 0) & (kinds <= left).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, shares @ (weight * (left / limits)), -1.0)
            k = int(score.argmax())
            bins[queues[first[k] + taken[k]]] = bin_id
            taken[k] += 1
            left_of[k] -= 1
            left -= kinds[k]
            open_items -= 1
    return bins


def pack_documents(docs: DataFrame, tokenizer_path: str, *, length: int = 1024, end_id: int = 0, max_segments: int = 6, max_loss: int = 1016, prompt_ids: int = 16, prompt: str | None = None, pool: int = 4096) -> DataFrame:
    """Tokenize every document (null text: empty), append ``end_id`` and place it in sequences under three simultaneous limits.

    A document's first ids are its prompt and bear no loss: as many as its column ``prompt`` says (instruction data; null: none), or
    ``prompt_ids`` where no column is named; all other ids bear loss, the end id too. A document is cut into pieces that fill a sequence,
    by ``length`` ids or ``max_loss`` loss-bearing ones, and a rest; up to ``pool`` rests of a task's rows are packed together
    under limits on tokens, on segments (pieces in a sequence) and on loss-bearing tokens. The work needs no shuffle: a task packs the
    rows it reads, so no group or key can be hot, and its sequences are numbered after its partition, as long as the input's splits stay
    the same.

    One row a piece: doc_id (null where the document's is), start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens,
    segments (pieces in its sequence). Repeated rows are packed as often as they come. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    limits = np.array([length, max_segments, max_loss])
    if limits.min() < 1:
        raise ValueError("limits must be positive")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = id_cache(tokenizer_path)
        base, used, waiting = TaskContext.get().partitionId() << 40, 0, []

        def packed(rows: list[tuple]) -> list[tuple]:
            nonlocal used
            bins = pack_vectors(np.array([[r[2], 1, r[5]] for r in rows], np.int64).reshape(-1, 3), limits)
            end, inside = {}, np.bincount(bins)
            out = []
            for r, b in zip(rows, bins.tolist()):
                at = end.get(b, 0)
                end[b] = at + r[2]
                out.append((*r[:5], base + used + b, at, r[5], int(inside[b])))
            used += len(inside)
            return out

        for batch in batches:
            out = []
            ids, cuts = cache.encode_column(batch["text"].fillna("").tolist())
            for doc, free, a, b in zip(batch["doc_id"].array, batch["prompt"].tolist(), cuts, cuts[1:]):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                n, start = len(own), 0
                while n - start > 0:
                    left = max(0, free - start)  # ids ahead that bear no loss
                    size = min(length, left + max_loss, n - start)
                    loss = max(0, size - left)
                    row = (doc, start, size, zlib.crc32(own[start : start + size].tobytes()), n, loss)
                    start += size
                    if size == length or loss == max_loss:
                        out.append((*row[:5], base + used, 0, row[5], 1))
                        used += 1
                    else:
                        waiting.append(row)
            while len(waiting) >= pool:
                out += packed(waiting[:pool])
                waiting = waiting[pool:]
            yield frame(out)
        if waiting:
            yield frame(packed(waiting))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    free = F.lit(prompt_ids) if prompt is None else F.coalesce(docs[f"`{prompt}`"], F.lit(0))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], free.cast("long").alias("prompt")).mapInPandas(pieces, PIECES)
