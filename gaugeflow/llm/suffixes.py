"""Repeated passages by a sparse suffix array: which strings of ``length`` bytes start more than once, and the texts without them.

Not every suffix is sorted, but those at anchors. The anchor of a window of ``length`` bytes is the leftmost of its grams (32 bytes) whose
hash is least, so it depends on the window's bytes only: equal windows have their anchors at the same offset. One byte in about 180 is an anchor.

1. Texts are read where they are. For each anchor and each half of the possible offsets two hashes are kept: of the *core*, the bytes that all
   windows of these offsets share (about half of ``length``), and of the *span*, all bytes of the windows that have this anchor.
2. Cores that come once drop out: their windows can't be repeated. This is a count with partial results in each task.
3. Anchors with equal spans repeat each other whole. One of them stays as their representative.
4. Representatives with equal cores but unlike spans are sorted: the suffixes behind their cores, and the reversed prefixes before them. The
   sort is deep-shallow: multikey quicksort in characters of 8 bytes to a shallow depth, then a blind trie for each group that still
   agrees, which compares a suffix in full once and otherwise looks at branching bytes only. With the common prefixes f and b of
   two representatives, windows whose offsets lie from r2 - f to r1 + b are equal, where r1 and r2 are the least and greatest offset of the half.
5. Cores with more than ``MOST`` representatives aren't gathered. The range of their offsets is cut in four, whose cores are longer, and 2 to 4
   are done again with these; a range of one offset has a core that is the window itself, so counting decides.
6. Windows found are joined to their texts, and the bytes that they cover go.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, forget, written

MOST = 1000  # representatives that one task sorts at once; each is under two lengths
SHALLOW = 24  # bytes behind a core that multikey quicksort looks at
CHARACTER = 8
CHUNK = 1 << 20


def gram_of(length: int) -> int:
    return min(32, length // 4)


def halves(length: int) -> tuple[tuple[int, int], ...]:
    """The possible offsets of an anchor in its window, in two ranges."""
    last = length - gram_of(length)
    return (0, last // 2), (last // 2 + 1, last)


def _gram_order(data: np.ndarray, gram: int) -> np.ndarray:
    """For each gram its hash (32 bits) above its position (32 bits)."""
    n = len(data) - gram + 1
    eights = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    x = np.zeros(n, np.uint64)
    for at in sorted({*range(0, gram - 7, 8), gram - 8}):
        x ^= eights[at : at + n]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x &= np.uint64(0xFFFFFFFF00000000)
    return x | np.arange(n, dtype=np.uint64)


def _least_of_next(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first window, last window) for texts that stand one after the other in ``data``, from bounds[i] to bounds[i + 1]."""
    gram, held = gram_of(length), None
    starts, last_window = bounds[:-1], bounds[1:] - length
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        least = _least_of_next(_gram_order(part, gram), length - gram + 1)
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
        cut = np.ones(len(anchor), bool)
        cut[1:] = anchor[1:] != anchor[:-1]
        for edge in (starts, last_window + 1):
            inside = edge[(edge >= at) & (edge < at + len(anchor))] - at
            cut[inside] = True
        first = np.flatnonzero(cut)
        end = np.append(first[1:], len(anchor)) - 1 + at
        own = anchor[first]
        first = first + at
        text = np.searchsorted(starts, first, "right") - 1
        ok = first <= last_window[text]
        for row in zip(own[ok].tolist(), first[ok].tolist(), end[ok].tolist(), text[ok].tolist(), strict=True):
            if held and held[0] == row[0] and held[2] + 1 == row[1] and held[3] == row[3]:
                held = (held[0], held[1], row[2], held[3])  # a chunk ended between them
                continue
            if held:
                yield held[:3]
            held = row
    if held:
        yield held[:3]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashes(text, at: int, lo: int, hi: int, r1: int, r2: int, length: int) -> tuple[int, int]:
    """Of an anchor's core for offsets r1 to r2 and of its span for lo to hi."""
    core = xxhash.xxh3_64_intdigest(text[at - r1 : at - r2 + length], seed=r1 << 32 | r2)
    span = xxhash.xxh3_64_intdigest(text[at - hi : at - lo + length], seed=lo << 32 | hi)
    return _signed(core), _signed(span)


ANCHORS = "at int, lo int, hi int, r1 int, r2 int, core long, span long, twice boolean"


def _fingerprints(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``ANCHORS``; those without a core tell windows that their own text repeats."""
    for batch in batches:
        ids, text_hashes = batch.column(0), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        view = memoryview(np.ascontiguousarray(data))
        ends, i, rows = bounds.tolist(), 0, []
        seen: dict[tuple[int, int], int] = {}
        for a, first, last in anchors(data, bounds, length):
            while first >= ends[i + 1]:
                i, seen = i + 1, {}
            for r1, r2 in halves(length):
                lo, hi = max(a - last, r1), min(a - first, r2)
                if lo > hi:
                    continue
                key = hashes(view, a, lo, hi, r1, r2, length)
                if key in seen:
                    rows[seen[key]][-1] = True
                    rows.append([i, a - ends[i], lo, hi, r1, r2, None, None, True])
                else:
                    seen[key] = len(rows)
                    rows.append([i, a - ends[i], lo, hi, r1, r2, *key, False])
            if len(rows) >= 50_000 and last >= ends[i + 1] - length:
                yield _with_ids(rows, ids, text_hashes)
                rows, seen = [], {}
        if rows:
            yield _with_ids(rows, ids, text_hashes)


def _with_ids(rows: list[list], ids: pa.Array, text_hashes: list[int]) -> pa.RecordBatch:
    text, *columns = zip(*rows, strict=True)
    types = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.bool_()]
    arrays = [ids.take(pa.array(text, pa.int32())), pa.array([text_hashes[i] for i in text], pa.int64()), *map(pa.array, columns, types)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", *(x.split()[0] for x in ANCHORS.split(", "))])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(suffixes: list[bytes], group: list[int]) -> tuple[list[int], list[int]]:
    """``group`` (indexes of suffixes) in order, and the common prefix of each with the one before it (0 for the first).

    Inner nodes know how long their suffixes agree and the byte by which they part (-1: a suffix ends). A new suffix goes down by these
    bytes alone to some leaf, is compared with that once, and the branch is made where they part.
    """
    root: list = [None, [group[0]]]  # a leaf: [None, equal suffixes]; an inner node: [depth, {byte: node}]
    for g in group[1:]:
        s, node = suffixes[g], root
        while node[0] is not None:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = suffixes[node[1][0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node[1].append(g)
            continue
        above, node = None, root
        while node[0] is not None and node[0] < same:
            above, node = node, node[1][s[node[0]]]
        byte = s[same] if same < len(s) else -1
        if node[0] == same:
            node[1][byte] = [None, [g]]
            continue
        inner = [same, {other[same] if same < len(other) else -1: node, byte: [None, [g]]}]
        if above is None:
            root = inner
        else:
            above[1][s[above[0]]] = inner
    order, prefixes, todo = [], [], [(root, 0)]
    while todo:
        node, before = todo.pop()
        if node[0] is None:
            order += node[1]
            prefixes += [before] + [len(suffixes[node[1][0]])] * (len(node[1]) - 1)
        else:
            parts = sorted(node[1])
            todo += [(node[1][p], node[0]) for p in reversed(parts[1:])] + [(node[1][parts[0]], before)]
    return order, prefixes


def deep_shallow(suffixes: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the suffixes, and the common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    prefixes: list[int] = []
    todo = [(list(range(len(suffixes))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) > 1 and depth < SHALLOW:
            pivot = suffixes[group[len(group) // 2]][depth : depth + CHARACTER]
            less, same, more = [], [], []
            for g in group:
                c = suffixes[g][depth : depth + CHARACTER]
                (same if c == pivot else less if c < pivot else more).append(g)
            todo += [(part, d) for part, d in ((more, depth), (same, depth + CHARACTER), (less, depth)) if part]
            continue
        own, shared = blind_trie(suffixes, group)
        shared[0] = common_prefix(suffixes[order[-1]], suffixes[own[0]]) if order else 0
        order += own
        prefixes += shared
    return order, prefixes


def _clusters(order: list[int], prefixes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array(prefixes)


def equal_windows(members: list[tuple[bytes, int, int]], r1: int, r2: int, length: int) -> list[tuple[int, int, int]]:
    """(member, first offset, last offset) of windows that another member has too. A member is (span, lo, hi); all have the same core."""
    core, n = length - (r2 - r1), len(members)
    after = [s[hi - r1 + core :] for s, lo, hi in members]
    before = [s[: hi - r1][::-1] for s, lo, hi in members]
    if n == 2:
        lo, hi = r2 - common_prefix(*after), r1 + common_prefix(*before)
        return [(i, max(lo, m[1]), min(hi, m[2])) for i, m in enumerate(members) if max(lo, m[1]) <= min(hi, m[2])]
    (rank_f, f), (rank_b, b) = (_clusters(*deep_shallow(x)) for x in (after, before))
    lo, hi = np.array([m[1] for m in members]), np.array([m[2] for m in members])
    cuts = np.unique(np.concatenate([[r1], r2 - f[1:], r1 + b[1:] + 1, lo, hi + 1]))
    cuts = cuts[(cuts >= r1) & (cuts <= r2)]
    found = []
    for first, end in zip(cuts.tolist(), [*cuts[1:].tolist(), r2 + 1], strict=True):
        # The suffixes that agree in r2 - offset bytes and the prefixes that agree in offset - r1 bytes.
        both = np.cumsum(f < r2 - first)[rank_f] * (n + 1) + np.cumsum(b < first - r1)[rank_b]
        here = np.flatnonzero((lo <= first) & (first <= hi))
        _, at, count = np.unique(both[here], return_inverse=True, return_counts=True)
        found += [(i, first, end - 1) for i in here[count[at] > 1].tolist()]
    return found


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From representatives in the order of their cores, the windows that sorting finds equal: doc_id, text_hash, first, last."""
    held: pa.Table | None = None

    def found_in(rows: pa.Table) -> pa.RecordBatch:
        at = {c: rows.column(c).to_pylist() for c in rows.column_names if c != "doc_id"}
        groups, out = defaultdict(dict), []
        for i, core in enumerate(at["core"]):
            s, r1, r2 = at["bytes"][i], at["r1"][i], at["r2"][i]
            c = at["hi"][i] - r1
            # The core itself makes the group, so unlike ones with one hash stand apart; a row that comes twice counts once.
            groups[core, r1, r2, s[c : c + length - (r2 - r1)]].setdefault((at["text_hash"][i], at["at"][i], at["lo"][i], s), i)
        for (_, r1, r2, _), rows_of in groups.items():
            own = list(rows_of.values())
            if len(own) > 1:
                for k, first, last in equal_windows([(at["bytes"][i], at["lo"][i], at["hi"][i]) for i in own], r1, r2, length):
                    if not at["done"][own[k]]:
                        out.append((own[k], at["at"][own[k]] - last, at["at"][own[k]] - first))
        i, first, last = zip(*out, strict=True) if out else ((), (), ())
        take = pa.array(i, pa.int64())
        columns = [rows.column(c).combine_chunks().take(take) for c in ("doc_id", "text_hash")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc_id", "text_hash", "first", "last"])

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            cores = rows.column("core").to_numpy()
            whole = int(np.flatnonzero(cores != cores[-1])[-1]) + 1 if (cores != cores[-1]).any() else 0
            if whole:
                yield found_in(rows.slice(0, whole).combine_chunks())
            held = rows.slice(whole)
    if held is not None:
        yield found_in(held.combine_chunks())


def _narrowed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each representative for the four parts of its range of offsets, with new cores and spans."""
    for batch in batches:
        take, out = [], []
        for i, r in enumerate(batch.select(["at", "lo", "hi", "r1", "r2", "done", "bytes"]).to_pylist()):
            step = -(-(r["r2"] - r["r1"] + 1) // 4)
            for q1 in range(r["r1"], r["r2"] + 1, step):
                q2 = min(q1 + step - 1, r["r2"])
                lo, hi = max(q1, r["lo"]), min(q2, r["hi"])
                if lo <= hi:
                    core, span = hashes(r["bytes"], r["hi"], lo, hi, q1, q2, length)
                    take.append(i)
                    out.append((r["at"], lo, hi, q1, q2, core, span, r["done"], r["bytes"][r["hi"] - hi : r["hi"] - lo + length]))
        if out:
            types = [pa.int32()] * 5 + [pa.int64()] * 2 + [pa.bool_(), pa.binary()]
            ids = [batch.column(c).take(pa.array(take, pa.int64())) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, zip(*out, strict=True), types)], names=["doc_id", "text_hash", "at", "lo", "hi", "r1", "r2", "core", "span", "done", "bytes"])


def _windows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text_hash", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["text_hash"].eqNullSafe(b["text_hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash, first, last: starts of windows that come elsewhere too. docs: doc_id, text_hash, text (not null)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keys = f"doc_id {id_type}, text_hash long"
    marks = written(docs.where(F.octet_length("text") >= length).mapInArrow(lambda b: _fingerprints(b, length), f"{keys}, {ANCHORS}"), "anchors")
    weight = F.when(F.col("twice"), 2).otherwise(1)
    counts = marks.where("core IS NOT NULL").groupBy("core").agg(F.sum(weight).alias("n")).where("n > 1")
    left = written(marks.join(counts, "core", "left_semi"), "repeated-cores")
    first_of = F.min(F.struct("doc_id", "text_hash", "at", "lo", "hi", "r1", "r2")).alias("first_one")
    spans = written(left.groupBy("core", "span").agg(F.sum(weight).alias("n"), first_of), "spans")
    found = [_windows(marks.where("core IS NULL")), _windows(left.join(spans.where("n > 1").select("core", "span"), ["core", "span"], "left_semi"))]

    # Cores whose representatives differ: their spans are read from the texts, each text's at once.
    sizes = spans.groupBy("core").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("core", "m")
    wanted = spans.join(sizes, "core").select("first_one.*", "core", "span", (F.col("n") > 1).alias("done"), "m")
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "lo", "hi", "r1", "r2", "core", "span", "done", "m")).alias("rows"))
    texts = docs.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text"))
    each = texts.join(wanted, _same_row(texts, wanted)).select(texts["doc_id"], texts["text_hash"], "text", F.explode("rows").alias("r"))
    one = F.expr(f"substring(text, r.at - r.hi + 1, r.hi - r.lo + {length})")
    members = written(each.select("doc_id", "text_hash", "r.*", one.alias("bytes")), "representatives")
    scratch = [marks, left, spans, members]
    while True:
        few = members.where(F.col("m") <= MOST).drop("m", "span").repartition("core").sortWithinPartitions("core")
        found.append(few.mapInArrow(lambda b: _sorted_groups(b, length), f"{keys}, first int, last int"))
        many = members.where(F.col("m") > MOST)
        if many.isEmpty():
            break
        parts = written(many.drop("m", "core", "span").mapInArrow(lambda b: _narrowed(b, length), f"{keys}, at int, lo int, hi int, r1 int, r2 int, core long, span long, done boolean, bytes binary"), "narrowed")
        spans = written(parts.groupBy("core", "span").agg(F.sum(F.when(F.col("done"), 2).otherwise(1)).alias("n"), F.min(F.struct("text_hash", "doc_id", "at")).alias("first_one")), "spans")
        sizes = spans.groupBy("core").agg(F.count("*").alias("m")).where("m > 1")
        found.append(_windows(parts.where("NOT done").join(spans.where("n > 1").select("core", "span"), ["core", "span"], "left_semi")))
        kept = parts.drop("done").join(spans, ["core", "span"]).where(F.struct("text_hash", "doc_id", "at").eqNullSafe(F.col("first_one")))
        members = written(kept.join(sizes, "core").select("doc_id", "text_hash", "at", "lo", "hi", "r1", "r2", "core", "span", (F.col("n") > 1).alias("done"), "m", "bytes"), "representatives")
        scratch += [parts, spans, members]
    out = written(reduce(DataFrame.unionAll, found).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("windows")), "windows")
    forget(*scratch)
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"


def _without(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [[] for _ in range(5)]
        texts, windows = batch.column(1).cast(pa.binary()), batch.column(2)
        for i in range(batch.num_rows):
            text, spans = texts[i].as_py() or b"", []
            for w in sorted(windows[i].as_py() or (), key=lambda w: w["first"]):
                if spans and w["first"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], w["last"] + length)
                else:
                    spans.append([w["first"], w["last"] + length])
            kept = b"".join(text[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(text)], strict=True))
            for c, v in zip(columns, (len(text), len(text) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans], kept), strict=True):
                c.append(v)
        types = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], names=["doc_id", *(x.split()[0] for x in RESULT.split(" long, ")[:3]), "spans", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed stretches of bytes, end exclusive) and kept (the other bytes) for each row.

    A byte goes if a string of ``length`` bytes (32 at least) that starts anywhere else too, in the same text or another, covers it, as the
    texts come in; strings don't cross texts. Texts are UTF-8 bytes, so a cut may fall inside a character. A null text is empty; texts
    under ``length`` bytes lose nothing. Of equal rows each repeats the others, whatever their ids, null ids too. Other columns are not
    read. An empty table gives an empty one.
    """
    if length < 32:
        raise ValueError("length must be 32 at least")
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    windows = repeated_windows(rows, length)
    both = rows.join(windows, _same_row(rows, windows), "left").select(rows["doc_id"], "text", "windows")
    return both.mapInArrow(lambda b: _without(b, length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")
