"""Token ids in wavelet-matrix shards: bit-planes with rank and select, written as one compressed value a shard."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bound_batches
from .tokens import id_cache

MAGIC = b"WMX2"
BLOCK = 512  # bits between two entries of the rank directory
CHUNK = 8192  # bytes of a plane that are compressed together, and read together


class Plane:
    """Bits of one level: a rank directory, and bytes that are given whole or in chunks that are decompressed when they are read."""

    def __init__(self, n: int, rank_at: np.ndarray, data: np.ndarray | None = None, chunks: list[bytes] | None = None):
        self.n, self.rank_at, self.data, self.chunks = n, rank_at, data, chunks
        self.zeros, self.opened = n - int(rank_at[-1]), {}

    @classmethod
    def build(cls, data: np.ndarray, n: int) -> Plane:
        whole = np.zeros(-(-len(data) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        whole[: len(data)] = data
        sums = np.bitwise_count(whole).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        return cls(n, np.concatenate([[0], np.cumsum(sums)]), data)

    def read(self, a: int, b: int) -> np.ndarray:
        """Bytes a to b."""
        if self.data is not None:
            return self.data[a:b]
        parts = [self._chunk(k)[max(0, a - k * CHUNK) : b - k * CHUNK] for k in range(a // CHUNK, -(-min(b, -(-self.n // 8)) // CHUNK))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def _chunk(self, k: int) -> np.ndarray:
        if k not in self.opened:
            self.opened[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[k], max_output_size=CHUNK), np.uint8)
        return self.opened[k]


class WaveletMatrix:
    """A sequence of unsigned integers as ``bits`` planes; plane ``l`` holds the l-th highest bit of each, zeros of the plane before moved in front."""

    def __init__(self, n: int, bits: int, planes: list[Plane]):
        self.n, self.bits, self.planes = n, bits, planes

    @property
    def zeros(self) -> list[int]:
        return [p.zeros for p in self.planes]

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        """``bits`` a value, or as many as the largest needs; a value that needs more is an error."""
        needed = max(1, int(values.max(initial=0)).bit_length())
        bits = bits or needed
        if needed > bits:
            raise ValueError(f"a value needs {needed} bits, more than {bits}")
        now, planes = values.astype(np.uint16 if bits <= 16 else np.uint32), []
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            planes.append(Plane.build(np.packbits(bit), len(values)))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(values), bits, planes)

    def values(self) -> np.ndarray:
        """All values, by undoing the planes' partitions from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane.read(0, -(-self.n // 8)), count=self.n).view(bool)
            before = np.empty_like(now)
            before[~bit], before[bit] = now[: plane.zeros], now[plane.zeros :] | now.dtype.type(1 << level)
            now = before
        return now

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        if i % BLOCK == 0:
            return int(plane.rank_at[block])
        part = plane.read(block * BLOCK // 8, i // 8 + 1)
        whole = i // 8 - block * BLOCK // 8
        rest = int(part[whole] >> (8 - i % 8)).bit_count() if i % 8 else 0
        return int(plane.rank_at[block]) + int(np.bitwise_count(part[:whole]).sum()) + rest

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit, ones = plane.read(i // 8, i // 8 + 1)[0] >> (7 - i % 8) & 1, self._ones(level, i)
            value, i = value << 1 | int(bit), plane.zeros + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """How many of the first i values equal ``value``."""
        if value >> self.bits:
            return 0
        a, b = 0, i
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.planes[level].zeros + x, self.planes[level].zeros + y) if value >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``; -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        a = 0
        for level in range(self.bits):
            x = self._ones(level, a)
            a = self.planes[level].zeros + x if value >> (self.bits - 1 - level) & 1 else a - x
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, one, i - self.planes[level].zeros if one else i)
        return i

    def _select_bit(self, level: int, one: int, k: int) -> int:
        plane = self.planes[level]
        at = plane.rank_at if one else np.arange(len(plane.rank_at)) * BLOCK - plane.rank_at
        block = int(np.searchsorted(at, k, side="right")) - 1
        bits = np.unpackbits(plane.read(block * BLOCK // 8, (block + 1) * BLOCK // 8))
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(at[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def to_bytes(self) -> bytes:
        """Header, sizes, then for each plane its rank directory and its chunks, each compressed by itself, so that a part of one plane can be read alone."""
        pack, sizes, parts = zstandard.ZstdCompressor(level=1), [], []
        for p in self.planes:
            bits = p.read(0, -(-self.n // 8)).tobytes()
            own = [pack.compress(p.rank_at.astype("<i8").tobytes()), *(pack.compress(bits[a : a + CHUNK]) for a in range(0, len(bits), CHUNK))]
            sizes += map(len, own)
            parts += own
        return MAGIC + struct.pack(f"<QII{len(sizes)}I", self.n, self.bits, len(sizes), *sizes) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """Opens a shard: only the rank directories are decompressed, planes as they are read."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        n, bits, count = struct.unpack_from("<QII", data, 4)
        sizes, at, parts = struct.unpack_from(f"<{count}I", data, 20), 20 + 4 * count, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        each, planes, unpack = count // bits, [], zstandard.ZstdDecompressor()
        for k in range(bits):
            directory, *chunks = parts[k * each : (k + 1) * each]
            rank_at = np.frombuffer(unpack.decompress(directory, max_output_size=8 * (-(-n // BLOCK) + 1)), "<i8")
            planes.append(Plane(n, rank_at, chunks=chunks))
        return cls(n, bits, planes)


SHARDS = T.StructType([T.StructField("part", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("matrix", T.BinaryType())])


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 1, shard_ids: int = 1 << 20) -> None:
    """Encode every document (null text: empty), append ``end_id``, and write shards in ascending doc_id order (null first) to ``path``.

    Documents are dealt by ranges of (doc_id, hash of the text), so repeated ids split too; rows equal in both keep one place each. A
    shard holds whole documents: it is closed once it has ``shard_ids`` ids, so it is larger than that by less than one document. The
    files are Parquet with a row a shard, so any store that Spark reaches will do. Planes are as many as the vocabulary's largest id, or
    ``end_id``, has bits. An empty table gives an empty folder of shards.
    """
    bound_batches(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part, shard = id_cache(tokenizer_path), TaskContext.get().partitionId(), 0
        bits = max(1, end_id.bit_length(), (cache.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        ids, doc_ids, lengths, total = [], [], [], 0

        def closed() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids), bits).to_bytes()
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "n_ids": [total], "doc_ids": [doc_ids], "lengths": [lengths], "matrix": [matrix]}, schema=pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("matrix", pa.binary())]))

        for batch in batches:
            found, cuts = cache.encode_column([t or "" for t in batch.column("text").to_pylist()])
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), cuts.tolist(), cuts[1:].tolist()):
                ids.append(np.append(found[a:b], np.uint32(end_id)))
                doc_ids.append(doc)
                lengths.append(b - a + 1)
                total += b - a + 1
                if total >= shard_ids:
                    yield closed()
                    ids, doc_ids, lengths, total, shard = [], [], [], 0, shard + 1
        if ids:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    slim.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(shards, SHARDS).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the shards at ``path``, a row a document: doc_id, start (ids of all documents before it), n_tokens and the ids' CRC-32."""
    shards = spark.read.schema(SHARDS).parquet(path)
    w = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr("part", f"coalesce(sum(n) OVER (ORDER BY part {w}), 0) AS part_start")  # a row a task of the writer
    inside = shards.selectExpr("part", "shard", f"coalesce(sum(n_ids) OVER (PARTITION BY part ORDER BY shard {w}), 0) AS shard_start")
    starts = inside.join(parts, "part").selectExpr("part", "shard", "part_start + shard_start AS first_id")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(x["matrix"]).values().astype("<u4")
                ends = np.cumsum(np.asarray(x["lengths"], np.int64))
                starts = ends - np.asarray(x["lengths"], np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_pydict({"part": pa.array([x["part"]] * n, pa.int64()), "shard": pa.array([x["shard"]] * n, pa.int64()), "doc_id": pa.array(x["doc_ids"], pa.int64()), "inside": pa.array(starts), "n_tokens": pa.array(x["lengths"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = shards.select("part", "shard", "doc_ids", "lengths", "matrix").mapInArrow(documents, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("first_id") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of a few token ids is in all shards at ``path``, counted in the compressed planes without decoding a sequence."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(tokens), np.int64)
            for data in batch.column("matrix").to_pylist():
                matrix = WaveletMatrix.from_bytes(data)
                total += [matrix.count(t) for t in tokens]
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array(total)})

    bound_batches(spark)
    each = spark.read.schema(SHARDS).parquet(path).select("matrix").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token long")
    return wanted.join(each, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, at: every place of a token id, counted from its document's start. Shards without it are passed over by their counts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(x["matrix"])
                places = np.array(matrix.occurrences(token), np.int64)
                ends = np.cumsum(np.asarray(x["lengths"], np.int64))
                doc = np.searchsorted(ends, places, side="right")
                starts = ends - np.asarray(x["lengths"], np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x["doc_ids"][d] for d in doc], pa.int64()), "at": pa.array(places - starts[doc], pa.int64())})

    bound_batches(spark)
    return spark.read.schema(SHARDS).parquet(path).select("doc_ids", "lengths", "matrix").mapInArrow(find, "doc_id long, at long")
