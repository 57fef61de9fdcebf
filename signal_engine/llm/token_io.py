"""Token ids in a binary file format: fixed-width bit packing with block offsets.

A shard file holds, little-endian: an 8-byte magic; blocks of ``BLOCK`` ids, each id in the fewest bits
that hold the vocabulary and each block padded to whole 64-bit words; then the documents' keys (int64,
with a validity byte each), the documents' first ids (int64, one more than documents), the blocks' byte
offsets (int64), and a trailer with the counts. Every block starts at a stored offset and every id has the
same width, so any range of ids is read by unpacking only its blocks with numpy.

``write_tokens`` sorts documents by key over range partitions, so that shard order and the order inside a
shard give ascending keys; each task writes files of its own name, and only the files named by tasks that
succeeded enter the manifest, so a lost executor or a repeated task leaves nothing but an unread file.

Defined results: null or empty text gives only the end id; null keys sort first; rows with equal keys stay
separate documents, ordered by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signal_engine.llm.common import as_arrow_string, Scratch, slices, tidy, word_tokenizer

MAGIC = b"SETOKID1"
TRAILER = struct.Struct("<qqqqqq8s")  # documents, ids, blocks, bits, block length, index offset, magic
BLOCK = 1 << 16
READ_IDS = 1 << 20  # ids unpacked at once when reading back


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id below vocab_size."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, least significant bit first, padded to whole 64-bit words."""
    per, words = 64 // math.gcd(bits, 64), bits // math.gcd(bits, 64)
    groups = -(-len(ids) // per)
    padded = np.zeros(groups * per, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, per)
    out = np.zeros((groups, words), np.uint64)
    for j in range(per):
        w, s = divmod(j * bits, 64)
        out[:, w] |= padded[:, j] << np.uint64(s)
        if s + bits > 64:
            out[:, w + 1] |= padded[:, j] >> np.uint64(64 - s)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    per, words = 64 // math.gcd(bits, 64), bits // math.gcd(bits, 64)
    packed = np.frombuffer(data, "<u8").reshape(-1, words)
    out = np.empty((len(packed), per), np.uint64)
    for j in range(per):
        w, s = divmod(j * bits, 64)
        out[:, j] = packed[:, w] >> np.uint64(s)
        if s + bits > 64:
            out[:, j] |= packed[:, w + 1] << np.uint64(64 - s)
    return (out & np.uint64((1 << bits) - 1)).ravel()[:n].astype(np.uint32)


def _open_dir(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class ShardWriter:
    """Streams documents into one shard file."""

    def __init__(self, uri: str, bits: int):
        fs, path = _open_dir(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.bits = fs.open_output_stream(path), bits
        self.out.write(MAGIC)
        self.at, self.offsets, self.buffer, self.held = len(MAGIC), [], [], 0
        self.keys, self.valid, self.starts, self.total = [], [], [0], 0

    def add(self, keys, valid, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.valid.append(valid)
        self.starts.extend((self.total + np.cumsum(counts)).tolist())
        self.total += len(ids)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.buffer)
            last = len(whole) // BLOCK * BLOCK
            for i in range(0, last, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.buffer, self.held = [whole[last:]], len(whole) - last

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if self.held:
            self._block(np.concatenate(self.buffer))
        n = len(self.starts) - 1
        index = np.concatenate([*self.keys, np.zeros(0, np.int64)]).astype("<i8").tobytes() + np.concatenate([*self.valid, np.zeros(0, np.uint8)]).astype(np.uint8).tobytes()
        index += np.asarray(self.starts, "<i8").tobytes() + np.asarray(self.offsets, "<i8").tobytes()
        self.out.write(index + TRAILER.pack(n, self.total, len(self.offsets), self.bits, BLOCK, self.at, MAGIC))
        self.out.close()
        return n, self.total


class ShardReader:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        fs, path = _open_dir(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.n, self.total, blocks, self.bits, self.block, at, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        index = self.file.read_at(size - TRAILER.size - at, at)
        self.keys = np.frombuffer(index, "<i8", self.n)
        self.valid = np.frombuffer(index, np.uint8, self.n, 8 * self.n)
        self.starts = np.frombuffer(index, "<i8", self.n + 1, 9 * self.n)
        self.offsets = np.append(np.frombuffer(index, "<i8", blocks, 9 * self.n + 8 * (self.n + 1)), at)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the shard; reads only their blocks."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        data = self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        parts = []
        for k in range(a, b + 1):
            n = min(self.block, self.total - k * self.block)
            parts.append(unpack(data[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])], n, self.bits))
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]


MANIFEST = "shard long, file string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id to each, write shards in ascending key order; returns the manifest
    (shard, file, n_docs, n_tokens, first_token), one row per shard."""
    out_uri = scratch.path("shards")

    def shard(batches):
        from pyspark import TaskContext

        tok, writer, uri = word_tokenizer(tokenizer_file), None, ""
        bits = bits_for(max(tok.vocab_size, end_id + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                uri = f"{out_uri}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                writer = ShardWriter(uri, bits)
            texts = as_arrow_string(batch.column(1))
            valid = np.asarray(batch.column(0).is_valid()).astype(np.uint8)
            keys = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            for i, j in slices(texts):
                ids, counts = tok.encode(texts[i:j])
                with_end = np.insert(ids, np.cumsum(counts), end_id) if j > i else ids
                writer.add(keys[i:j], valid[i:j], with_end.astype(np.uint32), counts + 1)
        if writer is not None:
            n, total = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "file": [uri], "n_docs": [n], "n_tokens": [total]})

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    manifest = scratch.write(ordered.mapInArrow(tidy(shard), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the shards back: one row per document with its place among all ids and the ids' CRC-32."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["file"])
                i = 0
                while i < shard.n:
                    j = max(i + 1, int(np.searchsorted(shard.starts, shard.starts[i] + READ_IDS, side="right")) - 1)
                    ids = shard.ids(int(shard.starts[i]), int(shard.starts[j])).astype("<u4")
                    data, base = memoryview(ids).cast("B"), shard.starts[i]
                    cuts = (4 * (shard.starts[i : j + 1] - base)).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.keys[i:j], mask=shard.valid[i:j] == 0),
                            pa.array(shard.starts[i:j] + row["first_token"]),
                            pa.array(np.diff(shard.starts[i : j + 1])),
                            pa.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    i = j

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
