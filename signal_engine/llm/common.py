"""Shared helpers: the job's shared folder, written intermediate tables, word splitting and tokenizing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Text handled at once inside a Python worker, in bytes; longer single texts go alone.
SLICE_BYTES = 3 << 20
#: Words whose ids a worker keeps; no result depends on it.
CACHE_WORDS = 400_000


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="signal-engine-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset an own one, but only in local runs:
    the executors of a cluster would each write to a disk of their own."""
    if path := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


class Scratch:
    """Intermediate tables of one run, written to the shared folder so that lineage ends there. They are deleted when
    the application ends, unless keep is set. settings: of the session, while a table is written."""

    def __init__(self, spark: SparkSession, name: str, keep: bool = False, settings: dict[str, str] | None = None):
        self.spark, self.root, self.settings = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", settings or {}
        if not keep:
            where = spark._jvm.org.apache.hadoop.fs.Path(self.root)
            files = where.getFileSystem(spark._jsc.hadoopConfiguration())
            files.mkdirs(where)
            files.deleteOnExit(where)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write df as Parquet and read it back; the shuffle files behind it are freed."""
        wanted = {_CLEANUP: "true", _BATCH: "2000", **self.settings}
        old = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(self.path(label))
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, label: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(label))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy(run):
    """run, a function of Arrow batches, returning what it freed to the system at the end of a task: reused Python
    workers would else keep the most that any of their tasks needed, while another operator runs."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return tidied


def as_arrow_string(column: pa.Array) -> pa.Array:
    """A string column without nulls (null becomes empty)."""
    return pc.fill_null(column, "").cast(pa.large_string())


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(from, to) row ranges of about ``limit`` bytes of text each; a longer text stands alone."""
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    end = np.cumsum(size)
    i = 0
    while i < len(size):
        base = end[i] - size[i]
        j = max(i + 1, int(np.searchsorted(end, base + limit, side="right")))
        yield i, j
        i = j
    pa.default_memory_pool().release_unused()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [starts[i], starts[i] + lengths[i])."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class WordCachedTokenizer:
    """Encode texts with a ``tokenizers`` file whose pre-tokenizer never joins across ASCII white space.

    A text is cut at ASCII white space; a chunk that is letters followed by ASCII punctuation is cut
    between the two. Each distinct part is encoded once by the library and kept in a bounded cache, and
    the ids of a text are the parts' ids in order. Chunks of any other shape are encoded as they stand.
    Texts that hold ``<|`` (which may spell a control token) are encoded whole.
    """

    PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.vocab_size = self.tok.get_vocab_size()
        self.cache_words = cache_words
        vocab = self.tok.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.word_end[i] = piece.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        if n + len(words) > len(self.start):
            self.start = np.resize(self.start, 2 * (n + len(words)))
            self.count = np.resize(self.count, 2 * (n + len(words)))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        ends = np.cumsum(counts)
        self.start[n : n + len(words)] = self.used + ends - counts
        self.count[n : n + len(words)] = counts
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        plain = np.asarray(pc.match_substring_regex(pa.array(words, pa.string()), r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"), bool)
        letters = [w for w, p in zip(words, plain, strict=True) if p]
        for i in range(0, len(letters), 4000):
            part = letters[i : i + 4000]
            found = self.tok.encode_batch_fast([" ".join(part[j : j + 500]) for j in range(0, len(part), 500)], add_special_tokens=False)
            ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in found])
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):
                raise RuntimeError("the tokenizer does not keep words apart")
            self._keep(part, ids, np.diff(ends, prepend=0))
        other = [w for w, p in zip(words, plain, strict=True) if not p]
        for i in range(0, len(other), 1000):
            part = other[i : i + 1000]
            found = [np.asarray(x.ids, np.uint32) for x in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(part, np.concatenate(found), np.asarray([len(x) for x in found], np.int64))

    def _codes(self, distinct: pa.Array) -> np.ndarray:
        words = distinct.to_pylist()
        if len(self.known) + len(words) > self.cache_words and len(self.known) > 1:
            self._clear()
        if missing := [w for w in words if w not in self.known]:
            self._learn(missing)
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        special = np.asarray(pc.match_substring(texts, "<|"), bool)
        plain = pc.ascii_lower(pc.if_else(pa.array(special), pa.scalar("", texts.type), texts)) if special.any() else pc.ascii_lower(texts)
        chunks = pc.ascii_split_whitespace(plain)
        sizes = np.diff(np.asarray(chunks.offsets)).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        distinct, where = coded.dictionary, np.asarray(coded.indices)
        stem = pc.ascii_rtrim(distinct, characters=self.PUNCTUATION)
        split = pc.match_substring_regex(stem, r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$")
        head = pc.if_else(split, stem, distinct)
        cut = pc.binary_length(head)
        tail_len = np.asarray(pc.subtract(pc.binary_length(distinct), cut))
        # rtrim only ever removes ASCII, so the tail is as many code points as bytes
        tails = [w[-n:] if n else "" for w, n in zip(distinct.to_pylist(), tail_len.tolist(), strict=True)] if tail_len.any() else [""] * len(distinct)
        parts = pa.concat_arrays([head.cast(pa.large_string()), pa.array(tails, pa.large_string())]).dictionary_encode()
        codes = self._codes(parts.dictionary)[np.asarray(parts.indices)]
        h, t = codes[: len(distinct)], codes[len(distinct) :]
        pair = np.stack([h[where], t[where]], 1).ravel()
        lengths = self.count[pair]
        ids = self.flat[ragged(self.start[pair], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(sizes)]) * 2
        counts = ends[bounds[1:]] - ends[bounds[:-1]]
        if special.any():
            pieces, at = [], np.concatenate([[0], np.cumsum(counts)])
            for i in range(len(texts)):
                own = np.asarray(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if special[i] else ids[at[i] : at[i + 1]]
                pieces.append(own)
                counts[i] = len(own)
            ids = np.concatenate(pieces)
        return ids, counts


_WORKER_CACHES: dict[str, object] = {}


def sole_cache(key: str, make):
    """The worker's one large cache: a worker that turns to another operator gives up the former one's."""
    if key not in _WORKER_CACHES:
        _WORKER_CACHES.clear()
        gc.collect()
        _trim()(0)
        _WORKER_CACHES[key] = make()
    return _WORKER_CACHES[key]


def word_tokenizer(file: str, cache_words: int = CACHE_WORDS) -> WordCachedTokenizer:
    """One tokenizer and cache per Python worker."""
    return sole_cache(f"tokenizer {cache_words} {file}", lambda: WordCachedTokenizer(file, cache_words))
