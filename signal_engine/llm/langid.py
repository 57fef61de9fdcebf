"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each letter piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, taken by a forward pass; a text's is the product
over its words. Piece probabilities are estimated by expectation-maximisation (the same forward pass with a
backward one): each round is a Spark job over the word counts of a bounded sample of labelled rows, which takes as
many rows of every label as it can; all their words count. Words are maximal runs of letters and marks, lower-cased,
of any length. The passes run in numpy over the distinct words of a batch, those of long words on logarithms; a
bounded cache in each worker keeps the log probabilities of the short ones.

Defined results: null text or text without a letter is ``und`` with score 0; so is every text when no
labelled row was given; ties go to the smaller language name; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signal_engine.llm.common import SLICE_BYTES, Scratch, as_arrow_string, slices, sole_cache, tidy

SHORT_WORD = 32  # characters up to which products of probabilities are far from underflow
CELLS = 400_000  # numbers that a pass holds at once, but for single longer words
UNKNOWN = 1e-7  # of a character that no piece covers
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def letter_pieces(file: str) -> tuple[str, ...]:
    """The vocabulary's pieces of letters and marks (a word's first piece starts with the word mark)."""
    import unicodedata

    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=file)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    letters = lambda x: all(unicodedata.category(c)[0] in "LM" for c in x)
    return tuple(sorted(p for p in found if p and letters(p.removeprefix("▁"))))


class Lattice:
    """Finds the pieces at all places of many words at once, through a rolling hash and an open hash table."""

    def __init__(self, pieces: tuple[str, ...]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.power = np.asarray([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = np.zeros(self.n, np.uint64)
        for k, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
            keys[k] = h ^ len(p)
        self.bits = max(10, int(self.n * 8).bit_length())
        self.key, self.id = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for k, slot in enumerate(self._slot(keys).tolist()):
            step = 1
            while self.id[slot] >= 0:
                slot, step = (slot + 1) & ((1 << self.bits) - 1), step + 1
            self.key[slot], self.id[slot] = keys[k], k
            self.probes = max(self.probes, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * _MIX) >> np.uint64(64 - self.bits)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys).astype(np.int64)
        found = np.full(keys.shape, self.n, np.int32)
        for _ in range(self.probes):
            hit = (self.key[slot] == keys) & (self.id[slot] >= 0)
            found[hit] = self.id[slot][hit]
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return found

    def edges(self, chars: np.ndarray) -> np.ndarray:
        """chars: words x length code points. Returns [length of piece - 1][word, start] piece numbers; n where none."""
        words, length = chars.shape
        prefix = np.zeros((words, length + 1), np.uint64)
        for t in range(length):
            prefix[:, t + 1] = prefix[:, t] * _BASE + (chars[:, t].astype(np.uint64) + np.uint64(1))
        return [self._find((prefix[:, k:] - prefix[:, :-k] * self.power[k]) ^ np.uint64(k)) for k in range(1, min(self.longest, length) + 1)]


def forward(edges: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """alpha[t][word, language]: probability of each word's first t characters. p: pieces + 1 (none) x languages."""
    words, length = edges[0].shape
    alpha = np.zeros((length + 1, words, p.shape[1]))
    alpha[0] = 1
    for t in range(1, length + 1):
        for k in range(1, min(len(edges), t) + 1):
            e = p[edges[k - 1][:, t - k]]
            alpha[t] += alpha[t - k] * (np.maximum(e, UNKNOWN) if k == 1 else e)
    return alpha


def _ends(edges: list[np.ndarray]) -> np.ndarray:
    """(length + 1) x piece lengths x words: the piece of each length that ends at each place; the last number's next where none."""
    words, length = edges[0].shape
    out = np.full((length + 1, len(edges), words), -1, np.int32)
    for k, e in enumerate(edges, 1):
        out[k : length + 1, k - 1] = e.T
    return out


def log_forward(ends: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """log alpha[t][word, language], for words of any length. logp: pieces + 1 x languages; row -1 is of no piece."""
    steps, longest, words = ends.shape
    alpha = np.full((steps, words, logp.shape[1]), -np.inf)
    alpha[0] = 0
    for t in range(1, steps):
        m = min(longest, t)
        e = logp[ends[t, :m]]
        np.maximum(e[0], np.log(UNKNOWN), out=e[0])
        e += alpha[t - m : t][::-1]
        top = e.max(0)
        alpha[t] = top + np.log(np.exp(e - top).sum(0))
    return alpha


def log_backward(ends: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """log beta[t][word, language]: of the characters from each place to the word's end."""
    steps, longest, words = ends.shape
    beta = np.full((steps, words, logp.shape[1]), -np.inf)
    beta[-1] = 0
    for t in range(steps - 2, -1, -1):
        m = min(longest, steps - 1 - t)
        lengths = np.arange(m)
        e = logp[ends[t + 1 + lengths, lengths]]
        np.maximum(e[0], np.log(UNKNOWN), out=e[0])
        e += beta[t + 1 : t + 1 + m]
        top = e.max(0)
        beta[t] = top + np.log(np.exp(e - top).sum(0))
    return beta


def _by_length(words: list[str], wide: int = 1):
    """(places, words x length code points) for the words of each length, with the word mark before each; so many at
    once that CELLS are not passed with ``wide`` numbers for each character."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(sizes, kind="stable")
    for n in np.unique(sizes).tolist():
        at = order[np.searchsorted(sizes[order], n) : np.searchsorted(sizes[order], n, side="right")]
        step = max(1, min(20_000, CELLS // (n * wide)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, np.frombuffer("".join("▁" + words[w] for w in part.tolist()).encode("utf-32-le"), "<u4").reshape(len(part), n)


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    languages: tuple[str, ...]
    p: np.ndarray  # pieces + 1 x languages; the last row is 0


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, word codes of the distinct chunks, words in each chunk, chunk codes of the texts in order, chunks in each text)."""
    chunks = pc.ascii_split_whitespace(texts)
    per_text = np.diff(np.asarray(chunks.offsets)).astype(np.int64)
    coded = chunks.flatten().dictionary_encode()
    letters = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{M}]+", " "), characters=" ")
    words = pc.ascii_split_whitespace(letters)
    counts = np.diff(np.asarray(words.offsets)).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    return flat.dictionary, np.asarray(flat.indices), counts, np.asarray(coded.indices), per_text


def log_probabilities(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """words x languages."""
    out = np.zeros((len(words), p.shape[1]))
    with np.errstate(divide="ignore"):
        logp = np.log(p) if any(len(w) > SHORT_WORD for w in words) else None
    for at, chars in _by_length(words, max(1, p.shape[1])):
        edges = lattice.edges(chars)
        out[at] = np.log(forward(edges, p)[-1]) if chars.shape[1] <= SHORT_WORD + 1 else log_forward(_ends(edges), logp)[-1]
    return out


class Scorer:
    """Log probabilities of texts in every language."""

    def __init__(self, model: Model, cache_words: int = 250_000):
        self.model, self.cache_words = model, max(1000, min(cache_words, 1_000_000 // max(1, len(model.languages))))
        self.lattice = Lattice(model.pieces)
        self.known: dict[str, int] = {"": 0}
        self.table = np.zeros((1024, len(model.languages)))

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > self.cache_words:
            self.known = {"": 0}
        if missing := [w for w in words if w not in self.known and len(w) <= SHORT_WORD]:
            n = len(self.known)
            if n + len(missing) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((n + len(missing), self.table.shape[1]))])
            self.table[n : n + len(missing)] = log_probabilities(self.lattice, self.model.p, missing)
            self.known.update(zip(missing, range(n, n + len(missing)), strict=True))
        rows = self.table[np.fromiter((self.known[w] if len(w) <= SHORT_WORD else 0 for w in words), np.int64, len(words))]
        if long := [i for i, w in enumerate(words) if len(w) > SHORT_WORD]:
            rows[long] = log_probabilities(self.lattice, self.model.p, [words[i] for i in long])
        return rows

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages log probabilities, number of words of each text)."""
        distinct, words, in_chunk, chunks, in_text = word_lists(texts)
        rows = self._rows(distinct.to_pylist())
        is_word = np.asarray(pc.binary_length(distinct)) > 0

        def sums(values, counts):
            total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0)])
            ends = np.cumsum(counts)
            return total[ends] - total[ends - counts]

        both = np.concatenate([rows, is_word[:, None]], 1)
        per_chunk = sums(both[words], in_chunk)
        out = np.zeros((len(in_text), both.shape[1]))
        ends = np.cumsum(in_text)
        for i in range(len(in_text)):  # summed text by text: equal texts get equal sums
            out[i] = per_chunk[chunks[ends[i] - in_text[i] : ends[i]]].sum(0)
        return out[:, :-1], out[:, -1].round().astype(np.int64)


def word_counts(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    distinct, words, in_chunk, chunks, _ = word_lists(texts)
    times = np.bincount(chunks, minlength=len(in_chunk))
    counts = np.bincount(words, weights=np.repeat(times, in_chunk), minlength=len(distinct)).astype(np.int64)
    names = distinct.to_pylist()
    return [w for w in names if w], counts[[i for i, w in enumerate(names) if w]]


def expected_pieces(lattice: Lattice, words: list[str], counts: np.ndarray, q: np.ndarray | None) -> np.ndarray:
    """How often each piece is expected in counted words of a language with piece probabilities q; without q, how
    often each could be used."""
    n_pieces = lattice.n + 1
    expected = np.zeros(n_pieces)
    for at, chars in _by_length(words):
        edges, weight = lattice.edges(chars), counts[at].astype(float)
        if q is None:
            for e in edges:
                expected += np.bincount(e.ravel(), weights=np.repeat(weight, e.shape[1]), minlength=n_pieces)
        elif chars.shape[1] > SHORT_WORD + 1:
            with np.errstate(divide="ignore"):
                logp = np.log(q)[:, None]
            ends = _ends(edges)
            alpha, beta = log_forward(ends, logp)[..., 0], log_backward(ends, logp)[..., 0]
            for k, e in enumerate(edges, 1):
                step = logp[e, 0].T
                if k == 1:
                    step = np.maximum(step, np.log(UNKNOWN))
                share = np.exp(alpha[: len(alpha) - k] + step + beta[k:] - alpha[-1]) * weight
                expected += np.bincount(e.T.ravel(), weights=share.ravel(), minlength=n_pieces)
        else:
            alpha = forward(edges, q[:, None])[:, :, 0]
            n = len(alpha) - 1
            beta = np.zeros_like(alpha)
            beta[n] = 1
            share = weight / alpha[n]
            for t in range(n - 1, -1, -1):
                for k in range(1, min(len(edges), n - t) + 1):
                    e = q[edges[k - 1][:, t]]
                    step = (np.maximum(e, UNKNOWN) if k == 1 else e) * beta[t + k]
                    beta[t] += step
                    expected += np.bincount(edges[k - 1][:, t], weights=alpha[t] * step * share, minlength=n_pieces)
    return expected


def maximised(expected: np.ndarray, smoothing: float) -> np.ndarray:
    """Piece probabilities (pieces + 1, the last 0) from expected counts."""
    q = expected + smoothing
    q[-1] = 0
    return q / q.sum()


def _sampled(rows: DataFrame, train_rows: int) -> DataFrame:
    """About ``train_rows`` of the rows (k, lang, t) in all, by a hash of the id: every label has the same bound, and
    labels with fewer rows give all of theirs. A label's row with the smallest hash is always taken."""
    at = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    sizes = sorted((r["n"], r["lang"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(at).alias("least")).collect())  # one row a label
    left, bound = train_rows, 0
    for i, (n, *_) in enumerate(sizes):
        bound = max(1, left // (len(sizes) - i))
        if n > bound:
            break
        left -= n
    rates = [(lang, max(least + 1, int((1 << 30) * min(1.0, bound / n)))) for n, lang, least in sizes]
    if all(r >= 1 << 30 for _, r in rates):
        return rows
    # one row a label; from an Arrow table, as a list would start Python workers of its own on the executors
    table = pa.table({"lang": pa.array([x for x, _ in rates], pa.string()), "rate": pa.array([n for _, n in rates], pa.int64())})
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), "lang").where(at < F.col("rate")).drop("rate")


_UNIT = 1 << 20  # parts of an expected count, which are added up exactly: every run gets the same model


def fit(labelled: DataFrame, vocabulary_file: str, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = 4_000, rounds: int = 4, smoothing: float = 0.02) -> Model:
    """Fit on a bounded sample of about ``train_rows`` labelled rows, chosen by a hash of the id; all labels are
    learned, from all words of the sampled rows. Rows without a label or id take no part."""
    scratch = Scratch(labelled.sparkSession, "langid")
    rows = labelled.select(F.col(id_col).alias("k"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")).where("lang IS NOT NULL AND k IS NOT NULL")
    sample = _sampled(rows, train_rows)
    names = tuple(sorted(r["lang"] for r in sample.select("lang").distinct().collect()))
    pieces = letter_pieces(vocabulary_file)

    def count(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            texts = as_arrow_string(batch.column(1))
            for code, name in enumerate(langs.dictionary.to_pylist()):
                own = texts.filter(pc.equal(langs.indices, code))
                for i, j in slices(own):
                    words, counts = word_counts(own[i:j])
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(words), pa.string()), "word": pa.array(words, pa.string()), "n": pa.array(counts)})

    counted = scratch.write(sample.select("lang", "t").mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    code = {name: i for i, name in enumerate(names)}
    p = np.zeros((len(pieces) + 1, len(names)))
    for r in range(rounds + 1 if names else 0):
        shared = labelled.sparkSession.sparkContext.broadcast(None if r == 0 else p)

        def expect(batches, shared=shared):
            lattice, total = Lattice(pieces), {}
            for batch in batches:
                langs = batch.column(0).dictionary_encode()
                for at, name in enumerate(langs.dictionary.to_pylist()):
                    own = pc.equal(langs.indices, at)
                    q = None if shared.value is None else shared.value[:, code[name]]
                    found = expected_pieces(lattice, batch.column(1).filter(own).to_pylist(), np.asarray(batch.column(2).filter(own)), q)
                    total[name] = total.get(name, 0) + np.rint(found * _UNIT).astype(np.int64)
            for name, found in total.items():
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(found[used])], ["lang", "piece", "n"])

        parts = counted.mapInArrow(tidy(expect), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        found = parts.toArrow()  # at most the numbers of the model
        expected = np.zeros_like(p)
        expected[np.asarray(found["piece"]), [code[x] for x in found["lang"].to_pylist()]] = np.asarray(found["n"]) / _UNIT
        p = np.stack([maximised(expected[:, i], smoothing) for i in range(len(names))], 1)
        shared.unpersist()
    return Model(pieces, names, p)


def _model_key(model: Model) -> str:
    return f"{model.languages}-{float(model.p.sum()):.12f}-{float((model.p**2).sum()):.15e}"


def _scorer(key: str, shared, cache_words: int = 250_000) -> Scorer:
    """The worker's scorer of a broadcast model; its word cache outlives the task."""
    return sole_cache(f"scorer {cache_words} {key}", lambda: Scorer(shared.value, cache_words))


def _decide(scorer: Scorer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language number, posterior) of each text; the number after the last language is undetermined."""
    logs, words = scorer.score(texts)
    n = logs.shape[1]
    if n == 0:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts))
    best = np.where(words > 0, logs.argmax(1), n)
    return best, np.where(words > 0, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0.0)


def _slice_bytes(model: Model, limit: int = SLICE_BYTES) -> int:
    """Text handled at once: less with many languages, as every word has a number for each."""
    return max(1 << 14, min(limit, 4 * limit // max(1, len(model.languages))))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the most probable language of every text and its posterior under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = _model_key(model)

    def score(batches):
        scorer = _scorer(key, shared)
        names = np.asarray([*scorer.model.languages, UNDETERMINED], object)
        for batch in batches:
            texts = as_arrow_string(batch.column(1))
            for i, j in slices(texts, _slice_bytes(scorer.model)):
                best, top = _decide(scorer, texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(names[best], pa.string()), pa.array(top)], ["k", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(score), f"k {kind}, lang_pred string, score double").withColumnRenamed("k", id_col)


def keep_languages(docs: DataFrame, model: Model, languages: set[str] | None = None, min_score: float = 0.5, text_col: str = "text", cache_words: int = 250_000, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows, as they are, whose text has a language: not undetermined, of the wanted ``languages`` (null: any)
    and with at least ``min_score``. Rows pass through whole, so nothing is joined back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = _model_key(model)

    def run(batches):
        scorer = _scorer(key, shared, cache_words)
        names = [*scorer.model.languages, UNDETERMINED]
        wanted = np.asarray([n != UNDETERMINED and (languages is None or n in languages) for n in names])
        for batch in batches:
            texts = as_arrow_string(batch.column(text_col))
            for i, j in slices(texts, _slice_bytes(scorer.model, slice_bytes)):
                best, top = _decide(scorer, texts[i:j])
                yield batch.slice(i, j - i).filter(pa.array(wanted[best] & (top >= min_score)))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: CRC-32 of its id as text is divisible by 5 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
