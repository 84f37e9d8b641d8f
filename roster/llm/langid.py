"""Language identification by prediction with partial matching (operator 6).

For every language a tree of byte contexts up to ``ORDER`` bytes long holds how often each byte followed each
context. The statistics are frozen, so a text's code length is a plain sum over its bytes: with n occurrences
of a context, d different followers and c of the byte in question, the longest known context codes the byte with
probability c / (n + d) if it followed there before, else escapes with probability d / (n + d) to the next shorter
context; an unknown context is skipped at no cost; below the empty context every byte has probability 1/256. The
language with the shortest code wins, and the score is its posterior under equal priors, computed from the code
lengths.

The trees of all languages are kept together as arrays: one sorted table per order of the strings (context and
byte) that some language knows, each with every language's complete code length, escapes included, and one per
order of the contexts with every language's escape length. A byte then takes one lookup at the longest order
for all languages; only bytes of strings that no language knows go on to shorter ones.

The model is fitted on at most ``SAMPLE`` documents of at most ``MAX_BYTES`` bytes of each of the ``LANGUAGES`` most frequent
languages, those with the smallest hash of their id, so its size doesn't depend on the table; it is collected and
broadcast. Rows are counted by language first, and only those below a bound on the hash that some four times ``SAMPLE`` rows
pass are ranked, so that no task ranks a language. Every document is scored, whole, in Arrow batches without a shuffle; a
text's code length is added up by blocks of ``BLOCK`` bytes.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, or a model without languages; ties
go to the language that sorts first; rows that repeat a ``doc_id`` are judged each by its own text; an empty table
gives an empty result; texts are lower-cased; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from roster.llm.shared import slices

ORDER = 4
SAMPLE = 400
MAX_BYTES = 20_000
LANGUAGES = 256
BLOCK = 1 << 20
UNKNOWN = "und"
FOLDS = 5


def held_out() -> Column:
    """Rows that training must not see: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def codes(data: np.ndarray, size: int) -> np.ndarray:
    """For every end position from ``size`` - 1 on, the last ``size`` bytes as one number."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out << np.uint64(8)) | data[k:n + k]
    return out


_FREE = np.iinfo(np.uint64).max


class Table:
    """Rows of floats by 64-bit key: an open-addressing table, at most a quarter full, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.rows = rows
        self.keys = np.full(1 << bits, _FREE, dtype=np.uint64)
        self.at = np.zeros(1 << bits, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free, first = np.unique(np.where(self.keys[slot] == _FREE, slot, -1), return_index=True)
            first = first[free >= 0]
            self.keys[slot[first]], self.at[slot[first]] = keys[todo[first]], todo[first]
            rest = np.ones(len(todo), dtype=bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def add_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the rows of the known keys, and the positions of the unknown ones."""
        slot = self._home(keys)
        held = self.keys.take(slot)
        other = np.flatnonzero(held != keys)
        found, unknown = slot, other
        if len(other):
            keep = np.ones(len(keys), dtype=bool)
            keep[other] = False
            found, lost = [slot[keep]], []
            while len(other):
                gone = held[other] == _FREE
                lost.append(other[gone])
                other = other[~gone]
                slot[other] = (slot[other] + 1) & self.mask
                held[other] = self.keys.take(slot[other])
                hit = held[other] == keys[other]
                found.append(slot[other[hit]])
                other = other[~hit]
            found, unknown = np.concatenate(found), np.concatenate(lost)
        rows = self.rows.take(self.at.take(found), axis=0)
        return np.ones(len(rows)) @ rows, unknown


@dataclass
class Model:
    languages: list[str]
    strings: list[Table]    # by order: code lengths in bits of known strings of order + 1 bytes
    contexts: list[Table]   # by order: escape lengths in bits of known contexts of order bytes

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of the bytes in every language."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(data), BLOCK):
            before = data[at - ORDER:at] if at else np.zeros(ORDER, np.uint8)       # the first bytes have no context
            block = np.concatenate([before, data[at:at + BLOCK]]).astype(np.uint64)
            total += self._block_bits(codes(block, ORDER + 1), 0 if at else ORDER)
        return total

    def _block_bits(self, windows: np.ndarray, heads: int) -> np.ndarray:
        """Code length of the last byte of every window; the byte of one of the first ``heads`` windows, number k, has k bytes
        of context."""
        total, left = np.zeros(len(self.languages)), windows[heads:]
        for k in range(ORDER, -1, -1):
            if k < heads:
                left = np.concatenate([left, windows[k:k + 1]])
            known, unknown = self.strings[k].add_up(left & np.uint64((1 << (8 * k + 8)) - 1))
            left = left[unknown]
            escaped, _ = self.contexts[k].add_up((left >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1))
            total += known + escaped
        return total + 8.0 * len(left)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.bits(np.frombuffer(text.lower().encode(), dtype=np.uint8))
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(bits[best] - bits).sum())


def fit(samples: dict[str, list[str]]) -> Model:
    """The model of the sample texts of every language."""
    languages = sorted(samples)
    texts = {x: [np.frombuffer(t.lower().encode(), dtype=np.uint8).astype(np.uint64) for t in samples[x]] for x in languages}
    strings, contexts, lower = [], [], None
    for k in range(ORDER + 1):
        counts = {}
        for x in languages:
            found = [codes(t, k + 1) for t in texts[x]]
            counts[x] = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        keys = np.unique(np.concatenate([counts[x][0] for x in languages] or [np.zeros(0, np.uint64)]))
        heads = np.unique(keys >> np.uint64(8))
        cost, escape = np.zeros((len(keys), len(languages))), np.zeros((len(heads), len(languages)))
        for i, x in enumerate(languages):
            own, c = counts[x]
            head = np.searchsorted(heads, own >> np.uint64(8))
            n = np.bincount(head, weights=c, minlength=len(heads))
            d = np.bincount(head, minlength=len(heads))
            seen = n > 0
            escape[seen, i] = -np.log2(d[seen] / (n[seen] + d[seen]))
            at = np.searchsorted(heads, keys >> np.uint64(8))
            shorter = np.full(len(keys), 8.0) if k == 0 else lower(keys & np.uint64((1 << (8 * k)) - 1))[:, i]
            cost[:, i] = escape[at, i] + shorter
            mine = np.searchsorted(keys, own)
            cost[mine, i] = -np.log2(c / (n + d)[head])
        strings.append(Table(keys, cost))
        contexts.append(Table(heads, escape))
        lower = (lambda q, keys=keys, cost=cost: cost[np.searchsorted(keys, q)])
    return Model(languages, strings, contexts)


def train(labelled: DataFrame, sample: int = SAMPLE, max_bytes: int = MAX_BYTES) -> Model:
    """The model of (doc_id, text, lang) rows; the sample is bounded by both parameters."""
    rows = labelled.filter(F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # The smallest hashes of a language of n rows, some four samples of them.
    place = (F.xxhash64("doc_id") / F.lit(2.0 ** 64) + 0.5).alias("place")
    low = rows.select("doc_id", "lang", place).join(F.broadcast(sizes), "lang").filter(F.col("place") * F.col("n") <= 4 * sample)
    by_hash = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = low.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= sample)
    # At most ``sample`` ids a language.
    drawn = rows.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    texts: dict[str, list[str]] = {}
    for row in drawn.select("lang", "text").toLocalIterator():
        texts.setdefault(row.lang, []).append(row.text)
    return fit(texts)


def identify(docs: DataFrame, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns named in ``carry``, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.select("doc_id", *carry, F.col("text").alias("text to identify"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                found = [shared.value.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    names=["doc_id", *carry, "lang_pred", "score"])

    schema = StructType([*text.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return text.mapInArrow(run, schema)
