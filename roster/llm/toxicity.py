"""Toxicity scores of deobfuscated text (operator 2).

Disguised words are restored first, by a noisy channel. A token with a look-alike, a separator, a doubled letter or letters
of two scripts becomes a lattice: each character may stand for itself, for letters it resembles (leetspeak, other
scripts), or for nothing (separators); a run of equal letters may stand for one or two; between single characters set
apart by spaces the space may be kept or dropped. Viterbi decoding finds the likeliest path under a character trigram
model, the plain reading among them. Other tokens have one path and pass unchanged.

The trigram model is counted over all documents (in the tasks, then summed by trigram), over a fixed alphabet, so what
reaches the driver is bounded by the alphabet. The classifier works on the restored text: how often each word and each
beginning of a word occurs there, against what is usual in clean text. It is fitted on at most ``SAMPLE`` labelled
documents of at most ``MAX_BYTES`` bytes, those with the smallest hash of their id; the ``FEATURES`` features that
separate the classes best are found by a grouped aggregate. Every document is scored, whole, without a shuffle.

Defined cases: null and empty texts get the score of a text without any feature; without usable labels every score
is 0; a document labelled more than once counts as toxic if any label says so; null labels are ignored; rows that repeat
a ``doc_id`` are scored each by its own text; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import pin, slices

SAMPLE = 10_000
MAX_BYTES = 20_000
FEATURES = 1500
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

#: What a character may stand for in leetspeak.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
    "€": "e", "£": "l", "¥": "y",
}
#: Letters of other scripts that look like Latin ones; read so only in tokens that also hold Latin letters.
OTHER_SCRIPTS = dict(zip("авеікмнорстухѕјһԁԛԝαβεικνορτυχ", "abeikmhopctyxsjhdqwabeikvoptux", strict=True))
SEPARATORS = ".-_~'"
_SPACED = re.compile(r" \S \S \S(?: \S)*(?= )")      # in a line set between spaces
_WORD = re.compile(r"[^\W\d_]+")
_TAIL = re.compile(r"[!.,;:?\"')\]}*]+$|([^\w\s])\1\1+$")
_HEAD = re.compile(r"^[\"'(\[{*]+")
_RUN = re.compile(r"([a-zß-ÿ])\1|([^\W\d_])\2\2")
_SYMBOL = "[" + re.escape("".join(LOOKS_LIKE)) + "]"
_DISGUISED = re.compile(rf"{_SYMBOL}|[{re.escape(SEPARATORS)}]")
_LETTER = re.compile(r"[^\W\d_]")
_ALL_SYMBOLS = re.compile(rf"(?!\d+$)(?!(.)\1*$){_SYMBOL}{{3,}}$")
_LATIN = re.compile(r"[a-zß-ÿ]")
_OTHER = re.compile("[" + "".join(OTHER_SCRIPTS) + "]")
_NO_WORD = re.compile(r"@.*\.|/|=|\d{4}|[0-9a-f]{16}", re.IGNORECASE)

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
SIZE = len(LETTERS) + 1         # number 0: the space, and whatever isn't a letter
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}
_LUT = np.array([_NUMBER.get(chr(c).lower(), 0) for c in range(256)], dtype=np.int64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts, as a cube."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    x = _LUT[np.frombuffer(f"  {text or ''} ".encode("latin-1", "replace"), dtype=np.uint8)]
                    np.add.at(total, (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    cube = np.zeros(SIZE ** 3, dtype=np.int64)
    for row in docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        cube[row.gram] = row.n
    return cube.reshape(SIZE, SIZE, SIZE)


class Channel:
    """Restores disguised words by Viterbi decoding under a trigram model with interpolated shorter contexts."""

    # Log costs of the channel.
    DROP, SWAP, KEEP_SPACE = -1.0, -0.5, -2.0
    KEEP_SYMBOL, KEEP_OTHER, KEEP_SEPARATOR, DROP_SEPARATOR, DROP_DOUBLE = -8.0, -12.0, -1.0, -2.0, -9.0

    def __init__(self, counts: np.ndarray):
        tri = counts.astype(float) + 0.0
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + SIZE)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest string; each place of the lattice offers strings with their channel cost."""
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for place in lattice:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, trace) in paths.items():
                for out, cost in place:
                    x, y, s = a, b, score + cost
                    for c in out:
                        n = _NUMBER.get(c, 0)
                        s += self.log[x][y][n]
                        x, y = y, n
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = (s, (trace, out) if out else trace)
            paths = new
        _, trace = max(((s + self.log[a][b][0], trace) for (a, b), (s, trace) in paths.items()), key=lambda path: path[0])
        outs = []
        while trace:
            trace, out = trace
            outs.append(out)
        return "".join(reversed(outs))

    def _places(self, symbols: str) -> list[list[tuple[str, float]]]:
        """The lattice of a token: what each run of equal characters may stand for."""
        places: list[list[tuple[str, float]]] = []
        latin = bool(_LATIN.search(symbols))
        for c, run in groupby(symbols):
            n = len(list(run))
            likely, keep = LOOKS_LIKE.get(c, ""), self.KEEP_SYMBOL
            if latin and c in OTHER_SCRIPTS:
                likely, keep = OTHER_SCRIPTS[c], self.KEEP_OTHER
            if c in SEPARATORS:
                place = [("", self.DROP_SEPARATOR), (c * n, self.KEEP_SEPARATOR)]
            elif likely:
                one = self.SWAP + (self.DROP_DOUBLE if n == 2 else 0.0)
                place = [(x, one) for x in likely] + [(c * n, keep)]
                if n > 1:
                    place += [(x + y, self.SWAP) for x in likely for y in likely]
            elif n > 2:
                place = [(c, 0.0), (c * 2, 0.0)]
            elif n == 2 and c in _NUMBER:
                place = [(c * 2, 0.0), (c, self.DROP_DOUBLE)]
            else:
                place = [(c * n, 0.0)]
            if len(place) == 1 and places and len(places[-1]) == 1:
                places[-1] = [(places[-1][0][0] + place[0][0], 0.0)]
            else:
                places.append(place)
        return places

    def token(self, token: str) -> str:
        """A lower-case token's restored form, or the token itself."""
        if is_plain(token):
            return token
        core = _TAIL.sub("", _HEAD.sub("", token))
        if _NO_WORD.search(core) or is_plain(core):
            return core
        if _LETTER.search(core) if _DISGUISED.search(core) else not core.isascii() or _RUN.search(core):
            return self.decode(self._places(core))
        return self.decode(self._places(core)) if _ALL_SYMBOLS.match(core) else core

    def spaced(self, run: str) -> str:
        """Single characters set apart by spaces, put together to words again."""
        symbols = run.split(" ")
        if len(set(symbols)) < 3:
            return run
        places: list[list[tuple[str, float]]] = []
        for i, c in enumerate(symbols):
            if i:
                places.append([("", self.DROP), (" ", self.KEEP_SPACE)])
            places += self._places(c)
        return self.decode(places)


def is_plain(token: str) -> bool:
    """Whether a lower-case token is a word without doubled letters and look-alikes of another script."""
    return token.isalpha() and not _RUN.search(token) and (token.isascii() or not (_OTHER.search(token) and _LATIN.search(token)))


def features(word: str) -> list[str]:
    """The word and its beginnings of three and four letters."""
    return [word, *(f"{word[:k]}…" for k in (3, 4) if len(word) > k)]


class Tokens(dict):
    """What ``make`` gives for the words of a token, remembered for a bounded number of tokens."""

    def __init__(self, channel: Channel, make: Callable[[list[str]], object], limit: int = 300_000):
        super().__init__()
        self.channel, self.make, self.limit = channel, make, limit

    def __missing__(self, token: str) -> object:
        lower = token.lower()
        plain = lower.rstrip(".,")
        found = self.make([plain] if is_plain(plain) else _WORD.findall(self.channel.token(lower)))
        if len(self) < self.limit and len(token) < 48:
            self[token] = found
        return found


class Reader:
    """Reads texts as tokens, spaced-out words put together."""

    def __init__(self, channel: Channel):
        self.channel, self.words = channel, Tokens(channel, lambda words: words)

    def _joined(self, line: str) -> str:
        return _SPACED.sub(lambda m: " " + self.channel.spaced(m[0][1:].lower()), f" {line} ")

    def restored(self, text: str) -> str:
        """The lower-cased text with disguised words restored."""
        lines = (self._joined(line)[1:-1] for line in text.split("\n"))
        return re.sub(r"\S+", lambda m: self.channel.token(m[0].lower()), "\n".join(lines))

    def tokens(self, text: str) -> Counter:
        return Counter(self._joined(text.replace("\n", "  ")).split())

    def counts(self, text: str) -> tuple[Counter, int]:
        """How often each word occurs in the restored text, and the number of words."""
        out: Counter = Counter()
        for token, n in self.tokens(text).items():
            for word in self.words[token]:
                out[word] += n
        return out, out.total()


def shares(counts: Counter, total: int) -> dict[str, float]:
    """Feature values: the share of the words, to the power of 3/4."""
    found: Counter = Counter()
    for word, n in counts.items():
        for f in features(word):
            found[f] += n
    return {f: (n / total) ** 0.75 for f, n in found.items()}


@dataclass
class Model:
    counts: np.ndarray                  # of letter trigrams
    weight: dict[str, tuple[float, float, float]]     # by feature: weight, usual value, spread
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        reader, weight = Reader(Channel(self.counts)), self.weight
        absent = {f: w * _standard(0.0, usual, spread) for f, (w, usual, spread) in weight.items()}
        base = self.bias + sum(absent.values())
        known = Tokens(reader.channel, lambda words: (len(words), [f for w in words for f in features(w) if f in weight]))

        def score(text: str | None) -> float:
            found: dict[str, int] = {}
            total = 0
            for token, n in reader.tokens(text or "").items():
                size, own = known[token]
                total += n * size
                for f in own:
                    found[f] = found.get(f, 0) + n
            z = base
            for f, n in found.items():
                w, usual, spread = weight[f]
                z += w * _standard((n / total) ** 0.75, usual, spread) - absent[f]
            return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))

        return score


def _standard(value: float, usual: float, spread: float) -> float:
    return min(5.0, max(-3.0, (value - usual) / spread))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_bytes: int = MAX_BYTES,
          top: int = FEATURES) -> Model | None:
    """The model of (doc_id, toxic) rows of ``labels``; None without both classes."""
    counts = char_counts(docs)
    usable = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .join(docs.filter(F.octet_length("text") <= max_bytes).select("doc_id").distinct(), "doc_id"))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows.
    texts = pin(docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes)
                .join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]), "toxicity-sample").repartition(48)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Reader(Channel(counts)), {}
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for f, v in shares(*reader.counts(text)).items():
                    at = found.setdefault(f, [0.0] * 6)
                    k = 3 * (toxic == 1)
                    at[k] += 1
                    at[k + 1] += v
                    at[k + 2] += v * v
        rows = list(zip(*found.values(), strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(r, pa.float64()) for r in rows)],
                                         names=["feature", "n0", "s0", "q0", "n1", "s1", "q1"])

    n = {row.toxic == 1: row["count"] for row in texts.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    if len(n) < 2:
        return None
    names = ["n0", "s0", "q0", "n1", "s1", "q1"]
    sums = (texts.mapInArrow(moments, "feature string, " + ", ".join(f"{c} double" for c in names))
            .groupBy("feature").agg(*[F.sum(c).alias(c) for c in names]).filter("n0 >= 4 OR n1 >= 4"))
    sums = sums.selectExpr("feature", f"s0 / {n[False]} AS m0", f"s1 / {n[True]} AS m1", f"q0 / {n[False]} AS e0", f"q1 / {n[True]} AS e1")
    z = f"abs(m1 - m0) / sqrt((e1 - m1 * m1 + 1e-8) / {n[True]} + (e0 - m0 * m0 + 1e-8) / {n[False]})"
    best = sums.withColumn("z", F.expr(z)).filter("z > 3").orderBy(F.desc("z"), "feature").limit(top).collect()
    scale = {r.feature: (r.m0, float(np.sqrt(max(r.e0 - r.m0 ** 2, 0) + 0.1 * max(r.e1 - r.m1 ** 2, 0)) + 2e-3)) for r in best}
    column = {f: i for i, f in enumerate(scale)}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Channel(counts))
        for batch in batches:
            found = [[(column[f], v) for f, v in shares(*reader.counts(t)).items() if f in column] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[c for c, _ in r] for r in found], pa.list_(pa.int32())),
                 pa.array([[v for _, v in r] for r in found], pa.list_(pa.float64())), batch.column(2).cast(pa.int64())],
                names=["columns", "values", "toxic"])

    usual, spread = (np.array(x, dtype=np.float32) for x in zip(*scale.values(), strict=True)) if scale else (np.zeros(0),) * 2
    x, y = np.zeros((sum(n.values()), len(column)), dtype=np.float32), np.zeros(sum(n.values()), dtype=np.float32)
    for i, row in enumerate(texts.mapInArrow(rows, "columns array<int>, values array<double>, toxic long").toLocalIterator()):
        x[i, row["columns"]], y[i] = row["values"], row.toxic == 1
    weight, bias = _logistic(np.clip((x - usual) / spread, -3, 5) if len(column) else x, y)
    return Model(counts, {f: (float(w), *scale[f]) for f, w in zip(column, weight, strict=True)}, bias)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.003, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps of adapted length."""
    w, b = np.zeros(x.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    size = np.full(len(w) + 1, 1e-8)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ w.astype(np.float32) + b))) - y
        g = np.append(error @ x / len(y) + l2 * w, error.mean())
        size += g * g
        step = 0.1 * g / np.sqrt(size)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per input row: doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([scorer(t) for t in part.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def restore(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, restored): every text in lower case with disguised words restored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Channel(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.restored(t or "") for t in batch.column(1).to_pylist()])],
                                             names=["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, restored string")
