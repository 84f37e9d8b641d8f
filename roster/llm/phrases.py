"""Benchmark decontamination by a distributed positional inverted index (operator 13).

``build_index`` cuts the training texts into segments (up to ``SEGMENT`` bytes of text, longer texts in several pieces) and
stores every segment's postings: for each of its distinct words the places where it occurs, as rising numbers. The
index is sharded by text, so that a word that fills a third of the corpus is spread over all segments.

``search`` looks for phrases (lists of words). In each segment a phrase's words are taken from the rarest to the most
frequent: the postings of the rarest, less its offset in the phrase, are the candidate starts, and each further list,
adjusted by its offset, is intersected with them until none is left or all words are found. A phrase with a word that the
segment lacks ends there. With ``slop`` above 0 every word may stand up to that many places from its offset (proximity).
Nothing but the narrow results is shuffled. Phrases go to the segments in blocks of at most ``BLOCK`` bytes, which are
broadcast; further blocks read the index again, so the benchmark may be of any size.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. The pieces of a long text
overlap by ``OVERLAP`` words on both sides, and each counts hits among its own words only.

Defined cases: null texts have no words; rows that repeat a doc_id, or have none, are rows of their own; items without words
have no phrases; rows of one item_id are one item, and a null item_id is an item listed as an empty string. Phrases longer
than ``OVERLAP`` + 1 words are refused. Empty tables give an empty result or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import pin

WINDOW = 10
OVERLAP = 31                # words; phrases may have one more
SEGMENT = 4 << 20           # bytes of text in a segment
BLOCK = 16 << 20            # bytes of phrases that are broadcast at once

_LETTERS = bytes(range(97, 123)) + bytes(range(48, 58)) + bytes(range(128, 256))
#: Bytes of words as they are, A-Z in lower case, all others as blanks. Bytes beyond ASCII belong to characters beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _parts(data: bytes) -> Iterator[list[bytes]]:
    """A folded text's words in lists of about ``SEGMENT`` bytes of text, and of ``OVERLAP`` words at least but for the last."""
    at, held = 0, []
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):                 # cut at the last blank, or behind a word that fills the part
            cut = data.rfind(b" ", at, end)
            cut = cut if cut >= 0 else data.find(b" ", end)
            end = cut + 1 if cut >= 0 else len(data)
        held += data[at:end].split()
        at = end
        if len(held) >= OVERLAP:
            yield held
            held = []
    if held:
        yield held


def _pieces(data: bytes) -> Iterator[tuple[list[bytes], int, int, int]]:
    """(words, how many of them lead in, how many are the piece's own, those of the text before them) of a folded text; every
    text has a piece."""
    if len(data) <= SEGMENT:
        found = data.split()
        yield found, 0, len(found), 0
        return
    before, now, base = [], [], 0
    for part in _parts(data):
        if now:
            yield before + now + part[:OVERLAP], len(before), len(now), base
            base += len(now)
            before = (before + now)[-OVERLAP:]
        now = part
    yield before + now, len(before), len(now), base


@dataclass
class _Segment:
    """Postings in the making. Places number the words of the segment's pieces, with a gap of ``OVERLAP`` + 1 between pieces,
    so that no phrase reaches over."""
    rows: list[tuple]           # per piece: rid, doc_id, first place, lead, own, base
    words: list[bytes]
    at: list[int]               # per piece: index of its first word in words
    size: int = 0

    def add(self, rid: int, doc_id: object, found: list[bytes], lead: int, own: int, base: int) -> None:
        first = len(self.words) + len(self.rows) * (OVERLAP + 1)
        self.rows.append((rid, doc_id, first, lead, own, base))
        self.at.append(len(self.words))
        self.words += found
        self.size += sum(map(len, found)) + len(found)

    def postings(self) -> tuple[list[bytes], bytes]:
        """The distinct words, and for each the number of its places and the places, as differences."""
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids = np.fromiter(map(number.__getitem__, self.words), dtype=np.int32, count=len(self.words))
        piece = np.zeros(len(ids), dtype=np.int64)
        for at in self.at[1:]:
            if at < len(piece):
                piece[at] += 1
        places = np.arange(len(ids)) + np.cumsum(piece) * (OVERLAP + 1)
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(number)).astype("<u4")
        steps = np.diff(places[order], prepend=0)
        starts = np.concatenate([[0], np.cumsum(counts[:-1].astype(np.int64))]) if len(counts) else np.zeros(0, np.int64)
        steps[starts] = places[order][starts]
        return list(number), zstandard.compress(counts.tobytes() + steps.astype("<u4").tobytes(), 1)


def unpack(n_words: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, places): the places of word i are places[bounds[i]:bounds[i + 1]]."""
    data = np.frombuffer(zstandard.decompress(packed), dtype="<u4").astype(np.int64)
    counts, steps = data[:n_words], data[n_words:]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = np.cumsum(steps)
    base = np.where(bounds[:-1] > 0, total[bounds[:-1] - 1], 0) if n_words else np.zeros(0, np.int64)
    return bounds, total - np.repeat(base, counts)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment, written once: rid, doc_id, first, lead, own, base (arrays with an entry a piece: the number of its
    row, its first place, the words that lead in, its own words, the text's words before them), words and postings."""
    kind = docs.schema[doc_id].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(docs.schema[doc_id].dataType)
    lists = [("rid", pa.int64()), ("doc_id", key), ("first", pa.int64()), ("lead", pa.int64()), ("own", pa.int64()),
             ("base", pa.int64())]

    def stored(segment: _Segment) -> pa.RecordBatch:
        found, packed = segment.postings()
        columns = list(zip(*segment.rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [*(pa.array([c], pa.list_(t)) for c, (_, t) in zip(columns, lists, strict=True)), pa.array([b" ".join(found)], pa.binary()),
             pa.array([len(found)], pa.int64()), pa.array([packed], pa.binary())],
            names=[n for n, _ in lists] + ["words", "n_words", "postings"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment([], [], [])
        for batch in batches:
            for i in range(batch.num_rows):
                rid, name, value = (batch.column(c)[i].as_py() for c in range(3))
                for piece in _pieces((value or "").encode("utf-8", "surrogatepass").translate(_FOLD)):
                    segment.add(rid, name, *piece)
                    if segment.size >= SEGMENT:
                        yield stored(segment)
                        segment = _Segment([], [], [])
        if segment.rows:
            yield stored(segment)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return pin(rows.mapInArrow(run, f"rid array<long>, doc_id array<{kind}>, first array<long>, lead array<long>, own array<long>, "
                                    "base array<long>, words binary, n_words long, postings binary"), "index")


# ---------------------------------------------------------------- phrases

def windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, phrase): the distinct phrases of each item, all ``size`` consecutive words, or all words of an item that has
    fewer; a phrase is its words joined by blanks, as bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(value)
                if found:
                    phrases = {b" ".join(found[i:i + size]) for i in range(max(1, len(found) - size + 1))}
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(phrases), pa.string()), pa.array(list(phrases), pa.binary())],
                                                     names=["item_id", "phrase"])

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, "item_id string, phrase binary").distinct()


@dataclass(frozen=True)
class _Phrases:
    """A block of phrases: their numbers, their words as rows of word numbers (-1 beyond the end), and the words."""
    number: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    vocabulary: list[bytes]


def _block(rows: Sequence[tuple[int, bytes]]) -> _Phrases:
    split = [p.split() for _, p in rows]
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    lengths = np.array([len(p) for p in split], dtype=np.int64)
    table = np.full((len(split), int(lengths.max())), -1, dtype=np.int64)
    for i, phrase in enumerate(split):
        table[i, :len(phrase)] = [number[w] for w in phrase]
    return _Phrases(np.array([n for n, _ in rows], dtype=np.int64), table, lengths, list(number))


def matches(phrases: _Phrases, vocabulary: Sequence[bytes], bounds: np.ndarray, places: np.ndarray,
            slop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of a phrase, its starts) in one segment: offset-adjusted lists are intersected from the rarest word on."""
    here = {w: i for i, w in enumerate(vocabulary)}
    local = np.array([here.get(w, -1) for w in phrases.vocabulary] + [-2], dtype=np.int64)
    table = local[phrases.words]                        # words the segment lacks are -1, places beyond the end -2
    counts = np.diff(bounds)
    for i in np.flatnonzero(~(table == -1).any(axis=1)):
        terms = table[i, :phrases.lengths[i]]
        starts = None
        for o in np.argsort(counts[terms], kind="stable"):
            at = places[bounds[terms[o]]:bounds[terms[o] + 1]] - o
            if starts is None:
                starts = at if slop == 0 else np.unique((at[:, None] + np.arange(-slop, slop + 1)).ravel())
            else:
                near = np.minimum(np.searchsorted(at, starts - slop), len(at) - 1)
                starts = starts[(at[near] >= starts - slop) & (at[near] <= starts + slop)]
            if not len(starts):
                break
        if len(starts):
            yield int(i), starts


def _search(index: DataFrame, phrases: object, slop: int) -> DataFrame:
    """(rid, doc_id, n_words, spans, phrases): per piece the text's words up to its end, the stretches of its own words inside
    a match (begin, end: words of the text), and the numbers of the phrases that touch them. ``phrases``: a broadcast block."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = index.schema["doc_id"].dataType.elementType
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("spans", span),
                        ("phrases", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = phrases.value
        for batch in batches:
            for i in range(batch.num_rows):
                rid, name, first, lead, own, base = (batch.column(c)[i].values for c in range(6))
                first, lead, own, base = (c.to_numpy() for c in (first, lead, own, base))
                found = batch.column(6)[i].as_py().split(b" ") if batch.column(7)[i].as_py() else []
                bounds, places = unpack(len(found), batch.column(8)[i].as_py())
                begin = first + lead                    # a piece's own words: begin to end
                end = begin + own
                size = int(end[-1]) + 2 * OVERLAP
                change = np.zeros(size + 1, dtype=np.int64)
                met: dict[int, set[int]] = defaultdict(set)
                for p, starts in matches(block, found, bounds, places, slop) if block is not None else ():
                    low, high = np.maximum(starts - slop, 0), np.minimum(starts + block.lengths[p] + slop, size)
                    np.add.at(change, low, 1)
                    np.add.at(change, high, -1)
                    piece = np.searchsorted(first, starts + slop, side="right") - 1
                    for k in np.unique(piece[(low < end[piece]) & (high > begin[piece])]):
                        met[int(k)].add(int(block.number[p]))
                inside = np.cumsum(change) > 0 if met else change
                spans: list[list[dict]] = [[] for _ in first]
                for k in met:
                    edges = np.flatnonzero(np.diff(inside[begin[k]:end[k]].astype(np.int8), prepend=0, append=0)) + base[k]
                    spans[k] = [{"begin": b, "end": e} for b, e in edges.reshape(-1, 2).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [rid, name, pa.array(base + own), pa.array(spans, span), pa.array([sorted(met.get(k, ())) for k in range(len(first))],
                                                                                      pa.list_(pa.int64()))], schema=schema)

    return index.mapInArrow(run, f"rid long, doc_id {kind.simpleString()}, n_words long, spans array<struct<begin: long, end: long>>, "
                                 "phrases array<long>")


def _numbered(phrases: DataFrame) -> DataFrame:
    """(number, block, phrase) of the distinct phrases, in blocks of bounded size, written once."""
    spark = phrases.sparkSession
    total = phrases.agg(F.sum(F.length("phrase") + 64)).first()[0] or 0     # with the size of a row of word numbers
    n_blocks = max(1, -(-int(total) // BLOCK))
    each = phrases.select(F.monotonically_increasing_id().alias("number"), F.pmod(F.xxhash64("phrase"), F.lit(n_blocks)).alias("block"), "phrase")
    return pin(each, "phrases") if total else spark.createDataFrame([], "number long, block long, phrase binary")


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Where the phrases (a column ``phrase``, as ``windows`` makes it) occur: one row per indexed row with rid, doc_id, n_words,
    spans (stretches of words inside matches, begin and end, in order; those of several pieces or blocks may overlap) and
    phrases (the numbers of those that occur); and (number, phrase)."""
    spark = index.sparkSession
    longest = phrases.agg(F.max(F.size(F.split(F.col("phrase").cast("string"), " ")))).first()[0] or 0
    if longest + 2 * slop > OVERLAP + 1:
        raise ValueError(f"a phrase of {longest} words with a slop of {slop}: pieces overlap by {OVERLAP} words")
    listed = _numbered(phrases.select("phrase").distinct())
    blocks = [r.block for r in listed.select("block").distinct().collect()]     # a block holds BLOCK bytes or so
    parts = []
    for b in blocks or [None]:
        rows = [(r.number, bytes(r.phrase)) for r in listed.filter(F.col("block") == b).collect()] if blocks else []
        parts.append(_search(index, spark.sparkContext.broadcast(_block(rows) if rows else None), slop))
    found = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("phrases"))).alias("phrases"))
    return found, listed.select("number", "phrase")


def covered(spans: Column) -> Column:
    """How many words sorted spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(seen: Column, span: Column) -> Column:
        new = F.greatest(span["end"] - F.greatest(span["begin"], seen["upto"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(seen["upto"], span["end"]).alias("upto"), (seen["n"] + new).alias("n"))

    return F.aggregate(spans, start, add, lambda seen: seen["n"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside a match), items (sorted ids of the items with a phrase
    that occurs) and spans."""
    owned = pin(windows(items, size), "windows")
    found, listed = search(build_index(docs), owned, slop)
    found = pin(found, "matches")
    by_phrase = owned.join(listed, "phrase").select("number", "item_id")
    named = (found.filter(F.size("phrases") > 0).select("rid", F.explode("phrases").alias("number")).join(by_phrase, "number")
             .groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return found.join(named, "rid", "left").select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
