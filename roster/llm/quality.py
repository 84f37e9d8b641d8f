"""Quality rules from repetition coverage (operator 4).

Per text, in numpy: words are numbered by first appearance, and a rolling polynomial hash over those numbers
(64 bits, wrapping) gives the n-grams of several lengths without building them. For every length the characters
inside n-grams that occur more than once are measured (overlapping ones count once), and so are the characters
of lines that repeat an earlier line. A text is rejected when one of these shares is over its limit, or by the
two base rules (too few words; too many words in repeated three-word windows).

Work is per row in Arrow batches, without a shuffle; whole texts are read, of any length.

Defined cases: a null or empty text has no words and fails; repeated rows are judged alike, each on its own;
further columns are ignored. Words are runs of anything but ASCII white space, lines are split at newlines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roster.llm.shared import slices

SYMBOLS = "#*$%&|<>"
#: Largest share of a text's word characters inside repeated n-grams, by n, and inside repeated lines: a little over what
#: clean documents reach that pass the base rules (of 3,243 such documents the largest shares are 0.28 and 0.14).
GRAM_LIMITS = {5: 0.32, 6: 0.31, 7: 0.30, 8: 0.30, 9: 0.29, 10: 0.28}
LINE_LIMIT = 0.18
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


_DROP_SPACES = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), dtype=np.uint8))


def _inside(first: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` words lie in one of the n-grams that begin where ``first`` is true."""
    steps = np.zeros(words + 1, dtype=np.int32)
    at = np.flatnonzero(first)
    steps[at] += 1
    steps[at + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def repeated(codes: np.ndarray) -> np.ndarray:
    """Which codes occur twice or more, the first included."""
    order = np.argsort(codes)
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(codes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def rolling_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of every n-gram: a wrapping polynomial over mixed word numbers; for three words of fewer
    than 2**21 different ones the numbers themselves, so the base rule on windows is exact."""
    size = len(numbers) - n + 1
    if n == 3 and int(numbers.max()) < 1 << 21:
        return (numbers[:size] << np.uint64(42)) | (numbers[1:size + 1] << np.uint64(21)) | numbers[2:]
    mixed = (numbers + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    h = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        h = h * _BASE + mixed[k:size + k]
    return h


def measure(text: str, lengths: Iterable[int] = tuple(GRAM_LIMITS)) -> dict:
    """The base figures of a text, and the share of word characters in repeated n-grams (by n) and lines."""
    data = text.encode()
    words = data.split()
    n_words = len(words)
    n_symbols = int(_SYMBOL[np.frombuffer(data, dtype=np.uint8)].sum())
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            size = len(line.translate(_DROP_SPACES))
            dup_lines += size > 0
            dup_chars += size
        else:
            seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=n_words)
    sizes = np.fromiter((len(w.decode()) for w in numbers), dtype=np.int64, count=len(numbers))
    chars = sizes[ids.astype(np.int64)] if n_words else sizes
    word_chars = int(chars.sum())
    repeat_words, shares, some = 0, {}, True
    for n in sorted({3, *lengths}):
        inside = None
        if some and n_words >= n:      # without a repeated n-gram there is no longer one either
            first = repeated(rolling_hashes(ids, n))
            some = bool(first.any())
            inside = _inside(first, n, n_words) if some else None
        if n == 3 and inside is not None:
            repeat_words = int(inside.sum())
        shares[n] = 0.0 if inside is None else float(chars[inside].sum()) / word_chars
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": repeat_words, "gram_shares": [shares[n] for n in lengths],
            "line_share": dup_chars / word_chars if word_chars else 0.0}


def quality(docs: DataFrame, gram_limits: Mapping[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT,
            min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """One row per input row: doc_id, the base figures, gram_shares (in order of ``gram_limits``), line_share,
    base_failed, and kept."""
    lengths, limits = tuple(sorted(gram_limits)), [gram_limits[n] for n in sorted(gram_limits)]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [measure(t or "", lengths) for t in part.column(1).to_pylist()]
                failed = [m["n_words"] < min_words or 100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"]
                          for m in found]
                kept = [not f and m["line_share"] <= line_limit
                        and all(s <= top for s, top in zip(m["gram_shares"], limits, strict=True))
                        for m, f in zip(found, failed, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([m[c] for m in found], pa.int64()) for c in counts],
                     pa.array([m["gram_shares"] for m in found], pa.list_(pa.float64())),
                     pa.array([m["line_share"] for m in found], pa.float64()), pa.array(failed), pa.array(kept)],
                    names=["doc_id", *counts, "gram_shares", "line_share", "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, gram_shares array<double>, line_share double, "
             "base_failed boolean, kept boolean")
