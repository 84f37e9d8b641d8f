"""Sequence packing as vector bin packing (operator 7).

Every example is tokenised, ended with an end id, and cut into pieces of at most ``tokens`` ids. Pieces are
placed into sequences under three limits at once: tokens, number of segments, and tokens that bear loss. A
sequence is filled greedily: of the pieces that still fit, the one whose demand vector has the largest dot
product with the sequence's remaining capacities, less half its own square, goes in next, until none fits. Demands and
capacities are fractions of the limits. Pieces that fill a sequence alone are emitted at once; the others wait in a pool.

Each task packs its own partition, in pools of at most ``pool`` pieces, so memory is bounded, nothing is
shuffled, and only the last sequences of a pool are left with much padding. ``sequence_id`` is the partition's
number times 2**32 plus a count. A repeated task packs the same rows again; a sequence never spans tasks.

Loss-bearing ids: all but the first of an example (nothing precedes it); with a ``prompt`` column, the ids of
``text`` and the end id, but not those of the prompt.

Defined cases: a null or empty text gives the end id alone; rows that repeat a ``doc_id`` are packed as examples
of their own; a null ``doc_id`` stays null; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from roster.llm.shared import slices

END_ID = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


def token_bytes(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ids by token bytes of a byte-level vocabulary, whose strings have a printable character for every byte: the
    printable ones of Latin-1 for themselves, then from U+0100 on for the others in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}


@lru_cache(maxsize=2)
def tokenizer(path: str, special: bool = True) -> Callable[[list[str | None]], list[bytes]]:
    """Ids of a byte-level BPE ``tokenizers`` file, little-endian unsigned 32 bits (null: none). A string of a special token in a text gives that token, as in the library
    unless told otherwise; with ``special`` false it is ordinary text.

    Such a file's ids are in the order of its merges, so they serve as ranks of the faster ``tiktoken`` encoder, which
    gives the same ids; the file is refused if it is of another kind."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = token_bytes({t: i for t, i in model["vocab"].items() if t not in added})
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    step = file["pre_tokenizer"]
    if (model["type"], step["type"], step["add_prefix_space"], file["normalizer"]) != ("BPE", "ByteLevel", False, None) or \
            merged != sorted(merged) or len(merged) + 256 != len(ranks) or any(" " in t or not t for t in added) or \
            any(t[flag] for t in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} isn't a plain byte-level BPE file with ids in the order of merges")
    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    allowed = "all" if special else set()

    def encode(texts: list[str | None]) -> list[bytes]:     # one call a text: words of their own cost more than the encoder
        found = (encoding.encode_to_numpy(t or "", allowed_special=allowed, disallowed_special=()) for t in texts)
        return [ids.astype("<u4", copy=False).tobytes() for ids in found]

    return encode


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Sequences as lists of piece numbers. Pieces of equal demand are interchangeable and taken in order."""
    if not len(tokens):
        return []
    kinds, which = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True)
    waiting = [[] for _ in kinds]
    for i, k in enumerate(which.reshape(-1)):
        waiting[k].append(i)
    left = np.array([len(w) for w in waiting])
    for w in waiting:
        w.reverse()
    t, x = kinds[:, 0], kinds[:, 1]
    ft, fx, fs = t / limits.tokens, x / limits.loss, 1 / limits.segments
    half = (ft ** 2 + fx ** 2 + fs ** 2) / 2
    out, todo = [], int(left.sum())
    while todo:
        room_t, room_x, room_s, seq = limits.tokens, limits.loss, limits.segments, []
        while room_s:
            fits = (left > 0) & (t <= room_t) & (x <= room_x)
            dot = ft * (room_t / limits.tokens) + fx * (room_x / limits.loss) + fs * (room_s / limits.segments) - half
            dot = np.where(fits, dot, -np.inf)
            k = int(dot.argmax())
            if not fits[k]:
                break
            seq.append(waiting[k].pop())
            left[k] -= 1
            room_t, room_x, room_s = room_t - int(t[k]), room_x - int(x[k]), room_s - 1
        if not seq:
            raise ValueError("a piece exceeds the limits on its own")
        out.append(seq)
        todo -= len(seq)
    return out


def _pieces(ids: bytes, no_loss: int, limits: Limits) -> Iterator[tuple[int, bytes, int]]:
    """(start, ids, loss-bearing ids) of an example's pieces, none over the limits."""
    n, at = len(ids) // 4, 0
    while at < n:
        size = min(limits.tokens, n - at)
        silent = max(0, min(size, no_loss - at))
        size = min(size, silent + limits.loss)
        yield at, ids[4 * at:4 * (at + size)], max(0, size - silent)
        at += size


SCHEMA = "start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), prompt: str | None = None, pool: int = 8192,
         encoder: Callable[[str], Callable[[list], list[bytes]]] = tokenizer) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, loss_tokens,
    sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", *([docs[prompt].alias("prompt")] if prompt else []))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number, doc_type = TaskContext.get().partitionId() << 32, None

        def rows(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for seq in sequences:
                at = 0
                for doc_id, start, ids, total, loss in seq:
                    out.append((doc_id, start, len(ids) // 4, ids, total, loss, number, at))
                    at += len(ids) // 4
                number += 1
            cols = list(zip(*out, strict=True))
            kinds = [doc_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def packed(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
            tokens = np.array([len(p[2]) // 4 for p in waiting])
            loss = np.array([p[4] for p in waiting])
            found = [[waiting[i] for i in seq] for seq in place(tokens, loss, limits)]
            for at in range(0, len(found), 1024):
                yield rows(found[at:at + 1024])

        full: list[list[tuple]] = []
        waiting: list[tuple] = []
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for part in slices(batch, 1):
                ids_of = [encode(c.to_pylist()) for c in part.columns[1:]]
                leads = ids_of[1] if prompt else [b""] * part.num_rows
                for doc_id, body, lead in zip(part.column(0).to_pylist(), ids_of[0], leads, strict=True):
                    ids = lead + body + end
                    for start, piece, loss in _pieces(ids, len(lead) // 4 or 1, limits):
                        row = (doc_id, start, piece, len(ids) // 4, loss)
                        if len(piece) == 4 * limits.tokens:
                            full.append([row])
                        else:
                            waiting.append(row)
                    if len(full) >= 1024:
                        yield rows(full)
                        full = []
                    if len(waiting) >= pool:
                        yield from packed(waiting)
                        waiting = []
        if full:
            yield rows(full)
        yield from packed(waiting)

    return docs.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
