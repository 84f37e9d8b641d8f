"""Byte-level BPE encoding and decoding through a generated sentencepiece model (operator 5).

The model is serialised directly from a vocabulary of byte strings and ranks: every byte becomes one stand-in
character, every token one piece of such characters whose score is its negative rank, and normalisation is the
identity. Merging the best-scored pair first is then merging the lowest rank first. Texts are split by the
vocabulary's pre-token pattern and each pre-token is encoded separately. Decoding maps ids back to their bytes.

Work is per row, in Arrow batches, without a shuffle. The model is of the vocabulary's fixed size and is the
only thing broadcast. A worker remembers a bounded number of chunks (see ``pretokens``).

Defined cases: a null text counts as empty and gives no ids; rows keep their number, also with repeated or null
``doc_id``; strings that look like special tokens are ordinary text; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from roster.llm.pretokens import ChunkEncoder
from roster.llm.shared import slices

#: Stand-in characters for the bytes 0 to 255 (letters of one Unicode range, no spaces among them).
FIRST_STAND_IN = 0x100


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank; ranks must be 0 to n - 1."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} aren't 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def stand_ins(data: bytes) -> str:
    return "".join([chr(FIRST_STAND_IN + b) for b in data])


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece BPE model. Piece ids are ranks; the unknown piece, never used, comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=stand_ins(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


@lru_cache(maxsize=2)
def _encoder(model: bytes, pattern: str) -> ChunkEncoder:
    import regex
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    split = regex.compile(pattern).findall

    def encode(pieces: list[str]) -> list[bytes]:
        split_up = [split(p) for p in pieces]
        ids = processor.encode([stand_ins(t.encode()) for s in split_up for t in s], num_threads=1)
        out, at = [], 0
        for s in split_up:
            out.append(np.array([i for one in ids[at:at + len(s)] for i in one], dtype="<u4").tobytes())
            at += len(s)
        return out

    return ChunkEncoder(encode)


def _lists(values: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) // 4 for v in values], out=offsets[1:])
    flat = np.frombuffer(b"".join(values), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def bpe_encode(docs: DataFrame, model: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, ids). ``model`` is a broadcast of ``model_bytes``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(encode(part.column(1).to_pylist()))], names=["doc_id", "ids"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, tokens: Broadcast) -> DataFrame:
    """(doc_id, ids, bytes) for (doc_id, ids): the inverse mapping. ``tokens`` is a broadcast of ``read_ranks``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(t) for t in tokens.value], dtype=np.int64)
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(tokens.value), dtype=np.uint8)
        for batch in batches:
            for part in slices(batch, 1, size=1 << 20):
                lists = part.column(1)
                ids = lists.flatten().to_numpy()
                sizes = size[ids]
                ends = np.cumsum(sizes)
                data = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[ids] - ends + sizes, sizes)]
                at_id = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                offsets = np.concatenate([[0], ends])[at_id].astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, made], names=["doc_id", "ids", "bytes"])
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")
