"""Secret scanning through a trigram index (operator 3).

Rules are regular expressions. For each one a Boolean query over trigrams is derived from its parse tree: the
trigrams that any match must contain, joined by AND along the expression and by OR between alternatives. The
index holds postings (trigram, ids) in segments of ``SEGMENT`` documents, as a search index does; a rule's
candidates come from intersecting and uniting postings within each segment, and only candidates are verified
with the expression itself. A rule without a mandatory trigram is run on every document.

Only trigrams that occur in some rule's query get postings, as no other posting would ever be read; with
``vocabulary=None`` the index holds all trigrams. ASCII letters are folded in the index, so a query never misses
a match because of case. The index is written to the shared checkpoint folder; candidates (rule numbers per
document) meet the texts in a shuffle join, which is the only movement of texts. Segments bound every array.

Defined cases: a null text counts as empty; rows that repeat a ``doc_id`` are each verified on their own text
against the candidates of all of them; null ids match null ids; an empty table gives an empty result; further
columns are ignored. Matches are leftmost, without overlaps within a rule; those shorter than a rule's minimum are
dropped after matching. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roster.llm.shared import pin, slices

SEGMENT = 1024


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int          # the group whose length counts
    least: int          # its least number of characters

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(self.pattern, text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The contracted kinds, in their order.
BASE_RULES = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),       # runs of [0-9a-f]+ of 24 or more
)
# A private key goes to its END line; one that another BEGIN or a further END cuts short, or the end of the text, goes to
# the end of its base64: tokens that are long, padded, or end their line, after header fields, with whatever sets lines
# apart in mails, program text and JSON (there also "\n" and "\/" as two characters each) in between.
_BETWEEN = r"""(?:\s|\\+[nrt/]|["'`,;>#*|+]|//|<br\ ?/?>)*+"""
_FIELD = r"Proc-Type: ?\d,[A-Z-]++|DEK-Info: ?[A-Z0-9-]++,[0-9A-Fa-f]++"
_BASE64 = r"""[A-Za-z0-9+/]++(?:={1,2}|(?<=[A-Za-z0-9+/]{20})|(?=[ \t]*+(?:["'`<\r\n]|\\+[nr/]|\Z)))"""
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"

#: Further kinds.
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|(?:{_BETWEEN}(?:{_FIELD}|{_BASE64}))*+)", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

# A query is None (no mandatory trigram), a trigram (three bytes as a number), or ("and" | "or", parts).
Query = None | int | tuple


def _all_of(parts: Iterable[Query]) -> Query:
    kept = tuple(dict.fromkeys(p for p in parts if p is not None))
    return kept[0] if len(kept) == 1 else ("and", kept) if kept else None


def _any_of(parts: Sequence[Query]) -> Query:
    parts = tuple(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _trigrams(word: str) -> Query:
    data = word.encode()
    return _all_of(int.from_bytes(data[i:i + 3]) for i in range(len(data) - 2))


def _words(node) -> list[str] | None:
    """The exact strings an element stands for, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return [chr(arg).lower() if arg < 128 else chr(arg)]
    if op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
        return sorted({chr(a).lower() for _, a in arg})
    return None


def _query(elements) -> Query:
    """The trigrams mandatory in a sequence of parsed elements."""
    found: list[Query] = []
    runs = [""]          # the exact strings that may end here

    def flush() -> None:
        nonlocal runs
        found.append(_any_of([_trigrams(r) for r in runs]))
        runs = [""]

    for node in elements:
        op, arg = node
        words = _words(node)
        if words is not None and len(words) * len(runs) <= 16:
            runs = [r + w for r in runs for w in words]
            continue
        if op is sre.SUBPATTERN and len(arg[3]) == 1 and arg[3][0][0] is sre.LITERAL:
            runs = [r + w for r in runs for w in _words(arg[3][0])]
            continue
        if op is sre.MAX_REPEAT and arg[:2] == (0, 1) and (words := _words(arg[2][0])) and len(arg[2]) == 1 and len(runs) <= 8:
            runs = [r + w for r in runs for w in ["", *words]]
            continue
        flush()
        if op is sre.SUBPATTERN:
            found.append(_query(arg[3]))
        elif op is sre.BRANCH:
            found.append(_any_of([_query(b) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            found.append(_query(arg[2]))
    flush()
    return _all_of(found)


def derive(rule: Rule) -> Query:
    return _query(parser.parse(rule.pattern))


def leaves(query: Query) -> set[int]:
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(leaves, query[1]))


def answer(query: Query, postings: dict[int, np.ndarray]) -> np.ndarray:
    """The documents (positions in a segment, sorted) that satisfy the query."""
    if isinstance(query, int):
        return postings.get(query, np.zeros(0, np.int64))
    op, parts = query
    found = [answer(p, postings) for p in parts]
    if op == "or":
        return np.unique(np.concatenate(found))
    found.sort(key=len)
    out = found[0]
    for other in found[1:]:
        out = np.intersect1d(out, other, assume_unique=True)
    return out


_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IDS = -1           # the pseudo-trigram whose row lists a segment's document ids


def trigrams_of(text: str) -> np.ndarray:
    """Codes of the text's byte trigrams, A-Z folded, with repeats."""
    data = np.frombuffer(text.encode().translate(_FOLD), dtype=np.uint8).astype(np.int32)
    return (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]


def build_index(docs: DataFrame, vocabulary: Iterable[int] | None, segment: int = SEGMENT) -> DataFrame:
    """(segment, trigram, positions, ids): postings of the vocabulary (None: of every trigram) by segment."""
    words = None if vocabulary is None else np.array(sorted(vocabulary), dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        if words is not None:
            numbered = np.zeros(1 << 24, dtype=np.int32)
            numbered[words] = np.arange(1, len(words) + 1)
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, 1, segment, 32 << 20):
                found, where = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    codes = trigrams_of(text or "")
                    if words is None:
                        own = np.unique(codes)
                    else:
                        own = words[np.flatnonzero(np.bincount(numbered[codes], minlength=len(words) + 1)[1:])]
                    found.append(own)
                    where.append(np.full(len(own), i))
                grams, position = np.concatenate(found), np.concatenate(where)
                order = np.argsort(grams, kind="stable")
                keys, starts = np.unique(grams[order], return_index=True)
                lists = np.split(position[order], starts[1:]) if len(keys) else []
                size = len(keys) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * size, pa.int64()), pa.array([*keys.tolist(), _IDS], pa.int32()),
                     pa.array([*(x.tolist() for x in lists), []], pa.list_(pa.int32())),
                     pa.array([*[None] * len(keys), part.column(0).to_pylist()], pa.list_(kind))],
                    names=["segment", "trigram", "positions", "ids"])
                number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"segment long, trigram int, positions array<int>, ids array<{kind}>")


def candidates(index: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(doc_id, rules): a bit for each query that a document satisfies; documents without any are left out."""
    needed = sorted({_IDS}.union(*map(leaves, queries)))
    kind = index.schema["ids"].dataType.elementType

    def run(rows: pa.Table) -> pa.Table:
        trigram, positions, ids = (rows.column(c).to_pylist() for c in ("trigram", "positions", "ids"))
        postings = {t: np.array(p, dtype=np.int64) for t, p in zip(trigram, positions, strict=True) if t != _IDS}
        own = ids[trigram.index(_IDS)]
        mask = np.zeros(len(own), dtype=np.int64)
        for bit, query in enumerate(queries):
            if query is not None:
                mask[answer(query, postings)] |= 1 << bit
        hit = np.flatnonzero(mask)
        return pa.table({"doc_id": pa.array([own[i] for i in hit], rows.schema.field("ids").type.value_type),
                         "rules": pa.array(mask[hit])})

    found = (index.filter(F.col("trigram").isin(needed)).groupBy("segment")
             .applyInArrow(run, f"doc_id {kind.simpleString()}, rules long"))
    return found.groupBy("doc_id").agg(F.bit_or("rules").alias("rules"))


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, text, the columns named in ``carry``, and spans, an array of (kind, start,
    end) ordered by start, then by the order of the rules."""
    queries = [derive(r) for r in rules]
    index = pin(build_index(docs, set().union(*map(leaves, queries))), "trigram-index")
    marked = candidates(index, queries).withColumnRenamed("doc_id", "marked_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    joined = (texts.join(marked, F.col("doc_id").eqNullSafe(F.col("marked_id")), "left")
              .select("doc_id", "text", "carry", F.coalesce("rules", F.lit(0)).alias("rules")))
    always = sum(1 << bit for bit, q in enumerate(queries) if q is None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, 1):
                found = []
                for text, mask in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    mask |= always
                    spans = sorted((s, bit, e) for bit, r in enumerate(rules) if mask >> bit & 1 for s, e in r.spans(text))
                    found.append([{"kind": rules[bit].kind, "start": s, "end": e} for s, bit, e in spans])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, kind)], names=["doc_id", "text", "carry", "spans"])

    spans = StructType.fromDDL("spans array<struct<kind:string,start:bigint,end:bigint>>")
    schema = StructType([*joined.schema.fields[:3], *spans.fields])
    return joined.mapInArrow(run, schema).select("doc_id", "text", *[F.col("carry")[c].alias(c) for c in carry], "spans")


def redact(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``scan``'s rows with every span in the text replaced by ``mask`` (overlapping spans by one)."""
    gaps = F.expr("""aggregate(spans, struct(0L AS at, cast(array() AS array<string>) AS parts),
        (a, s) -> CASE WHEN s.start >= a.at AND s.end > a.at
                       THEN struct(s.end AS at, array_append(a.parts, substring(text, int(a.at) + 1, int(s.start - a.at))) AS parts)
                       ELSE struct(greatest(a.at, s.end) AS at, a.parts AS parts) END)""")
    done = F.concat(F.array_join(F.array_append("gaps.parts", F.lit("")), mask), F.expr("substring(text, int(gaps.at) + 1)"))
    names = scanned.columns
    return (scanned.withColumn("gaps", F.when(F.size("spans") > 0, gaps))
            .select(*[F.coalesce(done, F.col("text")).alias("text") if c == "text" else F.col(c) for c in names]))
