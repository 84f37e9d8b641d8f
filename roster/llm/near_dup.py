"""MinHash near-dedup by a chosen-path set similarity join (operator 8).

A document is the set of its distinct five-word shingles. Documents with equal sets are one class from the start
and only a representative goes on. Representatives are branched by minwise tokens: every node of a tree chooses
coordinates of the MinHash signature by a hash of its own number, more than 1/threshold of them on average, and
sends each member to the child named by its value there. Similar documents follow the same paths; others part.

* A node of up to ``SMALL`` members and ``WEIGHT`` shingles is compared exhaustively: first signatures (pairs far below the threshold go),
  then the full shingle sets of the groups that remain. Groups met again in other nodes are compared once.
* In a larger node every member is compared with the node's first in the same two steps, and the node branches on. Between
  levels one table of labels takes in the new links (``merged``), and a node whose members share a label needs no further
  work; this ends the recursion in dense groups, of whatever size, without comparing all their pairs. Labels may be finer
  than components, which costs work but no link. Components are computed once, from all links.
* A node that is still large after ``LEVELS`` levels is compared completely, block by block.

The threshold gives the number of trees, how often nodes choose a second coordinate, and the least number of equal
coordinates (``tuning``; at 85 percent 12, 0.5 and 39, at 80 percent 14, 0.59 and 34). Signatures reject a link at the
threshold with 6e-7 at 85 and 3e-7 at 80 percent. In nodes of level 0 trees miss it with less than 1e-10. Deeper
down the trees' misses are not independent, as all draw from one signature: averaged over how many of its values agree,
1.9e-6 at 5 levels, 1.3e-5 at 8, 4.4e-5 at 12 and 1.2e-4 at 20 for 85 percent (2.5e-6, 2.2e-5, 8.8e-5 and 3.0e-4 for 80),
unless other members join the two. Every link is confirmed on full sets. Only (node, row) numbers are
shuffled for the trees; signatures and sets join in for rows that meet others. Texts move once, for those sets.

Defined cases: null, empty or white texts have no shingles and stay alone; shorter texts than five words are one
shingle of all their words; rows that repeat a ``doc_id`` are rows of their own; ``component_id`` is the smallest
doc_id of the component, null only if all are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.llm.components import components
from roster.llm.shared import pin, slices

WORDS = 5
PERCENT = 85
COORDINATES = 64
MISS = 4e-8             # of all trees together, at any depth, were they independent
REJECTED = 1e-6         # most links at the threshold that signatures may reject
SMALL = 2500            # members of a node that is compared exhaustively,
WEIGHT = 2_000_000      # and their shingles
LEVELS = 20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Tuning:
    trees: int
    second: float       # how often a node chooses a second coordinate
    equal: int          # least number of equal coordinates for a closer look


@lru_cache
def tuning(percent: int) -> Tuning:
    """What a threshold asks for. A node has 1.275/threshold children on average, two at most; a link at the threshold is
    lost in a tree with the least root of q = u (1 - second + second u), u = 1 - threshold (1 - q)."""
    if not 50 < percent <= 100:
        raise ValueError(f"a threshold of {percent} percent: links of 50 or less die out in trees of two choices a node")
    s, second = percent / 100, min(1.0, 127.5 / percent - 1)
    q = 0.0
    for _ in range(10_000):
        u = 1 - s * (1 - q)
        q = u * (1 - second + second * u)
    equal, below = 0, 0.0
    while equal < COORDINATES:
        below += math.comb(COORDINATES, equal) * s ** equal * (1 - s) ** (COORDINATES - equal)
        if below > REJECTED:
            break
        equal += 1
    return Tuning(math.ceil(math.log(MISS) / math.log(q)) if q else 1, second, equal)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACES = b" \t\n\x0b\x0c\r"
_SALT = mix(np.arange(1000, 1000 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, of which a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 300_000 and len(word) < 64:
            self[word] = h
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. Long texts are read in blocks cut at white space."""
    data = (text or "").encode().translate(_FOLD)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        found = data[at:end].split()
        parts.append(np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found)))
        at = end
    h = np.concatenate(parts) if len(parts) != 1 and parts else parts[0] if parts else np.zeros(0, np.uint64)
    size = min(words, len(h))
    if not size:
        return h
    out = h[:len(h) - size + 1] + np.uint64(size)
    for k in range(1, size):
        out = out * _M3 + h[k:len(h) - size + 1 + k]
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signature(s: np.ndarray) -> np.ndarray:
    """The lower 32 bits of every coordinate's smallest scrambled shingle (the upper ones of a minimum tell little)."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, at:at + 4096] * _SALT[:, None]).min(axis=1))
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def choices(nodes: np.ndarray, often: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's first coordinate, its second, and whether it uses the second."""
    h = mix(nodes ^ _M2)
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    return first, second, (h >> np.uint64(40)).astype(np.float64) / (1 << 24) < often


def children(nodes: np.ndarray, sigs: np.ndarray, often: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of (node, signature) rows, and the row of each."""
    first, second, twice = choices(nodes, often)
    rows = np.arange(len(nodes))
    made, of = [], []
    for coordinate, own in ((first, rows), (second, rows[twice])):
        c = coordinate[own]
        made.append(mix(mix(nodes[own] + c.astype(np.uint64) + np.uint64(1)) ^ sigs[own, c].astype(np.uint64)))
        of.append(own)
    return np.concatenate(made), np.concatenate(of)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, COORDINATES)


def _rooted(batches: Iterable[pa.RecordBatch], tuned: Tuning) -> Iterator[pa.RecordBatch]:
    roots = mix(np.arange(1, tuned.trees + 1, dtype=np.uint64))
    for batch in batches:
        if batch.num_rows:
            rid, size, sigs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _sigs(batch.column(2))
            for root in roots:
                nodes, of = children(np.full(len(rid), root), sigs, tuned.second)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(rid[of]), pa.array(size[of])],
                                                 names=["node", "rid", "size"])


def _branched(batches: Iterable[pa.RecordBatch], tuned: Tuning) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, rid, size = (batch.column(i).to_numpy() for i in range(3))
            nodes, of = children(node.view(np.uint64), _sigs(batch.column(3)), tuned.second)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(rid[of]), pa.array(size[of])],
                                             names=["node", "rid", "size"])


def _like_head(batches: Iterable[pa.RecordBatch], tuned: Tuning) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            equal = (_sigs(batch.column(2)) == _sigs(batch.column(3))).sum(axis=1)
            close = pa.array(equal >= tuned.equal)
            yield batch.select([0, 1]).filter(close)


def _groups(linked: np.ndarray) -> np.ndarray:
    """The number of the first member of each row's component in a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(table: pa.Table, tuned: Tuning) -> pa.Table:
    """The groups of a node whose signatures may be similar enough: (cluster, rid), named by their members."""
    rid, label = table.column("rid").to_numpy(), table.column("label").to_numpy()
    sigs = _sigs(table.column("sig").combine_chunks() if table.num_rows else table.column("sig"))
    order = np.argsort(rid)
    rid, label, sigs = rid[order], label[order], sigs[order]
    near = np.zeros((len(rid), len(rid)), dtype=bool)
    for i in range(len(rid)):
        near[i] = (sigs[i] == sigs).sum(axis=1) >= tuned.equal
    group = _groups(near)
    names, rows = [], []
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        if len(own) > 1 and len(np.unique(label[own])) > 1:
            name = int.from_bytes(hashlib.blake2b(rid[own].tobytes(), digest_size=8).digest(), "little", signed=True)
            names += [name] * len(own)
            rows += rid[own].tolist()
    return pa.table({"cluster": pa.array(names, pa.int64()), "rid": pa.array(rows, pa.int64())})


class _Sets:
    """A group's shingle sets as postings of the shingles that several of them hold."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], dtype=np.int64)
        owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
        by_token = np.argsort(flat, kind="stable")
        owner, flat = owner[by_token], flat[by_token]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        column = np.cumsum(new) - 1
        common = np.bincount(column)[column] > 1        # a token of one document alone is in no intersection
        self.n, self.size = len(sets), size
        self.owner, self.column = owner[common], np.cumsum(new & common)[common] - 1
        self.width = int(self.column[-1]) + 1 if len(self.column) else 0
        self.starts = np.searchsorted(self.column, np.arange(self.width + 1))
        by_owner = np.argsort(self.owner, kind="stable")
        self.tokens = self.column[by_owner]
        self.bounds = np.searchsorted(self.owner[by_owner], np.arange(self.n + 1))

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x with y."""
        if len(x) <= 4:             # few: their tokens' postings are counted
            out = np.empty((len(x), self.n), dtype=np.int64)
            for i, k in enumerate(x):
                lists = [self.owner[self.starts[t]:self.starts[t + 1]] for t in self.tokens[self.bounds[k]:self.bounds[k + 1]]]
                out[i] = np.bincount(np.concatenate(lists), minlength=self.n) if lists else 0
            return out[:, y]
        out = np.zeros((len(x), len(y)), dtype=np.float32)
        for at in range(0, self.width, 2048):           # many: matrix products, a stretch of tokens at a time
            end = min(self.width, at + 2048)
            part = slice(self.starts[at], self.starts[end])
            has = np.zeros((self.n, end - at), dtype=np.float32)
            has[self.owner[part], self.column[part] - at] = 1
            out += has[x] @ has[y].T
        return np.rint(out).astype(np.int64)


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links that hold a group's similar documents together (to the first of each component), on full sets.

    Breadth first: a block of newly reached documents is compared with all that are not reached yet; two that are
    in one component already are not compared."""
    rid = table.column("rid").to_numpy()
    order = np.argsort(rid)
    rid, packed = rid[order], table.column("shingles").to_pylist()
    sets = _Sets([np.frombuffer(packed[i], dtype="<u8") for i in order])
    size, first = sets.size, np.full(len(rid), -1)
    for start in range(len(rid)):
        if first[start] >= 0:
            continue
        first[start], reached = start, [start]
        while reached:
            block, reached = np.array(reached[:256]), reached[256:]
            rest = np.flatnonzero(first < 0)
            if not len(rest):
                break
            common = sets.shared(block, rest)
            near = (100 * common >= percent * (size[block][:, None] + size[rest][None, :] - common)).any(axis=0)
            first[rest[near]] = start
            reached += rest[near].tolist()
    own = np.flatnonzero(first != np.arange(len(rid)))
    return pa.table({"a": pa.array(rid[first[own]]), "b": pa.array(rid[own])})


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_shingles, set_hash, sig) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                n, name, sig = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text)
                    n.append(len(s))
                    name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n, pa.int64()), pa.array(name, pa.binary()),
                                                  pa.array(sig, pa.binary())],
                                                 names=["doc_id", "version", "n_shingles", "set_hash", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(
        run, f"doc_id {kind}, version long, n_shingles long, set_hash binary, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, shingles) of the wanted rows (rid, doc_id, version), computed again from their texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rid", "shingles"])

    wanted = wanted.select("rid", F.col("doc_id").alias("wanted_id"), F.col("version").alias("wanted_version"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    # The wanted rows grow with the input: a shuffle join at every size.
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("version") == F.col("wanted_version"))
    found = texts.join(wanted.hint("shuffle_merge"), same).select("rid", "text")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["rid"])
    return found.mapInArrow(run, "rid long, shingles binary")


def _work(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, rid) groups to compare: clusters with the same smallest member are put together where that keeps to the
    limits of a node; the others stay as they are."""
    heads = clusters.groupBy("cluster").agg(F.min("rid").alias("head"))
    joint = clusters.join(heads, "cluster")
    members = joint.select("head", "rid").distinct().join(sizes, "rid")
    fits = members.groupBy("head").agg(
        ((F.count(F.lit(1)) <= SMALL) & (F.sum("n_shingles") <= WEIGHT)).alias("fits"))
    return (joint.join(fits, "head").select(F.when(F.col("fits"), F.xxhash64("head")).otherwise(F.col("cluster")).alias("cluster"), "rid")
            .distinct())


def merged(labels: DataFrame | None, made: DataFrame) -> DataFrame:
    """(v, label): ``labels`` after links (a, b). Labels are vertices; each goes to the least one linked with it, and on to
    that one's. Vertices of one label are always connected, but a component may keep several labels."""
    if labels is not None:
        for c in ("a", "b"):
            given = labels.select(F.col("v").alias(c), F.col("label").alias("known"))
            made = made.join(given, c, "left").withColumn(c, F.coalesce("known", c)).drop("known")
    both = made.unionByName(made.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
    on = low.join(low.select(F.col("a").alias("to"), F.col("to").alias("label")), "to").select(F.col("a").alias("v"), "label")
    if labels is None:
        return pin(on, "labels")
    moved = labels.join(on.select(F.col("v").alias("label"), F.col("label").alias("new")), "label", "left")
    known = moved.select("v", F.coalesce("new", "label").alias("label"))
    return pin(known.unionByName(on).groupBy("v").agg(F.min("label").alias("label")), "labels")


def links(docs: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): confirmed links that join all similar representatives of ``rows`` (rid, doc_id, version, n_shingles,
    sig)."""
    tuned = tuning(percent)
    sigs, sizes = rows.select("rid", "sig"), rows.select("rid", "n_shingles")
    nodes = rows.select("rid", F.col("n_shingles").alias("size"), "sig").mapInArrow(
        lambda b: _rooted(b, tuned), "node long, rid long, size long")
    sets = labels = found = None
    for level in range(LEVELS + 1):
        if labels is None:
            nodes = nodes.withColumn("label", F.col("rid"))
        else:
            nodes = (nodes.join(labels.withColumnRenamed("v", "rid"), "rid", "left")
                     .select("node", "rid", "size", F.coalesce("label", "rid").alias("label")))
        alive = (nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("rid").alias("head"),
                                           F.min("label").alias("low"), F.max("label").alias("high"))
                 .filter("n > 1 AND low < high")
                 .select("node", "head", F.ceil(F.greatest(F.col("n") / SMALL, F.col("weight") / WEIGHT)).alias("parts")))
        nodes = pin(nodes.join(alive, "node"), "nodes")
        if level == 0:      # the others meet nobody
            sigs = pin(sigs.join(nodes.select("rid").distinct(), "rid", "left_semi"), "node-sketches")
        with_sigs = nodes.join(sigs, "rid")
        clusters = (with_sigs.filter("parts = 1").select("node", "rid", "label", "sig")
                    .groupBy("node").applyInArrow(lambda t: _close(t, tuned), "cluster long, rid long"))
        large = with_sigs.filter("parts > 1")
        more = not nodes.filter("parts > 1").isEmpty()
        if more and level < LEVELS:
            heads = nodes.filter("rid = head").join(sigs, "rid").select("node", F.col("sig").alias("head_sig"))
            star = (large.filter("rid <> head").join(heads, "node").select("head", "rid", "sig", "head_sig")
                    .mapInArrow(lambda b: _like_head(b, tuned), "head long, rid long").distinct())
            pair = star.select(F.xxhash64("head", "rid").alias("cluster"), F.explode(F.array("head", "rid")).alias("rid"))
            clusters = clusters.unionByName(pair)
        elif more:
            blocks = 2 * F.col("parts")
            block = F.pmod(F.xxhash64("rid"), blocks)
            clusters = clusters.unionByName(
                large.select("node", "rid", block.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
                .select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("cluster"), "rid"))
        clusters = pin(clusters.distinct(), "clusters")
        if sets is None:
            wanted = clusters.select("rid").union(nodes.filter("parts > 1").select("rid")).distinct()
            sets = pin(_sets(docs, rows.join(wanted, "rid", "left_semi")), "sets")
        made = (_work(clusters, sizes).join(sets, "rid").groupBy("cluster")
                .applyInArrow(lambda t: _linked(t, percent), "a long, b long"))
        made = pin(made.distinct(), "links")
        found = made if found is None else found.unionByName(made)
        if not more:
            break
        labels = merged(labels, made)
        nodes = large.select("node", "rid", "size", "sig").mapInArrow(lambda b: _branched(b, tuned), "node long, rid long, size long")
    return found


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id), and version and stays: the
    text's hash, and true for exactly one row of every component."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = pin(_sketches(docs).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    first = pin(rows.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select("set_hash", "rep"), "equal-sets")
    rep = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "rid")).otherwise(F.col("rid"))
    members = pin(rows.select("rid", "doc_id", "version", "n_shingles", "set_hash").join(first, "set_hash", "left")
                  .select("rid", "doc_id", "version", "n_shingles", rep.alias("rep")), "members")
    reps = members.filter("rid = rep AND n_shingles > 0").select("rid")
    whole = components(links(docs, rows.join(reps, "rid", "left_semi"), percent))
    named = (members.join(whole.withColumnRenamed("v", "rep"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    least = named.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.coalesce(F.min_by("rid", "doc_id"), F.min("rid")).alias("stays"))
    return named.join(least, "component").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "version", (F.col("rid") == F.col("stays")).alias("stays"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text and the columns named in ``carry`` of one document of every component, the one with the smallest
    doc_id. Of rows that repeat a doc_id and its text any one stays."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    staying = (near_dedup(docs, percent).filter("stays")
               .select(F.col("doc_id").alias("stays_id"), F.col("version").alias("stays_version")))
    same = F.col("doc_id").eqNullSafe(F.col("stays_id")) & (F.col("version") == F.col("stays_version"))
    found = texts.withColumn("version", F.xxhash64("text")).join(staying, same, "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "version"])
    return found.select("doc_id", "text", *[F.col("carry")[c].alias(c) for c in carry])
