"""Operators 11 to 13 against plain-Python versions: whitening, conversation repair, decontamination."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from roster.llm import conversations as C
from roster.llm import phrases as P
from roster.llm import whitening as W
from roster.llm.registry import QUERIES

SF001 = "/root/testdata/sf0.01"
OWN = ["id", "x", "cell", "entries", "n", "rid", "phrase", "number", "words", "first", "block", "kind", "copy", "digest", "chunk", "rows",
       "symbol", "edits", "cost", "position", "spans", "items", "behind", "state", "label"]


def clash(df):
    return df.withColumns({c: F.lit(7) for c in OWN if c not in df.columns})


# ---------------------------------------------------------------- operator 11

def vectors(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in rows], "vec_id long, embedding array<double>")


def whitened(df):
    x = W.fixed_point(df)
    model = W.fit(x)
    return model, W.whiten(x, model)


def check_whitening(df, rows, components=W.COMPONENTS):
    """Against a dense eigensolver; ``rows`` are (id, entries) of the vectors that count."""
    model, out = whitened(df)
    x = np.floor(np.array([r for _, r in rows]) * 1024).astype(np.int64) + 100_000
    s, n = x.sum(axis=0), len(x)
    c = x - s / n
    values, dirs = np.linalg.eigh(c.T @ c / n)
    values, dirs = values[::-1], dirs[:, ::-1]
    k = model.components
    assert model.n == n and k == min(components, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    assert np.allclose(model.values, values[:k], rtol=1e-10)
    assert np.allclose(model.explained(), values[:k] / values.sum(), rtol=1e-8)
    assert model.identity_error <= 1e-8
    got = sorted(((r.id is not None, r.id or 0, float(r.deviation)), list(r.whitened), int(r.deviation)) for r in out.collect())
    dev = ((n * x - s) ** 2).sum(axis=1)
    order = sorted(range(n), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, float(dev[i])))
    assert [g[2] for g in got] == [int(dev[i]) for i in order]
    w = np.array([g[1] for g in got]).reshape(n, k)
    gaps = np.diff(values[:k + 1]) if len(values) > k else np.append(np.diff(values[:k]), -values[0])
    for j in range(k):
        near = min([abs(gaps[j])] + ([abs(gaps[j - 1])] if j else [])) if len(gaps) else 1
        if near > 1e-6 * values[0]:         # the direction is unique
            want = c[order] @ dirs[:, j] / np.sqrt(values[j])
            assert min(np.abs(w[:, j] - want).max(), np.abs(w[:, j] + want).max()) < 1e-6
    return model


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(40) * np.linspace(3, 1, 40)).tolist()) for i in range(400)]
    model = check_whitening(clash(vectors(spark, rows)), rows)
    assert model.passes > W.LANCZOS + W.DEGREE and model.residual <= 100 * W.RESIDUAL      # the filter ran, to rounding level


def test_whitening_of_few_dimensions_and_of_low_rank(spark):
    rng = np.random.default_rng(4)
    check_whitening(vectors(spark, rows := [(i, rng.standard_normal(3).tolist()) for i in range(50)]), rows)
    base = np.round(rng.standard_normal((2, 40)) * 8)       # whole numbers: exactly two directions
    mixed = rng.integers(-3, 4, (60, 2)) @ base
    assert check_whitening(vectors(spark, rows := [(i, r.tolist()) for i, r in enumerate(mixed)]), rows).components == 2


def test_whitening_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(5)
    good = [(i % 7 if i else None, rng.standard_normal(5).tolist()) for i in range(30)]
    good += good[:3]            # repeated rows
    bad = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0]), (4, [float("nan")] * 5), (5, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (6, [1e300, 0.0, 0.0, 0.0, 0.0]), (7, [0.0] * 4)]
    check_whitening(clash(vectors(spark, bad + good)), good)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_whitening_without_variance_has_no_components(spark, rows):
    model, out = whitened(vectors(spark, rows))
    assert model.components == 0
    assert [(r.id, list(r.whitened)) for r in out.orderBy("id").collect()] == [(i, []) for i, v in rows if v]


def test_deviation_beyond_64_bits_is_exact(spark):
    rows = [(i, [(-1.0) ** i * 1e9, float(i)]) for i in range(8)]
    model, out = whitened(vectors(spark, rows))
    x = [[int(np.floor(v * 1024)) + 100_000 for v in r] for _, r in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((8 * a - b) ** 2 for a, b in zip(r, s)) for i, r in enumerate(x)}
    assert {r.id: int(r.deviation) for r in out.collect()} == want and max(want.values()) > 2 ** 63


def test_whitening_query(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, SF001).collect()
    assert len(rows) == 500 * 8 and {r.component for r in rows} == set(range(1, 9)) and {r.n for r in rows} == {500}
    assert all(r.deviation == int(r.deviation_exact) for r in rows) and max(r.identity_error for r in rows) < 1e-10


# ---------------------------------------------------------------- operator 12

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def brute_repair(rows):
    """All reports of one conversation by a plain search over prefixes; rows (turn, role, text) in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for state, (cost, audit, made) in list(out.items()):
                for role in ("user", "assistant"):
                    to = MOVES.get((state, role[0]))
                    new = (cost + 2, audit + "I", (*made, (role, "")))
                    if to and (to not in out or new[:2] < out[to][:2]):
                        out[to] = new
        return out

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, made) in inserted(best).items():
            choices = [(state, (cost + 3, audit + "D", made))]
            if fault not in ("b", "d"):
                extra = fault == "t"
                choices.append((MOVES.get((state, role[:1])), (cost + extra, audit + "K", (*made, (role, text)))))
                choices += [(MOVES.get((state, r[0])), (cost + 2 + extra, audit + "R", (*made, (r, text)))) for r in ("user", "assistant")]
            for to, new in choices:
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        best = after
    cost, audit, made = min((v for q, v in inserted(best).items() if q in ("", "a")), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit), list(made)


def all_repairs(symbols):
    """Cost and audit of every sequence of edits with at most two insertions in a row: no tables, no states kept apart."""
    out = []

    def go(i, state, cost, audit, run):
        if i == len(symbols) and state in ("", "a"):
            out.append((cost, audit))
        if run < 2:
            for r in "ua":
                if (state, r) in MOVES:
                    go(i, MOVES[state, r], cost + 2, audit + "I", run + 1)
        if i < len(symbols):
            s = symbols[i]
            go(i + 1, state, cost + 3, audit + "D", 0)
            if s not in "bd":
                extra = s.isupper()
                if (state, s.lower()) in MOVES:
                    go(i + 1, MOVES[state, s.lower()], cost + extra, audit + "K", 0)
                for r in "ua":
                    if (state, r) in MOVES:
                        go(i + 1, MOVES[state, r], cost + 2 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(out)


def test_edits_are_the_least_of_all_sequences():
    rng = random.Random(8)
    for n in range(6):
        for _ in range(60):
            symbols = "".join(rng.choices(C.SYMBOLS[:-1], k=n))
            letters, cost, _ = C.edit(symbols)
            assert (cost, "".join(letters)) == all_repairs(symbols), symbols


def test_blocks_and_runs_compose():
    rng, t = random.Random(9), C.tables()
    assert t.block.shape == (len(t.vectors), len(C.SYMBOLS) ** C.BLOCK)
    for _ in range(200):
        symbols = "".join(rng.choices(C.SYMBOLS[:-1], k=rng.randint(1, 30)))
        cuts = sorted(rng.sample(range(1, len(symbols)), min(2, len(symbols) - 1)))
        runs = [symbols[a:b] for a, b in itertools.pairwise([0, *cuts, len(symbols)])]
        whole, joined = C.summarise(symbols), reduce(C.Summary.then, map(C.summarise, runs))
        assert (whole.before == joined.before).all() and (whole.behind == joined.behind).all()
        again = C.Summary.unpack(whole.pack())
        assert (again.before == whole.before).all() and (again.behind == whole.behind).all()


def conversation_rows():
    rng, out = random.Random(10), []
    texts = ["Yes.", "No", "", " \t\n", "What?\n", None, "à ", "Long. " * 2000, "ok!"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "Umm", "tool"]
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(roles), rng.choice(texts)))
    hot = [(77, t, ["user", "assistant"][t % 2], f"{t % 50} is it{'.' * (t % 3)}") for t in range(900)]
    return out + out[:5] + hot + [(5_000_000_000, None, "user", "Only one.")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [C.CHUNK_BITS, 2])
def test_reports_equal_brute_force(spark, monkeypatch, bits):
    """With chunks of four rows nearly every conversation spans several."""
    monkeypatch.setattr(C, "CHUNK_BITS", bits)
    rows = conversation_rows()
    df = clash(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damage(df), every=df).collect()}
    want = {}
    for conv, lines in by_conv.items():
        report, made = brute_repair(lines)
        want[conv] = (*report, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    assert got == want


def test_repaired_rows(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([r for r in rows if r[2] is not None and r[3] is not None], SCHEMA)
    got = {}
    for r in C.repaired(df).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    by_conv = {}
    for conv, *line in rows:
        if None not in line[1:]:
            by_conv.setdefault(conv, []).append(tuple(line))
    want = {conv: made for conv, lines in by_conv.items() if (made := brute_repair(lines)[1])}
    assert got == want
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) for lines in got.values())


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(empty), every=empty).collect() == []
    gone = next(i for i in range(1000) if not damaged(i, 0, "user", "x."))
    df = spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA)
    assert [tuple(r) for r in C.repair(C.damage(df), every=df).collect()] == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---------------------------------------------------------------- operator 13

def plain_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_hits(docs, items, size, slop=0):
    """(id, words, hit words, items) of every document, by looking at every place."""
    wanted = {}
    for name, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wanted.setdefault(tuple(w[i:i + size]), set()).add("" if name is None else str(name))
    out = []
    for name, text in docs:
        w, hit, met = plain_words(text), set(), set()
        for phrase, names in wanted.items():
            for start in range(-slop, len(w) + slop):
                if all(any(0 <= start + o + e < len(w) and w[start + o + e] == p for e in range(-slop, slop + 1)) for o, p in enumerate(phrase)):
                    hit |= set(range(max(0, start - slop), min(len(w), start + len(phrase) + slop)))
                    met |= names
        out.append((name, len(w), len(hit), sorted(met)))
    return sorted(out, key=str)


def search_case():
    rng = random.Random(12)
    vocabulary = ["Über", "ein", "the", "of", "a1", "B2", "日本", "x"]
    items = [(i if i else None, " ".join(rng.choices(vocabulary, k=n)) + "!") for i, n in enumerate([12, 10, 9, 3, 1, 0, 14, 14])]
    items += [(3, "of of THE x x x a1"), (9, None), (1, items[6][1])]
    docs = [(1, None), (2, ""), (3, "-- \n"), (None, items[0][1].upper()), (4, "x"), (4, "x"), (5, "a1 " * 40)]
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        item = rng.choice(items)[1] or ""
        cut = rng.randint(0, len(text))
        docs.append((100 + i, rng.choice([" ", ", ", "\n"]).join([*text[:cut], *item.split(), *text[cut:]])))
    return docs, items


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return (clash(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3),
            clash(spark.createDataFrame(items, "item_id long, text string")))


@pytest.mark.parametrize(("size", "slop"), [(10, 0), (4, 0), (10, 1), (3, 2)])
def test_matches_equal_brute_force(spark, size, slop):
    docs, items = search_case()
    assert found(P.decontaminate(*frames(spark, docs, items), size=size, slop=slop)) == brute_hits(docs, items, size, slop)


def test_pieces_and_blocks_give_the_same(spark, monkeypatch):
    """Segments of 64 bytes cut nearly every text; blocks of 2 kB make the phrases go out in several."""
    docs, items = search_case()
    rng = random.Random(2)
    docs.append((7, " ".join(rng.choices(["the", "of", "x", "a1"], k=400)) + " " + (items[7][1] + " ") * 3 + "y" * 500 + " the"))
    monkeypatch.setattr(P, "SEGMENT", 64)
    monkeypatch.setattr(P, "BLOCK", 2000)
    assert found(P.decontaminate(*frames(spark, docs, items))) == brute_hits(docs, items, 10)


def test_postings_give_the_words_back(spark):
    docs, items = search_case()
    index = P.build_index(frames(spark, docs, items)[0]).collect()
    words = {}
    for segment in index:
        vocabulary = bytes(segment.words).split(b" ")
        bounds, places = P.unpack(len(vocabulary) if segment.n_words else 0, bytes(segment.postings))
        at = {int(p): vocabulary[i].decode() for i in range(segment.n_words) for p in places[bounds[i]:bounds[i + 1]]}
        for rid, first, lead, own in zip(segment.rid, segment.first, segment.lead, segment.own):
            words.setdefault(rid, []).extend(at.pop(first + lead + i) for i in range(own))
        assert not at
    assert sorted(words.values()) == sorted(plain_words(t) for _, t in docs)


def test_search_without_rows_or_phrases(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a b")])
    nothing = found(P.decontaminate(docs, items.limit(0)))
    assert nothing == [(1, 2, 0, [])]
    assert found(P.decontaminate(docs.limit(0), items)) == []
    with pytest.raises(ValueError, match="overlap"):
        P.decontaminate(*frames(spark, [(1, "a")], [(1, "a " * 50)]), size=40)


def test_a_long_text(spark):
    """20 MB in one row, with a passage across a cut between pieces."""
    passage = " ".join(f"p{i}" for i in range(12))
    filler = "lorem ipsum dolor " * 240_000
    text = filler[:P.SEGMENT - 20] + " " + passage + " " + filler * 4
    out = P.decontaminate(*frames(spark, [(1, text), (2, passage)], [(1, passage)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in out) == [(1, len(text.split()), 12), (2, 12, 12)]
