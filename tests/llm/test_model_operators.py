"""Near-duplicates, language ID, toxicity, surrogates and the pipeline, against brute force or held-out rows."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roster.llm import components, langid, near_dup, pii, toxicity
from tests.conftest import SF001
from tests.llm.conftest import words
from tests.llm.test_text_operators import LOWER, collected, some_order

SF01 = "/root/testdata/sf0.1"


# ---------------------------------------------------------------- near-duplicates

def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows: list[dict], percent: int = 85) -> list[int]:
    sets, label = [shingle_set(r["text"]) for r in rows], list(range(len(rows)))

    def find(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def assert_components(docs) -> None:
    rows = collected(docs)
    label = brute_components(rows)
    least = collections.defaultdict(list)
    for r, c in zip(rows, label, strict=True):
        least[c] += [r["doc_id"]] if r["doc_id"] is not None else []
    want = [(r["doc_id"], len(shingle_set(r["text"])), min(least[c], default=None)) for r, c in zip(rows, label, strict=True)]
    got = collected(near_dup.near_dedup(docs))
    assert some_order((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == some_order(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(r["stays"] for r in got) == len(set(label))


def test_near_dedup_on_odd_rows(clashing, empty):
    assert_components(clashing)
    assert near_dup.near_dedup(empty).count() == 0


@pytest.fixture(scope="module")
def drifting(spark):
    """A chain of copies that drift apart, copies of one text, and texts around one shared passage."""
    rng = random.Random(11)
    text, rows = words(rng, 90), []
    for i in range(70):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[rng.randrange(90)] = words(rng, 1)[0]
    passage = " ".join(words(rng, 60))
    rows += [(100 + i, " ".join(words(rng, 5)) + " " + passage + " " + " ".join(words(rng, 3 + i))) for i in range(40)]
    rows += [(200 + i, passage) for i in range(15)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("small,levels", [(2500, 20), (20, 2)])
def test_near_dedup_by_leaves_recursion_and_blocks(drifting, monkeypatch, small, levels):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "LEVELS", levels)
    assert_components(drifting)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(10_000), 600)
    pairs = list(zip(names[:300], names[1:300])) + [(names[300], x) for x in names[301:500]]
    got = collections.defaultdict(set)
    for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got[r.component].add(r.v)
    assert sorted(map(len, got.values())) == [200, 300]


# ---------------------------------------------------------------- language ID

SAMPLES = {"aa": ["the cat and the dog", "then that hat", "a the bat"], "bb": ["el gato y la rana", "la casa ñoña", "él va"]}


def brute_bits(texts: list[str], text: str) -> float:
    counts = collections.defaultdict(collections.Counter)
    for b in (t.lower().encode() for t in texts):
        for i in range(len(b)):
            for k in range(min(langid.ORDER, i) + 1):
                counts[b[i - k:i]][b[i]] += 1
    total, b = 0.0, text.lower().encode()
    for i in range(len(b)):
        for k in range(min(langid.ORDER, i), -1, -1):
            seen = counts.get(b[i - k:i])
            if not seen:
                continue
            n, d = seen.total(), len(seen)
            if b[i] in seen:
                total -= math.log2(seen[b[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


@pytest.mark.parametrize("text", ["the rana", "Ñ?", "a", "zzzz 12\x00 catcat", "la casa y the hat " * 20])
def test_code_lengths_are_exact(text):
    model = langid.fit(SAMPLES)
    bits = model.bits(np.frombuffer(text.lower().encode(), dtype=np.uint8))
    assert bits == pytest.approx([brute_bits(SAMPLES[x], text) for x in model.languages])


def test_code_lengths_add_up_over_blocks(monkeypatch):
    model, data = langid.fit(SAMPLES), np.frombuffer("the rana y la casa that hat ñ".encode() * 9, dtype=np.uint8)
    whole = model.bits(data)
    for block in (langid.ORDER, 7, 250):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert model.bits(data) == pytest.approx(whole)


def test_a_text_of_thirty_megabytes_takes_bounded_memory():
    import tracemalloc

    model, text = langid.fit(SAMPLES), "the rana y la casa that hat " * 1_100_000
    tracemalloc.start()
    assert model.predict(text)[0] in SAMPLES
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20


def test_the_sample_has_the_smallest_hashes(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"),
                                    F.when(F.col("id") % 3 == 0, "aa").when(F.col("id") % 500 == 1, "bb").otherwise("cc").alias("lang"))
    seen = {}
    old = langid.fit
    try:
        langid.fit = lambda samples: seen.update(samples) or old(samples)
        langid.train(rows, sample=20)
    finally:
        langid.fit = old
    hashed = rows.withColumn("h", F.xxhash64("doc_id")).collect()
    for lang in ("aa", "bb", "cc"):
        want = sorted((r.h, r.text) for r in hashed if r.lang == lang)[:20]
        assert sorted(seen[lang]) == sorted(t for _, t in want)


def test_language_of_odd_rows(odd, clashing, empty):
    model = langid.fit(SAMPLES)
    for docs in (odd, clashing):
        got = {r["doc_id"]: r for r in collected(langid.identify(docs, model))}
        for r in collected(odd):
            has_letter = any(c.isalpha() for c in r["text"] or "")
            assert (got[r["doc_id"]]["lang_pred"] == "und") == (not has_letter)
            assert 0 <= got[r["doc_id"]]["score"] <= 1
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in collected(langid.identify(odd, langid.train(empty)))} == {"und"}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()), sample=60)
    pred = langid.identify(docs.filter(langid.held_out()), model, carry=["lang"])
    assert pred.filter("lang_pred = lang").count() >= 0.97 * pred.count()


# ---------------------------------------------------------------- toxicity

def test_char_counts_cover_all_texts(odd):
    cube = toxicity.char_counts(odd)
    want = collections.Counter()
    for r in collected(odd):
        x = [toxicity._NUMBER.get(c.lower(), 0) if c.isalpha() and len(c.lower()) == 1 else 0 for c in f"  {r['text'] or ''} "]
        want.update(zip(x, x[1:], x[2:]))
    assert {k: int(cube[k]) for k in want} == dict(want) and cube.sum() == want.total()


def test_disguised_words_are_restored():
    plain = "the idiot is a stupid loser and the moron said it to them " * 50
    cube = np.zeros((toxicity.SIZE,) * 3)
    x = toxicity._LUT[np.frombuffer(f"  {plain}".encode("latin-1"), dtype=np.uint8)]
    np.add.at(cube, (x[:-2], x[1:-1], x[2:]), 1)
    reader = toxicity.Reader(toxicity.Channel(cube))
    assert reader.restored("the 1d10t is\nSTUUUPID 5tupid m.o.r.o.n l0$er") == "the idiot is\nstupid stupid moron loser"
    assert "moron" in reader.restored("the m o r o n said")
    assert reader.restored("12:30 on 2024-01-05, see a.b@c.org") == "12:30 on 2024-01-05 see a.b@c.org"
    assert reader.counts("")[1] == 0


@pytest.fixture(scope="module")
def channel(spark):
    return toxicity.Channel(toxicity.char_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


@pytest.mark.parametrize("disguised,word", [
    ("1d1ot", "idiot"), ("l0ser", "loser"), ("idio7", "idiot"), ("a$$", "ass"), ("@$$", "ass"), ("stuupid", "stupid"),
    ("st.up.id", "stupid"), ("st-upid", "stupid"), ("s.t.u.p.!.d", "stupid"), ("idi\u043et", "idiot"), ("\u0456diot", "idiot"),
    ("sc*m", "scum"), ("l0$$er", "loser"), ("mor\u03bfn", "moron")])
def test_each_kind_of_disguise_is_restored(channel, disguised, word):
    assert channel.token(disguised) == word


@pytest.mark.parametrize("token", ["letter", "well-known", "example.com", "covid19", "100%", "12:30", "2024-01-05", "llos",
                                   "\u0434\u043e\u043c", "\u4eba\u4eba", "...", "---", "$$$", "12345", ""])
def test_plain_readings_stay(channel, token):
    assert channel.token(token) in (token, token.rstrip("."), "")


def test_viterbi_finds_the_best_of_all_paths(channel):
    def value(outs: list[tuple[str, float]]) -> float:
        x = [0, 0, *(toxicity._NUMBER.get(c, 0) for out, _ in outs for c in out), 0]
        return sum(cost for _, cost in outs) + sum(channel.log[a][b][c] for a, b, c in zip(x, x[1:], x[2:]))

    rng = random.Random(4)
    tokens = ["1d!0t", "s.t-u!p", "@$$", "b00kk", "**ab", "\u0430bb1", "5e..l7"] + ["".join(rng.choices("aeprst10$!.-*", k=6)) for _ in range(40)]
    for token in tokens:
        places = channel._places(token)
        paths = {"".join(out for out, _ in outs): value(outs) for outs in sorted(itertools.product(*places), key=value)}
        assert paths[channel.decode(places)] == pytest.approx(max(paths.values()))


def test_a_long_token_is_decoded_in_linear_memory(channel):
    assert channel.token("sc*m-" * 40_000).count("scum") == 40_000


def test_toxicity_on_held_out_rows(spark, odd, clashing, empty):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    rows = collected(toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out()))
    bad, good = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) >= 0.95
    for odd_docs in (odd, clashing):
        assert all(0 <= r["score"] <= 1 for r in collected(toxicity.score(odd_docs, model)))
    assert toxicity.score(empty, model).count() == 0
    none = labels.filter("toxic > 1")
    assert {r["score"] for r in collected(toxicity.score(odd, toxicity.train(docs, none)))} == {0.0}


# ---------------------------------------------------------------- surrogates

PRIVATE = [
    (1, "Mr. John Smith met Mrs. Anna Smith. Smith wrote JOHN.DOE@Gmail.com, john.doe@gmail.com; +1 (864) 555-0138, +1-864-555-0138."),
    (2, "card 4111 1111 1111 1111 or 4111-1111-1111-1111, ip 142.226.109.250. ssn 123-45-6789, DE89 3704 0044 0532 0130 00"),
    (3, None), (4, ""), (5, "Госпожа Анна Иванова. ip 142.226.109.250"), (5, "a.b@mail2.example.com&&& v1.2.3"),
    (None, "a.b@mail2.example.com"), (6, "no data here: 12, 3.14, 2024."),
]


def luhn(number: str) -> bool:
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark, empty):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string").withColumn("gaps", F.lit(1)).withColumn("pos", F.lit(1))
    rows = collected(pii.replace_pii(docs, "key"))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    one, two = by[1][0]["text"], by[2][0]["text"]
    for old in ("John", "Smith", "oe@", "555-0138", "4111", "142.226", "123-45", "3704"):
        assert old not in one + two
    name = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) \2\. \2 wrote ([A-Z.]+@[a-z.]+), (\S+); \+(\d) \((\d{3})\) (\d{3})-(\d{4}), \+\6-\7-\8-\9\.$", one)
    assert name and name[4].lower() == name[5] and name[3].endswith("a")
    cards = re.search(r"card ((?:\d{4} ){3}\d{4}) or ((?:\d{4}-){3}\d{4}),", two)
    assert cards and cards[1].replace(" ", "") == cards[2].replace("-", "") and luhn(cards[1])
    ip = re.search(r"ip (\S+?)\. ssn \d{3}-\d{2}-\d{4}, DE\d\d( \d{4}){4} \d\d$", two)[1]
    assert any(r["text"].endswith(f"ip {ip}") and re.match(r"Госпожа [Ѐ-ӿ]+а [Ѐ-ӿ]+ва\.", r["text"]) for r in by[5])
    mail = by[None][0]["text"]
    assert mail.endswith(".example.com") and any(r["text"] == f"{mail}&&& v1.2.3" for r in by[5])
    assert by[3][0]["text"] is None and by[4][0]["text"] == "" and by[6][0]["text"] == PRIVATE[-1][1]
    assert [by[1][0][f"n_{k}"] for k in pii.KINDS] == [2, 0, 0, 0, 0, 2, 2]
    assert pii.replace_pii(empty, "key").count() == 0


def test_addresses_before_dots_are_found(spark):
    ends = [". Then more", "...", ".) and", ".", "", ".5 more", ", more", ". x@y.org"]
    rows = [(i, f"write to a.b@mail.example.com{end}") for i, end in enumerate(ends)]
    rows.append((99, "x@" + "a." * 100_000 + "com and x@" + "a." * 100_000))
    got = {r["doc_id"]: r for r in collected(pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "key"))}
    for i, end in enumerate(ends):
        assert got[i]["n_email"] == 1 + end.count("@")
        assert re.match(r"write to (?!a\.b@mail)\S+@\w+\.example\.com" + re.escape(end.split("x@")[0]), got[i]["text"])
    assert got[99]["n_email"] == 1


def test_surrogates_are_distinct_in_a_narrow_format(spark):
    """600 addresses of the shape x@yy.zz have many collisions; all surrogates differ from each other and the entities."""
    real = [f"{a}@{b}{c}.de" for a in "abcdefgh" for b in "abcdefghij" for c in "abcdefgh"][:600]
    entities = spark.createDataFrame([("email", e, "n") for e in real], "kind string, canon string, gender string")
    got = collected(pii.surrogates(entities, "key"))
    made = [r["surrogate"] for r in got]
    assert len(got) == len(set(made)) == 600 and not set(made) & set(real)
    assert {(r["canon"], r["surrogate"]) for r in collected(pii.surrogates(entities, "key"))} == {(r["canon"], r["surrogate"]) for r in got}
    assert {r["surrogate"] for r in collected(pii.surrogates(entities, "other key"))} != set(made)


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, odd, clashing, empty):
    import corpus_pipeline as pipeline
    from roster.llm.shared import pin

    docs, expected = spark.read.parquet(f"{SF001}/documents.parquet").limit(300).unionByName(odd), None
    for name, stage in pipeline.STAGES[:-1]:
        before, after = collected(docs), collected(out := pin(stage(spark, docs, SF001), "test"))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r["n_chars"] == len(r["text"]) for r in after)
        ids = collections.Counter(r["doc_id"] for r in after)
        if name == "language":
            gone = [r for r in before if r["doc_id"] not in ids]
            assert sum(any(c.isalpha() for c in r["text"] or "") for r in gone) <= 6       # odd rows of invented words
            assert not [r for r in after if not any(c.isalpha() for c in r["text"])]
        elif name == "near_duplicates":
            expected = len(set(brute_components([r for r in before], pipeline.NEAR_PERCENT)))
            assert len(after) == expected
        elif name in ("lines", "secrets"):
            assert len(after) == len(before)
        if name == "secrets":
            assert not [r for r in after if "AKIA" in r["text"] or re.search("[0-9a-f]{24}", r["text"])]
        docs = out
    pieces = collected(pipeline.STAGES[-1][1](spark, docs, SF001))
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in collected(docs)}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language(spark, unlabelled, SF001).count() == odd.count()
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF001).count() == 0
        assert stage(spark, clashing, SF001).count() >= 0


def test_pipeline_takes_near_duplicates_from_80_percent(spark):
    import corpus_pipeline as pipeline

    rng, rows = random.Random(17), []
    for i in range(60):         # a text, and one with 1 to 3 of its 60 words replaced: similarity 0.6 to 0.98
        text = words(rng, 60)
        near = list(text)
        for k in rng.sample(range(60), 1 + i % 3):
            near[k] = words(rng, 1)[0] + "x"
        rows += [{"doc_id": 2 * i, "text": " ".join(text)}, {"doc_id": 2 * i + 1, "text": " ".join(near)}]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], "en", "s", 0) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [len(set(brute_components(rows, p))) for p in (85, 80, 60)]
    assert sizes[0] > sizes[1] > sizes[2]
    assert pipeline.near_duplicates(spark, docs, SF001).count() == sizes[1]
    assert near_dup.one_of_each(docs, percent=60).count() == sizes[2]


def test_tuning_follows_the_threshold():
    assert near_dup.tuning(85) == near_dup.Tuning(12, 0.5, 39)
    for percent in (55, 60, 70, 80, 90):
        t, s, n = near_dup.tuning(percent), percent / 100, near_dup.COORDINATES
        assert (1 + t.second) * s > 1
        assert sum(math.comb(n, k) * s ** k * (1 - s) ** (n - k) for k in range(t.equal)) <= 1e-6
    with pytest.raises(ValueError):
        near_dup.tuning(50)
