"""Surrogates for personal data (operator 10), in DataFrame functions only.

E-mail and IP addresses, phone, card, social security and bank account numbers, and names after a title are found by
one expression per text. Each distinct entity receives a surrogate derived from a secret key: digits for digits,
letters for letters of the same case; a card number stays valid or invalid under its check digit; a name stays in its
script and, as far as the title tells, its gender. Mentions of one entity, in whatever spelling or punctuation, get the
same surrogate in the mention's own format; names are mapped word by word, so "Mr. John Smith", "Mr. Smith" and, in the
same document, a bare "Smith" agree.

Distinctness: surrogates are drawn in rounds. A candidate that equals a real entity, a surrogate given before, or a
candidate that another entity holds in the same round is drawn again with the next attempt number (of equal ones the
smallest entity keeps it); later attempts draw from wider formats. What remains after ``ROUNDS`` raises an error.

Mentions are narrow rows, written once; entities are reduced map-side; both joins are shuffle joins whose hot keys AQE
splits. Texts move once, in the join with their replacements.

Defined cases: a null text stays null and has no entities; empty texts stay empty; rows that repeat a ``doc_id`` are
treated by their own text; an empty table gives an empty result; further columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import pin

ROUNDS = 24

#: Titles and the gender they tell (m, f, or n for neither).
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
_TITLE = "(?:" + "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True)) + r")\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Where the last label isn't the end of a domain (a dot that ends the sentence), labels are given back. Only so many, the
#: most a domain name can have, as the JVM's expressions recurse for each label they may give back.
_LABEL, _LAST = r"(?:[A-Za-z0-9-]++\.)", r"[A-Za-z]{2,}(?![A-Za-z0-9])"
PATTERN = "|".join([
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:{_LABEL}++{_LAST}|{_LABEL}{{1,127}}{_LAST})",
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)",
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)",
    r"\+\d(?:[ .-]?\d){7,14}(?!\d)",
    rf"(?<!\p{{L}}){_TITLE} \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
])
KINDS = ("email", "ip", "ssn", "iban", "card", "phone", "name")

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Consonants, vowels, and the endings of male and female given names and surnames, by script.
SCRIPTS = {
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "н", "а", "ов", "ова"),
    "greek": ("βγδζκλμνπρστ", "αειου", "ς", "α", "ης", "η"),
    "latin": ("bdfghklmnprstvz", "aeiou", "n", "a", "er", "er"),
}


def _byte(i: Column | int) -> Column:
    """Byte i of the entity's key stream (column ``h``, 128 hexadecimal digits)."""
    at = (i % 64) * 2 + 1 if not isinstance(i, int) else F.lit(i % 64 * 2 + 1)
    return F.conv(F.substr(F.col("h"), at, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, i: Column | int) -> Column:
    return F.substr(F.lit(letters), _byte(i) % len(letters) + 1, F.lit(1))


def _shaped(value: Column) -> Column:
    """The value with keyed digits for its digits and keyed letters for its ASCII letters."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: (
        F.when(c.rlike("^[0-9]$"), (_byte(i) % 10).cast("string"))
        .when(c.rlike("^[a-z]$"), _pick(_LOWER, i)).when(c.rlike("^[A-Z]$"), _pick(_UPPER, i)).otherwise(c))), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string to which a check digit is still to be added."""
    n = F.length(digits)
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.when(
        (n - i) % 2 == 1, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x)


def _card(value: Column) -> Column:
    body = F.concat((_byte(63) % 9 + 1).cast("string"), _shaped(F.substr(value, F.lit(2), F.length(value) - 2)))
    check = (10 - _luhn(body) % 10) % 10
    valid = (10 - _luhn(F.substr(value, F.lit(1), F.length(value) - 1)) % 10) % 10 == F.substr(value, F.length(value), F.lit(1)).cast("int")
    return F.concat(body, F.when(valid, check).otherwise((check + 1 + _byte(62) % 9) % 10).cast("string"))


def _ip(attempt: int) -> Column:
    first = F.lit("10") if attempt < 4 else (_byte(3) % 223 + 1).cast("string")
    return F.concat_ws(".", first, *[_byte(i).cast("string") for i in range(3)])


def _email(value: Column, attempt: int) -> Column:
    """Keyed local part and domain labels; reserved example domains and the last label stay."""
    kept = F.regexp_extract(value, r"(\.example)?\.[a-z]+$", 0)
    moved = F.substr(value, F.lit(1), F.length(value) - F.length(kept))
    longer = F.substr(F.col("h"), F.lit(100), F.lit(max(0, attempt - 3)))
    return F.concat(longer, _shaped(moved), kept)


def _phone(value: Column) -> Column:
    return F.concat((_byte(63) % 9 + 1).cast("string"), _shaped(F.substr(value, F.lit(2), F.length(value) - 1)))


def _name(attempt: int) -> Column:
    """A name of as many syllables as the entity suggests, in its script, with an ending of its gender."""
    made: Column | None = None
    syllables = F.least(F.lit(5), F.greatest(F.lit(2), (F.length("canon") / 2).cast("int"))) + attempt // 3
    for script, (consonants, vowels, *endings) in SCRIPTS.items():
        body = F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.concat(
            _pick(consonants, i * 2), _pick(vowels, i * 2 + 1))), "")   # noqa: B023 - called at once
        end = (F.when((F.col("kind") == "given") & (F.col("gender") == "m"), endings[0])
               .when((F.col("kind") == "given") & (F.col("gender") == "f"), endings[1])
               .when((F.col("kind") == "surname") & (F.col("gender") == "m"), endings[2])
               .when((F.col("kind") == "surname") & (F.col("gender") == "f"), endings[3]).otherwise(""))
        whole = F.concat(body, end)
        if script == "latin":
            return made.otherwise(whole)
        here = F.col("canon").rlike(r"^\p{Is" + script.capitalize() + "}")
        made = F.when(here, whole) if made is None else made.when(here, whole)
    raise AssertionError


def _candidates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    c, kind = F.col("canon"), F.col("kind")
    stream = entities.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), kind, c, F.lit(str(attempt))), 512))
    made = (F.when(kind == "email", _email(c, attempt)).when(kind == "ip", _ip(attempt)).when(kind == "card", _card(c))
            .when(kind == "ssn", F.concat(F.lit("9"), _shaped(F.substr(c, F.lit(2), F.lit(8)))))
            .when(kind == "iban", F.concat(F.substr(c, F.lit(1), F.lit(2)), _shaped(F.substr(c, F.lit(3), F.length(c) - 2))))
            .when(kind == "phone", _phone(c)).otherwise(_name(attempt)))
    return stream.select("kind", "canon", "gender", made.alias("surrogate"))


def surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon, gender); surrogates are distinct within a kind (given
    names and surnames together) and differ from all entities."""
    family = F.when(F.col("kind").isin("given", "surname"), "name").otherwise(F.col("kind"))
    entities = entities.withColumn("family", family)
    real = entities.select("family", F.col("canon").alias("surrogate")).distinct()
    pending, done = entities.drop("family"), None
    for attempt in range(rounds):
        drawn = pin(_candidates(pending, key, attempt).withColumn("family", family), "surrogate-draws")
        free = drawn.join(real, ["family", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        named = F.concat_ws("|", "kind", "canon")
        first = free.groupBy("family", "surrogate").agg(F.min(named).alias("holder"))
        won = pin(free.join(first, ["family", "surrogate"]).filter(named == F.col("holder"))
                  .select("family", "kind", "canon", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = pin(drawn.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "gender"),
                      "surrogates-open")
        if pending.isEmpty():
            return done.select("kind", "canon", "surrogate")
    raise ValueError(f"no distinct surrogates for some entities after {rounds} rounds")


def _parts(mentions: DataFrame) -> DataFrame:
    """(doc_id, version, pos, part, lead, value, kind, canon, gender): a mention's kind and its words, one for all
    kinds but names."""
    m = F.col("mention")
    digits = F.regexp_replace(m, "[^0-9]", "")
    kind = (F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
            .when(m.rlike(r"^\p{L}"), "name").when((F.length(digits) >= 13) & m.rlike(r"^\d"), "card").otherwise("phone"))
    title = F.regexp_extract(m, rf"^{_TITLE} ", 0)
    words = F.split(F.substr(m, F.length(title) + 1, F.length(m)), " ")
    plain = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(plain.isin(TITLES["m"]), "m").when(plain.isin(TITLES["f"]), "f").otherwise("n")
    canon = (F.when(F.col("kind") == "email", F.lower(m)).when(F.col("kind") == "ip", m)
             .when(F.col("kind") == "iban", F.regexp_replace(m, " ", "")).otherwise(digits))
    found = mentions.withColumn("kind", kind)
    one = F.array(F.struct(F.lit("").alias("lead"), m.alias("value"), F.col("kind").alias("kind"), canon.alias("canon"), F.lit("n").alias("gender")))
    many = F.transform(words, lambda w, i: F.struct(
        F.when(i == 0, title).otherwise(" ").alias("lead"), w.alias("value"),
        F.when((i == 0) & (F.size(words) > 1), "given").otherwise("surname").alias("kind"), F.lower(w).alias("canon"), gender.alias("gender")))
    parts = found.select("doc_id", "version", "pos", F.posexplode(F.when(F.col("kind") == "name", many).otherwise(one)).alias("part", "p"))
    return parts.select("doc_id", "version", "pos", "part", "p.*")


def _rendered() -> Column:
    """The surrogate in the mention's format."""
    v, s, kind = F.col("value"), F.col("surrogate"), F.col("kind")
    slots = F.when(kind == "iban", "[^A-Z0-9]").otherwise("[^0-9]")
    before = lambda i: F.length(F.regexp_replace(F.substr(v, F.lit(1), i), slots, F.lit("")))
    placed = F.array_join(F.transform(F.split(v, ""), lambda c, i: F.when(
        F.regexp_replace(c, slots, F.lit("")) != "", F.substr(s, before(i) + 1, F.lit(1))).otherwise(c)), "")
    side = lambda c, k: F.substring_index(c, "@", k)
    mail = F.concat_ws("@", *[F.when(side(v, k) == F.upper(side(v, k)), F.upper(side(s, k))).otherwise(side(s, k)) for k in (1, -1)])
    name = F.when((v == F.upper(v)) & (F.length(v) > 1), F.upper(s)).otherwise(F.initcap(s))
    return F.when(kind == "email", mail).when(kind == "ip", s).when(kind.isin("given", "surname"), name).otherwise(placed)


def replace_pii(docs: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, text with surrogates, the columns named in ``carry``, n_<kind> (mentions) for
    each of ``KINDS``."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("version"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    mentions = (docs.select("doc_id", "version", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "mention"))
                .dropDuplicates(["doc_id", "version", "pos"]))
    parts = pin(_parts(mentions), "mentions")
    entities = pin(parts.groupBy("kind", "canon").agg(F.min("gender").alias("gender")), "entities")
    chosen = pin(surrogates(entities, key), "surrogate-table")
    found = parts.join(chosen, ["kind", "canon"]).withColumn("new", _rendered())
    per_doc = found.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "lead", "value", "kind", "new"))).alias("parts"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "found_id", "version": "found_version"})
    joined = (docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version")), "left")
              .withColumn("gaps", F.when(F.col("parts").isNotNull(), F.split("text", PATTERN, -1)))
              .withColumn("names", F.array_distinct(F.transform(
                  F.filter("parts", lambda p: p["kind"].isin("given", "surname")), lambda p: F.struct(p["value"], p["new"])))))
    # A name found after a title is also replaced where it stands alone in the document.
    bare = F.when(F.size("names") > 0, F.transform("gaps", lambda g: F.aggregate(
        "names", g, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})"), n["value"], F.lit(r"(?!\p{L})")), n["new"])))).otherwise(F.col("gaps"))
    joined = joined.withColumn("gaps", bare).withColumn("new", F.transform(
        F.sequence(F.lit(0), F.size("gaps") - 2), lambda k: F.array_join(F.transform(
            F.filter("parts", lambda p: p["pos"] == k), lambda p: F.concat(p["lead"], p["new"])), "")))
    text = F.array_join(F.zip_with("gaps", "new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")

    def count(kind: str) -> Column:
        own = {"name": ["given", "surname"]}.get(kind, [kind])
        hits = F.filter("parts", lambda p: p["kind"].isin(own) & (p["part"] == 0))
        return F.coalesce(F.array_size(hits), F.lit(0)).cast("long").alias(f"n_{kind}")

    return joined.select("doc_id", F.when(F.col("parts").isNull(), F.col("text")).otherwise(text).alias("text"),
                         *[F.col("carry")[c].alias(c) for c in carry], *map(count, KINDS))
