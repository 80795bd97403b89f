"""Sanitising private data and the terms that give it away."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BROADCAST_BYTES, fresh, quoted, stage, total_bytes

#: Words to either side of an entity in which terms count as occurring with it.
WINDOW = 12
#: Different texts that a term must share with an entity before the share counted is taken as it is.
SUPPORT = 3
#: Disclosure (share of the entity's information that a term gives away) from which a term is
#: generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.97
GENERAL = "[TERM]"

_SEP = r"[^\w\n]{0,5}"
#: White space within a key, which source code may write as escapes.
_GAP = r"(?:\s|\\[nrt])*"
_END = r"-----END [A-Z ]*PRIVATE KEY-----"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})"
#: What counts as a protected entity: class, the sign a text must have, and pattern, in order of precedence.
ENTITIES: tuple[tuple[str, str, re.Pattern], ...] = (
    (
        "KEY",
        "-----BEGIN",
        # as far as header fields, base 64 and the end mark go; a mark without any of them is no key
        re.compile(
            rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*)*"
            rf"(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:(?:{_GAP}[A-Za-z0-9+/]{{1,80}}={{0,2}})?{_GAP}{_END}|(?<=[A-Za-z0-9+/=]{{16}})(?:{_GAP}[A-Za-z0-9+/]{{1,80}}={{1,2}})?)"
        ),
    ),
    ("EMAIL", "@", re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")),
    (
        "SECRET",
        "",
        re.compile(
            r"\b[0-9a-fA-F]{32,}\b|\bAKIA[0-9A-Z]{16}\b|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+|\b(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abprs])[-_][A-Za-z0-9_-]{16,}"
            r"|(?<=[\"'])(?=[\w+/-]*\d)[\w+/-]{20,}={0,2}(?=[\"'])"
        ),
    ),
    ("IP", "", re.compile(rf"(?<![\w.]){_BYTE}(?:\.{_BYTE}){{3}}(?!\w|\.\d)")),
    ("IBAN", "", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("CARD", "", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("SSN", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    (
        "PHONE",
        "",
        re.compile(
            rf"(?<!\w)\+\d{{1,3}}{_SEP}\(?\d{{1,4}}\)?(?:{_SEP}\d{{2,4}}){{2,4}}(?!\w)"
            r"|(?<!\w)\(\d{2,5}\) ?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-])"
        ),
    ),
)
_LITERAL = ("@", "-----BEGIN", "AKIA", "eyJ")
_DIGIT = re.compile(r"\d")
_HEX = re.compile(r"[0-9a-fA-F]{32}")
_TOKEN = re.compile(r"[-_](?:(?<=[spr]k.)|(?<=gh[pos].)|(?<=glpat.)|(?<=xox[abprs].))")


def likely(text: str) -> bool:
    """Whether the text holds any of the signs of which every pattern's match has one."""
    return any(sign in text for sign in _LITERAL) or bool(_DIGIT.search(text) or _TOKEN.search(text) or _HEX.search(text))


_WORD = re.compile(r"\w+")
#: Words counted in a task before it hands them on.
_HELD = 200_000


def luhn(number: str) -> bool:
    """Whether the check digit of a card number is right."""
    digits = [int(d) for d in re.findall(r"\d", number)]
    return not sum(d if not i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10


def mod_97(account: str) -> bool:
    """Whether the check digits of an international account number are right."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


_CHECKS = {"CARD": luhn, "IBAN": mod_97}


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the protected entities of a text, in order, none overlapping."""
    if not likely(text):
        return []
    found: list[tuple[int, int, str]] = []
    for kind, sign, pattern in ENTITIES:
        if sign and sign not in text:
            continue
        # only what earlier classes left: a pattern must not run on into their entities
        bounds = [0, *(x for a, b, _ in sorted(found) for x in (a, b)), len(text)]
        for begin, end in zip(bounds[::2], bounds[1::2]):
            found += [(*m.span(), kind) for m in pattern.finditer(text, begin, end) if kind not in _CHECKS or _CHECKS[kind](m.group())]
    return sorted(found)


def entity_key(kind: str, value: str) -> str:
    """One key for the ways of writing an entity: without case, spaces and punctuation."""
    return kind + ":" + re.sub(r"[^\w@.]", "", value.lower()).strip(".")


def _windows(text: str) -> Iterator[tuple[str, set[str]]]:
    """For each entity: its key, and the words about it that belong to no entity."""
    found = entities(text)
    words = [(m.start(), m.group()) for m in _WORD.finditer(text.lower())] if found else []
    free, k = [], 0
    for start, word in words:
        while k < len(found) and found[k][1] <= start:
            k += 1
        if not (k < len(found) and found[k][0] <= start) and not word.isdigit():
            free.append((start, word))
    starts = [s for s, _ in free]
    i = 0
    for a, b, kind in found:
        while i < len(starts) and starts[i] < a:
            i += 1
        yield entity_key(kind, text[a:b]), {w for _, w in free[max(0, i - WINDOW) : i + WINDOW]}


def disclosing_terms(
    docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE
) -> DataFrame:
    """(term, disclosure): the terms that give away at least ``generalise`` of an entity's information.

    Entities are the values found and their classes.  All probabilities are shares of the rows of ``docs``.
    An entity of probability p carries IC = -log2 p bits; a term that has it within WINDOW words gives away
    PMI = log2 P(entity, term) / (P(entity) P(term)) of them.  The disclosure is PMI / IC: 1 if the term is
    never found without the entity.  P(entity | term) is the share counted where at least ``support``
    different texts have both; with fewer it is drawn towards p by the weight of one text, as p of a text
    more would be expected to have the entity.  The highest disclosure over all entities counts.
    """
    bodies = docs.select(quoted(text).alias("body")).where("body is not null")

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for body in batch.column(0).to_pylist():
                near: dict[str, set[str]] = {}
                for key, terms in _windows(body):
                    near.setdefault(key, {""}).update(terms)
                    near.setdefault(key.partition(":")[0], {""}).update(terms)
                if near:
                    digest = xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) >> 1
                    for key, terms in near.items():
                        for term in terms:
                            counts[key, term, digest] += 1
            rows = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))] + [pa.array([counts[r] for r in rows], pa.int64())],
                names=["entity", "term", "digest", "n"],
            )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for body in batch.column(0).slice(start, 256).to_pylist():
                    counts.update(set(_WORD.findall(body.lower())))
                if len(counts) > _HELD:
                    yield out()
                    counts.clear()
        yield out()

    found = bodies.mapInArrow(mentions, "entity string, term string, digest long, n long")
    joint = stage(
        found.groupBy("entity", "term", "digest").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")),
        "joint",
    )
    rows = docs.count()
    near = joint.where("term != ''")
    frequencies = bodies.mapInArrow(words, "term string, n long").join(near.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    entity = joint.where("term = ''").select("entity", F.col("n").alias("n_entity"))
    p = F.col("n_entity") / F.lit(float(max(rows, 1)))
    share = F.col("n") / F.col("n_term")
    given = F.when(F.col("texts") >= support, share).otherwise((F.col("texts") + p) / (F.col("texts") / share + 1))
    scored = near.join(entity, "entity").join(frequencies, "term").withColumn("disclosure", F.when(p < 1, 1 - F.log2(given) / F.log2(p)))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise)


def _classed(text: str, found: list[tuple[int, int, str]] | None = None) -> str:
    """The text with its entities generalised to their classes."""
    parts, at = [], 0
    for a, b, kind in entities(text) if found is None else found:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*parts, text[at:]])


def sanitised(text: str, remove: frozenset[str], general: frozenset[str]) -> tuple[str, int, int, int]:
    """The text with entities generalised to their class and disclosing terms generalised or removed."""
    found = entities(text)
    if found:
        text = _classed(text, found)
    n_general = n_removed = 0
    if remove or general:
        here = set(_WORD.findall(text.lower()))
        if not (remove.isdisjoint(here) and general.isdisjoint(here)):
            marks = {f"[{kind}]" for kind, _, _ in ENTITIES} | {GENERAL}

            def swap(m: re.Match) -> str:
                nonlocal n_general, n_removed
                word = m.group(2)
                if f"[{word}]" in marks and text[m.start(2) - 1 : m.end(2) + 1] == f"[{word}]":
                    return m.group()
                if (low := word.lower()) in remove:
                    n_removed += 1
                    return ""
                if low in general:
                    n_general += 1
                    return m.group(1) + GENERAL
                return m.group()

            text = re.sub(r"( ?)(\w+)", swap, text)
    return text, len(found), n_general, n_removed


_RESULT = "struct<text: string, entities: int, generalised: int, removed: int>"


def _cleaner(shared):
    """Sanitises texts by the terms broadcast, or by each row's own list of them (``word -`` for one to remove)."""

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        removed, general = shared.value if shared is not None else (frozenset(), frozenset())
        for texts, own in batches:
            rows = []
            for i, t in enumerate(texts):
                if shared is None:
                    mine = own[i].as_py() or []
                    removed = frozenset(x[1:] for x in mine if x[0] == "-")
                    general = frozenset(x[1:] for x in mine if x[0] == "+")
                rows.append((None, 0, 0, 0) if not t.is_valid else sanitised(t.as_py(), removed, general))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            parts = zip(*rows) if rows else [()] * 4
            yield pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], ["text", "entities", "generalised", "removed"])

    return run


class Bloom:
    """Words that may be in a set, in a fixed number of bytes; none of the set is missed."""

    def __init__(self, size: int) -> None:
        self.bits = np.zeros(size, np.uint8)

    def _places(self, words: list[str]) -> np.ndarray:
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * step) % np.uint64(8 * len(self.bits)) for i in range(4)])

    def add(self, words: list[str]) -> None:
        at = self._places(words).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, words: list[str]) -> np.ndarray:
        at = self._places(words)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def _with_clean(docs: DataFrame, text: str, terms: DataFrame, remove: float, name: str) -> DataFrame:
    """``docs`` with a column of the sanitised text and its counts.

    Terms that may be broadcast are.  More of them are joined: a Bloom filter of BROADCAST_BYTES, made in
    the tasks, picks each text's words that may be terms, which meet the terms by word and come back to their
    row as a list.  The corpus is read as often either way.
    """
    spark = docs.sparkSession
    rows, size = total_bytes(terms)
    if size + 60 * rows <= BROADCAST_BYTES:
        held = [tuple(r) for r in terms.select("term", "disclosure").collect()]
        gone = frozenset(t for t, d in held if d >= remove)
        shared = spark.sparkContext.broadcast((gone, frozenset(t for t, _ in held) - gone))
        return docs.withColumn(name, _cleaner(shared)(quoted(text), F.lit(None).cast("array<string>")))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(BROADCAST_BYTES)
        for batch in batches:
            if batch.num_rows:
                bloom.add(batch.column(0).to_pylist())
        at = np.flatnonzero(bloom.bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bloom.bits[at].astype(np.int32))], names=["at", "bits"])

    bloom = Bloom(BROADCAST_BYTES)
    bytes_of = terms.select("term").mapInArrow(fill, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for r in bytes_of.toLocalIterator():  # BROADCAST_BYTES rows at most
        bloom.bits[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bloom)
    uid, word, own = fresh(docs.columns, "uid", "word", "own")
    numbered = stage(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            words: list[str] = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                here = list(set(_WORD.findall(_classed(body).lower()))) if body else []
                if here:
                    here = [here[j] for j in np.flatnonzero(shared.value.has(here))]
                    words += here
                    ids += [i] * len(here)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(words, pa.string())], names=["uid", "word"])

    marked = terms.select(F.col("term").alias("word"), F.concat(F.when(F.col("disclosure") >= remove, "-").otherwise("+"), F.col("term")).alias("mark"))
    hits = numbered.select(quoted(uid).alias("uid"), quoted(text).alias("body")).mapInArrow(candidates, "uid long, word string").join(marked, "word")
    lists = stage(hits.groupBy("uid").agg(F.collect_list("mark").alias("marks")), "hits").select(F.col("uid").alias(uid), F.col("marks").alias(own))
    return numbered.join(lists, uid, "left").withColumn(name, _cleaner(None)(quoted(text), quoted(own))).drop(uid, own)


def sanitise(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """For every row of ``docs``: (doc_id, text, entities, generalised, removed).

    Protected entities (e-mail and IP addresses, phone, card and account numbers, secrets, keys) become
    their class, as ``[EMAIL]``.  Terms of :func:`disclosing_terms` become ``[TERM]``, in whatever document
    they are; from a disclosure of ``remove`` on they go altogether.  The counts say how many of each.
    All other text stays as it is, sign by sign.

    A null text stays null with counts of 0, an empty one stays empty; texts of any length are read
    whole; repeated rows are sanitised alike and count as one text for ``support``; an empty table gives
    no rows; other columns are not looked at.
    """
    terms = stage(disclosing_terms(docs, text, support, generalise), "terms")
    out = _with_clean(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("body")), "body", terms, remove, "s")
    return out.select("doc_id", "s.text", "s.entities", "s.generalised", "s.removed")


def sanitise_in_place(
    docs: DataFrame, text: str = "text", n_chars: str = "n_chars", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """All rows and columns of ``docs`` with the text of :func:`sanitise`, and its length in ``n_chars`` if there is one.

    A null text stays null and an empty one empty, and ``n_chars`` stays as it was where the text does (null
    included); texts of any length are read whole; repeated rows are sanitised alike and all stay; an empty
    table gives no rows; other columns, whatever their names, stay as they are.
    """
    terms = stage(disclosing_terms(docs, text, support, generalise), "terms")
    (name,) = fresh(docs.columns, "clean")
    out = _with_clean(docs, text, terms, remove, name)
    new = quoted(name)["text"]
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(new.alias(c))
        elif c == n_chars:
            kind = docs.schema[c].dataType
            columns.append(F.when(new.eqNullSafe(quoted(text)), quoted(c)).otherwise(F.char_length(new).cast(kind)).alias(c))
        else:
            columns.append(quoted(c))
    return out.select(*columns)
