"""Toxic documents: a learned lexicon, misspellings by automata, and scores of context windows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, fresh, quoted

#: Insults to start from; labelled documents add to them and veto those found in harmless ones.
SEED_TERMS = ("idiot", "imbecile", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser")
#: Labelled documents, at most about so many, from which the lexicon is learned.
TRAIN_ROWS = 20_000
#: Different neighbourhoods in toxic documents that a term must be seen in; copies of a text add none.
MIN_CONTEXTS = 12
#: Of a term's neighbourhoods, the share in toxic documents from which one find is enough, and from which
#: it is weak evidence: several finds within WEAK_WINDOW words are needed.
STRONG, WEAK = 0.998, 0.7
#: That share's lower confidence bound (at two standard deviations) must be at least this for a strong term.
STRONG_BOUND = 0.85
WEAK_WEIGHT, WEAK_WINDOW = 0.2, 250
#: Weak finds weigh more in texts of fewer words than this, up to DENSE_MOST times as much.
DENSE_WORDS, DENSE_MOST = 100, 2.0
#: A term is matched exactly only if a larger share of the clean documents than this has words that look like
#: it, and a larger share than of the toxic ones.
LOOKALIKES = 0.001
#: A document with a window score of at least this is rejected.
THRESHOLD = 0.6
WINDOW = 8

_WORD = re.compile(r"\w+")
_PREFIXES = range(4, 9)
_ADDRESS = frozenset("you your yours youre u ur du dich dir dein deine ihr euch tu toi te ton vous votre tú ti tus usted ustedes vos".split())
_REPORT = frozenset(
    "said says saying called calling calls wrote writes word words term terms quote quoted quotes insult insults slur named "
    "sagte nannte schrieb wort zitat dit appelé écrit mot terme dijo llamó escribió palabra término".split()
)
_MARKS = re.compile(r'["“”„«»\n]')
_REMEMBER = 200_000


# ---- automata


@dataclass(frozen=True)
class Lexicon:
    """Terms (``True``: also everything that starts with the term) and words known to be harmless."""

    terms: dict[str, bool]
    harmless: frozenset[str] = frozenset()
    #: Terms that are matched exactly only, as many harmless words look like them.
    exact: frozenset[str] = frozenset()
    #: Weight of a term where it isn't 1.
    weights: dict[str, float] = field(default_factory=dict)
    #: Beginnings that are terms as whole words too, and so may be misspelled.
    whole: frozenset[str] = frozenset()


def allowed_edits(term: str, exact: bool) -> int:
    """Misspellings are looked for in whole terms of four letters or more, two edits from nine letters on."""
    return 0 if exact or len(term) < 4 else 1 if len(term) < 9 else 2


def beginning_edits(term: str, exact: bool) -> int:
    """Of beginnings, in those of six letters or more: shorter ones are within an edit of too many words."""
    return 0 if exact or len(term) < 6 else 1


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of the passages between quotation marks, however long, within one line; in order of their ends.

    Straight marks open before a word or sign and close after one; of “ and ” each may be either, as languages
    differ.
    """
    out: list[tuple[int, int]] = []
    opened: dict[str, int] = {}
    for m in _MARKS.finditer(text):
        at, sign = m.start(), m.group()
        before, after = text[at - 1 : at] if at else " ", text[at + 1 : at + 2] or " "
        if sign == "\n":
            opened.clear()
        elif sign == '"':
            if '"' in opened and not before.isspace():
                out.append((opened.pop('"'), at + 1))
            elif not after.isspace() and not before.isalnum():
                opened['"'] = at
        elif sign in "„«":
            opened.setdefault(sign, at)
        else:
            opener = next((o for o in ("„“" if sign == "”" else "„" if sign == "“" else "«") if o in opened), None)
            if opener is not None:
                out.append((opened.pop(opener), at + 1))
            elif sign == "“":
                opened.setdefault(sign, at)
    return out


class FuzzyLexicon:
    """The intersection of the lexicon's trie with the Levenshtein automata of all words.

    A state is a set of (trie node, edits spent): all places in the trie that some word within the
    allowed distance of a term may have led to.  States and transitions are made when first met.
    """

    def __init__(self, lexicon: Lexicon) -> None:
        self.harmless, self.weights = lexicon.harmless, lexicon.weights
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.edits: list[int] = [0]  # that the term at a node allows, as a whole word and as a beginning
        self.starts: list[int] = [-1]
        for term, prefix in lexicon.terms.items():
            node = 0
            for sign in term:
                if sign not in self.children[node]:
                    self.children[node][sign] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.edits.append(0)
                    self.starts.append(-1)
                node = self.children[node][sign]
            self.term[node] = term
            exact = term in lexicon.exact
            self.edits[node] = allowed_edits(term, exact or prefix and term not in lexicon.whole)
            self.starts[node] = beginning_edits(term, exact) if prefix else -1
        self.most = [0] * len(self.children)  # edits that some term at or below a node allows
        for node in range(len(self.children) - 1, -1, -1):
            self.most[node] = max([self.edits[node], self.starts[node], *(self.most[c] for c in self.children[node].values())])
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        """The id of a state; places left out letters lead to are added first."""
        work = list(places.items())
        while work:
            node, spent = work.pop()
            for child in self.children[node].values():
                if spent + 1 <= self.most[child] and spent + 1 < places.get(child, 9):
                    places[child] = spent + 1
                    work.append((child, spent + 1))
        key = frozenset(places.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(spent, self.term[node]) for node, spent in key if self.term[node] is not None and spent <= max(self.edits[node], self.starts[node])]
            ends.sort(key=lambda e: (e[0], -self.weights.get(e[1], 1.0), e[1]))
            self.found.append((ends[0][1], ends[0][0]) if ends else None)
        return self.ids[key]

    def _move(self, state: int, sign: str) -> int:
        places: dict[int, int] = {}

        def put(node: int, spent: int) -> None:
            if spent <= self.most[node] and spent < places.get(node, 9):
                places[node] = spent

        for node, spent in self.sets[state]:
            if spent <= self.starts[node]:
                put(node, spent)  # whatever follows
            put(node, spent + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, spent + (letter != sign))
        to = self.moves[state][sign] = self._state(places)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed distance of the word, and the distance."""
        state, moves, dead = self.start, self.moves, self.dead
        for sign in word:
            to = moves[state].get(sign)
            state = self._move(state, sign) if to is None else to
            if state == dead:
                return None
        got = self.found[state]
        return None if got is None or got[1] and word in self.harmless else got


# ---- scores


class Scorer:
    """Scores whole texts: the highest score of any window around a term found."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton = FuzzyLexicon(lexicon)
        self.hits: dict[str, tuple[str, int]] = {}
        self.seen: set[str] = set()

    def __call__(self, text: str) -> tuple[float, int, int, int]:
        """(score, terms found, misspelled ones among them, quoted ones among them)."""
        lower = text.lower()
        found = _WORD.findall(lower)
        if len(self.seen) > _REMEMBER:
            self.hits, self.seen = {}, set()
        new = set(found).difference(self.seen)
        if new:
            match = self.automaton.match
            for word in new:
                if got := match(word):
                    self.hits[word] = got
            self.seen |= new
        return (0.0, 0, 0, 0) if self.hits.keys().isdisjoint(found) else self._windows(lower, found)

    def _windows(self, lower: str, found: list[str]) -> tuple[float, int, int, int]:
        at = [i for i, w in enumerate(found) if w in self.hits]
        spans = [m.span() for m in _WORD.finditer(lower)]
        quotes = np.zeros(len(lower) + 1, np.int32)  # by place: how many quotations it is in
        for a, b in quotations(lower):
            quotes[a] += 1
            quotes[b] -= 1
        quotes = np.cumsum(quotes)
        best, misspelled, in_quotes = 0.0, 0, 0
        weights = self.automaton.weights
        weak = [(i, 1 - 1.5 * edits / len(term)) for i in at for term, edits in (self.hits[found[i]],) if term in weights]
        first, inside, dense = 0, 0.0, min(DENSE_MOST, max(1.0, DENSE_WORDS / len(found)))
        for k, (i, weight) in enumerate(weak):
            inside += weight
            while weak[first][0] < i - WEAK_WINDOW:
                inside -= weak[first][1]
                first += 1
            best = max(best, WEAK_WEIGHT * inside * (dense if k > first else 1.0))
        for k, i in enumerate(at):
            term, edits = self.hits[found[i]]
            if term in weights:
                continue
            weight = 1 - 1.5 * edits / len(term)
            is_quoted = bool(quotes[spans[i][0]])
            around = found[max(0, i - WINDOW) : i + WINDOW + 1]
            company = sum(1 for other in (at[k - 1] if k else -WINDOW * 9, at[k + 1] if k + 1 < len(at) else 1 << 60) if abs(other - i) <= WINDOW)
            score = weight * (1 + 0.5 * (not _ADDRESS.isdisjoint(around)) + 0.25 * company)
            if is_quoted:
                score *= 0.4
            if not _REPORT.isdisjoint(found[max(0, i - 4) : i]):
                score *= 0.7
            best, misspelled, in_quotes = max(best, score), misspelled + (edits > 0), in_quotes + is_quoted
        return round(best, 6), len(at), misspelled, in_quotes


# ---- learning


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    train_rows: int = TRAIN_ROWS,
    seeds: tuple[str, ...] = SEED_TERMS,
    label_id: str = "doc_id",
    label: str = "toxic",
) -> Lexicon:
    """Terms and beginnings of words that toxic labelled documents have and others don't.

    Of the labelled documents a hash picks about ``train_rows`` at most, the only bound here.  A term
    counts by the different pairs of neighbours it has in toxic documents, so that a copied document
    doesn't make a term of each of its rare words.  Seeds stay unless harmless documents have them.
    Without labels the lexicon is the seeds.
    """
    spark = docs.sparkSession
    known = labels.select(quoted(label_id).alias("doc_id"), quoted(label).alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if not n:
        return Lexicon(dict.fromkeys(seeds, False))
    share = min(1.0, train_rows / n)
    known = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    train = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")).where("text is not null").join(broadcast_if_small(known), "doc_id")
    seed_set = set(seeds)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for body in batch.column(0).to_pylist():
                found = ["", *_WORD.findall(body.lower()), ""]
                pairs.update((w, xxhash.xxh64_intdigest(f"{a} {b}") >> 1) for a, w, b in zip(found, found[1:], found[2:]) if len(w) > 3)
            held = list(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([c for _, c in held], pa.int64())], names=["word", "context"])

    seen = train.where("toxic = 1").select("text").mapInArrow(contexts, "word string, context long").distinct()
    lengths = F.array(F.lit(0), *[F.lit(k) for k in _PREFIXES])
    features = (
        seen.select("word", "context", F.explode(lengths).alias("k"))
        .where("k = 0 or k < char_length(word)")
        .select(F.when(F.col("k") == 0, F.col("word")).otherwise(F.expr("substring(word, 1, k)")).alias("term"), (F.col("k") > 0).alias("prefix"), "word", "context")
        .groupBy("term", "prefix")
        .agg(F.countDistinct("context").alias("contexts"), F.countDistinct("word").alias("words"))
        .where(f"contexts >= {MIN_CONTEXTS} and (not prefix or words >= 3)")
    )
    candidates = {(r.term, r.prefix): r.contexts for r in features.toLocalIterator()}
    shared = spark.sparkContext.broadcast((frozenset(t for t, p in candidates if not p) | seed_set, frozenset(t for t, p in candidates if p)))

    def harmless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, beginnings = shared.value
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                found = _WORD.findall(body.lower())
                counts.update((w, False) for w in found if w in whole)
                counts.update((w[:k], True) for w in found for k in _PREFIXES if w[:k] in beginnings and len(w) > k)
        terms = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in terms], pa.string()), pa.array([p for _, p in terms], pa.bool_()), pa.array([counts[t] for t in terms], pa.int64())],
            names=["term", "prefix", "n"],
        )

    clean = train.where("toxic = 0").select("text")
    against = clean.mapInArrow(harmless, "term string, prefix boolean, n long").groupBy("term", "prefix").agg(F.sum("n").alias("n"))
    clean_finds = {(r.term, r.prefix): r.n for r in against.toLocalIterator()}
    terms: dict[str, bool] = {}
    weights: dict[str, float] = {}
    whole: set[str] = set()

    def bound(hits: int, others: int) -> float:
        """The lower end of Wilson's interval for the share of hits, at two standard deviations."""
        n = hits + others
        share = hits / n
        return (share + 2 / n - 2 * math.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)

    def add(least: float, surely: float, weight: float | None) -> None:
        """Terms of at least this precision that no shorter beginning covers, shortest first.

        A strong whole word is a term beside a beginning that covers it, as only whole words match misspelled.
        """
        for term, prefix in sorted(candidates, key=lambda f: (len(f[0]), not f[1], f[0])):
            contexts = candidates[term, prefix]
            covered = any(terms.get(term[:k]) for k in range(1, len(term) + 1))
            others = clean_finds.get((term, prefix), 0)
            if contexts >= least * (contexts + others) and bound(contexts, others) >= surely:
                if not prefix and weight is None and terms.get(term):
                    whole.add(term)
                if term in terms or covered and (prefix or weight is not None):
                    continue
                terms[term] = prefix
                if weight is not None:
                    weights[term] = weight

    add(STRONG, STRONG_BOUND, None)
    terms |= {t: False for t in seeds if t not in terms and not clean_finds.get((t, False))}
    add(WEAK, 0, WEAK_WEIGHT)
    fuzzy = FuzzyLexicon(Lexicon(dict(terms), whole=frozenset(whole)))

    def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, term, toxic, documents) of the words that match misspelled; word "" counts documents by term, term "" all."""
        counts: Counter = Counter()
        near: dict[str, str | None] = {}
        for batch in batches:
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = set(_WORD.findall(body.lower()))
                for w in here.difference(near):
                    got = fuzzy.match(w)
                    near[w] = got[0] if got and got[1] else None
                hits = [(w, near[w]) for w in here if near[w]]
                counts.update((w, t, toxic) for w, t in hits)
                counts.update(("", t, toxic) for t in {t for _, t in hits})
                counts["", "", toxic] += 1
        rows = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([counts[r] for r in rows], pa.int64())],
            names=["word", "term", "toxic", "n"],
        )

    attested: dict[str, str] = {}
    documents: Counter = Counter()
    found = train.select("text", "toxic").mapInArrow(lookalikes, "word string, term string, toxic int, n long").groupBy("word", "term", "toxic").agg(F.sum("n").alias("n"))
    for r in found.where("word = '' or toxic = 0").toLocalIterator():
        if r.word:
            attested[r.word] = r.term
        else:
            documents[r.term, r.toxic] = r.n
    share = lambda t, toxic: documents[t, toxic] / max(1, documents["", toxic])
    exact = frozenset(t for t in terms if share(t, 0) > max(LOOKALIKES, share(t, 1)))
    return Lexicon(terms, frozenset(w for w, t in attested.items() if t not in exact), exact, weights, frozenset(whole))


# ---- the operator

_RESULT = "struct<score: double, terms: int, misspelled: int, quoted: int>"


def _scored(text: str, lexicon: Lexicon, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf(_RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [(0.0, 0, 0, 0) if t is None else scorer(t) for t in (x.as_py() for x in batch)]
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
            parts = zip(*rows) if rows else [()] * 4
            yield pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], ["score", "terms", "misspelled", "quoted"])

    return score(quoted(text))


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every row of ``docs``: (doc_id, score, terms, misspelled, quoted, rejected).

    A term found (exactly, or within one or two edits if labelled harmless documents don't have that
    spelling) weighs less by its edits; the window of eight words about it raises the score for words
    of address and for other terms, and lowers it inside quotation marks and after words of reporting.
    Terms that harmless documents have too count little, and only several together are enough.  The
    score is that of the worst window; from ``threshold`` on the document is rejected.

    A null or empty text scores 0 and isn't rejected; texts of any length are read whole; repeated rows
    score alike; an empty table gives no rows; other columns are not looked at.
    """
    scored = docs.select(quoted(doc_id).alias("doc_id"), _scored(text, lexicon, docs).alias("s"))
    return scored.select("doc_id", "s.score", "s.terms", "s.misspelled", "s.quoted", (F.col("s.score") >= threshold).alias("rejected"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that :func:`toxicity_scores` doesn't reject.

    Null and empty texts stay; texts of any length are read whole; repeated rows stay or go alike; an empty
    table gives no rows; nulls in other columns, and columns of whatever names, stay as they are.
    """
    (name,) = fresh(docs.columns, "toxicity")
    return docs.withColumn(name, _scored(text, lexicon, docs)).where(quoted(name)["score"] < threshold).drop(name)
