"""Byte-pair encoding by speculation and verification, and decoding."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import fresh, quoted

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words a worker remembers before it starts anew; bounds memory, changes no result.
REMEMBER = 500_000
#: Pairs whose verdict a worker remembers, likewise.
REMEMBER_PAIRS = 2_000_000
#: Bytes beyond which a word is merged with a heap.
LONG_WORD = 64
#: Characters cut into words at a time; bounds memory, changes no result.
SLICE_CHARS = 500_000

# Words as the vocabulary was made for: contractions, letters, numbers, other signs, white space.
_EXACT = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
)
_QUICK = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: Code points below which the two patterns are compared sign by sign; texts beyond take the exact one.
_COMPARED = 0x600


def _odd_signs() -> str:
    """Signs that the two patterns put in different classes, as numbers that aren't digits."""
    classes = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\p{White_Space}", r"\s"))
    signs = [chr(i) for i in range(_COMPARED)]
    return "".join(re.escape(c) for c in signs if any(bool(regex.match(a, c)) != bool(re.match(b, c)) for a, b in classes))


_ODD = re.compile(f"[{_odd_signs()}]|[^\x00-{chr(_COMPARED - 1)}]")


def words(text: str) -> list[str]:
    """Cut a text into the words that are encoded one by one; joined, they are the text."""
    return _EXACT.findall(text) if _ODD.search(text) else _QUICK.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a token in base 64 and its rank on each line."""
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in rows}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact encoding: merge the adjacent pair of lowest rank, leftmost first, while there is one."""
    if len(word) > LONG_WORD:
        return _merged_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = 1 << 62
    gains = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while gains:
        least = min(gains)
        if least == none:
            break
        i = gains.index(least)
        parts[i] += parts.pop(i + 1)
        gains.pop(i)
        if i < len(gains):
            gains[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            gains[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """:func:`merged` with a heap of pairs and links between neighbours: n log n steps for n bytes."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins at a place; 0 where none does
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != to:
            continue  # one of the two was merged since
        end[i], end[middle] = to, 0
        if to < n:
            before[to] = i
            if (rank := ranks.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (rank, i, end[to]))
        if (left := before[i]) >= 0 and (rank := ranks.get(word[left:to])) is not None:
            heapq.heappush(heap, (rank, left, to))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


class SpeculativeBpe:
    """Encoder of words: greedy longest match, a check of adjacent pairs, exact merging of the rest.

    A sequence of tokens is what merging gives if and only if each adjacent pair of them is what
    merging gives for the pair's own bytes.  Verdicts on pairs are kept as sorted arrays, so that all
    pairs of a batch of words are looked up at once.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # the longest token that starts with given two bytes
        self.longest: dict[bytes, int] = {}
        for token in ranks:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 1))
        lengths = np.fromiter(map(len, self.tokens), np.int64, self.size)
        self.token_ends = np.cumsum(lengths)
        self.token_lengths = lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pairs = np.empty(0, np.int64)  # known pairs, sorted
        self.fits = np.empty(0, bool)
        self.counts = {"words": 0, "merged": 0}
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i + 1] is where word i ends in flat
        self.n = 0

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        ranks, longest, out, i, n = self.ranks, self.longest, [], 0, len(word)
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while (rank := ranks.get(word[i:j])) is None:
                j -= 1
            out.append(rank)
            i = j
        return out

    def _verdicts(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) is what merging gives; unknown ones are worked out."""
        wanted, back = np.unique(keys, return_inverse=True)
        if len(self.pairs) > REMEMBER_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        at = np.searchsorted(self.pairs, wanted)
        known = np.zeros(len(wanted), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == wanted[inside]
        if not known.all():
            new = wanted[~known]
            tokens, ranks = self.tokens, self.ranks
            left, right = (new // self.size).tolist(), (new % self.size).tolist()
            fit = np.fromiter((merged(tokens[a] + tokens[b], ranks) == [a, b] for a, b in zip(left, right)), bool, len(new))
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fit])[order]
            at = np.searchsorted(self.pairs, wanted)
        return self.fits[at][back]

    def encode_words(self, new: list[str]) -> list[list[int]]:
        """The tokens of each word of a batch."""
        ranks, raw = self.ranks, [w.encode("utf-8", "surrogatepass") for w in new]
        ids = [[rank] if (rank := ranks.get(b)) is not None else self.proposed(b) for b in raw]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(ids)), lengths)
        inner = owner[1:] == owner[:-1]
        if inner.any():
            fit = self._verdicts((flat[:-1] * self.size + flat[1:])[inner])
            wrong = np.unique(owner[1:][inner][~fit]).tolist()
            for i in wrong:
                ids[i] = merged(raw[i], ranks)
            self.counts["merged"] += len(wrong)
        self.counts["words"] += len(new)
        return ids

    def _learn(self, new: list[str]) -> None:
        ids = self.encode_words(new)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), np.int32, int(lengths.sum()))
        used = int(self.ends[self.n])
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(new)] = used + np.cumsum(lengths)
        self.at.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and how many each text has."""
        cut = [words(t) for t in texts]
        if self.n > REMEMBER:
            self.forget()
        at = self.at
        new = {w for row in cut for w in row if w not in at}
        if new:
            self._learn(list(new))
        each = np.fromiter(map(len, cut), np.int64, len(cut))
        index = np.fromiter((at[w] for row in cut for w in row), np.int64, int(each.sum()))
        starts, lengths = self.ends[index], self.ends[index + 1] - self.ends[index]
        total = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])
        bounds = np.concatenate([[0], np.cumsum(each)])
        return self.flat[place], total[bounds[1:]] - total[bounds[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of tokens."""
        ids = np.asarray(ids, np.int64)
        lengths = self.token_lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat(self.token_ends[ids] - lengths - total[:-1], lengths) + np.arange(total[-1])
        raw = self.token_bytes[place].tobytes()
        cuts = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _slices(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, some at a time: as many as are about SLICE_CHARS long, one at least."""
    ends = np.cumsum(np.nan_to_num(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = min(start + 512, max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, "right"))))
        yield column.slice(start, end - start).to_pylist()
        start = end


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode every text and decode it again.

    Returns the columns ``keep`` (default: all but the text) with ``tokens`` (array of int),
    ``n_tokens`` and ``round_trip`` (whether the decoded bytes are the text's).  Encoding runs in one
    narrow pass over Arrow batches; only the vocabulary, of fixed size, is broadcast.

    A null text has null ``tokens``, ``n_tokens`` and ``round_trip``; an empty one has an empty array,
    0 and true.  Repeated rows are encoded each; texts of any length are encoded whole; an empty table
    gives no rows; a kept column named like a new one stays and the new one gets a suffix.
    """
    kept = [c for c in docs.columns if c != text] if keep is None else keep
    tokens, n_tokens, round_trip, body = fresh(kept, "tokens", "n_tokens", "round_trip", "body")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType(
        [
            *[fields[c] for c in kept],
            T.StructField(tokens, T.ArrayType(T.IntegerType(), False)),
            T.StructField(n_tokens, T.LongType()),
            T.StructField(round_trip, T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpeculativeBpe(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            done = 0
            for part in _slices(batch.column(len(kept))):
                real = [t or "" for t in part]
                ids, counts = encoder.encode(real)
                null = np.fromiter((t is None for t in part), bool, len(part))
                good = [a == b.encode("utf-8", "surrogatepass") for a, b in zip(encoder.decode(ids, counts), real)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(null, False))
                cut = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[cut.column(i) for i in range(len(kept))],
                        pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                        pa.array(counts, pa.int64(), mask=null),
                        pa.array(np.array(good, bool), mask=null),
                    ],
                    names=[f.name for f in schema.fields],
                )

    return docs.select(*[quoted(c) for c in kept], quoted(text).alias(body)).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY, tokens: str = "tokens") -> DataFrame:
    """All columns of ``encoded`` and ``text``, the decoded tokens; null tokens give a null text.

    Bytes that aren't valid UTF-8 (from tokens cut apart elsewhere) become U+FFFD.
    """
    (name,) = fresh(encoded.columns, "text")
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    place = encoded.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpeculativeBpe(shared.value)
        for batch in batches:
            lists = batch.column(place)
            valid = lists.is_valid().to_pylist()
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            out = [r.decode("utf-8", "replace") if v else None for r, v in zip(raw, valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return encoded.select(*[F.col(f"`{c}`") for c in encoded.columns]).mapInArrow(run, schema)
