"""Passages that repeat within and across documents, by prefix-partitioned suffix trees.

Suffixes are those of texts as sequences of words, as deep as the least length of a passage.  Two steps
come before the trees.  Each window of ``min_words`` words belongs to the least of its GRAM-word sequences by
hash (the leftmost of equal ones), so that equal windows belong to equal sequences: windows whose sequence
occurs once in the corpus can't repeat and are left out, and all others meet in one task.  There, suffixes
are split by prefixes, one word longer each time a group is still too large, until groups fit in memory;
each group becomes a subtree (suffix array and depths of common prefixes), and its internal nodes at full
depth are the repeats.  Windows of a sequence that is too frequent for one task take their whole
``min_words`` words as prefix: at full depth a group is a single node, of which only the first place is
needed, and that is aggregated without being brought together.  Consecutive windows that repeat the same
place make a maximal passage.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, quoted, stage
from tracewell.operators.sets import numbered

#: Words that a passage has at least.
MIN_WORDS = 50
#: Words of the sequences that windows are assigned to.
GRAM = 16
#: Suffixes that are sorted at once.
GROUP_SUFFIXES = 65_536
#: Runs of a sequence beyond which its windows are split by their whole words at once.
HOT_RUNS = 50_000
#: Bytes of words that one task of the search holds.
PART_BYTES = 4 << 20
_REMEMBER = 200_000
_SLICE_WORDS = 300_000


class Words:
    """Texts as arrays of 32-bit word hashes (two words are taken for one with a chance of 2^-32)."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = text.split()
        at = self.at
        if len(at) > _REMEMBER:
            at = self.at = {}
        for word in set(found).difference(at):
            at[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(at.__getitem__, found), np.uint32, len(found))


def _gram_hashes(words: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of the ``length`` words from each place on."""
    n = len(words) - length + 1
    total = np.zeros(n, np.uint64)
    wide = words.astype(np.uint64) + np.uint64(1)
    for j in range(length):
        total *= np.uint64(factor)
        total += wide[j : j + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    return total


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the least, the leftmost of equal ones."""
    low, at, span = values, np.arange(len(values)), 1

    def joined(low: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[shift:] < low[:-shift]
        return np.where(right, low[shift:], low[:-shift]), np.where(right, at[shift:], at[:-shift])

    while span * 2 <= width:
        low, at = joined(low, at, span)
        span *= 2
    if span < width:
        low, at = joined(low, at, width - span)
    return at


def runs(words: np.ndarray, owners: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, count) of each run of windows that belong to one sequence and lie in one text.

    ``words`` are texts in a row; ``owners`` has the text of each word.
    """
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(words) < min_words:
        return none
    gram = min(GRAM, (min_words + 1) // 2)
    hashes = _gram_hashes(words, gram)
    anchor = _least(hashes, min_words - gram + 1)
    windows = len(words) - min_words + 1
    starts = np.flatnonzero(owners[:windows] == owners[min_words - 1 :])
    if not len(starts):
        return none
    own = anchor[starts]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return hashes[own[first]], starts[first], np.diff(np.append(first, len(starts)))


def subtrees(suffixes: np.ndarray, text: np.ndarray, full: int, limit: int = GROUP_SUFFIXES, depth: int = 0) -> Iterator[np.ndarray]:
    """Groups of suffixes with a common prefix that may be sorted in memory.

    ``suffixes`` are places in ``text``.  A group over the limit is split by its next word, so that
    prefixes are as long as they need to be; at depth ``full`` all suffixes are equal and stay together.
    """
    if len(suffixes) <= limit or depth == full:
        yield suffixes
        return
    order = np.argsort(text[suffixes + depth], kind="stable")
    suffixes = suffixes[order]
    word = text[suffixes + depth]
    cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    held: list[np.ndarray] = []
    size = 0
    for a, b in zip(cuts, np.append(cuts[1:], len(word))):
        if b - a > limit:
            yield from subtrees(suffixes[a:b], text, full, limit, depth + 1)
            continue
        if size + b - a > limit and held:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(suffixes[a:b])
        size += b - a
    if held:
        yield np.concatenate(held)


class Subtree:
    """The suffix tree of some suffixes down to depth ``full``: their order and the depths they part at."""

    def __init__(self, suffixes: np.ndarray, text: np.ndarray, full: int) -> None:
        rows = np.ascontiguousarray(text[suffixes[:, None] + np.arange(full)].astype(">u4"))
        order = np.argsort(rows.view(f"V{4 * full}").ravel(), kind="stable")
        rows = rows[order]
        same = rows[1:] == rows[:-1]
        #: Suffixes in the order of their words, and how many words each has in common with the one before.
        self.suffixes = suffixes[order]
        self.common = np.concatenate([[0], np.where(same.all(1), full, same.argmin(1))]) if len(rows) else np.empty(0, np.int64)

    def nodes(self, depth: int) -> np.ndarray:
        """The internal node at ``depth`` or deeper, nearest to the root, that each suffix is under; -1 if there is none.

        These are the stretches of suffixes with ``depth`` words or more in common.
        """
        node = np.cumsum(self.common < depth) - 1
        return np.where(np.bincount(node)[node] > 1, node, -1) if len(node) else node


def _passages(table: pa.Table, min_words: int = MIN_WORDS) -> pa.Table | None:
    """Of the runs of a partition: stretches of windows that occur elsewhere, each with its first place."""
    table = table.take(pa.array(np.lexsort([table[k].to_numpy() for k in ("start", "no", "gram")])))
    columns = {k: table[k].to_numpy() for k in ("gram", "no", "start")}
    lists = table["words"].combine_chunks()
    text = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    ends = np.cumsum(lists.value_lengths().to_numpy())
    begins = np.concatenate([[0], ends[:-1]])
    many = ends - begins - min_words + 1  # suffixes of full depth in each run
    run = np.repeat(np.arange(len(begins)), many)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    place = begins[run] + offset
    source = np.full(len(text), -1, np.int64)  # by place: the first suffix with the same words
    number = np.full(len(text), -1, np.int64)
    number[place] = np.arange(len(place))
    # suffixes of different sequences never have equal windows, so any of them may be in one subtree
    for group in subtrees(place, text, min_words):
        tree = Subtree(group, text, min_words)
        node = tree.nodes(min_words)
        on = node >= 0
        suffixes, node = tree.suffixes[on], node[on]
        if not len(node):
            continue
        by = np.lexsort((suffixes, node))
        suffixes, node = suffixes[by], node[by]
        head = np.concatenate([[True], node[1:] != node[:-1]])
        source[suffixes] = suffixes[np.flatnonzero(head)][np.cumsum(head) - 1]
    found = np.flatnonzero(source >= 0)
    if not len(found):
        return None
    mine, other = number[found], number[source[found]]
    fields = {
        "no": columns["no"][run[mine]],
        "start": columns["start"][run[mine]] + offset[mine],
        "source_no": columns["no"][run[other]],
        "source_start": columns["start"][run[other]] + offset[other],
    }
    new = np.ones(len(found), bool)
    new[1:] = run[mine][1:] != run[mine][:-1]
    for k, step in (("start", 1), ("source_no", 0), ("source_start", 1)):
        new[1:] |= fields[k][1:] != fields[k][:-1] + step
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(found)))
    return pa.table({**{k: v[first] for k, v in fields.items()}, "windows": count.astype(np.int64)})


_RUN = "gram long, high long, low long, start long, windows long"
_FULL = "gram long, no long, start long, words array<int>"
_WINDOW = "wh long, wl long, no long, start long"
_FOUND = "no long, start long, source_no long, source_start long, windows long"


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, source_doc_id, source_start): each repeated passage of each document.

    Words are what white space parts.  A passage is a maximal stretch of words of which every ``min_words`` in
    a row occur elsewhere (in another document, or another place of this one), and first at the place
    named as source.  The first place itself is listed too, as its own source, so that the rows with
    (source_doc_id, source_start) other than their own place are what deduplication removes.  "First" is
    by doc_id, then by a hash of the text, then by place.

    Of documents with equal texts each but the first has one passage, the whole text; so has the first,
    from itself, besides those it shares with others.  Null texts, and texts of fewer words, have none;
    texts of any length are read whole.  Ids may be of any type that can be ordered; a null doc_id comes
    last.  Rows equal in doc_id and text repeat each other like any others.  An empty table gives no rows;
    other columns are not looked at.
    """
    if min_words < 2:
        raise ValueError("a passage has two words at least")
    spark = docs.sparkSession
    texts = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("body")).where("body is not null")
    texts = texts.select("doc_id", F.xxhash64("body").alias("high"), F.xxhash64(F.lit(7), F.col("body")).alias("low"), "body")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Words()
        for batch in batches:
            held: list[np.ndarray] = []
            rows: list[int] = []
            size = 0
            for i, body in enumerate([*batch.column(2).to_pylist(), None]):
                if body is not None:
                    found = cut(body)
                    if len(found) >= min_words:
                        held.append(found)
                        rows.append(i)
                        size += len(found)
                if held and (body is None or size > _SLICE_WORDS):
                    lengths = np.array([len(h) for h in held])
                    owner = np.repeat(np.arange(len(held)), lengths)
                    gram, start, windows = runs(np.concatenate(held), owner, min_words)
                    who = owner[start]
                    of = pa.array(np.array(rows)[who])
                    local = start - (np.cumsum(lengths) - lengths)[who]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(local), pa.array(windows)],
                        names=["gram", "high", "low", "start", "windows"],
                    )
                    held, rows, size = [], [], 0

    rows = stage(texts.select("doc_id", "high", "low").withColumn("uid", F.monotonically_increasing_id()), "rows")
    all_runs = stage(texts.select("high", "low", "body").mapInArrow(find_runs, _RUN), "runs")
    # each copy of a text has all its windows in runs
    lengths = all_runs.groupBy("high", "low").agg(F.sum("windows").alias("windows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    distinct = rows.groupBy("high", "low").agg(first.alias("f"), F.count(F.lit(1)).alias("copies")).join(lengths, ["high", "low"])
    distinct = distinct.select("high", "low", F.col("f.none").alias("none"), F.col("f.doc_id").alias("first"), F.col("f.uid").alias("first_uid"), "copies", (F.col("windows") / F.col("copies") + (min_words - 1)).cast("long").alias("n_words"))
    known = stage(numbered(distinct, ("none", "first", "high", "low"), "no"), "texts")
    place = F.struct("high", "low", "start")
    often = all_runs.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")).where("a != b").select("gram", "n")
    often = stage(often, "often")
    hot = often.where(F.col("n") > HOT_RUNS).select("gram")
    if hot.limit(1).count():  # copies of a text don't make its sequences hot
        texts_of = all_runs.join(broadcast_if_small(hot), "gram").groupBy("gram").agg(F.countDistinct("high", "low", "start").alias("n"))
        hot = stage(texts_of.where(F.col("n") > HOT_RUNS).select("gram", F.lit(True).alias("hot")), "hot")
        often = often.join(broadcast_if_small(hot), "gram", "left").select("gram", F.coalesce("hot", F.lit(False)).alias("hot"))
    else:
        often = often.select("gram", F.lit(False).alias("hot"))
    kept = stage(
        all_runs.join(often, "gram")
        .groupBy("high", "low")
        .agg(F.collect_set(F.struct("start", "windows", "gram", "hot")).alias("runs"))
        .join(known.select("high", "low", "no"), ["high", "low"]),
        "kept",
    )
    count = lambda r: F.aggregate("runs", F.lit(0).cast("long"), r)
    sizes = kept.select(count(lambda s, x: s + x["windows"] + (min_words - 1)).alias("w"), F.exists("runs", lambda x: x["hot"]).alias("h"))
    words_held, any_hot = sizes.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.bool_or("h"), F.lit(False))).first()

    def cut_runs(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(gram, number of the text, start, words) of each run, hot or not."""
        cut = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for no, body, listed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    mine = [r for r in listed if r["hot"] == hot]
                    found = cut(body) if mine else None
                    for r in mine:
                        yield r["gram"], no, r["start"], found[r["start"] : r["start"] + r["windows"] + min_words - 1]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = cut_runs(batches, False)
        while some := list(itertools.islice(runs_of, 4096)):
            grams, numbers, starts, out = zip(*some)
            offsets = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (grams, numbers, starts)), whole], names=["gram", "no", "start", "words"])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, no, start, words in cut_runs(batches, True):
            one, two = _gram_hashes(words, min_words), _gram_hashes(words, min_words, 0xD6E8FEB86659FD93)
            columns = (one.view(np.int64), two.view(np.int64), np.full(len(one), no), start + np.arange(len(one)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["wh", "wl", "no", "start"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held and (out := _passages(pa.Table.from_batches(held), min_words)) is not None:
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    def with_bodies(kept: DataFrame, texts: DataFrame) -> DataFrame:
        """One body a text: copies are dropped before anything is cut from them."""
        bodies = texts.groupBy("high", "low").agg(F.any_value("body").alias("body"))
        return bodies.join(kept.hint("merge"), ["high", "low"]).select("no", "body", "runs")

    full = with_bodies(kept, texts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words_held * 4 / PART_BYTES))
    found = full.mapInArrow(fill, _FULL).repartition(parts, "gram").mapInArrow(search, _FOUND)
    if any_hot:
        hot_ones = stage(kept.where(F.exists("runs", lambda x: x["hot"])), "hot")
        some = texts.join(broadcast_if_small(hot_ones.select("high", "low")), ["high", "low"], "left_semi")
        windows = stage(with_bodies(hot_ones, some).mapInArrow(windows_of, _WINDOW), "windows")
        at = F.struct("no", "start")
        nodes = windows.groupBy("wh", "wl").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b")
        each = windows.join(nodes, ["wh", "wl"])
        found = found.unionAll(each.select("no", "start", F.col("a.no").alias("source_no"), F.col("a.start").alias("source_start"), F.lit(1).cast("long").alias("windows")))
    w = Window.partitionBy("no").orderBy("start", "source_no", "source_start")
    last = F.lag(F.struct("start", "windows", "source_no", "source_start")).over(w)
    goes_on = (
        (last["start"] + last["windows"] == F.col("start")) & (last["source_no"] == F.col("source_no")) & (last["source_start"] + last["windows"] == F.col("source_start"))
    )
    spans = (
        found.withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(w))
        .groupBy("no", "island")
        .agg(F.min("start").alias("start"), F.min("source_start").alias("source_start"), F.first("source_no").alias("source_no"), (F.sum("windows") + (min_words - 1)).alias("n_words"))
    )
    spans = spans.join(known.select(F.col("no").alias("source_no"), F.col("first").alias("source")), "source_no")
    listed = spans.groupBy("no").agg(F.collect_list(F.struct("start", "n_words", "source", "source_start")).alias("spans"))
    about = known.join(listed, "no", "left")
    kind = f"array<struct<start: long, n_words: long, source: {docs.schema[doc_id].dataType.simpleString()}, source_start: long>>"
    whole = F.array(F.struct(F.lit(0), F.col("n_words"), F.col("first"), F.lit(0))).cast(kind)
    none = F.array().cast(kind)
    own = F.when(F.col("copies") > 1, whole).otherwise(none)
    # a text that others copy whole may be listed as its own source already
    spans_of = F.coalesce(F.col("spans").cast(kind), none)
    others = F.when(F.col("copies") > 1, F.filter(spans_of, lambda x: x != whole[0])).otherwise(spans_of)
    shared = F.when(F.col("uid") == F.col("first_uid"), others).otherwise(none)
    return (
        rows.join(about.where(F.col("spans").isNotNull() | (F.col("copies") > 1)), ["high", "low"])
        .select("doc_id", F.explode(F.concat(own, shared)).alias("s"))
        .select("doc_id", F.col("s.start").alias("start_word"), F.col("s.n_words").alias("n_words"), F.col("s.source").alias("source_doc_id"), F.col("s.source_start").alias("source_start"))
    )
