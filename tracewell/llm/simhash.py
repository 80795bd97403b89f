"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, fresh, quoted, stage
from tracewell.llm.graph import components

BITS = 128
#: Fingerprints that differ in at most so many bits are near-duplicates if their texts overlap enough.
MAX_DISTANCE = 20
#: Share of their word triples that near-duplicates have in common at least, estimated from sketches of SLOTS bytes.
MIN_OVERLAP, SLOTS = 0.3, 64
#: Rows that a group of equal table keys holds on average, as far as the distance leaves keys of so many bits.
GROUP_ROWS = 512
#: Rows of equal table keys beyond which a group is cut into pieces, each pair of which is searched on its own; a
#: corpus whose groups are larger throughout has pieces of up to HOT_MOST rows.
HOT_GROUP, HOT_MOST = 16_384, 262_144
#: Rows of whole groups that a task searches at a time.
HELD_ROWS = 262_144
FANOUT = 8
#: Rows from which a group is searched by parts of the fingerprints, and what building, probing and comparing cost there.
PARTED = 256
BUILD, PROBE, COMPARE = 40, 1, 8
_WORD = re.compile(r"\w+")
_REMEMBER = 150_000


# ---- fingerprints


class Fingerprinter:
    """128-bit SimHash of the set of a text's words, without case and punctuation."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.signs = np.empty((1 << 12, BITS), np.int8)
        self.hashes = np.empty(1 << 12, np.uint64)

    def _rows(self, found: list[list[str]]) -> np.ndarray:
        at = self.at
        new = list(dict.fromkeys(w for row in found for w in row if w not in at))
        n = len(at)
        while n + len(new) > len(self.signs):
            self.signs = np.concatenate([self.signs, np.empty_like(self.signs)])
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        raw = b"".join(xxhash.xxh128_digest(w.encode("utf-8", "surrogatepass")) for w in new)
        self.hashes[n : n + len(new)] = np.frombuffer(raw, np.uint64)[::2]
        self.signs[n : n + len(new)] = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).astype(np.int8) * 2 - 1
        at.update(zip(new, range(n, n + len(new))))
        return np.fromiter((at[w] for row in found for w in row), np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """An array of (high, low) words, one row a text."""
        return self.both(texts)[0]

    def both(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, and the sketches of the texts' word triples."""
        ordered = [_WORD.findall(t.lower()) or ["\0" + t.strip()] for t in texts]
        if len(self.at) > _REMEMBER:
            self.at = {}
        words = self._rows(ordered)
        ends = np.cumsum([len(f) for f in ordered])
        each = np.split(words, ends[:-1])
        sketch = [sketches(self.hashes[np.concatenate(part)], np.cumsum([len(w) for w in part])) for part in (each[i : i + 64] for i in range(0, len(each), 64))]
        return self._prints([np.unique(w) for w in each]), np.concatenate(sketch)

    def _prints(self, found: list[np.ndarray]) -> np.ndarray:
        index = np.concatenate(found)
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        bits = np.empty((len(found), BITS), bool)
        for i in range(0, len(found), 64):
            j = min(len(found), i + 64)
            part = self.signs[index[starts[i] : starts[j]]]
            bits[i:j] = np.add.reduceat(part, starts[i:j] - starts[i], axis=0, dtype=np.int32) > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(text, slot): a byte of the least hash of each text's word triples in each of SLOTS slots, 0 if none falls there.

    ``words`` are the hashes of all texts' words in order, ``ends`` where each text's words end.  A text
    of one or two words has the one sequence of them in place of triples.
    """
    starts = np.concatenate([[0], ends[:-1]])
    left = np.repeat(ends, ends - starts) - np.arange(len(words))  # words from here to the text's end
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    after = np.concatenate([words[1:], [np.uint64(0)]]), np.concatenate([words[2:], np.zeros(2, np.uint64)])[: len(words)]
    one, two = np.where(left > 1, after[0], np.uint64(0)), np.where(left > 2, after[1], np.uint64(0))
    hashes = _mixed(_mixed(_mixed(words) + one * a) + two * b)
    whole = left > 2
    whole[starts[ends - starts < 3]] = True
    hashes, owner = hashes[whole], np.repeat(np.arange(len(ends)), ends - starts)[whole]
    least = np.full(len(ends) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * SLOTS + (hashes % np.uint64(SLOTS)).astype(np.int64), hashes // np.uint64(SLOTS))
    byte = (1 + _mixed(least) % np.uint64(255)).astype(np.uint8)
    return np.where(least == np.iinfo(np.uint64).max, np.uint8(0), byte).reshape(-1, SLOTS)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of the triples of both texts that they have in common, row by row of two sketches."""
    some = (a | b) != 0
    return ((a == b) & some).sum(1) / np.maximum(some.sum(1), 1)


def fingerprinted(docs: DataFrame, keep: list[str], text: str, names: tuple[str, str, str]) -> DataFrame:
    """The columns ``keep``, the two halves of the fingerprint and the sketch, null for a null text."""
    (body,) = fresh(keep, "body")
    schema = docs.select(*[quoted(c) for c in keep]).schema.add(names[0], "long").add(names[1], "long").add(names[2], "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(len(keep)).to_pylist()
                null = np.array([t is None for t in texts], bool)
                both, sketch = prints.both(["" if t is None else t for t in texts])
                halves = [pa.array(np.ascontiguousarray(both.view(np.int64)[:, k]), pa.int64(), mask=null) for k in (0, 1)]
                made = pa.array([None if n else x.tobytes() for n, x in zip(null, sketch)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *halves, made], names=schema.names)

    return docs.select(*[quoted(c) for c in keep], quoted(text).alias(body)).mapInArrow(run, schema)


# ---- the index


def gray_rank(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each 128-bit word in the reflected Gray sequence."""

    def prefix_xor(x: np.ndarray) -> np.ndarray:
        for s in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> np.uint64(s))
        return x

    high = prefix_xor(high)
    odd = (high & np.uint64(1)).astype(bool)  # parity of all higher bits
    low = prefix_xor(low)
    return high, np.where(odd, ~low, low)


def gray_order(prints: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """The places of fingerprints, by group if any, in Gray order."""
    high, low = gray_rank(prints[:, 0], prints[:, 1])
    return np.lexsort((low, high) if group is None else (low, high, group))


class GrayIndex:
    """Fingerprints in Gray order, group by group, under a hierarchy of shared bit patterns.

    A node stands for up to FANOUT consecutive nodes (at the bottom: fingerprints) of one group.  Its
    mask holds the bits that all below it agree on, apart from those that an upper node holds already;
    its pattern holds their values.  A search adds up differences on the way down and leaves a whole
    node as soon as the sum exceeds the distance allowed.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray, order: np.ndarray | None = None) -> None:
        """``order``: the places by group and Gray rank, where these are known."""
        self.order = gray_order(prints, group) if order is None else order
        self.prints = prints[self.order]
        self.group = group[self.order]
        self.levels: list[dict[str, np.ndarray]] = []
        if not len(group):
            return
        low, every, group = self.prints, self.prints, self.group
        last = np.arange(len(group))
        while True:
            fresh_group = np.concatenate([[True], group[1:] != group[:-1]])
            begin = np.flatnonzero(fresh_group)
            inside = np.arange(len(group)) - begin[np.cumsum(fresh_group) - 1]
            starts = np.flatnonzero(inside % FANOUT == 0)
            ends = np.concatenate([starts[1:], [len(group)]]) - 1
            shared, some = np.bitwise_and.reduceat(low, starts, axis=0), np.bitwise_or.reduceat(every, starts, axis=0)
            level = {"child": starts, "children": ends - starts + 1, "last": last[ends], "mask": shared | ~some, "pattern": shared}
            if self.levels:
                parent = np.repeat(np.arange(len(starts)), level["children"])
                self.levels[-1]["mask"] = self.levels[-1]["mask"] & ~level["mask"][parent]
            self.levels.append(level)
            low, every, group, last = shared, some, group[starts], last[ends]
            if (group[1:] != group[:-1]).all():
                break
        self.roots = group
        self.root_of = np.cumsum(np.concatenate([[False], self.group[1:] != self.group[:-1]]))

    def _own(self, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(self.group), step):
            yield np.arange(i, min(len(self.group), i + step)), self.root_of[i : i + step]

    def near_pairs(
        self, distance: int, most: int = 1 << 20, begin: Iterator[tuple[np.ndarray, np.ndarray]] | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair of sorted places i < j of one group within the distance, in batches.

        ``begin``: for places, the groups' roots under which they are searched, in place of their own.
        """
        step = max(1, most // FANOUT)
        for rows, nodes in self._own(step) if begin is None else begin:
            yield from self._down(rows, nodes, distance, step)

    def _down(self, rows: np.ndarray, nodes: np.ndarray, distance: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        work = [(len(self.levels) - 1, rows, nodes, np.zeros(len(rows), np.int64))]
        while work:
            depth, rows, nodes, spent = work.pop()
            if len(rows) > step:
                half = len(rows) // 2
                work += [(depth, rows[half:], nodes[half:], spent[half:]), (depth, rows[:half], nodes[:half], spent[:half])]
                continue
            level = self.levels[depth]
            apart = np.bitwise_count((self.prints[rows] ^ level["pattern"][nodes]) & level["mask"][nodes]).sum(1)
            spent = spent + apart
            on = (spent <= distance) & (level["last"][nodes] > rows)
            rows, nodes, spent = rows[on], nodes[on], spent[on]
            many = level["children"][nodes]
            total = np.cumsum(many)
            if not len(total):
                continue
            child = np.repeat(level["child"][nodes] - np.concatenate([[0], total[:-1]]), many) + np.arange(total[-1])
            rows = np.repeat(rows, many)
            if depth:
                work.append((depth - 1, rows, child, np.repeat(spent, many)))
                continue
            later = child > rows
            rows, child = rows[later], child[later]
            near = np.bitwise_count(self.prints[rows] ^ self.prints[child]).sum(1) <= distance
            if near.any():
                yield rows[near], child[near]


@lru_cache(maxsize=None)
def cheapest(width: int, rows: int, distance: int) -> tuple[float, int]:
    """What a search among ``rows`` fingerprints of ``width`` bits costs a row, and in how many parts; 0 if comparing all is cheaper.

    The costs are those of evenly spread bits and matter for time only.
    """
    best = COMPARE * rows / 2, 0
    for m in range(1, min(distance + 1, width) + 1):
        cost = BUILD * m
        for k in range(m):
            bits, radius = width // m + (k < width % m), (distance + 1) // m - (k >= (distance + 1) % m)
            if bits > math.log2(rows) + 2:
                cost = math.inf
                break
            cost += sum(math.comb(bits, r) for r in range(radius + 1)) * (PROBE + COMPARE * rows / 2 / (1 << bits))
        best = min(best, (cost, m))
    return best


def parts_of(places: np.ndarray, rows: int, distance: int) -> list[tuple[np.ndarray, int]]:
    """Parts of the bit places, each with a radius, for the search among ``rows`` fingerprints; none if comparing all is cheaper.

    Two fingerprints within the distance on these places are within the radius on at least one part: the radii,
    one more each, add up to the distance and one.
    """
    m = cheapest(len(places), rows, distance)[1]
    return [(part, (distance + 1) // m - (k >= (distance + 1) % m)) for k, part in enumerate(np.array_split(places, m))] if m else []


def values_at(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at the places, as a number."""
    value = np.zeros(len(prints), np.int64)
    for k, p in enumerate(places.tolist()):
        value |= (prints[:, p // 64] >> np.uint64(63 - p % 64) & np.uint64(1)).astype(np.int64) << np.int64(k)
    return value


def flips(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits of which at most ``radius`` are set, that without any first."""
    return np.array([sum(1 << b for b in on) for r in range(radius + 1) for on in combinations(range(width), r)], np.int64)


def near_in_group(
    prints: np.ndarray, parts: list[tuple[np.ndarray, int]], distance: int, most: int = 1 << 20
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of ``prints`` within the distance, each once, in batches: at least all within the radius of a part.

    For each part of the bits the fingerprints of equal bits there have a Gray index of their own, and each
    fingerprint goes down those whose bits are within the part's radius of its own.
    """
    n = len(prints)
    ranked = gray_order(prints)
    ahead, values = 0.0, []
    for part, radius in parts:
        values.append(values_at(prints, part))
        many = np.bincount(values[-1], minlength=1 << len(part)).astype(float)
        by = flips(len(part), radius)
        some = by[:: max(1, len(by) // 4)]
        ahead += sum(many @ many[np.arange(len(many)) ^ f] for f in some.tolist()) / len(some) * len(by)
    if not parts or ahead > n * n:  # bits so uneven that the parts would compare more than there are pairs
        index = GrayIndex(np.zeros(n, np.int64), prints, ranked)
        for i, j in index.near_pairs(distance, most):
            yield index.order[i], index.order[j]
        return
    masks = table_masks([part for part, _ in parts])
    for at, (part, radius) in enumerate(parts):
        order = np.argsort(values[at][ranked].astype(np.uint16 if len(part) <= 16 else np.int64), kind="stable")
        index = GrayIndex(values[at], prints, ranked[order])
        node_at = np.full(1 << len(part), -1, np.int64)
        node_at[index.roots] = np.arange(len(index.roots))
        by = flips(len(part), radius)

        def begin() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            step = max(1, most // len(by))
            for i in range(0, n, step):
                nodes = node_at[index.group[i : i + step, None] ^ by]
                row, k = np.nonzero(nodes >= index.root_of[i : i + step, None])
                yield i + row, nodes[row, k]

        for i, j in index.near_pairs(distance, most, begin()):
            apart = index.prints[i] ^ index.prints[j]
            new = np.ones(len(i), bool)
            for mask, (_, before) in zip(masks[:at], parts):
                new &= np.bitwise_count(apart & mask).sum(1) > before
            yield index.order[i[new]], index.order[j[new]]


def meet_first(apart: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of the pairs, given by their differing bits and a table they meet in, meet in no table before."""
    left = np.arange(len(apart))
    for t, mask in enumerate(masks[: table.max(initial=0)]):
        left = left[((apart[left] & mask) != 0).any(1) | (table[left] <= t)]
    return left


def near_in_groups(group: np.ndarray, table: np.ndarray, prints: np.ndarray, tables: list[np.ndarray], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of places of one group within the distance that meets in no table before, once, in batches.

    The fingerprints of a group agree on the key bits of its table.  Those that didn't meet before differ in the
    key of each earlier table, so beyond the first few keys they have that much less of the distance left.
    """
    masks = table_masks(tables)

    def fresh_pairs(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(i), 65_536):
            a, b = i[k : k + 65_536], j[k : k + 65_536]
            left = meet_first(prints[a] ^ prints[b], table[a], masks)
            yield a[left], b[left]

    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(group) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    few = order[np.repeat(sizes < PARTED, sizes)]
    index = GrayIndex(group[few], prints[few])
    for i, j in index.near_pairs(distance):
        yield from fresh_pairs(few[index.order[i]], few[index.order[j]])
    shuffled = np.random.default_rng(7).permutation(BITS)
    for k in np.flatnonzero(sizes >= PARTED).tolist():
        rows = order[starts[k] : starts[k] + sizes[k]]
        t, about = int(table[rows[0]]), 3 << int(sizes[k]).bit_length() >> 2
        free = BITS - len(tables[t]) - np.cumsum([0, *[len(key) for key in tables[:t]]])
        past = min(range(t + 1), key=lambda past: cheapest(int(free[past]), about, distance - past)[0])
        places = shuffled[~np.isin(shuffled, np.concatenate([tables[t], *tables[:past]]))]
        for i, j in near_in_group(prints[rows], parts_of(places, about, distance - past), distance):
            yield from fresh_pairs(rows[i], rows[j])


class Forest:
    """Disjoint sets over places, joined many pairs at a time; a set's root is its least place."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self._flatten()


# ---- tables


def key_bits(rows: int) -> int:
    """Bits of a table key for which a group of equal keys has about GROUP_ROWS rows."""
    return max(4, min(40, round(math.log2(max(rows, 1) / GROUP_ROWS)))) if rows > GROUP_ROWS else 4


def key_tables(bits: int, distance: int = MAX_DISTANCE, seed: int = 5) -> list[np.ndarray]:
    """For each table, the bit places that form its key: ``bits`` of them, or fewer.

    No place is in two keys and there are more tables than ``distance``, so fingerprints that differ in no more bits
    agree on all of at least one key.  If the distance is that of all bits, the one key is empty.
    """
    order = np.random.default_rng(seed).permutation(BITS)
    if distance >= BITS:
        return [order[:0]]
    return [places[:bits] for places in np.array_split(order, distance + 1)]


def table_keys(prints: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(tables, rows): the key of each fingerprint in each table, with the table's number on top."""
    return np.stack([(np.int64(t) << np.int64(40)) + values_at(prints, places) for t, places in enumerate(tables)])


def table_masks(tables: list[np.ndarray]) -> np.ndarray:
    """(table, 2): the bits of each table's key, as a mask of fingerprints."""
    masks = np.zeros((len(tables), 2), np.uint64)
    for t, places in enumerate(tables):
        for p in places.tolist():
            masks[t, p // 64] |= np.uint64(1) << np.uint64(63 - p % 64)
    return masks


def _links(prints: DataFrame, rows: int, distance: int) -> DataFrame:
    """(a, b, n) for distinct fingerprints and sketches: edges (b is set) that join all near-duplicates, and
    parts of the number of rows that ``a`` is linked to (n is set).

    Each pair within the distance is looked at in the first table in which it meets, and verified by its
    sketches.
    """
    spark = prints.sparkSession
    tables = key_tables(key_bits(rows), distance)
    piece_rows = max(HOT_GROUP, min(HOT_MOST, 2 * rows >> min(len(t) for t in tables)))

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return table_keys(np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1).view(np.uint64), tables).ravel()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch.slice(start, 4096)))], names=["key"])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                again = pa.array(np.tile(np.arange(part.num_rows), len(tables)))
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(part)), *[c.take(again) for c in part.columns]], names=["key", *part.schema.names])

    def found(held: pa.Table) -> Iterator[pa.RecordBatch]:
        both = np.stack([held["high"].to_numpy(), held["low"].to_numpy()], 1).view(np.uint64)
        key, piece, across = held["key"].to_numpy(), held["piece"].to_numpy(), held["across"].to_numpy()
        table, group = key >> 40, np.cumsum(changes(held)) - 1
        forest = Forest(held.num_rows)
        sketch = np.frombuffer(b"".join(held["sketch"].to_pylist()), np.uint8).reshape(-1, SLOTS)
        many, ids = held["m"].to_numpy(), held["id"].to_numpy()
        links = np.zeros(len(ids), np.int64)
        for i, j in near_in_groups(group, table, both, tables, distance):
            on = ~across[i] | (piece[i] != piece[j])
            i, j = i[on], j[on]
            alike = overlap(sketch[i], sketch[j]) >= MIN_OVERLAP
            i, j = i[alike], j[alike]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            forest.join(i, j)
        linked = np.flatnonzero(forest.parent != np.arange(len(ids)))
        edges = np.unique(np.stack([ids[linked], ids[forest.parent[linked]]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.int64())], names=["a", "b", "n"])
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], names=["a", "b", "n"])

    def changes(held: pa.Table) -> np.ndarray:
        key, block = held["key"].to_numpy(), held["block"].to_numpy()
        return np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come by key and block; whole groups are searched as soon as there are enough rows."""
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= HELD_ROWS:
                all_rows = pa.Table.from_batches(held)
                last = int(np.flatnonzero(changes(all_rows))[-1])
                if last:
                    yield from found(all_rows.slice(0, last))
                    held = all_rows.slice(last).combine_chunks().to_batches()
                    count -= last
                else:
                    held = all_rows.to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * len(tables) / 500_000))
    counts = prints.select("high", "low").mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = stage(counts.where(F.col("n") > piece_rows).select("key", F.ceil(F.col("n") / piece_rows).cast("int").alias("p")), "hot")
    scattered = prints.select("high", "low", "id", "m", "sketch").mapInArrow(scatter, "key long, high long, low long, id long, m long, sketch binary")
    if hot.limit(1).count():
        mine = F.pmod(F.xxhash64(F.lit(6), "id"), F.col("p")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("p", F.lit(1)) - 1))
        scattered = scattered.join(broadcast_if_small(hot), "key", "left").withColumn("piece", F.coalesce(mine, F.lit(0))).withColumn("other", other)
        block = (F.least("piece", "other") * F.coalesce("p", F.lit(1)) + F.greatest("piece", "other")).cast("int")
        scattered = scattered.withColumn("block", block).withColumn("across", F.col("piece") != F.col("other")).drop("p", "other")
        # across: the block is of two pieces, and only pairs across them count there
        scattered = scattered.repartition(parts, "key", "block")
    else:
        scattered = scattered.repartition(parts, "key").withColumns({"piece": F.lit(0), "block": F.lit(0), "across": F.lit(False)})
    return scattered.sortWithinPartitions("key", "block").mapInArrow(search, "a long, b long, n long")


def _grouped(keyed: DataFrame, distance: int) -> DataFrame:
    """``keyed`` rows (uid, doc_id, high, low, sketch) with ``group``, the least uid of the row's component, and ``links``."""
    print_of = ["high", "low", "sketch"]
    distinct = stage(keyed.where("high is not null").groupBy(*print_of).agg(F.min("uid").alias("id"), F.count(F.lit(1)).alias("m")), "prints")
    links = stage(_links(distinct, distinct.count(), distance), "links")
    roots = components(links.where("b is not null").select("a", "b"))
    linked = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = distinct.join(roots, distinct.id == roots.node, "left").join(linked, "id", "left")
    joined = joined.select(*print_of, F.coalesce("root", "id").alias("group"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    return keyed.join(joined, print_of, "left").select("uid", "doc_id", F.coalesce("group", "uid").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def _heads(groups: DataFrame) -> DataFrame:
    """Of each group: its first row by (doc_id, uid), nulls last, its least doc_id and its size."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    heads = groups.groupBy("group").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size"))
    return heads.select("group", F.col("f.uid").alias("head"), F.col("f.doc_id").alias("group_id"), "group_size")


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE
) -> DataFrame:
    """For every row of ``docs``: (doc_id, group_id, group_size, links, kept).

    Two rows are linked if their fingerprints differ in at most ``distance`` of 128 bits and they share about
    MIN_OVERLAP of their word triples or more, by an estimate that each pair must pass; ``links`` is the number
    of rows linked to this one.  Rows are in one group if a chain of links joins them.  ``group_id`` is the
    least doc_id of the group; ``kept`` is true for one row of each group, that of the least doc_id.  Every pair
    within the distance is found.  Texts of equal words in another order are no near-duplicates.

    A null text has no fingerprint: its row is a group of its own, without links, and is kept.  Texts without
    any word are in one group if they are equal but for outer white space.  Of rows with equal (or only null)
    doc_ids in a group still just one is kept; a null doc_id comes after all others, and is the
    group_id only of a group with no other.  Repeated rows are near-duplicates of each other.  Texts of
    any length count whole.  An empty table gives no rows; other columns are not looked at.
    """
    narrow = fingerprinted(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), ["doc_id"], "text", ("high", "low", "sketch"))
    keyed = stage(narrow.withColumn("uid", F.monotonically_increasing_id()), "keyed")
    groups = stage(_grouped(keyed, distance), "groups")
    return groups.join(_heads(groups), "group").select("doc_id", "group_id", "group_size", "links", (F.col("uid") == F.col("head")).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which :func:`near_duplicate_groups` keeps one a group.

    The rows are written once with their fingerprints and a row number, as decisions must hold for rows
    that have equal or null doc_ids; those that go are then left out by number.  Null, empty and very long
    texts, null and equal doc_ids, repeated rows and empty tables are dealt with as there; all columns,
    whatever their names, stay as they are.
    """
    columns = docs.columns
    high, low, sketch, uid = fresh(columns, "high", "low", "sketch", "uid")
    numbered = fingerprinted(docs, columns, text, (high, low, sketch)).withColumn(uid, F.monotonically_increasing_id())
    table = stage(numbered, "numbered")
    keyed = table.select(quoted(uid).alias("uid"), quoted(doc_id).alias("doc_id"), quoted(high).alias("high"), quoted(low).alias("low"), quoted(sketch).alias("sketch"))
    groups = stage(_grouped(keyed, distance), "groups")
    gone = stage(groups.join(_heads(groups), "group").where("uid != head").select(F.col("uid").alias(uid)), "gone")
    return table.join(broadcast_if_small(gone), uid, "left_anti").select(*[quoted(c) for c in columns])
