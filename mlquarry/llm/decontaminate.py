"""Finding benchmark items in documents by SimHash windows of the items' sizes.

A window of as many words as an item is compared with it: both get a 64-bit SimHash over their shingles of five words,
and the pair is a candidate if the fingerprints differ in at most RADIUS bits. Fingerprints of items are indexed by
BLOCKS blocks: within RADIUS = 23 bits, one of 8 blocks differs in at most 2, and for every block and value the items
that near are listed beforehand, so no fingerprint within the radius is missed. Candidates are then verified by the exact
similarity of their weighted shingles: shared over all, each counted as often as it occurs.

Only windows of a text that shares a shingle with an item of their size are fingerprinted, and only compared with such
items; all others have similarity 0. The items are a query set: they go to the tasks in blocks of at most ITEMS items and
CHARS characters, and documents are read where they are, with no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import chunks, empty_text

WIDTH, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BITS = 23, 8, 8
#: Items that a task holds at a time, and their characters (a longer item is a block of its own).
ITEMS, CHARS = 20_000, 20_000_000
#: Words whose hash a worker remembers, and windows fingerprinted at a time.
MEMORY, WINDOWS = 600_000, 4096
WORD = re.compile(r"\w+")


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = Hashes()


def words_of(text: str | None) -> list[str]:
    """Lower-case words; punctuation and white space do not count."""
    return WORD.findall((text or "").lower())


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A well-mixed 64-bit hash of every width hashed words in a row."""
    out = np.zeros(max(0, words.size - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + out.size]
    # the finishing steps of splitmix64 (fixed values)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def windows(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of the size shingles from each start on: a bit is set if it is set in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((hashes.size + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits((sums[starts + size] - sums[starts]) * 2 > size, axis=1, bitorder="little").view("<u8").reshape(-1)


def similarity(a: list[str], b: list[str], width: int) -> float:
    """Shared over all shingles of two word lists, each as often as it occurs."""
    one, two = (Counter(zip(*[x[k:] for k in range(width)], strict=False)) for x in (a, b))
    shared = (one & two).total()
    return shared / (one.total() + two.total() - shared) if shared else 0.0


class Items:
    """Benchmark items of known words with their fingerprints, by number of words."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        split = [(i, words_of(t)) for i, t in rows]
        self.ids = [i for i, w in split if w]
        self.words = [w for _, w in split if w]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.by_size = {int(n): np.flatnonzero(self.sizes == n) for n in np.unique(self.sizes)}
        prints = np.zeros(len(self.words), np.uint64)
        owners: dict[int, dict[int, dict[int, set[int]]]] = {}
        for j, words in enumerate(self.words):
            width = min(WIDTH, len(words))
            own = shingles(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), width)
            prints[j] = windows(own, np.array([0]), own.size)[0]
            for h in own.tolist():
                owners.setdefault(width, {}).setdefault(h, {}).setdefault(len(words), set()).add(j)
        self.prints = prints
        #: the place of each item among those of its size
        self.place = np.zeros(len(self.words), np.int64)
        for own in self.by_size.values():
            self.place[own] = np.arange(own.size)
        #: for each width the hashes of shingles in order, and by size the items that hold each
        self.widths = {w: (np.array(sorted(x), np.uint64), [{n: sorted(own) for n, own in x[h].items()} for h in sorted(x)]) for w, x in owners.items()}
        self.near: dict[int, np.ndarray] = {}

    def table(self, size: int) -> np.ndarray:
        """For each block and value which items of a size are within RADIUS // BLOCKS bits in that block."""
        if size not in self.near:
            values = np.arange(1 << BITS, dtype=np.uint64)
            own = self.prints[self.by_size[size]]
            parts = [(own >> np.uint64(BITS * b)) & np.uint64((1 << BITS) - 1) for b in range(BLOCKS)]
            self.near[size] = np.array([np.bitwise_count(values[:, None] ^ p) <= RADIUS // BLOCKS for p in parts])
        return self.near[size]

    def candidates(self, prints: np.ndarray, size: int, among: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(window, item) within RADIUS bits, by the index; only items among those of this size, if given."""
        near, among = self.table(size), self.by_size[size] if among is None else among
        columns = self.place[among]
        found = np.zeros((prints.size, among.size), bool)
        for b in range(BLOCKS):
            values = ((prints >> np.uint64(BITS * b)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            found |= near[b][values[:, None], columns[None, :]]
        at, item = np.nonzero(found)
        item = among[item]
        close = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
        return list(zip(at[close].tolist(), item[close].tolist(), strict=True))

    def matches(self, words: list[str], hashed: np.ndarray, touched: dict[int, tuple[list[int], set[int]]]) -> dict[int, tuple[float, int]]:
        """Item to its largest similarity in a text, and where it first starts. touched: for each size of window the
        places of shingles that items of this size hold, and these items."""
        best: dict[int, tuple[float, int]] = {}
        for size, (at_places, owners) in touched.items():
            places, among = np.array(at_places), np.array(sorted(owners))
            width = min(WIDTH, size)
            count, last = size - width + 1, len(words) - size
            if last < 0:
                continue
            # windows that hold one of the places: ranges of starts, merged
            marks = np.zeros(last + 2, np.int64)
            low, high = np.maximum(places - count + 1, 0), np.minimum(places, last)
            fits = low <= high
            np.add.at(marks, low[fits], 1)
            np.add.at(marks, high[fits] + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            for at in range(0, starts.size, WINDOWS):
                part = starts[at : at + WINDOWS]
                # a stretch per run of starts, so that far windows do not cost what lies between
                for run in np.split(part, np.flatnonzero(np.diff(part) > count) + 1):
                    own = shingles(hashed[run[0] : run[-1] + size], width)
                    for k, item in self.candidates(windows(own, run - run[0], count), size, among):
                        s = int(run[k])
                        value = similarity(words[s : s + size], self.words[item], width)
                        if value >= SIMILARITY and value > best.get(item, (0.0, 0))[0]:
                            best[item] = (value, s)
        return best


def search(texts: list[str], items: Items) -> list[dict[int, tuple[float, int]]]:
    """For each text the items in it, with similarity and first word."""
    if len(_hashes) > MEMORY:
        _hashes.clear()
    split = [words_of(t) for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    hashed = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(n.sum()))
    starts = np.cumsum(n) - n
    touched: list[dict[int, tuple[list[int], set[int]]]] = [{} for _ in texts]
    for width, (known, owners) in items.widths.items():
        own = shingles(hashed, width)
        if not own.size:
            continue
        at = np.minimum(np.searchsorted(known, own), known.size - 1)
        hits = np.flatnonzero(known[at] == own)
        docs = np.searchsorted(starts, hits, side="right") - 1
        inside = hits + width <= starts[docs] + n[docs]
        for p, d, k in zip(hits[inside].tolist(), docs[inside].tolist(), at[hits[inside]].tolist(), strict=True):
            for size, found in owners[k].items():
                places, own_items = touched[d].setdefault(size, ([], set()))
                places.append(p - int(starts[d]))
                own_items.update(found)
    return [items.matches(w, hashed[s : s + len(w)], t) if t else {} for w, s, t in zip(split, starts.tolist(), touched, strict=True)]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of ITEMS and CHARS at most, in no particular order."""
    held, chars = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        more = len(row[1] or "")
        if held and (len(held) == ITEMS or chars + more > CHARS):
            yield Items(held)
            held, chars = [], 0
        held.append((row[0], row[1]))
        chars += more
    yield Items(held)


MATCH = "item_id long, similarity double, start_word long, n_words long"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item with similarity SIMILARITY or more: doc_id, item_id, the largest similarity, and
    the first word and number of words of the first such window.

    An item of fewer than five words is one shingle; one without words, or null, matches nothing, and neither do texts
    without words. Items of one text are all reported. Repeated rows are reported each; columns other than doc_id, item_id
    and text are not looked at; an empty table gives an empty result.
    """
    out = None
    kind = docs.schema["doc_id"].dataType.simpleString()
    for items in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def kernel(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in chunks(batches):
                found = search(empty_text(batch.column(1).to_pylist()), items)
                rows = [(i, items.ids[j], value, s, len(items.words[j])) for i, x in enumerate(found) for j, (value, s) in sorted(x.items())]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]], names=["doc_id", *[x.split(" ")[0] for x in MATCH.split(", ")]])

        part = docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(kernel, f"doc_id {kind}, {MATCH}")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    for items in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def kernel(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                texts = pc.cast(batch.column(batch.schema.get_field_index("text")), pa.string()).to_pylist()
                yield batch.filter(pa.array([not x for x in search(empty_text(texts), held.value)], pa.bool_()))

        docs = docs.mapInArrow(kernel, docs.schema)
    return docs
