"""Benchmark decontamination with an FM-index per shard of documents.

A shard holds a few megabytes of texts as word numbers. Its suffix array gives the Burrows-Wheeler
transform, kept as a wavelet matrix. Test phrases are searched backwards, all at once; the rows found are
located by walking to the next sampled suffix position. Overlapping hits of a document are merged to
removal spans.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is 10 consecutive words
of an item, or all its words if fewer.

Defined results: null and empty texts have no words, hits or items, and a null text stays null. Items
without words never occur. Items with equal ids are one item. Repeated documents are each judged alike.
The windows of an item without an id count as hits, but there is no id to list. A text longer than a shard is read in
pieces that overlap by all but one word of a window. Columns of documents that bear a result's name are replaced.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import kept

WIDTH = 10
SHARD_BYTES = 3 << 20
SAMPLE = 8
#: Distinct windows searched in one pass, about; a larger benchmark takes several passes.
PHRASES = 200_000
#: Where a long text may be cut: at bytes of no word.
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; `symbols` are dense ranks and end in a symbol that occurs once.

    Ranks of prefixes of 1, 3, 9, ... symbols; after the first round only suffixes that are still tied.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64)
    size, step = n + 1, 1
    arity = 3 if size**3 < 1 << 63 else 2  # ranks that one 64-bit key holds

    def key(at):
        k = rank[at]
        for i in range(1, arity):
            to = at + i * step
            k = k * size + np.where(to < n, rank[np.minimum(to, n - 1)] + 1, 0)
        return k

    k = key(np.arange(n))
    order = np.argsort(k)
    k = k[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        rank[order] = np.repeat(starts, sizes)
        where = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(where):
            return order
        step *= arity
        at = order[where]
        k = key(at)
        inner = np.argsort(k)
        order[where], k = at[inner], k[inner]
        new[where] = np.concatenate(([True], k[1:] != k[:-1]))


class Wavelet:
    """Rank queries over a sequence of small numbers: one bit plane per level, stably partitioned."""

    def __init__(self, values: np.ndarray, bits: int):
        self.planes = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(values) - int(ones[-1])
            self.planes.append((level, ones, zeros))
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(upto), upto
        for level, ones, zeros in self.planes:
            one = (symbol >> level) & 1 == 1
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    """Words of a shard, searchable by phrases of known words.

    `known` are the words of the phrases, 1 and up; 0 is any other word or the end of a text. All words
    take part in the suffix order. Places after a 0 are sampled too, so no walk passes one.
    """

    def __init__(self, symbols: np.ndarray, known: np.ndarray, n_known: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        before = known[order - 1]  # the suffix at 0 follows the last symbol, an end
        # The rows of a known word lie together; where they begin does not follow from its number.
        self.size = np.bincount(known, minlength=n_known + 1)
        self.first = np.zeros(n_known + 1, np.int64)
        words = known[order]
        change = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        self.first[words[change]] = change
        self.wavelet = Wavelet(before.astype(np.int32), max(1, int(n_known).bit_length()))
        self.before = before
        marked = (order % sample == 0) | (before == 0)
        self.marked, self.sampled = np.concatenate(([0], np.cumsum(marked))), order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase; phrases are rows of word numbers, right-aligned."""
        width = phrases.shape[1]
        last = phrases[:, -1]
        low, high = self.first[last], self.first[last] + self.size[last]
        for k in range(width - 2, -1, -1):
            live = np.flatnonzero((high > low) & (lengths >= width - k))
            if not len(live):
                break
            c = phrases[live, k]
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            hit = self.marked[rows + 1] > self.marked[rows]
            out[todo[hit]] = self.sampled[self.marked[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self.before[rows]
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


def phrases_of(items: list[tuple[str | None, str]], width: int = WIDTH) -> Iterator[tuple[tuple[bytes, ...], str | None]]:
    """(window, item) for every window of every item."""
    for item, text in items:
        block = tokens.Block([(text or "").encode()], tokens.ALNUM)
        words, n = block.words(np.arange(block.count)), block.count
        for i in range(max(0, n - width) + 1 if n else 0):
            yield tuple(words[i : i + width]), item


class Phrases:
    """Windows of a slice of the benchmark as numbers, and the items of each."""

    def __init__(self, pairs, width: int = WIDTH):
        held: dict[tuple[bytes, ...], set[str]] = {}
        for window, item in pairs:
            of = held.setdefault(window, set())
            if item is not None:
                of.add(item)
        words = sorted({w for window in held for w in window})
        number = {w: i + 1 for i, w in enumerate(words)}
        hashes = tokens.word_hash([w.decode() for w in words])
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        self.n_words = len(words)
        self.lengths = np.array([len(w) for w in held], np.int64)
        self.table = np.zeros((len(held), width), np.int64)
        for i, w in enumerate(held):
            self.table[i, width - len(w) :] = [number[x] for x in w]
        self.items = [sorted(x) for x in held.values()]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not self.n_words:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n_words - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)


def hits(block: tokens.Block, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of the block lie in a window, and the items that occur in each text."""
    covered, items = np.zeros(block.count + 1, np.int64), [set() for _ in range(block.texts)]
    if not block.count or not len(phrases.lengths):
        return covered[:-1] > 0, items
    hashes = block.hashes()
    codes, _ = pd.factorize(hashes)
    # Each text ends in a symbol of its own, lower than any word, so that no order depends on the next text.
    place = np.arange(block.count) + block.owner
    ends = block.last + np.arange(block.texts)
    symbols = np.empty(block.count + block.texts, np.int64)
    symbols[place], symbols[ends] = codes + block.texts, np.arange(block.texts)
    known = np.zeros(len(symbols), np.int64)
    known[place] = phrases.known(hashes)
    index = FMIndex(symbols, known, phrases.n_words)
    low, high = index.search(phrases.table, phrases.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    at = index.locate(rows)
    owner = np.searchsorted(ends, at)
    word = at - owner
    np.add.at(covered, word, 1)
    np.add.at(covered, word + phrases.lengths[which], -1)
    seen = np.unique(owner * len(n) + which)
    for t, w in zip((seen // len(n)).tolist(), (seen % len(n)).tolist()):
        items[t].update(phrases.items[w])
    return np.cumsum(covered[:-1]) > 0, items


def spans(block: tokens.Block, hit: np.ndarray, text: int) -> list[tuple[int, int]]:
    """Merged removal spans of one text, in bytes: from a hit word's start to the end of the last one in a row."""
    a, b = block.first[text], block.last[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False])).view(np.int8)))
    base = block.text_at[text]
    return [(int(block.start[a + s] - base), int(block.end[a + e - 1] - base)) for s, e in zip(edge[0::2], edge[1::2])]


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """`phrase` (its words, joined by spaces) and `item` of every window of every item; made in tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[bytes, str | None]] = []
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for window, item in phrases_of([pair], width):
                    held.append((b" ".join(window), item))
                    if len(held) >= 10_000:
                        yield _windows(held)
                        held = []
            yield _windows(held)

    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL")
    return rows.mapInArrow(make, "phrase string, item string").distinct()


def _windows(held) -> pa.RecordBatch:
    phrase = pa.array([w for w, _ in held], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([phrase, pa.array([i for _, i in held], pa.string())], names=["phrase", "item"])


def _slices(benchmark: DataFrame, width: int, phrases: int) -> Iterator[Phrases]:
    """Windows of the benchmark in shares by hash of about `phrases` distinct ones; one share at a time comes here."""
    found = kept(windows(benchmark, width), "windows")
    shares = max(1, -(-found.select("phrase").distinct().count() // phrases))
    for i in range(shares):
        share = found.where(F.pmod(F.xxhash64("phrase"), F.lit(shares)) == i)
        yield Phrases(((tuple(r["phrase"].encode().split(b" ")), r["item"]) for r in share.toLocalIterator()), width)


RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: int, end: int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, phrases: int = PHRASES, remove: bool = False) -> DataFrame:
    """`docs` with `n_words`, `n_hit`, `items` found (sorted as strings) and `spans` (in UTF-8 bytes of `text`).

    With `remove` the spans are cut out of `text`, and what stood around one is joined by a space.
    A benchmark of more windows than `phrases` is searched slice by slice, each pass writing its marks for the
    next one to take along.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    slices = _slices(benchmark, width, phrases)
    part, again = next(slices), False
    while part is not None:
        after = next(slices, None)
        rows = rows.mapInArrow(_search(names, part, again, remove and after is None), f"{fields}, {RESULT}")
        if after is not None:  # one slice at a time is in memory
            rows = kept(rows, "searched")
        part, again = after, True
    return rows


def _search(names: list[str], phrases: Phrases, again: bool, remove: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = tokens.raw(batch["text"])
            earlier = batch["spans"].to_pylist() if again else None
            older = batch["items"].to_pylist() if again else None
            n_words, n_hit, found, cut = [], [], [], []
            for at, block in tokens.blocks([p if len(p) <= SHARD_BYTES else b"" for p in parts], tokens.ALNUM, SHARD_BYTES):
                hit, items = hits(block, phrases)
                if again:
                    _mark(block, hit, earlier[at : at + block.texts])
                    items = [x | set(y) for x, y in zip(items, older[at : at + block.texts])]
                total = np.concatenate(([0], np.cumsum(hit)))
                n_words += block.per_text.tolist()
                n_hit += (got := total[block.last] - total[block.first]).tolist()
                found += [sorted(x) for x in items]
                cut += [spans(block, hit, t) if got[t] else [] for t in range(block.texts)]
            for i in (i for i, p in enumerate(parts) if len(p) > SHARD_BYTES):
                n_words[i], n_hit[i], items, cut[i] = long_text(parts[i], phrases, earlier[i] if again else ())
                found[i] = sorted(items | set(older[i] if again else ()))
            columns = {c: batch[c] for c in names}
            if remove:
                columns["text"] = _without(batch["text"], parts, cut)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns |= {
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array(found, pa.list_(pa.string())),
                "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in cut], kind),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def long_text(text: bytes, phrases: Phrases, earlier=(), size: int | None = None) -> tuple[int, int, set[str], list[tuple[int, int]]]:
    """Words, hit words, items and spans of one text, read in pieces of about `size` bytes.

    A piece begins with the last words of the one before, one fewer than a window has, so no window is cut.
    """
    size = size or SHARD_BYTES
    overlap = phrases.table.shape[1] - 1
    found, items, at, more = [], set(), 0, size
    while True:
        gap = GAP.search(text, at + more) if at + more < len(text) else None
        block = tokens.Block([text[at : gap.start() if gap else len(text)]], tokens.ALNUM)
        hit, seen = hits(block, phrases)
        found.append((block.start + at, block.end + at, hit))
        items |= seen[0]
        if gap is None:
            break
        on = at + int(block.start[-overlap]) if block.count >= overlap > 0 else at
        if block.count and not overlap:
            on = gap.start()
        at, more = (on, size) if on > at else (at, 2 * more)  # too few words: the same again with more of the text
    start, end, hit = (np.concatenate(x) for x in zip(*found))
    place, first = np.unique(start, return_index=True)
    both = np.zeros(len(place), bool)
    both[np.searchsorted(place, start[hit])] = True
    for s in earlier:
        both[np.searchsorted(place, s["start"]) : np.searchsorted(place, s["end"])] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([False], both, [False])).view(np.int8)))
    cut = [(int(place[a]), int(end[first[b - 1]])) for a, b in zip(edge[0::2], edge[1::2])]
    return len(place), int(both.sum()), items, cut


def _mark(block: tokens.Block, hit: np.ndarray, earlier: list[list[dict]]) -> None:
    for t, old in enumerate(earlier):
        for s in old:
            a, b = (np.searchsorted(block.start, block.text_at[t] + s[k]) for k in ("start", "end"))
            hit[a:b] = True


def _without(texts, parts: list[bytes], cut: list[list[tuple[int, int]]]) -> pa.Array:
    if not any(cut):
        return texts
    out = []
    for valid, p, spans_ in zip(texts.is_valid().to_pylist(), parts, cut):
        if spans_:
            ends = [0, *(e for _, e in spans_)]
            left = [p[a:b] for a, b in zip(ends, [*(s for s, _ in spans_), len(p)])]
            p = b" ".join(x.strip() for x in left if x.strip())
        out.append(p if valid else None)
    return pa.array(out, pa.binary()).cast(pa.string())


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
