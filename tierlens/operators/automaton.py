"""Many keywords found in one pass over each text: an Aho-Corasick automaton as arrays.

The keywords' prefixes are the states; a state's row of the table names the state after each character, and falls
back to its longest suffix that is a state. Texts are cut into overlapping pieces that are read in step, one
character of all pieces at a time, so the work is numpy's and independent of the number of keywords.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of keywords that one automaton takes; more keywords take more passes over the texts.
KEYWORD_CHARS = 4_000_000
#: Cells of one table. A set of keywords that needs more becomes several automata, run over the same batch.
CELLS = 1 << 24
#: Characters of a piece of text, and of the pieces read in step.
PIECE, TOGETHER = 1024, 1 << 21


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """All places of some keywords, which are distinct and not empty."""

    def __init__(self, keywords: list[str]):
        sizes = np.array([len(k) for k in keywords], np.int64)
        self.sizes, self.longest = sizes, int(sizes.max(initial=0))
        flat, first = points("".join(keywords)), np.cumsum(sizes) - sizes
        alphabet = np.unique(flat)
        self.classes = np.zeros(0x110000, np.uint16 if len(alphabet) < 65535 else np.uint32)
        self.classes[alphabet] = np.arange(1, len(alphabet) + 1)
        flat, width = self.classes[flat].astype(np.int64), len(alphabet) + 1
        at, levels, count = np.zeros(len(keywords), np.int64), [], 1
        for depth in range(self.longest):  # states by depth: distinct pairs of a state and the next character
            longer = np.flatnonzero(sizes > depth)
            edges, own = np.unique(at[longer] * width + flat[first[longer] + depth], return_inverse=True)
            at[longer] = count + own
            levels.append((edges // width, edges % width, np.arange(count, count + len(edges))))
            count += len(edges)
        self.word = np.full(count, -1, np.int64)  # the keyword that ends in a state
        self.word[at] = np.arange(len(keywords))
        self.table = np.zeros((count, width), np.int32)
        fall = np.zeros(count, np.int64)
        self.next = np.zeros(count, np.int64)  # the nearest suffix state where a keyword ends
        for parent, char, child in levels:
            deep = parent > 0
            fall[child[deep]] = self.table[fall[parent[deep]], char[deep]]
            self.table[parent, char] = child
            self.table[child] = self.table[fall[child]]
            self.next[child] = np.where(self.word[fall[child]] >= 0, fall[child], self.next[fall[child]])
        self.ends = (self.word >= 0) | (self.next > 0)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and keyword of every occurrence, overlapping ones too; by text and start."""
        flat = self.classes[points("".join(texts))]
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        per = np.where(sizes > 0, -(-sizes // PIECE), 0)
        text = np.repeat(np.arange(len(texts)), per)
        nominal = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * PIECE
        start = np.maximum(nominal - self.longest + 1, 0)
        length = np.minimum(nominal + PIECE, sizes[text]) - start
        order = np.argsort(-length, kind="stable")
        text, nominal, start, length = text[order], nominal[order], start[order], length[order]
        origin, state = base[text] + start, np.zeros(len(text), np.int64)
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        found = []
        for t, k in enumerate(active):
            now = self.table[state[:k], flat[origin[:k] + t]]
            state[:k] = now
            hit = np.flatnonzero(self.ends[now])
            hit = hit[start[hit] + t >= nominal[hit]]  # the overlap belongs to the piece before
            if len(hit):
                found.append(np.stack([text[hit], start[hit] + t + 1, now[hit]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        owner, end, state = np.concatenate(found, axis=1)
        out = []
        while len(state):
            word = self.word[state]
            own = word >= 0
            out.append(np.stack([owner[own], end[own] - self.sizes[word[own]], word[own]]))
            state = self.next[state]
            more = state > 0
            owner, end, state = owner[more], end[more], state[more]
        owner, at, word = np.concatenate(out, axis=1)
        order = np.lexsort((word, at, owner))
        return owner[order], at[order], word[order]


class Keywords:
    """Automata of a bounded size each, for a list of distinct keywords."""

    def __init__(self, keywords: list[str], cells: int = CELLS):
        self.keywords, self.parts = keywords, []
        width = len(np.unique(points("".join(keywords)))) + 1
        order = sorted(range(len(keywords)), key=keywords.__getitem__)
        part, states = [], 1
        for i in order:
            if part and (states + len(keywords[i])) * width > cells:
                self._add(part)
                part, states = [], 1
            part.append(i)
            states += len(keywords[i])
        if part:
            self._add(part)

    def _add(self, part: list[int]) -> None:
        self.parts.append((np.array(part), Automaton([self.keywords[i] for i in part])))

    def places(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, text, start, keyword) of the texts, some at a time; null texts are given as empty."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= TOGETHER):
                size += len(texts[to])
                to += 1
            some = []
            for numbers, automaton in self.parts:
                owner, start, word = automaton.places(texts[at:to])
                some.append(np.stack([owner, start, numbers[word]]))
            owner, start, word = np.concatenate(some, axis=1) if some else np.zeros((3, 0), np.int64)
            order = np.lexsort((word, start, owner))
            yield at, owner[order], start[order], word[order]
            at = to


def passes(words: DataFrame, column: str, chars: int = KEYWORD_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of a keyword table in shares by hash, each of about `chars` characters of distinct keywords.

    Only a share at a time comes to the driver, so what tasks are sent has a bounded size.
    """
    distinct = words.select(column).distinct()
    total = distinct.agg(F.sum(F.length(column))).first()[0] or 0
    shares = -(-total // chars)
    for i in range(shares):
        yield words.where(F.pmod(F.xxhash64(column), F.lit(shares)) == i).toPandas()


def matches(df: DataFrame, text: str, id_cols, table: pd.DataFrame, keyword: str, columns: dict[str, str]) -> DataFrame:
    """(id columns, `columns`) once for every row of `df` and distinct row of `table` whose keyword its text holds.

    `table` is held by every task, `columns` names columns of it with their types.
    """
    sent = df.sparkSession.sparkContext.broadcast(table.reset_index(drop=True))
    ids = df.select(*id_cols).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ids), *(f"`{c}` {t}" for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value.groupby(keyword, sort=True)
        found = Keywords(list(rows.groups))
        # The rows of `table` by keyword, one keyword after another.
        by = np.concatenate([np.asarray(v) for v in rows.indices.values()])
        count = np.array([len(v) for v in rows.indices.values()])
        first = np.cumsum(count) - count
        held = [pa.array(sent.value[c]) for c in columns]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for at, owner, _, word in found.places(texts):
                pairs = np.unique(owner * len(found.keywords) + word)
                owner, word = pairs // len(found.keywords) + at, pairs % len(found.keywords)
                n = count[word]
                row = by[np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                own = [c.take(pa.array(np.repeat(owner, n))) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, *(c.take(pa.array(row)) for c in held)], names=[*ids.names, *columns])

    return df.select(*id_cols, F.col(text).alias("_text")).mapInArrow(run, fields)


def positions(df: DataFrame, text: str, words: pd.DataFrame, keyword: str, name: str) -> DataFrame:
    """`df` with `name`: array of (start, size) of all places of all keywords in its text, by start."""
    sent = df.sparkSession.sparkContext.broadcast(sorted(set(words[keyword])))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Keywords(sent.value)
        sizes = np.array([len(k) for k in sent.value], np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            starts, lengths, per = [], [], np.zeros(len(texts), np.int64)
            for at, owner, start, word in found.places(texts):
                per[at : at + len(np.bincount(owner))] += np.bincount(owner)
                starts.append(start)
                lengths.append(sizes[word])
            place = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(starts or [[]]), pa.int32()), pa.array(np.concatenate(lengths or [[]]), pa.int32())], ["start", "size"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), place)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    return df.mapInArrow(run, f"{fields}, `{name}` array<struct<start:int,size:int>>")


def nearest(places: Column, start: Column, end: Column) -> Column:
    """Characters between [start, end) and the closest of the places; 0 when touching, null without one.

    Places come by start; their ends are sorted once more, and one walk over each list finds the last end left of
    the span and the first start right of it.
    """
    ends = F.array_sort(F.transform(places, lambda p: p["start"] + p["size"]))
    right = F.filter(places, lambda p: p["start"] > end)
    left = F.filter(ends, lambda e: e < start)
    # What neither lies right of the span nor ends left of it touches it.
    touching = F.size(places) - F.size(right) - F.size(left) > 0
    gap = F.least(F.get(right, F.lit(0))["start"] - end, start - F.get(left, F.size(left) - 1))
    return F.when(touching, F.lit(0)).otherwise(gap)
