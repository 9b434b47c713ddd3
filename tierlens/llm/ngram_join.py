"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

1. Texts become sets of n-gram hashes. The hash space is cut into fragments; one task per fragment counts
   in how many different sets each of its n-grams occurs.
2. The global order is by that count, then hash. An n-gram of one set only can't link it to another, so a
   set is left with its shared n-grams, and two sets that link share one within their prefixes: the first
   `n - ceil(share * n) + 1` n-grams. Sets with no shared n-gram there are done.
3. Sets that meet at a prefix n-gram are candidates. Overlaps of a pair are counted separately in each
   vertical fragment of the order and then summed per pair.
   Short lists give pairs. A long list is cut into blocks of sets instead; each pair of blocks sums its
   partial overlaps as matrices and reports a spanning forest of its links, so a group of copies is
   never written out as pairs. A pair is judged in one place only: in the short lists if it meets there, else at
   its first common long list.
4. Sets are numbered by a hash of their n-grams, so equal sets are one class from the start.

Defined results: words are runs of `[^\\x20\\x09-\\x0D]` with A-Z lower-cased. A text with fewer words than `width`
is one n-gram of all of them. Null texts and texts without words have an empty set, link with nothing and are
their own component. Repeated rows are copies of each other. A component's id is its smallest non-null
doc_id. N-grams and sets are told apart by 64-bit hashes. Only `doc_id` and `text` are read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .store import kept, parts

WIDTH = 5
#: Link when 100 * intersection >= SHARE * union.
SHARE = 75
#: Sets in a list that gives pairs, sets in a block of a longer list, vertical fragments of a set.
SHORT, BLOCK, FRAGMENT_BITS = 64, 512, 3
#: N-grams that a map task holds before it sends them on, and columns of a partial overlap matrix.
HELD, COLUMNS = 1_500_000, 4096
#: Rows of a fragment before common n-grams are sent on, how many classes make an n-gram common, and its count then.
FRAGMENT_ROWS, COMMON, EVERYWHERE = 6_000_000, 100_000, 1 << 40

ROWS = "part int, doc_id bigint, n bigint, cls bigint, grams binary, owners binary"


def _rows(part, doc_id=None, n=None, cls=None, grams=None, owners=None) -> pa.RecordBatch:
    size = len(part)
    cols = [
        pa.array(part, pa.int32()), *(pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (doc_id, n, cls)),
        *(pa.nulls(size, pa.binary()) if c is None else pa.array(c, pa.binary()) for c in (grams, owners)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "n", "cls", "grams", "owners"])


def gram_sets(parts_: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, block in tokens.blocks(parts_, tokens.SPACE):
        hashes = block.hashes()
        grams, at = tokens.windows(block, hashes, width)
        first = np.searchsorted(at, block.first)
        last = np.append(first[1:], len(at))
        for t in range(block.texts):
            if block.per_text[t] >= width:
                yield np.unique(grams[first[t] : last[t]])
            else:
                own = hashes[block.first[t] : block.last[t]]
                yield np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), np.uint64)[: len(own)]


def _split(width: int, fragments: int):
    """Documents to (doc_id, set size, class) rows and packed n-grams per fragment of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes, classes, held, seen, total = [], [], [], set(), 0
            for s in gram_sets(tokens.raw(batch.column(1)), width):
                sizes.append(len(s))
                cls = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                classes.append(cls)
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    held.append((cls, s))
                    total += len(s)
                if total >= HELD:
                    yield _by_fragment(held, fragments)
                    held, total = [], 0
            if held:
                yield _by_fragment(held, fragments)
            yield _rows(np.arange(len(ids)) % fragments, ids, sizes, classes)

    return run


def _by_fragment(held, fragments: int) -> pa.RecordBatch:
    grams = np.concatenate([s for _, s in held])
    sizes = np.array([len(s) for _, s in held])
    classes = np.array([c for c, _ in held], np.int64)
    which = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
    owner = np.repeat(np.arange(len(held)), sizes)
    order = np.argsort(which, kind="stable")
    grams, owner = grams[order], owner[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=fragments))))
    g, o = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own, count = np.unique(owner[a:b], return_counts=True)
        g.append(grams[a:b].tobytes())
        o.append(np.stack([classes[own], sizes[own], count]).astype(np.int64).tobytes())
    return _rows(np.arange(fragments), grams=g, owners=o)


def _shared(gram, cls, n, least: int):
    """Distinct (n-gram, class) rows sorted by n-gram, with the class counts of n-grams in `least` classes and up."""
    order = np.argsort(gram)
    gram = gram[order]
    same = gram[1:] == gram[:-1]
    several = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(gram) else np.zeros(0, bool)
    gram, order = gram[several], order[several]
    again = np.lexsort((cls[order], gram))
    gram, order = gram[again], order[again]
    cls, n = cls[order], n[order]
    # A class met in several map tasks counts once.
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
    gram, cls, n = gram[new], cls[new], n[new]
    first = np.ones(len(gram), bool)
    first[1:] = gram[1:] != gram[:-1]
    df = np.diff(np.append(np.flatnonzero(first), len(gram)))
    df = np.repeat(df, df)
    return [x[df >= least] for x in (gram, cls, n, df)]


def _to_buckets(gram, cls, n, df, buckets: int) -> pa.RecordBatch:
    bucket = np.mod(cls, buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    packed = np.stack([gram.view(np.int64), cls, n, df])[:, order]
    full = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
    return _rows(full, grams=[packed[:, bounds[b] : bounds[b + 1]].tobytes() for b in full], owners=[b""] * len(full))


def _count(buckets: int, held_most: int = FRAGMENT_ROWS, common: int = COMMON):
    """One fragment: n-grams of several classes with their counts, packed per bucket of classes.

    An n-gram found in `common` classes while rows gather is sent on at once, and so are its later rows;
    all of these share one count, the largest, so the order stays the same for every set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        hot = np.zeros(0, np.uint64)
        new, size = [], 0
        for batch in batches:
            mine = batch.column("grams").is_null()
            docs = batch.filter(mine)
            if docs.num_rows:
                yield docs.set_column(0, "part", pa.array(np.arange(docs.num_rows) % buckets, pa.int32()))
            packed = batch.filter(pc.invert(mine))
            for g, o in zip(packed["grams"], packed["owners"]):
                cls, n, count = np.frombuffer(o.as_buffer(), np.int64).reshape(3, -1)
                rows = np.frombuffer(g.as_buffer(), np.uint64).copy(), np.repeat(cls, count), np.repeat(n, count)
                if len(hot):
                    known = np.isin(rows[0], hot)
                    yield _to_buckets(*(x[known] for x in rows), np.full(known.sum(), EVERYWHERE), buckets)
                    rows = [x[~known] for x in rows]
                new.append(rows)
                size += len(rows[0])
                if size > held_most:
                    held = [np.concatenate(x) for x in zip(held, *new)]
                    gram, cls, n, _ = _shared(*held, common)
                    yield _to_buckets(gram, cls, n, np.full(len(gram), EVERYWHERE), buckets)
                    hot = np.union1d(hot, gram)
                    stay = ~np.isin(held[0], hot)
                    held, new = [x[stay] for x in held], []
                    size = len(held[0]) // 2  # what can't be sent on must not be sorted again at every row
        held = [np.concatenate(x) for x in zip(held, *new)]
        del new
        yield _to_buckets(*_shared(*held, 2), buckets)

    return run


def min_overlap(n, share: int):
    """Least overlap of a set of size n with any set that it links to."""
    return -(-share * n // 100)


SETS = "doc_id bigint, n bigint, cls bigint, grams array<bigint>, prefix int"


def _prefixes(share: int):
    """One bucket of classes: the shared n-grams of each in the global order, and how many are its prefix."""

    def out(doc_id, n, cls, grams, prefix) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_id, n, cls, grams, prefix], names=["doc_id", "n", "cls", "grams", "prefix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            mine = batch.column("grams").is_null()
            docs = batch.filter(mine)
            if k := docs.num_rows:
                yield out(docs["doc_id"], docs["n"], docs["cls"], pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int32()))
            held += [np.frombuffer(g, np.int64).reshape(4, -1) for g in batch.filter(pc.invert(mine))["grams"].to_pylist()]
        if not held:
            return
        gram, cls, n, df = np.concatenate(held, axis=1)
        del held
        order = np.lexsort((gram.view(np.uint64), df, cls))
        gram, cls, n = gram[order], cls[order], n[order]
        new = np.ones(len(cls), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
        gram, cls, n = gram[new], cls[new], n[new]
        start = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
        m = np.diff(np.append(start, len(cls)))
        cls, n = cls[start], n[start]
        alone = n - m  # n-grams of no other set come first in the order
        prefix = np.minimum(m, n - min_overlap(n, share) + 1 - alone)
        live = prefix > 0
        offsets = np.concatenate(([0], np.cumsum(m[live])))
        grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(gram[np.repeat(live, m)], pa.int64()))
        k = int(live.sum())
        if k:
            yield out(pa.nulls(k, pa.int64()), pa.array(n[live]), pa.array(cls[live]), grams, pa.array(prefix[live], pa.int32()))

    return run


def _enough(overlap, n_a, n_b, share: int):
    """100 * i >= share * (n_a + n_b - i)"""
    return (100 + share) * overlap >= share * (n_a + n_b)


def _incidence(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(columns)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(columns, r)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == r]] = 1
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: partial overlaps of one range of n-grams after another, summed."""
    out = np.zeros((len(left), len(right)))
    flat = [np.unique(np.concatenate(side)) if side else np.zeros(0, np.int64) for side in (left, right)]
    common = np.intersect1d(*flat, assume_unique=True)
    left, right = ([np.sort(r) for r in side] for side in (left, right))
    for at in range(0, len(common), COLUMNS):
        cols = common[at : at + COLUMNS]
        cut = lambda side: [r[slice(*np.searchsorted(r, (cols[0], cols[-1] + 1)))] for r in side]
        out += _incidence(cut(left), cols) @ _incidence(cut(right), cols).T
    return out


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x for c in column.chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])]


LINKS = "a bigint, b bigint, links bigint"


def _block_links(share: int):
    """One pair of blocks of a long list: a spanning forest of its links, and weighted links per set."""

    def run(rows: pa.Table) -> pa.Table:
        token, i, j = (rows.column(c)[0].as_py() for c in ("token", "i", "j"))
        cls, n, size, side = (rows.column(c).to_numpy() for c in ("cls", "n", "size", "side"))
        grams, short, long = (_arrays(rows.column(c)) for c in ("grams", "in_short", "in_long"))
        long = [g[: int(np.flatnonzero(g == token)[0])] for g in long]  # long lists before this one
        one = np.flatnonzero(side == i)
        two = one if i == j else np.flatnonzero(side == j)
        pick = lambda lists, at: [lists[x] for x in at]
        met = _overlaps(pick(short, one), pick(short, two)) > 0
        met |= _overlaps(pick(long, one), pick(long, two)) > 0
        if i == j:
            np.fill_diagonal(met, True)
        # Sets all of whose pairs are judged elsewhere need no overlaps here.
        rows_, columns = ~met.all(axis=1), ~met.all(axis=0)
        one, two, met = one[rows_], two[columns], met[np.ix_(rows_, columns)]
        linked = _enough(_overlaps(pick(grams, one), pick(grams, two)), n[one][:, None], n[two][None, :], share) & ~met
        count = np.zeros(len(cls), np.int64)
        count[one] += linked @ size[two]
        if i != j:
            count[two] += linked.T @ size[one]
        ends = _forest(linked, one, two)
        a = np.concatenate([cls[[x for x, _ in ends]] if ends else np.zeros(0, np.int64), cls[count > 0]])
        b = pa.array([*(int(cls[y]) for _, y in ends), *([None] * int((count > 0).sum()))], pa.int64())
        links = np.concatenate([np.zeros(len(ends), np.int64), count[count > 0]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "links": pa.array(links, pa.int64())})

    return run


def _forest(linked: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Links that reach, from each unreached set of the first block, everything that it is joined with."""
    ends, seen_one, seen_two = [], np.zeros(len(one), bool), np.zeros(len(two), bool)
    for root in range(len(one)):
        stack = [] if seen_one[root] else [root]
        seen_one[root] = True
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(linked[x] & ~seen_two):
                seen_two[y] = True
                ends.append((one[x], two[y]))
                for z in np.flatnonzero(linked[:, y] & ~seen_one):
                    seen_one[z] = True
                    ends.append((two[y], one[z]))
                    stack.append(z)
    return ends


def similar_sets(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Members (`doc_id`, `n`, `cls`) and the sets that may link (`cls`, `n`, `grams`, `prefix`)."""
    fragments = buckets = parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_split(width, fragments), ROWS)
    rows = rows.repartitionById(fragments, F.col("part")).mapInArrow(_count(buckets), ROWS)
    rows = rows.repartitionById(buckets, F.col("part")).mapInArrow(_prefixes(share), SETS)
    rows = kept(rows, "sets")
    return rows.where("grams IS NULL").select("doc_id", "n", "cls"), rows.where("grams IS NOT NULL").drop("doc_id")


def links(sets: DataFrame, share: int = SHARE) -> DataFrame:
    """`a`, `b`: links that connect what is linked; with null `b`: `links` of set `a` counted elsewhere.

    `sets` also has `size`, the documents of each class.
    """
    lists = sets.select(
        "cls", "n", "size", F.size("grams").alias("m"), F.posexplode(F.slice("grams", 1, F.col("prefix"))).alias("at", "token")
    )
    length = lists.groupBy("token").agg(F.count("*").alias("len")).where("len > 1")
    lists = kept(lists.join(kept(length, "lengths"), "token"), "lists")

    short = lists.where(F.col("len") <= SHORT)
    one, two = (short.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "m", "size")]) for x in "ab")
    # Only n-grams that other sets hold can overlap.
    able = _enough(F.least("m_a", "m_b"), F.col("n_a"), F.col("n_b"), share)
    pairs = one.join(two, "token").where((F.col("cls_a") < F.col("cls_b")) & able)
    pairs = pairs.select("cls_a", "cls_b", "n_a", "n_b", "size_a", "size_b").distinct()
    found = _pair_links(kept(pairs, "pairs"), sets, share)
    return kept(found.unionByName(_long_lists(lists, sets, share)), "found")


def _pair_links(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Partial overlaps per vertical fragment, summed per pair."""
    ends = pairs.select(F.col("cls_a").alias("cls")).unionByName(pairs.select(F.col("cls_b").alias("cls"))).distinct()
    gram = sets.join(ends, "cls", "left_semi").select("cls", F.explode("grams").alias("gram"))
    segments = gram.groupBy("cls", F.shiftrightunsigned("gram", 64 - FRAGMENT_BITS).alias("fragment")).agg(F.collect_list("gram").alias("grams"))
    segments = kept(segments, "segments")
    one, two = (segments.select("fragment", F.col("cls").alias(f"cls_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    both = pairs.join(one, "cls_a").join(two, ["cls_b", "fragment"])
    ids = ("cls_a", "cls_b", "n_a", "n_b", "size_a", "size_b")
    overlap = both.groupBy(*ids).agg(F.sum(F.size(F.array_intersect("grams_a", "grams_b"))).alias("overlap"))
    linked = overlap.where(_enough(F.col("overlap"), F.col("n_a"), F.col("n_b"), share))
    linked = kept(linked, "linked")
    none = F.lit(0).cast("bigint").alias("links")
    counted = [
        linked.select(F.col(f"cls_{x}").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col(f"size_{y}").alias("links"))
        for x, y in ("ab", "ba")
    ]
    return linked.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), none).unionByName(counted[0]).unionByName(counted[1])


def _long_lists(lists: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    long = F.col("len") > SHORT
    own = lists.groupBy("cls").agg(
        F.sort_array(F.collect_list(F.when(long, F.struct("at", "token")))).alias("_long"),
        F.collect_list(F.when(~long, F.col("token"))).alias("in_short"),
    ).where(F.size("_long") > 0)
    own = kept(own.select("cls", "in_short", F.col("_long.token").alias("in_long")), "long")
    sets = kept(sets.join(own, "cls"), "members")
    blocks = F.ceil(F.col("len") / BLOCK)
    at = lists.where(long).select("token", "cls", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).alias("side"))
    # Each block meets itself and every other one once.
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    at = at.select("token", "cls", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    rows = at.join(sets, "cls")
    return rows.groupBy("token", "i", "j").applyInArrow(_block_links(share), LINKS)


def ngram_join(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_shingles`, `component_id`, and `n_links`, its linked documents."""
    members, sets = similar_sets(docs, width, share)
    classes = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    classes = kept(classes, "classes")
    found = links(kept(sets.join(classes.select("cls", "size"), "cls"), "active"), share)
    labels = kept(components(found.where("b IS NOT NULL")).withColumnRenamed("node", "cls"), "labels")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    ids = labels.join(classes, "cls").groupBy("label").agg(F.min("least").alias("component"))
    known = kept(labels.join(kept(ids, "ids"), "label").join(counts, "cls", "left").drop("label"), "known")
    every = classes.join(known, "cls", "left").select(
        "cls", F.coalesce("component", "least").alias("component_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    out = members.join(kept(every, "classes"), "cls", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
