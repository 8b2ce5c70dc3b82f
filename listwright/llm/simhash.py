"""SimHash near-duplicates: fingerprints, a binary trie joined with itself, and components.

Two fingerprints within `distance` differing bits agree wholly on at least two of `distance` + 2
blocks of bits. So each pair of blocks gives one forest of binary tries, one trie for each value
of the two blocks, and no link is outside all of them. Spark deals the tries out by that value. In
a trie, pairs of nodes are traversed together from the root: a step into unlike branches adds a
differing bit, and a pair beyond the error budget goes. A trie with more than `cell` leaves is
dealt out as cells, each the union of two of its parts, so that memory per task is bounded while
all its pairs of leaves still meet.

Only what connects is returned by a task: each leaf with the smallest leaf it is connected to, so
a group of n copies gives at most n rows. Components are then found by alternating stars.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like others. A
repeated row is a document like any other. A null `doc_id` counts as a document but names a
component only if the component has no other id. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from listwright.llm.base import fresh, keyed, without, written

SHINGLE = 4
DISTANCE = 4
BITS = 64
CELL = 1024
#: Pairs of nodes that a task holds at once, and rows it reads at once.
PAIRS_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 50_000


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Signed 64 bits; a bit is set if more than half of the shingles' XXH64 have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    width = min(shingle, len(words))
    spans = zip(starts, ends[width - 1:])
    ones, count = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_digest
    while part := [digest(line[a:b - 1], seed) for a, b in itertools.islice(spans, 65536)]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
        count += len(part)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n leaves the smallest it is connected to by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(jump := root[root], root):
            root = jump
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _near(leaves: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(leaves[a] ^ leaves[b]) <= distance


def _neighbour_links(trie: np.ndarray, leaves: np.ndarray, order: np.ndarray, distance: int):
    a, b = order[:-1], order[1:]
    ok = (trie[a] == trie[b]) & _near(leaves, a, b, distance)
    return a[ok], b[ok]


def trie_join(trie: np.ndarray, leaves: np.ndarray, distance: int) -> np.ndarray:
    """The smallest connected leaf of each leaf. Leaves (unsigned) are sorted within each trie.

    Neighbours in the order of the bits and of the inverted bits are linked first; a pair of nodes
    all of whose leaves are connected already can add nothing and is left out, as is a pair whose
    differing bits exceed the budget.
    """
    n = len(leaves)
    links = [_neighbour_links(trie, leaves, np.arange(n), distance)]
    turned = (leaves << np.uint64(32)) | (leaves >> np.uint64(32))
    links.append(_neighbour_links(trie, leaves, np.lexsort((turned, trie)), distance))
    root = _components(n, *(np.concatenate(x) for x in zip(*links)))
    change = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))

    starts = np.flatnonzero(np.concatenate(([True], trie[1:] != trie[:-1])))
    a = c = starts
    b = d = np.concatenate((starts[1:], [n]))
    differ = np.zeros(len(a), np.int8)
    for level in range(BITS):
        one = ((leaves >> np.uint64(BITS - 1 - level)) & np.uint64(1)).astype(np.int64)
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        p, q = a + zeros[b] - zeros[a], c + zeros[d] - zeros[c]
        twice = a != c  # of a node with itself, only one of the two unlike pairs
        a, b, c, d, differ = (
            np.concatenate(x) for x in (
                (a, p, a, p[twice]), (p, b, p, b[twice]), (c, q, q, c[twice]), (q, d, d, q[twice]),
                (differ, differ, differ + 1, differ[twice] + 1),
            )
        )
        keep = (a < b) & (c < d) & (differ <= distance) & ((a != c) | (b - a > 1))
        a, b, c, d, differ = a[keep], b[keep], c[keep], d[keep], differ[keep]
        connected = (change[a] == change[b - 1]) & (change[c] == change[d - 1]) & (root[a] == root[c])
        leaf = (b - a == 1) & (d - c == 1)
        ends = leaf & ~connected
        x, y = a[ends], c[ends]
        near = _near(leaves, x, y, distance)
        links.append((x[near], y[near]))
        keep = ~(connected | leaf)
        a, b, c, d, differ = a[keep], b[keep], c[keep], d[keep], differ[keep]
        if not len(a):
            break
    return _components(n, *(np.concatenate(x) for x in zip(*links)))


def _chunks(trie: np.ndarray):
    """Ends of runs of whole tries with few enough pairs of leaves."""
    ends = np.concatenate((np.flatnonzero(trie[1:] != trie[:-1]) + 1, [len(trie)]))
    sizes = np.diff(ends, prepend=0)
    load, start = 0, 0
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if load and load + size * size > 2 * PAIRS_AT_ONCE:
            yield start, end - size
            start, load = end - size, 0
        load += size * size
    yield start, len(trie)


def _join_cells(distance: int):
    def joined(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["combo", "prefix", "x", "y"], kind="stable", ignore_index=True)
        trie = part.groupby(["combo", "prefix", "x", "y"], sort=False).ngroup().to_numpy()
        leaves = part["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((leaves, trie))
        trie, leaves = trie[order], leaves[order]
        found = []
        for start, end in _chunks(trie):
            own, group = leaves[start:end], trie[start:end]
            root = trie_join(group, own, distance)
            far = root != np.arange(len(own))
            found.append(pd.DataFrame({"a": own[far].view(np.int64), "b": own[root[far]].view(np.int64)}))
        return pd.concat(found).drop_duplicates()

    def cells(batches):
        """Rows come sorted by cell; the last cell of what has been read may go on."""
        rest, size = [], 0
        for batch in batches:
            rest.append(batch)
            size += len(batch)
            if size < ROWS_AT_ONCE:
                continue
            rows = pd.concat(rest, ignore_index=True)
            key = ["combo", "prefix", "x", "y"]
            last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield joined(rows[~last])
            rest, size = [rows[last]], int(last.sum())
        if size:
            yield joined(pd.concat(rest, ignore_index=True))

    return cells


def _blocks(distance: int) -> list[tuple[int, int]]:
    """Shift and mask of each block of bits."""
    n = distance + 2
    sizes = [BITS // n + (i < BITS % n) for i in range(n)]
    shifts = [sum(sizes[i + 1:]) for i in range(n)]
    return [(shift, (1 << size) - 1) for shift, size in zip(shifts, sizes)]


def links(nodes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect all fingerprints `fp` within the distance; b is unsigned-smaller."""
    blocks = _blocks(distance)

    def prefix(i: int, j: int) -> Column:
        (s, m), (t, k) = blocks[i], blocks[j]
        high = F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m))
        low = F.shiftrightunsigned("fp", t).bitwiseAND(F.lit(k))
        return F.shiftleft(high, k.bit_length()).bitwiseOR(low)

    combos = [
        F.struct(F.lit(n).cast("byte").alias("combo"), prefix(i, j).alias("prefix"))
        for n, (i, j) in enumerate(itertools.combinations(range(len(blocks)), 2))
    ]
    leaves = nodes.select("fp", F.inline(F.array(*combos)))
    large = written(
        leaves.groupBy("combo", "prefix").count().filter(F.col("count") > cell)
        .select("combo", "prefix", F.ceil(F.col("count") / cell).cast("int").alias("parts")),
        "tries",
    )
    parted = leaves.join(large, ["combo", "prefix"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meet = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")),
    )
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    dealt = parted.select(
        "combo", "prefix", "fp", F.inline(F.when(F.col("parts").isNull(), alone).otherwise(meet))
    )
    key = ["combo", "prefix", "x", "y"]
    return (
        dealt.repartition(*key).sortWithinPartitions(*key)
        .mapInPandas(_join_cells(distance), "a long, b long").distinct()
    )


def _with_lowest(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Edges with the lowest neighbour of their a.

    Joined by a's inverted bits, not by a: both sides are then dealt for this join alone, and a node with
    a large part of all edges can be split between tasks.
    """
    key, = fresh(edges, "key")
    near = lowest.select(F.bitwise_not("a").alias(key), "low")
    return edges.withColumn(key, F.bitwise_not("a")).join(near, key).drop(key)


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges (a, b), a above b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    large = _with_lowest(both.filter("b > a"), lowest).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    large = written(large, "large-star")
    moved = _with_lowest(large, large.groupBy("a").agg(F.min("b").alias("low")))
    small = moved.select("a", F.col("low").alias("b")).union(
        moved.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    )
    return written(small.distinct(), "small-star")


def components(edges: DataFrame) -> DataFrame:
    """(a, root): the smallest node (signed) of each node that has an edge to a smaller one."""

    def sign(frame: DataFrame):
        return frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        "edges",
    )
    seen = sign(now)
    while seen[0]:
        now = _stars(now)
        before, seen = seen, sign(now)
        if before == seen:
            break
    return now.select("a", F.col("b").alias("root"))


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, mark, fp and component_id of every row of documents, and `first_mark`: the keeper of a
    component is (component_id, first_mark), its smallest id with that id's smallest mark."""
    spread = docs.select("doc_id", "text")
    prints = written(keyed(spread, fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    roots = components(links(nodes, distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["a"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    named = rooted.join(named, "root").select(
        "fp", F.col("keeper.doc_id").alias("component_id"), F.col("keeper.mark").alias("first_mark")
    )
    return prints.join(written(named, "classes"), "fp").select("doc_id", "mark", "fp", "component_id", "first_mark")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The document with the smallest id of each component, columns unchanged.

    Of rows with one id and one text, one stays; of rows with one id in one component, the one with
    the smallest text hash. Components can share an id or have none: each keeps its own document.
    """
    found = written(classes(docs, shingle, distance), "members")
    keeper = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first_mark"))
    beside = found.filter(~keeper).select("doc_id", "mark")
    twins = found.filter(keeper).groupBy("doc_id", "mark").count().filter("count > 1").select("doc_id", "mark")
    twins = written(twins, "twins")
    kept = without(docs, beside.union(twins))
    mark, = fresh(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    of_twins = marked.join(
        twins, marked["doc_id"].eqNullSafe(twins["doc_id"]) & (marked[mark] == twins["mark"])
    ).select(*(marked[f"`{c}`"] for c in marked.columns)).dropDuplicates(["doc_id", mark])
    return kept.union(of_twins.select(*(F.col(f"`{c}`") for c in docs.columns)))
