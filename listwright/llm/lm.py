"""Language-model scores with stupid backoff, from count tables partitioned by hash.

Words are those between white space; each text starts after a start mark. With `order` 3, a word
after two others has the score c(u v w) / c(u v) if the three were counted, else 0.4 c(v w) / c(v)
if the two were, else 0.16 c(w) / N; after the start mark it has one step less. N is the number of
words, and an uncounted word counts as one. N-grams of two words or more that occur fewer than
`least` times are not in the tables, so their words back off. A text's score is the mean natural
logarithm over its words, so texts of all lengths compare.

Documents are packed into blocks: word numbers, the words' hashes, and where each text ends. For
each n, a block sends the hashes of its distinct n-grams with their counts, packed by leading bits
(the part), one row for each part. All that blocks send to a part is summed, which gives that part of
the count table (packed hashes and counts) and, joined with what each block asked, the block's answer.
Answers come back by block and are summed per document. A hot n-gram is one number of each block. As an n-gram is never more frequent than those inside it, a block asks only for n-grams
whose own parts are in the tables; so no disk is spent on words that back off anyway.

Hashes have 64 bits: of ten billion distinct n-grams, three pairs are expected to share one and
their counts. Parts hold about `PART_WORDS` n-grams.

Defined cases: null and wordless texts have n_words 0 and a null score. Repeated rows count each
time and get one score each. With an empty corpus every word backs off. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from listwright.llm.base import bucketed, remove, shared_path, shuffles_dropped, written

ORDER = 3
LEAST = 2
BACKOFF = 0.4
BLOCK_WORDS = 1 << 19
PART_WORDS = 1 << 20
START = b"\x02 start"  # no word holds a blank


@dataclass
class Counts:
    """Count tables by n (part, hashes, counts), the number of words, and what the corpus's own blocks were answered."""

    tables: list[DataFrame]
    total: int
    least: int
    part_bits: int
    blocks: DataFrame
    answers: list[DataFrame]


# --- blocks ----------------------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, ids and ends (of the texts), text (word numbers, each text after a start mark), words (their hashes), n_words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, ends, texts, numbers, size = [], [], [], _Numbers({START: 0}), 0

        def row() -> pa.RecordBatch:
            text = np.concatenate([np.zeros(0, np.int32), *texts])
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([ends], pa.list_(pa.int64())),
                pa.array([text.tobytes()], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
                pa.array([int((text > 0).sum())], pa.int64()),
            ], ["block", "ids", "ends", "text", "words", "n_words"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = (text.as_py() or b"").split()
                lookup = numbers.__getitem__
                found = np.fromiter(map(lookup, words), np.int32, len(words))
                if words:
                    texts += [np.zeros(1, np.int32), found]
                    size += len(words) + 1
                ids.append(doc_id)
                ends.append(size)
                if size + len(ids) >= block_words:
                    yield row()
                    number += 1
                    ids, ends, texts, numbers, size = [], [], [], _Numbers({START: 0}), 0
        if ids:
            yield row()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        packed, f"block bigint, ids array<{kind}>, ends array<bigint>, text binary, words binary, n_words bigint"
    )


class _Grams:
    """The n-grams of a block: by n, the distinct ones that may be counted, and which of them starts at each place."""

    def __init__(self, row: dict, answers: list[bytes], least: int, n: int) -> None:
        text = np.frombuffer(row["text"], np.int32)
        self.ends = np.array(row["ends"], np.int64)
        starts = np.concatenate(([0], self.ends[:-1]))
        left = np.repeat(self.ends, self.ends - starts) - np.arange(len(text))  # words from here to the end of the text
        one = np.frombuffer(row["words"], np.uint64)[text]
        self.distinct: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []  # by n, the global count at each place; 0 where there is none or too few
        self.here: np.ndarray | None = None
        hashes, whole = one, np.ones(len(text), bool)
        for size in range(1, n + 1):
            if size > 1:
                # Both n-grams inside must be in the tables.
                before = self.counts[-1]
                whole = (left >= size) & (before > 0) & (np.append(before, 0)[1:] > 0)
                hashes = _joined(hashes, np.concatenate((one[size - 1:], one[:size - 1])))  # the last places have no such n-gram
            places = np.flatnonzero(whole)
            values, which, counts = np.unique(hashes[places], return_inverse=True, return_counts=True)
            self.values, self.own = values, counts
            if size <= len(answers):
                found = np.zeros(len(text), np.int64)
                found[places] = _counts(answers[size - 1])[which]
                if size > 1:
                    found[found < least] = 0
                self.counts.append(found)


def _joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first n - 1 words and their last."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (last ^ (last >> np.uint64(31)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


# --- count tables ----------------------------------------------------------------------------------


def _with_answers(packed: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with the answers by n so far, in order."""
    for n, own in enumerate(answers, 1):
        packed = packed.join(own.select("block", F.col("counts").alias(f"answer{n}")).hint("merge"), "block")
    return packed


def _asked(packed: DataFrame, answers: list[DataFrame], least: int, n: int, part_bits: int) -> DataFrame:
    """part, block, and the hashes and counts of the block's distinct n-grams in that part."""
    names = [f"answer{i}" for i in range(1, n)]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams = _Grams(row, [row[name] for name in names], least, n)
            starts = np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits) if part_bits else []
            cuts = np.searchsorted(grams.values, starts)
            for part, (hashes, counts) in enumerate(zip(np.split(grams.values, cuts), np.split(grams.own, cuts))):
                if len(hashes):
                    yield pa.RecordBatch.from_pylist([{
                        "part": part, "block": row["block"], "hashes": _steps(hashes), "counts": _bytes(counts),
                    }], _ASKED)

    rows = _with_answers(packed.select("block", "ends", "text", "words"), answers)
    return rows.mapInArrow(asked, "part bigint, block bigint, hashes binary, counts binary")


_ASKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _steps(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first and the steps between them, six bytes each where that is enough."""
    steps = np.diff(hashes)
    width = 6 if len(steps) and int(steps.max()) < 1 << 48 else 8
    return hashes[:1].tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() + bytes([width])


def _hashes(blob: bytes) -> np.ndarray:
    width = blob[-1]
    size = (len(blob) - 9) // width
    steps = np.zeros((size + 1, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8)
    steps[1:, :width] = np.frombuffer(blob, np.uint8, size * width, 8).reshape(size, width)
    return np.cumsum(steps.reshape(-1).view("<u8").astype(np.uint64), dtype=np.uint64)


def _bytes(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those from 255 in eight more at the end; chunks can follow one another."""
    large = counts[counts >= 255].astype(np.int64)
    return np.array([len(counts)], np.int64).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _counts(blob: bytes) -> np.ndarray:
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(blob):
        size = int(np.frombuffer(blob, np.int64, 1, at)[0])
        own = np.frombuffer(blob, np.uint8, size, at + 8).astype(np.int64)
        at += 8 + size
        large = own == 255
        m = int(large.sum())
        if m:
            own[large] = np.frombuffer(blob, np.int64, m, at)
            at += 8 * m
        found.append(own)
    return np.concatenate(found)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row of blocks at a time, as they are large."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


def _sums(least: int) -> Callable[[pa.Table], pa.Table]:
    return lambda group: _summed(group, least)


def _summed(group: pa.Table, least: int) -> pa.Table:
    """A part of the count table (without a block), and the answers to the blocks that asked."""
    hashes = [_hashes(blob.as_py()) for blob in group["hashes"]]
    counts = [_counts(blob.as_py()) for blob in group["counts"]]
    every, which = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(which, np.concatenate(counts), len(every)).astype(np.int64)  # exact up to 2^53
    answers = np.split(totals[which], np.cumsum([len(h) for h in hashes])[:-1])
    often, part = totals >= least, group["part"][0].as_py()
    rows = [{"part": part, "block": None, "hashes": _steps(every[often]) if often.any() else b"", "counts": _bytes(totals[often])}]
    rows += [{"part": part, "block": block, "hashes": b"", "counts": _bytes(a)} for block, a in zip(group["block"].to_pylist(), answers)]
    return pa.Table.from_pylist(rows, _ASKED)


def _looked_up(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Answers from a part of the count table; an n-gram that it lacks has count 0."""
    known = np.concatenate([np.zeros(0, np.uint64), *(_hashes(blob.as_py()) for blob in table["hashes"] if len(blob.as_py()))])
    counts = np.concatenate([np.zeros(0, np.int64), *(_counts(blob.as_py()) for blob in table["counts"])])
    rows = []
    for part, block, hashes in zip(asked["part"].to_pylist(), asked["block"].to_pylist(), asked["hashes"]):
        hashes = _hashes(hashes.as_py())
        found = np.zeros(len(hashes), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = np.where(known[at] == hashes, counts[at], 0)
        rows.append({"part": part, "block": block, "hashes": b"", "counts": _bytes(found)})
    return pa.Table.from_pylist(rows, _ASKED)


def _by_block(packed: DataFrame, answered: DataFrame) -> DataFrame:
    """block and counts: the answers of all parts in the order of the hashes, for every block."""
    parts = answered.select("block", F.struct("part", "counts").alias("own")).union(
        packed.select("block", F.struct(F.lit(-1).cast("bigint").alias("part"), F.lit(b"").alias("counts")))
    )
    gathered = parts.groupBy("block").agg(F.sort_array(F.collect_list("own")).alias("owns"))
    whole = F.aggregate("owns", F.lit(b""), lambda all_, own: F.concat(all_, own["counts"]))
    return gathered.select("block", whole.alias("counts"))


_SENT = "part bigint, block bigint, hashes binary, counts binary"


def count(docs: DataFrame, order: int = ORDER, least: int = LEAST, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS,
          keep_tables: bool = True) -> Counts:
    """Count tables of all documents, up to n-grams of `order` words.

    Without `keep_tables` each table goes once the corpus's own blocks have their answers from it, which
    is enough for `score_corpus`.
    """
    spark = docs.sparkSession
    packed = bucketed(blocks(docs, block_words), "lm-blocks", "block")
    size = packed.agg(F.sum("n_words")).first()[0] or 0
    part_bits = max(math.ceil(math.log2(max(size / part_words, 1))), 0)
    tables, answers = [], []
    for n in range(1, order + 1):
        asked = _asked(packed, answers, least, n, part_bits)
        path = shared_path(spark, "lm-counts")
        with shuffles_dropped(spark):
            asked.groupBy("part").applyInArrow(_sums(1 if n == 1 else least), _SENT).write.parquet(path)
        both = spark.read.schema(_SENT).parquet(path)
        answers.append(written(_by_block(packed, both.filter("block is not null")), "lm-answers"))
        if keep_tables:
            tables.append(both.filter("block is null").select("part", "hashes", "counts"))
        else:
            remove(spark, path)
    return Counts(tables, size, least, part_bits, packed, answers)


# --- scores ----------------------------------------------------------------------------------------


def _scored(packed: DataFrame, answers: list[DataFrame], total: int, least: int) -> DataFrame:
    order = len(answers)
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    names = [f"answer{i}" for i in range(1, order + 1)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            for at, row in enumerate(_rows([batch.drop_columns(["ids"])])):
                grams = _Grams(row, [row[name] for name in names], least, order)
                ends = grams.ends
                starts = np.concatenate(([0], ends[:-1]))
                words = np.maximum(ends - starts - 1, 0)
                some = words > 0
                begin, size = starts[some], len(grams.counts[0])
                depth = np.arange(size) - np.repeat(starts, ends - starts)  # words before, the start mark included
                most = np.minimum(depth, order - 1)
                logs = np.log(np.maximum(grams.counts[0], 1) / max(total, 1)) + most * math.log(BACKOFF)
                for n in range(2, order + 1):
                    own, context = np.zeros(size, np.int64), np.ones(size, np.int64)
                    own[n - 1:] = grams.counts[n - 1][:max(size - n + 1, 0)]
                    context[n - 1:] = grams.counts[n - 2][:max(size - n + 1, 0)]
                    counted = own > 0
                    logs[counted] = np.log(own[counted] / context[counted]) + (most[counted] - n + 1) * math.log(BACKOFF)
                logs[begin] = 0.0  # the start mark is no word
                scores = np.zeros(len(words))
                if size:
                    scores[some] = np.round(np.add.reduceat(logs, begin) / words[some], 6)
                yield pa.RecordBatch.from_arrays(
                    [ids[at].values, pa.array(words), pa.array(scores, mask=~some)], ["doc_id", "n_words", "score"]
                )

    rows = _with_answers(packed, answers)
    return rows.mapInArrow(scored, f"doc_id {kind}, n_words bigint, score double")


def score_corpus(counts: Counts) -> DataFrame:
    """doc_id, n_words and score of each row that was counted."""
    return _scored(counts.blocks, counts.answers, counts.total, counts.least)


def score(docs: DataFrame, counts: Counts, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words and score of each row of any documents."""
    packed, answers = bucketed(blocks(docs, block_words), "lm-blocks", "block"), []
    for n, table in enumerate(counts.tables, 1):
        asked = _asked(packed, answers, counts.least, n, counts.part_bits)
        found = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(_looked_up, _SENT)
        answers.append(written(_by_block(packed, found), "lm-answers"))
    return _scored(packed, answers, counts.total, counts.least)
