"""Phrase mining with counting quotient filters.

Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and the pieces into words at
blanks and tabs. A phrase is two to four words of one piece, counted per language with overlaps.

Documents are packed into blocks of one language: the block's distinct words, and its text as their
numbers (`blocks`). Words that are frequent enough for a phrase get an id, dense over all languages;
ids are joined to each block's distinct words, so no worker holds more of the dictionary than its
blocks use. A phrase occurs at most as often as each of its words, so n-grams with another word
need not be counted.

A block's n-grams are packed into whole numbers of n ids and counted in a counting quotient filter
(`encode`). An invertible permutation spreads the numbers evenly; its leading bits, the quotient,
are kept as two bit maps, its other bits, the remainder, in full, and its count in a byte or, from
255, in eight. Nothing is hashed away: the permutation is undone and gives the words back, so counts
are exact. Entries are sorted, so filters of the same leading bits, the part, merge as sorted lists.
Filters are dealt by part and merged; with many parts this takes several rounds, each dealing by
more leading bits. Permuted numbers are spread evenly, whatever the text, so parts hold about
`PART_ENTRIES` n-grams of each block's own and a hot phrase is one entry of a filter.

What is frequent is then joined as rows: a phrase's cuts with the counts of their two sides, and the
phrases inside longer ones with the longer ones' counts.

Defined cases: a null text has no words; a null language is `und`; an empty table gives no rows.
Rows are not told apart by id, so repeated rows count each time. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.llm.base import bucketed, written

LONGEST = 4
LEAST = 30
INSIDE_PERCENT = 80
TOP = 2000
NO_LANG = "und"
BLOCK_WORDS = 1 << 19
#: Distinct n-grams of one length that a merge holds at a time, about.
PART_ENTRIES = 1 << 19
#: Parts in which a language's phrases are ranked before the best of all parts are.
RANK_PARTS = 16
#: Leading bits by which one round of merging deals filters.
ROUND_BITS = 10

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_SEPARATORS))
BREAK = -1


class _Numbers(dict):
    """Words by order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """A block being filled: its words and its texts as word numbers, with breaks between pieces."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        words = [w for w in words if w]
        lookup = self.numbers.__getitem__
        found = np.fromiter((BREAK if w == b"\n" else lookup(w) for w in words), np.int32, len(words))
        self.texts += [found, np.array([BREAK], np.int32)]
        self.size += len(words) + 1

    def columns(self, lang: str) -> dict:
        text = np.concatenate(self.texts)
        counts = np.bincount(text[text >= 0], minlength=len(self.numbers))
        return {
            "lang": lang, "words": list(self.numbers), "counts": counts, "text": text.tobytes(),
        }


_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())),
                    ("counts", pa.list_(pa.int64())), ("text", pa.binary())])


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, lang, words, counts (of the words in the block) and text (their numbers)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[str, _Block] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                lang = lang.as_py()
                block = open_.setdefault(lang, _Block())
                block.add(text.as_py())
                if block.size >= block_words:
                    yield pa.RecordBatch.from_pylist([{"block": number, **open_.pop(lang).columns(lang)}], _BLOCK)
                    number += 1
        for lang, block in open_.items():
            yield pa.RecordBatch.from_pylist([{"block": number, **block.columns(lang)}], _BLOCK)
            number += 1

    texts = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang")).filter("text is not null")
    return texts.mapInArrow(packed, "block bigint, lang string, words array<binary>, counts array<bigint>, text binary")


def word_counts(packed: DataFrame) -> DataFrame:
    """lang, word and f over all blocks."""
    rows = packed.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def numbered(words: DataFrame, parts: int = 1024) -> DataFrame:
    """The rows with a dense id from 0, numbered within `parts` parts by hash and then across them."""
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(parts))
    own = words.withColumn("part", part).withColumn(
        "place", F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    )
    sizes = words.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(
        "part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("start")
    )  # one row per part
    return own.join(F.broadcast(starts), "part").select(
        "lang", "word", "f", (F.coalesce("start", F.lit(0)) + F.col("place") - 1).cast("long").alias("id")
    )


def block_ids(packed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """block, places and ids: by place in the block's words, the ids of those in the vocabulary."""
    words = packed.select("block", "lang", F.posexplode("words").alias("place", "word"))
    return words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(
        F.collect_list("place").alias("places"), F.collect_list("id").alias("ids")
    )


# --- packed n-grams and their permutation ----------------------------------------------------------


class Packing:
    """n ids of `bits` bits each as one whole number in two halves, and its permutation.

    Halves have `half` bits each, so numbers of up to 128 bits fit two words of 64. The permutation
    is four rounds of a Feistel network, each undone by itself in reverse order.
    """

    _ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, n: int, bits: int) -> None:
        self.n, self.bits = n, bits
        self.half = max((n * bits + 1) // 2, 1)
        if self.half > 64:
            raise ValueError("more than 128 bits")
        self.mask = np.uint64((1 << self.half) - 1)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
        for place, own in enumerate(ids):
            own, at = own.astype(np.uint64), place * self.bits
            if at < self.half:
                low |= (own << np.uint64(at)) & self.mask
                over = at + self.bits - self.half
                if over > 0:
                    high |= own >> np.uint64(self.bits - over)
            else:
                high |= own << np.uint64(at - self.half)
        return high, low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        found, one = [], np.uint64((1 << self.bits) - 1)
        for place in range(self.n):
            at = place * self.bits
            if at < self.half:
                own = low >> np.uint64(at)
                if at + self.bits > self.half:
                    own = own | (high << np.uint64(self.half - at))
            else:
                own = high >> np.uint64(at - self.half)
            found.append((own & one).astype(np.int64))
        return found

    def _stir(self, x: np.ndarray, turn: int) -> np.ndarray:
        x = x * np.uint64(self._ODD[turn])
        x ^= x >> np.uint64(29)
        x *= np.uint64(self._ODD[turn - 1])
        return (x ^ (x >> np.uint64(32))) & self.mask

    def permute(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for turn in range(4):
            high, low = low, high ^ self._stir(low, turn)
        return high, low

    def restore(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for turn in reversed(range(4)):
            high, low = low ^ self._stir(high, turn), high
        return high, low

    def leading(self, high: np.ndarray, bits: int) -> np.ndarray:
        """The first `bits` bits; quotients lie in the high half."""
        return high >> np.uint64(self.half - bits) if bits else np.zeros(len(high), np.uint64)


def tallied(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each occurs."""
    if 2 * half > 64 or not len(high):
        return merged(high, low, np.ones(len(high), np.int64), half)
    numbers, counts = np.unique((high << np.uint64(half)) | low, return_counts=True)
    return numbers >> np.uint64(half), numbers & np.uint64((1 << half) - 1), counts


def merged(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers with their counts added. Runs that are sorted already merge as runs."""
    if not len(high):
        return high, low, counts
    if 2 * half <= 64:
        order = np.argsort((high << np.uint64(half)) | low, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low, counts = high[order], low[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    return high[first], low[first], np.add.reduceat(counts, first)


# --- filters ---------------------------------------------------------------------------------------


def encode(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, part_bits: int) -> bytes:
    """A counting quotient filter of sorted, distinct permuted numbers that agree in their first `part_bits` bits.

    Two bit maps say which quotients occur and where the run of each ends; remainders follow in whole
    bytes, then counts.
    """
    size = len(high)
    q = min(max(size - 1, 1).bit_length(), half - part_bits)
    rest = half - part_bits - q
    quotients = (high >> np.uint64(rest)) & np.uint64((1 << q) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotients.astype(np.int64)] = True
    ends = np.concatenate((quotients[1:] != quotients[:-1], [True]))
    remainder = high & np.uint64((1 << rest) - 1) if rest else np.zeros(size, np.uint64)
    small = np.minimum(counts, 255).astype(np.uint8)
    return b"".join((
        np.array([size, q], np.int64).tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        _cut(remainder, rest), _cut(low, half), small.tobytes(), counts[counts >= 255].astype(np.int64).tobytes(),
    ))


def decode(blob: bytes, half: int, part: int, part_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, q = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    rest = half - part_bits - q
    at = 16
    occupied = np.unpackbits(np.frombuffer(blob, np.uint8, ((1 << q) + 7) // 8, at), count=1 << q)
    at += ((1 << q) + 7) // 8
    ends = np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size)
    at += (size + 7) // 8
    remainder, at = _grown(blob, at, size, rest)
    low, at = _grown(blob, at, size, half)
    counts = np.frombuffer(blob, np.uint8, size, at).astype(np.int64)
    at += size
    large = counts == 255
    counts[large] = np.frombuffer(blob, np.int64, int(large.sum()), at)
    run = np.cumsum(ends) - ends  # the number of the run that each entry belongs to
    quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
    start = part << (half - part_bits)
    return np.uint64(start) | (quotients << np.uint64(rest)) | remainder, low, counts


def _cut(values: np.ndarray, bits: int) -> bytes:
    """The low `bits` bits of each value, in whole bytes."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _grown(blob: bytes, at: int, size: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, size * width, at).reshape(size, width)
    return wide.reshape(-1).view("<u8").astype(np.uint64), at + size * width


_FILTER = pa.schema([("n", pa.int32()), ("part", pa.int64()), ("filter", pa.binary())])
_FILTER_COLUMNS = "n int, part bigint, filter binary"


def _split(n: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray, packing: Packing, bits: int) -> pa.RecordBatch:
    """One filter for each part that has entries."""
    parts = packing.leading(high, bits)
    starts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else np.zeros(0, int)
    ends = [*starts[1:], len(parts)]
    rows = [(n, int(parts[a]), encode(high[a:b], low[a:b], counts[a:b], packing.half, bits)) for a, b in zip(starts, ends)]
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FILTER)], schema=_FILTER)


def _bits_at(part_bits: int, turn: int, packing: Packing) -> int:
    """Leading bits by which the filters of a round are dealt."""
    return min((turn + 1) * ROUND_BITS, part_bits, packing.half)


def block_filters(encoded: DataFrame, id_bits: int, part_bits: int, longest: int = LONGEST) -> DataFrame:
    """n, part and filter: the n-grams of each block, by leading bits."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                places = batch["places"][row].values.to_numpy(zero_copy_only=False)
                text = np.frombuffer(batch["text"][row].as_py(), np.int32)
                ids = np.full(max(int(text.max(initial=0)), int(places.max(initial=0))) + 2, -1, np.int64)
                ids[places] = batch["ids"][row].values.to_numpy(zero_copy_only=False)
                words = ids[text]  # BREAK reads the last place, which has no id
                for n in range(2, longest + 1):
                    packing = Packing(n, id_bits)
                    here = [words[i:len(words) - n + 1 + i] for i in range(n)]
                    whole = np.logical_and.reduce([w >= 0 for w in here])
                    high, low = packing.permute(*packing.pack([w[whole] for w in here]))
                    yield _split(n, *tallied(high, low, packing.half), packing, _bits_at(part_bits, 0, packing))

    return encoded.mapInArrow(counted, _FILTER_COLUMNS)


def _regrouped(filters: DataFrame, id_bits: int, part_bits: int, turn: int) -> DataFrame:
    """Filters of a round's parts, merged some at a time and dealt by the next round's bits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, size = [], None, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                packing = Packing(key[0], id_bits)
                found = merged(*(np.concatenate(x) for x in zip(*held)), packing.half)
                yield _split(key[0], *found, packing, _bits_at(part_bits, turn + 1, packing))

        for batch in batches:
            for n, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (n, part) or size >= PART_ENTRIES:
                    yield from flushed()
                    held, key, size = [], (n, part), 0
                packing = Packing(n, id_bits)
                held.append(decode(blob, packing.half, part, _bits_at(part_bits, turn, packing)))
                size += len(held[-1][0])
        yield from flushed()

    dealt = filters.repartition("n", "part").sortWithinPartitions("n", "part")
    return dealt.mapInArrow(deal, _FILTER_COLUMNS)


def frequent(filters: DataFrame, id_bits: int, part_bits: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """ids and f of the n-grams that occur `least` times or more, from all filters."""
    rounds = max(math.ceil(part_bits / ROUND_BITS), 1)
    for turn in range(rounds - 1):
        filters = _regrouped(filters, id_bits, part_bits, turn)

    def summed(group: pa.Table) -> pa.Table:
        n, part = group["n"][0].as_py(), group["part"][0].as_py()
        packing = Packing(n, id_bits)
        bits = _bits_at(part_bits, rounds - 1, packing)
        own = [decode(blob.as_py(), packing.half, part, bits) for blob in group["filter"]]
        high, low, counts = merged(*(np.concatenate(x) for x in zip(*own)), packing.half)
        often = counts >= least
        ids = np.stack(packing.unpack(*packing.restore(high[often], low[often])), 1).astype(np.int64)
        offsets = pa.array(np.arange(len(ids) + 1) * n, pa.int32())
        return pa.table({"ids": pa.ListArray.from_arrays(offsets, pa.array(ids.reshape(-1))), "f": counts[often]})

    return filters.groupBy("n", "part").applyInArrow(summed, "ids array<bigint>, f bigint")


# --- phrases ---------------------------------------------------------------------------------------


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS,
           part_entries: int = PART_ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent n-grams (ids, f), the vocabulary (lang, word, f, id) and the words of each language (lang, n)."""
    packed = bucketed(blocks(docs, block_words), "phrase-blocks", "block")
    words = written(word_counts(packed), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = written(numbered(words.filter(F.col("f") >= least)), "phrase-vocabulary")
    size, total = vocabulary.count(), words.agg(F.sum("f")).first()[0] or 0
    id_bits = max((size - 1).bit_length(), 1) if size else 1
    part_bits = max(math.ceil(math.log2(max(total / part_entries, 1))), 0)
    known = written(block_ids(packed, vocabulary), "phrase-ids")
    encoded = packed.select("block", "text").join(known.hint("merge"), "block")
    filters = block_filters(encoded, id_bits, part_bits, longest)
    long = frequent(filters, id_bits, part_bits, least, longest)
    grams = written(long.union(vocabulary.select(F.array("id"), "f")), "phrase-counts")
    return grams, vocabulary, totals


def _scored(grams: DataFrame) -> DataFrame:
    """Phrases with a, and l, r and score of their lowest-scoring cut."""
    phrases = grams.filter(F.size("ids") > 1).withColumnRenamed("f", "a")
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select(
        "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"),
    )
    left = grams.select(F.col("ids").alias("left"), F.col("f").alias("l"))
    right = grams.select(F.col("ids").alias("right"), F.col("f").alias("r"))
    each = cuts.join(left, "left").join(right, "right").withColumn(
        "score", F.expr("cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + r)").cast("long")
    )
    return each.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "ids", "a", "cut.score", "cut.l", "cut.r"
    )


def _inside(grams: DataFrame, longest: int) -> DataFrame:
    """ids of phrases with the largest count of a longer phrase that holds them."""
    longer = grams.filter(F.size("ids") > 2)
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("ids") - n + 1), lambda at: F.slice("ids", at, n)
    )))
    return longer.select(F.explode(parts).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, top: int = TOP,
          block_words: int = BLOCK_WORDS, part_entries: int = PART_ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases."""
    grams, vocabulary, totals = counts(docs, least, longest, block_words, part_entries)
    free = _scored(grams).join(_inside(grams, longest), "ids", "left").filter(
        "longer is null or 100 * cast(longer as decimal(38,0)) < " f"{inside_percent} * cast(a as decimal(38,0))"
    ).drop("longer")
    kept = written(free.select("*", F.xxhash64("ids").alias("mark")), "phrase-scores")
    words = kept.select("ids", F.posexplode("ids").alias("place", "id")).join(
        vocabulary.select("lang", "word", "id"), "id"
    ).groupBy("ids").agg(
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"].cast("string")), " ").alias("phrase"),
    )
    named = kept.join(words, "ids")
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    # First within parts of a language, so that what meets in one task does not grow with the phrases.
    some = Window.partitionBy("lang", F.pmod("mark", F.lit(RANK_PARTS))).orderBy(*order)
    first = named.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
