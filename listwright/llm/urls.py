"""URL lists: a blocked Bloom filter of the listed canonical URLs, then an exact join.

A listed URL is a host and a path, "example.com/en/". One that ends with a slash fits its host, all
subdomains and every path that starts with its own; one that doesn't fits only that path, on the
host and its subdomains. A page is asked for under those suffixes of its host and leading parts of
its path that are as long as some listed one, counted in labels and folders, and under its whole path
if the list has such; so a page asks for at most as many keys as the list has lengths, however long
its URL. Each such key picks one block of the filter and two bits in each of its four words; keys
whose bits are all set are joined with the list, which removes false positives. The longest listed
URL wins, then the one with the longer host.

The filter has about 16 bits for each listed URL, in blocks of 256. Up to `BROADCAST_BLOCKS` blocks, 1 MB,
it is broadcast; a longer list's filter is dealt by block, as the keys are. `n_blocks` sets its
size instead. No size changes a result.

Defined cases: a null URL or one without "://" has an empty host and path and fits nothing, as do
empty hosts; a key listed with both verdicts blocks; null keys and verdicts in the list are left
out; repeated pages give repeated rows; an empty list fits nothing; other columns of pages are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listwright.llm.base import LOWER, UPPER

BROADCAST_BLOCKS = 1 << 15
LEAST_BLOCKS = 1 << 8
WORDS = 4
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in its block: two in each of four words of 64 bits."""
    h = F.xxhash64(F.lit("bits"), key)

    def bit(n: int) -> Column:
        place = F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * n).bitwiseOR(bit(2 * n + 1)) for n in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """block and its four words, for blocks with a bit: at most `n_blocks` rows."""
    key = F.col("key")
    return listed.select(
        _block(key, n_blocks).alias("block"), *(m.alias(f"m{n}") for n, m in enumerate(_masks(key)))
    ).groupBy("block").agg(*(F.bit_or(f"m{n}").alias(f"b{n}") for n in range(WORDS)))


@dataclass(frozen=True)
class Lengths:
    """How many labels listed hosts have, how many slashes listed folders, and whether whole paths are listed."""

    labels: tuple[int, ...]
    folders: tuple[int, ...]
    whole: bool


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def lengths(listed: DataFrame) -> tuple[Lengths, int]:
    """The lengths in a list of keys, and how many keys it has. As many numbers as the longest key has parts."""
    host = F.substring_index("key", "/", 1)
    folder = F.col("key").endswith("/")
    found = listed.agg(
        F.collect_set(F.size(F.split(host, r"\."))).alias("labels"),
        F.collect_set(F.when(folder, _slashes(F.col("key")))).alias("folders"),
        F.coalesce(F.max(~folder), F.lit(False)).alias("whole"), F.count(F.lit(1)).alias("n"),
    ).first()
    return Lengths(tuple(sorted(found["labels"])), tuple(sorted(found["folders"])), found["whole"]), found["n"]


def keys(host: Column, path: Column, asked: Lengths) -> Column:
    """What a page can be listed under: (length of the host, key)."""
    own = F.size(F.split(host, r"\."))
    hosts = F.array(*(F.when(own >= n, F.substring_index(host, ".", -n)) for n in asked.labels)).cast("array<string>")
    folders = [F.when(_slashes(path) >= n, F.concat(F.substring_index(path, "/", n), F.lit("/"))) for n in asked.folders]
    paths = F.array(*folders, *([path] if asked.whole else [])).cast("array<string>")
    every = F.flatten(F.transform(F.array_compact(hosts), lambda h: F.transform(
        F.array_distinct(F.array_compact(paths)), lambda p: F.struct(F.length(h).alias("host_length"), F.concat(h, p).alias("key")),
    )))
    return F.when(host != "", every)


def judged(pages: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, n_blocks: int | None = None,
           unlisted: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    `rules` has key and verdict, `blocked` the keys of other listed URLs."""
    listed = rules.select("key", "verdict", F.lit(1).alias("rank"))
    if blocked is not None:
        listed = listed.union(blocked.select("key", F.lit(BLOCK), F.lit(0)))
    listed = listed.filter("key is not null and verdict is not null").groupBy("key").agg(
        F.max(F.struct("rank", "verdict")).alias("own")
    ).select("key", "own.*")
    asked_lengths, size = lengths(listed)
    n_blocks = n_blocks or max(LEAST_BLOCKS, 1 << max(size // 16 - 1, 0).bit_length())
    filter_ = bloom(listed, n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.xxhash64("url").alias("mark"), host.alias("host"), path.alias("path"))
    asked = rows.select("page_id", "mark", F.inline(keys(F.col("host"), F.col("path"), asked_lengths)))
    probe = asked.select(
        "*", _block(F.col("key"), n_blocks).alias("block"), *(m.alias(f"m{n}") for n, m in enumerate(_masks(F.col("key"))))
    )
    passes = reduce(lambda a, b: a & b, (F.col(f"b{n}").bitwiseAND(F.col(f"m{n}")) == F.col(f"m{n}") for n in range(WORDS)))
    possible = probe.join(filter_, "block").filter(passes)
    hits = possible.select("page_id", "mark", "host_length", "key").join(listed, "key").groupBy("page_id", "mark").agg(
        F.max(F.struct("rank", F.length("key").alias("length"), "host_length", "key", "verdict")).alias("best")
    ).select(F.col("page_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "best")
    joined = rows.join(hits, F.col("page_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    return joined.select(
        "page_id", "host", "path", F.when(F.col("best.rank") == 1, F.col("best.key")).alias("rule"),
        F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict"),
    )
