"""Phrases whose words occur together more often than apart, by top-order marginalisation.

Every word of a piece starts one window: itself and the next words as lead columns,
padded at the end of the piece.  Only these longest windows are counted.  A phrase of k
words begins as many windows as it occurs, so ROLLUP over the window's columns sums the
counts of all shorter phrases from the same rows.  Words travel as numbers: frequent ones
as small numbers of which three fit into a column, others as hashes that are known
to be unique, and words too rare to be in a phrase end a window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_split_hot, received, shipped, slices, written

#: Breaks between pieces are written as this byte, a break itself.
BREAK = b"."
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz......... ")
UNKNOWN = "und"
SCALE = 1_000_000
#: Words that may be named by a small number (some 100 MB in a worker), the bits of one, and numbers in a column.
CODED = (1 << 20) - 1
CODE_BITS = 20
PACK = 3
#: Bits of the filter that tells rare words, two megabytes; and words a worker keeps at hand.
FILTER_BITS = 1 << 24
BUCKET_BITS = 32768
HELD_WORDS = 300_000
#: Groups that a language's candidates are dealt to before its first ones are chosen.
RANK_PIECES = 64


def tokens(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text in lower case, with ``BREAK`` where a piece ends; no word holds that byte."""
    return raw.translate(TABLE).replace(BREAK, b" . ").split()


def spoken(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, text``: a null language is ``und``."""
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, word, f`` of every word of every language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush():
            for name, found in held.items():
                del found[BREAK]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([w.decode("utf-8") for w in found], pa.string()),
                                                  pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in slices(batches, "text"):
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if t:
                    held.setdefault(name, Counter({BREAK: 0})).update(tokens(t.encode("utf-8")))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    found = spoken(docs, lang, text).mapInArrow(run, "lang string, word string, n bigint")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def word_ids(words: DataFrame, total: int, min_count: int) -> DataFrame:
    """``lang, word, id, coded`` of the words found ``min_count`` times; rarer ones are in no phrase.

    A word that is a ``CODED``-th of all words gets a small number; at most ``CODED`` can be.  The id of any other
    word is its hash below zero, and words of one hash get numbers too.
    """
    known = words.where(F.col("f") >= min_count).withColumn("hash", word_hash())
    often = F.col("f") * CODED >= total
    shared = known.where(~often).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    small = known.where(often).unionByName(known.where(~often).join(shared, "hash", "left_semi"))
    # At most CODED rows and the rare words of one hash.
    numbers = small.select("lang", "word", F.row_number().over(Window.orderBy("lang", "word")).cast("long").alias("id"), F.lit(True).alias("coded"))
    other = known.where(~often).join(shared, "hash", "left_anti").select("lang", "word", F.col("hash").alias("id"), F.lit(False).alias("coded"))
    return numbers.unionByName(other)


def word_hash() -> Column:
    """XXH64 of ``word``, seeded by that of ``lang``, made negative."""
    return F.xxhash64("lang", "word").bitwiseOR(F.lit(-(1 << 63)))


def hash_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits: the hashes of all words that are named by hash.  A word whose bit is not set is rare."""
    # Bucket b from 1 and bit i stand for the value (b - 1) * 32768 + i + 1.
    place = F.col("id").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    parts = ids.where("not coded").select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")) + (row["b"] - 1) * BUCKET_BITS
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return bits


class Lookup(dict):
    """Word to id within one language; rare words and breaks are 0."""

    def __init__(self, lang: str, coded: dict[bytes, int], bits: np.ndarray):
        super().__init__(coded)
        self[BREAK] = 0
        self.coded, self.bits, self.seed, self.kept = coded, bits, xxhash.xxh64_intdigest(lang.encode("utf-8"), 42), 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed) | (1 << 63)
        at = h & (FILTER_BITS - 1)
        found = h - (1 << 64) if self.bits[at >> 3] >> (at & 7) & 1 else 0
        if self.kept > HELD_WORDS:
            self.clear()
            self.update(self.coded)
            self[BREAK], self.kept = 0, 0
        self[word] = found
        self.kept += 1
        return found


def windows_of(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a run of ids (0: a break) as lead columns ``[row, word]``, padded after a break, and which have small numbers only."""
    cols = np.zeros((len(ids), n), np.int64)
    cols[:, 0] = ids
    for i in range(1, n):
        cols[:-i or None, i] = np.where(cols[:-i, i - 1] != 0, ids[i:], 0) if len(ids) > i else 0
    cols = cols[cols[:, 0] != 0]
    return cols, (cols >= 0).all(axis=1)


def longest_windows(docs: DataFrame, ids: DataFrame, n: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """``k1 .. kn, n``: windows of ``n`` words that begin at each word, by ids, with counts of a part of the rows.

    Windows of small numbers have three numbers in each of the first columns and null in the last.
    """
    spark = docs.sparkSession
    named: dict[str, dict[bytes, int]] = {}
    # Bounded by CODED.
    for row in ids.where("coded").collect():
        named.setdefault(row["lang"], {})[row["word"].encode("utf-8")] = row["id"]
    shared = shipped(spark, (named, hash_bits(ids)))
    packs, names = -(-n // PACK), [f"k{i + 1}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, bits = received(shared)
        lookups: dict[str, Lookup] = {}
        for batch in slices(batches, "text"):
            runs: dict[str, list[np.ndarray]] = {}
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if t:
                    own = lookups.get(name)
                    if own is None:
                        own = lookups[name] = Lookup(name, coded.get(name, {}), bits)
                    words = tokens(t.encode("utf-8"))
                    runs.setdefault(name, []).append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
            if not runs:
                continue
            stop = np.zeros(1, np.int64)
            cols, small = windows_of(np.concatenate([x for r in runs.values() for a in r for x in (a, stop)]), n)
            packed = np.zeros((int(small.sum()), packs), np.int64)
            for i in range(n):
                packed[:, i // PACK] |= cols[small, i] << (CODE_BITS * (PACK - 1 - i % PACK))
            packed, counts = np.unique(packed, axis=0, return_counts=True) if packs > 1 else (lambda u: (u[0][:, None], u[1]))(np.unique(packed[:, 0], return_counts=True))
            wide = cols[~small]
            none = pa.nulls(len(packed), pa.int64())
            columns = [pa.concat_arrays([pa.array(packed[:, i]) if i < packs else none, pa.array(wide[:, i])]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([counts, np.ones(len(wide), np.int64)]))], [*names, "n"])

    return spoken(docs, lang, text).mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", n bigint")


def phrase_counts(windows: DataFrame, ids: DataFrame, min_count: int) -> DataFrame:
    """``lang, words, phrase, f`` of all phrases found ``min_count`` times or more.

    The longest windows are counted as they are, ROLLUP over their words but the last sums
    all shorter phrases.  Padding is 0, so that the nulls of ROLLUP are the columns
    summed away; a prefix that ends in padding is no phrase of its length.
    """
    names = windows.columns[:-1]
    n = len(names)
    longest = windows.groupBy(*names).agg(F.sum("n").alias("n"))
    mask = F.lit((1 << CODE_BITS) - 1)
    words = [F.when(F.col(names[-1]).isNotNull(), F.col(c)).otherwise(
        F.shiftright(F.col(names[i // PACK]), CODE_BITS * (PACK - 1 - i % PACK)).bitwiseAND(mask)) for i, c in enumerate(names)]
    cols = [f"s{i + 1}" for i in range(n)]
    heads = longest.select(*[w.alias(c) for w, c in zip(words, cols)], "n")
    sums = heads.rollup(*cols[:-1]).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # The level has one bit per column summed away; the grand total has them all.
    used = F.lit(n - 1) - F.bit_count("level")
    short = sums.where((used > 0) & (F.element_at(F.array(*cols[:-1]), F.greatest(used, F.lit(1))) != 0) & (F.col("f") >= min_count))
    # Both sides read one exchange: no condition on the words may be pushed below their counts here.
    every = short.select(F.array_compact(F.array(*cols[:-1])).alias("s"), "f").unionByName(
        heads.where(F.col("n") >= min_count).select(F.array(*cols).alias("s"), F.col("n").alias("f")))
    often = written(every, "phrase-ids").where(~F.array_contains("s", 0))
    named = often.withColumn("words", F.size("s"))
    small, large = F.broadcast(ids.where("coded")), ids.where("not coded")
    for i in range(n):
        own = [F.col("id").alias(f"y{i}"), F.col("word").alias(f"t{i}"), F.col("lang").alias(f"l{i}")]
        named = named.withColumn("_s", F.get("s", F.lit(i))).join(small.select(*own), F.col("_s") == F.col(f"y{i}"), "left")
        other = large.select(F.col("id").alias("_y"), F.col("word").alias("_t"), F.col("lang").alias("_l"))
        # Words named by hash are rare, so none of them is a hot key; the others stay where they are.
        far = named.where("_s < 0").join(other, F.col("_s") == F.col("_y"))
        far = far.withColumn(f"t{i}", F.col("_t")).withColumn(f"l{i}", F.col("_l")).drop("_y", "_t", "_l")
        named = written(named.where("_s is null or _s >= 0").unionByName(far).drop("_s", f"y{i}"), "phrase-names")
    phrase = F.concat_ws(" ", *[f"t{i}" for i in range(n)])
    return named.select(F.col("l0").alias("lang"), "words", phrase.alias("phrase"), "f")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, k, l, r, score`` of every candidate: its lowest-scoring cut."""
    cuts = counts.where("words > 1").withColumn("w", F.split("phrase", " ")).select(
        "lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    halves = cuts.select("lang", "phrase", "words", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("half")),
        F.struct(F.lit(False).alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("half")))).alias("h")).select(
        F.struct("lang", F.col("h.half").alias("phrase")).alias("id"), F.col("phrase").alias("whole"), "words", "a", "k", F.col("h.left").alias("left"))
    halves = written(halves, "collocation-halves")
    asked = halves.groupBy("id").agg(F.count(F.lit(1)).alias("asked"))
    found = asked.join(counts.select(F.struct("lang", "phrase").alias("id"), "f"), "id")
    pairs = join_split_hot(halves, found, "id", "asked", halves.count(), "inner")
    both = pairs.groupBy(F.col("id.lang").alias("lang"), "whole", "words", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # Products of counts may pass 64 bits; decimals of 38 digits hold them and DIV floors exactly.
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(30,0)) "
                   "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = both.withColumn("score", score).groupBy("lang", "whole", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", F.col("whole").alias("phrase"), "words", "a", "best.k", "best.l", "best.r", "best.score")


def covering(candidates: DataFrame) -> DataFrame:
    """``lang, phrase, cover``: the count of the most frequent longer candidate that holds the words of the phrase."""
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    held = candidates.where("words > 2").withColumn("w", w).select("lang", F.explode(inner).alias("phrase"), "a")
    return held.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))


def first_ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language with their ``rank``, chosen within pieces first: no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    piece = rows.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PIECES)))
    near = piece.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).where(F.col("rank") <= limit)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= limit).drop("piece")


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover_percent: int = 50, limit: int = 2_000,
         lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the
    language; the score is ``floor(1000000 * a * a / (l * r))``.  A phrase inside a longer candidate that
    has ``cover_percent`` of its count goes.  Ties fall to the larger count, then to the phrase in byte order.
    Null texts count as empty, null languages as ``und``; repeated rows count each; texts without words give
    nothing and an empty table an empty result.  Other columns are not read.
    """
    if max_words < 2:
        raise ValueError("a phrase has at least two words")
    words = written(word_counts(docs, lang, text), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ids = written(word_ids(words, words.agg(F.sum("f")).first()[0] or 0, min_count), "word-ids")
    counts = written(phrase_counts(longest_windows(docs, ids, max_words, lang, text), ids, min_count), "phrase-counts")
    candidates = written(scored(counts), "collocations")
    covers = covering(candidates).withColumnRenamed("phrase", "inner").withColumnRenamed("lang", "of")
    free = candidates.join(covers, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")), "left").where(
        F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * cover_percent))
    return first_ranked(free, limit).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
