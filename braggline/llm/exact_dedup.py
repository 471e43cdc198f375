"""Exact duplicates by a cuckoo-filter index over digests of normalised texts.

Digests are dealt to shards by their hash.  A shard holds a cuckoo filter of
16-bit fingerprints, four to a bucket, and beside it the content of the buckets: the
full digests with what is known of their documents.  A look-up that hits the filter is
verified against the content; an insertion that finds no room after many moves makes
the filter twice as large and fills it again from the stored keys; a deletion takes one
matching fingerprint and the key out.  Each input task folds its own repeats through
such a filter before anything is shuffled, so a text that a third of all rows share
reaches its shard once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import SPACE, marked_rows

SLOTS = 4
MAX_MOVES = 200
#: Live digests a shard is meant to hold; the number of shards follows the number of rows.
SHARD_DIGESTS = 200_000


class CuckooIndex:
    """A cuckoo filter over 32-byte digests with the stored content that hits are checked against."""

    def __init__(self, buckets: int = 64):
        self.buckets = buckets
        self.table = [0] * (buckets * SLOTS)
        self.content: dict[int, dict[bytes, list]] = {}
        self.size = 0
        self.resizes = 0

    def spots(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and both buckets; each bucket follows from the other and the fingerprint."""
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.buckets - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def maybe(self, digest: bytes) -> bool:
        mark, a, b = self.spots(digest)
        table = self.table
        return mark in table[a * SLOTS:a * SLOTS + SLOTS] or mark in table[b * SLOTS:b * SLOTS + SLOTS]

    def get(self, digest: bytes) -> list | None:
        """The stored value of a live digest: the filter first, the bucket's content only on a hit."""
        if not self.maybe(digest):
            return None
        return self.content.get(self.home(digest), {}).get(digest)

    def home(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:18], "little") & 0xFFFF

    def insert(self, digest: bytes, value: list) -> None:
        """Add a digest that is not live."""
        self.content.setdefault(self.home(digest), {})[digest] = value
        self.size += 1
        if not self.place(digest):
            self.resize()

    def place(self, digest: bytes) -> bool:
        mark, a, b = self.spots(digest)
        table = self.table
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not table[i]:
                    table[i] = mark
                    return True
        bucket = b
        for move in range(MAX_MOVES):
            i = bucket * SLOTS + move % SLOTS
            table[i], mark = mark, table[i]
            bucket = self.other(bucket, mark)
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not table[i]:
                    table[i] = mark
                    return True
        return False

    def resize(self) -> None:
        """Double until every stored key has room."""
        settled = False
        while not settled:
            self.buckets *= 2
            self.resizes += 1
            self.table = [0] * (self.buckets * SLOTS)
            settled = all(self.place(d) for held in self.content.values() for d in held)

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; false if it is not live."""
        if self.get(digest) is None:
            return False
        mark, a, b = self.spots(digest)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[i] == mark:
                    self.table[i] = 0
                    del self.content[self.home(digest)][digest]
                    self.size -= 1
                    return True
        raise AssertionError("a live digest has no fingerprint")

    def items(self) -> Iterator[tuple[bytes, list]]:
        for held in self.content.values():
            yield from held.items()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, length, digest``: code points of the text and SHA-256 of it without ASCII white space."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.length(whole).cast("bigint").alias("length"), F.unhex(bare_sha256(text)).alias("digest"))


def bare_sha256(text: str) -> Column:
    """SHA-256, in hexadecimal digits, of a text without ASCII white space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+", "").cast("binary"), 256)


GROUPS = "digest binary, doc_id bigint, length bigint, n bigint"


def better(a: list, doc_id, length) -> bool:
    """Whether a row goes before the stored ``[doc_id, length, n]``: longer, then smaller id, null ids last."""
    if length != a[1]:
        return length > a[1]
    return doc_id is not None and (a[0] is None or doc_id < a[0])


def offer(index: CuckooIndex, digest: bytes, doc_id, length: int, n: int) -> None:
    """Add ``n`` documents of one text, of which the given one is best, to the index."""
    held = index.get(digest)
    if held is None:
        index.insert(digest, [doc_id, length, n])
    else:
        held[2] += n
        if better(held, doc_id, length):
            held[0], held[1] = doc_id, length


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    names = ["digest", "doc_id", "length", "n"]
    block: list[tuple] = []
    for digest, value in index.items():
        block.append((digest, *value))
        if len(block) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names)


def _fold(limit: int | None):
    """Fold rows of equal digests; with a limit, hand on what is held when so many digests are live."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc_id", "length", "n"))):
                offer(index, *row)
            if limit and index.size >= limit:
                yield from _rows(index)
                index = CuckooIndex()
        yield from _rows(index)
    return run


def build_index(rows: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """``digest, doc_id, length, n``: every live text once, with its best document and number of rows.

    ``rows`` is what ``digests`` returns.  The result is the index's stored content and
    can be kept as a table; ``insert_rows`` and ``delete_rows`` carry it on.
    """
    return _dealt(_folded(rows, shard_digests), rows.count(), shard_digests).mapInArrow(_fold(None), GROUPS)


def _folded(rows: DataFrame, shard_digests: int) -> DataFrame:
    """The groups of equal digests that each input task sees."""
    single = rows.select("digest", "doc_id", "length", F.lit(1).cast("bigint").alias("n"))
    return single.mapInArrow(_fold(shard_digests), GROUPS)


def _dealt(groups: DataFrame, n_rows: int, shard_digests: int) -> DataFrame:
    """Deal groups to the shards that own their digests; ``n_rows`` bounds the digests from above."""
    least = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(max(least, -(-n_rows // shard_digests)), "digest")


def insert_rows(index: DataFrame, rows: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """The index with further documents; an id that is in it already counts again."""
    n = index.count() + rows.count()
    return _dealt(index.unionByName(_folded(rows, shard_digests)), n, shard_digests).mapInArrow(_fold(None), GROUPS)


def delete_rows(index: DataFrame, gone: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """The index without the digests of ``gone``; digests that are not live change nothing."""
    none = F.lit(None).cast("bigint")
    marks = gone.select("digest", none.alias("doc_id"), none.alias("length"), none.alias("n"), F.lit(True).alias("gone")).dropDuplicates(["digest"])
    both = _dealt(index.withColumn("gone", F.lit(False)).unionByName(marks), index.count() + marks.count(), shard_digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = CuckooIndex(), []
        for batch in batches:
            for digest, doc_id, length, n, is_gone in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc_id", "length", "n", "gone"))):
                if is_gone:
                    out.append(digest)
                else:
                    offer(held, digest, doc_id, length, n)
        for digest in out:
            held.delete(digest)
        yield from _rows(held)

    return both.mapInArrow(run, GROUPS)


def resolve(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``digests``."""
    live = index.select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    return rows.join(live, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                                            F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Label every document with the one that stays of its equals.

    Texts are equal when they are so without ASCII white space (null counts as empty).
    The row with the most code points stays, then the smallest id; a null id goes last.
    Repeated rows of one id share its fate and each has a row here; an empty table gives
    an empty result; other columns are not read.
    """
    rows = checkpointed(digests(docs, key, text))
    return resolve(rows, build_index(rows))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows decide by id and text together: texts that differ all stay, under whatever ids,
    and of rows equal in both the longest stays once.
    """
    kept = deduplicate(docs, key, text).where("kept").select("doc_id", "text_sha256")
    return marked_rows(docs, key, bare_sha256(text), kept, F.coalesce(F.length(text), F.lit(0)))
