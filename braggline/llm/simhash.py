"""Near duplicates by SimHash: exact tiled comparison of all fingerprints.

Fingerprints are folded to distinct ones and dealt to tiles by the population counts of
their four 16-bit blocks.  Two fingerprints differ in at least as many bits as their
block counts differ in sum, so a pair of tiles whose counts differ by more than the
radius is skipped; every other pair is compared in full with exclusive-or and bit counts
on numpy blocks.  Tiles above a size are cut into pieces, and each comparison hands on a
forest of its links instead of the links, so a crowd of near copies stays linear.

``keep_first`` decides by the texts themselves: longer sketches only propose groups, and
two texts link when their whole sets of shingles are similar enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracks import connected_components
from ..session import checkpointed
from .common import marked_rows, slices, text_mark, written
from .groups import Links, by_key

SEED = 42
SHINGLE = 3
RADIUS = 2
TILE = 8192
BLOCKS = 4
#: Of ``keep_first``: words to a shingle, Jaccard similarity of whole shingle sets, and shingles that one side of a verifying task holds.
KEEP_SHINGLE = 5
SIMILARITY = 0.8
PIECE_SHINGLES = 1 << 22
SKETCH = ["f0", "f1", "f2", "f3"]
SIDE = 17  # population counts of a 16-bit block: 0 to 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(raw: bytes, shingle: int) -> bytes:
    """Eight bytes for each shingle of UTF-8 text whose letters A-Z are lower case; a shorter text is one shingle."""
    words = raw.split()
    if not words:
        return b""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())])


def majority(hashes: bytes) -> int:
    """The signed number whose bits most of the hashes have; zero without hashes."""
    seen = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.bincount((seen + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(seen)).tobytes(), "big", signed=True)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text whose letters A-Z are lower case; zero without words."""
    return majority(shingle_hashes(raw, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed 64-bit number."""
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [0 if t is None else fingerprint(t.encode("utf-8").lower(), shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id bigint, fp bigint")


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Half of the steps between tiles within the radius: of each step and its reverse, the one that starts positive."""
    reach = range(-radius, radius + 1)
    return [s for s in product(reach, repeat=BLOCKS) if 0 < sum(map(abs, s)) <= radius and s > (0,) * BLOCKS]


def compare(home: np.ndarray, partner: np.ndarray, radius: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of ``[home, partner]``: every pair of home rows and every home row with every partner."""
    rows = np.concatenate((home, partner)).view(np.uint64)  # numpy counts the bits of the absolute value of signed numbers
    links = Links(len(rows))
    step = max(1, block // max(1, len(rows)))
    for start in range(0, len(home), step):
        part = rows[start:min(start + step, len(home))]
        near = np.bitwise_count(part[:, None] ^ rows[None, start:]) <= radius
        left, right = np.nonzero(near)
        other = left < right
        links.add(left[other] + start, right[other] + start)
    return links.forest()


def tile_counts(placed: DataFrame, tile: int) -> DataFrame:
    """``cell, n, m``: the rows of each tile and the pieces it is cut into."""
    return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", "n", F.ceil(F.col("n") / tile).cast("int").alias("m"))


def tile_groups(placed: DataFrame, cells: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``cell, home, q, role`` and ``columns``, sorted by group: every piece of a tile (role 0) with the pieces it is compared with (role 1).

    ``placed`` has ``cell`` and ``columns``, whose first tells the rows apart; ``pairs``
    (``cell, m, other, other_m``) says which other tiles a tile meets.
    """
    # At most 17^4 tiles (of fingerprints) or one per size class: sent to the rows, so that a tile of any size is cut where its rows are.
    most = pairs.groupBy("cell").agg(F.max("other_m").alias("most"))
    reverse = pairs.groupBy("other").agg(F.collect_list(F.struct("cell", "m")).alias("homes")).withColumnRenamed("other", "cell")
    facts = written(cells.join(most, "cell", "left").join(reverse, "cell", "left"), "tiles")
    tiled = placed.join(F.broadcast(facts), "cell").withColumn("sub", F.pmod(F.xxhash64(columns[0]), F.col("m")).cast("int"))
    # A home piece meets piece q of each partner tile in group (cell, sub, q), and the later pieces of its own tile.
    home = (tiled.where("n > 1 or most is not null")
            .select("cell", "sub", F.explode(F.sequence(F.lit(0), F.greatest("m", F.coalesce("most", F.lit(1))) - 1)).alias("q"), F.lit(0).alias("role"), *columns))
    own = tiled.where("sub > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("sub") - 1)).alias("home"), F.col("sub").alias("q"), F.lit(1).alias("role"), *columns)
    far = (tiled.select(F.col("sub").alias("q"), *columns, F.explode("homes").alias("at")).select("q", *columns, "at.cell", "at.m")
           .select("cell", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("home"), "q", F.lit(1).alias("role"), *columns))
    keys = ["cell", "home", "q"]
    return home.withColumnRenamed("sub", "home").unionByName(own).unionByName(far).repartition(*keys).sortWithinPartitions(*keys)


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that hold all components together."""
    mask = (1 << 16) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(mask)) for i in range(BLOCKS)]
    number = lambda parts: sum((p * SIDE ** i for i, p in enumerate(parts[1:], 1)), parts[0])
    placed = distinct.select("fp", number(counts).cast("int").alias("cell"))
    cells = tile_counts(placed, tile)
    place = [F.floor(F.col("cell") / SIDE ** i).cast("int") % SIDE for i in range(BLOCKS)]
    steps = [F.when(sum((F.when((p + s).between(0, SIDE - 1), 0).otherwise(1) for p, s in zip(place, step)), F.lit(0)) == 0,
                    F.col("cell") + number(list(step))) for step in neighbours(radius)]
    # Pairs of tiles within the radius: at most 20 for each of the 17^4 tiles, whatever the data.
    pairs = (cells.select("cell", "m", F.explode(F.array(*steps)).alias("other")).where("other is not null")
             .join(cells.select(F.col("cell").alias("other"), F.col("m").alias("other_m")), "other"))
    keys = ["cell", "home", "q"]
    groups = tile_groups(placed, cells, pairs, ["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, sub, q), group in by_key(batches, keys):
            role = group.column("role").to_numpy()
            fp = group.column("fp").to_numpy()
            mine, others = fp[role == 0], fp[role == 1]
            if len(mine) and len(mine) + len(others) > 1:
                rows = np.concatenate((mine, others))
                a, b = compare(mine, others, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a]), pa.array(rows[b])], ["a", "b"])

    return groups.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Two documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id that links reach, the row's own included.  Null
    and empty texts have fingerprint zero and link like any other; null ids count for
    links and are never a smallest id unless alone; repeated rows give repeated results;
    an empty table an empty one; other columns are not read.
    """
    marked = checkpointed(fingerprints(docs, key, text, shingle))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(distinct.select("fp"), radius))
    named = distinct.join(roots.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(raw: bytes, shingle: int) -> tuple[np.ndarray, list[int]]:
    """The distinct shingle hashes of a text in order, and a fingerprint of 256 bits over them as signed numbers."""
    found = np.unique(np.frombuffer(shingle_hashes(raw, shingle), ">u8").astype(np.uint64))
    prints = []
    for i in range(len(SKETCH)):
        x = found + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        for turn, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(turn))) * np.uint64(factor)
        prints.append(majority((x ^ (x >> np.uint64(31))).tobytes()))
    return found, prints


def reach(similarity: float) -> int:
    """Bits of a sketch that may differ between candidates.

    Sets of the given similarity are expected to differ in the angle between them as a
    share of 256 bits (39 at 0.8, deviation 6); 33 more also cover sets of a few shingles,
    whose majorities are less even.  Unrelated texts differ in 128 bits, deviation 8.
    """
    return int(256 * np.arccos(2 * similarity / (1 + similarity)) / np.pi) + 34


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``doc_id, mark, grams, shingles`` and the sketch: digests of the text and of its set of so many shingles."""
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_mark(text).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for t in batch.column("text").to_pylist():
                found, prints = sketch((t or "").encode("utf-8").lower(), shingle)
                rows.append((hashlib.blake2b(found.tobytes(), digest_size=16).digest(), len(found), *prints))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.binary(), *[pa.int64()] * 5])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *arrays], ["doc_id", "mark", "grams", "shingles", *SKETCH])

    return source.mapInArrow(run, "doc_id bigint, mark binary, grams binary, shingles bigint, " + ", ".join(f"{c} bigint" for c in SKETCH))


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits in which each row of ``one`` differs from each of ``many``."""
    out = np.zeros((len(one), len(many)), np.uint16)
    for w in range(one.shape[1]):
        out += np.bitwise_count(one[:, None, w] ^ many[None, :, w])
    return out


def candidate_links(distinct: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """``a, b``: links between sets ``grams`` that hold all groups of candidates together.

    Sizes of similar sets lie in the same or the next class of a geometric scale, so a
    tile of one class is compared in full with itself and the next.
    """
    far = reach(similarity)
    columns = ["grams", "shingles", *SKETCH]
    cell = F.floor(F.log("shingles") / float(-np.log(similarity))).cast("int")
    placed = distinct.where("shingles > 0").select(cell.alias("cell"), *columns)
    cells = tile_counts(placed, tile)
    pairs = (cells.select("cell", "m", (F.col("cell") + 1).alias("other"))
             .join(cells.select(F.col("cell").alias("other"), F.col("m").alias("other_m")), "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, ["cell", "home", "q"]):
            order = np.argsort(group.column("role").to_numpy(), kind="stable")
            n_home = int((group.column("role").to_numpy() == 0).sum())
            if not n_home or len(order) < 2:
                continue
            prints = np.column_stack([group.column(c).to_numpy() for c in SKETCH]).view(np.uint64)[order]
            size = group.column("shingles").to_numpy()[order]
            links = Links(len(order))
            step = max(1, (1 << 18) // len(order))
            for start in range(0, n_home, step):
                end = min(start + step, n_home)
                left, right = np.nonzero(apart(prints[start:end], prints[start:]) <= far)
                left, right = left + start, right + start
                fit = (left < right) & (np.minimum(size[left], size[right]) >= similarity * np.maximum(size[left], size[right]))
                links.add(left[fit], right[fit])
            a, b = links.forest()
            if len(a):
                names = group.column("grams").combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(order[a])), names.take(pa.array(order[b]))], ["a", "b"])

    return tile_groups(placed, cells, pairs, columns).mapInArrow(run, "a binary, b binary")


def verified(sets: list[np.ndarray], prints: np.ndarray, side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between sets of at least the similarity; with ``side`` only of those between its two values.

    The nearest sketches are tried first and rows linked already are not tried again, so a
    crowd of near copies takes one comparison of sets a row.
    """
    far, root = reach(similarity), np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    for x in range(1, len(sets)):
        bits = apart(prints[x:x + 1], prints[:x])[0]
        fit = (bits <= far) & (np.minimum(size[:x], size[x]) >= similarity * np.maximum(size[:x], size[x])) & (root[:x] != root[x])
        if side is not None:
            fit &= side[:x] != side[x]
        rest = np.flatnonzero(fit)
        rest = rest[np.argsort(bits[rest], kind="stable")]
        while len(rest):
            y, rest = rest[0], rest[1:]
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= similarity * (size[x] + size[y] - both):
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
                rest = rest[root[rest] != low]
    rows = np.flatnonzero(root != np.arange(len(root)))
    return rows, root[rows]


def verified_links(docs: DataFrame, distinct: DataFrame, text: str, shingle: int, similarity: float, piece: int = PIECE_SHINGLES) -> DataFrame:
    """``a, b``: links between sets ``grams`` of at least the similarity, each verified on the whole texts.

    A group of candidates with more than ``piece`` shingles is cut into pieces, and each
    pair of pieces is verified in a task of its own.
    """
    roots = checkpointed(connected_components(candidate_links(distinct, similarity)))
    member = roots.select(F.col("node").alias("grams"), "component").unionByName(roots.select(F.col("component").alias("grams"), "component").distinct())
    member = distinct.join(member, "grams").select("grams", "shingles", *SKETCH, F.col("first.mark").alias("mark"), "component")
    pieces = member.groupBy("component").agg(F.ceil(F.sum("shingles") / piece).cast("int").alias("m"))
    placed = member.join(pieces, "component").withColumn("sub", F.pmod(F.xxhash64("grams"), F.col("m")).cast("int"))
    whole = docs.select(text_mark(text).alias("mark"), F.col(text).alias("text")).join(placed.select("mark"), "mark").groupBy("mark").agg(F.first("text").alias("text"))
    # Two groups of one hash would only be verified together.
    keys = ["cell", "i", "j"]
    groups = (placed.join(whole, "mark").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
              .select(F.xxhash64("component").alias("cell"), F.least("sub", "t").alias("i"), F.greatest("sub", "t").alias("j"), "sub", "grams", *SKETCH, "text")
              .repartition(*keys).sortWithinPartitions(*keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in by_key(batches, keys):
            if group.num_rows < 2:
                continue
            sets = [sketch((t or "").encode("utf-8").lower(), shingle)[0] for c in group.column("text").chunks for t in c.to_pylist()]
            prints = np.column_stack([group.column(c).to_numpy() for c in SKETCH]).view(np.uint64)
            a, b = verified(sets, prints, group.column("sub").to_numpy() if i < j else None, similarity)
            if len(a):
                names = group.column("grams").combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], ["a", "b"])

    return groups.mapInArrow(run, "a binary, b binary")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = KEEP_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of the documents that links hold together the one of smallest id, with all its columns.

    Two documents link when the Jaccard similarity of their whole sets of shingles is at
    least ``similarity``; letters A-Z count as small.  Sketches propose the pairs, see
    ``reach``.  A null id goes last; of rows of one id in a component the one of
    smallest text digest stays, once.
    """
    marked = checkpointed(sketches(docs, key, text, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    distinct = checkpointed(marked.groupBy("grams").agg(F.min(row).alias("first"), *[F.first(c).alias(c) for c in ("shingles", *SKETCH)]))
    roots = connected_components(verified_links(docs, distinct, text, shingle, similarity))
    named = distinct.join(roots.select(F.col("node").alias("grams"), "component"), "grams", "left").withColumn("component", F.coalesce("component", "grams"))
    best = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.mark").alias("text_mark"))
    kept = marked.join(best, (F.col("mark") == F.col("text_mark")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "mark")
    return marked_rows(docs, key, text_mark(text), kept)
