"""Mixing sources to target weights by capped water-filling.

The words to hand out are shared by weight; a source whose share is above its size
times the largest number of epochs is clamped there, and what it cannot take is shared
again by weight among the others, until no share is above its cap.  A source then repeats
all its documents a whole number of times, and a seeded part of them once more: the
documents in the order of a hash, up to the words that are still missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import WORD, dense_rank_rows, fresh, join_split_hot, numbered, sums_before, unit_hash, written

#: Places of the order that are sorted in one piece.
PIECE_ROWS = 1_000_000


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Add ``weight``: the given weights, repeating, along the sources in code-point order with null last."""
    ranked = dense_rank_rows(sources, [F.asc_nulls_last("source")], "__rank")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.element_at(values, (F.col("__rank") % len(weights)).cast("int") + 1)).drop("__rank")


def water_fill(sources: DataFrame, total: int | None = None, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``; ``total`` defaults to all words.

    Each round is one aggregate over the sources.  It ends when the clamped sources no
    longer change; if all are clamped, the rest of ``total`` cannot be placed and is left.
    A source without weight or words has target 0.
    """
    cap = F.col("source_size") * max_epochs
    clamped = F.lit(False)
    level, count = 0.0, -1
    while True:
        held = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(clamped, cap).otherwise(0)).alias("caps"),
            F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(clamped.cast("long")).alias("n")).first()
        if held["all"] is None or held["n"] == count:
            break
        count = held["n"]
        level = ((held["all"] if total is None else total) - held["caps"]) / held["weight"] if held["weight"] else float("inf")
        clamped = (F.col("weight") > 0) & (F.lit(level) * F.col("weight") > cap)
    share = F.when(F.col("weight") > 0, F.least(F.lit(level) * F.col("weight"), cap.cast("double"))).otherwise(0.0)
    return sources.withColumn("target", F.when(F.col("source_size") > 0, share).otherwise(0.0))


#: What orders the rows of a source: hash of the id, id, size, and a hash of the text for rows that share these.
ORDER = ["spot", "doc_id", "size", "mark"]


def take(documents: DataFrame, sources: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``whole`` and ``once`` to ``documents``, one row per source and ``ORDER`` with its rows in ``copies``.

    ``sources`` is ``source, source_size, target``.  Every copy is taken ``whole`` times, ``once`` of the copies
    once more.  Documents of a source stand in ``ORDER``; after the whole repetitions a
    document is taken once more while at least half of it fits into the words still missing,
    so a source misses its target by half a document at most.
    """
    facts = sources.select(F.col("source").alias("__source"), "source_size", "target", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("whole"))
    run = sums_before(documents.withColumn("words", F.col("size") * F.col("copies")), "source", ORDER, "words", "until", piece_rows)
    joined = run.join(facts, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "words")
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    fits = F.col("until") + F.col("size") / 2.0 <= missing
    # Of many copies the first ones fit: copy i from 0 needs until + (i + 1/2) * size.
    many = F.greatest(F.lit(0), F.least(F.col("copies"), F.floor((missing - F.col("until")) / F.col("size") + 0.5)))
    once = F.when((missing > 0) & fits, F.when((F.col("copies") == 1) | (F.col("size") == 0), F.col("copies")).otherwise(many)).otherwise(0)
    return joined.withColumn("once", once.cast("bigint")).drop("until")


def ordered(docs: DataFrame, seed: str, key: str, source: str, text: str) -> DataFrame:
    """``docs`` with ``source, ORDER`` as a struct column ``__at``."""
    content = F.coalesce(F.col(text), F.lit(""))
    ident = F.col(key).cast("bigint")
    return docs.withColumn(fresh(docs, "__at"), F.struct(
        F.col(source).cast("string").alias("source"), unit_hash(seed, ident.cast("string")).alias("spot"), ident.alias("doc_id"),
        F.regexp_count(content, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(content).alias("mark")))


def planned(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, total: int | None, seed: str,
            key: str, source: str, text: str, piece_rows: int) -> DataFrame:
    """What is taken of every row's place in its source; rows of one place are counted in ``copies``."""
    places = ordered(docs, seed, key, source, text)
    places = places.groupBy(F.col(fresh(docs, "__at")).alias("at")).agg(F.count(F.lit(1)).alias("copies"))
    documents = checkpointed(places.select("at.*", "copies"))
    sources = documents.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    return take(documents, water_fill(cyclic_weights(sources, weights), total, max_epochs), piece_rows)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, total: int | None = None, seed: str = "mix",
        key: str = "doc_id", source: str = "source", text: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken`` for every row.

    Null texts have size 0, the null source is a source of its own and stands last.
    Documents of equal hash (repeated ids) stand by size, then by a hash of the text.  Documents without
    words are repeated with their source's whole repetitions and fill nothing.  An empty table gives
    an empty result; other columns are not read.  Reruns agree: the order is a hash of the id.
    """
    plan = planned(docs, weights, max_epochs, total, seed, key, source, text, piece_rows)
    rows = numbered(plan, "copies", "copy")
    times = F.col("whole") + F.when(F.col("copy") < F.col("once"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, total: int | None = None, seed: str = "mix",
                    key: str = "doc_id", source: str = "source", text: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, as often as ``mix`` takes it.

    What is taken once more is a beginning of its source's order, so the place where it ends
    decides every row where it stands and no text is shuffled.  Of rows equal in source, id
    and text that are taken in part, one stands for the others.
    """
    plan = planned(docs, weights, max_epochs, total, seed, key, source, text, piece_rows)
    at, own, end, number, copy = (fresh(docs, n) for n in ("__at", "__source", "__end", "__times", "__copy"))
    place = F.struct(*ORDER)
    ends = plan.groupBy(F.col("source").alias(own)).agg(
        F.first("whole").alias("whole"), F.count(F.lit(1)).alias("places"),
        F.min(F.when(F.col("once") < F.col("copies"), F.struct(place.alias("place"), "once"))).alias("end"))
    ends = written(ends.select(F.struct(F.col(own).alias("source")).alias(own), F.struct("whole", "places", "end").alias(end)), "mix-ends")
    rows = ordered(docs, seed, key, source, text).withColumn(own, F.struct(F.col(f"{at}.source").alias("source")))
    facts = ends.select(own, end, F.col(f"{end}.places").alias(number))
    rows = join_split_hot(rows, facts, own, number, plan.count(), "inner").drop(number)
    here, stop = F.struct(*[F.col(f"{at}.{c}").alias(c) for c in ORDER]), F.col(f"{end}.end.place")
    more = F.when(stop.isNull() | (F.col(f"{at}.spot") < stop["spot"]), 1).when(F.col(f"{at}.spot") > stop["spot"], 0).when(here < stop, 1).otherwise(0)
    whole = rows.withColumn(number, F.col(f"{end}.whole") + more).where(F.col(number) > 0)
    out = whole.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(number)))).select(*docs.columns)
    # At most one place of a source is taken in part.
    part = rows.where((F.col(f"{end}.end.once") > 0) & (F.col(f"{at}.spot") == stop["spot"]) & (here == stop))
    one = part.groupBy(own).agg(F.max_by(F.struct(*docs.columns), F.lit(0)).alias(at), F.first(f"{end}.end.once").alias(number))
    return out.unionByName(numbered(one, number, copy).select(f"{at}.*"))
