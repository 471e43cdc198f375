"""What each filter of a chain removes, in every order of the filters.

A document is a mask of the filters it fails, and documents of one mask share their
fate, so a part of the table comes down to at most ``2^k`` masks with weights.  The step
at which a mask is removed is a min-plus product: mask matrix (0 where it fails a
filter, infinity elsewhere) by position matrix (the inverse permutation of each order).
Everything reported is a weighted scatter count over these steps.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_split_hot, text_mark, written

#: Orders grow as the factorial of the filters; eight give 40,320.
MOST_FILTERS = 8

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
MARKS = "[#$%&*|]"

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """``steps[m, o]``: the step, from 1, at which order ``o`` removes mask ``m``; one past the last where it never does."""
    k = orders.shape[1]
    position = np.argsort(orders, axis=1) + 1
    never = k + 1
    fails = np.where((masks[:, None] >> np.arange(k)) & 1, 0, never)
    steps = np.full((len(masks), len(orders)), never)
    for f in range(k):
        np.minimum(steps, fails[:, f, None] + position[None, :, f], out=steps)
    return steps


def scattered(steps: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``sums[o, s]``: the weight of the masks that order ``o`` removes at step ``s + 1``; the last column survives."""
    n_orders = steps.shape[1]
    sums = np.zeros((n_orders, k + 1), np.int64)
    np.add.at(sums, (np.arange(n_orders)[None, :], steps - 1), weights[:, None])
    return sums


def audit_part(masks: np.ndarray, rows: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: list[str]) -> pd.DataFrame:
    """All orders and steps of one part, given its masks and their weights."""
    k = len(filters)
    orders = np.array(list(itertools.permutations(range(k))))
    steps = removal_steps(masks, orders)
    removed = scattered(steps, rows, k)
    fails = np.array([rows[(masks >> f) & 1 == 1].sum() for f in range(k)], np.int64)
    alone = np.array([rows[masks == 1 << f].sum() for f in range(k)], np.int64)
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, orders, removed[:, :k])
    flat = orders.ravel()
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(filters[f] for f in o) for o in orders], k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        "filter": np.array(filters)[flat],
        "kept": (rows.sum() - np.cumsum(removed[:, :k], axis=1)).ravel(),
        "removed": removed[:, :k].ravel(),
        "redundant": fails[flat] - removed[:, :k].ravel(),
        "unique_fails": alone[flat],
        "good_lost": scattered(steps, good, k)[:, :k].ravel(),
        "toxic_lost": scattered(steps, toxic, k)[:, :k].ravel(),
        "shapley": shapley[flat]})


def audit(rows: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """``part, filter_order, step, filter`` and the counts, for every order of ``filters`` (name to failure condition).

    A null condition is not failed, a null part is the empty string, null weights are 0.
    Only sums by part and mask are shuffled, at most ``2^k`` a part.
    """
    names = list(filters)
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, their orders are all listed")
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    flags = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
                        F.coalesce(good.cast("long"), F.lit(0)).alias("good"), F.coalesce(toxic.cast("long"), F.lit(0)).alias("toxic"))
    sums = flags.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # By value: the workers need not have this package.
    kernel = audit_part

    def one_part(key, frame):
        cols = [frame[c].to_numpy(np.int64) for c in ("mask", "n", "good", "toxic")]
        out = kernel(*cols, names)
        out.insert(0, "part", key[0])
        return out

    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return sums.groupBy("part").applyInPandas(one_part, schema)


def document_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id, part, mark, a, b, c, d``: the four conditions that a text decides alone, and its digest."""
    whole = docs.select(F.col(key).alias("doc_id"), F.col(part).cast("string").alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = whole.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return words.select("doc_id", "part", text_mark("t").alias("mark"), (n < MIN_WORDS).alias("a"), (distinct * 100 < n * MIN_DISTINCT_PERCENT).alias("b"),
                        (capitals * 100 > F.length("t") * MAX_CAPITAL_PERCENT).alias("c"), F.col("t").rlike(MARKS).alias("d"))


def with_first_ids(facts: DataFrame) -> DataFrame:
    """Add ``first``: the smallest id of the rows of equal ``mark``, null where no other row has it."""
    copies = facts.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return join_split_hot(facts, copies.where("copies > 1"), "mark", "copies", facts.count())


def with_labels(facts: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``good`` and ``toxic``: 1 where any label row of the id says so, else 0.  A null id has no labels."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    none = [F.lit(None).cast("int").alias(c) for c in ("good", "toxic")]
    # Rows without id would meet in one task of the join.
    return facts.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(facts.where("doc_id is null").select("*", *none))


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of five filters over whole texts, by ``part``.

    A: under 200 words; B: fewer than half of the words distinct; C: over 3 % capitals A-Z; D: holds one
    of ``#$%&*|``; E: a row of smaller id has the same text.  A null text counts as empty and a null part as the
    empty string.  Every row is a document: rows of one id and text do not precede each other, a row without
    id neither precedes nor follows.  Labels of a repeated id hold if any of its label rows says so.
    An empty table gives an empty result; other columns are not read.
    """
    facts = written(document_failures(docs, key, text, part), "filter-facts")
    rows = with_labels(with_first_ids(facts), labels)
    failed = {"A": F.col("a"), "B": F.col("b"), "C": F.col("c"), "D": F.col("d"), "E": F.col("doc_id") > F.col("first")}
    return audit(rows, failed, F.col("part"), F.col("good"), F.col("toxic"))
