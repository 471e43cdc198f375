"""Language identification by error-correcting output codes over n-gram classifiers.

Every language has a codeword of bits.  For each bit a binary classifier tells the
languages that have it set from those that have not: the mean log ratio of the byte
3-grams of a text.  A text's bits are decoded to the codeword of smallest loss, where a
bit weighs the more the better its classifier does on the training texts; texts whose
two nearest codewords are almost equally near are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, id_crc, joined_bytes, received, shipped, slices, texts, unit_hash

BUCKETS = 1 << 15
#: Bound of the training sample: about so many texts of each language.
SAMPLE = 4000
SCALE = float(1 << 40)
UNKNOWN = "und"
SHARPNESS = 4.0
#: A text is ambiguous if its best language has less than this share against the others.
CLEAR = 0.6


@dataclass
class Model:
    """Languages, their codewords (rows of +1 and -1), bit classifiers (bucket by bit), scale and weight of each bit."""

    languages: list[str]
    code: np.ndarray
    table: np.ndarray
    scale: np.ndarray
    trust: np.ndarray


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1 for ``n`` languages.

    Up to seven languages have every split into two sides as a bit.  More have seeded
    random bits, about 15 for each doubling of their number, drawn again for the pair of
    codewords that lie nearest until no two are nearer than a quarter of the length.
    """
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        bits = [[1 if i == 0 or m >> (i - 1) & 1 else -1 for i in range(n)] for m in range((1 << (n - 1)) - 1)]
        return np.array(bits, np.int8).T.copy()
    rng = np.random.default_rng(n)
    length = int(15 * np.ceil(np.log2(n)))
    code = rng.choice(np.array([-1, 1], np.int8), (n, length))
    while True:
        gap = (length - code.astype(int) @ code.astype(int).T) // 2 + length * np.eye(n, dtype=int)
        worst = np.unravel_index(gap.argmin(), gap.shape)
        lonely = np.flatnonzero(np.abs(code.sum(axis=0)) == n)
        if gap[worst] >= length // 4 and not len(lonely):
            return code
        if len(lonely):
            code[:, lonely] = rng.choice(np.array([-1, 1], np.int8), (n, len(lonely)))
        else:
            code[worst[0]] = rng.choice(np.array([-1, 1], np.int8), length)


def hashed(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 3-grams of the texts on one line, their places that count, and where each text starts.

    A text is lower-cased and stands between two blanks; places where a 3-gram would
    reach into the next text do not count.
    """
    raw, starts = joined_bytes([b"  " + t.lower().encode("utf-8", "replace") + b" " for t in values])
    wide = raw.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    at = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    counts = np.ones(len(raw), bool)
    counts[starts[1:] - 1] = False
    counts[starts[1:] - 2] = False
    return at, counts[:len(at)], starts[:-1]


def margins(values: list[str], table: np.ndarray) -> np.ndarray:
    """Mean log ratio of every text (row) for every bit (column)."""
    at, counts, starts = hashed(values)
    found = table[at]
    found[~counts] = 0
    n = np.add.reduceat(counts.astype(np.int64), starts)
    return np.add.reduceat(found, starts, axis=0, dtype=np.float64) / np.maximum(n, 1)[:, None]


def decode(model: Model, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the language of smallest weighted loss for every row, and its share against the others."""
    z = found / model.scale
    loss = np.zeros((len(z), len(model.languages)))
    for bit in range(z.shape[1]):
        for side in (-1, 1):
            loss[:, model.code[:, bit] == side] += model.trust[bit] * np.logaddexp(0, -SHARPNESS * side * z[:, bit])[:, None]
    best = loss.argmin(axis=1)
    share = np.exp(loss[np.arange(len(z)), best][:, None] - loss).sum(axis=1)
    return best, 1 / share


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from the rows with a language and a text for which ``learn`` (a column over ``doc_id``) holds.

    Of a language with more than ``sample`` texts a hash of the id draws about so many;
    their n-grams are counted in Spark, whole texts throughout.  What reaches the driver
    is the model: one number per bucket and bit.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(learn).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    known = {r["lang"]: r["n"] for r in sizes.collect()}  # one row per language
    if len(known) > 2000:
        raise ValueError("a codebook of over 2000 languages is not supported")
    languages = sorted(known)
    code = codewords(len(languages))
    if not languages or not code.shape[1]:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.ones(0))
    place = {name: i for i, name in enumerate(languages)}
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, sample / known[name])))])
    drawn = rows.where(unit_hash("language", F.col("doc_id").cast("string")) <= share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            names = batch.column("lang").to_pylist()
            at, counts, starts = hashed(texts(batch.column("text")))
            owner = np.repeat([place[n] for n in names], np.diff(np.append(starts, len(at))))
            for i in np.unique(owner):
                totals.setdefault(languages[i], np.zeros(BUCKETS, np.int64))[:] += np.bincount(at[(owner == i) & counts], minlength=BUCKETS)
        for name, total in totals.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["lang", "bucket", "n"])

    counted = drawn.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    # Shares as whole numbers, so that their sums do not depend on the order of the rows.
    shares = counted.join(whole, "lang").select("lang", "bucket", F.floor(F.col("n") / F.col("all") * F.lit(SCALE)).cast("bigint").alias("p"))
    words = spark.createDataFrame([(name, [int(b) for b in code[i]]) for i, name in enumerate(languages)], "lang string, code array<int>")
    sides = [F.sum(F.when(F.get("code", F.lit(j)) == 1, F.col("p")).otherwise(0)).alias(f"b{j}") for j in range(code.shape[1])]
    found = shares.join(F.broadcast(words), "lang").groupBy("bucket").agg(F.sum("p").alias("p"), F.array(*sides).alias("on")).collect()
    on, every = np.zeros((BUCKETS, code.shape[1])), np.zeros(BUCKETS)
    for row in found:
        on[row["bucket"]], every[row["bucket"]] = row["on"], row["p"]
    n_on = (code == 1).sum(axis=0)
    smooth = 0.5 / BUCKETS
    table = np.log((on / SCALE / n_on + smooth) / ((every[:, None] - on) / SCALE / (len(languages) - n_on) + smooth)).astype(np.float32)
    shared = spark.sparkContext.broadcast(table)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, code.shape[1]))
        for batch in slices(batches, "text", limit=max(1 << 16, (8 << 20) // code.shape[1])):
            right = margins(texts(batch.column("text")), shared.value) * code[[place[n] for n in batch.column("lang").to_pylist()]]
            sums += [right.sum(axis=0), (right > 0).sum(axis=0), np.full(code.shape[1], len(right))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(code.shape[1], dtype=np.int32)), *map(pa.array, sums)], ["bit", "margin", "good", "n"])

    trust, scale = np.ones(code.shape[1]), np.ones(code.shape[1])
    for row in drawn.mapInArrow(judge, "bit int, margin double, good double, n double").groupBy("bit").agg(
            F.sum("margin").alias("margin"), F.sum("good").alias("good"), F.sum("n").alias("n")).collect():
        scale[row["bit"]] = max(1e-3, round(row["margin"] / row["n"], 9))
        trust[row["bit"]] = max(0.05, 2 * row["good"] / row["n"] - 1)
    return Model(languages, code, table, scale, trust)


def predict(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """Add a struct ``lang_pred, score, ambiguous`` to every row, all other columns as they are.

    A null text or one without a letter is ``und`` with score 0; so is any text if
    nothing was learned.  With a single language every text with a letter is of it.
    """
    shared = shipped(spark, model)

    @F.arrow_udf("struct<place: int, score: double>")
    def nearest(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own: Model = received(shared)
        bits = own.code.shape[1]
        for array in column:
            places, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in slices([pa.RecordBatch.from_arrays([array], ["t"])], "t", limit=max(1 << 16, (8 << 20) // max(1, bits))):
                if bits:
                    best, share = decode(own, margins(texts(part.column("t")), own.table))
                else:
                    best, share = np.zeros(part.num_rows, np.int64), np.ones(part.num_rows)
                places.append(best)
                scores.append(share)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(scores))], ["place", "score"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    names = F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array(F.lit(UNKNOWN))
    spot = fresh(docs, "__near")
    out = docs.withColumn(spot, nearest(F.col(text)))
    near = F.col(spot)
    return out.withColumn(name, F.struct(
        F.when(letter, F.get(names, near["place"])).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(letter, near["score"]).otherwise(F.lit(0.0)).alias("score"),
        (letter & (near["score"] < CLEAR)).alias("ambiguous"))).drop(spot)


def held_out(column: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether the id's checksum falls into the fold that learning leaves out."""
    return F.pmod(id_crc(column), F.lit(folds)) == fold
