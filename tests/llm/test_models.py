import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggline.llm import langid, licenses, mixing, toxicity
from braggline.llm.queries import QUERIES

from .conftest import ODD_ROWS, make_docs

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# mixing ---------------------------------------------------------------------------

def brute_fill(sizes, weights, total, epochs):
    """Clamp, share the excess again, until no source is above its cap."""
    clamped = {}
    while True:
        free = [s for s in sizes if s not in clamped and weights[s] > 0]
        weight = sum(weights[s] for s in free)
        level = (total - sum(clamped.values())) / weight if weight else 0
        over = [s for s in free if level * weights[s] > epochs * sizes[s]]
        if not over:
            return {s: clamped.get(s, level * weights[s] if s in free else 0) for s in sizes}
        clamped |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("sizes,weights", [
    ((100, 100, 100), (5.0, 2.0, 1.0)), ((10, 500, 1000), (5.0, 2.0, 1.0)), ((1, 2, 3, 1000), (9.0, 9.0, 9.0, 0.1)),
    ((0, 50), (5.0, 1.0)), ((10, 10), (0.0, 1.0)), ((5,), (1.0,))])
def test_water_filling(spark, sizes, weights):
    rows = [(str(i), s, w) for i, (s, w) in enumerate(zip(sizes, weights))]
    got = mixing.water_fill(spark.createDataFrame(rows, "source string, source_size bigint, weight double"))
    want = brute_fill(dict(zip(map(str, range(9)), sizes)), dict(zip(map(str, range(9)), weights)), sum(sizes), 3)
    assert {r.source: round(r.target, 6) for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_water_filling_beyond_all_caps(spark):
    got = mixing.water_fill(spark.createDataFrame([("a", 10, 1.0), ("b", 20, 1.0)], "source string, source_size bigint, weight double"), total=1000)
    assert {r.source: r.target for r in got.collect()} == {"a": 30.0, "b": 60.0}


@pytest.mark.parametrize("piece", [20_000, 7])
def test_sources_meet_their_targets(spark, piece):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mixing.mix(docs, piece_rows=piece).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs.collect())
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
        assert sum(r.size for r in own) == own[0].source_size
    assert all(r.taken == r.times * r.size <= 3 * r.size for r in rows)
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, piece_rows=20_000).collect()))


@pytest.mark.parametrize("piece", [1_000_000, 20])
def test_the_mix_takes_what_the_plan_says(spark, piece):
    """Rows without id, repeated ids and repeated rows: the words of the mixed rows equal those taken."""
    ten = lambda i: " ".join(f"w{i}x{j}" for j in range(10))
    rows = [(None if i < 200 else i, ten(i), "en", "a") for i in range(250)] + [(None, ten(i), "en", "b") for i in range(200)]
    rows += [(5, ten(i % 3), "en", "c") for i in range(90)] + [(6, "same text again", "en", "c")] * 70 + [(7, None, "en", "b"), (8, "", None, None)]
    docs = make_docs(spark, rows)
    planned = {r.source: (r.taken, r.target) for r in mixing.mix(docs, piece_rows=piece).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    mixed = mixing.mixed_documents(docs, piece_rows=piece)
    assert mixed.columns == docs.columns
    got = {r.source: r.words for r in mixed.groupBy("source").agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))).alias("words")).collect()}
    assert {s: got.get(s, 0) for s in planned} == {s: t for s, (t, _) in planned.items()}
    assert all(abs(taken - target) <= 5 for taken, target in planned.values())


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(ODD_ROWS) and sum(r.size for r in rows) == sum(words(t) for _, t, *_ in ODD_ROWS)
    sizes = {}
    for _, t, _, s in ODD_ROWS:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_fill(sizes, {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), 3)
    assert {r.source: round(r.target, 6) for r in rows} == {s: round(t, 6) for s, t in want.items()}
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    times = {r.doc_id: r.times for r in rows}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n * sum(r.doc_id == i for r in rows) for i, n in times.items() if n}
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


# toxicity -------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op2_nbsvm"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 500 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic, clean = ([r for r in held if r.toxic == y] for y in (1, 0))
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in clean]) < 0.05
    better = np.mean([a.score > b.score for a in toxic for b in clean])
    assert better > 0.97


def test_bounded_sample_teaches_both_classes(spark):
    """Of 14 toxic and 112 clean long texts a bound for a third of the sample takes as many of each."""
    own = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [(i, " ".join(hashlib.sha256(f"{i}:{j}".encode()).hexdigest() for j in range(20)) + " " + own(i), "en", "a") for i in range(126)]
    labels = spark.createDataFrame([(i, 1, int(i < 14)) for i in range(126)], "doc_id bigint, quality int, toxic int")
    mark = np.zeros(toxicity.BUCKETS, bool)
    mean = np.mean([len(toxicity.grams(t, mark)) for _, t, *_ in rows])
    weight, _ = toxicity.train(make_docs(spark, rows), labels, F.lit(True), sample=14, sample_grams=int(mean * 8.5))
    taught = {i for i, t, *_ in rows if np.count_nonzero(weight[toxicity.grams(t, mark)]) > 0.9 * len(toxicity.grams(t, mark))}
    assert len(taught) == 8 and sum(i < 14 for i in taught) == 4


def test_repeats_of_a_sampled_id_teach_once(spark):
    rows = [(i, f"{'vile slur' if i % 2 else 'kind words'} number {i} and more of it", "en", "web") for i in range(24)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id bigint, toxic int")
    once = toxicity.train(make_docs(spark, rows), labels, F.lit(True))
    # A third of all rows repeat one id.
    repeated = toxicity.train(make_docs(spark, rows + [rows[3]] * 12), labels, F.lit(True))
    np.testing.assert_array_equal(once[0], repeated[0])
    assert once[1] == repeated[1]
    # Whole texts are left out once the next one passes the bound; nothing is left below the first.
    none, offset = toxicity.train(make_docs(spark, rows), labels, F.lit(True), sample_grams=5)
    assert not none.any() and np.isfinite(offset)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (8, 0), (8, None), (None, 1), (5, 0), (99, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(odd_docs, labels, F.lit(True))
    rows = toxicity.score(spark, odd_docs, model).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[3] == by[4] == by[6] and by[1] > by[7]
    assert [tuple(r) for r in toxicity.score(spark, odd_docs, model).collect()] == [tuple(r) for r in rows]
    assert toxicity.score(spark, no_docs, model).count() == 0
    for known in ([], [(1, 1)], [(1, 0)]):
        flat = toxicity.train(odd_docs, spark.createDataFrame(known, "doc_id bigint, toxic int"), F.lit(True))
        assert {round(r.score) for r in toxicity.score(spark, odd_docs, flat).collect()} == {1 if known == [(1, 1)] else 0}


# languages ------------------------------------------------------------------------

@pytest.mark.parametrize("n", [2, 4, 7, 8, 30])
def test_codewords_lie_apart(n):
    code = langid.codewords(n)
    gaps = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(gaps) >= max(1, code.shape[1] // 4) and (np.abs(code.sum(axis=0)) < n).all()
    assert langid.codewords(1).shape == (1, 0) and langid.codewords(0).shape == (0, 0)


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(6)
    model = langid.Model(list("abcdef"), code, None, np.ones(code.shape[1]), np.ones(code.shape[1]))
    for i in range(6):
        for flip in range(code.shape[1]):
            z = code[i].astype(float)
            z[flip] *= -1
            assert langid.decode(model, z[None])[0][0] == i


def test_margins_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    values = ["", "a", "Straße über", "x" * 500, "你好 world"]
    got = langid.margins(values, table)
    for t, row in zip(values, got):
        raw = b"  " + t.lower().encode() + b" "
        at = [((((raw[i] << 16) | (raw[i + 1] << 8) | raw[i + 2]) * 0x9E3779B1) % 2 ** 32) >> 17 for i in range(len(raw) - 2)]
        assert np.allclose(row, table[at].mean(axis=0), atol=1e-5)


def test_languages_of_held_out_rows(spark):
    truth = {d.doc_id: d.lang for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op8_language_codes"](spark, FOLDER).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(odd_docs, F.lit(True))
    assert model.languages == ["de", "en", "fr"]
    out = langid.predict(spark, odd_docs, model)
    assert out.columns == [*odd_docs.columns, "language"]
    got = {r.doc_id: r.language for r in out.collect()}
    assert [got[i].lang_pred for i in (3, 4, 6, 8)] == ["und"] * 4 and [got[i].score for i in (3, 4, 6, 8)] == [0.0] * 4
    assert [got[i].lang_pred for i in (1, 2, 5, 7, None)] == ["en", "en", "en", "de", "en"]
    one = langid.train(odd_docs.where("lang = 'de'"), F.lit(True))
    assert {r.language.lang_pred for r in langid.predict(spark, odd_docs, one).collect()} == {"de", "und"}
    none = langid.train(no_docs, F.lit(True))
    assert {r.language.lang_pred for r in langid.predict(spark, odd_docs, none).collect()} == {"und"}
    assert langid.predict(spark, no_docs, model).count() == 0


# licenses -------------------------------------------------------------------------

def test_scan_finds_spans(spark, no_docs):
    mit = licenses.TEMPLATES[11][1]
    edited = mit.replace("free of charge, ", "").replace("merge", "fold").upper()
    rows = [(1, f"intro words\n{mit} tail", None, None), (2, f"über {edited} end. All rights reserved.", None, None), (3, None, None, None), (4, "", None, None),
            (5, "all rights", None, None), (6, "Licensed under CC BY-NC 4.0. " * 500, None, None), (7, "x " * 100_000 + "Released under the MIT License", None, None),
            (7, "x " * 100_000 + "Released under the MIT License", None, None), (8, "licensed to kill under the moon", None, None)]
    docs = make_docs(spark, rows)
    got = {}
    for r in licenses.scan(spark, docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {r[0]: r[1] for r in rows}
    assert set(got) == {1, 2, 6, 7} and len(got[6]) == 500 and len(got[7]) == 2
    assert [(r.license, r.coverage) for r in got[1]] == [("MIT", 1.0)]
    assert texts[1][got[1][0].first_char:got[1][0].end_char] == mit.rstrip(".")
    found = sorted(got[2], key=lambda r: r.first_char)
    assert [r.license for r in found] == ["MIT", "All-Rights-Reserved"] and 0.9 < found[0].coverage < 1
    assert texts[2][found[1].first_char:found[1].end_char] == "All rights reserved"
    assert {(r.end_word - r.first_word) for r in got[6]} == {7}
    assert licenses.scan(spark, no_docs).count() == 0
    assert licenses.scan(spark, docs, templates=[]).count() == 0


def test_whole_notices_and_texts_go_before_their_openings(spark):
    """A changed word in a long notice does not leave its short beginning; whole texts are found to their end and BSD variants told apart."""
    notice = licenses.TEMPLATES[2][1]
    whole = {n: t for n, t in licenses.TEMPLATES[13:]}
    assert sorted(whole) == ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "ISC", "MIT", "MPL-2.0"]
    rows = [(0, "start " + notice.replace("http:", "https:") + " end", None, None), (1, notice.replace("obtain", "get"), None, None)]
    rows += [(i, "start\n" + t.replace("express or implied", "explicit or implied") + "\nend", None, None) for i, t in enumerate(whole.values(), 2)]
    got = {}
    for r in licenses.scan(spark, make_docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i in (0, 1):
        assert [r.license for r in got[i]] == ["Apache-2.0"] and got[i][0].coverage > 0.95 and got[i][0].template == 2
    for i, (name, text) in enumerate(whole.items(), 2):
        assert [r.license for r in got[i]] == [name]
        assert got[i][0].coverage > 0.97 and got[i][0].end_word - got[i][0].first_word > 0.97 * len(licenses.words(text.encode()))


def test_band_alignment_equals_full_alignment():
    rng = np.random.default_rng(4)
    for _ in range(60):
        t, ids = rng.integers(1, 5, 12), rng.integers(1, 5, 20)
        best = np.zeros((len(t) + 1, len(ids) + 1))
        for i in range(len(t)):
            for j in range(len(ids)):
                best[i + 1, j + 1] = max(0, best[i, j] + (2 if t[i] == ids[j] else -1), best[i, j + 1] - 1, best[i + 1, j] - 1)
        got = licenses.align(t, ids, -20, 20)
        assert (got is None) == (best.max() == 0)
        if got:
            assert 2 * got[0] >= best.max() and 0 <= got[1] < got[2] <= len(ids)


def test_every_license_line_of_the_table_is_found(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    lines = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.",
             "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    want = sorted((i, n) for i, t in docs.items() for n, line in enumerate(lines) for _ in range(t.count(line)))
    name = {"GPL-3.0": 0, "All-Rights-Reserved": 1, "CC-BY-NC-4.0": 2, "MIT": 3, "Apache-2.0": 4}
    assert sorted((r.doc_id, name[r.license]) for r in QUERIES["op6_license_scan"](spark, FOLDER).collect()) == want
