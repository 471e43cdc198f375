import base64
import gzip
import hashlib
import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braggline.llm import warc
from braggline.llm.queries import ORACLES, QUERIES

from .conftest import make_docs

FOLDER = "/root/testdata/sf0.001"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_of_odd_pages(spark):
    pages = [(1, "http://a/x y\r\nWARC/1.1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""),
             (5, "http://e", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "http://ü", "ß" * 300_000),
             (None, "http://n", "<p>one</p>"), (7, "http://g", "same"), (7, "http://g", "same"), (8, "http://h", "\n"), (9, "http://i", "\n")]
    frame = spark.createDataFrame([(*p, "x", True, 1) for p in pages], "page_id bigint, url string, html string, digest string, revisit boolean, value int")
    rows = warc.round_trip(spark, frame).collect()
    got = {r.metadata.page_id: r for r in rows}
    assert len(rows) == len(got) == 10  # the page repeated in full is one capture
    for i, url, html in pages:
        r, first = got[i], {2: 1, None: 1, 4: 3, 9: 8}.get(i)
        assert r.response.record_type == ("revisit" if first else "response")
        facts = (r.original if first else r.response)
        assert (facts.payload_bytes, facts.payload_digest) == (len((html or "").encode()), digest(html))
        assert r.response.declared_digest == digest(html)
        assert (r.original.page_id if first else r.original) == first
        assert r.request.target_uri == r.response.target_uri
    assert got[1].response.target_uri == "http://a/x%20y%0D%0AWARC/1.1" and got[2].response.target_uri is None


def test_every_page_row_comes_back(spark):
    """Equal ids (or none) and payloads under other URLs, and rows repeated in full."""
    pages = [(1, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (1, None, "<p>x</p>"), (1, "null", "<p>x</p>"), (2, "http://a", "<p>x</p>"), (2, "http://c", "<p>x</p>"),
             (None, "http://a", ""), (None, "http://b", ""), (None, None, None), (3, "http://d", "y"), (3, "http://d", "y"), (3, "http://d", "y"), (None, "http://a", "")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = warc.every_row(warc.round_trip(spark, frame)).collect()
    got = [(r.metadata.page_id, r.response.target_uri, r.response.declared_digest) for r in rows]
    assert sorted(got, key=repr) == sorted([(i, u, digest(h)) for i, u, h in pages], key=repr)
    assert all(r.request.target_uri == r.response.target_uri for r in rows)
    assert {(r.metadata.page_id, r.original.page_id) for r in rows if r.response.record_type == "revisit"} == {(2, 1)}
    assert {r.metadata.page_id for r in rows if r.response.record_type == "response"} == {1, 3, None}


def test_small_payloads_are_no_revisits(spark):
    frame = spark.createDataFrame([(i, "u", "ab") for i in range(3)], "page_id bigint, url string, html string")
    rows = warc.round_trip(spark, frame, min_bytes=3).collect()
    assert {r.response.record_type for r in rows} == {"response"} and len(rows) == 3


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_payloads_come_back(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"http://{i}", f"<b>{i}</b>") for i in range(30)], "page_id bigint, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"), records_per_file=4)
    rows = warc.assemble(warc.read_records(spark, str(tmp_path / "w"), with_payload=True)).collect()
    assert {r.metadata.page_id: bytes(r.response.payload) for r in rows} == {i: f"<b>{i}</b>".encode() for i in range(30)}


def test_records_in_any_file_and_packing():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    many = gzip.compress(one) + gzip.compress(one * 2)
    assert [b for _, b in warc.records(many)] == [b"abc"] * 3 == [b for _, b in warc.records(one * 3)]
    with pytest.raises(ValueError):
        list(warc.records(one[:-6]))


def test_lone_records_are_kept(spark):
    rows = spark.createDataFrame([("request", "r1", "gone", None, "u", None, None, None, None, None)], warc.RECORD)
    out = warc.assemble(rows).collect()
    assert len(out) == 1 and out[0].response is None and out[0].request.record_id == "r1"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, FOLDER).select(*columns).collect()))) == sorted(map(repr, cur.fetchall()))


def test_stages_on_planted_rows(spark):
    filler = "the lazy dog and the quick fox walked over to the old mill near the river while it was raining on the hill "
    base = " ".join(f"word{i}x" for i in range(400))
    rows = [(10, base, "en", "a"), (11, base.replace(" ", "\n"), "en", "a"), (12, base + " end", "en", "a"), (13, filler, "en", "b"), (14, None, "en", "b"),
            (15, "123 456", "en", "b"), (13, filler, "en", "b")]
    docs = make_docs(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "SimHash near-dedup", "source mix", "BPE encoding"]
    told = stages["language ID"](spark, docs, None)
    assert told.columns == docs.columns and sorted(r.doc_id for r in told.collect()) == [10, 11, 12, 13, 13]
    exact = stages["exact dedup"](spark, told, None)
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == [10, 12, 13]
    near = stages["SimHash near-dedup"](spark, exact, None)
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == [10, 13]
    mixed = stages["source mix"](spark, near, None)
    assert mixed.columns == docs.columns and all(1 <= r["count"] <= 3 for r in mixed.groupBy("doc_id").count().collect())
    done = stages["BPE encoding"](spark, mixed, None).collect()
    assert len(done) == mixed.count()
    for r in done:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_no_rows(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        assert docs.count() == 0, name


def test_pipeline_equals_a_plain_run(spark):
    """Every stage of the whole run, held against a plain one of its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    told = stages[0](spark, docs, FOLDER).cache()
    letters = {d.doc_id for d in docs.collect() if re.search(r"[^\W\d_]", d.text or "")}
    assert {d.doc_id for d in told.collect()} == letters
    exact = stages[1](spark, told, FOLDER).cache()
    best = {}
    for d in told.collect():
        bare = re.sub(r"[\x20\x09-\x0D]+", "", d.text)
        best[bare] = max(best.get(bare, (0, 0)), (len(d.text), -d.doc_id))
    assert {d.doc_id for d in exact.collect()} == {-i for _, i in best.values()}
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert whole and {r.doc_id for r in whole} <= {d.doc_id for d in exact.collect()}
    text = {d.doc_id: d.text for d in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in whole)


def test_an_input_column_named_like_the_prediction_stays(spark):
    docs = make_docs(spark, [(1, "some words of a text", "en", "a"), (2, "1 2", "en", "a")]).withColumn("__language", F.lit("mine"))
    out = corpus_pipeline.known_language(spark, docs, "")
    assert [(r.doc_id, r["__language"]) for r in out.collect()] == [(1, "mine")]


WITHOUT_PACKAGE = """
import sys, os
sys.path.insert(0, {repo!r})
import __spark_entry__
from pyspark.sql import SparkSession, functions as F
import public_tokenizers
from braggline.llm import bpe, langid, licenses
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, t, t[:2]) for i, t in enumerate(["the mill by the river", "der Fluss und die Mühle"] * 20)], "doc_id long, text string, lang string")
seen = docs.limit(1).mapInPandas(lambda it: (f.assign(text=str(__import__("importlib.util").util.find_spec("braggline"))) for f in it), docs.schema).first().text
assert seen == "None", seen
print("rows", bpe.encode(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).count() + licenses.scan(spark, docs).count()
      + langid.predict(spark, docs, langid.train(docs, F.lit(True))).where("language.lang_pred is not null").count())
"""


def test_workers_do_not_need_the_package(tmp_path):
    """The driver knows the repository by its own path alone; Python workers are started without it."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_PYTHON")}
    env["PYTHONPATH"] = os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and os.path.abspath(x) != repo)
    env["PYSPARK_PYTHON"] = sys.executable
    done = subprocess.run([sys.executable, "-c", WITHOUT_PACKAGE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 80" in done.stdout, done.stderr[-2000:]
