import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braggline.llm import bpe, common, sharding
from braggline.llm.queries import QUERIES

from .conftest import ODD_ROWS

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.load_codec(PATH)


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


def test_encoding_equals_the_library(library, codec):
    random.seed(3)
    parts = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", "a", "word", "THE", "12", "é", "ß", "你", "　", "\xa0", "\x85", " ", "!", "!!",
             "'!", "🙂", "<|endoftext|>", "<|", "_", "\x1c", " ", "-", "--", "x" * 70, "=#=", "²", "½", "̀", "ل", "Ĳ", "\x00", "ab" * 60]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(20_000)]
    texts += ["".join(chr(random.choice([random.randrange(32, 0x250), random.randrange(0x250, 0xd800), random.randrange(0x10000, 0x1fa00), 32]))
                      for _ in range(random.randint(0, 20))) for _ in range(10_000)]
    texts += ["", "a" * 50_000 + "=" * 20_000 + "ab" * 20_000, " " * 5000 + "x"]
    want = [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = codec.encode(texts)
    assert [t for t, a, b in zip(texts, want, got) if a != b] == []
    back = library.decode_batch([np.frombuffer(g, "<u4").tolist() for g in got], skip_special_tokens=False)
    assert [codec.decode(g) for g in got] == back == texts


def test_forgetting_changes_nothing(codec, monkeypatch):
    texts = [f"some words {i} and others" for i in range(50)]
    want = codec.encode(texts)
    monkeypatch.setattr(bpe, "MEMORY", 3)
    assert [codec.encode([t])[0] for t in texts] == want


def test_decoding_broken_characters(library, codec):
    ids = [i for i, b in codec.tokens.items() if len(b) == 1 and b[0] > 127][:20]
    assert codec.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_certain_cuts_never_lie_in_a_token(codec):
    free, safe = codec.cuts
    assert safe.sum() > 10_000 and not (safe & ~free).any()
    assert not any(free[a * 256 + b] for t in list(codec.tokens.values())[:5000] if t != b"<|endoftext|>" for a, b in zip(t, t[1:]))


def test_unsupported_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec({"model": {"type": "WordPiece"}, "pre_tokenizer": {"type": "ByteLevel"}})


def test_documents_are_encoded_whole(spark, odd_docs, no_docs, library):
    done = bpe.encode(spark, odd_docs, PATH, with_text=True)
    rows = sorted(((r.doc_id or 0, r.ids, r.decoded) for r in done.collect()), key=repr)
    want = sorted(((i or 0, packed(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in ODD_ROWS), key=repr)
    assert [(a, bytes(b), c) for a, b, c in rows] == want
    assert sorted(r.decoded for r in bpe.decode(spark, done, PATH).collect()) == sorted(t or "" for _, t, *_ in ODD_ROWS)
    assert bpe.encode(spark, no_docs, PATH).count() == 0


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d.doc_id] = (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op10_bpe"](spark, FOLDER).collect()} == want


def brute_shard(node, key):
    while node.shard is None:
        def draw(c):
            h = int(hashlib.md5(f"shard:{c.name}:{key}".encode()).hexdigest()[:13], 16)
            return -np.log((h + 0.5) / 2.0 ** 52) / c.weight
        node = min(node.children, key=draw)
    return node.shard


def test_shards_equal_a_plain_descent(spark):
    rows = QUERIES["op7_shard_tree"](spark, FOLDER).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    old, new = sharding.tree(24), sharding.tree(24, added=1)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (brute_shard(old, r.doc_id), brute_shard(new, r.doc_id))
        assert r.grown_shard in (r.shard, 24)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shares_follow_the_weights(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    placed = sharding.assign(ids, "doc_id", sharding.tree(8, racks=2, shards=2, weights={0: 3.0, 5: 0.0}))
    n = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert 5 not in n and abs(n[0] / n[1] - 3) < 0.25 and all(abs(n[i] * 9 / 40_000 - 1) < 0.1 for i in (1, 2, 3, 4, 6, 7))


def test_changed_weights_move_keys_only_in_their_subtree(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = sharding.tree(12, racks=2, shards=3)
    kids = list(before.children)
    rack = kids[0].children[0]
    lighter = sharding.parent(rack.name, [sharding.Node("s0", 0.5, (), 0), *rack.children[1:]])
    after = sharding.parent("root", [sharding.parent(kids[0].name, [lighter, kids[0].children[1]]), *kids[1:]])
    both = sharding.assign(sharding.assign(ids, "doc_id", before, "a"), "doc_id", after, "b").where("a != b").collect()
    assert both and all(r.a in range(6) for r in both)  # only the region that grew lighter loses or reshuffles keys


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 3).collect()
    assert len(rows) == len(ODD_ROWS)
    assert len({(r.shard, r.grown_shard) for r in rows if r.doc_id == 7}) == 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(3) for i in range(sum(r.shard == s for r in rows))]
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {8}
    assert sharding.shard_documents(no_docs).count() == 0


def test_slots_are_gapless_in_many_pieces(spark):
    rows = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as shard", "1 as size")
    out = sharding.slots(rows, "shard", "doc_id", piece_rows=20).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in (0, 1) for i in range(250)]
    assert sorted(map(tuple, out)) == sorted(map(tuple, sharding.slots(rows, "shard", "doc_id").collect()))


def test_slots_of_repeated_and_missing_ids(spark):
    rows = [(None, i % 4) for i in range(60)] + [(7, 1)] * 50 + [(i, 2) for i in range(40)]
    frame = spark.createDataFrame([(k, n, 3, "x") for k, n in rows], "doc_id long, size long, shard int, __spot string")
    out = sharding.slots(frame, "shard", "doc_id", piece_rows=10)
    assert out.columns == frame.columns + ["slot"]
    got = out.collect()
    assert sorted(r.slot for r in got) == list(range(150)) and sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((k or -1, n) for k, n in rows)


def test_rows_of_one_id_do_not_meet_in_a_piece(spark):
    from braggline.llm.common import sums_before
    rows = spark.range(3000).select(F.lit(1).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id", F.lit(2).cast("long").alias("n"))
    out = sums_before(rows, "g", ["k", "id"], "n", "before", 100).cache()
    assert [r.before for r in out.orderBy(F.asc_nulls_first("k"), "id").collect()] == list(range(0, 6000, 2))
    seen = {}
    original = common.written
    try:
        common.written = lambda df, what: seen.setdefault(what, original(df, what))
        sums_before(rows, "g", ["k", "id"], "n", "before", 100)
    finally:
        common.written = original
    assert max(r["count"] for r in seen["pieces"].groupBy("__piece").count().collect()) < 400


def test_clashing_names_stay(spark):
    frame = spark.createDataFrame([(1, "a b", "k", "n")], "doc_id long, __text string, __key string, __node string").withColumnRenamed("__text", "text")
    placed = sharding.assign(frame, "doc_id", sharding.tree(4))
    assert placed.columns == [*frame.columns, "shard"] and placed.first()["__key"] == "k"
    other = frame.withColumn("__text", F.lit("mine"))
    assert bpe.encode(spark, other, PATH, keep=("doc_id", "__text")).first()["__text"] == "mine"
