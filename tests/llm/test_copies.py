import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from braggline.llm import embedding_dedup, exact_dedup, simhash
from braggline.llm.queries import QUERIES

from .conftest import ODD_ROWS, make_docs

FOLDER = "/root/testdata/sf0.001"


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# exact copies ---------------------------------------------------------------------

def test_filter_inserts_deletes_and_grows():
    random.seed(5)
    index, live = exact_dedup.CuckooIndex(1), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(6000)]
    for step in range(20_000):
        k = random.choice(keys)
        if k in live and random.random() < 0.5:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            assert index.get(k) is None
            index.insert(k, [step])
            live[k] = [step]
    assert index.resizes > 3 and index.size == len(live) == len(dict(index.items()))
    assert all(index.get(k) == live.get(k) for k in keys)
    assert not index.delete(b"\0" * 32)


def test_hits_of_the_filter_are_verified():
    index = exact_dedup.CuckooIndex(4)
    a = bytes(range(32))
    b = a[:18] + bytes(14)  # same fingerprint and buckets, other content
    index.insert(a, ["a"])
    assert index.maybe(b) and index.get(b) is None
    index.insert(b, ["b"])
    assert index.delete(a) and index.get(b) == ["b"] and index.get(a) is None


def test_copies_crowd_one_pair_of_buckets():
    index = exact_dedup.CuckooIndex(2)
    keys = [bytes([1] * 8) + i.to_bytes(4, "little") * 6 for i in range(300)]
    for k in keys:
        index.insert(k, [k])
    assert all(index.get(k) == [k] for k in keys)


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((i, len(t or "")))
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(i, best, len(members), i == best, hashlib.sha256(bare.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def test_exact_labels_of_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r) for r in exact_dedup.deduplicate(odd_docs).collect()), key=repr)
    assert got == brute_exact(ODD_ROWS)
    assert exact_dedup.deduplicate(no_docs).count() == 0


def test_exact_keeps_one_document_of_each_text(odd_docs, no_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t, *_ in ODD_ROWS})
    assert exact_dedup.keep_first(no_docs).count() == 0


def test_exact_copies_are_decided_by_row(spark):
    """A third of the rows without id and one id with many texts: every distinct text stays once."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i // 2 * 2}" + " " * (i % 2), "en", "a") for i in range(30)]
    rows += [(100, "own", "en", "a"), (100, "text 0", "en", "a"), (100, "own  ", "en", "a"), (None, "text 4", "en", "a"), (None, "text  4", "en", "a")]
    kept = exact_dedup.keep_first(make_docs(spark, rows)).collect()
    texts = [r.text.replace(" ", "") for r in kept]
    assert len(texts) == len(set(texts)) and set(texts) == {t.replace(" ", "") for _, t, *_ in rows}
    longest = {}
    for _, t, *_ in rows:
        longest[t.replace(" ", "")] = max(longest.get(t.replace(" ", ""), 0), len(t))
    assert all(len(r.text) == longest[r.text.replace(" ", "")] for r in kept)


def test_index_is_carried_on(spark):
    first = exact_dedup.digests(make_docs(spark, [(i, f"text {i % 4}", None, None) for i in range(10)]))
    more = exact_dedup.digests(make_docs(spark, [(i, f"text {i % 6}", None, None) for i in range(10, 20)]))
    index = exact_dedup.build_index(first, shard_digests=2)
    both = exact_dedup.insert_rows(index, more, shard_digests=2)
    assert sorted((r.doc_id, r.n) for r in both.collect()) == [(0, 4), (1, 4), (2, 5), (3, 4), (10, 2), (11, 1)] or sum(r.n for r in both.collect()) == 20
    gone = more.where("doc_id < 12").select("digest")
    left = exact_dedup.delete_rows(both, gone)
    assert left.count() == both.count() - gone.distinct().count()
    assert left.join(gone, "digest").count() == 0


# SimHash --------------------------------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(a, b, radius=2):
    return (a ^ b).bit_count() <= radius


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    prints = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    ids = sorted(prints)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(prints[a], prints[b])])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_simhash_of_odd_rows(odd_docs, no_docs):
    got = {}
    for r in simhash.near_duplicates(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert {k: {f for f, _ in v} for k, v in got.items()} == {i: {f"{brute_fingerprint(t):016x}"} for i, t, *_ in ODD_ROWS if i != 5} | {5: {got[5][0][0]}}
    assert got[1] == got[2] and got[None][0][1] == 1 and len(got[7]) == 2
    assert got[3] == got[4] == got[6] == [("0" * 16, 3)]
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9]


def edited(rng, words, changes):
    words = list(words)
    for i in rng.choice(len(words), changes, replace=False):
        words[i] = f"new{rng.integers(1 << 40)}"
    return words


def shingled(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_copies_at_the_threshold_are_found(spark):
    """Copies of Jaccard similarity 0.8 and more go, those below stay; the 2 bits of the op4 query would keep most."""
    rng = np.random.default_rng(4)
    texts = []
    for n, changes in ((400, 4), (400, 6), (400, 8), (2000, 20), (2000, 40), (100, 1), (100, 2), (9, 0), (400, 12), (100, 4)):
        for _ in range(8):
            base = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
            texts += [" ".join(base), " ".join(edited(rng, base, changes)) if changes else " ".join(base[:-1])]
    texts += ["", None, "a b c d e f g h", "a b c d e f g h i"]
    want = roots(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (x := shingled(texts[a])) == (y := shingled(texts[b]))
                                     or x and y and len(x & y) >= 0.8 * len(x | y)])
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == {i for i, r in want.items() if i == r}


def test_groups_of_candidates_in_pieces(spark):
    """A chain whose ends differ, cut into many pieces of a few texts: every link is verified somewhere."""
    rng = np.random.default_rng(5)
    texts = [[f"w{i}" for i in range(200)]]
    for _ in range(30):
        texts.append(edited(rng, texts[-1], 2))
    texts = [" ".join(t) for t in texts]
    want = roots(range(31), [(a, b) for a in range(31) for b in range(a) if len(shingled(texts[a]) & shingled(texts[b])) >= 0.8 * len(shingled(texts[a]) | shingled(texts[b]))])
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    rows = simhash.sketches(docs, "doc_id", "text", 5)
    distinct = rows.groupBy("grams").agg(F.min(F.struct("doc_id", "mark")).alias("first"), *[F.first(c).alias(c) for c in ("shingles", *simhash.SKETCH)]).cache()
    name = {bytes(r["grams"]): r["first"]["doc_id"] for r in distinct.collect()}
    links = simhash.verified_links(docs, distinct, "text", 5, 0.8, piece=900).collect()
    assert roots(range(31), [(name[bytes(r.a)], name[bytes(r.b)]) for r in links]) == want


def test_near_copies_are_decided_by_row(spark):
    """Rows without id, and two texts of one id, are documents of their own unless their texts are near."""
    words = [[f"v{i}x{j}" for j in range(60)] for i in range(4)]
    rows = [(None, " ".join(words[0]), "en", "a"), (None, " ".join(words[1]), "en", "a"), (None, " ".join(words[1]) + " end", "en", "a"), (5, " ".join(words[2]), "en", "a"),
            (5, " ".join(words[3]), "en", "a"), (5, " ".join(words[3]) + " end", "en", "a"), (4, " ".join(words[2]) + " end", "en", "a"), (5, " ".join(words[3]), "en", "a")]
    kept = simhash.keep_first(make_docs(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.text.split()[0]) for r in kept) == [(False, "v2x0"), (False, "v3x0"), (True, "v0x0"), (True, "v1x0")]
    assert [r.doc_id for r in kept if r.text.startswith("v2x0")] == [4]


@pytest.mark.parametrize("tile", [8192, 5])
def test_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(0)
    prints = set()
    for b in rng.integers(-2 ** 63, 2 ** 63 - 1, 60).tolist():
        prints.add(b)
        for _ in range(6):  # a chain of one- and two-bit steps
            for _ in range(int(rng.integers(1, 3))):
                b = int(np.int64(b) ^ (np.int64(1) << np.int64(rng.integers(0, 64))))
            prints.add(b)
    prints |= {0, -1, 1, 3, 7, -2}
    found = simhash.connected_components(simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), 2, tile))
    got = {p: p for p in prints} | {r.node: r.component for r in found.collect()}
    mask = 2 ** 64 - 1
    ids = sorted(prints)
    assert got == roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if ((a ^ b) & mask).bit_count() <= 2])


# embeddings -----------------------------------------------------------------------

def brute_vectors(rows, threshold=0.95):
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    width = max(len(v) for _, v in good)
    m = np.array([list(v) + [0.0] * (width - len(v)) for _, v in good], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = [(a, b) for a, b in zip(*np.nonzero(m @ m.T >= threshold)) if a != b]
    ids = [i for i, _ in good]
    root = roots(ids, [(ids[a], ids[b]) for a, b in links])
    out = {i: (0, i, True) for i, _ in rows if i is not None}
    for k, i in enumerate(ids):
        out[i] = (sum(a == k for a, _ in links), root[i], root[i] == i)
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_grid_join_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + rng.normal(size=12) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 12), (402, [float("nan")] + [1.0] * 11), (403, [None] + [1.0] * 11), (404, [float("inf")] + [1.0] * 11),
             (405, rows[0][1]), (406, [x * 7 for x in rows[0][1]]), (407, rows[1][1][:11]), (408, []), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1, "p", 3) for i, v in rows], "vec_id bigint, embedding array<float>, label int, p string, n int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = embedding_dedup.near_duplicates(frame, block=block).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute_vectors(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_grid_join_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_grid_join_query(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op5_grid_join"](spark, FOLDER).select(F.col("*")).collect()}
    assert got == brute_vectors(rows)
