import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggline.llm import collocations, filter_audit, line_dedup
from braggline.llm.common import join_split_hot

from .conftest import LONG, make_docs

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
A = "  This very line stands in many of the documents here.\t"
B = "another line, which is long enough to be a candidate of it"
C = "ÄÖÜ lines of other letters, long enough as well, 你好 🙂 end"

LINE_ROWS = (
    [(i, f"{A}\nown {i}\n{B}", "en", "a") for i in range(1, 7)]
    + [(i, f"{B.upper()}\n\n{A.strip()}\r\n{A}", "de", "b") for i in range(7, 9)]
    + [(8, f"{A}", "de", "b"), (8, f"{A}", "de", "b"), (None, A, "en", None), (None, f"{C}\n{C}", None, None)]
    + [(20 + i, C, "fr", "b") for i in range(4)]
    + [(30, None, None, "a"), (31, "", "en", "a"), (32, "\n\n", "en", "a"), (33, LONG + "\n" + A, "en", "a"), (34, "short\nshort", "en", "a"),
       (35, "short\nshort", "en", "a")])


def lines_by_hand(rows, min_docs=5, min_chars=40):
    def key(line):
        return line.strip(WS).translate(LOWER)
    docs, last = Counter(), {}
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            docs[k] += 1
            last[k] = max(last.get(k, -1), -1 if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key(x)) < min_chars or docs[key(x)] < min_docs or last[key(x)] == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (5, 3)])
def test_repeated_lines_by_hand(spark, batches, fanout):
    got = collected(line_dedup.deduplicate(make_docs(spark, LINE_ROWS), batches=batches, fanout=fanout))
    assert got == lines_by_hand(LINE_ROWS)


def test_line_thresholds_are_parameters(spark):
    got = collected(line_dedup.deduplicate(make_docs(spark, LINE_ROWS), min_docs=2, min_chars=5))
    assert got == lines_by_hand(LINE_ROWS, 2, 5)


def test_lines_of_an_empty_table(no_docs):
    df = line_dedup.deduplicate(no_docs)
    assert df.collect() == [] and df.columns == ["doc_id", "n_lines", "n_dropped", "kept"]


def test_runs_are_levelled_and_keep_the_first_batch(spark):
    store = line_dedup.LineRuns(spark, 3, fanout=2)
    batches = [[("a", 2, 9), ("b", 1, 8)], [("a", 1, 7), ("c", 4, 6)], [("c", 1, 5)], [("d", 1, 4), ("a", 1, 3)], [("d", 2, 2)]]
    seen = []
    for batch in batches:
        df = spark.createDataFrame([(bytes(k, "ascii"), n, last) for k, n, last in batch], "key binary, docs long, last long")
        seen.append(sorted(bytes(r.key).decode() for r in store.unseen(df).collect()))
        store.add(df)
    assert seen == [["a", "b"], ["c"], [], ["d"], []]
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sorted((bytes(r.key).decode(), r.docs, r["last"]) for r in store.entries().collect()) == [("a", 4, 9), ("b", 1, 8), ("c", 5, 6), ("d", 3, 4)]


def test_runs_meet_without_a_shuffle(spark):
    store = line_dedup.LineRuns(spark, 4)
    df = spark.range(100).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.lit(1).cast("long").alias("docs"), F.col("id").alias("last"))
    store.store(df, 0)
    store.store(df.where("last < 50"), 0)
    plan = store.entries()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert store.entries().count() == 100


def phrases_by_hand(rows, max_words=3, min_count=10, percent=50, limit=2000):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        held = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= min_count
                and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= percent * a for b in held):
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items()
                   for i, (s, a, p, left, right) in enumerate(sorted(rows)[:limit])), key=repr)


PHRASES = ["New York city", "new YORK", "the big apple", "big apple", "in the city of new york", "a", "ab c", "the", "你好 世界", "x|y z", "\x0bnew york\x0c"]


def phrase_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        words = [PHRASES[j] + str(rng.choice([" ", "  ", "\t", ". ", "\n", ",", " - "])) for j in rng.zipf(1.5, rng.integers(0, 30)) % len(PHRASES)]
        rows.append((i, "".join(words), [None, "und", "en", "de"][i % 4], "a"))
    return rows + [(240, None, "en", "a"), (241, "", "fr", None), (242, " ,;. ", "fr", None), (3, rows[3][1], None, "a"), (243, "word " * 5000, "xx", "a")]


@pytest.mark.parametrize("options", [{}, {"max_words": 2, "min_count": 3}, {"max_words": 4, "percent": 90, "limit": 5}])
def test_phrases_by_hand(spark, options):
    rows = phrase_rows()
    mine = {{"percent": "cover_percent"}.get(k, k): v for k, v in options.items()}
    got = collected(collocations.mine(make_docs(spark, rows).repartition(5), **mine))
    assert got == phrases_by_hand(rows, **options) and len(got) > 5


@pytest.mark.parametrize("coded", [1, 7, 30])
def test_words_named_by_hash(spark, monkeypatch, coded):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "CODED", coded)
    monkeypatch.setattr(collocations, "HELD_WORDS", 5)
    assert collected(collocations.mine(make_docs(spark, rows), min_count=4)) == phrases_by_hand(rows, min_count=4)


def test_words_of_one_hash_get_numbers(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "CODED", 3)
    monkeypatch.setattr(collocations, "word_hash", lambda: F.length("word").cast("long").bitwiseOR(F.lit(-(1 << 63))))
    words = collocations.word_counts(make_docs(spark, rows))
    ids = collocations.word_ids(words, words.agg(F.sum("f")).first()[0], 4).collect()
    assert len({r.id for r in ids}) == len(ids) == words.where("f >= 4").count()
    by_length = Counter(len(r.word) for r in ids if not r.coded)
    assert max(by_length.values(), default=1) == 1


def test_the_filter_knows_all_hashes(spark):
    ids = spark.range(5000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), "id").alias("word"), F.lit(False).alias("coded")).withColumn("id", collocations.word_hash())
    bits = collocations.hash_bits(ids)
    look = collocations.Lookup("en", {}, bits)
    assert all(look[r.word.encode()] == r.id for r in ids.collect())
    assert int(np.unpackbits(bits).sum()) <= 5000 and sum(look[b"x%d" % i] != 0 for i in range(5000)) < 20


def test_longest_windows_are_counted_once(spark, monkeypatch):
    docs = make_docs(spark, phrase_rows())
    words = collocations.word_counts(docs)
    ids = collocations.word_ids(words, words.agg(F.sum("f")).first()[0], 10)
    plans, original = [], collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, what: (plans.append((what, df)), original(df, what))[1])
    collocations.phrase_counts(collocations.longest_windows(docs, ids, 3), ids, 10)
    df = dict(plans)["phrase-ids"]
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_phrases_of_an_empty_table(no_docs):
    assert collocations.mine(no_docs).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_001
    counts = spark.createDataFrame([("en", 1, "a", big * 2), ("en", 1, "b", big * 3 + 1), ("en", 2, "a b", big), ("en", 1, "c", big * 9)],
                                   "lang string, words int, phrase string, f long")
    (row,) = collocations.scored(counts).collect()
    assert row.score == 1_000_000 * big * big // (big * 2 * (big * 3 + 1)) and row.a == big


def audit_by_hand(rows, labels):
    names = "ABCDE"
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = defaultdict(list)
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [x for x in labels if i is not None and x[0] == i]
        docs[lang or ""].append((fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part, members in docs.items():
        total = Counter()
        lines = []
        for order in itertools.permutations(names):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[0][f]]
                left = [m for m in left if not m[0][f]]
                total[f] += len(gone)
                failing = sum(m[0][f] for m in members)
                alone = sum(m[0][f] and sum(m[0].values()) == 1 for m in members)
                lines.append([part, "".join(order), step, f, len(left), len(gone), failing - len(gone), alone, sum(m[1] for m in gone), sum(m[2] for m in gone)])
        out += [tuple(x) + (total[x[3]],) for x in lines]
    return sorted(out, key=repr)


AUDIT_ROWS = [(1, "word " * 300, "en", "a"), (2, "word " * 300, "en", "a"), (2, "word " * 300, "de", "a"), (None, "word " * 300, "en", "a"),
              (3, None, None, "a"), (4, "", "", "a"), (5, "SHOUT # twice", "en", "a"), (6, " ".join(map(str, range(250))), "en", "b"),
              (7, " ".join(map(str, range(250))), "fr", "b"), (8, LONG, "en", "b"), (9, " \t\n", None, None), (None, "a", "en", "b"), (None, "a", "en", "b")]
AUDIT_LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1)]


def test_audit_by_hand(spark):
    labels = spark.createDataFrame([(*x, "z") for x in AUDIT_LABELS], "doc_id long, quality int, toxic int, part string")
    got = collected(filter_audit.audit_documents(make_docs(spark, AUDIT_ROWS), labels))
    want = audit_by_hand(AUDIT_ROWS, AUDIT_LABELS)
    assert got == want and len(got) == 4 * 600


def test_audit_of_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(no_docs, none).collect() == []
    got = filter_audit.audit_documents(make_docs(spark, AUDIT_ROWS), none).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(got) == (0, 0)


def test_removal_steps_are_a_min_plus_product():
    orders = np.array(list(itertools.permutations(range(4))))
    steps = filter_audit.removal_steps(np.arange(16), orders)
    for m, o in itertools.product(range(16), range(24)):
        want = next((s for s, f in enumerate(orders[o], 1) if m >> f & 1), 5)
        assert steps[m, o] == want


def test_audit_of_other_filters(spark):
    rows = spark.range(20).select("id", (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") > 3, F.col("id") > 9).alias("large"))
    got = filter_audit.audit(rows, {"e": F.col("even"), "l": F.col("large")}, F.lit(None), F.lit(1), F.lit(None))
    by = {(r.filter_order, r.step): r for r in got.collect()}
    assert [(by["el", s].removed, by["el", s].kept, by["el", s].redundant) for s in (1, 2)] == [(10, 10, 0), (5, 5, 5)]
    assert by["le", 2].unique_fails == 5 and by["le", 2].shapley == 15 and by["le", 1].good_lost == 10


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_are_split_off(spark, how):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 5 <> 1")
    got = collected(join_split_hot(rows, facts, "k", "n", 1000, how, parts=10).select("k", "id", "n"))
    assert got == collected(rows.join(facts, "k", how).select("k", "id", "n"))
