"""The registered queries of this subpackage; each binds one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (bpe, collocations, embedding_dedup, exact_dedup, filter_audit, langid, licenses, line_dedup, mixing, sharding, simhash, toxicity,
               warc)
from .common import table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_mixing", r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  (('0x' || substr(md5(concat_ws(':', 'mix', doc_id::varchar)), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as spot from documents),
s as (select source, sum(size)::bigint as source_size, ([5::double, 2::double, 1::double])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from d group by source),
f as (select *, source_size * 3 as cap, coalesce(sum(source_size * 3) over (order by source_size * 3 / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as caps,
  sum(weight) over (order by source_size * 3 / weight, source nulls last rows between current row and unbounded following) as rest, sum(source_size) over () as total from s),
l as (select max((total - caps) / rest) as level from f),
t as (select source, source_size, case when source_size > 0 then least(level * weight, cap::double) else 0::double end as target from f, l),
w as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
c as (select d.*, w.source_size, w.target, w.whole, sum(size) over (partition by d.source order by spot, doc_id, size rows unbounded preceding) as until from d join w on d.source is not distinct from w.source)
select doc_id, size, source_size, target, ((whole + case when until - size / 2.0::double <= target - whole * source_size and target - whole * source_size > 0 then 1 else 0 end) * size)::bigint as taken from c""")
def op1(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_nbsvm")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), ~toxicity.held_out())
    return toxicity.score(spark, docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op3_cuckoo_dedup", r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, length(t) as len, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as sha from d),
k as (select *, first_value(doc_id) over (partition by sha order by len desc, doc_id) as keep_id, count(*) over (partition by sha) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha as text_sha256 from k""")
def op3(spark, folder):
    return exact_dedup.deduplicate(table(spark, folder, "documents"))


@query("op4_simhash")
def op4(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_grid_join", """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95::double),
reach(node, root) as (select vec_id, vec_id from embeddings union select r.node, l.b from reach r join l on l.a = r.root),
c as (select node, min(root) as component_id from reach group by 1), n as (select a, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings e join c on c.node = e.vec_id left join n on n.a = e.vec_id""")
def op5(spark, folder):
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op6_license_scan")
def op6(spark, folder):
    return licenses.scan(spark, table(spark, folder, "documents"))


def steps_sql(root, name, key):
    """The descent of ``sharding.assign`` in SQL: one step per level, the children of all nodes as a table."""
    nodes, kids, depth = sharding.levels(root)
    rows = ", ".join(f"({n}, {c}, '{nodes[c].name}', {float(nodes[c].weight)}::double)" for n, below in enumerate(kids) for c in (below or [n]))
    out = f", {name}_kids(parent, node, kid, weight) as (values {rows}), {name}_0 as (select doc_id, 0 as node from d)"
    for i in range(depth):
        draw = (f"-ln((('0x' || substr(md5('shard:' || kid || ':' || {key}), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double) / weight")
        out += (f", {name}_{i + 1} as (select p.doc_id, arg_min(k.node, row({draw}, k.node)) as node "
                f"from {name}_{i} p join {name}_kids k on k.parent = p.node group by 1)")
    shards = ", ".join(f"({i}, {n.shard})" for i, n in enumerate(nodes) if n.shard is not None)
    return out + f", {name}_leaf(node, shard) as (values {shards}), {name} as (select p.doc_id, l.shard from {name}_{depth} p join {name}_leaf l on l.node = p.node)"


# CRC-32 as a fold over the bytes with its table of 256 entries, which SQL makes from the polynomial.
CRC_SQL = """
with tab as (select list_transform(range(256), lambda n: list_reduce(list_concat([n::bigint], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t),
h as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 8 as size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as bytes from documents),
d as (select doc_id, size, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(bytes, lambda b: ('0x' || b)::bigint)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) as text_crc32 from h, tab)"""


@query("op7_shard_tree", CRC_SQL + steps_sql(sharding.tree(24), "old", "doc_id") + steps_sql(sharding.tree(24, added=1), "new", "doc_id") + """
select d.doc_id, size, text_crc32, 'key' as law, old.shard, new.shard as grown_shard,
  row_number() over (partition by old.shard order by ('0x' || substr(md5('slot:' || d.doc_id), 1, 13))::bigint, d.doc_id, size, text_crc32) - 1 as slot
from d join old on old.doc_id = d.doc_id join new on new.doc_id = d.doc_id""")
def op7(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"), 24)


@query("op8_language_codes")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    found = langid.predict(spark, docs.select("doc_id", "text"), langid.train(docs, ~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


@query("op9_warc", r"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as sha from p),
b as (select *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda c:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + 5 * g::int, 5))::bigint >> (15 - 5 * c)::int) & 31)::int, 1)), '')), '') as payload_digest,
  min(page_id) over (partition by sha) as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from b""")
def op9(spark, folder):
    done = warc.every_row(warc.round_trip(spark, table(spark, folder, "pages")))
    return done.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("original.page_id").alias("refers_to"))


@query("op10_bpe")
def op10(spark, folder):
    done = bpe.encode(spark, table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_text=True)
    return done.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_collocations", r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, m as words, array_to_string(w[i:i + m - 1], ' ') as phrase from w, range(1, 4) t(m), lateral (select unnest(range(1, len(w) - m + 2)) as i)),
f as (select lang, words, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where words = 1 group by 1),
c as (select *, string_split(phrase, ' ') as w from f where words > 1 and f >= 10),
k as (select lang, phrase, words, f as a, k, array_to_string(w[1:k], ' ') as lp, array_to_string(w[k + 1:], ' ') as rp from c, range(1, 3) t(k) where k < words),
s as (select k.*, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score from k
  join f x on x.lang = k.lang and x.phrase = k.lp join f y on y.lang = k.lang and y.phrase = k.rp),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
h as (select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(f) as cover from c, range(1, 3) t(i) where words = 3 group by all),
z as (select b.* from b left join h on h.lang = b.lang and h.phrase = b.phrase and b.words = 2 where h.cover is null or 100 * h.cover < 50 * a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select r.lang, rank, phrase, a, l, r.r, n, score::bigint as score from r join n on n.lang = r.lang where rank <= 2000""")
def op11(spark, folder):
    return collocations.mine(table(spark, folder, "documents"))


@query("op12_line_dedup", r"""
with d as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select row, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from d),
k as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, count(distinct row) as docs, max(doc_id) as last from k where length(key) >= 40 group by 1),
g as (select k.*, coalesce(f.docs >= 5 and f.last is distinct from k.doc_id, false) as gone from k left join f on f.key = k.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from g group by row, doc_id""")
def op12(spark, folder):
    return line_dedup.deduplicate(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_filter_audit", r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
m as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails from w),
y as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
g as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join y using (doc_id) group by 1, 2),
x as (select unnest(range(1, 6)) as f),
o as (select [a.f, b.f, c.f, d.f, e.f] as o from x a, x b, x c, x d, x e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
r as (select g.*, o, list_min(list_filter([case when fails[o[i]] then i end for i in range(1, 6)], lambda v: v is not null)) as gone from g, o),
q as (select part, o, s as step, sum(n) filter (gone is null or gone > s) as kept, sum(n) filter (gone = s) as removed, sum(n) filter (fails[o[s]] and gone < s) as redundant,
  sum(n) filter (fails[o[s]] and len(list_filter(fails, lambda v: v)) = 1) as unique_fails, sum(good) filter (gone = s) as good_lost, sum(toxic) filter (gone = s) as toxic_lost
  from r, range(1, 6) t(s) group by 1, 2, 3)
select part, array_to_string(list_transform(o, lambda v: substr('ABCDE', v::int, 1)), '') as filter_order, step::int as step, substr('ABCDE', o[step]::int, 1) as filter,
  coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, o[step]), 0)::bigint as shapley from q""")
def op13(spark, folder):
    return filter_audit.audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
