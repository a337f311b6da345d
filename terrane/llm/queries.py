"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, manifest, prefix_trie
from .cleaning import op13_quality_rules
from .decontamination import op4_decontamination
from .embeddings import op5_embedding_dedup
from .langid import op6_language_id
from .manifest import op12_merkle_manifest
from .maxent import op10_lm_scoring
from .minhash import op9_minhash_dedup
from .packing import op7_packing
from .prefix_trie import op11_prefix_trie
from .quality import op1_quality
from .secrets import op8_secret_scan
from .substrings import op2_suffix_dedup
from .toxicity import op3_toxicity

#: All 400-byte strings, as 800 hexadecimal digits, at every place of every document.
_SUBSTRINGS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h, row_number() over () k from documents), n as (select doc_id, k, h, length(h)//2 n from d),
c as (select k, n, c, substr(h, 8192*c + 1, 8192 + 798) part from n, unnest(range(0, (n - 400)//4096 + 1)) t(c) where n >= 400),
w as (select k, 4096*c + j i, hash(substr(part, 2*j + 1, 800)) s from c, unnest(range(0, least(4096, n - 399 - 4096*c))) u(j)), twice as (select s from w group by s having count(*) > 1),
hit as (select k, i from w semi join twice using (s)),
runs as (select k, i, case when i <= lag(i) over (partition by k order by i) + 400 then 0 else 1 end fresh from hit),
numbered as (select k, i, sum(fresh) over (partition by k order by i) r from runs), spans as (select k, r, min(i) a, max(i) + 400 b from numbered group by k, r),
edges as (select k, a, b, coalesce(lag(b) over (partition by k order by a), 0) e from spans),
kept as (select edges.k, string_agg(substr(h, 2*e + 1, 2*(a - e)), '' order by a) || max(substr(h, 2*(select max(b) from spans s where s.k = edges.k) + 1)) h, sum(b - a) gone, count(*) spans from edges join n on n.k = edges.k group by edges.k)
select n.doc_id, n.n n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(kept.h, n.h))) kept_sha256 from n left join kept on kept.k = n.k"""
#: All pairs of one label, and what they reach.
_EMBEDDINGS = """with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select *, sqrt(list_sum(list_transform(e, lambda x: x*x))) n from v), p as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and len(a.e) = len(b.e) where list_dot_product(a.e, b.e)/(a.n*b.n) >= 0.93e0),
reach as (select vec_id id, vec_id c from embeddings union select p.b, r.c from reach r join p on p.a = r.id), least as (select id, min(c) c from reach group by id), k as (select a, count(*) n from p group by a)
select e.vec_id, coalesce(k.n, 0) n_links, l.c component_id, e.vec_id = l.c kept from embeddings e left join k on k.a = e.vec_id join least l on l.id = e.vec_id"""
#: Sets of two-word shingles, shared ones counted for all pairs that share any.
_SHINGLES = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) x from w), n as (select doc_id, count(*) n from s group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) both_ from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
p as (select a, b from shared join n on n.doc_id = a join n m on m.doc_id = b where 100*both_ >= 80*(n.n + m.n - both_)), e as (select a, b from p union all select b, a from p),
reach as (select doc_id id, doc_id c from documents union select e.b, r.c from reach r join e on e.a = r.id), least as (select id, min(c) c from reach group by id)
select d.doc_id, coalesce(n.n, 0) n_shingles, l.c component_id, d.doc_id = l.c kept from documents d left join n on n.doc_id = d.doc_id join least l on l.id = d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_suffix_dedup, op3_toxicity, op4_decontamination, op5_embedding_dedup, op6_language_id, op7_packing, op8_secret_scan, op9_minhash_dedup, op10_lm_scoring, op11_prefix_trie, op12_merkle_manifest, op13_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": _SUBSTRINGS, "op5_embedding_dedup": _EMBEDDINGS, "op9_minhash_dedup": _SHINGLES, "op11_prefix_trie": prefix_trie.SQL, "op12_merkle_manifest": manifest.SQL, "op13_quality_rules": cleaning.SQL}
