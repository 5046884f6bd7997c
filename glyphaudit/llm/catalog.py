"""Queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op2_multi_index_hashing
from .bpe_fst import op6_byte_bpe
from .embedding_dup import op8_embedding_dup
from .hard_negatives import op13_kronecker_negatives
from .html_text import op10_html_blocks
from .language_id import op1_language_ppm
from .lexical import op12_geometric_blocks
from .matrix import op7_matrix_bfd
from .near_dup import op3_near_dup_forest
from .packing import op9_packing_dp
from .quality import op11_nb_support_vectors
from .repeats import op5_suffix_dedup
from .toxicity import op4_toxicity_nnpu


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_ppm, op2_multi_index_hashing, op3_near_dup_forest, op4_toxicity_nnpu, op5_suffix_dedup, op6_byte_bpe, op7_matrix_bfd, op8_embedding_dup, op9_packing_dp,
             op10_html_blocks, op11_nb_support_vectors, op12_geometric_blocks, op13_kronecker_negatives)
    return {f.__name__: f for f in found}


REACH = """reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
 least as (select a, min(b) as b from reach group by a)"""

NEAR_DUP_SQL = f"""with recursive w as (select doc_id, regexp_extract_all(
   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
 s as (select doc_id, unnest(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
   when len(ws) > 0 then [array_to_string(ws, ' ')] end) as sh from w),
 n as (select doc_id, count(*) as n from s group by doc_id),
 pair as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
 link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
 {REACH}
 select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(t.b, d.doc_id)) as component_id,
   d.doc_id <= coalesce(t.b, d.doc_id) as kept from documents d left join n using (doc_id) left join least t on t.a = d.doc_id"""

EMBEDDING_DUP_SQL = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings
   where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u as (select vec_id, e, sqrt(list_inner_product(e, e)) as size from v),
 link as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and list_inner_product(x.e, y.e) >= 0.95 * x.size * y.size),
 {REACH}, n as (select a, count(*) as n from link group by a)
 select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(t.b, e.vec_id)) as component_id, e.vec_id <= coalesce(t.b, e.vec_id) as kept
 from embeddings e left join n on n.a = e.vec_id left join least t on t.a = e.vec_id"""


WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_SQL = f"""with d as (select row_number() over () as r, doc_id, {WORDS} as ws from documents where text is not null),
 s as (select count(*) as docs, sum(len(ws))::bigint as words from d where len(ws) > 0),
 q as (select item_id, text, w, count(*) as q from (select item_id, text, unnest({WORDS}) as w from (select distinct item_id, text from benchmark)) group by all),
 t as (select r, doc_id, n, w, count(*) as tf from (select r, doc_id, len(ws) as n, unnest(ws) as w from d) where w in (select w from q) group by all),
 f as (select w, count(*) as df from t group by w),
 p as (select r, doc_id, w, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words))) as share from t, s),
 x as (select item_id, text, r, doc_id, sum(q * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint * share)::bigint as score
   from q join p using (w) join f using (w), s group by all)
 select item_id, row_number() over (partition by item_id, text order by score desc, doc_id, r) as rank, doc_id, score from x where score > 0 qualify rank <= 10"""

NEGATIVES_SQL = """with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
   list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where vec_id is not null and label is not null
   and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as own, list_inner_product(a.e, b.e)::bigint as score
   from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from s where own
   qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
 select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank,
   vec_id as negative_id, positive_score, score as negative_score
 from p join s on s.anchor_id = p.anchor_id and not own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
 qualify rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dup_forest": NEAR_DUP_SQL, "op8_embedding_dup": EMBEDDING_DUP_SQL, "op12_geometric_blocks": SEARCH_SQL,
            "op13_kronecker_negatives": NEGATIVES_SQL}
