"""DuckDB statements for the operators that SQL can express.

Byte-pair encoding, SimHash's hash function (line dedup needs it, too), trained models and
hundreds of licence patterns are beyond it; those operators are held against plain versions in the tests.
"""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')"

OP4 = f"""
with words as (select doc_id, {_WORDS} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 11)) as s from words where len(w) >= 13),
windows as (select doc_id, s, array_to_string(w[s : s + 12], ' ') as body from starts),
earliest as (select body, min(doc_id) as least from windows group by body),
gone as (select distinct doc_id, unnest(range(s, s + 13)) as i from windows join earliest using (body) where doc_id > least),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words)
select doc_id, any_value(len(w)) as n_words, count(g.i) as n_removed,
    sha256(coalesce(string_agg(word, ' ' order by e.i) filter (g.i is null), '')) as kept_sha256
from words left join each e using (doc_id) left join gone g using (doc_id, i) group by doc_id
"""

_FINE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

OP5 = f"""
with recursive fine as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and {_FINE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as node, vec_id as low from embeddings union select l.b, r.low from reach r join links l on l.a = r.node where r.low < l.b),
found as (select node, min(low) as low from reach group by node)
select vec_id, (select count(*) from links where a = vec_id) as n_links, low as component_id, vec_id = low as kept from embeddings join found on node = vec_id
"""

OP6 = f"""
with fine as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings where {_FINE}),
each as (select vec_id, unnest(e) as x, unnest(range(len(e))) as i from fine),
scores as (select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score from each q join each c using (i) where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id group by all)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scores) where rank <= 5
"""

ORACLES = {"op4_substring_dedup": OP4, "op5_embedding_near_dedup": OP5, "op6_exact_top_k": OP6}
