"""DuckDB SQL that yields the rows of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = r"""
with recursive l as (select doc_id, coalesce(text, '') text, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) no from documents),
ink as materialized (select *, row_number() over (partition by doc_id order by no) k, lead(line) over (partition by doc_id order by no) nxt, lead(no) over (partition by doc_id order by no) nxt_no from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
first as (select line, nxt, min(struct_pack(d := doc_id, k := k)) f from ink where nxt is not null group by all),
alone as (select line, min(struct_pack(d := doc_id, k := k)) f from ink where len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 50 group by all),
hit as (select ink.doc_id, ink.k from ink join first using (line, nxt) where doc_id > f.d or (doc_id = f.d and k >= f.k + 2)),
one as (select ink.doc_id, ink.k from ink join alone using (line) where doc_id > f.d or (doc_id = f.d and k > f.k)),
gone as (select doc_id, k from hit union select doc_id, k + 1 from hit union select doc_id, k from one),
ids as materialized (select doc_id, k, dense_rank() over (order by line) c from ink),
runs as (select doc_id, k, c g, 1 n from (select *, count(*) over (partition by c) m from ids) where m > 1
  union all select doc_id, k, g, n from (select *, count(*) over (partition by g) m from (select r.doc_id, r.k, r.n + 1 n, dense_rank() over (order by r.g, i.c) g from runs r join ids i on i.doc_id = r.doc_id and i.k = r.k + r.n)) where m > 1),
longest as (select doc_id, max(n) n from runs group by 1),
cut as (select ink.doc_id, ink.no a, coalesce(ink.nxt_no, 1000000000) b from ink join gone using (doc_id, k)),
left_over as (select doc_id, string_agg(line, chr(10) order by no) text from l where not exists (select 1 from cut where cut.doc_id = l.doc_id and l.no >= a and l.no < b) group by doc_id)
select d.doc_id, (select count(*) from ink where ink.doc_id = d.doc_id)::bigint n_lines, (select count(*) from gone where gone.doc_id = d.doc_id)::bigint n_removed_lines,
       coalesce(longest.n, 0)::bigint longest_run, sha256(coalesce(o.text, '')) kept_sha256
from documents d left join left_over o using (doc_id) left join longest using (doc_id)
"""

NEAREST = """
with p as (select q.vec_id query_id, x.vec_id, list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (x.embedding[i] > 0))::int))::int distance
           from embeddings q join embeddings x on q.vec_id <> x.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) rank from p)
select query_id, vec_id, distance, rank::int rank from r where rank <= 10
"""

JACCARD = f"""
with recursive w as (select doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i+4], ' ')) h from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
e as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y using (h) where x.doc_id <> y.doc_id group by all),
links as (select a, b from e join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * c >= 75 * (na.n + nb.n - c)),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, links.b from reach join links on reach.r = links.a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, (select min(r) from reach where reach.doc_id = d.doc_id) component_id from documents d left join n using (doc_id)
"""

WINDOWS = f"""
with w as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} w from documents),
k as (select doc_id, i, md5(array_to_string(w[i:i+49], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) i from w where len(w) >= 50)),
f as (select h, min(doc_id) d from k group by 1),
c as (select k.doc_id, k.i from k join f using (h) where f.d < k.doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) j from c),
flat as (select doc_id, unnest(w) word, generate_subscripts(w, 1) j from w),
kept as (select doc_id, string_agg(word, ' ' order by j) t from flat anti join gone using (doc_id, j) group by 1)
select w.doc_id, len(w.w)::bigint n_words, (select count(*) from gone where gone.doc_id = w.doc_id)::bigint n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from w left join kept using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINES,
    "op5_multi_index_topk": NEAREST,
    "op8_parity_sketch_join": JACCARD,
    "op9_count_min_substrings": WINDOWS,
}
