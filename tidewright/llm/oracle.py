"""DuckDB SQL for the operators that SQL can express on whole tables."""

#: Windows by their words themselves; the first occurrence of each is by (doc_id, start), a null id last.
SUBSTRING_DEDUP = r"""
with words as (
  select coalesce(doc_id, 9223372036854775807) as id, unnest(w) as word, generate_subscripts(w, 1) as i
  from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents)
), windows as (
  select id, i, list(word) over (partition by id order by i rows between current row and 19 following) as g from words
), later as (
  select id, i, row_number() over (partition by g order by id, i) > 1 as again from windows where len(g) = 20
), marked as (
  select id, i, word, coalesce(bool_or(again) over (partition by id order by i rows between 19 preceding and current row), false) as gone
  from words left join later using (id, i)
), runs as (
  select *, gone and not coalesce(lag(gone) over (partition by id order by i), false) as opens from marked
), counted as (
  select id, count(*) as n_words, count_if(gone) as n_removed, count_if(opens) as n_spans, string_agg(word, ' ' order by i) filter (not gone) as kept
  from runs group by id
)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256,
  coalesce(n_spans, 0)::bigint as n_spans
from documents left join counted on coalesce(doc_id, 9223372036854775807) = id
"""

#: The order of the rules changes no verdict, so the cascade is one condition here.
QUALITY_RULES = r"""
with texts as (
  select row_number() over () as row, doc_id, coalesce(text, '') as t from documents
), split as (
  select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts
), words as (
  select row, unnest(w) as word, generate_subscripts(w, 1) as i from split
), windows as (
  select row, i, list(word) over (partition by row order by i rows between current row and 4 following) as g from words
), twice as (
  select row, i, count(*) over (partition by row, g) > 1 as again from windows where len(g) = 5
), covered as (
  select row, i, coalesce(bool_or(again) over (partition by row order by i rows between 4 preceding and current row), false) as repeated
  from words left join twice using (row, i)
), counts as (
  select row, count_if(repeated) as n from covered group by row
), measured as (
  select doc_id, t, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines, coalesce(n, 0)::bigint as n_repeat_words,
    length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as capitals,
    len(regexp_extract_all(t, '!!')) as exclamations
  from split left join counts using (row)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or n_symbols * 10 > n_words or capitals * 2 > letters or exclamations * 10 > n_words
    or word_chars < 2 * n_words or word_chars > 20 * n_words or letters * 2 < word_chars or n_dup_lines * 10 > n_lines * 3 and n_dup_lines > 2) as kept
from measured
"""

#: Cosine over all pairs of a label, and the least id over everything reachable.
EMBEDDING_DEDUP = """
with recursive sound as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join least on least.a = vec_id left join degree on degree.a = vec_id
"""

#: Nodes level by level, and each leaf's way up. crc32 by its table of 256 remainders, made here.
MERKLE = """
with recursive crc as (
  select list(c order by i) as t from (
    select i, list_reduce(list_concat([i], range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) r(i))),
rows as (
  select doc_id, lang, case when lang is null then '' else 'v' || lang end as tree, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    doc_id is not null and xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 7 = 0 as tampered
  from documents, crc),
digests as (
  select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when tampered then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as bad
  from rows),
leaves as (
  select row_number() over () as r, doc_id, tree, leaf, coalesce(bad, leaf) as shown,
    row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n
  from digests),
nodes as (
  select 0 as level, tree, i, n, leaf as digest from leaves
  union all
  select level + 1, tree, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by i)) from nodes where n > 1 group by level, tree, i // 2, n),
walk as (
  select 0 as level, r, tree, i, n, shown as node, '' as proof from leaves
  union all
  select w.level + 1, w.r, w.tree, w.i // 2, (w.n + 1) // 2,
    sha256(case when w.i % 2 = 1 then s.digest || w.node else w.node || coalesce(s.digest, '') end), w.proof || coalesce(s.digest, '')
  from walk w left join nodes s on s.tree = w.tree and s.level = w.level and s.i = xor(w.i, 1) where w.n > 1),
tops as (select tree, digest as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1),
top_nodes as (
  select 0 as level, i, n, subroot as digest from tops
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by i)) from top_nodes where n > 1 group by level, i // 2, n),
climb as (
  select 0 as level, w.r, t.i, t.n, w.node, w.proof from walk w join tops t using (tree) where w.n = 1
  union all
  select w.level + 1, w.r, w.i // 2, (w.n + 1) // 2,
    sha256(case when w.i % 2 = 1 then s.digest || w.node else w.node || coalesce(s.digest, '') end), w.proof || coalesce(s.digest, '')
  from climb w left join top_nodes s on s.level = w.level and s.i = xor(w.i, 1) where w.n > 1)
select l.doc_id, l.leaf, t.subroot, root.digest as root, sha256(c.proof) as proof_sha256, c.node as folded_root, c.node = root.digest as verified
from leaves l join tops t using (tree) join climb c on c.r = l.r and c.n = 1, (select digest from top_nodes where n = 1) root
"""
