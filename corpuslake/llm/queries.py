"""Queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import (
    centroids,
    decontaminate,
    packing,
    pii,
    quality,
    repetition,
    secret_scan,
    simhash,
    token_counts,
    toxicity,
    turns,
    url_graph,
    vafile,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_graph(spark, sf_dir):
    return url_graph.judge_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op3_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.simhash_clusters(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark, sf_dir):
    return repetition.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op11_centroids(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_turns(spark, sf_dir):
    rows = turns.damaged(table(spark, sf_dir, "conversations"))
    return turns.report(rows, present=F.col("present"))


def op13_topk(spark, sf_dir):
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: A repeat of k words or more covers what the k-word windows found twice cover, and there is one of over k words if some
#: (k + 1)-word window is found twice; so windows stand for the suffix array here.
OP10_SQL = r"""
with words as (
    select rowid_ as r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w
    from (select row_number() over () as rowid_, doc_id, coalesce(text, '') as text from documents)),
sized as (select r, doc_id, text, w, len(w) as n from words),
positions as (select r, w, n, unnest(range(1, n + 1)) as i from sized),
windows as (
    select r, i, k, hash(list_slice(w, i, i + k - 1)) as h, list_slice(w, i, i + k - 1) as g
    from positions, (values (5), (15), (51)) as s(k) where i + k - 1 <= n),
twice as (select r, i, k from (select r, i, k, count(*) over (partition by r, k, h, g) as c from windows) where c > 1),
marked as (
    select r, k, i, max(i) over (partition by r, k order by i rows between unbounded preceding and 1 preceding) as before
    from twice),
covered as (
    select r, k, sum(case when before is null or i - before >= k then k else i - before end) as n from marked group by r, k),
lines as (
    select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(text, chr(10))) as line from words)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
base as (
    select s.r, s.doc_id, s.n as n_words, coalesce(list_sum(list_transform(s.w, lambda x: length(x))), 0)::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        coalesce(l.n, 0)::bigint as n_dup_lines,
        coalesce((select n from covered c where c.r = s.r and k = 5), 0)::bigint as n_repeat_words,
        coalesce((select n from covered c where c.r = s.r and k = 15), 0)::bigint as covered_words,
        exists (select 1 from twice t where t.r = s.r and k = 51) as over_50
    from sized s left join lines l on l.r = s.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * covered_words <= 10 * n_words and not over_50 as kept
from base
"""

OP6_SQL = r"""
with d as (select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_windows as (select distinct item_id, k, list_slice(w, i, i + k - 1) as g
    from (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
doc_windows as (select r, k, i, list_slice(w, i, i + k - 1) as g
    from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from item_windows) where len(w) >= k)),
hits as (select r, doc_windows.k, i, item_id from doc_windows join item_windows using (k, g)),
reach as (select r, i, max(i + k) as stop from hits group by r, i),
ordered as (select r, i, stop, max(stop) over (partition by r order by i rows between unbounded preceding and 1 preceding) as before from reach),
counted as (select r, sum(greatest(0, stop - greatest(i, coalesce(before, i))))::bigint as n_hit from ordered group by r),
items as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct r, item_id::varchar as id from hits where item_id is not null) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join counted using (r) left join items using (r)
"""

def _rank_sql(name: str, verdict: str, start: str, end: str, rounds: int = 120) -> str:
    """CTEs of a personalised PageRank over ``edges``, as the sum of what walks of each length bring; the last is ``{name}``."""
    return f"""{name}_seed as (select host, {verdict}::double / (select sum({verdict}) from hosts) as seed from hosts where {verdict} > 0),
{name}_share as (select {start} as host, {end} as dest, weight / sum(weight) over (partition by {start}) as share from edges),
{name}_walk as (select 0 as i, host, seed * (1 - 0.85::double) as mass from {name}_seed
    union all select i + 1, dest, sum(mass * share * 0.85) from {name}_walk join {name}_share using (host) where i < {rounds} group by i, dest),
{name} as (select host, sum(mass) as mass from {name}_walk group by host)"""


OP2_SQL = rf"""
with recursive p as (select page_id, coalesce(html, '') as html,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
addresses as (select distinct host, path from p),
fits as (select host, path, max_by(h || rules.p, length(h || rules.p)) as rule, max_by(v, length(h || rules.p)) as v
    from addresses join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, rules.p) group by host, path),
ruled as (select p.*, rule, v from p left join fits using (host, path)),
hosts as (select host, count(*) filter (v = 'allow') as allow, count(*) filter (v = 'block') as block from ruled where host <> '' group by host),
links as (select host as source, translate(unnest(regexp_extract_all(html, '(?is)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as target from p where host <> ''),
edges as (select source, target, count(*)::double as weight from links where source <> target group by source, target),
{_rank_sql("trust", "allow", "source", "target")},
{_rank_sql("distrust", "block", "target", "source")}
select page_id, host, path, rule,
    coalesce(v, case when coalesce(distrust.mass, 0) > coalesce(trust.mass, 0) then 'block' else 'allow' end) as verdict
from ruled left join trust using (host) left join distrust using (host)
"""

#: Vectors as lists of whole numbers.
_LATTICE = """
whole as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and of floored means, written out; exact sums are taken component by component."""
    out = [
        _LATTICE,
        "kept as materialized (select row_number() over () as r, vec_id, v from whole where len(v) = 64)",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from (select sha256('2:' || vec_id) as h, v from kept order by h, v limit {k}))",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        out.append(
            f"a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d := d, c := c)) as best "
            f"from (select p.r, p.vec_id, p.v, q.c, {far} as d from kept p cross join c{i} q) group by r)"
        )
        if i < rounds:
            out.append(f"s{i} as (select c, j, floor(sum(x)::decimal(38, 0)::double / count(*))::bigint as m from (select best.c as c, unnest(v) as x, unnest(range(64)) as j from a{i}) group by c, j)")
            out.append(f"m{i} as (select c, list(m order by j) as v from s{i} group by c)")
            out.append(f"c{i + 1} as materialized (select o.c, coalesce(m.v, o.v) as v from c{i} o left join m{i} m using (c))")
    return f"""
with {", ".join(out)},
one as (select best.c as c, sum(best.d)::bigint as s from a{rounds} group by all)
select vec_id, best.c::integer as cluster, best.d as distance, one.s as cluster_inertia, (select sum(s) from one)::bigint as inertia,
    sha256(array_to_string(q.v, ',')) as centroid_sha256
from a{rounds} join one on one.c = best.c join c{rounds} q on q.c = best.c
"""


OP11_SQL = _lloyd_sql()

#: crc32 by its table; then the dynamic program over (row, state), with the edits and lines so far in place of backpointers.
OP12_SQL = r"""
with recursive
table_256 as (select list(c order by n) as tab from (select n, list_reduce(list_prepend(n, range(8)),
    lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from (select unnest(range(256)) as n))),
spaced as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
drawn as (select *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 as draw from spaced, table_256),
damaged as (select conv_id, turn, unnest(case when draw = 0 then [] when draw = 3 then [1, 2] else [1] end) as copy,
    case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from drawn),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from damaged),
faulty as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
    lag(role) over (partition by conv_id order by i) as before from ordered),
lengths as (select conv_id, max(i) as n from faulty group by conv_id),
moves(here, after, name) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
added(here, m, q, price, edit, lines) as (
    select here, 0, here, 0, '', ''::varchar from moves
    union all select a.here, 1, a.after, 3, 'I', a.name || ':' || chr(10) from moves a
    union all select a.here, 2, b.after, 6, 'II', a.name || ':' || chr(10) || b.name || ':' || chr(10) from moves a join moves b on b.here = a.after),
walk as (
    select conv_id, 0::bigint as i, 0 as q, {'cost': 0, 'audit': '', 'lines': ''} as best from lengths
    union all
    select conv_id, i, q, min(best) from (
        select f.conv_id, f.i, case own when 'D' then a.q when 'R' then v.after else case left(f.role, 1) when 's' then 1 when 'u' then 2 else 3 end end as q,
            {'cost': w.best.cost + a.price + case own when 'D' then 4 else (case own when 'R' then 3 else 0 end) + (case f.fault when 'truncated' then 3 else 0 end) end,
             'audit': w.best.audit || a.edit || own,
             'lines': w.best.lines || a.lines || case own when 'D' then '' when 'R' then v.name || ':' || f.text || chr(10) else f.role || ':' || f.text || chr(10) end} as best
        from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
            join added a on a.here = w.q join moves v on v.here = a.q, (values ('D'), ('R'), ('K')) as e(own)
        where own = 'D' or f.fault not in ('blank', 'duplicate') and (own = 'R' or left(f.role, 1) = 's' and a.q = 0
            or left(f.role, 1) = 'u' and a.q <> 2 or left(f.role, 1) = 'a' and a.q = 2)) group by conv_id, i, q),
ended as (select w.conv_id, min({'cost': w.best.cost + a.price, 'audit': w.best.audit || a.edit, 'lines': w.best.lines || a.lines}) as best
    from walk w join lengths l on l.conv_id is not distinct from w.conv_id and l.n = w.i join added a on a.here = w.q where a.q in (0, 3) group by w.conv_id),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
    sha256(coalesce(left(best.lines, greatest(length(best.lines) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id
    left join ended e on e.conv_id is not distinct from o.conv_id
"""

OP13_SQL = f"""
with {_LATTICE},
numbered as (select row_number() over () as r, vec_id, v from whole),
scored as (select q.r, q.vec_id as query_id, c.vec_id, c.r as other, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::bigint as score
    from numbered q join numbered c on len(q.v) = len(c.v) and q.r <> c.r where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id nulls last, other) as rank from scored)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_graph": op2_url_graph,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroids": op11_centroids,
    "op12_turns": op12_turns,
    "op13_topk": op13_topk,
}
ORACLES = {
    "op2_url_graph": OP2_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_centroids": OP11_SQL,
    "op12_turns": OP12_SQL,
    "op13_topk": OP13_SQL,
}
