"""Catalog queries: files, tags, collections, refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions.scale import materialise, shared_dir
from corpuslake.operators import catalog as ct
from corpuslake.operators import chunking as ck
from corpuslake.plans.bindings.inputs import CORPUS, FILES, INVENTORY, QUERIES_CTE, collections, corpus, files, inventory, queries, table

SIZE = 1000


def fixed_chunks(docs):
    return ck.split_fixed(docs, SIZE)


def tags(spark, sf):
    """One tag per folder and language, and one that no file carries."""
    f = files(spark, sf).select(F.explode("tags").alias("id")).distinct()
    unused = spark.range(1).select(F.lit("unused").alias("id"))
    return f.union(unused).select("id", F.initcap("id").alias("name"))


TAGS = "tags as (select distinct id, upper(id[1]) || id[2:] as name from (select unnest(tags) as id from files union all select 'unused'))"


def records(spark, sf):
    """File records plus one web record per benchmark item."""
    f = files(spark, sf).select(
        F.upper("path").alias("path"), "chunk_count", F.lit("").alias("preview"), "size", "updated_at",
        F.when(F.col("source") == "src3", None).otherwise(F.col("file_hash")).alias("file_hash"), "source_type", "tags",
    )
    web = table(spark, sf, "benchmark").select(
        F.concat(F.lit("https://x.example.com/"), "item_id").alias("path"), F.lit(1).cast("long").alias("chunk_count"), F.lit("").alias("preview"),
        F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("updated_at"), F.lit(None).cast("string").alias("file_hash"),
        F.lit("url").alias("source_type"), F.array(F.lit("web")).alias("tags"),
    )
    return f.union(web)


RECORDS = """records as (select upper(path) as path, chunk_count, size, updated_at, case when source = 'src3' then null else file_hash end as file_hash, source_type, tags from files
  union all select 'https://x.example.com/' || item_id, 1, 0, 0, null, 'url', ['web'] from benchmark)"""


def chunks(spark, sf):
    c = ck.split_fixed(corpus(spark, sf).select(F.col("source").alias("doc_id"), "text"), SIZE)
    return c.select(F.col("doc_id").alias("path"), "chunk_no", "content", F.array(F.lit("old")).alias("tags"))


CHUNKS = f"""chunks as (select source as path, cast(i as integer) as chunk_no, substr(text, i * {SIZE} + 1, {SIZE}) as content
  from (select source, text, unnest(range(cast(ceil(length(text) / {SIZE}) as bigint))) as i from corpus))"""

PLAN = """plan as (select coalesce(r.path, i.path) as path, lower(coalesce(r.path, i.path)) as norm, i.text, i.path as i_path, r.path as r_path,
    case when r.path is null then 'new' when r.source_type = 'url' then 'url' when i.path is null then 'missing'
      when r.size is distinct from i.size or (r.updated_at <> 0 and r.updated_at < i.mtime) then 'size_or_time'
      when {hash} then {hash_reason} else 'unchanged' end as reason, r.chunk_count, r.size as r_size, i.size as i_size, r.updated_at, i.mtime, r.tags, r.source_type
  from records r full outer join inventory i on lower(r.path) = lower(i.path))"""
SMART = PLAN.format(hash="r.file_hash is null or r.file_hash <> i.file_hash", hash_reason="case when r.file_hash is null then 'no_hash' else 'hash' end")
FAST = PLAN.format(hash="false", hash_reason="''")
ACTION = "case reason when 'new' then 'new' when 'missing' then 'missing' when 'unchanged' then 'skip' else 'update' end"


def changes(mode):
    def run(spark, sf):
        return ct.plan_changes(records(spark, sf), inventory(spark, sf), mode)

    return run


def _refreshed(spark, sf, mode="smart", paths=None):
    return ct.refresh(chunks(spark, sf), records(spark, sf), inventory(spark, sf), fixed_chunks, mode, paths)


def refresh_chunks(spark, sf):
    c, _ = _refreshed(spark, sf)
    return c.select("path", "chunk_no", F.md5("content").alias("content"), F.array_join("tags", "|").alias("tags"))


def refresh_records(spark, sf):
    _, r = _refreshed(spark, sf)
    return r.select("path", "chunk_count", "size", "updated_at", F.md5("preview").alias("preview"), F.array_join("tags", "|").alias("tags"), "source_type")


def refresh_stored(spark, sf):
    """The refresh as a write: tables are published, refreshed into a new version, and read back."""
    root = f"{shared_dir(spark)}/catalog"
    ct.store(chunks(spark, sf), records(spark, sf), root)
    ct.refresh_stored(root, inventory(spark, sf), fixed_chunks)
    r = ct.stored(spark, root, "records")
    return r.select("path", "chunk_count", "size", "updated_at", F.md5("preview").alias("preview"), F.array_join("tags", "|").alias("tags"), "source_type")


def refresh_stored_chunks(spark, sf):
    """The chunks after two stored refreshes: one of a few files, then the rest."""
    root = f"{shared_dir(spark)}/catalog"
    ct.store(chunks(spark, sf), records(spark, sf), root)
    some = files(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_semi").select("path")
    ct.refresh_stored(root, inventory(spark, sf), fixed_chunks, paths=some)
    ct.refresh_stored(root, inventory(spark, sf), fixed_chunks)
    c = ct.stored(spark, root, "chunks")
    return c.select("path", "chunk_no", F.md5("content").alias("content"))


def refresh_paths(spark, sf):
    """Refresh limited to the files of the labelled documents."""
    p = files(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_semi").select("path")
    _, r = _refreshed(spark, sf, "fast", p)
    return r.select("path", "chunk_count", "size", "updated_at")


def rebuild(spark, sf):
    text = inventory(spark, sf).select("path", "text")
    _, r, _ = ct.rebuild(records(spark, sf), text, fixed_chunks)
    return r.select("path", "ok", "chunk_count", F.md5("preview").alias("preview"))


def rebuild_counts(spark, sf):
    text = inventory(spark, sf).select("path", "text")
    return ct.rebuild(records(spark, sf), text, fixed_chunks)[2]


def stats(spark, sf):
    r = records(spark, sf)
    return ct.index_stats(r, ct.plan_changes(r, inventory(spark, sf)))


def cleanup(spark, sf):
    r, c, gone = ct.cleanup(records(spark, sf), inventory(spark, sf), chunks(spark, sf))
    part = lambda df, name: df.groupBy("path").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), F.lower("path").alias("path"), "n")
    return part(r, "record").union(part(c, "chunk")).union(part(gone, "removed"))


def members(spark, sf):
    return ct.members_of(collections(spark, sf))


MEMBERS = """members as (select source as collection_id, cast(row_number() over (partition by source order by doc_id) - 1 as integer) as pos, path from files
  union all select source, cast(count(*) as integer), source || '/gone.txt' from files group by source)"""


def doubled_members(spark, sf):
    m = members(spark, sf)
    return m.union(m.select("collection_id", F.col("pos") + 100000, "path"))


def sanitise(spark, sf):
    return ct.sanitise_members(doubled_members(spark, sf), files(spark, sf)).select("collection_id", "path", "pos")


def without_file(spark, sf):
    gone = corpus(spark, sf).join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select(F.upper("source").alias("path"))
    return ct.remove_file(members(spark, sf), gone)


def cascade(spark, sf):
    ids = corpus(spark, sf).select(F.col("folder").alias("id")).distinct().where("id like '%1%'")
    m, f, c = ct.delete_collections(ids, members(spark, sf), files(spark, sf), chunks(spark, sf))
    part = lambda df, name: df.groupBy("path").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "path", "n")
    return part(m, "member").union(part(f, "file")).union(part(c, "chunk"))


def named(spark, sf):
    c = collections(spark, sf).select("id", F.when(F.col("id").endswith("1"), "  ").otherwise(F.concat(F.lit(" "), "name")).alias("name"))
    return ct.name_collections(c, 20)


def tags_upserted(spark, sf):
    names = corpus(spark, sf).select(F.explode(F.array(F.upper("folder"), F.concat(F.lit(" New "), "lang"), F.concat(F.lit("new "), F.upper("lang")))).alias("name"))
    return ct.upsert_tags(tags(spark, sf), names)


def consistency(spark, sf):
    return ct.consistency(chunks(spark, sf), inventory(spark, sf))


def scope_queries(spark, sf):
    q = queries(spark, sf)
    n = F.col("query_id")
    return q.select(
        "query_id",
        F.when(n % 4 == 0, F.array(F.concat(F.lit("SRC1\\"), n.cast("string"), F.lit(".txt")), F.concat(F.lit("src"), (n % 20).cast("string"), F.lit("/"), n.cast("string"), F.lit(".TXT")))).alias("paths"),
        F.when(n % 4 <= 1, F.concat(F.lit("src"), (n % 30).cast("string"))).alias("collection_id"),
    )


def scope(spark, sf):
    return ct.resolve_scope(scope_queries(spark, sf), members(spark, sf), files(spark, sf))


def listing(keyword, sort):
    def run(spark, sf):
        p = table(spark, sf, "pages").select(
            F.col("url").alias("path"), F.concat(F.lit("page "), "page_id").alias("name"), F.lit(0).cast("long").alias("chunk_count"), F.col("page_id").alias("updated_at"),
            F.when(F.length("html") > 2000, "processing").otherwise("ready").alias("status"),
        )
        return ct.list_files(files(spark, sf), p, keyword, sort)

    return run


QUERIES = {
    "k1_tag_counts": lambda spark, sf: ct.tag_counts(files(spark, sf)),
    "k2_overview": lambda spark, sf: ct.overview(files(spark, sf), tags(spark, sf)),
    "k3_plan_smart": changes("smart"),
    "k3_plan_fast": changes("fast"),
    "k4_refresh_chunks": refresh_chunks,
    "k4_refresh_records": refresh_records,
    "k4_refresh_paths": refresh_paths,
    "k4_refresh_stored": refresh_stored,
    "k4_refresh_stored_chunks": refresh_stored_chunks,
    "k5_rebuild": rebuild,
    "k5_rebuild_counts": rebuild_counts,
    "k6_index_stats": stats,
    "k6_failed_records": lambda spark, sf: ct.failed_records(records(spark, sf)),
    "k7_cleanup": cleanup,
    "k8_sanitise_members": sanitise,
    "k8_remove_file": without_file,
    "k8_delete_cascade": cascade,
    "k8_default_names": named,
    "k9_tag_stats": lambda spark, sf: ct.tag_stats(tags(spark, sf), files(spark, sf)),
    "k9_files_for_tags": lambda spark, sf: ct.files_for_tags(files(spark, sf), ["src1", "fr", "src19"]),
    "k9_tags_for_file": lambda spark, sf: ct.tags_for_file(files(spark, sf), tags(spark, sf)),
    "k9_upsert_tags": tags_upserted,
    "k10_consistency": consistency,
    "k11_resolve_scope": scope,
    "k12_list_files": listing("", "updated"),
    "k12_list_by_name": listing(" 7.TXT", "name"),
}

BASE = f"with {FILES}, {INVENTORY}, {RECORDS}"
PLANNED = f"{BASE}, {CHUNKS}, {SMART}, act as (select *, case when reason = 'url' then 'skip' else {ACTION} end as action from plan)"
LISTED = """listed as (select path, name, chunk_count, updated_at, 'ready' as status from files union all
  select url, 'page ' || page_id, 0, page_id, 'processing' from pages where length(html) > 2000)"""

ORACLES = {
    "k1_tag_counts": f"with {FILES} select tag, count(*) as n from (select unnest(tags) as tag from files) group by 1",
    "k2_overview": f"""with {FILES}, {TAGS}, u as (select unnest(tags) as id from files)
      select 'total' as section, 'files' as key, count(*) as value from files union all select 'total', 'chunks', cast(sum(chunk_count) as bigint) from files
      union all select 'tag', any_value(name), count(*) from u join tags on tags.id = u.id group by u.id
      union all select 'recent', name, updated_at from (select name, updated_at from files order by updated_at desc, path limit 5)""",
    "k3_plan_smart": f"{BASE}, {SMART} select path, norm, {ACTION} as action, reason from plan",
    "k3_plan_fast": f"{BASE}, {FAST} select path, norm, {ACTION} as action, reason from plan",
    "k4_refresh_chunks": f"""{PLANNED}, n as (select i_path as path, tags, text, unnest(range(cast(ceil(length(text) / {SIZE}) as bigint))) as i from act where action in ('new', 'update'))
      select path, chunk_no, md5(content) as content, 'old' as tags from chunks where lower(path) not in (select norm from act where action in ('update', 'missing'))
      union all select path, cast(i as integer), md5(substr(text, i * {SIZE} + 1, {SIZE})), coalesce(array_to_string(tags, '|'), '') from n""",
    "k4_refresh_records": f"""{PLANNED} select path, case when action = 'skip' then chunk_count else cast(ceil(length(text) / {SIZE}) as bigint) end as chunk_count,
        case when action = 'skip' then r_size else i_size end as size, case when action = 'skip' then updated_at else mtime end as updated_at,
        md5(case when action = 'skip' then '' else substr(text, 1, 160) end) as preview, coalesce(array_to_string(tags, '|'), '') as tags, coalesce(source_type, 'file') as source_type
      from act where action <> 'missing'""",
    "k4_refresh_stored": f"""{PLANNED} select path, case when action = 'skip' then chunk_count else cast(ceil(length(text) / {SIZE}) as bigint) end as chunk_count,
        case when action = 'skip' then r_size else i_size end as size, case when action = 'skip' then updated_at else mtime end as updated_at,
        md5(case when action = 'skip' then '' else substr(text, 1, 160) end) as preview, coalesce(array_to_string(tags, '|'), '') as tags, coalesce(source_type, 'file') as source_type
      from act where action <> 'missing'""",
    "k4_refresh_stored_chunks": f"""{PLANNED}, n as (select i_path as path, text, unnest(range(cast(ceil(length(text) / {SIZE}) as bigint))) as i from act where action in ('new', 'update'))
      select path, chunk_no, md5(content) as content from chunks where lower(path) not in (select norm from act where action in ('update', 'missing'))
      union all select path, cast(i as integer), md5(substr(text, i * {SIZE} + 1, {SIZE})) from n""",
    "k4_refresh_paths": f"""{BASE}, {FAST}, lim as (select lower(path) as norm from files where doc_id in (select doc_id from labels)),
      act as (select *, case when norm in (select norm from lim) and reason <> 'url' then {ACTION} else 'skip' end as action from plan where r_path is not null or norm in (select norm from lim))
      select path, case when action = 'skip' then chunk_count else cast(ceil(length(text) / {SIZE}) as bigint) end as chunk_count,
        case when action = 'skip' then r_size else i_size end as size, case when action = 'skip' then updated_at else mtime end as updated_at
      from act where action <> 'missing'""",
    "k5_rebuild": f"""{BASE} select r.path, i.path is not null as ok, coalesce(cast(ceil(length(i.text) / {SIZE}) as bigint), r.chunk_count) as chunk_count,
        md5(coalesce(substr(i.text, 1, 160), '')) as preview from records r left join inventory i on lower(i.path) = lower(r.path)""",
    "k5_rebuild_counts": f"""{BASE} select count(*) filter (i.path is not null) as succeeded, count(*) filter (i.path is null) as failed
      from records r left join inventory i on lower(i.path) = lower(r.path)""",
    "k6_index_stats": f"""{BASE}, {SMART} select count(*) as total_files, cast(sum(chunk_count) as bigint) as total_chunks, max(updated_at) as last_update,
        count(*) filter (chunk_count = 0 or updated_at = 0) as failed_files, (select count(*) from plan where {ACTION} = 'update') as pending_updates from records""",
    "k6_failed_records": f"{BASE} select path from records where chunk_count = 0 or updated_at = 0",
    "k7_cleanup": f"""{BASE}, {CHUNKS}, gone as (select lower(path) as path from records where source_type = 'file' and lower(path) not in (select lower(path) from inventory))
      select 'record' as part, lower(path) as path, count(*) as n from records where lower(path) not in (select path from gone) group by 2
      union all select 'chunk', lower(path), count(*) from chunks where lower(path) not in (select path from gone) group by 2
      union all select 'removed', path, count(*) from gone group by 2""",
    "k8_sanitise_members": f"with {FILES}, {MEMBERS} select collection_id, path, pos from members where path in (select path from files)",
    "k8_remove_file": f"with {FILES}, {MEMBERS} select * from members where path not in (select path from files where doc_id in (select doc_id from labels where toxic = 1))",
    "k8_delete_cascade": f"""with {FILES}, {MEMBERS}, {CHUNKS} select 'member' as part, path, count(*) as n from members where collection_id not like '%1%' and path in (select path from files) group by 2
      union all select 'file', path, count(*) from files where source not like '%1%' group by 2
      union all select 'chunk', path, count(*) from chunks where string_split(path, '/')[1] not like '%1%' group by 2""",
    "k8_default_names": f"with {FILES} select distinct source as id, case when ends_with(source, '1') then '未命名文档集 21' else 'Set ' || source end as name from files",
    "k9_tag_stats": f"with {FILES}, {TAGS} select id, name, count(u) as n from tags left join (select unnest(tags) as u from files) on u = id group by 1, 2",
    "k9_files_for_tags": f"with {FILES} select path from files where source in ('src1', 'src19') or list_contains(tags, 'fr')",
    "k9_tags_for_file": f"""with {FILES}, {TAGS}, u as (select path, unnest(tags) as id, unnest([0, 1]) as ord from files)
      select path, cast(ord as integer) as ord, u.id, name from u join tags on tags.id = u.id""",
    "k9_upsert_tags": f"""with {FILES}, {TAGS} select id, name from tags
      union all select md5('new ' || lang), 'New ' || lang from (select distinct lang from documents)""",
    "k10_consistency": f"""with {FILES}, {INVENTORY}, {CHUNKS}, c as (select lower(path) as norm, count(*) as n from chunks group by 1), r as (select lower(path) as norm, count(*) as n from inventory group by 1),
      b as (select coalesce(c.norm, r.norm) as norm, coalesce(c.n, 0) as n_chunks, coalesce(r.n, 0) as n_records from c full outer join r on r.norm = c.norm)
      select norm, n_chunks, n_records, case when n_records = 0 then 'no_record' else 'no_chunks' end as issue from b where n_records = 0 or n_chunks = 0
      union all select '', cast(sum(n_chunks) as bigint), cast(sum(n_records) as bigint),
        case when sum(n_chunks) = 0 then 'empty_index' when sum(n_chunks) < sum(n_records) then 'fewer_chunks_than_files' else 'ok' end from b""",
    "k11_resolve_scope": f"""with {FILES}, {QUERIES_CTE}, {MEMBERS},
      n as (select query_id, unnest(['SRC1\\' || query_id || '.txt', 'src' || (query_id % 20) || '/' || query_id || '.TXT']) as path from queries where query_id % 4 = 0
        union all select query_id, m.path from queries join members m on m.collection_id = 'src' || (query_id % 30) where query_id % 4 = 1),
      r as (select distinct query_id, path from n where lower(replace(path, '\\', '/')) in (select path from files))
      select query_id, path, false as is_global from r union all select query_id, null, true from queries where query_id not in (select query_id from r)""",
    "k12_list_files": f"with {FILES}, {LISTED} select * from listed",
    "k12_list_by_name": f"with {FILES}, {LISTED} select * from listed where contains(lower(name), '7.txt')",
}
