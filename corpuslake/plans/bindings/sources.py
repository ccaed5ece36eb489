"""Scan, chunk-table, inventory, import, delete, upsert and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions.scale import shared_dir
from corpuslake.operators import chunking as ck
from corpuslake.sources import tables as st
from corpuslake.plans.bindings.inputs import CORPUS, FILES, INVENTORY, corpus, events, files, inventory, table
from corpuslake.plans.bindings.pages import trim_sql


def scan(spark, sf):
    df = st.scan(spark, f"{sf}/documents.parquet", ["doc_id", "text", "source"])
    return df.select("doc_id", "source", F.md5("text").alias("text"))


def scan_capped(spark, sf):
    """The feature itself: the first 100 rows by key."""
    return st.scan(spark, f"{sf}/documents.parquet", ["doc_id", "source"], limit=100, key="doc_id")


def loose(spark, sf):
    """Documents with open-ended string metadata: numbers, blanks, JSON lists, unknown keys."""
    d = corpus(spark, sf)
    s = lambda c: F.col(c).cast("string")
    en = F.col("lang") == "en"
    return d.select(
        "doc_id", "text",
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in ("source", "tags", "fileName", "pageNumber", "position", "importedAt", "hasHeading", "title", "chunkIndex", "lang", "folder")]),
            F.array(
                F.col("source"), F.to_json(F.array("lang", "folder")), F.lit(""), F.concat(s("doc_id"), F.lit(".7")),
                F.when(en, s("n_chars")).otherwise("many"), F.when(en, F.lit("NaN")).otherwise(s("doc_id")),
                F.when(en, "true").otherwise("false"), F.when(en, F.lit("")).otherwise(F.concat(F.lit("Doc "), "doc_id")), F.lit("  "), F.col("lang"), F.col("folder"),
            ),
        ).alias("metadata"),
    )


def chunk_schema(spark, sf):
    out = st.to_chunk_schema(loose(spark, sf))
    m = F.col("metadata")
    return out.select(
        "doc_id", "source", F.array_join("tags", "|").alias("tags"), "fileName", "pageNumber", "position", "importedAt", "hasHeading", "title", "chunkIndex",
        m["hasHeading"].alias("m_heading"), m["title"].alias("m_title"), m["extra"].alias("extra"), m["headingText"].alias("m_heading_text"),
        F.size(m["blockTypes"]).alias("m_blocks"), F.size("blockTypes").alias("blocks"),
    )


def write_append(spark, sf):
    """Overwrite with one half of the corpus, append the other half in a looser shape, read back."""
    path = f"{shared_dir(spark)}/chunks"
    d = corpus(spark, sf)
    nest = lambda *extra: F.struct(F.col("source").alias("source"), F.col("n_chars").cast("int").alias("position"), *extra)
    first = d.where("lang = 'en'").select(
        "doc_id", "text", nest(F.array("lang").alias("tags"), F.lit(True).alias("hasHeading")).alias("metadata"), F.array("lang").alias("tags"), "folder"
    )
    later = d.where("lang <> 'en'").select(
        F.lit("drop me").alias("unknown"), nest(F.lit(1).alias("other")).alias("metadata"), "text", F.col("doc_id").cast("string").alias("doc_id")
    )
    st.write_chunks(first, path, "overwrite")
    st.write_chunks(later, path, "append")
    m = F.col("metadata")
    return spark.read.parquet(path).select(
        "doc_id", F.md5("text").alias("text"), m["source"].alias("source"), m["position"].alias("position"),
        F.size(m["tags"]).alias("m_tags"), m["hasHeading"].alias("heading"), F.size("tags").alias("tags"), "folder",
    )


def _listed(spark, sf):
    """Documents written as text files by folder, plus files of an unsupported kind, then listed."""
    path = f"{shared_dir(spark)}/files"
    d = corpus(spark, sf)
    d.select("text", "folder").repartition("folder").write.partitionBy("folder").text(path)
    d.select("doc_id").write.parquet(f"{path}/other")
    return st.scan_folder(spark, path).where("size > 0")


def folder_totals(spark, sf):
    return st.folder_totals(_listed(spark, sf))


def folder_scan(spark, sf):
    return _listed(spark, sf).groupBy(F.regexp_extract("folder", r"folder=(.*)\z", 1).alias("folder"), "format").agg(
        F.sum("size").alias("total_size")
    )


def chunk_rows(spark, sf):
    i = inventory(spark, sf)
    filled = i.where(F.length("text") >= 300)
    return ck.split_fixed(filled.select(F.col("path").alias("doc_id"), "text"), 500).select(
        F.upper("doc_id").alias("path"), "chunk_no", "content"
    )


def records_part(spark, sf):
    """Records registered so far: the labelled documents."""
    return files(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_semi")


def import_plan(spark, sf):
    out = st.plan_import(inventory(spark, sf), records_part(spark, sf), chunk_rows(spark, sf))
    return out.select(
        "path", "status", "message", "name", "chunk_count", F.md5("preview").alias("preview"), "size", "format", F.array_join("tags", "|").alias("tags")
    )


def import_totals(spark, sf):
    return st.import_totals(st.plan_import(inventory(spark, sf), records_part(spark, sf), chunk_rows(spark, sf)))


def gone(spark, sf):
    """Sources to look up: toxic documents, spelled with backslashes and capitals."""
    t = table(spark, sf, "labels").where("toxic = 1")
    return corpus(spark, sf).join(t, "doc_id", "left_semi").select(
        F.concat(F.lit(" "), F.upper(F.replace("source", F.lit("/"), F.lit("\\")))).alias("path")
    )


def delete_sources(spark, sf):
    return st.delete_sources(corpus(spark, sf), gone(spark, sf)).select("doc_id", "source")


def by_source(spark, sf):
    return st.by_source(corpus(spark, sf), gone(spark, sf)).select("doc_id", "source")


def upsert(spark, sf):
    """Label rows update document rows in two partial updates: a language, then a size and, for some, another language."""
    target = corpus(spark, sf).select("doc_id", "lang", "n_chars", "folder")
    lab = table(spark, sf, "labels")
    one = lab.select("doc_id", F.lit("first").alias("lang"), F.when(F.col("quality") == 0, F.lit(-1)).cast("long").alias("n_chars"), F.lit(1).alias("version"))
    two = lab.select("doc_id", F.when(F.col("toxic") == 1, "xx").alias("lang"), F.when(F.col("quality") == 1, F.lit(7)).cast("long").alias("n_chars"), F.lit(2).alias("version"))
    new = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("version"))
    return st.upsert(target, one.union(two).union(new), ["doc_id"], "version")


def log_rows(spark, sf):
    e = events(spark, sf)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    return e.select(
        level.alias("level"), F.concat(F.col("event_type"), F.lit(" "), "event_id").alias("message"), F.unix_micros("ts").alias("timestamp"),
        F.concat(F.lit("user "), "user_id").alias("context"), F.col("props").alias("metadata"), F.lit(None).cast("string").alias("error"),
    )


def log_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/log"
    st.write_log(log_rows(spark, sf), path, "INFO")
    return st.read_log(spark, path)


def log_recent(spark, sf):
    return st.recent(log_roundtrip(spark, sf), 100, "ERROR")


QUERIES = {
    "s1_scan": scan,
    "s1_scan_capped": scan_capped,
    "s2_chunk_schema": chunk_schema,
    "s3_write_append": write_append,
    "s4_scan_folder": folder_scan,
    "s4_folder_totals": folder_totals,
    "s5_import_plan": import_plan,
    "s5_import_totals": import_totals,
    "s6_delete_sources": delete_sources,
    "s7_by_source": by_source,
    "s8_upsert": upsert,
    "s10_log_roundtrip": log_roundtrip,
    "s10_log_recent": log_recent,
}

IMPORT = f"""{FILES}, {INVENTORY}, recs as (select f.path from files f where doc_id in (select doc_id from labels)),
  p as (select i.*, case when exists (select 1 from recs r where lower(r.path) = lower(i.path)) then 'exists'
    when length(i.text) < 300 then 'empty' else 'added' end as status, string_split(i.path, '/')[-1] as name from inventory i)"""
LOG = """log as (select case event_type when 'error' then 'ERROR' when 'view' then 'DEBUG' else 'INFO' end as level, event_type || ' ' || event_id as message,
  epoch_us(ts) as timestamp, 'user ' || user_id as context, props as metadata, cast(null as varchar) as error from events)"""

ORACLES = {
    "s1_scan": "select doc_id, source, md5(text) as text from documents",
    "s1_scan_capped": "select doc_id, source from documents order by doc_id limit 100",
    "s2_chunk_schema": f"""with {CORPUS} select doc_id, source, lang || '|' || folder as tags, cast(null as varchar) as "fileName", cast(doc_id as integer) as "pageNumber",
        case when lang = 'en' then cast(n_chars as integer) end as "position", case when lang <> 'en' then cast(doc_id as double) end as "importedAt",
        case when lang = 'en' then true end as "hasHeading", case when lang <> 'en' then 'Doc ' || doc_id end as title, cast(null as integer) as "chunkIndex",
        lang = 'en' as m_heading, case when lang = 'en' then '' else 'Doc ' || doc_id end as m_title, '{{"lang":"' || lang || '","folder":"' || folder || '"}}' as extra,
        '' as m_heading_text, 0 as m_blocks, cast(null as integer) as blocks from corpus""",
    "s3_write_append": f"""with {CORPUS} select doc_id, md5(text) as text, source, cast(n_chars as integer) as position, case when lang = 'en' then 1 else 0 end as m_tags,
        lang = 'en' as heading, case when lang = 'en' then 1 else 0 end as tags, case when lang = 'en' then folder end as folder from corpus""",
    "s4_folder_totals": f"""with {CORPUS} select count(distinct folder) as file_count, cast(sum(octet_length(encode(text)) + 1) as bigint) as total_size,
        count(distinct folder) as folder_count from corpus""",
    "s4_scan_folder": f"""with {CORPUS} select folder, 'txt' as format, cast(sum(octet_length(encode(text)) + 1) as bigint) as total_size from corpus group by 1""",
    "s5_import_plan": f"""with {IMPORT} select path, status, case status when 'exists' then '文件已存在，跳过: ' || name when 'empty' then '文件内容为空或无法解析: ' || name end as message,
        case when status = 'added' then name end as name, case when status = 'added' then cast(ceil(length(text) / 500) as bigint) end as chunk_count,
        case when status = 'added' then md5(substr(text, 1, 160)) end as preview, case when status = 'added' then size end as size,
        case when status = 'added' then string_split(name, '.')[-1] end as format,
        case when status = 'added' then string_split(path, '/')[1] || '|' || upper(string_split(name, '.')[-1]) end as tags from p""",
    "s5_import_totals": f"with {IMPORT} select status, count(*) as n from p group by 1",
    "s6_delete_sources": f"with {CORPUS} select doc_id, source from corpus where doc_id not in (select doc_id from labels where toxic = 1)",
    "s7_by_source": f"with {CORPUS} select doc_id, source from corpus where doc_id in (select doc_id from labels where toxic = 1)",
    "s8_upsert": f"""with {CORPUS} select c.doc_id, case when l.toxic = 1 then 'xx' when l.toxic = 0 then 'first' else lang end as lang,
          case l.quality when 1 then 7 when 0 then -1 else n_chars end as n_chars, folder
        from corpus c left join labels l on l.doc_id = c.doc_id
      union all select -item_id - 1, 'en', length(text), null from benchmark""",
    "s10_log_roundtrip": f"with {LOG} select * from log where level <> 'DEBUG'",
    "s10_log_recent": f"with {LOG} select * from log where level = 'ERROR' order by timestamp desc, message desc limit 100",
}
