"""The catalogue of items, and one over the supplied documents for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: An items table over ``documents``, in SQL that Spark and other engines read alike.
ITEMS_SQL = """
select item_id, root, full_path, file_name, parent_path, extension, file_type_group, size_bytes, created_ts, modified_ts, best_time_ts, is_deleted, text from (
  select doc_id as item_id, source as root,
    concat('/', source, '/', lang, '/doc_', cast(doc_id as varchar(20)), ext) as full_path,
    concat('doc_', cast(doc_id as varchar(20)), ext) as file_name,
    concat('/', source, '/', lang) as parent_path,
    ext as extension,
    case when ext in ('.txt', '.md') then 'text' when ext in ('.py', '.html') then 'code' when ext = '.pdf' then 'pdf' when ext = '.docx' then 'office'
      when ext in ('.jpg', '.png') then 'image' when ext = '.mp3' then 'audio' when ext = '.mp4' then 'video' when ext = '.zip' then 'archive' else 'other' end as file_type_group,
    n_chars as size_bytes, created_ts, modified_ts,
    case when created_ts > 631152000 and (modified_ts <= 631152000 or created_ts <= modified_ts) then created_ts else modified_ts end as best_time_ts,
    case when doc_id % 17 = 0 then 1 else 0 end as is_deleted, text
  from (
    select doc_id, text, lang, source, n_chars,
      case doc_id % 12 when 0 then '.txt' when 1 then '.md' when 2 then '.py' when 3 then '.html' when 4 then '.pdf' when 5 then '.docx' when 6 then '.jpg'
        when 7 then '.png' when 8 then '.mp3' when 9 then '.mp4' when 10 then '.zip' else '.xyz' end as ext,
      600000000 + (doc_id * 7919 * 977) % 900000000 as created_ts, 600000000 + (doc_id * 104729 * 61) % 900000000 as modified_ts
    from documents
  ) d
) i
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEMS_SQL.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))
