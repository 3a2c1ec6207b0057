"""The supplied tables in the shape of the operators' relations, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatebed.dims import LICENSES

TAGS = [row[0] for row in LICENSES]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: candidates out of documents and labels; runs in Spark SQL and DuckDB alike.
CANDIDATES_SQL = f"""
select 'q' || cast(d.doc_id % 5 as varchar(20)) as query, d.doc_id as ordinal,
  'https://' || case d.doc_id % 4 when 1 then 'me:pw@' else '' end || 'Img.' || d.source || '.example' || case d.doc_id % 3 when 1 then ':443' when 2 then ':8443' else '' end || '/a/' || cast(d.doc_id % 400 as varchar(20)) || '.jpg?w=' || cast(d.doc_id % 7 as varchar(20)) || '&id=' || cast(d.doc_id % 3 as varchar(20)) || '#top' as url,
  cast(d.n_chars % 4000 as int) as width, cast(d.n_chars % 900 as int) as height, d.source as source,
  'https://' || d.source || '.example/p/' || cast(d.doc_id as varchar(20)) as source_page_url,
  case when d.doc_id % 4 = 0 then null else 'Title ' || cast(d.doc_id as varchar(20)) end as title,
  case when d.doc_id % 3 = 0 then '' when d.doc_id % 3 = 1 then null else 'Author ' || cast(d.doc_id % 50 as varchar(20)) end as author,
  case d.doc_id % 7 {' '.join(f"when {i} then '{t}'" for i, t in enumerate(TAGS))} end as license,
  case when l.quality = 1 then cast(0.9 as double) when l.quality = 0 then cast(0.3 as double) else null end as confidence
from documents d left join labels l on d.doc_id = l.doc_id
"""
#: request log out of events; four keys share a workspace.
USAGE_SQL = """
select event_id as request_id, ts, 'k' || cast(user_id as varchar(20)) as api_key, 'w' || cast(user_id - user_id % 4 as varchar(20)) as workspace_id,
  case event_type when 'click' then '/v1/search' when 'view' then '/v1/similar' when 'purchase' then '/v1/download' else '/v1/' || event_type end as endpoint,
  case event_type when 'purchase' then 2 when 'view' then 3 else 1 end as units, value, props
from events
"""
#: workspaces out of customer.
WORKSPACES_SQL = """
select 'w' || cast(c_custkey - 1 as varchar(20)) as workspace_id,
  case c_mktsegment when 'BUILDING' then 'pro' when 'MACHINERY' then 'team' when 'AUTOMOBILE' then 'enterprise' else 'free' end as plan,
  case when c_custkey % 2 = 0 then 10 else null end as audit_retention_days, case when c_acctbal > 0 then 'cus' || cast(c_custkey as varchar(20)) else null end as customer_id
from customer
"""


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs one of the texts above over the tables of a folder, without leaving views behind."""
    text = sql.replace("varchar(20)", "string")
    tables = {n: read(spark, sf_dir, n) for n in ("documents", "labels", "events", "customer") if f"from {n}" in sql or f"join {n}" in sql}
    for n in tables:
        for before in ("from", "join"):
            text = text.replace(f"{before} {n}", f"{before} {{{n}}}")
    return spark.sql(text, **tables)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, CANDIDATES_SQL)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, USAGE_SQL)


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, WORKSPACES_SQL)


def hashes_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slatebed.functions.values import median_bits

    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), median_bits(F.col("embedding")).alias("phash"))
