"""Derived views of the given tables.

Each view is one SQL text that both Spark and DuckDB read; the few places
where the dialects differ are looked up in ``DIALECT``. Nothing is random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators import importing
from mailloom.session import spread

NL = "\n"
LONG_LINE = "long line " * 13  # 130 characters

DIALECT = {
    "spark": {
        "b64": lambda s: f"replace(base64(encode({s}, 'UTF-8')), '\r\n', '')",
        "header_time": lambda t: f"date_format({t}, 'dd MMM yyyy HH:mm:ss')",
        "hours2": "interval '2' hour",
    },
    "duckdb": {
        "b64": lambda s: f"to_base64(encode({s}))",
        "header_time": lambda t: f"strftime({t}, '%d %b %Y %H:%M:%S')",
        "hours2": "interval '2' hour",
    },
}

_BODY_NOISE = f"""
  case when doc_id % 12 = 0 then '{NL}non break\u200bing\u00ad soft\r{NL} after\t  tab\u3000' else '' end
  || case when doc_id % 4 = 0 then '{NL}Click to unsubscribe here' else '' end
  || case when doc_id % 6 = 0 then '{NL}https://x.example.com/a' else '' end
  || case when doc_id % 8 = 0 then '{NL}see https://a.example https://b.example' else '' end
  || case when doc_id % 7 = 0 then '{NL}-----{NL}[image: logo]{NL}<html>' else '' end
  || case when doc_id % 2 = 0 then '{NL}Thanks{NL}x{NL}THANKS {NL}{NL}{NL}{NL}x' else '' end
  || case when doc_id % 9 = 0 then '{NL}{LONG_LINE}{NL}{LONG_LINE}{NL}mid{NL}{LONG_LINE}' else '' end
  || case when doc_id % 10 = 1 then '{NL}Sent from my phone' else '' end
  || case when doc_id % 3 = 0 then '{NL}On Mon, Bob wrote:{NL}old text' else '' end
  || case when doc_id % 5 = 0 then '{NL}From:{NL}someone' else '' end
"""


def emails_src_sql(dialect: str) -> str:
    return f"""
select doc_id as arrival,
  case when doc_id % 97 = 0 then null when doc_id % 10 = 9 then 'm' || (doc_id - 1) else 'm' || doc_id end
    as external_message_id,
  't' || (doc_id % 50) as external_thread_id,
  case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then '' else 'Subject ' || doc_id end as subject,
  case when doc_id % 89 = 0 then '' else 'User <u' || (doc_id % 40) || '@' || source || '.example.com>' end as sender,
  'team@corp.example.com' as recipients,
  case when doc_id % 101 = 0 then null when doc_id % 103 = 0 then '' else text || {_BODY_NOISE} end as body_text,
  cast(null as {'string' if dialect == 'spark' else 'varchar'}) as body_html,
  case when doc_id % 59 = 0 then null else timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute end as sent_at,
  doc_id % 7 = 0 as has_attachments,
  timestamp '2024-02-01 00:00:00' + doc_id * interval '1' second as created_at
from documents"""


def raw_messages_sql(dialect: str) -> str:
    """Messages as RFC 2822 text, over ``emails_src``."""
    d = DIALECT[dialect]
    zone = f"case when arrival % 2 = 0 then {d['header_time']('sent_at + ' + d['hours2'])} || ' +0200' else {d['header_time']('sent_at')} || ' +0000' end"
    body = "coalesce(body_text, '')"
    plain = "Content-Type: text/plain; charset=utf-8" + NL + "Content-Transfer-Encoding: 8bit" + NL
    html = "Content-Type: text/html; charset=utf-8" + NL + "Content-Transfer-Encoding: 8bit" + NL
    return f"""
select arrival, external_message_id as id, external_thread_id as "threadId",
  'From: ' || sender || '{NL}To: ' || recipients || '{NL}'
  || case when subject is null then '' when arrival % 3 = 0 then 'Subject: =?UTF-8?B?' || {d['b64']("subject || ' Илья'")} || '?={NL}'
     else 'Subject: ' || subject || '{NL}' end
  || case when sent_at is null then '' when arrival % 61 = 0 then 'Date: not a date{NL}' else 'Date: ' || {zone} || '{NL}' end
  || 'MIME-Version: 1.0{NL}'
  || case arrival % 4
     when 0 then '{plain}{NL}' || {body}
     when 1 then '{html}{NL}<p>' || {body} || '</p>'
     when 2 then 'Content-Type: multipart/alternative; boundary="b0undary"{NL}{NL}--b0undary{NL}{plain}{NL}' || {body}
       || '{NL}--b0undary{NL}{html}{NL}<p>' || {body} || '</p>{NL}--b0undary--{NL}'
     else 'Content-Type: multipart/mixed; boundary="b0undary"{NL}{NL}--b0undary{NL}{plain}Content-Disposition: ATTACHMENT; filename="n.txt"{NL}{NL}note'
       || '{NL}--b0undary{NL}{plain}{NL}' || {body} || '{NL}--b0undary--{NL}' end
  as message
from emails_src"""


PAGES_NOISY_SQL = """
select page_id,
  case when page_id % 3 = 0 then '<?xml version="1.0"?>' else '' end
  || case when page_id % 5 = 0 then replace(html, '<html', '<html xmlns="u"') else html end
  || case when page_id % 4 = 0 then '<p style="display: none">hidden</p>' else '' end
  || case when page_id % 7 = 0 then '<span aria-hidden="true">x</span>' else '' end
  || case when page_id % 6 = 0 then '<div style="Font-Size:0;color:red">gone<b>too</b></div>tail' else '' end
  as html
from pages"""

EVENT_EMAILS_SQL = """
select 'e' || event_id as message_id, event_id,
  case when event_id % 53 = 0 then 'nobody' else 'U <u' || user_id || '@example.com>' end as sender,
  case event_type when 'purchase' then 'HITL_RESPONSE' when 'error' then 'hitl_response' else event_type end as subject,
  case when event_type = 'purchase' then 'e' || (event_id - event_id % 20) else props end as snippet,
  props as body,
  case event_id % 4 when 0 then 'clean' when 1 then 'suspicious' when 2 then 'malicious' end as security_status,
  cast(ts as timestamp) as ts
from events"""

# One row per step; the array form is gathered from it.
PLAN_STEPS_SQL = """
select conv_id as plan_id, turn as step_index,
  case when turn < conv_id % 4 then 'completed' else 'pending' end as status,
  case role when 'user' then 'perform_local_action' when 'assistant' then 'send_email' else 'do_nothing' end as type,
  substr(text, 1, 40) as summary, role as reason,
  '{"turn": ' || turn || '}' as action_spec,
  turn % 3 as n_artifacts
from conversations"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def emails_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        emails_src_sql("spark").replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents")
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, deduplicated rows with key and body to clean."""
    src = emails_src(spark, sf_dir)
    kept = importing.keep_first(importing.valid_rows(src))
    return importing.to_email_rows(kept, F.col("created_at"))


def target_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails(spark, sf_dir).filter(F.col("arrival") % 2 == 0)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = spark.sql(
        raw_messages_sql("spark").replace("from emails_src", "from {emails_src}").replace('"threadId"', "threadId"),
        emails_src=emails_src(spark, sf_dir),
    )
    encoded = F.replace(F.base64(F.encode("message", "UTF-8")), F.lit("\r\n"), F.lit(""))
    url_safe = F.replace(F.replace(encoded, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    raw = F.rtrim(url_safe, F.lit("="))
    return text.select("arrival", "id", "threadId", raw.alias("raw"))


def pages_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES_NOISY_SQL.replace("from pages", "from {pages}"), pages=table(spark, sf_dir, "pages"))


def event_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_EMAILS_SQL.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = PLAN_STEPS_SQL.replace("from conversations", "from {conversations}").replace(
        "'{\"turn\": '", "'{{\"turn\": '"
    ).replace("'}'", "'}}'")
    return spark.sql(text, conversations=table(spark, sf_dir, "conversations"))


def artifacts(n: F.Column) -> F.Column:
    """``n`` artifact names of a plan step."""
    numbers = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n.cast("int")))
    step = F.concat(F.col("plan_id").cast("string"), F.lit("/"), F.col("step_index").cast("string"), F.lit("/"))
    return F.transform(numbers, lambda i: F.concat(step, i.cast("string")))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and results per plan, and one plan without steps after the last.

    A plan is one record of the data model, a short list as long as its conversation.
    """
    step = F.struct(
        F.col("step_index").cast("int").alias("step_index"), "status", "type", "summary", "reason", "action_spec"
    )
    steps = plan_steps(spark, sf_dir).withColumn("artifacts", artifacts(F.col("n_artifacts")))
    full = steps.groupBy("plan_id").agg(
        F.array_sort(F.collect_list(step)).alias("steps"),
        F.array_sort(F.collect_list(F.struct("step_index", "artifacts"))).alias("results"),
    )
    empty = steps.agg((F.max("plan_id") + 1).alias("plan_id")).select(
        "plan_id",
        F.array().cast(full.schema["steps"].dataType).alias("steps"),
        F.array().cast(full.schema["results"].dataType).alias("results"),
    )
    return full.unionByName(empty)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector points with the source key, for the norm, size and upsert checks."""
    from mailloom.functions.ids import uuid5_url

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        uuid5_url(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(":0"))).alias("id"),
        F.struct(
            F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("external_message_id"),
            F.lit(0).alias("chunk_index"),
            F.col("label").cast("string").alias("chunk_text"),
        ).alias("payload"),
        F.col("embedding").alias("vector"),
        "label",
    )
