"""Declared schemas of the tables and records."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("threadId", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

EMAILS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("external_message_id", T.StringType()),
        T.StructField("external_thread_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType(), False),
        T.StructField("recipients", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("body_html", T.StringType()),
        T.StructField("body_cleaned", T.StringType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("has_attachments", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

POINTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("external_message_id", T.StringType()),
                    T.StructField("chunk_index", T.IntegerType()),
                    T.StructField("chunk_text", T.StringType()),
                ]
            ),
        ),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

PLAN_STEP = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("step_index", T.IntegerType()),
        T.StructField("summary", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("action_spec", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)
