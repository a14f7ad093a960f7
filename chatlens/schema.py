"""Explicit schemas of the three chat tables (never inferred)."""

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ms_user_id", T.StringType(), False),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("first_seen", T.TimestampNTZType(), True),
    T.StructField("last_active", T.TimestampNTZType(), True),
])

CONVERSATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("thread_id", T.StringType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("started_at", T.TimestampNTZType(), True),
    T.StructField("last_message_at", T.TimestampNTZType(), True),
    T.StructField("message_count", T.LongType(), True),
])

MESSAGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("conversation_id", T.LongType(), True),
    T.StructField("role", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("response_time_ms", T.IntegerType(), True),
    T.StructField("tools_used", T.ArrayType(T.StringType(), True), True),
    T.StructField("sql_query", T.StringType(), True),
    T.StructField("sql_results_count", T.IntegerType(), True),
    T.StructField("error", T.StringType(), True),
])

USER_COLUMNS = [f.name for f in USERS.fields]
CONVERSATION_COLUMNS = [f.name for f in CONVERSATIONS.fields]
MESSAGE_COLUMNS = [f.name for f in MESSAGES.fields]

# Name of the date partition column of a stored messages table.
MESSAGE_DATE_PARTITION = "msg_date"
