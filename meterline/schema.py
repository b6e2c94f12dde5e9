"""Fixed schemas of the fact table and its companions."""

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 12)
PRICE = T.DecimalType(18, 12)
TOKENS_DEC = T.DecimalType(15, 0)

# One validated API call.  Cost columns are added by ``with_cost``.
USAGE_ENTRY = T.StructType([
    T.StructField("entry_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("project_path", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cache_create_tokens", T.LongType()),
    T.StructField("cache_read_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("logged_cost", MONEY),
    T.StructField("session_id", T.StringType()),
    T.StructField("block_type", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("usage_limit_reset_time", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("file_first_ts", T.TimestampType()),
    T.StructField("file_block_start", T.LongType()),
    T.StructField("line_seq", T.LongType()),
])

COST_COLUMNS = ["cost", "api_cost", "cache_create_cost", "cache_read_cost"]

# Session-name lines: one row per custom-title / agent-name line.
NAME_ROW = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("kind", T.StringType()),          # 'title' | 'agent'
    T.StructField("name", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("file_first_ts", T.TimestampType()),
    T.StructField("file_block_start", T.LongType()),
    T.StructField("line_seq", T.LongType()),
])

PRICE_TABLE = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("input_cost_per_token", PRICE),
    T.StructField("output_cost_per_token", PRICE),
    T.StructField("cache_creation_input_token_cost", PRICE),
    T.StructField("cache_read_input_token_cost", PRICE),
])

# Load order of the log files: earliest timestamp of the file (nulls last),
# then path, then byte offset of the split and the line inside it.
LOAD_ORDER = ["file_first_ts", "source_file", "file_block_start", "line_seq"]
