"""DuckDB oracle SQL for every registered query.

Each statement starts from the same usage view over ``events`` that
``meterline.sources.events_view`` builds in Spark (FIXTURES.md section 5),
written independently in SQL, so the check compares two implementations.
"""

from __future__ import annotations

from meterline.sources.prices import DEFAULT_PRICES, EMBEDDED_PRICES, VARIANTS

AS_OF = "2024-01-31 00:00:00"


def _embedded_values() -> str:
    rows = ",\n    ".join(
        f"('{n}', {a}::DECIMAL(18,12), {b}::DECIMAL(18,12), {c}::DECIMAL(18,12), {d}::DECIMAL(18,12))"
        for n, a, b, c, d in EMBEDDED_PRICES)
    return rows


def _variant_values() -> str:
    return ", ".join(f"({i}, '{p}', '{s}')" for i, (p, s) in enumerate(VARIANTS))


D_IN, D_OUT, D_CC, D_CR = DEFAULT_PRICES

# usage_raw: one row per event; usage: after keep-first dedup; priced: with cost.
BASE = f"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
usage_raw AS (
  SELECT
    CAST(event_id AS VARCHAR) AS entry_id,
    ts,
    '/data/projects/p' || CAST(user_id % 10 AS VARCHAR) AS project_path,
    CASE event_type WHEN 'view' THEN 'claude-3-5-sonnet-20241022'
                    WHEN 'click' THEN 'claude-3-haiku-20240307'
                    WHEN 'purchase' THEN 'claude-3-opus-20240229'
                    WHEN 'error' THEN 'gpt-4o'
                    WHEN 'signup' THEN 'unknown-model-x' END AS model,
    CAST(floor(value * 10) AS BIGINT) AS input_tokens,
    CAST(floor(value * 3) AS BIGINT) AS output_tokens,
    CASE WHEN event_type = 'signup' THEN NULL ELSE k * 20 END AS cache_create_tokens,
    CASE WHEN event_type = 'signup' THEN NULL ELSE k * 100 END AS cache_read_tokens,
    CAST(floor(value * 10) AS BIGINT) + CAST(floor(value * 3) AS BIGINT)
      + CASE WHEN event_type = 'signup' THEN 0 ELSE k * 120 END AS total_tokens,
    CASE WHEN event_id % 10 = 0 THEN CAST(CAST(floor(value) AS BIGINT) * 0.01 AS DECIMAL(38,12))
         ELSE CAST(0 AS DECIMAL(38,12)) END AS logged_cost,
    's' || CAST(user_id AS VARCHAR) AS session_id,
    CASE event_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'text' WHEN 2 THEN 'analysis' END AS block_type,
    concat_ws('-', 'm', CAST(user_id AS VARCHAR), event_type, CAST(CAST(ts AS DATE) AS VARCHAR)) AS message_id,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'r-' || CAST(user_id AS VARCHAR) END AS request_id,
    CASE WHEN event_id % 7 = 0
         THEN '/data/projects/p' || CAST(user_id % 10 AS VARCHAR) || '/s' || CAST(user_id AS VARCHAR)
              || '/subagents/agent-' || CAST(event_id % 3 AS VARCHAR) || '.jsonl'
         ELSE '/data/projects/p' || CAST(user_id % 10 AS VARCHAR) || '/s' || CAST(user_id AS VARCHAR) || '.jsonl'
    END AS source_file,
    event_id AS line_seq,
    user_id,
    event_type
  FROM ev
),
file_first AS (SELECT source_file, min(ts) AS file_first_ts FROM usage_raw GROUP BY source_file),
usage AS (
  SELECT r.* FROM usage_raw r JOIN file_first f USING (source_file)
  WHERE message_id IS NOT NULL AND request_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY message_id, request_id ORDER BY {{dedup_order}}) = 1
  UNION ALL
  SELECT * FROM usage_raw WHERE message_id IS NULL OR request_id IS NULL
),
embedded(name, p_in, p_out, p_cc, p_cr) AS (VALUES
    {_embedded_values()}
),
variants(pos, pre, suf) AS (VALUES {_variant_values()}),
models AS (SELECT DISTINCT model FROM usage),
model_hits AS (
  SELECT m.model, e.*, v.pos,
         row_number() OVER (PARTITION BY m.model ORDER BY v.pos) AS rk
  FROM models m CROSS JOIN variants v
  JOIN embedded e ON e.name = v.pre || m.model || v.suf
),
prices AS (
  SELECT m.model,
    COALESCE(h.p_in, {D_IN}::DECIMAL(18,12)) AS p_in,
    COALESCE(h.p_out, {D_OUT}::DECIMAL(18,12)) AS p_out,
    COALESCE(h.p_cc, {D_CC}::DECIMAL(18,12)) AS p_cc,
    COALESCE(h.p_cr, {D_CR}::DECIMAL(18,12)) AS p_cr,
    CASE WHEN h.model IS NULL THEN 'default' ELSE 'embedded' END AS price_source
  FROM models m LEFT JOIN (SELECT * FROM model_hits WHERE rk = 1) h ON h.model = m.model
),
priced0 AS (
  SELECT u.*,
    CAST(CAST(u.input_tokens AS DECIMAL(15,0)) * p.p_in + CAST(u.output_tokens AS DECIMAL(15,0)) * p.p_out
         AS DECIMAL(38,12)) AS api0,
    CASE WHEN u.cache_create_tokens IS NULL THEN CAST(0 AS DECIMAL(38,12))
         ELSE CAST(CAST(u.cache_create_tokens AS DECIMAL(15,0)) * p.p_cc AS DECIMAL(38,12)) END AS cc0,
    CASE WHEN u.cache_read_tokens IS NULL THEN CAST(0 AS DECIMAL(38,12))
         ELSE CAST(CAST(u.cache_read_tokens AS DECIMAL(15,0)) * p.p_cr AS DECIMAL(38,12)) END AS cr0
  FROM usage u LEFT JOIN prices p ON p.model = u.model
),
priced_nn AS (
  SELECT * EXCLUDE (api0, cc0, cr0),
    CASE WHEN logged_cost = 0 THEN api0 ELSE 0 END AS api_cost,
    CASE WHEN logged_cost = 0 THEN cc0 ELSE 0 END AS cache_create_cost,
    CASE WHEN logged_cost = 0 THEN cr0 ELSE 0 END AS cache_read_cost,
    CASE WHEN logged_cost = 0 THEN CAST(api0 + cc0 + cr0 AS DECIMAL(38,12)) ELSE logged_cost END AS cost
  FROM priced0
),
name_lines AS (
  SELECT session_id, source_file, ts, line_seq,
         CASE WHEN event_type = 'signup' THEN 'title' ELSE 'agent' END AS kind,
         CASE WHEN event_type = 'signup' THEN 'title-' ELSE 'agent-' END || CAST(line_seq AS VARCHAR) AS name
  FROM usage_raw WHERE event_type IN ('signup', 'error')
),
file_names AS (
  SELECT session_id, source_file,
    COALESCE(arg_max(name, (ts, line_seq)) FILTER (WHERE kind = 'title'),
             arg_min(name, (ts, line_seq)) FILTER (WHERE kind = 'agent')) AS name
  FROM name_lines GROUP BY session_id, source_file
),
session_names AS (
  SELECT n.session_id, arg_min(n.name, (f.file_first_ts, n.source_file)) AS session_name
  FROM file_names n JOIN file_first f USING (source_file)
  WHERE n.name IS NOT NULL GROUP BY n.session_id
),
priced AS (
  SELECT p.*, s.session_name FROM priced_nn p LEFT JOIN session_names s USING (session_id)
)"""


def model_label_sql(m: str) -> str:
    """The model-label rule written in DuckDB SQL."""
    r1 = r"^claude-(\w+)-(\d+)-(\d+)-\d{8}"
    r2 = r"^claude-(\w+)-(\d+)-\d{8}"
    r3 = r"^claude-(\w+)-(\d+)-(\d+)$"
    r4 = r"^claude-(\w+)-(\d+)$"

    def title(rx):
        g = f"lower(regexp_extract({m}, '{rx}', 1))"
        return f"(upper(substr({g}, 1, 1)) || substr({g}, 2))"

    def g(rx, i):
        return f"regexp_extract({m}, '{rx}', {i})"
    return f"""(CASE
      WHEN regexp_matches({m}, '{r1}') THEN {title(r1)} || '-' || {g(r1, 2)} || '.' || {g(r1, 3)}
      WHEN regexp_matches({m}, '{r2}') THEN {title(r2)} || '-' || {g(r2, 2)}
      WHEN regexp_matches({m}, '{r3}') THEN {title(r3)} || '-' || {g(r3, 2)} || '.' || {g(r3, 3)}
      WHEN regexp_matches({m}, '{r4}') THEN {title(r4)} || '-' || {g(r4, 2)}
      WHEN {m} = 'gpt-4o' THEN 'gpt-4o'
      WHEN {m} = 'gpt-4o-mini' THEN 'gpt-4o-mini'
      WHEN {m} = 'gpt-4' THEN 'gpt-4'
      WHEN {m} = 'gpt-3.5-turbo' THEN 'gpt-3.5'
      ELSE substr({m}, 1, 12) END)"""


VIEW_DEDUP_ORDER = "r.ts, r.line_seq"
# the JSONL logs: files by earliest time, then path, then line (time order)
LOAD_DEDUP_ORDER = "f.file_first_ts, r.source_file, r.ts, r.line_seq"


def with_base(body: str, recursive: bool = False, dedup_order: str = VIEW_DEDUP_ORDER) -> str:
    base = BASE.replace("{dedup_order}", dedup_order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{base}\n{body}"
