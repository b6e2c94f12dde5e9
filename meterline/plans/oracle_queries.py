"""DuckDB SQL for each registered query (same names as ``queries.QUERIES``)."""

from __future__ import annotations

from meterline.plans.oracle import AS_OF, LOAD_DEDUP_ORDER, model_label_sql, with_base


def _local(ts: str, tz: str) -> str:
    return ts if tz == "UTC" else f"timezone('{tz}', timezone('UTC', {ts}))"


def _period_sql(key_expr: str, key: str, where: str = "", total_tokens: str = "parts",
                having: str = "", total: bool = False) -> str:
    label = model_label_sql("model")
    tot = ("input_tokens + output_tokens + cache_create_tokens + cache_read_tokens"
           if total_tokens == "parts" else "stored_total")
    models = (f"COALESCE(string_agg(DISTINCT CASE WHEN model IS NOT NULL AND model <> '' "
              f"AND model <> '<synthetic>' THEN {label} END, ';' ORDER BY CASE WHEN model IS NOT NULL "
              f"AND model <> '' AND model <> '<synthetic>' THEN {label} END), '')")
    measures = f"""
      count(DISTINCT CASE WHEN session_id <> '' THEN session_id END) AS sessions,
      {{models}} AS models,
      COALESCE(sum(input_tokens), 0) AS input_tokens,
      COALESCE(sum(output_tokens), 0) AS output_tokens,
      COALESCE(sum(cache_create_tokens), 0) AS cache_create_tokens,
      COALESCE(sum(cache_read_tokens), 0) AS cache_read_tokens,
      COALESCE(sum(total_tokens), 0) AS stored_total,
      sum(api_cost) AS api_cost, sum(cache_create_cost) AS cache_create_cost,
      sum(cache_read_cost) AS cache_read_cost, sum(cost) AS cost"""
    src = f"(SELECT *, {key_expr} AS {key} FROM priced WHERE ts IS NOT NULL AND year(ts) >= 2020) x"
    w = f"WHERE {where}" if where else ""
    groups = f"SELECT {key}, {measures.format(models=models)} FROM {src} {w} GROUP BY {key}"
    if total:
        groups = (f"SELECT {key}, false AS is_total, * EXCLUDE ({key}) FROM ({groups}) "
                  f"UNION ALL SELECT NULL AS {key}, true AS is_total, {measures.format(models=repr(''))} "
                  f"FROM {src} {w}")
    cols = (f"{key}, " + ("is_total, " if total else "") +
            f"sessions, models, input_tokens, output_tokens, cache_create_tokens, cache_read_tokens, "
            f"CAST({tot} AS BIGINT) AS total_tokens, "
            f"CAST(round(COALESCE(api_cost, 0), 6) AS DOUBLE) AS api_cost, "
            f"CAST(round(COALESCE(cache_create_cost, 0), 6) AS DOUBLE) AS cache_create_cost, "
            f"CAST(round(COALESCE(cache_read_cost, 0), 6) AS DOUBLE) AS cache_read_cost, "
            f"CAST(round(COALESCE(cost, 0), 6) AS DOUBLE) AS cost")
    return with_base(f"SELECT {cols} FROM ({groups}) g")


def _day(tz: str = "UTC") -> str:
    return f"strftime({_local('ts', tz)}, '%Y-%m-%d')"


ORACLE = {
    "daily_report": _period_sql(_day(), "date_key"),
    "daily_report_tz": _period_sql(_day("America/New_York"), "date_key"),
    "daily_report_total": _period_sql(_day(), "date_key", total=True),
    "daily_filtered": _period_sql(_day(), "date_key", where="date_key BETWEEN '2024-01-05' AND '2024-01-20'"),
    "monthly_report": _period_sql(f"substr({_day()}, 1, 7)", "month_key", total_tokens="stored"),
    "monthly_report_total": _period_sql(f"substr({_day('Asia/Tokyo')}, 1, 7)", "month_key",
                                        total_tokens="stored", total=True),
    "monthly_filtered": _period_sql(f"substr({_day('Asia/Tokyo')}, 1, 7)", "month_key",
                                    total_tokens="stored", where="month_key BETWEEN '2023-12' AND '2024-01'"),
}


def _money(c: str) -> str:
    return f"CAST(round(COALESCE({c}, 0), 6) AS DOUBLE)"


def _summary(where: str, extra_cols: str = "", group: str = "") -> str:
    g_sel = f"{group}, " if group else ""
    g_by = f"GROUP BY {group}" if group else ""
    join_on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM m.{c}" for c in group.split(", ")) if group else "true"
    return f"""
    , f AS (SELECT *{extra_cols} FROM priced WHERE {where}),
    tot AS (SELECT {g_sel} count(*) AS total_requests, sum(cost) AS c, COALESCE(sum(total_tokens), 0) AS total_tokens,
                   COALESCE(sum(input_tokens), 0) AS input_tokens, COALESCE(sum(output_tokens), 0) AS output_tokens
            FROM f {g_by}),
    bym AS (SELECT {g_sel} COALESCE(model, '') AS k, count(*) AS n FROM f WHERE model IS DISTINCT FROM '<synthetic>'
            GROUP BY {g_sel} COALESCE(model, '')),
    byp AS (SELECT {g_sel} COALESCE(project_path, '') AS k, count(*) AS n FROM f
            GROUP BY {g_sel} COALESCE(project_path, '')),
    m AS (SELECT {g_sel} string_agg(k || '=' || CAST(n AS VARCHAR), ';' ORDER BY k) AS models FROM bym {g_by}),
    p AS (SELECT {g_sel} string_agg(k || '=' || CAST(n AS VARCHAR), ';' ORDER BY k) AS projects FROM byp {g_by})
    """


def _summary_select(period: str, start: str, end: str) -> str:
    return f"""SELECT '{period}' AS period, {start} AS start_time, {end} AS end_time,
       tot.total_requests, {_money('tot.c')} AS total_cost, tot.total_tokens, tot.input_tokens, tot.output_tokens,
       CASE WHEN tot.total_requests > 0 THEN {_money('tot.c')} / tot.total_requests ELSE 0.0 END AS average_cost,
       COALESCE(m.models, '') AS models, COALESCE(p.projects, '') AS projects
    FROM tot, m, p"""


def _range_summary(period: str, start: str, end: str) -> str:
    return with_base(_summary(f"ts >= {start} AND ts < {end}") + _summary_select(period, start, end))


_SESSION = f"""
    SELECT COALESCE(NULLIF(project_path, ''), 'unknown') AS project_path,
      COALESCE(arg_min(session_name, (ts, line_seq)) FILTER (WHERE session_name <> ''), '') AS session_name,
      min(ts) AS start_time, max(ts) AS end_time,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds,
      max(ts) AS last_activity, count(*) AS request_count,
      COALESCE(sum(input_tokens), 0) AS input_tokens, COALESCE(sum(output_tokens), 0) AS output_tokens,
      COALESCE(sum(cache_create_tokens), 0) AS cache_create_tokens,
      COALESCE(sum(cache_read_tokens), 0) AS cache_read_tokens,
      COALESCE(sum(total_tokens), 0) AS total_tokens,
      {_money('sum(cost)')} AS total_cost, {_money('sum(api_cost)')} AS total_api_cost,
      {_money('sum(cache_create_cost)')} AS cache_create_cost, {_money('sum(cache_read_cost)')} AS cache_read_cost,
      COALESCE(string_agg(DISTINCT CASE WHEN model <> '' AND model <> '<synthetic>' THEN model END, ';'
               ORDER BY CASE WHEN model <> '' AND model <> '<synthetic>' THEN model END), '') AS models_used,
      count(DISTINCT NULLIF(session_id, '')) AS n_session_ids,
      count(DISTINCT NULLIF(source_file, '')) AS n_source_files
    FROM priced {{where}} GROUP BY 1"""

_FILE_LABEL = ("CASE WHEN list_position(string_split(source_file, '/'), 'subagents') > 0 AND "
               "list_position(string_split(source_file, '/'), 'subagents') < len(string_split(source_file, '/')) "
               "THEN 'subagents/' || string_split(source_file, '/')[list_position(string_split(source_file, '/'), "
               "'subagents') + 1] ELSE string_split(source_file, '/')[-1] END")

ORACLE.update({
    "dedup_usage": with_base("SELECT entry_id, message_id, request_id, ts, session_id, model, input_tokens, "
                             "output_tokens FROM usage"),
    "price_resolution": with_base(
        "SELECT model, CAST(p_in AS DOUBLE) AS input_cost_per_token, CAST(p_out AS DOUBLE) AS output_cost_per_token, "
        "CAST(p_cc AS DOUBLE) AS cache_creation_input_token_cost, "
        "CAST(p_cr AS DOUBLE) AS cache_read_input_token_cost, price_source FROM prices"),
    "usage_costs": with_base(
        f"SELECT entry_id, model, session_name, {_money('api_cost')} AS api_cost, "
        f"{_money('cache_create_cost')} AS cache_create_cost, {_money('cache_read_cost')} AS cache_read_cost, "
        f"{_money('cost')} AS cost FROM priced"),
    "user_price_costs": with_base(f"""
        , made AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'claude-3-haiku-20240307' WHEN 1 THEN 'gpt-4o'
                          WHEN 2 THEN 'unknown-model-x' ELSE 'not-used' END AS model,
                    CAST(p_size * 0.000000001 AS DECIMAL(18,12)) AS a, CAST(p_size * 2 * 0.000000001 AS DECIMAL(18,12)) AS b,
                    CAST((p_partkey % 7) * 0.000000001 AS DECIMAL(18,12)) AS c,
                    CAST((p_partkey % 7 + 1) * 0.000000001 AS DECIMAL(18,12)) AS d FROM part),
        own AS (SELECT model, a, b, c, d FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY a, b, c, d) AS rn
                                               FROM made) WHERE rn = 1),
        costed AS (SELECT u.model, CASE WHEN u.logged_cost <> 0 THEN u.logged_cost ELSE
              CAST(u.input_tokens AS DECIMAL(15,0)) * coalesce(o.a, p.p_in) + CAST(u.output_tokens AS DECIMAL(15,0)) * coalesce(o.b, p.p_out)
              + coalesce(CAST(u.cache_create_tokens AS DECIMAL(15,0)) * coalesce(o.c, p.p_cc), 0)
              + coalesce(CAST(u.cache_read_tokens AS DECIMAL(15,0)) * coalesce(o.d, p.p_cr), 0) END AS cost
            FROM usage u LEFT JOIN own o USING (model) LEFT JOIN prices p ON p.model = u.model)
        SELECT model, count(*) AS requests, {_money('sum(cost)')} AS cost FROM costed GROUP BY model"""),
    "session_names": with_base("SELECT session_id, session_name FROM session_names"),
    "period_summary": _range_summary("daily", "TIMESTAMP '2024-01-15 00:00:00'", "TIMESTAMP '2024-01-16 00:00:00'"),
    "monthly_summary": _range_summary("monthly", "TIMESTAMP '2024-01-01 00:00:00'",
                                      "TIMESTAMP '2024-02-01 00:00:00'"),
    "weekly_report": _range_summary("weekly", "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-15 00:00:00'"),
    "weekly_report_all": with_base(
        _summary("ts IS NOT NULL AND year(ts) >= 2020",
                 ", CAST(year(date_trunc('week', ts)) AS INTEGER) AS week_year, "
                 "CAST(floor((dayofyear(date_trunc('week', ts)) - 1) / 7) + 1 AS INTEGER) AS week, "
                 "CAST(date_trunc('week', ts) AS TIMESTAMP) AS start_time", "week_year, week, start_time")
        + f"""SELECT t.week_year, t.week, t.start_time, t.start_time + INTERVAL 7 DAY AS end_time,
       t.total_requests, {_money('t.c')} AS total_cost, t.total_tokens, t.input_tokens, t.output_tokens,
       CASE WHEN t.total_requests > 0 THEN {_money('t.c')} / t.total_requests ELSE 0.0 END AS average_cost,
       COALESCE(m.models, '') AS models, COALESCE(p.projects, '') AS projects
    FROM tot t JOIN m USING (week_year, week, start_time) JOIN p USING (week_year, week, start_time)"""),
    "session_report": with_base(_SESSION.format(where="")),
    "session_members": with_base(
        "SELECT DISTINCT COALESCE(NULLIF(project_path, ''), 'unknown') AS project_path, 'session_id' AS kind, "
        "session_id AS member FROM priced WHERE session_id <> '' UNION "
        "SELECT DISTINCT COALESCE(NULLIF(project_path, ''), 'unknown'), 'source_file', source_file FROM priced "
        "WHERE source_file <> ''"),
    "session_by_id": with_base(_SESSION.format(where="WHERE session_id = 's7'")),
    "session_by_name": with_base(_SESSION.format(
        where="WHERE session_name = (SELECT session_name FROM session_names WHERE session_id = 's3')")),
    "source_file_report": with_base(f"""
    SELECT source_file AS file_path, COALESCE(sum(input_tokens), 0) AS input_tokens,
      COALESCE(sum(output_tokens), 0) AS output_tokens,
      COALESCE(sum(cache_create_tokens), 0) AS cache_create_tokens,
      COALESCE(sum(cache_read_tokens), 0) AS cache_read_tokens,
      CAST(COALESCE(sum(input_tokens), 0) + COALESCE(sum(output_tokens), 0) + COALESCE(sum(cache_create_tokens), 0)
           + COALESCE(sum(cache_read_tokens), 0) AS BIGINT) AS total_tokens,
      {_money('sum(api_cost)')} AS api_cost, {_money('sum(cache_create_cost)')} AS cache_create_cost,
      {_money('sum(cache_read_cost)')} AS cache_read_cost, {_money('sum(cost)')} AS cost,
      COALESCE(string_agg(DISTINCT CASE WHEN model <> '' AND model <> '<synthetic>' THEN model END, ';'
               ORDER BY CASE WHEN model <> '' AND model <> '<synthetic>' THEN model END), '') AS models_used,
      max(ts) AS last_activity, count(*) AS entry_count
    FROM priced WHERE source_file <> '' GROUP BY source_file"""),
    "block_type_report": with_base(f"""
    SELECT block_type, count(*) AS count, COALESCE(sum(total_tokens), 0) AS total_tokens,
      min(ts) AS first_seen, max(ts) AS last_seen, {_money('sum(cost)')} AS total_cost
    FROM priced WHERE block_type <> '' GROUP BY block_type"""),
    "usage_totals": with_base(f"SELECT count(*) AS total_requests, {_money('sum(cost)')} AS total_cost, "
                              "COALESCE(sum(total_tokens), 0) AS total_tokens FROM priced"),
    "recent_entries": with_base(f"SELECT entry_id, ts, model, total_tokens, {_money('cost')} AS cost FROM priced "
                                "ORDER BY ts DESC, source_file DESC, line_seq DESC LIMIT 5"),
    "model_labels": with_base(f"SELECT model, {model_label_sql('model')} AS label FROM (SELECT DISTINCT model "
                              "FROM usage_raw)"),
    "file_labels": with_base(f"SELECT source_file, {_FILE_LABEL} AS label FROM (SELECT DISTINCT source_file "
                             "FROM usage_raw)"),
})


# ---- billing blocks: recursive CTE + range attach -------------------------------

def _blocks_ctes(key: str) -> str:
    return f"""
, e AS (SELECT {key} AS k, * FROM priced WHERE ts IS NOT NULL),
b(k, st) AS (
  SELECT k, date_trunc('hour', min(ts)) FROM e GROUP BY k
  UNION ALL
  SELECT b.k, date_trunc('hour', min(e.ts)) FROM b JOIN e ON e.k = b.k AND e.ts > b.st + INTERVAL 5 HOUR
  GROUP BY b.k
),
asg AS (
  SELECT e.entry_id, min(b.st) AS block_start FROM e JOIN b ON b.k = e.k
    AND e.ts >= b.st AND e.ts <= b.st + INTERVAL 5 HOUR GROUP BY e.entry_id
),
ea AS (SELECT e.*, asg.block_start FROM e JOIN asg USING (entry_id)),
blk AS (
  SELECT k, block_start AS start_time, block_start + INTERVAL 5 HOUR AS end_time,
    strftime(block_start, '%Y-%m-%dT%H:%M:%SZ') AS block_id,
    max(ts) AS actual_end_time, min(ts) AS first_ts, false AS is_gap, count(*) AS entry_count,
    COALESCE(sum(input_tokens), 0) AS input_tokens, COALESCE(sum(output_tokens), 0) AS output_tokens,
    COALESCE(sum(cache_create_tokens), 0) AS cache_creation_input_tokens,
    COALESCE(sum(cache_read_tokens), 0) AS cache_read_input_tokens,
    COALESCE(sum(input_tokens), 0) + COALESCE(sum(output_tokens), 0) + COALESCE(sum(cache_create_tokens), 0)
      + COALESCE(sum(cache_read_tokens), 0) AS total_tokens,
    {_money('sum(cost)')} AS cost_usd,
    COALESCE(string_agg(DISTINCT NULLIF(model, ''), ';' ORDER BY NULLIF(model, '')), '') AS models,
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts)) < CAST(18000000000 AS BIGINT)
      AND TIMESTAMP '{AS_OF}' < block_start + INTERVAL 5 HOUR) AS is_active
  FROM ea GROUP BY k, block_start
),
gaps AS (
  SELECT k, 'gap-' || strftime(actual_end_time + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS block_id,
    actual_end_time + INTERVAL 5 HOUR AS start_time, nf AS end_time, CAST(NULL AS TIMESTAMP) AS actual_end_time,
    false AS is_active, true AS is_gap, 0 AS entry_count, 0 AS input_tokens, 0 AS output_tokens,
    0 AS cache_creation_input_tokens, 0 AS cache_read_input_tokens, 0 AS total_tokens, 0.0 AS cost_usd,
    '' AS models
  FROM (SELECT *, lead(first_ts) OVER (PARTITION BY k ORDER BY start_time) AS nf FROM blk)
  WHERE epoch_us(nf) - epoch_us(actual_end_time) > CAST(18000000000 AS BIGINT)
),
burn AS (
  SELECT *, (epoch_us(actual_end_time) - epoch_us(first_ts)) / 60000000.0 AS mins FROM blk
),
proj AS (
  SELECT *,
    CASE WHEN mins > 0 THEN total_tokens / mins END AS tpm,
    CASE WHEN mins > 0 THEN (input_tokens + output_tokens) / mins END AS tpm_ind,
    greatest((epoch_us(end_time) - epoch_us(TIMESTAMP '{AS_OF}')) / 60000000.0, 0.0) AS rem
  FROM burn
),
projected AS (
  SELECT *,
    CASE WHEN is_active AND tpm IS NOT NULL THEN rem END AS remaining_minutes,
    CASE WHEN is_active THEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(start_time)) / 60000000.0 END
      AS elapsed_minutes,
    CASE WHEN is_active AND tpm IS NOT NULL THEN total_tokens + CAST(trunc(tpm * rem) AS BIGINT) END
      AS projected_total_tokens
  FROM proj
),
maxtok AS (SELECT COALESCE(max(CASE WHEN NOT is_active THEN total_tokens END), 0) AS max_tokens FROM blk)
"""


_BLOCK_COLS = ("block_id, start_time, end_time, actual_end_time, is_active, is_gap, entry_count, input_tokens, "
               "output_tokens, cache_creation_input_tokens, cache_read_input_tokens, total_tokens, cost_usd, models")

ORACLE.update({
    "block_assignment": with_base(_blocks_ctes("session_id")
                                  + "SELECT entry_id, k AS session_id, block_start FROM ea", recursive=True),
    "block_report": with_base(_blocks_ctes("session_id") + f"SELECT k AS session_id, {_BLOCK_COLS} FROM blk",
                              recursive=True),
    "block_report_global": with_base(_blocks_ctes("0") + f"SELECT {_BLOCK_COLS} FROM blk UNION ALL "
                                     f"SELECT {_BLOCK_COLS} FROM gaps", recursive=True),
    "block_gaps": with_base(_blocks_ctes("session_id")
                            + "SELECT k AS session_id, block_id, start_time, end_time FROM gaps", recursive=True),
    "active_blocks": with_base(_blocks_ctes("session_id")
                               + f"SELECT k AS session_id, {_BLOCK_COLS} FROM blk WHERE is_active", recursive=True),
    "recent_blocks": with_base(_blocks_ctes("session_id") + f"""
        SELECT k AS session_id, {_BLOCK_COLS} FROM (SELECT * FROM blk UNION ALL BY NAME SELECT * FROM gaps)
        WHERE start_time > TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY""", recursive=True),
    "block_burn_rate": with_base(_blocks_ctes("0") + """
        SELECT block_id, CASE WHEN mins > 0 THEN total_tokens / mins END AS tokens_per_minute,
          CASE WHEN mins > 0 THEN (input_tokens + output_tokens) / mins END AS tokens_per_minute_for_indicator,
          CASE WHEN mins > 0 THEN cost_usd / mins * 60 END AS cost_per_hour FROM burn""", recursive=True),
    "block_projection": with_base(_blocks_ctes("session_id") + """
        SELECT k AS session_id, block_id, remaining_minutes, elapsed_minutes, projected_total_tokens
        FROM projected WHERE is_active""", recursive=True),
    "block_limit_status": with_base(_blocks_ctes("session_id") + """
        SELECT k AS session_id, block_id, is_active, max_tokens AS token_limit,
          CASE WHEN max_tokens > 0 THEN total_tokens / max_tokens * 100 END AS percent_of_limit,
          CASE WHEN max_tokens > 0 AND is_active THEN greatest(max_tokens - total_tokens, 0) END AS remaining_tokens,
          CASE WHEN max_tokens > 0 AND projected_total_tokens IS NOT NULL
               THEN projected_total_tokens / max_tokens * 100 END AS projected_percent,
          CASE WHEN max_tokens > 0 AND projected_total_tokens IS NOT NULL THEN
            CASE WHEN projected_total_tokens / max_tokens * 100 > 100 THEN 'exceeds'
                 WHEN projected_total_tokens / max_tokens * 100 > 80 THEN 'warning' ELSE 'ok' END END AS limit_status
        FROM projected, maxtok""", recursive=True),
    "block_live_status": with_base(_blocks_ctes("session_id") + """
        SELECT k AS session_id, block_id, total_tokens / 50000 * 100 AS usage_percent,
          CASE WHEN tpm_ind IS NULL THEN NULL WHEN tpm_ind > 1000 THEN 'HIGH' WHEN tpm_ind > 500 THEN 'MODERATE'
               ELSE 'NORMAL' END AS burn_status,
          CASE WHEN total_tokens / 50000 * 100 > 95 THEN 'red' WHEN total_tokens / 50000 * 100 > 80 THEN 'yellow'
               ELSE 'green' END AS usage_level,
          CASE WHEN projected_total_tokens IS NULL THEN NULL
               WHEN projected_total_tokens / 50000 * 100 > 100 THEN 'EXCEEDS'
               WHEN projected_total_tokens / 50000 * 100 > 90 THEN 'APPROACHING' ELSE 'WITHIN' END
            AS projection_status
        FROM projected WHERE is_active""", recursive=True),
    "max_block_tokens": with_base(_blocks_ctes("session_id") + "SELECT max_tokens FROM maxtok", recursive=True),
    "active_block_detail": with_base(_blocks_ctes("session_id") + f"""
        SELECT k AS session_id, block_id, start_time, end_time, elapsed_minutes,
          (epoch_us(end_time) - epoch_us(TIMESTAMP '{AS_OF}')) / 60000000.0 AS time_remaining_minutes,
          input_tokens, output_tokens, total_tokens, cost_usd, projected_total_tokens,
          max_tokens AS token_limit,
          CASE WHEN max_tokens > 0 THEN greatest(max_tokens - total_tokens, 0) END AS remaining_tokens,
          CASE WHEN max_tokens > 0 AND projected_total_tokens IS NOT NULL THEN
            CASE WHEN projected_total_tokens / max_tokens * 100 > 100 THEN 'exceeds'
                 WHEN projected_total_tokens / max_tokens * 100 > 80 THEN 'warning' ELSE 'ok' END END AS limit_status
        FROM projected, maxtok WHERE is_active ORDER BY start_time, k LIMIT 1""", recursive=True),
})


# ---- JSONL logs: same facts, load-order dedup ------------------------------------


def _load_order(sql_with_base: str) -> str:
    return sql_with_base.replace("ORDER BY r.ts, r.line_seq) = 1", f"ORDER BY {LOAD_DEDUP_ORDER}) = 1")


_REL = "'projects/' || split_part(source_file, '/data/projects/', 2)"

ORACLE.update({
    "jsonl_ingest": _load_order(ORACLE["daily_report"]),
    "jsonl_entries": with_base(f"SELECT entry_id, session_name, {_REL} AS source_file, total_tokens, "
                               f"{_money('cost')} AS cost FROM priced", dedup_order=LOAD_DEDUP_ORDER),
    "jsonl_rejects": """
        SELECT reject_reason, counted, count(*) AS lines FROM (
          SELECT 'malformed_json' AS reject_reason, true AS counted FROM events WHERE event_id % 13 = 0
          UNION ALL SELECT 'input_tokens_not_number', true FROM events
            WHERE event_id % 13 <> 0 AND event_id % 17 = 0
          UNION ALL SELECT 'missing_usage', false FROM events
            WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 = 0
        ) GROUP BY reject_reason, counted""",
    "jsonl_session_names": with_base("SELECT session_id, session_name FROM session_names"),
    "file_order": with_base(f"SELECT {_REL} AS rel_path, min(ts) AS file_first_ts FROM usage_raw GROUP BY 1"),
})


# ---- live reports: the batch statements, over the load-order dedup ------------------

ORACLE.update({
    "stream_dedup": with_base(f"SELECT entry_id, message_id, request_id, session_id, {_REL} AS source_file, "
                              "total_tokens FROM usage", dedup_order=LOAD_DEDUP_ORDER),
    "stream_daily": ORACLE["jsonl_ingest"],
    "stream_totals": _load_order(ORACLE["usage_totals"]),
    "stream_activity": with_base("""
        , s AS (SELECT session_id, ts, sum(CASE WHEN prev IS NOT NULL AND ts - prev >= INTERVAL 5 HOUR THEN 1
                                                ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, line_seq) AS g
                FROM (SELECT session_id, ts, line_seq,
                             lag(ts) OVER (PARTITION BY session_id ORDER BY ts, line_seq) AS prev FROM usage))
        SELECT session_id, min(ts) AS start_time, max(ts) + INTERVAL 5 HOUR AS end_time, count(*) AS entries,
               min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY session_id, g""", dedup_order=LOAD_DEDUP_ORDER),
    "stream_blocks": _load_order(ORACLE["block_report"]),
})

ORACLE.update({
    "live_reports": ORACLE["jsonl_ingest"],
    "growing_daily": ORACLE["jsonl_ingest"],
    "monthly_from_partials": ORACLE["monthly_report_total"],
    "monthly_from_sketches": f"SELECT * EXCLUDE (sessions), TRUE AS sessions_close FROM ({ORACLE['monthly_report_total']})",
    "daily_approx": f"SELECT * EXCLUDE (sessions), TRUE AS sessions_close FROM ({ORACLE['daily_report_total']})",
    "live_keep_first": ORACLE["stream_dedup"],
    "live_state_blocks": ORACLE["stream_blocks"],
    "incremental_refresh": ORACLE["jsonl_ingest"],
    "refresh_by_keys": ORACLE["jsonl_ingest"],
    "manifest_diff": """
        SELECT status, count(*) AS files FROM (
          SELECT src, CASE WHEN min(ts) < TIMESTAMP '2024-01-16 00:00:00' THEN 'changed' ELSE 'new' END AS status
          FROM (SELECT ts, CASE WHEN event_id % 7 = 0
                  THEN 'p' || CAST(user_id % 10 AS VARCHAR) || '/s' || CAST(user_id AS VARCHAR) || '/subagents/agent-'
                       || CAST(event_id % 3 AS VARCHAR)
                  ELSE 'p' || CAST(user_id % 10 AS VARCHAR) || '/s' || CAST(user_id AS VARCHAR) END AS src
                FROM events) GROUP BY src) GROUP BY status""",
})


# ---- documented extras ------------------------------------------------------------

_DAILY_SERIES = """, series AS (
    SELECT strftime(ts, '%Y-%m-%d') AS date_key, round(COALESCE(sum(cost), 0), 6) AS cost,
           COALESCE(sum(total_tokens), 0) AS total_tokens
    FROM priced WHERE ts IS NOT NULL AND year(ts) >= 2020 GROUP BY 1),
    reg AS (SELECT count(*)::DECIMAL(38,0) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sx2,
                   sum(y * y) AS sy2
            FROM (SELECT (row_number() OVER (ORDER BY date_key) - 1)::DECIMAL(38,0) AS x,
                         cost::DECIMAL(38,6) AS y FROM series))
"""

ORACLE.update({
    "model_breakdown": with_base(f"""
        SELECT strftime(ts, '%Y-%m-%d') AS period, COALESCE(model, '') AS model, count(*) AS requests,
          COALESCE(sum(input_tokens), 0) AS input_tokens, COALESCE(sum(output_tokens), 0) AS output_tokens,
          COALESCE(sum(cache_create_tokens), 0) AS cache_create_tokens,
          COALESCE(sum(cache_read_tokens), 0) AS cache_read_tokens,
          COALESCE(sum(total_tokens), 0) AS total_tokens, {_money('sum(cost)')} AS cost
        FROM priced WHERE ts IS NOT NULL AND year(ts) >= 2020 GROUP BY 1, 2"""),
    "project_daily": with_base(f"""
        SELECT COALESCE(project_path, '') AS project_path, strftime(ts, '%Y-%m-%d') AS date_key,
          count(*) AS requests, COALESCE(sum(total_tokens), 0) AS total_tokens, {_money('sum(cost)')} AS cost
        FROM priced WHERE ts IS NOT NULL AND year(ts) >= 2020
          AND contains(lower(COALESCE(project_path, '')), 'projects/p3') GROUP BY 1, 2"""),
    "iso_weekly_report": _period_sql("strftime(ts, '%G-W%V')", "week_key"),
    "month_stats": with_base(_DAILY_SERIES + f"""
        SELECT substr(date_key, 1, 7) AS month, count(*) AS days_active, {_money('sum(cost)')} AS total_cost,
          sum(total_tokens) AS total_tokens, CAST(sum(cost) AS DOUBLE) / count(*) AS average_daily_cost,
          CAST(trunc(sum(total_tokens) / count(*)) AS BIGINT) AS average_daily_tokens,
          arg_max(date_key, (cost, date_key)) AS peak_day, {_money('max(cost)')} AS peak_day_cost,
          CAST(NULL AS DOUBLE) AS change_percent
        FROM series GROUP BY 1"""),
    "usage_stats": with_base("""
        , v AS (SELECT total_tokens AS x FROM priced WHERE total_tokens IS NOT NULL),
        a AS (SELECT count(*) AS count, sum(x::DECIMAL(38,0)) AS s, sum(x::DECIMAL(38,0) * x::DECIMAL(38,0)) AS s2,
                     min(x) AS min, max(x) AS max FROM v),
        o AS (SELECT x, row_number() OVER (ORDER BY x) AS rk FROM v)
        SELECT count, CAST(s AS BIGINT) AS sum, CAST(s AS DOUBLE) / count AS average, min, max,
          sqrt(CAST(count::DECIMAL(38,0) * s2 - s * s AS DOUBLE) / (CAST(count AS DOUBLE) * CAST(count AS DOUBLE)))
            AS std_dev,
          (SELECT x FROM o WHERE rk = floor(count / 2) + 1) AS median,
          (SELECT x FROM o WHERE rk = floor(CAST(count AS DOUBLE) * 0.95) + 1) AS p95
        FROM a"""),
    "usage_trend": with_base(_DAILY_SERIES + """
        , t AS (SELECT n, sx, sy,
                  CAST(n * sxy - sx * sy AS DOUBLE) AS num, CAST(n * sx2 - sx * sx AS DOUBLE) AS dx,
                  CAST(n * sy2 - sy * sy AS DOUBLE) AS dy FROM reg)
        SELECT CAST(n AS BIGINT) AS points,
          CASE WHEN n >= 2 THEN num / dx END AS slope,
          CASE WHEN n >= 2 THEN abs(num) / sqrt(dx * dy) END AS correlation,
          CASE WHEN n < 2 OR abs(num / dx) < 0.01 THEN 'stable' WHEN num / dx > 0 THEN 'increasing'
               ELSE 'decreasing' END AS direction,
          CASE WHEN n >= 2 THEN num / dx * CAST(n AS DOUBLE)
               + (CAST(sy AS DOUBLE) - num / dx * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) END AS prediction
        FROM t"""),
    "half_trend": with_base(_DAILY_SERIES + """
        , h AS (SELECT count(*) AS n, floor(count(*) / 2) AS mid FROM series),
        s2 AS (SELECT row_number() OVER (ORDER BY date_key) - 1 AS i, cost::DECIMAL(38,6) AS y FROM series),
        g AS (SELECT h.n, h.mid, sum(CASE WHEN i < h.mid THEN y END) AS a, sum(CASE WHEN i >= h.mid THEN y END) AS b
              FROM s2, h GROUP BY h.n, h.mid)
        SELECT n AS points, CAST(a AS DOUBLE) / mid AS first_half_avg, CAST(b AS DOUBLE) / (n - mid) AS second_half_avg,
          CASE WHEN n < 10 THEN 'stable'
               WHEN (CAST(b AS DOUBLE) / (n - mid) - CAST(a AS DOUBLE) / mid) / (CAST(a AS DOUBLE) / mid) > 0.1
                 THEN 'increasing'
               WHEN (CAST(b AS DOUBLE) / (n - mid) - CAST(a AS DOUBLE) / mid) / (CAST(a AS DOUBLE) / mid) < -0.1
                 THEN 'decreasing' ELSE 'stable' END AS trend
        FROM g"""),
    "block_alerts": with_base(_blocks_ctes("session_id") + """
        , a AS (SELECT k, block_id, is_active, remaining_minutes, cost_usd,
                  CASE WHEN mins > 0 THEN cost_usd / mins * 60 END AS cph FROM projected)
        SELECT k AS session_id, block_id, 'high_burn_rate' AS rule, 'warning' AS level FROM a
          WHERE is_active AND cph > 50
        UNION ALL SELECT k, block_id, 'block_limit_approaching', 'critical' FROM a
          WHERE is_active AND remaining_minutes < 30 AND cost_usd > 150""", recursive=True),
    "cost_per_token": with_base(f"""
        , bm AS (SELECT project_path, COALESCE(model, '') AS model, count(*) AS n, sum(cost) AS cost,
                        COALESCE(sum(total_tokens), 0) AS tokens FROM priced GROUP BY 1, 2)
        SELECT project_path, sum(n) AS requests, {_money('sum(cost)')} AS total_cost, sum(tokens) AS total_tokens,
          CASE WHEN CAST(sum(tokens) AS BIGINT) > 0 THEN CAST(sum(cost) AS DOUBLE) / CAST(sum(tokens) AS BIGINT) END AS cost_per_token, arg_max(model, (n, model)) AS most_used_model
        FROM bm GROUP BY 1"""),
    "live_sessions": with_base(f"""
        SELECT session_id, max(ts) AS last_seen, count(*) AS requests, {_money('sum(cost)')} AS cost,
          epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts)) < CAST(18000000000 AS BIGINT) AS is_active
        FROM priced WHERE session_id <> '' GROUP BY 1"""),
    "gap_sessions": with_base(f"""
        , o AS (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, line_seq) AS prev FROM priced
                WHERE ts IS NOT NULL),
        g AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > CAST(18000000000 AS BIGINT)
                                 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, line_seq) AS sn FROM o)
        SELECT session_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS request_count,
          COALESCE(sum(input_tokens), 0) AS input_tokens, COALESCE(sum(output_tokens), 0) AS output_tokens,
          {_money('sum(cost)')} AS total_cost,
          string_agg(DISTINCT COALESCE(model, ''), ';' ORDER BY COALESCE(model, '')) AS models_used,
          (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds,
          CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1) END
            AS average_interval_seconds
        FROM g GROUP BY session_id, sn"""),
    "data_quality": with_base("SELECT entry_id, '' AS quality_issues FROM usage_raw WHERE input_tokens < 0 "
                              "OR output_tokens < 0 OR cache_create_tokens < 0 OR cache_read_tokens < 0 "
                              "OR logged_cost < 0"),
    "sorted_report": with_base(f"""
        SELECT strftime(ts, '%Y-%m-%d') AS date_key, count(DISTINCT NULLIF(session_id, '')) AS sessions,
          {_money('sum(cost)')} AS cost FROM priced WHERE ts IS NOT NULL AND year(ts) >= 2020 GROUP BY 1"""),
})


# ---- detail, merge, labels, sinks ------------------------------------------------------

def _fixed(c: str, places: int) -> str:
    return f"CAST(CAST(round(CAST({c} AS DECIMAL(38,12)), {places}) AS DECIMAL(38,{places})) AS VARCHAR)"


_RFC = "'%Y-%m-%dT%H:%M:%SZ'"

ORACLE.update({
    "session_file_detail": with_base(f"""
        , names AS (SELECT COALESCE(NULLIF(project_path, ''), 'unknown') AS project,
                      arg_min(session_name, (ts, line_seq)) FILTER (WHERE session_name <> '') AS name FROM priced
                    GROUP BY 1),
        files AS (SELECT COALESCE(NULLIF(project_path, ''), 'unknown') AS project, source_file,
                    COALESCE(sum(input_tokens), 0) AS input_tokens, COALESCE(sum(output_tokens), 0) AS output_tokens,
                    COALESCE(sum(cache_create_tokens), 0) AS cache_create_tokens,
                    COALESCE(sum(cache_read_tokens), 0) AS cache_read_tokens,
                    sum(api_cost) AS api_cost, sum(cache_create_cost) AS cache_create_cost,
                    sum(cache_read_cost) AS cache_read_cost, sum(cost) AS cost,
                    COALESCE(string_agg(DISTINCT {model_label_sql('model')}, ';' ORDER BY {model_label_sql('model')}),
                             '') AS models,
                    max(ts) AS last_activity
                  FROM priced WHERE source_file <> '' GROUP BY 1, 2)
        SELECT f.project AS project_path, COALESCE(n.name, split_part(f.project, '/', -1)) AS session_display,
          f.source_file AS file_path, {_FILE_LABEL} AS file_label, f.models, f.input_tokens, f.output_tokens,
          f.cache_create_tokens, f.cache_read_tokens,
          f.input_tokens + f.output_tokens + f.cache_create_tokens + f.cache_read_tokens AS total_tokens,
          {_money('f.api_cost')} AS api_cost, {_money('f.cache_create_cost')} AS cache_create_cost,
          {_money('f.cache_read_cost')} AS cache_read_cost, {_money('f.cost')} AS cost,
          strftime(f.last_activity, '%Y-%m-%d %H:%M') AS last_activity, false AS all_files_fallback
        FROM files f JOIN names n USING (project)"""),
    "merge_projects": with_base("SELECT entry_id, session_id, project_path FROM usage_raw"),
    "block_time_labels": with_base(_blocks_ctes("session_id") + f"""
        , allb AS (SELECT * FROM blk UNION ALL BY NAME SELECT * FROM gaps)
        SELECT k AS session_id, block_id,
          CASE WHEN is_gap THEN CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 60000000.0 / 60) AS BIGINT) END AS gap_hours,
          CASE WHEN NOT is_gap THEN CAST(floor((epoch_us(actual_end_time) - epoch_us(start_time)) / 60000000.0 / 60) AS BIGINT) END
            AS span_hours,
          CASE WHEN NOT is_gap THEN CAST(floor((epoch_us(actual_end_time) - epoch_us(start_time)) / 60000000.0) % 60 AS BIGINT) END
            AS span_minutes,
          CASE WHEN is_active THEN CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(start_time)) / 60000000.0 / 60) AS BIGINT) END
            AS elapsed_hours,
          CASE WHEN is_active THEN CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(start_time)) / 60000000.0) % 60 AS BIGINT) END
            AS elapsed_minutes_part,
          CASE WHEN is_active THEN CAST(floor((epoch_us(end_time) - epoch_us(TIMESTAMP '{AS_OF}')) / 60000000.0 / 60) AS BIGINT) END
            AS remaining_hours,
          CASE WHEN is_active THEN CAST(floor((epoch_us(end_time) - epoch_us(TIMESTAMP '{AS_OF}')) / 60000000.0) % 60 AS BIGINT) END
            AS remaining_minutes_part
        FROM allb""", recursive=True),
    "entries_csv": with_base(f"""
        SELECT strftime(ts, {_RFC}) AS timestamp, COALESCE(model, '') AS model, COALESCE(project_path, '')
          AS project_path, input_tokens, output_tokens, total_tokens, {_fixed('cost', 6)} AS cost,
          COALESCE(session_id, '') AS session_id, COALESCE(block_type, '') AS block_type FROM priced"""),
    "block_types_csv": with_base(f"""
        SELECT block_type, count(*) AS count, COALESCE(sum(total_tokens), 0) AS total_tokens,
          {_fixed('round(sum(cost), 6)', 6)} AS total_cost, strftime(min(ts), {_RFC}) AS first_seen,
          strftime(max(ts), {_RFC}) AS last_seen FROM priced WHERE block_type <> '' GROUP BY block_type"""),
    "blocks_csv": with_base(_blocks_ctes("0") + f"""
        , allb AS (SELECT * FROM blk UNION ALL BY NAME SELECT * FROM gaps)
        SELECT block_id AS "Block ID", strftime(start_time, {_RFC}) AS "Start Time",
          strftime(end_time, {_RFC}) AS "End Time", CAST(is_active AS VARCHAR) AS "Is Active",
          CAST(is_gap AS VARCHAR) AS "Is Gap", input_tokens AS "Input Tokens", output_tokens AS "Output Tokens",
          cache_creation_input_tokens AS "Cache Creation Tokens", cache_read_input_tokens AS "Cache Read Tokens",
          total_tokens AS "Total Tokens", {_fixed('cost_usd', 2)} AS "Cost (USD)", models AS "Models",
          entry_count AS "Entry Count" FROM allb""", recursive=True),
    "sessions_csv": with_base(f"""
        SELECT COALESCE(NULLIF(project_path, ''), 'unknown') AS session_id,
          COALESCE(arg_min(session_name, (ts, line_seq)) FILTER (WHERE session_name <> ''), '') AS session_name,
          string_agg(DISTINCT NULLIF(session_id, ''), ';' ORDER BY NULLIF(session_id, '')) AS session_ids,
          string_agg(DISTINCT NULLIF(source_file, ''), ';' ORDER BY NULLIF(source_file, '')) AS source_files,
          strftime(min(ts), {_RFC}) AS start_time, strftime(max(ts), {_RFC}) AS end_time,
          CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_seconds,
          {_fixed('round(sum(cost), 6)', 6)} AS total_cost,
          {_fixed('round(sum(cache_create_cost), 6)', 6)} AS cache_create_cost,
          {_fixed('round(sum(cache_read_cost), 6)', 6)} AS cache_read_cost,
          COALESCE(sum(total_tokens), 0) AS total_tokens, count(*) AS request_count,
          COALESCE(NULLIF(project_path, ''), 'unknown') AS project_path
        FROM priced GROUP BY COALESCE(NULLIF(project_path, ''), 'unknown')"""),
    "usage_table": with_base(f"SELECT entry_id, strftime(ts, '%Y-%m-%d') AS date_key, total_tokens, "
                             f"{_money('cost')} AS cost FROM priced WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15'"),
})


# ---- project labels: the whole rule in SQL ------------------------------------------

_SYS = r"'^(Volumes?|Users?|home|var|tmp|opt|usr|bin|lib|etc|[A-Z0-9]+_[A-Z0-9]+|^\d+[A-Z]+$)$'"
_SRC = r"'(?:^|-)(?:go_)?(?:src|react_src|python_src)[_-]([A-Za-z][A-Za-z0-9_-]+)'"
_BLOG = r"'blog-([a-z]+)-([a-z]+)'"
_FOUND = f"len(list_filter(range(1, i), lambda j: ends_with(segs[j], '_src') AND NOT regexp_full_match(segs[j], {_SYS})))"

ORACLE["project_labels"] = with_base(f"""
    , paths AS (
      SELECT DISTINCT project_path FROM (
        SELECT project_path FROM usage_raw
        UNION ALL
        SELECT CASE p_partkey % 6
          WHEN 0 THEN '/home/dev/.claude/projects/-Users-' || p_type || '-' || replace(p_name, ' ', '-')
          WHEN 1 THEN '/x/projects/-Volumes-DATA_' || CAST(p_partkey % 10 AS VARCHAR) || '-'
                      || replace(p_name, ' ', '_') || '_src-' || replace(p_brand, '#', '')
          WHEN 2 THEN '/x/projects/-Users-bob-go_src-' || replace(p_name, ' ', '')
          WHEN 3 THEN '/x/projects/-Users-bob-blog-' || replace(p_name, ' ', '-')
          WHEN 4 THEN '/srv/' || p_type || '/' || replace(p_name, ' ', '-') || '/2024/01/05'
          ELSE '/x/projects/' || replace(p_brand, '#', '') || '-' || upper(replace(p_name, ' ', '-'))
               || '-longsegmentname' END FROM part)),
    l1 AS (SELECT project_path AS p, string_split(COALESCE(project_path, ''), '/') AS parts FROM paths),
    l2 AS (SELECT p, parts, list_position(parts, 'projects') AS idx FROM l1),
    l3 AS (SELECT p, CASE WHEN idx IS NOT NULL AND idx < len(parts) AND parts[idx + 1] <> '' THEN parts[idx + 1]
                          ELSE parts[-1] END AS name0 FROM l2),
    l4 AS (SELECT p, CASE WHEN starts_with(name0, '-') THEN substr(name0, 2) ELSE name0 END AS name FROM l3),
    l5 AS (SELECT p, name, string_split(name, '-') AS segs FROM l4),
    l6 AS (SELECT p, name, segs,
      list_filter(range(1, len(segs) + 1), lambda i: NOT regexp_full_match(segs[i], {_SYS})
        AND (ends_with(segs[i], '_src') OR (segs[i] = 'src' AND {_FOUND} > 0))
        AND i < len(segs) AND NOT regexp_full_match(segs[i + 1], {_SYS})) AS trig,
      list_transform(list_filter(range(1, len(segs) + 1), lambda i: NOT regexp_full_match(segs[i], {_SYS})
        AND NOT (regexp_full_match(segs[i], '^[a-z]+$') AND {_FOUND} = 0 AND length(segs[i]) < 8)
        AND length(segs[i]) > 2), lambda i: segs[i]) AS meaningful
      FROM l5)
    SELECT p AS project_path,
      CASE WHEN COALESCE(p, '') = '' OR p = 'unknown' THEN 'unknown'
           WHEN regexp_matches(name, {_SRC}) THEN 'src-' || regexp_extract(name, {_SRC}, 1)
           WHEN regexp_matches(name, {_BLOG}) THEN 'blog-' || regexp_extract(name, {_BLOG}, 1) || '-'
                || regexp_extract(name, {_BLOG}, 2)
           WHEN len(trig) > 0 THEN 'src-' || segs[trig[1] + 1]
           WHEN len(meaningful) >= 2 THEN meaningful[-2] || '-' || meaningful[-1]
           WHEN len(meaningful) = 1 THEN meaningful[1]
           ELSE segs[-1] END AS label,
      CASE WHEN COALESCE(p, '') = '' THEN 'unknown' ELSE string_split(p, '/')[-1] END AS short_name
    FROM l6""")

ORACLE.update({
    "stream_active_blocks": _load_order(with_base(_blocks_ctes("session_id") + """
        SELECT k AS session_id, block_id, entry_count, total_tokens, remaining_minutes, projected_total_tokens,
          CASE WHEN projected_total_tokens IS NOT NULL THEN
            CASE WHEN projected_total_tokens / 50000 * 100 > 100 THEN 'exceeds'
                 WHEN projected_total_tokens / 50000 * 100 > 80 THEN 'warning' ELSE 'ok' END END AS limit_status,
          CASE WHEN tpm_ind IS NULL THEN NULL WHEN tpm_ind > 1000 THEN 'HIGH' WHEN tpm_ind > 500 THEN 'MODERATE'
               ELSE 'NORMAL' END AS burn_status,
          CASE WHEN total_tokens / 50000 * 100 > 95 THEN 'red' WHEN total_tokens / 50000 * 100 > 80 THEN 'yellow'
               ELSE 'green' END AS usage_level,
          CASE WHEN projected_total_tokens IS NULL THEN NULL
               WHEN projected_total_tokens / 50000 * 100 > 100 THEN 'EXCEEDS'
               WHEN projected_total_tokens / 50000 * 100 > 90 THEN 'APPROACHING' ELSE 'WITHIN' END
            AS projection_status
        FROM projected WHERE is_active""", recursive=True)),
    "blocks_date_filtered": with_base(_blocks_ctes("session_id").replace(
        "FROM priced WHERE ts IS NOT NULL",
        "FROM priced WHERE ts IS NOT NULL AND ts >= TIMESTAMP '2024-01-10 00:00:00' "
        "AND ts < TIMESTAMP '2024-01-21 00:00:00'") + f"SELECT k AS session_id, {_BLOCK_COLS} FROM blk",
        recursive=True),
    "sessions_activity_filtered": with_base("SELECT * FROM (" + _SESSION.format(where="") + ") s "
                                            "WHERE strftime(last_activity, '%Y-%m-%d %H:%M') BETWEEN "
                                            "'2024-01-30 20:00' AND '2024-01-30 23:59'"),
    "weekly_default": _range_summary("weekly", "TIMESTAMP '2024-01-15 00:00:00'", "TIMESTAMP '2024-01-22 00:00:00'"),
})


# ---- result types ---------------------------------------------------------------------
# DuckDB sums BIGINT columns into HUGEINT; Spark keeps BIGINT.  The integer
# sums are cast back so both sides have the same column types.
_INT_SUMS = ["input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", "total_tokens",
             "n", "tokens"]


def _bigint_sums(sql: str) -> str:
    for c in _INT_SUMS:
        sql = sql.replace(f"sum({c})", f"CAST(sum({c}) AS BIGINT)")
    return sql


ORACLE.update({k: _bigint_sums(v) for k, v in ORACLE.items()})
