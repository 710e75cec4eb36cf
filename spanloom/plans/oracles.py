"""For each query, the same result in plain SQL for another engine.

Trees are walked with recursive queries here: ancestors as a closure, layouts as
position lists. That shares nothing with the Spark side's doubling.
"""

from __future__ import annotations

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {1}"


def _when(column, name=None):
    return _TS.format(column, name or column)


_EVENT_SPANS = """
e0 AS (SELECT *, event_id // 24 AS block, event_id % 24 AS k FROM events),
e1 AS (SELECT *, CASE WHEN block % 3 = 0 THEN k // 8 ELSE 0 END AS sub,
                 CASE WHEN block % 3 = 0 THEN k % 8 ELSE k END AS p FROM e0),
e2 AS (SELECT *, event_id - p + CASE WHEN block % 5 = 0 THEN p - 1 ELSE (p - 1) // 2 END AS parent,
              CASE WHEN event_id % 211 = 0 THEN NULL
                   WHEN event_id % 11 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS start_time,
              concat('agent', event_id % 3) AS receiver, concat('tool', event_id % 2) AS tool FROM e1),
spans AS (SELECT
  concat('r', block, '-', sub) AS trace_id,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat('s', event_id) END AS span_id,
  CASE WHEN p = 0 AND block % 7 = 3 THEN concat('s', event_id + 2) WHEN p = 0 THEN NULL
       WHEN event_id % 97 = 0 THEN concat('ghost-', event_id) ELSE concat('s', parent) END AS parent_span_id,
  CASE WHEN block % 2 = 0 THEN 'research-desk' ELSE 'support-bot' END AS service_name,
  CASE event_type WHEN 'signup' THEN 'orchestrator' WHEN 'purchase' THEN 'summarizer' ELSE 'search' END AS agent_name,
  CASE WHEN event_type = 'signup' THEN 'decision' WHEN event_type IN ('click', 'error') THEN 'tool_call'
       WHEN event_type = 'view' THEN 'llm_call' ELSE 'a2a_handoff' END AS step_type,
  CASE WHEN event_type = 'signup' THEN 'orchestrate' WHEN event_type IN ('click', 'error') THEN concat('search-tools.', tool)
       WHEN event_type = 'view' THEN 'extract' ELSE concat('a2a: summarizer -> ', receiver) END AS name,
  start_time,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE start_time + to_microseconds(CAST(round(value, 2) * 1000000 AS BIGINT)) END AS end_time,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN 'malformed "tool" response' END AS error_message,
  CASE WHEN event_type = 'view' THEN 'us.model-a' END AS model,
  CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS tokens_in,
  CASE WHEN event_type = 'view' THEN CAST(floor(value / 2) AS BIGINT) ELSE 0 END AS tokens_out,
  value / 200 AS cost_usd,
  CASE WHEN event_type = 'purchase' THEN concat('{"a2a.from":"summarizer","a2a.to":"', receiver, '","a2a.task":"review"}')
       WHEN event_type IN ('click', 'error') THEN concat('{"mcp.server":"search-tools","mcp.tool":"', tool, '","mcp.transport":"stdio"}')
       ELSE props END AS attributes,
  true AS redacted, ts AS ingested_at, event_id AS seq
  FROM e2)"""

_ORDER_SPANS = """
spans AS (
  SELECT concat('o', o_orderkey) AS trace_id, concat('o', o_orderkey) AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id,
    'orders' AS service_name, 'orchestrator' AS agent_name, 'decision' AS step_type, 'orchestrate' AS name,
    o_orderdate AS start_time, CAST(NULL AS TIMESTAMP) AS end_time, 'ok' AS status, CAST(NULL AS VARCHAR) AS error_message,
    0.0::DOUBLE AS duration_ms, 0.0::DOUBLE AS cost_usd, CAST(NULL AS BIGINT) AS tokens_in, CAST(NULL AS BIGINT) AS tokens_out,
    CAST(NULL AS BIGINT) AS seq
  FROM orders
  UNION ALL
  SELECT concat('o', l_orderkey), concat('o', l_orderkey, '-', l_linenumber), concat('o', l_orderkey), 'orders', 'search',
    'tool_call', concat('tool.', l_returnflag, l_linestatus), l_shipdate, NULL,
    CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END, NULL, l_quantity, l_extendedprice * l_discount / 10000,
    NULL, NULL, NULL
  FROM lineitem)"""

_CONVERSATION_SPANS = """
c0 AS (SELECT *, greatest(1, length(text) // 4) AS tokens FROM conversations),
c1 AS (SELECT *, CASE WHEN role = 'assistant' THEN 0 ELSE tokens END AS tokens_in,
                 CASE WHEN role = 'assistant' THEN tokens ELSE 0 END AS tokens_out FROM c0),
spans AS (SELECT concat('c', conv_id) AS trace_id, concat('c', conv_id, '-', turn) AS span_id, role AS agent_name, 'ok' AS status,
    CASE WHEN conv_id % 2 = 0 THEN 'anthropic.claude-haiku-4-5-20251001-v1:0' END AS base_model, tokens_in, tokens_out,
    round(tokens_in / 1000.0::DOUBLE * 0.001::DOUBLE + tokens_out / 1000.0::DOUBLE * 0.005::DOUBLE, 8) AS cost_usd,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS start_time, CAST(NULL AS TIMESTAMP) AS end_time,
    CAST(NULL AS DOUBLE) AS duration_ms
  FROM c1)"""

# The last copy of each span id.
_UNIQ = """
uniq AS (SELECT * FROM spans WHERE span_id IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY trace_id, span_id ORDER BY seq DESC NULLS LAST, start_time DESC NULLS LAST, name DESC NULLS LAST,
  status DESC NULLS LAST, duration_ms DESC NULLS LAST, cost_usd DESC NULLS LAST) = 1)"""

_NODES = f"""{_UNIQ},
keyed AS (SELECT *, row_number() OVER (PARTITION BY trace_id
            ORDER BY start_time IS NULL, start_time, coalesce(seq, 0), span_id) AS pos FROM uniq),
linked AS (SELECT k.*, q.pos AS up, k.parent_span_id IS NOT NULL AND q.pos IS NULL AS orphaned
           FROM keyed k LEFT JOIN keyed q ON q.trace_id = k.trace_id AND q.span_id = k.parent_span_id),
anc AS (SELECT trace_id, pos, up AS a FROM linked WHERE up IS NOT NULL
        UNION
        SELECT c.trace_id, c.pos, l.up FROM anc c JOIN linked l ON l.trace_id = c.trace_id AND l.pos = c.a WHERE l.up IS NOT NULL),
rooted AS (SELECT trace_id, pos FROM linked WHERE up IS NULL
           UNION
           SELECT c.trace_id, c.pos FROM anc c JOIN linked l ON l.trace_id = c.trace_id AND l.pos = c.a WHERE l.up IS NULL),
low AS (SELECT trace_id, pos, min(a) AS low FROM anc GROUP BY trace_id, pos),
eff AS (SELECT l.*, r.pos IS NULL AND l.pos <= w.low AS promoted,
          CASE WHEN r.pos IS NULL AND l.pos <= w.low THEN NULL ELSE up END AS lay_up,
          CASE WHEN r.pos IS NULL AND l.pos = w.low THEN NULL ELSE up END AS visit_up
        FROM linked l LEFT JOIN rooted r USING (trace_id, pos) LEFT JOIN low w USING (trace_id, pos)),
lay AS (SELECT trace_id, pos, [pos] AS path FROM eff WHERE lay_up IS NULL
        UNION ALL
        SELECT e.trace_id, e.pos, list_append(l.path, e.pos) FROM lay l JOIN eff e ON e.trace_id = l.trace_id AND e.lay_up = l.pos),
vis AS (SELECT trace_id, pos, [-pos] AS path FROM eff WHERE visit_up IS NULL
        UNION ALL
        SELECT e.trace_id, e.pos, list_append(v.path, -e.pos) FROM vis v JOIN eff e ON e.trace_id = v.trace_id AND e.visit_up = v.pos),
nodes AS (SELECT e.*, row_number() OVER (PARTITION BY e.trace_id ORDER BY l.path) - 1 AS order_index,
            row_number() OVER (PARTITION BY e.trace_id ORDER BY v.path) - 1 AS visit_index,
            CAST(len(l.path) - 1 AS INTEGER) AS depth
          FROM eff e JOIN lay l USING (trace_id, pos) JOIN vis v USING (trace_id, pos))"""

_COST = "CAST(coalesce(cost_usd, 0) AS DECIMAL(18,8))"
_SUMMARY = f"""
summaries AS (SELECT trace_id, CAST(sum({_COST}) AS DECIMAL(28,8)) AS total_cost,
    CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS total_tokens_in, CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS total_tokens_out,
    CAST(sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) AS BIGINT) AS total_tokens,
    CAST(sum(CAST(coalesce(duration_ms, date_diff('microsecond', start_time, end_time) / 1000.0::DOUBLE, 0) AS DECIMAL(24,6))) AS DOUBLE) AS sum_ms,
    count(*) AS step_count, count(*) FILTER (status = 'error') AS error_count,
    count(DISTINCT nullif(agent_name, '')) AS agent_count, min(start_time) AS first_start,
    max(start_time) AS last_start,
    CASE WHEN min(start_time) IS NOT NULL THEN coalesce(max(end_time), max(start_time)) END AS last_end
  FROM spans GROUP BY trace_id)"""
_SUMMARY_ROW = f"""trace_id, CAST(total_cost AS DOUBLE) AS total_cost_usd, total_tokens_in, total_tokens_out, total_tokens,
  coalesce(greatest(0.0::DOUBLE, date_diff('microsecond', first_start, last_end) / 1000.0::DOUBLE), 0.0) AS wall_clock_ms,
  round(sum_ms, 4) AS sum_step_ms, step_count, error_count, agent_count, {_when('first_start', 'start_time')}, {_when('last_end', 'end_time')}"""

_ROUND = "CAST(CAST(CAST({0} AS DECIMAL(28,8)) AS DECIMAL(28,{1})) AS DOUBLE)"
_MONEY = "CAST(CAST({0} AS DECIMAL(28,{1})) AS VARCHAR)"


def _shown(c):
    return f"coalesce({c}, 'None')"


_FINDINGS = f"""
loops AS (SELECT trace_id, agent_name, step_type, name, count(*) AS n, min(visit_index) AS first_visit
          FROM nodes GROUP BY ALL HAVING count(*) >= 5),
fails AS (SELECT trace_id, agent_name, name, count(*) AS n, min(visit_index) AS first_visit
          FROM nodes WHERE step_type = 'tool_call' AND status = 'error' GROUP BY ALL HAVING count(*) >= 3),
found AS (
  SELECT trace_id, 1 AS rule_no, 'runaway_loop' AS rule, CASE WHEN n >= 10 THEN 'critical' ELSE 'warning' END AS severity,
    concat({_shown('agent_name')}, ' repeated ''', {_shown('name')}, ''' (', {_shown('step_type')}, ') ', n, 'x (threshold 5)') AS summary,
    first_visit, agent_name, step_type, name, n AS "count", 5.0::DOUBLE AS threshold, CAST(NULL AS DOUBLE) AS total_cost_usd FROM loops
  UNION ALL
  SELECT trace_id, 2, 'repeated_tool_failure', CASE WHEN n >= 6 THEN 'critical' ELSE 'warning' END,
    concat({_shown('agent_name')}, '''s tool ''', {_shown('name')}, ''' failed ', n, 'x (threshold 3)'),
    first_visit, agent_name, NULL, name, n, 3.0, NULL FROM fails
  UNION ALL
  SELECT trace_id, 3, 'cost_spike', CASE WHEN total_cost > 2 THEN 'critical' ELSE 'warning' END,
    concat('run cost $', {_MONEY.format('total_cost', 4)}, ' exceeded limit $1.0000'),
    0, NULL, NULL, NULL, NULL, 1.0, CAST(total_cost AS DOUBLE) FROM summaries WHERE total_cost > 1)"""
_FINDING_ROW = 'trace_id, rule_no, rule, severity, summary, first_visit, "count", threshold, total_cost_usd'

_EVIDENCE = """
tops AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY cost_usd DESC, visit_index) AS cost_rank
         FROM nodes WHERE cost_usd > 0 QUALIFY cost_rank <= 3),
evidence AS (
  SELECT f.trace_id, f.rule, f.first_visit, n.visit_index, n.span_id, n.error_message, n.cost_usd
  FROM found f JOIN nodes n ON n.trace_id = f.trace_id AND n.agent_name = f.agent_name AND n.name = f.name AND n.step_type = f.step_type
  WHERE f.rule_no = 1
  UNION ALL
  SELECT f.trace_id, f.rule, f.first_visit, n.visit_index, n.span_id, n.error_message, n.cost_usd
  FROM found f JOIN nodes n ON n.trace_id = f.trace_id AND n.agent_name = f.agent_name AND n.name = f.name
  WHERE f.rule_no = 2 AND n.step_type = 'tool_call' AND n.status = 'error'
  UNION ALL
  SELECT f.trace_id, f.rule, f.first_visit, t.cost_rank - 1, t.span_id, t.error_message, t.cost_usd
  FROM found f JOIN tops t ON t.trace_id = f.trace_id WHERE f.rule_no = 3),
documents AS (
  SELECT f.*, coalesce(ids, '') AS span_ids, first_error, first_span
  FROM found f LEFT JOIN (
    SELECT trace_id, rule, first_visit, string_agg(span_id, ',' ORDER BY visit_index) AS ids,
      arg_min(error_message, visit_index) AS first_error, arg_min(span_id, visit_index) AS first_span
    FROM evidence GROUP BY ALL) USING (trace_id, rule, first_visit))"""

_STARTS = "starts AS (SELECT trace_id, max(start_time) AS last_start FROM spans GROUP BY trace_id)"
_NEW_YORK = "timezone('America/New_York', timezone('UTC', max(start_time)))"
_RUNS = f"""
runs AS (SELECT trace_id, service_name,
    concat(service_name, ' · ', CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'fail' ELSE 'ok' END, ' · ',
           strftime({_NEW_YORK}, '%H:%M:%S')) AS run,
    count(*) AS steps, CAST(CAST(sum({_COST}) AS DECIMAL(28,4)) AS DOUBLE) AS cost_usd,
    count(*) FILTER (status = 'error') AS errors, max(start_time) AS seen
  FROM spans GROUP BY trace_id, service_name)"""
_RUN_ROW = f"trace_id, service_name, run, steps, cost_usd, errors, {_when('seen', 'last_seen')}"
_NEWEST = "ORDER BY seen DESC NULLS LAST, trace_id, service_name"

_LAST = f"""{_STARTS},
lastrun AS (SELECT trace_id FROM starts ORDER BY last_start DESC NULLS LAST, trace_id DESC LIMIT 1),
gauges AS (SELECT trace_id, CAST(total_cost AS DOUBLE) AS last_run_cost_usd,
    coalesce((SELECT max("count") FROM found f WHERE f.rule_no = 1 AND f.trace_id = s.trace_id), 0) AS last_run_loops,
    coalesce((SELECT max("count") FROM found f WHERE f.rule_no = 2 AND f.trace_id = s.trace_id), 0) AS last_run_tool_failures
  FROM summaries s WHERE trace_id IN (SELECT trace_id FROM lastrun))"""


_SESSIONS = """
sessions AS (SELECT trace_id, count(*) AS spans, max(ingested_at) AS last_arrival FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY ingested_at, seq) AS session FROM (
      SELECT *, CASE WHEN ingested_at >= lag(ingested_at) OVER (PARTITION BY trace_id ORDER BY ingested_at, seq) + INTERVAL 20 MINUTE
                     THEN 1 ELSE 0 END AS fresh FROM spans))
  GROUP BY trace_id, session)"""

# After batch k of three, with what arrived by then.
_SETTLED = """
arrived AS (SELECT k, trace_id, max(ingested_at) AS last_arrival FROM spans, range(1, 4) b(k) WHERE seq % 3 < k GROUP BY ALL),
settled AS (SELECT DISTINCT trace_id FROM arrived JOIN (SELECT k, max(last_arrival) AS now FROM arrived GROUP BY k) USING (k)
  WHERE last_arrival + INTERVAL 20 MINUTE <= now)"""


def _attr(key):
    return f"""coalesce(json_extract_string(attributes, '$."{key}"'), '')"""


_DETAIL = f"""CASE WHEN step_type = 'a2a_handoff' THEN concat({_attr('a2a.from')}, ' → ', {_attr('a2a.to')})
  WHEN step_type = 'tool_call' THEN concat({_attr('mcp.server')}, '.', {_attr('mcp.tool')}) ELSE '' END"""
_LINE = f"""concat(repeat('  ', depth), CASE WHEN depth > 0 THEN '+- ' ELSE '' END, CASE WHEN status = 'error' THEN 'x ' ELSE '* ' END,
  agent_name, ' | ', step_type, ' | ', name, ' ($', {_MONEY.format('CAST(cost_usd AS DECIMAL(28,8))', 4)}, ', ',
  coalesce(CAST(CAST(round_even(duration_ms, 0) AS BIGINT) AS VARCHAR) || 'ms', '...'), ')', CASE WHEN orphaned THEN '  [ORPHAN]' ELSE '' END)"""
_BOX = f"""concat('[', order_index + 1, '. ', step_type, ' | ', agent_name, ' | ', replace(name, '->', '→'), ' | ',
  {_MONEY.format('CAST(coalesce(duration_ms, 0) AS DECIMAL(28,8))', 1)}, ' ms | $', {_MONEY.format('CAST(cost_usd AS DECIMAL(28,8))', 6)}, ' | ',
  CASE WHEN status = 'error' THEN 'ERROR' ELSE 'ok' END,
  CASE WHEN status = 'error' AND coalesce(error_message, '') <> '' THEN concat(': ', replace(replace(error_message, '"', ''''), chr(10), ' ')) ELSE '' END, ']')"""
_RULE = "=" * 60

# What each kind of message is worth: kinds 1, 3 (explicitly absent cost is
# fine), 4, 5, 6 and 7 are the ones that were tampered with.
_GOOD = "seq % 50 NOT IN (1, 4, 5, 6, 7) AND start_time IS NOT NULL"
_INGESTED = f"""trace_id, coalesce(span_id, concat('s', seq)) AS span_id, parent_span_id, step_type, status, {_when('start_time')}, {_when('end_time')},
  CASE WHEN seq % 50 = 2 THEN 12 ELSE tokens_in END AS tokens_in, tokens_out,
  CASE WHEN seq % 50 = 3 THEN 0.0::DOUBLE ELSE CAST(printf('%.5f', cost_usd) AS DOUBLE) END AS cost_usd,
  json_extract_string(attributes, '$."mcp.tool"') AS tool, redacted, seq"""

_SECRETS = r"(sk-[A-Za-z0-9_\-]{16,})|(AKIA[0-9A-Z]{16})|((?i:bearer)\s+[A-Za-z0-9._\-]{8,})|(AIza[0-9A-Za-z_\-]{20,})|(ghp_[A-Za-z0-9]{20,})|(xox[baprs]-[A-Za-z0-9\-]{10,})"
_DENIED = "password|passwd|secret|token|apikey|accesskey|secretkey|authorization|credential|privatekey|sessionid"


def _sql(select: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}" if ctes else select


E, O, C, N, S, F, V = _EVENT_SPANS, _ORDER_SPANS, _CONVERSATION_SPANS, _NODES, _SUMMARY, _FINDINGS, _EVIDENCE

_HEAD_LINE = """SELECT trace_id, 0 AS rule_no, 0 AS first_visit, CAST(0 AS BIGINT) AS part,
  CASE WHEN n IS NULL THEN concat('Trace ', trace_id, ': clean — no findings.') ELSE concat('Trace ', trace_id, ': ', n, ' finding(s)') END AS line
  FROM summaries LEFT JOIN (SELECT trace_id, count(*) AS n FROM found GROUP BY trace_id) USING (trace_id)"""
_TREE = f"""SELECT trace_id, 1 AS section, CAST(0 AS BIGINT) AS part, string_agg({_LINE}, chr(10) ORDER BY order_index) AS text FROM nodes GROUP BY trace_id"""
_HANDOFF_EVENTS = "SELECT event_id, concat('u', user_id % 7) AS agent_name, 'a2a_handoff' AS step_type, concat('a2a: u', user_id % 7, ' -> ', event_type) AS name, concat('u', user_id % 7) AS a2a_from, event_type AS a2a_to, CASE WHEN event_id % 2 = 0 THEN 'review' END AS a2a_task, CAST(NULL AS VARCHAR) AS a2a_task_id FROM events"

ORACLES = {
    "span_view": _sql(
        f"""SELECT trace_id, span_id, parent_span_id, service_name, agent_name, step_type, name, {_when('start_time')}, {_when('end_time')},
        duration_ms, status, error_message, model, tokens_in, tokens_out, cost_usd, attributes, redacted, {_when('ingested_at')}, seq FROM spans""", E),
    "run_summary": _sql(f"SELECT {_SUMMARY_ROW} FROM summaries", E, S),
    "run_summary_orders": _sql(f"SELECT {_SUMMARY_ROW} FROM summaries", O, S),
    "span_last_copy": _sql(f"SELECT trace_id, span_id, {_when('start_time')}, name, status, duration_ms, cost_usd FROM uniq", O, _UNIQ),
    "contract_violations": _sql(
        """SELECT * FROM (SELECT 'span_id: missing' AS violation, count(*) FILTER (span_id IS NULL) AS spans FROM spans
        UNION ALL SELECT 'start_time: missing', count(*) FILTER (start_time IS NULL) FROM spans) WHERE spans > 0""", E),
    "tree_nodes": _sql("SELECT trace_id, span_id, parent_span_id, order_index, visit_index, depth, orphaned, coalesce(promoted, false) AS promoted FROM nodes", E, N),
    "tree_nodes_orders": _sql("SELECT trace_id, span_id, parent_span_id, order_index, visit_index, depth, orphaned, coalesce(promoted, false) AS promoted FROM nodes", O, N),
    # A root is promoted when its spans lie on a cycle or below one.
    "walked_places": _sql(
        """SELECT n.trace_id, n.span_id, n.depth, r.span_id AS root_id, n.depth + 1 AS steps
        FROM (SELECT *, max(CASE WHEN depth = 0 THEN order_index END) OVER (PARTITION BY trace_id ORDER BY order_index) AS root_at FROM nodes) n
        JOIN nodes r ON r.trace_id = n.trace_id AND r.order_index = n.root_at WHERE NOT coalesce(r.promoted, false)""", E, N),
    "orphans_anti_join": _sql(
        """SELECT trace_id, span_id, parent_span_id FROM spans s WHERE span_id IS NOT NULL AND parent_span_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM spans q WHERE q.trace_id = s.trace_id AND q.span_id = s.parent_span_id)""", E),
    "orphan_list": _sql("SELECT trace_id, span_id, order_index FROM nodes WHERE orphaned", E, N),
    "node_table_rows": _sql(
        """SELECT trace_id, span_id, parent_span_id, order_index, depth, agent_name, step_type, name, coalesce(duration_ms, 0) AS duration_ms,
        cost_usd, status, error_message, attributes, orphaned FROM nodes""", E, N),
    "node_latest_version": _sql("SELECT status, depth, count(*) AS nodes, CAST(sum(order_index) AS BIGINT) AS order_sum FROM nodes GROUP BY status, depth", E, N),
    "runaway_loops": _sql(f"SELECT {_FINDING_ROW} FROM found WHERE rule_no = 1", E, N, S, F),
    "tool_failures": _sql(f"SELECT {_FINDING_ROW} FROM found WHERE rule_no = 2", E, N, S, F),
    "cost_spikes": _sql(f"SELECT {_FINDING_ROW} FROM found WHERE rule_no = 3", E, N, S, F),
    "findings": _sql(f"SELECT {_FINDING_ROW} FROM found", E, N, S, F),
    "findings_orders": _sql(f"SELECT {_FINDING_ROW} FROM found", O, N, S, F),
    "added_rule": _sql(
        """SELECT trace_id, CAST(list_position(['runaway_loop', 'repeated_tool_failure', 'cost_spike'], rule) AS INTEGER) AS rule_no, rule, severity, first_visit,
          CAST("count" AS BIGINT) AS "count" FROM found
        UNION ALL SELECT trace_id, 4, 'many_errors', CASE WHEN count(*) > 4 THEN 'critical' ELSE 'warning' END, min(visit_index), count(*)
        FROM nodes WHERE status = 'error' GROUP BY trace_id HAVING count(*) > 3""", E, N, S, F),
    "failed_tool_calls": _sql("SELECT trace_id, span_id, agent_name, name, error_message FROM spans WHERE step_type = 'tool_call' AND status = 'error'", E),
    "top_spans": _sql("SELECT trace_id, CAST(cost_rank AS INTEGER) AS cost_rank, span_id, cost_usd FROM tops", E, N, S, F, V),
    "evidence_spans": _sql("SELECT trace_id, rule, first_visit, visit_index, span_id, error_message, cost_usd FROM evidence", E, N, S, F, V),
    "finding_documents": _sql(
        """SELECT trace_id, rule, severity, first_visit, CAST(0 AS BIGINT) AS part, span_ids, "count" AS evidence_count,
        CASE WHEN rule_no = 2 THEN name END AS evidence_tool, CASE WHEN rule_no = 2 THEN first_error END AS first_error,
        CASE WHEN rule_no = 3 THEN first_span END AS priciest FROM documents""", E, N, S, F, V),
    "finding_json": _sql("SELECT trace_id, rule, severity, summary, first_span FROM documents", E, N, S, F, V),
    "finding_lines": _sql(
        f"""{_HEAD_LINE} UNION ALL SELECT trace_id, rule_no, first_visit, CAST(0 AS BIGINT),
        concat('  [', rpad(upper(severity), 8, ' '), '] ', rule, ': ', summary, chr(10), '             spans: ', replace(span_ids, ',', ', ')) FROM documents""",
        E, N, S, F, V),
    "one_shot_score": _sql(f"SELECT {_FINDING_ROW} FROM found WHERE trace_id IN (SELECT trace_id FROM lastrun)", E, N, S, F, _LAST),
    "findings_by_severity": _sql(
        """SELECT r.rule, s.severity, count(f.trace_id) AS findings
        FROM (VALUES ('runaway_loop'), ('repeated_tool_failure'), ('cost_spike')) r(rule) CROSS JOIN (VALUES ('warning'), ('critical')) s(severity)
        LEFT JOIN found f ON f.rule = r.rule AND f.severity = s.severity GROUP BY r.rule, s.severity""", E, N, S, F),
    "critical_findings": _sql("SELECT count(*) FILTER (severity = 'critical') AS critical_findings FROM found", E, N, S, F),
    "findings_over_time": _sql(
        f"""SELECT rule, {_when('day', 'interval_start')}, findings, CAST(sum(findings) OVER (PARTITION BY rule ORDER BY day NULLS FIRST) AS BIGINT) AS findings_total
        FROM (SELECT rule, date_trunc('day', last_start)::TIMESTAMP AS day, count(*) AS findings FROM found LEFT JOIN starts USING (trace_id) GROUP BY ALL)""", E, N, S, F, _STARTS),
    "runs_evaluated": _sql("SELECT count(*) AS runs_evaluated FROM summaries", E, S),
    "cost_histogram": _sql(
        """SELECT le, count(*) FILTER (total_cost <= bound) AS runs, count(*) AS run_count, round(CAST(sum(total_cost) AS DOUBLE), 6) AS cost_sum
        FROM summaries CROSS JOIN (VALUES ('0.01', 0.01), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0),
          ('2.0', 2.0), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 1e12)) b(le, bound) GROUP BY le""", E, S),
    "last_run_gauges": _sql("SELECT * FROM gauges", E, N, S, F, _LAST),
    "run_costs_over_time": _sql(f"SELECT {_when('last_end', 'time')}, trace_id, CAST(total_cost AS DOUBLE) AS run_cost_usd FROM summaries", E, S),
    "alarm_levels": _sql(
        """SELECT CASE WHEN n >= 1 THEN 'red' ELSE 'green' END AS critical_findings,
        CASE WHEN last_run_cost_usd >= 1 THEN 'red' ELSE 'green' END AS last_run_cost,
        CASE WHEN last_run_loops >= 10 THEN 'red' WHEN last_run_loops >= 5 THEN 'orange' ELSE 'green' END AS last_run_loops,
        CASE WHEN last_run_tool_failures >= 6 THEN 'red' WHEN last_run_tool_failures >= 3 THEN 'orange' ELSE 'green' END AS last_run_tool_failures
        FROM gauges CROSS JOIN (SELECT count(*) FILTER (severity = 'critical') AS n FROM found)""", E, N, S, F, _LAST),
    "recent_runs_table": _sql(f"SELECT {_RUN_ROW} FROM runs {_NEWEST} LIMIT 30", E, _RUNS),
    "all_runs_table": _sql(f"SELECT {_RUN_ROW} FROM runs", O, _RUNS),
    "run_selector": _sql(
        f"SELECT trace_id, service_name, run, {_when('seen', 'last_seen')} FROM runs WHERE trace_id IN (SELECT trace_id FROM spans WHERE status = 'error') {_NEWEST} LIMIT 50", E, _RUNS),
    "spans_of_failed_labels": _sql(
        """SELECT trace_id, count(*) AS spans, count(*) FILTER (status = 'error') AS errors FROM spans
        WHERE (trace_id, service_name) IN (SELECT (trace_id, service_name) FROM runs WHERE run LIKE '% · fail · %') GROUP BY trace_id""", E, _RUNS),
    "runs_of_newest_label": _sql(f"SELECT trace_id, run FROM runs WHERE run = (SELECT run FROM runs {_NEWEST} LIMIT 1)", E, _RUNS),
    "recent_traces": _sql(f"SELECT trace_id, {_when('last_start')} FROM (SELECT * FROM starts ORDER BY last_start DESC NULLS LAST, trace_id DESC LIMIT 50)", E, _STARTS),
    "recent_spans": _sql(
        f"""SELECT {_when('start_time')}, agent_name, step_type, name, status, {_ROUND.format('cost_usd', 4)} AS cost_usd
        FROM (SELECT * FROM spans ORDER BY start_time DESC NULLS LAST, trace_id, span_id NULLS LAST, seq LIMIT 50)""", E),
    "run_timeline": _sql(
        f"""SELECT trace_id, span_id, {_when('start_time', 'time')}, CASE WHEN status = 'ok' THEN {_ROUND.format('duration_ms', 2)} END AS ok,
        CASE WHEN status = 'error' THEN {_ROUND.format('duration_ms', 2)} END AS error FROM spans""", E),
    "run_detail": _sql(
        f"""SELECT trace_id, order_index, concat(repeat('    ', depth), name) AS step, agent_name, step_type, {_DETAIL} AS detail,
        {_ROUND.format('coalesce(duration_ms, 0)', 1)} AS duration_ms, {_ROUND.format('cost_usd', 6)} AS cost_usd, status, attributes FROM nodes""", E, N),
    "sequence_strip": _sql(f"SELECT trace_id, CAST(0 AS BIGINT) AS part, string_agg({_BOX}, ' → ' ORDER BY order_index) AS strip FROM nodes GROUP BY trace_id", E, N),
    "tree_lines": _sql(f"SELECT trace_id, order_index, {_LINE} AS line FROM nodes", E, N),
    "run_text": _sql(
        f"""SELECT trace_id, 0 AS section, CAST(0 AS BIGINT) AS part, concat('Trace ', trace_id, ' -- ', count(*), ' spans', chr(10), '{_RULE}') AS text FROM nodes GROUP BY trace_id
        UNION ALL {_TREE}
        UNION ALL SELECT trace_id, 2, CAST(0 AS BIGINT), concat('{_RULE}', chr(10), 'cost $', {_MONEY.format('total_cost', 4)}, ' | ', total_tokens, ' tokens (', total_tokens_in,
          ' in / ', total_tokens_out, ' out)', chr(10), 'wall-clock ',
          CAST(round_even(coalesce(greatest(0.0::DOUBLE, date_diff('microsecond', first_start, last_end) / 1000.0::DOUBLE), 0.0), 0) AS BIGINT), 'ms | compute ',
          CAST(round_even(sum_ms, 0) AS BIGINT), 'ms | ', step_count, ' steps | ', agent_count, ' agents | ', error_count, ' errors') FROM summaries
        UNION ALL SELECT trace_id, 3, CAST(0 AS BIGINT), concat('orphaned spans (missing parent): ', string_agg(span_id, ', ' ORDER BY order_index)) FROM nodes WHERE orphaned GROUP BY trace_id""",
        E, N, S),
    "run_json": _sql(
        """SELECT trace_id, CAST(0 AS BIGINT) AS part, count(*) AS span_count, any_value(step_count) AS step_count, count(*) FILTER (orphaned) AS orphans,
        count(*) FILTER (depth = 0) AS roots, max(span_id) FILTER (order_index = 0) AS first_root,
        max(span_id) FILTER (order_index = 1 AND depth = 1) AS first_child,
        max(span_id) FILTER (order_index = 2 AND depth = 2) AS first_grandchild, count(*) AS nodes
        FROM nodes JOIN summaries USING (trace_id) GROUP BY trace_id""", E, N, S),
    "arrivals": _sql("SELECT count(*) AS spans, count(DISTINCT trace_id) AS runs FROM spans WHERE service_name = 'support-bot' AND ingested_at >= TIMESTAMP '2024-01-10 00:00:00'", E),
    "handoff_edges": _sql(
        f"""SELECT trace_id, {_attr('a2a.from')} AS from_agent, {_attr('a2a.to')} AS to_agent, count(*) AS handoffs, count(*) FILTER (status = 'error') AS failed
        FROM spans WHERE step_type = 'a2a_handoff' GROUP BY ALL""", E),
    "tool_usage": _sql(
        f"""SELECT server, tool, transport, count(*) AS calls, count(*) FILTER (status = 'error') AS failed,
        round(CAST(sum(CAST(coalesce(duration_ms, 0) AS DECIMAL(24,6))) AS DOUBLE), 4) AS total_ms, concat(server, '.', tool) AS label
        FROM (SELECT *, {_attr('mcp.server')} AS server, {_attr('mcp.tool')} AS tool, {_attr('mcp.transport')} AS transport FROM spans WHERE step_type = 'tool_call')
        GROUP BY server, tool, transport""", E),
    "stamped_handoffs": _HANDOFF_EVENTS,
    "stamped_tool_calls": """SELECT event_id, 'search' AS agent_name, 'tool_call' AS step_type,
        CASE WHEN event_id % 5 = 0 THEN 'custom' ELSE concat(event_type, '.t', user_id % 7) END AS name,
        event_type AS mcp_server, concat('t', user_id % 7) AS mcp_tool, 'stdio' AS mcp_transport FROM events""",
    "ingest_good": _sql(f"SELECT {_INGESTED} FROM spans WHERE {_GOOD}", E),
    "stream_ingest": _sql(f"SELECT {_INGESTED} FROM spans WHERE {_GOOD}", E),
    "ingest_quarantine": _sql(
        f"""SELECT seq, CASE WHEN seq % 50 IN (4, 5) THEN 'not a JSON object' WHEN seq % 50 = 7 THEN 'agent_name: missing'
          WHEN start_time IS NULL THEN 'start_time: missing' WHEN seq % 50 = 1 THEN 'tokens_in: not an integer'
          ELSE 'tokens_out: not an integer' END AS reason FROM spans WHERE NOT ({_GOOD})""", E),
    "stream_quarantine": _sql(
        f"""SELECT seq, CASE WHEN seq % 50 IN (4, 5) THEN 'not a JSON object' WHEN seq % 50 = 7 THEN 'agent_name: missing'
          WHEN start_time IS NULL THEN 'start_time: missing' WHEN seq % 50 = 1 THEN 'tokens_in: not an integer'
          ELSE 'tokens_out: not an integer' END AS reason FROM spans WHERE NOT ({_GOOD})""", E),
    "store_versions": _sql(
        f"""SELECT version, folders, count(*) AS spans, count(DISTINCT trace_id) AS runs, CAST(sum(seq) AS BIGINT) AS seq_sum
        FROM spans CROSS JOIN (VALUES ('batches', CAST(4 AS BIGINT)), ('merged', 1)) v(version, folders) WHERE {_GOOD} GROUP BY version, folders""", E),
    "stream_without_repeats": _sql("SELECT trace_id, span_id, seq FROM spans WHERE span_id IS NOT NULL", E),
    "topic_messages": _sql(
        """SELECT trace_id AS key, span_id, status, json_extract_string(attributes, '$."mcp.tool"') AS tool,
        strftime(start_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS start_time FROM spans""", E),
    "span_table_by_day": _sql(
        """SELECT strftime(start_time, '%Y-%m-%d') AS day, count(*) AS spans, count(DISTINCT trace_id) AS runs FROM spans
        WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-21' GROUP BY ALL""", E),
    "newest_run_spans": _sql(
        f"""SELECT trace_id, span_id, {_when('start_time')}, CAST(len(json_keys(attributes)) AS BIGINT) AS n_attributes,
        json_extract_string(attributes, '$."mcp.tool"') AS tool, redacted FROM spans
        WHERE trace_id = (SELECT trace_id FROM starts ORDER BY last_start DESC NULLS LAST, trace_id DESC LIMIT 1)""", E, _STARTS),
    "new_minus_scored": _sql(
        "SELECT DISTINCT trace_id FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM starts WHERE last_start < TIMESTAMP '2024-01-15')", E, _STARTS),
    "late_after_score": _sql(
        """SELECT trace_id, count(*) AS late_after_score FROM spans JOIN
        (SELECT trace_id, min(ingested_at) + INTERVAL 30 MINUTE AS scored_at FROM spans GROUP BY trace_id) USING (trace_id)
        WHERE ingested_at > scored_at GROUP BY trace_id""", E),
    "settled_sessions": _sql(f"SELECT trace_id, spans, {_when('last_arrival')} FROM sessions", E, _SESSIONS),
    # A run has settled once the newest arrival of all is long past its own last one.
    "stream_watch": _sql(
        """SELECT trace_id, rule, severity, first_visit, "count" FROM found WHERE trace_id IN (SELECT trace_id FROM spans
        GROUP BY trace_id HAVING max(ingested_at) + INTERVAL 20 MINUTE <= (SELECT max(ingested_at) FROM spans))""", E, N, S, F),
    "stream_watch_batches": _sql(
        """SELECT trace_id, rule, severity, first_visit, "count" FROM found WHERE trace_id IN (SELECT trace_id FROM settled)""",
        E, N, S, F, _SETTLED),
    "watch_timers": _sql("""SELECT trace_id, rule, severity, first_visit, "count" FROM found""", E, N, S, F),
    "watch_ignoring_existing": _sql(
        """SELECT trace_id, bool_or(seq < 24 * 100) AS ignored FROM spans GROUP BY trace_id
        HAVING bool_or(seq < 24 * 100) OR max(ingested_at) + INTERVAL 20 MINUTE <= (SELECT max(ingested_at) FROM spans)""", E),
    "node_table_snapshots": _sql(
        """SELECT step, written, count(*) AS nodes, CAST(sum(order_index) AS BIGINT) AS places FROM (
          SELECT order_index, step, CASE WHEN step = 3 AND order_index % 5 = 0 THEN 'third' WHEN step > 0 AND order_index % 3 = 0 THEN 'second' ELSE 'first' END AS written
          FROM nodes CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (1), (2), (3)) t(step)) GROUP BY step, written""", E, N),
    "stored_run_costs": _sql(
        """SELECT le, count(*) FILTER (total_cost <= bound) AS runs, count(*) AS run_count, round(CAST(sum(total_cost) AS DOUBLE), 6) AS cost_sum
        FROM (SELECT * FROM summaries WHERE trace_id IN (SELECT trace_id FROM settled))
        CROSS JOIN (VALUES ('0.01', 0.01), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0),
          ('2.0', 2.0), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 1e12)) b(le, bound) GROUP BY le""", E, S, _SETTLED),
    "kept_findings_by_severity": _sql(
        """SELECT r.rule, s.severity, count(f.trace_id) AS findings
        FROM (VALUES ('runaway_loop'), ('repeated_tool_failure'), ('cost_spike')) r(rule) CROSS JOIN (VALUES ('warning'), ('critical')) s(severity)
        LEFT JOIN (SELECT * FROM found WHERE trace_id IN (SELECT trace_id FROM settled)) f ON f.rule = r.rule AND f.severity = s.severity
        GROUP BY r.rule, s.severity""", E, N, S, F, _SETTLED),
    "kept_findings_over_time": _sql(
        f"""SELECT rule, {_when('day', 'interval_start')}, findings, CAST(sum(findings) OVER (PARTITION BY rule ORDER BY day NULLS FIRST) AS BIGINT) AS findings_total
        FROM (SELECT rule, date_trunc('day', last_start)::TIMESTAMP AS day, count(*) AS findings FROM found JOIN settled USING (trace_id)
              LEFT JOIN starts USING (trace_id) GROUP BY ALL)""", E, N, S, F, _STARTS, _SETTLED),
    "kept_cost_histogram": _sql(
        """SELECT le, count(*) FILTER (total_cost <= bound) AS runs, count(*) AS run_count, round(CAST(sum(total_cost) AS DOUBLE), 6) AS cost_sum
        FROM (SELECT * FROM summaries WHERE trace_id IN (SELECT trace_id FROM settled))
        CROSS JOIN (VALUES ('0.01', 0.01), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0),
          ('2.0', 2.0), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 1e12)) b(le, bound) GROUP BY le""", E, S, _SETTLED),
    "kept_gauges": _sql(
        """SELECT trace_id, CAST(total_cost AS DOUBLE) AS last_run_cost_usd,
          coalesce((SELECT max("count") FROM found f WHERE f.rule_no = 1 AND f.trace_id = s.trace_id), 0) AS last_run_loops,
          coalesce((SELECT max("count") FROM found f WHERE f.rule_no = 2 AND f.trace_id = s.trace_id), 0) AS last_run_tool_failures,
          (SELECT count(*) FILTER (severity = 'critical') FROM found JOIN settled USING (trace_id)) AS critical_findings,
          (SELECT count(*) FROM settled) AS runs_evaluated
        FROM summaries s WHERE trace_id IN (SELECT trace_id FROM starts JOIN settled USING (trace_id) ORDER BY last_start DESC NULLS LAST, trace_id DESC LIMIT 1)""",
        E, N, S, F, _STARTS, _SETTLED),
    "conversation_costs": _sql("SELECT trace_id, span_id, base_model, tokens_in, tokens_out, cost_usd FROM spans", C),
    "conversation_summary": _sql(f"SELECT {_SUMMARY_ROW} FROM summaries", C, S),
    "redacted_documents": f"""SELECT doc_id, sha256(CASE WHEN hit THEN '[REDACTED]' ELSE text END) AS text_hash, hit AS blanked
        FROM (SELECT *, regexp_matches(text, '{_SECRETS}|(token = "[^"]+")') AS hit FROM documents)""",
    "redacted_messages": f"""SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(t, '{_SECRETS}') THEN '[REDACTED]' ELSE t END) AS text_hash
        FROM (SELECT *, concat(text, ' ', CASE conv_id % 6 WHEN 0 THEN concat('sk-', repeat('aB3_', 6)) WHEN 1 THEN concat('AKIA', repeat('Z9', 8))
          WHEN 2 THEN concat('bEaReR ', chr(9), ' abcd.efgh-ijkl') WHEN 3 THEN concat('ghp_', repeat('x1', 9)) WHEN 4 THEN concat('xoxb-', repeat('12-', 4)) ELSE '' END) AS t
          FROM conversations)""",
    "sensitive_keys": f"""SELECT key, regexp_matches(regexp_replace(lower(key), '[^a-z0-9]', '', 'g'), '{_DENIED}|signupi') AS sensitive, count(*) AS n
        FROM (SELECT concat(event_type, CASE event_id % 5 WHEN 0 THEN 'Token' WHEN 1 THEN '-API-Key' WHEN 2 THEN '_count' WHEN 3 THEN ' passwd' ELSE '_id' END) AS key FROM events)
        GROUP BY ALL""",
    "redacted_map": """SELECT event_id, '[REDACTED]' AS user_password, CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' ELSE props END AS note, event_type AS kind FROM events""",
    "redacted_hard_json": """SELECT event_id, FALSE AS leaks, CAST(CASE WHEN event_id % 3 = 0 THEN 5000 ELSE 0 END AS BIGINT) AS digits,
        CAST(CASE WHEN event_id % 3 = 1 THEN 40 ELSE 0 END AS BIGINT) AS levels FROM events""",
    "redacted_nested_json": """SELECT event_id, event_type AS name, '[REDACTED]' AS session,
        CASE WHEN event_id % 4 = 0 THEN '[REDACTED]' ELSE 'plain' END AS tag, CASE WHEN event_id % 5 = 0 THEN '[REDACTED]' ELSE 'inner' END AS inner_tag,
        CAST(user_id AS VARCHAR) AS n FROM events""",
}
