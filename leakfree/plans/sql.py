"""DuckDB twins of the bindings, used to write the SQL oracles.

Each entry is a CTE body over the pre-registered views (orders, customer, events, ...).
``with_ctes(body, names)`` prepends the named CTEs in dependency order.
"""

from __future__ import annotations


def h(expr: str, seed: int = 42) -> str:
    """DuckDB replay of ``seeded_hash``."""
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR) || '-{seed}'), 1, 8)) AS BIGINT)"


CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, body: str, deps: list[str] | None = None) -> None:
    CTES[name] = body
    DEPS[name] = deps or []


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    return f"WITH {parts}\n{body}"


cte("train", """
SELECT o.o_orderkey AS row_id, o.o_custkey AS grp, o.o_orderdate AS order_date,
       o.o_orderpriority AS cat,
       CASE WHEN o.o_orderkey % 13 <> 0 THEN o.o_orderpriority END AS cat_missing,
       c.c_mktsegment AS segment, c.c_acctbal AS x_acct,
       CASE WHEN o.o_orderkey % 7 <> 0 THEN c.c_acctbal END AS x_acct_missing,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) AS DOUBLE) AS x_days,
       o.o_totalprice AS y_reg, CAST(o.o_orderstatus = 'F' AS INTEGER) AS y_bin,
       CASE o.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_cls
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")

# k-fold over a seeded permutation: contiguous blocks, first n % 5 folds one larger
cte("kf", f"""
SELECT * EXCLUDE (r, q, m),
       CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS BIGINT) AS fold
FROM (SELECT *, row_number() OVER (ORDER BY {h('row_id')}, row_id) - 1 AS r,
             count(*) OVER () // 5 AS q, count(*) OVER () % 5 AS m
      FROM train)""", ["train"])

cte("skf", f"""
SELECT * EXCLUDE (r), CAST(r % 5 AS BIGINT) AS fold
FROM (SELECT *, row_number() OVER (ORDER BY y_cls, {h('row_id')}, row_id) - 1 AS r FROM train)""",
    ["train"])

cte("tsf", """
SELECT * EXCLUDE (r, ts, warm),
       CAST(CASE WHEN r < warm THEN -1 ELSE (r - warm) // ts END AS BIGINT) AS fold
FROM (SELECT *, row_number() OVER (ORDER BY order_date, row_id) - 1 AS r,
             count(*) OVER () // 6 AS ts, count(*) OVER () - 5 * (count(*) OVER () // 6) AS warm
      FROM train)""", ["train"])

# journal binding: events → tool records (odd seq) + checkpoint records before submits (even seq)
_TOOL = """CASE event_type
    WHEN 'click' THEN CASE WHEN event_id % 50 = 0 THEN 'done' ELSE 'read_file' END
    WHEN 'view' THEN 'sample_rows' WHEN 'signup' THEN 'train_cv' WHEN 'purchase' THEN 'submit_kaggle'
    ELSE ['train_cv', 'submit_kaggle', 'run_python', 'read_file'][event_id % 4 + 1] END"""
_METRIC = "CASE WHEN user_id % 2 = 0 THEN 'accuracy' ELSE 'rmse' END"

cte("journal", f"""
SELECT user_id AS competition, event_id * 2 + 1 AS seq, ts,
       CASE WHEN event_type = 'error' THEN 'tool_error' ELSE 'tool_call' END AS kind,
       {_TOOL} AS tool, props AS args,
       CASE WHEN event_type <> 'error' THEN
         CASE WHEN ({_TOOL}) = 'train_cv' THEN
           'train_cv complete: ' || CASE WHEN user_id % 2 = 0 THEN 'stratified_kfold' ELSE 'kfold' END
           || ' (5 folds), metric=' || {_METRIC} || ', mean='
           || CASE WHEN event_id % 17 = 0 THEN 'nan' ELSE printf('%.4f', value) END
           || ', std=0.0100, fold_scores=[' || printf('%.2f, %.2f, %.2f, %.2f, %.2f', value - 0.02, value - 0.01,
                                                      value, value + 0.01, value + 0.02)
           || '], duration_s=' || printf('%.2f', value)
         ELSE ({_TOOL}) || ' ok ' || CAST(value AS VARCHAR) END END AS result_summary,
       CASE WHEN event_type = 'error' THEN 'ToolError: failed with ' || CAST(value AS VARCHAR) END AS error,
       CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ''
            ELSE 'call_' || CAST(event_id AS VARCHAR) END AS tool_call_id,
       CAST(NULL AS VARCHAR) AS trigger, CAST(NULL AS VARCHAR) AS action,
       CAST(NULL AS VARCHAR) AS evidence, CAST(NULL AS VARCHAR) AS decision
FROM events
UNION ALL
SELECT user_id, event_id * 2, ts, 'checkpoint', NULL, NULL, NULL, NULL, NULL,
       'submit_kaggle_gate', 'submit ''sub_' || CAST(event_id AS VARCHAR) || '.csv''', props,
       CASE event_id % 7 WHEN 0 THEN 'deny' WHEN 1 THEN 'skip_check' WHEN 2 THEN 'abort' ELSE 'approve' END
FROM events WHERE event_type = 'purchase'""")

cte("jo", """
SELECT *, row_number() OVER (PARTITION BY competition ORDER BY seq) AS ordinal FROM journal""",
    ["journal"])

cte("ledger_raw", """
SELECT conv_id AS competition, turn AS seq,
       1704067200 + conv_id * 86400 + turn * 300 + length(text) % 250 AS ts_s,
       ['gemini-2.5-flash', 'gemini-2.5-pro', 'gemini-3-pro', 'gemini-3-pro-large',
        'experimental-model'][conv_id % 5 + 1] AS model,
       CASE WHEN role IN ('user', 'system') THEN CAST(length(text) AS BIGINT) ELSE 0 END AS input_tokens,
       CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) ELSE 0 END AS output_tokens,
       CASE WHEN role = 'user' AND turn >= 2 THEN CAST(length(text) // 2 AS BIGINT) ELSE 0 END AS cached_tokens
FROM conversations""")

cte("prices", """
SELECT * FROM (VALUES ('gemini-2.5-flash', 0.075, 0.01875, 0.30),
                      ('gemini-2.5-pro', 1.25, 0.3125, 10.00),
                      ('gemini-3-pro', 1.25, 0.3125, 10.00),
                      ('gemini-3-pro-large', 2.50, 0.625, 20.00))
         AS t(model, rate_in, rate_cached, rate_out)""")

cte("ledger", """
SELECT l.*, l.input_tokens * CAST(coalesce(p.rate_in, 1.25) AS DOUBLE) / 1000000
          + l.cached_tokens * CAST(coalesce(p.rate_cached, 0.3125) AS DOUBLE) / 1000000
          + l.output_tokens * CAST(coalesce(p.rate_out, 10.0) AS DOUBLE) / 1000000 AS cost_usd
FROM ledger_raw l LEFT JOIN prices p ON l.model = p.model""", ["ledger_raw", "prices"])

cte("subs", f"""
SELECT user_id AS competition, event_id AS seq, ts, 'sub_' || CAST(event_id AS VARCHAR) || '.csv' AS csv,
       CASE WHEN event_id % 11 <> 0 THEN value END AS cv_at_submit,
       'submission ' || CAST(event_id AS VARCHAR) AS message, {_METRIC} AS metric
FROM events WHERE event_type = 'purchase'""")

cte("spans", """
SELECT o_orderdate AS ts, CAST(o_orderkey AS VARCHAR) AS trace_id, 'o' || CAST(o_orderkey AS VARCHAR) AS span_id,
       CAST(NULL AS VARCHAR) AS parent_span_id, 'solve.loop' AS name,
       CAST(round(o_totalprice * 1000) AS BIGINT) AS duration_ns, 'OK' AS status,
       CAST(NULL AS BIGINT) AS in_tok, CAST(NULL AS BIGINT) AS out_tok, false AS has_error_attr,
       CAST(NULL AS VARCHAR) AS error
FROM orders
UNION ALL
SELECT o_orderdate, CAST(o_orderkey AS VARCHAR), 'm' || CAST(o_orderkey AS VARCHAR), NULL,
       'run:' || o_orderpriority, 0, 'MARKER', NULL, NULL, false, NULL
FROM orders
UNION ALL
SELECT l_shipdate, CAST(l_orderkey AS VARCHAR),
       'l-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
            || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR),
       'o' || CAST(l_orderkey AS VARCHAR),
       CASE l_returnflag WHEN 'R' THEN 'llm.call' WHEN 'A' THEN 'tool:train_cv' ELSE 'tool:read_file' END,
       CAST(round(l_extendedprice * 100) AS BIGINT),
       CASE WHEN l_discount = 0 THEN 'ERROR' ELSE 'OK' END,
       CASE WHEN l_returnflag = 'R' THEN CAST(round(l_quantity * 100) AS BIGINT) END,
       CASE WHEN l_returnflag = 'R' THEN CAST(round(l_quantity * 10) AS BIGINT) END,
       l_returnflag <> 'R' AND l_tax = 0,
       CASE WHEN l_discount = 0 THEN 'ValueError: zero discount' END
FROM lineitem""")

cte("docs", """
SELECT l.doc_id AS row_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(l.quality AS INTEGER) AS quality, CAST(l.toxic AS INTEGER) AS toxic
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")

cte("dskf", f"""
SELECT * EXCLUDE (r), CAST(r % 5 AS BIGINT) AS fold
FROM (SELECT *, row_number() OVER (ORDER BY quality, {h('row_id')}, row_id) - 1 AS r FROM docs)""", ["docs"])
