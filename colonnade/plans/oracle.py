"""The queries of ``plans/catalog.py`` as plain SQL over the same tables, for checking.

The SQL is written from the rules, not from the Spark plans: distinct counts are
counted, quantiles interpolated by the database, and moments summed up.
"""

from __future__ import annotations

# The columns of the test tables with their kinds.
COLUMNS = {
    "lineitem": "l_orderkey:integer l_partkey:integer l_suppkey:integer l_linenumber:integer l_quantity:float "
                "l_extendedprice:float l_discount:float l_tax:float l_returnflag:string l_linestatus:string "
                "l_shipdate:datetime",
    "orders": "o_orderkey:integer o_custkey:integer o_orderstatus:string o_totalprice:float o_orderdate:datetime "
              "o_orderpriority:string",
    "events": "event_id:integer ts:datetime user_id:integer event_type:string value:float props:string",
    "customer": "c_custkey:integer c_name:string c_nationkey:integer c_acctbal:float c_mktsegment:string",
    "part": "p_partkey:integer p_name:string p_brand:string p_type:string p_size:integer p_retailprice:float",
    "supplier": "s_suppkey:integer s_name:string s_nationkey:integer s_acctbal:float",
    "nation": "n_nationkey:integer n_name:string n_regionkey:integer",
    "region": "r_regionkey:integer r_name:string",
    "documents": "doc_id:integer text:string lang:string source:string n_chars:integer",
    "labels": "doc_id:integer quality:integer toxic:integer",
    "conversations": "conv_id:integer turn:integer role:string text:string",
    "pages": "page_id:integer url:string html:string",
    "benchmark": "item_id:integer text:string",
}
PROFILED = tuple(COLUMNS)
SUMMARISED = ("lineitem", "orders", "events", "documents", "customer", "part")


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in COLUMNS[table].split()]


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _roles(tables) -> str:
    """``table_name, column, role`` from counts and ranges of every column."""
    facts = _union(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{k}' AS kind, count(*) AS n_rows, count({c}) AS present, "
        f"count(DISTINCT {c}) AS n_distinct, "
        + (f"max({c}) - min({c}) AS width" if k == "integer" else "CAST(NULL AS BIGINT) AS width") + f" FROM {t}"
        for t in tables for c, k in _columns(t)
    )
    return f"""
WITH facts AS ({facts}),
judged AS (
  SELECT *, n_distinct::DOUBLE / n_rows AS share,
    regexp_matches(replace(replace(lower("column"), '_', ''), '-', ''), 'id|uuid|guid|index') AS hinted,
    present >= 2 AND n_distinct = present AND width = present - 1 AS sequential
  FROM facts
)
SELECT table_name, "column", CASE
  WHEN n_rows > 20 AND share > 0.95 AND kind <> 'float' AND (kind <> 'integer' OR hinted OR sequential) THEN 'id_like'
  WHEN kind = 'datetime' THEN 'datetime'
  WHEN kind IN ('integer', 'float') AND NOT (n_distinct <= 20 OR share <= 0.05) THEN 'numerical'
  ELSE 'categorical' END AS role
FROM judged"""


def _summary(numbers: str) -> str:
    """Numeric summary of ``(table_name, column, x)``, with the adjusted moments summed up from deviations."""
    return f"""
WITH numbers AS ({numbers}),
means AS (SELECT table_name, "column", avg(x) AS mean FROM numbers GROUP BY ALL),
sums AS (
  SELECT n.table_name, n."column", count(x)::DOUBLE AS n, any_value(mean) AS mean,
    sum((x - mean) ** 2) / count(x) AS m2, sum((x - mean) ** 3) / count(x) AS m3, sum((x - mean) ** 4) / count(x) AS m4,
    min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75,
    max(x) AS max
  FROM numbers n JOIN means m ON n.table_name = m.table_name AND n."column" = m."column"
  GROUP BY n.table_name, n."column"
)
SELECT table_name, "column", n::BIGINT AS n_present, round(mean, 4) AS mean,
  round(CASE WHEN n > 1 THEN sqrt(m2 * n / (n - 1)) END, 4) AS std,
  round(min, 4) AS min, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75, round(max, 4) AS max,
  round(CASE WHEN n < 3 THEN NULL WHEN m2 = 0 THEN 0 ELSE m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) END, 4) AS skewness,
  round(CASE WHEN n < 4 THEN NULL WHEN m2 = 0 THEN 0
    ELSE (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) END, 4) AS kurtosis
FROM sums"""


def _numbers(tables) -> str:
    """Values of the numerical columns, ``(table_name, column, x)``."""
    cells = _union(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM {t}"
        for t in tables for c, k in _columns(t) if k in ("integer", "float")
    )
    return f"""SELECT c.* FROM ({cells}) c JOIN ({_roles(tables)}) r
  ON c.table_name = r.table_name AND c."column" = r."column" WHERE r.role = 'numerical'"""


def _histogram(tables) -> str:
    """``(table_name, column, value, number, n)`` of the columns that are not numerical."""
    cells = _union(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, "
        + (f"CAST({c} AS DOUBLE)" if k in ("integer", "float") else "CAST(NULL AS DOUBLE)") + f" AS number FROM {t}"
        for t in tables for c, k in _columns(t)
    )
    return f"""SELECT c.table_name, c."column", value, any_value(number) AS number, count(*) AS n
FROM ({cells}) c JOIN ({_roles(tables)}) r ON c.table_name = r.table_name AND c."column" = r."column"
WHERE r.role <> 'numerical' AND value IS NOT NULL GROUP BY ALL"""


_TOP = """SELECT *, row_number() OVER (
  PARTITION BY table_name, "column" ORDER BY n DESC, number ASC NULLS FIRST, value) AS place FROM histogram"""

_DISTINCT = _union(
    f"SELECT '{t}' AS table_name, '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM {t}"
    for t in ("lineitem", "orders", "documents") for c, _ in _columns(t)
)

HOLED_LINEITEM = """SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_linenumber <= 4 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem"""
_HOLED_COUNTS = _union(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_present, count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM ({HOLED_LINEITEM})"
    for c in ("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
)
HOLED_ORDERS = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderstatus, o_orderdate FROM orders"""
IMPUTED_ORDERS = f"""SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM ({HOLED_ORDERS}))) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM ({HOLED_ORDERS}) WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority, o_orderstatus, o_orderdate FROM ({HOLED_ORDERS})"""

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


def _indicators(column: str, levels) -> str:
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{column}_{v}\"" for v in levels)


_PARTS_OF_DATE = ("year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, "
                  "day(o_orderdate)::INT AS o_orderdate_day, (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek")

JUDGED_LINES = """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * (1 - l_discount) > 30000 AS INT) AS label,
  CAST(l_quantity > 25 AS INT) AS prediction, CAST(floor(l_extendedprice / 100) + l_quantity AS DOUBLE) AS score FROM lineitem"""
# The hash of a row's place in splits: 13 hexadecimal digits of the MD5 of seed and key.
_HASHED_ORDERS = "SELECT *, ('0x' || md5('42|' || o_orderkey)[1:13])::BIGINT AS h FROM orders"
_HASHED_EVENTS = """SELECT event_id, 3 * value + 5 AS y, ('0x' || md5('42|' || event_id)[1:13])::BIGINT AS h,
  ('0x' || md5('43|' || event_id)[1:13])::BIGINT AS later FROM events WHERE value IS NOT NULL"""
_RANKED_ORDERS = f"""SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h) AS place,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM ({_HASHED_ORDERS})"""
JUDGED_ORDERS = """SELECT o_orderkey, o_orderstatus AS label, CASE WHEN o_orderpriority LIKE '1%' THEN 'F'
  WHEN o_orderpriority LIKE '2%' THEN 'O' WHEN o_orderpriority LIKE '3%' THEN 'X' ELSE o_orderstatus END AS prediction
  FROM orders"""
JUDGED_PARTS = """SELECT p_partkey, p_retailprice AS label,
  CAST(900 + p_partkey * 0.05::DOUBLE + p_size AS DOUBLE) AS prediction FROM part"""


def _class_scores(judged: str, by: str = "") -> str:
    on = " AND ".join(f"s.{c} = l.{c}" for c in [b.strip() for b in by.split(",") if b.strip()] + ["label"])
    keys = f"{by}, " if by else ""
    return f"""
WITH judged AS ({judged}),
labels AS (SELECT {keys}label FROM judged UNION SELECT {keys}prediction FROM judged),
truth AS (SELECT {keys}label, count(*) AS support, count_if(label = prediction) AS hits FROM judged GROUP BY ALL),
guess AS (SELECT {keys}prediction AS label, count(*) AS predicted FROM judged GROUP BY ALL),
counted AS (
  SELECT l.*, coalesce(support, 0)::BIGINT AS support, coalesce(predicted, 0)::BIGINT AS predicted, coalesce(hits, 0)::BIGINT AS hits
  FROM labels l LEFT JOIN truth s ON {on} LEFT JOIN guess g ON {on.replace("s.", "g.")}
),
shares AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits::DOUBLE / predicted END AS "precision",
    CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS recall FROM counted
),
scored AS (
  SELECT *, CASE WHEN "precision" + recall = 0 THEN 0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM shares
)"""


_RULES = """SELECT l_orderkey % 5 AS fold, CAST(l_extendedprice * (1 - l_discount) > 30000 AS INT) AS label,
    'always' AS model, 1 AS prediction FROM lineitem
  UNION ALL SELECT l_orderkey % 5, CAST(l_extendedprice * (1 - l_discount) > 30000 AS INT),
    'by_price', CAST(l_extendedprice > 32000 AS INT) FROM lineitem
  UNION ALL SELECT l_orderkey % 5, CAST(l_extendedprice * (1 - l_discount) > 30000 AS INT),
    'by_quantity', CAST(l_quantity > 25 AS INT) FROM lineitem"""
_RULE_SCORES = f"""{_class_scores(_RULES, "model, fold")},
folds AS (
  SELECT model, fold, sum(hits)::DOUBLE / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1
  FROM scored GROUP BY model, fold
)"""

# Counts at every score and above it; the window's peers are the rows of the same score.
_RANKED = f"""
WITH by_score AS (
  SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM ({JUDGED_LINES}) GROUP BY score
),
ranked AS (
  SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM by_score WINDOW w AS (ORDER BY score DESC)
)"""

LINEAR_LINEITEM = """SELECT l_orderkey, l_extendedprice, 2 * l_extendedprice + 1 AS doubled,
  l_extendedprice + 20000 * l_discount * l_quantity AS noisy,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey + l_extendedprice END AS holed,
  CAST(5.0 AS DOUBLE) AS constant, l_quantity, l_tax FROM lineitem"""


def _pairs(source: str, names) -> str:
    """All pairs, from deviations over the rows where both are present."""
    return _union(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0
  THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS corr
FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM ({source}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for i, a in enumerate(names) for b in names[i + 1:]
    )


_PLANTED = ("l_orderkey", "l_extendedprice", "doubled", "noisy", "holed", "constant")
_PLANTED_PAIRS = _pairs(LINEAR_LINEITEM, _PLANTED)


def _role_pairs(table: str) -> str:
    """Pairs of the columns of role numerical."""
    names = [c for c, k in _columns(table) if k in ("integer", "float")]
    numerical = f"""SELECT "column" FROM ({_roles([table])}) WHERE role = 'numerical'"""
    return f"""SELECT '{table}' AS table_name, * FROM ({_pairs(table, names)})
WHERE col_a IN ({numerical}) AND col_b IN ({numerical})"""


def _bounds(table: str, key: str) -> str:
    names = [c for c, k in _columns(table) if k in ("integer", "float")]
    return _union(
        f"""SELECT '{table}' AS table_name, {key} AS row_key, '{c}' AS "column", CAST({c} AS DOUBLE) AS value,
  b.* FROM {table}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
  avg({c}) AS mean, stddev_samp({c}) AS std FROM {table}) b
WHERE '{c}' IN (SELECT "column" FROM ({_roles([table])}) WHERE role = 'numerical')"""
        for c in names
    )


_OUTLYING = _union([_bounds("documents", "doc_id"), _bounds("events", "event_id")])

_SLOPE = "SELECT regr_slope(p_retailprice, p_partkey) AS slope, regr_intercept(p_retailprice, p_partkey) AS start FROM part"

_SAVED = "SELECT event_type AS dataset, event_id AS version FROM events"
_PROMOTED = "SELECT event_type AS dataset, event_id AS version, ts AS promoted_at FROM events WHERE value > 120"
_DELETED = "SELECT event_type AS dataset, event_id AS version FROM events WHERE user_id < 40"


def _live(deleted: str) -> str:
    return (f"SELECT * FROM ({_SAVED}) s WHERE NOT EXISTS (SELECT 1 FROM ({deleted}) d "
            "WHERE d.dataset = s.dataset AND d.version = s.version)")


def _current(deleted: str) -> str:
    return f"""
WITH live AS ({_live(deleted)}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY promoted_at DESC, version DESC) AS place FROM ({_PROMOTED})),
latest AS (SELECT dataset, version FROM ordered WHERE place = 1)
SELECT l.dataset, coalesce(max(CASE WHEN l.version = p.version THEN l.version END), max(l.version)) AS version
FROM live l JOIN latest p ON l.dataset = p.dataset GROUP BY l.dataset"""


_SHAP = """SELECT p_partkey, 'p_retailprice' AS feature, p_retailprice AS value, p_retailprice - 1000 AS shap FROM part
  UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE), 3.0::DOUBLE * (25 - p_size) FROM part
  UNION ALL SELECT p_partkey, 'p_brand_length', CAST(length(p_brand) AS DOUBLE), length(p_brand) - 7.5::DOUBLE FROM part
  UNION ALL SELECT p_partkey, 'constant', 1.0::DOUBLE, 0.0::DOUBLE FROM part"""
_SHAP_TOP = f"""SELECT feature, avg(abs(shap)) AS mean_abs_shap, min(value) AS low, max(value) AS high
  FROM ({_SHAP}) GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 3"""

_LINE_ROLES = _roles(["lineitem"])

SQL: dict[str, str] = {
    "profile_roles": _roles(PROFILED),
    "distinct_counts": _DISTINCT,
    "problem_type": _union(
        f"""SELECT '{t}' AS table_name, '{c}' AS target,
  CASE WHEN '{k}' NOT IN ('integer', 'float') OR count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END AS problem
FROM {t}"""
        for t, names in (("orders", ("o_orderstatus", "o_totalprice", "o_custkey")), ("labels", ("quality",)),
                         ("part", ("p_size", "p_retailprice")))
        for c, k in _columns(t) if c in names
    ),
    "id_name_hints": """SELECT page_id, url,
  regexp_matches(replace(replace(lower(trim(url)), '_', ''), '-', ''), 'id|uuid|guid|index') AS hints_at_id FROM pages""",
    "date_text_roles": """SELECT * FROM (VALUES ('day', 'datetime'), ('junk_later', 'categorical'), ('day_with_holes', 'datetime')) t("column", role)""",
    "read_dates": """SELECT o_orderkey,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""",
    "validation_rules": """
WITH planted AS (SELECT event_type, CAST(floor(value / 10) AS INT) AS bucket,
  CASE WHEN event_type = 'click' THEN value END AS click_value, CAST(NULL AS DOUBLE) AS nothing FROM events),
shares AS (SELECT 'event_type' AS "column", count(event_type) AS present, count(*) AS n_rows FROM planted
  UNION ALL SELECT 'bucket', count(bucket), count(*) FROM planted
  UNION ALL SELECT 'click_value', count(click_value), count(*) FROM planted
  UNION ALL SELECT 'nothing', count(nothing), count(*) FROM planted),
groups AS (SELECT count(*) AS n FROM planted GROUP BY event_type, bucket, click_value, nothing)
SELECT 'min_rows' AS rule, 'error' AS severity, NULL AS "column", CAST(count(*) AS DOUBLE) AS value FROM planted HAVING count(*) < 10
UNION ALL SELECT 'empty_column', 'error', "column", CAST(n_rows AS DOUBLE) FROM shares WHERE present = 0
UNION ALL SELECT 'mostly_missing', 'warning', "column", round(1 - present::DOUBLE / n_rows, 6) FROM shares
  WHERE 1 - present::DOUBLE / n_rows > 0.5
UNION ALL SELECT 'duplicate_rows', 'warning', NULL, CAST(sum(n - 1) AS DOUBLE) FROM groups HAVING sum(n - 1) > 0""",
    "validation_verdict": """SELECT 'events' AS table_name, TRUE AS is_valid, 0::BIGINT AS n_errors, count(*) AS n_warnings
FROM (SELECT 1 FROM (SELECT count(*) AS n FROM events GROUP BY event_id, ts, user_id, event_type, value, props) HAVING sum(n - 1) > 0)
UNION ALL SELECT 'planted', FALSE, 1, 3 FROM (SELECT count_if(event_type <> 'click') * 2 > count(*) AS mostly FROM events) WHERE mostly""",
    "target_rules": """
WITH holes AS (SELECT count_if(toxic = 1) AS n, count(*) AS n_rows FROM labels)
SELECT 'holed' AS table_name, 'target_missing' AS rule, 'warning' AS severity, 'holed' AS "column", CAST(n AS DOUBLE) AS value
  FROM holes WHERE n > 0
UNION ALL SELECT 'holed', 'target_constant', 'error', 'holed', 1.0 FROM labels WHERE toxic <> 1 HAVING count(DISTINCT quality) = 1
UNION ALL SELECT 'quality', 'target_constant', 'error', 'quality', 1.0 FROM labels HAVING count(DISTINCT quality) = 1
UNION ALL SELECT 'constant', 'target_constant', 'error', 'constant', 1.0
UNION ALL SELECT 'nothing', 'target_missing', 'warning', 'nothing', CAST(n_rows AS DOUBLE) FROM holes
UNION ALL SELECT 'nothing', 'target_constant', 'error', 'nothing', 0.0
UNION ALL SELECT 'absent', 'target_absent', 'error', 'absent', NULL""",
    "drop_missing_target": f"SELECT o_orderkey, o_orderpriority FROM ({HOLED_ORDERS}) WHERE o_orderpriority IS NOT NULL",
    "missing_report": f'SELECT "column", n_missing, missing_pct FROM ({_HOLED_COUNTS})',
    "missing_total": f"""SELECT CAST(sum(n_missing) AS BIGINT) AS n_missing, CAST(sum(n_missing + n_present) AS BIGINT) AS n_cells,
  round(sum(n_missing) * 100.0::DOUBLE / sum(n_missing + n_present), 2) AS missing_pct FROM ({_HOLED_COUNTS})""",
    "high_risk_columns": f'SELECT "column", n_missing, missing_pct FROM ({_HOLED_COUNTS}) WHERE missing_pct >= 40',
    "duplicate_count": """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates,
  round(sum(n - 1) * 100.0::DOUBLE / sum(n), 2) AS duplicate_pct FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)""",
    "duplicate_rows": """SELECT doc_id, lang, length(text)::INT AS n
FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS place FROM documents) WHERE place > 1""",
    "duplicate_rows_null_key": """
WITH holed AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id, lang, source[1:4] AS source FROM documents)
SELECT doc_id, lang, source
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id NULLS FIRST) AS place FROM holed) WHERE place > 1""",
    "table_size": _union(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(_columns(t))}::BIGINT AS n_columns FROM {t}" for t in PROFILED),
    "column_counts": _HOLED_COUNTS,
    "numeric_summary": _summary(_numbers(SUMMARISED)),
    "categorical_summary": f"""
WITH histogram AS ({_histogram(SUMMARISED)}), ordered AS ({_TOP})
SELECT table_name, "column", CAST(sum(n) AS BIGINT) AS n_present, count(*) AS n_distinct,
  max(CASE WHEN place = 1 THEN value END) AS mode, max(CASE WHEN place = 1 THEN n END) AS mode_count
FROM ordered GROUP BY table_name, "column" """,
    "top_values": f"""
WITH histogram AS ({_histogram(SUMMARISED)}), ordered AS ({_TOP})
SELECT table_name, "column", place::INT AS rank, value, n FROM ordered WHERE place <= 10""",
    "quantiles_by_narrowing": _union(
        f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS share, quantile_cont(CAST({c} AS DOUBLE), {p}) AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity", "l_orderkey") for p in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)),
    "corr_pairs": f"""SELECT table_name, col_a, col_b, round(corr, 6) AS corr FROM (
{_union([_role_pairs(t) for t in ("orders", "lineitem", "supplier")] + [f"SELECT 'planted' AS table_name, * FROM ({_PLANTED_PAIRS})"])})""",
    "corr_matrix": f"""
WITH pairs AS ({_PLANTED_PAIRS}),
both_ways AS (SELECT * FROM pairs UNION ALL SELECT col_b, col_a, corr FROM pairs)
SELECT col_a, col_b, round(corr, 6) AS corr FROM both_ways
UNION ALL SELECT col_a, col_a, CASE WHEN count(corr) > 0 THEN 1.0::DOUBLE END FROM both_ways GROUP BY col_a""",
    "corr_wide": f"""SELECT col_a, col_b, round(corr, 6) AS corr
FROM ({_pairs(LINEAR_LINEITEM, _PLANTED + ("l_quantity", "l_tax"))})""",
    "corr_high": f"SELECT col_a, col_b, round(corr, 4) AS corr FROM ({_PLANTED_PAIRS}) WHERE abs(corr) >= 0.8",
    "corr_target": f"""SELECT CASE WHEN col_a = 'l_extendedprice' THEN col_b ELSE col_a END AS "column", round(corr, 4) AS corr
FROM ({_PLANTED_PAIRS}) WHERE 'l_extendedprice' IN (col_a, col_b)""",
    "outlier_report": f"""
SELECT table_name, "column", count(value) AS n_present, round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower,
  round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper,
  count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS iqr_count,
  round(count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count(value), 2) AS iqr_pct,
  count_if(abs((value - mean) / std) > 3)::BIGINT AS zscore_count,
  round(count_if(abs((value - mean) / std) > 3) * 100.0::DOUBLE / count(value), 2) AS zscore_pct
FROM ({_OUTLYING}) GROUP BY table_name, "column" """,
    "outlier_rows": f"""SELECT table_name, row_key, "column", value FROM ({_OUTLYING})
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "impute_median": f"SELECT o_orderkey, o_totalprice FROM ({IMPUTED_ORDERS})",
    "impute_mode": f"SELECT o_orderkey, o_orderpriority FROM ({IMPUTED_ORDERS})",
    "drop_ids": "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "interactions": "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) * o_totalprice AS o_custkey_x_o_totalprice FROM orders",
    "datetime_parts": f"SELECT o_orderkey, {_PARTS_OF_DATE} FROM orders",
    "onehot": f"""SELECT o_orderkey, {_indicators("o_orderstatus", STATUSES)}, {_indicators("o_orderpriority", PRIORITIES)} FROM orders""",
    "frequency_encode": """
WITH seen AS (SELECT p_brand, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM part WHERE p_brand <> 'Brand#3' GROUP BY p_brand)
SELECT p_partkey, coalesce(share, 0.0) AS p_brand_freq FROM part LEFT JOIN seen USING (p_brand)""",
    "scale_standard": """
WITH s AS (SELECT avg(o_custkey) AS m1, stddev_pop(o_custkey) AS s1, avg(o_totalprice) AS m2, stddev_pop(o_totalprice) AS s2 FROM orders)
SELECT o_orderkey, round((o_custkey - m1) / s1, 6) AS o_custkey, round((o_totalprice - m2) / s2, 6) AS o_totalprice FROM orders, s""",
    "scale_minmax": """
WITH s AS (SELECT min(o_custkey) AS l1, max(o_custkey) AS h1, min(o_totalprice) AS l2, max(o_totalprice) AS h2 FROM orders)
SELECT o_orderkey, round((o_custkey - l1)::DOUBLE / (h1 - l1), 6) AS o_custkey,
  round((o_totalprice - l2) / (h2 - l2), 6) AS o_totalprice FROM orders, s""",
    "prepared_table": f"""
WITH imputed AS ({IMPUTED_ORDERS}),
s AS (SELECT avg(o_custkey) AS m1, stddev_pop(o_custkey) AS s1, avg(o_totalprice) AS m2, stddev_pop(o_totalprice) AS s2 FROM imputed)
SELECT o_orderkey AS row_key, round((o_custkey - m1) / s1, 6) AS o_custkey, round((o_totalprice - m2) / s2, 6) AS o_totalprice,
  round(o_custkey * o_totalprice, 4) AS o_custkey_x_o_totalprice, {_PARTS_OF_DATE},
  {_indicators("o_orderpriority", PRIORITIES)}, {_indicators("o_orderstatus", STATUSES)} FROM imputed, s""",
    "compare_exact": f"""
WITH e AS ({_HASHED_EVENTS}), k AS (SELECT unnest(range(5)) AS fold),
m AS (SELECT fold, avg(y) AS guess FROM e, k WHERE h % 5 <> fold GROUP BY fold),
s AS (SELECT fold, -sqrt(avg((y - guess) ** 2)) AS neg_rmse, 1 - sum((y - guess) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM e JOIN m ON h % 5 = fold GROUP BY fold)
SELECT 'linear_regression' AS model, 0.0::DOUBLE AS neg_rmse, 0.0::DOUBLE AS neg_rmse_std, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS r2_std
UNION ALL SELECT 'mean', round(round(avg(neg_rmse), 4), 3) + 0.0, round(round(stddev_pop(neg_rmse), 4), 3) + 0.0,
  round(round(avg(r2), 4), 3) + 0.0, round(round(stddev_pop(r2), 4), 3) + 0.0 FROM s""",
    "best_refit": "SELECT 'linear_regression' AS model, 'r2' AS metric, 1.0::DOUBLE AS score",
    "learning_curve": f"""
WITH e AS ({_HASHED_EVENTS}), k AS (SELECT unnest(range(5)) AS fold),
t AS (SELECT unnest([0.1, 0.28, 0.46, 0.64, 0.82, 1.0])::DOUBLE AS share),
p AS (SELECT share, fold, count(*) AS n FROM e, k, t WHERE h % 5 <> fold AND later % 1000000 < round(share * 1000000) GROUP BY ALL)
SELECT share, floor(avg(n))::BIGINT AS train_rows, 1.0::DOUBLE AS train_mean, 0.0::DOUBLE AS train_std,
  1.0::DOUBLE AS validation_mean, 0.0::DOUBLE AS validation_std FROM p GROUP BY share""",
    "shap_one_row": "SELECT o_orderkey, TRUE AS adds_up FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
    "split_flags": f"SELECT o_orderkey, h % 1000000 < 200000 AS is_test FROM ({_HASHED_ORDERS})",
    "fold_flags": f"SELECT o_orderkey, (h % 5)::INT AS fold FROM ({_HASHED_ORDERS})",
    "split_shares": "SELECT o_orderstatus, count(*) AS n, floor(count(*) * 0.2::DOUBLE + 0.5)::BIGINT AS n_test FROM orders GROUP BY o_orderstatus",
    "fold_shares": f"""SELECT o_orderstatus, fold, count(*) AS n FROM (SELECT *, {" + ".join(
        f"(place > floor(n * {i / 5}::DOUBLE + 0.5))::INT" for i in range(1, 5))} AS fold FROM ({_RANKED_ORDERS})) GROUP BY ALL""",
    "split_train_test": f"""SELECT o_orderkey, o_orderstatus, CASE WHEN place <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS side
FROM ({_RANKED_ORDERS})""",
    "accuracy": f"SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM ({JUDGED_ORDERS})",
    "class_scores": f"""{_class_scores(JUDGED_ORDERS)}
SELECT label, support, predicted, hits, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scored""",
    "weighted_scores": f"""{_class_scores(JUDGED_ORDERS)}
SELECT round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(sum("precision" * support) / sum(support), 6) AS "precision",
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM scored""",
    "confusion": f"""
WITH judged AS ({JUDGED_ORDERS}), labels AS (SELECT label FROM judged UNION SELECT prediction FROM judged),
cells AS (SELECT label, prediction, count(*) AS n FROM judged GROUP BY ALL)
SELECT a.label AS actual, p.label AS predicted, coalesce(n, 0)::BIGINT AS n
FROM labels a CROSS JOIN labels p LEFT JOIN cells c ON c.label = a.label AND c.prediction = p.label""",
    "confusion_missing": f"""
WITH judged AS ({JUDGED_ORDERS}), holed AS (SELECT label, CASE WHEN o_orderkey % 10 <> 0 THEN prediction END AS prediction FROM judged)
SELECT label AS actual, prediction AS predicted, count(*) AS n FROM holed GROUP BY ALL""",
    "roc_points": f"""{_RANKED}
SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / all_pos, 8) AS tpr, round(fp::DOUBLE / all_neg, 8) AS fpr
FROM ranked UNION ALL SELECT NULL, 0, 0, 0.0, 0.0""",
    "roc_auc": f"""{_RANKED}
SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / any_value(all_pos::DOUBLE * all_neg), 8) AS roc_auc FROM ranked""",
    "pr_points": f"""{_RANKED}
SELECT score AS threshold, round(tp::DOUBLE / (tp + fp), 8) AS "precision", round(tp::DOUBLE / all_pos, 8) AS recall FROM ranked
UNION ALL SELECT NULL, 1.0, 0.0""",
    "regression_metrics": f"""
WITH judged AS ({JUDGED_PARTS}), centre AS (SELECT avg(label) AS mean FROM judged)
SELECT round(avg(abs(label - prediction)), 6) AS mae, round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse,
  round(1 - sum((label - prediction) ** 2) / sum((label - mean) ** 2), 6) AS r2,
  round(CASE WHEN count_if(label = 0) = 0 THEN avg(abs((label - prediction) / label)) * 100 END, 6) AS mape FROM judged, centre""",
    "residuals": f"""SELECT p_partkey, round(label, 6) AS actual, round(prediction, 6) AS predicted,
  round(label - prediction, 6) AS residual FROM ({JUDGED_PARTS})""",
    "residual_range": f"""SELECT round(least(min(label), min(prediction)), 6) AS low,
  round(greatest(max(label), max(prediction)), 6) AS high FROM ({JUDGED_PARTS})""",
    "linear_fit_one_feature": f"""SELECT 'p_partkey' AS feature, round(slope * spread, 4) AS coefficient,
  round(start + slope * centre, 4) AS intercept
FROM ({_SLOPE}), (SELECT stddev_pop(p_partkey) AS spread, avg(p_partkey) AS centre FROM part)""",
    "batch_score": f"SELECT part.*, round(start + slope * p_partkey, 4) AS prediction FROM part, ({_SLOPE})",
    "stream_score": f"SELECT part.*, round(start + slope * p_partkey, 4) AS prediction FROM part, ({_SLOPE})",
    "baseline_predictions": """
WITH m AS (SELECT avg(o_totalprice) AS mean FROM orders)
SELECT round(avg(abs(o_totalprice - mean)), 4) AS mae, round(sqrt(avg((o_totalprice - mean) ** 2)), 4) AS rmse,
  0.0::DOUBLE AS r2, round(avg(abs((o_totalprice - mean) / o_totalprice)) * 100, 4) AS mape FROM orders, m""",
    "score_summary": f"""{_RULE_SCORES}
SELECT model, 'accuracy' AS metric, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, 0.0::DOUBLE AS seconds
FROM folds GROUP BY model
UNION ALL SELECT model, 'f1', round(avg(f1), 6), round(stddev_pop(f1), 6), 0.0 FROM folds GROUP BY model""",
    "leaderboard": f"""{_RULE_SCORES}
SELECT model, 0.0::DOUBLE AS fit_seconds, round(avg(accuracy), 4) AS accuracy, round(stddev_pop(accuracy), 4) AS accuracy_std,
  round(avg(f1), 4) AS f1, round(stddev_pop(f1), 4) AS f1_std FROM folds GROUP BY model""",
    "shap_adds_up": "SELECT o_orderkey, TRUE AS adds_up FROM orders",
    "shap_boosted_adds_up": "SELECT o_orderkey, TRUE AS adds_up FROM orders",
    "shap_top_global": f"SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap FROM ({_SHAP_TOP})",
    "shap_beeswarm": f"""
WITH top AS (SELECT *, row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS place FROM ({_SHAP_TOP}))
SELECT p_partkey, s.feature, place::INT AS place, round(shap, 6) AS shap,
  round(CASE WHEN high > low THEN (value - low) / (high - low) ELSE 0 END, 6) AS position FROM ({_SHAP}) s JOIN top USING (feature)""",
    "shap_waterfall": f"""
WITH ordered AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(shap) DESC, feature) AS place FROM ({_SHAP}))
SELECT p_partkey, place::INT AS place, feature, round(value, 6) AS value, round(shap, 6) AS shap,
  CASE WHEN shap > 0 THEN 'up' ELSE 'down' END AS pushes FROM ordered WHERE place <= 2""",
    "shape_rules": """
SELECT 'region' AS table_name, 'min_rows' AS rule, 'error' AS severity, NULL::VARCHAR AS "column", count(*)::DOUBLE AS value
FROM region HAVING count(*) < 10
UNION ALL SELECT 'one_column', 'min_columns', 'error', NULL, 1.0
UNION ALL SELECT 'one_column', 'duplicate_rows', 'warning', NULL, count(*) - count(DISTINCT c_custkey) FROM customer
  HAVING count(*) > count(DISTINCT c_custkey)
UNION ALL SELECT 'repeated', 'repeated_name', 'error', 'o_orderkey', 2.0
UNION ALL SELECT 'repeated', 'duplicate_rows', 'warning', NULL, sum(n - 1) FROM
  (SELECT count(*) AS n FROM orders GROUP BY o_orderkey, o_totalprice) HAVING sum(n - 1) > 0""",
    "hinted_roles": """
WITH facts AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM orders),
names AS (SELECT unnest(['amount', 'paid', 'Row-Index', 'GU_ID', 'height', 'in_dex']) AS "column")
SELECT "column", CASE
  WHEN n > 20 AND d / n::DOUBLE > 0.95 AND regexp_matches(replace(replace(lower("column"), '_', ''), '-', ''), 'id|uuid|guid|index') THEN 'id_like'
  WHEN d <= 20 OR d / n::DOUBLE <= 0.05 THEN 'categorical' ELSE 'numerical' END AS role FROM names, facts""",
    "overridden_roles": f"""SELECT "column", CASE WHEN "column" IN ('o_custkey', 'o_totalprice') THEN 'categorical' ELSE role END AS role
FROM ({_roles(["orders"])})""",
    "label_numbers": """SELECT c_custkey, c_name, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS by_name,
  (dense_rank() OVER (ORDER BY c_custkey) - 1)::DOUBLE AS by_number FROM customer""",
    "scoring_missing_columns": """SELECT 'p_name' AS dropped, count(*) AS n_scored, NULL::VARCHAR AS error FROM part
UNION ALL SELECT 'p_partkey', 0, 'missing columns: p_partkey'""",
    "tune_without_space": """SELECT p_partkey, 'none' AS method, 0 AS tried,
  'method must be one of randomized, grid, not ''annealing''' AS refused, (SELECT round(avg(p_retailprice), 4) FROM part) AS prediction FROM part""",
    "line_importance": """SELECT 'value' AS feature, round(3 * stddev_pop(value), 3) AS importance FROM events
UNION ALL SELECT DISTINCT 'event_type_' || event_type, 0.0 FROM events""",
    "shap_global_exact": """
WITH background AS (SELECT IF(p_size > 25, 10, 0) AS y FROM part ORDER BY ('0x' || md5('42|' || p_partkey)[1:13])::BIGINT LIMIT 100),
base AS (SELECT avg(y) AS base FROM background)
SELECT 'p_size' AS feature, round(avg(abs(IF(p_size > 25, 10, 0) - base)), 6) AS mean_abs_shap FROM part, base
UNION ALL SELECT unnest(['p_retailprice', 'p_size_x_p_retailprice']), 0.0""",
    "store_scores": f"SELECT part.*, round(start + slope * p_partkey, 4) AS prediction FROM part, ({_SLOPE})",
    "store_versions": f"""
WITH errors AS (SELECT sqrt(avg((p_retailprice - start - slope * p_partkey) ** 2)) AS line, stddev_pop(p_retailprice) AS mean, count(*) AS n
  FROM part, ({_SLOPE})),
saved AS (SELECT 1 AS version, 'line' AS model_name, round(line, 4) AS rmse, n, TRUE AS in_force FROM errors
  UNION ALL SELECT 2, 'mean', round(mean, 4), n, FALSE FROM errors)
SELECT 'parts__all_' AS dataset, version, model_name, 'regression' AS problem, rmse, 'standard' AS scaling,
  'p_partkey' AS features, n AS n_train_rows, in_force FROM saved""",
    "version_next": f"SELECT dataset, max(version) + 1 AS next_version FROM ({_SAVED}) GROUP BY dataset",
    "version_resolve": _current(_DELETED),
    "version_delete": _current(f"{_DELETED} UNION ALL SELECT dataset, version FROM ({_PROMOTED})"),
    "version_list": f"SELECT * FROM ({_live(_DELETED)}) WHERE dataset = 'click'",
    "version_datasets": f"SELECT DISTINCT dataset FROM ({_live(_DELETED)})",
    "sanitize_name": r"""SELECT page_id,
  lower(regexp_replace(regexp_replace(url, '\.[^.]+$', ''), '[^a-zA-Z0-9_-]', '_', 'g')) AS name FROM pages""",
    "csv_roundtrip": "SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders",
    "csv_texts": """SELECT doc_id, ' say "yes", ' || text AS text, lang FROM documents""",
    "csv_windows": "SELECT c_custkey, '“' || c_name || '” 5 €' AS c_name FROM customer",
    "csv_latin1": "SELECT c_custkey, c_name || ' Müller' AS c_name FROM customer",
    "land_dataset": "SELECT * FROM supplier",
    "run_log": f"""{_RULE_SCORES}
SELECT model AS run_name, 'lineitem' AS dataset, '5' AS folds, round(avg(accuracy), 6) AS accuracy,
  round(stddev_pop(accuracy), 6) AS accuracy_std FROM folds GROUP BY model""",
    "table_profile": f"""
SELECT r."column", role, n_present, n_missing, missing_pct, n_distinct, mean, std, min, q25, median, q75, max, skewness, kurtosis
FROM ({_LINE_ROLES}) r
JOIN ({_DISTINCT}) d ON d.table_name = r.table_name AND d."column" = r."column"
JOIN ({_union(f'''SELECT '{c}' AS "column", count({c}) AS n_present, count(*) - count({c}) AS n_missing,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM lineitem''' for c, _ in _columns("lineitem"))}) c
  ON c."column" = r."column"
LEFT JOIN (SELECT * EXCLUDE (n_present) FROM ({_summary(_numbers(["lineitem"]))})) s ON s."column" = r."column" """,
}
