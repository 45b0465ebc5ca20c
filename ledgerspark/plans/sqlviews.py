"""DuckDB SQL text of the shaping views, used only to build oracle queries.

They mirror ``ledgerspark.sources.tables`` exactly; the oracle queries are ``WITH`` blocks
over these views and the driver's pre-registered tables.
"""

from ledgerspark.sources.tables import CATEGORY_RULES, COMPONENTS, EVENT_TYPE_MAP, PAGES

LEDGER_ORDERS = """ledger AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS description, c_name AS merchant,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         NULLIF(lower(c_mktsegment), 'household') AS category, lower(o_orderstatus) AS provider
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _category_case(merchant: str = "merchant", description: str = "description") -> str:
    parts = []
    for category, keywords in CATEGORY_RULES:
        conds = " OR ".join(
            f"contains(lower({merchant}), '{kw.lower()}') OR contains(lower({description}), '{kw.lower()}')"
            for kw in keywords)
        parts.append(f"WHEN {conds} THEN '{category}'")
    return "CASE " + " ".join(parts) + " ELSE 'misc' END"


LEDGER_LINES = f"""ledger AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_name AS description, p_brand AS merchant,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         {_category_case('p_brand', 'p_name')} AS category, lower(l_returnflag) AS provider
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _pick(values, idx: str) -> str:
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_K = "CAST(json_extract(props, '$.k') AS INTEGER)"
_TYPE = "CASE WHEN event_type = 'view' AND k % 10 = 9 THEN 'session_ended' " \
    "WHEN event_type = 'error' AND k % 5 = 4 THEN 'search_abandoned' " + " ".join(f"WHEN event_type = '{s}' THEN '{d}'" for s, d in EVENT_TYPE_MAP.items()) + " ELSE event_type END"

USAGE_EVENTS = f"""ev0 AS (SELECT *, {_K} AS k, CAST(ts AS TIMESTAMP) AS tsx FROM events),
usage AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         'user-' || CAST(user_id AS VARCHAR) AS user_id,
         'user-' || CAST(user_id AS VARCHAR) || '-' || strftime(tsx, '%Y%m%d') AS session_id,
         {_TYPE} AS event_type,
         {_pick(PAGES, 'k % 4')} AS page,
         CASE WHEN event_type = 'view' THEN NULL ELSE {_pick(COMPONENTS, 'k % 3')} END AS component,
         CASE
           WHEN event_type = 'click' AND k % 10 = 0 THEN '{{"field":"f' || CAST(k % 4 AS VARCHAR) || '","selected":"v' || CAST(k % 3 AS VARCHAR) || '"}}'
           WHEN event_type = 'click' THEN '{{"filter":"f' || CAST(k % 4 AS VARCHAR) || '","value":"v' || CAST(k % 3 AS VARCHAR) || '"}}'
           WHEN event_type = 'signup' AND k % 7 = 0 THEN '{{"sort":"s' || CAST(k % 3 AS VARCHAR) || '"}}'
           WHEN event_type = 'signup' THEN '{{"direction":"' || CASE WHEN k % 2 = 0 THEN 'asc' ELSE 'desc' END || '","sort":"s' || CAST(k % 3 AS VARCHAR) || '"}}'
           WHEN event_type = 'purchase' THEN '{{"query":"q' || CAST(k % 25 AS VARCHAR) || '","resultcount":' || CAST(k % 4 AS VARCHAR) || '}}'
           WHEN event_type = 'error' THEN '{{"query":"q' || CAST(k % 25 AS VARCHAR) || '"}}'
           ELSE '{{"k":' || CAST(k AS VARCHAR) || '}}'
         END AS metadata_json,
         tsx AS ts, value
  FROM ev0)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
