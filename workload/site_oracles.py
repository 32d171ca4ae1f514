"""DuckDB statements for the queries of ``site_queries``."""

from __future__ import annotations

from .clinical import CTES
from .incidence_oracles import oracles as incidence_oracles
from .report_oracles import ask
from .sql import FIXTURES, statement

COUNTED = """
  SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n,
         min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY ALL"""


def first_of(order: str) -> str:
    """Of the statuses a customer has in a priority, the one that comes first in ``order``."""
    return statement(
        {"counted": COUNTED},
        f"""
SELECT o_custkey, o_orderpriority, o_orderstatus, n,
       CASE WHEN o_orderstatus <> 'O' THEN day END AS first_day FROM counted
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                           ORDER BY strpos('{order}', o_orderstatus)) = 1""",
    )


def oracles() -> dict[str, str]:
    return {
        "append_results_replace": first_of("POF"),
        "append_results_keep": first_of("FOP"),
        "site_purged_twice": statement(
            {"sites": CTES["sites"]},
            """
SELECT database_name AS database_id, o_custkey AS cell,
       CAST(CASE WHEN database_name IN ('ASIA', 'EUROPE') THEN 2 ELSE 1 END AS INTEGER) AS release,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders JOIN sites ON o_custkey = subject_id
WHERE database_name NOT IN ('ASIA', 'EUROPE') OR o_custkey % 3 = 0
GROUP BY ALL""",
        ),
        "file_first_row": """
SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey AS n FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                           ORDER BY o_orderstatus, o_orderkey DESC) = 1""",
        "files_with_line_breaks": """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, md5(nullif(text, '')) AS text_md5
FROM documents""",
        "csv_keys_replaced": """
SELECT o_orderpriority AS "oOrderpriority", o_orderstatus AS "oOrderstatus",
       CASE WHEN o_orderstatus = 'F' THEN -count(*) ELSE count(*) END AS "numOrders",
       min(CAST(o_orderdate AS DATE)) AS "firstDay"
FROM orders GROUP BY o_orderpriority, o_orderstatus""",
        "older_layouts": """
SELECT o_orderkey AS cohort_id, 'm' AS metadata, CAST(NULL AS DOUBLE) AS sum_value FROM orders
UNION ALL SELECT o_orderkey, '{}', -1.0 FROM orders""",
        "outcomes_in_order": ask(
            """
SELECT outcome_name, CAST(sum(num_outcomes) AS BIGINT) AS n,
       CAST(CASE outcome_name WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Unspecified' THEN 3 END
         AS INTEGER) AS sort_order
FROM summary GROUP BY outcome_name"""
        ),
        "task_status": """
SELECT unnest(['unchanged', 'changed', 'unknown']) AS task, md5(text) AS checksum,
       CAST(unnest([0, 1, 1]) AS INTEGER) AS required
FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 1)""",
        "found_release": statement(
            FIXTURES,
            """
SELECT 'db2' AS database_id, 'Database two' AS database_name, 'Named release' AS description,
       (SELECT max('v' || r_regionkey) FROM region WHERE r_name = 'ASIA') AS vocabulary_version,
       MIN(op_start) AS min_obs_period_date, MAX(op_end) AS max_obs_period_date,
       0 AS is_meta_analysis
FROM op""",
        ),
        "study_from_files": incidence_oracles()["incidence_two_analyses"],
    }
