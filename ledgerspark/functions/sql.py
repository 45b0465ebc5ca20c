"""SQL-callable forms of ``slug``, ``cents`` and ``period_key`` as SQL functions.

``CREATE TEMPORARY FUNCTION ... RETURN <expr>`` defines SQL UDFs whose bodies Catalyst inlines
into the calling plan, so ``spark.sql`` users get the same JVM-side expressions as the
DataFrame API (no Python in the loop).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = [
    """CREATE OR REPLACE TEMPORARY FUNCTION slug(label STRING) RETURNS STRING RETURN
       CASE WHEN regexp_replace(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_'), '^_+|_+$', '') = ''
            THEN 'uncategorized'
            ELSE regexp_replace(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_'), '^_+|_+$', '') END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION cents(amount DECIMAL(18,2)) RETURNS BIGINT RETURN
       coalesce(CAST(amount * 100 AS BIGINT), 0)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION period_key(d DATE, period STRING) RETURNS STRING RETURN
       CASE period WHEN 'month' THEN date_format(d, 'yyyy-MM')
                   WHEN 'quarter' THEN concat(date_format(d, 'yyyy'), '-Q', CAST(quarter(d) AS STRING))
                   WHEN 'year' THEN date_format(d, 'yyyy')
                   WHEN 'week' THEN concat(CAST(extract(YEAROFWEEK FROM d) AS STRING), '-W',
                                           lpad(CAST(weekofyear(d) AS STRING), 2, '0')) END""",
]


def register_sql_functions(spark: SparkSession) -> None:
    for ddl in _FUNCTIONS:
        spark.sql(ddl)
