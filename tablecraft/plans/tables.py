"""Tables and derived views; the view text is the same for Spark and for the reference SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions.columns import col
from tablecraft.functions.durable import checkpoint_dir

_DIRTY = """SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('  ', o_orderpriority, ' ') END AS o_orderpriority,
  CASE WHEN o_orderkey % 10 < 8 THEN NULL ELSE o_custkey END AS mostly_null,
  CAST(NULL AS DOUBLE) AS all_null, o_orderdate FROM {orders}"""

VIEWS = {
    # Every order, with gaps and padding put in; one status appears twice and some rows are empty.
    "dirty_orders": f"""{_DIRTY}
  UNION ALL {_DIRTY} WHERE o_orderstatus = 'P'
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL FROM {{orders}} WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'""",
    "string_dates": """SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS d FROM {orders}""",
    "mixed_text": """SELECT o_orderkey, o_orderdate, o_orderstatus,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS all_numbers,
  CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END AS some_numbers,
  CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS days,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM {orders}""",
    "correlated_lineitem": """SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 + l_tax AS q2 FROM {lineitem}""",
    "flagged_events": """SELECT event_id, user_id, value, value * value AS value_sq, event_type, props,
  CASE WHEN value > 40 THEN 'rare' ELSE 'usual' END AS flag FROM {events}""",
    "text_labels": "SELECT CAST(toxic AS STRING) AS toxic, CAST(quality AS STRING) AS quality FROM {labels}",
    "binary_pred": """SELECT CAST(l.quality AS DOUBLE) AS label, CASE WHEN d.n_chars > 1000 THEN 1.0E0 ELSE 0.0E0 END AS prediction
  FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "weighted_pred": """SELECT CAST(l_linenumber % 4 AS DOUBLE) AS label, CAST(floor(l_quantity / 13) AS DOUBLE) AS prediction FROM {lineitem}""",
    "reg_pred": "SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * 2000 AS prediction FROM {lineitem}",
    "gappy_customer": """SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS gappy FROM {customer}""",
    "doc_features": """SELECT l.doc_id, d.n_chars, d.lang, d.source, l.toxic, l.quality
  FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", sql))}
    return spark.sql(sql, **tables)


def sql_view(name: str) -> str:
    """The view as a parenthesised subquery for the reference SQL."""
    return "(" + re.sub(r"{(\w+)}", r"\1", VIEWS[name]) + ")"


def scratch(spark: SparkSession) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Doubles rounded, integers widened, dates and timestamps as text: a canonical form for comparison."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), col(f.name)
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), per_column.get(f.name, digits))
        elif kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
