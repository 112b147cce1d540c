"""Input views of the registered queries.

One text per view, valid in Spark SQL and in DuckDB. Base tables are written `{orders}`, other views
by name. Nulls, empty strings and dirty text come from arithmetic on keys; every view covers its
whole base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from landroll.sources.tables import read_table

# Columns of the base tables that the registered queries use.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_linestatus STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING",
    "pages": "page_id BIGINT, url STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

STAT_COLUMNS = [f"c{i}" for i in range(9)]

VIEWS: dict[str, str] = {}

VIEWS["claims_v"] = """
SELECT CAST(o.o_orderkey AS STRING) AS id,
 CASE WHEN o.o_orderkey % 29 = 0 THEN '' ELSE c.c_name END AS name,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE concat('Village ', CAST(o.o_custkey % 97 AS STRING)) END AS village,
 CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderkey % 17 = 0 THEN '' ELSE n.n_name END AS district,
 CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE r.r_name END AS state,
 CASE o.o_orderpriority WHEN '1-URGENT' THEN 'IFR' WHEN '2-HIGH' THEN 'CR' WHEN '3-MEDIUM' THEN 'CFR'
   WHEN '5-LOW' THEN 'Individual' END AS claim_type,
 CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 19 = 0 THEN 'In Review'
   WHEN o.o_orderstatus = 'F' THEN 'Approved' WHEN o.o_orderstatus = 'O' THEN 'Pending' ELSE 'Rejected' END AS status,
 CASE WHEN o.o_orderkey % 5 = 0 THEN '' WHEN o.o_orderkey % 31 = 0 THEN '0' WHEN o.o_orderkey % 37 = 0 THEN 'abc'
   WHEN o.o_orderkey % 43 = 0 THEN '5d' ELSE concat(CAST(8 + o.o_custkey % 29 AS STRING), '.5') END AS latitude_in,
 concat(CAST(68 + o.o_custkey % 29 AS STRING), '.25') AS longitude_in,
 CASE WHEN o.o_orderkey % 3 = 0 THEN NULL WHEN o.o_orderkey % 53 = 0 THEN ''
   ELSE concat('Claim Form', chr(10), 'Name of Claimant: ', c.c_name) END AS raw_text,
 CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_orderdate END AS created_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["status_updates_v"] = """
SELECT CASE WHEN event_id % 47 = 0 THEN concat('gone-', CAST(user_id AS STRING))
   ELSE CAST(user_id AS STRING) END AS claim_id,
 CASE event_type WHEN 'purchase' THEN 'Approved' WHEN 'error' THEN 'Rejected' WHEN 'view' THEN 'Pending'
   WHEN 'click' THEN 'In Review' ELSE '' END AS status, ts, event_id FROM {events}
"""

# Raw workbook: one sheet per supplier, so that the workbook grows with the tables. Per sheet a header
# row, one row per state, one blank row; in some sheets every row is a sum, so they have no state at all. There are four
# layouts, told by the first letter of the id: N has one header per group, F the measures that N has not, R ends in a header
# that leads to a key for the second time, A in a remark and empty headers.
VIEWS["stats_counts_v"] = """
SELECT t.sheet_no, n.n_nationkey AS k, n.n_name AS state, t.ind, t.com, t.tind, t.pend, t.rej, t.land
FROM (SELECT l_suppkey AS sheet_no, CAST(l_partkey % 25 AS INT) AS k,
  SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS ind,
  SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS com,
  SUM(CASE WHEN l_linestatus = 'O' AND l_quantity < 25 THEN 1 ELSE 0 END) AS tind,
  SUM(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS pend,
  SUM(CASE WHEN l_discount > 0.07 THEN 1 ELSE 0 END) AS rej,
  SUM(CAST(l_quantity AS BIGINT)) AS land
  FROM {lineitem} GROUP BY l_suppkey, l_partkey % 25) t
JOIN {nation} n ON t.k = n.n_nationkey
"""

LAYOUT = "substr('ANRF', CAST({} % 4 + 1 AS INT), 1)"

VIEWS["stats_names_v"] = f"""
SELECT {LAYOUT.format("s_suppkey")} AS layout, concat({LAYOUT.format("s_suppkey")}, '-', CAST(s_suppkey AS STRING)) AS sheet_id
FROM {{supplier}}
"""

VIEWS["stats_header_v"] = """
SELECT sheet_id, CAST(0 AS INT) AS row_pos, 'Sl. No.' AS c0, 'States/UT' AS c1,
 CASE WHEN layout = 'F' THEN 'TITLES DISTRIBUTED, community' ELSE concat('No. of  Claims Received', chr(10), ' Individual') END AS c2,
 CASE WHEN layout = 'F' THEN 'Total  titles distributed' ELSE 'Number of claims received - Community' END AS c3,
 CASE WHEN layout = 'F' THEN 'Pending claims: individual' ELSE 'Claims Received (Total)' END AS c4,
 CASE layout WHEN 'A' THEN 'Remarks' WHEN 'F' THEN 'Individual claims rejected' ELSE 'Titles Distributed Individual' END AS c5,
 CASE layout WHEN 'A' THEN NULL WHEN 'F' THEN concat('claims rejected', chr(10), 'community') ELSE 'Pending Claims (Community)' END AS c6,
 CASE layout WHEN 'A' THEN '  ' WHEN 'F' THEN 'forest land Individual' ELSE ' Total Claims Rejected ' END AS c7,
 CASE layout WHEN 'N' THEN 'Forest Land (in acres) - Total' WHEN 'F' THEN 'Forest Land (community)'
   WHEN 'R' THEN 'Extent of forest land for which titles distributed (Individual)' END AS c8
FROM stats_names_v
"""

VIEWS["stats_rows_v"] = f"""
SELECT sheet_id, CAST(1000 AS INT) AS row_pos, NULL AS c0, '' AS c1, '  ' AS c2, NULL AS c3, chr(9) AS c4,
 NULL AS c5, '' AS c6, NULL AS c7, NULL AS c8
FROM stats_names_v
UNION ALL
SELECT concat({LAYOUT.format("sheet_no")}, '-', CAST(sheet_no AS STRING)) AS sheet_id,
 CAST(k + 1 AS INT) AS row_pos, CAST(k AS STRING) AS c0,
 CASE WHEN sheet_no % 9 = 4 THEN 'Total' WHEN k % 9 = 8 THEN 'TOTAL' WHEN k % 9 = 7 THEN '  ' WHEN k % 9 = 5 THEN 'Grand Total'
   ELSE concat(' ', state, chr(10)) END AS c1,
 CASE WHEN k % 6 = 1 THEN 'NA/NR' WHEN k % 6 = 2 THEN concat('-', CAST(ind AS STRING), '*')
   WHEN k % 6 = 3 THEN concat('1,', CAST(ind AS STRING)) ELSE CAST(ind AS STRING) END AS c2,
 CASE WHEN k % 4 = 1 THEN '-' ELSE CAST(com AS STRING) END AS c3,
 CASE WHEN k % 3 = 0 THEN CAST(ind + com AS STRING) WHEN k % 3 = 1 THEN '12-3' ELSE NULL END AS c4,
 CAST(tind AS STRING) AS c5, concat(CAST(pend AS STRING), ' #') AS c6,
 CASE WHEN k % 5 = 0 THEN ' na ' ELSE CAST(rej AS STRING) END AS c7,
 CASE WHEN k % 7 = 3 THEN NULL ELSE concat(CAST(land AS STRING), '.1250') END AS c8
FROM stats_counts_v
"""

VIEWS["stats_sheet_v"] = """
SELECT * FROM stats_header_v UNION ALL SELECT * FROM stats_rows_v
"""

# Every turn is one entity span, the whole text of the turn being the entity.
VIEWS["spans_v"] = """
SELECT conv_id AS doc_id, turn AS pos,
 CASE WHEN role = 'system' THEN 'ORG' WHEN role = 'assistant' AND turn % 3 = 0 THEN 'LOC' WHEN role = 'assistant' THEN 'GPE'
   WHEN turn % 4 = 2 THEN 'DATE' ELSE 'PERSON' END AS label,
 CASE WHEN turn % 5 = 1 THEN 'India' ELSE text END AS text
FROM {conversations}
"""

# Every turn is also a page, some with land areas; some documents have spans only, some pages only, some blank pages.
VIEWS["extraction_pages_v"] = """
SELECT conv_id AS doc_id, turn AS page_no,
 CASE WHEN conv_id % 13 = 4 THEN concat(' ', chr(10)) WHEN turn % 7 = 3 THEN NULL
   WHEN turn % 2 = 1 THEN concat(text, ' Area ', CAST(turn AS STRING), '.25 Hectares,', chr(10), CAST(conv_id AS STRING), ' acres') ELSE text END AS text
FROM {conversations} WHERE conv_id % 17 <> 5
"""

VIEWS["extraction_spans_v"] = """
SELECT doc_id, pos, label, text FROM spans_v WHERE doc_id % 19 <> 6
"""

# A form has the text of a document between its fields, where there is one of its number.
VIEWS["form_text_v"] = """
SELECT c_custkey AS doc_id, concat('Forest Rights Act Claim Form', chr(10), 'Name of Claimant: ', c_name, chr(10),
 'Village- V', CAST(c_custkey % 97 AS STRING), '  ', chr(10),
 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('District: ', n_name, chr(10)) END,
 'STATE: ', r_name, chr(10), coalesce(body, ''), chr(10), 'Claim Type: ', c_mktsegment, chr(10), 'Status: Approved', chr(10),
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('Coordinates: ', CAST(8 + c_custkey % 29 AS STRING), '.1234, ',
   CAST(68 + c_custkey % 29 AS STRING), '.5', chr(10)) END,
 CASE WHEN c_custkey % 11 = 0 THEN 'no land' ELSE concat('Area ', CAST(c_custkey % 13 AS STRING), '.5 hectares and 3 ACRES') END)
 AS raw_text
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
LEFT JOIN (SELECT doc_id AS body_id, text AS body FROM {documents}) ON body_id = c_custkey
"""

# The ledger holds all document texts; a batch of the same size sends some again and others revised.
VIEWS["ledger_texts_v"] = """
SELECT doc_id AS id, text AS raw_text FROM {documents}
"""

VIEWS["new_claims_v"] = """
SELECT doc_id AS arrival, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN '' ELSE source END AS name,
 lang AS state,
 CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN text
   ELSE concat(text, ' (revised)') END AS raw_text
FROM {documents}
"""

VIEWS["engine_outputs_v"] = """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat(' ', chr(10)) WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS primary_text,
 CASE WHEN doc_id % 4 = 0 THEN 'engine error' END AS primary_error,
 CASE WHEN doc_id % 20 = 0 THEN chr(9) ELSE concat('fallback ', text) END AS fallback_text
FROM {documents}
"""

BASE_TABLE = re.compile(r"\{(\w+)\}")


def view_names_in(sql: str) -> list[str]:
    """Views that a text mentions, those they are built on first."""
    found: list[str] = []
    for name, body in VIEWS.items():
        if re.search(rf"\b{name}\b", sql):
            for needed in [*view_names_in(body), name]:
                if needed not in found:
                    found.append(needed)
    return found


def with_views(sql: str) -> str:
    """Put the views a query mentions in front of it as common table expressions."""
    names = view_names_in(sql)
    views = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    if not names:
        return sql
    own = sql.removeprefix("WITH ")
    return f"WITH {views}, {own}" if own != sql else f"WITH {views} {sql}"


def base_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name, schema=TABLES[name])


def load_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = with_views(f"SELECT * FROM {name}")
    tables = {t: base_table(spark, folder, t) for t in sorted(set(BASE_TABLE.findall(sql)))}
    return spark.sql(sql, **tables)


def portable(sql: str) -> str:
    """The query for an engine that has the base tables registered under their own names."""
    return BASE_TABLE.sub(r"\1", with_views(sql))
