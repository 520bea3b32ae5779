"""Inputs of the registered queries: the given tables and the views derived from them, in Spark and as check SQL."""

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quoteflow.sources.store import stored

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# The same text runs in both engines; `threads` alone differs in how a text is aggregated in order.
VIEWS = {
    "catalog_rows": """
SELECT p_partkey AS position,
       upper(replace(p_brand, '#', '-')) || '/' || CAST(p_size AS VARCHAR(10)) AS code,
       p_name || ' ' || p_type || ', ' || CAST(p_size AS VARCHAR(10)) || 'MM' AS description,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'c.' || CAST(p_partkey % 900 AS VARCHAR(10)) END AS customer_code,
       CASE WHEN p_partkey % 7 = 0 THEN replace(replace(p_name, 'widget', 'wiget'), 'plate', 'plte')
            ELSE p_name || 's ' || lower(p_type) END AS customer_description
FROM part""",
    "rfq_lines": """
SELECT l_orderkey AS rfq_id, line_index, s.customer_description AS description,
       CASE WHEN line_index % 3 = 0 THEN NULL
            WHEN line_index % 3 = 1 THEN lower(s.code)
            ELSE 'C-' || CAST((l_partkey + 1) % 900 AS VARCHAR(10)) END AS customer_code,
       CASE WHEN line_index % 11 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) || ' coil'
            ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) || ',5' END AS quantity,
       CASE WHEN l_returnflag = 'N' THEN 'pcs' ELSE 'box' END AS uom,
       'file' || CAST(l_suppkey % 2 AS VARCHAR(10)) || '.xlsx#S row ' || CAST(line_index AS VARCHAR(10)) AS source,
       CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(12,2)) + CAST(0.25 AS DECIMAL(12,2)) AS unit_price,
       l_suppkey, l_partkey
FROM (SELECT l.*, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
             l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS BIGINT) AS line_index
      FROM lineitem l) x
JOIN catalog_rows s ON s.position = x.l_partkey""",
    "verdicts": """
SELECT o_orderkey AS email_id,
       CASE o_orderkey % 13 WHEN 0 THEN 'NEW_RFQ' WHEN 1 THEN 'UPDATED_RFQ' WHEN 2 THEN 'PORTAL_RFQ_NOTIFICATION'
         WHEN 3 THEN 'CUSTOMER_ORDER_PO' WHEN 4 THEN 'CUSTOMER_CLARIFICATION' WHEN 5 THEN 'SUPPLIER_CORRESPONDENCE'
         WHEN 6 THEN 'QUOTE_STATUS_NOTIFICATION' WHEN 7 THEN 'INTERNAL' WHEN 8 THEN 'OUTBOUND_OWN' WHEN 9 THEN 'SPAM_MARKETING'
         WHEN 10 THEN 'AUTO_REPLY_SYSTEM' WHEN 11 THEN 'OTHER_NON_ACTIONABLE' ELSE 'UNCERTAIN' END AS category,
       CAST(o_custkey % 101 AS DOUBLE) / 100 AS confidence,
       o_orderkey % 4 = 0 AS answered_is_rfq,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' ELSE 'NORMAL' END AS priority,
       o_orderkey % 10 = 9 AS strong_signal, o_orderdate AS received_at, o_custkey
FROM orders""",
    "threads": """
SELECT conv_id, {aggregate} AS body
FROM (SELECT conv_id, turn, CASE WHEN newest THEN text
         ELSE 'From: ' || role || chr(10) || 'Sent: turn ' || CAST(turn AS VARCHAR(10)) || chr(10)
              || 'Subject: c' || CAST(conv_id AS VARCHAR(10)) || chr(10) || chr(10) || text END AS piece
      FROM (SELECT c.*, turn = max(turn) OVER (PARTITION BY conv_id) AS newest FROM conversations c) n) p
GROUP BY conv_id""",
    "cells": """
SELECT grid_id, row_no, col_no, value FROM (
  SELECT o_orderkey AS grid_id, CAST(0 AS BIGINT) AS row_no, 0 AS col_no, 'DECK STORES' AS value FROM orders
  UNION ALL
  SELECT o.o_orderkey, CAST(1 AS BIGINT), h.col_no, h.value FROM orders o CROSS JOIN
    (SELECT 0 AS col_no, 'ITEM CODE' AS value UNION ALL SELECT 1, 'Description' UNION ALL SELECT 2, 'QTY' UNION ALL SELECT 3, 'U/M'
     UNION ALL SELECT 4, 'REMARKS' UNION ALL SELECT 6, 'BAG 16 KG') h
  UNION ALL
  SELECT rfq_id, line_index + 1, k.col_no,
         CASE k.col_no WHEN 0 THEN customer_code WHEN 1 THEN description WHEN 2 THEN quantity WHEN 3 THEN uom
              WHEN 4 THEN CASE WHEN line_index = 5 THEN 'urgent' END ELSE 'UOM ' || CAST(line_index AS VARCHAR(10)) END
  FROM rfq_lines CROSS JOIN (SELECT 0 AS col_no UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 6) k
  UNION ALL
  SELECT rfq_id, max(line_index) + 2, 1, 'TOTAL' FROM rfq_lines GROUP BY rfq_id
  UNION ALL
  SELECT o.o_orderkey, CAST(100 AS BIGINT), h.col_no, h.value FROM orders o CROSS JOIN
    (SELECT 1 AS col_no, 'Material' AS value UNION ALL SELECT 2, 'Req. Qty' UNION ALL SELECT 3, 'Stock' UNION ALL SELECT 5, 'Notes') h
    WHERE o.o_orderkey % 3 = 0
  UNION ALL
  SELECT rfq_id, 100 + line_index * 2, k.col_no, CASE k.col_no WHEN 1 THEN description ELSE quantity END
  FROM rfq_lines CROSS JOIN (SELECT 1 AS col_no UNION ALL SELECT 2) k WHERE rfq_id % 3 = 0 AND line_index % 2 = 0
) t WHERE value IS NOT NULL""",
    "mails": """
SELECT o_orderkey AS message_id, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'CAUTION: External sender' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CASE WHEN o_orderkey % 13 = 0 THEN 'Message: ' ELSE 'From: ' END || 'Buyer ' || CAST(o_custkey AS VARCHAR(10)) || CASE WHEN o_orderkey % 2 = 0 THEN ' (C' ELSE ' <C' END || CAST(o_custkey % 50 AS VARCHAR(10)) || '@'
     || CASE o_custkey % 6 WHEN 0 THEN 'Own.example' WHEN 1 THEN 'portal.example' WHEN 2 THEN 'customer.example' WHEN 3 THEN 'supplier.example' WHEN 4 THEN 'elsewhere.example' ELSE 'own.example' END || CASE WHEN o_orderkey % 2 = 0 THEN ')' ELSE '>' END || chr(10)
     || 'To: Desk <desk@own.example>' || CASE WHEN o_orderkey % 3 = 0 THEN ', buyer@elsewhere.example' ELSE '' END || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN 'Cc: "Desk, Two" <Two@own.example>, nobody' || chr(10) ELSE '' END
     || 'Sent: Tuesday, May 26' || chr(10) || 'Subject: ' || CASE o_orderkey % 4 WHEN 0 THEN 'RE: FW: [Updated]Stores' WHEN 1 THEN 'fwd :re: VSL: NORTH STAR' WHEN 2 THEN 'Stores RE: later' ELSE '' END || chr(10)
     || CASE WHEN o_orderkey % 6 = 0 THEN 'Attachments: E_QUOT ' || CAST(o_orderkey AS VARCHAR(10)) || '.xlsx, image001.png, , e_quot.pdf' || chr(10) ELSE '' END || 'Subject: ' || CASE o_orderkey % 4 WHEN 0 THEN 'RE: FW: [Updated]Stores' WHEN 1 THEN 'fwd :re: VSL: NORTH STAR' WHEN 2 THEN 'Stores RE: later' ELSE '' END || chr(10) || chr(10) END
  || CASE WHEN o_orderkey % 17 = 0 THEN 'ok' ELSE 'Dear all,' || chr(10) || 'Vessel: North Star ' || CAST(o_custkey AS VARCHAR(10)) || ' - ' || 'eta 12 Oct 2024' || chr(10) || 'IMO: ' || CAST(9000000 + o_orderkey AS VARCHAR(10)) || chr(10)
     || CASE WHEN o_orderkey % 3 = 0 THEN 'RFQ No: AB-' || CAST(o_orderkey AS VARCHAR(10)) || '/24' || chr(10) || 'Quote Before: 12-Oct-2024' || chr(10) ELSE '' END || 'Delivery Port: ' || CASE o_orderkey % 5 WHEN 0 THEN 'Jebel Ali' WHEN 1 THEN 'Tuas - Singapore' WHEN 2 THEN 'Rotterdam' WHEN 3 THEN 'Dubai or Singapore' ELSE 'Khor Fakkan' END || chr(10)
     || CASE WHEN o_orderkey % 4 = 1 THEN 'this is urgent, ASAP please, urgent' || chr(10) ELSE '' END || 'from the portal mail tool' || chr(10) || chr(10) || chr(10) || 'Kind regards,' || chr(10) || 'Name' || chr(10) || 'Buyer' || chr(10) || chr(10) || 'Line three' || chr(10) || 'Line four' || chr(10)
     || CASE WHEN o_orderkey % 8 = 0 THEN 'price list' ELSE 'www.ship.example' END || chr(10) || CASE WHEN o_orderkey % 9 = 0 THEN 'This email and any associated files are private' || chr(10) ELSE '' END END
  || CASE WHEN o_orderkey % 2 = 1 THEN chr(10) || '-----Original Message-----' || chr(10) || 'From: desk' || chr(10) || 'Sent: Monday' || chr(10) || 'Subject: old' || chr(10) || chr(10) || 'the old text' ELSE '' END AS raw_text
FROM orders""",
    "journal": """
SELECT event_id AS ord, user_id AS decision_id, ts AS recorded_at,
       CASE event_type WHEN 'click' THEN 'extraction' WHEN 'purchase' THEN 'delivery' WHEN 'error' THEN NULL ELSE 'decision' END AS type,
       value, props
FROM events""",
    "predictions": """
SELECT l.doc_id AS email_id, p.pass AS pass_no,
       CASE WHEN quality = 1 AND toxic = 0 THEN 'NEW_RFQ' WHEN quality = 1 THEN 'UPDATED_RFQ' WHEN toxic = 0 THEN 'INTERNAL' ELSE 'SPAM_MARKETING' END AS expected,
       CASE WHEN n_chars % 10 = p.pass THEN 'UNCERTAIN' WHEN n_chars > 1500 THEN 'NEW_RFQ' WHEN n_chars > 700 THEN 'UPDATED_RFQ' ELSE 'INTERNAL' END AS predicted,
       CASE WHEN n_chars % 3 = 0 THEN 'IGNORE' ELSE 'HUMAN_REVIEW' END AS recommended_action,
       n_chars % 2 = 0 AS needs_human_review,
       n_chars % 7 = 0 AS held_out,
       CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars END AS latency_ms
FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (SELECT 1 AS pass UNION ALL SELECT 2) p""",
}
AGGREGATE = {
    "spark": "array_join(transform(array_sort(collect_list(struct(-turn AS k, piece AS v))), x -> x.v), chr(10))",
    "check": "string_agg(piece, chr(10) ORDER BY turn DESC)",
}


# Views whose rows are much work beside the bytes they are made of, so that a scan would make few tasks: the table and
# the key by which it is dealt out before.
DEALT = {"mails": ("orders", "o_orderkey")}
# Views that stand for stored tables are written once per session and folder.
KEPT = ["rfq_lines", "cells", "threads"]
_STORED: dict[tuple[str, str, str], object] = {}


def _uses(text: str, names) -> list[str]:
    return [name for name in names if re.search(rf"(?<![.\w]){name}(?![\w(])", text)]


class Inputs:
    """Tables of one folder as DataFrames, and the derived views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in KEPT:
            view = VIEWS[name].replace("{aggregate}", AGGREGATE["spark"])
            return self.kept(name, lambda: stored(self.sql(view), name))
        if name in VIEWS:
            return self.sql(VIEWS[name].replace("{aggregate}", AGGREGATE["spark"]), *DEALT.get(name, ()))
        raise AttributeError(name)

    def kept(self, label: str, make: Callable):
        """Something made once per session and folder: an index, a table several queries read."""
        key = (self.spark.sparkContext.applicationId, self.folder, label)
        if key not in _STORED:
            _STORED[key] = make()
        return _STORED[key]

    def sql(self, text: str, dealt: str = "", key: str = "") -> DataFrame:
        """Run SQL over the tables and views by name; whole number division is spelled `//` in the shared texts.

        The table `dealt` is dealt out by `key` before.
        """
        text = text.replace(" // ", " div ").replace("{", "{{").replace("}", "}}")
        names = _uses(text, [*TABLES, *VIEWS])
        frames = {f"df_{name}": getattr(self, name) for name in names}
        if dealt:
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            frames[f"df_{dealt}"] = frames[f"df_{dealt}"].repartition(tasks, key)
        for name in names:
            text = re.sub(rf"(?<=FROM ){name}\b|(?<=JOIN ){name}\b", "{df_" + name + "}", text)
        return self.spark.sql(text, **frames)


def check_sql(text: str) -> str:
    """The check query with the views it needs in front of it."""
    order: list[str] = []

    def need(body: str) -> None:
        for name in _uses(body, VIEWS):
            if name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(text)
    views = [
        f"{name} AS ({VIEWS[name].replace('{aggregate}', AGGREGATE['check']).strip()})" for name in order
    ]
    body = text.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(views) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body


@dataclass(frozen=True)
class Query:
    """A registered query: the operator's place in the survey, its job, and its check SQL where SQL can say it."""

    operator: str
    name: str
    run: Callable[[Inputs], DataFrame]
    sql: str | None = None
    why_no_sql: str = ""
