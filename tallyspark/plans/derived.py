"""Invoices derived from the star schema: inputs of the registered queries.

The SQL runs alike in Spark and in DuckDB; table names in braces are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.numeric import round2
from tallyspark.operators import extraction

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def r2(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 100 + 0.5) / 100 + 0.0)"


def gstin(nation: str, key: str) -> str:
    """A number of the right shape that follows from a nation and a key."""
    state = f"lpad(CAST({nation} % 38 + 1 AS STRING), 2, '0')"
    return f"concat({state}, 'ABCDE', lpad(CAST({key} % 10000 AS STRING), 4, '0'), 'F1Z', substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({key} % 36 + 1 AS INT), 1))"


HEADS = f"""
SELECT o.o_orderkey AS order_id, o.o_totalprice AS price, o.o_orderdate AS ordered,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE {gstin('s.s_nationkey', 's.s_suppkey')} END AS seller,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE {gstin('c.c_nationkey', 'c.c_custkey')} END AS buyer
FROM {{orders}} o
JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM (SELECT {{dealt}} l_orderkey, l_suppkey FROM {{lineitem}}) GROUP BY l_orderkey) m ON m.l_orderkey = o.o_orderkey
JOIN {{supplier}} s ON s.s_suppkey = m.supp
JOIN {{customer}} c ON c.c_custkey = o.o_custkey
"""

LINES = f"""
SELECT h.order_id, h.seller, h.buyer, l.l_linenumber AS line_no, l.l_partkey AS part, l.l_suppkey AS supp, l.l_extendedprice AS ext,
  CASE WHEN l.l_partkey % 50 = 7 THEN '' ELSE concat('Part ', CAST(l.l_partkey AS STRING)) END AS description,
  CASE WHEN l.l_partkey % 40 = 3 THEN 0.0E0 ELSE l.l_quantity END AS quantity,
  {r2('l.l_extendedprice / l.l_quantity')} AS rate,
  CASE WHEN l.l_partkey % 3 = 0 THEN {r2('l.l_extendedprice * l.l_discount')} END AS discount,
  CASE WHEN l.l_partkey % 4 <> 0 THEN {r2('l.l_extendedprice - l.l_extendedprice * l.l_discount')} END AS given,
  CASE WHEN l.l_partkey % 13 <> 0 THEN l.l_tax * 100 + (l.l_partkey % 3) * 0.2E0 END AS gst,
  CASE WHEN l.l_partkey % 10 = 2 THEN 12.34E0 END AS cgst,
  CASE WHEN l.l_partkey % 10 = 2 THEN 12.35E0 END AS sgst,
  CASE WHEN l.l_partkey % 10 = 1 THEN 56.78E0 END AS igst
FROM ({HEADS}) h JOIN {{lineitem}} l ON l.l_orderkey = h.order_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark's reading of a text whose tables are Parquet files.

    ``{dealt}`` fixes the number of partitions of the orders: what follows computes far more than it
    reads, so they must not be merged by their size in bytes.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = text.replace("{dealt}", f"/*+ REPARTITION({parts}, l_orderkey) */")
    for t in TABLES:
        text = text.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def duck(text: str) -> str:
    text = text.replace("{dealt}", "")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


#: Order of an invoice's lines.
LINE_ORDER = ("line_no", "part", "supp", "ext")


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: order_id, keys (the lines' order), raw (the record)."""
    lines = sql(spark, sf_dir, LINES)
    of = {"description": "description", "quantity": "quantity", "rate": "rate", "discount": "discount", "taxableAmount": "given", "gstRate": "gst",
          "cgstAmount": "cgst", "sgstAmount": "sgst", "igstAmount": "igst"}
    raw = F.struct(*((F.col(of[n]).cast("string") if n in of else F.lit(None).cast("string")).alias(n) for n in extraction.LINE))
    grouped = lines.groupBy("order_id", "seller", "buyer").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, raw.alias("raw")))).alias("lines"))

    def party(name: str):
        return F.struct(*({"name": F.lit("Acme"), "gstin": F.col(name)}.get(n, F.lit(None).cast("string")).alias(n) for n in extraction.PARTY))

    nothing = F.lit(None).cast("string")
    # a printed grand total on some: near the sum of the lines, or far off
    worth = F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.coalesce(x["raw"]["taxableAmount"].cast("double"), F.lit(0.0)))
    printed = F.when(F.col("order_id") % 4 == 1, F.floor(round2(worth)).cast("string")).when(F.col("order_id") % 4 == 2, F.lit("100"))
    totals = F.struct(*({"grandTotal": printed}.get(n, nothing).alias(n) for n in extraction.TOTALS))
    record = F.struct(
        party("seller").alias("seller"), party("buyer").alias("buyer"), F.struct(*(nothing.alias(n) for n in extraction.META)).alias("invoice"),
        F.transform("lines", lambda x: x["raw"]).alias("lineItems"), F.array().cast("array<" + extraction._struct(extraction.SLAB) + ">").alias("taxSummary"), totals.alias("totals"),
    )
    return grouped.select("order_id", "seller", "buyer", F.transform("lines", lambda x: F.struct(*(x[k].alias(k) for k in LINE_ORDER))).alias("keys"), record.alias("raw"))


PAGE = """
SELECT order_id, concat('# TAX INVOICE', chr(10), 'Seller GSTIN: ', coalesce(seller, 'none'), chr(10), 'Buyer GSTIN: ', coalesce(buyer, 'none'), chr(10),
  'Invoice No: INV-', CAST(order_id AS STRING), chr(10), 'Invoice Date: ', lpad(CAST(day(ordered) AS STRING), 2, '0'), '/', lpad(CAST(month(ordered) AS STRING), 2, '0'), '/', CAST(year(ordered) AS STRING), chr(10),
  CASE WHEN order_id % 3 = 0 THEN concat('Payment Due: ', CAST(order_id % 90 AS STRING), ' Days') WHEN order_id % 3 = 1 THEN concat('Net ', CAST(order_id % 60 AS STRING)) ELSE 'Due Date: 2026-08-12' END, chr(10),
  'PIN ', CAST(110000 + order_id % 800000 AS STRING), ' HSN: ', CAST(1000 + order_id % 9000 AS STRING)) AS head,
  concat('Grand Total: ', CAST(CAST(floor(price) AS BIGINT) AS STRING), '.', lpad(CAST(order_id % 100 AS STRING), 2, '0')) AS foot
FROM ({heads})
""".replace("{heads}", HEADS)

ROWS = f"""
SELECT order_id, line_no, part, supp, ext, concat('| ', CAST(line_no AS STRING), ' | ', description, ' | ', CAST(1000 + part % 9000 AS STRING), ' | ', CAST(CAST(quantity AS INT) AS STRING), ' | ',
  CAST(CAST(floor(rate) AS BIGINT) AS STRING), ' | ', CAST(CAST(floor(ext) AS BIGINT) AS STRING), ' | 18 |') AS line
FROM ({LINES})
"""

TABLE_HEAD = "| Sr | Description | HSN | Qty | Rate | Taxable | GST % |"
TABLE_RULE = "|----|----|----|----|----|----|----|"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown invoice an order: order_id, head, foot, text."""
    rows = sql(spark, sf_dir, ROWS).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "line"))).alias("rows"))
    page = sql(spark, sf_dir, PAGE)
    lines = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    text = F.concat_ws("\n", "head", F.lit(""), F.lit(TABLE_HEAD), F.lit(TABLE_RULE), lines, F.lit(""), "foot")
    return page.join(rows, "order_id").select("order_id", "head", "foot", text.alias("text"))


#: The same documents for DuckDB: a query with columns order_id, head, foot, text.
DOCUMENTS_SQL = f"""
SELECT p.order_id, p.head, p.foot, concat(p.head, chr(10), chr(10), '{TABLE_HEAD}', chr(10), '{TABLE_RULE}', chr(10), r.body, chr(10), chr(10), p.foot) AS text
FROM ({PAGE}) p JOIN (SELECT order_id, string_agg(line, chr(10) ORDER BY line_no, part, supp, ext) AS body FROM ({ROWS}) GROUP BY order_id) r ON r.order_id = p.order_id
"""
