"""Input tables, and the inputs derived from them.

The derived ones are plain SQL over the given tables that Spark and the checking engine both run;
``{name}`` stands for a table. They grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veil.sources.files import read_spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Chat turns with known planted values; ``turn`` is the order key, unique and rising per session.
MESSAGES = """
SELECT c AS conv_id, k AS turn, CASE k % 8
  WHEN 0 THEN 'my name is ' || nm WHEN 1 THEN 'token = "' || h || '"'
  WHEN 2 THEN 'my card is ' || card WHEN 3 THEN 'call ' || ph
  WHEN 4 THEN 'can i change my oassword to ' || substr(h, 1, 9)
  WHEN 5 THEN 'what is a strong password?' WHEN 6 THEN 'tell ' || nm || ' that ' || card || ' is ready'
  ELSE 'see page 834 for details' END AS text,
  CASE k % 8 WHEN 0 THEN nm WHEN 1 THEN h WHEN 2 THEN card WHEN 3 THEN ph
    WHEN 4 THEN substr(h, 1, 9) WHEN 6 THEN card END AS planted,
  CASE k % 8 WHEN 0 THEN 'NAME' WHEN 1 THEN 'SECRET' WHEN 2 THEN 'CARD' WHEN 3 THEN 'PHONE'
    WHEN 4 THEN 'SECRET' WHEN 6 THEN 'CARD' END AS cat
FROM (SELECT o_orderkey AS k, o_custkey AS c,
  split_part('Asha,Ravi,Meera,Arjun,Priya', ',', CAST(o_orderkey % 5 + 1 AS INT)) AS nm,
  md5(CAST(o_orderkey AS STRING)) AS h,
  '4' || lpad(CAST(o_custkey * 7919 AS STRING), 15, '0') AS card,
  '+1 (' || CAST(200 + o_orderkey % 700 AS STRING) || ') 555-'
    || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') AS ph FROM {orders}) o
"""

# Chat turns in which values come back: people by surname or backwards, a card number, a term of a rule.
TALKS = """
SELECT c AS conv_id, k AS turn, k % 9 AS t, nm, sur, card, h, CASE k % 9
  WHEN 0 THEN 'my name is ' || nm || ' ' || sur WHEN 1 THEN 'please tell ' || sur || ' that the report is late'
  WHEN 2 THEN 'the label reads ' || reverse(nm || sur) WHEN 3 THEN 'my card is ' || card || ' and my friend is ' || nm
  WHEN 4 THEN 'move project falcon to monday' WHEN 5 THEN 'token = "' || h || '" belongs to ' || sur
  WHEN 6 THEN 'see page 834 for details' WHEN 7 THEN 'is ' || card || ' the right one?'
  ELSE nm || ' wrote to ' || substr(h, 1, 9) || '@mail.example.com' END AS text
FROM (SELECT o_orderkey AS k, o_custkey AS c,
  split_part('Asha,Ravi,Meera,Arjun,Priya', ',', CAST(o_orderkey % 5 + 1 AS INT)) AS nm,
  split_part('Kapoor,Sharma,Iyengar', ',', CAST(floor(o_orderkey / 9) % 3 + 1 AS INT)) AS sur,
  md5(CAST(o_orderkey AS STRING)) AS h,
  '4' || lpad(CAST(o_custkey * 7919 AS STRING), 15, '0') AS card FROM {orders}) o
"""

# Rows of a file per nation, header at row 0; ``row_idx`` rises with the customer key.
GRID = """
SELECT DISTINCT c_nationkey AS file_id, CAST(0 AS BIGINT) AS row_idx, 'Customer Name' AS c0,
  'Segment' AS c1, 'Mobile No' AS c2, 'Amount' AS c3 FROM {customer}
UNION ALL
SELECT c_nationkey, c_custkey + 1, c_name, c_mktsegment,
  '555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'),
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) FROM {customer}
"""

# Text boxes of a four-column table per order, rows 40 px and columns 200 px apart, with jitter.
BOXES = """
SELECT image_id, CAST((rn - 1) * 4 + col AS INT) AS region_id,
  CASE col WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN CAST(l_suppkey AS STRING)
    WHEN 2 THEN l_returnflag ELSE l_linestatus END AS text,
  CAST(col * 200 + l_partkey % 15 AS DOUBLE) AS x0, CAST(rn * 40 + l_suppkey % 9 AS DOUBLE) AS y0,
  CAST(col * 200 + l_partkey % 15 + 120 AS DOUBLE) AS x1,
  CAST(rn * 40 + l_suppkey % 9 + 24 AS DOUBLE) AS y1
FROM (SELECT l_orderkey AS image_id, l_partkey, l_suppkey, l_returnflag, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_shipdate) AS rn FROM {lineitem}) x
CROSS JOIN (VALUES (0), (1), (2), (3)) AS f(col)
"""

# Form fields of a page per customer; some hidden, without height, or below the viewport.
ELEMENTS = """
SELECT c_custkey AS page_id, i AS el_id, CASE i WHEN 1 THEN 'password' ELSE 'text' END AS type,
  CASE i WHEN 2 THEN 'cc-number' ELSE '' END AS autocomplete,
  CASE i WHEN 0 THEN 'Full name' END AS aria_label, CASE i WHEN 3 THEN 'Segment' END AS placeholder,
  CASE i WHEN 4 THEN 'balance' END AS name,
  CASE i WHEN 0 THEN c_name || CASE WHEN c_custkey % 3 = 0 THEN ' c' || CAST(c_custkey AS STRING) || '@mail.example.com' ELSE '' END
    WHEN 2 THEN '4785380592391139' WHEN 3 THEN c_mktsegment WHEN 4 THEN '' ELSE 'hunter2' END AS value,
  CASE WHEN c_custkey % 7 = 0 AND i = 3 THEN 'none' ELSE 'block' END AS display,
  'visible' AS visibility, CAST(1.0 AS DOUBLE) AS opacity, CAST(40 AS DOUBLE) AS left_px,
  CAST(i * 60 + c_custkey % 500 AS DOUBLE) AS top_px, CAST(200 AS DOUBLE) AS width,
  CAST((i + c_custkey) % 5 * 8 AS DOUBLE) AS height
FROM {customer} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS f(i)
"""

# One sentence per order from a set of templates, with the value that has to be found in it.
SENTENCES = """
SELECT k AS doc_id, t, CASE t
  WHEN 0 THEN 'my aadhaar is ' || v WHEN 1 THEN 'pan ' || v || ' attached' WHEN 2 THEN 'ifsc ' || v
  WHEN 3 THEN 'pay to ' || v || ' today' WHEN 4 THEN 'meet at ' || v WHEN 5 THEN 'cvv ' || v
  WHEN 6 THEN 'one time password ' || v WHEN 7 THEN 'door code for my building is ' || v
  WHEN 8 THEN 'pin code ' || v WHEN 9 THEN 'my password for gmail is ' || v
  WHEN 10 THEN v || ' is my password' WHEN 11 THEN 'use ' || v || ' for the api'
  WHEN 12 THEN 'my wife ' || v || ' said so' WHEN 13 THEN 'Dr. ' || v || ' called'
  WHEN 14 THEN 'i work at ' || v WHEN 15 THEN 'date of birth: ' || v
  WHEN 16 THEN 'my salary is ' || v WHEN 17 THEN v WHEN 18 THEN 'account number ' || v
  WHEN 19 THEN 'my username is ' || v WHEN 20 THEN 'payload ' || v
  WHEN 21 THEN 'I was diagnosed with diabetes' WHEN 22 THEN 'password manager recommended'
  ELSE 'Forgot Password?' END AS text, v AS planted
FROM (SELECT k, t, CASE t
  WHEN 0 THEN '2' || lpad(CAST(k AS STRING), 11, '0')
  WHEN 1 THEN 'ABCDE' || lpad(CAST(k % 10000 AS STRING), 4, '0') || 'F'
  WHEN 2 THEN 'HDFC0' || lpad(CAST(k AS STRING), 6, '0')
  WHEN 3 THEN 'user' || CAST(k AS STRING) || '@okaxis'
  WHEN 4 THEN CAST(10 + k % 80 AS STRING) || '.5204, 73.' || lpad(CAST(k % 10000 AS STRING), 4, '0')
  WHEN 5 THEN lpad(CAST(k % 1000 AS STRING), 3, '0') WHEN 6 THEN lpad(CAST(k AS STRING), 6, '0')
  WHEN 7 THEN lpad(CAST(k % 10000 AS STRING), 4, '0') WHEN 8 THEN lpad(CAST(k AS STRING), 6, '4')
  WHEN 9 THEN 'hunter' || CAST(k AS STRING) WHEN 10 THEN 'kite#' || CAST(k AS STRING)
  WHEN 11 THEN 'ghp_' || md5(CAST(k AS STRING)) WHEN 12 THEN 'Meera' WHEN 13 THEN 'Arjun'
  WHEN 14 THEN 'Acme' WHEN 15 THEN '12/03/' || CAST(1950 + k % 50 AS STRING)
  WHEN 16 THEN 'Rs. ' || CAST(10000 + k AS STRING)
  WHEN 17 THEN 'H.No ' || CAST(k AS STRING) || ', Sector 5, Nehru Nagar'
  WHEN 18 THEN lpad(CAST(k AS STRING), 9, '7') WHEN 19 THEN 'bob_' || CAST(k AS STRING)
  WHEN 20 THEN hex('password=' || CAST(k AS STRING) || 'x9') END AS v
  FROM (SELECT o_orderkey AS k, o_orderkey % 24 AS t FROM {orders}) o) x
"""

# Sheets of a workbook per order status: one sheet per priority, a cell missing here and there.
SHEETS = """
SELECT o_orderstatus AS file_id, o_orderpriority AS sheet, o_orderkey AS row_idx,
  CAST(o_orderkey AS STRING) AS c0, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS STRING) END AS c1,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS c2 FROM {orders}
"""

# Pages of a document per conversation; short turns make nearly empty pages.
PDF = """
SELECT conv_id AS file_id, turn + 1 AS page_no, CASE WHEN conv_id % 4 = 0 THEN substr(text, 1, 12)
  ELSE text END AS words FROM {conversations}
"""

DERIVED = {"messages": (MESSAGES, ("orders",)), "talks": (TALKS, ("orders",)), "grid": (GRID, ("customer",)),
           "boxes": (BOXES, ("lineitem",)), "elements": (ELEMENTS, ("customer",)),
           "sentences": (SENTENCES, ("orders",)), "sheets": (SHEETS, ("orders",)),
           "pdf": (PDF, ("conversations",))}


# Tables whose rows cost much work each: texts, and what texts are derived from (in bytes of the files for a
# task; a row of orders takes some 18 of them and makes a sentence, one of lineitem some 10 and makes four boxes).
HEAVY = {"documents": 2 << 20, "pages": 2 << 20, "conversations": 2 << 20, "orders": 256 << 10,
         "lineitem": 1 << 20}
# Dealt out by the key that they are grouped by: the boxes of a picture.
KEYS = {"lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_spread(spark, path, HEAVY[name], KEYS.get(name)) if name in HEAVY else spark.read.parquet(path)


def derive(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run ``{name}`` SQL over the given tables."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, names = DERIVED[name]
    return derive(spark, sf_dir, sql, *names)


def oracle(sql: str) -> str:
    """The same SQL for the checking engine, where tables go by their own names."""
    return sql.format(**{n: n for n in TABLES})


def with_derived(*names: str) -> str:
    """`WITH messages AS (…), …` for the oracle side."""
    return "WITH " + ", ".join(f"{n} AS ({oracle(DERIVED[n][0])})" for n in names)
