"""Projections of the test tables onto the reading tables and message streams.

``{events}``, ``{orders}`` and ``{lineitem}`` are replaced by the table reference
of the engine, so Spark and the SQL check read exactly the same text. The gaps in
``POWER_METER`` (days without device 1 and days without device 2, whose readings belong to the
fourth device then; NULL readings) are the cases the operators have to get right, not a sample: every
query reads the whole view.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2024, 1, 15)
AS_OF_DEVICE_2 = date(2024, 1, 16)  # device 2 is silent on AS_OF
DAY = date(2024, 1, 10)
RANGE = (date(2024, 1, 5), date(2024, 1, 25))
AS_OF_LONG = date(1998, 6, 15)
RANGE_LONG = (date(1996, 1, 1), date(1997, 12, 31))

POWER_METER = """
SELECT event_id AS id,
       CASE WHEN user_id % 4 = 0 AND day(ts) % 7 = 0 THEN 4
            WHEN user_id % 4 = 1 AND day(ts) % 5 = 0 THEN 4
            ELSE CAST(user_id % 4 AS INT) + 1 END AS no_device,
       CAST(CAST(value AS DECIMAL(18,2)) + CAST(user_id AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS kva,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS kw,
       CAST(220 + event_id % 11 AS DECIMAL(18,2)) AS volt1,
       CAST(219 + event_id % 13 AS DECIMAL(18,2)) AS volt2,
       CAST(221 + event_id % 7 AS DECIMAL(18,2)) AS volt3,
       CAST(user_id % 17 AS DECIMAL(18,2)) AS amp1,
       CAST(user_id % 19 AS DECIMAL(18,2)) AS amp2,
       CAST(user_id % 23 AS DECIMAL(18,2)) AS amp3,
       CAST(49 + event_id % 3 AS DECIMAL(18,2)) AS freq,
       ts AS timestamp
FROM {events}
WHERE event_type <> 'signup'
"""

TEMP_CONTROL = """
SELECT event_id AS id,
       CAST(user_id % 3 AS INT) + 1 AS no_device,
       CAST(value AS DECIMAL(18,2)) AS temp,
       ts AS timestamp
FROM {events}
WHERE event_type = 'signup'
"""

POWER_METER_LONG = """
SELECT CAST(l_linenumber % 4 AS INT) + 1 AS no_device,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS kva,
       CAST(l_quantity AS DECIMAL(18,2)) AS kw,
       CAST(220 + l_partkey % 11 AS DECIMAL(18,2)) AS volt1,
       CAST(219 + l_partkey % 13 AS DECIMAL(18,2)) AS volt2,
       CAST(221 + l_partkey % 7 AS DECIMAL(18,2)) AS volt3,
       CAST(l_suppkey % 17 AS DECIMAL(18,2)) AS amp1,
       CAST(l_suppkey % 19 AS DECIMAL(18,2)) AS amp2,
       CAST(l_suppkey % 23 AS DECIMAL(18,2)) AS amp3,
       CAST(49 + l_partkey % 3 AS DECIMAL(18,2)) AS freq,
       l_shipdate AS timestamp
FROM {lineitem}
"""

TEMP_CONTROL_LONG = """
SELECT o_orderkey AS id,
       CAST(o_custkey % 3 AS INT) + 1 AS no_device,
       CAST(o_totalprice AS DECIMAL(18,2)) AS temp,
       o_orderdate AS timestamp
FROM {orders}
"""

# One message per event; every 50th is cut off.
MESSAGES = """
SELECT 'PM/E5' AS topic, ts, event_id AS seq,
       CASE WHEN event_id % 50 = 0 THEN '{{"PME5":[' ELSE concat(
         '{{"PME5":[{{"server_name":"PM2100","name":"Voltage","data":"[', CAST(220 + event_id % 11 AS STRING), ']"}},',
         '{{"server_name":"PM2100","name":"kWh","data":"[', CAST(CAST(value AS DECIMAL(18,2)) AS STRING), ']"}},',
         '{{"server_name":"E5CC","name":"Temperature","data":"[0,', CAST(20 + event_id % 15 AS STRING), ']"}}]}}') END AS payload
FROM {events}
"""

# Objects that lack the list of readings, or have none in it; every 50th is cut off.
MESSAGES_WITHOUT_LIST = """
SELECT 'PM/E5' AS topic, ts, event_id AS seq,
       CASE WHEN event_id % 50 = 0 THEN '{{"PME5":['
            WHEN event_id % 3 = 0 THEN '{{"PME5":[]}}'
            ELSE concat('{{"site":', CAST(event_id % 7 AS STRING), '}}') END AS payload
FROM {events}
"""

# Device lists: the frequency is missing in every third message, the power is sent
# twice in every fifth (the later value counts) and as text in every seventh; the
# temperature controller has a number in even messages only.
MESSAGES_DEVICE_LIST = """
SELECT 'toho' AS topic, ts, event_id AS seq,
       CASE WHEN event_id % 50 = 0 THEN '{{"data":[{{"name"' ELSE concat(
         '{{"data":[{{"name":"Power Meter ', CAST(user_id % 4 + 1 AS STRING), '","values":[',
         CASE WHEN event_id % 5 = 0 THEN '{{"name":"KW","raw_data":-1}},' ELSE '' END,
         '{{"name":"KVA","raw_data":', CAST(CAST(value AS DECIMAL(18,2)) AS STRING), '}},',
         CASE WHEN event_id % 7 = 0
              THEN concat('{{"name":"KW","raw_data":"', CAST(user_id AS STRING), '.5"}},')
              ELSE concat('{{"name":"KW","raw_data":', CAST(user_id AS STRING), '.5}},') END,
         '{{"name":"V1","raw_data":', CAST(220 + event_id % 11 AS STRING), '}},',
         '{{"name":"V2","raw_data":', CAST(219 + event_id % 13 AS STRING), '}},',
         '{{"name":"V3","raw_data":', CAST(221 + event_id % 7 AS STRING), '}},',
         '{{"name":"T Current","raw_data":', CAST(user_id % 17 AS STRING), '}},',
         '{{"name":"S Current","raw_data":', CAST(user_id % 19 AS STRING), '}},',
         '{{"name":"R Current","raw_data":', CAST(user_id % 23 AS STRING), '}}',
         CASE WHEN event_id % 3 = 0 THEN ''
              ELSE concat(',{{"name":"Frequency","raw_data":', CAST(49 + event_id % 3 AS STRING), '}}') END,
         ']}},{{"name":"Temperature Controller',
         CASE WHEN event_id % 2 = 0 THEN ' 2' ELSE '' END,
         '","values":[{{"name":"Temperature 1","raw_data":', CAST(20 + event_id % 15 AS STRING), '}},',
         '{{"name":"Temperature 2","raw_data":', CAST(30 + event_id % 9 AS STRING), '.25}}]}},',
         '{{"name":"Gateway","values":[{{"name":"KW","raw_data":99}}]}}]}}') END AS payload
FROM {events}
"""

TABLES = ("events", "orders", "lineitem")


def spark_view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def duckdb_text(text: str) -> str:
    return text.format(**{t: t for t in TABLES}).strip()
