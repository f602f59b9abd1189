"""Views that state the domain's tables over the driver's parquet tables.

Every view is one SQL text that both Spark and DuckDB read, so that the oracle starts from the same parquet files. The
few places where the dialects differ are placeholders: see ``DIALECTS``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIALECTS = {
    "spark": {"us": "unix_micros(CAST({} AS TIMESTAMP))", "ts": "CAST({} AS TIMESTAMP)", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)", "hours": "make_dt_interval(0, {})", "div": "({}) DIV ({})", "hex": "CAST(conv({}, 16, 10) AS BIGINT)"},
    "duckdb": {"us": "epoch_us({})", "ts": "{}", "k": "CAST(props->>'$.k' AS BIGINT)", "hours": "to_hours(CAST({} AS INTEGER))", "div": "({}) // ({})", "hex": "CAST('0x' || {} AS BIGINT)"},
}

#: View -> text. A view may read those before it.
VIEWS: dict[str, str] = {
    "txn": """
        SELECT event_id AS transaction_id, user_id AS customer_id, user_id % 211 AS account_id, @ts{ts} AS ts, @us{ts} AS us,
               CAST(value AS DECIMAL(15,2)) AS amount,
               CASE event_type WHEN 'view' THEN 'online' WHEN 'click' THEN 'mobile' WHEN 'purchase' THEN 'pos' WHEN 'signup' THEN 'atm' ELSE 'online' END AS channel,
               CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END AS status,
               event_type AS transaction_type, (event_id * 31 + user_id) % 97 AS merchant_id,
               CASE (user_id * 7 + event_id % 11) % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' WHEN 4 THEN 'NG' WHEN 5 THEN 'JP' WHEN 6 THEN 'BR' ELSE 'US' END AS country,
               user_id * 10 + event_id % 3 AS device_id,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id * 13 + user_id) % 9 END AS mcc_slot,
               CAST((event_id * 7919) % 17000 AS DOUBLE) / 100 - 85 AS lat, CAST((event_id * 104729) % 35000 AS DOUBLE) / 100 - 175 AS lon,
               @k{} AS k
        FROM events""",
    "risk_txn": """
        SELECT transaction_id, customer_id, account_id, status, channel, transaction_type, merchant_id, CASE WHEN transaction_id % 19 = 0 THEN -(customer_id % 7) ELSE device_id END AS device_id, lat, lon, k,
               CASE WHEN customer_id % 3 = 0 AND transaction_id % 29 <> 0 THEN 'US' ELSE country END AS country,
               CASE WHEN transaction_id % 23 = 0 THEN '7995' ELSE CAST(5000 + merchant_id % 12 * 50 AS VARCHAR(9)) END AS mcc,
               CAST(CASE WHEN transaction_id % 13 = 0 THEN 1000 * (transaction_id % 12) WHEN transaction_id % 7 < 2 THEN FLOOR(amount) / 20 WHEN transaction_id % 11 = 0 THEN 9000 + amount * 10 ELSE amount * 100 END AS DECIMAL(15,2)) AS amount,
               CASE WHEN customer_id % 10 = 0 AND us >= 1705276800000000 THEN us + 8640000000000
                    WHEN customer_id % 10 IN (1, 2) THEN us - us % 345600000000 + @div{us % 345600000000||,||288}
                    ELSE us END AS us
        FROM txn""",
    "raw_txn": """
        SELECT transaction_id, m, CAST(FLOOR(amount) AS DECIMAL(15,2)) AS amount, 'ext' || CAST(m AS VARCHAR(20)) AS external_transaction_id, 'acc' || CAST(m % 50 AS VARCHAR(9)) AS account_id, mcc,
               CASE m % 8 WHEN 0 THEN ' usd ' WHEN 1 THEN 'Euros' WHEN 2 THEN 'gbp' WHEN 3 THEN 'JPY' WHEN 4 THEN NULL WHEN 5 THEN 'xyz' WHEN 6 THEN 'Sterling' ELSE 'USD' END AS transaction_currency,
               CASE m % 9 WHEN 0 THEN ' United States' WHEN 1 THEN 'uk' WHEN 2 THEN 'de' WHEN 3 THEN 'Deutschland' WHEN 4 THEN NULL WHEN 5 THEN 'Atlantis' WHEN 6 THEN 'usa' WHEN 7 THEN 'xq ' ELSE 'JP' END AS geo_country,
               CASE m % 7 WHEN 0 THEN 'Web' WHEN 1 THEN ' POS' WHEN 2 THEN 'in_store' WHEN 3 THEN 'fax' WHEN 4 THEN NULL WHEN 5 THEN '  ' ELSE 'atm' END AS channel,
               CASE m % 6 WHEN 0 THEN 'Buy' WHEN 1 THEN ' WITHDRAW' WHEN 2 THEN 'refund' WHEN 3 THEN 'mystery' WHEN 4 THEN NULL ELSE 'cash_out' END AS transaction_type,
               CASE m % 4 WHEN 0 THEN 'Visa' WHEN 1 THEN 'debit' WHEN 2 THEN NULL ELSE 'cc' END AS card_type,
               CASE m % 6 WHEN 0 THEN '$12.50' WHEN 1 THEN '1.234,56' WHEN 2 THEN '12,5' WHEN 3 THEN '1,234.5' WHEN 4 THEN 'abc' ELSE ' €99' END AS transaction_amount,
               CASE m % 12 WHEN 0 THEN '2024-01-02T03:04:05Z' WHEN 1 THEN '2024-01-02T03:04:05.678Z' WHEN 2 THEN '2024-01-02T03:04:05+02:00' WHEN 3 THEN '03/04/2024' WHEN 4 THEN ' 25/04/2024 10:11:12 ' WHEN 5 THEN '20240102' WHEN 6 THEN '1704164645' WHEN 7 THEN '1704164645123' WHEN 8 THEN 'nonsense' WHEN 9 THEN NULL WHEN 10 THEN '05-04-2024' ELSE '2024-01-02T03:04:05.123456+0530' END AS transaction_timestamp,
               CASE m % 3 WHEN 0 THEN '  Big   <b>Shop</b> ' WHEN 1 THEN 'Plain' ELSE 'Tab' || chr(9) || 'and' || chr(7) || 'bell ' END AS merchant_name,
               CAST(CASE m % 4 WHEN 0 THEN 95 WHEN 1 THEN -90 WHEN 2 THEN 12.5 END AS DOUBLE) AS geo_latitude
        FROM (SELECT transaction_id, amount, transaction_id - CASE WHEN transaction_id % 20 = 19 THEN 1 ELSE 0 END AS m, CAST(CASE WHEN transaction_id % 9 = 0 THEN 3000 + transaction_id % 900 ELSE 5411 + transaction_id % 400 END AS VARCHAR(9)) AS mcc FROM txn) numbered""",
    "txn_score": """
        SELECT transaction_id, CAST((transaction_id * 37) % 1000 AS DOUBLE) / 1000 AS score, us + 1000000 AS scored_us,
               CASE WHEN transaction_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version, CAST((transaction_id * 53) % 400 AS DOUBLE) / 2 AS latency_ms
        FROM txn
        UNION ALL
        SELECT transaction_id, CAST((transaction_id * 61) % 1000 AS DOUBLE) / 1000, us + 2000000, 'v2', CAST((transaction_id * 59) % 400 AS DOUBLE) / 2
        FROM txn WHERE transaction_id % 5 = 0""",
    "latest_score": """
        SELECT transaction_id, score, model_version, latency_ms FROM (
          SELECT s.*, row_number() OVER (PARTITION BY transaction_id ORDER BY scored_us DESC) AS rn FROM txn_score s) ranked
        WHERE rn = 1""",
    "alert": """
        SELECT t.transaction_id AS alert_id, t.transaction_id, t.account_id, t.customer_id, t.us AS created_us, t.ts AS created_at, s.score,
               CASE WHEN s.score >= 0.95 THEN 'critical' WHEN s.score >= 0.9 THEN 'high' WHEN s.score >= 0.85 THEN 'medium' ELSE 'low' END AS severity,
               CASE t.transaction_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' WHEN 3 THEN 'false_positive' ELSE 'open' END AS status,
               CASE WHEN t.transaction_id % 5 IN (2, 3) THEN t.us + (t.transaction_id % 96) * 3600000000 END AS resolved_us,
               CASE WHEN t.transaction_id % 7 = 0 THEN NULL ELSE 'analyst' || CAST(t.transaction_id % 6 AS VARCHAR(9)) END AS assigned_to,
               CASE WHEN t.transaction_id % 4 = 0 THEN NULL ELSE 'rule' || CAST(t.transaction_id % 13 AS VARCHAR(9)) END AS rule_id
        FROM txn t JOIN latest_score s ON t.transaction_id = s.transaction_id WHERE s.score >= 0.8""",
    "rule_table": """
        SELECT DISTINCT rule_id, 'name of ' || rule_id AS rule_name, rule_id <> 'rule7' AS enabled FROM alert WHERE rule_id IS NOT NULL""",
    "geo": """
        SELECT n.n_nationkey AS geo_key, n.n_name AS country, r.r_name AS region, n.n_nationkey % 5 = 0 AS is_high_risk
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fact": """
        SELECT o.o_orderkey AS transaction_id, o.o_custkey AS customer_key, c.c_nationkey AS geo_key, c.c_mktsegment AS segment, @us{o.o_orderdate} AS us, CAST(o.o_orderdate AS DATE) AS day,
               CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount, o.o_orderstatus AS order_status,
               CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'declined' END AS status,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'pos' WHEN 2 THEN 'atm' ELSE 'mobile' END AS channel,
               CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS risk_level,
               substr(o.o_orderpriority, 1, 1) IN ('1', '2') AS is_flagged, (o.o_orderkey * 11) % 29 = 0 AS is_fraud,
               CAST((o.o_orderkey * 37) % 1000 AS DOUBLE) / 1000 AS score
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "fact_line": """
        SELECT l.l_orderkey AS transaction_id, l.l_linenumber AS line, l.l_suppkey AS merchant_id, l.l_partkey AS part_id, p.p_brand AS category, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS line_amount, (l.l_orderkey * 11) % 29 = 0 AS is_fraud, s.s_nationkey AS merchant_nation
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "network": """
        SELECT net_key, family, length, lo, hi, country_code, country_name, city, latitude, longitude, is_vpn, is_proxy, is_tor,
               CASE WHEN family = 4 THEN CAST(@div{lo||,||16777216} AS VARCHAR(3)) || '.' || CAST(@div{lo % 16777216||,||65536} AS VARCHAR(3)) || '.' || CAST(@div{lo % 65536||,||256} AS VARCHAR(3)) || '.' || CAST(lo % 256 AS VARCHAR(3)) || '/' || CAST(length AS VARCHAR(3))
                    WHEN length = 48 THEN '2001:db8:' || CAST(slot AS VARCHAR(4)) || '::/48' ELSE '2001:0DB8:' || CAST(slot AS VARCHAR(4)) || ':' || CAST(net_key % 10 AS VARCHAR(4)) || ':0:0:0:0/64' END AS network
        FROM (SELECT net_key, family, length, slot, CASE WHEN family = 4 THEN low4 ELSE low6 END AS lo, CASE WHEN family = 4 THEN low4 + size4 - 1 WHEN length = 48 THEN low6 + 65535 ELSE low6 END AS hi, country_code, 'land of ' || country_code AS country_name, 'city' || CAST(net_key % 50 AS VARCHAR(9)) AS city,
                     CAST(net_key % 170 AS DOUBLE) - 85 AS latitude, CAST(net_key * 7 % 350 AS DOUBLE) - 175 AS longitude, net_key % 11 = 0 AS is_vpn, net_key % 13 = 0 AS is_proxy, net_key % 17 = 0 AS is_tor
              FROM (SELECT k.*, spot - spot % size4 AS low4, 2306139568115548160 + @hex{CAST(slot AS VARCHAR(4))} * 65536 + CASE WHEN length = 64 THEN net_key % 10 ELSE 0 END AS low6
                    FROM (SELECT c_custkey AS net_key, CASE WHEN c_custkey % 4 = 0 THEN 6 ELSE 4 END AS family, CASE WHEN c_custkey % 4 <> 0 THEN 12 + c_custkey % 15 WHEN c_custkey % 8 = 0 THEN 48 ELSE 64 END AS length, c_custkey * 37 % 1000 AS slot, 167772160 + c_custkey * 7919 % 65536 * 256 + c_custkey % 256 AS spot,
                                 CAST(POWER(2, 20 - c_custkey % 15) AS BIGINT) AS size4, CASE c_custkey % 9 WHEN 0 THEN 'KP' WHEN 1 THEN 'NG' WHEN 2 THEN 'GB' WHEN 3 THEN 'SY' WHEN 4 THEN '' WHEN 5 THEN 'ZZ' ELSE 'US' END AS country_code FROM customer) k) sized) shaped""",
    "addressed": """
        SELECT transaction_id, customer_id, us, lat, lon, country, CASE WHEN transaction_id % 6 = 5 THEN 6 ELSE 4 END AS family, CASE WHEN kind = 6 THEN num6 WHEN kind <> 8 THEN num4 END AS num,
               CASE WHEN kind = 8 THEN CASE transaction_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '10.0.0.256' WHEN 2 THEN 'unknown' ELSE '' END
                    WHEN kind = 6 THEN '2001:db8:' || CAST(slot AS VARCHAR(4)) || ':' || CAST(customer_id % 10 AS VARCHAR(4)) || '::' || CAST(transaction_id % 9999 AS VARCHAR(4))
                    ELSE CASE WHEN transaction_id % 5 = 4 THEN '::ffff:' ELSE '' END || CAST(@div{num4||,||16777216} AS VARCHAR(3)) || '.' || CAST(@div{num4 % 16777216||,||65536} AS VARCHAR(3)) || '.' || CAST(@div{num4 % 65536||,||256} AS VARCHAR(3)) || '.' || CAST(num4 % 256 AS VARCHAR(3)) END AS ip_address
        FROM (SELECT t.*, CASE WHEN transaction_id % 50 = 7 THEN 8 WHEN transaction_id % 6 = 5 THEN 6 ELSE 4 END AS kind, transaction_id * 11 % 1000 AS slot, CASE WHEN transaction_id % 3 = 0 THEN 167772161 WHEN transaction_id % 10 = 1 THEN 3232235520 + transaction_id % 65536 ELSE 167772160 + transaction_id * 104729 % 16777216 END AS num4,
                     2306139568115548160 + @hex{CAST(transaction_id * 11 % 1000 AS VARCHAR(4))} * 65536 + customer_id % 10 AS num6 FROM txn t) numbered""",
    "scored_label": """
        SELECT d.doc_id, l.toxic AS label, l.quality, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score, d.lang AS segment, CASE WHEN d.doc_id % 2 = 0 THEN 'base' ELSE 'now' END AS period
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def rendered(text: str, dialect: str) -> str:
    """``text`` with ``@name{argument}`` written in ``dialect``."""
    forms, out, rest = DIALECTS[dialect], "", text
    while found := re.search(r"@(\w+)\{", rest):
        before, name, rest = rest[: found.start()], found[1], rest[found.end() :]
        depth, at = 1, 0
        while depth:
            depth += {"{": 1, "}": -1}.get(rest[at], 0)
            at += 1
        arguments, rest = rendered(rest[: at - 1], dialect).split("||,||"), rest[at:]
        form = forms[name]
        out += before + (form.format(*arguments) if "{}" in form else form)
    return out + rest


def used(text: str) -> list[str]:
    """Views that ``text`` reads, directly or through others, in their order."""
    found: set[str] = set()

    def look(t: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", t):
                found.add(name)
                look(VIEWS[name])

    look(text)
    return [name for name in VIEWS if name in found]


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views over the tables of ``sf_dir``; reading is left to the queries."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run ``text`` over the views, inlined as common table expressions that Catalyst optimises as one plan."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text + "".join(VIEWS[v] for v in used(text))):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(with_views(text, "spark"))


def with_views(text: str, dialect: str) -> str:
    """``text`` behind the views that it reads."""
    views = ",\n".join(f"{name} AS ({rendered(VIEWS[name], dialect)})" for name in used(text))
    text = rendered(text, dialect).strip()
    if not views:
        return text
    if text[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views},\n{text[15:]}"
    return f"WITH {views},\n{text[5:]}" if text[:5].upper() == "WITH " else f"WITH {views}\n{text}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views."""
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")
