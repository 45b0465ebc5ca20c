"""Registered source queries (step 7): recurring expansion over specs derived from the
customer table, and a statement round trip: the order ledger is written out as bank statement
files of four layouts (by Spark, into the shared checkpoint folder) and imported back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.plans.registry import register
from ledgerspark.plans.sqlviews import LEDGER_ORDERS, with_
from ledgerspark.session import staging_path
from ledgerspark.sources.entries import expand_recurring
from ledgerspark.sources.statements import load_statements
from ledgerspark.sources.tables import ledger_orders, read_table

AS_OF = "1998-12-31"


def _specs(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    start = F.date_add(F.lit("1998-01-01").cast("date"), (k % 60).cast("int"))
    return c.select(
        F.concat(F.lit("plan-"), k.cast("string")).alias("description"), F.col("c_name").alias("merchant"),
        F.col("c_acctbal").alias("amount"),
        F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("monthly").alias("cadence"),
        start.cast("string").alias("start_date"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.date_add(start, (k % 200).cast("int")).cast("string")).alias("end_date"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(k % 9).cast("bigint").alias("count"),
        k.alias("spec_id"))


@register("recurring_expand", f"""
WITH spec AS (
  SELECT c_custkey AS spec_id, 'plan-' || CAST(c_custkey AS VARCHAR) AS description, c_name AS merchant,
         c_acctbal AS amount,
         CASE WHEN c_custkey % 3 = 0 THEN 'daily' WHEN c_custkey % 3 = 1 THEN 'weekly' ELSE 'monthly' END AS cadence,
         DATE '1998-01-01' + CAST(c_custkey % 60 AS INTEGER) AS start_d,
         CASE WHEN c_custkey % 4 = 0 THEN DATE '{AS_OF}'
              ELSE DATE '1998-01-01' + CAST(c_custkey % 60 AS INTEGER) + CAST(c_custkey % 200 AS INTEGER) END AS end_d,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 9 END AS cnt
  FROM customer),
valid AS (SELECT * FROM spec WHERE cnt IS NULL OR cnt > 0),
steps AS (SELECT *, unnest(generate_series(0, greatest(date_diff('day', start_d, end_d), -1))) AS k FROM valid),
dated AS (SELECT *, CASE WHEN cadence = 'daily' THEN start_d + CAST(k AS INTEGER)
                         WHEN cadence = 'weekly' THEN start_d + CAST(7 * k AS INTEGER)
                         ELSE CAST(start_d + to_months(CAST(k AS INTEGER)) AS DATE) END AS d FROM steps)
SELECT CAST(d AS VARCHAR) AS date, description, merchant, CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       'recurring' AS provider, CAST(k AS BIGINT) AS seq
FROM dated WHERE d <= end_d AND (cnt IS NULL OR k < cnt)""")
def recurring_expand(spark, sf):
    rows, _bad = expand_recurring(_specs(spark, sf), AS_OF)
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
                       F.col("amount").cast("double").alias("amount"), "provider", "seq")


# ---- statement round trip ------------------------------------------------------------------

def _even(col):
    return F.substring(col, -1, 1).isin("0", "2", "4", "6", "8")


PARTS = 64  # tasks that write statements: more than there are statements, so that most are split


def write_statements(spark, sf, out: str, whole: bool = False) -> str:
    """Write the order ledger as statement files: TD Visa (no header), Canadian Tire (preamble +
    header), Amex (junk rows, then a header; blank amounts and merchants), Home Trust (header,
    '$'/'(...)' amounts) and Wealthsimple (header), one file per bank and year.

    One projection picks each row's bank and formats its line; one aggregate per file emits the
    preamble/header lines; a range partition by statement and line writes a statement's lines in
    order over the part files of its folder (``whole``: into one)."""
    led = ledger_orders(spark, sf)
    prov, desc, merch = F.col("provider"), F.col("description"), F.col("merchant")
    amt = F.col("amount").cast("string")
    money = F.concat(F.lit('"$'), F.format_number(F.col("amount").cast("double"), 2), F.lit('"'))
    mdy = F.date_format("date", "MM/dd/yyyy")
    iso = F.date_format("date", "yyyy-MM-dd")
    bank = (F.when((prov == "f") & _even("merchant"), "tdvisa").when(prov == "f", "canadiantire")
            .when((prov == "o") & _even("merchant"), "amex").when(prov == "o", "hometrust")
            .when(prov == "p", "wealthsimple"))
    line = (
        F.when(F.col("bank") == "tdvisa", F.when(desc == "5-LOW", F.concat_ws(",", mdy, F.lit("PAYMENT - THANK YOU"), F.lit(""), amt, F.lit("1000.00")))
               .otherwise(F.concat_ws(",", mdy, desc, amt, F.lit(""), F.lit("1000.00"))))
        .when(F.col("bank") == "canadiantire", F.concat_ws(",", F.date_format("date", "M/d/yyyy"), desc, merch,
                                                           # urgent rows lose their amount: bad lines
                                                           F.when(desc == "1-URGENT", F.lit("")).otherwise(money)))
        .when(F.col("bank") == "amex", F.concat_ws(",", iso, desc, F.when(desc == "3-MEDIUM", F.lit("")).otherwise(money),
                                                   F.when(desc == "4-NOT SPECIFIED", F.lit("")).otherwise(merch)))
        .when(F.col("bank") == "hometrust", F.concat_ws(
            ",", F.lit("1234"), F.lit("A HOLDER"), mdy, mdy, F.lit("Debit"), F.lit("Misc"), merch, F.lit("Toronto"), F.lit("ON"),
            F.when(desc == "2-HIGH", F.concat(F.lit('"($'), F.format_number(F.col("amount").cast("double"), 2), F.lit(')"')))
            .otherwise(money)))
        .otherwise(F.concat_ws(",", iso, iso, F.when(desc == "5-LOW", F.lit("Payment")).otherwise(desc), merch,
                               F.when(desc == "5-LOW", F.concat(F.lit("-"), amt)).otherwise(amt), F.lit("CAD"))))
    pos = F.unix_date("date").cast("bigint") * 100000 + F.abs(F.xxhash64("merchant", "description", "amount")) % 100000
    rows = (led.withColumn("bank", bank).filter(F.col("bank").isNotNull())
            .select(F.concat("bank", F.lit("-"), F.date_format("date", "yyyy")).alias("file"), "bank",
                    pos.alias("pos"), line.alias("line")))

    def head(*lines):
        return F.array(*[F.struct(F.lit(-len(lines) + i).cast("bigint").alias("pos"), F.lit(t).alias("line"))
                         for i, t in enumerate(lines)])

    headers = (rows.groupBy("file").agg(F.first("bank").alias("bank"))
               .select("file", F.explode(
                   F.when(F.col("bank") == "canadiantire", head("Card statement export", "Account,****1234",
                                                                "Transaction Date,Description,Merchant Name,Amount"))
                   .when(F.col("bank") == "amex", head("Summary of account,,,", "Prepared,today,,",
                                                       "Date,Description,Amount,Merchant"))
                   .when(F.col("bank") == "hometrust", head(
                       "Account Number,Cardholder Name,Trans Date,Posting Date,Type,Category,Merchant Name,"
                       "Merchant City,Merchant State,Amount"))
                   .when(F.col("bank") == "wealthsimple", head("transaction_date,post_date,type,details,amount,currency"))
                   .otherwise(F.array().cast("array<struct<pos:bigint,line:string>>"))).alias("h"))
               .select("file", "h.pos", "h.line"))
    lines = rows.drop("bank").unionByName(headers)
    dealt = lines.repartition("file") if whole else lines.repartitionByRange(PARTS, "file", "pos")
    (dealt.sortWithinPartitions("file", "pos").select("file", "line")
     .write.mode("overwrite").partitionBy("file").text(out))
    return out


@register("statement_roundtrip", with_(LEDGER_ORDERS) + """
SELECT CAST(date AS VARCHAR) AS date, description, description AS merchant, CAST(amount AS DOUBLE) AS amount,
       'tdvisa' AS provider FROM ledger
WHERE provider = 'f' AND right(merchant, 1) IN ('0', '2', '4', '6', '8') AND description <> '5-LOW'
UNION ALL
SELECT CAST(date AS VARCHAR), description, merchant, CAST(amount AS DOUBLE), 'canadiantire' FROM ledger
WHERE provider = 'f' AND right(merchant, 1) NOT IN ('0', '2', '4', '6', '8') AND description <> '1-URGENT'
UNION ALL
SELECT CAST(date AS VARCHAR), merchant, merchant,
       CAST(CASE WHEN description = '2-HIGH' THEN -amount ELSE amount END AS DOUBLE), 'hometrust' FROM ledger
WHERE provider = 'o' AND right(merchant, 1) NOT IN ('0', '2', '4', '6', '8')
UNION ALL
SELECT CAST(date AS VARCHAR), description, CASE WHEN description = '4-NOT SPECIFIED' THEN description ELSE merchant END,
       CAST(amount AS DOUBLE), 'amex' FROM ledger
WHERE provider = 'o' AND right(merchant, 1) IN ('0', '2', '4', '6', '8') AND description <> '3-MEDIUM'
UNION ALL
SELECT CAST(date AS VARCHAR), description, merchant, CAST(amount AS DOUBLE), 'wealthsimple' FROM ledger
WHERE provider = 'p' AND description <> '5-LOW'""")
def statement_roundtrip(spark, sf):
    out = write_statements(spark, sf, staging_path(spark, "statements"))
    res = load_statements(spark, out, route_on="path")
    return res.rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "description", "merchant",
                           F.col("amount").cast("double").alias("amount"), "provider")


@register("statement_quarantine", with_(LEDGER_ORDERS) + """
SELECT strftime(date, '%-m/%-d/%Y') || ',' || description || ',' || merchant || ',' AS line,
       'unparsable amount' AS reason
FROM ledger WHERE provider = 'f' AND right(merchant, 1) NOT IN ('0', '2', '4', '6', '8') AND description = '1-URGENT'""")
def statement_quarantine(spark, sf):
    """Bad lines of the round trip (D9): the Canadian Tire lines written without an amount."""
    out = write_statements(spark, sf, staging_path(spark, "statements"))
    return load_statements(spark, out, route_on="path").quarantine.select("line", "reason")


# A line of every layout with every fault that it can have, by the order's priority.
_FAULTS = {
    "amex": ("01", "iso", "PAYMENT RECEIVED", "Date,Description,Amount,Merchant", None, "{d},{desc},{a},{m}"),
    "canadiantire": ("23", "us", "payment", "Transaction Date,Description,Merchant Name,Amount", None, "{d},{desc},{m},{a}"),
    "hometrust": ("45", "us", "payment", "Trans Date,Merchant Name,Amount", "Trans Date,Merchant Name,Total", "{d},{desc},{a}"),
    "tdvisa": ("67", "us", "PAYMENT - THANK YOU", None, None, "{d},{desc},{a},,1000.00"),
    "wealthsimple": ("89", "iso", "Payment", "transaction_date,type,details,amount", "transaction_date,type,details,total",
                     "{d},{desc},{m},{a}"),
}


def _fault_sql() -> str:
    parts = []
    for bank, (digits, style, payment, header, lacking, line) in _FAULTS.items():
        date = "strftime(date, '%Y-%m-%d')" if style == "iso" else "strftime(date, '%m/%d/%Y')"
        pieces = {"d": f"CASE WHEN description = '1-URGENT' THEN 'someday' ELSE {date} END",
                  "desc": f"CASE WHEN description = '5-LOW' THEN '{payment}' ELSE description END", "m": "merchant",
                  "a": "CASE WHEN description = '2-HIGH' THEN '1.2.3' ELSE CAST(amount AS VARCHAR) END"}
        text = "'" + line + "'"
        for k, v in pieces.items():
            text = text.replace("{" + k + "}", f"' || {v} || '")
        no_header = "'no header'" if header and not lacking else "'missing column'" if lacking else "NULL"
        parts.append(f"""SELECT '{bank}' AS bank, {text} AS line,
CASE description WHEN '1-URGENT' THEN 'unparsable date' WHEN '2-HIGH' THEN 'unparsable amount'
     WHEN '4-NOT SPECIFIED' THEN {no_header} WHEN '5-LOW' THEN 'payment not negative' END AS reason
FROM ledger WHERE right(merchant, 1) IN ('{digits[0]}', '{digits[1]}')""")
    return "SELECT bank, line, reason FROM (" + "\nUNION ALL ".join(parts) + ") WHERE reason IS NOT NULL"


@register("statement_faults", with_(LEDGER_ORDERS) + _fault_sql())
def statement_faults(spark, sf):
    """D9 in all five layouts: bad dates, bad amounts, positive payments, statements without a header
    and headers that lack a column, found in files of any number of blocks."""
    led = ledger_orders(spark, sf)
    desc, amount = F.col("description"), F.col("amount").cast("string")
    out = staging_path(spark, "faults")
    body, heads = None, []
    for bank, (digits, style, payment, header, lacking, line) in _FAULTS.items():
        date = F.date_format("date", "yyyy-MM-dd" if style == "iso" else "MM/dd/yyyy")
        value = {"d": F.when(desc == "1-URGENT", "someday").otherwise(date),
                 "desc": F.when(desc == "5-LOW", payment).otherwise(desc), "m": F.col("merchant"),
                 "a": F.when(desc == "2-HIGH", "1.2.3").otherwise(amount)}
        cells = [value[c[1:-1]] if c.startswith("{") else F.lit(c) for c in line.split(",")]
        kind = F.when(desc == "4-NOT SPECIFIED", "b").otherwise("a")
        rows = led.filter(F.substring("merchant", -1, 1).isin(*digits)).select(
            F.concat(F.lit(f"{bank}-"), kind, F.date_format("date", "-yyyy")).alias("file"),
            F.lit(1).alias("pos"), F.concat_ws(",", *cells).alias("line"))
        body = rows if body is None else body.unionByName(rows)
        heads += [(f"{bank}-{k}", h) for k, h in (("a", header), ("b", lacking)) if h]
    files = body.select("file").distinct()
    head = F.lit(None).cast("string")
    for start, text in heads:
        head = F.when(F.col("file").startswith(start), text).otherwise(head)
    headers = files.select("file", F.lit(0).alias("pos"), head.alias("line")).filter("line is not null")
    (body.unionByName(headers).repartitionByRange(PARTS, "file", "pos").sortWithinPartitions("file", "pos")
     .select("file", "line").write.partitionBy("file").text(out))
    bad = load_statements(spark, out, route_on="path", include_payments=True).quarantine
    return bad.select(F.regexp_extract("file", r"file=([a-z]+)-", 1).alias("bank"), "line", "reason")
