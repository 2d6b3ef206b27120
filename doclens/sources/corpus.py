"""Documents made from the star tables: invoices, prescriptions, laboratory reports and clinic notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = ("OD", "BD", "TDS", "1-0-1", "HS")
#: event type: analyte, unit, low, high
ANALYTES = {"view": ("Glucose", "mg/dl", 70, 110), "signup": ("Urea", "mg/dl", 15, 40), "click": ("Calcium", "mg/dl", 8, 11), "error": ("Albumin", "g/dl", 3, 6), "purchase": ("Sodium", "mmol/l", 135, 145)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(number: Column) -> Column:
    """A number spelt with letters."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def _bodies(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(doc_id, body): a document's lines in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, "line")))
    return items.groupBy(F.col(key).alias("doc_id")).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("body"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text) of each order that has lines: an invoice."""
    line = F.format_string("%d. %s Tablets %dmg 3004 %d %.2f", "l_linenumber", F.upper("p_name"), "p_size", F.col("l_quantity").cast("int"), "l_extendedprice")
    bodies = _bodies(_items(spark, sf_dir).withColumn("line", line), "l_orderkey", _ORDER)
    orders = table(spark, sf_dir, "orders")
    head = F.concat(F.lit("Tax Invoice No "), "o_orderkey", F.lit("\nGSTIN 29ABC"), "o_custkey", F.lit("\nDate: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nItem HSN Qty Rate\n"))
    return orders.join(bodies, F.col("o_orderkey") == F.col("doc_id")).select("doc_id", F.concat(head, "body", F.lit("\nGrand Total")).alias("raw_text"))


def prescription_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source rows of prescriptions, with their lines: what an extraction should find."""
    code = F.element_at(F.array(*map(F.lit, CODES)), F.col("l_linenumber") % len(CODES) + 1)
    days = F.col("l_quantity").cast("int")
    out = _items(spark, sf_dir).withColumns({"name": F.upper("p_name"), "dosage": F.concat("p_size", F.lit("MG")), "frequency": code, "duration": F.concat(days, F.lit(" days"))})
    return out.withColumn("line", F.concat(F.lit("TAB. "), "name", F.lit(" "), "dosage", F.lit(" "), "frequency", F.lit(" x "), "duration"))


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text) of each order that has lines: a prescription."""
    bodies = _bodies(prescription_items(spark, sf_dir), "l_orderkey", _ORDER)
    orders = table(spark, sf_dir, "orders")
    head = F.concat(
        F.lit("Dr S"), letters(F.col("o_custkey") % 97), F.lit(" Rao MBBS\nReg No "), "o_orderkey", F.lit("\nDate: "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit("\nPatient: P"), letters(F.col("o_custkey")), F.lit(" Iyer Age\nRx\n"),
    )
    return orders.join(bodies, F.col("o_orderkey") == F.col("doc_id")).select("doc_id", F.concat(head, "body", F.lit("\nReview after 2 weeks")).alias("raw_text"))


def lab_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text) of each user's events: a laboratory report."""
    line = F.coalesce(*(F.when(F.col("event_type") == kind, F.format_string(f"{name} %.2f {unit} {low} - {high}", "value")) for kind, (name, unit, low, high) in ANALYTES.items()))
    events = table(spark, sf_dir, "events").withColumn("line", line).where("line is not null")
    head = F.concat(F.lit("City Laboratory\nPatient: U"), letters(F.col("doc_id")), F.lit("\nLipid Profile\nTest Result Reference Range\n"))
    return _bodies(events, "user_id", ["event_id"]).select("doc_id", F.concat(head, "body").alias("raw_text"))


_L = "translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij')"
#: Clinic notes: each customer gets one line of each list, chosen by its key; empty lines are left in. Expressions of both engines.
NOTE_LINES = (
    (f"'Patient Name: R' || {_L} || ' Das Age'", f"'Name: A' || {_L} || ' Rao'", f"'Pt K' || {_L} || ' Iyer'", "'Bank details'", f"'Patient: Age. Patient: V' || {_L} || ' IP No'", "''", "'Tax Invoice No ' || c_custkey"),
    ("'Age ' || (20 + c_custkey % 60) || ' Sex F'", "'Name: Kamal'", "'30 yrs'", "'GSTIN 29' || c_custkey", "'M/' || (c_custkey % 90)", "'Manufactured by Acme'"),
    ("'Date: 0' || (1 + c_custkey % 9) || '/11/2021'", "'seen 3 Mar 2001'", "'on 12-11-98 and 1/2/2003'", "'Dr. S' || {L} || ' Rao, MBBS MD'".replace("{L}", _L), "'Review after 2 weeks'"),
    ("'Vitals: BP ' || (100 + c_custkey % 70) || '/80 mmHg, Pulse 84/min, SpO2 98%'", "'Temp 98.6 F'", "'Wt ' || (40 + c_custkey % 50) || ' kg'", "'Inj Insulin 10 units, BP 140/90'", "'Resp rate 18, Height 1.6'"),
    ("'Dx: T2DM, HTN and old MI'", "'Impression: No fever'", "'Diagnosis: asthma; nil; rhinitis since 2019'", "'Final diagnosis - gout'", "'no remarks'"),
    ("'Allergies: None known'", "'Allergic to penicillin, sulfa'", "'NKDA'", "'allergy: dust mites'"),
    ("'C/o fever, cough x 3 days'", "'Chief complaints: chest pain and sweating'", "'complains of headache for 2 weeks'", "'well'"),
    ("'HbAlc 7.1 % 4.0 - 6.0'", "'TSH ' || (c_custkey % 90) || '.1 uiu/ml 0.4 - 4.0'", "'Hb 12.5 g/dl 13 - 17'", "'ESR 250 mm/hr < 20'", "'Serum T5H 4.1 miu/l (0.4 - 4.0)'", "'Folate 3 µg/dl'", "'SGPT (ALT) 64 U/L 5 - 40'", "'Platelets 250 x10^9/l'"),
    ("'Complete Blood Count'", "'Lipid Profile'", "'Review with lipid profile'", "'Thyroid studies'"),
    ("'TAB. OMEZ 4O MG 1-O-1 x 5 days'", "'TAB. DOLO 650 D'", "'Tab. Montek LC HS, Tab. Glimepiride 1 mg OD'", "'Cap Becosules 1mg, 2mg, 5mg'", "'Syp Calpol 250 mg/5 ml BD for 3 days'", "'Tab Ecosprin 75 mg once daily'", "'1) Augmentin 625 TDS'", "'NEW MINIPRESS Capsules 2mg, each tablet contains prazosin'"),
    ("'Here is the text of the page:'", "'Sure, see below'", "'漢字 ok'", "'repeat this line'", "''"),
    ("'repeat this line'", "'Repeat  this line'", "'end of note'"),
    ("'repeat this line'", "'output: done'", "'Rx'"),
)
#: A step of 10 would always choose the same of the five lines of vital signs.
_STEP = {3: 11}
_NOTE = " || chr(10) || ".join(f"CASE (c_custkey * {_STEP.get(k, k * k + 1)} + {k}) % {len(v)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(v))} END" for k, v in enumerate(NOTE_LINES))
#: One in 41 has no text at all, one in 43 hardly any.
NOTE = f"CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN 'ok ' || c_custkey % 7 ELSE {_NOTE} END"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text) of each customer: a clinic note. Keys are a few bytes a customer, so a file of few parts makes many
    notes: they are dealt out first, by key, which later steps by doc_id keep to."""
    n = 4 * spark.sparkContext.defaultParallelism
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(n, "c_custkey")
    return keys.select(F.col("c_custkey").alias("doc_id"), F.expr(NOTE).alias("raw_text"))


#: The four corpora with doc_ids that don't clash: four times the id, and the number of the corpus.
CORPORA = ("invoices", "prescriptions", "lab_reports", "notes")


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text) of all corpora."""
    parts = [f(spark, sf_dir).select((F.col("doc_id") * 4 + k).alias("doc_id"), "raw_text") for k, f in enumerate((invoices, prescriptions, lab_reports, notes))]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


# The same documents in SQL, as common table expressions for the oracle.
_LETTERS = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"
_SQL_ITEMS = "lineitem JOIN part ON l_partkey = p_partkey"
_SQL_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, line"
_ANALYTE_SQL = " ".join(f"WHEN '{k}' THEN printf('{n} %.2f {u.replace('%', '%%')} {a} - {b}', value)" for k, (n, u, a, b) in ANALYTES.items())
CTE = {
    "invoices": f"""invoices AS (SELECT o_orderkey AS doc_id, 'Tax Invoice No ' || o_orderkey || chr(10) || 'GSTIN 29ABC' || o_custkey || chr(10) || 'Date: ' || strftime(o_orderdate, '%d/%m/%Y')
  || chr(10) || 'Item HSN Qty Rate' || chr(10) || body || chr(10) || 'Grand Total' AS raw_text FROM orders JOIN (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY {_SQL_ORDER}) AS body FROM (
  SELECT *, printf('%d. %s Tablets %dmg 3004 %d %.2f', l_linenumber, upper(p_name), p_size, CAST(l_quantity AS INT), l_extendedprice) AS line FROM {_SQL_ITEMS}) GROUP BY 1) ON o_orderkey = l_orderkey)""",
    "items": f"""items AS (SELECT *, 'TAB. ' || name || ' ' || dosage || ' ' || frequency || ' x ' || duration AS line FROM (SELECT *, upper(p_name) AS name, p_size || 'MG' AS dosage,
  {list(CODES)}[l_linenumber % {len(CODES)} + 1] AS frequency, CAST(l_quantity AS INT) || ' days' AS duration FROM {_SQL_ITEMS}))""",
    "prescriptions": f"""prescriptions AS (SELECT o_orderkey AS doc_id, 'Dr S' || {_LETTERS.format('o_custkey % 97')} || ' Rao MBBS' || chr(10) || 'Reg No ' || o_orderkey || chr(10) || 'Date: ' || strftime(o_orderdate, '%d/%m/%Y')
  || chr(10) || 'Patient: P' || {_LETTERS.format('o_custkey')} || ' Iyer Age' || chr(10) || 'Rx' || chr(10) || body || chr(10) || 'Review after 2 weeks' AS raw_text
  FROM orders JOIN (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY {_SQL_ORDER}) AS body FROM items GROUP BY 1) ON o_orderkey = l_orderkey)""",
    "lab_reports": f"""lab_reports AS (SELECT user_id AS doc_id, 'City Laboratory' || chr(10) || 'Patient: U' || {_LETTERS.format('user_id')} || chr(10) || 'Lipid Profile' || chr(10) || 'Test Result Reference Range' || chr(10)
  || string_agg(line, chr(10) ORDER BY event_id) AS raw_text FROM (SELECT *, CASE event_type {_ANALYTE_SQL} END AS line FROM events) WHERE line IS NOT NULL GROUP BY user_id)""",
    "notes": f"notes AS (SELECT c_custkey AS doc_id, {NOTE} AS raw_text FROM customer)",
    "every": "every AS (" + " UNION ALL ".join(f"SELECT doc_id * 4 + {k} AS doc_id, raw_text FROM {c}" for k, c in enumerate(CORPORA)) + ")",
}


def ctes(*names: str) -> str:
    """WITH clause of the corpora named, with what they stand on."""
    names = (*names, *(CORPORA if "every" in names else ()))
    wanted = [n for n in CTE if n in names or n == "items" and "prescriptions" in names]
    return "WITH " + ",\n".join(CTE[n] for n in wanted)
