"""The registered queries of the core operators over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import profile as p
from meshwright.functions import scalars as s
from meshwright.operators import align, clean, knowledge, merge, quality, resolve
from meshwright.plans.advisor import HeuristicAdvisor
from meshwright.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# By the fixed weights of the header score, over the columns of customer.
HEADER_SCORES = """('id', 'c_custkey', 22.0::DOUBLE),
  ('id', 'c_name', 2.6::DOUBLE),
  ('id', 'c_nationkey', 5.0::DOUBLE),
  ('id', 'c_acctbal', 11.0::DOUBLE),
  ('id', 'c_mktsegment', 0.0::DOUBLE),
  ('name', 'c_custkey', 22.0::DOUBLE),
  ('name', 'c_name', 10.6::DOUBLE),
  ('name', 'c_nationkey', 5.0::DOUBLE),
  ('name', 'c_acctbal', 11.0::DOUBLE),
  ('name', 'c_mktsegment', 0.0::DOUBLE),
  ('balance', 'c_custkey', 22.0::DOUBLE),
  ('balance', 'c_name', 2.6::DOUBLE),
  ('balance', 'c_nationkey', 5.0::DOUBLE),
  ('balance', 'c_acctbal', 11.0::DOUBLE),
  ('balance', 'c_mktsegment', 0.0::DOUBLE)"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

# Deterministic dirty views: one text for both engines.
VIEWS = {
    "dirty_customer": """SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'abc' WHEN c_custkey % 5 = 0 THEN '$' || s
       WHEN c_custkey % 3 = 0 THEN ' ' || s || ' ' ELSE s END AS bal_raw,
  CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS segment_raw
FROM (SELECT *, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) AS s FROM customer) t""",
    "dirty_orders": """SELECT o_orderkey, o_custkey,
  CASE o_orderkey % 5 WHEN 0 THEN iso WHEN 1 THEN substr(iso,6,2) || '/' || substr(iso,9,2) || '/' || substr(iso,1,4)
       WHEN 2 THEN replace(iso,'-','') WHEN 3 THEN 'n/a' ELSE NULL END AS date_raw,
  CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' f' WHEN 2 THEN '1' ELSE 'maybe' END AS flag_raw
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso FROM orders) t""",
    "cust_left": """SELECT c_custkey AS entity_id, c_name AS entity_name, c_acctbal AS balance, c_mktsegment AS segment
FROM customer WHERE c_custkey % 3 <> 0""",
    "cust_right": """SELECT c_custkey AS entity_id, c_name AS entity_name,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 100 END AS balance, c_nationkey AS nation
FROM customer WHERE c_custkey % 3 <> 1
UNION ALL
SELECT c_custkey, c_name, c_acctbal - 1000, c_nationkey FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 4 = 0""",
    "er_input": """SELECT c_custkey AS rid, 'cust ' || CAST(c_custkey AS STRING) || ' ltd' AS name, c_acctbal AS amount FROM customer
UNION ALL
SELECT c_custkey + 1000000, 'Cust ' || CAST(c_custkey AS STRING) || ' Ltd.', c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name].replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), **{t: view(spark, sf_dir, t) for t in ("customer", "orders") if f"FROM {t}" in VIEWS[name]})


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; in its SQL, {view} stands for a dirty view."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            text = sql
            for v, body in VIEWS.items():
                text = text.replace("{" + v + "}", f"({body})")
            SQL[key] = text
        return f

    return register


def _order():
    """Largest balance first, nulls last."""
    return [F.col("balance").isNull(), -F.col("balance"), F.col("entity_id")]



KEYS = merge.MergePolicy(["entity_id", "entity_name"], strong_keys=["entity_id"])
RANKED = """ranked_l AS (SELECT *, row_number() OVER (PARTITION BY entity_id, entity_name ORDER BY balance DESC NULLS LAST) AS rn FROM {cust_left} v),
ranked_r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, entity_name ORDER BY balance DESC NULLS LAST) AS rn FROM {cust_right} v)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = view(spark, sf_dir, "cust_left"), view(spark, sf_dir, "cust_right")
    return merge.universal_merge([left, right], KEYS, [_order(), _order()])[0]


MERGED = f"""(WITH {RANKED} SELECT coalesce(l.entity_id, r.entity_id) AS entity_id, coalesce(l.entity_name, r.entity_name) AS entity_name, coalesce(l.balance, r.balance) AS balance, l.segment, r.nation
FROM (SELECT * FROM ranked_r WHERE rn = 1) r FULL JOIN (SELECT * FROM ranked_l WHERE rn = 1) l ON l.entity_id = r.entity_id AND l.entity_name = r.entity_name)"""


@query(f"SELECT entity_id, entity_name, round(balance, 4) AS balance, segment, CAST(nation AS DOUBLE) AS nation FROM {MERGED} m")
def universal_merge_customers(spark, sf_dir):
    return _merged(spark, sf_dir).select("entity_id", "entity_name", F.round("balance", 4).alias("balance"), "segment", F.col("nation").cast("double").alias("nation"))


@query(f"""WITH {RANKED} SELECT l.entity_id, l.entity_name, round(coalesce(l.balance, r.balance), 4) AS balance, l.segment, r.nation
FROM (SELECT * FROM ranked_r WHERE rn = 1) r JOIN (SELECT * FROM ranked_l WHERE rn = 1) l ON l.entity_id = r.entity_id AND l.entity_name = r.entity_name""")
def safe_inner_merge_customers(spark, sf_dir):
    left, right = view(spark, sf_dir, "cust_left"), view(spark, sf_dir, "cust_right")
    out, _ = merge.safe_inner_chain([left, right], KEYS, [_order(), _order()])
    return out.select("entity_id", "entity_name", F.round("balance", 4).alias("balance"), "segment", "nation")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT o.o_custkey AS custkey, o.o_orderkey AS orderkey, c.c_name AS cust_name, c.c_nationkey AS nationkey, n.n_name AS nation_name
FROM o JOIN customer c ON c.c_custkey = o.o_custkey JOIN (SELECT n_nationkey, n_name FROM nation) n ON n.n_nationkey = c.c_nationkey WHERE rn = 1
AND o.o_custkey IN (SELECT custkey FROM (SELECT o2.o_custkey AS custkey, row_number() OVER (PARTITION BY c2.c_nationkey ORDER BY o2.o_custkey) AS k
  FROM o o2 JOIN customer c2 ON c2.c_custkey = o2.o_custkey WHERE o2.rn = 1) z WHERE k = 1)""")
def multiway_safe_chain(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    c = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("cust_name"), F.col("c_nationkey").alias("nationkey"))
    n = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation_name"))
    policy = merge.MergePolicy(["custkey", "nationkey"], strong_keys=["custkey", "nationkey"], min_keys=1, max_blowup=1e6)
    out, log = merge.safe_inner_chain([o, n, c], policy, [[F.col("orderkey")], [F.col("nation_name")], [F.col("cust_name")]])
    assert [x["joined"] for x in log] == [True, True]
    return out.select("custkey", "orderkey", "cust_name", "nationkey", "nation_name")


@query("""SELECT CAST(entity_id AS DOUBLE) AS entity_id, entity_name, round(balance, 4) AS balance, segment, NULL AS r_name FROM {cust_left} v
UNION ALL SELECT NULL, NULL, NULL, NULL, r_name FROM region""")
def universal_merge_with_keyless(spark, sf_dir):
    left, region = view(spark, sf_dir, "cust_left"), view(spark, sf_dir, "region").select("r_name")
    out, _ = merge.universal_merge([left, region], KEYS, [_order(), [F.col("r_name")]])
    return out.withColumn("balance", F.round("balance", 4))


@query("""SELECT CAST(s_suppkey AS DOUBLE) AS k, s_name AS name, s_acctbal AS bal FROM supplier
UNION ALL SELECT CAST(c_custkey AS DOUBLE), c_name, CAST(c_nationkey AS DOUBLE) FROM customer""")
def type_unified_union(spark, sf_dir):
    a = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("bal"))
    return align.union_unified([a, b])


@query("SELECT c_name AS name, c_acctbal AS acctbal FROM customer UNION SELECT s_name, s_acctbal FROM supplier")
def requested_union_distinct(spark, sf_dir):
    sources = {"customer": {"name": "c_name", "acctbal": "c_acctbal"}, "supplier": {"name": "s_name", "acctbal": "s_acctbal"}}
    parts = [align.requested_subset(align.rename(view(spark, sf_dir, t), m), ["name", "acctbal"]) for t, m in sources.items()]
    return align.union_distinct(parts, ["name", "acctbal"])


@query("""SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) t WHERE rn = 1""")
def dedup_keep_first(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return merge.keep_first(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("""WITH a AS (SELECT count(*) AS n FROM orders GROUP BY o_orderkey), b AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT (SELECT sum(n) FROM a)::BIGINT AS left_rows, (SELECT sum(n) FROM b)::BIGINT AS right_rows, round((SELECT avg(n) FROM a), 6) AS left_mean, round((SELECT avg(n) FROM b), 6) AS right_mean,
round((SELECT avg(n) FROM a) * (SELECT avg(n) FROM b), 6) AS estimate""")
def blowup_guard_stats(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    li = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    g = merge.group_means(o, li, ["k"])
    return g.select("left_rows", "right_rows", *(F.round(c, 6).alias(c) for c in ("left_mean", "right_mean", "estimate")))


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_rate, "
    f"count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique, round((count(DISTINCT {c}) + max(({c} IS NULL)::INT)) / count(*), 4) AS unique_rate FROM {{dirty_customer}} v"
    for c in ("c_custkey", "c_nationkey", "bal_raw", "segment_raw")
)


@query(PROFILE_SQL)
def column_profile(spark, sf_dir):
    return p.column_quality(view(spark, sf_dir, "dirty_customer"))


@query(r"SELECT round(avg(coalesce(regexp_matches(replace(trim(bal_raw), ',', '.'), '^-?\d+(\.\d+)?$'), false)::INT), 6) AS bal_ratio, round(avg(coalesce(regexp_matches(trim(segment_raw), '^-?\d+(\.\d+)?$'), false)::INT), 6) AS segment_ratio FROM {dirty_customer} v")
def numeric_ratio_profile(spark, sf_dir):
    ratio = lambda c: F.round(F.avg(s.is_numeric_ratio_hit(F.col(c)).cast("int")), 6)
    return view(spark, sf_dir, "dirty_customer").agg(ratio("bal_raw").alias("bal_ratio"), ratio("segment_raw").alias("segment_ratio"))


@query("SELECT round(avg((date_raw IS NOT NULL AND date_raw <> '' AND date_raw <> 'None')::INT), 6) AS date_usable, round(avg((flag_raw IS NOT NULL AND flag_raw <> '' AND flag_raw <> 'None')::INT), 6) AS flag_usable FROM {dirty_orders} v")
def usable_value_gate(spark, sf_dir):
    share = lambda c: F.round(F.avg(s.is_usable(F.col(c)).cast("int")), 6)
    return view(spark, sf_dir, "dirty_orders").agg(share("date_raw").alias("date_usable"), share("flag_raw").alias("flag_usable"))


@query(r"SELECT lang, round(sum(length(text) - length(regexp_replace(text, '[^0-9A-Za-z\x{4e00}-\x{9fa5} ]', '', 'g'))) / sum(length(text)), 8) AS punct_rate FROM documents GROUP BY lang")
def punct_rate_screen(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.round(F.sum(F.regexp_count("text", F.lit(p.PUNCTUATION))) / F.sum(F.length("text")), 8).alias("punct_rate"))


SIGMA = "SELECT '{c}' AS column_name, count(*) AS present, count(*) FILTER (abs({c} - m) > 3 * d) AS outliers, round(1 - count(*) FILTER (abs({c} - m) > 3 * d) / count(*), 6) AS score FROM part, (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM part) z"


@query(" UNION ALL ".join(SIGMA.replace("{c}", c) for c in ("p_size", "p_retailprice")))
def sigma_outlier_share(spark, sf_dir):
    return p.sigma_share(view(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


BOUNDS = "(SELECT q25, q75, q25 - 1.5 * (q75 - q25) AS low, q75 + 1.5 * (q75 - q25) AS high FROM (SELECT l[1 + round(0.25 * (len(l) - 1))::INT] AS q25, l[1 + round(0.75 * (len(l) - 1))::INT] AS q75 FROM (SELECT list_sort(list(value)) AS l FROM events) a) b)"


@query(f"SELECT round(q25, 6) AS q25, round(q75, 6) AS q75, round(low, 6) AS low, round(high, 6) AS high FROM {BOUNDS} z")
def iqr_bounds(spark, sf_dir):
    return p.iqr_bounds(view(spark, sf_dir, "events"), "value").select(*(F.round(c, 6).alias(c) for c in ("q25", "q75", "low", "high")))


@query(f"SELECT event_id, CASE WHEN value < low OR value > high THEN NULL ELSE round(value, 6) END AS value FROM events, {BOUNDS} z")
def iqr_outliers_removed(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", "value")
    b = p.iqr_bounds(e, "value").first()
    return clean.apply_rules(e, {"value": clean.outlier_rule(b.low, b.high)}, ["event_id"]).withColumn("value", F.round("value", 6))


BAL = r"regexp_replace(trim(bal_raw), '[,$€£¥]', '', 'g')"
NUM = rf"CASE WHEN regexp_matches({BAL}, '^-?\d+(\.\d+)?$') THEN try_cast({BAL} AS DOUBLE) END"
DATE = "coalesce(try_strptime(trim(date_raw), '%Y-%m-%d'), try_strptime(trim(date_raw), '%m/%d/%Y'), try_strptime(trim(date_raw), '%Y%m%d'))::DATE::VARCHAR"
FLAG = "CASE WHEN lower(trim(flag_raw)) IN ('true','yes','1','t','y') THEN true WHEN lower(trim(flag_raw)) IN ('false','no','0','f','n') THEN false END"


def _rules():
    return {"bal_raw": clean.numeric_rule()}, {"date_raw": clean.date_rule()}, {"flag_raw": clean.bool_rule()}


@query(f"SELECT c_custkey, {NUM} AS bal_raw FROM {{dirty_customer}} v")
def type_clean_numeric(spark, sf_dir):
    return clean.apply_rules(view(spark, sf_dir, "dirty_customer"), _rules()[0], ["c_custkey"]).select("c_custkey", "bal_raw")


@query(f"SELECT c_custkey, 'bal_raw' AS \"column\", bal_raw AS before, ({NUM})::VARCHAR AS after, CASE WHEN {NUM} IS NULL THEN 'Type fix: invalid numeric value' ELSE 'Type fix: converted to numeric' END AS reason FROM {{dirty_customer}} v WHERE bal_raw IS DISTINCT FROM ({NUM})::VARCHAR")
def type_clean_numeric_changes(spark, sf_dir):
    return clean.changes_of(view(spark, sf_dir, "dirty_customer"), _rules()[0], ["c_custkey"])


@query(f"SELECT o_orderkey, {DATE} AS date_raw FROM {{dirty_orders}} v")
def type_clean_date(spark, sf_dir):
    return clean.apply_rules(view(spark, sf_dir, "dirty_orders"), _rules()[1], ["o_orderkey"]).select("o_orderkey", "date_raw")


@query(f"SELECT o_orderkey, 'date_raw' AS \"column\", date_raw AS before, {DATE} AS after, CASE WHEN {DATE} IS NULL THEN 'Type fix: invalid date value' ELSE 'Format fix: standardized date' END AS reason FROM {{dirty_orders}} v WHERE date_raw IS DISTINCT FROM {DATE}")
def type_clean_date_changes(spark, sf_dir):
    return clean.changes_of(view(spark, sf_dir, "dirty_orders"), _rules()[1], ["o_orderkey"])


@query(f"SELECT o_orderkey, ({FLAG})::VARCHAR AS flag_raw FROM {{dirty_orders}} v")
def type_clean_boolean(spark, sf_dir):
    return clean.apply_rules(view(spark, sf_dir, "dirty_orders"), _rules()[2], ["o_orderkey"]).select("o_orderkey", F.col("flag_raw").cast("string").alias("flag_raw"))


@query(f"SELECT o_orderkey, 'flag_raw' AS \"column\", flag_raw AS before, ({FLAG})::VARCHAR AS after, CASE WHEN {FLAG} IS NULL THEN 'Type fix: invalid boolean value' ELSE 'Type fix: converted to boolean' END AS reason FROM {{dirty_orders}} v")
def type_clean_boolean_changes(spark, sf_dir):
    return clean.changes_of(view(spark, sf_dir, "dirty_orders"), _rules()[2], ["o_orderkey"])


@query("SELECT c_custkey, lower(trim(segment_raw)) AS segment_raw FROM {dirty_customer} v")
def fast_clean_string_enum(spark, sf_dir):
    d = view(spark, sf_dir, "dirty_customer").select("c_custkey", "segment_raw")
    return clean.clean_data(d, ["c_custkey"], "fast")[0]


@query(rf"SELECT c_custkey, CASE WHEN regexp_matches({BAL}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN try_cast({BAL} AS DOUBLE) END AS bal_raw FROM {{dirty_customer}} v")
def fast_clean_numeric(spark, sf_dir):
    d = view(spark, sf_dir, "dirty_customer").select("c_custkey", "bal_raw")
    return clean.apply_rules(d, {"bal_raw": clean.numeric_rule(s.to_number_loose)}, ["c_custkey"])


@query(f"""SELECT count(*) AS cleaned_cells, count(DISTINCT o_orderkey) AS cleaned_rows, 'date_raw,flag_raw' AS cleaned_columns, count(*) FILTER (lower(reason) LIKE '%type%') AS type_fixes,
count(*) FILTER (lower(reason) LIKE '%format%') AS format_fixes, 0::BIGINT AS outlier_fixes, 0::BIGINT AS duplicate_fixes FROM (
SELECT o_orderkey, CASE WHEN {DATE} IS NULL THEN 'type' ELSE 'format' END AS reason FROM {{dirty_orders}} v WHERE date_raw IS DISTINCT FROM {DATE}
UNION ALL SELECT o_orderkey, 'type' FROM {{dirty_orders}} v) z""")
def clean_report_summary(spark, sf_dir):
    d = view(spark, sf_dir, "dirty_orders")
    return clean.report_frame(clean.changes_of(d, _rules()[1] | _rules()[2], ["o_orderkey"]), ["o_orderkey"])


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 20")
def value_frequency_topk(spark, sf_dir):
    return p.value_frequency(view(spark, sf_dir, "part"), "p_type", 20)


@query("""WITH f AS (SELECT segment_raw AS raw, trim(segment_raw) AS tidy, count(*) AS n FROM {dirty_customer} v GROUP BY 1, 2),
b AS (SELECT lower(tidy) AS fold, arg_max(tidy, (n, tidy)) AS cleaned FROM (SELECT tidy, sum(n) AS n FROM f GROUP BY tidy) g GROUP BY 1)
SELECT c_custkey, cleaned AS segment_raw FROM {dirty_customer} v JOIN b ON lower(trim(segment_raw)) = fold""")
def value_dictionary_apply(spark, sf_dir):
    d = view(spark, sf_dir, "dirty_customer").select("c_custkey", "segment_raw")
    return clean.apply_dictionary(d, "segment_raw", HeuristicAdvisor().value_dictionary(d, "segment_raw", None))


@query("SELECT p_type AS raw, sha256(concat('v1', '‖', 'p_type', '‖', p_type)) AS key_hash FROM (SELECT DISTINCT p_type FROM part) z")
def value_dictionary_keys(spark, sf_dir):
    return view(spark, sf_dir, "part").select(F.col("p_type").alias("raw")).distinct().withColumn("key_hash", clean.dictionary_key("p_type", F.col("raw")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, NOT (u > 0.95 OR d < 10 AND z < 0.3 OR z > 0.8) AS is_complex FROM (SELECT (count(DISTINCT {c}) + max(({c} IS NULL)::INT)) AS d, d / count(*) AS u, count(*) FILTER ({c} IS NULL) / count(*) AS z FROM {{dirty_customer}} v) q" for c in ("bal_raw", "segment_raw")))
def complex_column_screen(spark, sf_dir):
    seen = p.profile(view(spark, sf_dir, "dirty_customer"), ["bal_raw", "segment_raw"])
    hard = clean.complex_columns(seen, [])
    return spark.createDataFrame([(n, n in hard) for n in seen], "column_name string, is_complex boolean")


def _gappy(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(" ").alias("segment"))


def _known(spark, sf_dir, name="bank", where="c_custkey % 5 <> 0"):
    c = view(spark, sf_dir, "customer").where(where)
    return knowledge.KnowledgeSource(name, c.select(F.upper("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))


GAPPY = "(SELECT c_custkey AS custkey, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE ' ' END AS segment, c_acctbal AS kb, c_mktsegment AS ks FROM customer)"


@query(f"SELECT custkey, name, CASE WHEN balance IS NULL AND custkey % 5 <> 0 THEN kb ELSE balance END AS balance, CASE WHEN trim(segment) = '' AND custkey % 5 <> 0 THEN ks ELSE segment END AS segment FROM {GAPPY} g")
def mvi_fill(spark, sf_dir):
    return knowledge.impute(_gappy(spark, sf_dir), ["custkey"], ["balance", "segment"], [_known(spark, sf_dir)], F.col("name"))


MVI_LOG = f"(SELECT custkey, 'segment' AS \"column\", segment AS before, ks AS after FROM {GAPPY} g WHERE trim(segment) = '' AND custkey % 5 <> 0)"


def _segment_log(spark, sf_dir):
    g = _gappy(spark, sf_dir)
    return knowledge.imputation_changes(g, knowledge.impute(g, ["custkey"], ["segment"], [_known(spark, sf_dir)], F.col("name")), ["custkey"], ["segment"])


@query(f"SELECT * FROM {MVI_LOG} z")
def mvi_change_report(spark, sf_dir):
    return _segment_log(spark, sf_dir)


@query(f"SELECT 'segment' AS \"column\", count(*) AS filled_cells, (SELECT count(*) FROM customer) AS sample_size, round(count(*) / (SELECT count(*) FROM customer), 4) AS filled_ratio FROM {MVI_LOG} z")
def mvi_summary(spark, sf_dir):
    return knowledge.imputation_summary(_segment_log(spark, sf_dir), view(spark, sf_dir, "customer").count())


@query(f"SELECT custkey, CASE WHEN balance IS NOT NULL THEN balance WHEN custkey % 2 = 0 THEN kb ELSE kb END AS balance FROM {GAPPY} g")
def composite_mvi_priority(spark, sf_dir):
    sources = [_known(spark, sf_dir, "first", "c_custkey % 2 = 0"), _known(spark, sf_dir, "second", "true")]
    return knowledge.impute(_gappy(spark, sf_dir), ["custkey"], ["balance"], sources, F.col("name")).select("custkey", "balance")


@query(r"SELECT o_orderkey, nullif(regexp_extract(t, '\b(19\d{2}|20\d{2})\b', 1), '')::DOUBLE AS year FROM (SELECT o_orderkey, 'Released in ' || coalesce(date_raw, 'unknown') || ', a film' AS t FROM {dirty_orders} v) z")
def year_extract(spark, sf_dir):
    t = F.concat(F.lit("Released in "), F.coalesce("date_raw", F.lit("unknown")), F.lit(", a film"))
    return view(spark, sf_dir, "dirty_orders").select("o_orderkey", s.first_year(t).cast("double").alias("year"))


CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in s.CATEGORIES) + " END"


@query(f"SELECT p_partkey, {CATEGORY} AS category FROM (SELECT p_partkey, lower(p_name || CASE p_partkey % 4 WHEN 0 THEN ' is a Sci-Fi Film' WHEN 1 THEN ' Corporation' WHEN 2 THEN ' comedy drama' ELSE '' END) AS t FROM part) z")
def category_extract(spark, sf_dir):
    tail = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' is a Sci-Fi Film' WHEN 1 THEN ' Corporation' WHEN 2 THEN ' comedy drama' ELSE '' END")
    return view(spark, sf_dir, "part").select("p_partkey", s.keyword_category(F.concat("p_name", tail)).alias("category"))


SHIFT = "CASE p_partkey % 3 WHEN 0 THEN 0.005 WHEN 1 THEN 1.0 ELSE 0.0 END"


def _priced(spark, sf_dir):
    part = view(spark, sf_dir, "part").where("p_partkey IS NOT NULL").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("title"), "p_retailprice")
    mine = part.select("p_partkey", "title", (F.col("p_retailprice") + F.expr(SHIFT)).alias("budget"))
    return mine, knowledge.KnowledgeSource("catalogue", part.select("title", F.col("p_retailprice").alias("budget")), "title")


@query(f"SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 1 THEN p_retailprice ELSE p_retailprice + {SHIFT} END, 4) AS budget FROM part")
def validate_numeric_tolerance(spark, sf_dir):
    mine, source = _priced(spark, sf_dir)
    return knowledge.validate(mine, ["p_partkey"], ["budget"], source, "tmdb", F.col("title"))[0].select("p_partkey", F.round("budget", 4).alias("budget"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE w END AS title FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN ' ' || upper(c_name) WHEN 1 THEN 'wrong' ELSE c_name END AS w FROM customer) z")
def validate_text_match(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    mine = c.select("c_custkey", F.col("c_name").alias("key"), F.expr("CASE c_custkey % 3 WHEN 0 THEN ' ' || upper(c_name) WHEN 1 THEN 'wrong' ELSE c_name END").alias("title"))
    source = knowledge.KnowledgeSource("registry", c.select(F.col("c_name").alias("name"), F.col("c_name").alias("title")), exact=False)
    return knowledge.validate(mine, ["c_custkey"], ["title"], source, "wikipedia", F.col("key"))[0].select("c_custkey", "title")


@query("SELECT count(*) AS validated_cells, count(*) FILTER (p_partkey % 3 = 1) AS corrected_cells, round(count(*) FILTER (p_partkey % 3 <> 1) / count(*), 6) AS accuracy_before FROM part")
def validation_report_summary(spark, sf_dir):
    mine, source = _priced(spark, sf_dir)
    _, log, counts = knowledge.validate(mine, ["p_partkey"], ["budget"], source, "tmdb", F.col("title"))
    n = log.agg(F.count(F.lit(1)).alias("corrected_cells"))
    return counts.crossJoin(n).select("validated_cells", "corrected_cells", F.round((F.col("validated_cells") - F.col("corrected_cells")) / F.col("validated_cells"), 6).alias("accuracy_before"))  # a row each


RATIO = "round(1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name)), 6)"
PAIRS = f"""(WITH r AS (SELECT *, lower(name[1]) AS block, row_number() OVER (PARTITION BY lower(name[1]) ORDER BY lower(name), rid) AS at FROM {{er_input}} v)
SELECT a.rid AS rid_a, b.rid AS rid_b, {RATIO} AS similarity FROM r a JOIN r b ON a.block = b.block AND b.at > a.at AND b.at <= a.at + 5 WHERE {RATIO} > 0.7)"""


@query(f"SELECT * FROM {PAIRS} z")
def er_candidate_pairs(spark, sf_dir):
    return resolve.candidate_pairs(view(spark, sf_dir, "er_input"), "rid", "name")


@query()
def er_candidate_pairs_ratcliff(spark, sf_dir):
    return resolve.candidate_pairs(view(spark, sf_dir, "er_input"), "rid", "name", similarity="ratcliff")


def _clustered(spark, sf_dir):
    d = view(spark, sf_dir, "er_input")
    same = F.regexp_replace(F.lower("name"), r"[^a-z0-9]", "")
    digits = d.select("rid", same.alias("fold"))
    pairs = resolve.candidate_pairs(d, "rid", "name", least=0.9)
    a, b = digits.select(F.col("rid").alias("rid_a"), F.col("fold").alias("fa")), digits.select(F.col("rid").alias("rid_b"), F.col("fold").alias("fb"))
    return resolve.clusters(d, pairs.join(a, "rid_a").join(b, "rid_b").where("fa = fb"), "rid")


@query("SELECT rid, CASE WHEN rid >= 1000000 THEN rid - 1000000 ELSE rid END AS cluster_id FROM {er_input} v")
def er_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir).select("rid", "cluster_id")


@query("""SELECT cluster_id, count(*) AS records_merged, arg_min(name, rid) AS name, round(avg(amount), 4) AS amount
FROM (SELECT *, CASE WHEN rid >= 1000000 THEN rid - 1000000 ELSE rid END AS cluster_id FROM {er_input} v) z GROUP BY cluster_id""")
def er_merge(spark, sf_dir):
    return resolve.merge_clusters(_clustered(spark, sf_dir), "rid").select("cluster_id", "records_merged", "name", F.round("amount", 4).alias("amount"))


@query("SELECT rid - 1000000 AS cluster_id, 2::BIGINT AS records_merged FROM {er_input} v WHERE rid >= 1000000")
def er_report(spark, sf_dir):
    return resolve.report(_clustered(spark, sf_dir))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_json_props(spark, sf_dir):
    e = view(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return files.flatten(e)


@query(f"SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, sum((balance IS NULL)::INT + (segment IS NULL)::INT + (nation IS NULL)::INT)::BIGINT AS null_cells, round(1 - sum((balance IS NULL)::INT + (segment IS NULL)::INT + (nation IS NULL)::INT) / (5 * count(*)), 6) AS completeness FROM {MERGED} m")
def quality_metrics_completeness(spark, sf_dir):
    return quality.completeness(_merged(spark, sf_dir))


@query("SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) d) AS duplicate_rows, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) d)) / count(*), 6) AS duplicate_rate FROM events")
def quality_metrics_duplicates(spark, sf_dir):
    return quality.duplicates(view(spark, sf_dir, "events").select("user_id", "event_type"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_rate, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique, round((count(DISTINCT {c}) + max(({c} IS NULL)::INT)) / count(*), 4) AS unique_rate FROM {MERGED} m" for c in ("entity_id", "entity_name", "balance", "segment", "nation")))
def quality_per_column(spark, sf_dir):
    return p.column_quality(_merged(spark, sf_dir).select("entity_id", "entity_name", "balance", "segment", "nation"))


@query("""WITH c AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer), a AS (SELECT 1 - count(*) FILTER (abs(c_acctbal - m) > 3 * d) / count(*) AS k FROM customer, c)
SELECT 1.0::DOUBLE AS completeness, round(k, 6) AS consistency, round(100 * (0.3 * (1 + k) / 2 + 0.3 * 1.0 + 0.2 * 1.0), 2) AS overall FROM a""")
def quality_overall_score(spark, sf_dir):
    df = view(spark, sf_dir, "customer").select("c_name", "c_acctbal")
    r = quality.quality_report(df, coverage=1.0, mapped=[2], targets=2)
    score = quality.overall(r.accuracy, r.join_accuracy, r.mapping_coverage, 0.0, 0.0)
    return spark.createDataFrame([(r.completeness, round(r.consistency, 6), score)], "completeness double, consistency double, overall double")


def _values(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS t({names})"


@query(_values(HEADER_SCORES, "wanted, header, score"))
def semantic_header_scores(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    seen = p.profile(c)
    rows = [(w, h, align.header_score(h, w, "cust", seen[h])) for w in ("id", "name", "balance") for h in c.columns]
    return spark.createDataFrame(rows, "wanted string, header string, score double")


@query(_values("('date,entity_id', true), ('entity_id', false), ('date,name', false)", "keys, strong"))
def strong_key_guard(spark, sf_dir):
    policy = merge.MergePolicy(["entity_id", "entity_name", "date"], strong_keys=["entity_id", "entity_name"])
    cases = [["date", "entity_id"], ["entity_id"], ["date", "name"]]
    return spark.createDataFrame([(",".join(k), merge.strong_enough(k, policy)) for k in cases], "keys string, strong boolean")


@query("""WITH RECURSIVE v AS (SELECT segment_raw AS value, count(*) AS n FROM {dirty_customer} d GROUP BY segment_raw),
links AS (SELECT a.value AS a, b.value AS b FROM v a, v b WHERE a.value <> b.value AND 1 - levenshtein(lower(a.value), lower(b.value)) / greatest(length(a.value), length(b.value)) >= 0.9),
reach AS (SELECT value, value AS peer FROM v UNION SELECT reach.value, links.b FROM reach JOIN links ON links.a = reach.peer)
SELECT reach.value, arg_max(reach.peer, (v.n, reach.peer)) AS representative FROM reach JOIN v ON v.value = reach.peer GROUP BY reach.value""")
def similar_value_clusters(spark, sf_dir):
    return clean.similar_values(p.value_frequency(view(spark, sf_dir, "dirty_customer"), "segment_raw"))


@query("SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def row_cap(spark, sf_dir):
    return files.row_cap(view(spark, sf_dir, "lineitem"), 1000, ["l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey, CASE WHEN trim(segment_raw) <> '' THEN 'segment_name' WHEN trim(bal_raw) <> '' THEN 'bal_raw' END AS field FROM
(SELECT c_custkey, bal_raw, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE segment_raw END AS segment_raw FROM {dirty_customer} v) w""")
def er_entity_field(spark, sf_dir):
    d = view(spark, sf_dir, "dirty_customer").select("c_custkey", "bal_raw", F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("segment_raw")).alias("segment_name"))
    return d.select("c_custkey", resolve.entity_field(d).alias("field"))


@query(r"""SELECT o_orderkey, CASE WHEN regexp_matches(d, '^\d{4}-\d{1,2}-\d{1,2}') THEN regexp_extract(d, '^(\d{4})-', 1)::INT || '-' || lpad(regexp_extract(d, '^\d{4}-(\d{1,2})-', 1), 2, '0') || '-' || lpad(regexp_extract(d, '^\d{4}-\d{1,2}-(\d{1,2})', 1), 2, '0')
 WHEN regexp_matches(d, '^\d{1,2}/\d{1,2}/\d{4}') THEN regexp_extract(d, '^\d{1,2}/\d{1,2}/(\d{4})', 1)::INT || '-' || lpad(regexp_extract(d, '^(\d{1,2})/', 1), 2, '0') || '-' || lpad(regexp_extract(d, '^\d{1,2}/(\d{1,2})/', 1), 2, '0')
 ELSE d END AS date_raw FROM (SELECT o_orderkey, trim(date_raw) AS d FROM {dirty_orders} v) w""")
def date_digits(spark, sf_dir):
    return clean.apply_rules(view(spark, sf_dir, "dirty_orders").select("o_orderkey", F.trim("date_raw").alias("date_raw")), {"date_raw": clean.date_digits_rule()}, ["o_orderkey"])


@query("SELECT c.column_name FROM (SELECT max((bal_raw IS NULL OR bal_raw = '')::INT) AS b, max((segment_raw IS NULL OR segment_raw = '')::INT) AS s, max((c_nationkey IS NULL)::INT) AS n FROM {dirty_customer} v) t, (VALUES ('bal_raw'), ('segment_raw'), ('c_nationkey')) AS c(column_name) WHERE CASE c.column_name WHEN 'bal_raw' THEN b WHEN 'segment_raw' THEN s ELSE n END = 1")
def updatable_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in clean.updatable_columns(view(spark, sf_dir, "dirty_customer"), ["c_custkey"])], "column_name string")


@query(_values("('id', 'wine_id'), ('name', 'wine_name'), ('ph', 'ph')", "wanted, header"))
def best_names_by_header(spark, sf_dir):
    got = align.best_names(["wine_id", "id", "ph", "wine_name", "name_of_region"], ["id", "name", "ph"], "wine")
    return spark.createDataFrame(list(got.items()), "wanted string, header string")


@query(f"SELECT c_custkey, ({NUM})::VARCHAR AS bal_raw, trim(segment_raw) AS segment_raw FROM {{dirty_customer}} v")
def cleaned_in_turn(spark, sf_dir):
    """Two cleaners and one that fails, which the report names."""
    d = view(spark, sf_dir, "dirty_customer").select("c_custkey", "bal_raw", "segment_raw")

    def by(rules):
        return lambda df: (clean.apply_rules(df, rules, ["c_custkey"]), clean.changes_of(df, rules, ["c_custkey"]), clean.CleaningReport())

    out, _, report = clean.clean_in_turn(d, {"numbers": by(_rules()[0]), "broken": lambda df: df.nothing(), "text": by({"segment_raw": clean.text_rule(False)})}, ["c_custkey"])
    assert len(report.errors) == 1 and report.errors[0].startswith("broken: ") and report.cleaned_columns == ["bal_raw", "segment_raw"]
    return out.withColumn("bal_raw", F.col("bal_raw").cast("string"))
