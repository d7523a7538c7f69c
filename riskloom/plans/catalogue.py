"""Queries over the bundled tables, and the same in SQL.

The tables hold no source code, so columns stand in for it (roles below); the
operators are those that the analysis of real projects uses.  Queries from
source text on are in :mod:`riskloom.plans.generated`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as X
from ..operators import coverage as C
from ..operators import duplicates as D
from ..operators import report as R
from ..operators import scoring as J
from ..schemas import RULES


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Roles of columns.
def units(s, d) -> DataFrame:
    """Functions: files are customers, functions their orders."""
    o = _t(s, d, "orders").select(F.col("o_custkey").cast("string").alias("file"), "o_orderkey", F.dayofyear("o_orderdate").cast("bigint").alias("start_line"))
    return o.select("file", F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("qualified_name"), "start_line", (F.col("start_line") + F.col("o_orderkey") % 20).alias("end_line"), (1 + F.col("o_orderkey") % 15).alias("complexity"), F.col("o_orderkey").alias("ord"))


def covered(s, d) -> DataFrame:
    """Coverage rows: files are customers, spans days of shipping."""
    li = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.dayofyear("l_shipdate").cast("bigint").alias("start_line"), (F.col("l_quantity") * 2.0).alias("line_coverage_pct"))
    o = _t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("file"))
    return li.join(o, "l_orderkey").select("file", "start_line", (F.col("start_line") + F.col("l_linenumber")).alias("end_line"), "line_coverage_pct")


def regions(s, d) -> DataFrame:
    """Regions: functions are users' days, lines minutes; some end before they start."""
    e = _t(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", "user_id", F.to_date("ts").alias("day"), F.minute("ts").cast("bigint").alias("start_line"), (F.minute("ts") + k % 7 - 1).cast("bigint").alias("end_line"), (F.col("event_id") % 3).alias("hits"))


def checked(s, d) -> DataFrame:
    """Idiom rows: each order's items give its checks."""
    rules = F.array(*[F.lit(r[0]) for r in RULES])
    li = _t(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.element_at(rules, (F.col("l_partkey") % 8 + 1).cast("int")).alias("rule"), (F.col("l_suppkey") % 4).alias("pick")).alias("c"))
    li = li.filter("c.pick = 0").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["rule"]).alias("checks"))
    o = _t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("file"), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("qualified_name"), F.concat(F.col("o_orderstatus"), F.col("o_totalprice").cast("bigint").cast("string")).alias("sig_fingerprint"), F.concat_ws("/", F.dayofyear("o_orderdate"), (F.col("o_custkey") % 40).cast("string")).alias("body_fingerprint"))
    rows = o.join(li, "l_orderkey", "left").withColumn("checks", F.coalesce("checks", F.array().cast("array<string>")))
    return rows.select("file", "qualified_name", X.demerits(F.col("checks")).alias("demerits"), "checks", F.lit(False).alias("sig_duplicate"), F.lit(False).alias("body_duplicate"), "sig_fingerprint", "body_fingerprint", F.col("l_orderkey").alias("ord"))


def records(s, d) -> DataFrame:
    return J.score(units(s, d), covered(s, d), D.check_duplicates(checked(s, d)))


_UNITS = """units AS (SELECT CAST(o_custkey AS VARCHAR) AS file, 'f' || CAST(o_orderkey % 3 AS VARCHAR) AS qualified_name, CAST(dayofyear(o_orderdate) AS BIGINT) AS start_line,
  CAST(dayofyear(o_orderdate) AS BIGINT) + o_orderkey % 20 AS end_line, 1 + o_orderkey % 15 AS complexity, o_orderkey AS ord FROM orders)"""
_COVERED = """covered AS (SELECT CAST(o_custkey AS VARCHAR) AS file, CAST(dayofyear(l_shipdate) AS BIGINT) AS start_line, CAST(dayofyear(l_shipdate) AS BIGINT) + l_linenumber AS end_line,
  l_quantity * 2.0::double AS line_coverage_pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
merged AS (SELECT file, start_line, end_line, max(line_coverage_pct) AS line_coverage_pct FROM covered GROUP BY ALL)"""
_BEST = """best AS (SELECT u.ord, m.line_coverage_pct AS pct, row_number() OVER (PARTITION BY u.ord ORDER BY least(u.end_line, m.end_line) - greatest(u.start_line, m.start_line) DESC, m.start_line DESC, m.end_line DESC) AS rn
  FROM units u JOIN merged m ON u.file = m.file AND u.start_line <= m.end_line AND m.start_line <= u.end_line),
scored AS (SELECT u.*, coalesce(b.pct, 0.0::double) AS coverage_pct FROM units u LEFT JOIN best b ON u.ord = b.ord AND b.rn = 1)"""
_WEIGHTS = " ".join(f"WHEN '{r[0]}' THEN {r[1]}" for r in RULES)
_NAMES = ", ".join(f"'{r[0]}'" for r in RULES)
_CHECKED = f"""items AS (SELECT l_orderkey, l_linenumber, [{_NAMES}][l_partkey % 8 + 1] AS rule FROM lineitem WHERE l_suppkey % 4 = 0),
listed AS (SELECT l_orderkey, list(rule ORDER BY l_linenumber, rule) AS checks, sum(CASE rule {_WEIGHTS} END) AS demerits FROM items GROUP BY l_orderkey),
plain AS (SELECT CAST(o_custkey AS VARCHAR) AS file, 'f' || CAST(o_orderkey % 3 AS VARCHAR) AS qualified_name, o_orderstatus || CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS sig,
  CAST(dayofyear(o_orderdate) AS VARCHAR) || '/' || CAST(o_custkey % 40 AS VARCHAR) AS body, o_orderkey AS ord, coalesce(checks, CAST([] AS VARCHAR[])) AS checks, CAST(coalesce(demerits, 0) AS BIGINT) AS demerits0
  FROM orders LEFT JOIN listed ON l_orderkey = o_orderkey),
checked AS (SELECT *, count(*) OVER (PARTITION BY sig) >= 2 AS sig_duplicate, count(*) OVER (PARTITION BY body) >= 2 AS body_duplicate,
  demerits0 + 3 * CAST(count(*) OVER (PARTITION BY sig) >= 2 AS INT) + 3 * CAST(count(*) OVER (PARTITION BY body) >= 2 AS INT) AS demerits FROM plain)"""
_RECORDS = f"""{_UNITS}, {_COVERED}, {_BEST}, {_CHECKED},
firsts AS (SELECT *, row_number() OVER (PARTITION BY file, qualified_name ORDER BY ord) AS rn FROM scored),
lasts AS (SELECT *, row_number() OVER (PARTITION BY file, qualified_name ORDER BY ord DESC) AS rl FROM checked),
joined AS (SELECT f.file, f.qualified_name AS name, f.complexity, f.coverage_pct, f.start_line, f.ord, coalesce(l.demerits, 0) AS demerits, coalesce(l.checks, CAST([] AS VARCHAR[])) AS checks,
  coalesce(l.sig_duplicate, false) AS sig_duplicate, coalesce(l.body_duplicate, false) AS body_duplicate FROM firsts f LEFT JOIN lasts l ON f.file = l.file AND f.qualified_name = l.qualified_name AND f.rn = 1 AND l.rl = 1),
crap AS (SELECT *, CAST(complexity AS DOUBLE) * CAST(complexity AS DOUBLE) * (1.0::double - coverage_pct / 100.0::double) * (1.0::double - coverage_pct / 100.0::double) * (1.0::double - coverage_pct / 100.0::double) + CAST(complexity AS DOUBLE) AS crap_score,
  1.0::double + 0.25::double * CAST(demerits AS DOUBLE) AS idiom_penalty FROM joined),
records AS (SELECT *, crap_score * idiom_penalty AS risk_score FROM crap)"""
_CLEAN = "(coverage_pct >= 50 AND complexity < 10 AND idiom_penalty <= 1 AND len(checks) = 0 AND NOT sig_duplicate AND NOT body_duplicate)"
_CODE = "CASE WHEN coverage_pct < 50 AND complexity >= 10 THEN 'high-risk' WHEN coverage_pct < 50 THEN 'low-coverage' WHEN complexity >= 10 THEN 'high-complexity' WHEN idiom_penalty > 1 THEN 'idiom-violation' ELSE 'risky' END"
_SHOW = "file, name, complexity, coverage_pct, crap_score, idiom_penalty, risk_score, start_line, array_to_string(checks, ',') AS checks, sig_duplicate, body_duplicate"
_REGIONS = """regions AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(minute(ts) AS BIGINT) AS start_line, CAST(minute(ts) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 - 1 AS end_line, event_id % 3 AS hits FROM events)"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("file", "name", "complexity", "coverage_pct", "crap_score", "idiom_penalty", "risk_score", "start_line", F.array_join("checks", ",").alias("checks"), "sig_duplicate", "body_duplicate")


_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


@_query("f1_crap_score", "SELECT o_orderkey, CAST(1 + o_orderkey % 15 AS DOUBLE) * CAST(1 + o_orderkey % 15 AS DOUBLE) * (1.0::double - CAST(o_orderkey % 101 AS DOUBLE) / 100.0::double) * (1.0::double - CAST(o_orderkey % 101 AS DOUBLE) / 100.0::double) * (1.0::double - CAST(o_orderkey % 101 AS DOUBLE) / 100.0::double) + CAST(1 + o_orderkey % 15 AS DOUBLE) AS crap_score FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    return _t(s, d, "orders").select(k, X.crap(1 + k % 15, (k % 101).cast("double")).alias("crap_score"))


@_query("f2_idiom_penalty", "SELECT o_orderkey, 1.0::double + 0.25::double * CAST(o_orderkey % 9 AS DOUBLE) AS idiom_penalty FROM orders")
def _(s, d):
    return _t(s, d, "orders").select("o_orderkey", X.idiom_penalty(F.col("o_orderkey") % 9).alias("idiom_penalty"))


@_query("f3_risk_score", f"WITH {_RECORDS} SELECT ord, risk_score FROM records")
def _(s, d):
    return records(s, d).select("ord", "risk_score")


@_query("f4_interval_overlap", "SELECT l_orderkey, l_linenumber, greatest(0, least(l_partkey % 50 + l_linenumber, l_suppkey % 50 + 5) - greatest(l_partkey % 50, l_suppkey % 50) + 1) AS lines FROM lineitem")
def _(s, d):
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.overlap(a, a + F.col("l_linenumber"), b, b + 5).alias("lines"))


@_query("f5_saturating_cast", "SELECT o_orderkey, CAST(least(o_orderkey * 1000003, 4294967295) AS BIGINT) AS line FROM orders")
def _(s, d):
    return _t(s, d, "orders").select("o_orderkey", X.saturate((F.col("o_orderkey") * 1000003).cast("decimal(20,0)")).alias("line"))


@_query("f6_rule_weight_and_suggestion", "SELECT * FROM (VALUES " + ", ".join("('{}', {}, '{}')".format(*r) for r in RULES) + ") t(rule, weight, suggestion)")
def _(s, d):
    from ..schemas import idiom_rules

    return idiom_rules(s)


@_query("f7_lint_code", f"WITH {_RECORDS} SELECT ord, {_CODE} AS lint_code FROM records")
def _(s, d):
    return records(s, d).select("ord", X.lint_code(F.col("coverage_pct"), F.col("complexity"), F.col("idiom_penalty")).alias("lint_code"))


@_query("f8_level", f"WITH {_RECORDS} SELECT ord, CASE WHEN risk_score >= 30 THEN 'warning' ELSE 'note' END AS level FROM records")
def _(s, d):
    return records(s, d).select("ord", X.level(F.col("risk_score"), 30.0).alias("level"))


@_query("f10_duration", "SELECT o_orderkey, CASE WHEN ms < 60000 THEN CAST(ms // 1000 AS VARCHAR) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 's' ELSE CAST(ms // 60000 AS VARCHAR) || 'm ' || CAST(ms // 1000 % 60 AS VARCHAR) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 's' END AS took FROM (SELECT o_orderkey, o_orderkey * 125 % 200000 AS ms FROM orders)")
def _(s, d):
    return _t(s, d, "orders").select("o_orderkey", X.duration((F.col("o_orderkey") * 125 % 200000) / 1000.0).alias("took"))


@_query("f11_fixed_point", "SELECT p_partkey, format('{:.1f}', p_retailprice / 8) AS one, format('{:.0f}', p_size / 2.0::double) AS none, format('{:.2f}', p_size / 8.0::double) AS two FROM part")
def _(s, d):
    return _t(s, d, "part").select("p_partkey", X.fixed(F.col("p_retailprice") / 8, 1).alias("one"), X.fixed(F.col("p_size") / 2.0, 0).alias("none"), X.fixed(F.col("p_size") / 8.0, 2).alias("two"))


@_query("a2_region_span", f"WITH {_REGIONS} SELECT user_id, day, min(start_line) AS start_line, max(end_line) AS end_line FROM regions GROUP BY user_id, day")
def _(s, d):
    r = regions(s, d).select("user_id", "day", F.array(*[F.col(c).cast("decimal(20,0)") for c in ("start_line", "user_id", "end_line", "user_id", "hits")]).alias("r"))
    r = r.groupBy("user_id", "day").agg(C.region_span(F.collect_list("r")).alias("span"))
    return r.select("user_id", "day", "span.*")


@_query("g1_line_ranges", f"WITH {_REGIONS} SELECT event_id, unnest(generate_series(start_line, end_line)) AS line FROM regions WHERE start_line <= end_line")
def _(s, d):
    return C.line_ranges(regions(s, d), ["event_id"])


@_query("a3_line_hits", f"WITH {_REGIONS}, lines AS (SELECT user_id, day, hits, unnest(generate_series(start_line, end_line)) AS line FROM regions WHERE start_line <= end_line) SELECT user_id, day, line, max(hits) AS hits FROM lines GROUP BY user_id, day, line")
def _(s, d):
    return C.line_hits(regions(s, d), ["user_id", "day"])


@_query("a4_line_coverage", f"WITH {_REGIONS}, lines AS (SELECT user_id, day, hits, unnest(generate_series(start_line, end_line)) AS line FROM regions WHERE start_line <= end_line), per AS (SELECT user_id, day, line, max(hits) AS hits FROM lines GROUP BY ALL), pct AS (SELECT user_id, day, sum(CASE WHEN hits > 0 THEN 1.0::double ELSE 0.0::double END) / count(*) * 100.0::double AS p FROM per GROUP BY ALL), fns AS (SELECT DISTINCT user_id, day FROM regions) SELECT user_id, day, coalesce(p, 100.0::double) AS line_coverage_pct FROM fns LEFT JOIN pct USING (user_id, day)")
def _(s, d):
    r = regions(s, d)
    pct = C.line_coverage(r, ["user_id", "day"])
    return r.select("user_id", "day").distinct().join(pct, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("line_coverage_pct", F.lit(100.0)).alias("line_coverage_pct"))


@_query("s8_convert_functions", f"WITH {_REGIONS}, lines AS (SELECT user_id, day, hits, unnest(generate_series(start_line, end_line)) AS line FROM regions WHERE start_line <= end_line AND event_id % 4 <> 1), per AS (SELECT user_id, day, line, max(hits) AS hits FROM lines GROUP BY ALL), pct AS (SELECT user_id, day, sum(CASE WHEN hits > 0 THEN 1.0::double ELSE 0.0::double END) / count(*) * 100.0::double AS p FROM per GROUP BY ALL), fns AS (SELECT user_id, day, min(start_line) AS start_line, max(end_line) AS end_line FROM regions GROUP BY ALL) SELECT '/proj/' || CAST(user_id AS VARCHAR) || '/' || CAST(day AS VARCHAR) AS file, start_line, end_line, coalesce(p, 100.0::double) AS line_coverage_pct FROM fns LEFT JOIN pct USING (user_id, day) WHERE user_id % 5 <> 0")
def _(s, d):
    kind = F.when(F.col("event_id") % 4 == 1, 2).otherwise(0)
    region = F.array(*[c.cast("decimal(20,0)") for c in (F.col("start_line"), F.lit(1), F.col("end_line"), F.lit(1), F.col("hits"), F.lit(0), F.lit(0), kind)])
    r = regions(s, d).groupBy("user_id", "day").agg(F.collect_list(region).alias("regions"))
    root = F.when(F.col("user_id") % 5 == 0, "/proj2/").otherwise("/proj/")
    return C.function_coverage(r.select(F.array(F.concat(root, F.col("user_id").cast("string"), F.lit("/"), F.col("day").cast("string"))).alias("filenames"), "regions"), "/proj")


@_query("a5_span_dedup", f"WITH {_COVERED} SELECT * FROM merged")
def _(s, d):
    return C.merge_spans(covered(s, d))


@_query("a6_demerit_sum", f"WITH {_CHECKED} SELECT ord, demerits FROM checked")
def _(s, d):
    return D.check_duplicates(checked(s, d)).select("ord", "demerits")


@_query("a7_duplicates", "SELECT doc_id, count(*) OVER (PARTITION BY lang, source, n_chars % 50) >= 2 AS sig_duplicate, count(*) OVER (PARTITION BY text) >= 2 AS body_duplicate FROM documents")
def _(s, d):
    rows = _t(s, d, "documents").select("doc_id", F.concat_ws("|", "lang", "source", F.col("n_chars") % 50).alias("sig"), F.sha2("text", 256).alias("body"))
    return D.flag_repeated(D.flag_repeated(rows, "sig", "sig_duplicate"), "body", "body_duplicate").select("doc_id", "sig_duplicate", "body_duplicate")


@_query("u3_repeated_keys", "SELECT CAST(l_partkey AS VARCHAR) AS part FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_partkey HAVING count(*) >= 2")
def _(s, d):
    rows = _t(s, d, "lineitem").filter("l_linenumber <= 3").select(F.col("l_partkey").cast("string").alias("part"))
    return D.repeated_keys(rows, "part")


@_query("j4_duplicate_flag_join", "SELECT p_partkey, p_type IS NOT NULL AND count(*) OVER (PARTITION BY p_type, p_size) >= 2 AS twice FROM part")
def _(s, d):
    rows = _t(s, d, "part").select("p_partkey", F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("key"))
    return D.flag_repeated(rows, "key", "twice").select("p_partkey", "twice")


@_query("a8_warning_count", f"WITH {_RECORDS} SELECT count(*) FILTER (risk_score >= 30) AS warnings FROM records")
def _(s, d):
    return R.summary(records(s, d)).select("warnings")


@_query("a9_any_exceeds", f"WITH {_RECORDS} SELECT bool_or(risk_score > 500) AS exceeds FROM records")
def _(s, d):
    return R.any_exceeds(records(s, d), 500.0)


@_query("a13_row_counts", f"WITH {_UNITS}, {_COVERED} SELECT (SELECT count(*) FROM units) AS functions, (SELECT count(*) FROM covered) AS coverage_rows")
def _(s, d):
    return R.row_counts(functions=units(s, d), coverage_rows=covered(s, d))


@_query("j1_best_overlap", f"WITH {_UNITS}, {_COVERED}, {_BEST} SELECT ord, coverage_pct FROM scored")
def _(s, d):
    return J.best_overlap(units(s, d), C.merge_spans(covered(s, d))).select("ord", "coverage_pct")


@_query("j2_consume_once", "WITH l AS (SELECT l_orderkey AS a, l_suppkey % 3 AS b, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS ord, l_quantity FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ord) AS rn FROM (SELECT DISTINCT a, b, ord FROM l)), g AS (SELECT a, b, l_quantity AS q, row_number() OVER (PARTITION BY a, b ORDER BY ord DESC, l_quantity DESC) AS rl FROM l) SELECT f.a, f.b, f.ord, g.q AS q FROM f LEFT JOIN g ON f.a = g.a AND f.b = g.b AND rn = 1 AND rl = 1")
def _(s, d):
    rows = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") % 3).alias("b"), (F.col("l_linenumber") * F.lit(1000000000).cast("bigint") + F.col("l_partkey")).alias("ord"), F.col("l_quantity").alias("q"))
    return J.consume_once(rows.select("a", "b", "ord").distinct(), rows, ["a", "b"])


@_query("j5_rule_lookup", f"WITH items AS (SELECT l_orderkey, l_linenumber, [{_NAMES}][l_partkey % 8 + 1] AS rule FROM lineitem) SELECT l_orderkey, l_linenumber, rule, CASE rule {_WEIGHTS} END AS weight FROM items")
def _(s, d):
    from ..schemas import idiom_rules

    rules = F.array(*[F.lit(r[0]) for r in RULES])
    li = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(rules, (F.col("l_partkey") % 8 + 1).cast("int")).alias("rule"))
    return li.join(F.broadcast(idiom_rules(s)), "rule").select("l_orderkey", "l_linenumber", "rule", "weight")  # eight rows


@_query("p9_project_prefix", "SELECT p_partkey FROM part WHERE p_type = 'A' OR starts_with(p_brand || '/' || p_type, 'Brand#1/') OR starts_with(p_brand || '/' || p_type, 'Brand#12/')")
def _(s, d):
    path = F.concat_ws("/", "p_brand", "p_type")
    return _t(s, d, "part").filter(X.under(path, "Brand#1") | X.under(path, "Brand#12")).select("p_partkey")


@_query("p11_code_regions", f"WITH {_REGIONS} SELECT event_id FROM regions WHERE event_id % 9 >= 5 AND (event_id % 9 <= 7 OR hits = 0)")
def _(s, d):
    r = regions(s, d)
    row = F.concat(F.array_repeat(F.lit(1).cast("decimal(20,0)"), 7), F.array(F.col("hits").cast("decimal(20,0)")))
    row = F.slice(row, 1, (F.col("event_id") % 9).cast("int"))
    return r.filter(F.size(C.code_regions(F.array(row))) > 0).select("event_id")


@_query("p12_p13_exclusions", f"WITH {_RECORDS} SELECT {_SHOW} FROM records WHERE NOT contains(file, '7') AND NOT contains(file, '33') AND name NOT IN ('f1')")
def _(s, d):
    return _shown(R.exclude(records(s, d), ["7", "33"], ["f1"]))


@_query("p14_display_threshold", f"WITH {_RECORDS} SELECT {_SHOW} FROM records WHERE risk_score >= 30 AND NOT {_CLEAN}")
def _(s, d):
    return _shown(R.displayed(records(s, d)))


@_query("p15_clean", f"WITH {_RECORDS} SELECT ord FROM records WHERE {_CLEAN}")
def _(s, d):
    return records(s, d).filter(X.is_clean()).select("ord")


@_query("p16_display_path", f"WITH {_RECORDS} SELECT ord, CASE WHEN starts_with('/p/' || file, '/p/') THEN substr('/p/' || file, 4) ELSE file END AS shown FROM records")
def _(s, d):
    u = units(s, d).withColumn("file", F.concat(F.lit("/p/"), F.col("file")))
    c = covered(s, d).withColumn("file", F.concat(F.lit("/p/"), F.col("file")))
    i = D.check_duplicates(checked(s, d)).withColumn("file", F.concat(F.lit("/p/"), F.col("file")))
    return J.score(u, c, i, "/p").select("ord", F.col("file").alias("shown"))


@_query("o1_rank_by_risk", f"WITH {_RECORDS} SELECT {_SHOW} FROM records ORDER BY risk_score DESC, ord")
def _(s, d):
    return _shown(J.rank(records(s, d)))


@_query("o3_top_n", f"WITH {_RECORDS}, top AS (SELECT * FROM records ORDER BY risk_score DESC, ord LIMIT 25) SELECT {_SHOW} FROM top WHERE NOT {_CLEAN}")
def _(s, d):
    return _shown(R.displayed(records(s, d), top=25))


@_query("k2_diagnostic", f"""WITH {_RECORDS}, t AS (SELECT *, CASE WHEN risk_score >= 100 THEN 'warning' ELSE 'note' END AS level, {_CODE} AS code FROM records WHERE risk_score >= 100 AND NOT {_CLEAN})
SELECT ord, level || '[' || code || ']: `' || name || '` has high change-risk score' || chr(10) || ' --> ' || file || ':' || CAST(start_line AS VARCHAR) || chr(10) || '  |' || chr(10)
|| '  = note: RISK = ' || format('{{:.1f}}', risk_score) || ', CRAP = ' || format('{{:.1f}}', crap_score) || ', CC = ' || CAST(complexity AS VARCHAR) || ', Cov = ' || format('{{:.0f}}', coverage_pct) || '%' || chr(10)
|| CASE WHEN coverage_pct < 50 THEN '  = help: coverage is ' || format('{{:.0f}}', coverage_pct) || '% — add tests to reduce risk' || chr(10) ELSE '' END
|| CASE WHEN complexity >= 10 THEN '  = help: cyclomatic complexity is ' || CAST(complexity AS VARCHAR) || ' — consider splitting into smaller functions' || chr(10) ELSE '' END
|| CASE WHEN idiom_penalty > 1 THEN '  = note: idiom penalty ' || format('{{:.2f}}', idiom_penalty) || 'x applied' || chr(10) ELSE '' END
|| CASE WHEN len(checks) > 0 THEN array_to_string(list_transform(checks, lambda c: '  = help: ' || CASE c {" ".join(f"WHEN '{r[0]}' THEN '{r[2]}'" for r in RULES)} END), chr(10)) || chr(10) ELSE '' END
|| CASE WHEN sig_duplicate THEN '  = help: signature duplicate — another function has the same (params)->return type' || chr(10) ELSE '' END
|| CASE WHEN body_duplicate THEN '  = help: body duplicate — another function has the same structure' || chr(10) ELSE '' END AS report_line FROM t""")
def _(s, d):
    return R.diagnostics(R.displayed(records(s, d), 100.0), 100.0).select("ord", "report_line")


@_query("k3_summary", f"WITH {_RECORDS} SELECT count(*) FILTER (risk_score >= 30) AS warnings, count(*) AS functions, CASE WHEN count(*) FILTER (risk_score >= 30) > 0 THEN 'warning: `riskloom` generated ' || CAST(count(*) FILTER (risk_score >= 30) AS VARCHAR) || ' warnings' ELSE 'note: `riskloom` analyzed ' || CAST(count(*) AS VARCHAR) || ' functions, no warnings' END AS summary_line FROM records")
def _(s, d):
    return R.summary(records(s, d))


_LINES = _SQL["k2_diagnostic"].replace("AS report_line FROM t", "AS report_line, risk_score FROM t").replace("100", "1000")


@_query("k1_report", f"""WITH blocks AS ({_LINES}), {_RECORDS}, n AS (SELECT count(*) FILTER (risk_score >= 1000) AS warnings, count(*) AS functions FROM records)
SELECT coalesce((SELECT string_agg(report_line || chr(10), '' ORDER BY risk_score DESC, ord) FROM blocks), '') || CASE WHEN warnings > 0 THEN 'warning: `riskloom` generated ' || CAST(warnings AS VARCHAR) || ' warnings (threshold 1000)' ELSE 'note: `riskloom` analyzed ' || CAST(functions AS VARCHAR) || ' functions, no warnings' END || chr(10) AS report FROM n""")
def _(s, d):
    return s.createDataFrame([(R.report_text(records(s, d), 1000.0),)], "report string")


@_query("k5_exit_code", f"WITH {_RECORDS} SELECT threshold, CAST(coalesce((SELECT bool_or(risk_score > threshold) FROM records), false) AS INT) AS code FROM (VALUES (10.0::double), (300.0::double), (100000.0::double)) t(threshold)")
def _(s, d):
    rows = records(s, d).persist()
    return s.createDataFrame([(t, R.exit_code(rows, t)) for t in (10.0, 300.0, 100000.0)], "threshold double, code int")


def queries() -> dict:
    from . import generated

    return _Q | generated.queries()


def oracle_sql() -> dict[str, str]:
    from . import generated

    return _SQL | generated.oracle_sql()
