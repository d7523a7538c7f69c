"""Queries over Rust source, coverage exports and build messages that are made
from the bundled tables, and the same results in SQL from the tables alone.

A file is a customer, its items are the customer's orders in the order of their
keys, three lines each behind a first line of comment; the statements of a body
are the order's items.  What every statement and item means is stated once, in
``STATEMENTS``, ``HEADS`` and ``PARAMETERS``: the generator writes the source
from them, and the SQL says what the analysis has to find.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..api import analyze_static
from ..functions import scores as X
from ..operators import coverage as C
from ..operators import report as R
from ..operators import static
from ..operators.scoring import score
from ..schemas import RULES
from ..sources.project import target_dirs, test_binaries
from ..sources.tree import read_sources
from ..storage import scratch_path


class Statement(NamedTuple):
    text: str
    branches: int
    tokens: str
    rule: str | None = None


STATEMENTS = (
    Statement("if a { b(); }", 1, "if call"),
    Statement("while a { }", 1, "while"),
    Statement("for i in c { }", 1, "for"),
    Statement("loop { break; }", 1, "loop"),
    Statement("match x { 1 => { } 2 | 3 => { } _ => { } }", 3, "match arm arm arm", "MatchOnLiteral"),
    Statement("let v = r?;", 1, "let ?"),
    Statement("let w = a && b || c;", 2, "let binop binop"),
    Statement("v.unwrap();", 0, "method", "Unwrap"),
    Statement("drop(v);", 0, "call", "ExplicitDrop"),
    Statement("let f = || if a { 1 } else { 2 };", 0, "let closure"),
    Statement("let e = vec![];", 0, "let", "EmptyVecMacro"),
    Statement("let q = a as u8 > b;", 0, "let binop", "PrimitiveCastInComparison"),
    Statement("let z: Vec<u8> = Vec::from_iter(r);", 0, "let call", "FromIterInsteadOfCollect"),
)


class Head(NamedTuple):
    """``{k}`` is the order's key, ``{p}`` its parameter."""

    opens: str
    closes: str = ""
    emitted: bool = True
    name: str = "f{k}"
    context: str | None = None
    receiver: str = ""
    returns: str = "()"
    free: bool = True
    struct: str | None = None  # at the top of the file
    rules: tuple = ()
    functions: int = 1
    has_p: bool = True


_BOXED = "Result<u8, Box<dyn Error + Send>>"
HEADS = (
    Head("fn f{k}({p}) {{"),
    Head("#[test] fn f{k}() {{", emitted=False),
    Head("#[allow(dead_code, riskloom)] fn f{k}() {{", emitted=False),
    Head("#[cfg(test)] mod m{k} {{ fn f{k}() {{", " }", emitted=False),
    Head("impl T{k} {{ fn f{k}(&self, {p}) {{", " }", context="T{k}", receiver="&T{k}", free=False),
    Head("impl fmt::Display for T{k}<u8> {{ fn f{k}(&mut self, {p}) {{", " }", context="<T{k} as Display>", receiver="&mut <T{k} as Display>", free=False),
    Head("trait D{k} {{ fn f{k}(&self, {p}) {{", " fn g{k}(&self); }", context="D{k}", receiver="&D{k}", free=False, functions=2),
    Head("#[tokio::test] async fn f{k}({p}) {{"),
    Head(f"struct S{{k}}; fn f{{k}}(x: &S{{k}}, {{p}}) -> {_BOXED} {{{{", receiver="&S{k}", returns="Result<u8,Box<_>>", struct="S{k}", rules=("FreeMethodCandidate", "BoxDynError")),
    Head("#[cfg(all(test, unix))] mod m{k} {{ struct S{k}; fn f{k}(x: &mut S{k}) {{", " }", receiver="&mut S{k}", has_p=False),
    Head("#[test] fn f{k}() {{ fn g{k}() {{", " }", emitted=False, functions=2),
    Head("trait D{k} {{ #[test] fn f{k}(&self) {{ fn g{k}({p}) {{", " } }", name="g{k}", context="D{k}", functions=2),
)
#: Source of a parameter, and what a signature's fingerprint says of it; ``Self`` is the context, if there is one.
PARAMETERS = (("", ""), ("p: u8", "u8"), ("p: &mut [u8]", "&mut [u8]"), ("p: (u8, Vec<Self>)", "(u8,Vec<Self>)"), ("p: impl Copy", "impl_"), ("p: [u8; 3]", "_"))


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sources(s, d, broken: int = 0) -> DataFrame:
    """file, content: a file a customer; every *broken*-th one has no end."""
    item = (F.col("l_partkey") % len(STATEMENTS)).cast("int")
    li = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", item.alias("item")).alias("at"))
    text = F.array(*[F.lit(x.text) for x in STATEMENTS])
    bodies = li.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda x: F.element_at(text, x["item"] + 1)), " ").alias("body"))
    o = _t(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k")).join(bodies, "k", "left")
    k, p = F.col("k").cast("string"), _pick(F.floor(F.col("k") / len(HEADS)) % len(PARAMETERS), [x[0] for x in PARAMETERS])
    opens = _pick(F.col("k") % len(HEADS), [h.opens.replace("{{", "{") for h in HEADS])
    opens = F.replace(F.replace(opens, F.lit("{k}"), k), F.lit("{p}"), p)
    closes = F.replace(_pick(F.col("k") % len(HEADS), [h.closes for h in HEADS]), F.lit("{k}"), k)
    o = o.withColumn("text", F.concat(opens, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n}"), closes))
    files = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("items"))
    end = F.when(F.col("o_custkey") % broken == 0, "\nfn open( {").otherwise("\n") if broken else F.lit("\n")
    made = files.select(F.concat(F.lit("/gen/"), F.col("o_custkey").cast("string"), F.lit(".rs")).alias("file"), F.concat(F.lit("// made\n"), F.col("items"), end).alias("content"))
    # Source is small and slow to parse: by their bytes alone, few tasks would seem enough for all of it.
    return made.repartition(int(s.conf.get("spark.sql.shuffle.partitions")))


def nodes(s, d, *kinds: str) -> DataFrame:
    return static.ast_nodes(sources(s, d), kinds=kinds or static.FUNCTIONS)


# The same in SQL.
def _case(index: str, values, quote: bool = True) -> str:
    def said(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if quote else str(v)

    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values)) + " END"


def _named(values) -> str:
    return f"replace({_case('head', values)}, '{{k}}', CAST(k AS VARCHAR))"


def _list(values) -> str:
    return "CASE head " + " ".join(f"WHEN {i} THEN [{', '.join(repr(r) for r in v)}]" for i, v in enumerate(values) if v) + " ELSE CAST([] AS VARCHAR[]) END"


_WEIGHT = " ".join(f"WHEN '{r[0]}' THEN {r[1]}" for r in RULES)
_ITEMS = f"""placed AS (SELECT '/gen/' || CAST(o_custkey AS VARCHAR) || '.rs' AS file, o_orderkey AS k, CAST(o_orderkey % {len(HEADS)} AS INT) AS head, CAST(o_orderkey // {len(HEADS)} % {len(PARAMETERS)} AS INT) AS param,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 3 - 1 AS start_line FROM orders),
said AS (SELECT l_orderkey, l_linenumber, l_partkey % {len(STATEMENTS)} AS item FROM lineitem),
bodies AS (SELECT l_orderkey, CAST(sum({_case("item", [x.branches for x in STATEMENTS], False)}) AS BIGINT) AS branches, string_agg({_case("item", [x.tokens for x in STATEMENTS])}, ' ' ORDER BY l_linenumber, item) AS tokens,
  list({_case("item", [x.rule for x in STATEMENTS])} ORDER BY l_linenumber, item) AS found, count(*) FILTER (item = 4) AS matches FROM said GROUP BY l_orderkey),
items AS (SELECT placed.*, coalesce(branches, 0) AS branches, coalesce(tokens, '') AS tokens, coalesce(matches, 0) AS matches, list_filter(coalesce(found, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL) AS found,
  {_case("head", [int(h.emitted) for h in HEADS], False)} = 1 AS emitted, {_case("head", [h.functions for h in HEADS], False)} AS functions, {_named([h.context for h in HEADS])} AS context,
  {_named([h.name for h in HEADS])} AS name, {_case("head", [int(h.free) for h in HEADS], False)} = 1 AS is_free, {_named([h.struct for h in HEADS])} AS struct, {_named([h.receiver or None for h in HEADS])} AS receiver,
  {_case("head", [h.returns for h in HEADS])} AS returns, CASE WHEN {_case("head", [int(h.has_p) for h in HEADS], False)} = 1 THEN {_case("param", [x[1] or None for x in PARAMETERS])} END AS p, {_list([h.rules for h in HEADS])} AS head_rules
  FROM placed LEFT JOIN bodies ON l_orderkey = k),
fns AS (SELECT *, concat_ws('::', context, name) AS qualified_name, start_line + 2 AS end_line, 1 + branches AS complexity, list_concat(head_rules, found) AS checks, sha256(tokens) AS body_fp,
  '(' || concat_ws(',', receiver, replace(p, 'Self', coalesce(context, 'Self'))) || ')->' || returns AS sig_fp FROM items WHERE emitted),
flagged AS (SELECT *, count(*) OVER (PARTITION BY sig_fp) >= 2 AS sig_duplicate, count(*) OVER (PARTITION BY body_fp) >= 2 AS body_duplicate,
  CAST(coalesce(list_sum(list_transform(checks, lambda c: CASE c {_WEIGHT} END)), 0) AS BIGINT) AS weight FROM fns)"""

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def register(f):
        _Q[name], _SQL[name] = f, sql
        return f

    return register


def _over(select: str) -> str:
    return f"WITH {_ITEMS} {select}"


@_query("s2_parsed_nodes", _over("SELECT file, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(3 * matches) AS BIGINT) AS arms FROM items GROUP BY file"))
def _(s, d):
    return nodes(s, d, "fn", "arm").groupBy("file").agg(F.count_if(F.col("kind") == "fn").alias("functions"), F.count_if(F.col("kind") == "arm").alias("arms"))


@_query("s2_permissive", "SELECT DISTINCT '/gen/' || CAST(o_custkey AS VARCHAR) || '.rs' AS file, o_custkey % 7 = 0 AS broken FROM orders")
def _(s, d):
    found = static.ast_nodes(sources(s, d, broken=7), permissive=True, kinds=static.FUNCTIONS)
    return found.groupBy("file").agg(F.bool_or(F.col("parse_error").isNotNull()).alias("broken"))


@_query("g3_p1_p6_function_discovery", _over("SELECT file, qualified_name, is_free FROM fns"))
def _(s, d):
    return static.function_rows(nodes(s, d)).select("file", "qualified_name", "is_free")


@_query("p17_p19_names_and_spans", _over("SELECT file, qualified_name, start_line, end_line FROM fns"))
def _(s, d):
    return static.function_rows(nodes(s, d)).select("file", "qualified_name", "start_line", "end_line")


@_query("a1_cyclomatic_complexity", _over("SELECT file, qualified_name, complexity FROM fns"))
def _(s, d):
    return static.complexity(nodes(s, d)).select("file", "qualified_name", "complexity")


@_query("a10_literal_arms", _over("SELECT file, CAST(sum(matches) AS BIGINT) AS matches FROM items GROUP BY file HAVING sum(matches) > 0"))
def _(s, d):
    return static.literal_matches(nodes(s, d, "match")).groupBy("file").agg(F.count("*").alias("matches"))


@_query("a11_distinct", _over("SELECT file, struct AS name FROM items WHERE struct IS NOT NULL"))
def _(s, d):
    return static.struct_names(nodes(s, d, "struct")).select("file", F.col("ref_type_name").alias("name"))


@_query("j3_struct_semi_join", _over("SELECT file, qualified_name FROM fns WHERE struct IS NOT NULL"))
def _(s, d):
    return static.method_like(nodes(s, d)).select("file", "qualified_name")


@_query("g4_idiom_findings", _over("SELECT file, qualified_name, array_to_string(checks, ',') AS checks FROM fns WHERE len(checks) > 0"))
def _(s, d):
    rows = static.idioms(nodes(s, d)).filter(F.size("checks") > 0)
    return rows.select("file", "qualified_name", F.array_join("checks", ",").alias("checks"))


@_query("g5_demerits_of_files", _over("SELECT file, CAST(sum(weight) AS BIGINT) AS demerits, count(*) AS functions FROM flagged GROUP BY file"))
def _(s, d):
    return static.idioms(nodes(s, d)).groupBy("file").agg(F.sum("demerits").alias("demerits"), F.count("*").alias("functions"))


@_query("u2_bag_union", _over("SELECT file, rule, count(*) AS n FROM (SELECT file, unnest(checks) AS rule FROM fns) GROUP BY file, rule"))
def _(s, d):
    return static.findings(nodes(s, d)).groupBy("file", "rule").agg(F.count("*").alias("n"))


@_query("a12_body_fingerprint", _over("SELECT file, qualified_name, body_fp AS body_fingerprint FROM fns"))
def _(s, d):
    return static.fingerprints(nodes(s, d)).select("file", "qualified_name", "body_fingerprint")


@_query("f12_f14_signature_fingerprints", _over("SELECT file, qualified_name, sig_fp FROM fns"))
def _(s, d):
    return static.function_rows(nodes(s, d)).select("file", "qualified_name", "sig_fp")


@_query("f15_type_predicates", _over("SELECT file, qualified_name, CASE WHEN head IN (8, 9) THEN 'S' || CAST(k AS VARCHAR) END AS ref_type_name, head = 8 AS boxed FROM fns"))
def _(s, d):
    return static.function_rows(nodes(s, d)).select("file", "qualified_name", "ref_type_name", F.col("ret_box_dyn_error").alias("boxed"))


@_query("f16_literals_casts_and_calls", _over("SELECT file, count(*) FILTER (item = 4) * 2 AS literals, count(*) FILTER (item = 11) AS casts, count(*) FILTER (item = 8) AS drops FROM placed JOIN said ON l_orderkey = k GROUP BY file"))
def _(s, d):
    c = F.col
    # Functions belong to it, so that a file without any of the others has its zeros.
    rows = nodes(s, d, "fn", "arm", "binary", "call", "let").groupBy("file")
    rows = rows.agg(F.count_if("lit_pattern").alias("literals"), F.count_if((c("kind") == "binary") & c("casts")).alias("casts"), F.count_if((c("kind") == "call") & (c("name") == "drop")).alias("drops"))
    return rows.join(_files_with_statements(s, d), "file", "left_semi")


def _files_with_statements(s, d) -> DataFrame:
    o = _t(s, d, "orders").join(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return o.select(F.concat(F.lit("/gen/"), F.col("o_custkey").cast("string"), F.lit(".rs")).alias("file")).distinct()


@_query("s17_analyze_static", _over("SELECT file, qualified_name, start_line, complexity, weight + 3 * CAST(sig_duplicate AS INT) + 3 * CAST(body_duplicate AS INT) AS demerits, sig_duplicate, body_duplicate FROM flagged"))
def _(s, d):
    functions, idioms = analyze_static(sources(s, d))
    return functions.join(idioms.select("ord", "demerits", "sig_duplicate", "body_duplicate"), "ord").select("file", "qualified_name", "start_line", "complexity", "demerits", "sig_duplicate", "body_duplicate")


@_query("s17_risk_of_sources", _over("""SELECT file, qualified_name AS name, complexity, (CAST(complexity AS DOUBLE) * CAST(complexity AS DOUBLE) + CAST(complexity AS DOUBLE)) * (1.0::double + 0.25::double * CAST(weight + 3 * CAST(sig_duplicate AS INT) + 3 * CAST(body_duplicate AS INT) AS DOUBLE)) AS risk_score FROM flagged"""))
def _(s, d):
    functions, idioms = analyze_static(sources(s, d))
    return score(functions, s.createDataFrame([], S.COVERAGE), idioms).select("file", "name", "complexity", "risk_score")


# Files: a small tree a region, with names that a scan has to keep or pass over.
_NAMES = ("a{n}.rs", "_b{n}.rs", ".c{n}.rs", "d {n}.rs", "x{n}.txt", "target/t{n}.rs", "m/target/u{n}.rs", ".git/v{n}.rs", "_n/.w/y{n}.rs", "deep/er/z{n}.rs", "no_end{n}")
_KEPT = (0, 1, 2, 3, 8, 9)


@_query("s1_source_scan", f"""WITH f AS (SELECT n_regionkey, n_nationkey, n_name, range AS i FROM nation, range({len(_NAMES)}))
SELECT CAST(n_regionkey AS VARCHAR) || '/' || replace({_case("i", _NAMES)}, '{{n}}', CAST(n_nationkey AS VARCHAR)) AS file, 'fn f() {{ }} // ' || n_name AS content FROM f WHERE i IN {_KEPT}""")
def _(s, d):
    import os
    from pathlib import Path

    root = Path(scratch_path(s, "tree").removeprefix("file://"))
    for r in _t(s, d, "nation").collect():  # 25 rows
        for name in _NAMES:
            at = root / str(r.n_regionkey) / name.format(n=r.n_nationkey)
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(f"fn f() {{ }} // {r.n_name}", encoding="utf-8")
    roots = [str(p) for p in sorted(root.iterdir())]
    found = read_sources(s, [*roots, str(root / "0" / "_n")])  # one of them twice
    return found.select(F.substring("file", len(os.path.realpath(root)) + 2, 1000).alias("file"), "content")


_REGION = """r AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(minute(ts) AS BIGINT) AS s, CAST(minute(ts) AS BIGINT) + event_id % 9 - 1 AS e, event_id % 3 AS hits, event_id % 4 = 1 AS skipped FROM events),
l AS (SELECT user_id, day, hits, unnest(generate_series(s, e)) AS line FROM r WHERE s <= e AND NOT skipped), per AS (SELECT user_id, day, line, max(hits) AS hits FROM l GROUP BY ALL),
pct AS (SELECT user_id, day, sum(CASE WHEN hits > 0 THEN 1.0::double ELSE 0.0::double END) / count(*) * 100.0::double AS p FROM per GROUP BY ALL), spans AS (SELECT user_id, day, min(s) AS s, max(e) AS e FROM r GROUP BY ALL)"""


#: Regions of a document, about.
REGIONS = 50_000


def export(s, d) -> DataFrame:
    """The regions of users' days as coverage exports, eight documents or more, as they are read back."""
    n = F.minute("ts").cast("bigint")
    kind = F.when(F.col("event_id") % 4 == 1, 2).otherwise(0)
    region = F.array(*[c.cast("bigint") for c in (n, F.lit(1), n + F.col("event_id") % 9 - 1, F.lit(1), F.col("event_id") % 3, F.lit(0), F.lit(0), kind)])
    root = F.when(F.col("user_id") % 5 == 0, "/proj2/").otherwise("/proj/")
    file = F.concat(root, F.col("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string"))
    events = _t(s, d, "events")
    # A task writes a document, a function at a time.
    rows = events.select("event_id", "ts", "user_id", file.alias("file")).repartition(max(8, -(-events.count() // REGIONS)), "user_id", "file")
    fn = rows.groupBy("user_id", "file").agg(F.collect_list(region).alias("regions"))
    fn = fn.select(F.to_json(F.struct(F.lit("f").alias("name"), F.array("file", F.lit("/other")).alias("filenames"), "regions")).alias("value"))

    def document(batches):
        import pyarrow as pa

        before = '{"data":[{"functions":['
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_pydict({"value": [before + texts[0], *("," + t for t in texts[1:])]})
                before = ","
        yield pa.RecordBatch.from_pydict({"value": [(before if before != "," else "") + ']}],"version":"1"}']})

    at = scratch_path(s, "export")
    fn.mapInArrow(document, "value string").write.text(at)
    return C.read_export(s, f"{at}/*.txt")


@_query("s7_g2_coverage_export", f"""WITH {_REGION} SELECT CASE WHEN user_id % 5 = 0 THEN '/proj2/' ELSE '/proj/' END || CAST(user_id AS VARCHAR) || '/' || CAST(day AS VARCHAR) AS file, count(*) AS regions FROM r GROUP BY ALL""")
def _(s, d):
    return export(s, d).select(F.get("filenames", 0).alias("file"), F.size("regions").cast("bigint").alias("regions"))


@_query("s7_s8_function_coverage", f"""WITH {_REGION} SELECT '/proj/' || CAST(user_id AS VARCHAR) || '/' || CAST(day AS VARCHAR) AS file, s AS start_line, e AS end_line, coalesce(p, 100.0::double) AS line_coverage_pct FROM spans LEFT JOIN pct USING (user_id, day) WHERE user_id % 5 <> 0 AND e >= 0""")
def _(s, d):
    return C.function_coverage(export(s, d), "/proj").filter("end_line >= 0")


# Project metadata and build messages, by suppliers and parts.
_KINDS = (["lib"], ["bin"], ["test"], ["bin", "test"], ["custom-build"])


def metadata(s, d) -> DataFrame:
    kind = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in _KINDS]), (F.col("s_suppkey") % len(_KINDS) + 1).cast("int"))
    path = F.concat(F.lit("/p/"), (F.col("s_suppkey") % 37).cast("string"), F.lit("/src/"), F.col("s_suppkey").cast("string"), F.lit(".rs"))
    rows = _t(s, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(kind.alias("kind"), path.alias("src_path"))).alias("targets"))
    text = rows.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"), "targets")).alias("packages"))).alias("v"))
    return text.select(F.from_json("v", S.METADATA).alias("m")).select("m.*")


@_query("s5_p8_source_dirs", f"SELECT DISTINCT '/p/' || CAST(s_suppkey % 37 AS VARCHAR) || '/src' AS dir FROM supplier WHERE s_suppkey % {len(_KINDS)} IN (0, 1, 3)")
def _(s, d):
    return target_dirs(metadata(s, d))


@_query("p7_package", f"SELECT DISTINCT '/p/' || CAST(s_suppkey % 37 AS VARCHAR) || '/src' AS dir FROM supplier WHERE s_suppkey % {len(_KINDS)} IN (0, 1, 3) AND s_nationkey = 7")
def _(s, d):
    return target_dirs(metadata(s, d), "n7")


@_query("s6_test_binaries", "SELECT '/t/' || CAST(p_partkey AS VARCHAR) AS executable FROM part WHERE p_partkey % 5 = 0 AND p_size % 2 = 0")
def _(s, d):
    p, k = _t(s, d, "part"), F.col("p_partkey")
    path = F.concat(F.lit("/t/"), k.cast("string"))
    test = F.to_json(F.struct(F.lit("compiler-artifact").alias("reason"), path.alias("executable"), F.struct((F.col("p_size") % 2 == 0).alias("test")).alias("profile")))
    none = F.to_json(F.struct(F.lit("compiler-artifact").alias("reason"), F.struct(F.lit(True).alias("test")).alias("profile")))
    other = F.to_json(F.struct(F.lit("build-finished").alias("reason"), path.alias("executable"), F.struct(F.lit(True).alias("test")).alias("profile")))
    line = F.when(k % 5 == 0, test).when(k % 5 == 1, none).when(k % 5 == 2, other).when(k % 5 == 3, F.concat(F.lit("warning: "), test)).otherwise(F.concat(F.lit("{broken "), test))
    return test_binaries(p.select(line.alias("value")))


@_query("s13_compiler_host", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'h' || CAST(p_size AS VARCHAR) || '-linux' END AS host FROM part")
def _(s, d):
    host = F.concat(F.lit("h"), F.col("p_size").cast("string"), F.lit("-linux"))
    text = F.concat(F.lit("rustc 1\nbinary: rustc\n"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" host: "), host)).otherwise(F.concat(F.lit("host: "), host)), F.lit("\nrelease: 1"))
    return _t(s, d, "part").select("p_partkey", X.rustc_host(text).alias("host"))


@_query("k4_progress_counts", _over("SELECT count(*) AS functions, count(*) FILTER (NOT contains(file, '7')) AS shown, (SELECT count(DISTINCT (user_id, CAST(ts AS DATE))) FROM events WHERE user_id % 5 <> 0) AS covered FROM fns"))
def _(s, d):
    functions, idioms = analyze_static(sources(s, d))
    covered = C.function_coverage(export(s, d), "/proj")
    return R.row_counts(functions=functions, covered=covered, shown=R.exclude(score(functions, covered, idioms), ["7"]))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
