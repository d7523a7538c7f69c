"""Scores, joins, coverage, parser and report on hand-made cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.cli import parse
from riskloom.errors import ArgumentError
from riskloom.functions import scores as X
from riskloom.operators import coverage as C
from riskloom.operators import report as R
from riskloom.operators import scoring as J
from riskloom.operators.duplicates import check_duplicates, flag_repeated
from riskloom.rust import parser
from riskloom.rust.lexer import RustSyntaxError
from riskloom.sources.tree import read_sources, walk
from riskloom.storage import keep


@pytest.mark.parametrize("cc,cov,want", [(1, 100, 1), (1, 0, 2), (6, 0, 42), (12, 0, 156), (7, 100, 7)])
def test_crap(spark, cc, cov, want):
    assert spark.range(1).select(X.crap(F.lit(cc), F.lit(float(cov)))).first()[0] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("regions,want", [([(1, 5, 3)], 100), ([(1, 5, 0)], 0), ([(1, 2, 1), (3, 4, 0)], 50), ([], 100), ([(1, 3, 0), (2, 3, 5)], 200 / 3), ([(5, 3, 1)], 100)])
def test_line_coverage(spark, regions, want):
    rows = [[s, 1, e, 1, n, 0, 0, 0] for s, e, n in regions]
    df = spark.createDataFrame([(json.dumps(rows),)], "j string").select(F.from_json("j", "array<array<decimal(20,0)>>").alias("r"))
    assert df.select(C.line_coverage_in_row(F.col("r"))).first()[0] == pytest.approx(want)


def test_coverage_export(spark, tmp_path):
    def fn(file, regions):
        return {"name": "x", "filenames": file, "regions": regions}

    big = 2**64 - 1
    doc = {"data": [{"functions": [fn(["/proj/a.rs"], [[5, 1, 10, 1, big, 0, 0, 0], [12, 1, 20, 1, 0, 0, 0, 2]]), fn(["/proj2/a.rs"], [[1, 1, 2, 1, 1]]), fn([], [[1, 1, 2, 1, 1]]), fn(["/proj/b.rs"], [])]}]}
    p = tmp_path / "cov.json"
    p.write_text(json.dumps(doc))
    assert [tuple(r) for r in C.function_coverage(C.read_export(spark, str(p)), "/proj").collect()] == [("/proj/a.rs", 5, 20, 100.0)]


LISTED = [{"name": 'a"},{"', "filenames": ["/p/}, {.rs"], "regions": [[1, 1, 2, 1, 1]], "branches": [{}, {"a": {}}, {}]}, {}, {"filenames": ["\\"], "regions": []}]


@pytest.mark.parametrize("indent", [None, 2])
def test_documents_are_cut_into_functions(indent):
    from riskloom.sources.export import CUT, functions

    doc = {"type": "x", "data": [{"files": [{"s": {"n": 1}, "t": {}}, {}], "functions": LISTED, "totals": {"a": {}, "b": {}}}, {"functions": []}, {"functions": LISTED[:1]}], "version": "1"}
    text = json.dumps(doc, indent=indent)
    want = [(0, i, fn) for i, fn in enumerate(LISTED)] + [(2, 0, LISTED[0])]
    assert [(d, f, json.loads(t)) for d, f, t in functions(text.split(CUT))] == want
    for end in range(len(text)):  # wherever it is cut off
        with pytest.raises(ValueError):
            list(functions(text[:end].split(CUT)))


def test_documents_are_not_held_whole():
    from riskloom.sources.export import functions

    read = []

    def pieces():
        yield '{"data":[{"files":[{"a":1'
        for i in range(1000):
            read.append(i)
            yield '{"segments":[1]'
        yield '{}],"functions":[{"name":"f"'
        for i in range(1000):
            read.append(i)
            yield '{"name":"f","regions":[]'
        yield '{}]}]}'

    done = [(f, len(read)) for _, f, _ in functions(pieces())]
    assert len(done) == 1002 and all(n - f - 1000 <= 3 for f, n in done)


@pytest.mark.parametrize("text", ["[]", "{}", '{"data":null}', '{"data":[null]}', '{"data":[{}]}', '{"data":[{"functions":null}]}', '{"data":[{"functions":[null]}]}', '{"data":[{"functions":[{"filenames":[]}]}]}', '{"data":[{"functions":[{"filenames":["a"],"regions":[["x"]]}]}]}', '{"data":[]} {}', '{"data":[],}', '{"data":[{"functions":[{"a":},{}]}]}'])
def test_unreadable_export(spark, tmp_path, text):
    from riskloom.errors import JsonError, translated

    (tmp_path / "a,b").mkdir()
    path = tmp_path / "a,b" / "cov.json"
    path.write_text(text)
    with pytest.raises(JsonError), translated():
        C.function_coverage(C.read_export(spark, str(path)), "/proj").collect()


def tables(spark, functions, coverage, idioms):
    return (
        spark.createDataFrame(functions, S.FUNCTIONS),
        spark.createDataFrame(coverage, S.COVERAGE),
        spark.createDataFrame(idioms, S.IDIOMS),
    )


def test_score_joins(spark):
    f, c, i = tables(
        spark,
        [("a.rs", "x", 4, 16, 5, 1), ("a.rs", "x", 30, 40, 3, 2), ("b.rs", "y", 1, 2, 3, 3), ("a.rs", "t", 100, 110, 1, 4)],
        [("a.rs", 5, 15, 80.0), ("a.rs", 5, 15, 90.0), ("a.rs", 96, 103, 10.0), ("a.rs", 107, 120, 20.0)],
        [("a.rs", "x", 1, ["Unwrap"], False, False, "", "", 1), ("a.rs", "x", 4, [], True, False, "", "", 2)],
    )
    got = {r.ord: r for r in J.score(f, c, i).collect()}
    assert (got[1].coverage_pct, got[1].idiom_penalty) == (90.0, 2.0)  # instantiations merge; the last idiom row wins
    assert (got[2].coverage_pct, got[2].idiom_penalty, got[2].crap_score) == (0.0, 1.0, 12.0)  # it is taken once
    assert got[4].coverage_pct == 20.0  # four lines either side: the last in order


def test_duplicates(spark):
    rows = [("a", "f", 5, [], False, False, "s", "b", 1), ("a", "g", 0, [], False, False, "s", "c", 2), ("a", "h", 0, [], False, False, "", "", 3), ("a", "i", 0, [], False, False, "", "", 4)]
    got = {r.qualified_name: r.demerits for r in check_duplicates(spark.createDataFrame(rows, S.IDIOMS)).collect()}
    assert got == {"f": 8, "g": 3, "h": 0, "i": 0}


def test_report(spark):
    f, c, i = tables(spark, [("/p/a.rs", "x", 1, 3, 12, 1), ("/p/a.rs", "y", 5, 6, 1, 2)], [("/p/a.rs", 5, 6, 100.0)], [])
    r = J.score(f, c, i, "/p")
    text = R.report_text(r, 30.0)
    assert text.startswith("warning[high-risk]: `x` has high change-risk score\n --> a.rs:1\n  |\n  = note: RISK = 156.0, CRAP = 156.0, CC = 12, Cov = 0%\n")
    assert text.endswith("generated 1 warnings (threshold 30)\n") and "`y`" not in text
    assert R.report_text(r, None, 0) == "No functions to report.\n"
    assert R.exit_code(r, 156.0) == 0 and R.exit_code(r, 155.0) == 1 and R.exit_code(r) == 0


def test_fixed_ties(spark):
    got = spark.range(1).select(X.fixed(F.lit(6.25), 1), X.fixed(F.lit(0.35), 1), X.fixed(F.lit(2.5), 0), X.fixed(F.lit(1234567.0), 1)).first()
    assert tuple(got) == ("6.2", "0.3", "2", "1234567.0")


@pytest.mark.parametrize("source", ["fn f( {", "fn f() { 'x }", "struct", "fn f() { let x = ; }"])
def test_syntax_errors(source):
    with pytest.raises(RustSyntaxError):
        parser.rows(source, "riskloom")


@pytest.mark.parametrize(
    "source",
    [
        "fn f() { let x: Vec<Vec<u8>> = a::<Vec<u8>>()?; if x < y && (z as u8) < 3 {} }",
        "fn f() { match x { Some(A { b, .. }) if b > 1 => {} 1..=5 | -1 => (), ref y @ Z::Q(_) => y, } }",
        "fn f<'a, T: Fn(u8) -> u8 + 'a>(x: &'a mut [T; 3], mut y: impl A) -> impl Iterator<Item = u8> + 'a where T: Copy { x.iter().map(|&z| z).sum::<u8>() }",
        "fn f() { 'a: loop { break 'a; } let Some(x) = y else { return }; let c = async move { x.await }; r#type.0.1 + 1.0e3_f64 + 0xff_u8 }",
        "impl<T> A for B<T> where T: C { const D: u8 = 1; type E = F; fn g(self: Box<Self>) {} } macro_rules! m { ($x:expr) => { $x } } m!{a} m!(b);",
        "fn f() { let s = r#\"a\"b\"#; let c = '\\u{1F600}'; let b = b'x'; /* a /* b */ c */ let l = S { a, ..T::default() }; match a {} -1; unsafe { g() } .h(); }",
    ],
)
def test_parses(source):
    assert any(r["kind"] == "fn" for r in parser.rows(source, "riskloom"))


def test_source_tree(spark, tmp_path):
    for name in ("a.rs", "_b.rs", ".c.rs", "d e.rs", "x.txt", "target/t.rs", "m/target/u.rs", ".git/v.rs", "_n/.w/y.rs"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("fn f() {}")
    want = sorted(str((tmp_path / n).resolve()) for n in ("a.rs", "_b.rs", ".c.rs", "d e.rs", "_n/.w/y.rs"))
    assert walk(str(tmp_path)) == want
    assert sorted(r.file for r in read_sources(spark, [str(tmp_path), str(tmp_path / "_n")]).collect()) == want


def test_arguments():
    action, o, _ = parse(["--threshold", "30", "--top", "5", "--exclude-fn", "a", "--exclude-fn", "b", "-p", "q"])
    assert (action, o.threshold, o.top, o.exclude_fns, o.package) == ("run", 30.0, 5, ["a", "b"], "q")
    assert parse(["--help"])[0] == "help" and parse(["-V"])[0] == "version" and parse(["--what"])[0] == "help"
    for bad in (["--threshold"], ["--threshold", "x"], ["--top", "-1"]):
        with pytest.raises(ArgumentError):
            parse(bad)


def test_regions_that_claim_to_end_far_off(spark):
    big = 2**32 - 1
    rows = [[1, 1, big, 1, 0, 0, 0, 0], [5, 1, 9, 1, 3, 0, 0, 0]]
    df = spark.createDataFrame([(json.dumps(rows),)], "j string").select(F.from_json("j", "array<array<decimal(20,0)>>").alias("r"))
    assert df.select(C.line_coverage_in_row(F.col("r"))).first()[0] == pytest.approx(5 / big * 100)
    f, c, i = tables(spark, [("a.rs", "x", 4, 16, 5, 1), ("b.rs", "y", 4, 16, 5, 2)], [("a.rs", 1, big, 80.0), ("a.rs", 5, 6, 90.0), ("none.rs", 0, big, 1.0)], [])
    assert {r.ord: r.coverage_pct for r in J.score(f, c, i).collect()} == {1: 80.0, 2: 0.0}


def test_one_key_on_a_third_of_all_rows(spark):
    """Neither the flags nor the consume-once join bring a key's rows to one task."""
    from pyspark.sql import DataFrame

    hot = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k"}
    old = {k: spark.conf.get(k) for k in hot}
    n = 60_000

    def largest(df: DataFrame) -> int:
        return max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("ord")).collect())  # the sum keeps the rows wide

    for k, v in hot.items():
        spark.conf.set(k, v)
    try:
        rows = keep(spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("ord"), F.lit(1).alias("v")).repartition(8), "hot")
        flagged = keep(flag_repeated(rows, "key", "twice"), "flagged")
        assert flagged.filter("twice").count() == n // 3
        assert largest(flag_repeated(rows, "key", "twice").select("ord", "twice")) < n // 6
        taken = J.consume_once(rows.select("key", "ord"), rows, ["key"])
        assert taken.filter("v is not null").count() == 2 * n // 3 + 1
        assert largest(taken) < n // 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def project(tmp_path, source: str, coverage: str):
    src = tmp_path / "src"
    src.mkdir(exist_ok=True)
    (src / "lib.rs").write_text(source)
    (tmp_path / "cov.json").write_text(coverage)
    return str(tmp_path.resolve())


SOURCE = "pub fn answer() -> u8 { 42 }\npub fn sign(n: i64) -> &'static str {\n    if n < 0 {\n        \"minus\"\n    } else if n > 0 {\n        \"plus\"\n    } else {\n        \"\"\n    }\n}\n#[allow(quiet)]\nfn left_out() {}\n"


def exported(root: str) -> str:
    return json.dumps({"data": [{"functions": [{"filenames": [f"{root}/src/lib.rs"], "regions": [[1, 1, 1, 9, 4, 0, 0, 0]]}]}]})


def test_end_to_end(spark, tmp_path):
    from riskloom.api import Options, analyze

    root = str(tmp_path.resolve())
    project(tmp_path, SOURCE, exported(root))
    got = {r.name: (r.file, r.complexity, r.coverage_pct, r.crap_score) for r in analyze(spark, root, [f"{root}/src"], f"{root}/cov.json", Options(allowance="quiet")).collect()}
    assert got == {"answer": ("src/lib.rs", 1, 100.0, 1.0), "sign": ("src/lib.rs", 3, 0.0, 12.0)}


def run(tmp_path, monkeypatch, capsys, *args):
    from riskloom import cli
    from riskloom.sources import collector

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(collector, "metadata", lambda *a, **k: "")
    code = cli.main([*args, "--coverage", str(tmp_path / "cov.json")])
    return code, *capsys.readouterr()


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    root = str(tmp_path.resolve())
    project(tmp_path, SOURCE, exported(root))
    code, out, err = run(tmp_path, monkeypatch, capsys, "riskloom", "--threshold", "5", "--allowance", "quiet", "--label", "SCORE")
    assert code == 1 and out.startswith("warning[low-coverage]: `sign`") and "SCORE = 12.0, CRAP = 12.0, CC = 3, Cov = 0%" in out and out.endswith("generated 1 warnings (threshold 5)\n")
    assert "Read 1 functions with coverage, 2 in the source" in err and "Scored 2 functions in 0m" not in err and "Scored 2 functions in " in err
    assert run(tmp_path, monkeypatch, capsys, "--threshold", "500")[0] == 0 and run(tmp_path, monkeypatch, capsys)[0] == 0


@pytest.mark.parametrize("source,coverage,said", [
    ("fn f( {", None, "unreadable Rust source"),
    ("fn f() {}", "{", "unreadable JSON document"),
    ("fn f() {}", '{"data": [{}]}', "unreadable JSON document"),
    ("fn f() {}", '{"data": 7}', "unreadable JSON document"),
    ("fn f() {}", '{"data": [{"functions": [{"filenames": ["x"]}]}]}', "unreadable JSON document"),
])
def test_input_that_cannot_be_read(spark, tmp_path, monkeypatch, capsys, source, coverage, said):
    root = str(tmp_path.resolve())
    project(tmp_path, source, exported(root) if coverage is None else coverage)
    code, out, err = run(tmp_path, monkeypatch, capsys)
    assert code == 2 and out == "" and [x for x in err.splitlines() if x.startswith("error: ")][0].startswith(f"error: {said}")


def test_bytes_that_are_no_source(spark, tmp_path, monkeypatch, capsys):
    root = str(tmp_path.resolve())
    project(tmp_path, "", exported(root))
    (tmp_path / "src/lib.rs").write_bytes(b"fn f() {} // \xff")
    code, _, err = run(tmp_path, monkeypatch, capsys)
    assert code == 2 and "error: unreadable file" in err


def test_permissive_and_strict(spark):
    from riskloom.operators import static

    sources = spark.createDataFrame([("a.rs", "fn f( {"), ("b.rs", "impl A { fn f() { x.unwrap(); } } mod m { impl A { fn f() { } } }"), ("c.rs", None)], "file string, content string")
    nodes = static.ast_nodes(sources, permissive=True).persist()
    assert [r.file for r in nodes.filter("parse_error is not null").collect()] == ["a.rs"]
    f, i = static.complexity(nodes), check_duplicates(static.idioms(nodes))
    c = spark.createDataFrame([], S.COVERAGE)
    loose, strict = (sorted(len(r.checks) for r in J.score(f.withColumn("start_line", F.monotonically_increasing_id()), c, i.withColumn("start_line", F.monotonically_increasing_id()), strict_identity=x).collect()) for x in (False, True))
    assert loose == [0, 0] and strict == [0, 1]


def test_collector_parts(tmp_path):
    from riskloom.errors import ToolNotFound
    from riskloom.sources import collector, project as P

    assert collector.host_triple("rustc 1\nhost: a-b\n") == "a-b" and collector.host_triple("rustc") is None
    assert collector.feature_args("p", ["a", "b"], True, True) == ["--package", "p", "--features", "a", "--features", "b", "--all-features", "--no-default-features"]
    assert collector.feature_args() == []
    with pytest.raises(ToolNotFound):
        collector.resolve_tools("/x", "nothing")
    tools = tmp_path / "lib/rustlib/h/bin"
    tools.mkdir(parents=True)
    (tools / "llvm-profdata").touch()
    with pytest.raises(ToolNotFound, match="llvm-cov"):
        collector.resolve_tools(f"{tmp_path}\n", "host: h")
    (tools / "llvm-cov").touch()
    assert [p.name for p in collector.resolve_tools(f"{tmp_path}\n", "host: h")] == ["llvm-profdata", "llvm-cov"]

    at = tmp_path / "profiles"
    collector.clean_profiles(at)
    for name in ("b.profraw", "a.profraw", "m.profdata", "keep.txt"):
        (at / name).touch()
    assert [p.name for p in collector.profiles(at)] == ["a.profraw", "b.profraw"]
    collector.clean_artifacts(at)
    assert [p.name for p in at.iterdir()] == ["keep.txt"]
    (at / "keep.txt").unlink()
    collector.clean_artifacts(at)
    assert not at.exists()

    inner = tmp_path / "work" / "crate"
    inner.mkdir(parents=True)
    assert P.detect_package(str(inner)) is None and not P.is_workspace_member(str(inner))
    (inner / "Cargo.toml").write_text('[dependencies]\nname = "no"\n[package]\nversion = "1"\nname = "yes"\n')
    (inner.parent / "Cargo.toml").write_text("[workspace]\n")
    assert P.detect_package(str(inner)) == "yes" and P.is_workspace_member(str(inner))


def test_terminal_codes(spark):
    from riskloom.cli import bold

    assert spark.range(1).select(bold(True)("warning", F.lit("x")), bold(False)("warning", F.lit("x"))).first()[:] == ("\x1b[1;33mx\x1b[0m", "x")


def test_scores_that_follow_a_folder(spark, tmp_path):
    from riskloom.streaming import follow_coverage

    f, c, i = tables(spark, [("a.rs", "x", 4, 16, 5, 1)], [("a.rs", 5, 15, 80.0)], [])
    at, seen = str(tmp_path / "rows"), []
    c.coalesce(1).write.parquet(at)
    writer = follow_coverage(spark, at, f, i, lambda df, batch: seen.append([r.coverage_pct for r in df.collect()]))
    query = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    query.awaitTermination(120)
    assert seen == [[80.0]]


def test_scratch_folder(spark):
    from riskloom import storage

    kept = storage.keep(spark.range(5).toDF("id"), "gone")
    assert kept.count() == 5
    storage.drop(kept)
    assert not os.path.exists(kept._riskloom_path.removeprefix("file://"))
    assert storage.scratch_dir(spark) == storage.scratch_dir(spark)
