"""Queries over generated source, on small tables made to hold rare cases."""

from riskloom.plans import generated as G


def tables(spark, at, orders, items):
    """*orders*: (customer, order); *items*: (order, line, statement)."""
    spark.createDataFrame(orders, "o_custkey bigint, o_orderkey bigint").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_files_of_one_statement(spark, tmp_path):
    n = len(G.STATEMENTS)
    orders = [(i, 12 * i) for i in range(n)] + [(n, 12 * n)]  # the last without statements
    at = tables(spark, tmp_path, orders, [(12 * i, 1, i) for i in range(n)])
    got = sorted(tuple(r) for r in G.queries()["f16_literals_casts_and_calls"](spark, at).collect())
    assert got == sorted((f"/gen/{i}.rs", 2 * (i == 4), int(i == 11), int(i == 8)) for i in range(n))


def test_each_file_is_parsed_once(spark, tmp_path):
    from riskloom.operators import static

    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    text = "struct S; fn f(x: &S) -> Box<dyn Error> { x.unwrap(); if a { drop(v); } }"
    sources = spark.createDataFrame([(f"{i}.rs", text) for i in range(10)], "file string, content string").mapInArrow(count, "file string, content string")
    nodes = static.ast_nodes(sources)
    for relation in (static.findings, static.fingerprints, static.idioms, static.complexity, static.method_like, static.literal_matches):
        before = counted.value
        relation(nodes).write.format("noop").mode("overwrite").save()
        assert counted.value - before == 10, relation.__name__
    assert static.idioms(nodes).first().checks == ["FreeMethodCandidate", "BoxDynError", "Unwrap", "ExplicitDrop"]


def test_shared_statements():
    """Equal statements on other lines, in closures and with other tokens behind them."""
    from riskloom.rust.parser import rows

    one = "if a { b(); }"
    source = f"fn f() {{ {one} {one}\n{one} else {{ drop(v); }}\n{one}.x();\nlet g = || {{ {one} }}; {one}\n}}"
    whole, brief = rows(source, "x"), rows(source, "x", ("fn",))
    assert [r["line"] for r in whole if r["kind"] == "if"] == [1, 1, 2, 3, 4, 4]
    assert whole[0] == brief[0] and len(brief) == 1
    assert brief[0]["branches"] == 5 and brief[0]["checks"] == ["ExplicitDrop"]
    assert brief[0]["tokens"] == "if call if call if call call method if call let closure if call"


def test_equal_signatures_are_parsed_once(monkeypatch):
    from riskloom.rust import parser

    met = []
    real = parser.Parser.type_
    monkeypatch.setattr(parser.Parser, "type_", lambda self, plus=True: met.append(1) or real(self, plus))
    source = "\n".join(f"impl T{i} {{ fn f{i}(&self, once: [u8; 3], s: Vec<Self>) -> Once<Self> {{\n}} }}" for i in range(50))
    got = [r for r in parser.rows(source, "x") if r["kind"] == "fn"]
    assert [r["sig_fp"] for r in got] == [f"(&T{i},_,Vec<T{i}>)->Once<T{i}>" for i in range(50)]
    assert [r["line"] for r in got] == list(range(1, 101, 2))
    literals = [(r["line"], r["owners"]) for r in parser.rows(source, "x") if r["kind"] == "literal"]
    assert literals == [(r["line"], [r["pre"]]) for r in got]
    assert len(met) < 150  # a type of each impl, twice, and those of one signature


def test_statements_by_their_text():
    """Pieces of lines as tokens of other layouts: at other places, before other tokens, behind dots and comments."""
    from riskloom.rust.parser import rows

    def said(source):
        return [{k: v for k, v in r.items() if "line" not in k} for r in rows(source, "x")]

    body = "if a { b(); } v.unwrap(); match x { 1 => { } 2 | 3 => { } _ => { } } if a { b(); } else { drop(v); } a.0 .0; x. 0;"
    one = f"struct S; fn f(x: &S) {{\n{body}\n{body} // if\nlet q = a//\n= b;\n}}\nfn g() {{ {body} }}"
    spread = one.replace("a//\n= b", "a = b").replace("// if", "").replace("; ", ";\n").replace("} ", "}\n").replace("{ ", "{\n")
    assert said(one) == said(one) == said(spread)


def test_only_read_functions_are_summed_up(monkeypatch):
    from riskloom.rust import parser

    met = []
    real = parser.Summary.extend
    monkeypatch.setattr(parser.Summary, "extend", lambda self, more, at: met.append(1) or real(self, more, at))
    source = "fn f() {\nlet only = a; let only = a; match x { 1 => { } 2 => { } }\n}"
    parser.rows(source, "x")
    met.clear()
    (match,) = parser.rows(source, "x", ("match",))
    assert match["lit_match"] and match["owners"] == [0] and not met
    assert not [r for r in parser.rows(source, "x", ("struct",))] and not met
    assert parser.rows(source, "x", ("fn",))[0]["tokens"] == "let let match arm arm" and met


def test_exports_are_many_documents(spark, tmp_path, monkeypatch):
    from pathlib import Path

    events = [(i, i % 40) for i in range(400)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint").selectExpr("*", "timestamp_seconds(event_id * 60) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(G, "REGIONS", 10)
    made = []
    monkeypatch.setattr(G, "scratch_path", lambda s, name: made.append(tmp_path / name) or str(made[-1]))
    got = {r.file: len(r.regions) for r in G.export(spark, str(tmp_path)).selectExpr("filenames[0] AS file", "regions").collect()}
    assert sum(got.values()) == 400 and len(got) == 40
    documents = list(Path(made[0]).glob("*.txt"))
    assert len(documents) > 8 and max(d.stat().st_size for d in documents) < 400 * 20
