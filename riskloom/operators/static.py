"""Static analysis: source text to syntax nodes once, then plain relations.

A function's row sums up the nodes that it owns while its file is walked, since
branches, findings and tokens of a function never leave its file: functions,
complexity, idiom findings and fingerprints are filters and columns of one table
of nodes, without a join.  Only parsing runs Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BAD_SOURCE
from ..functions import scores as X
from ..session import ship

NODES = (
    "file string, pre bigint, parent bigint, kind string, name string, op string, line bigint, end_line bigint, owners array<bigint>, context string,"
    " emitted boolean, is_free boolean, sig_fp string, ref_type_name string, ret_box_dyn_error boolean, on_struct boolean, branches bigint, tokens string, checks array<string>,"
    " at_top boolean, lit_match boolean, lit_pattern boolean, casts boolean, macro_empty boolean, parse_error string"
)
#: The lint whose allowance takes a function out of the analysis, unless the caller names another.
ALLOWANCE = "riskloom"
#: The only nodes that most relations read.
FUNCTIONS = ("fn",)
#: Rows of a batch that goes to Spark, at most but for one file's.
BATCH = 2_000


def ast_nodes(sources: DataFrame, permissive: bool = False, allowance: str = ALLOWANCE, kinds=None) -> DataFrame:
    """Syntax nodes of (file, content) rows: all, or those of *kinds*.  A file
    that cannot be parsed is an error, or with *permissive* one row with
    parse_error.  Functions that allow the lint *allowance* are left out of the
    analysis."""
    ship(sources.sparkSession)

    def run(batches):
        from riskloom.rust.lexer import RustSyntaxError
        from riskloom.rust.parser import rows

        types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(n, types[k]) for n, k in map(str.split, NODES.split(","))])
        for batch in batches:
            got = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for r in rows(content or "", allowance, kinds):
                        r["file"] = file
                        got.append(r)
                except RustSyntaxError as e:
                    if not permissive:
                        raise RuntimeError(f"{BAD_SOURCE} {file}: {e}") from None
                    got.append({"file": file, "pre": -1, "kind": "error", "owners": [], "parse_error": str(e)})
                for i in range(0, len(got) - BATCH + 1, BATCH):
                    yield pa.RecordBatch.from_pylist(got[i : i + BATCH], schema)
                got = got[len(got) // BATCH * BATCH :] if len(got) >= BATCH else got
            if got:
                yield pa.RecordBatch.from_pylist(got, schema)

    return sources.select("file", "content").mapInArrow(run, NODES)


def _qualified() -> Column:
    return F.concat_ws("::", "context", "name")


def function_rows(nodes: DataFrame) -> DataFrame:
    """Emitted functions: file, fn (pre-order id), qualified_name, lines, ord."""
    return nodes.filter((F.col("kind") == "fn") & F.col("emitted")).select(
        "file", F.col("pre").alias("fn"), _qualified().alias("qualified_name"), F.col("line").alias("start_line"), F.greatest("line", "end_line").alias("end_line"), "is_free", "sig_fp", "ref_type_name", "ret_box_dyn_error", "on_struct", "branches", "tokens", "checks"
    )


def complexity(nodes: DataFrame) -> DataFrame:
    """functions: cyclomatic complexity of each emitted function."""
    return function_rows(nodes).select("file", "qualified_name", "start_line", "end_line", (1 + F.col("branches")).cast("bigint").alias("complexity"), _order())


def _order() -> Column:
    """File order, then pre-order, as one sortable value."""
    return F.concat("file", F.lit("\x00"), F.lpad(F.col("fn").cast("string"), 12, "0")).alias("ord")


def literal_matches(nodes: DataFrame) -> DataFrame:
    """file, pre of each match with two arms or more that are literals."""
    return nodes.filter("kind = 'match' and lit_match").select("file", "pre")


def struct_names(nodes: DataFrame) -> DataFrame:
    """file, ref_type_name: the structs at the top of each file, each once."""
    return nodes.filter("kind = 'struct' and at_top").select("file", F.col("name").alias("ref_type_name")).distinct()


def method_like(nodes: DataFrame) -> DataFrame:
    """Free functions whose first parameter refers to a struct at the top of their file."""
    return function_rows(nodes).filter(F.col("is_free") & F.col("on_struct"))


def findings(nodes: DataFrame) -> DataFrame:
    """file, fn, place, rule: every idiom finding of an emitted function; place orders a function's findings."""
    return function_rows(nodes).select("file", "fn", F.posexplode("checks").alias("place", "rule"))


def fingerprints(nodes: DataFrame) -> DataFrame:
    """Emitted functions with body_fingerprint: of the token list of a body, never empty.

    Closures are a token without contents.  The list itself is the key of the
    comparison by way of its digest, so equal digests are equal lists."""
    return function_rows(nodes).withColumn("body_fingerprint", F.sha2("tokens", 256))


def idioms(nodes: DataFrame) -> DataFrame:
    """idiom rows of each emitted function, before duplicate detection."""
    return fingerprints(nodes).select("file", "qualified_name", "start_line", X.demerits(F.col("checks")).alias("demerits"), "checks", F.lit(False).alias("sig_duplicate"), F.lit(False).alias("body_duplicate"), F.col("sig_fp").alias("sig_fingerprint"), "body_fingerprint", _order())
