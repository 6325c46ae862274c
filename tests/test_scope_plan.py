"""Symbols in code: uses are read once, and found as their SQL finds them."""

import contextlib
import io

import __spark_entry__ as entry
from loomspark.operators.cascade import symbol_uses


def test_lines_are_scanned_once(spark):
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        entry.queries()["symbol_scope_cascade"](spark, "/root/testdata/sf0.001").explain()
    assert held.getvalue().split("Initial Plan")[-1].count("l_linestatus#") > 0
    assert held.getvalue().count("lineitem.parquet") == 1


def test_first_lines_of_uses(spark):
    code = "using A.B;\nnew Foo();\n/* new\nBar() */ new\n\n Bar {\nnew X.Foo(); new Foo(); new new (\nnew Barn(new Bar())"
    rows = symbol_uses(spark.createDataFrame([(1, code), (2, None), (3, "none")], "id int, content string"), ["id"]).collect()
    got = sorted((r["id"], r["symbol"], r["line"], list(r["qualifiers"]), list(r["imports"])) for r in rows)
    assert got == [(1, "Bar", 3, [], ["A.B"]), (1, "Barn", 7, [], ["A.B"]), (1, "Foo", 2, ["X"], ["A.B"]), (1, "new", 6, [], ["A.B"])]
