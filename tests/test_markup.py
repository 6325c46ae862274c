"""Markup, names, sources and sinks against plain Python and stated goldens."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions import names
from loomspark.functions.schema import json_errors
from loomspark.operators import markup, matching, retrieval
from loomspark.sinks import files
from loomspark.sources import artefacts

XML = f"""<Window xmlns="{markup.PRESENTATION}" xmlns:x="{markup.XAML}" xmlns:l="clr-namespace:Lib">
  <Window.Resources><l:Thing x:Name="t"/><Style/></Window.Resources>
  head<Border>in<!-- no --><TextBox Text="{{Binding A}} {{Binding Path= B.C }}" PreviewKeyDown=" Go "/>out</Border>tail
  <Label Content="x"/><Label Content="{{MultiBinding}}"/>
</Window>"""


def test_nodes(spark):
    rows = markup.xml_nodes(spark.createDataFrame([("a", XML), ("b", None), ("c", "<x>"), ("d", "")], "source_id string, xml string")).collect()
    assert {r["source_id"] for r in rows if r["error"]} == {"b", "c", "d"}
    by = {r["node_path"]: r for r in rows if not r["error"]}
    assert list(by) == ["/Window[1]", "/Window[1]/Window.Resources[1]", "/Window[1]/Window.Resources[1]/Thing[1]", "/Window[1]/Window.Resources[1]/Style[1]", "/Window[1]/Border[1]", "/Window[1]/Border[1]/TextBox[1]", "/Window[1]/Label[1]", "/Window[1]/Label[2]"]
    border, thing = by["/Window[1]/Border[1]"], by["/Window[1]/Window.Resources[1]/Thing[1]"]
    assert (border["text"], border["tail"], border["line"], border["n_children"]) == ("in", "tail", 3, 1)
    assert by["/Window[1]/Border[1]/TextBox[1]"]["tail"] == "out" and by["/Window[1]"]["attributes"] == {}
    assert (thing["namespace"], thing["full_tag"], thing["above"], thing["attributes"], thing["details"][0]["full_name"]) == ("clr-namespace:Lib", "{clr-namespace:Lib}Thing", ["Window.Resources", "Window"], {"Name": "t"}, f"{{{markup.XAML}}}Name")


def test_references(spark):
    nodes = markup.xml_nodes(spark.createDataFrame([("a", XML)], "source_id string, xml string"))
    got = {(r["kind"], r["attribute"], r["target"], r["resolution"]) for r in markup.references(nodes).collect()}
    assert got == {("binding", "Text", "A", "parsed"), ("binding", "Text", "B.C", "parsed"), ("event_handler", "PreviewKeyDown", "Go", "parsed"), ("multibinding", "Content", None, "partial")} or got == {("binding", "Text", "B.C", "parsed"), ("event_handler", "PreviewKeyDown", "Go", "parsed"), ("multibinding", "Content", None, "partial")}
    found = markup.resources(nodes).orderBy("index").collect()
    assert [(r["index"], r["tag"], r["key"], r["child_count"]) for r in found] == [(1, "Thing", "t", None), (2, "Style", None, 0)]


def test_control_tree_gets_one_root(spark):
    rows = markup.classify(markup.xml_nodes(spark.createDataFrame([("a", XML)], "source_id string, xml string")))
    tree = {r["ordinal"]: (r["new_parent"], r["tag"]) for r in markup.control_tree(rows).collect()}
    assert tree == {-1: (None, "Border"), 4: (-1, "Border"), 5: (4, "TextBox"), 6: (-1, "Label"), 7: (-1, "Label")}


def test_translation(spark):
    nodes = markup.xml_nodes(spark.createDataFrame([("a", "<Grid><Label>hi</Label><Odd/></Grid>")], "source_id string, xml string"))
    assert markup.translate(nodes, markup.RENAMES).first()["text"] == '<Box>\n  <Typography>hi\n  </Typography>\n  <Box data-unsupported="Odd">\n  </Box>\n</Box>'
    assert [r["tag"] for r in markup.placeholders(nodes, markup.RENAMES).collect()] == ["Odd"]


def test_occurrences_are_those_of_a_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["<", "A", "b", "\n", "Card.X", " ", "</", ">", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", "<<A", "<A"]
    rows = matching.tag_occurrences(spark.createDataFrame(list(enumerate(texts)), "file long, content string"), ["file"], 5, 9).collect()
    want = {(i, m[1], m.start(), t.count("\n", 0, m.start()) + 1, t[max(0, m.start() - 5) : m.start() + 9]) for i, t in enumerate(texts) for m in re.finditer(r"<([A-Z][A-Za-z0-9_.]*)\b", t)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_claims():
    c = lambda score, file, at, evidence=1, preferred=False, fallback=False: (score, file, at, (file, at), evidence, preferred, fallback)
    held = {1: [c(13, "A", 5, 2)], 2: [c(13, "A", 5), c(13, "B", 1)], 3: [c(10, "A", 9), c(10, "C", 2)], 4: [c(10, "A", 9), c(10, "C", 2), c(1, "D", 1, preferred=True)], 5: [c(5, "E", 1, fallback=True)], 7: [c(9, "A", 5)]}
    got = {r[0]: (r[1], r[3], r[4]) for r in matching.claim([1, 2, 3, 4, 5, 6, 7], held)}
    assert got == {
        1: (("A", 5), "MATCHED", 0.95), 2: (("B", 1), "MATCHED", 0.75), 3: (None, "AMBIGUOUS", 0.4), 4: (("A", 9), "MATCHED", 0.75),
        5: (("E", 1), "MATCHED", 0.7), 6: (None, "NOT_FOUND", 0.0), 7: (None, "NOT_FOUND", 0.0),
    }


def test_greedy_is_the_claims_of_each_project(spark):
    rng = random.Random(4)
    rows = [(i % 3, i, o, f"f{o % 4}", rng.randint(1, 4) * 5, rng.randint(1, 3), rng.random() < 0.1, rng.random() < 0.2) for i in range(30) for o in rng.sample(range(40), rng.randint(0, 6))]
    items = spark.createDataFrame([(i % 3, i) for i in range(30)], "project int, item long")
    got = matching.greedy(items, spark.createDataFrame(rows, "project int, item long, occurrence long, file string, score long, evidence int, preferred boolean, fallback boolean"), "project").collect()
    want = []
    for p in range(3):
        held = {}
        for q, i, o, f, s, e, pr, fb in rows:
            if q == p:
                held.setdefault(i, []).append((s, f, o, o, e, pr, fb))
        want += matching.claim([i for i in range(30) if i % 3 == p], held)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_tokens_of_other_scripts(spark):
    row = spark.createDataFrame([("wpf 按钮组件 MyButton 控件",), (None,), ("",)], "t string").select(retrieval.tokens(F.col("t")).alias("w")).collect()
    assert row[0]["w"] == ["按钮组件", "按钮", "钮组", "组件", "my", "button"] and row[1]["w"] is None and row[2]["w"] == []


def test_bm25_counts_documents_without_tokens(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple"), (3, ""), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(9, "apple apple apple pear")], "id long, text string")
    got = {r["id"]: r["bm25"] for r in retrieval.bm25(docs, asked).collect()}
    import math

    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    gain = lambda length: 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / 0.75))
    one, two = 2 * idf(2) * gain(2) + idf(1) * gain(2), 2 * idf(2) * gain(1)
    assert got == pytest.approx({1: 1.0, 2: two / one})


def test_names(spark):
    ask = lambda f, *values: [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]
    assert ask(names.component_name, "a/b c/Main View.xaml", "9lives.xaml") == ["a__b_c__Main_View", "Page_9lives"]
    assert ask(names.source_id, "a\\b.cs", "/a", "../a", "", "a//b/", "a/./b") == ["a/b.cs", None, None, None, "a/b", "a/b"]
    assert ask(names.generated_path, "src/a.tsx", "a.exe", "/a.ts", "x/../a.ts", "node_modules/a.ts", "", ".ts") == ["src/a.tsx", None, None, None, None, None, None]
    assert ask(names.without_comments, "a // b\nc /* d\ne */ f") == ["a \nc  f"]
    assert ask(names.symbol_variants, "'App.MainViewModel'", "Main") == [["MainViewModel", "MainView"], ["Main"]]
    assert ask(names.state_name, "Help") == ["helpOpen"] and ask(names.setter_name, "Help") == ["setHelpOpen"]
    folded = spark.range(1).select(markup.fold_path(F.array(*map(F.lit, "a . b .. .. c".split()))).alias("x"), markup.fold_path(F.array(*map(F.lit, "a .. .. c".split()))).alias("y")).first()
    assert (folded["x"]["parts"], folded["x"]["escaped"], folded["y"]["escaped"]) == (["c"], False, True)


def test_schema(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}}, "required": ["n"]}}, "b": {"type": ["boolean", "null"]}}, "additionalProperties": False}
    rows = ['{"a": [{"n": 1}, {"n": 2.5}], "b": null}', '{"a": [{"n": "x"}, {}], "c": 1}', '{"b": 3}', "[]", "{", '{"a": 1}']
    got = [r[1] for r in sorted(spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", json_errors(F.col("t"), schema)).collect())]
    assert got == [[], ["$.a[0].n is not number", "$.a[1].n missing", "$.c undefined"], ["$.a missing", "$.b is not boolean/null"], ["$ is not an object"], ["$ is not JSON"], ["$.a is not array"]]


def test_sources(spark, tmp_path):
    for name, data in {"a.tsx": "é".encode(), "node_modules/b.ts": b"x", "d_temp.ts": b"x", "sub/c.ts": "﻿z".encode(), "e.ts": "é".encode("cp1252"), "f.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {tuple(r) for r in artefacts.code_inventory(spark, str(tmp_path)).collect()} == {("a.tsx", "é"), ("sub/c.ts", "z"), ("e.ts", "é")}
    assert artefacts.decode(b"\x81\xff") == ("\x81ÿ", "latin-1", None)
    docs, meta = spark.createDataFrame([("A",), ("B",)], "name string"), spark.createDataFrame([("A", 1)], "name string, n int")
    out = artefacts.catalogue(docs, meta, spark.createDataFrame([("B",)], "name string"))
    assert [tuple(r) for r in out.collect()] == [("A", 1)]
    with pytest.raises(artefacts.Unknown, match="C"):
        artefacts.catalogue(docs, spark.createDataFrame([("C", 1)], "name string, n int"), docs)
    code, groups = artefacts.code_files(spark.createDataFrame([("a", "page", ["T"]), ("b", "else", ["T", "U"]), ("c", None, [])], "source_id string, type string, partial_types array<string>"))
    assert {r["source_id"] for r in code.collect()} == {"b", "c"} and {(r["qualified_name"], r["complete"]) for r in groups.collect()} == {("T", True), ("U", False)}
    edge = "project string, pages array<string>, edges array<struct<source:string,target:string>>"
    projects = spark.createDataFrame([("p", ["a.xaml", "b.xaml"], [("a.xaml", "b.xaml")]), ("q", ["a.xaml", "a.xaml"], [("a.xaml", "z.xaml")]), ("r", [], [])], edge)
    assert artefacts.page_selection(projects, "p").count() == 1
    assert {tuple(r) for r in artefacts.selection_violations(projects).collect()} == {("q", "page twice"), ("q", "edge leaves the set"), ("r", "no pages")}
    with pytest.raises(ValueError, match="no project"):
        artefacts.page_selection(projects, "s")


def test_sinks(spark, tmp_path):
    good = spark.createDataFrame([("src/a.ts", "x = 1\ny"), ("b.css", "z")], "path string, content string")
    out = f"{tmp_path}/gen"
    assert {r["place"] for r in files.write_generated(good, out).collect()} == {"src/a.ts", "b.css"}
    assert (tmp_path / "gen/src/a.ts").read_bytes() == b"x = 1\ny" and (tmp_path / "gen/b.css").read_bytes() == b"z"
    with pytest.raises(FileExistsError):
        files.write_generated(good, out)
    bad = good.unionByName(spark.createDataFrame([("b.css", "again"), ("../c.ts", "q"), ("d.ts", " ")], "path string, content string"))
    with pytest.raises(files.Refused) as e:
        files.write_generated(bad, f"{tmp_path}/none")
    assert {tuple(r) for r in e.value.violations.collect()} == {("b.css", "path given twice"), ("../c.ts", "path not allowed"), ("d.ts", "empty file")} and not (tmp_path / "none").exists()
    rows = spark.createDataFrame([(2, None, "é"), (1, "x", "y")], "b int, a string, c string")
    files.write_jsonl(rows, f"{tmp_path}/rows")
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/rows").collect())
    assert lines == ['{"a":"x","b":1,"c":"y"}', '{"a":null,"b":2,"c":"é"}'] and files.read_jsonl(spark, f"{tmp_path}/rows", "a string, b int, c string").count() == 2
    value = {"b": [1, {"é": None}], "a": {}}
    text = spark.createDataFrame([(json.dumps(value),), (None,)], "t string").select(files.pretty(F.col("t"), True), files.pretty(F.col("t"))).collect()
    assert tuple(text[0]) == (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", json.dumps(value, ensure_ascii=False, indent=2)) and tuple(text[1]) == (None, None)
    files.write_mirrored(spark.createDataFrame([("a/x.cs", "{}"), ("a/y.cs", "[1]")], "source_id string, json string"), f"{tmp_path}/mirror")
    assert {str(p.relative_to(tmp_path / "mirror")): p.read_text() for p in (tmp_path / "mirror").rglob("*.*")} == {"a/x.cs.json": "{}", "a/y.cs.json": "[\n  1\n]"}
    both = files.tagged(spark.createDataFrame([("run1",)], "run string"), page=rows, call=rows.select("a"))
    assert both.columns == ["run", "unit_type", "result"] and both.where("unit_type = 'call'").count() == 2
