from quarryline.operators import relations as L


def test_edges():
    assert L.script_edges("function a() { b(); if (x) c(); }\nconst b = (x) => c(x);\nfunction c() {}\nclass K extends P {\n  run(x) { a(); }\n}\n") == [("call", "a", "b"), ("call", "a", "c"), ("call", "b", "c"), ("call", "run", "a"), ("inheritance", "K", "P")]
    assert L.esql_edges("CREATE FUNCTION F() RETURNS INT\nBEGIN CALL P(1); SET x = Q.R(2); END\nCREATE PROCEDURE P(IN a INT)\nBEGIN END") == [("call", "F", "P"), ("set", "F", "Q.R")]
    dwl = "%dw 2.0\ntype Row = { a: String }\nvar name = 'x'\nfun up(r: Row) = upper(r.a)\nfun greet(s) = up(s)\n---\ngreet(name)"
    assert set(L.dataweave_edges(dwl)) == {("type-reference", "up", "Row"), ("function-call", "greet", "up"), ("function-call", "main", "greet"), ("variable-reference", "main", "name")}
    xml = '<mule><flow name="main"><listener config-ref="H"/><flow-ref name="sub"/><flow-ref name="gone"/><transform/></flow><sub-flow name="sub"/><connections sourceNode="a" targetNode="b"/></mule>'
    assert L.xml_edges(xml) == [("config-reference", "main", "H"), ("flow-reference", "main", "sub"), ("dataweave", "main", "dataweave-transformation"), ("connection", "a", "b")]
    assert L.xml_edges("<") == []


def test_rows(spark):
    df = spark.createDataFrame([("1", "function a() { b(); b(); }\nfunction b() {}", "javascript"), ("2", None, "xml"), ("3", "x", "go")], "k string, t string, l string")
    edges = L.relationships(df, "k", "t", "l")
    assert edges.count() == 2 and [(r.source, r.callees) for r in L.call_graph(edges).collect()] == [("a", ["b"])]
    assert L.relationships(df.limit(0), "k", "t", "l").count() == 0
