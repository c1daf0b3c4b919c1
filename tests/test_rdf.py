import pytest
from tripleloom.plans.graph import RDF_TYPE
from tripleloom.sources import rdf

TURTLE = """@prefix ex: <http://x/> . @base <http://b/> .
# comment
ex:alice a ex:Person ; ex:knows ex:bob , <carol> ; ex:name "Al\\"ice"@en ; ex:age 30 .
ex:bob ex:score 1.5 ; ex:ok true ; ex:note \"\"\"two
lines\"\"\" ; ex:when "2020"^^<http://x/year> .
_:b0 ex:likes [ ex:name 'inner' ] .
"""


def triples(df):
    return {tuple(r) for r in df.collect()}


def test_turtle(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TURTLE)
    got = triples(rdf.read_triples(spark, str(tmp_path / "g.ttl")))
    x, xsd = "http://x/", "http://www.w3.org/2001/XMLSchema#"
    assert (f"{x}alice", RDF_TYPE, f"{x}Person", False, None, None) in got
    assert (f"{x}alice", f"{x}knows", "http://b/carol", False, None, None) in got
    assert (f"{x}alice", f"{x}name", 'Al"ice', True, None, "en") in got
    assert (f"{x}alice", f"{x}age", "30", True, f"{xsd}integer", None) in got
    assert (f"{x}bob", f"{x}score", "1.5", True, f"{xsd}decimal", None) in got
    assert (f"{x}bob", f"{x}ok", "true", True, f"{xsd}boolean", None) in got
    assert (f"{x}bob", f"{x}note", "two\nlines", True, None, None) in got
    assert (f"{x}bob", f"{x}when", "2020", True, "http://x/year", None) in got
    assert ("_:b0", f"{x}likes", "_:gen1", False, None, None) in got and ("_:gen1", f"{x}name", "inner", True, None, None) in got
    assert len(got) == 11


def test_blank_nodes_belong_to_their_file(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.ttl").write_text(f"@prefix e: <http://x/> .\n_:b0 e:p [ e:q {k} ] .\n")
    g = rdf.load(spark, str(tmp_path))
    assert g.names.filter("name like '_:%'").count() == 4 and g.edges.count() == 4


def test_ntriples_round_trip(spark, tmp_path):
    rows = [
        ("http://a", "http://p", "http://b", False, None, None), ("_:n1", "http://p", "_:n2", False, None, None), ("http://a", "http://q", 'say "hi"\\n\n\tend', True, None, None),
        ("http://a", "http://q", "Bob", True, None, "en"), ("http://a", "http://q", "30", True, "http://x/int", None), ("http://a", "http://q", "é漢", True, None, None), ("http://a", "http://q", "", True, None, None),
    ]
    df = spark.createDataFrame(rows, rdf.TRIPLES)
    for fmt in ("nt", "turtle"):
        out = str(tmp_path / fmt)
        rdf.save(df, out, fmt)
        assert rdf.looks_like_ntriples(spark.read.text(out))
        assert triples(rdf.read_triples(spark, out)) == set(rows)
    with pytest.raises(ValueError):
        rdf.save(df, str(tmp_path / "x"), "rdfxml")
    (tmp_path / "u.nt").write_text('<http://a> <http://p> "\\u00e9\\U0001F600\\\\" . # note\n\n# all\n')
    assert triples(rdf.read_triples(spark, str(tmp_path / "u.nt"))) == {("http://a", "http://p", "é\U0001f600\\", True, None, None)}


def test_parser_agrees_with_the_line_format(spark, tmp_path):
    text = '<http://a> <http://p> <http://b> .\n<http://a> <http://q> "x"@en-GB .\n_:z <http://p> "5"^^<http://t> .\n'
    (tmp_path / "g").write_text(text)
    assert triples(rdf.read_triples(spark, str(tmp_path / "g"))) == set(rdf.parse_turtle(text))


@pytest.mark.parametrize("text", ["<rdf/>", "ex:a ex:b ex:c .", "<http://a> <http://b> .", "<http://a> <http://b> \"open ."])
def test_what_is_not_rdf_raises(spark, tmp_path, text):
    (tmp_path / "bad").write_text(text)
    with pytest.raises(ValueError):
        rdf.read_triples(spark, str(tmp_path / "bad"))


def test_loaded_graph(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix : <http://x/> . :a :p :b , :b ; :age "30"^^:int ; :name "Bob"@en . :a :p :b .')
    g = rdf.load(spark, str(tmp_path / "g.ttl"))
    assert g.edges.count() == 3 and g.names.count() == 4 and g.names.filter("is_literal").count() == 2
