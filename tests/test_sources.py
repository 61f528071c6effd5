"""Readers, writers, function extraction and streams."""

import json

import pytest
from pyspark.sql import functions as F

from reqtrail.sources import tables, tree
from reqtrail.streaming import stages


@pytest.fixture
def root(tmp_path):
    (tmp_path / "src/b").mkdir(parents=True)
    (tmp_path / "src/a").mkdir()
    (tmp_path / "src/z.c").write_bytes(b"uint32_t\nf(int a)\n{ return a; }\n\nvoid A::g() { }\nint h(void) { \xff{ \"}\" } }\n")
    (tmp_path / "src/a/one.h").write_text("static int one(int x) {\n if (x) { return 1; }\n return 0;\n}\n")
    (tmp_path / "src/b/two.cpp").write_text("int two() { open")
    (tmp_path / "src/b/skip.C").write_text("int skip() { }")
    (tmp_path / "top.cc").write_text("int top(a, b) {}")
    return str(tmp_path)


def test_tree(spark, root):
    files = tree.read_tree(spark, root)
    assert [r["file_path"] for r in files.orderBy("order").collect()] == ["top.cc", "src/z.c", "src/a/one.h", "src/b/two.cpp"]
    assert tree.read_tree(spark, root, max_files=2).count() == 2


@pytest.mark.parametrize("cap", [5000, None])
def test_extract(spark, root, cap):
    out = tree.extract_functions(tree.read_tree(spark, root), max_functions=cap).orderBy("function_id").collect()
    assert [(r["function_id"], r["function_name"], r["file_path"], r["start_line"], r["end_line"]) for r in out] == [
        (1, "top", "top.cc", 1, 1), (2, "f", "src/z.c", 1, 3), (3, "h", "src/z.c", 6, 6), (4, "one", "src/a/one.h", 1, 4), (5, "two", "src/b/two.cpp", 1, 1),
    ]
    assert out[1]["source_code"] == "{ return a; }" and out[2]["source_code"] == '{ { "}" }' and out[4]["source_code"] == "{ open"


def test_extract_options(spark, root):
    files = tree.read_tree(spark, root)
    assert tree.extract_functions(files, None, max_functions=2).count() == 2
    with pytest.raises(ValueError):
        tree.extract_functions(files, "yacc")
    try:
        import clang  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            tree.extract_functions(files, "CLANG")


def test_csv(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text('SR Text,n\n"a ""b"", c\nd",None\n,12\n')
    df = tables.read_csv(spark, path)
    assert [tuple(r) for r in df.collect()] == [('a "b", c\nd', "None"), (None, "12")]
    assert tables.read_csv(spark, path, missing=["None"]).filter("n IS NULL").count() == 1
    assert tables.read_csv_if_there(spark, str(tmp_path / "none.csv")) is None
    out = str(tmp_path / "out")
    tables.write_csv(df, out)
    assert sorted(map(str, tables.read_csv(spark, out).collect())) == sorted(map(str, df.collect()))
    assert tables.reordered(["id", "SR Text", "x", "new"], ["new", "more"]) == ["id", "SR Text", "new", "more", "x"]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "http.json").write_text(json.dumps({"keywords": {"status_code": {"100": "Continue"}, "field_name": ["Age"], "method": ["GET"]}}))
    (tmp_path / "tls.json").write_text(json.dumps({"flow": {"keywords": ["alert", "a"]}}))
    http = tables.read_keywords(spark, str(tmp_path / "http.json"), "HTTP")
    assert tables.flat_keywords(http) == ["100", "Age", "GET", "Continue"]
    assert tables.flat_keywords(tables.read_keywords(spark, str(tmp_path / "tls.json"), "tls")) == ["a", "alert"]
    with pytest.raises(ValueError):
        tables.read_keywords(spark, str(tmp_path / "tls.json"), "ftp")
    (tmp_path / "g.json").write_text(json.dumps({"g": {"a": [1, "x", "2"], "b": [2], "c": 5}, "h": []}))
    assert {tuple(r) for r in tables.read_groups(spark, str(tmp_path / "g.json")).collect()} == {(1, "g", "a"), (2, "g", "b")}
    (tmp_path / "v.json").write_text(json.dumps({"a": 4}))
    assert tables.read_vocabulary(spark, str(tmp_path / "v.json")).collect()[0].asDict() == {"word": "a", "id": 4}


def test_lines_and_slices(spark, tmp_path):
    (tmp_path / "code.txt").write_bytes("één\nzwei\n\ndrei".encode("latin-1"))
    assert [r["line"] for r in tables.read_lines(spark, str(tmp_path / "code.txt"), "ISO-8859-1").orderBy("id").collect()][:2] == ["één", "zwei"]
    (tmp_path / "plain.txt").write_text("a\n\nb")
    assert [tuple(r) for r in tables.read_lines(spark, str(tmp_path / "plain.txt")).collect()] == [(0, "a"), (1, ""), (2, "b")]
    seqs = spark.range(4).select("id", F.array(F.col("id")).alias("tokens"))
    assert [r["tokens"][0] for r in tables.ragged_slices(seqs, 3, 3, 4).orderBy("at").collect()] == [3, 0, 1]
    assert tables.ragged_slices(seqs, 0, -1, 4).count() == 4
    assert tables.check_counts(seqs, seqs) == 4
    with pytest.raises(ValueError):
        tables.check_counts(seqs, seqs.limit(1))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "100,200", "")], "id int, `SR Text` string, status_code string, method string")
    shown = tables.readable(df, {"status_code": "Status Codes", "method": "Methods"}, "SR Text", F.col("id"))
    tables.write_jsonl(shown, str(tmp_path / "j"))
    line = json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part-*")))
    assert line == {"id": 1, "sr": "x", "keywords_found": {"Status Codes": ["100", "200"], "Methods": []}}
    tables.write_outputs({"sr": df}, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        tables.write_outputs({"other": df}, str(tmp_path / "out"))
    vecs = spark.range(10).select("id", F.array(F.lit(0.5).cast("float")).alias("vec")).coalesce(1)
    tables.write_vectors(vecs, str(tmp_path / "v"), 5)
    assert len(list((tmp_path / "v").glob("part-*"))) == 2 and tables.read_vectors(spark, str(tmp_path / "v")).count() == 10
    watched, watch = tables.observed(df, "rows-1")
    watched.collect()
    assert watch.get == {"rows": 1}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "server header GET", '["GET"]'), (2, "nothing", "[]")], "function_id int, source_code string, method string")
    rows.write.parquet(str(tmp_path / "in"))
    reqs = spark.createDataFrame([(7, "server MUST", "GET,PUT")], "sr_id int, sr string, method string")
    got = {"overlap": [], "dictionary": [], "keywords": []}
    stream = lambda: stages.read_stream(spark, str(tmp_path / "in"), rows.schema)
    keep = lambda name: lambda df, _: got[name].extend(map(tuple, df.collect()))
    stages.run_available(stages.overlap_stream(stream(), reqs, "function_id", "source_code"), keep("overlap"), str(tmp_path / "c1"))
    stages.run_available(stages.dictionary_stream(stream(), reqs, {"method": "method"}), keep("dictionary"), str(tmp_path / "c2"))
    stages.run_available(stages.keyword_stream(stream().select("function_id", "source_code"), {"method": ["GET"]}, "source_code").select("function_id", "method"), keep("keywords"), str(tmp_path / "c3"))
    assert {k: sorted(v) for k, v in got.items()} == {"overlap": [(1, 7, 0.5)], "dictionary": [(1, 7, "method", "GET")], "keywords": [(1, "GET"), (2, "")]}
    with pytest.raises(ValueError):
        stages.overlap_stream(stream(), reqs, "function_id", "source_code", limit=10)


def test_clang_definitions():
    """With a stand-in for the bindings: own definitions only, cut by places in the text that was parsed, else by lines."""
    from types import SimpleNamespace as N

    from reqtrail.sources import clang_tree

    raw = b"// caf\xe9\xff\nint f(int a)\n{ return a; }\nint g(void);\nint h(void) { return 1; }\n"
    text = raw.decode("utf-8", "ignore")
    kinds = N(FUNCTION_DECL=1, VAR_DECL=2)

    def cursor(name, part, kind=1, definition=True, file="a.c", shift=0):
        at = text.encode().index(part.encode())
        line = text[: text.index(part)].count("\n") + 1
        start, end = N(file=file, offset=at + shift, line=line), N(offset=at + (len(part) if not shift else 0) + shift, line=line + part.count("\n"))
        return N(kind=kind, spelling=name, is_definition=lambda: definition, extent=N(start=start, end=end))

    seen = []

    class Index:
        def parse(self, path, args, unsaved_files, options):
            if path == "bad.c":
                raise RuntimeError("no unit")
            seen.append((path, args, unsaved_files, options))
            return N(cursor=N(get_children=lambda: [
                cursor("f", "int f(int a)\n{ return a; }"), cursor("g", "int g(void);", definition=False), cursor("v", "int h", kind=2),
                cursor("x", "int g", file="other.h"), cursor("h", "int h(void) { return 1; }", shift=10_000)]))

    stub = N(TranslationUnit=N(PARSE_INCOMPLETE=2, PARSE_DETAILED_PROCESSING_RECORD=1), CursorKind=kinds)
    got = list(clang_tree.definitions(stub, Index(), "a.c", raw, ["-Iinc", "-DX"]))
    assert got == [("a.c", 0, "f", 2, 3, "int f(int a)\n{ return a; }"), ("a.c", 1, "h", 5, 5, "int h(void) { return 1; }")]
    assert seen == [("a.c", ["-Iinc", "-DX"], [("a.c", text)], 3)]
    assert list(clang_tree.definitions(stub, Index(), "bad.c", raw, [])) == []
