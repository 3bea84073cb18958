"""Reading and writing files: detection, error modes, byte-exact round trips, spreadsheets, records, cells, streams, CLI."""

from dataclasses import dataclass, field
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabspark import streaming
from tabspark.cli import main
from tabspark.errors import CellError, FileClosed, InvalidReference, MissingColumn, NoHeader, OutOfRange, ParseError, TabError
from tabspark.operators import cells, merge, records
from tabspark.operators import validate as V
from tabspark.operators.query import Query
from tabspark.sources import jsonx, registry, sheets, text
from tabspark.sources.files import read_bytes, write_bytes
from tabspark.sources.text import Options


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("data, want", [("a,b\n1,2\n", ","), ("a;b\n1;2\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b|c\n1|2|3", "|"), ('"x;y",b\n1,2', ","), ("", ","), ("plain", ",")])
def test_delimiters(data, want):
    assert text.sniff_delimiter(data) == want


def test_headers_and_encodings():
    assert text.sniff_header([["name", "age"], ["Al", "3"]]) and not text.sniff_header([["name"], ["Al"]]) and not text.sniff_header([["1"], ["2"]])
    assert text.sniff_encoding(b"\xff\xfea\0") == ("utf-16-le", 2) and text.sniff_encoding(b"abc") == ("utf-8", 0)
    assert text.decode(b"\xef\xbb\xbfx") == "x" and text.decode(b"\x80", "windows-1252") == "€" and text.decode(b"\xe9", "iso-8859-1") == "é"
    assert text.encode("é€", "iso-8859-1") == b"\xe9?" and text.encode("a", "utf-8", bom=True) == b"\xef\xbb\xbfa"


def test_parser_grammar():
    rows = lambda s, **o: text.parse(s, Options(delimiter=",", **o))[0]
    assert rows('a,"b ""x"", c",d\n') == [["a", 'b "x", c', "d"]]
    assert rows('a,"line\nbreak"\nx,y') == [["a", "line\nbreak"], ["x", "y"]]
    assert rows("a,b\r\n\r\n1,2\r\n") == [["a", "b"], ["1", "2"]]
    assert rows("#c\na\n#d\nb", comment="#") == [["a"], ["b"]]
    assert rows("a,\n,\n") == [["a", ""], ["", ""]] and rows('"a",\n') == [["a", ""]]
    assert rows("skip\nme\na,b", skip_rows=2) == [["a", "b"]]
    assert rows(" a,  b", trim=True) == [["a", "b"]]
    assert rows("1,2\n1,2,3,4\n1") == [["1", "2"], ["1", "2", "3", "4"], ["1"]]
    assert rows('a,"b"c', lazy_quotes=True) == [["a", 'b"c']] and rows('a,b"c', lazy_quotes=True) == [["a", 'b"c']]


def test_error_modes():
    bad = 'ok,1\na,b"c\nfine,2\n"open'
    with pytest.raises(ParseError) as e:
        text.parse(bad, Options(delimiter=","))
    assert (e.value.line, e.value.column, e.value.offset) == (2, 4, 8)
    rows, errors = text.parse(bad, Options(delimiter=",", errors="skip"))
    assert rows == [["ok", "1"], ["fine", "2"]] and [x.line for x in errors] == [2, 4]
    rows, errors = text.parse(bad, Options(delimiter=",", errors="collect"))
    assert len(rows) == 4 and len(errors) == 2
    rows, errors = text.parse("a,b\n1\n1,2", Options(delimiter=",", errors="skip", fields=-1))
    assert rows == [["a", "b"], ["1", "2"]] and errors[0].line == 2


CELLS = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\r"), max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(CELLS, min_size=2, max_size=4), min_size=1, max_size=5))
def test_what_is_written_is_read(rows):
    data = "".join(text.format_row(r) + "\n" for r in rows)
    assert text.parse(data, Options(delimiter=","))[0] == rows


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_read_or_refused(data):
    for mode in ("strict", "skip", "collect"):
        try:
            text.parse(data, Options(errors=mode))
        except ParseError:
            assert mode == "strict"


def test_csv_on_spark(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'title,note,code\n"a, b","say ""hi""",1\n"two\nlines",,2\n')
    q = text.open_csv(spark, p)
    assert q.headers == ["title", "note", "code"]
    assert q.to_rows() == [["a, b", 'say "hi"', "1"], ["two\nlines", "", "2"]] == text.open_csv(spark, p, native=True).to_rows()
    text.save_csv(q, str(tmp_path / "b.csv"))
    assert (tmp_path / "b.csv").read_bytes() == (tmp_path / "a.csv").read_bytes()
    text.write_csv(q, str(tmp_path / "parts"))
    assert text.render_csv(q, Options(crlf=True)).count("\r\n") == 3
    assert b"".join(x.read_bytes() for x in sorted((tmp_path / "parts").glob("part*"))) == (tmp_path / "a.csv").read_bytes()
    ragged = text.open_csv(spark, write(tmp_path / "r.csv", "a,b,c\n1,2\n1,2,3,4\n1\n"), Options(header=True))
    assert ragged.to_rows() == [["1", "2", ""], ["1", "2", "3"], ["1", "", ""]]
    assert [len(r[0]) for r in ragged.ordered().select("_all_cells").collect()] == [2, 4, 1]
    bom = text.open_csv(spark, write(tmp_path / "bom.csv", "﻿name,age\nAl,3\n"))
    assert bom.headers == ["name", "age"]
    assert text.open_text(spark, "x;y\n1;2\n", Options(header=True)).to_records() == [{"x": "1", "y": "2"}]


@pytest.mark.parametrize("rows, parts", [(1000, 4), (1000, 1), (3, 4), (0, 2)])
def test_headers_of_many_parts(spark, tmp_path, rows, parts):
    df = spark.range(0, rows, 1, parts).selectExpr("cast(id as string) id", "concat('n', id) name")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_csv(Query.from_df(df), str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for native in (False, True):
        q = text.open_csv(spark, str(tmp_path / "d"), Options(header=True), native=native)
        assert q.headers == ["id", "name"] and sorted(q.to_rows()) == sorted([str(i), f"n{i}"] for i in range(rows))


def test_concat_of_nothing(spark):
    assert merge.concat().count() == 0 and merge.concat().headers == []


@pytest.mark.parametrize("ext", ["gz", "bz2", "zst", "GZIP"])
def test_compressed(spark, tmp_path, ext):
    q = Query.from_rows(spark, [[i, f"n{i}"] for i in range(100)], ["id", "name"])
    p = str(tmp_path / f"t.csv.{ext}")
    text.save_csv(q, p)
    assert registry.load(spark, p).to_rows() == q.to_rows()
    assert read_bytes(spark, p).startswith(b"id,name\n0,n0\n")


def test_native_reader_looks_beyond_the_sample(spark, tmp_path):
    o = text.Options(header=False)
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.csv", "1,x\n" * 4000)
    write(tmp_path / "d" / "b.csv", "2,y\n" * 4000 + '3,"two\nlines",z\n')
    q = text.open_csv(spark, str(tmp_path / "d"), o, native=True)
    assert q.headers == ["column1", "column2", "column3"]
    assert q.df.count() == 8001 and q.to_rows()[-1] == ["3", "two\nlines", "z"]
    p = write(tmp_path / "wide.csv", "1,x\n" * 4000 + '2,"a,b",c,d\n')
    assert text.open_csv(spark, p, o, native=True).to_rows()[-1] == ["2", "a,b", "c", "d"]


def test_lines_of_several_json_objects(spark, tmp_path):
    p = write(tmp_path / "a.ndjson", '{"a": 1}{"a": 2} {"b": 3}\n\n[{"a": 4}, {"a": 5}]\n[]\n{"a": 6}\n')
    q = jsonx.from_ndjson(spark, p)
    assert q.headers == ["a", "b"]
    assert q.to_rows() == [["1", ""], ["2", ""], ["", "3"], ["4", ""], ["5", ""], ["6", ""]]


def test_json(spark, tmp_path):
    p = write(tmp_path / "a.json", '[{"id": 9007199254740993, "x": 1.50, "n": null}, {"id": 2, "o": {"b": [1, "<"], "a": true}}]')
    q = jsonx.from_json(spark, p)
    assert q.headers == ["id", "n", "x", "o"]
    assert q.to_rows() == [["9007199254740993", "", "1.50", ""], ["2", "", "", '{"a":true,"b":[1,"\\u003c"]}']]
    t = Query.from_rows(spark, [["1", "007", "true", 'q"<', ""], ["x", "1.50", "NaN", "é\n", "2"]], ["a", "b", "c", "d", "e"])
    assert [r.value for r in jsonx.json_lines(t, null_for_empty=True).collect()] == ['{"a":1,"b":7,"c":true,"d":"q\\"\\u003c","e":null}', '{"a":"x","b":1.5,"c":"NaN","d":"é\\n","e":2}']
    jsonx.to_ndjson(t, str(tmp_path / "n"))
    back = jsonx.from_ndjson(spark, str(tmp_path / "n"))
    assert back.to_rows() == [["1", "7", "true", 'q"<', ""], ["x", "1.5", "NaN", "é\n", "2"]]
    jsonx.to_json(t, str(tmp_path / "p.json"), pretty=True)
    assert jsonx.from_json(spark, str(tmp_path / "p.json")).to_rows() == back.to_rows()


@pytest.mark.parametrize("ext", ["xlsx", "ods"])
def test_sheets(spark, tmp_path, ext):
    q = Query.from_rows(spark, [["1", "A & <b>", "true"], ["2", "two\nlines", ""], ["", "x", "1.5"]], ["id", "name", "v"])
    p = str(tmp_path / f"t.{ext}")
    sheets.write_sheet(q, p)
    assert sheets.read_sheet(spark, p).to_rows() == q.to_rows()
    sheets.append_sheet(q.limit(1), p, "More")
    assert sheets.sheet_names(spark, p) == ["Sheet1", "More"] and sheets.read_sheet(spark, p, "More").count() == 1
    assert [r["name"] for r in sheets.iterate_sheet(spark, p)] == ["A & <b>", "two\nlines", "x"]
    if ext == "xlsx":
        sheets.write_sheet(q, p, type_infer=True, auto_filter=True)
        assert sheets.read_sheet(spark, p).to_rows()[0] == ["1", "A & <b>", "TRUE"]


def test_convert(spark, tmp_path):
    p = write(tmp_path / "a.csv", "id,name\n1,Al\n2,Bo\n")
    for to in ("csv", "ods", "xlsx", "json", "ndjson"):
        registry.convert(spark, p, out := str(tmp_path / f"o.{to}"), to)
        assert registry.load(spark, out).to_rows() == [["1", "Al"], ["2", "Bo"]]
    registry.convert(spark, p, str(tmp_path / "o.csv.gz"), "gz")
    assert registry.load(spark, str(tmp_path / "o.csv.gz")).count() == 2


@dataclass
class Home:
    street: str = ""
    city: str = ""


@dataclass
class User:
    id: int = 0
    name: str = field(default="", metadata={"csv": "full name"})
    score: float = field(default=0.0, metadata={"csv": records.Field(omit_empty=True)})
    active: bool = False
    created: datetime = field(default=None, metadata={"csv": records.Field(layout="2006-01-02")})
    tags: list[str] = field(default_factory=list, metadata={"csv": records.Field(sep="|")})
    home: Home = field(default_factory=Home, metadata={"csv": records.Field(prefix="home_")})
    at: Home = field(default_factory=Home, metadata={"csv": records.Field(json=True)})
    more: dict[str, str] = field(default_factory=dict, metadata={"csv": records.Field(rest=True)})


def test_records(spark):
    made = [User(1, "Al", 1.5, True, datetime(2024, 1, 2), ["a", "b"], Home("s", "c"), Home("x", "y"), {"k": "v"}), User(2, "Bo", more={"j": "w"})]
    q = records.encode_records(spark, made, User)
    assert q.headers == ["id", "full name", "score", "active", "created", "tags", "home_street", "home_city", "at", "j", "k"]
    assert q.to_rows()[0] == ["1", "Al", "1.5", "true", "2024-01-02", "a|b", "s", "c", '{"street":"x","city":"y"}', "", "v"]
    back = list(records.iterate(q, User))
    assert back[0].tags == ["a", "b"] and back[0].home == Home("s", "c") and back[0].at == Home("x", "y") and back[0].more == {"j": "", "k": "v"}
    assert back[1].id == 2 and back[1].score == 0.0 and back[1].created is None
    bad = Query.from_rows(spark, [["x"]], ["id"])
    with pytest.raises(Exception, match="doesn't parse"):
        list(records.iterate(bad, User))
    with pytest.raises(TabError):
        records.encode_records(spark, [User(more={"id": "1"})], User)


def test_references():
    for ref, place in {"A1": (1, 1), "Z26": (26, 26), "AA27": (27, 27), "ZZ1": (702, 1), "AAA1": (703, 1), "  a1": (1, 1)}.items():
        assert cells.parse_ref(ref) == place
    assert all(cells.parse_ref(cells.to_ref(c, 1)) == (c, 1) for c in range(1, 1001))
    for bad in ("", "ABC", "123", "A!1", "A0"):
        with pytest.raises(InvalidReference):
            cells.parse_ref(bad)


def test_table_edits(spark, tmp_path):
    t = cells.Table.from_rows(spark, [["1", "a"], ["2", "b"]], ["id", "name"])
    t.set_cell("B2", True)
    assert t.get_cell("B2") == "true" and t.get_cell("A1") == "" and t.dimension() == "A1:B3"
    t.insert_row(1, ["9", "z"])
    t.remove_row(0)
    t.append_record({"name": "c", "other": 1})
    assert t.rows() == [["9", "z"], ["2", "b"], ["", "c"]]
    t.append_column("n", [1, 2])
    assert t.column("n") == ["1", "2", ""]
    t.remove_column("id")
    assert t.headers == ["name", "n"] and t.record(0) == {"name": "z", "n": "1"}
    t.range("A2:B3").set_values([["p", 1.5], ["q", None]])
    assert t.range("B3:A2").values() == [["p", "1.5"], ["q", ""]] and t.range("A1:C5").dimensions() == (5, 3)
    assert t.get_int("B2") == 1 and t.get_float("B2") == 1.5 and t.cell_type("B2") == "float"
    assert isinstance(t.range("nope").err, InvalidReference)
    t.set_cell("B3", "05/04/2024")
    assert t.get_date("B3") == datetime(2024, 4, 5)
    with pytest.raises(CellError):
        t.get_bool("B3")
    t.save(str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text() == "name,n\np,1.5\nq,05/04/2024\nc,\n"
    with pytest.raises(OutOfRange):
        t.remove_row(9)
    with pytest.raises(MissingColumn):
        t.column("none")
    e = cells.Table.empty(spark)
    e.set_row(2, ["x"])
    assert e.row_count() == 3 and e.rows() == [[""], [""], ["x"]]
    with pytest.raises(NoHeader):
        e.append_record({})
    e.close()
    assert e.row_count() == 0
    with pytest.raises(FileClosed):
        e.rows()
    assert cells.Table.from_query(Query.from_rows(spark, [["1"], ["2"]], ["a"])).row(1) == ["2"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", "id,age\n1,5\n2,-1\n,7\n")
    stream = streaming.read_csv_stream(spark, str(tmp_path / "in"), ["id", "age"])
    schema = V.Schema().column("id", V.required()).column("age", V.minimum(0))
    q = streaming.validate_stream(stream, schema).writeStream.format("memory").queryName("violations").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r.field) for r in spark.table("violations").collect()) == [("", "id"), ("2", "age")]
    streaming.write_csv_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert text.open_csv(spark, str(tmp_path / "out" / "*.csv"), Options(header=True)).count() == 3
    with streaming.StreamWriter(spark, str(tmp_path / "w.csv.gz")) as w:
        with pytest.raises(NoHeader):
            w.write_record({})
        w.write_header(["a", "b"])
        w.write_record({"b": 1})
        w.write_row(1.5, "x,y")
    assert read_bytes(spark, str(tmp_path / "w.csv.gz")) == b'a,b\n,1\n1.5,"x,y"\n'
    with pytest.raises(FileClosed):
        w.write_row(1)
    data, closed = iter([[1, "a"], [2, "b"]]), []
    rows = streaming.rows_from_function(["n", "s"], lambda: next(data, None), lambda: closed.append(1))
    assert Query.from_iterator(spark, rows, ["n", "s"]).to_rows() == [["1", "a"], ["2", "b"]] and closed == [1]


def test_cli(spark, tmp_path, capsys):
    p = write(tmp_path / "p.csv", "id,name,age\n1,Alice,30\n2,Bob,\n3,Charlie,35\n")
    r = write(tmp_path / "r.csv", "id,name,age\n1,Alice,30\n2,Bobby,\n4,Dee,1\n")

    def run(*args):
        code = main(list(args), spark)
        return code, capsys.readouterr().out

    assert run("head", "-n", "2", p) == (0, "id,name,age\n1,Alice,30\n2,Bob,\n")
    assert run("tail", "-n", "1", p) == (0, "id,name,age\n3,Charlie,35\n")
    assert run("select", "-c", "age, id", p)[1].startswith("age,id\n30,1\n")
    assert run("filter", "-w", "age > 25", p)[1].count("\n") == 3
    assert run("filter", "-w", "age < 1", p) == (0, "id,name,age\n2,Bob,\n")
    assert run("filter", "-w", "name < Bob", p)[1].splitlines()[1:] == [x for x in run("head", "-n", "99", p)[1].splitlines()[1:] if x.split(",")[1] < "Bob"]
    assert run("filter", "-w", "name starts B", p) == (0, "id,name,age\n2,Bob,\n")
    assert run("sort", "-c", "age", "-desc", p)[1].split("\n")[1] == "3,Charlie,35"
    assert "age: int, 1 empty, 2 distinct" in run("stats", p)[1]
    assert run("join", "-on", "id", "-mode", "full", p, r)[1].count("\n") == 5
    assert run("diff", "-on", "id", p, r) == (0, "added: 1\n  4\nremoved: 1\n  3\nmodified: 1\n  2: name\n")
    assert run("sql", "-q", "SELECT name FROM t WHERE age >= 30 ORDER BY age DESC", p) == (0, "name\nCharlie\nAlice\n")
    assert run("sql", "SELECT COUNT(*) AS n FROM t", p) == (0, "n\n3\n")
    schema = write(tmp_path / "s.json", '{"columns": [{"name": "age", "required": true}]}')
    assert run("validate", "-schema", schema, p)[0] == 1
    assert run("convert", "-to", "json", p, str(tmp_path / "o.json"))[0] == 0
    assert "name: str" in run("gen-struct", p)[1]
    assert main(["sql", "-q", "SELECT", p], spark) == 1
    write_bytes(spark, str(tmp_path / "x.csv"), b"a\n")
    assert registry.load(spark, str(tmp_path / "x.csv")).headers == ["a"]
