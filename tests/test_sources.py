"""Files in and out, workbooks, streams."""

import datetime
import glob
import zipfile

import pytest
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.plans.lookup import work_folder
from sparkscrub.sources.tables import format_of
from sparkscrub.streaming.streams import apply_recipe, drop_duplicates, first_by_order, read_stream


def test_format_of():
    assert [format_of(p) for p in ("a.CSV", "b/c.parquet/", "x.xlsx")] == ["csv", "parquet", "xlsx"]
    for path in ("a.xls", "a.md", "folder"):
        with pytest.raises(ValueError, match="unsupported"):
            format_of(path)


def test_csv_types_and_missing_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    lines = ["id,n,d,flag,t,day,e", '1,007,1.5,True,"a ""b"", c",2024-01-01,', "2,NA,1e3,false, x ,,nan", '3, 4,inf,,"",,']
    path.write_text("\n".join(lines) + "\n")
    df = ss.read_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "double", "boolean", "string", "string", "string"]
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [
        (1, 7, 1.5, True, 'a "b", c', "2024-01-01", None),
        (2, None, 1000.0, False, " x ", None, None),
        (3, 4, float("inf"), None, None, None, None),
    ]
    raw = ss.read_table(spark, str(path), infer=False)
    assert {t for _, t in raw.dtypes} == {"string"}
    given = ss.read_table(spark, str(path), schema="n int, id string", missing_tokens=["NA"])
    assert [tuple(r) for r in given.collect()] == [(7, "1"), (None, "2"), (4, "3")]
    with pytest.raises(ValueError):
        ss.read_table(spark, str(path), schema="nope int")


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", you', 12345678.5, True), (2, " padded ", 1e-5, False), (3, None, None, None)]
    df = spark.createDataFrame(rows, "i bigint, t string, d double, b boolean")
    path = str(tmp_path / "out.csv")
    ss.write_table(ss.mark_duplicates(df, "t"), path)
    written = "".join(open(p).read() for p in glob.glob(path + "/part-*"))
    assert "12345678.5" in written and "1e-05" in written and "duplicate" not in written
    assert sorted(map(tuple, ss.read_table(spark, path).collect())) == rows


@pytest.mark.parametrize("ending", ["json", "parquet", "orc"])
def test_other_formats(spark, tmp_path, ending):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "i bigint, t string")
    path = str(tmp_path / f"out.{ending}")
    ss.write_table(df, path)
    assert sorted(map(tuple, ss.read_table(spark, path).select("i", "t").collect())) == [(1, "a\nb"), (2, None)]


def test_marks_are_kept_on_request(spark, tmp_path):
    df = ss.trim(spark.createDataFrame([(" a",)], "t string"), "t", flags=True)
    ss.write_table(df, str(tmp_path / "a.parquet"), keep_marks=True)
    assert ss.read_table(spark, str(tmp_path / "a.parquet")).columns == ["t", "t__modified"]


def test_workbooks_cannot_be_written(spark, tmp_path):
    with pytest.raises(ValueError, match="issue_report"):
        ss.write_table(spark.range(1), str(tmp_path / "a.xlsx"))


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows):
    """A small workbook: shared texts, inline texts, numbers, truth values, gaps."""
    shared, body = [], ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, value in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if value is None:
                continue
            if isinstance(value, bool):
                cells += f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
            elif isinstance(value, tuple):
                cells += f'<c r="{at}" s="{value[1]}"><v>{value[0]}</v></c>'
            elif isinstance(value, (int, float)):
                cells += f'<c r="{at}"><v>{value}</v></c>'
            elif value.startswith("="):
                cells += f'<c r="{at}" t="str"><f>x</f><v>{value[1:]}</v></c>'
            elif len(value) % 2:
                cells += f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>'
            else:
                shared.append(value)
                cells += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
        body += f'<row r="{r}">{cells}</row>'
    texts = "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in shared)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {MAIN} xmlns:r="{LINKS}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId7" Target="worksheets/sheet9.xml"/></Relationships>',
        )
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/>'
            f'<numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/>'
            f'<xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{texts}</sst>")
        book.writestr("xl/worksheets/sheet9.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    head = ("name", "size", "ok")
    workbook(tmp_path / "a.xlsx", [head, ("Anna", 1.5, True), (None, 2, None), ("=sum", None, False)])
    workbook(tmp_path / "b.xlsx", [head, ("Bob", 3, True)])
    df = ss.read_table(spark, str(tmp_path), "xlsx")
    assert df.columns == ["name", "size", "ok", "source_path", "source_row"]
    rows = [(r.name, r.size, r.ok, r.source_row) for r in df.orderBy("source_path", "source_row").collect()]
    assert rows == [("Anna", 1.5, True, 2), (None, 2.0, None, 3), ("sum", None, False, 4), ("Bob", 3.0, True, 2)]
    assert ss.read_table(spark, str(tmp_path / "b.xlsx")).count() == 1
    workbook(tmp_path / "c.xlsx", [("other",), ("x",)])
    with pytest.raises(ValueError, match="different headers"):
        ss.read_table(spark, str(tmp_path), "xlsx")


def test_workbook_rows_wider_than_the_header_are_not_cut(spark, tmp_path):
    workbook(tmp_path / "w.xlsx", [("a",), ("1", "2")])
    with pytest.raises(Exception, match="more cells than the header"):
        ss.read_table(spark, str(tmp_path), "xlsx", infer=False).collect()


def test_workbook_numbers_and_dates(spark, tmp_path):
    cells = ((45292, 1), (45292.5, 2), (0.25, 1), (1, 1), (45292, 3), (45292, 0), 1e-3, 12)
    workbook(tmp_path / "d.xlsx", [tuple(f"c{i}" for i in range(len(cells))), cells])
    row = ss.read_table(spark, str(tmp_path), "xlsx", infer=False).first()
    assert tuple(row)[: len(cells)] == (
        "2024-01-01 00:00:00", "2024-01-01 12:00:00", "06:00:00", "1900-01-01 00:00:00", "45292", "45292", "0.001", "12",
    )


def test_work_folder_comes_from_the_session(spark):
    assert work_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_local_sessions_are_asked_for_a_folder_too(spark):
    class Context:
        master = "local[2]"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        work_folder(Session())


# ---------------------------------------------------------------- nothing is lost in CSV


def _csv(tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    return str(tmp_path / "a.csv")


@pytest.mark.parametrize("schema", [None, "a int, b string"])
def test_surplus_cells_stop_the_query(spark, tmp_path, schema):
    path = _csv(tmp_path, "a,b\n1,x\n2,y,LOST\n3\n4,,\n")
    with pytest.raises(Exception, match="more cells"):
        ss.read_table(spark, path, schema=schema).collect()
    with pytest.raises(Exception, match="more cells"):
        ss.read_table(spark, path, schema="a int, b string").select("a").collect()
    lenient = ss.read_table(spark, path, schema="a int, b string", on_bad="null")
    assert [tuple(r) for r in lenient.collect()] == [(1, "x"), (2, "y"), (3, None), (4, None)]
    with pytest.raises(Exception, match="more cells"):
        ss.read_table(spark, path, schema="a int, b string").count()
    assert lenient.count() == 4
    bad = ss.bad_lines(spark, path).collect()
    assert [(r.line, r.cells) for r in bad] == [("2,y,LOST", 3), ("4,,", 3)]
    assert all(r.file.endswith("a.csv") for r in bad)


def test_fewer_cells_are_missing(spark, tmp_path):
    path = _csv(tmp_path, 'a,b,c\n1,"x, y"\n2,"a ""q"", b",z\n')
    assert [tuple(r) for r in ss.read_table(spark, path).collect()] == [(1, "x, y", None), (2, 'a "q", b', "z")]


def test_line_breaks_in_quotes_are_kept(spark, tmp_path):
    path = _csv(tmp_path, 'a,b\n1,"x\ny"\n2,"p, q"\n')
    assert [tuple(r) for r in ss.read_table(spark, path).collect()] == [(1, "x\ny"), (2, "p, q")]
    assert ss.read_table(spark, path, multi_line=False, on_bad="null").count() == 3


@pytest.mark.parametrize("cell, kind", [("abc", "int"), ("1.5", "bigint"), ("maybe", "boolean"), ("1,5", "double")])
def test_cells_that_do_not_fit_stop_the_query(spark, tmp_path, cell, kind):
    path = _csv(tmp_path, f'a,b\n"{cell}",x\n,y\n')
    with pytest.raises(Exception, match="in column 'a'"):
        ss.read_table(spark, path, schema=f"a {kind}, b string").select("b").collect()
    rows = ss.read_table(spark, path, schema=f"a {kind}, b string", on_bad="null").collect()
    assert [tuple(r) for r in rows] == [(None, "x"), (None, "y")]


def test_whole_numbers_beyond_64_bits_stay_text(spark, tmp_path):
    path = _csv(tmp_path, "a,b\n123456789012345678901,1\n123456789012345678902,2\n")
    df = ss.read_table(spark, path)
    assert df.dtypes == [("a", "string"), ("b", "bigint")]
    assert [r.a for r in df.collect()] == ["123456789012345678901", "123456789012345678902"]


def test_csv_streams_read_as_batches_do(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _csv(tmp_path / "in", 'a,b,c\n1,NA,"x\ny"\n 2 ,1e3,None\n')
    schema = "a int, b double, c string"
    found = drain(read_stream(spark, str(tmp_path / "in"), "csv", schema), tmp_path)
    batch = ss.read_table(spark, str(tmp_path / "in" / "a.csv"), schema=schema)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect())) == [(1, None, "x\ny"), (2, 1000.0, None)]


# ---------------------------------------------------------------- streams


@pytest.fixture
def stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, f" Name {i % 5}\t", start + datetime.timedelta(minutes=i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, t string, ts timestamp, d double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return read_stream(spark, str(tmp_path / "in"), "parquet", df.schema)


def drain(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


# Every operation that is a projection, with what it needs to be one.
ON_STREAMS = [
    {"key": "op_trim", "column": "t"},
    {"key": "op_upper", "column": "t"},
    {"key": "op_lower", "column": "t"},
    {"key": "op_title", "column": "t"},
    {"key": "op_find_replace", "column": "t", "find_text": "a", "replace_text": "b"},
    {"key": "op_remove_specific", "column": "t", "chars_to_remove": "x"},
    {"key": "op_fill_missing", "column": "t", "fill_value": "0"},
    {"key": "op_extract_pattern", "column": "t", "pattern": r"\d", "new_col_name": "n"},
    {"key": "op_concatenate", "cols_to_concat": ["t", "n"], "separator": "-", "new_col_name": "c"},
    {"key": "op_merge_columns", "cols_to_merge": ["t", "n"], "separator": "-", "new_col_name": "m"},
    {"key": "op_rename_column", "column": "c", "new_col_name": "joined"},
    {"key": "op_split_delimiter", "column": "joined", "delimiter": "-", "n_parts": 2},
    {"key": "op_split_surname", "column": "m"},
    {"key": "op_round_numbers", "column": "d", "decimals": 0},
    {"key": "op_calculate_column_constant", "column": "d", "operation": "*", "constant_value": 2},
    {"key": "op_create_calculated_column", "column": "d", "col2_name": "id", "operation": "+", "new_col_name": "e",
     "decimals": 1},
    *[{"key": f"op_validate_{k}", "column": "t"} for k in ("email", "phone", "date", "numeric", "alphanumeric", "url")],
    {"key": "op_mask_words", "column": "t"},
    {"key": "op_mask_email", "column": "t"},
    {"key": "op_remove_non_alpha", "column": "t"},
    {"key": "op_remove_non_numeric", "column": "n"},
    {"key": "op_mask", "column": "t"},
]


def test_projections_run_on_a_stream(spark, stream, tmp_path):
    recipe = ss.Recipe(ON_STREAMS)
    found = drain(apply_recipe(stream, recipe, flags=True), tmp_path)
    batch = spark.read.parquet(str(tmp_path / "in"))
    expected = recipe.apply(batch, flags=True)
    assert found.columns == expected.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_first_arrival_keeps_the_types(spark, stream, tmp_path):
    local = stream.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept = drop_duplicates(local, "t", event_time="ts", within="1 day")
    assert kept.schema.simpleString() == local.schema.simpleString()
    rows = {tuple(r) for r in spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()}
    found = drain(kept, tmp_path).collect()
    assert len(found) == 5 and {tuple(r) for r in found} <= rows


def test_first_arrival_on_a_stream(stream, tmp_path):
    kept = drop_duplicates(stream.withColumn("k", F.col("id") % 5), "k", event_time="ts", within="1 day")
    assert sorted(r.k for r in drain(kept.select("k"), tmp_path).collect()) == [0, 1, 2, 3, 4]


def _timed(spark, folder, rows, files=1):
    """(key, seconds or None, order) rows as a stream, ``files`` files read one after another."""
    start = datetime.datetime(2024, 1, 1)
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        part = [(k, None if s is None else start + datetime.timedelta(seconds=s), o) for k, s, o in rows[i : i + step]]
        df = spark.createDataFrame(part, "k string, at timestamp, o int").coalesce(1)
        df.write.mode("append").parquet(str(folder / "in"))
    reader = spark.readStream.option("maxFilesPerTrigger", 1).schema(df.schema)
    return reader.parquet(str(folder / "in"))


@pytest.mark.parametrize("files", [1, 4])
def test_first_by_order_is_the_batch_result(spark, tmp_path, files):
    rows = [(["a", "b", None, "hot"][min(i % 7, 3)], i, (i * 37) % 101) for i in range(100)]
    rows.append(("end", 10_000, 0))  # lets the watermark pass all others
    stream = _timed(spark, tmp_path, rows, files)
    found = drain(first_by_order(stream, "k", "o", event_time="at", within="1 hour"), tmp_path)
    assert found.columns == ["k", "at", "o"]
    batch = ss.remove_duplicates(spark.read.parquet(str(tmp_path / "in")), "k", "o").where("k is null or k <> 'end'")
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    assert found.count() == 4


def test_first_by_order_by_runs(spark, tmp_path):
    """Rows ten minutes apart or more are another run; runs that may still grow are held back."""
    rows = [("a", 0, 5), ("a", 300, 2), ("a", 800, 9), ("a", 3000, 7), ("a", 3100, 8), ("b", 4200, 1)]
    stream = _timed(spark, tmp_path, rows)
    found = drain(first_by_order(stream, "k", "o", event_time="at", within="10 minutes"), tmp_path)
    assert sorted(r.o for r in found.collect()) == [2]
    assert found.schema == stream.schema


def test_first_by_order_reduces_before_the_shuffle(spark, tmp_path):
    rows = [("hot", i, i) for i in range(2000)] + [("end", 100_000, 0)]
    stream = first_by_order(_timed(spark, tmp_path, rows), "k", "o", event_time="at", within="1 hour")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    started = query.trigger(availableNow=True).start(str(tmp_path / "out"))
    started.awaitTermination()
    states = [p["stateOperators"][0]["numRowsUpdated"] for p in started.recentProgress if p["stateOperators"]]
    assert "MergingSessions" in started._jsq.explainInternal(False)
    assert max(states) <= 2


def test_first_by_order_problems(spark, stream, tmp_path):
    with pytest.raises(ValueError, match="order_by"):
        first_by_order(stream, "t", [], event_time="ts", within="1 day")
    with pytest.raises(ValueError, match="x"):
        first_by_order(stream, "t", "x", event_time="ts", within="1 day")
    (tmp_path / "timeless").mkdir()
    bad = _timed(spark, tmp_path / "timeless", [("a", None, 1), ("a", 3, 2)])
    with pytest.raises(Exception, match="a row has no at"):
        drain(first_by_order(bad, "k", "o", event_time="at", within="1 hour"), tmp_path / "timeless")


def test_first_by_order_with_local_times_and_clashing_names(spark, tmp_path):
    rows = _timed(spark, tmp_path, [("a", 1, 2), ("a", 2, 1), ("end", 90_000, 0)])
    named = rows.select(F.col("k").alias("__row"), F.col("at").cast("timestamp_ntz").alias("__at"), F.col("o").alias("__key0"))
    found = drain(first_by_order(named, "__row", "__key0", event_time="__at", within="1 hour"), tmp_path)
    assert found.schema == named.schema
    assert [(r[0], r[2]) for r in found.collect()] == [("a", 1)]


@pytest.mark.parametrize(
    "run",
    [
        lambda s: ss.mark_duplicates(s, "t"),
        lambda s: ss.remove_duplicates(s, "t", order_by="id"),
        lambda s: ss.distinct_group(s, "t"),
        lambda s: ss.distinct_codes(s, "t"),
        lambda s: ss.slice_rows(s, "head", order_by="id"),
        lambda s: ss.split_delimiter(s, "t", " "),
        lambda s: ss.calculated_column(s, "d", "d", "+", "x"),
        lambda s: ss.round_numbers(s, "d", check=True),
    ],
)
def test_whole_table_operations_refuse_streams(stream, run):
    with pytest.raises(ValueError, match="stream"):
        run(stream)


def test_apply_recipe_wants_a_stream(spark):
    with pytest.raises(ValueError, match="not a stream"):
        apply_recipe(spark.range(1), ss.Recipe())
