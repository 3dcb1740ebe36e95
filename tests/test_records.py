"""CSV files with line breaks in quotes, cut into records by many tasks."""

import random

import pytest

import sparkscrub as ss
from sparkscrub.sources import records
from sparkscrub.sources.records import QuoteCounts, quoted_records


@pytest.fixture
def small_blocks(spark):
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(setting, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _both(spark, path, **options):
    """As cut by blocks, and as Spark's own reader finds it with one task per file."""
    return [_rows(ss.read_table(spark, path, "csv", infer=False, multi_line=m, **options)) for m in (None, True)]


def _cell(rng):
    text = "".join(rng.choice(["a", "ß", ",", '"', "\n", "\n\n", " ", "word "]) for _ in range(rng.randint(0, 12)))
    if any(c in text for c in ',"\n') or rng.random() < 0.2:
        return '"' + text.replace('"', '""') + '"'
    return text


@pytest.mark.parametrize("seed", range(6))
def test_random_files_equal_the_single_task(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    for name in ("a", "b", "c"):
        # With a bare line break in the names, Spark's reader takes Windows line ends for text.
        end = "\n" if seed % 2 else rng.choice(["\n", "\r\n"])
        lines = [f"id,{'\"first\nname\"' if seed % 2 else 'first'},x"] + [f"{i},{_cell(rng)},{_cell(rng)}" for i in range(400)]
        (tmp_path / f"{name}.csv").write_text(end.join(lines) + (end if rng.random() < 0.7 else ""), newline="")
    found, expected = _both(spark, str(tmp_path))
    assert len(found) == 1200 and found == expected


def test_as_many_tasks_as_blocks(spark, tmp_path, small_blocks):
    lines = ["id,text"] + [f'{i},"line one of {i}\nline two, with ""quotes"""' for i in range(500)]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines))
    counts = QuoteCounts(spark, str(path))
    assert counts.any_open and len(counts.opens) >= path.stat().st_size // 1024
    assert 0 < sum(counts.opens.values()) < len(counts.opens)
    found = quoted_records(spark, str(path), counts)
    # One part file per task that cut, none of them holds more than a few blocks.
    parts = {f.rsplit("/", 1)[1].split("-")[1] for f in found.inputFiles()}
    assert len(parts) >= 8
    assert found.where("NOT first").count() == 500 and found.where("first").count() == 1
    assert found.select("record").where("record LIKE '7,%'").first()[0] == '7,"line one of 7\nline two, with ""quotes"""'


def test_a_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}" for i in range(1000))
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{long}"\n2,x\n3,"{long}"\n')
    found, expected = _both(spark, str(tmp_path / "t.csv"))
    assert found == expected == [("1", long), ("2", "x"), ("3", long)]


@pytest.mark.parametrize(
    "text",
    [
        'a,b\n1,5" pipe\n2,"x\ny"\n3,6" pipe\n4,z\n',  # quotes inside of bare cells
        'a,b\n1,5",\n2,"x\ny"\n',
        'a,b\n1,"x" y\n2,"x\ny"\n',
        'a,b\n1,"x\n2,y\n',  # never closed
        'a,b\r1,"x\ry"\r2,z\r',  # old line ends
    ],
)
def test_odd_quotes_are_left_to_the_single_task(spark, tmp_path, small_blocks, text):
    (tmp_path / "t.csv").write_text(text, newline="")
    path = str(tmp_path / "t.csv")
    assert quoted_records(spark, path, QuoteCounts(spark, path)) is None
    found, expected = _both(spark, path, on_bad="null")
    assert found == expected


def test_surplus_cells_and_blank_lines(spark, tmp_path, small_blocks):
    (tmp_path / "t.csv").write_text('\n\na,b\n\n1,"x\ny"\n\n2,"p\nq",lost\n')
    path = str(tmp_path / "t.csv")
    with pytest.raises(Exception, match="more cells than the header, in .*t.csv"):
        ss.read_table(spark, path).collect()
    assert _rows(ss.read_table(spark, path, on_bad="null")) == [(1, "x\ny"), (2, "p\nq")]
    bad = ss.bad_lines(spark, path).collect()
    assert [(r.line, r.cells) for r in bad] == [('2,"p\nq",lost', 3)] and bad[0].file.endswith("t.csv")


def test_other_blocks_than_counted_are_noticed(spark, tmp_path, small_blocks):
    """The blocks of a file may differ between two passes; then both are made again."""
    lines = ["id,text"] + [f'{i},"one\ntwo"' for i in range(3000)]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    counts = QuoteCounts(spark, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    assert quoted_records(spark, str(path), counts).count() == 3001
    attempts, records._ATTEMPTS = records._ATTEMPTS, 1
    try:
        assert quoted_records(spark, str(path), counts) is None
    finally:
        records._ATTEMPTS = attempts


def test_records_over_blocks_are_joined_each_on_its_own(spark, tmp_path, small_blocks):
    """No task sees all fragments of a file: they are grouped by the block in which their record begins."""
    lines = ["id,text"] + [f'{i},"' + "\n".join(f"{i} line {k}" for k in range(i % 90)) + '"' for i in range(300)]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines))
    counts = QuoteCounts(spark, str(path))
    assert len(counts.begun) == len(counts.opens) and len(set(counts.begun.values())) > 20
    found = quoted_records(spark, str(path), counts)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "begun" in plan
    assert sorted(r["record"] for r in found.collect()) == sorted(lines)


def test_the_file_of_split_quotes_is_bounded(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_CSV_FILE_BYTES", 1 << 16)
    parts = []
    write = ss.write_table
    monkeypatch.setattr(ss, "write_table", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or write(df, *a))
    monkeypatch.setattr(entry, "_table", lambda s, d, name: ss.read_table(s, f"{d}/{name}.parquet").repartition(8))
    folder = "/root/testdata/sf0.001"
    found = entry.queries()["csv_split_quotes"](spark, folder)
    documents = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert parts[0] > 1 and sorted(r[:5] for r in found.collect()) == sorted(tuple(r) for r in documents)
