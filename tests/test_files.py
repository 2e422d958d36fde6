import gzip

import pytest
from pyspark.sql import functions as F

from tidewright.sources import delimited, files, named_files

SCHEMA = "station string, date date, conductivity_mS_per_m double"


def put(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def rows(df):
    return sorted((tuple(str(x) if x is not None else None for x in r) for r in df.collect()), key=str)


def test_reordered_extra_missing_and_marked_columns(spark, tmp_path):
    folder = put(
        tmp_path,
        a="station,date,conductivity_mS_per_m\nA,2001-01-02,1.5\n",
        b="\ufeffdate,station,conductivity_mS_per_m\n2001-01-02,B,2.5\n",
        c='date,note,station,conductivity_mS_per_m,tail\n2001-01-02,"x, ""y""",C,3.5,z\n',
        d="station,date\nD,2001-01-02\n",
        e="",
        f="station,date,conductivity_mS_per_m\n",
        g="\n\nconductivity_mS_per_m,station,date\n4.5,G,2001-01-02\n",
    )
    (tmp_path / "h [x] y.csv.gz").write_bytes(gzip.compress(b"date,conductivity_mS_per_m,station\n2001-01-02,NaN,H\n2001-01-03,N/A,None\n"))
    want = [("A", "1.5"), ("B", "2.5"), ("C", "3.5"), ("D", None), ("G", "4.5"), ("H", None)]
    got = rows(files.read_csv(spark, folder, "*.csv*", SCHEMA))
    assert got == sorted([(s, "2001-01-02", v) for s, v in want] + [(None, "2001-01-03", None)], key=str)
    assert len(delimited.headers(spark, folder, "*.csv*")) == 6
    assert rows(files.read_csv(spark, folder, "*.csv*", SCHEMA, exclude=("b.csv", "[x]")).select("station")) == [("A",), ("C",), ("D",), ("G",)]
    with pytest.raises(ValueError, match="no \\['conductivity_mS_per_m'\\] in .*d.csv"):
        files.read_csv(spark, folder, "*.csv", SCHEMA, required=("conductivity_mS_per_m",))
    none = files.read_csv(spark, folder, "none*.csv", SCHEMA, file_column="file")
    assert none.columns == ["station", "date", "conductivity_mS_per_m", "file"] and none.count() == 0


def test_synonyms_and_dates_are_resolved_for_each_header(spark, tmp_path):
    folder = put(
        tmp_path,
        a="wse,station,time\n1.5,A,2001-01-01\n",
        b="station,valid_time,water_level\nB,2001-01-02,2.5\n",
        c="station,water_level_m,MeasureDate\nC,3.5,2001-01-03\n",
        d="station,time,valid_time,water_level\nD,2001-01-04,1999-01-01,4.5\n",
    )
    schema, synonyms = "station string, date date, water_level_m double", {"water_level_m": ("wse", "water_level"), "date": ("time", "valid_time")}
    got = rows(files.read_csv(spark, folder, "*.csv", schema, synonyms=synonyms, date="date", prefer=True))
    assert got == [(s, f"2001-01-0{k}", f"{k}.5") for k, s in enumerate("ABCD", 1)]
    with pytest.raises(ValueError, match="more than one column for date"):
        files.read_csv(spark, folder, "d.csv", schema, synonyms=synonyms)
    with pytest.raises(ValueError, match="one column for more than one"):
        delimited.positions(("date",), ["station", "date"], {"station": ("date",)})
    assert delimited.positions(("x", "y"), ["date"], date="date") == {"date": 0}
    with pytest.raises(ValueError, match="more than one column for x"):
        delimited.positions(("x", "x"), ["x"])


def test_columns_reach_the_scan_by_header(spark, tmp_path):
    folder = put(tmp_path, a="station,date,conductivity_mS_per_m\nA,2001-01-02,1.5\n", b="date,station\n2001-01-02,B\n")
    plan = files.read_csv(spark, folder, "*.csv", SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "Python" not in plan


def test_quarantine_counts_in_one_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = put(
        tmp_path / "in",
        a="station,date,conductivity_mS_per_m\nA,2001-01-02,1.5\nA,yesterday,1\nA,2001-01-02,x\nA,2001-01-02,NA\n",
        b='date,station,conductivity_mS_per_m\n2001-01-02,"B, b",2.5\n2001-01-02,B\n2001-01-02,B,1,2\nnever,"q ""q""",none\n',
        c="station,date\nC,2001-01-02\n",
    )
    checked = files.read_checked(spark, folder, "*.csv", SCHEMA)
    assert checked.count() == 9
    spark.sparkContext.setJobGroup("quarantine", "one pass")
    sound, others, counts = files.quarantined(checked, str(tmp_path / "out"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("quarantine")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    by_file = {k.rpartition("/")[2]: n for k, n in counts.items()}
    assert by_file == {"rows": 9, "wrong": 5, "a.csv": 2, "b.csv": 3, "c.csv": 0}
    assert rows(sound.select("station", "conductivity_mS_per_m")) == [("A", "1.5"), ("A", None), ("B, b", "2.5"), ("C", None)]
    want = [("columns", "2001-01-02,B"), ("columns", "2001-01-02,B,1,2"), ("conductivity_mS_per_m", "A,2001-01-02,x"), ("date", "A,yesterday,1"), ("date,conductivity_mS_per_m", 'never,"q ""q""",none')]
    assert rows(others.select("wrong", "line")) == want
    assert {r.wrong for r in others.collect()} == {w for w, _ in want}


@pytest.mark.parametrize("bom", [True, False])
def test_named_files_round_trip(spark, tmp_path, bom):
    data = [(f"s{k % 5}", k, None if k % 7 == 0 else f'text, "{k}"', k / 4) for k in range(300)]
    df = spark.createDataFrame(data, "station string, id long, note string, value double").repartition(7)
    name = F.concat(F.lit("level_"), "station", F.lit("_id"), F.substring("station", 2, 9), F.lit(".csv"))
    named_files.write_named(df, str(tmp_path / "out"), name, ["id"], bom=bom)
    found = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert found == [f"level_s{k}_id{k}.csv" for k in range(5)]
    text = (tmp_path / "out" / found[0]).read_text(encoding="utf-8")
    assert text.startswith("\ufeff" * bom + "station,id,note,value\n") and text.index("s0,5,") < text.index("s0,10,")
    assert rows(files.read_csv(spark, str(tmp_path / "out"), "*.csv", df.schema)) == rows(df)


def test_named_files_appear_together_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.createDataFrame([(f"f{k % 4}.csv", k) for k in range(40)], "file string, id long")
    broken = df.withColumn("id", F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        named_files.write_named(broken, str(out), "file")
    assert not out.exists() or list(out.iterdir()) == []
    named_files.write_named(df, str(out), "file", ["id"])
    before = {p.name: p.read_text() for p in out.iterdir()}
    with pytest.raises(Exception, match="broken"):
        named_files.write_named(broken, str(out), "file")
    with pytest.raises(Exception, match="FileExistsError"):
        named_files.write_named(df.filter("id < 3"), str(out), "file", overwrite=False)
    assert {p.name: p.read_text() for p in out.iterdir()} == before
    named_files.write_named(df.filter("id = 4"), str(out), "file")  # replaces one file, and leaves the others
    assert (out / "f0.csv").read_text() == "id\n4\n" and (out / "f1.csv").read_text() == before["f1.csv"]
    with pytest.raises(Exception, match="is no file name"):
        named_files.write_named(df.withColumn("file", F.lit("../x.csv")), str(out), "file")
    named_files.write_named(df.limit(0), str(tmp_path / "none"), "file")
    assert not (tmp_path / "none").exists() or list((tmp_path / "none").iterdir()) == []


def test_named_files_split_between_tasks_are_refused(spark, tmp_path):
    spark.dataSource.register(named_files.NamedFiles)
    lines = spark.range(8, numPartitions=4).selectExpr("'a.csv' as file", "cast(id as string) as line")
    with pytest.raises(Exception, match="two tasks wrote"):
        lines.write.format("named_files").option("path", str(tmp_path / "x")).mode("append").save()
    assert not (tmp_path / "x").exists() or list((tmp_path / "x").iterdir()) == []
