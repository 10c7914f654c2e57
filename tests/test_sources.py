import pytest
from pyspark.sql import functions as F

from logloom.operators.parse import parse_lines, with_row_ids
from logloom.sources import log_table, tabular, text_lines


def lines_of(df):
    return [r["line"] for r in df.orderBy("line").collect()]


def access_rows(n=30):
    methods, paths, codes = ["GET", "POST", "PUT", "DELETE"], ["/a", "/b", "/c", "/d"], [200, 404, 500, 201]
    return "\n".join(
        f'10.0.0.{i},-,user{i},[{18 + i % 10}/Jul/2024:10:00:{i:02d},+0530],"{methods[i % 4]} {paths[i % 4]} HTTP/1.1",{codes[i % 4]},{i * 10},-,"Mozilla/5.0",{50 + i}'
        for i in range(n)
    )


def test_text_lines_are_numbered_per_file_across_splits(spark, tmp_path):
    first = [f"line {i}" if i % 7 else "" for i in range(1, 4001)]
    (tmp_path / "a.log").write_text("\n".join(first) + "\n")
    (tmp_path / "b.log").write_text("only\r\n\r\n  last  \n")
    (tmp_path / "c.log").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text_lines.read_lines(spark, str(tmp_path), "*.log").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r["line_number"]: r["line"] for r in got if r["source_file"] == "a.log"}
    assert a == {i: t for i, t in enumerate(first, 1) if t}
    assert sorted((r["line_number"], r["line"]) for r in got if r["source_file"] == "b.log") == [(1, "only"), (3, "last")]


def test_formats(spark):
    names = ["x.LOG", "a/b.txt", "t.tsv", "u.CSV", "w.xlsm", "p.pdf", "noending", "odd.bin"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    want = ["log", "log", "csv", "csv", "excel", "pdf", "log", "log"]
    assert [r[0] for r in df.select(text_lines.detect_format(F.col("p"))).collect()] == want
    assert [text_lines.format_of(n) for n in names] == want


def test_access_csv(spark, tmp_path):
    (tmp_path / "log_files.csv").write_text(access_rows())
    rows = tabular.read_csv_lines(spark, str(tmp_path / "log_files.csv"))
    got = lines_of(rows)
    assert len(got) == 30
    assert "2024-07-18 10:00:00 INFO user0 GET /a status=200 bytes=0 rt=50ms" in got
    assert sum(" ERROR " in l for l in got) == sum(1 for i in range(30) if i % 4 == 2)
    assert {r["http_status"] for r in rows.collect()} == {200, 404, 500, 201}


def test_access_edge_rows(spark):
    row = ("1.1.1.1", "-", "u", "[bad", "+0]", None, "x", "7", "-", "-", None)
    df = spark.createDataFrame([row], tabular.ACCESS_CSV)
    assert lines_of(tabular.access_lines(df)) == ["[bad +0] INFO u nan / status=x bytes=7 rt=0ms"]
    df = spark.createDataFrame([row[:5] + ("",) + row[6:]], tabular.ACCESS_CSV)
    assert " UNKNOWN / " in lines_of(tabular.access_lines(df))[0]


def test_telemetry_csv(spark, tmp_path):
    head = "Timestamp,Anomaly_ID,Anomaly_Type,Severity,Status,Source,Response_Time_ms,Error_Code"
    body = "\n".join(f"2024-01-01 00:00:{i:02d},A{i},{'DB Timeout' if i % 5 else ''},{['Low', 'Medium', 'High', 'Critical'][i % 4]},Open,svc{i % 4},{i}.5,{500 if i % 3 == 0 else 0}" for i in range(25))
    (tmp_path / "t.csv").write_text(head + "\n" + body)
    got = lines_of(tabular.route(spark, str(tmp_path / "t.csv")))
    assert len(got) == 25 and sum(" ERROR " in l for l in got) == 6 and sum(" FATAL " in l for l in got) == 6
    assert got[1] == "2024-01-01 00:00:01 WARN svc1 anomaly_type=DB Timeout status=Open host= error_code=0 rt=1.5ms cpu=0% mem=0MB disk=0% svc= id=A1"
    rows = spark.read.csv(str(tmp_path / "t.csv"), header=True)
    for name in ("CPU_Usage_Percent", "Memory_Usage_MB", "Disk_Usage_Percent", "Service_Type"):
        rows = rows.withColumn(name, F.lit("1"))
    records = {r["template_id"]: r for r in tabular.labelled_records(rows).collect()}
    assert len(records) == 20 and records["ANOMALY_A3"]["error_rate"] == 1.0 and records["ANOMALY_A2"]["error_rate"] == 0.0
    assert records["ANOMALY_A3"]["template_str"].startswith("DB Timeout anomaly on svc3 service. Severity=critical. ErrorCode=500.")
    assert records["ANOMALY_A3"]["avg_volatility"] == 3.5


def test_generic_rows(spark, tmp_path):
    (tmp_path / "g.csv").write_text(
        'timestamp,level,service,message,extra\n2024-01-01,,api,hello,-\n2024-01-02,WARN,,' + "x" * 90 + ',nan\n,ERROR,db,,None\n'
    )
    got = lines_of(tabular.route(spark, str(tmp_path / "g.csv")))
    assert got == [" ERROR db ", "2024-01-01  api message=hello", "2024-01-02 WARN  message=" + "x" * 90]
    df = spark.createDataFrame([("v", "y" * 300)], "a string, b string")
    assert lines_of(tabular.row_lines(df)) == [" INFO unknown a=v b=" + "y" * 300]
    assert lines_of(tabular.row_lines(df, value_cap=200)) == [" INFO unknown a=v b=" + "y" * 200]


def test_sheets_and_pages(spark):
    logs = spark.createDataFrame([("t1", "WARN", "auth", "m", 5)], "Timestamp string, Level string, Service string, Message string, `a=b` int")
    other = spark.createDataFrame([("t2", "High", "DB")], "` Time ` string, Severity string, Kind string")
    got = tabular.sheet_lines({"SystemLogs": logs, "Anomalies": other}).orderBy("sheet").collect()
    assert [tuple(r) for r in got] == [("Anomalies", "t2 High excel_Anomalies Kind=DB"), ("SystemLogs", "t1 WARN auth Message=m 5")]
    pages = spark.createDataFrame([(1, " one \n\n two\r\nthree"), (2, "")], "page int, text string")
    assert lines_of(tabular.page_lines(pages)) == ["pdf_page=1 INFO pdf_source one", "pdf_page=1 INFO pdf_source three", "pdf_page=1 INFO pdf_source two"]
    cells = spark.createDataFrame([(1, ["a", None, " ", "b"]), (1, [None, ""])], "page int, cells array<string>")
    assert lines_of(tabular.cell_lines(cells)) == ["pdf_page=1 INFO pdf_table a | b"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.csv").write_text("x,y\n3,4\n")
    (tmp_path / "d.csv").write_text(access_rows(3))
    (tmp_path / "_skip.log").write_text("hidden\n")
    (tmp_path / "e.bin").write_text("no\n")
    rows = tabular.route_folder(spark, str(tmp_path))
    assert {r["source_file"]: r["count"] for r in rows.groupBy("source_file").count().collect()} == {"a.log": 2, "b.csv": 1, "c.csv": 1, "d.csv": 3}
    empty = tmp_path / "empty"
    empty.mkdir()
    assert tabular.route_folder(spark, str(empty)) is None
    with pytest.raises(ValueError):
        tabular.route(spark, "book.xlsx")


def test_append_twice_and_resume(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text("".join(f"2024-01-0{1 + i % 3} 00:00:00 INFO m{i}\n" for i in range(100)))
    table = str(tmp_path / "logs")
    rows = lambda: with_row_ids(parse_lines(text_lines.read_lines(spark, str(source))))
    log_table.append(rows(), table)
    log_table.append(rows(), table)
    assert spark.read.parquet(table).count() == 100
    assert log_table.unseen_lines(rows(), spark.read.parquet(table)).count() == 0
    (source / "a.log").write_text((source / "a.log").read_text() + "2024-01-04 00:00:00 INFO more\n")
    (source / "b.log").write_text("2024-01-04 00:00:00 INFO other\n")
    fresh = log_table.unseen_lines(rows(), spark.read.parquet(table))
    assert sorted((r["source_file"], r["line_number"]) for r in fresh.collect()) == [("a.log", 101), ("b.log", 1)]


def test_scan_order_reports_and_feature_files(spark, tmp_path):
    from logloom.schema import FEATURE_SCAN, LOG_SCHEMA

    rows = spark.createDataFrame(
        [("c", 3, None), ("a", 1, "2024-01-02"), ("b", 2, "2024-01-01")], "log_id string, line_number long, t string"
    ).withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    for field in LOG_SCHEMA:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    scan = log_table.feature_scan(rows)
    assert scan.columns == FEATURE_SCAN and [r["log_id"] for r in scan.collect()] == ["b", "a", "c"]
    assert [r["log_id"] for r in log_table.feature_scan(rows, "line_number > 1").collect()] == ["b", "c"]
    calls = []
    build = lambda: calls.append(1) or rows
    path = str(tmp_path / "features-1")
    assert log_table.features_once(build, spark, path).count() == 3 and log_table.features_once(build, spark, path).count() == 3
    assert len(calls) == 1
    report = spark.createDataFrame([(3, ["a"])], "n_anomalies long, anomaly_ids array<string>")
    log_table.save_report(report, str(tmp_path / "reports"))
    log_table.save_report(report, str(tmp_path / "reports"))
    loaded = log_table.load_reports(spark, str(tmp_path / "reports")).collect()
    assert len(loaded) == 2 and loaded[0]["report_file"] <= loaded[1]["report_file"] and loaded[0]["anomaly_ids"] == ["a"]


def test_first_rows_with_ties_and_missing_times(spark):
    from logloom.session import first_rows

    rows = spark.range(0, 5000).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("v")
    )
    order = [F.asc_nulls_last("v"), F.desc("id")]
    for n in (1, 40, 1700, 4900):
        got = [r["id"] for r in first_rows(rows, F.col("v"), order, n).collect()]
        assert got == [r["id"] for r in rows.orderBy(*order).limit(n).collect()]


def test_quotes_breaks_and_separators(spark, tmp_path):
    (tmp_path / "q.csv").write_text('level,message,code\nINFO,"He said ""hi, there"", ok",7\nWARN,plain,8\n')
    (tmp_path / "b.csv").write_text('level,message,code\nINFO,"first\nsecond",7\nWARN,"plain",8\n')
    (tmp_path / "s.csv").write_text("level;message;code\nINFO;a,b;7\n")
    (tmp_path / "h.csv").write_text('"level","the, message"\nINFO,x\n')
    got = {(r["source_file"], r["line_number"]): r["line"] for r in tabular.route_folder(spark, str(tmp_path)).collect()}
    assert got == {
        ("q.csv", 1): ' INFO unknown message=He said "hi, there", ok code=7', ("q.csv", 2): " WARN unknown message=plain code=8",
        ("b.csv", 1): " INFO unknown message=first\nsecond code=7", ("b.csv", 2): " WARN unknown message=plain code=8",
        ("s.csv", 1): " INFO unknown message=a,b code=7", ("h.csv", 1): " INFO unknown the, message=x",
    }


def test_skipped_inputs_are_named(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n")
    (tmp_path / "b.xlsx").write_text("no")
    with pytest.warns(UserWarning, match="b.xlsx"):
        assert tabular.route_folder(spark, str(tmp_path)).count() == 1
