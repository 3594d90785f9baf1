from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioforge.sources import arrivals, files

START = datetime(2024, 1, 1)
ARRIVAL = "path string, modified timestamp, content binary"


def arrive(spark, folder, rows):
    made = [(path, None if hour is None else START + timedelta(hours=hour), None if text is None else bytearray(text, "utf-8")) for path, hour, text in rows]
    spark.createDataFrame(made, ARRIVAL).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_file_that_changes_twice_is_one_row(spark, tmp_path):
    folder, log, at = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "checkpoint")
    arrive(spark, folder, [("a", 1, "one"), ("b", 1, "same"), (None, 1, "x"), ("c", None, "x"), ("d", 1, None)])
    stream = lambda: spark.readStream.schema(ARRIVAL).parquet(str(folder))
    arrivals.follow(stream(), log, at)
    arrive(spark, folder, [("a", 3, "three"), ("a", 2, "two"), ("b", 2, "same"), ("b", 2, "same")])
    arrivals.follow(stream(), log, at)
    arrive(spark, folder, [("a", 2, "late"), ("d", 4, "")])
    arrivals.follow(stream(), log, at)
    rows = spark.read.parquet(log).orderBy("path", "version").collect()
    assert [(r.path, r.version, r.change, r.length) for r in rows] == [("a", 1, "added", 3), ("a", 2, "changed", 3), ("a", 3, "changed", 5), ("b", 1, "added", 4), ("d", 1, "added", 0)]
    now = arrivals.current(spark.read.parquet(log)).orderBy("path").collect()
    assert [(r.path, r.version, r.length) for r in now] == [("a", 3, 5), ("b", 1, 4), ("d", 1, 0)]


def test_large_files_are_never_opened(spark, tmp_path):
    """Spark's reader refuses to read files above its own bound; ours lists them with their length."""
    (tmp_path / "small.txt").write_text("hello")
    with (tmp_path / "large.txt").open("wb") as f:
        f.truncate(40 << 20)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(31 << 20))
    try:
        rows = {r.path[-9:]: (r.length, r.content, r.error) for r in files.read_files(spark, str(tmp_path)).select("path", "length", "content", files.size_error(F.col("length")).alias("error")).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows == {"small.txt": (5, bytearray(b"hello"), None), "large.txt": (40 << 20, None, "FILE_TOO_LARGE")}
