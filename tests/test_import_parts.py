import gzip
import pathlib

import pytest
from pyspark.sql import functions as F

from cohortline.plans import intake
from cohortline.sources import imports, readers, store

from .test_store_versions import HEAD, line, put


def test_keys_that_are_there_once_are_not_shuffled_as_rows(spark, tmp_path, monkeypatch):
    rows = [(2020, str(k % 40 if k < 50 else k), f"m{k}") for k in range(200)]
    path, order = str(tmp_path / "staged"), [F.col("make")]
    spark.createDataFrame(rows, "year int, sequence string, make string").write.parquet(path)
    staged, keys = spark.read.parquet(path), ["year", "sequence"]
    want = {tuple(r) for r in store.last_wins(staged, keys, order).collect()}
    for most in (1000, 3):  # few repeated keys, and too many to send
        assert {tuple(r) for r in store.once(staged, keys, order, most).select(*staged.columns).collect()} == want and len(want) == 190
    first = str(tmp_path / "v_2020.csv")
    put(tmp_path / "v_2020.csv", "\n".join([HEAD, *[line(2020, k) for k in range(9)]]))
    monkeypatch.setattr(store, "last_wins", None)  # whole rows need not be dealt by key
    table = str(tmp_path / "t")
    for _ in range(2):
        assert [(r.stored, r.dropped) for r in imports.import_files(spark, [first], table)] == [(9, 0)]
    assert [(r.stored, r.dropped) for r in imports.import_all(spark, [first], str(tmp_path / "u")).results] == [(9, 0)]
    assert spark.read.parquet(table).exceptAll(spark.read.parquet(str(tmp_path / "u"))).count() == 0 and spark.read.parquet(table).count() == 9
    assert [p.name for p in (tmp_path / "t").iterdir() if p.is_dir()] == ["year=2020"]  # nothing is left beside it


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1"])
def test_sources_in_compressed_parts(spark, tmp_path, encoding):
    """A year's source is a folder of parts, with the header in the first; both imports take it as they take a file."""
    folder = tmp_path / "v_2020.csv"
    folder.mkdir()
    (folder / "a.txt").write_bytes(f"{HEAD}\nshort\n".encode(encoding))
    for k in range(3):
        (folder / f"part-{k}.csv.gz").write_bytes(gzip.compress("\n".join(line(2020, j) for j in range(5 * k, 5 * k + 5)).encode(encoding)))
    (folder / "_SUCCESS").write_bytes(b"")
    other = put(tmp_path / "v_2021.csv", "\n".join([HEAD, line(2021, 1)]), encoding)
    one, all_, rejects = (str(tmp_path / n) for n in ("one", "all", "r"))
    assert [(r.year, r.stored, r.dropped) for r in imports.import_files(spark, [str(folder), other], one)] == [(2020, 15, 1), (2021, 1, 0)]
    assert [(r.year, r.stored, r.dropped) for r in imports.import_all(spark, [str(folder), other], all_, rejects).results] == [(2020, 15, 1), (2021, 1, 0)]
    assert spark.read.parquet(one).exceptAll(spark.read.parquet(all_)).count() == 0 and spark.read.parquet(one).count() == 16
    assert spark.read.parquet(rejects).first().line == "short"


def test_delivered_lines_are_written_where_they_are_made(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).selectExpr("cast(2000 + id % 2 as int) as y", "cast(id as string) as a")
    paths = intake.delivered(spark, rows, ("y", "a"), "y", str(tmp_path), extra="short")
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["file_2000.csv", "file_2001.csv"]
    for p in paths:
        assert sum(x.name.endswith(".gz") for x in pathlib.Path(p).iterdir()) == 4  # of each task, as it made them
        assert readers.head(spark, p).decode().splitlines()[:2] == ["y,a", "short"] and spark.read.text(p).count() == 22
