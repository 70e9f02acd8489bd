import os
import subprocess
import sys

from tidemark.llm import common


def test_shared_folder_is_the_configured_one(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shared_folder_where_none_is_configured():
    code = (
        "from pyspark.sql import SparkSession\nfrom tidemark.llm import common, queries\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "a, b = common.shared_dir(s), common.shared_dir(s)\nassert a == b, (a, b)\n"
        "assert common.materialize(s.range(5), 'x').count() == 5\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=120, stderr=subprocess.DEVNULL)


def test_running_total_over_keys_with_nulls(spark):
    rows = [(k, i, i % 7) for k in ("a", None, "b") for i in range(0, 5000, 3)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    got = {(r.k, r.i): r.t for r in common.running_total(df, ["k"], "i", "v", "t", fan=100).collect()}
    for k in ("a", None, "b"):
        total = 0
        for i in range(0, 5000, 3):
            assert got[(k, i)] == total
            total += i % 7


def test_staged_tables_leave_nothing_else_behind(spark):
    from tidemark.llm import common

    before = list(common._MADE)
    make = lambda: common.materialize(common.materialize(spark.range(7).toDF("n"), "one"), "two").filter("n > 2")
    df, path = common.staged(spark, "three", make)
    assert df.count() == 4 and common._MADE == [*before, path]
    fs, at = common.file_system(path)
    names = [f.base_name for f in fs.get_file_info(common.pafs.FileSelector(at.rsplit("/", 1)[0]))]
    assert not any(n.startswith(("one-", "two-")) and f"/{n}" not in " ".join(before) for n in names)
    common.remove(spark, [path])
    assert common._MADE == before


def test_slices_are_bounded_in_rows_and_bytes():
    import pyarrow as pa

    from tidemark.llm import common

    text = ["a" * 10] * 700 + [None, "b" * 5000, "", "c" * 200] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array(text)], names=["doc_id", "text"])
    cut = list(common.pieces(iter([batch, batch.slice(0, 0)]), rows=100, most=6000))
    assert [x for c in cut for x in c.column("text").to_pylist()] == text
    assert max(c.num_rows for c in cut) <= 100 and max(sum(len(x or "") for x in c.column("text").to_pylist()) for c in cut) <= 6000 + 5000
