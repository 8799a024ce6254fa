"""Delimited text in ranges gives the rows of the reader that takes a file in one task."""

import random

import pytest

from sieveline.sources import delimited
from sieveline.sources.tables import read


def whole(spark, path, sep):
    return spark.read.csv(str(path), sep=sep, header=True, multiLine=True, escape='"', inferSchema=False)


def made(r, sep, end, rows):
    cell = lambda: r.choice(["", "x", "é日", '"a' + sep + 'b"', '"line' + end + 'feed"', '"say ""hi"""', '""', '"a' + end * 2 + '"', '5"', 'a"b"c', '"' + "q" * r.randint(0, 40) + '"', '"""' + end + '"""', " sp "])
    lines = [sep.join(["SMILES", "id", "odd name"])]
    for _ in range(rows):
        lines.append(sep.join([r.choice(["C", "N"]), cell(), cell()]))
        if r.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if r.random() < 0.5 else "")


@pytest.mark.parametrize("seed", range(6))
def test_as_one_task(spark, tmp_path, seed):
    r = random.Random(seed)
    sep, end = r.choice(",\t"), ["\n", "\r\n", "\n"][seed % 3]
    path = tmp_path / "t.csv"
    path.write_bytes((b"\xef\xbb\xbf" if seed == 4 else b"") + made(r, sep, end, 60).encode())
    want = [tuple(x) for x in whole(spark, path, sep).collect()]
    if end == "\r\n":  # that reader makes one line feed of both within fields
        want = [tuple(c and c.replace("\r\n", "\n") for c in x) for x in want]
    for each in (7, 64, 1000, 1 << 20):
        got = delimited.read(spark, str(path), sep, ["SMILES", "id", "odd name"], each)
        rows = sorted(got.collect(), key=lambda x: x["__row_index__"])
        assert [x["__row_index__"] for x in rows] == list(range(len(want)))
        assert [tuple(c and c.replace("\r\n", "\n") if end == "\r\n" else c for c in x[:3]) for x in rows] == want


def test_every_border(tmp_path):
    """All ranges of all sizes, without Spark: each record is read once, whole, with its number."""
    r = random.Random(9)
    for k in range(25):
        end = ["\n", "\r\n", "\r"][k % 3]
        path = tmp_path / f"{k}.csv"
        path.write_bytes(made(r, ",", end, 12).encode())
        one = None
        for each in [1 << 20, *range(1, 40, 2)]:
            file, state, before, rows = delimited.File(str(path)), 0, 0, []
            for low, high in delimited.ranges(file.size, each):
                reader = delimited.RangeReader(str(path), ",", [], ["a", "b", "c"])
                for batch in reader.read(delimited.Range(low, high, state, before)):
                    rows += [tuple(x.values()) for x in batch.to_pylist()]
                marks = delimited.Marks(file, low, high, ord(","))
                state, before = marks.last(state), before + int((~marks.records(state)[1]).sum())
            one = one or rows
            assert rows == one and [x[3] for x in rows] == list(range(len(rows)))
        assert len(one) >= 12


def test_short_long_and_empty(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('SMILES,id\nC\nN,1,2\n"unclosed,3\nx,y\n')
    rows, text = read(spark, str(path))
    assert text and [tuple(x) for x in rows.orderBy("__row_index__").collect()] == [("C", None, 0), ("N", "1", 1), ("unclosed,3\nx,y\n", None, 2)]
    path.write_text("SMILES,id\n")
    assert read(spark, str(path))[0].count() == 0


def test_many_tasks_and_quotes(spark, tmp_path):
    """A field longer than a range, a file in more than eight tasks, rows numbered in order."""
    path = tmp_path / "b.tsv"
    with path.open("w") as out:
        out.write("SMILES\tid\n")
        for k in range(20_000):
            out.write(f'C\t"{k}\n""{"y" * (k % 50)}"\n')
        out.write('N\t"' + "z\n" * 300_000 + '"\nO\tlast')
    got = delimited.read(spark, str(path), "\t", ["SMILES", "id"], 100_000)
    assert got.rdd.getNumPartitions() > 8 and got.count() == 20_002
    ends = got.where("__row_index__ >= 19999").orderBy("__row_index__").collect()
    assert [(x[0], len(x[1]), x[2]) for x in ends] == [("C", 7 + 19_999 % 50, 19_999), ("N", 600_000, 20_000), ("O", 4, 20_001)]
    assert got.where("int(split(id, '\n')[0]) <> __row_index__ and SMILES = 'C'").count() == 0


def test_several_files_as_one(spark, tmp_path):
    """Rows are numbered on over files that end with or without a line end, one without rows among them."""
    texts = ["id,x\n0,a\n1,\"b\nc\"\n", "id,x\n", "id,x\n2,d\n3,e", "id,x\n4,f\n"]
    paths = [str(tmp_path / f"{k}.csv") for k in range(4)]
    for path, t in zip(paths, texts, strict=True):
        with open(path, "w") as out:
            out.write(t)
    for each in (5, 1 << 20):
        got = sorted(delimited.read(spark, paths, ",", ["id", "x"], each).collect(), key=lambda r: r[2])
        assert [(r[0], r[2]) for r in got] == [(str(k), k) for k in range(5)] and got[1][1] == "b\nc"


def test_no_task_writes_a_whole_file(spark, tmp_path, monkeypatch):
    """documents are written in pieces by size, ids that are negative or null among them, and numbered by file."""
    import duckdb

    from sieveline.plans import scale

    rows = [(k - 50, "s", f"{k} " * 50) for k in range(700)] + [(None, None, "x")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scale, "PIECE", 4000, raising=False)
    found = scale.delimited_documents(spark, str(tmp_path))
    pieces = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{spark.conf.get('spark.checkpoint.dir')}/delimited-*/").where("length > 0").select("path", "length").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, found.select("file", "row_index", "doc_id", "source", "text_md5").collect()))) == sorted(map(repr, con.execute(scale.ORACLE_SQL["delimited_documents"]).fetchall()))
    assert len(pieces) > 16 and max(r["length"] for r in pieces) < 16_000
