"""CSV files in chunks against the built-in reader of whole files."""

import random
import re

import pytest

from tallyloom.sources import chunks, files

ODD = {
    "plain.csv": "a,b,c\n1,2,3\n4,5,6\n",
    "breaks.csv": 'a,b,c\n1,"two\nlines",3\n"x\n\n,y",5,"6"\n7,8,9\n',
    "windows.csv": 'a,b,c\r\n1,"two\r\nlines",3\r\n4,5,6\r\n',
    "quotes.csv": 'a,b,c\n1,5" pipe,3\n"say ""hi""",5,6\n7,"",\n8,"a""",9\n""""\n',
    "ragged.csv": "a,b,c\n1,2\n3,4,5,6\n7,8,9\n",
    "blank.csv": "a,b,c\n\n1,2,3\n\n\n4,5,6\n \n",
    "open.csv": 'a,b,c\n1,2,3\n4,"never closed,5\n6,7,8\n',
    "mark.csv": "﻿a,b,c\n1,2,3\n",
    "none.csv": "a,b,c\n",
    "long.csv": 'a,b,c\n1,"' + "line\n" * 400 + '",3\n4,5,6',
    "wide.csv": "a,b,c\nÜber,漢字,😀\n",
    "tail.csv": 'a,b,c\n"q" tail,2,3\n"q"tail,"x",3\n',
}


def told(df):
    at = df.columns.index("source_file")
    return sorted((tuple(v if i != at else v.rsplit("/", 1)[1] for i, v in enumerate(r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [None, 64, 23])
def test_odd_files_read_as_whole_ones(spark, tmp_path, size):
    paths = []
    for name, text in ODD.items():
        (tmp_path / name).write_bytes(text.encode())
        paths.append(str(tmp_path / name))
    want = told(files.read_csv(spark, paths, audit=True))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = chunks.read_csv(spark, paths, audit=True)
        got = told(df)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    # a cell that is never closed ends without the last line break of its file
    plain = lambda rows: [tuple(v.replace("\r\n", "\n").removesuffix("\n") if isinstance(v, str) else v for v in r) for r in rows]
    assert plain(got) == plain(want)


def test_random_files_in_small_chunks(spark, tmp_path):
    rng = random.Random(1)
    cell = lambda: rng.choice(["x", "", '"a\nb"', '"c;d"', '"e""f"', "g h", '"' + "long\n" * rng.randrange(30) + '"', "12"])
    paths = []
    for i in range(6):
        (tmp_path / f"f{i}.csv").write_text("a;b;c\n" + "\n".join(";".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(200)) + "\n" * rng.randrange(2))
        paths.append(str(tmp_path / f"f{i}.csv"))
    want = told(files.read_csv(spark, paths, separator=";", audit=True))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    try:
        assert spark.read.text(paths).rdd.getNumPartitions() > 60
        assert told(chunks.read_csv(spark, paths, ";", audit=True)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_that_end_a_record():
    def slow(line, open_):
        """The bit by going through the characters."""
        state = "q" if open_ else "start"
        for ch in line:
            if state == "start":
                state = "q" if ch == '"' else "start" if ch == "," else "u"
            elif state == "u":
                state = "start" if ch == "," else "u"
            elif state == "q":
                state = "end" if ch == '"' else "q"
            else:
                state = "q" if ch == '"' else "start" if ch == "," else "u"
        return state == "q"

    patterns = chunks.closers(",")
    for n in range(7):
        for i in range(3**n):
            line = "".join('",x'[i // 3**k % 3] for k in range(n))
            for open_ in (False, True):
                assert chunks._opens(line, open_, patterns) == slow(line, open_), (line, open_)


def test_ranges_are_placed_by_their_file():
    folds = [("b", 0, False, 3, True, 1), ("a", 10, True, 2, False, 5), ("a", 0, True, 4, False, 0), ("a", 20, False, 1, True, 0)]
    assert chunks.placed(folds) == {("a", 0): (False, 0), ("a", 10): (True, 4), ("a", 20): (False, 9), ("b", 0): (False, 0)}


def test_patterns_take_any_separator():
    for separator in ("|", "\t", ";", "^"):
        assert re.match(chunks.closers(separator)[0], f'a{separator}"b"')
        assert not re.match(chunks.closers(separator)[0], f'a{separator}"b')
