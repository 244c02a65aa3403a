"""Byte ranges of large CSV files against the reader that takes a file as one task."""

import random

import pandas as pd
import pytest

from leadsmith.sources import csv_scan as CS
from leadsmith.sources import csv_split as SP


def cell(rng):
    v = rng.choice(["", "x", "né", "007", "a,b", 'say "hi"', "two\nlines", "cr\r\nlf", "\n", '"', "NaN", " pad ", "long " * 30])
    quoted = '"' + v.replace('"', '""') + '"'
    return quoted if any(c in v for c in ',"\n\r') or rng.random() < 0.2 else v


def write(path, rng, n, end="\n", last=True, bom=False, width=3):
    lines = ["a,\"b\"\"x\",c"[:None] if width == 3 else ",".join(f"h{k}" for k in range(width))]
    for _ in range(n):
        lines.append(",".join(cell(rng) for _ in range(rng.choice([width, width, width, 1]))))
        if rng.random() < 0.05:
            lines.append("")
    text = end.join(lines) + (end if last else "")
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())


@pytest.mark.parametrize("step", [150, 2000])
def test_ranges_that_cut_anywhere_give_the_same_rows(spark, tmp_path, step):
    rng = random.Random(step)
    write(tmp_path / "one.csv", rng, 60)
    write(tmp_path / "two words.csv", rng, 40, end="\r\n", last=False, bom=True)
    write(tmp_path / "three.csv", rng, 5, width=2)
    (tmp_path / "head.csv").write_bytes(b'only,"head\ner"\n')
    want = CS.read_csv_files(spark, [str(tmp_path)]).orderBy("_row").collect()
    found = CS.read_csv_files(spark, [str(tmp_path)], split_bytes=step).orderBy("_row").collect()
    assert [tuple(r)[:-1] for r in found] == [tuple(r)[:-1] for r in want]
    assert [r["_row"] >> 33 for r in found] == [r["_row"] >> 33 for r in want]
    assert len({r["_row"] for r in found}) == len(found)


@pytest.mark.parametrize("step", [1, 2, 3, 5, 16, 23, 70])
def test_every_cut_gives_the_same_records(tmp_path, step):
    for seed, end in enumerate(["\n", "\r\n", "\n"]):
        file = tmp_path / f"f {seed}.csv"
        write(file, random.Random(step + seed), 25, end=end, last=seed != 2, bom=seed == 1 and step >= 16)
        size = file.stat().st_size

        def records(step):
            cuts = [(f"file:{file}", at, min(at + step, size), size) for at in range(0, size, step)]
            inside = number = 0
            found = []
            for cut in cuts:
                (row,) = next(SP._counted(iter([pd.DataFrame([cut])]))).itertuples(index=False)
                assert not (row.irregular1 if inside else row.irregular0) or step < 3
                part = pd.concat(SP._split(iter([pd.DataFrame([(*cut, bool(inside), number, False)])])))
                found += list(part.itertuples(index=False))
                number += row.records1 if inside else row.records0
                inside ^= row.odd
            return [(r.number, r.record) for r in found]

        whole = records(size + 1)
        assert [n for n, _ in whole] == list(range(len(whole))) and len(whole) >= 15
        assert records(step) == whole


def test_one_file_is_many_tasks(spark, tmp_path):
    write(tmp_path / "big.csv", random.Random(1), 3000)
    size = (tmp_path / "big.csv").stat().st_size
    states = SP.range_states(spark, CS.csv_listing(spark, [str(tmp_path)]), size // 12)
    assert states.count() >= 12 and not SP.irregular_files(states)
    assert states.where("inside").count() + states.where("not inside").count() == states.count()
    assert SP.split_records(states).rdd.getNumPartitions() >= 12
    numbers = [r["number"] for r in SP.split_records(states).select("number").collect()]
    assert sorted(numbers) == list(range(len(numbers)))


@pytest.mark.parametrize("body", ['a,b\n1,5" pipe\n2,6" pipe\n', 'a,b\n1,"x"y\n2,z\n', "a,b\r1,x\r2,y\r", 'a,b\n1,"open\n2,z\n'])
def test_irregular_files_are_left_to_the_other_reader(spark, tmp_path, body):
    (tmp_path / "odd.csv").write_text(body, newline="")
    states = SP.range_states(spark, CS.csv_listing(spark, [str(tmp_path)]), 4)
    assert len(SP.irregular_files(states)) == 1
    want = CS.read_csv_files(spark, [str(tmp_path)]).orderBy("_row").collect()
    assert CS.read_csv_files(spark, [str(tmp_path)], split_bytes=4).orderBy("_row").collect() == want


def test_a_long_record_in_a_split_file_fails_with_its_name(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n" + "4,5\n" * 50)
    with pytest.raises(Exception, match="more cells than the header of .*bad.csv"):
        CS.read_csv_files(spark, [str(tmp_path)], split_bytes=20).collect()


@pytest.mark.parametrize("block", [16, 17, 61])
def test_blocks_that_cut_anywhere_give_the_same_records(tmp_path, monkeypatch, block):
    for seed, end in enumerate(["\n", "\r\n"]):
        file = tmp_path / f"f {seed}.csv"
        write(file, random.Random(block + seed), 40, end=end, last=seed == 0, bom=seed == 1)
        size = file.stat().st_size

        def found():
            out = []
            for at in range(0, size, 300):
                cut = (f"file:{file}", at, min(at + 300, size), size)
                (row,) = next(SP._counted(iter([pd.DataFrame([cut])]))).itertuples(index=False)
                for inside in (False, True):
                    part = pd.concat(SP._split(iter([pd.DataFrame([(*cut, inside, 5, False)])])))
                    out.append((row, list(part.itertuples(index=False))))
            return out

        want = found()
        monkeypatch.setattr(SP, "BLOCK_BYTES", block)
        assert found() == want
        monkeypatch.undo()


def test_a_range_is_read_a_block_at_a_time(tmp_path):
    """Memory goes by the block: a range of 8 MB took 150 MB and more when it was read whole."""
    import tracemalloc

    file = tmp_path / "big.csv"
    file.write_bytes(b"a,b\n" + b'1,"two\nlines"\n' * 100 + (b"x" * 500 + b',"y"\n') * 16_000)
    size = file.stat().st_size
    tracemalloc.start()
    try:
        for _ in SP._counted(iter([pd.DataFrame([(f"file:{file}", 0, size, size)])])):
            pass
        rows = sum(map(len, SP._split(iter([pd.DataFrame([(f"file:{file}", 0, size, size, False, 0, False)])]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 16_100 and size > 8_000_000 and peak < 30_000_000
