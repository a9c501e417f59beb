"""The records data source in batch and as a stream against a parse of the whole files."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.sources import records as R

SCHEMA_COLUMNS = ["file", "start", "attrs"]


@pytest.fixture(scope="module")
def reg(spark):
    spark.dataSource.register(R.RecordSource)
    return spark


def plain(raw: bytes):
    """{start: attrs} by lines."""
    out, at, begin, lines = {}, 0, 0, []
    for line in raw.split(b"\n"):
        if line == b"//":
            out[begin], begin, lines = R.parse(b"\n".join(lines).decode("latin-1")), at + 3, []
        else:
            lines.append(line)
        at += len(line) + 1
    if b"".join(lines).strip():
        out[begin] = R.parse(b"\n".join(lines).decode("latin-1"))
    return {k: v for k, v in out.items() if v}


def invented(seed, n):
    rng, parts = random.Random(seed), []
    for k in range(n):
        lines = [f"UNIQUE-ID - R{k}", "# note - no value", ""] + [f"TYPES - t{rng.randrange(5)}é" for _ in range(rng.randrange(4))]
        lines += ["COMMENT - first part", "/second // part", "/third - part"] if rng.random() < 0.5 else ["no separator", "a//b - //"]
        lines += ["LONG - " + "x" * rng.randrange(300), "A - b - c"]
        parts.append("\n".join(lines) + "\n//\n")
    return "".join(parts).encode("latin-1")


def rows(df):
    return sorted((r["file"].rsplit("/", 1)[-1], r["start"], sorted(r["attrs"].items())) for r in df.collect())


def wanted(files):
    return sorted((name, k, sorted(v.items())) for name, raw in files.items() for k, v in plain(raw).items())


ODD = {"empty": b"", "only_end": b"//\n", "ends": b"//\n//\nA - 1\n//\n//\n", "open": b"A - 1\n//\nB - 2", "cr": b"A - 1\r\nB - 2\r\n//\n",
       "tail": b"A - 1\n//", "blank": b"\n\n//\nA - 1\n//\n\n"}


def test_parse():
    assert R.parse("A - 1 - 2\n/more\n# A - 9\nnothing\nA - 3\n//x - y") == {"A": ["1 - 2 more", "3"], "//x": ["y"]}


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_ranges_meet_without_gap(tmp_path, split):
    raw = {**ODD, "long": invented(1, 30)}
    for name, data in raw.items():
        p = tmp_path / name
        p.write_bytes(data)
        got = [x for a in range(0, len(data), split) for x in R.records(str(p), a, min(a + split, len(data)), str(p))]
        assert {k: v for k, b in got if (v := R.parse(b.decode("latin-1")))} == plain(data), name
        assert len(got) == len({k for k, _ in got})


@pytest.mark.parametrize("split", [50, 1 << 20])
def test_batch(reg, tmp_path, split):
    files = {"a.dat": invented(2, 40), "b.dat": invented(3, 7), **ODD}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"X - 1\n//\n")
    df = reg.read.format("sievekit_records").option("splitBytes", split).load(str(tmp_path))
    assert df.columns == SCHEMA_COLUMNS and rows(df) == wanted(files)


def test_long_record_spans_chunks(reg, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 13)
    data = invented(4, 12)
    (tmp_path / "a").write_bytes(data)
    got = list(R.records(str(tmp_path / "a"), 0, len(data), str(tmp_path)))
    assert {k: R.parse(b.decode("latin-1")) for k, b in got} == plain(data)
    assert R.complete(str(tmp_path / "a"), len(data), str(tmp_path)) == len(data)
    assert R.complete(str(tmp_path / "a"), len(data) - 1, str(tmp_path)) == data[:-1].rfind(b"\n//\n") + 4


def run(spark, source, tmp_path):
    q = (spark.readStream.format("sievekit_records").option("splitBytes", 200).load(str(source)).writeStream.format("parquet")
         .option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "sink"))


def test_stream_goes_on_after_a_restart(reg, tmp_path):
    """Equal to the batch; a growing file, a new one, and a record that is finished only later."""
    source = tmp_path / "in"
    source.mkdir()
    first, more = invented(5, 9), invented(6, 5)
    (source / "a").write_bytes(first + b"LATE - half")
    assert rows(run(reg, source, tmp_path)) == wanted({"a": first})
    (source / "a").write_bytes(first + b"LATE - half done\n//\n" + more)
    (source / "b").write_bytes(more)
    got = run(reg, source, tmp_path)
    assert rows(got) == wanted({"a": first + b"LATE - half done\n//\n" + more, "b": more})
    assert rows(got) == rows(reg.read.format("sievekit_records").load(str(source)))


def test_empty_folder(reg, tmp_path):
    (tmp_path / "none").mkdir()
    assert reg.read.format("sievekit_records").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="names no path"):
        reg.read.format("sievekit_records").load().count()


def test_attrs_query(reg, tmp_path):
    (tmp_path / "a").write_bytes(b"UNIQUE-ID - \xe9t\xe9\nTYPES - a\nTYPES - b\n//\n")
    r = reg.read.format("sievekit_records").load(str(tmp_path)).select(F.col("attrs")["UNIQUE-ID"][0].alias("u"), F.size(F.col("attrs")["TYPES"]).alias("n")).first()
    assert (r["u"], r["n"]) == ("été", 2)
