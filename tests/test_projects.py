"""The data source of audio projects on archives of every sort."""

from __future__ import annotations

import zipfile

from tessera.sources import projects


def archive(path, **files):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)


TRACKS = (
    '<?xml version="1.0"?><!DOCTYPE project><project xmlns="http://a.example/" rate="8000"><wavetrack name="ann"><waveclip offset="2.5"><sequence><waveblock start="20"><simpleblockfile filename="e2.au"/></waveblock>'
    '<waveblock start="3"><pcmaliasblockfile aliasfile="C:\\old\\e1.wav"/><simpleblockfile filename=""/></waveblock></sequence></waveclip><waveclip offset="0"/></wavetrack><wavetrack><waveclip/></wavetrack></project>'
)
IMPORTS = '<p:project xmlns:p="x"><p:import filename="1-bob.flac" offset="0.25"/><p:import offset="9"/><p:import filename="sub/2-eve.ogg"/><p:wavetrack name="no"/></p:project>'


def test_archives(spark, tmp_path):
    archive(tmp_path / "a.zip", **{"deep/er/p.aup": TRACKS, "deep/er/p_data/e1.wav": b"12", "deep/er/p_data/x/e1.wav": b"123", "deep/e2.au": b"outside"})
    archive(tmp_path / "b.zip", **{"/p.aup": IMPORTS, "x/1-bob.flac": b"1234", "2-eve.ogg": b"12345"})
    archive(tmp_path / "c.zip", **{"p.aup": TRACKS, "q/p.aup": TRACKS})
    archive(tmp_path / "d.zip", **{"readme": b""})
    archive(tmp_path / "e.zip", **{"p.aup": TRACKS[:-30]})
    archive(tmp_path / "f.zip", **{"p.aup": TRACKS, "../out.au": b""})
    archive(tmp_path / "g.zip", **{"p.aup": TRACKS, "big.au": b"0" * 5000})
    archive(tmp_path / "h.zip", **{"p.aup": '<!DOCTYPE p [<!ENTITY a "b">]><project><wavetrack name="&a;"/></project>'})
    archive(tmp_path / "i.zip", **{"p.aup": "<project/>"})
    (tmp_path / "j.zip").write_bytes(b"PK nothing")
    (tmp_path / "k.txt").write_bytes(b"no archive")
    projects.register(spark)
    for each in (1, 100):
        rows = spark.read.format("audio_project").option("cap", 4000).option("archivesPerPartition", each).load(str(tmp_path)).collect()
        of = lambda a: [(r["track_no"], r["track"], r["clip_no"], r["offset"], r["block_no"], r["start"], r["file"], r["size"]) for r in rows if r["archive"] == a and not r["error"]]
        assert of("a.zip") == [(1, "ann", 1, 0.0, None, None, None, None), (1, "ann", 2, 2.5, 1, 3, "e1.wav", 2), (1, "ann", 2, 2.5, 2, 20, "e2.au", None), (2, "Track_2", 1, 0.0, None, None, None, None)]
        assert of("b.zip") == [(1, "1-bob", 1, 0.25, 1, 0, "1-bob.flac", 4), (3, "sub/2-eve", 1, 0.0, 1, 0, "sub/2-eve.ogg", 5)]
        assert {r["archive"] for r in rows if r["error"]} == {f"{x}.zip" for x in "cdefghj"} and len(rows) == 4 + 2 + 7
        assert {r["rate"] for r in rows if r["archive"] == "a.zip"} == {8000.0}
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("audio_project").load(str(empty)).count() == 0


def test_partitions_of_many_archives(tmp_path):
    """A partition has over a hundred archives by default, as a task costs more than a small archive; each archive is in one."""
    for i in range(300):
        (tmp_path / f"{i:03}.zip").write_bytes(b"")
    parts = projects._Reader({"path": str(tmp_path)}).partitions()
    assert len(parts) <= 3 and [p.rpartition("/")[2] for x in parts for p in x.paths] == [f"{i:03}.zip" for i in range(300)]
