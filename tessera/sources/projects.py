"""A data source of audio projects in ZIP archives: `spark.read.format("audio_project").load(folder)`.

A partition is some archives. Of each, only the directory and the one project entry are read, by seeking, through any file system that pyarrow
reaches; audio stays where it is. The project is parsed as it is read, element by element.
"""

from __future__ import annotations

import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.session import ship

#: Endings of files that blocks and imports may name.
AUDIO = (".au", ".flac", ".wav", ".ogg", ".mp3", ".m4a")
SCHEMA = "archive string, project string, rate double, track_no int, track string, clip_no int, offset double, block_no int, start bigint, file string, entry string, size bigint, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes of a project that are parsed at a time, and of archives' contents by default.
CHUNK, CAP = 1 << 16, 2 << 30
#: Archives of a partition by default; they are read one after the other.
EACH = 128


def safe_name(name: str) -> str:
    """An entry's name below the archive's folder: leading separators go, steps out of it are an error."""
    out = posixpath.normpath(name.replace("\\", "/").lstrip("/"))
    if out == ".." or out.startswith("../"):
        raise ValueError(f"an entry leaves the archive's folder: {name}")
    return out


def entries(z: zipfile.ZipFile, cap: int) -> list[tuple[str, zipfile.ZipInfo]]:
    """The files of an archive by safe_name(); an error if they have more than `cap` bytes together."""
    infos = [(safe_name(i.filename), i) for i in z.infolist()]
    if sum(i.file_size for _, i in infos) > cap:
        raise ValueError("the archive is too large")
    return [(name, i) for name, i in infos if not i.is_dir()]


def project_rows(z: zipfile.ZipFile, cap: int = CAP) -> Iterator[tuple]:
    """COLUMNS from project to size of the archive's only project: a row for each import, or else for each block of each clip of each track.

    Tracks count in the order of the project, from 1, and those without a name are Track_n; clips count by offset, blocks by start, ties in the
    project's order. A clip without blocks is a row without one. Elements may be in any name space. entry and size are those of the file below
    the project's folder that has the block's name, null if there is none; of several, the one that is least deep, then least by name.
    """
    files = entries(z, cap)
    projects = [(name, i) for name, i in files if name.endswith(".aup")]
    if len(projects) != 1:
        raise ValueError("several projects" if projects else "no project")
    project, info = projects[0]
    folder = posixpath.dirname(project)
    inside = [(n, i.file_size) for n, i in files if (not folder or n.startswith(folder + "/")) and posixpath.splitext(n)[1].lower() in AUDIO]
    found: dict[str, tuple[str, int]] = {}
    for name, size in sorted(inside, key=lambda f: (f[0].count("/"), f[0])):
        found.setdefault(posixpath.basename(name), (name, size))

    rate, imports, clips = 44100.0, [], []  # clips: (track number, name, offset, [(start, file)])
    track_no, track, clip, block = 0, None, None, 0
    parser, tail = ET.XMLPullParser(("start", "end")), b""
    with z.open(info) as stream:
        while True:
            chunk = stream.read(CHUNK)
            if b"<!ENTITY" in tail + chunk:
                raise ValueError("a project with entities")
            tail = chunk[-8:]
            parser.feed(chunk) if chunk else parser.close()
            for event, e in parser.read_events():
                name = e.tag.rpartition("}")[2]
                if event == "end":
                    if name == "waveclip":
                        clip = None
                    e.clear()
                elif name == "project":
                    rate = float(e.get("rate", rate))
                elif name == "import":
                    imports.append((e.get("filename"), float(e.get("offset", 0))))
                elif name == "wavetrack":
                    track_no += 1
                    track = (e.get("name") or "").strip() or f"Track_{track_no}"
                elif name == "waveclip" and track is not None:
                    clip = (track_no, track, float(e.get("offset", 0)), [])
                    clips.append(clip)
                elif name == "waveblock":
                    block = int(e.get("start", 0))
                elif name in ("simpleblockfile", "pcmaliasblockfile") and clip is not None:
                    file = e.get("filename") if name == "simpleblockfile" else posixpath.basename((e.get("aliasfile") or "").replace("\\", "/"))
                    if file:
                        clip[3].append((block, file))
            if not chunk:
                break
    if imports:
        for n, (file, offset) in enumerate(imports, 1):
            if file:
                where = found.get(file) or found.get(posixpath.basename(file)) or (None, None)
                yield project, rate, n, posixpath.splitext(file)[0], 1, offset, 1, 0, file, *where
        return
    seen: dict[int, int] = {}
    for number, name, offset, blocks in sorted(clips, key=lambda c: (c[0], c[2])):
        seen[number] = seen.get(number, 0) + 1
        for i, (start, file) in enumerate(sorted(blocks, key=lambda b: b[0]), 1):
            yield project, rate, number, name, seen[number], offset, i, start, file, *(found.get(file) or (None, None))
        if not blocks:
            yield project, rate, number, name, seen[number], offset, None, None, None, None, None


class _Archives(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.cap, self.each = options["path"], int(options.get("cap", CAP)), int(options.get("archivesPerPartition", EACH))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or not self.path.startswith("file:") else "file://" + self.path[5:])

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = self._store()
        one = store.get_file_info(path)
        listed = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        paths = sorted(f.path for f in listed if f.type == fs.FileType.File and f.extension.lower() == "zip")
        return [_Archives(paths[i : i + self.each]) for i in range(0, len(paths), self.each)] or [_Archives([])]

    def read(self, partition: _Archives) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            name = posixpath.basename(path)
            try:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    rows = list(project_rows(z, self.cap))  # all of them, as a bad project gives none
            except (ValueError, ET.ParseError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                yield (name, *[None] * (len(COLUMNS) - 2), str(e))
                continue
            for row in rows:
                yield (name, *row, None)


class AudioProjects(DataSource):
    """Options: cap (bytes of an archive's contents), archivesPerPartition. An archive that is none, has no project or several, leaves
    its folder or exceeds the cap is one row with an error; an archive whose project has no tracks gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "audio_project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(AudioProjects)
