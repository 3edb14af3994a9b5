"""A data source for layout documents: ``spark.read.format("layout").load(folder)``.

Files are dealt out in partitions of near-equal size, each is parsed in its task, and a document that cannot be read is a row with
its error, so a load loses nothing silently. Options: ``kind`` (``page``, ``alto``, ``tei``, ``manifest`` or ``auto``, by the first characters),
``pattern`` (of names, default ``*.xml``), ``recursive`` (default true), ``bytesperpartition`` (default 16 MB).

Paths are those of the file systems that Arrow knows (local and mounted folders, ``s3://``, ``hdfs://``); for others there are the shredders
of :mod:`quillon.sources.layout` over Spark's own readers, which give the same rows.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, line_no int, line_id string, text string, x0 int, y0 int, x1 int, y1 int, error string"


class Files(InputPartition):
    """Some files that one task reads."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _page(root: ElementTree.Element) -> Iterator[tuple]:
    if not any(_local(e) == "Page" for e in root):
        raise ValueError("no Page")
    for region in (e for e in root.iter() if _local(e) == "TextRegion"):
        for number, line in enumerate(e for e in region if _local(e) == "TextLine"):
            parts = {_local(e): e for e in line}
            pairs = [p.split(",") for p in (parts["Coords"].get("points") or "").split()] if "Coords" in parts else []
            points = [(x, y) for x, y in ((_number(p[0]), _number(p[1])) for p in pairs if len(p) == 2) if x is not None and y is not None]
            if points and "type:margin" not in (line.get("custom") or ""):
                text = next((e.text for e in parts["TextEquiv"] if _local(e) == "Unicode"), None) if "TextEquiv" in parts else None
                xs, ys = [p[0] for p in points], [p[1] for p in points]
                yield number, line.get("id"), text, int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys))


def _alto(root: ElementTree.Element) -> Iterator[tuple]:
    for number, line in enumerate(e for e in root.iter() if _local(e) == "TextLine"):
        x, y, w, h = (_number(line.get(k)) or 0.0 for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
        words = [e.get("CONTENT") or "" for e in line if _local(e) == "String"]
        yield number, line.get("ID"), " ".join(words), int(x), int(y), int(x + w), int(y + h)


def _tei(root: ElementTree.Element) -> Iterator[tuple]:
    body = next((e for e in root.iter() if _local(e) == "body"), None)
    if body is None:
        raise ValueError("no body")
    texts = [t.strip() for t in body.itertext() if t.strip()]
    yield from ((i, None, t, None, None, None, None) for i, t in enumerate(texts))


def _manifest(content: bytes) -> Iterator[tuple]:
    found = json.loads(content)
    if "sequences" in found:
        canvases = [(c.get("label"), c["images"][0]["resource"]["@id"]) for s in found["sequences"] for c in s.get("canvases", [])]
    else:
        canvases = [(next(iter((c.get("label") or {"": [None]}).values()))[0], c["items"][0]["items"][0]["body"]["id"]) for c in found.get("items", [])]
    yield from ((i, name, url, None, None, None, None) for i, (name, url) in enumerate(canvases))


_SHREDDERS = {"page": _page, "alto": _alto, "tei": _tei}


def _kind_of(content: bytes) -> str:
    head = content[:4096].decode(errors="replace")
    if head.lstrip().startswith(("{", "[")):
        return "manifest"
    return next((kind for kind, marks in (("page", ("PcGts",)), ("alto", ("<alto", ":alto")), ("tei", ("<TEI", "tei-c.org"))) if any(m in head for m in marks)), "page")


def shred(path: str, content: bytes, kind: str) -> Iterator[tuple]:
    """The rows of one document; one row with an error if it is none."""
    kind = _kind_of(content) if kind == "auto" else kind
    try:
        rows = list(_manifest(content) if kind == "manifest" else _SHREDDERS[kind](ElementTree.fromstring(content)))
    except ElementTree.ParseError:
        rows, error = [], "malformed"
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
        rows, error = [], str(e) if isinstance(e, ValueError) and not isinstance(e, json.JSONDecodeError) else "malformed"
    else:
        error = None
    if error is not None:
        yield (path, kind, *[None] * 7, error)
    yield from ((path, kind, *row, None) for row in rows)


class LayoutReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "auto")
        self.pattern, self.recursive = options.get("pattern", "*.xml"), options.get("recursive", "true").lower() == "true"
        self.most = int(options.get("bytesperpartition", 16 << 20))
        if self.kind not in {*_SHREDDERS, "manifest", "auto"}:
            raise ValueError(f"unknown kind of documents: {self.kind}")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))
        parts, size = [[]], 0
        for path, n in files:
            if parts[-1] and size + n > self.most:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
            except OSError as e:
                yield (path, self.kind, *[None] * 7, f"unreadable: {e}"[:200])
                continue
            yield from shred(path, content, self.kind)


class LayoutDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayoutReader:
        return LayoutReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LayoutDataSource)
    return spark
