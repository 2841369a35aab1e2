"""Folders of mixed files as a data source: `spark.read.format("tarnfold_folder").load(path)`.

A parser takes a file's bytes, its type and its name, and gives markdown, or nothing if the
file is not for it. The parsers of a chain are asked in order; a file that none takes, or
that its parser can't read, is a row with an error. Files are listed once and read in
tasks, as many together as `bytesPerPartition` holds.

Options: path (a folder, or one file), chain (names of parsers, in order), bytesPerPartition,
mostBytes (a larger file is an error row and isn't read). Paths may be any that pyarrow opens.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Types by extension, and what the errors are called.
MIME = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "doc": "application/msword", "ppt": "application/vnd.ms-powerpoint", "xls": "application/vnd.ms-excel",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
UNKNOWN, NO_CONVERTER, FAILED, TOO_LARGE = "INVALID_MIME_TYPE", "CONVERTER_MISSING", "PARSE_FAILED", "FILE_TOO_LARGE"
SCHEMA = "path string, filename string, mime string, bytes long, source_hash string, parser string, profile string, markdown string, error_code string, error string"


class Parser(ABC):
    """One way to read files."""

    name: str
    profile: str

    @abstractmethod
    def parse(self, content: bytes, mime: str | None, filename: str) -> str | None:
        """Markdown, or None if the file is not for this parser; an exception if it is and can't be read."""


class TextParser(Parser):
    name = profile = "text"

    def parse(self, content: bytes, mime: str | None, filename: str) -> str | None:
        return content.decode("utf-8-sig") if mime in ("text/plain", "text/markdown") else None


class HtmlParser(Parser):
    name = profile = "html"

    def parse(self, content: bytes, mime: str | None, filename: str) -> str | None:
        if mime != "text/html":
            return None
        return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", content.decode("utf-8-sig"))).strip(" ") + "\n"


class ConvertedParser(Parser):
    """Office files and PDF: a converter's output beside the file (`<name>.md`) is taken by the text parser; here only its absence is told."""

    name, profile = "converted", "converted"

    def parse(self, content: bytes, mime: str | None, filename: str) -> str | None:
        if mime is None or not mime.startswith("application/"):
            return None
        raise LookupError(NO_CONVERTER)


PARSERS: dict[str, Parser] = {p.name: p for p in (TextParser(), HtmlParser(), ConvertedParser())}


@dataclass
class Files(InputPartition):
    """Files that a task reads: paths with their sizes."""

    paths: list[tuple[str, int]]


def parsed(content: bytes, mime: str | None, filename: str, chain: list[Parser]) -> tuple:
    """parser, profile, markdown, error_code, error of one file."""
    for p in chain:
        try:
            markdown = p.parse(content, mime, filename)
        except LookupError as e:
            return p.name, p.profile, None, str(e.args[0]), None
        except Exception as e:  # a file's own fault is its row's, not the job's
            return p.name, p.profile, None, FAILED, f"{type(e).__name__}: {e}"
        if markdown is not None:
            return p.name, p.profile, markdown, None, None
    return None, "unknown", None, UNKNOWN, None


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str], chain: list[Parser]) -> None:
        self.path, self.chain = options["path"], chain
        self.together = int(options.get("bytesPerPartition", 32 << 20))
        self.most = int(options.get("mostBytes", 256 << 20))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        store, root = self._open()
        about = store.get_file_info(root)
        if about.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, held = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if not out or held + f.size > self.together:
                out.append(Files([]))
                held = 0
            out[-1].paths.append((f.path, f.size))
            held += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._open()
        for path, size in partition.paths:
            name = path.rpartition("/")[2]
            mime = MIME.get(name.rpartition(".")[2].lower()) if "." in name else None
            if size > self.most:
                yield path, name, mime, size, None, None, "unknown", None, TOO_LARGE, None
                continue
            with store.open_input_stream(path) as f:
                content = f.read()
            yield path, name, mime, size, sha256(content).hexdigest(), *parsed(content, mime, name, self.chain)


class FolderSource(DataSource):
    """The format `tarnfold_folder`."""

    parsers = PARSERS

    @classmethod
    def name(cls) -> str:
        return "tarnfold_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        names = [n.strip() for n in self.options.get("chain", ",".join(self.parsers)).split(",")]
        if unknown := [n for n in names if n not in self.parsers]:
            raise ValueError(f"no parser {unknown[0]!r}; there are {sorted(self.parsers)}")
        return FolderReader(self.options, [self.parsers[n] for n in names])


def register(spark: SparkSession, *parsers: Parser) -> None:
    """Make the format known to a session, with further parsers asked before the built-in ones."""
    own = type("FolderSource", (FolderSource,), {"parsers": {p.name: p for p in parsers} | PARSERS})
    spark.dataSource.register(own)
