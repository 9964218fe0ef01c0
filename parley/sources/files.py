"""Files of the sources below, on any file system that Arrow reaches; written hidden, then renamed."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the visible files of a folder in the order of their names."""
    system, inner = at(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in found
                  if i.is_file and i.base_name[0] not in "._" and i.base_name.endswith(ending))


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (folder, hidden name, visible name) of each file, and counts."""

    files: list[tuple[str, str, str]]
    counts: dict[str, int]


class Hidden:
    """Files of one task, under names that no reader sees until they are committed."""

    def __init__(self):
        self.mark, self.files = uuid.uuid4().hex, []

    def create(self, folder: str, name: str):
        system, inner = at(folder)
        system.create_dir(inner, recursive=True)
        hidden = f"_{self.mark}-{name}"
        self.files.append((folder, hidden, name))
        return system.open_output_stream(f"{inner}/{hidden}")

    def drop(self) -> None:
        discard(self.files)


def discard(files: list[tuple[str, str, str]]) -> None:
    for folder, hidden, _ in files:
        system, inner = at(folder)
        if system.get_file_info(f"{inner}/{hidden}").type != fs.FileType.NotFound:
            system.delete_file(f"{inner}/{hidden}")


def reveal(messages: list[Written | None]) -> dict[str, int]:
    """Show all files of all tasks; sums their counts."""
    counts: dict[str, int] = {}
    for message in messages:
        for folder, hidden, name in message.files if message else []:
            system, inner = at(folder)
            system.move(f"{inner}/{hidden}", f"{inner}/{name}")
        for key, n in (message.counts if message else {}).items():
            counts[key] = counts.get(key, 0) + n
    return counts


def put_text(path: str, text: str) -> None:
    system, inner = at(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(text.encode())


def get_json(path: str) -> dict:
    system, inner = at(path)
    with system.open_input_stream(inner) as source:
        return json.loads(source.read())
