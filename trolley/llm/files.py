"""Binary files in the shared folder, opened from tasks by URI on any file system that Arrow knows."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def create(folder: str, suffix: str) -> tuple[str, object]:
    """A new file of a name no other task attempt uses, and its output stream. Only files that a finished task reports count."""
    fs, path = _at(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex[:16]}{suffix}"
    return name, fs.open_output_stream(f"{path}/{name}", compression=None)


def reader(uri: str):
    fs, path = _at(uri)
    return fs.open_input_file(path)


class Readers:
    """Open files of one folder; the oldest are closed beyond `most`."""

    def __init__(self, folder: str, most: int = 32):
        self.folder, self.most, self.open = folder, most, {}

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            while len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = reader(f"{self.folder}/{name}")
        return self.open[name].read_at(size, at)
