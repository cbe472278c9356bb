"""Files of our own formats in the shared folder, through pyarrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def create_dir(uri: str) -> None:
    system, path = locate(uri)
    system.create_dir(path, recursive=True)


def write(uri: str, data: bytes) -> None:
    system, path = locate(uri)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def read(uri: str) -> bytes:
    system, path = locate(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def delete(uri: str) -> None:
    system, path = locate(uri)
    try:
        system.delete_file(path)
    except FileNotFoundError:
        return


def sizes(uri: str, suffix: str) -> list[tuple[str, int]]:
    """Name and size of the files of a folder, by name."""
    system, path = locate(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(suffix))
