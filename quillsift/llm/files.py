"""Files in the shared folder from Python tasks, and the manifest that commits them."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def create(folder: str, stem: str):
    """(name, open output stream) of a file that no other attempt of the task writes."""
    system, path = at(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    return name, system.open_output_stream(f"{path}/{name}")


def put(folder: str, name: str, data: bytes) -> None:
    system, path = at(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def get(folder: str, name: str) -> bytes:
    system, path = at(folder)
    with system.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def remove(folder: str, names: list[str]) -> None:
    system, path = at(folder)
    for name in names:
        try:
            system.delete_file(f"{path}/{name}")
        except FileNotFoundError:
            pass


def commit(folder: str, entries: list[dict]) -> None:
    put(folder, "_manifest.json", json.dumps(entries).encode())


def manifest(folder: str) -> list[dict]:
    return json.loads(get(folder, "_manifest.json"))
