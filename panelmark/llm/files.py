"""Files of the two file formats, reached by URI from any executor."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

MANIFEST = "_manifest.json"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_manifest(folder: str, entries: list[dict]) -> None:
    """Name the files of a finished job; whatever else lies in the folder was left by a
    task that was run twice or lost, and is not read. Written aside, then moved."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    aside = f"{root}/.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(json.dumps(entries).encode())
    store.move(aside, f"{root}/{MANIFEST}")


def read_manifest(folder: str) -> list[dict] | None:
    store, root = opened(folder)
    if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


def remove(folder: str, names: list[str]) -> None:
    """Best effort: the files of a job that failed."""
    store, root = opened(folder)
    for name in names:
        if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            store.delete_file(f"{root}/{name}")
