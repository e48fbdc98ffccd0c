"""Files of an operator's own format in the shared folder, from inside tasks.

Any store that ``pyarrow.fs`` opens will do, as long as all executors see it under the same URI.
A file is written under a name of its own and then renamed, so a task that runs twice or dies half
way leaves one whole file.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        if not uri.startswith(("file:", "/")):
            raise ValueError(f"not a shared folder's URI: {uri}")
        uri = "file://" + uri.removeprefix("file:")
    # Hadoop's names for two common object stores
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("abfss://", "abfs://", 1))


@contextlib.contextmanager
def written(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A new file ``name`` in ``folder``, there only if all goes well."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(own) as out:
            yield out
        store.move(own, f"{path}/{name}")
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(own)
        raise


def ranges(spans: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """Sorted ``(offset, length)`` spans as reads ``(offset, length, numbers of the spans)``: spans
    no more than ``gap`` bytes apart are read in one go, up to ``most`` bytes."""
    at, end, held = 0, 0, []
    for k, (offset, length) in enumerate(spans):
        if held and (offset > end + gap or offset + length - at > most):
            yield at, end - at, held
            held = []
        if not held:
            at, end = offset, offset
        end = max(end, offset + length)
        held.append(k)
    if held:
        yield at, end - at, held
