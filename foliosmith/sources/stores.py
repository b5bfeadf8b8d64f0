"""Files of a store from inside tasks: any file system that pyarrow opens, by path or URI."""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import quote

from pyarrow import fs


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the place in it; URIs are as Spark shows them, with plain blanks and letters."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"\Afile:/+", "/", root)
    if "://" in root:
        return fs.FileSystem.from_uri(quote(root, safe="/:@?&=%+,~"))
    return fs.LocalFileSystem(), root


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def hidden(path: str) -> str:
    """A passing name beside ``path`` that readers of folders skip."""
    head, _, name = path.rpartition("/")
    return f"{head}/.{name}.{uuid.uuid4().hex}.part"


def put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file whole: under a passing name, then moved into place."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    passing = hidden(path)
    with store.open_output_stream(passing) as out:
        out.write(data)
    store.move(passing, path)


def claim(store: fs.FileSystem, staged: str, final: str) -> None:
    """Moves a staged file to a name that must be free; of several writers at once one gets it, the others a ``FileExistsError``.

    Local and mounted file systems decide that by a link, which fails where the name is taken.  Other stores are asked first, which is as safe as their own move is.
    """
    store.create_dir(final.rpartition("/")[0], recursive=True)
    if isinstance(store, fs.LocalFileSystem):
        os.link(staged, final)
        os.unlink(staged)
        return
    if store.get_file_info(final).type != fs.FileType.NotFound:
        raise FileExistsError(f"{final} is there already")
    store.move(staged, final)
