"""State that lives as long as a Python worker, and files in the shared store."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs


def per_worker(kind: str, identity: str, make: Callable[[], Any]) -> Any:
    """One value of each kind per worker process, kept from task to task until another identity is asked for."""
    state = sys.modules.setdefault("_tidemark_worker_state", types.ModuleType("_tidemark_worker_state")).__dict__
    if state.get(kind, (None,))[0] != identity:
        state.pop(kind, None)
        state[kind] = identity, make()
    return state[kind][1]


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task, as workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style location (``file:/x`` and plain paths included)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)
