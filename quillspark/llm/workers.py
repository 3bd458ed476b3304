"""What a Python worker keeps between tasks: in a module of its own, as tasks bring this library's modules by value."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable

from quillspark.session import ship

ship(__name__)


def _state() -> dict:
    return sys.modules.setdefault("quillspark_worker_state", types.ModuleType("quillspark_worker_state")).__dict__.setdefault("kept", {})


def trimmed() -> None:
    """Give memory that is free back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Let go what the worker keeps: for tasks that need the room, at their start."""
    if _state():
        _state().clear()
        trimmed()


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave the first time. Only a task's own thread comes here, and a worker runs one task at a time."""
    state = _state()
    if name not in state:
        state[name] = make()
    return state[name]
