"""Errors of the library."""

from __future__ import annotations


class LoomError(Exception):
    """Any error of this library."""


class NotInitialized(LoomError):
    def __init__(self, folder):
        super().__init__(f"there is no graph in {folder}")


class UnsafeRoot(LoomError):
    def __init__(self, folder):
        super().__init__(f"{folder!r} can't hold a graph")


class NodeNotFound(LoomError):
    def __init__(self, name):
        super().__init__(f"no symbol {name!r}")
