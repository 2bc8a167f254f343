"""Languages: which parser reads a file, by its extension.

An adapter's ``parse`` takes (text, module path) and returns what ``pyparse.parse_source`` does, or raises
``ParseFailure``. Adapters go to the executors with the parsing step, so their functions must pickle.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from . import pyparse


@dataclass(frozen=True)
class Adapter:
    language: str
    extensions: tuple[str, ...]
    parse: Callable[[str, str], dict]


class Adapters:
    """Adapters by extension and by language; a later one takes over the extensions that it names."""

    def __init__(self, *adapters: Adapter):
        self._by_extension: dict[str, Adapter] = {}
        self._by_language: dict[str, Adapter] = {}
        for a in adapters:
            self.register(a)

    def register(self, adapter: Adapter) -> None:
        self._by_language[adapter.language] = adapter
        self._by_extension |= dict.fromkeys(adapter.extensions, adapter)

    def get_adapter(self, path: str) -> Adapter | None:
        return self._by_extension.get(os.path.splitext(path)[1])

    def get_by_language(self, language: str) -> Adapter | None:
        return self._by_language.get(language)

    @property
    def supported_languages(self) -> list[str]:
        return list(self._by_language)

    @property
    def supported_extensions(self) -> tuple[str, ...]:
        return tuple(sorted(self._by_extension))

    def extensions(self) -> dict[str, str]:
        """Extension -> language."""
        return {ext: a.language for ext, a in self._by_extension.items()}


ADAPTERS = Adapters(Adapter("python", (".py",), pyparse.parse_source))
