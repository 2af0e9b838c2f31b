"""Names for plug-ins: sources, providers, losses, launchers."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points


class Registry:
    def __init__(self, kind: str):
        self.kind, self._made = kind, {}

    def register(self, name: str) -> Callable:
        def put(thing):
            if name in self._made:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._made[name] = thing
            return thing

        return put

    def __getitem__(self, name: str):
        if name not in self._made:
            raise KeyError(f"unknown {self.kind} {name!r}; there are {', '.join(sorted(self._made))}")
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._made)


SOURCES, PROVIDERS, LOSSES = Registry("source"), Registry("provider"), Registry("loss")
#: An experiment is a function (train, test, by) -> (rows with a corrected column p, metrics); a launcher one that runs a configuration.
EXPERIMENTS, LAUNCHERS = Registry("experiment"), Registry("launcher")


def load_plugins(group: str = "lattica.launchers") -> list[str]:
    """Import what installed packages offer under an entry-point group; they register themselves. Returns their names."""
    found = sorted(entry_points(group=group), key=lambda e: e.name)
    for e in found:
        e.load()
    return [e.name for e in found]
