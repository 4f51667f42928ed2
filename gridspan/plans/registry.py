"""Names for extensions: transforms, augmentations, criteria, reductions, blendings, schedules, selectors, sinks, sources, patch generators."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

KINDS = ("transform", "augmentation", "criterion", "reduction", "blending", "schedule", "selector", "sink", "source", "patches", "step")


@dataclass
class Registry:
    """(kind, name) -> a callable. A name ``module:attribute`` is imported, any other must have been registered."""

    held: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def add(self, kind: str, name: str, thing: Callable) -> Callable:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
        if self.held.get((kind, name), thing) is not thing:
            raise ValueError(f"{kind} {name!r} is registered already")
        self.held[kind, name] = thing
        return thing

    def register(self, kind: str, name: str | None = None):
        """As a decorator."""
        return lambda thing: self.add(kind, name or thing.__name__, thing)

    def find(self, kind: str, name: str) -> Callable:
        if (kind, name) in self.held:
            return self.held[kind, name]
        module, colon, attribute = name.partition(":")
        if not colon:
            known = sorted(n for k, n in self.held if k == kind)
            raise KeyError(f"no {kind} {name!r}; known: {', '.join(known) or 'none'}")
        return getattr(importlib.import_module(module), attribute)


REGISTRY = Registry()


@dataclass(frozen=True)
class Choices:
    """A setting's allowed values."""

    values: tuple

    def check(self, value) -> None:
        if value not in self.values:
            raise ValueError(f"{value!r} is none of {self.values}")


@dataclass(frozen=True)
class Range:
    """A setting's allowed interval, ends included."""

    low: float
    high: float

    def check(self, value) -> None:
        if not self.low <= value <= self.high:
            raise ValueError(f"{value!r} is not between {self.low} and {self.high}")
