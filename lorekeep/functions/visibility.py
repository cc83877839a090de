"""Which rows a reader may see, as one predicate for every path.

A reader names one scope, or a list, or a persona; without any, everything but persona scopes
is visible: forgetting to say who reads never shows what a persona was told.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL = "global"
PERSONA = "persona:"


@dataclass(frozen=True)
class Visibility:
    """scopes: the only visible ones, or None for all; hidden: prefixes that are never visible then."""

    scopes: tuple[str, ...] | None = None
    hidden: tuple[str, ...] = ()

    def predicate(self, scope: Column) -> Column:
        if self.scopes is not None:
            return F.coalesce(scope.isin(*self.scopes), F.lit(False)) if self.scopes else F.lit(False)
        seen = scope.isNotNull()
        for prefix in self.hidden:
            seen = seen & ~F.coalesce(scope.startswith(prefix), F.lit(False))
        return seen


def _persona(name: str) -> str:
    return name if name.startswith(PERSONA) else PERSONA + name


def resolve(scope: str | None = None, scopes: Sequence[str] | None = None, persona: str | None = None) -> Visibility:
    """One scope goes before a list, a list before a persona, a persona before the default."""
    if scope is not None:
        return Visibility((scope,))
    if scopes is not None:
        own = (*scopes, *([_persona(persona)] if persona else []))
        return Visibility(tuple(dict.fromkeys(own)))
    if persona:
        return Visibility((GLOBAL, _persona(persona)))
    return Visibility(None, (PERSONA,))


def written_into(scope: Column) -> Column:
    """when_writing() for a column of scopes: the scopes that may be read, as an array."""
    return F.when(scope.startswith(PERSONA), F.array(F.lit(GLOBAL), scope)).when(scope.isNotNull(), F.array(scope)).otherwise(F.array().cast("array<string>"))


def when_writing(scope: str) -> Visibility:
    """What may be read as context of a write into a scope: for a persona the global scope too, else the scope alone."""
    return resolve(persona=scope) if scope.startswith(PERSONA) else resolve(scope=scope)
