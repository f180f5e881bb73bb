"""Registration of functions and macros by dialect."""

from __future__ import annotations

from collections.abc import Callable

from folioquery.plans.compiler import COMPILERS, Val
from folioquery.values import STRING


def function(dialects: str, *names: str) -> Callable:
    """Register a function under names in dialects given as a text of their names."""

    def add(f: Callable) -> Callable:
        for d in dialects.split():
            for n in names:
                COMPILERS[d].functions[n] = f
        return f

    return add


def macro(dialects: str, *names: str) -> Callable:
    """Register a macro: it gets the call's tree, and may return None to decline."""

    def add(f: Callable) -> Callable:
        for d in dialects.split():
            for n in names:
                COMPILERS[d].macros[n] = f
        return f

    return add


def subject(target: Val | None, args: list[Val]) -> tuple[Val, list[Val]]:
    """What a function is about: its target, or else its first argument."""
    return (target, args) if target is not None else (args[0], args[1:])


def text_of(c, v: Val) -> Val:
    return c.concrete(v, STRING)
