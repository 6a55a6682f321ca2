"""Text analyzers. Each exists twice: over Python lists for query strings, over columns for documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import UnknownKind, ValidationError

#: Unicode's White_Space, the same for Java and Python.
SPACE = r"[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: The same for Java alone, a character at a time (no empty token stays anyway): the ranges are tried only from U+1680 on.
SPACE_COLUMN = r"[\t\n\x0b\f\r \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"


def _keep_all(tokens: list[str]) -> list[str]:
    return list(tokens)


def _first_of_each(tokens: list[str]) -> list[str]:
    return list(dict.fromkeys(tokens))


def _portable(pattern: str) -> str:
    """Java and Python disagree on the vertical tab in ``\\s``: spell it out, within classes too."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            body = r"\t\n\f\r "
            out.append(body if inside and two == r"\s" else f"[{'^' if two == chr(92) + 'S' else ''}{body}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _for_python(pattern: str) -> str:
    """A portable pattern with Java's word boundaries, which know letters beyond ASCII, unlike its word characters."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            two = pattern[i : i + 2]
            out.append(f"(?u:{two})" if two in (r"\b", r"\B") and not inside else two)
            i += 2
            continue
        inside = pattern[i] == "[" or (inside and pattern[i] != "]")
        out.append(pattern[i])
        i += 1
    return "".join(out)


def _splitter(pattern: str, on_columns: str | None = None) -> tuple[Callable[[list[str]], list[str]], Callable[[Column], Column], Callable[[Column], Column]]:
    compiled, pattern = re.compile(_for_python(pattern), re.ASCII), on_columns or pattern

    def parts(token: str) -> list[str]:
        """What lies between matches; what groups hold isn't part of it."""
        out, at = [], 0
        for match in compiled.finditer(token):
            out.append(token[at : match.start()])
            at = match.end()
        return [*out, token[at:]]

    def split_list(tokens: list[str]) -> list[str]:
        return [part for token in tokens for part in parts(token) if part]

    def split_column(tokens: Column) -> Column:
        parts = F.flatten(F.transform(tokens, lambda t: F.split(t, pattern, -1)))
        return F.array_remove(parts, "")

    return split_list, split_column, lambda text: F.array_remove(F.split(text, pattern, -1), "")


@dataclass(frozen=True)
class Step:
    """One analyzer: list to list, array column to array column, and string column to array column."""

    kind: str
    on_list: Callable[[list[str]], list[str]]
    on_column: Callable[[Column], Column]
    on_text: Callable[[Column], Column] = F.array


def step(kind: str, settings: dict | None = None) -> Step:
    if kind == "nop":
        return Step(kind, _keep_all, lambda c: c)
    if kind == "dedup":
        return Step(kind, _first_of_each, F.array_distinct)
    if kind == "whitespace":
        return Step(kind, *_splitter(SPACE, SPACE_COLUMN))
    if kind == "regexp":
        settings = settings or {}
        pattern = settings.get("pattern")
        if set(settings) - {"pattern"}:
            raise ValidationError({"settings": "only a pattern is known"})
        if not isinstance(pattern, str) or not pattern:
            raise ValidationError({"settings.pattern": "a non-empty string is needed"})
        try:
            return Step(kind, *_splitter(_portable(pattern)))
        except re.error as error:
            raise ValidationError({"settings.pattern": str(error)}) from error
    raise UnknownKind(f"no analyzer is called {kind!r}")


@dataclass(frozen=True)
class Analyzer:
    """Steps from left to right; a text enters as one token."""

    steps: tuple[Step, ...] = field(default_factory=tuple)

    @classmethod
    def build(cls, specs: Sequence[dict]) -> Analyzer:
        if not specs:
            raise ValidationError({"analyzers": "a chain needs at least one analyzer"})
        return cls(tuple(step(s.get("type", ""), s.get("settings")) for s in specs))

    def on_list(self, tokens: list[str]) -> list[str]:
        for one in self.steps:
            tokens = one.on_list(tokens)
        return tokens

    def tokens(self, text: str) -> list[str]:
        return self.on_list([text])

    def column(self, text: Column) -> Column:
        """The tokens of a string column; an empty array for null.

        A tokenizer that starts the chain splits the string itself, which stays within
        generated code; later ones go over the tokens.
        """
        found = None
        for one in self.steps:
            found = one.on_text(text) if found is None else one.on_column(found)
        return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(found)
