"""What can go wrong, each with the HTTP status a service would answer with."""

from __future__ import annotations


class LodestoneError(Exception):
    status = 500


class InvalidRequest(LodestoneError):
    """The request can't be read."""

    status = 400


class NotFound(LodestoneError):
    status = 404


class IndexNotFound(NotFound):
    def __init__(self, name: str) -> None:
        super().__init__(f"no index is called {name!r}")


class DocumentNotFound(NotFound):
    def __init__(self, guid: object) -> None:
        super().__init__(f"no document has the id {guid!r}")


class ValidationError(LodestoneError):
    """Carries a message for each faulty part, by its path."""

    status = 422

    def __init__(self, problems: dict[str, str] | str) -> None:
        self.problems = {"": problems} if isinstance(problems, str) else problems
        super().__init__("; ".join(f"{k}: {v}" if k else v for k, v in self.problems.items()))


class IndexAlreadyExists(LodestoneError):
    status = 422

    def __init__(self, name: str) -> None:
        super().__init__(f"an index called {name!r} exists")


class UnknownKind(LodestoneError):
    """A query, aggregation or analyzer of a type that doesn't exist."""
