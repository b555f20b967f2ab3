"""Query parameters, checked before any job starts."""

from __future__ import annotations

import re
from dataclasses import dataclass


class OptionError(ValueError):
    """A parameter that no query can run with."""


#: Regex features that Java has and RE2 lacks; results would differ between engines.
UNPORTABLE = re.compile(r"\(\?[=!<]|\\[1-9]|[*+?}]\+")


def checked_regex(name: str, pattern: str) -> str:
    if UNPORTABLE.search(pattern):
        raise OptionError(f"{name}: lookaround, backreferences and possessive repeats are not supported: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise OptionError(f"{name}: {pattern!r} is no regular expression: {e}") from e
    return pattern


@dataclass(frozen=True)
class BaseOptions:
    repo: str = "."
    branch: str = "main"
    files: str = ".*"
    files_not: str = ""
    authors: str = ".*"
    authors_not: str = ""
    cache_file: str = ""
    cache_ttl_seconds: int = 5_184_000

    def __post_init__(self) -> None:
        for name in ("files", "files_not", "authors", "authors_not"):
            checked_regex(name, getattr(self, name))


@dataclass(frozen=True)
class OwnershipOptions(BaseOptions):
    when: str = "now"
    commit_id: str = ""
    min_duplicate_lines: int = 4
    max_file_bytes: int = 80_000
    min_line_bytes: int = 15

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.min_duplicate_lines <= 0:
            raise OptionError("min_duplicate_lines must be above 0")


@dataclass(frozen=True)
class OwnershipSeriesOptions(OwnershipOptions):
    since: str = "3 months ago"
    until: str = "now"
    period: str = "2 weeks"


@dataclass(frozen=True)
class ChangesOptions(BaseOptions):
    since: str = "30 days ago"
    until: str = "now"
    since_commit: str = ""
    until_commit: str = ""
    refactor_after_hours: int = 504
    max_file_bytes: int = 80_000
    include_boundary: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if (self.since_commit or self.until_commit) and (self.since or self.until):
            raise OptionError("give a range of dates or of commits, not both")


@dataclass(frozen=True)
class ChangesSeriesOptions(ChangesOptions):
    since: str = "90 days ago"
    period: str = "30 days"


def describe(options: BaseOptions) -> str:
    """One `name: value` line for each filled parameter."""
    pairs = [("repo", options.repo), ("branch", options.branch), ("files", options.files), ("files-not", options.files_not), ("authors", options.authors), ("authors-not", options.authors_not)]
    return "".join(f"{k}: {v}\n" for k, v in pairs if v)
