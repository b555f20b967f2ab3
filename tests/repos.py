"""Git repositories built for tests."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path


def git(repo: Path, *args: str, **env: str) -> None:
    subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env={**os.environ, **env})


def start(path: Path) -> Path:
    path.mkdir(parents=True)
    git(path, "init", "-q", "-b", "main")
    git(path, "config", "user.name", "Fixture")
    git(path, "config", "user.email", "fixture@localhost")
    return path


def commit(repo: Path, author: str, files: dict[str, str | bytes | None], at: int) -> None:
    for name, text in files.items():
        p = repo / name
        p.parent.mkdir(parents=True, exist_ok=True)
        if text is None:
            p.unlink()
        elif isinstance(text, bytes):
            p.write_bytes(text)
        else:
            p.write_text(text)
    git(repo, "add", "-A")
    stamp = f"{1_700_000_000 + at} +0000"
    git(repo, "commit", "-q", "-m", "c", f"--author={author} <{author}@mail.com>", GIT_AUTHOR_DATE=stamp, GIT_COMMITTER_DATE=stamp)


# Authors, files and contents of the next two repositories; expected counts depend on them.
def owned(path: Path, times: tuple[int, ...] = (0, 2, 4, 6, 8)) -> Path:
    """Three authors, two files, five commits; no file ends with a line end."""
    r = start(path)
    for at, (author, files) in zip(times, [
        ("author1", {"file1": "a"}), ("author2", {"file1": "a\nb"}), ("author1", {"file1": "a\nd\nc"}), ("author1", {"file1": "a\nc"}), ("author3", {"dir1/dir1.1/file2": "a\nb\nc\nd\ne"}),
    ], strict=True):
        commit(r, author, files, at)
    return r


def copied(path: Path) -> Path:
    """Four files that share runs of long lines."""
    r = start(path)
    a, b, c, x = ("".join(ch * 20) for ch in "abcx")
    for i, (author, files) in enumerate([
        ("author1", {"file1": f"{a}\n{b}"}), ("author2", {"file2": f"{a}\n{b}"}), ("author1", {"file3": f"{x}\n{b}\n{c}"}), ("author1", {"file4": f"{a}\n{c}\n{b}"}),
    ]):
        commit(r, author, files, i * 2)
    return r


def aged(path: Path) -> Path:
    """Old and young lines changed by their author and by others; a binary, a large and a deleted file."""
    r, day = start(path), 86_400
    commit(r, "ann", {"f": "one\ntwo\nthree\nfour\n", "bin": b"\0\1\2", "big": "x\n" * 50_000, "gone": "g\n", "a b/é.txt": "u\n"}, 0)
    commit(r, "bob", {"f": "ONE\ntwo\nthree\nfour\n"}, 30 * day)
    commit(r, "ann", {"f": "ONE\nTWO\nthree\nfour\n"}, 31 * day)
    commit(r, "bob", {"f": "oNe\nTWO\nthree\nfour\nfive\nsix\n"}, 32 * day)
    commit(r, "cid", {"f": "oNe\nTwO\nfour\nfive\nsix\n", "gone": None}, 33 * day)
    return r


def merged(path: Path) -> Path:
    """Two branches that change the same file, and a merge that takes both changes."""
    r, day = start(path), 86_400
    lines = [f"line {i} of the file" for i in range(12)]
    put = lambda **at: "".join((at.get(f"l{i}") or x) + "\n" for i, x in enumerate(lines))
    commit(r, "ann", {"f": put(), "g": "g\n"}, 0)
    git(r, "checkout", "-q", "-b", "side")
    commit(r, "bob", {"f": put(l1="side 1")}, day)
    git(r, "checkout", "-q", "main")
    commit(r, "cid", {"f": put(l10="main 10")}, 2 * day)
    git(r, "checkout", "-q", "side")
    commit(r, "bob", {"f": put(l1="side 2")}, 3 * day)
    git(r, "checkout", "-q", "main")
    stamp = f"{1_700_000_000 + 4 * day} +0000"
    git(r, "merge", "-q", "--no-ff", "-m", "m", "side", GIT_AUTHOR_DATE=stamp, GIT_COMMITTER_DATE=stamp)
    commit(r, "ann", {"f": put(l1="side 2", l10="main 11")}, 5 * day)
    return r
