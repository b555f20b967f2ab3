"""Canonical tables read from a git repository.

The commit log and its changed paths come from one git process each; file sizes, previous versions,
blame and hunks, the costly part, are read by tasks over commits and files, from a clone that the
executors can reach, and checkpointed, so that no git process runs twice.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom import schema
from lineloom.session import with_checkpoints

#: The tree of no files.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
#: What git puts between fields and records for us; neither can occur in them.
FIELD, RECORD = "\x1f", "\x1e"
#: Paths given to one git process at most.
PATHS_AT_ONCE = 500


def git(repo: str, *args: str, ok: tuple[int, ...] = (0,)) -> bytes:
    run = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, check=False)
    if run.returncode not in ok:
        raise RuntimeError(f"git {' '.join(args[:2])}: {run.stderr.decode('utf-8', 'replace').strip()}")
    return run.stdout


def git_version() -> str:
    return subprocess.run(["git", "--version"], capture_output=True, check=True, text=True).stdout.strip()


def _minutes(stamp: str) -> int:
    return int(datetime.fromisoformat(stamp).utcoffset().total_seconds() // 60)


def commits(spark: SparkSession, repo: str, branch: str = "main") -> DataFrame:
    """commits of a branch; author mails in angle brackets, committer mails without."""
    form = FIELD.join(["%H", "%P", "%aN", "<%aE>", "%aI", "%cN", "%cE", "%cI"]) + RECORD
    rows = []
    for record in git(repo, "log", f"--format={form}", branch, "--").decode("utf-8", "replace").split(RECORD):
        if record.strip():
            h, parents, an, am, at, cn, cm, ct = record.strip("\n").split(FIELD)
            rows.append((h, parents.split(), an, am, datetime.fromisoformat(at), cn, cm, datetime.fromisoformat(ct), _minutes(ct)))
    return spark.createDataFrame(rows, schema.COMMITS)


def files_at(repo: str, commit: str, paths: list[str] | None = None) -> list[tuple[str, int, bool]]:
    """(path, size, is_binary) of a snapshot's files, or of some of them; paths that it lacks are left out."""
    out = []
    for i in range(0, len(paths), PATHS_AT_ONCE) if paths is not None else (0,):
        only = ["--", *[f":(literal){p}" for p in paths[i : i + PATHS_AT_ONCE]]] if paths is not None else []
        plain = ["--", *paths[i : i + PATHS_AT_ONCE]] if paths is not None else []
        # a line "-\t-\t" marks a file that differs from the empty tree in bytes only
        binary = {x.split(b"\t", 2)[2] for x in git(repo, "diff", "--numstat", "-z", "--no-renames", EMPTY_TREE, commit, *only).split(b"\0") if x.startswith(b"-\t-\t")}
        for entry in git(repo, "ls-tree", "-r", "-l", "-z", "--full-tree", commit, *plain).split(b"\0"):
            if entry:
                meta, path = entry.split(b"\t", 1)
                size = meta.split()[3]
                if size != b"-":  # submodules have no size
                    out.append((path.decode("utf-8", "replace"), int(size), path in binary))
    return out


def tree_files(spark: SparkSession, repo: str, commit_ids: list[str]) -> DataFrame:
    """tree_files of snapshots, a task for each batch of commits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b.commit_id:
                yield pd.DataFrame([(c, *f) for f in files_at(repo, c)], columns=["commit_id", "file_path", "size", "is_binary"])

    ids = spark.createDataFrame([(c,) for c in commit_ids], "commit_id string")
    return ids.repartition("commit_id").mapInPandas(run, schema.TREE_FILES)


def previous_version(repo: str, commit: str, path: str) -> str | None:
    """The commit before, by ancestry, that touched the path; of a commit that doesn't touch it the last one that does."""
    found = git(repo, "rev-list", "--parents", "-n", "1", commit, "--", path, ok=(0, 128)).decode().split()
    return None if not found else found[0] if found[0] != commit else found[1] if len(found) > 1 else None


def file_versions(touched: DataFrame, repo: str, max_bytes: int = 80_000) -> DataFrame:
    """commit_id, file_path, prev_commit_id of the rows of touched (commit_id, file_path) whose file
    is in its commit's tree, is text, and is not above max_bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, mine in b.groupby("commit_id"):
                rows = [(c, p, previous_version(repo, c, p)) for p, size, binary in files_at(repo, c, list(mine.file_path)) if size <= max_bytes and not binary]
                yield pd.DataFrame(rows, columns=["commit_id", "file_path", "prev_commit_id"])

    return touched.select("commit_id", "file_path").repartition("commit_id").mapInPandas(run, "commit_id string, file_path string, prev_commit_id string")


def commit_files(spark: SparkSession, repo: str, branch: str = "main") -> DataFrame:
    """commit_files: the paths that each commit changed; merges list none."""
    out = git(repo, "log", f"--format={RECORD}%H", "--name-only", "-z", "--root", "--no-renames", "--diff-merges=off", branch, "--").decode("utf-8", "replace")
    rows = []
    for record in out.split(RECORD):
        parts = [x.strip("\n") for x in record.split("\0")]
        rows += [(parts[0], p) for p in parts[1:] if p]
    return spark.createDataFrame(rows, schema.COMMIT_FILES)


def blame_file(repo: str, commit: str, path: str) -> list[tuple]:
    """(line number, author, mail, time, origin commit, contents) of each line of a file."""
    seen: dict[str, dict[str, str]] = {}
    out, now = [], ""
    for line in git(repo, "blame", "--porcelain", commit, "--", path).decode("utf-8", "replace").split("\n"):
        if line.startswith("\t"):
            info = seen[now]
            out.append((len(out) + 1, info["author"], info["author-mail"], int(info["author-time"]), now, line[1:]))
        elif m := re.match(r"([0-9a-f]{40}) \d+ \d+", line):
            now = m[1]
            seen.setdefault(now, {})
        elif now:
            key, _, value = line.partition(" ")
            seen[now].setdefault(key, value)
    return out


def blame(files: DataFrame, repo: str, keep_failures: bool = False) -> DataFrame:
    """blame_lines of the rows of files (commit_id, file_path), a batch of files a task.

    A file that git can't blame is an error; with keep_failures it is one row, of line 0, instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, p in zip(b.commit_id, b.file_path, strict=True):
                try:
                    rows = [(c, p, n, a, m, pd.Timestamp(t, unit="s"), o, text) for n, a, m, t, o, text in blame_file(repo, c, p)]
                except RuntimeError:
                    if not keep_failures:
                        raise
                    rows = [(c, p, 0, None, None, pd.NaT, None, None)]
                yield pd.DataFrame(rows, columns=["commit_id", "file_path", "line_number", "author_name", "author_mail", "author_ts", "origin_commit_id", "contents"])

    return files.select("commit_id", "file_path").repartition("commit_id", "file_path").mapInPandas(run, schema.BLAME_LINES)


HUNK_HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def hunks_of(repo: str, prev: str | None, commit: str, path: str) -> list[tuple]:
    """(op, src_from, src_to, dst_from, dst_to) between a file's two versions."""
    if not prev:
        n = len(blame_file(repo, commit, path))
        return [("New", 1, 0, 1, n)] if n else []
    out = []
    for line in git(repo, "diff", "-U0", "--no-color", "--no-ext-diff", "--no-renames", prev, commit, "--", path).decode("utf-8", "replace").split("\n"):
        if m := HUNK_HEADER.match(line):
            a, n, c, k = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            op = "Add" if n == 0 else "Delete" if k == 0 else "Change"
            out.append((op, a, a + n - 1, c, c + k - 1))
    return out


def hunks(versions: DataFrame, repo: str) -> DataFrame:
    """hunks of versions (commit_id, file_path, prev_commit_id); a diff that fails has none."""

    def found(c: str, p: str, prev: str | None) -> list[tuple]:
        try:
            return hunks_of(repo, prev, c, p)
        except RuntimeError:
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, p, prev in zip(b.commit_id, b.file_path, b.prev_commit_id, strict=True):
                rows = [(c, p, prev, *h) for h in found(c, p, prev)]
                yield pd.DataFrame(rows, columns=["commit_id", "file_path", "prev_commit_id", "op", "src_from", "src_to", "dst_from", "dst_to"])

    return versions.select("commit_id", "file_path", "prev_commit_id").repartition("file_path", "commit_id").mapInPandas(run, schema.HUNKS)


def commit_range(repo: str, branch: str, since: str = "", until: str = "") -> list[str]:
    """Ids of a range of commits, newest first: those that one end reaches and the other doesn't, and
    the commits just outside. One id alone if both ends are the same; the whole branch without ends."""
    if since and since == until:
        return [git(repo, "rev-parse", "--verify", f"{since}^{{commit}}").decode().strip()]
    wanted = f"{since}...{until}" if since or until else branch
    ids = [x.lstrip("-") for x in git(repo, "rev-list", "--boundary", wanted, "--").decode().split()]
    if not ids:
        if since and until:
            raise ValueError("since/until commit not found")
        return []
    ends = [git(repo, "rev-parse", "--verify", f"{x}^{{commit}}").decode().strip() if x else "" for x in (since, until)]
    if since and ids[-1] != ends[0]:
        raise ValueError("the since commit is not the last one of the range")
    if until and ids[0] != ends[1]:
        raise ValueError("the until commit is not the first one of the range")
    dates = [int(git(repo, "show", "-s", "--format=%ct", x).decode()) for x in (ids[-1], ids[0])]
    if dates[0] > dates[1]:
        raise ValueError("the since commit is later than the until commit")
    return ids


def line_touches(spark: SparkSession, repo: str, branch: str, commit_ids: list[str] | None = None, max_bytes: int = 80_000, files_where=None) -> DataFrame:
    """line_touches of commits of a branch (all of them, or some), through blame and hunks.

    A file that git can't blame at the commit or before it is left out.
    """
    from lineloom.operators.changes import touches_of_hunks

    with_checkpoints(spark)
    log = commits(spark, repo, branch)
    touched = commit_files(spark, repo, branch)
    if commit_ids is not None:
        touched = touched.join(spark.createDataFrame([(c,) for c in commit_ids], "commit_id string"), "commit_id", "left_semi")
    if files_where is not None:
        touched = touched.where(files_where)
    versions = file_versions(touched, repo, max_bytes).checkpoint()
    before = versions.where("prev_commit_id is not null").select(F.col("prev_commit_id").alias("commit_id"), "file_path").distinct()
    after, before = (blame(x, repo, keep_failures=True).checkpoint() for x in (versions, before))
    failed = after.where("line_number = 0").select("commit_id", "file_path")
    failed_before = before.where("line_number = 0").select(F.col("commit_id").alias("prev_commit_id"), "file_path")
    good = versions.join(failed, ["commit_id", "file_path"], "left_anti").join(failed_before, ["prev_commit_id", "file_path"], "left_anti")
    return touches_of_hunks(hunks(good, repo).checkpoint(), after, before, log)
