"""Tracked files of git checkouts as a data source: one task for each checkout, read with plain git."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_id STRING, path STRING, revision STRING, clean BOOLEAN, is_regular BOOLEAN, content BINARY"


def git(folder: str, *arguments: str) -> bytes:
    done = subprocess.run(["git", "-C", folder, *arguments], capture_output=True, timeout=300, check=False)
    if done.returncode:
        raise ValueError(f"git {arguments[0]} failed in {folder}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def tracked(folder: str) -> list[str]:
    """Tracked paths by components; a path that leaves the checkout is an error."""
    names = sorted((n.decode("utf-8") for n in git(folder, "ls-files", "-z").split(b"\0") if n), key=lambda n: n.split("/"))
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        raise ValueError(f"unsafe path in {folder}")
    return names


class Checkout(InputPartition):
    def __init__(self, source_id: str, folder: str):
        self.source_id, self.folder = source_id, folder


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.most = int(options.get("max_bytes", 1_000_000))
        self.checkouts = [c.partition("=")[::2] for c in options.get("checkouts", "").split("\n") if c]

    def partitions(self) -> list[InputPartition]:
        return [Checkout(i, f) for i, f in self.checkouts]

    def read(self, partition: Checkout) -> Iterator[tuple]:
        folder = partition.folder
        revision = git(folder, "rev-parse", "HEAD").decode().strip()
        clean = not git(folder, "status", "--porcelain").strip()
        for name in tracked(folder):
            full = os.path.join(folder, name)
            regular = os.path.isfile(full) and not os.path.islink(full)
            content = None
            if regular:
                with open(full, "rb") as f:
                    content = f.read(self.most + 1)  # one byte more tells that a file is too large
            yield partition.source_id, name, revision, clean, regular, content


class GitTreeSource(DataSource):
    """``spark.read.format("git_tree").option("checkouts", "id=/folder\\nid2=/folder2").load()``"""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


STATE_SCHEMA = "source_id STRING, revision STRING, branch STRING, clean BOOLEAN, porcelain STRING, diff STRING, truncated BOOLEAN"
#: Characters of a diff that are kept.
DIFF_MOST = 100_000


def is_sensitive(path: str) -> bool:
    """The rule of ``functions.paths.is_sensitive`` for one path."""
    *folders, name = path.lower().split("/")
    return ".git" in path.split("/") or name == ".env" or name.startswith(".env.") or name.endswith((".key", ".pem")) and len(name) > 4


def diff(folder: str, staged: bool = False, path: str | None = None, most: int = DIFF_MOST) -> tuple[str, bool]:
    """(diff, truncated) of a checkout, or of one path in it, without protected files."""
    kind = ["diff", "--cached"] if staged else ["diff"]
    if path is not None:
        if path.startswith("/") or ".." in path.split("/") or is_sensitive(path):
            raise ValueError(f"refused to show {path}")
        names = [path]
    else:
        names = [n for n in git(folder, *kind, "--name-only", "-z").decode("utf-8", "surrogateescape").split("\0") if n and not is_sensitive(n)]
    if not names:
        return "", False
    text = git(folder, *kind, "--", *names).decode("utf-8", "replace")
    return text[:most], len(text) > most


class _StateReader(_Reader):
    def read(self, partition: Checkout) -> Iterator[tuple]:
        folder = partition.folder
        status = git(folder, "status", "--porcelain=v1", "--branch").decode("utf-8", "replace")
        text, cut = diff(folder)
        clean = all(line.startswith("##") for line in status.splitlines() if line)
        yield partition.source_id, git(folder, "rev-parse", "HEAD").decode().strip(), git(folder, "branch", "--show-current").decode().strip(), clean, status, text, cut


class GitStateSource(GitTreeSource):
    """``spark.read.format("git_state")`` with the options of ``git_tree``: one row a checkout, with what is changed in it."""

    @classmethod
    def name(cls) -> str:
        return "git_state"

    def schema(self) -> str:
        return STATE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _StateReader(dict(self.options))
