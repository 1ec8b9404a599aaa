"""Small per-repository helpers around the ``git`` program, run inside Spark tasks."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# Objects and bytes read by one task group.
SLICE_OBJECTS = 20_000
SLICE_BYTES = 64 << 20


def is_repository(path: str) -> bool:
    return os.path.exists(os.path.join(path, ".git")) or is_bare(path)


def is_bare(path: str) -> bool:
    return os.path.isfile(os.path.join(path, "HEAD")) and all(
        os.path.isdir(os.path.join(path, part)) for part in ("objects", "refs")
    )


def subdirectories(path: str) -> Iterator[str]:
    """Directories to search below ``path``; a repository's own store is not one."""
    if is_bare(path):
        return
    with os.scandir(path) as entries:
        for entry in entries:
            if entry.name != ".git" and entry.is_dir(follow_symlinks=False):
                yield entry.path


def _environment(path: str) -> dict[str, str]:
    return {
        **os.environ,
        "GIT_CEILING_DIRECTORIES": os.path.dirname(path),
        "GIT_NO_LAZY_FETCH": "1",
        "GIT_NO_REPLACE_OBJECTS": "1",
        "GIT_OPTIONAL_LOCKS": "0",
        "GIT_TERMINAL_PROMPT": "0",
    }


def _command(path: str, *arguments: str) -> list[str]:
    return ["git", "-c", "safe.directory=*", "-C", path, *arguments]


def run(path: str, *arguments: str, none_found: int | None = None) -> bytes:
    """Output of a git command; exit code ``none_found`` means an empty result."""
    done = subprocess.run(
        _command(path, *arguments), env=_environment(path), capture_output=True, check=False
    )
    if done.returncode == none_found:
        return b""
    if done.returncode:
        raise RuntimeError(f"git failed in {path}: {done.stderr.decode(errors='replace')}")
    return done.stdout


def text(data: bytes, encoding: str = "utf-8") -> str:
    """Text for a table cell; bytes that are not UTF-8 stay visible as escapes."""
    try:
        return data.decode(encoding)
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "backslashreplace")


def ref_rows(path: str) -> Iterator[tuple[str, str]]:
    """(ref name, object) with tags followed to what they name."""
    lines = run(path, "show-ref", "--head", "--dereference", none_found=1).splitlines()
    refs: dict[str, str] = {}
    for line in lines:
        target, name = text(line).split(" ", 1)
        refs[name.removesuffix("^{}")] = target
    yield from refs.items()


def remote_rows(path: str) -> Iterator[tuple[str, str]]:
    found = run(path, "config", "-z", "--get-regexp", r"^remote\..*\.url$", none_found=1)
    for entry in found.split(b"\0")[:-1]:
        key, _, url = text(entry).partition("\n")
        yield key[len("remote.") : -len(".url")], url


def object_rows(path: str) -> Iterator[tuple[str, str, int, int]]:
    """(hash, kind, size, slice) of all objects; a slice is read by one task."""
    command = _command(
        path,
        "cat-file",
        "--batch-all-objects",
        "--unordered",
        "--batch-check=%(objectname) %(objecttype) %(objectsize)",
    )
    part = count = held = 0
    with subprocess.Popen(command, env=_environment(path), stdout=subprocess.PIPE) as process:
        for line in process.stdout:
            name, kind, size = line.decode().split()
            yield name, kind, int(size), part
            count, held = count + 1, held + int(size)
            if count >= SLICE_OBJECTS or held >= SLICE_BYTES:
                part, count, held = part + 1, 0, 0
    if process.returncode:
        raise RuntimeError(f"git failed in {path}")


class ObjectReader:
    """Reads objects of one repository after another."""

    def __init__(self):
        self._path: str | None = None
        self._process: subprocess.Popen | None = None

    def read(self, path: str, name: str) -> bytes:
        if path != self._path:
            self.close()
            self._process = subprocess.Popen(
                _command(path, "cat-file", "--batch"),
                env=_environment(path),
                stdin=subprocess.PIPE,
                stdout=subprocess.PIPE,
            )
            self._path = path
        self._process.stdin.write(f"{name}\n".encode())
        self._process.stdin.flush()
        header = self._process.stdout.readline().split()
        if len(header) != 3:
            raise RuntimeError(f"cannot read {name} in {path}")
        data = self._process.stdout.read(int(header[2]))
        self._process.stdout.read(1)
        return data

    def close(self) -> None:
        if self._process is not None:
            self._process.stdin.close()
            self._process.stdout.close()
            self._process.wait()
            self._path = self._process = None


def commit_row(data: bytes) -> tuple:
    """Author, committer, message, tree and parents of a commit object."""
    head, _, message = data.partition(b"\n\n")
    tree, parents, people, encoding = "", [], {}, "utf-8"
    for line in head.split(b"\n"):
        key, _, value = line.partition(b" ")
        if key == b"tree":
            tree = value.decode()
        elif key == b"parent":
            parents.append(value.decode())
        elif key in (b"author", b"committer"):
            people[key] = value
        elif key == b"encoding":
            encoding = text(value)
    author = _signature(people.get(b"author", b""), encoding)
    committer = _signature(people.get(b"committer", b""), encoding)
    return (*author, *committer, text(message, encoding), tree, parents)


def _signature(value: bytes, encoding: str) -> tuple:
    """Name, email and time of ``Name <email> seconds zone``."""
    person, _, when = value.rpartition(b"> ")
    name, _, email = person.rpartition(b"<")
    try:
        time = _EPOCH + timedelta(seconds=int(when.split()[0]))
    except (IndexError, ValueError, OverflowError):
        time = None
    return text(name.strip(), encoding), text(email.strip(), encoding), time


def entry_rows(name: str, data: bytes) -> Iterator[tuple[str, str, str]]:
    """(entry hash, entry name, mode) of a tree object called ``name``."""
    width = len(name) // 2
    start = 0
    while start < len(data):
        space = data.index(b" ", start)
        end = data.index(b"\0", space)
        target = data[end + 1 : end + 1 + width].hex()
        yield target, text(data[space + 1 : end]), data[start:space].decode().zfill(6)
        start = end + 1 + width
