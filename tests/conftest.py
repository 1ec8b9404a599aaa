import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from codestrata.session import local_session  # noqa: E402
from codestrata.sources.star_schema import open_star_schema  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def ds(spark):
    return open_star_schema(spark, SF_DIR)


class Repo:
    """A git repository for tests."""

    def __init__(self, path, *options):
        self.path = str(path)
        os.makedirs(self.path, exist_ok=True)
        subprocess.run(["git", "init", "-q", "-b", "main", *options, self.path], check=True)
        self.clock = 1_600_000_000

    def git(self, *arguments):
        self.clock += 60
        when = f"{self.clock} +0200"
        people = {
            "GIT_AUTHOR_NAME": "Ann Author",
            "GIT_AUTHOR_EMAIL": "ann@example.com",
            "GIT_AUTHOR_DATE": when,
            "GIT_COMMITTER_NAME": "Carl Committer",
            "GIT_COMMITTER_EMAIL": "carl@example.com",
            "GIT_COMMITTER_DATE": when,
        }
        done = subprocess.run(
            ["git", "-C", self.path, *arguments],
            env={**os.environ, **people},
            check=True,
            capture_output=True,
        )
        return done.stdout.decode("utf-8", "surrogateescape")

    def commit(self, files, message="change"):
        for name, content in files.items():
            target = os.path.join(self.path, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as out:
                out.write(content if isinstance(content, bytes) else content.encode())
        self.git("add", "-A")
        self.git("commit", "-q", "--allow-empty", "-m", message)
        return self.git("rev-parse", "HEAD").strip()


@pytest.fixture
def make_repo():
    return Repo
