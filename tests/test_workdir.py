import os
import subprocess
import sys

import pytest

from codestrata.operators.layout import clustered, drop_copy
from codestrata.plans import analyses
from codestrata.schema import TABLES
from codestrata.sources import workdir
from codestrata.sources.workdir import open_workdir

TRIM = "def f(s):\n    return trim(s)\n"


def ids(ds):
    return sorted(r.repository_id for r in ds.table("repositories").collect())


def test_empty_repository(spark, tmp_path, make_repo):
    make_repo(tmp_path / "reponame")
    ds = open_workdir(spark, str(tmp_path))
    assert [tuple(r) for r in ds.sql("select * from repositories").collect()] == [("reponame",)]
    assert all(ds.table(t).isEmpty() for t in ("commits", "refs", "ref_commits", "files", "blobs"))


def test_invalid_directory(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        open_workdir(spark, str(tmp_path / "missing"))


def test_current_directory_is_the_default(spark, tmp_path, make_repo, monkeypatch):
    make_repo(tmp_path)
    monkeypatch.chdir(tmp_path)
    assert ids(open_workdir(spark)) == [tmp_path.name]


def test_refresh_and_switch(spark, tmp_path, make_repo):
    one, two = tmp_path / "one", tmp_path / "two"
    make_repo(one / "repo_a").commit({"LICENSE": "free"})
    make_repo(two / "sub" / "repo_b")
    first = open_workdir(spark, str(one))
    copy = clustered(first, "repositories", ["repository_id"])
    make_repo(one / "repo_c")
    assert ids(first) == ids(open_workdir(spark, str(one))) == ["repo_a"]
    assert ids(open_workdir(spark, str(two))) == ["sub/repo_b"]
    fresh = open_workdir(spark, str(one), refresh=True)
    assert ids(fresh) == ["repo_a", "repo_c"]
    assert ids(first) == ["repo_a"]
    # A copy outlives the switch and is stale until rebuilt.
    again = clustered(fresh, "repositories", ["repository_id"])
    assert again.inputFiles() == copy.inputFiles() and again.count() == 1
    assert clustered(fresh, "repositories", ["repository_id"], rebuild=True).count() == 2


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Two repositories with a merge, shared content, odd files, and a bare clone."""
    from conftest import Repo

    root = tmp_path_factory.mktemp("world")
    repo = Repo(root / "main")
    repo.commit({"LICENSE": "free", "src/a.py": TRIM, "src/deep/er/b.py": TRIM}, "first\n\nbody")
    repo.commit({"data.bin": bytes(range(256)), "empty": ""}, "second")
    repo.git("checkout", "-q", "-b", "side", "HEAD~1")
    repo.commit({"page.html": "<p><a href=x>y</a>", "tool": "#!/usr/bin/env python\ntrim(1)\n"})
    repo.git("checkout", "-q", "main")
    repo.commit({"src/a.py": "def g(): pass\n"}, "third")
    repo.git("merge", "-q", "-m", "merge", "side")
    os.symlink("LICENSE", f"{repo.path}/link")
    with open(os.path.join(repo.path.encode(), b"bad-\xff.txt"), "wb") as out:
        out.write(b"odd name")
    Repo(root / "main" / "vendor" / "inner").commit({"in.json": "[]"})
    repo.commit({}, "odd files and a repository within")
    repo.commit({}, "same tree again")
    repo.git("tag", "-a", "-m", "tag", "v1")
    repo.git("tag", "tree-tag", "HEAD^{tree}")
    repo.git("remote", "add", "origin", "https://example.com/main.git")
    other = Repo(root / "group" / "other")
    other.commit({"COPY": "free", "x.json": '{"k": [1, 2]}'})
    Repo(root / "long", "--object-format=sha256").commit({"d/LICENSE": "free", "LICENSE": "free"})
    other.git("clone", "-q", "--bare", repo.path, str(root / "bare.git"))
    return repo, open_workdir(spark, str(root))


def test_repositories_and_remotes(world):
    repo, ds = world
    assert ids(ds) == ["bare.git", "group/other", "long", "main", "main/vendor/inner"]
    remotes = {tuple(r) for r in ds.table("remotes").collect()}
    assert ("main", "origin", "https://example.com/main.git") in remotes
    assert ("bare.git", "origin", repo.path) in remotes


def test_commits(world):
    repo, ds = world
    names = "%H %T %P|%an|%ae|%at|%cn|%ce|%ct"
    expected = {}
    for line in repo.git("log", "--all", f"--format={names}").splitlines():
        hashes, *people = line.split("|")
        commit, tree, *parents = hashes.split()
        expected[commit] = (tree, parents, people)
    rows = ds.table("commits").where("repository_id = 'main'").collect()
    assert {r.commit_hash for r in rows} == set(expected)
    for r in rows:
        tree, parents, people = expected[r.commit_hash]
        assert r.tree_hash == tree
        assert r.commit_parents == "[" + ",".join(f'"{p}"' for p in parents) + "]"
        author, committer = r.commit_author_when.timestamp(), r.committer_when.timestamp()
        assert people == [
            r.commit_author_name,
            r.commit_author_email,
            str(int(author)),
            r.committer_name,
            r.committer_email,
            str(int(committer)),
        ]
    assert "first\n\nbody\n" in {r.commit_message for r in rows}


def test_refs_and_history(world):
    repo, ds = world
    refs = {(r.ref_name, r.commit_hash) for r in ds.table("refs").where("repository_id = 'main'").collect()}
    head = repo.git("rev-parse", "HEAD").strip()
    side = repo.git("rev-parse", "side").strip()
    assert refs == {
        ("HEAD", head),
        ("refs/heads/main", head),
        ("refs/heads/side", side),
        ("refs/tags/v1", head),
        ("refs/tags/tree-tag", repo.git("rev-parse", "HEAD^{tree}").strip()),
    }
    walked = {r.ref_name for r in ds.table("ref_commits").where("repository_id = 'main'").collect()}
    assert walked == {name for name, _ in refs} - {"refs/tags/tree-tag"}
    parents = {
        c: p for c, *p in (line.split() for line in repo.git("rev-list", "--parents", "--all").splitlines())
    }
    distance, queue = {head: 0}, [head]
    for commit in queue:
        for parent in parents[commit]:
            if parent not in distance:
                distance[parent] = distance[commit] + 1
                queue.append(parent)
    walked = ds.table("ref_commits").where("repository_id = 'main' AND ref_name = 'HEAD'")
    assert {r.commit_hash: r.history_index for r in walked.collect()} == distance


def test_files_of_every_commit(world):
    repo, ds = world
    expected = set()
    for commit in repo.git("rev-list", "--all").split():
        for line in repo.git("-c", "core.quotePath=off", "ls-tree", "-r", "-z", commit).split("\0")[:-1]:
            meta, path = line.split("\t", 1)
            if meta.split()[1] == "commit":
                continue
            path = path.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")
            expected.add((commit, path, meta.split()[2]))
    files = ds.table("commit_files").where("repository_id = 'main'")
    rows = [(r.commit_hash, r.file_path, r.blob_hash) for r in files.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert "bad-\\xff.txt" in {row[1] for row in rows}
    blobs = {(c, b) for c, _, b in expected}
    got = ds.table("commit_blobs").where("repository_id = 'main'").collect()
    assert sorted((r.commit_hash, r.blob_hash) for r in got) == sorted(blobs)


def test_trees(world):
    repo, ds = world
    expected = set()
    for commit in repo.git("rev-list", "--all").split():
        expected.add((commit, repo.git("rev-parse", f"{commit}^{{tree}}").strip()))
        for line in repo.git("ls-tree", "-r", "-d", commit).splitlines():
            if line.split()[1] == "tree":
                expected.add((commit, line.split()[2]))
    got = ds.table("commit_trees").where("repository_id = 'main'").collect()
    assert sorted((r.commit_hash, r.tree_hash) for r in got) == sorted(expected)
    head_tree = repo.git("rev-parse", "HEAD^{tree}").strip()
    entries = ds.table("tree_entries").where(f"repository_id = 'main' AND tree_hash = '{head_tree}'")
    names = {r.tree_entry_name: r.tree_entry_mode for r in entries.collect()}
    inner = ds.table("tree_entries").where("tree_entry_name = 'inner'").first()
    assert inner.tree_entry_mode == "160000"
    assert names["src"] == "040000" and names["link"] == "120000" and names["LICENSE"] == "100644"


def test_long_hashes(world):
    _, ds = world
    files = ds.table("files").where("repository_id = 'long'").collect()
    assert sorted(r.file_path for r in files) == ["LICENSE", "d/LICENSE"]
    assert all(len(r.blob_hash) == 64 and bytes(r.blob_content) == b"free" for r in files)


def test_content_is_stored_once(world):
    repo, ds = world
    assert ds.contents.count() == ds.contents.select("blob_hash").distinct().count()
    data = repo.git("rev-parse", "HEAD:data.bin").strip()
    rows = ds.table("blobs").where(f"blob_hash = '{data}'").collect()
    assert sorted(r.repository_id for r in rows) == ["bare.git", "main"]
    assert all(bytes(r.blob_content) == bytes(range(256)) and r.blob_size == 256 for r in rows)
    licenses = analyses.license_blobs(ds).collect()
    assert licenses and all(bytes(r.blob_content) == b"free" for r in licenses)


def test_code_questions(world):
    _, ds = world
    calls = {(r.repository_id, r.file_path) for r in analyses.files_calling(ds, "trim").collect()}
    paths = {"src/deep/er/b.py", "tool"}
    assert calls == {(r, p) for r in ("main", "bare.git") for p in paths}
    functions = analyses.functions_of_language(ds, "python").where("repository_id = 'main'")
    assert {r.file_path: r.functions is not None for r in functions.collect()} == {
        "src/a.py": True,
        "src/deep/er/b.py": True,
        "tool": False,
    }


def test_documented_sql(world):
    _, ds = world
    head = ds.sql(
        "SELECT * FROM (SELECT cf.file_path, UAST(f.blob_content, LANGUAGE(f.file_path, f.blob_content)) as uast "
        "FROM ref_commits r NATURAL JOIN commit_files cf NATURAL JOIN files f "
        "WHERE r.ref_name = 'HEAD' AND r.history_index = 0) t WHERE uast != ''"
    )
    job = analyses.uast_at_head(ds)
    assert sorted(map(tuple, head.collect())) == sorted(map(tuple, job.collect()))
    calls = ds.sql(
        "SELECT * FROM (SELECT files.repository_id, files.file_path, UAST(files.blob_content, "
        "LANGUAGE(files.file_path, files.blob_content), '//*[@roleCallee]/Identifier[@Name=\"trim\"]') as functionCall "
        "FROM files NATURAL JOIN commit_files NATURAL JOIN commits NATURAL JOIN refs "
        "WHERE refs.ref_name = 'HEAD') t WHERE ARRAY_LENGTH(functionCall) > 0"
    )
    found = sorted((r.repository_id, r.file_path) for r in calls.collect())
    job = analyses.files_calling(ds, "trim").collect()
    assert found == sorted((r.repository_id, r.file_path) for r in job)
    counts = ds.sql(
        "SELECT f.repository_id, COUNT(*) num_files FROM ref_commits r NATURAL JOIN commit_files cf "
        "NATURAL JOIN files f WHERE r.ref_name = 'HEAD' GROUP BY f.repository_id"
    )
    top = analyses.top_repositories_by_files(ds)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, top.collect()))


REOPEN = """
import sys
sys.path.insert(0, {root!r})
from codestrata.operators.layout import clustered, copies
from codestrata.session import local_session
from codestrata.sources import workdir
workdir.build = None  # must not be needed
spark = local_session("reopen", 2)
ds = workdir.open_workdir(spark, {source!r}, store={store!r})
assert list(copies(ds)) == [("commits", ("commit_hash",))], copies(ds)
print("FOUND", ds.table("commits").count(), ds.table("files").count(), clustered(ds, "commits", ["commit_hash"]).count())
"""


def test_stored_snapshot_is_opened_by_another_application(spark, tmp_path, make_repo):
    repo = make_repo(tmp_path / "work" / "repo")
    repo.commit({"a.py": "x = 1", "b.json": "[1]"})
    source, store = str(tmp_path / "work"), str(tmp_path / "store")
    ds = open_workdir(spark, source, store=store)
    clustered(ds, "commits", ["commit_hash"])
    clustered(ds, "refs", ["ref_name"])
    drop_copy(ds, "refs", ["ref_name"])
    repo.commit({"a.py": "x = 2"})
    script = REOPEN.format(root=os.path.dirname(os.path.dirname(__file__)), source=source, store=store)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=200)
    assert "FOUND 1 2 1" in done.stdout, done.stderr[-2000:]
    other = spark.newSession()
    assert open_workdir(other, source, store=store).table("commits").count() == 1
    assert open_workdir(spark, source, refresh=True, store=store).table("commits").count() == 2
    assert open_workdir(other, source, store=store).table("commits").count() in (1, 2)
    with pytest.raises(KeyError):
        drop_copy(ds, "refs", ["ref_name"])


def same_tables(got, expected):
    for name in TABLES:
        left, right = got.table(name), expected.table(name)
        assert left.count() == right.count(), name
        assert left.exceptAll(right).isEmpty(), name


@pytest.mark.parametrize("kept", [False, True])
def test_refresh_reads_only_changed_repositories(spark, tmp_path, make_repo, monkeypatch, kept):
    listed = []
    plain = workdir._listed

    def listing(repositories, rows, schema):
        if schema is workdir._OBJECTS:
            listed.append(sorted(r.repository_id for r in repositories.collect()))
        return plain(repositories, rows, schema)

    monkeypatch.setattr(workdir, "_listed", listing)
    root = tmp_path / "work"
    repos = {name: make_repo(root / name) for name in ("a", "b", "c")}
    for name, repo in repos.items():
        repo.commit({"LICENSE": "free", "src/x.py": f"{name} = 1\n"})
    store = {"store": str(tmp_path / "store")} if kept else {}
    first = open_workdir(spark, str(root), **store)
    assert listed.pop() == ["a", "b", "c"]
    steps = [
        (lambda: repos["b"].commit({"src/y.py": "y = 2\n", "copy": "free"}), ["b"]),
        (lambda: repos["a"].git("tag", "v1"), ["a"]),
        (lambda: make_repo(root / "d").commit({"z.json": "[1]"}), ["d"]),
        (lambda: os.rename(root / "c", tmp_path / "gone"), []),
        (lambda: None, []),
    ]
    for change, read in steps:
        change()
        fresh = open_workdir(spark, str(root), refresh=True, **store)
        assert listed.pop() == read
    assert ids(first) == ["a", "b", "c"] and ids(fresh) == ["a", "b", "d"]
    assert first.table("commits").count() == 3 and fresh.table("commits").count() == 4
    # Content read before is neither read nor written again.
    assert set(first.contents.inputFiles()) <= set(fresh.contents.inputFiles())
    assert fresh.contents.count() == fresh.contents.select("blob_hash").distinct().count()
    if kept:
        reopened = open_workdir(spark.newSession(), str(root), **store)
        assert reopened.contents.inputFiles() and not listed
        assert reopened.table("files").count() == fresh.table("files").count()
    whole = open_workdir(spark, str(root), reread=True, **store)
    assert listed.pop() == ["a", "b", "d"]
    same_tables(fresh, whole)
