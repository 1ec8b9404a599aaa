"""A dataset: the stored relations of a snapshot and the eleven tables over them.

Stored relations hold each fact once:

* ``contents``: one row per distinct blob, shared by all repositories;
* ``tree_files``: the file list of each distinct root tree, with languages. A
  snapshot keeps the lists at the tips of refs in folders of their own;
* ``tree_entries`` and ``subtrees``: the entries of each tree and the trees
  below each root tree. Left out when trees are flat;
* ``tree_files_by_tree`` and ``commit_roots``: ``tree_files``, and the root trees of
  ``commits``, both dealt out by tree: joins of all file lists then shuffle neither.
  Left out where a source has file lists in one order;
* ``blob_languages``: the distinct ``blob_hash, language`` of the file lists. Left out
  where a source has no cheaper way to them than the lists;
* ``hot_trees`` and ``hot_blobs``: trees that very many commits share and
  blobs that very many files share. Joins split them. Left out when empty.

``commit_files``, ``files``, ``blobs``, ``commit_blobs`` and ``commit_trees``
are joins over them, so a path query never reads content and a file list is
not repeated for every commit that shares its tree. ``files`` is an outer join
on a unique key: where no content is asked for, the join drops out of the plan.
A tree names a path once, so ``commit_files`` and ``files`` name the same rows of
``tree_files``; ``joined`` and ``count_joined`` read them once.
"""

from __future__ import annotations

import re
import uuid
import weakref
from collections.abc import Callable, Iterator, Mapping, MutableMapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.functions.language import language_of_content
from codestrata.operators.joins import count_over_join, hot_keys, natural_join, split_join
from codestrata.operators.languages import with_language
from codestrata.schema import SCHEMAS, TABLES
from codestrata.scratch import counted, materialize, scratch_root

STORED = (
    "repositories",
    "remotes",
    "refs",
    "ref_commits",
    "commits",
    "tree_files",
    "contents",
)

# File lists, and commits with their root trees, dealt out by tree.
BY_TREE, ROOTS = "tree_files_by_tree", "commit_roots"

# Blobs with the languages of their paths.
BLOBS = "blob_languages"

HEAD = "HEAD"

# Values of ``tip`` in stored file lists, in this order: what has the tree at its tip.
AT_HEAD, AT_REF, IN_HISTORY = "HEAD", "ref", "none"

# Rows of one key in one join group; keys with more are split.
COMMITS_PER_TREE = 1000
FILES_PER_BLOB = 100_000

# Columns that name a row of a relation.
_KEYS = {
    "commits": ("repository_id", "commit_hash"),
    "ref_commits": ("repository_id", "ref_name", "commit_hash"),
    "refs": ("repository_id", "ref_name"),
    "tree_files": ("repository_id", "tree_hash", "file_path"),
}

# What orders joins by cost. What a join shuffles is bytes, so the size of what it makes weighs most.
_ORDER_JOINS = {
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.cbo.joinReorder.card.weight": "0.1",
}

# Rows dealt by tree serve a join on the tree and more as they are.
_JOIN_AS_DEALT = "spark.sql.requireAllClusterKeysForCoPartition"

# Columns that file lists are counted by.
_FILE_KEYS = ("repository_id", "tree_hash", "file_path", "blob_hash")

# Relations behind the views that SQL joins by commit or tree, and the columns they meet on.
_COUNTED = {
    "refs": ("repository_id", "commit_hash"),
    "ref_commits": ("repository_id", "commit_hash"),
    "commits": ("repository_id", "commit_hash", "tree_hash"),
    "tree_files": _FILE_KEYS,
    BY_TREE: _FILE_KEYS,
    ROOTS: ("repository_id", "commit_hash", "tree_hash"),
}
_BEHIND = {
    "files": ("tree_files",),
    "commit_files": ("commits", "tree_files"),
    "commit_trees": ("commits",),
    "classified_files": ("tree_files",),
}

_FILE_LISTS = T.StructType([f for f in SCHEMAS["files"] if not f.name.startswith("blob_c")])
_CONTENTS = T.StructType([f for f in SCHEMAS["blobs"] if f.name.startswith("blob_")])


class Relations(MutableMapping):
    """Relations by name; one given as a function is made when it is first read."""

    def __init__(self, relations: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        given = relations._given if isinstance(relations, Relations) else relations
        self._given = {n: df if isinstance(df, DataFrame) else cache(df) for n, df in given.items()}

    def __getitem__(self, name: str) -> DataFrame:
        given = self._given[name]
        if not isinstance(given, DataFrame):
            given = self._given[name] = given()
        return given

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._given[name] = df

    def __delitem__(self, name: str) -> None:
        del self._given[name]

    def __contains__(self, name: object) -> bool:
        return name in self._given

    def __iter__(self) -> Iterator[str]:
        return iter(self._given)

    def made(self, name: str) -> bool:
        """Whether the relation is there without being made."""
        return isinstance(self._given.get(name), DataFrame)

    def __len__(self) -> int:
        return len(self._given)


VIEWS = (*TABLES, "classified_files")

# The dataset whose views a session has.
_registered: weakref.WeakKeyDictionary[SparkSession, weakref.ref[Dataset]] = weakref.WeakKeyDictionary()


class Dataset:
    def __init__(
        self, spark: SparkSession, stored: Mapping[str, DataFrame], folder: str | None = None
    ):
        """``folder`` is where this source keeps tables derived later."""
        missing = [name for name in STORED if name not in stored]
        if missing:
            raise ValueError(f"missing relations: {missing}")
        self.spark = spark
        self.stored = Relations(stored)
        # Hot keys that are looked for when a join first asks for them.
        self._unsearched: set[str] = set()
        # Relations whose rows are counted for the planner.
        self._counted: set[str] = set()
        # Folders of the relations of a kept snapshot.
        self.paths: dict[str, list[str]] = {}
        self.folder = folder or f"{scratch_root(spark)}/unnamed-{uuid.uuid4().hex}"

    @classmethod
    def empty(cls, spark: SparkSession) -> Dataset:
        """All tables without rows: what there is before a source is opened."""
        schemas = {**SCHEMAS, "tree_files": _FILE_LISTS, "contents": _CONTENTS}
        return cls(spark, {name: spark.createDataFrame([], schemas[name]) for name in STORED})

    def find_hot(
        self,
        commits_per_tree: int = COMMITS_PER_TREE,
        files_per_blob: int = FILES_PER_BLOB,
        later: bool = False,
    ) -> None:
        """Note the trees and blobs with too many rows for one join group.

        ``later`` looks for them when a join first asks.
        """
        self._limits = {"hot_trees": commits_per_tree, "hot_blobs": files_per_blob}
        self._unsearched = set(self._limits)
        if not later:
            for name in self._limits:
                self.hot(name)

    def hot(self, name: str) -> DataFrame | None:
        """``hot_trees`` or ``hot_blobs``; None where there are none."""
        if name in self._unsearched:
            # Rows in any order will do.
            if name == "hot_trees":
                commits = ROOTS if self.stored.made(ROOTS) else "commits"
                rows, keys = self.stored[commits], ["repository_id", "tree_hash"]
            else:
                lists = BY_TREE if self.stored.made(BY_TREE) else "tree_files"
                rows, keys = self.stored[lists], ["blob_hash"]
            found = materialize(hot_keys(rows, keys, self._limits[name]), name)
            self._unsearched.discard(name)
            if not found.isEmpty():
                self.stored[name] = found
        return self.stored.get(name)

    # Relations the tables are built from.

    @property
    def contents(self) -> DataFrame:
        """``blob_hash, blob_size, blob_content, content_language``: every distinct blob once.

        ``content_language`` is what the first line tells; sources store it, so
        that classifying files reads no content.
        """
        contents = self.stored["contents"]
        if "content_language" in contents.columns:
            return contents
        return contents.withColumn("content_language", language_of_content())

    @property
    def classified_files(self) -> DataFrame:
        """``files`` without content, with the ``language`` of each file."""
        return self._classified_files("tree_files")

    def _classified_files(self, lists: str) -> DataFrame:
        return with_language(self.stored[lists], self.contents).drop("tip")

    @property
    def classified_blobs(self) -> DataFrame:
        """``blob_hash, language`` of all files, a pair at least once; lists are not made for it."""
        if BLOBS in self.stored and not self.stored.made("tree_files"):
            return self.stored[BLOBS]
        return self.classified_files.select("blob_hash", "language")

    def classified_files_at_tips(self, ref: str) -> DataFrame:
        """``classified_files`` of few more trees than those at the tip of ``ref``.

        Where file lists tell their tips, only those of ``HEAD``, or of all refs, are read.
        """
        files = self.stored["tree_files"]
        if "tip" in files.columns:
            at = [AT_HEAD] if ref == HEAD else [AT_HEAD, AT_REF]
            files = files.where(F.col("tip").isin(at)).drop("tip")
        return with_language(files, self.contents)

    @property
    def tree_files(self) -> DataFrame:
        """``files`` without content: ``repository_id, file_path, blob_hash, tree_hash``."""
        return self.file_rows("tree_files")

    def file_rows(self, lists: str) -> DataFrame:
        """``tree_files`` as the stored relation ``lists`` has them."""
        return self.stored[lists].select("repository_id", "file_path", "blob_hash", "tree_hash")

    @property
    def lists_by_tree(self) -> str:
        """The relation that has the file lists in the best order for joins by tree.

        Rows dealt by tree cannot be split: much-shared trees need the other order. The
        session is told that joins may leave dealt rows where they are.
        """
        if not {BY_TREE, ROOTS} <= set(self.stored):
            return "tree_files"
        self.stored[ROOTS]
        if self.hot("hot_trees") is not None:
            return "tree_files"
        self.spark.conf.set(_JOIN_AS_DEALT, "false")
        return BY_TREE

    def with_content(self, files: DataFrame) -> DataFrame:
        """Add content by hash. Call it last, on as few files as possible."""
        return self.join_by_blob(files, self.contents.drop("content_language"))

    def with_content_of_few(self, files: DataFrame) -> DataFrame:
        """``with_content`` for a selection of files.

        Their hashes are written first. The planner then knows the size of that
        table: content is not shuffled when it fits a broadcast, and is shuffled
        once, for both joins, when it does not.
        """
        hashes = materialize(files.select("blob_hash").distinct(), "hashes")
        few = self.contents.drop("content_language").join(hashes, "blob_hash", "left_semi")
        return self.join_by_blob(files, few)

    def join_by_blob(
        self, files: DataFrame, by_blob: DataFrame, keys: Sequence[str] = ("blob_hash",), how: str = "inner"
    ) -> DataFrame:
        """Join files with one row per blob; much-copied blobs are split."""
        hot = self.hot("hot_blobs")
        return split_join(files, by_blob, list(keys), files.columns, hot, how)

    def join_by_tree(self, by_tree: DataFrame, lists: str = "tree_files") -> DataFrame:
        """Join every commit with the rows of its root tree; much-shared trees are split.

        ``lists`` is the relation that ``by_tree`` is read from.
        """
        commits = self.stored[ROOTS if lists == BY_TREE else "commits"]
        commits = commits.select("repository_id", "commit_hash", "tree_hash")
        hot = self.hot("hot_trees")
        return split_join(commits, by_tree, ["repository_id", "tree_hash"], ["commit_hash"], hot)

    def remembered(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A small table derived from this snapshot, written on first use."""
        if name not in self.stored:
            self.stored[name] = materialize(build(), "remembered")
        return self.stored[name]

    # The eleven tables.

    def table(self, name: str, lists: str = "tree_files") -> DataFrame:
        """The table; ``lists`` is the relation that file rows are read from."""
        if name not in SCHEMAS:
            raise KeyError(f"table not found: {name}")
        builder = getattr(self, f"_{name}", None)
        df = builder(lists) if builder else self.stored[name]
        return df.select(*SCHEMAS[name].fieldNames())

    def _files(self, lists: str) -> DataFrame:
        files, hot = self.file_rows(lists), self.hot("hot_blobs")
        contents = self.contents.drop("content_language")
        return split_join(files, contents, ["blob_hash"], files.columns, hot, "left", unique=True)

    def _commit_files(self, lists: str) -> DataFrame:
        return self.join_by_tree(self.file_rows(lists), lists)

    def _blobs(self, lists: str) -> DataFrame:
        owned = self.stored.get("owned_blobs")
        if owned is None:
            owned = self.file_rows(lists).select("repository_id", "blob_hash").distinct()
        return self.with_content(owned)

    def _commit_blobs(self, lists: str) -> DataFrame:
        # Distinct per tree first: commits are unique, so the join keeps rows distinct.
        # File rows are shuffled at most once for both; paths, which lists are sorted by, are not read.
        lists, key = self.lists_by_tree, ["repository_id", "tree_hash"]
        per_tree = self.file_rows(lists).select(*key, "blob_hash")
        if lists != BY_TREE:
            per_tree = per_tree.repartition(*key)
        return self.join_by_tree(per_tree.distinct(), lists)

    def _tree_entries(self, lists: str) -> DataFrame:
        if "tree_entries" in self.stored:
            return self.stored["tree_entries"]
        return self.file_rows(lists).select(
            "repository_id",
            "tree_hash",
            "blob_hash",
            F.col("file_path").alias("tree_entry_name"),
            F.lit("100644").alias("tree_entry_mode"),
        )

    def _commit_trees(self, lists: str) -> DataFrame:
        roots = self.stored["commits"].select("repository_id", "commit_hash", "tree_hash")
        if "subtrees" not in self.stored:
            return roots
        below = self.join_by_tree(self.stored["subtrees"]).select(
            "repository_id", "commit_hash", F.col("subtree_hash").alias("tree_hash")
        )
        return roots.unionByName(below)

    # Natural joins of the tables.

    def joined(self, *names: str) -> DataFrame:
        """Natural join of the named tables, left to right.

        Where ``commit_files`` and ``files`` are both named, the file lists are
        read once, and content only if it is selected.
        """
        tables, merged = [], False
        for name in names:
            if name in ("commit_files", "files") and {"commit_files", "files"} <= set(names):
                if not merged:
                    tables.append(self.join_by_tree(self.table("files")))
                merged = True
            else:
                tables.append(self.table(name))
        return natural_join(*tables)

    def count_joined(
        self,
        names: Sequence[str],
        by: Sequence[str],
        alias: str = "n",
        where: Mapping[str, Column | str] | None = None,
    ) -> DataFrame:
        """Rows per ``by`` of the natural join of the named tables, without making them.

        ``where`` filters tables by name before they are joined. A commit's file
        rows are counted once per tree, a commit once however many refs reach it.
        """
        where = dict(where or {})
        unknown = set(where) - set(names)
        if unknown:
            raise ValueError(f"filters of tables that are not joined: {sorted(unknown)}")
        tables: dict[str, DataFrame] = {}
        for name in dict.fromkeys(names):
            if name in ("commit_files", "files") and name not in where:
                tables["tree_files"] = self.tree_files
                if name == "commit_files" and "commits" not in names:
                    tables["commits"] = self.stored["commits"].select(
                        "repository_id", "commit_hash", "tree_hash"
                    )
            else:
                table = self.table(name)
                tables[name] = table.where(where[name]) if name in where else table
        # File rows are the most: they meet what is left of commits and refs, once per tree.
        ordered = sorted(tables, key=lambda name: name in ("tree_files", "commit_files", "files"))
        return count_over_join([(tables[name], _KEYS.get(name, ())) for name in ordered], by, alias)

    def count_relations(self, views: Sequence[str]) -> None:
        """Count the rows behind ``views``, and let the planner order joins by such counts."""
        behind = {name for view in views for name in _BEHIND.get(view, (view,))}
        if "tree_files" in behind and self.lists_by_tree == BY_TREE:
            behind = behind - {"tree_files"} | {BY_TREE, ROOTS}
            if not {"commits", "commit_trees"} & set(views):
                behind.discard("commits")
        for name in behind:
            if name in _COUNTED and name not in self._counted:
                self.stored[name] = counted(self.stored[name], _COUNTED[name])
                self._counted.add(name)
        for key, value in _ORDER_JOINS.items():
            self.spark.conf.set(key, value)

    def register(self, names: Sequence[str] | None = None, lists: str = "tree_files") -> None:
        """Create the read-only views (default: the eleven and ``classified_files``) and the code functions.

        ``lists`` is the relation that file rows are read from.
        """
        from codestrata.functions.sql import register_functions

        for name in VIEWS if names is None else names:
            view = self._classified_files(lists) if name == "classified_files" else self.table(name, lists)
            view.createOrReplaceTempView(name)
        _registered[self.spark] = weakref.ref(self)
        register_functions(self.spark)

    def _is_there(self, view: str) -> bool:
        """Whether a view can be created without making a relation."""
        is_built = view == "classified_files" or hasattr(self, f"_{view}")
        return all(map(self.stored.made, ("commits", "tree_files", "contents") if is_built else (view,)))

    def sql(self, text: str) -> DataFrame:
        """Run a query over this dataset's views.

        Views that the text does not name are not made, unless it may name one indirectly.
        Where the session has those of another dataset, they are replaced by what is
        there of this one, or dropped.

        The text tells the order of joins, not how many rows each makes. Where it names
        three views or more, the relations behind them are counted, and the planner
        orders the joins by cost; file lists are then those dealt out by tree.
        """
        last = _registered.get(self.spark, lambda: self)()
        named = [name for name in VIEWS if re.search(rf"\b{name}\b", text, re.IGNORECASE)]
        indirect = re.search(r"\bidentifier\b", text, re.IGNORECASE)
        lists = "tree_files"
        if len(named) > 2:
            self.count_relations(named)
            lists = self.lists_by_tree
        if named and not indirect and last is not self:
            for name in VIEWS:
                if name not in named and not self._is_there(name):
                    self.spark.catalog.dropTempView(name)
            named = [name for name in VIEWS if name in named or self._is_there(name)]
        self.register(named if named and not indirect else None, lists)
        return self.spark.sql(text)
