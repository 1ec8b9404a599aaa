"""The documented questions as SQL over the views give what the jobs give."""

import pytest

from codestrata.plans import analyses

HEAD_FILES = (
    "FROM files NATURAL JOIN commit_files NATURAL JOIN commits NATURAL JOIN refs "
    "WHERE refs.ref_name = 'HEAD'"
)

# The documented statements under test, word for word.
CASES = {
    "commits": (
        "SELECT repository_id, commit_count FROM (SELECT r.repository_id, COUNT(*) AS commit_count "
        "FROM ref_commits r WHERE r.ref_name = 'HEAD' GROUP BY r.repository_id) AS q "
        "ORDER BY commit_count DESC, repository_id LIMIT 10;",
        analyses.top_repositories_by_commits,
    ),
    "files at head": (
        "SELECT cf.file_path, f.blob_content FROM ref_commits r NATURAL JOIN commit_files cf "
        "NATURAL JOIN files f WHERE r.ref_name = 'HEAD' AND r.history_index = 0;",
        analyses.files_at_head,
    ),
    "trees at head": (
        "SELECT * FROM (SELECT cf.file_path, UAST(f.blob_content, LANGUAGE(f.file_path, f.blob_content)) as uast "
        "FROM ref_commits r NATURAL JOIN commit_files cf NATURAL JOIN files f "
        "WHERE r.ref_name = 'HEAD' AND r.history_index = 0) t WHERE uast != '';",
        analyses.uast_at_head,
    ),
    "license and readme": (
        "SELECT repository_id, blob_content FROM files "
        "WHERE file_path = 'LICENSE' OR file_path = 'README.md';",
        analyses.license_and_readme_blobs,
    ),
    "last messages": (
        "SELECT c.commit_message FROM refs r NATURAL JOIN commits c WHERE r.ref_name = 'HEAD'",
        analyses.last_commit_messages,
    ),
    "contributors": (
        "SELECT repository_id, contributor_count FROM (SELECT repository_id, "
        "COUNT(DISTINCT commit_author_email) AS contributor_count FROM commits GROUP BY repository_id) AS q "
        "ORDER BY contributor_count DESC, repository_id LIMIT 10",
        analyses.top_repositories_by_contributors,
    ),
    "licenses": (
        "SELECT blob_content FROM files WHERE file_path = 'LICENSE'",
        analyses.license_blobs,
    ),
    "files": (
        # No column of files is NULL, so COUNT(f.*) counts rows here.
        "SELECT repository_id, num_files FROM (SELECT COUNT(f.*) num_files, f.repository_id "
        "FROM ref_commits r NATURAL JOIN commit_files cf NATURAL JOIN files f "
        "WHERE r.ref_name = 'HEAD' GROUP BY f.repository_id) AS t "
        "ORDER BY num_files DESC, repository_id LIMIT 10",
        analyses.top_repositories_by_files,
    ),
    "committers per repository": (
        "SELECT * FROM (SELECT commit_author_email as author, repository_id as id, count(*) as num_commits "
        "FROM commits GROUP BY commit_author_email, repository_id) AS t ORDER BY num_commits DESC",
        analyses.committers_per_repository,
    ),
    "committers": (
        "SELECT * FROM (SELECT commit_author_email as author, count(*) as num_commits "
        "FROM commits GROUP BY commit_author_email) AS t ORDER BY num_commits DESC",
        analyses.committers,
    ),
    "callers": (
        "SELECT repository_id, file_path FROM (SELECT files.repository_id, files.file_path, "
        "UAST(files.blob_content, LANGUAGE(files.file_path, files.blob_content), "
        "'//*[@roleCallee]/Identifier[@Name=\"trim\"]') as functionCall "
        f"{HEAD_FILES}) t WHERE ARRAY_LENGTH(functionCall) > 0",
        lambda ds: analyses.files_calling(ds, "trim").select("repository_id", "file_path"),
    ),
    "functions": (
        "SELECT files.repository_id, files.file_path, ARRAY_LENGTH(UAST(files.blob_content, "
        "LANGUAGE(files.file_path, files.blob_content), '//FunctionGroup')) as functions "
        f"{HEAD_FILES} AND LANGUAGE(files.file_path, files.blob_content) = 'Python'",
        lambda ds: analyses.functions_of_language(ds, "Python").selectExpr(
            "repository_id", "file_path", "json_array_length(functions) AS functions"
        ),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_sql_equals_job(ds, name):
    text, job = CASES[name]
    by_sql, by_job = ds.sql(text), job(ds)
    assert by_sql.columns == by_job.columns
    rows = sorted(map(repr, map(tuple, by_sql.collect())))
    assert rows == sorted(map(repr, map(tuple, by_job.collect())))
    assert rows
