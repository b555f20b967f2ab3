"""Canonical tables, as DDL."""

from __future__ import annotations

COMMITS = "commit_id string, parent_ids array<string>, author_name string, author_mail string, author_ts timestamp, committer_name string, committer_mail string, commit_ts timestamp, tz_offset_min int"
TREE_FILES = "commit_id string, file_path string, size bigint, is_binary boolean"
COMMIT_FILES = "commit_id string, file_path string"
BLAME_LINES = "commit_id string, file_path string, line_number int, author_name string, author_mail string, author_ts timestamp, origin_commit_id string, contents string"
HUNKS = "commit_id string, file_path string, prev_commit_id string, op string, src_from int, src_to int, dst_from int, dst_to int"
LINE_TOUCHES = (
    "commit_id string, file_path string, op string, lines bigint, actor_name string, actor_mail string, src_author_name string, src_author_mail string, "
    "commit_author_name string, commit_ts timestamp, src_ts timestamp"
)
#: The additive measures of changed lines.
MEASURES = ["new_lines", "changes", "refactor_own", "refactor_other", "refactor_received", "churn_own", "churn_other", "churn_received"]
