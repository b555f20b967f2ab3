"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions import numbers
from lineloom.operators import changes, clusters, commits, duplicates, filters, ownership, series
from lineloom.options import ChangesOptions, OwnershipOptions
from lineloom.plans import changes as changes_plan
from lineloom.plans import ownership as ownership_plan
from lineloom.sources import adapters, diff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

K = 4
SNAPSHOT = datetime(2025, 1, 1)
FILES, FILES_NOT = "^(en|de)/", "src1/|7$"
AUTHORS, AUTHORS_NOT = "src[0-9]$|@en", "src3|@fr"
TOUCH_FILES, TOUCH_AUTHORS, TOUCH_AUTHORS_NOT = "Brand#1", "Supplier#0000000[0-4]", "@3>$"
SINCE, UNTIL = datetime(2024, 1, 10), datetime(2024, 1, 20, 12)
TICKS = [datetime(2024, 1, d) for d in (31, 28, 25, 22, 19, 16, 13, 10, 7, 4)]
PERIOD_END, PERIOD_DAYS = datetime(2001, 12, 31), 180


def query(sql: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- SQL that several oracles start with

BLAME_SQL = r"""
d AS (SELECT concat_ws('/', lang, source, doc_id) AS file_path, source AS author_name, '<' || source || '@' || lang || '>' AS author_mail,
  TIMESTAMP '2024-01-01' + to_hours(doc_id) AS author_ts, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls
  FROM documents WHERE strlen(text) <= 80000 AND text <> ''),
b AS (SELECT file_path, author_name, author_mail, author_ts, UNNEST(range(1, len(ls) + 1))::INT AS line_number, UNNEST(ls) AS contents FROM d)"""

WINDOWS_SQL = BLAME_SQL + r""",
w AS (SELECT *, list(contents) OVER f AS win FROM b WINDOW f AS (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
n AS (SELECT * EXCLUDE (win), regexp_replace(trim(array_to_string(win, '\n') || '\n', 'n\'), '[\t\n\f\r ]', '', 'g') AS norm FROM w WHERE len(win) = 4 AND trim(contents) <> ''),
e AS (SELECT * FROM n WHERE len(list_filter(string_split(norm, '\n'), lambda x: strlen(x) < 15 OR regexp_matches(x, '^\*|^/\*|^#|import|export|from|package'))) = 0),
o AS (SELECT *, count(*) OVER (PARTITION BY norm) AS n, row_number() OVER p AS rn, first_value(author_name) OVER p AS first_name, first_value(author_mail) OVER p AS first_mail
  FROM e WINDOW p AS (PARTITION BY norm ORDER BY author_ts, file_path, line_number))"""

TOUCH_SQL = """
s AS (SELECT *, '<' || s_suppkey || '@' || s_nationkey || '>' AS mail FROM supplier),
t AS (SELECT l_orderkey * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS commit_id, p_brand || '/' || p_size AS file_path, s_name AS actor_name, mail AS actor_mail, l_shipdate AS commit_ts,
  lag(l_shipdate) OVER w AS src_ts, lag(s_name) OVER w AS src_name, lag(mail) OVER w AS src_mail
  FROM lineitem JOIN s ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey)),
k AS (SELECT *, date_diff('microsecond', src_ts, commit_ts) / 86400e6 AS age_days,
  CASE WHEN src_ts IS NULL THEN 'new' WHEN date_diff('microsecond', src_ts, commit_ts) > 504 * 3600000000 THEN CASE WHEN src_name = actor_name THEN 'refactor_own' ELSE 'refactor_other' END
  WHEN src_name = actor_name THEN 'churn_own' ELSE 'churn_other' END AS kind FROM t)"""

PARTS_SQL = (
    TOUCH_SQL
    + """,
c0 AS (
  SELECT commit_id, file_path, commit_ts, actor_name AS author_name, actor_mail AS author_mail, true AS touch, (kind = 'new')::INT AS new_lines, (kind <> 'new')::INT AS changes,
    (kind = 'refactor_own')::INT AS refactor_own, (kind = 'refactor_other')::INT AS refactor_other, 0 AS refactor_received,
    (kind = 'churn_own')::INT AS churn_own, (kind = 'churn_other')::INT AS churn_other, 0 AS churn_received, CASE kind WHEN 'new' THEN 0 ELSE age_days END AS age_days_sum FROM k
  UNION ALL
  SELECT commit_id, file_path, commit_ts, src_name, src_mail, false, 0, 0, 0, 0, (kind = 'refactor_other')::INT, 0, 0, (kind = 'churn_other')::INT, 0 FROM k WHERE kind IN ('refactor_other', 'churn_other'))"""
)
SUMS_SQL = ", ".join(f"sum({m})::BIGINT AS {m}" for m in ("new_lines", "changes", "refactor_own", "refactor_other", "refactor_received", "churn_own", "churn_other", "churn_received")) + ", round(sum(age_days_sum), 3) AS age_days_sum"
AUTHORS_SQL = PARTS_SQL + f", a AS (SELECT author_name, author_mail, {SUMS_SQL} FROM c0 GROUP BY ALL)"


def ts(*moments: datetime) -> str:
    return ", ".join(f"TIMESTAMP '{m}'" for m in moments)


def rounded(df: DataFrame, *names: str, digits: int = 3) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- scans, filters, lines


@query("""SELECT concat_ws('/', lang, source, doc_id) AS file_path, strlen(text) AS size FROM documents
WHERE regexp_matches(concat_ws('/', lang, source, doc_id), '^(en|de)/') AND NOT regexp_matches(concat_ws('/', lang, source, doc_id), 'src1/|7$')""")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = adapters.documents_as_tree(spark, sf_dir)
    return tree.where(filters.file_matches(F.col("file_path"), FILES, FILES_NOT)).select("file_path", "size")


@query("SELECT concat_ws('/', lang, source, doc_id) AS file_path, strlen(text) AS size FROM documents WHERE strlen(text) <= 2000")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.text_files(adapters.documents_as_tree(spark, sf_dir), 2000).select("file_path", "size")


@query(f"WITH {BLAME_SQL} SELECT file_path, line_number, author_name, author_mail, contents FROM b")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.documents_as_blame(spark, sf_dir).select("file_path", "line_number", "author_name", "author_mail", "contents")


@query(f"WITH {BLAME_SQL} SELECT file_path, line_number FROM b WHERE trim(contents) <> ''")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.documents_as_blame(spark, sf_dir).where(filters.not_blank(F.col("contents"))).select("file_path", "line_number")


@query(f"""WITH {BLAME_SQL} SELECT file_path, line_number, author_name FROM b
WHERE (regexp_matches(author_name, '{AUTHORS}') OR regexp_matches(author_mail, '{AUTHORS}')) AND NOT regexp_matches(author_name, '{AUTHORS_NOT}') AND NOT regexp_matches(author_mail, '{AUTHORS_NOT}')""")
def author_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.documents_as_blame(spark, sf_dir)
    return lines.where(filters.author_matches(F.col("author_name"), F.col("author_mail"), AUTHORS, AUTHORS_NOT)).select("file_path", "line_number", "author_name")


@query(f"WITH {BLAME_SQL} SELECT file_path, line_number, date_diff('microsecond', author_ts, {ts(SNAPSHOT)}) / 86400e6 AS age_days FROM b WHERE trim(contents) <> ''")
def line_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.owned_lines(adapters.documents_as_blame(spark, sf_dir), F.lit(SNAPSHOT), F.lit(True)).select("file_path", "line_number", "age_days")


@query("SELECT l_orderkey, l_linenumber, l_partkey, UNNEST(range(l_linenumber, l_linenumber + (l_partkey % 3)::INT + 1))::INT AS line_number FROM lineitem")
def hunk_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return i.select("l_orderkey", "l_linenumber", "l_partkey", changes.each_line("l_linenumber", (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int")).alias("line_number"))


# an order is a commit with one hunk; numbers follow from its key k
HUNK_SQL = """
h0 AS (SELECT o_orderkey AS k, 'f' || (o_custkey % 50) AS file_path, o_orderdate AS ts, ['New', 'Add', 'Change', 'Delete'][(o_orderkey % 4 + 1)::INT] AS op FROM orders),
h1 AS (SELECT *, CASE op WHEN 'New' THEN 1 ELSE k % 5 + 1 END AS sf, CASE op WHEN 'New' THEN 1 ELSE k % 7 + 1 END AS df,
  CASE WHEN op IN ('Change', 'Delete') THEN k % 3 + 1 ELSE 0 END AS ns, CASE op WHEN 'Delete' THEN 0 ELSE (k // 4) % 4 + 1 END AS nd FROM h0)"""

TOUCHED_SQL = (
    HUNK_SQL
    + """,
w AS (
  SELECT k, file_path, ts, op, 1 AS lines, 'c' || ((k * 7 + l) % 40) AS actor, NULL AS src, NULL::TIMESTAMP AS src_ts FROM (SELECT *, UNNEST(range(1, nd + 1)) AS l FROM h1 WHERE op = 'New')
  UNION ALL SELECT k, file_path, ts, op, nd, 'c' || ((k * 7 + df) % 40), NULL, NULL FROM h1 WHERE op = 'Add'
  UNION ALL SELECT k, file_path, ts, op, 1, 'c' || ((k * 7 + l) % 40), NULL, NULL FROM (SELECT *, UNNEST(range(df + ns, df + nd)) AS l FROM h1 WHERE op = 'Change')
  UNION ALL SELECT k, file_path, ts, op, 1, CASE op WHEN 'Delete' THEN 'c' || (k % 40) ELSE 'c' || ((k * 7 + df) % 40) END, 'c' || (((k - 1) * 5 + l) % 40), ts - to_days(((k * 13 + l * 7) % 60)::INT) FROM (SELECT *, UNNEST(range(sf, sf + ns)) AS l FROM h1 WHERE op IN ('Change', 'Delete'))),
k AS (SELECT k AS commit_id, file_path, op, lines, actor AS actor_name, '<' || actor || '@x>' AS actor_mail, src AS src_name, '<' || src || '@x>' AS src_mail, date_diff('microsecond', src_ts, ts) / 86400e6 AS age_days,
  CASE WHEN src IS NULL THEN 'new' WHEN date_diff('microsecond', src_ts, ts) > 504 * 3600000000 THEN CASE WHEN src = 'c' || (k % 40) THEN 'refactor_own' ELSE 'refactor_other' END WHEN src = 'c' || (k % 40) THEN 'churn_own' ELSE 'churn_other' END AS kind FROM w),
c0 AS (
  SELECT commit_id, file_path, actor_name AS author_name, actor_mail AS author_mail, lines * (kind = 'new')::INT AS new_lines, lines * (kind <> 'new')::INT AS changes, (kind = 'refactor_own')::INT AS refactor_own, (kind = 'refactor_other')::INT AS refactor_other,
    0 AS refactor_received, (kind = 'churn_own')::INT AS churn_own, (kind = 'churn_other')::INT AS churn_other, 0 AS churn_received, coalesce(age_days, 0) AS age_days_sum FROM k
  UNION ALL SELECT commit_id, file_path, src_name, src_mail, 0, 0, 0, 0, (kind = 'refactor_other')::INT, 0, 0, (kind = 'churn_other')::INT, 0 FROM k WHERE kind IN ('refactor_other', 'churn_other'))"""
)


@query(f"WITH {TOUCHED_SQL} SELECT commit_id, file_path, op, lines, actor_name, actor_mail, src_name AS src_author_name, kind, age_days FROM k")
def hunk_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = changes.classified(changes.touches_of_hunks(*adapters.orders_as_hunks(spark, sf_dir)))
    return touches.select("commit_id", "file_path", "op", "lines", "actor_name", "actor_mail", "src_author_name", "kind", "age_days")


@query(f"WITH {TOUCHED_SQL} SELECT author_name, author_mail, {SUMS_SQL} FROM c0 GROUP BY ALL")
def hunk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = changes.touches_of_hunks(*adapters.orders_as_hunks(spark, sf_dir))
    return rounded(changes_plan.analyse(touches, ChangesOptions()).authors, "age_days_sum")


@query(f"WITH {HUNK_SQL} SELECT k AS pair_id, op, sf::INT AS src_from, (sf + ns - 1)::INT AS src_to, df::INT AS dst_from, (df + nd - 1)::INT AS dst_to FROM h1 WHERE op <> 'New'")
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.parsed(adapters.orders_as_diffs(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS k, UNNEST(range(1, o_orderkey % 7 + 7)) AS i FROM orders),
t AS (SELECT k, 2 * i AS pos, CASE WHEN (i * 7 + k) % 5 = 0 THEN 'del' ELSE 'keep' END AS what FROM o UNION ALL SELECT k, 2 * i + 1, 'add' FROM o WHERE (i * 3 + k) % 4 = 0),
g AS (SELECT *, count(*) FILTER (what = 'keep') OVER w AS part, count(*) FILTER (what <> 'add') OVER w AS in_src, count(*) FILTER (what <> 'del') OVER w AS in_dst FROM t WINDOW w AS (PARTITION BY k ORDER BY pos)),
r AS (SELECT k, part, count(*) FILTER (what = 'del') AS dels, count(*) FILTER (what = 'add') AS adds, max(in_src) AS src_to, max(in_dst) AS dst_to FROM g WHERE what <> 'keep' GROUP BY ALL)
SELECT k AS pair_id, CASE WHEN dels = 0 THEN 'Add' WHEN adds = 0 THEN 'Delete' ELSE 'Change' END AS op, (src_to - dels + 1)::INT AS src_from, src_to::INT AS src_to, (dst_to - adds + 1)::INT AS dst_from, dst_to::INT AS dst_to FROM r""")
def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_pairs(adapters.orders_as_texts(spark, sf_dir))


@query(f"SELECT event_id, ts FROM events WHERE ts > {ts(UNTIL)} - INTERVAL 5184 SECOND")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("last_access"))
    return filters.fresh(entries, F.lit(UNTIL), 5184).select("event_id", F.col("last_access").alias("ts"))


# ---- ownership and duplicates


def _ownership(spark: SparkSession, sf_dir: str, **options) -> ownership_plan.Ownership:
    return ownership_plan.analyse(adapters.documents_as_blame(spark, sf_dir), F.lit(SNAPSHOT), OwnershipOptions(**options))


OWNERSHIP_SQL = """,
l AS (SELECT author_name, count(*) AS lines, round(sum(date_diff('microsecond', author_ts, TIMESTAMP '2025-01-01') / 86400e6), 3) AS age_days_sum, max_by(author_mail, (author_ts, file_path, line_number)) AS author_mail
  FROM b WHERE trim(contents) <> '' GROUP BY 1),
x AS (SELECT author_name, 4 AS duplicated, CASE WHEN first_name = author_name THEN 4 ELSE 0 END AS original, 0 AS original_others FROM o WHERE rn > 1
  UNION ALL SELECT first_name, 0, 0, 4 FROM o WHERE rn > 1 AND first_name <> author_name),
y AS (SELECT author_name, sum(duplicated)::BIGINT AS duplicated, sum(original)::BIGINT AS original, sum(original_others)::BIGINT AS original_others FROM x GROUP BY 1),
z AS (SELECT author_name, author_mail, coalesce(lines, 0) AS lines, coalesce(age_days_sum, 0) AS age_days_sum, coalesce(duplicated, 0) AS duplicated, coalesce(original, 0) AS original, coalesce(original_others, 0) AS original_others
  FROM l FULL JOIN y USING (author_name))"""


@query(f"WITH {WINDOWS_SQL}{OWNERSHIP_SQL} SELECT * FROM z")
def ownership_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ownership(spark, sf_dir).authors, "age_days_sum")


@query(f"WITH {BLAME_SQL}, l AS (SELECT author_name, count(*) AS lines, sum(date_diff('microsecond', author_ts, TIMESTAMP '2025-01-01') / 86400e6) AS age FROM b WHERE trim(contents) <> '' GROUP BY 1) SELECT author_name, lines, row_number() OVER (ORDER BY lines DESC, author_name)::INT AS place, round(age / lines, 3) AS age_days FROM l")
def ranked_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ownership.ranked(_ownership(spark, sf_dir).authors.where("lines > 0")), "age_days").select("author_name", "lines", "place", "age_days")


@query(f"""WITH {WINDOWS_SQL} SELECT count(DISTINCT file_path) AS files, count(*) AS lines, count(DISTINCT author_name) AS authors,
round(sum(date_diff('microsecond', author_ts, TIMESTAMP '2025-01-01') / 86400e6), 3) AS age_days_sum, (SELECT 4 * count(*) FROM o WHERE rn > 1) AS duplicated FROM b WHERE trim(contents) <> ''""")
def ownership_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ownership(spark, sf_dir).totals, "age_days_sum")


@query(f"""WITH {BLAME_SQL.replace("AND text <> ''", "AND text <> '' AND regexp_matches(concat_ws('/', lang, source, doc_id), '^(en|de)/') AND NOT regexp_matches(concat_ws('/', lang, source, doc_id), 'src1/|7$')")}{WINDOWS_SQL[len(BLAME_SQL) :]},
l AS (SELECT author_name, count(*) AS lines FROM b WHERE trim(contents) <> '' AND regexp_matches(author_name, 'src[0-9]$') GROUP BY 1),
y AS (SELECT author_name, 4 * count(*) AS duplicated FROM o WHERE rn > 1 AND regexp_matches(author_name, 'src[0-9]$') GROUP BY 1),
q AS (SELECT first_name AS author_name, 4 * count(*) AS original_others FROM o WHERE rn > 1 AND first_name <> author_name AND regexp_matches(author_name, 'src[0-9]$') AND regexp_matches(first_name, 'src[0-9]$') GROUP BY 1)
SELECT author_name, coalesce(lines, 0) AS lines, coalesce(duplicated, 0) AS duplicated, coalesce(original_others, 0) AS original_others FROM l FULL JOIN y USING (author_name) FULL JOIN q USING (author_name)""")
def ownership_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ownership(spark, sf_dir, files=FILES, files_not=FILES_NOT, authors="src[0-9]$").authors.select("author_name", "lines", "duplicated", "original_others")


@query(f"WITH {WINDOWS_SQL} SELECT file_path, line_number, norm FROM e")
def dup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = duplicates.windows(adapters.documents_as_blame(spark, sf_dir), K).where(filters.not_blank(F.col("contents")))
    rows = lines.select("file_path", "line_number", duplicates.normal(F.col("window")).alias("norm"))
    return rows.where(duplicates.eligible(F.col("norm")))


@query(f"WITH {WINDOWS_SQL} SELECT file_path, line_number, n, rn > 1 AS is_copy FROM o WHERE n > 1")
def dup_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ownership(spark, sf_dir).found.where("n > 1").select("file_path", "line_number", "n", (~F.col("is_first")).alias("is_copy"))


@query(f"WITH {WINDOWS_SQL} SELECT author_name, (4 * count(*))::BIGINT AS duplicated FROM o WHERE rn > 1 GROUP BY 1")
def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ownership(spark, sf_dir).authors.where("duplicated > 0").select("author_name", "duplicated")


@query(f"WITH {WINDOWS_SQL}{OWNERSHIP_SQL} SELECT author_name, original, original_others FROM z WHERE original + original_others > 0")
def dup_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ownership(spark, sf_dir).authors.where("original + original_others > 0").select("author_name", "original", "original_others")


@query(f"""WITH {WINDOWS_SQL},
i AS (SELECT file_path, line_number, line_number + 3 AS stop, max(line_number + 3) OVER (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o WHERE n > 1),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR line_number > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_number) AS island FROM i)
SELECT file_path, min(line_number) AS line_number, (max(stop) - min(line_number) + 1)::INT AS line_count FROM g GROUP BY file_path, island""")
def dup_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_islands(_ownership(spark, sf_dir).found, K)


# runs in order, their texts' occurrences as spans, and each span's first claimer that isn't itself
GROUPS_SQL = (
    WINDOWS_SQL
    + """,
i AS (SELECT file_path, line_number, line_number + 3 AS stop, norm, max(line_number + 3) OVER (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o WHERE n > 1),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR line_number > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_number) AS island FROM i),
runs AS (SELECT file_path, island, min(line_number) AS a, max(stop) AS b, row_number() OVER (ORDER BY file_path, min(line_number)) AS place FROM g GROUP BY file_path, island),
hits AS (SELECT DISTINCT r.place, x.file_path, x.line_number, x.stop FROM runs r JOIN g USING (file_path, island) JOIN g x ON x.norm = g.norm),
edges AS (SELECT *, max(stop) OVER (PARTITION BY place, file_path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
marks AS (SELECT *, sum(CASE WHEN before IS NULL OR line_number > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY place, file_path ORDER BY line_number) AS part FROM edges),
spans AS (SELECT place, file_path, min(line_number) AS a, max(stop) AS b FROM marks GROUP BY place, file_path, part),
others AS (SELECT s.*, r.place AS own FROM spans s LEFT JOIN runs r ON r.file_path = s.file_path AND r.a = s.a AND r.b = s.b WHERE r.place IS DISTINCT FROM s.place),
claims AS (SELECT file_path, a, b, any_value(own) AS own, min(place) AS place FROM others GROUP BY file_path, a, b),
heads AS (SELECT r.* FROM runs r LEFT JOIN claims c ON c.own = r.place WHERE c.place IS NULL OR c.place > r.place),
rel AS (SELECT h.place, c.file_path, c.a, c.b FROM heads h JOIN claims c USING (place) WHERE c.own IS NULL OR c.own > c.place)"""
)


@query(f"""WITH {GROUPS_SQL} SELECT h.file_path, h.a AS line_number, (h.b - h.a + 1)::INT AS line_count, count(r.place) AS related_runs, coalesce(sum(r.b - r.a + 1), 0)::BIGINT AS related_count
FROM heads h LEFT JOIN rel r USING (place) GROUP BY ALL""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ownership(spark, sf_dir).groups


@query(f"""WITH {GROUPS_SQL} SELECT h.file_path, h.a AS line_number, (h.b - h.a + 1)::INT AS line_count, r.file_path AS related_path, r.a AS related_line, (r.b - r.a + 1)::INT AS related_lines
FROM heads h JOIN rel r USING (place)""")
def dup_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ownership(spark, sf_dir).related


# ---- changes


def _changes(spark: SparkSession, sf_dir: str, **options) -> changes_plan.Changes:
    return changes_plan.analyse(adapters.lineitem_as_touches(spark, sf_dir), ChangesOptions(**options))


@query(f"WITH {TOUCH_SQL} SELECT commit_id, file_path, actor_name, commit_ts, src_ts, src_name AS src_author_name FROM t")
def prev_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.lineitem_as_touches(spark, sf_dir).select("commit_id", "file_path", "actor_name", "commit_ts", "src_ts", "src_author_name")


@query("SELECT event_id AS commit_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_commit_id FROM events")
def previous_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("commit_id"), F.col("user_id").alias("file_path"), F.col("ts").alias("commit_ts"))
    return commits.previous_versions(e).select("commit_id", F.col("file_path").alias("user_id"), "prev_commit_id")


@query(f"WITH {TOUCH_SQL} SELECT kind, count(*) AS lines, round(coalesce(sum(age_days), 0), 3) AS age_days_sum FROM k GROUP BY 1")
def change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = changes.classified(adapters.lineitem_as_touches(spark, sf_dir))
    return rounded(k.groupBy("kind").agg(F.sum("lines").alias("lines"), F.coalesce(F.sum("age_days"), F.lit(0.0)).alias("age_days_sum")), "age_days_sum")


@query(f"WITH {TOUCH_SQL} SELECT actor_name AS author_name, count(*) AS new_lines FROM k WHERE kind = 'new' GROUP BY 1")
def change_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = changes.classified(adapters.lineitem_as_touches(spark, sf_dir)).where("kind = 'new'")
    return k.groupBy(F.col("actor_name").alias("author_name")).agg(F.sum("lines").alias("new_lines"))


@query(f"WITH {AUTHORS_SQL} SELECT author_name, refactor_received, churn_received FROM a WHERE refactor_received + churn_received > 0")
def change_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).authors.where("refactor_received + churn_received > 0").select("author_name", "refactor_received", "churn_received")


@query(f"WITH {AUTHORS_SQL} SELECT * FROM a")
def changes_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_changes(spark, sf_dir).authors, "age_days_sum")


@query(f"""WITH {PARTS_SQL},
c1 AS (SELECT * FROM c0 WHERE regexp_matches(file_path, '{TOUCH_FILES}') AND (regexp_matches(author_name, '{TOUCH_AUTHORS}') OR regexp_matches(author_mail, '{TOUCH_AUTHORS}'))
  AND NOT regexp_matches(author_name, '{TOUCH_AUTHORS_NOT}') AND NOT regexp_matches(author_mail, '{TOUCH_AUTHORS_NOT}'))
SELECT author_name, author_mail, {SUMS_SQL} FROM c1 WHERE (commit_id, file_path) IN (SELECT (commit_id, file_path) FROM c1 WHERE touch) GROUP BY ALL""")
def changes_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_changes(spark, sf_dir, files=TOUCH_FILES, authors=TOUCH_AUTHORS, authors_not=TOUCH_AUTHORS_NOT).authors, "age_days_sum")


@query(f"WITH {PARTS_SQL} SELECT count(DISTINCT commit_id) AS commits, count(DISTINCT file_path) AS files, {SUMS_SQL} FROM c0")
def changes_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_changes(spark, sf_dir).totals, "age_days_sum")


FILES_SQL = PARTS_SQL + ", f AS (SELECT author_name, author_mail, file_path, sum(new_lines + churn_own + churn_other + refactor_own + refactor_other)::BIGINT AS lines FROM c0 GROUP BY ALL)"


@query(f"WITH {FILES_SQL} SELECT * FROM f")
def files_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).files


@query(f"WITH {FILES_SQL} SELECT *, row_number() OVER (PARTITION BY author_name, author_mail ORDER BY lines DESC, file_path)::INT AS place FROM f QUALIFY place <= 5")
def top_files_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.top_files(_changes(spark, sf_dir).files)


SCORES = {
    "top_coders": "new_lines + 3 * refactor_other + 2 * refactor_own - 2 * churn_own - 4 * churn_received",
    "top_new_liners": "new_lines",
    "top_refactorers": "refactor_other + refactor_own",
    "top_helpers": "churn_other",
    "top_churners": "churn_received + churn_own",
}


def _ranking(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return changes.top_authors(_changes(spark, sf_dir).authors, name)

    run.__name__ = name
    query(f"WITH {AUTHORS_SQL} SELECT author_name, author_mail, ({SCORES[name]})::BIGINT AS score FROM a ORDER BY score DESC, author_name, author_mail LIMIT 3")(run)


for _name in SCORES:
    _ranking(_name)


@query(f"""WITH {AUTHORS_SQL} SELECT author_name, new_lines + changes AS touched, trunc(100 * new_lines / nullif(new_lines + changes, 0))::BIGINT AS new_percent,
trunc(100 * (refactor_own + refactor_other) / nullif(changes, 0))::BIGINT AS refactor_percent, trunc(100 * churn_own / nullif(churn_own + churn_other, 0))::BIGINT AS own_churn_percent FROM a""")
def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _changes(spark, sf_dir).authors.select(
        "author_name", (c("new_lines") + c("changes")).alias("touched"), numbers.percent(c("new_lines"), c("new_lines") + c("changes")).alias("new_percent"),
        numbers.percent(c("refactor_own") + c("refactor_other"), c("changes")).alias("refactor_percent"), numbers.percent(c("churn_own"), c("churn_own") + c("churn_other")).alias("own_churn_percent"),
    )


@query(f"""WITH {PARTS_SQL}, s1 AS (SELECT {SUMS_SQL} FROM c0)
SELECT UNNEST(['touched', 'touched', 'changes', 'changes', 'refactor', 'refactor', 'churn', 'churn']) AS source, UNNEST(['new', 'changes', 'refactor', 'churn', 'refactor own', 'refactor other', 'churn own', 'churn other']) AS target,
UNNEST([new_lines, changes, refactor_own + refactor_other, churn_own + churn_other, refactor_own, refactor_other, churn_own, churn_other]) AS lines FROM s1""")
def sankey_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.flows(_changes(spark, sf_dir).totals)


# all pairs of bounds over the distinct totals, and the pair with the least squares
CLUSTERS_SQL = (
    AUTHORS_SQL
    + """, sums AS (SELECT author_name, sum(new_lines + changes)::BIGINT AS total FROM a GROUP BY 1),
v AS (SELECT total::DOUBLE AS total, count(*)::DOUBLE AS n FROM sums GROUP BY 1),
p AS (SELECT total, row_number() OVER x AS r, sum(n) OVER x AS w, sum(n * total) OVER x AS s, sum(n * total * total) OVER x AS q FROM v WINDOW x AS (ORDER BY total)),
z AS (SELECT max(r) AS r, max(w) AS w, max(s) AS s, max(q) AS q FROM p),
c AS (SELECT a.total AS t1, b.total AS t2, a.s / a.w AS c1, (b.s - a.s) / (b.w - a.w) AS c2, (z.s - b.s) / (z.w - b.w) AS c3,
  z.q - a.s * a.s / a.w - (b.s - a.s) ** 2 / (b.w - a.w) - (z.s - b.s) ** 2 / (z.w - b.w) AS off FROM p a JOIN p b ON a.r < b.r JOIN z ON b.r < z.r ORDER BY off, a.r, b.r LIMIT 1),
kk AS (SELECT author_name, t.total, floor(CASE WHEN t1 IS NULL THEN t.total WHEN t.total <= t1 THEN c1 WHEN t.total <= t2 THEN c2 ELSE c3 END)::BIGINT AS cluster_value FROM sums t LEFT JOIN c ON true)"""
)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _changes(spark, sf_dir).authors.groupBy("author_name").agg(F.sum(F.col("new_lines") + F.col("changes")).alias("total"))
    return clusters.cluster_authors(totals, 3, "touched")


@query(f"WITH {CLUSTERS_SQL} SELECT author_name, total, cluster_value, 'Authors that touched ~' || cluster_value || ' lines' AS cluster_name FROM kk")
def cluster_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@query(f"""WITH {CLUSTERS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY cluster_value ORDER BY total DESC, author_name) AS place, count(*) OVER (PARTITION BY cluster_value) AS n FROM kk)
SELECT 'Authors that touched ~' || cluster_value || ' lines' AS cluster_name, cluster_value, string_agg(author_name, ', ' ORDER BY place) FILTER (place <= 4) || CASE WHEN any_value(n) > 4 THEN '... (+' || (any_value(n) - 4) || ')' ELSE '' END AS text FROM m GROUP BY cluster_value""")
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_lines(_clusters(spark, sf_dir))


@query(f"WITH {AUTHORS_SQL} SELECT author_name, author_mail, new_lines + changes AS touched, row_number() OVER (ORDER BY new_lines + changes DESC, author_name, author_mail)::INT AS place FROM a WHERE new_lines + changes > 0")
def active_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.active(_changes(spark, sf_dir).authors).select("author_name", "author_mail", "touched", "place")


# ---- commits


@query(f"""WITH r AS (SELECT event_id AS commit_id, ts AS commit_ts FROM events WHERE ts BETWEEN {ts(SINCE)} AND {ts(UNTIL)})
SELECT * FROM r UNION ALL (SELECT event_id, ts FROM events WHERE ts < {ts(SINCE)} ORDER BY ts DESC, event_id DESC LIMIT 1)""")
def commit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.in_range(adapters.events_as_commits(spark, sf_dir), SINCE, UNTIL).select("commit_id", "commit_ts")


@query(f"SELECT event_id AS commit_id, 'user' || user_id AS author_name, ts AS commit_ts FROM events WHERE ts <= {ts(UNTIL)} ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.latest(adapters.events_as_commits(spark, sf_dir), UNTIL).select("commit_id", "author_name", "commit_ts")


@query(f"""WITH a AS (SELECT event_id AS commit_id FROM events WHERE ts <= {ts(UNTIL)}), b AS (SELECT event_id AS commit_id FROM events WHERE ts >= {ts(SINCE)})
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def commit_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.events_as_commits(spark, sf_dir).select("commit_id", "commit_ts")
    return commits.symmetric_difference(c.where(F.col("commit_ts") <= F.lit(UNTIL)).select("commit_id"), c.where(F.col("commit_ts") >= F.lit(SINCE)).select("commit_id"))


@query("""WITH RECURSIVE r(commit_id) AS (SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id // 2 FROM events WHERE event_id > 0)
UNION SELECT e.event_id FROM r JOIN events e ON e.event_id = r.commit_id // 2 WHERE r.commit_id > 0) SELECT commit_id FROM r""")
def commit_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    parents = e.select(F.col("event_id").alias("commit_id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)).alias("parent_id"))
    return commits.ancestors(parents, commits.tips(parents))


@query("SELECT event_id AS commit_id, 'user' || user_id AS author_name, ts AS commit_ts FROM events WHERE event_id IN (SELECT o_custkey FROM orders)")
def commit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("commit_id"))
    return commits.by_id(adapters.events_as_commits(spark, sf_dir), ids).select("commit_id", "author_name", "commit_ts")


# ---- series


@query(f"""WITH t AS (SELECT UNNEST([{ts(*TICKS)}]) AS tick),
x AS (SELECT tick, (SELECT max((ts, event_id)) FROM events WHERE ts <= tick) AS c FROM t)
SELECT max(tick) AS tick, c[2] AS commit_id, c[1] AS commit_ts FROM x WHERE c IS NOT NULL GROUP BY c""")
def sampled_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.samples(adapters.events_as_commits(spark, sf_dir), TICKS)


def _snapshots(spark: SparkSession, sf_dir: str) -> ownership_plan.Ownership:
    """Three snapshots: after all lines, and a third and two thirds of their time before."""
    lines = adapters.documents_as_blame(spark, sf_dir)
    ends = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id").alias("last")).first()["last"] or 0
    start, step = datetime(2024, 1, 1), timedelta(hours=ends // 3)
    samples = [start + timedelta(hours=ends) - i * step for i in (2, 1, 0)]
    lines = lines.withColumn("snapshot", F.explode(F.array(*[F.lit(s) for s in samples]))).where("author_ts <= snapshot")
    return ownership_plan.analyse(lines, F.col("snapshot"), OwnershipOptions(), keys=("snapshot",))


SAMPLES_SQL = "g AS (SELECT TIMESTAMP '2024-01-01' + to_hours(last - i * (last // 3)) AS snapshot FROM (SELECT max(doc_id) AS last FROM documents) JOIN (SELECT UNNEST([2, 1, 0]) AS i) ON true), "
SNAPSHOTS_SQL = WINDOWS_SQL.replace("b AS (SELECT file_path,", f"{SAMPLES_SQL}b AS (SELECT snapshot, file_path,").replace("FROM d)", "FROM d JOIN g ON author_ts <= snapshot)").replace("PARTITION BY", "PARTITION BY snapshot,")
SERIES_SQL = (
    SNAPSHOTS_SQL
    + """,
v AS (SELECT snapshot, count(DISTINCT file_path) AS files, count(*) AS lines, count(DISTINCT author_name) AS authors, round(sum(date_diff('microsecond', author_ts, snapshot) / 86400e6), 3) AS age_days_sum FROM b WHERE trim(contents) <> '' GROUP BY 1),
u AS (SELECT snapshot, 4 * count(*) AS duplicated FROM o WHERE rn > 1 GROUP BY 1),
r AS (SELECT snapshot, files, lines, authors, age_days_sum, coalesce(duplicated, 0) AS duplicated FROM v LEFT JOIN u USING (snapshot))"""
)


@query(f"WITH {SERIES_SQL} SELECT * FROM r")
def ownership_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_snapshots(spark, sf_dir).totals, "age_days_sum")


@query(f"""WITH {SERIES_SQL} SELECT snapshot, lines, duplicated, files, CASE WHEN lag(lines) OVER w <> 0 THEN lines - lag(lines) OVER w END AS lines_delta,
CASE WHEN lag(duplicated) OVER w <> 0 THEN duplicated - lag(duplicated) OVER w END AS duplicated_delta, CASE WHEN lag(files) OVER w <> 0 THEN files - lag(files) OVER w END AS files_delta FROM r WINDOW w AS (ORDER BY snapshot)""")
def series_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.deltas(_snapshots(spark, sf_dir).totals.select("snapshot", "lines", "duplicated", "files"), "snapshot", ["lines", "duplicated", "files"])


@query(f"""WITH {SERIES_SQL} SELECT max_by(lines, snapshot) - min_by(lines, snapshot) AS lines_growth, trunc(100 * (max_by(lines, snapshot) - min_by(lines, snapshot)) / nullif(min_by(lines, snapshot), 0))::BIGINT AS lines_percent,
max_by(files, snapshot) - min_by(files, snapshot) AS files_growth, trunc(100 * (max_by(files, snapshot) - min_by(files, snapshot)) / nullif(min_by(files, snapshot), 0))::BIGINT AS files_percent FROM r""")
def series_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.growth(_snapshots(spark, sf_dir).totals, "snapshot", ["lines", "files"])


def _periods(spark: SparkSession, sf_dir: str) -> changes_plan.Changes:
    touches = adapters.lineitem_as_touches(spark, sf_dir)
    return changes_plan.analyse(touches.withColumn("period", series.period_of(F.col("commit_ts"), PERIOD_END, PERIOD_DAYS)), keys=("period",))


PERIODS_SQL = PARTS_SQL + f", p AS (SELECT floor(date_diff('microsecond', commit_ts, {ts(PERIOD_END)}) / {PERIOD_DAYS * 86400e6})::INT AS period, c0.* FROM c0)"


@query(f"WITH {PERIODS_SQL} SELECT period, count(DISTINCT commit_id) AS commits, count(DISTINCT file_path) AS files, {SUMS_SQL} FROM p GROUP BY 1")
def changes_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_periods(spark, sf_dir).totals, "age_days_sum")


@query(f"""WITH {PERIODS_SQL}, r AS (SELECT period, count(DISTINCT commit_id) AS commits, count(DISTINCT file_path) AS files, sum(new_lines)::BIGINT AS new_lines, sum(changes)::BIGINT AS changes FROM p GROUP BY 1)
SELECT period::VARCHAR AS period, commits, files, new_lines, changes FROM r UNION ALL SELECT 'Total', sum(commits)::BIGINT, sum(files)::BIGINT, sum(new_lines)::BIGINT, sum(changes)::BIGINT FROM r""")
def series_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_total(_periods(spark, sf_dir).totals, "period", ["commits", "files", "new_lines", "changes"])


PIVOT_SQL = PERIODS_SQL + ", r AS (SELECT author_name, period, sum(new_lines)::BIGINT AS new_lines, sum(changes)::BIGINT AS changes FROM p GROUP BY ALL)"


@query(f"WITH {PIVOT_SQL} SELECT * FROM r")
def author_date_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _periods(spark, sf_dir).authors.groupBy("author_name", "period").agg(F.sum("new_lines").alias("new_lines"), F.sum("changes").alias("changes"))
    return series.last_of_day(rows, ["author_name"], "period", ["new_lines"])


@query(f"""WITH {PIVOT_SQL}, x AS (SELECT author_name, period FROM (SELECT DISTINCT author_name FROM r) CROSS JOIN (SELECT DISTINCT period FROM r))
SELECT author_name, period, coalesce(new_lines, 0) AS new_lines, coalesce(changes, 0) AS changes FROM x LEFT JOIN r USING (author_name, period)""")
def dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _periods(spark, sf_dir).authors.groupBy("author_name", "period").agg(F.sum("new_lines").alias("new_lines"), F.sum("changes").alias("changes"))
    return series.dense(rows, "author_name", "period", ["new_lines", "changes"])


@query("""WITH x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, value FROM events)
SELECT user_id, day, event_id, value FROM x QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", "value")
    return series.last_of_day(e, ["user_id"], "day", ["ts", "event_id"]).select("user_id", "day", "event_id", "value")
