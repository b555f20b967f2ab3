"""Classification of touched lines, and its sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.numbers import coder_score
from lineloom.schema import MEASURES

#: Fixed value: a line at most so many hours old is churned, an older one refactored.
REFACTOR_AFTER_HOURS = 504


def kind(refactor_after_hours: int = REFACTOR_AFTER_HOURS) -> Column:
    """new, refactor_own, refactor_other, churn_own or churn_other of a line touch."""
    micros = F.unix_micros("commit_ts") - F.unix_micros("src_ts")
    own = F.col("src_author_name") == F.col("commit_author_name")
    old = micros > refactor_after_hours * 3_600_000_000
    return (
        F.when(F.col("src_ts").isNull(), "new")
        .when(old & own, "refactor_own").when(old, "refactor_other")
        .when(own, "churn_own").otherwise("churn_other")
    )


def classified(touches: DataFrame, refactor_after_hours: int = REFACTOR_AFTER_HOURS) -> DataFrame:
    """`touches` with `kind` and, of changed lines, `age_days`."""
    age = (F.unix_micros("commit_ts") - F.unix_micros("src_ts")) / F.lit(86_400e6)
    return touches.withColumn("kind", kind(refactor_after_hours)).withColumn("age_days", age)


def contributions(touches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What each classified touch adds, by author: to the one who touched, and to the one whose
    line another changed. `touch` marks the former. keys: further columns to carry along."""

    def measures(who: str, mail: str, touch: bool, given: dict[str, Column], age: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.struct(F.col(who).alias("author_name"), F.col(mail).alias("author_mail"), F.lit(touch).alias("touch"), *[given.get(m, zero).alias(m) for m in MEASURES], age.alias("age_days_sum"))

    n = F.col("lines")
    if_kind = {m: F.when(F.col("kind") == m, n).otherwise(0) for m in ("refactor_own", "refactor_other", "churn_own", "churn_other")}
    is_new = F.col("kind") == "new"
    if_kind |= {"new_lines": F.when(is_new, n).otherwise(0), "changes": F.when(is_new, 0).otherwise(n)}
    actor = measures("actor_name", "actor_mail", True, if_kind, F.when(is_new, 0.0).otherwise(F.col("age_days") * n))
    received = {"refactor_received": F.when(F.col("kind") == "refactor_other", n).otherwise(0), "churn_received": F.when(F.col("kind") == "churn_other", n).otherwise(0)}
    owner = F.when(F.col("kind").isin("refactor_other", "churn_other"), measures("src_author_name", "src_author_mail", False, received, F.lit(0.0)))
    return touches.select(*keys, "commit_id", "file_path", F.inline(F.filter(F.array(actor, owner), lambda x: x.isNotNull())))


def counted(parts: DataFrame, author_counts: Column | None) -> DataFrame:
    """Contributions of authors that count, of (commit, file) pairs that such an author touched.

    None: all authors count, and so does every pair, since each has someone who touched it.
    """
    if author_counts is None:
        return parts
    own = parts.where(author_counts)
    touched = own.where("touch").select("commit_id", "file_path").distinct()
    return own.join(touched, ["commit_id", "file_path"], "left_semi")


def sums() -> list[Column]:
    return [F.sum(m).alias(m) for m in [*MEASURES, "age_days_sum"]]


def by_author(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All measures by author name and mail."""
    return parts.groupBy(*keys, "author_name", "author_mail").agg(*sums())


def active(authors: DataFrame) -> DataFrame:
    """Authors who touched lines, with `touched` and `place` by it, then by name and mail; others only received."""
    touched = F.col("new_lines") + F.col("changes")
    order = Window.orderBy(F.col("touched").desc(), "author_name", "author_mail")
    return authors.withColumn("touched", touched).where("touched > 0").withColumn("place", F.row_number().over(order))


def by_author_file(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """author_name, author_mail, file_path, lines: lines given to a file; received ones don't count."""
    given = F.col("new_lines") + F.col("churn_own") + F.col("churn_other") + F.col("refactor_own") + F.col("refactor_other")
    return parts.groupBy(*keys, "author_name", "author_mail", "file_path").agg(F.sum(given).alias("lines"))


def totals(parts: DataFrame, touched: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """commits, files and all measures, of every contribution.

    touched: commit_id and file_path of what was touched, repeats included. Each count is a count of
    groups, and the sums need no grouping by commit or file.
    """
    commits, files = (touched.groupBy(*keys, c).agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias(n)) for c, n in (("commit_id", "commits"), ("file_path", "files")))
    measures = parts.groupBy(*keys).agg(*sums())
    joined = commits.join(files, list(keys)).join(measures, list(keys)) if keys else commits.join(files).join(measures)  # else three single rows
    return joined.select(*keys, "commits", "files", *MEASURES, "age_days_sum")


def score() -> Column:
    return coder_score(F.col("new_lines"), F.col("refactor_other"), F.col("refactor_own"), F.col("churn_own"), F.col("churn_received"))


#: name -> what ranks authors.
RANKINGS = {
    "top_coders": score,
    "top_new_liners": lambda: F.col("new_lines"),
    "top_refactorers": lambda: F.col("refactor_other") + F.col("refactor_own"),
    "top_helpers": lambda: F.col("churn_other"),
    "top_churners": lambda: F.col("churn_received") + F.col("churn_own"),
}


def top_authors(authors: DataFrame, ranking: str, k: int = 3) -> DataFrame:
    """The k authors that a ranking puts first: author_name, author_mail, score."""
    ranked = authors.select("author_name", "author_mail", RANKINGS[ranking]().alias("score"))
    return ranked.orderBy(F.col("score").desc(), "author_name", "author_mail").limit(k)


def top_files(files: DataFrame, k: int = 5) -> DataFrame:
    """The k files that each author gave most lines, with `place`."""
    order = Window.partitionBy("author_name", "author_mail").orderBy(F.col("lines").desc(), "file_path")
    return files.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def flows(total: DataFrame) -> DataFrame:
    """The totals row as links (source, target, lines) of a flow chart."""
    links = [
        ("touched", "new", "new_lines"),
        ("touched", "changes", "changes"),
        ("changes", "refactor", "refactor_own + refactor_other"),
        ("changes", "churn", "churn_own + churn_other"),
        ("refactor", "refactor own", "refactor_own"),
        ("refactor", "refactor other", "refactor_other"),
        ("churn", "churn own", "churn_own"),
        ("churn", "churn other", "churn_other"),
    ]
    stack = ", ".join(f"'{a}', '{b}', cast({c} as bigint)" for a, b, c in links)
    return total.selectExpr(f"stack({len(links)}, {stack}) as (source, target, lines)")


def each_line(first: Column | str, last: Column | str) -> Column:
    """A row for each line number from first to last."""
    return F.explode(F.sequence(first, last))


def touches_of_hunks(hunks: DataFrame, dst_blame: DataFrame, src_blame: DataFrame, commits: DataFrame) -> DataFrame:
    """Line touches of diff hunks.

    hunks: op New (a file without a previous version, all its lines), Add, Delete or Change, with
    inclusive line ranges. A new file's lines belong to their blamed authors; an added run to the
    author of its first line; a changed source line to the author of the hunk's first new line,
    a deleted one to the commit's author; new lines beyond the changed ones to their own authors.
    """
    c = commits.select("commit_id", F.col("author_name").alias("commit_author_name"), F.col("author_mail").alias("commit_author_mail"), F.col("author_ts").alias("commit_ts"))
    h = hunks.join(c, "commit_id")
    dst = dst_blame.select("commit_id", "file_path", F.col("line_number").alias("dst_line"), F.col("author_name").alias("dst_name"), F.col("author_mail").alias("dst_mail"))
    src = src_blame.select(F.col("commit_id").alias("prev_commit_id"), "file_path", F.col("line_number").alias("src_line"), F.col("author_name").alias("src_author_name"), F.col("author_mail").alias("src_author_mail"), F.col("author_ts").alias("src_ts"))
    n_src, n_dst = F.col("src_to") - F.col("src_from") + 1, F.col("dst_to") - F.col("dst_from") + 1
    out = ["commit_id", "file_path", "op", "lines", "actor_name", "actor_mail", "src_author_name", "src_author_mail", "commit_author_name", "commit_ts", "src_ts"]
    none = {"src_author_name": F.lit(None).cast("string"), "src_author_mail": F.lit(None).cast("string"), "src_ts": F.lit(None).cast("timestamp")}

    def as_new(rows: DataFrame, lines: Column) -> DataFrame:
        joined = rows.join(dst, ["commit_id", "file_path", "dst_line"])
        return joined.select(*[{**none, "lines": lines.cast("bigint"), "actor_name": F.col("dst_name"), "actor_mail": F.col("dst_mail")}.get(x, F.col(x)).alias(x) for x in out])

    whole = as_new(h.where("op = 'New'").withColumn("dst_line", each_line("dst_from", "dst_to")), F.lit(1))
    added = as_new(h.where("op = 'Add'").withColumn("dst_line", F.col("dst_from")).withColumn("n", n_dst), F.col("n"))
    surplus = h.where("op = 'Change'").where(n_dst > n_src).withColumn("dst_line", each_line(F.col("dst_from") + n_src, "dst_to"))
    surplus = as_new(surplus, F.lit(1))
    old = h.where("op in ('Change', 'Delete')").withColumn("src_line", each_line("src_from", "src_to")).join(src, ["prev_commit_id", "file_path", "src_line"])
    old = old.withColumn("dst_line", F.col("dst_from")).join(dst, ["commit_id", "file_path", "dst_line"], "left")
    deleted = F.col("op") == "Delete"
    changed = old.select(*[{"lines": F.lit(1).cast("bigint"), "actor_name": F.when(deleted, F.col("commit_author_name")).otherwise(F.col("dst_name")), "actor_mail": F.when(deleted, F.col("commit_author_mail")).otherwise(F.col("dst_mail"))}.get(x, F.col(x)).alias(x) for x in out])
    return whole.unionByName(added).unionByName(surplus).unionByName(changed)
