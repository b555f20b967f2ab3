"""Duplicated runs of lines: windows, first occurrences, islands, groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that never count as duplicates (after white space is removed).
IGNORED_LINES = r"^\*|^/\*|^#|import|export|from|package"
#: Fixed value: white space that is removed before lines are compared.
REMOVED_SPACE = r"[\t\n\f\r ]"
MIN_LINE_BYTES = 15
#: What separates the lines of a window: a backslash and an n.
SEPARATOR = "\\n"
#: Fixed value: what ends a report that was cut short.
MORE_RESULTS = '...(use --format "full" for more results)'


def windows(lines: DataFrame, k: int, keys: tuple[str, ...] = ("commit_id", "file_path")) -> DataFrame:
    """`lines` that start a run of k lines of their file, with `window`, the run's text.

    Every line of the run is followed by the separator; then backslashes and n are trimmed off
    both ends.
    """
    ahead = Window.partitionBy(*keys).orderBy("line_number").rowsBetween(0, k - 1)
    run = F.concat(F.concat_ws(SEPARATOR, F.collect_list(F.coalesce("contents", F.lit(""))).over(ahead)), F.lit(SEPARATOR))
    return lines.withColumn("window", F.btrim(run, F.lit("n\\"))).withColumn("window_lines", F.count("*").over(ahead)).where(F.col("window_lines") == k).drop("window_lines")


def normal(window: Column) -> Column:
    return F.regexp_replace(window, REMOVED_SPACE, "")


def eligible(norm: Column, min_bytes: int = MIN_LINE_BYTES) -> Column:
    """Whether all lines of a normalised window are long enough and none is of the ignored kind."""
    return F.forall(F.split(norm, r"\\n"), lambda line: (F.octet_length(line) >= min_bytes) & ~line.rlike(IGNORED_LINES))


def eligible_windows(lines: DataFrame, k: int, min_bytes: int = MIN_LINE_BYTES, keys: tuple[str, ...] = ("commit_id",)) -> DataFrame:
    """Lines that start an eligible window, with `text_key`, a digest of its normalised text."""
    found = windows(lines, k, (*keys, "file_path")).where(F.trim("contents") != "").withColumn("norm", normal(F.col("window")))
    return found.where(eligible(F.col("norm"), min_bytes)).withColumn("text_key", F.unhex(F.sha2("norm", 256))).drop("window", "norm")


def occurrences(lines: DataFrame, k: int, min_bytes: int = MIN_LINE_BYTES, keys: tuple[str, ...] = ("commit_id",), least: int = 1) -> DataFrame:
    """Eligible windows with, of their text: `n`, `first` (the earliest occurrence), `is_first`.

    keys: texts are compared within each snapshot. First means least (author_ts, file, line).
    least: texts that occur less often are left out, before the join that brings n to each window.
    """
    found = eligible_windows(lines, k, min_bytes, keys)
    at = F.struct("author_ts", "file_path", "line_number", "author_name", "author_mail")
    # pre-aggregated, so that a text which repeats everywhere costs one row per task; no window over it
    texts = found.groupBy(*keys, "text_key").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    joined = found.join(texts.where(F.col("n") >= least) if least > 1 else texts, [*keys, "text_key"])
    return joined.withColumn("is_first", (F.col("file_path") == F.col("first.file_path")) & (F.col("line_number") == F.col("first.line_number")))


def islands(spans: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """spans (keys, line_number, line_count, ...) with `island`: spans that overlap or touch share one."""
    in_order = Window.partitionBy(*keys).orderBy("line_number", "line_count")
    end = F.col("line_number") + F.col("line_count") - 1
    before = F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("line_number") > before + 1), 1).otherwise(0)
    return spans.withColumn("starts", starts).withColumn("island", F.sum("starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def merged(spans: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """keys, line_number, line_count: one row for each island of the spans."""
    end = F.max(F.col("line_number") + F.col("line_count") - 1)
    return islands(spans, keys).groupBy(*keys, "island").agg(F.min("line_number").alias("line_number"), (end - F.min("line_number") + 1).cast("int").alias("line_count")).drop("island")


def duplicate_islands(found: DataFrame, k: int) -> DataFrame:
    """file_path, line_number, line_count: runs of lines that lie in windows with copies."""
    return merged(found.where("n > 1").select("file_path", "line_number", F.lit(k).alias("line_count")))


def run_claims(found: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(runs, related): every run of duplicated lines, and each span with the run that claims it.

    Runs are taken in order of file and line. A run's candidates are the spans that the occurrences
    of its texts form; it claims those that no run before it has claimed, itself aside, and is a
    group unless it was claimed. So a span belongs to the first run that has it as a candidate and
    isn't it, and a run's own place in the order is all that is needed besides: no run waits for another.

    runs: span (file_path, line_number, line_count), is_group. related: run and span of what groups claim.
    Runs with the same texts share their candidates, so copies of whole files cost one list for all.
    """
    spans = islands(found.where("n > 1").select("file_path", "line_number", F.lit(k).alias("line_count"), "text_key"))
    end = F.max(F.col("line_number") + F.col("line_count") - 1)
    # a run's texts are bounded by its file's lines
    runs = spans.groupBy("file_path", "island").agg(F.min("line_number").alias("line_number"), (end - F.min("line_number") + 1).cast("int").alias("line_count"), F.sort_array(F.collect_set("text_key")).alias("texts"))
    span = F.struct("file_path", "line_number", "line_count")
    runs = runs.select(span.alias("run"), F.unhex(F.sha2(F.array_join(F.transform("texts", F.hex), "").cast("binary"), 256)).alias("texts_key"), "texts")
    # of the runs with the same texts the first claims for all; what is the first itself, the second claims
    firsts = runs.groupBy("texts_key").agg(F.min("run").alias("first"), F.first("texts").alias("texts"))
    seconds = runs.join(firsts.select("texts_key", "first"), "texts_key").where("run <> first").groupBy("texts_key").agg(F.min("run").alias("second"))
    of_texts = firsts.select("texts_key", F.explode("texts").alias("text_key"))
    candidates = merged(of_texts.join(spans.select("file_path", "line_number", "line_count", "text_key"), "text_key"), ("texts_key", "file_path"))
    claims = candidates.select("texts_key", span.alias("span")).join(firsts.select("texts_key", "first"), "texts_key").join(seconds, "texts_key", "left")
    claims = claims.select("span", F.when(F.col("span") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("run")).groupBy("span").agg(F.min("run").alias("run"))
    known = runs.select(F.col("run").alias("span")).join(claims, "span", "left").select("span", (F.col("run").isNull() | (F.col("run") > F.col("span"))).alias("is_group"))
    # a run that came before was claimed, by another or by itself
    later = claims.where("run is not null").join(known.select("span", "is_group"), "span", "left").where("is_group is null or span > run").select("run", "span")
    groups = known.where("is_group").select(F.col("span").alias("run"))
    return known, later.join(groups, "run", "left_semi")


def duplicate_groups(found: DataFrame, k: int) -> DataFrame:
    """Groups of duplicated runs: file_path, line_number, line_count of the run, how many runs are
    related to it, and their lines together (related_count)."""
    runs, related = run_claims(found, k)
    sums = related.groupBy("run").agg(F.count("*").alias("related_runs"), F.sum("span.line_count").alias("related_count"))
    groups = runs.where("is_group").select(F.col("span").alias("run")).join(sums, "run", "left")
    return groups.select("run.*", F.coalesce("related_runs", F.lit(0)).alias("related_runs"), F.coalesce("related_count", F.lit(0)).alias("related_count"))


def related_runs(found: DataFrame, k: int) -> DataFrame:
    """file_path, line_number, line_count of each group's run, and related_path, related_line, related_lines of a run related to it."""
    _, related = run_claims(found, k)
    return related.select("run.*", F.col("span.file_path").alias("related_path"), F.col("span.line_number").alias("related_line"), F.col("span.line_count").alias("related_lines"))


def iterate_groups(groups: DataFrame, related: DataFrame, related_limit: int | None = None) -> Iterator[str]:
    """Report lines of groups in order of their lines, each with its related runs in order of theirs;
    with a limit, stops after so many related runs."""
    shown, now = 0, None
    run = ["file_path", "line_number", "line_count"]
    rows = groups.join(related, run, "left").orderBy((F.col("line_count") + F.col("related_count")).desc(), "file_path", F.col("line_number").desc(), F.col("related_lines").desc(), "related_path", F.col("related_line").desc())
    for g in rows.toLocalIterator():
        if (g["file_path"], g["line_number"]) != now:
            now = g["file_path"], g["line_number"]
            yield f"{g['file_path']}:{g['line_number']} - {g['line_number'] + g['line_count']}"
        if g["related_path"] is None:
            continue
        yield f"  {g['related_path']}:{g['related_line']} - {g['related_line'] + g['related_lines']}"
        shown += 1
        if related_limit is not None and shown > related_limit:
            yield MORE_RESULTS
            return
