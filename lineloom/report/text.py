"""Reports. Every input is a result with one row per author, period or group; rows are fetched in order."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators import changes as ops
from lineloom.operators import duplicates
from lineloom.operators.clusters import cluster_authors, cluster_lines
from lineloom.plans.changes import Changes
from lineloom.plans.ownership import Ownership

#: The columns of the ownership CSV.
CSV_HEADER = ["AuthorName", "AuthorMail", "OwnedLinesTotal", "OwnedLinesAgeDaysSum", "OwnedLinesDuplicate", "OwnedLinesDuplicateOriginal", "OwnedLinesDuplicateOriginalOthers"]


def share(value: float, total: float) -> str:
    """" (n%)", cut towards zero; nothing if the total is 0."""
    return f" ({int(100 * value / total)}%)" if total else ""


def change(now: int, before: int) -> str:
    return f" ({now - before:+d})" if before and now != before else " (0)" if before else " " * 7


def change_share(now: int, before: int) -> str:
    if not before:
        return " " * 7
    percent = int(100 * (now - before) / before)
    return f" ({'+' if now > before else ''}{percent}%)"


def aligned(header: list[str], rows: Iterable[list[str]]) -> str:
    """Rows in columns as wide as their widest value."""
    table = [header, *rows]
    widths = [max(len(r[i]) for r in table) for i in range(len(header))]
    return "".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in table)


def clusters_text(totals: DataFrame, verb: str, title: str) -> str:
    rows = cluster_lines(cluster_authors(totals, 3, verb)).orderBy(F.col("cluster_value").desc()).collect()
    return title + "".join(f"  {r['cluster_name']}: {r['text']}\n" for r in rows) if rows else ""


# The labels and the layout of the reports below.
def ownership_text(result: Ownership, full: bool = True) -> str:
    t = result.totals.first()
    out = f"\nTotal authors: {t['authors']}\nTotal files: {t['files']}\n"
    if full:
        age = t["age_days_sum"] / t["lines"] if t["lines"] else 0
        out += f"Avg line age: {age:.0f} days\nDuplicated lines: {t['duplicated']}{share(t['duplicated'], t['lines'])}\n"
    out += clusters_text(result.authors.select("author_name", F.col("lines").alias("total")), "owns", "Author clusters:\n")
    out += f"Total lines: {t['lines']}\n"
    for a in result.authors.orderBy(F.col("lines").desc(), "author_name").toLocalIterator():
        part = 100 * a["lines"] / t["lines"] if t["lines"] else 0
        mail = f" {a['author_mail']}" if full and a["author_mail"] else ""
        more = ""
        if full:
            days = int(a["age_days_sum"] / a["lines"]) if a["lines"] else 0
            more = f" avg-days:{days} dup:{a['duplicated']} orig:{a['original']} dup-others:{a['original_others']}"
        out += f"  {a['author_name']}{mail}: {a['lines']} ({part:.1f}%){more}\n"
    return out


def ownership_csv(result: Ownership) -> str:
    buffer = io.StringIO()
    writer = csv.writer(buffer, delimiter=";", lineterminator="\n")
    writer.writerow(CSV_HEADER)
    for a in result.authors.orderBy(F.col("lines").desc(), "author_name").toLocalIterator():
        writer.writerow([a["author_name"], a["author_mail"] or "", a["lines"], f"{a['age_days_sum']:.2f}", a["duplicated"], a["original"], a["original_others"]])
    return buffer.getvalue()


def write_ownership_csv(result: Ownership, path: str) -> None:
    """The same table as files, written by the tasks that hold its rows."""
    names = ["author_name", "author_mail", "lines", "age_days_sum", "duplicated", "original", "original_others"]
    rows = result.authors.withColumn("age_days_sum", F.format_string("%.2f", "age_days_sum"))
    rows.select(*[F.col(c).alias(h) for c, h in zip(names, CSV_HEADER, strict=True)]).write.option("sep", ";").option("header", True).csv(path)


def duplicates_text(result: Ownership, full: bool = True) -> str:
    t = result.totals.first()
    lines = duplicates.iterate_groups(result.groups, result.related, None if full else 20)
    return f"Total lines: {t['lines']}\nDuplicated lines: {t['duplicated']}{share(t['duplicated'], t['lines'])}\n" + "".join(f"{x}\n" for x in lines)


def _touched(r) -> int:
    return r["new_lines"] + r["changes"]


def touched_block(r, touched_total: int = 0) -> str:
    refactor, churn = r["refactor_own"] + r["refactor_other"], r["churn_own"] + r["churn_other"]
    return (
        f"- Total lines touched: {_touched(r)}{share(_touched(r), touched_total)}\n"
        f"  - New lines: {r['new_lines']}{share(r['new_lines'], _touched(r))}\n"
        f"  - Changed lines: {r['changes']}{share(r['changes'], _touched(r))}\n"
        f"    - Refactor: {refactor}{share(refactor, r['changes'])}\n"
        f"      - Refactor of own lines: {r['refactor_own']}{share(r['refactor_own'], refactor)}\n"
        f"      - Refactor of other's lines: {r['refactor_other']}{share(r['refactor_other'], refactor)}\n"
        f"      * Refactor done by others to own lines (help received): {r['refactor_received']}\n"
        f"    - Churn: {churn}{share(churn, r['changes'])}\n"
        f"      - Churn of own lines: {r['churn_own']}{share(r['churn_own'], churn)}\n"
        f"      - Churn of other's lines (help given): {r['churn_other']}{share(r['churn_other'], churn)}\n"
        f"      * Churn done by others to own lines (help received): {r['churn_received']}\n"
    )


def _changes_clusters(result: Changes) -> str:
    totals = result.authors.groupBy("author_name").agg(F.sum(F.col("new_lines") + F.col("changes")).alias("total"))
    return clusters_text(totals, "touched", "\nAuthor clusters\n")


def changes_text(result: Changes) -> str:
    """The long report: totals, clusters, a block and the top files of each author."""
    t = result.totals.first()
    if not t["commits"]:
        return "No changes found"
    authors = result.authors.orderBy((F.col("new_lines") + F.col("changes")).desc(), "author_name").collect()
    out = f"Total authors active: {len(authors)}\nTotal files touched: {t['files']}\n"
    if t["changes"]:
        out += f"Average line age when changed: {int(t['age_days_sum'] / t['changes'])} days\n"
    out += touched_block(t) + "\n" + _changes_clusters(result)
    files: dict[tuple, list] = {}
    for f in ops.top_files(result.files).orderBy("place").collect():
        files.setdefault((f["author_name"], f["author_mail"]), []).append(f)
    for a in authors:
        if _touched(a):
            out += f"\nAuthor: {a['author_name']} {a['author_mail']}\n" + touched_block(a, _touched(t)) + "  - Top files:\n"
            out += "".join(f"    - {f['file_path']} ({f['lines']})\n" for f in files.get((a["author_name"], a["author_mail"]), []))
    return out


#: Headings of the rankings.
TITLES = {"top_coders": "Top Coders (new+refactor-churn)", "top_new_liners": "Top New Liners", "top_refactorers": "Top Refactorers", "top_helpers": "Top Helpers", "top_churners": "Top Churners"}


def changes_short_text(result: Changes) -> str:
    """Five rankings of three authors each."""
    total = result.totals
    if not total.first()["commits"]:
        return "No changes found"
    out = _changes_clusters(result)
    for name, title in TITLES.items():
        all_of = total.select(ops.RANKINGS[name]().alias("score")).first()["score"]
        out += f"\n{title}\n"
        for a in ops.top_authors(result.authors, name).collect():
            mail = f" {a['author_mail']}" if name == "top_coders" else ""
            out += f"  {a['author_name']}{mail}: {a['score']}{share(a['score'], all_of)}\n"
    return out


def series_text(rows: list, label: str, measures: dict[str, str], last: str) -> str:
    """A table of a series with changes from row to row; `last`: "Total" or "Inc/period"."""
    out, before = [], None
    for r in rows:
        out.append([str(r[label]), *[f"{r[m]}{change(r[m], before[m] if before else 0)}" for m in measures]])
        before = r
    if rows and last == "Total":
        out.append([last, *[str(sum(r[m] for r in rows)) for m in measures]])
    elif rows:
        out.append([last, *[f"{rows[-1][m] - rows[0][m]}{change_share(rows[-1][m], rows[0][m])}" for m in measures]])
    return aligned([label.capitalize(), *measures.values()], out)


def author_series_text(people: list[dict], label: str, measures: dict[str, str], last: str) -> str:
    """A series of each author, by name; people: rows of author and period, newest period first.

    An author who comes with several mails in a period has one row of their sums.
    """
    series: dict[str, dict[str, dict]] = {}
    for r in reversed(people):
        row = series.setdefault(r["author_name"], {}).setdefault(r[label], {label: r[label], **dict.fromkeys(measures, 0)})
        for m in measures:
            row[m] += r[m]
    return "".join(f"\n{name}\n" + series_text(list(rows.values()), label, measures, last) for name, rows in sorted(series.items()))
