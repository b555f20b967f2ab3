import itertools
import random
import subprocess
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineloom.functions import numbers, reldate
from lineloom.operators import changes, clusters, commits, duplicates, filters, series
from lineloom.options import ChangesOptions, OptionError, OwnershipOptions, describe
from lineloom.sources import diff
from lineloom.sources.cache import ResultCache, cache_key

NOW = datetime(2024, 3, 31, 12, tzinfo=UTC)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("now", NOW), ("30 days ago", NOW - timedelta(30)), ("now - 2 weeks - 2 weeks", NOW - timedelta(28)), ("1 month ago", datetime(2024, 2, 29, 12, tzinfo=UTC)),
        ("2024-01-02", datetime(2024, 1, 2, tzinfo=UTC)), ("2024-01-02T10:00:00-02:00 - 1 hour", datetime(2024, 1, 2, 11, tzinfo=UTC)), ("1 year ago", datetime(2023, 3, 31, 12, tzinfo=UTC)),
    ],
)
def test_relative_dates(text, want):
    assert reldate.resolve(text, NOW) == want


def test_bad_dates_and_ticks():
    with pytest.raises(ValueError, match="no date"):
        reldate.resolve("next tuesday", NOW)
    assert [t.day for t in reldate.ticks("2024-03-01", "2024-03-20", "1 week", NOW)] == [20, 13, 6]


def test_options():
    with pytest.raises(OptionError):
        OwnershipOptions(min_duplicate_lines=0)
    with pytest.raises(OptionError):
        OwnershipOptions(files="(")
    with pytest.raises(OptionError, match="lookaround"):
        OwnershipOptions(authors="(?=x)")
    with pytest.raises(OptionError, match="not both"):
        ChangesOptions(since_commit="a", until_commit="b")
    assert describe(OwnershipOptions(files="x")) == "repo: .\nbranch: main\nfiles: x\nauthors: .*\n"


def test_filters(spark):
    df = spark.createDataFrame([("src/a.go",), ("  ",), ("src/a_test.go",), ("doc.md",)], "p string")
    assert [r.p for r in df.where(filters.file_matches(df.p, r"\.go$", "_test")).collect()] == ["src/a.go"]
    who = spark.createDataFrame([("ann", "<x@a>"), ("bob", "<ann@b>"), ("cid", "<c@c>")], "n string, m string")
    assert [r.n for r in who.where(filters.author_matches(who.n, who.m, "ann", "@b")).collect()] == ["ann"]
    lines = spark.createDataFrame([("   ",), ("\t",), ("x",), ("",)], "c string")
    assert [r.c for r in lines.where(filters.not_blank(lines.c)).collect()] == ["\t", "x"]


def test_percent_and_difference(spark):
    df = spark.createDataFrame([(8, 11), (-3, 11), (1, 0)], "v bigint, t bigint")
    assert [r[0] for r in df.select(numbers.percent_text(df.v, df.t)).collect()] == [" (72%)", " (-27%)", ""]
    assert [r[0] for r in df.select(numbers.difference_text(df.v, df.t)).collect()] == [" (-3)", " (-14)", " " * 7]
    assert [r[0] for r in df.select(numbers.difference_percent_text(df.t, df.v)).collect()] == [" (+37%)", " (+-466%)", " (-100%)"]


def lines_of(spark, files):
    ts = datetime(2024, 1, 1)
    rows = [("h", f, i + 1, "ann" if f < "m" else "bob", "<m>", ts + timedelta(hours=k), f, text) for k, (f, ls) in enumerate(files.items()) for i, text in enumerate(ls)]
    return spark.createDataFrame(rows, "commit_id string, file_path string, line_number int, author_name string, author_mail string, author_ts timestamp, origin_commit_id string, contents string")


def test_windows_are_trimmed_and_filtered(spark):
    long = "x" * 20
    df = lines_of(spark, {"a": ["next" + long, long + "return", "short", "", long, "* " + long, long, "my import " + long, long + "\t ", "  " + long]})
    w = {r.line_number: r.window for r in duplicates.windows(df, 2).collect()}
    assert len(w) == 9 and w[1] == f"ext{long}\\n{long}retur"
    found = duplicates.occurrences(df, 2).collect()
    assert sorted(r.line_number for r in found) == [1, 9]


def test_white_space_does_not_tell_copies_apart(spark):
    long = "y" * 8
    df = lines_of(spark, {"a": [f"{long} {long}"], "b": [f"  {long}\t{long} "], "z": [f"{long}{long}"]})
    found = {r.file_path: (r.n, r.is_first) for r in duplicates.occurrences(df, 1).collect()}
    assert found == {"a": (3, True), "b": (3, False), "z": (3, False)}


@pytest.mark.parametrize(("spans", "want"), [([(1, 1), (2, 2), (5, 4)], [(1, 3), (5, 4)]), ([(4, 4), (2, 2), (1, 1)], [(1, 7)]), ([(1, 9), (2, 1), (11, 1)], [(1, 9), (11, 1)])])
def test_islands(spark, spans, want):
    df = spark.createDataFrame([("f", a, n) for a, n in spans], "file_path string, line_number int, line_count int")
    assert sorted((r.line_number, r.line_count) for r in duplicates.merged(df).collect()) == want


def greedy(rows):
    """Groups by the definition, over all rows at once. rows: (file, line, count, text)."""

    def runs(spans):
        out = []
        for f, a, n in sorted(spans):
            if out and out[-1][0] == f and a <= out[-1][2] + 1:
                out[-1] = (f, out[-1][1], max(out[-1][2], a + n - 1))
            else:
                out.append((f, a, a + n - 1))
        return out

    taken, result = set(), []
    for run in runs([r[:3] for r in rows]):
        texts = {r[3] for r in rows if r[0] == run[0] and run[1] <= r[1] <= run[2]}
        related = [x for x in runs([r[:3] for r in rows if r[3] in texts]) if x != run and x not in taken]
        taken.update(related)
        if run not in taken:
            taken.add(run)
            result.append((run[0], run[1], run[2] - run[1] + 1, sum(b - a + 1 for _, a, b in related)))
    return sorted(result)


@pytest.mark.parametrize("seed", range(6))
def test_groups_match_the_definition(spark, seed):
    r = random.Random(seed)
    rows = sorted({(f"f{r.randint(0, 5)}", r.randint(1, 40), 2, f"t{r.randint(0, 9 + 3 * seed)}") for _ in range(70)})
    # whole files that are copies of one another
    rows += [(f"copy{c}", a, 2, t) for c in range(seed) for f, a, _, t in rows if f == "f1"]
    n = pd.Series([x[3] for x in rows]).value_counts()
    rows = [x for x in rows if n[x[3]] > 1]
    found = spark.createDataFrame([(f, a, t, 2) for f, a, _, t in rows], "file_path string, line_number int, text_key string, n int").withColumn("text_key", F.col("text_key").cast("binary"))
    groups, related = duplicates.duplicate_groups(found, 2), duplicates.related_runs(found, 2)
    got = sorted((g.file_path, g.line_number, g.line_count, g.related_count) for g in groups.collect())
    assert got == greedy(rows)
    sums = {}
    for x in related.collect():
        sums[x.file_path, x.line_number] = sums.get((x.file_path, x.line_number), 0) + x.related_lines
    assert sums == {(f, a): n for f, a, _, n in got if n}


def touch(spark, rows):
    day = lambda d: None if d is None else datetime(2024, 1, 1) + timedelta(days=d)
    data = [(c, f, "Change", n, a, f"<{a}>", s, s and f"<{s}>", w, day(at), day(old)) for c, f, n, a, s, w, at, old in rows]
    return spark.createDataFrame(data, "commit_id string, file_path string, op string, lines bigint, actor_name string, actor_mail string, src_author_name string, src_author_mail string, commit_author_name string, commit_ts timestamp, src_ts timestamp")


def test_classification_and_its_invariants(spark):
    rows = [("1", "f", 3, "ann", None, "ann", 40, None), ("2", "f", 1, "ann", "ann", "ann", 21, 0), ("2", "f", 1, "ann", "ann", "ann", 22, 0), ("3", "g", 1, "bob", "ann", "bob", 50, 0), ("3", "g", 1, "bob", "ann", "bob", 50, 45), ("4", "f", 1, "cid", "ann", "bob", 5, 1)]
    t = changes.classified(touch(spark, rows))
    assert [r.kind for r in t.orderBy("commit_id", "commit_ts", "src_ts").collect()] == ["new", "churn_own", "refactor_own", "refactor_other", "churn_other", "churn_other"]
    parts = changes.contributions(t)
    by = {r.author_name: r for r in changes.by_author(changes.counted(parts, F.lit(True))).collect()}
    assert (by["ann"].new_lines, by["ann"].changes, by["ann"].refactor_received, by["ann"].churn_received) == (3, 2, 1, 2)
    assert all(a.changes == a.refactor_own + a.refactor_other + a.churn_own + a.churn_other for a in by.values())
    # without a counted toucher a commit's file is left out, received lines included
    of_ann = changes.counted(parts, F.col("author_name") == "ann")
    only = changes.totals(of_ann, of_ann.where("touch")).first()
    assert (only.commits, only.refactor_received, only.churn_received) == (2, 0, 0)


def test_rankings_and_flows(spark):
    rows = [("1", f"f{i}", i, f"a{i % 4}", None, "x", 40, None) for i in range(1, 30)]
    parts = changes.contributions(changes.classified(touch(spark, rows)))
    top = changes.top_authors(changes.by_author(parts), "top_new_liners").collect()
    assert [a.author_name for a in top] == ["a1", "a0", "a3"]
    files = changes.top_files(changes.by_author_file(parts)).where("author_name = 'a1'").orderBy("place").collect()
    assert [f.lines for f in files] == [29, 25, 21, 17, 13]
    assert {(f.source, f.target): f.lines for f in changes.flows(changes.totals(parts, parts)).collect()}["touched", "new"] == sum(range(1, 30))


def test_ranges_samples_and_differences(spark):
    t0 = datetime(2024, 1, 1)
    c = spark.createDataFrame([(f"c{i}", [f"c{i - 1}"] if i else [], t0 + timedelta(days=i)) for i in range(10)], "commit_id string, parent_ids array<string>, commit_ts timestamp")
    ids = lambda df: sorted(r.commit_id for r in df.collect())
    assert ids(commits.in_range(c, t0 + timedelta(3), t0 + timedelta(5))) == ["c2", "c3", "c4", "c5"]
    assert ids(commits.in_range(c.drop("parent_ids"), t0 + timedelta(3), t0 + timedelta(5))) == ["c2", "c3", "c4", "c5"]
    assert ids(commits.in_range(c, t0 + timedelta(3), t0 + timedelta(5), boundary=False)) == ["c3", "c4", "c5"]
    assert ids(commits.symmetric_difference(c.limit(4).select("commit_id"), c.where("commit_id > 'c1'").select("commit_id")))[:2] == ["c0", "c1"]
    got = series.samples(c, [t0 + timedelta(hours=h) for h in (300, 250, 30, 31, -5)]).orderBy("tick").collect()
    assert [(r.commit_id, r.tick) for r in got] == [("c1", t0 + timedelta(hours=31)), ("c9", t0 + timedelta(hours=300))]
    parents = c.select("commit_id", F.get("parent_ids", F.lit(0)).alias("parent_id"))
    some = spark.createDataFrame([("c3",), ("nope",)], "commit_id string")
    assert ids(commits.ancestors(parents, some)) == ["c0", "c1", "c2", "c3"]
    assert ids(commits.tips(parents)) == ["c9"] and ids(commits.by_id(c, some)) == ["c3"]


def test_series(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 4), ("b", 1, 7)], "who string, day int, n bigint")
    assert [r.n_delta for r in series.deltas(df, "day", ["n"], ("who",)).orderBy("who", "day").collect()] == [None, None, -1, None]
    assert {r.who: (r.n_growth, r.n_percent) for r in series.growth(df, "day", ["n"], ("who",)).collect()} == {"a": (4, None), "b": (0, 0)}
    assert series.with_total(df.where("who = 'a'").select("day", "n"), "day", ["n"]).where("day = 'Total'").first().n == 9
    assert sorted((r.who, r.day, r.n) for r in series.dense(df, "who", "day", ["n"]).collect()) == [("a", 1, 0), ("a", 2, 5), ("a", 3, 4), ("b", 1, 7), ("b", 2, 0), ("b", 3, 0)]


def test_clusters(spark):
    df = spark.createDataFrame([("author3", 5), ("author1", 1), ("author2", 1)], "author_name string, total bigint")
    rows = clusters.cluster_lines(clusters.cluster_authors(df, 2)).orderBy(F.col("cluster_value").desc()).collect()
    assert [(r.cluster_name, r.text) for r in rows] == [("Authors that owns ~5 lines", "author3"), ("Authors that owns ~1 lines", "author1, author2")]
    many = spark.createDataFrame([(f"a{i}", 100 + i) for i in range(6)] + [("z", 9000), ("y", 1)], "author_name string, total bigint")
    rows = {r.cluster_value: r.text for r in clusters.cluster_lines(clusters.cluster_authors(many, 3)).collect()}
    assert rows[9000] == "z" and rows[102] == "a5, a4, a3, a2... (+2)"
    assert clusters.cluster_authors(df.limit(0)).count() == 0


def test_clusters_are_the_best_there_are():
    r = random.Random(3)
    for n, k in ((1, 3), (2, 3), (3, 3), (7, 1), (7, 2), (9, 3), (12, 4)):
        x = np.array(sorted(r.sample(range(1, 200), n)), float)
        w = np.array([r.randint(1, 4) for _ in x], float)

        def off(cuts):
            parts = [(x[a:b], w[a:b]) for a, b in zip((0, *cuts), (*cuts, n), strict=True)]  # noqa: B023
            return sum((wt * (v - np.average(v, weights=wt)) ** 2).sum() for v, wt in parts)

        got = clusters.best_clusters(x, w, k)
        cuts = [int(np.searchsorted(x, last, "right")) for last, _ in got[:-1]]
        assert len(got) == min(n, k) and abs(off(cuts) - min(off(c) for c in itertools.combinations(range(1, n), min(n, k) - 1))) < 1e-6
    assert clusters.best_clusters(np.zeros(0), np.zeros(0), 3) == []


def shortest(a, b):
    """Lines that a shortest edit of a to b keeps."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diffs_are_shortest_and_lead_from_one_text_to_the_other():
    r = random.Random(1)
    for _ in range(400):
        a = [r.choice("abcdefgh"[: r.randint(2, 8)]) for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 1)] = r.choice([[], ["x"], ["a", "b"]])
        a, b = diff.lines_of("".join(x + "\n" for x in a)), diff.lines_of("\n".join(b))
        hunks, out, at = diff.diff_lines(a, b), [], 0
        for h in hunks:
            out += a[at : h.src_from - 1] + b[h.dst_from - 1 : h.dst_to]
            at = h.src_to
        assert out + a[at:] == b
        assert sum(len(h.src) + len(h.dst) for h in hunks) == len(a) + len(b) - 2 * shortest(a, b)


def test_diffs_of_programs_equal_the_tool(tmp_path):
    src = [f"line {i}\n" for i in range(60)] + ["same\n"] * 3
    # of several shortest edits the tool may give another one; of these texts it gives the same
    edits = [src[:10] + ["new\n"] + src[10:], src[:5] + src[9:], src[:20] + ["x\n", "y\n"] + src[21:40] + src[45:] + ["end"], ["same\n", *src], src + ["same\n"], [], src[:60:2] + src[60:], src[:30] + src[10:]]
    for dst in edits:
        (tmp_path / "a").write_text("".join(src))
        (tmp_path / "b").write_text("".join(dst))
        want = subprocess.run(["diff", "-a", str(tmp_path / "a"), str(tmp_path / "b")], capture_output=True, text=True, check=False).stdout
        assert diff.diff_texts("".join(src), "".join(dst)) == diff.parse_normal(want)


def test_parsed_diffs_equal_the_parser(spark):
    texts = ["1,3c1\n< a\n< 2c3\n< c\n---\n> x\n5a4,5\n> p\n> q\n\\ No newline at end of file\n9d7\n< z\n", "", None, "0a1\n> 1a2"]
    got = diff.parsed(spark.createDataFrame(list(enumerate(texts)), "pair_id int, diff string")).collect()
    want = [(i, h.op, h.src_from, h.src_to, h.dst_from, h.dst_to) for i, t in enumerate(texts) for h in diff.parse_normal(t or "")]
    assert sorted(map(tuple, got)) == sorted(want)
    pairs = spark.createDataFrame([(1, None, "a\n"), (2, "a\n", None), (3, None, None)], "pair_id int, src string, dst string")
    assert sorted((r.pair_id, r.op) for r in diff.diff_pairs(pairs).collect()) == [(1, "Add"), (2, "Delete")]


def test_diffs():
    (first, *_) = diff.parse_normal("1,3c1\n< a\n< b\n< c\n---\n> x\n5a4,5\n> p\n> q\n\\ No newline at end of file\n9d7\n< z\n")
    assert (first.op, first.src_from, first.src_to, first.dst_from, first.dst_to, first.src, first.dst) == ("Change", 1, 3, 1, 1, ("a", "b", "c"), ("x",))
    ops = [(h.op, h.src_from, h.src_to, h.dst_from, h.dst_to) for h in diff.diff_texts("a\nb\nc\n", "a\nc\nd\ne\n")]
    assert ops == [("Delete", 2, 2, 2, 1), ("Add", 4, 3, 3, 4)]
    assert [h.op for h in diff.diff_texts("a", "a\n")] == ["Change"] and diff.diff_texts("x\n", "x\n") == []
    assert diff.expand("8,10") == [8, 9, 10] and diff.expand("7") == [7]
    with pytest.raises(ValueError, match="normal diff"):
        diff.parse_normal("what")


def test_cache(tmp_path):
    path = str(tmp_path / "c.db")
    c = ResultCache(path, 1)
    c.put("k", {"a": [1, 2]})
    c.put("k", {"a": [3]})
    assert c.get("k") == {"a": [3]} and c.get("other") is None
    time.sleep(0.7)
    assert c.get("k") == {"a": [3]}  # and is renewed
    time.sleep(0.7)
    assert c.get("k") == {"a": [3]}
    time.sleep(1.1)
    assert c.get("k") is None and ResultCache(path, 1).get("k") is None
    o = ChangesOptions(since="2024-01-01", until="2024-02-01")
    day = datetime(2024, 5, 1), datetime(2024, 5, 2)
    assert cache_key("x", o, today=day[0]) == cache_key("x", o, today=day[1])
    assert cache_key("x", ChangesOptions(), today=day[0]) != cache_key("x", ChangesOptions(), today=day[1])
