"""Documents with every awkward trait: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward() -> list[tuple]:
    r = random.Random(7)
    words = ["the", "of", "Line", "über", "кит", "a1", "x", "No!", "end.\n", "\t"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(60)
    rows = [(i, text(r.randint(0, 40)), "en", f"s{i % 3}", 0) for i in range(12)]
    rows += [(100, base, "en", "s1", 0), (101, base.upper().replace("ÜBER", "über").replace("КИТ", "кит"), "en", None, 0), (102, base, None, "s0", 0), (102, base, None, "s0", 0)]
    rows += [(200, None, "en", "s0", None), (201, "", "en", "s2", 0), (None, "lost id", "en", None, 1), (None, None, None, None, None)]
    rows += [(300, text(20_000), "en", "s2", 0), (301, "w" * 30_000, "en", "s2", 0), (302, base + " tail", "en", "s0", 0)]
    return rows


def frame(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if extra:  # names that operators use inside
        for name in ("id", "row", "digest", "kept", "size", "key", "shard", "score", "words", "fp", "at_file", "at_row", "place", "body", "n"):
            df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, tmp_path, df, name: str = "documents") -> str:
    """Writes df as a table of a folder; returns the folder."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
