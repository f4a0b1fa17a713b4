"""Small literal tables of cases that the driver's tables don't hold, for Spark and, as VALUES, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: id, title, content, url, tier, age in days, limit of days.
ITEMS = [
    (-1, "[OFFER] one year of the pro plan", "", "https://www.reddit.com/r/DiscountOffer90/comments/1", "aggregated", 1, 7),
    (-2, "[H] codes [W] cash", "", "https://www.reddit.com/r/IdealSociety/comments/2", "aggregated", 1, 7),
    (-3, "An ideal town votes", "The council of the town has voted on the new park after two years of talks about it, it says.", "https://www.reddit.com/r/IdealSociety/comments/3", "aggregated", 9, 7),
    (-4, "Release v5.14.0", "", "https://github.com/a/b/releases/tag/v5.14.0", "curated", 9, 0),
    (-5, "I built a tracker for my garden", "It waters the plants.", "https://www.reddit.com/r/u_someone/comments/5", "aggregated", None, 7),
    (-6, "Show HN: my new tool supports Claude Opus 5", "It also reads mail.", "https://news.ycombinator.com/item?id=6", "aggregated", 7, 7),
    (-7, "Gemini season and what it means for you", "The stars say so.", "https://example.org/stars", "aggregated", 1, 7),
    (-8, "Gemini adds a longer context window", "Google says so.", "https://blog.google/gemini", "primary", 8, 7),
    (-9, "Daily discussion thread", "", "https://www.reddit.com/r/stocks/comments/9", "aggregated", 0, 7),
    (-10, "Remote jobs hiring now", "Use my link", "https://example.org/jobs", None, 1, 7),
    (-11, "Open-sourced my side project", "Code inside.", "https://github.com/someone/project", "curated", 1, 7),
    (-12, "Welcome to r/lists, read this first", "", "https://www.reddit.com/r/accountsharingclub/comments/12", "aggregated", 1, 7),
    (-13, "v0.14.23", "", "https://example.org/v", "aggregated", 1, 7),
    (-14, "We just shipped our startup's app", "A list of things.", "https://example.org/app", "aggregated", 1, 7),
    (-15, "", "", "https://www.reddit.com/r/u_other/comments/15", "aggregated", 1, 7),
    (-16, "Weekly knitting thread", "Show your work.", "https://www.reddit.com/r/FlashSale/comments/16", "aggregated", 1, 7),
]
ITEM = "id bigint, title string, content string, url string, tier string, age int, max_days int"

#: thread, no, publisher, title: near-duplicates, series by version or date, titles of few words, publishers at the end.
TITLED = [
    ("t1", 1, "a", "Maker releases big engine v0.117.0 for all users"), ("t1", 2, "b", "Maker releases big engine v0.117.1 for all users"),
    ("t1", 3, "c", "Maker releases big engine v0.117.0 for all users - The Paper"), ("t1", 4, "d", "maker releases big engine v0.117.0, for all users!"),
    ("t2", 1, "a", "Company reports strong growth in July sales"), ("t2", 2, "b", "Company reports strong growth in June sales"), ("t2", 3, "c", "Company reports very strong growth in July sales"),
    ("t3", 1, "a", "short title"), ("t3", 2, "b", "short title"), ("t3", 3, "c", ""), ("t3", 4, "d", None),
    ("t4", 1, "a", "one two three four five six seven eight nine ten"), ("t4", 2, "b", "one two three four five six seven eight nine eleven"),
    ("t4", 3, "c", "one two three four five six seven eight eleven twelve"), ("t4", 4, "a", "one two three four five six seven eight nine ten"),
    ("t5", 1, "a", "press release of the same pitch"), ("t5", 2, "b", "press release of the same pitch"), ("t5", 3, "c", "press release of the same pitch | Wire"),
]
TITLE = "thread string, no int, publisher string, title string"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(name: str, rows: list[tuple], schema: str) -> str:
    """The same table as a common table expression."""
    kinds = {"string": "varchar", "bigint": "bigint", "int": "int", "double": "double", "boolean": "boolean"}
    columns = [c.split() for c in schema.split(", ")]

    def one(value: object, kind: str) -> str:
        shown = "null" if value is None else "'" + str(value).replace("'", "''") + "'" if kind == "string" else str(value)
        return f"cast({shown} as {kinds[kind]})"

    lines = ", ".join("(" + ", ".join(one(v, k) for v, (_, k) in zip(row, columns, strict=True)) + ")" for row in rows)
    return f"{name}({', '.join(c for c, _ in columns)}) as (select * from (values {lines}) q)"
