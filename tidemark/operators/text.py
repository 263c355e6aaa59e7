"""Search over notes and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title_of(text: Column) -> Column:
    """The first '# ' heading, else the first line."""
    heading = F.regexp_extract(text, r"(?m)^# (.*)$", 1)
    return F.when(heading != "", heading).otherwise(F.split(text, "\n", 2)[0])


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def search(notes: DataFrame, query: str, limit: int = 5, key: str = "path", text: str = "text", title: str = "title") -> DataFrame:
    """Notes by 100 for each matched term, 10 for each in the title, and up to 20 occurrences; the best `limit`, ties by key."""
    terms = list(dict.fromkeys(t for t in query.lower().split() if t))
    low, low_title = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(title), F.lit("")))
    zero = F.lit(0)
    n = [occurrences(low, t) for t in terms]
    matched = sum(((x > 0) | low_title.contains(t)).cast("int") for x, t in zip(n, terms, strict=True)) if terms else zero
    titled = sum(low_title.contains(t).cast("int") for t in terms) if terms else zero
    score = matched * 100 + titled * 10 + F.least(sum(n, zero), F.lit(20))
    found = notes.withColumns({"matched": matched, "score": score}).where("matched > 0")
    return found.orderBy(F.col("score").desc(), key).limit(limit)


def snippets(text: Column, terms: list[str], around: int = 60, most: int = 3) -> Column:
    """Lines that hold a term, cut to a length."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(x), t)))
    return F.slice(F.transform(lines, lambda x: F.substring(F.trim(x), 1, 2 * around)), 1, most)


def history(messages: DataFrame, by: str, order: str, limit: int, role: str = "role") -> DataFrame:
    """The last `limit` turns of each conversation, oldest first, from the first user turn on."""
    w = Window.partitionBy(by)
    last = messages.withColumn("_rn", F.row_number().over(w.orderBy(F.col(order).desc()))).where(F.col("_rn") <= limit)
    first = F.min(F.when(F.col(role) == "user", F.col(order))).over(w)
    return last.withColumn("_first", first).where(F.col(order) >= F.col("_first")).drop("_rn", "_first")


def split_for_limit(text: Column, limit: int) -> Column:
    """Chunks of at most limit characters, cut at the last line end within it where there is one."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?:.{{1,{limit}}}(?:\n|$)|.{{1,{limit}}})"), F.lit(0))


def keyword_sentiment(titles: DataFrame, by: str, text: str, positive: list[str], negative: list[str], most: int = 8) -> DataFrame:
    """50 plus 12 for each positive less negative keyword on average over a key's first titles, within 0 to 100."""
    low = F.lower(text)
    s = sum((low.contains(w).cast("int") for w in positive), F.lit(0)) - sum((low.contains(w).cast("int") for w in negative), F.lit(0))
    f = titles.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("_rn") <= most)
    return f.groupBy(by).agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 12 * F.avg(s))).alias("sentiment"))
