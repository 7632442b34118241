"""Question terms shown in texts: snippets around the densest place, and highlighted windows. Relational throughout: a text
is cut at its hits, running sums of lengths give positions, and window frames count and group them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as T

# Characters of a snippet; characters around a highlight, windows a text.
WIDTH, RADIUS, WINDOWS = 240, 90, 3


def query_terms(question: Column) -> Column:
    """Distinct words of three characters or more that are no stop words, the longest first."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z0-9#]+"), F.lit(0))
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*T.SNIPPET_STOPWORDS)))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(ranked, lambda r: r["w"])


def any_of(terms: Column) -> Column:
    """A pattern for any of the terms in either case; one that fits nothing if there are none."""
    return F.when(F.size(terms) == 0, F.lit("[^\\s\\S]")).otherwise(F.concat(F.lit("(?i)("), F.array_join(terms, "|"), F.lit(")")))


def positions(rows: DataFrame, keys: list[str], text: str, pattern: Column) -> DataFrame:
    """(keys, at, word, start, stop): where the pattern fits, in order; places count from 0."""
    hits = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    cut = F.zip_with(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, word: F.struct(F.length(gap).alias("gap"), word.alias("word")))
    flat = rows.select(*keys, F.posexplode(cut).alias("at", "hit")).select(*keys, "at", "hit.*")
    stop = F.sum(F.col("gap") + F.length("word")).over(W.partitionBy(*keys).orderBy("at"))
    return flat.select(*keys, "at", "word", (stop - F.length("word")).alias("start"), stop.alias("stop"))


def snippets(rows: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """(keys, snippet) from (keys, text, terms): whole words around the hit with most hits near it, hits marked.

    A text without a hit shows its beginning. ``keys`` tell rows apart.
    """
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = rows.select(*keys, flat.alias("flat"), any_of(F.col("terms")).alias("pattern"))
    near = F.count("*").over(W.partitionBy(*keys).orderBy("start").rangeBetween(-(width // 2), width // 2))
    best = positions(rows, keys, "flat", F.col("pattern")).withColumn("near", near)
    best = best.groupBy(*keys).agg(F.max_by(F.struct("start", "stop"), F.struct("near", -F.col("start"))).alias("hit"))
    out = rows.join(best, keys, "left").withColumn("n", F.length("flat"))
    low = F.floor((F.col("hit.start") + F.col("hit.stop")) / 2) - width // 2
    low = F.greatest(F.lit(0), F.least(low, F.greatest(F.lit(0), F.col("n") - width))).cast("int")
    out = out.withColumns({"low": low, "high": F.least(F.col("n"), low + width)})
    word = F.length(F.regexp_extract(F.substring("flat", F.col("high") + 1, F.col("n")), "^[^ ]*", 0))
    inside = F.substring("flat", F.col("high"), F.lit(1)) != " "
    out = out.withColumns({"low": F.length(F.regexp_extract(F.left("flat", F.col("low")), "^.* ", 0)), "high": F.when((F.col("high") < F.col("n")) & inside, F.col("high") + word).otherwise(F.col("high"))})
    body = F.regexp_replace(F.substring("flat", F.col("low") + 1, F.col("high") - F.col("low")), F.col("pattern"), F.lit("«$1»"))
    dots = lambda there: F.when(there, "…").otherwise("")
    head = F.concat(F.left("flat", F.lit(width)), dots(F.col("n") > width))
    shown = F.concat(dots(F.col("low") > 0), body, dots(F.col("high") < F.col("n")))
    return out.select(*keys, F.when(F.col("hit").isNull(), head).otherwise(shown).alias("snippet"))


def highlights(rows: DataFrame, keys: list[str], radius: int = RADIUS, limit: int = WINDOWS) -> DataFrame:
    """(keys, place, highlight) from (keys, text, terms): the first windows around words whose stem is one of ``terms``.

    Windows that touch are one. ``terms`` are index terms.
    """
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    hits = positions(rows, keys, "text", F.lit(T.TOKEN)).withColumn("term", T.stem(F.lower("word")))
    hits = hits.where(~T.is_stopword(F.lower("word"))).join(rows.select(*keys, F.explode(F.array_distinct("terms")).alias("term")), [*keys, "term"], "left_semi")
    order = W.partitionBy(*keys).orderBy("start")
    new = F.col("start") > F.lag("stop").over(order) + radius
    hits = hits.withColumn("place", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order)).where(F.col("place") <= limit)
    inside = W.partitionBy(*keys, "place").orderBy("start")
    hits = hits.withColumn("from", F.coalesce(F.lag("stop").over(inside), F.greatest(F.col("start") - radius, F.lit(0))))
    hits = hits.join(rows.select(*keys, "text"), keys)
    piece = F.concat(F.substring("text", F.col("from") + 1, F.col("start") - F.col("from")), F.lit("<em>"), F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")), F.lit("</em>"))
    windows = hits.select(*keys, "place", "start", "stop", "from", piece.alias("piece")).groupBy(*keys, "place").agg(
        F.array_sort(F.collect_list(F.struct("start", "piece")))["piece"].alias("pieces"), F.min("from").alias("low"), F.max("stop").alias("last"))
    out = windows.join(rows.select(*keys, "text"), keys).withColumn("high", F.least(F.col("last") + radius, F.length("text")))
    body = F.concat(F.array_join("pieces", ""), F.substring("text", F.col("last") + 1, F.col("high") - F.col("last")))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    dots = lambda there: F.when(there, "...").otherwise("")
    return out.select(*keys, F.col("place").cast("long").alias("place"), F.concat(dots(F.col("low") > 0), body, dots(F.col("high") < F.length("text"))).alias("highlight"))
