"""Keyset pages, cursors and fuzzy name search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarity from which a name matches.
SIMILAR = 0.3


def page(df: DataFrame, key: str, uid: str, limit: int, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The next ``limit`` + 1 rows after a (key, uid) cursor; the extra one tells that more follow. A top-k, never an offset."""
    if after is not None:
        k, u = F.lit(after[0]), F.lit(after[1])
        beyond = F.col(key) < k if descending else F.col(key) > k
        df = df.where(beyond | (F.col(key) == k) & (F.col(uid) > u))
    order = F.col(key).desc() if descending else F.col(key).asc()
    return df.orderBy(order, F.col(uid).asc()).limit(limit + 1)


def with_more(rows: DataFrame, key: str, uid: str, limit: int, descending: bool = False) -> DataFrame:
    """A page without its extra row, and ``has_more``. At most limit + 1 rows reach the window."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col(key).desc() if descending else F.col(key).asc(), F.col(uid).asc())
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("has_more", n > limit).where(F.col("place") <= limit)


def cursor(*fields: str) -> Column:
    """URL-safe base64 of a JSON object."""
    return F.regexp_replace(F.translate(F.base64(F.to_json(F.struct(*fields)).cast("binary")), "+/", "-_"), "=+$", "")


def from_cursor(text: Column, schema: str) -> Column:
    """The object of a cursor; null where it is none."""
    raw = F.translate(text, "-_", "+/")
    padded = F.concat(raw, F.repeat(F.lit("="), F.pmod(F.lit(4) - F.pmod(F.length(raw), F.lit(4)), F.lit(4))))
    ok = padded.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.pmod(F.length(raw), F.lit(4)) != 1)
    return F.from_json(F.when(ok, F.unbase64(padded)).cast("string"), schema)


def letter_trigrams(text: Column) -> Column:
    """Distinct letter trigrams of each lower-cased word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Trigram Jaccard of two texts."""
    x, y = letter_trigrams(a), letter_trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def search(df: DataFrame, name: str, uid: str, term: str, limit: int, threshold: float = SIMILAR) -> DataFrame:
    """Best matching names first, ties by uid, as a page."""
    hits = df.withColumn("similarity", similarity(F.col(name), F.lit(term))).where(F.col("similarity") >= threshold)
    return page(hits, "similarity", uid, limit, descending=True)


def _word_similarity(term: str, name: str) -> float:
    """Largest share of the term's trigrams, over their union with it, in a run of the name's ordered trigrams."""
    def grams(t: str) -> list[str]:
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return [p[k : k + 3] for w in words for p in [f"  {w} "] for k in range(len(p) - 2)]

    want, has = set(grams(term)), grams(name)
    best = 0.0
    for i in range(len(has)):
        if has[i] not in want:
            continue
        seen: set[str] = set()
        for j in range(i, len(has)):
            seen.add(has[j])
            if has[j] in want:
                common = len(seen & want)
                best = max(best, common / (len(want) + len(seen) - common))
    return best


def may_hold(name: Column, term: str, threshold: float) -> Column:
    """Whether a name can score ``threshold``: no extent holds more of the term's trigrams than the name. Native, so few names reach Python."""
    want = letter_trigrams(F.lit(term))
    share = F.size(F.array_intersect(letter_trigrams(name), want)) / F.size(want)
    return ~name.rlike(r"^[\x00-\x7F]*$") | (share >= threshold)


def best_extents(df: DataFrame, name: str, uid: str, term: str, limit: int, threshold: float = SIMILAR) -> DataFrame:
    """Names by how well the term matches their best extent, as a page."""
    some = df.where(may_hold(F.col(name), term, threshold)) if term.isascii() and term.strip() else df
    scored = some.withColumn("score", F.round(word_similarity(term)(name), 6))
    return page(scored.where(F.col("score") >= threshold), "score", uid, limit, descending=True)


def word_similarity(term: str):
    """Arrow UDF of a column: how well the term matches the best extent of a name."""
    @F.pandas_udf("double")
    def score(names: pd.Series) -> pd.Series:
        return names.map(lambda n: _word_similarity(term, n or ""))

    return score
