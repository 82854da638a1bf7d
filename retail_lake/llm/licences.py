"""Licences of files by TF-IDF cosine to templates, and by inheritance from directories.

Only DataFrame functions. The statements of a file are its lines, its paragraphs (wrapped lines of
a header), its blocks (a comment with empty comment lines in it) and, of a licence file, the whole
text. A word counts once per statement, by its inverse frequency over the licences known; words
that no template has weigh most. So the weights are fixed, and a statement is its template words
and the number of its other words. Statements meet templates through rare words: without one of
the heaviest words of a template, which hold all but LEAST of its length, none can be reached.
A file without a licence of its own takes that of the licence file in the nearest directory above.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import lower_ascii
from retail_lake.llm.licence_texts import TEMPLATES
from retail_lake.session import freeze

#: Least cosine that counts.
LEAST = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"
#: Reserves rights and grants none; counts where a file states nothing else.
RESERVED = "Proprietary"
_WORD = "([a-z0-9]+)"
PARAGRAPH, BLOCK = "\\n[^A-Za-z0-9\\n]*\\n", "\\n[ \\t\\r]*\\n"


def _wording(text: str) -> list[str]:
    return sorted(set(re.findall(_WORD, text.lower())))


def weights() -> tuple[dict[str, float], float]:
    """Squared weight of every template word, and of a word that no template has."""
    having = Counter(term for _, term in {(name, t) for name, text in TEMPLATES for t in _wording(text)})
    known = len({name for name, _ in TEMPLATES})
    return {t: (math.log((known + 1) / (n + 1)) + 1) ** 2 for t, n in having.items()}, (math.log(known + 1) + 1) ** 2


def _strings(values: list[str]) -> Column:
    return F.lit(sorted(values))


def _heavy(terms: list[str], weight: dict[str, float]) -> list[str]:
    """The heaviest words; what is left of the template is shorter than LEAST of it."""
    left = sum(weight[t] for t in terms)
    bound, out = left * LEAST**2, []
    for term in sorted(terms, key=lambda t: (-weight[t], t)):
        if left < bound * (1 - 1e-9):
            break
        out.append(term)
        left -= weight[term]
    return out


def statements(files: DataFrame) -> DataFrame:
    """(path, digest, sid, terms, length): statements that can reach a template; length is squared."""
    weight, other = weights()
    heavy = {t for _, text in TEMPLATES for t in _heavy(_wording(text), weight)}
    text = lower_ascii(F.col("text"))
    whole = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    parts = [F.split(text, pattern) for pattern in ("\n", PARAGRAPH, BLOCK)]
    cut = F.array_distinct(F.concat(*parts, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))
    words = files.select("path", "digest", F.explode(cut).alias("statement")).select(
        "path", "digest", F.array_distinct(F.regexp_extract_all("statement", F.lit(_WORD), F.lit(1))).alias("words")
    )
    met = words.filter(F.arrays_overlap("words", _strings(list(heavy)))).select(
        "path", "digest", F.array_sort(F.array_intersect("words", _strings(list(weight)))).alias("terms"), F.size("words").alias("n")
    )
    rest = (F.col("n") - F.size("terms")) * F.lit(other)
    met = met.filter(F.size("terms") * max(weight.values()) * (1 - LEAST**2) >= rest * LEAST**2)
    length = rest
    for value in sorted(set(weight.values())):
        alike = _strings([t for t, w in weight.items() if w == value])
        length = length + F.size(F.array_intersect("terms", alike)) * F.lit(value)
    sid = F.unhex(F.md5(F.concat_ws(" ", "n", F.concat_ws(" ", "terms"))))
    return met.select("path", "digest", sid.alias("sid"), "terms", length.alias("length")).distinct()


def match(stated: DataFrame) -> DataFrame:
    """(sid, licence, score, weight) of ``statements`` that reach LEAST, each different one once.

    Equal scores go to the first template of the list. Scores are rounded to six places. ``weight``
    is the length of the template times the score: how much wording speaks for the licence.
    """
    spark = stated.sparkSession
    weight, _ = weights()
    cut = [(i, name, _wording(text)) for i, (name, text) in enumerate(TEMPLATES)]
    lengths = [sum(weight[t] for t in terms) for _, _, terms in cut]
    # three tables of the fixed wordings
    gates = [(t, i, n) for (i, _, terms), n in zip(cut, lengths, strict=True) for t in _heavy(terms, weight)]
    gate = spark.createDataFrame(gates, "term string, number int, t_length double")
    held = spark.createDataFrame([(i, name, terms) for i, name, terms in cut], "number int, licence string, t_terms array<string>")
    worth = spark.createDataFrame(sorted(weight.items()), "term string, w double")

    each = stated.select("sid", "terms", "length").dropDuplicates(["sid"])
    heavy = _strings(sorted({t for t, _, _ in gates}))
    near = F.col("length").between(F.col("t_length") * (LEAST**2 - 1e-6), F.col("t_length") / (LEAST**2 - 1e-6))
    pairs = (
        each.select("sid", "terms", "length", F.explode(F.array_intersect("terms", heavy)).alias("term"))
        .join(gate, "term")
        .filter(near)  # what both have is at most the shorter one, so the ratio of lengths bounds the cosine
        .dropDuplicates(["sid", "number"])
        .join(held, "number")
    )
    dots = (
        pairs.select("sid", "number", "licence", "length", "t_length", F.explode(F.array_intersect("terms", "t_terms")).alias("term"))
        .join(worth, "term")
        .groupBy("sid", "number", "licence", "length", "t_length")
        .agg(F.sum("w").alias("dot"))
    )
    score = F.round(F.col("dot") / F.sqrt(F.col("length") * F.col("t_length")), 6)
    scored = dots.withColumn("score", score).filter(F.col("score") >= LEAST)
    speaks = F.round(F.col("score") * F.sqrt("t_length"), 6).alias("weight")
    best = scored.groupBy("sid").agg(F.max_by(F.struct("licence", "score", speaks), F.struct("score", -F.col("number"))).alias("b"))
    return best.select("sid", "b.*")


def licences(files: DataFrame, path: str, text: str, key: str) -> DataFrame:
    """One row per file row: the key, path, own_licence, own_score, licence, from_dir.

    ``from_dir`` is the directory a licence is inherited from, null for a licence of one's own.
    Of several statements the one with most wording counts, a mere reservation of rights last, then
    the higher score, then the licence last in the alphabet; of several licence files in a
    directory the first path. Null and empty texts state nothing, a
    null path inherits nothing, repeated rows give equal rows; empty tables give none.
    """
    base = files.select(F.col(key).alias("file_key"), F.col(path).cast("string").alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = base.withColumn("digest", F.md5("text"))
    stated = freeze(statements(keyed))
    own = (
        stated.select("path", "digest", "sid")
        .join(match(stated), "sid")
        .groupBy("path", "digest")
        .agg(F.max_by(F.struct("licence", "score"), F.struct(F.col("licence") != RESERVED, "weight", "score", "licence")).alias("own"))
        .select(F.col("path").alias("own_path"), F.col("digest").alias("own_digest"), "own.*")
    )
    parts = F.split("own_path", "/")
    given = (
        own.filter(F.col("own_path").rlike(LICENCE_FILE))
        .select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("given_dir"), "own_path", "licence")
        .groupBy("given_dir")
        .agg(F.min_by("licence", F.struct("own_path", "licence")).alias("given"))
    )
    joined = keyed.select("file_key", "path", "digest").join(
        own, F.col("path").eqNullSafe(F.col("own_path")) & (F.col("digest") == F.col("own_digest")), "left"
    ).select("file_key", "path", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    # the directories above the files: distinct ones first, so files share the search
    parts = F.split("path", "/")
    dirs = keyed.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir")).filter("dir is not null").distinct()
    above = F.split("dir", "/")
    steps = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(above)))).alias("depth")).select(
        "dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/")).alias("given_dir")
    )
    nearest = steps.join(given, "given_dir").groupBy("dir").agg(F.max_by(F.struct("given_dir", "given"), "depth").alias("near"))
    mine = joined.withColumn("dir", F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/"))
    inherits = F.col("own_licence").isNull()
    return mine.join(nearest, "dir", "left").select(
        F.col("file_key").alias(key),
        "path",
        "own_licence",
        "own_score",
        F.coalesce("own_licence", "near.given").alias("licence"),
        F.when(inherits, F.col("near.given_dir")).alias("from_dir"),
    )
