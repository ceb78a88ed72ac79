"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

Built from DataFrame functions alone. The JVM's regular expressions give the matches and the
pieces between them, whose lengths give the offsets (code points). The patterns are written with
possessive repeats and look-behind, which match the same spans without backtracking on long runs.

Bootstrapping: matches of the fixed patterns are seed instances. The words around an instance
induce lexical patterns: the two words before it, and the word before with the word after. Other
tokens of ``LEAST`` characters or more, with a digit, ``@``, ``_`` or ``-`` (identifiers, not words),
are candidate instances with patterns of their own. In a bipartite graph of patterns and instances, a
pattern's confidence is the smoothed mean score of its distinct instances, its support the sum of the
scores that reach ``ACCEPT``; a candidate's score is that of its best supported pattern. Scores go
back and forth ``ROUNDS`` times, starting from 1 for seeds and 0 for others, so candidates that are
accepted give support to patterns that no seed stands in, and these discover others. Candidates that
reach ``ACCEPT`` become spans of kind ``context``. All counts are over distinct instances, taken
before shuffles, and joins go from many rows to one. All bounds are parameters of ``extract``.

Null, empty texts: no spans. Null ids stay; repeated rows give a row each. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The kinds as listed, and patterns that match what the contract's patterns match.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates are tokens of these characters, LEAST or more, with one of those that mark identifiers.
TOKEN, MARKS, LEAST = "A-Za-z0-9@._%+/-", "0-9@_-", 4
#: Characters of context on each side.
AROUND = 48
ROUNDS = 4
#: Support that a pattern needs, its least confidence, and the score of an accepted candidate.
SUPPORT, CONFIDENT, ACCEPT = 3.0, 0.6, 0.6
BLOCK = 128


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def with_spans(df: DataFrame, pattern: str, name: str, gate: Column) -> DataFrame:
    """Adds ``name``: array of (start, end, found) of all matches; rows outside ``gate`` have none.

    Offsets are sums over blocks of lengths, so that very many matches don't take quadratic time.
    """
    none = F.lit(None)
    df = df.withColumn("__m", F.when(gate, matches(F.col("text"), pattern)))
    df = df.withColumn("__m", F.when(F.size("__m") > 0, F.col("__m")))
    df = df.withColumn("__p", F.when(F.col("__m").isNotNull(), F.transform(F.split("text", F.lit(pattern), -1), F.char_length)).otherwise(none))
    df = df.withColumn("__w", F.zip_with("__m", F.slice("__p", 1, F.size("__m")), lambda m, p: F.char_length(m) + p))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__w") - 1) / BLOCK).cast("int")), lambda b: total(F.slice("__w", b * BLOCK + 1, F.lit(BLOCK))))
    df = df.withColumn("__b", F.when(F.col("__m").isNotNull(), blocks))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = total(F.slice("__b", F.lit(1), block)) + total(F.slice("__w", block * BLOCK + 1, i - block * BLOCK)) + F.element_at("__p", i + 1)
        return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("found"))

    kind = "array<struct<start:int,end:int,found:string>>"
    return df.withColumn(name, F.coalesce(F.when(F.col("__m").isNotNull(), F.transform("__m", span)), F.array().cast(kind))).drop("__m", "__p", "__w", "__b")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts double."""

    def value(c: Column, i: Column) -> Column:
        n = c.cast("int") * (1 + i % 2)
        return n - F.when(n > 9, 9).otherwise(0)

    return total(F.transform(F.split(F.reverse(number), F.lit("")), lambda c, i: F.when(c != "", value(c, i)).otherwise(0))) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        # parts of more than nine digits do not fit a number, leading zeros aside
        return F.forall(F.split(s, F.lit(r"\.")), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^[0-9]{1,3}$") & (F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 9).cast("int") <= 255))
    if kind == "card":
        number = digits(s)
        return F.char_length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.char_length(digits(s)).between(8, 15)
    return F.lit(True)


def passes(kind: str):
    return lambda s: valid(kind, s["found"])


def gate(kind: str) -> Column:
    text = F.col("text")
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def written(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def candidates(least: int) -> str:
    return rf"(?<![{TOKEN}])(?=[{TOKEN}]{{{least}}})(?=[{TOKEN}]*[{MARKS}])[{TOKEN}]++"


def contexts(text: Column, spans: Column, kind: str, around: int = AROUND) -> Column:
    """(kind, start, end, instance, patterns) of each span."""

    def one(s: Column) -> Column:
        at = F.greatest(s["start"] - around, F.lit(0))
        before = F.lower(F.substring(text, at + 1, s["start"] - at))
        after = F.lower(F.substring(text, s["end"] + 1, F.lit(around)))
        two = F.regexp_extract(before, r"(?:^|\s)(\S+\s+\S+)\s*$", 1)
        last = F.regexp_extract(before, r"(?:^|\s)(\S+)\s*$", 1)
        follows = F.regexp_extract(after, r"^\S*\s+(\S+)", 1)
        patterns = F.array(
            F.when(two != "", F.concat(F.lit("two "), F.regexp_replace(two, r"\s+", " "))), F.when((last != "") & (follows != ""), F.concat_ws(" ", F.lit("around"), last, follows))
        )
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["found"]).alias("instance"), F.array_compact(patterns).alias("patterns"))

    return F.transform(spans, one)


def extract(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, around: int = AROUND,
    rounds: int = ROUNDS, support: float = SUPPORT, confident: float = CONFIDENT, accept: float = ACCEPT,
) -> DataFrame:
    """One row per document: counts, base_sha256, spans (base and found), n_context."""
    folder = common.shared_dir(docs.sparkSession)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        df = with_spans(df, pattern, kind, gate(kind))
        df = df.withColumn(kind, F.filter(kind, passes(kind)))
    df = with_spans(df, candidates(least), "other", F.col("text").rlike(f"[{MARKS}]"))
    bases = F.concat(*[F.col(k) for k in PATTERNS])
    df = df.withColumn("other", F.when(F.size("other") > 0, F.filter("other", lambda s: ~F.exists(bases, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(F.col("other")))
    df = df.select(
        "doc_id",
        F.xxhash64("text").alias("hash"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.concat(*[written(F.col(k), k) for k in PATTERNS]).alias("base"),
        F.concat(*[contexts(F.col("text"), F.col(k), k, around) for k in (*PATTERNS, "other")]).alias("occurrences"),
    )
    rows = common.stage(df, folder, "scanned")
    seen = rows.where(F.size("occurrences") > 0).select("doc_id", "hash", F.explode("occurrences").alias("o")).select("doc_id", "hash", "o.*")
    found = discovered(seen, folder, rounds, support, confident, accept)
    more = (
        seen.where("kind = 'other'").join(found, "instance", "left_semi").select("doc_id", "hash", "start", "end").distinct()
        .groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("more"))  # spans of one text
        .select(F.col("doc_id").alias("id2"), F.col("hash").alias("hash2"), "more")
    )
    out = rows.drop("occurrences").join(more, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")), "left")
    added = F.coalesce(written(F.col("more"), "context"), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in PATTERNS],
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat("base", added), ",").alias("spans"),
        F.size(added).cast("long").alias("n_context"),
    )


def discovered(seen: DataFrame, folder: str, rounds: int, support: float, confident: float, accept: float) -> DataFrame:
    """Accepted candidate instances with their score, by rounds over the pattern-instance graph."""
    edges = seen.select("instance", (F.col("kind") != "other").alias("seed"), F.explode("patterns").alias("pattern"))
    edges = common.stage(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), folder, "edges")
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("seed"))
    for k in range(rounds):
        scores = common.stage(scores, folder, f"scores-{k}")
        patterns = (
            edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern")
            .agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum(F.when(F.col("score") >= accept, F.col("score")).otherwise(0.0)).alias("support"))
            .where((F.col("support") >= support) & (F.col("confidence") >= confident))
        )
        best = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        scores = scores.join(best, "instance", "left").select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "seed")
    return common.stage(scores.where(~F.col("seed") & (F.col("score") >= accept)), folder, "found")
