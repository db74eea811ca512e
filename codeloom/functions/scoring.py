"""Column functions that score symbols, files, assets and lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import accessor_core, camel_words, compound_share, equal_share, slashes, split_camel, strip_loose
from codeloom.functions.trigrams import jaccard, trigram_list, trigrams

# What a specifier adds to a member's score, and the most they add together.
SPECIFIERS = {
    "BlueprintCallable": 0.05,
    "BlueprintPure": 0.05,
    "BlueprintReadWrite": 0.04,
    "BlueprintReadOnly": 0.04,
    "BlueprintImplementableEvent": 0.04,
    "BlueprintNativeEvent": 0.04,
    "EditAnywhere": 0.03,
    "EditDefaultsOnly": 0.02,
    "VisibleAnywhere": 0.02,
    "Replicated": 0.02,
}
SPECIFIER_LIMIT = 0.08
# What a kind adds to a type's score.
KINDS = {"class": 0.04, "struct": 0.03, "interface": 0.03, "enum": 0.02, "delegate": 0.01, "event": 0.01}
# Lines that define something.
DEFINITIONS = (
    r"^\s*(class|struct|enum)\s+\w+",
    r"^\s*UCLASS\s*\(",
    r"^\s*USTRUCT\s*\(",
    r"^\s*UENUM\s*\(",
    r"^\s*UFUNCTION\s*\(",
    r"^\s*UPROPERTY\s*\(",
    r"^\s*UINTERFACE\s*\(",
    r"^\s*(virtual\s+)?(void|int|float|bool|double|auto|const\s+\w+&?|[\w:]+\*?)\s+\w+::\w+\s*\(",
    r"^\s*(void|int|float|bool|double|auto|FString|FName|FVector|TArray|TMap)\s+\w+\s*\(",
    r"^\s*#define\s+\w+",
    r"^\s*(mixin\s+)?class\s+\w+",
    r"^\s*(event\s+|delegate\s+)?\w+\s+\w+\s*\(",
)
# Points by age in days.
RECENCY = ((1, 10), (7, 8), (30, 5), (90, 3))
DAY_MS = 86_400_000
HEADER = r"(?i)\.(h|hpp|hxx)$"


def specifier_boost(specifiers: Column) -> Column:
    parts = [F.when(specifiers.contains(s), F.lit(v)).otherwise(0.0) for s, v in SPECIFIERS.items()]
    return F.least(F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0.0)), F.lit(SPECIFIER_LIMIT))


def kind_weight(kind: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), KINDS.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def structural_score(parent: Column, path: Column) -> Column:
    """How prominent a declaration's place is: a parent, a header, a runtime or public folder, a short path. Rounded to
    six digits so that sums do not depend on their order."""
    plain = F.coalesce(slashes(path), F.lit(""))
    score = (
        F.when(F.coalesce(parent, F.lit("")) != "", 10.0).otherwise(0.0)
        + F.when(F.coalesce(path, F.lit("")).endswith(".h"), 5.0).otherwise(0.0)
        + F.when(plain.contains("/Runtime/"), 2.0).when(plain.contains("/Developer/"), 1.0).otherwise(0.0)
        + F.when(plain.contains("/Public/") | plain.contains("/Classes/"), 1.5).when(plain.contains("/Private/"), 0.5).otherwise(0.0)
        + F.when(F.coalesce(path, F.lit("")) != "", F.greatest(F.lit(0.0), F.lit(0.5) - F.length(plain) * 0.004)).otherwise(0.0)
    )
    return F.round(score, 6)


def recency(mtime: Column, now_ms: int) -> Column:
    """Points by age at ``now_ms``; none without a time."""
    age = (F.lit(now_ms) - mtime) / DAY_MS
    ladder = F.when(mtime.isNull() | (mtime == 0), 0)
    for days, points in RECENCY:
        ladder = ladder.when(age < days, points)
    return ladder.otherwise(1)


def is_definition(line: Column) -> Column:
    """Whether a line of source defines something; comment lines and null do not."""
    bare = F.ltrim(line)
    comment = bare.startswith("//") | bare.startswith("/*") | bare.startswith("*")
    return F.coalesce(~comment & line.rlike("|".join(f"(?:{p})" for p in DEFINITIONS)), F.lit(False))


def _ladder(rungs: list[tuple[Column, Column | float, str]], otherwise: Column | float) -> tuple[Column, Column]:
    """(score, reason) of the first rung that fits."""
    score, reason = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), "")
    for condition, points, label in rungs:
        score, reason = score.when(condition, points), reason.when(condition, label)
    return score.otherwise(otherwise), reason.otherwise("trigram")


def _changed(frame: DataFrame, steps: list[tuple[Column, Column, Column]]) -> DataFrame:
    """``score`` and ``match_reason`` after the first step (condition, score, reason) that fits."""
    score, reason = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), "")
    for condition, points, label in steps:
        score, reason = score.when(condition, points), reason.when(condition, label)
    return frame.withColumns({"score": score.otherwise(F.col("score")), "match_reason": reason.otherwise(F.col("match_reason"))})


def score_types(frame: DataFrame, query: str) -> DataFrame:
    """``frame`` (``name``, ``kind``, ``depth``) with ``score`` and ``match_reason`` for a fuzzy query: the first rung that
    fits, then the getter-setter form, then what kind and depth add. Rounded to six digits. Each stage is a column of
    its own, so that no expression is repeated inside another."""
    q, qs = query.lower(), (query[1:] if query[:1] in "UAFESI" and query else query).lower()
    words = camel_words(query)
    c, cs, share, core = (F.col(x) for x in ("_c", "_cs", "_share", "_core"))
    own = {"_c": F.lower("name"), "_cs": F.lower(strip_loose(F.col("name"))), "_core": accessor_core(F.lower("name"))}
    rungs = [
        (c == q, 1.0, "exact"),
        (cs == qs, 0.98, "exact-stripped"),
        (cs == q, 0.97, "exact-stripped"),
        (c.startswith(q), 0.95, "prefix"),
        (cs.startswith(qs), 0.93, "prefix-stripped"),
        (cs.startswith(q), 0.92, "prefix-stripped"),
        (c.contains(q), 0.85, "substring"),
        (cs.contains(qs), 0.80, "substring-stripped"),
    ]
    frame = frame.withColumns(own)
    if len(words) >= 2:
        frame = frame.withColumn("_words", split_camel(F.col("name")))
        frame = frame.withColumn("_share", F.greatest(equal_share(F.col("_words"), words), compound_share(F.col("_words"), words)))
        rungs += [(share >= 1, 0.70, "word-match-all"), (share >= 0.66, 0.50, "word-match-most"), (share >= 0.5, 0.40, "word-match-some"), (share > 0, 0.30, "word-match-few")]
    score, reason = _ladder(rungs, 0.30)
    frame = frame.withColumns({"score": score, "match_reason": reason})
    bare = re.sub("^(get|set|is|has|can|should)", "", q)
    if bare and bare != q:
        low, now, why = F.col("score") < 0.85, F.col("score"), F.col("match_reason")
        part = F.when(why == "trigram", "getter-setter-partial").otherwise(why)
        frame = _changed(frame, [(low & (core == bare), F.greatest(now, F.lit(0.88)), F.lit("getter-setter")), (low & core.contains(bare), F.greatest(now, F.lit(0.75)), part)])
    bonus = kind_weight(F.col("kind")) + F.when(F.col("depth").isNotNull(), F.greatest(F.lit(0.0), F.lit(0.03) - F.col("depth") * 0.005)).otherwise(0.0)
    return frame.withColumn("score", F.round(F.col("score") + bonus, 6)).drop(*own, "_words", "_share")


def score_members(frame: DataFrame, query: str) -> DataFrame:
    """``frame`` (``name``, ``specifiers``) with ``score`` and ``match_reason`` for a fuzzy query, and what the specifiers
    add. Rounded to six digits."""
    q, words, c = query.lower(), camel_words(query), F.col("_c")
    tail = F.round(jaccard(trigrams(F.col("name")), F.array(*[F.lit(t) for t in trigram_list(query)])) * 0.7, 9) if len(q) >= 3 else F.lit(0.0)
    frame = frame.withColumns({"_c": F.lower("name"), "_tail": tail})
    score, reason = _ladder([(c == q, 1.0, "exact"), (c.startswith(q), 0.95, "prefix"), (c.contains(q), 0.85, "substring"), (F.lit(q).contains(c) & (c != ""), 0.8, "reverse-substring")], F.col("_tail"))
    frame = frame.withColumns({"score": score, "match_reason": reason})
    if len(words) >= 2:
        frame = frame.withColumn("_share", compound_share(split_camel(F.col("name")), words))
        now, share = F.col("score"), F.col("_share")
        frame = _changed(frame, [((now < 0.7) & (share >= 1), F.lit(0.7), F.lit("word-match-all")), ((now < 0.5) & (share >= 0.66), F.lit(0.5), F.lit("word-match-most"))])
    return frame.withColumn("score", F.round(F.col("score") + specifier_boost(F.col("specifiers")), 6)).drop("_c", "_tail", "_share")


def file_match(path: Column, basename: Column, query: str) -> Column:
    """Score of a file for a name: how the name fits the base name, then small boosts for its place; null if it does not."""
    q, low = query.lower(), F.lower(slashes(path))
    base = F.when(basename == q, 1.0).when(basename.startswith(q), 0.85).when(basename.contains(q), 0.7)
    place = (
        F.when(low.endswith(".h"), 0.01).otherwise(0.0)
        + F.when(low.contains("/runtime/"), 0.004).when(low.contains("/developer/"), 0.002).otherwise(0.0)
        + F.when(low.contains("/public/") | low.contains("/classes/"), 0.003).when(low.contains("/private/"), 0.001).otherwise(0.0)
    )
    return F.round(base + place, 6)


def asset_match(name: Column, query: str) -> Column:
    """Score of an asset's name; null if it does not contain the query."""
    q, c = query.lower(), F.lower(name)
    return F.when(c == q, 1.0).when(c.startswith(q), 0.95).when(c.contains(q), 0.85)


def plain_match(name: Column, query: str) -> Column:
    """The older likeness of a name: rungs as for types, with less for a match that begins later, then the words of the
    query, then half the likeness by edit distance; null where that is too small. Rounded to six digits."""
    q, qs = query.lower(), (query[1:] if query[:1] in "UAFES" and query else query).lower()
    c, cs = F.lower(name), F.lower(F.regexp_replace(name, "^[UAFES]", ""))
    later = lambda text, part, top: F.lit(top) - (F.instr(text, part) - 1) / F.length(text) * 0.15
    words = q.split()
    hit = lambda w: F.when(cs.startswith(w), 0.6).when(cs.contains(w), 0.4).otherwise(0.0) / len(words)
    by_word = reduce(lambda a, b: a + b, [hit(w) for w in words], F.lit(0.0))
    alike = F.lit(1.0) - F.levenshtein(cs, F.lit(qs)) / F.greatest(F.length(cs), F.lit(len(qs)))
    score = (
        F.when(c == q, 1.0).when(cs == qs, 0.98).when(c.startswith(q), 0.95).when(cs.startswith(qs), 0.93).when(cs.startswith(q), 0.92)
        .when(c.contains(q), later(c, q, 0.85)).when(cs.contains(qs), later(cs, qs, 0.80)).when(cs.contains(q), later(cs, q, 0.75))
        .when(by_word > 0.3, by_word).when(alike > (0.25 if len(query) < 5 else 0.35), alike * 0.5)
    )
    return F.round(score, 6)


def near_jaccard(matched: Column, length: Column, query_grams: int) -> Column:
    """Likeness by counts alone: shared trigrams over the larger of the query's and what a name of that length may have."""
    return F.round(matched / F.greatest(F.lit(query_grams), F.lit(1), length - 2) * 0.7, 6)
