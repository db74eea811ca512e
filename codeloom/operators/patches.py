"""Applying a feed of inserts, updates and deletes by composing patches.

A patch is a function on the state of one path. Two patches compose into one, and composition is associative, so the
changes of a path may be composed in chunks of its order, the chunks in pairs, and so on, in any grouping; only the
composed patch of each path is applied to the base table. A patch is kept as three marks, each the latest of its kind:
``last`` (the last change and whether it leaves the path present), ``wrote`` (the last change with an mtime) and
``cleared`` (the last unlink, which forgets every mtime before it). The later mark wins, whatever order they meet in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Changes of one path that are composed in one chunk at the most (a power of two of event numbers within a session).
CHUNK_BITS = 10


def same_path(path) -> F.Column:
    """The form in which two spellings of a path are equal: lower case, slashes."""
    return F.lower(F.translate(path, "\\", "/"))


def to_patches(changes: DataFrame) -> DataFrame:
    """Each delivery as a patch of its path, with the chunk of the order it falls in.

    A null path names nothing and is left out. A null or unknown ``op`` leaves the path as an add would (the watcher saw
    it); a null session or event number sorts before all others. Of repeated deliveries of one change it does not matter
    which is taken; should they differ, an unlink wins, then the larger mtime.
    """
    order = [F.col("session_no").alias("session_no"), F.col("event_seq").alias("event_seq")]
    gone = F.coalesce(F.lower(F.trim("op")) == "unlink", F.lit(False))
    return changes.where(F.col("path").isNotNull()).select(
        same_path(F.col("path")).alias("path_lower"),
        F.coalesce(F.col("session_no").cast("long"), F.lit(-1)).alias("chunk_hi"),
        F.shiftright(F.coalesce(F.col("event_seq"), F.lit(-1)), CHUNK_BITS).alias("chunk_lo"),
        F.struct(*order, gone.alias("gone"), "project").alias("last"),
        F.when(~gone & F.col("mtime").isNotNull(), F.struct(*order, "mtime")).alias("wrote"),
        F.when(gone, F.struct(*order)).alias("cleared"),
    )


def compose(patches: DataFrame, *keys: str) -> DataFrame:
    """One patch for each value of ``keys``: the composition of all its patches, in their order."""
    return patches.groupBy(*keys).agg(F.max("last").alias("last"), F.max("wrote").alias("wrote"), F.max("cleared").alias("cleared"))


def composed(changes: DataFrame) -> DataFrame:
    """The composed patch of every path: first within chunks of the order (which splits a path that holds a large share
    of the feed over tasks), then across the chunks of each path."""
    return compose(compose(to_patches(changes), "path_lower", "chunk_hi", "chunk_lo"), "path_lower")


def apply_patches(patches: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The state after the patches: ``path_lower``, ``present``, ``mtime``, ``project``, ``session_no``, ``event_seq``.

    ``base`` (``path``, ``mtime``, ``project``) gives the state before; a path without changes keeps it (with null
    change numbers), a path without a base row starts absent. The mtime is that of the last change that brought one
    since the last unlink, else the base's unless an unlink came since. Base paths equal in ``same_path`` are one; the
    largest mtime is taken. Without base, only paths of the feed come out.
    """
    order = lambda mark: F.struct(F.col(f"{mark}.session_no"), F.col(f"{mark}.event_seq"))
    cleared = F.col("cleared").isNotNull()
    lives = F.col("wrote").isNotNull() & (~cleared | (order("wrote") > F.col("cleared")))
    state = patches.select(
        "path_lower",
        (~F.col("last.gone")).alias("present"),
        F.when(lives, F.col("wrote.mtime")).alias("mtime"),
        cleared.alias("was_cleared"),
        F.col("last.project").alias("project"),
        F.col("last.session_no").alias("session_no"),
        F.col("last.event_seq").alias("event_seq"),
    )
    if base is None:
        return state.drop("was_cleared")
    before = base.where(F.col("path").isNotNull()).groupBy(same_path(F.col("path")).alias("path_lower")).agg(F.max(F.struct("mtime", "project")).alias("b"))
    both = state.join(before, "path_lower", "full_outer")
    return both.select(
        "path_lower",
        F.coalesce("present", F.lit(True)).alias("present"),
        F.coalesce(F.col("mtime"), F.when(~F.coalesce(F.col("was_cleared"), F.lit(False)), F.col("b.mtime"))).alias("mtime"),
        F.coalesce("project", F.col("b.project")).alias("project"),
        "session_no",
        "event_seq",
    )


def present_paths(changes: DataFrame) -> DataFrame:
    """The paths of the feed that are present after all their changes, each with its last change."""
    return apply_patches(composed(changes)).where("present").select("path_lower", "session_no", "event_seq")
