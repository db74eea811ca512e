"""Column functions over names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the letters that may lead a type's name.
PREFIXES = ("A", "U", "F", "E", "S", "I")


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_lower(path: Column) -> Column:
    """Lower case, with slashes; null stays null."""
    return F.lower(slashes(path))


def basename_lower(path: Column) -> Column:
    """Lower-case file name without its last extension; a name that begins with its only dot stays whole."""
    return F.lower(F.regexp_replace(F.element_at(F.split(slashes(path), "/"), -1), r"^(.+)\.[^.]*$", "$1"))


def derive_module(relative: Column, project: Column) -> Column:
    """The project and the folders of a relative path, joined by dots; a file at the top gives the project."""
    parts = F.split(slashes(relative), "/")
    return F.concat_ws(".", project, F.slice(parts, 1, F.size(parts) - 1))


def strip_loose(name: Column) -> Column:
    """Takes one leading prefix letter off, whatever follows it."""
    return F.regexp_replace(name, "^[UAFESI]", "")


def strip_strict(name: Column) -> Column:
    """Takes a leading prefix letter off if an upper-case letter follows."""
    return F.regexp_replace(name, "^[UAFESI](?=[A-Z])", "")


def prefix_variants(name: str) -> list[str]:
    """Other spellings under which a type may be declared: with each prefix, and with its own prefix exchanged."""
    variants = [p + name for p in PREFIXES]
    if name[:1] in PREFIXES:
        variants += [p + name[1:] for p in (*PREFIXES, "")]
    return sorted({v for v in variants if v != name})


def split_camel(name: Column) -> Column:
    """The lower-case words of a camel-case name without its prefix; digits and underscores do not split."""
    apart = F.regexp_replace(strip_strict(name), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    apart = F.regexp_replace(apart, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"\s+"), lambda w: w != "")


def camel_words(name: str) -> list[str]:
    """The same for a Python string, for the words of a query."""
    import re

    apart = re.sub("^[UAFESI](?=[A-Z])", "", name)
    apart = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", apart)
    return re.sub("([a-z])([A-Z])", r"\1 \2", apart).lower().split()


def accessor_core(lowered: Column) -> Column:
    """A lower-case name without a leading get, set, is, has, can or should."""
    return F.regexp_replace(lowered, "^(get|set|is|has|can|should)", "")


def compound_share(words: Column, query_words: list[str]) -> Column:
    """Share of the query's words that begin, or are begun by, a word of ``words``."""
    query = F.array(*[F.lit(w) for w in query_words])
    hit = F.filter(query, lambda q: F.exists(words, lambda c: c.startswith(q) | q.startswith(c)))
    return F.size(hit) / F.lit(len(query_words))


def equal_share(words: Column, query_words: list[str]) -> Column:
    """Share of the query's words that are words of ``words``."""
    query = F.array(*[F.lit(w) for w in query_words])
    return F.size(F.filter(query, lambda q: F.array_contains(words, q))) / F.lit(len(query_words))


def clean_path(path: Column, project: Column, prefix: Column) -> Column:
    """The path under its project: the project's common prefix, if the path has it, gives way to the project's name."""
    plain = slashes(path)
    return F.when(prefix.isNotNull() & plain.startswith(prefix), F.concat(project, F.lit("/"), F.substr(plain, F.length(prefix) + 1))).otherwise(plain)


def asset_mirror_path(content_path: Column) -> Column:
    """Where an asset's text row lies in the mirror of texts."""
    return F.concat(F.regexp_replace(content_path, "^/Game/", "_assets/"), F.lit(".uasset"))


def mirror_content_path(mirror: Column) -> Column:
    """The inverse of ``asset_mirror_path``."""
    return F.regexp_replace(F.regexp_replace(mirror, "^_assets/", "/Game/"), r"\.uasset$", "")


def language_of(path: Column) -> Column:
    """A language from the extension of a path; ``content`` for assets, else null."""
    low = F.lower(path)
    return (
        F.when(low.endswith(".as"), "angelscript")
        .when(low.rlike(r"\.(h|hpp|hxx|c|cc|cpp|cxx|inl)$"), "cpp")
        .when(low.rlike(r"\.(ini|cfg|conf)$"), "config")
        .when(low.rlike(r"\.(uasset|umap)$"), "content")
    )


def path_depth_prefix(path: Column, separator: str, depth: int) -> Column:
    """The first ``depth`` parts of a path, joined again."""
    pattern = r"\." if separator == "." else separator
    lead = F.lit("" if separator == "." else separator)
    parts = F.filter(F.split(path, pattern), lambda p: p != "")
    return F.concat(lead, F.array_join(F.slice(parts, 1, depth), separator))


def under(path: Column, parent: str, separator: str = ".") -> Column:
    """Whether a path is ``parent`` or lies below it."""
    return (path == parent) | path.startswith(parent + separator)
