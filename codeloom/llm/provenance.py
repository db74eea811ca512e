"""Which source files were written by hand, and which by a tool, a minifier, a third party or a data export.

Each text is lexed and emitted again in one canonical layout: a line per statement and brace, the file's own most frequent
gap between every two kinds of tokens, its most frequent indentation at every depth. The comparison of the two layouts
tells minified files (the canonical form has many times the lines), perfectly uniform ones (the two are the same) and data
blobs (literals make up nearly all of the code). How uniform people write is learned from each project's own files:
perfection names a tool only where it is
unusual there, and only as far as the files that tools are known to have written are perfect more often. Notices in comments, paths, equal texts and identifier prefixes
support what layout cannot tell; ``evidence`` says which of these a file's origin rests on.

Lexing looks up each distinct token once per process; the figures of files are sums over token numbers in arrays.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import heavy_light_join
from codeloom.session import Scratch

#: Canonical lines per original line, and characters per original line, from which a file counts as minified.
MIN_EXPANSION = 6.0
MIN_LINE = 160.0
#: Share of the code's characters in literals from which a file counts as data, and the least characters of code.
MIN_LITERAL = 0.8
MIN_CODE = 200
#: Share of a file's gaps and indentations as in the canonical layout from which it is perfectly uniform, and the least
#: number of them.
PERFECT, MIN_GAPS = 0.999, 100
#: Perfection names a tool where no more than this share of a project's files have it, and the files known to be a tool's
#: have it so many times as often.
UNUSUAL, TELLING = 0.05, 20
#: An identifier prefix is third party if at least so many different texts with it are known to be, at least this share of
#: its files, and at least so many times the share of such files among all.
PREFIX_TEXTS, PREFIX_SHARE, PREFIX_RATIO = 3, 0.8, 2.0

#: A prefix or a text on more than this share of all files is joined by broadcast; at most its inverse are.
HEAVY_SHARE = 0.002

# Folders that hold other people's code, by the names in general use.
THIRD_PARTY_FOLDERS = (
    "3rdparty", "3rd_party", "3rd-party", "thirdparty", "third_party", "third-party", "vendor", "vendored", "extern", "externals",
    "external", "deps", "contrib", "extlibs", "ext_libs",
)
# Package managers whose folders are named for them.
PACKAGE_FOLDER = "^(bower|composer|jspm|node|npm|yarn)_[a-z]+$"
# Folders that tools write.
OUTPUT_FOLDERS = ("generated", "autogen", "auto_generated", "autogenerated", "intermediate", "gensrc", "generatedfiles")
# What tools, minifiers and exporters put in a file's name.
GENERATED_NAME = r"(\.generated\.|\.gen\.|\.pb\.|\.g\.|\.designer\.|_autogen\.|_generated\.|^uic_|^ui_[^.]*\.h$|^moc_|^qrc_|_pb2\.)"
MINIFIED_NAME = r"([.-]min\.|\.pack\.|\.packed\.|\.bundle\.|\.chunk\.)"
BLOB_NAME = r"(^embedded_|blob\.|_png\.|_jpg\.|_bin\.|_ttf\.|fontatlas\.)"

# Notices of tools. Each needs the tool's claim itself, not merely a word such as "generated".
TOOL_NOTICE = re.compile(
    r"<auto-?generated"
    r"|\bauto-?(matically )?generated (file|code|by|from)"
    r"|\b(code|file|source) (was |is )?(auto-?|automatically )?generated by\b"
    r"|^\W*(automatically |auto-?)?generated (by|from|with) \S+"
    r"|@generated by\b|^\W*@generated\W*$"
    r"|\bthis file (was|is|has been) (auto-?|automatically )?(produced|generated|created|written|made) (by|from|with)\b"
    r"|\b(your|manual|any|all) (changes|edits|modifications)( to this file| made here)? (will|would) be (lost|discarded|overwritten)"
    r"|\bchanges are overwritten\b"
    r"|\bmachine[- ](written|generated|made)\b"
    r"|\bautomatisch (erzeugt|generiert|erstellt)\b|\bgenerado automáticamente\b"
    r"|\bgenerated from \S+,? do not (edit|modify|change)"
    r"|^\W*(generated|produced|exported|emitted|created|built|compiled|written|output) (by|from|of|with) .{1,80}?(\bv?\d+(\.\d+)+|\b[\w-]+/[\w./-]+\.\w{2,8}\b)"
    r"|\bdo not edit\W*$(?<=generated file - do not edit)",
    re.IGNORECASE | re.MULTILINE,
)
# Notices of third-party licences and of imports from upstream.
LICENCE_NOTICE = re.compile(
    r"\bredistribution\w* (and use )?in source\b"
    r"|\bpermission (is hereby granted|to use, copy)"
    r"|\bprovided (\"?as[- ]is\"?|'as is')"
    r"|\blicen[sc]ed under (the )?(terms|apache|mit|bsd|gpl|lgpl|mozilla|zlib|boost)"
    r"|\bsee (the )?(licen[sc]e|copying)(\.\w+)? (of|in|from|file)\b"
    r"|\bspdx-license-identifier\b"
    r"|\bupstream (version|distribution|release|repository)\b"
    r"|\bimported from \S+"
    r"|\bsingle[- ]header (edition|library|version)\b"
    r"|\bcopyright \(c\).{0,80}\bauthors\b"
    r"|\b(gnu|mozilla) (general |lesser )?public licen[sc]e\b|\bapache licen[sc]e\b|\bmit licen[sc]e\b",
    re.IGNORECASE,
)

_LEX = re.compile(
    r"[^\S\n]*(?:\n"
    r"|//[^\n]*|/\*.*?(?:\*/|\Z)"
    r"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?"
    r"|\b(?:0[xX][0-9a-fA-F]+|\d[\w.]*)"
    r"|[^\W\d]\w*"
    r"|[^\w\s])",
    re.DOTALL,
)
_PREFIX = re.compile(r"([a-z][a-z0-9]{1,11})_[a-z0-9_]+\Z")
FIELDS = "h long, size int, tool boolean, licence boolean, minified boolean, blob boolean, uniform double, gaps long, expansion double, literal double, prefix string"

#: Characters of texts that are worked on at once, tokens that a process remembers, and the longest ones it does.
AT_ONCE, REMEMBERED, SHORT = 1_000_000, 500_000, 48
#: Kinds of tokens; a mark is its character's number.
_NEWLINE, _COMMENT, _STRING, _NUMBER, _WORD = range(5)
#: A gap is its number of blanks, a tab counting as TAB of them, up to one below _BREAK, which stands for a line end.
TAB, _BREAK = 256, (1 << 14) - 1
FIGURES = ("kind", "gap", "size", "tool", "licence", "prefix")


class Tokens(dict):
    """The number of each token (with the white space before it), and per number its figures in ``column[name]``."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple] = []
        self.prefixes: list[str] = [""]
        self.prefix_numbers: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        number = len(self.rows)
        self.rows.append(self._figures(token))
        if len(token) <= SHORT:
            self[token] = number
        return number

    def _figures(self, token: str) -> tuple:
        value = token.lstrip()
        blank = token[: len(token) - len(value)]
        if not value:  # a line end and the white space before it
            return (_NEWLINE, 0, 0, 0, 0, 0)
        gap = min(len(blank) + (TAB - 1) * blank.count("\t"), _BREAK - 1)
        first = value[0]
        if value[:2] in ("//", "/*"):
            return (_COMMENT, gap, len(value), int(bool(TOOL_NOTICE.search(value))), int(bool(LICENCE_NOTICE.search(value))), 0)
        prefix = 0
        if first in "\"'`":
            kind = _STRING
        elif first.isdigit():
            kind = _NUMBER
        elif first.isalpha() or first == "_":
            kind = _WORD
            if found := _PREFIX.match(value):
                prefix = self.prefix_numbers.setdefault(found.group(1), len(self.prefixes))
                if prefix == len(self.prefixes):
                    self.prefixes.append(found.group(1))
        else:
            kind = ord(first)
        return (kind, gap, len(value), 0, 0, prefix)

    def columns(self) -> dict[str, np.ndarray]:
        table = np.array(self.rows, dtype=np.int64).reshape(-1, len(FIGURES))
        return {name: table[:, i] for i, name in enumerate(FIGURES)}


def _numbers(text: str, tokens: Tokens):
    if len(text) <= 4 * AT_ONCE:
        return map(tokens.__getitem__, _LEX.findall(text))
    return (tokens[m.group()] for m in _LEX.finditer(text))


def _inside(kind: np.ndarray, file: np.ndarray, opens: str, closes: str) -> np.ndarray:
    """How many brackets are open after each token, in its file; a closing one too many closes nothing."""
    step = np.isin(kind, [ord(c) for c in opens]).astype(np.int64) - np.isin(kind, [ord(c) for c in closes])
    run = np.cumsum(step)
    start = np.flatnonzero(np.diff(file, prepend=-1))
    run = run - np.repeat(run[start] - step[start], np.diff(np.append(start, len(file))))
    apart = np.int64(len(file) + 1) * file * 2  # files fall so far apart that the running minimum starts anew in each
    lowest = np.minimum.accumulate(np.minimum(run, 0) - apart) + apart
    return run - lowest


def _most_frequent(context: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the value (below ``_BREAK + 1``) that is most frequent among the rows of its context; of equals the
    smallest."""
    if not len(context):
        return value
    both, where, often = np.unique(context * (_BREAK + 1) + value, return_inverse=True, return_counts=True)
    keys, values = both // (_BREAK + 1), both % (_BREAK + 1)
    order = np.lexsort((values, -often, keys))
    first = np.ones(len(order), dtype=bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    best = np.repeat(values[order][first], np.diff(np.append(np.flatnonzero(first), len(order))))
    chosen = np.empty(len(order), dtype=np.int64)
    chosen[order] = best
    return chosen[where]


def _layouts(number: np.ndarray, file: np.ndarray, column: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tokens of code (no comments, no line ends), each with its gap to the token before it as it is (``gap``) and as
    in the canonical layout (``canonical``), and the same for the indentation of those that begin a line."""
    kind = column["kind"][number]
    line = np.cumsum(kind == _NEWLINE)
    code = kind >= _STRING
    at = np.flatnonzero(code)
    kind, gap, file, line, number = kind[at], column["gap"][number[at]], file[at], line[at], number[at]
    round_depth, depth = _inside(kind, file, "([", ")]"), _inside(kind, file, "{", "}")
    before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
    first = np.diff(file, prepend=-1) != 0
    begins = first | (np.diff(line, prepend=-1) != 0)  # the token is the first of code on its line
    real = np.where(begins, _BREAK, gap)
    ended = np.concatenate([[0], round_depth[:-1]]) if len(kind) else kind
    must = np.isin(before, [ord("{"), ord("}")]) & ~np.isin(kind, [ord(";"), ord(","), ord(")")]) | ((before == ord(";")) & (ended == 0)) | (kind == ord("}"))
    macro = code_line = np.zeros(len(kind), dtype=bool)
    if len(kind):
        code_line = np.repeat(kind[begins] == ord("#"), np.diff(np.append(np.flatnonzero(begins), len(kind))))  # a line of the preprocessor
        macro = np.concatenate([[False], code_line[:-1]])
    must |= begins & (macro | code_line)
    context = ((file * 256 + np.minimum(before, 255)) * 256 + np.minimum(kind, 255)) * 2 + (ended > 0)
    own = _most_frequent(context, real)
    outer = np.maximum(depth - (kind == ord("{")), 0)
    indent = np.zeros(len(kind), dtype=np.int64)
    indent[begins] = _most_frequent((file[begins] * 4096 + np.minimum(outer[begins], 2047)) * 2 + (ended[begins] > 0), gap[begins])
    return {
        "number": number, "file": file, "line": line, "kind": kind, "first": first, "begins": begins, "gap": real, "canonical": np.where(must, _BREAK, own),
        "indent": gap, "canonical_indent": indent, "depth": outer, "inside": ended, "round": round_depth,
    }


def canonical(text: str) -> str:
    """A text's code, without comments, in the canonical layout. A line that the file itself does not begin takes the
    indentation of four blanks for each open brace."""
    tokens = Tokens()
    number = np.fromiter(_numbers(text, tokens), dtype=np.int64)
    names = [t.lstrip() for t in _LEX.findall(text)]
    kinds = tokens.columns()["kind"][number] if len(number) else number
    laid = _layouts(number, np.zeros(len(number), dtype=np.int64), tokens.columns())
    out = []
    for i, at in enumerate(np.flatnonzero(kinds >= _STRING)):
        if laid["canonical"][i] == _BREAK and not laid["first"][i]:
            out.append("\n")
        if laid["canonical"][i] == _BREAK or laid["first"][i]:
            width = laid["canonical_indent"][i] if laid["begins"][i] else 4 * laid["depth"][i]
        else:
            width = laid["canonical"][i]
        out.append("\t" * (width // TAB) + " " * (width % TAB) + names[at])
    return "".join(out)


def layout(texts: list[str], tokens: Tokens) -> pa.RecordBatch:
    """The features of texts, as in ``FIELDS`` from ``tool`` on: notices in comments, and how the layout compares.

    ``expansion``: canonical lines of statements and braces per original line of code; ``uniform``: share of the ``gaps``
    between tokens, and of the indentations, that are as in the canonical layout; ``literal``: share of the code's
    characters in literals; ``prefix``: what most of the snake-case names begin with, if one prefix leads at least half
    of three or more. An empty text has no evidence; a very long one is lexed whole.
    """
    sizes, numbers = [], array("q")
    for text in texts:
        before = len(numbers)
        numbers.extend(_numbers(text, tokens))
        sizes.append(len(numbers) - before)
    column, count = tokens.columns(), len(texts)
    number = np.frombuffer(numbers, dtype=np.int64) if len(numbers) else np.zeros(0, dtype=np.int64)
    file = np.repeat(np.arange(count), sizes)
    per_file = lambda at, values=None: np.bincount(at, weights=values, minlength=count)
    tool, licence = (per_file(file, column[name][number]) > 0 for name in ("tool", "licence"))
    code = _layouts(number, file, column)
    kind, at, size = code["kind"], code["file"], column["size"][code["number"]]
    ends = np.isin(kind, [ord("{"), ord("}")]) | ((kind == ord(";")) & (code["round"] == 0))
    literal = np.where((kind == _STRING) | (kind == _NUMBER), size, (kind == ord(",")) & (code["round"] == 0))  # and the commas between values
    lines, statements, chars, literals = per_file(at, code["begins"]), per_file(at, ends), per_file(at, size), per_file(at, literal)
    same = np.where(code["first"], 0, code["gap"] == code["canonical"]) + (code["begins"] & (code["indent"] == code["canonical_indent"]))
    gaps = per_file(at, ~code["first"] + code["begins"].astype(np.int64))
    divide = lambda a, b: np.divide(a, b, out=np.zeros(count), where=b > 0)
    expansion, share = divide(statements, lines), divide(literals, chars)
    prefix = column["prefix"][code["number"]]
    named = prefix > 0
    many = len(tokens.prefixes)
    both, often = np.unique(at[named] * many + prefix[named], return_counts=True)
    files, which = both // many, both % many
    total = per_file(files, often)
    leads = [None] * count
    for f, w, n in zip(files.tolist(), which.tolist(), often.tolist()):
        if n >= 3 and 2 * n >= total[f]:
            leads[f] = tokens.prefixes[w] if leads[f] is None else min(leads[f], tokens.prefixes[w])
    minified = (expansion >= MIN_EXPANSION) & (chars >= MIN_LINE * lines) & (lines > 0)
    blob = (chars >= MIN_CODE) & (share >= MIN_LITERAL)
    columns = [tool, licence, minified, blob, divide(per_file(at, same), gaps), gaps.astype(np.int64), expansion, share]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(leads, pa.string())], names=[f.split()[0] for f in FIELDS.split(", ")[2:]])


def _features(batches: Iterable[pa.RecordBatch]):
    tokens = Tokens()
    for batch in batches:
        begin = 0
        while begin < batch.num_rows:
            size, end, group = 0, begin, []
            while end < batch.num_rows and size < AT_ONCE:
                group.append(batch.column("content")[end].as_py())
                size, end = size + len(group[-1]), end + 1
            if len(tokens.rows) > REMEMBERED:
                tokens = Tokens()
            found = layout(group, tokens)
            kept = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("file_id", "h", "size")), *found.columns], names=["file_id", "h", "size", *found.schema.names])
            begin = end


def _folders(path) -> F.Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def _segment(path, names) -> F.Column:
    return F.arrays_overlap(_folders(path), F.array(*[F.lit(n) for n in names]))


def path_evidence(files: DataFrame) -> DataFrame:
    """What a file's path and project say: columns ``id``, ``project``, ``by_tool``, ``by_third_party``, ``by_minifier``, ``by_export``.
    A null path says nothing; a missing project says nothing."""
    segments = F.split(F.lower(F.translate(F.coalesce("path", F.lit("")), "\\", "/")), "/")
    name = F.element_at(segments, -1)
    return files.select(
        "id",
        "project",
        (_segment(segments, OUTPUT_FOLDERS) | name.rlike(GENERATED_NAME)).alias("by_tool"),
        (_segment(segments, THIRD_PARTY_FOLDERS) | F.exists(_folders(segments), lambda f: f.rlike(PACKAGE_FOLDER)) | F.coalesce(F.lower("project").isin(*THIRD_PARTY_FOLDERS), F.lit(False))).alias("by_third_party"),
        (name.rlike(MINIFIED_NAME) | (_segment(segments, ("dist",)) & name.endswith(".js"))).alias("by_minifier"),
        name.rlike(BLOB_NAME).alias("by_export"),
    )


def provenance(files: DataFrame, content: DataFrame) -> DataFrame:
    """One row per file: ``file_id``, ``origin`` (hand, tool, third_party, minified or data), ``evidence`` (what it rests
    on: notice, path, layout, text or prefix; null for hand) and the layout's figures.

    A file without content (no row, or a null text) is judged by path and project. The texts are lexed where they are
    read; only their figures are joined with the files. A name that promises an exported blob counts only if there is no
    text to judge. A file without notice or telling path is a tool's if it is perfectly uniform where that is unusual, and
    third party if its text is the same as a third-party file's or if nearly all files with its identifier prefix are.
    """
    scratch = Scratch(files.sparkSession, "provenance")
    texts = content.where("content is not null and file_id is not null").select("file_id", "content", F.xxhash64("content").alias("h"), F.length("content").alias("size"))
    figures = texts.mapInArrow(_features, f"file_id long, {FIELDS}")
    judged = path_evidence(files.dropDuplicates(["id"])).withColumnRenamed("id", "file_id").join(figures, "file_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    by = [
        ("third_party", "notice", yes("licence")), ("third_party", "path", F.col("by_third_party")), ("tool", "notice", yes("tool")), ("tool", "path", F.col("by_tool")),
        ("minified", "layout", yes("minified")), ("minified", "path", F.col("by_minifier")), ("data", "layout", yes("blob")), ("data", "path", F.col("expansion").isNull() & F.col("by_export")),
    ]
    first = F.coalesce(*[F.when(holds, F.struct(F.lit(origin).alias("origin"), F.lit(evidence).alias("evidence"))) for origin, evidence, holds in by])
    perfect = (F.col("uniform") >= PERFECT) & (F.col("gaps") >= MIN_GAPS)
    of_tool = F.coalesce(F.col("first.origin") == "tool", F.lit(False))
    judged, found = scratch.measured(
        judged.withColumn("first", first).withColumn("large", F.coalesce(F.col("gaps") >= MIN_GAPS, F.lit(False))).withColumn("perfect", F.coalesce(perfect, F.lit(False))),
        rows=F.count(F.lit(1)), third=F.count_if(F.col("first.origin") == "third_party"), tools=F.count_if(of_tool & F.col("large")), perfect_tools=F.count_if(of_tool & F.col("perfect")),
    )
    judged = judged.withColumn("origin", F.coalesce("first.origin", F.lit("hand"))).withColumn("evidence", F.col("first.evidence"))
    # What is known of a project, a prefix or a text is worked out once for each; those of many files are joined by broadcast.
    limit, rate = max(1, int(found["rows"] * HEAVY_SHARE)), found["third"] / max(1, found["rows"])
    keyed = judged.withColumn("same", F.when(F.col("size") > 0, F.concat_ws(":", "h", "size")))
    is_third = F.col("origin") == "third_party"
    tests = (
        ("project", "tool", "layout", F.col("perfect"), F.sum("perfect") <= F.sum("large") * min(UNUSUAL, found["perfect_tools"] / max(1, found["tools"]) / TELLING)),
        ("same", "third_party", "text", F.lit(True), F.sum("third") > 0),
        ("prefix", "third_party", "prefix", F.lit(True), (F.sum("texts") >= PREFIX_TEXTS) & (F.sum("third") >= F.sum("n") * max(PREFIX_SHARE, min(1.0, PREFIX_RATIO * rate)))),
    )
    known = None
    for place, (name, origin, evidence, asks, holds) in enumerate(tests):
        held = keyed.where(F.col(name).isNotNull()).select("file_id", "origin", "large", "perfect", "h", F.col(name).alias("key"))
        if name == "project":
            held = held.where("origin = 'hand'")
        # Files are counted where they are read; only then do different texts of a key meet.
        each = held.groupBy("key", "h").agg(F.count("*").alias("n"), F.count_if(is_third).alias("third"), F.count_if("large").alias("large"), F.count_if("perfect").alias("perfect"), F.max(is_third.cast("int")).alias("texts"))
        groups = scratch.save(each.groupBy("key").agg(F.sum("n").alias("n"), holds.alias("holds")).where("holds").select("key", "n"))
        heavy = [r[0] for r in groups.where(F.col("n") > limit).select("key").collect()]  # at most 1 / HEAVY_SHARE
        part = heavy_light_join(held.where(F.col("origin") == "hand").where(asks), groups.select("key"), "key", heavy, "left_semi").select("file_id", F.struct(F.lit(place).alias("place"), F.lit(origin).alias("origin"), F.lit(evidence).alias("evidence")).alias("found"))
        known = part if known is None else known.unionByName(part)
    known = known.groupBy("file_id").agg(F.max("found").alias("found"))
    columns = ["file_id", "origin", "evidence", "uniform", "expansion", "literal"]
    open_files = judged.where("origin = 'hand'").join(known, "file_id", "left")
    open_files = open_files.withColumn("origin", F.coalesce("found.origin", "origin")).withColumn("evidence", F.col("found.evidence"))
    return judged.where("origin <> 'hand'").select(*columns).unionByName(open_files.select(*columns))


def not_hand_written(files: DataFrame, content: DataFrame) -> DataFrame:
    """The ids (``file_id``) of the files nobody wrote by hand in this code base, each once."""
    return provenance(files, content).where("origin <> 'hand'").select("file_id")
