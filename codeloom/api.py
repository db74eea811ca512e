"""The engine's face: one object over a directory of tables with a method for each question it answers.

Every method returns a frame. Arguments are checked before a plan is made: a project against the names of all projects,
which are read for it. Lookups by likeness, of members by type, and over the inheritance graph run jobs while the plan is
made (they save their candidates, or go round by round); the others read nothing before the frame is used.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import trigrams
from codeloom.operators import closure, content, ingest, logs, statistics, symbols
from codeloom.operators.symbols import Options
from codeloom.session import table
from codeloom.sources import parsers
from codeloom.sources.publish import LAYOUTS, publish

#: Results of a lookup where nothing else is asked for.
LIMITS = {"find_type": 10, "find_member": 20, "find_children": 50, "browse_module": 100, "find_file": 20, "find_asset": 20, "browse_assets": 100, "grep": 20}
BATCH_LIMIT = 10
LANGUAGES = ("all", "angelscript", "cpp", "config", "blueprint", "content", "javascript")


class BadRequest(ValueError):
    """A question that cannot be answered as it was put."""


class Index:
    """``published``: a folder that ``publish`` has written the tables to, laid out for lookups; they are then read from there,
    and lookups by likeness use the postings of names that stand beside them."""

    def __init__(self, spark: SparkSession, directory: str, published: str | None = None):
        self.spark, self.directory, self.published = spark, directory, published

    def table(self, name: str) -> DataFrame:
        if self.published and name in LAYOUTS:
            return self.spark.read.parquet(f"{self.published}/{name}")
        return table(self.spark, self.directory, name)

    def publish(self, target: str) -> "Index":
        """Writes the tables and the postings of their names to ``target``, laid out for lookups; an index that reads these."""
        for name in LAYOUTS:
            publish(name, table(self.spark, self.directory, name), f"{target}/{name}")
        self.build_name_trigrams(f"{target}/name_trigrams")
        return Index(self.spark, self.directory, target)

    def postings(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.published}/name_trigrams") if self.published else None

    def _tables(self, *names: str) -> list[DataFrame]:
        return [self.table(n) for n in names]

    # ---- checks ----------------------------------------------------------------------------------------------------

    def check_project(self, project: str | None) -> None:
        """An unknown project is an error that names the known ones (a handful of names, read as a distinct)."""
        if project is None:
            return
        known = sorted(r[0] for r in statistics.projects(*self._tables("files", "assets")).collect())
        if project not in known:
            raise BadRequest(f"unknown project {project}; known are {', '.join(known)}")

    @staticmethod
    def check_text(value: str | None, what: str) -> str:
        if not value or not str(value).strip():
            raise BadRequest(f"{what} is missing")
        return value

    @staticmethod
    def check_language(language: str | None) -> None:
        if language is not None and language not in LANGUAGES:
            raise BadRequest(f"unknown language {language}; known are {', '.join(LANGUAGES)}")

    def options(self, method: str, project=None, language=None, kind=None, max_results=None, include_assets=None) -> Options:
        self.check_project(project)
        self.check_language(language)
        return Options(project, language, kind, max_results or LIMITS[method], include_assets)

    # ---- symbols ---------------------------------------------------------------------------------------------------

    def find_type(self, name: str, fuzzy: bool = False, context_lines: int = 0, **filters) -> DataFrame:
        name, options = self.check_text(name, "name"), self.options("find_type", **filters)
        tables = self._tables("types", "files", "assets")
        found = symbols.find_type_fuzzy(*tables, name, options, self.postings()) if fuzzy else symbols.find_type(*tables, name, options)
        if not context_lines:
            return found
        files, texts = self._tables("files", "file_content")
        placed = found.join(files.select(F.col("id").alias("file_id"), "path", "project"), ["path", "project"], "left")
        return content.context_of(placed, texts, context_lines).drop("file_id")

    def find_member(self, name: str, fuzzy: bool = False, containing_type: str | None = None, hierarchy: bool = False, member_kind: str | None = None, **filters) -> DataFrame:
        name, options = self.check_text(name, "name"), replace(self.options("find_member", **filters), kind=member_kind)
        tables = self._tables("members", "types", "files")
        if fuzzy:
            found = symbols.find_member_fuzzy(*tables, name, options, self.postings())
        else:
            family = None
            if containing_type and hierarchy:
                family = closure.descendants(self.inheritance(), self.spark.createDataFrame([(containing_type,)], "name string"))
            found = symbols.find_member(*tables, name, options, containing_type, family)
        if containing_type:
            above = closure.ancestors(closure.inheritance(self.table("types"), None), containing_type)
            found = symbols.synthetic_members(found, above, containing_type, name, fuzzy, options.max_results)
        return found

    def inheritance(self) -> DataFrame:
        return closure.inheritance(*self._tables("types", "assets"))

    def find_children(self, parent: str, recursive: bool = True, **filters) -> DataFrame:
        o = self.options("find_children", **filters)
        return closure.children(*self._tables("types", "files", "assets"), self.check_text(parent, "parent"), recursive, o.project, o.language, o.max_results)

    def explain_type(self, name: str, max_functions: int = 30, max_properties: int = 30, max_children: int = 20, context_lines: int = 0) -> dict[str, DataFrame]:
        """A type's declaration, its members in buckets, and what lies below it. With ``context_lines`` declaration and
        members come with the line they stand on (``signature``) and the lines around it (``context``)."""
        name = self.check_text(name, "name")
        members, types, texts = self._tables("members", "types", "file_content")
        inside = symbols.members_of(members, types, name, max_functions, max_properties)
        if context_lines:
            placed = inside.join(members.select("id", "file_id").dropDuplicates(["id"]), "id")
            inside = content.context_of(placed, texts, context_lines).drop("file_id")
        return {
            "type": self.find_type(name, max_results=1, context_lines=context_lines),
            "members": inside,
            "children": self.find_children(name, max_results=max_children),
        }

    def find_file(self, name: str, **filters) -> DataFrame:
        return symbols.find_file(*self._tables("files", "types"), self.check_text(name, "name"), self.options("find_file", **filters))

    def find_asset(self, name: str, fuzzy: bool = True, project: str | None = None, folder: str | None = None, max_results: int | None = None) -> DataFrame:
        self.check_project(project)
        return symbols.find_asset(self.table("assets"), self.check_text(name, "name"), fuzzy, project, folder, max_results or LIMITS["find_asset"])

    # ---- modules, folders, figures ---------------------------------------------------------------------------------

    def browse_module(self, module: str, **filters) -> DataFrame:
        return symbols.browse_module(*self._tables("types", "files"), self.check_text(module, "module"), self.options("browse_module", **filters))

    def list_modules(self, parent: str = "", project: str | None = None, depth: int = 1) -> DataFrame:
        self.check_project(project)
        return symbols.list_modules(self.table("files"), parent, project, depth).orderBy(F.expr("collate(module, 'UNICODE')"))

    def browse_assets(self, folder: str, project: str | None = None, max_results: int | None = None) -> DataFrame:
        self.check_project(project)
        return symbols.browse_assets(self.table("assets"), self.check_text(folder, "folder"), project, max_results or LIMITS["browse_assets"])

    def list_asset_folders(self, parent: str = "/Game", project: str | None = None, depth: int = 1) -> DataFrame:
        self.check_project(project)
        return symbols.list_asset_folders(self.table("assets"), parent, project, depth).orderBy(F.expr("collate(folder, 'UNICODE')"))

    def stats(self) -> DataFrame:
        return statistics.index_stats(*self._tables("files", "types", "members"))

    def summary(self) -> DataFrame:
        return statistics.project_stats(*self._tables("files", "types"))

    def asset_stats(self) -> DataFrame:
        return statistics.asset_stats(self.table("assets"))

    def status(self) -> DataFrame:
        return statistics.language_status(*self._tables("files", "assets"))

    def name_trigram_status(self) -> DataFrame:
        return statistics.posting_stats(*self._tables("types", "members"))

    def build_name_trigrams(self, target: str) -> None:
        """Writes the postings of all names, one folder per kind of symbol, sorted so that a lookup reads few pages."""
        trigrams.postings(*self._tables("types", "members")).repartitionByRange("entity_type", "trigram").sortWithinPartitions("trigram").write.mode("overwrite").partitionBy("entity_type").parquet(target)

    def file_mtimes(self) -> DataFrame:
        return ingest.mtimes(*self._tables("files", "file_content"))

    # ---- text ------------------------------------------------------------------------------------------------------

    def grep(self, pattern: str, now_ms: int, regex: bool = True, case_sensitive: bool = True, context_lines: int = 0, language: str | None = None, project: str | None = None, max_results: int | None = None, grouped: bool = True) -> DataFrame:
        """Ranked matching lines, by file or flat. Several words without regular-expression characters ask for lines with
        all of them, or near each other."""
        self.check_text(pattern, "pattern")
        self.check_project(project)
        self.check_language(language)
        if language == "blueprint":
            raise BadRequest("assets have no source text; ask for them by name")
        try:
            re.compile(pattern)
        except re.error as e:
            raise BadRequest(f"no regular expression: {e}") from e
        texts, files, types, members = self._tables("file_content", "files", "types", "members")
        words = pattern.split()
        if regex and len(words) > 1 and not content.is_regex(pattern):
            hits = content.grep(texts, files, "|".join(map(re.escape, words)), True, False, max(3, context_lines), language, project)
            hits = content.all_words(hits, words)
        else:
            hits = content.grep(texts, files, pattern, regex and content.is_regex(pattern), case_sensitive, context_lines, language, project)
        best = content.best_hits(content.rank(hits, now_ms, content.symbols_near(hits, types, members)), max_results or LIMITS["grep"])
        return content.by_file(best) if grouped else best

    def search_symbols(self, name: str, case_sensitive: bool = True, language: str | None = None, project: str | None = None, max_results: int = 20) -> DataFrame:
        return content.search_symbols(*self._tables("types", "members", "files"), self.check_text(name, "name"), case_sensitive, language, project, max_results)

    def search_assets(self, pattern: str) -> DataFrame:
        return content.search_assets(self.table("assets"), self.check_text(pattern, "pattern"))

    # ---- logs ------------------------------------------------------------------------------------------------------

    def query_analytics(self) -> dict[str, DataFrame]:
        log = logs.query_log(self.table("events"))
        return {"by_method": logs.by_method(log), "slowest": logs.slowest(log), "without_result": logs.without_result(log), "latencies": logs.latencies(log)}

    def tool_analytics(self) -> dict[str, DataFrame]:
        log = logs.tool_log(self.table("events"))
        return {"by_tool": logs.by_tool(log), "by_session": logs.by_session(log)}

    # ---- upkeep ----------------------------------------------------------------------------------------------------

    def ingest(self, incoming: DataFrame, assets: DataFrame | None, deletes: DataFrame) -> dict[str, DataFrame]:
        """The tables after a batch; write them as a new version to make it current."""
        tables = {n: self.table(n) for n in ("files", "types", "members", "file_content", "assets")}
        return ingest.ingest(tables, incoming, assets, deletes, parsers.symbols)

    # ---- several questions -----------------------------------------------------------------------------------------

    METHODS = ("find_type", "find_member", "find_children", "find_file", "find_asset", "browse_module", "list_modules", "browse_assets", "list_asset_folders", "stats", "asset_stats")

    def batch(self, questions: list[tuple[str, dict]]) -> list[DataFrame | str]:
        """The answers to up to ten questions (method, arguments); an error takes the place of its answer only."""
        if not questions or len(questions) > BATCH_LIMIT:
            raise BadRequest(f"a batch has 1 to {BATCH_LIMIT} questions, not {len(questions)}")
        answers: list[DataFrame | str] = []
        for method, given in questions:
            try:
                if method not in self.METHODS:
                    raise BadRequest(f"unknown method {method}")
                answers.append(getattr(self, method)(**given))
            except (BadRequest, TypeError) as e:
                answers.append(f"error: {e}")
        return answers

    def logged(self, method: str, log: logs.Log, **given):
        """The collected answer to a question, with its time and size in a log."""
        return log.timed(method, [v for v in given.values() if v is not None], lambda: getattr(self, method)(**given).collect())

    @staticmethod
    def grep_hints(pattern: str, project: str | None = None) -> list[str]:
        """What to try when a text search found nothing."""
        tips = []
        if "\\n" in pattern or "\\r" in pattern:
            tips.append("lines are searched one by one, so a line end in the pattern matches nothing; ask for each line apart")
        if "\\|" in pattern:
            tips.append("an escaped bar is a bar; leave the backslash out for one or the other")
        if project:
            tips.append(f"leave out the filter on project ({project})")
        return tips

    @staticmethod
    def hints(method: str, fuzzy: bool = False, project: str | None = None, language: str | None = None, kind: str | None = None) -> list[str]:
        """What to try when nothing was found."""
        tips = [] if fuzzy or method not in ("find_type", "find_member") else ["look for similar names (fuzzy)"]
        tips += [f"leave out the filter on {what} ({value})" for what, value in (("project", project), ("language", language), ("kind", kind)) if value]
        return tips or ["check the spelling, or search the text"]


# ---- routing of search commands ------------------------------------------------------------------------------------

# What a search pattern looks like when a declaration is meant.
TYPE_WORDS = ("class", "struct", "enum")
TYPE_LETTERS = "UAFES"
MEMBER_WORDS = ("void", "int", "float", "bool", "double", "FVector", "FString", "FName", "FText", "TArray", "TMap", "TSubclassOf", "UFUNCTION", "UPROPERTY")
# Commands by what they do, and the shortest pattern and file name that are looked up.
TEXT_SEARCH, FILE_SEARCH = ("grep", "rg", "select-string", "sls"), ("find", "get-childitem", "gci")
PATTERN_FLAGS, NAME_FLAGS = ("-pattern",), ("-name", "-iname", "-filter", "-include")
SHORTEST_PATTERN, SHORTEST_NAME = 2, 3

_DECLARED = re.compile(rf"(?:{'|'.join(TYPE_WORDS)})\s+(\w+)")
_PREFIXED = re.compile(rf"[{TYPE_LETTERS}][A-Z][A-Za-z0-9_]+")
_MEMBER = re.compile(rf"(?:{'|'.join(MEMBER_WORDS)})\s+(\w+)")


def routes(pattern: str) -> list[tuple[str, dict]]:
    """The lookups a search pattern asks for, in the order they are to be tried; each but the last only if the one before
    found nothing. A type for what begins as a declaration, or is all of it a prefixed name; a member for what begins with
    the word of a member's type; in the end the text. A pattern that is too short asks for nothing."""
    if len(pattern) < SHORTEST_PATTERN:
        return []
    found = []
    if declared := _DECLARED.match(pattern):
        found.append(("find_type", {"name": declared.group(1)}))
    if _PREFIXED.fullmatch(pattern):
        found.append(("find_type", {"name": pattern}))
    if member := _MEMBER.match(pattern):
        found.append(("find_member", {"name": member.group(1)}))
    return [*found, ("grep", {"pattern": pattern})]


def route(pattern: str) -> tuple[str, dict]:
    """The first of ``routes``; text search for a pattern that is too short."""
    return (routes(pattern) or [("grep", {"pattern": pattern})])[0]


def file_lookup(pattern: str) -> tuple[str, dict] | None:
    """The lookup of files that a glob stands for: by its last part, without wild cards and extension; none if little is left."""
    name = re.split(r"[/\\]", pattern)[-1].replace("*", "").replace("?", "")
    name = name.rsplit(".", 1)[0]
    return ("find_file", {"name": name}) if len(name) >= SHORTEST_NAME else None


def route_command(command: str) -> tuple[str, dict] | None:
    """The lookup that a shell search stands for: a search in texts becomes one in the index's texts, a search for files by
    name one for files. None for other commands, and for a search for files without a name."""
    import shlex

    try:
        words = shlex.split(command)
    except ValueError:
        return None
    if not words:
        return None
    tool, rest = words[0].lower(), words[1:]
    given = lambda flags: next((rest[i + 1] for i, w in enumerate(rest[:-1]) if w.lower() in flags), None)
    if tool in TEXT_SEARCH:
        pattern = given(PATTERN_FLAGS) or next((w for w in rest if not w.startswith("-")), "")
        return ("grep", {"pattern": pattern}) if len(pattern) >= SHORTEST_PATTERN else None
    if tool in FILE_SEARCH:
        name = given(NAME_FLAGS)
        return file_lookup(name) if name else None
    return None


def register(spark: SparkSession, directory: str, names=("files", "types", "members", "assets", "file_content")) -> None:
    """Makes the tables views, and the name functions SQL functions (``trigrams``, ``strip_prefix``, ``camel_words``; as tables ``children_of`` and ``lines_of``)."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)
    spark.sql("create or replace temporary function strip_prefix(x string) returns string return regexp_replace(x, '^[UAFESI](?=[A-Z])', '')")
    spark.sql("create or replace temporary function trigrams(x string) returns array<string> return case when length(x) >= 3 then array_distinct(transform(sequence(1, length(x) - 2), i -> substring(lower(x), i, 3))) else cast(array() as array<string>) end")
    spark.sql("create or replace temporary function children_of(p string) returns table (name string, kind string) return select name, kind from types where parent = children_of.p union all select name, 'class' from assets where asset_class is not null and parent_class in (children_of.p, strip_prefix(children_of.p))")
    spark.sql("create or replace temporary function lines_of(f bigint) returns table (line int, text string) return select pos + 1, col from (select posexplode(split(content, '\\n')) from file_content where file_id = lines_of.f)")
    spark.sql("create or replace temporary function camel_words(x string) returns array<string> return filter(split(lower(regexp_replace(regexp_replace(strip_prefix(x), '([A-Z]+)([A-Z][a-z])', '$1 $2'), '([a-z])([A-Z])', '$1 $2')), ' +'), w -> w <> '')")
