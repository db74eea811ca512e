"""Symbols from source text: types and members of C++ headers and of the script language.

Both dialects are read by one scanner: it keeps the depth of braces and the type whose body it is in, and asks the
dialect's table of rules what a line declares. A rule is a pattern and what to make of its match. Types nested in a
type's body are not declared apart; only the first level of a body has members.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "file_id long, entity string, name string, kind string, parent string, line int, is_static boolean, specifiers string, owner string"

# Declarations of the C++ dialect.
CPP_DELEGATES = (
    r"DECLARE_(?:DYNAMIC_(?:MULTICAST_)?)?(?:MULTICAST_)?DELEGATE_RetVal(?:_\w+)?\s*\(\s*[^,)]+\s*,\s*(\w+)",
    r"DECLARE_(?:DYNAMIC_(?:MULTICAST_)?)?(?:MULTICAST_)?DELEGATE(?:_\w+)?\s*\(\s*(\w+)",
    r"DECLARE_EVENT(?:_\w+)?\s*\(\s*\w+\s*,\s*(\w+)",
)
CPP_ALIAS = r"using\s+([FUAESI]\w+)\s*=\s*(?:[\w:]+::)*(\w+)(?:<[^>]*>)?\s*;"
CPP_TYPE = r"(class|struct)\s+(?:\w+_API\s+)?(\w+)(?:\s+final)?(?:\s*:\s*(?:public|private|protected)\s+(\w+))?"
CPP_ENUM = r"enum\s+(?:class\s+)?(\w+)"
CPP_FUNCTION = r"(?:\w+_API\s+)?(?:virtual\s+)?(?:static\s+)?(?:const\s+)?\w[\w<>:,\s*&]*?\s+(\w+)\s*\("
CPP_MARKED_FUNCTION = r"(?:virtual\s+)?(?:static\s+)?(?:const\s+)?\w[\w<>:,\s*&]*?\s+(\w+)\s*\("
CPP_MARKED_PROPERTY = r"(?:const\s+)?\w[\w<>:,\s*&]*?\s+(\w+)\s*(?::\s*\d+\s*)?[=;{]"
CPP_NO_FUNCTION = ("if", "for", "while", "switch", "return", "typedef", "using", "operator")
CPP_NO_NAME = ("GENERATED_BODY", "GENERATED_UCLASS_BODY")
# Declarations of the script dialect.
SCRIPT_TYPE = r"(class|struct)\s+(\w+)(?:\s*:\s*(\w+))?"
SCRIPT_ENUM = r"enum\s+(E\w+)"
SCRIPT_CALLBACK = r"(event|delegate)\s+\w+\s+(F\w+)\s*\("
SCRIPT_NAMESPACE = r"namespace\s+(\w+)"
SCRIPT_FUNCTION = r"(\w[\w<>,\s]*?)\s+(\w+)\s*\("
SCRIPT_PROPERTY = r"(\w[\w<>,\s]*?)\s+(\w+)\s*[=;]"
SCRIPT_WORDS = frozenset(
    "if else for while do switch case break continue return default new delete cast import from class struct enum event delegate "
    "namespace mixin access UCLASS USTRUCT UENUM UPROPERTY UFUNCTION override property settings private protected public".split()
)
ENUM_VALUE = r"(\w+)\s*(?:[,=}]|$)"

_QUIET = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|//.*")
_ARGUMENTS = re.compile(r"\(([^)]*)\)")
_match = lambda pattern: re.compile(pattern, re.ASCII).match


def brace_change(line: str) -> int:
    """Opening less closing braces of a line, those in strings and comments aside."""
    code = _QUIET.sub("", line)
    return code.count("{") - code.count("}")


def arguments(line: str) -> list[str]:
    """The comma-separated words of the first pair of parentheses."""
    found = _ARGUMENTS.search(line)
    return [a.strip() for a in found.group(1).split(",") if a.strip()] if found else []


@dataclass
class Scan:
    """The state of a scan, and what it has found."""

    depth: int = 0
    owner: str | None = None
    base: int = 0
    in_enum: bool = False
    marks: dict[str, tuple[int, list[str]]] = field(default_factory=dict)
    seen: set[str] = field(default_factory=set)
    rows: list[tuple] = field(default_factory=list)

    def type(self, name: str, kind: str, line: int, parent: str | None = None, body: bool = False) -> None:
        self.rows.append(("type", name, kind, parent, line, None, None, None))
        if body:
            self.owner, self.base, self.in_enum = name, self.depth, kind == "enum"

    def member(self, name: str, kind: str, line: int, static: bool = False, specifiers: str | None = None) -> None:
        self.rows.append(("member", name, kind, None, line, static, specifiers, self.owner))

    def leave(self, change: int) -> bool:
        self.depth += change
        if self.owner is not None and self.depth <= self.base:
            self.owner, self.in_enum = None, False
            return True
        return False


class Dialect:
    """What a line declares at the top level and in a body; ``True`` from a rule ends the line."""

    anywhere: list[tuple[Callable, Callable]] = []
    top: list[tuple[Callable, Callable]] = []
    forgets_on_leave = False

    def member_line(self, scan: Scan, line: str, number: int) -> None:
        raise NotImplementedError

    def pass_over(self, scan: Scan, line: str) -> bool:
        """Whether a body line declares nothing for certain."""
        raise NotImplementedError

    def enum_value(self, line: str) -> str | None:
        found = None if line in ("{", "}", "};") else _match(ENUM_VALUE)(line)
        return found.group(1) if found else None

    def parse(self, text: str) -> list[tuple]:
        scan = Scan()
        for number, raw in enumerate(text.split("\n"), 1):
            line = raw.strip()
            if not line or line.startswith("//"):
                continue
            change = brace_change(raw)
            if self._declared(self.anywhere, scan, line, number):
                scan.depth += change
            elif scan.owner is None:
                before = scan.depth
                self._declared(self.top, scan, line, number)
                scan.depth = before + change
            else:
                quiet = False
                if scan.depth > scan.base:
                    if scan.in_enum:
                        value = self.enum_value(line)
                        if value:
                            scan.member(value, "enum_value", number)
                    else:
                        quiet = self.pass_over(scan, line)
                        if not quiet:
                            self.member_line(scan, line, number)
                if scan.leave(change) and not quiet and self.forgets_on_leave:
                    scan.marks.clear()
        return scan.rows

    @staticmethod
    def _declared(rules, scan: Scan, line: str, number: int) -> bool:
        for matches, make in rules:
            found = matches(line)
            if found and make(scan, found, line, number):
                return True
        return False


def _is_forward(line: str) -> bool:
    return line.endswith(";") and "{" not in line


def _mark(name: str):
    def make(scan: Scan, found, line: str, number: int) -> bool:
        scan.marks[name] = (number, arguments(line))
        return True

    return make


def _marked(scan: Scan, name: str, number: int, reach: int) -> bool:
    """Whether a marker stands close enough above; it is used up then."""
    if name in scan.marks and number - scan.marks[name][0] <= reach:
        del scan.marks[name]
        return True
    return False


def _cpp_delegate(scan: Scan, found, line: str, number: int) -> bool:
    if not found.group(1).startswith("F"):
        return False
    scan.type(found.group(1), "delegate", number)
    return True


def _cpp_alias(scan: Scan, found, line: str, number: int) -> bool:
    name, target = found.groups()
    kind = {"F": "struct", "S": "struct", "E": "enum", "I": "interface"}.get(name[0], "class")
    scan.type(name, kind, number, target if target != name and kind != "enum" else None)
    return True


def _cpp_type(scan: Scan, found, line: str, number: int) -> bool:
    word, name, parent = found.groups()
    if not _is_forward(line):
        mark, letters = ("UCLASS", "UAFI") if word == "class" else ("USTRUCT", "F")
        if _marked(scan, mark, number, 3) or name[0] in letters:
            scan.type(name, "struct" if word == "struct" else "interface" if name[0] == "I" else "class", number, parent, body=True)
    return True


def _cpp_enum(scan: Scan, found, line: str, number: int) -> bool:
    name = found.group(1)
    if not _is_forward(line) and (_marked(scan, "UENUM", number, 3) or name[0] == "E"):
        scan.type(name, "enum", number, body=True)
    return True


class Cpp(Dialect):
    anywhere = [(_match(p), _cpp_delegate) for p in CPP_DELEGATES]
    top = [*((_match(rf"{m}\s*\("), _mark(m)) for m in ("UCLASS", "USTRUCT", "UENUM")), (_match(CPP_ALIAS), _cpp_alias), (_match(CPP_TYPE), _cpp_type), (_match(CPP_ENUM), _cpp_enum)]
    forgets_on_leave = True

    def enum_value(self, line: str) -> str | None:
        return None if line.startswith(("UMETA", "GENERATED")) else super().enum_value(line)

    def pass_over(self, scan: Scan, line: str) -> bool:
        for mark in ("UFUNCTION", "UPROPERTY"):
            if _match(rf"{mark}\s*\(")(line):
                scan.marks[mark] = (0, arguments(line))
                return True
        return line in ("{", "}", "};") or line.startswith(("GENERATED", "#", "friend "))

    def member_line(self, scan: Scan, line: str, number: int) -> None:
        if scan.depth != scan.base + 1:
            return
        static = bool(re.search(r"\bstatic\b", line))
        for mark, pattern, kind in (("UFUNCTION", CPP_MARKED_FUNCTION, "function"), ("UPROPERTY", CPP_MARKED_PROPERTY, "property")):
            if mark in scan.marks:
                found = _match(pattern)(line)
                _, words = scan.marks.pop(mark)
                if found:
                    scan.marks.pop("UFUNCTION", None)
                    scan.marks.pop("UPROPERTY", None)
                    scan.member(found.group(1), kind, number, static, ", ".join(words) or mark)
                    return
        found = _match(CPP_FUNCTION)(line)
        if found and not line.startswith(CPP_NO_FUNCTION):
            name = found.group(1)
            if len(name) > 1 and name != scan.owner and name[0] == name[0].upper() and name not in CPP_NO_NAME and not name.startswith(("DECLARE_", "IMPLEMENT_")):
                scan.member(name, "function", number, static, "virtual" if re.search(r"\bvirtual\b", line) else "")


def _script_type(scan: Scan, found, line: str, number: int) -> bool:
    word, name, parent = found.groups()
    if len(name) < 2 or name[0] not in ("UAIF" if word == "class" else "F"):
        return False
    scan.type(name, "struct" if word == "struct" else "interface" if name[0] == "I" else "class", number, parent, body=True)
    return True


def _script_enum(scan: Scan, found, line: str, number: int) -> bool:
    scan.type(found.group(1), "enum", number, body=True)
    return True


def _script_callback(scan: Scan, found, line: str, number: int) -> bool:
    scan.type(found.group(2), found.group(1), number)
    return True


def _script_namespace(scan: Scan, found, line: str, number: int) -> bool:
    if found.group(1) not in scan.seen:
        scan.seen.add(found.group(1))
        scan.type(found.group(1), "namespace", number)
    return True


class Script(Dialect):
    top = [(_match(SCRIPT_TYPE), _script_type), (_match(SCRIPT_ENUM), _script_enum), (_match(SCRIPT_CALLBACK), _script_callback), (_match(SCRIPT_NAMESPACE), _script_namespace)]

    def pass_over(self, scan: Scan, line: str) -> bool:
        for mark in ("UFUNCTION", "UPROPERTY"):
            if _match(rf"{mark}\s*\(")(line):
                scan.marks[mark] = (0, [])
                return True
        if line in ("{", "}", "};") or line.startswith(("GENERATED_BODY", "default ", "settings ", "#")):
            scan.marks.clear()
            return True
        return False

    def member_line(self, scan: Scan, line: str, number: int) -> None:
        marks, scan.marks = scan.marks, {}
        if scan.depth != scan.base + 1:
            return
        bare = re.sub(r"^static\s+", "", re.sub(r"^(private|protected|public)\s+", "", line))
        for mark, pattern, kind in (("UFUNCTION", SCRIPT_FUNCTION, "function"), ("UPROPERTY", SCRIPT_PROPERTY, "property")):
            found = _match(pattern)(bare)
            if found and SCRIPT_WORDS.isdisjoint(found.groups()):
                scan.member(found.group(2), kind, number, bool(re.search(r"\bstatic\b", line)), mark if mark in marks else None)
                return


DIALECTS: dict[str, Dialect] = {"cpp": Cpp(), "angelscript": Script()}


def _parse(batches: Iterable[pd.DataFrame]):
    columns = [f.split()[0] for f in SYMBOLS.split(", ")]
    for batch in batches:
        rows = []
        for file_id, language, text in zip(batch["file_id"], batch["language"], batch["content"]):
            dialect = DIALECTS.get(language)
            if dialect is not None:
                rows.extend((file_id, *r) for r in dialect.parse(text))
        yield pd.DataFrame(rows, columns=columns).astype({"is_static": "object"})


def symbols(texts: DataFrame, longest: int | None = None) -> DataFrame:
    """The symbols of ``texts`` (``file_id``, ``language``, ``content``), as in ``SYMBOLS``: types (``parent``) and members
    (``owner``, ``is_static``, ``specifiers``) with their lines. Texts of other languages, null texts and, if
    ``longest`` is given, texts of more characters have none."""
    picked = texts.where(F.col("language").isin(*DIALECTS) & F.col("content").isNotNull())
    if longest is not None:
        picked = picked.where(F.length("content") <= longest)
    return picked.select("file_id", "language", "content").mapInPandas(_parse, SYMBOLS)
