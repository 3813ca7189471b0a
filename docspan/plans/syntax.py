"""The query language's text: relaxed JSON, statements, and the syntax tree of filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from docspan.errors import QueryError, UnsupportedOperator

COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
STAGES = ("$match", "$project", "$sort", "$skip", "$limit", "$count", "$group", "$lookup")
ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$first")
TESTS = ("$in", "$nin", "$exists", "$regex", "$and", "$or")
VERBS = ("find", "aggregate", "update", "delete")
TAILS = ("sort", "skip", "limit", "page", "project")
UPDATES = ("$set", "$unset", "$inc", "$push", "$pull")
DEFAULT_PAGE = 200

# relaxed JSON


class Reader:
    """Reads values from text: JSON, keys without quotes, and single quotes."""

    _bare = re.compile(r"[A-Za-z_$][\w$.\-]*")
    _number = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")
    _escapes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def fail(self, what: str) -> QueryError:
        return QueryError(f"{what} at {self.at}: {self.text[max(0, self.at - 20):self.at + 20]!r}")

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self, char: str) -> None:
        if self.peek() != char:
            raise self.fail(f"expected {char!r}")
        self.at += 1

    def match(self, pattern: re.Pattern) -> str | None:
        self.peek()
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
            return m[0]
        return None

    def string(self) -> str:
        quote, out = self.peek(), []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if c == "\\":
                e = self.text[self.at : self.at + 1]
                self.at += 1
                if e == "u":
                    try:
                        code = int(self.text[self.at : self.at + 4], 16)
                        self.at += 4
                        if 0xD800 <= code < 0xDC00 and self.text[self.at : self.at + 2] == "\\u":
                            code = 0x10000 + ((code - 0xD800) << 10) + int(self.text[self.at + 2 : self.at + 6], 16) - 0xDC00
                            self.at += 6
                        out.append(chr(code))
                    except ValueError:
                        raise self.fail("bad escape") from None
                else:
                    out.append(self._escapes.get(e, e))
            else:
                out.append(c)
        raise self.fail("text without end")

    def items(self, end: str, one) -> None:
        self.at += 1
        if self.peek() == end:
            self.at += 1
            return
        while True:
            one()
            if self.peek() == end:
                self.at += 1
                return
            self.take(",")

    def value(self) -> Any:
        c = self.peek()
        if c == "{":
            out: dict[str, Any] = {}

            def pair() -> None:
                key = self.string() if self.peek() in "\"'" and self.peek() else self.match(self._bare)
                if key is None:
                    raise self.fail("expected a key")
                self.take(":")
                out[key] = self.value()

            self.items("}", pair)
            return out
        if c == "[":
            values: list[Any] = []
            self.items("]", lambda: values.append(self.value()))
            return values
        if c and c in "\"'":
            return self.string()
        if (n := self.match(self._number)) is not None:
            return float(n) if re.search(r"[.eE]", n) else int(n)
        word = self.match(self._bare)
        if word in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word]
        raise self.fail("expected a value")


def read(text: str) -> Any:
    r = Reader(text)
    value = r.value()
    if r.peek():
        raise r.fail("text after the value")
    return value


# filters


@dataclass(frozen=True)
class Compare:
    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class In:
    path: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    path: str
    wanted: bool = True


@dataclass(frozen=True)
class Regex:
    path: str
    pattern: str


@dataclass(frozen=True)
class StartsWith:
    path: str
    prefix: str


@dataclass(frozen=True)
class All:
    parts: tuple = ()


@dataclass(frozen=True)
class Any_:
    parts: tuple = ()


Filter = Compare | In | Exists | Regex | StartsWith | All | Any_


def filter_of(value: Any) -> Filter:
    """The filter of a JSON object, its text, or a filter itself."""
    if isinstance(value, (Compare, In, Exists, Regex, StartsWith, All, Any_)):
        return value
    if value is None or (isinstance(value, str) and not value.strip()):
        return All()
    if isinstance(value, str):
        value = read(value)
    if not isinstance(value, dict):
        raise QueryError("a filter must be an object")
    parts: list[Filter] = []
    for key, arg in value.items():
        if key in ("$and", "$or"):
            if not isinstance(arg, list):
                raise QueryError(f"{key} takes an array of filters")
            parts.append((All if key == "$and" else Any_)(tuple(filter_of(x) for x in arg)))
        elif key.startswith("$"):
            raise UnsupportedOperator(f"unknown operator {key}")
        elif isinstance(arg, dict) and any(k.startswith("$") for k in arg):
            parts += [_operator(key, op, x) for op, x in arg.items()]
        else:
            parts.append(Compare(key, "$eq", arg))
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def _operator(path: str, op: str, arg: Any) -> Filter:
    if op in COMPARISONS:
        return Compare(path, op, arg)
    if op in ("$in", "$nin"):
        if not isinstance(arg, list):
            raise QueryError(f"{op} takes an array")
        return In(path, tuple(arg), op == "$nin")
    if op == "$exists":
        return Exists(path, arg is not False)
    if op == "$regex":
        if not isinstance(arg, str):
            raise QueryError("$regex takes a text")
        return Regex(path, arg)
    raise UnsupportedOperator(f"unknown operator {op}")


# statements


@dataclass(frozen=True)
class Find:
    collection: str
    filter: Filter = All()
    sort: tuple[tuple[str, bool], ...] = ()
    skip: int = 0
    limit: int = 0
    project: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Aggregate:
    collection: str
    stages: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Update:
    collection: str
    filter: Filter = All()
    changes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Delete:
    collection: str
    filter: Filter = All()


Statement = Find | Aggregate | Update | Delete
_HEAD = re.compile(r"\s*db\s*\.\s*(?:([A-Za-z0-9_]+)|`([^`]+)`)\s*\.\s*(" + "|".join(VERBS) + r")\s*\(")
_TAIL = re.compile(r"\.\s*([A-Za-z]+)\s*\(")


def arguments(r: Reader) -> list[Any]:
    """What stands between parentheses; the opening one has been read."""
    out: list[Any] = []
    if r.peek() == ")":
        r.at += 1
        return out
    while True:
        out.append(r.value())
        if r.peek() == ")":
            r.at += 1
            return out
        r.take(",")


def direction(value: Any, otherwise: bool) -> bool:
    """Whether a sort direction is ascending; otherwise holds for what isn't a number."""
    return value >= 0 if isinstance(value, (int, float)) and not isinstance(value, bool) else otherwise


def included(value: Any) -> tuple[str, ...]:
    """Paths that a projection includes: 0 leaves an entry out, anything else includes it."""
    if not isinstance(value, dict):
        raise QueryError("a projection must be an object")
    return tuple(k for k, v in value.items() if not (isinstance(v, (int, float)) and not isinstance(v, bool) and v == 0))


def stage_of(value: Any) -> tuple[str, Any]:
    if not isinstance(value, dict) or not value:
        raise QueryError("a stage must be an object")
    name, arg = next(iter(value.items()))
    if name not in STAGES:
        raise UnsupportedOperator(f"unknown stage {name}")
    return name, arg


def parse(text: str) -> Statement:
    if not text or not text.strip():
        raise QueryError("the query is empty")
    head = _HEAD.match(text)
    if not head:
        raise QueryError("a query looks like db.<collection>.find({ ... })")
    name, verb = head[1] or head[2], head[3]
    r = Reader(text, head.end())
    args = arguments(r)
    most = {"find": 1, "aggregate": 1, "update": 2, "delete": 1}[verb]
    if len(args) > most:
        raise QueryError(f"{verb}() takes {most} argument(s)")
    find = {"sort": (), "skip": 0, "limit": 0, "project": None}
    while r.peek() == ".":
        tail = r.match(_TAIL)
        call = _TAIL.match(tail)[1] if tail else ""
        if verb != "find" or call not in TAILS:
            raise QueryError(f"unexpected .{call}()")
        _tail(find, call, arguments(r))
    if r.peek() == ";":
        r.at += 1
    if r.peek():
        raise r.fail("unexpected text")
    if verb == "find":
        return Find(name, filter_of(args[0] if args else {}), **find)
    if verb == "delete":
        return Delete(name, filter_of(args[0] if args else {}))
    if verb == "update":
        changes = args[1] if len(args) > 1 else {}
        if not isinstance(changes, dict):
            raise QueryError("an update must be an object")
        return Update(name, filter_of(args[0] if args else {}), changes)
    stages = args[0] if args else []
    if not isinstance(stages, list):
        raise QueryError("aggregate() takes an array of stages")
    return Aggregate(name, tuple(stage_of(s) for s in stages))


def _tail(find: dict, call: str, args: list[Any]) -> None:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if call == "page":
        if not 1 <= len(args) <= 2 or not all(whole(a) and a >= 1 for a in args):
            raise QueryError("page() takes a page number from 1, and a size, as in page(2, 200)")
        size = args[1] if len(args) == 2 else find["limit"] if find["limit"] > 0 else DEFAULT_PAGE
        find |= {"skip": (args[0] - 1) * size, "limit": size}
    elif len(args) != 1:
        raise QueryError(f"{call}() takes one argument")
    elif call in ("skip", "limit"):
        if not whole(args[0]):
            raise QueryError(f"{call}() takes a whole number")
        find[call] = args[0]
    elif call == "sort":
        if not isinstance(args[0], dict):
            raise QueryError("sort() takes an object")
        find["sort"] = tuple((k, direction(v, False)) for k, v in args[0].items())
    else:
        find["project"] = included(args[0])
