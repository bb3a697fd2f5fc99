"""Source text to a tree of regions and typed spans, for C/C++, C# and Java.

A language is a table of token classes, tried in order at each place, and a few switches of one stack machine.
Texts have line feeds as line ends.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

from ..schema import REGION_TYPES, SPAN_KINDS

GAP = r"(?:\\\n)*"  # continued lines
WORD = r"[A-Za-z_][A-Za-z_0-9]*"
STRING = r'"(?:[^"\\]|\\.)*"'
CHARS = r"'(?:[^'\\]|\\.)*'"
OPERATOR = rf"operator(?:\s+{WORD}(?:\s*\[\s*\])?|\s*\[\s*\]|\s*\(\s*\)|\s*[!%&*^|~+-\\]{{1,3}})"
TYPES = r"(?:\s*<\s*[A-Za-z_0-9]+\s*(?:,\s*[A-Za-z_0-9]+\s*)*>)?"
BLANK_LINE = r"\n\s*\n"


@dataclass(frozen=True)
class Language:
    """classes: (token class, pattern), with the name in a group of its own where there is one."""

    name: str
    classes: tuple[tuple[str, str], ...]
    squeeze: bool = False  # white space in names goes
    function_renames: bool = False  # a function's name replaces that of a type
    pattern: re.Pattern = field(init=False)

    def __post_init__(self):
        joined = "|".join(f"(?P<{n}>{p})" for n, p in self.classes)
        object.__setattr__(self, "pattern", re.compile(joined, re.DOTALL | re.MULTILINE))


CPP = Language(
    "cpp",
    (
        ("comment", rf"/{GAP}/(?:(?=\n)|.*?[^\\](?=\n))|/\*\*/|/{GAP}\*.*?\*{GAP}/"),
        ("string", rf"(?<![0-9A-Fa-f]){CHARS}|{STRING}"),
        ("preprocessor", r"^[ \t]*\#.*?[^\\](?=\n)"),
        ("call", rf"(?P<call_name>{OPERATOR}|~?{WORD})\s*\("),
        ("block", rf"(?P<block_type>\b(?:class|struct|union|namespace))(?P<block_name>\s+{WORD}|(?=\s*\{{))"),
        ("mark", r"[<>{};:]"),
        ("blank", BLANK_LINE),
    ),
    function_renames=True,
)
CSHARP = Language(
    "cs",
    (
        ("comment", r"//(?:(?=\n)|.*?(?=\n))|/\*\*/|/\*.*?\*/"),
        ("string", f"{CHARS}|{STRING}"),
        ("preprocessor", r"^[ \t]*\#.*?(?=\n)"),
        ("call", rf"(?P<call_name>{OPERATOR}|(?:~\s*)?{WORD}{TYPES}(?:\s*\.\s*{WORD}{TYPES})*)\s*\("),
        ("accessor", r"(?P<accessor_name>get|set)\s*(?=\{)"),
        ("block", rf"(?P<block_type>\b(?:class|struct|namespace|interface))(?P<block_name>\s+{WORD}{TYPES})"),
        ("mark", r"[\[\]{};]"),
        ("blank", BLANK_LINE),
    ),
    squeeze=True,
)
JAVA = Language(
    "java",
    (
        ("comment", r"//(?:(?=\n)|.*?(?=\n))|/\*\*/|/\*.*?\*/"),
        ("string", f"{CHARS}|{STRING}"),
        ("call", r"(?P<call_name>@?[$A-Za-z_][$A-Za-z_0-9]*)\s*\("),
        ("block", r"(?P<block_type>\b(?:class|interface))(?P<block_name>\s+[$A-Za-z_][$A-Za-z_0-9]*)"),
        ("mark", r"[{};]"),
        ("blank", BLANK_LINE),
    ),
)
LANGUAGES: dict[str, Language] = {x.name: x for x in (CPP, CSHARP, JAVA)}
_TYPE_OF = {"union": "struct"}


@dataclass
class Region:
    name: str
    type: str
    begin: int
    cursor: int
    depth: int
    end: int = 0
    checksum: int = 0
    line_begin: int = 0
    line_end: int = 0
    region_id: int = 0
    parent_id: int | None = None
    children: list[Region] = field(default_factory=list)


class Parsed:
    """regions in pre-order with ids from 1, markers as (begin, end, kind), and the number of unmatched braces."""

    def __init__(self, language: Language, text: str):
        self.text = text
        self.markers: list[tuple[int, int, int]] = []
        self.errors: list[tuple[int, str]] = []
        self._breaks = [m.start() for m in re.finditer("\n", text)]
        stack = self._scan(language)
        for r in reversed(stack):
            self._finish(r, len(text))
        self.regions: list[Region] = []
        for r in stack:
            self._number(r)
        self._lines(stack)
        self._parents()

    def _line(self, at: int) -> int:
        return 1 + bisect_left(self._breaks, at)

    def _scan(self, language: Language) -> list[Region]:
        text, stack, depth = self.text, [Region("__global__", "global", 0, 0, 0)], 0
        name, begin, kind, cursor, sure, quiet = "", 0, "", 0, False, False  # of the next block

        def forget(at: int) -> tuple:
            return "", at, "", 0, False, False

        for m in language.pattern.finditer(text):
            token, at = m.lastgroup, m.start()
            if token in ("comment", "preprocessor"):
                self.markers.append((at, m.end(), SPAN_KINDS[token]))
            elif token == "string":
                self.markers.append((at + 1, m.end() - 1, SPAN_KINDS["string"]))
            elif token == "blank":
                begin = begin if name else m.end()
            elif token in ("call", "accessor"):
                found = m[f"{token}_name"]
                free = not name or (language.function_renames and kind != "function")
                if stack[-1].type != "function" and free and not quiet and found[0] != "@":
                    name, kind = found, "function"
                    cursor = self._line(m.start(f"{token}_name"))
            elif token == "block":
                if not name:
                    name, kind = m["block_name"].strip() or "__noname__", m["block_type"]
                    cursor = self._line(m.start("block_name"))
            elif (mark := text[at]) == ";":
                name, begin = "", m.end()
            elif mark in "[]":
                quiet = mark == "["  # attributes hold no function names
            elif mark == ">":
                if not sure and kind in ("class", "struct"):
                    name = ""  # it was a template parameter
            elif mark in "<:":
                sure = sure or kind in ("class", "struct")
            elif mark == "{":
                depth += 1
                if name:
                    squeezed = re.sub(r"\s+", "", name) if language.squeeze else name.strip()
                    stack.append(Region(squeezed, _TYPE_OF.get(kind, kind), begin, cursor, depth))
                    name, begin, kind, cursor, sure, quiet = forget(m.end())
                else:
                    begin = m.end()
            else:  # }
                if stack[-1].depth == depth:
                    name, begin, kind, cursor, sure, quiet = forget(m.end())
                    if len(stack) == 1:
                        self.errors.append((self._line(at), "closing bracket without an opening one"))
                        continue
                    done = stack.pop()
                    self._finish(done, m.end())
                    stack[-1].children.append(done)
                depth -= 1
                if depth < 0:
                    self.errors.append((self._line(at), "closing bracket without an opening one"))
                    depth = 0
        self.errors += [(self._line(len(text)), "opening bracket without a closing one")] * depth
        return stack

    def _finish(self, r: Region, end: int) -> None:
        if r.type != "global":
            r.begin += len(re.match(r"\s*", self.text[r.begin : end])[0])
        r.end, at = end, r.begin
        for c in r.children:
            r.checksum = zlib.crc32(self.text[at : c.begin].encode(errors="replace"), r.checksum)
            at = c.end
        r.checksum = zlib.crc32(self.text[at:end].encode(errors="replace"), r.checksum)

    def _number(self, r: Region) -> None:
        todo = [r]
        while todo:
            r = todo.pop()
            self.regions.append(r)
            r.region_id = len(self.regions)
            todo += reversed(r.children)

    def _lines(self, stack: list[Region]) -> None:
        """Lines are counted in the order of visits; only a forward step counts, which shows in unclosed regions."""
        line, last = 1, 0
        todo: list[tuple[Region, bool]] = [(r, False) for r in reversed(stack)]
        while todo:
            r, leaving = todo.pop()
            to = r.end if leaving else r.begin
            line += max(0, bisect_left(self._breaks, to) - bisect_left(self._breaks, last))
            last = to
            if leaving:
                r.line_end = line
            else:
                r.line_begin = line
                todo.append((r, True))
                todo += [(c, False) for c in reversed(r.children)]

    def _parents(self) -> None:
        """The parent is the innermost region before that isn't over yet: unclosed regions lie in others too."""
        open_: list[Region] = []
        for r in self.regions:
            r.children = []
            last = None
            while open_:
                last = open_.pop()
                if last.end > r.begin:
                    open_.append(last)
                    break
            open_.append(r)
            if last is not None:
                r.parent_id = last.region_id
                last.children.append(r)

    def file_spans(self) -> list[tuple[int, int, int]]:
        """(kind, begin, end) over the whole text; what lies between markers is code."""
        return self.inclusive_spans(0, len(self.text))

    def inclusive_spans(self, begin: int, end: int) -> list[tuple[int, int, int]]:
        """Spans of a region with its children: the markers that begin in it, and the code between."""
        out, at = [], begin
        for b, e, kind in self.markers:
            if begin <= b < end:
                if at < b:
                    out.append((SPAN_KINDS["code"], at, b))
                out.append((kind, b, e))
                at = e
        if at < end:
            out.append((SPAN_KINDS["code"], at, end))
        return out

    def exclusive_spans(self) -> list[list[tuple[int, int, int]]]:
        """For each region its spans without those of its children; a marker is the innermost region's it begins in."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.regions]
        at = k = 0

        def upto(own: list, end: int) -> None:
            nonlocal at, k
            while k < len(self.markers) and self.markers[k][0] < end:
                b, e, kind = self.markers[k]
                if at < b:
                    own.append((SPAN_KINDS["code"], at, b))
                own.append((kind, b, e))
                at, k = e, k + 1
            if at < end:
                own.append((SPAN_KINDS["code"], at, end))
            at = end

        todo: list[tuple[Region, int]] = [(self.regions[0], 0)]
        while todo:
            r, child = todo.pop()
            if child < len(r.children):
                c = r.children[child]
                upto(out[r.region_id - 1], c.begin)
                todo += [(r, child + 1), (c, 0)]
            else:
                upto(out[r.region_id - 1], r.end)
        return out


def tokenize(lang: str, text: str) -> Parsed:
    return Parsed(LANGUAGES[lang], text)


def region_rows(path: str, lang: str, text: str) -> list[tuple]:
    """Rows of schema.REGIONS: one for the file (region_id null, spans of the file), then the regions in pre-order."""
    p = tokenize(lang, text)

    def texts(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": k, "begin": b, "end": e, "text": text[b:e]} for k, b, e in spans]

    whole = p.regions[0]
    rows: list[tuple] = [(path, lang, None, None, None, None, 0, len(text), whole.line_begin, whole.line_end, None, zlib.crc32(text.encode(errors="replace")), len(p.errors), None, None, texts(p.file_spans()))]
    for r, spans in zip(p.regions, p.exclusive_spans()):
        children, inside = [REGION_TYPES[c.type] for c in r.children], sum(c.end - c.begin for c in r.children)
        rows.append((path, lang, r.region_id, r.parent_id, r.name, REGION_TYPES[r.type], r.begin, r.end, r.line_begin, r.line_end, r.cursor, r.checksum, None, children, inside, texts(spans)))
    return rows
