"""Parsers: one source's text to its atoms (kind, parent, breadcrumb, start and end byte, text)."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field


@dataclass
class Atom:
    kind: str
    text: str
    breadcrumb: str
    start: int
    end: int
    parent: int = -1
    start_line: int = 0
    end_line: int = 0
    name: str = ""
    leading: str = ""
    signature: str = ""
    references: list[str] = field(default_factory=list)


def _offsets(text: str) -> list[int]:
    """Byte offset of each character, and of the end."""
    if text.isascii():
        return list(range(len(text) + 1))
    out, at = [], 0
    for c in text:
        out.append(at)
        at += len(c.encode())
    return [*out, at]


def parse_text(text: str, title: str) -> list[Atom]:
    """The document and a paragraph for each run of lines between blank ones; offsets leave line ends out."""
    at = _offsets(text)
    out = [Atom("document", text, title, 0, at[-1])]
    for m in re.finditer(r"[^\r\n]*\S[^\r\n]*(?:\r?\n[^\r\n]*\S[^\r\n]*)*", text):
        out.append(Atom("paragraph", m[0], title, at[m.start()], at[m.end()], 0))
    return out


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r"^ {0,3}>")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")


def parse_markdown(text: str, title: str) -> list[Atom]:
    """Headings, paragraphs, lists with their items, block quotes and code blocks, under a stack of headings.

    A heading inside a list or a quote belongs to it and does not change the stack. Blocks of HTML and tables count as paragraphs.
    """
    at = _offsets(text)
    lines, pos = [], 0
    for raw in text.splitlines(keepends=True):
        lines.append((pos, raw.rstrip("\r\n")))
        pos += len(raw)
    out = [Atom("document", text, title, 0, at[-1])]
    stack: list[tuple[int, str, int]] = []

    def crumb() -> str:
        return " > ".join([title, *(name for _, name, _ in stack)])

    def parent() -> int:
        return stack[-1][2] if stack else 0

    def emit(kind: str, first: int, last: int, up: int | None = None) -> int:
        s, e = lines[first][0], lines[last][0] + len(lines[last][1])
        out.append(Atom(kind, text[s:e], crumb(), at[s], at[e], parent() if up is None else up, first + 1, last + 1))
        return len(out) - 1

    def starts_block(line: str) -> bool:
        return bool(not line.strip() or _FENCE.match(line) or _HEADING.match(line) or _ITEM.match(line) or _QUOTE.match(line))

    i = 0
    while i < len(lines):
        line = lines[i][1]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[j][1]):
                j += 1
            emit("code_block", i, min(j, len(lines) - 1))
            i = j + 1
        elif m := _HEADING.match(line):
            level, name = len(m[1]), (m[2] or "").strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            up = parent()
            stack.append((level, name, len(out)))
            emit("heading", i, i, up)
            i += 1
        elif _ITEM.match(line):
            j, items = i, []
            while j < len(lines):
                now = lines[j][1]
                if m := _ITEM.match(now):
                    items.append(j)
                elif not now.strip():
                    if j + 1 >= len(lines) or not (lines[j + 1][1].startswith("  ") or _ITEM.match(lines[j + 1][1])):
                        break
                elif not now.startswith(" ") and starts_block(now):
                    break
                j += 1
            end = j - 1
            while not lines[end][1].strip():
                end -= 1
            up = emit("list", i, end)
            for k, first in enumerate(items):
                last = (items[k + 1] if k + 1 < len(items) else end + 1) - 1
                while not lines[last][1].strip():
                    last -= 1
                emit("list_item", first, last, up)
            i = j
        elif _QUOTE.match(line):
            j = i
            while j < len(lines) and (_QUOTE.match(lines[j][1]) or not starts_block(lines[j][1])):
                j += 1
            emit("block_quote", i, j - 1)
            i = j
        else:
            j = i + 1
            while j < len(lines) and not starts_block(lines[j][1]) and not _UNDERLINE.match(lines[j][1]):
                j += 1
            if j < len(lines) and (m := _UNDERLINE.match(lines[j][1])):
                level, name = 1 if m[1][0] == "=" else 2, " ".join(x.strip() for _, x in lines[i:j])
                while stack and stack[-1][0] >= level:
                    stack.pop()
                up = parent()
                stack.append((level, name, len(out)))
                emit("heading", i, j, up)
                i = j + 1
            else:
                emit("paragraph", i, j - 1)
                i = j
    return out


EXTENSIONS = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "java": "java", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "gd": "gdscript", "tscn": "godot", "tres": "godot",
}
FILE_NAMES = {"Gemfile": "ruby", "Rakefile": "ruby"}
SHEBANGS = [("python", "python"), ("node", "javascript"), ("ruby", "ruby"), ("php", "php"), ("bash", "shell"), ("sh", "shell")]

# Per language: (pattern of a line, atom kind, group of the name). The first that fits counts.
_ID = r"[A-Za-z_]\w*"
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [(rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+\"\w+\"\s+)*fn\s+(?P<n>{_ID})", "function"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(?P<n>{_ID})", "class"),
             (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:trait|mod|type)\s+(?P<n>{_ID})", "module"), (r"\s*(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*(?P<n>[^{;]+?)\s*(?:where\b[^{]*)?\{", "module"),
             (r"\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<n>[^;]+)", "import"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static(?:\s+mut)?)\s+(?P<n>{_ID})", "declaration"), (rf"\s*macro_rules!\s*(?P<n>{_ID})", "declaration")],
    "javascript": [(rf"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>{_ID})", "function"), (rf"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(?P<n>{_ID})", "class"),
                   (rf"\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>", "function"), (rf"\s*(?:export\s+)?(?:type|enum)\s+(?P<n>{_ID})", "declaration"), (r"\s*import\s+(?P<n>.+)", "import"),
                   (rf"\s*exports\.(?P<n>{_ID})\s*=", "function"), (r"\s+(?:static\s+|async\s+|public\s+|private\s+|protected\s+)*(?!if|for|while|switch|catch|return|function\b)(?P<n>[\w$]+)\s*\([^;]*\)\s*(?::[^{]+)?\{\s*$", "function")],
    "go": [(rf"func\s+\(\s*\w*\s*\*?(?P<r>{_ID})[^)]*\)\s*(?P<n>{_ID})", "function"), (rf"func\s+(?P<n>{_ID})", "function"), (rf"type\s+(?P<n>{_ID})\s+(?:struct|interface)\b", "class"), (rf"type\s+(?P<n>{_ID})", "declaration"),
           (r"import\s+(?P<n>.+)", "import"), (rf"(?:const|var)\s+(?P<n>{_ID})", "declaration")],
    "java": [(rf"\s*(?:[\w@]+\s+)*(?:class|interface|enum|record|@interface)\s+(?P<n>{_ID})", "class"), (r"import\s+(?:static\s+)?(?P<n>[\w.*]+)", "import"),
             (rf"\s+(?!return|new|else|throw)(?:[\w<>\[\],.?@]+\s+)+(?P<n>{_ID})\s*\([^;]*\)\s*(?:throws[^{{]+)?\{{", "function"), (rf"\s+(?:public\s+|protected\s+|private\s+)(?P<n>{_ID})\s*\([^;]*\{{", "function")],
    "c": [(r"\s*#\s*include\s+(?P<n>\S+)", "import"), (rf"\s*#\s*define\s+(?P<n>{_ID})", "declaration"), (rf"\s*(?:typedef\s+)?(?:struct|union|enum)\s+(?P<n>{_ID})\s*\{{?", "class"),
          (rf"(?!\s*(?:if|for|while|switch|return|else)\b)[\w*&:<>,~\s]+?\b(?P<n>~?{_ID}(?:::~?{_ID})*)\s*\([^;{{]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{", "function")],
    "ruby": [(r"\s*def\s+(?P<n>(?:self\.)?[\w?!=]+)", "function"), (r"\s*class\s+(?P<n>[A-Z][\w:]*)", "class"), (r"\s*module\s+(?P<n>[A-Z][\w:]*)", "module"), (r"\s*(?:require|require_relative|load)\s+(?P<n>.+)", "import")],
    "php": [(rf"\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<n>{_ID})", "function"), (rf"\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+(?P<n>{_ID})", "class"), (r"\s*namespace\s+(?P<n>[\w\\]+)", "module"), (r"\s*(?:use|include|include_once|require|require_once)\s+(?P<n>[^;]+)", "import")],
    "shell": [(r"\s*(?:function\s+)?(?P<n>[\w-]+)\s*\(\)\s*\{?", "function"), (r"\s*function\s+(?P<n>[\w-]+)", "function"), (r"\s*(?:source|\.)\s+(?P<n>[^\s$]+)\s*$", "import")],
    "gdscript": [(rf"\s*(?:static\s+)?func\s+(?P<n>{_ID})", "function"), (rf"\s*class\s+(?P<n>{_ID})", "class"), (r"\s*extends\s+(?P<n>\"[^\"]+\")", "import"), (rf"\s*(?:class_name|signal|enum|const|@?export\s+var|@onready\s+var|var)\s+(?P<n>{_ID})", "declaration")],
    "godot": [(r"\[node\s+name=\"(?P<n>[^\"]+)\".*", "class"), (r"\[(?:resource|sub_resource|connection)\b(?P<n>.*)\]", "declaration")],
}
RULES["typescript"] = RULES["javascript"]
RULES["cpp"] = [(rf"\s*(?:class|namespace)\s+(?P<n>{_ID})[^;]*\{{", "class"), *RULES["c"]]
RULES["csharp"] = [(r"\s*using\s+(?P<n>[\w.]+)\s*;", "import"), (r"\s*namespace\s+(?P<n>[\w.]+)", "module"), *RULES["java"]]
_COMMENT = {"python": "#", "ruby": "#", "shell": "#", "gdscript": "#", "godot": ";"}
MAX_REFERENCES = 64


def language_of(locator: str, text: str) -> str | None:
    """By file name, extension, or the interpreter that the first line names."""
    base = locator.rpartition("/")[2]
    if base in FILE_NAMES:
        return FILE_NAMES[base]
    if "." in base:
        return EXTENSIONS.get(base.rpartition(".")[2].lower())
    first = text[:256].partition("\n")[0]
    return next((lang for word, lang in SHEBANGS if word in first), None) if first.startswith("#!") else None


def _references(text: str) -> list[str]:
    return sorted({x for x in re.findall(_ID, text) if len(x) <= 100})[:MAX_REFERENCES]


def _leading(lines: list[str], first: int, mark: str) -> str:
    """Comment lines right above a line, with no blank line between."""
    k = first
    while k > 0 and (s := lines[k - 1].strip()) and (s.startswith((mark, "/*", "*", "@", "#[")) if mark == "//" else s.startswith((mark, "@"))):
        k -= 1
    return "\n".join(lines[k:first])


def _python_spans(text: str) -> list[tuple[str, str, int, int]] | None:
    """(kind, name, first line, last line) from the syntax tree, outer ones first; None if it has errors."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: list[tuple[str, str, int, int]] = []

    def walk(node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            kind = "function" if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) else "class" if isinstance(x, ast.ClassDef) else "import" if isinstance(x, ast.Import) else None
            if kind == "import":
                out.append((kind, ", ".join(a.name for a in x.names), x.lineno - 1, x.end_lineno - 1))
            elif kind:
                out.append((kind, x.name, x.lineno - 1, x.end_lineno - 1))
            walk(x)

    walk(tree)
    return out


def _block_end(lines: list[str], first: int, lang: str) -> int:
    """The last line of the block that starts at a line: by braces, ``end`` words, or indentation."""
    if lang in ("gdscript",):
        depth = len(lines[first]) - len(lines[first].lstrip())
        last = first
        for k in range(first + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= depth:
                    break
                last = k
        return last
    if lang == "godot":
        return next((k - 1 for k in range(first + 1, len(lines)) if lines[k].startswith("[")), len(lines) - 1)
    if lang == "ruby":
        indent = len(lines[first]) - len(lines[first].lstrip())
        return next((k for k in range(first + 1, len(lines)) if lines[k].strip() == "end" and len(lines[k]) - len(lines[k].lstrip()) == indent), first)
    depth, opened = 0, False
    for k in range(first, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*$", "", lines[k])
        depth += bare.count("{") - bare.count("}")
        opened |= "{" in bare
        if opened and depth <= 0 or not opened and bare.rstrip().endswith(";"):
            return k
        if not opened and k - first > 8:
            return first
    return first if not opened else len(lines) - 1


def parse_code(text: str, locator: str) -> list[Atom]:
    """The file and an atom for each symbol, nested by lines; nothing but the file for unknown languages."""
    lang = language_of(locator, text)
    out = [Atom("file", text, locator, 0, len(text.encode()), -1, 1, text.count("\n") + 1)]
    if lang is None:
        return out
    lines = text.split("\n")
    spans = _python_spans(text) if lang == "python" else None
    if spans is None:
        rules = [(re.compile(p), k) for p, k in RULES.get(lang, [(rf"\s*(?:async\s+)?def\s+(?P<n>{_ID})", "function"), (rf"\s*class\s+(?P<n>{_ID})", "class"), (r"\s*import\s+(?P<n>.+)", "import")])]
        spans = []
        for i, line in enumerate(lines):
            for pattern, kind in rules:
                if m := pattern.match(line):
                    groups = m.groupdict()
                    name = f"{groups['r']}.{groups['n']}" if groups.get("r") else groups["n"]
                    spans.append((kind, name.strip(), i, i if kind in ("import", "declaration") and lang not in ("godot",) else _block_end(lines, i, lang)))
                    break
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line.encode()) + 1
    open_: list[tuple[int, int]] = []
    for kind, name, first, last in sorted(spans, key=lambda s: (s[2], -s[3])):
        while open_ and open_[-1][1] < first:
            open_.pop()
        up = open_[-1][0] if open_ else 0
        body = "\n".join(lines[first : last + 1])
        out.append(Atom(kind, body, f"{out[up].breadcrumb} > {name}", starts[first], starts[last] + len(lines[last].encode()), up, first + 1, last + 1, name, _leading(lines, first, _COMMENT.get(lang, "//")), lines[first].split("{")[0].strip(), _references(body)))
        open_.append((len(out) - 1, last))
    return out
