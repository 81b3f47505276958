"""Definitions of Java, Kotlin, Go, TypeScript, JavaScript, Rust, C#, PHP and Ruby files, by declaration heads.

Comments and texts are blanked first. What stands between two of the marks `;`, `{` and `}` outside of
parentheses is a head; a table of patterns by language says which heads declare something. Braces (in Ruby,
the words that go with `end`) give a declaration its extent and its scope. Heads are read in one pass and
sources that don't close their braces give what was read so far, so broken files never raise.

Rows have the form of Python's definitions. Kinds that hold others give their name to qualified names, which
begin with the package, else with the path. A function within such a kind is a method. start_line is the line
of the declaration without annotations; a doc comment is the last comment before it, if it begins as the
language's doc comments do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from .python_source import DEFINITIONS  # noqa: F401  the schema of these rows too

# Kinds whose names are part of the qualified names of what they hold.
CONTAINERS = frozenset({"class", "interface", "enum", "struct"})
VISIBILITIES = ("private", "protected", "public")

ANNOTATION = r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?"
PARAMETERS = r"(?P<params>\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))"
GENERIC = r"(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?"
JAVA_TYPE = rf"[\w.]+\s*{GENERIC}(?:\s*\[\s*\])*"


@dataclass(frozen=True)
class Form:
    """A pattern over a whole head: groups mods, name, params and returns; ends are the marks that may close it."""

    kind: str
    pattern: str
    ends: str = "{"
    member: bool = False  # only directly within a container

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.S))


def _mods(words: str, annotated: bool = False) -> str:
    one = rf"(?:{words})\b" + (rf"|{ANNOTATION}" if annotated else "")
    return rf"^(?P<mods>(?:(?:{one})\s*)*)"


_JAVA = _mods("public|protected|private|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default|transient", True)
_KOTLIN = _mods("public|protected|private|internal|open|abstract|final|sealed|data|inner|enum|annotation|value|override|suspend|inline|infix|operator|tailrec|external|companion|expect|actual|lateinit|const|fun(?=\\s+interface)", True)
_SCRIPT = rf"(?P<mods>(?:{ANNOTATION}\s*)*)(?P<export>(?:(?:export|default|declare)\s+)*)"
_SHARP = r"^(?P<attributes>(?:\[[^\]]*\]\s*)*)(?P<mods>(?:(?:public|protected|private|internal|static|abstract|sealed|partial|virtual|override|async|extern|unsafe|readonly|new|ref|file)\s+)*)"
_PHP = _mods("public|protected|private|static|abstract|final|readonly")
_RUST = r"^(?:#!?\[[^\]]*\]\s*)*(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)"
_JS_METHOD = rf"(?:^|\n)\s*(?:{ANNOTATION}\s*)*(?P<mods>(?:(?:public|protected|private|static|abstract|async|override|readonly|get|set)\s+|\*\s*)*)(?!(?:if|for|while|switch|catch|function|return|with|do)\b)(?P<name>#?[\w$]+)\s*\??\s*{GENERIC}\s*{PARAMETERS}\s*(?::\s*(?P<returns>[^=]+?))?\s*$"
_CLASS_TAIL = r"\b(?P<rest>.*)$"


@dataclass(frozen=True)
class Language:
    name: str
    suffixes: tuple[str, ...]
    forms: tuple[Form, ...]
    doc: tuple[str, ...] = ("/**", "///")
    package: str | None = None
    comments: str = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    texts: str = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    annotated: bool = False  # annotations are decorators


_CLASS_FORMS = (
    Form("class", rf"^{_SCRIPT}(?:abstract\s+)?class\s+(?P<name>[\w$]+){_CLASS_TAIL}"),
    Form("function", rf"(?:^|\n)\s*(?P<export>(?:(?:export|default|declare)\s+)*)(?P<mods>(?:async\s+)?)function\s+(?P<name>[\w$]+)\s*{GENERIC}\s*{PARAMETERS}\s*(?::\s*(?P<returns>[^=]+?))?\s*$"),
)
_SCRIPT_TEXTS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'

# Suffixes, kinds and doc marks by language.
LANGUAGES: tuple[Language, ...] = (
    Language(
        "java",
        (".java",),
        (
            Form("class", rf"{_JAVA}(?:class|record)\s+(?P<name>\w+)\s*{GENERIC}\s*(?P<params>\([^{{}}]*\))?(?P<rest>.*)$"),
            Form("interface", rf"{_JAVA}interface\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("enum", rf"{_JAVA}enum\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("method", rf"{_JAVA}{GENERIC}\s*(?P<returns>(?!(?:return|new|else|throw|case)\b){JAVA_TYPE})\s+(?P<name>\w+)\s*{PARAMETERS}\s*(?:throws\s+[\w.,\s]+|default\b.*)?$", "{;", True),
            Form("constructor", rf"{_JAVA}{GENERIC}\s*(?P<name>\w+)\s*{PARAMETERS}\s*(?:throws\s+[\w.,\s]+)?$", "{", True),
        ),
        package=r"^\s*package\s+([\w.]+)",
        texts=r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
        annotated=True,
    ),
    Language(
        "kotlin",
        (".kt", ".kts"),
        (
            Form("class", rf"{_KOTLIN}(?:class|interface)\s+(?P<name>\w+){_CLASS_TAIL}", "{\n;"),
            Form("function", rf"{_KOTLIN}fun\s+{GENERIC}\s*(?:[\w<>.?]+\.)?(?P<name>\w+)\s*{PARAMETERS}\s*(?::\s*(?P<returns>[^={{]+?))?\s*(?:=.*)?$", "{\n;"),
        ),
        package=r"^\s*package\s+([\w.]+)",
        texts=r'"""(?:[^"]|"(?!""))*"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
        annotated=True,
    ),
    Language(
        "go",
        (".go",),
        (
            Form("function", rf"(?:^|\n)(?P<mods>)func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*{PARAMETERS}[^;]*$"),
            Form("method", rf"(?:^|\n)(?P<mods>)func\s*\([^()]*\)\s*(?P<name>\w+)\s*{PARAMETERS}[^;]*$"),
            Form("type", r"(?:^|\n)(?P<mods>)type\s+(?P<name>\w+)\b[^;]*$", "{\n;"),
        ),
        doc=("//",),
        texts=r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])*\'',
    ),
    Language("typescript", (".ts",), (*_CLASS_FORMS, Form("interface", rf"^{_SCRIPT}interface\s+(?P<name>[\w$]+){_CLASS_TAIL}"), Form("method", _JS_METHOD, "{", True)), texts=_SCRIPT_TEXTS, annotated=True),
    Language("tsx", (".tsx",), (*_CLASS_FORMS, Form("method", _JS_METHOD, "{", True)), texts=_SCRIPT_TEXTS, annotated=True),
    Language("javascript", (".js", ".jsx", ".mjs"), (*_CLASS_FORMS, Form("method", _JS_METHOD, "{", True)), texts=_SCRIPT_TEXTS, annotated=True),
    Language(
        "rust",
        (".rs",),
        (
            Form("function", rf"{_RUST}fn\s+(?P<name>\w+)\s*{GENERIC}\s*{PARAMETERS}\s*(?:->\s*(?P<returns>.+?))?\s*(?:\bwhere\b.*)?$"),
            Form("struct", rf"{_RUST}struct\s+(?P<name>\w+){_CLASS_TAIL}", "{;"),
            Form("interface", rf"{_RUST}trait\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("impl", rf"{_RUST}impl\s*{GENERIC}\s*!?(?P<name>[A-Za-z_]\w*){_CLASS_TAIL}"),
        ),
        doc=("///", "/**", "//!"),
        texts=r'r(?P<h>#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'',
    ),
    Language(
        "csharp",
        (".cs",),
        (
            Form("class", rf"{_SHARP}class\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("interface", rf"{_SHARP}interface\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("struct", rf"{_SHARP}struct\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("method", rf"{_SHARP}(?P<returns>(?!(?:return|new|else|throw|class|struct|interface|namespace|using)\b){JAVA_TYPE}\??)\s+(?P<name>\w+)\s*{GENERIC}\s*{PARAMETERS}\s*(?:where\b.*|=>.*)?$", "{;", True),
        ),
        package=r"^\s*namespace\s+([\w.]+)",
        texts=r'\$?@"(?:""|[^"])*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    ),
    Language(
        "php",
        (".php",),
        (
            Form("class", rf"{_PHP}class\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("interface", rf"{_PHP}interface\s+(?P<name>\w+){_CLASS_TAIL}"),
            Form("method", rf"{_PHP}function\s+&?\s*(?P<name>\w+)\s*{PARAMETERS}\s*(?::\s*(?P<returns>.+?))?\s*$", "{;", True),
            Form("function", rf"^(?P<mods>)function\s+&?\s*(?P<name>\w+)\s*{PARAMETERS}\s*(?::\s*(?P<returns>.+?))?\s*$"),
        ),
        comments=r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|<\?(?:php|=)?|\?>",
    ),
    Language("ruby", (".rb",), (), doc=("#",), comments=r"\#[^\n]*|^=begin\b.*?^=end\b"),
)
BY_SUFFIX = {suffix: x for x in LANGUAGES for suffix in x.suffixes}
SUFFIXES = tuple(BY_SUFFIX)
_BLANKS = {x.name: re.compile(rf"(?P<comment>{x.comments})|(?:{x.texts})", re.S | re.M) for x in LANGUAGES}


def language_of(path: str) -> Language | None:
    return BY_SUFFIX.get(PurePosixPath(path).suffix.lower())


def blanked(text: str, language: Language) -> tuple[str, list[tuple[int, int]]]:
    """text with comments and the insides of its texts as spaces (line ends stay), and where comments stand."""
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        found = m[0]
        if m["comment"] is not None:
            comments.append(m.span())
            return re.sub(r"[^\n]", " ", found)
        return found[0] + re.sub(r"[^\n]", " ", found[1:-1]) + found[-1] if len(found) > 1 else found

    return _BLANKS[language.name].sub(blank, text), comments


def clean_comment(raw: str) -> str:
    """A comment without its marks, line by line."""
    body = raw.removeprefix("/*").removesuffix("*/") if raw.startswith("/*") else raw
    lines = [re.sub(r"^(///|//!|//|\*|#)", "", line.strip()).strip() for line in body.splitlines()]
    return "\n".join(lines).strip()


@dataclass
class Found:
    """A declaration: where its node begins, where it is declared and where it ends (exclusive)."""

    kind: str
    name: str
    start: int
    declared: int
    end: int
    mods: str = ""
    params: str | None = None
    returns: str | None = None
    decorators: list[str] = field(default_factory=list)
    holder: "Found | None" = None
    doc: str | None = None


def _declared(language: Language, code: str, text: str, head: tuple[int, int], mark: str, holder: Found | None) -> Found | None:
    """What the head declares, the first form that fits."""
    start, end = head
    lead = len(code[start:end]) - len(code[start:end].lstrip())
    start += lead
    piece = code[start:end].rstrip()
    if not piece:
        return None
    for form in language.forms:
        if mark not in form.ends or (form.member and not (holder and holder.kind in CONTAINERS)):
            continue
        m = form.compiled.search(piece)
        if not m:
            continue
        groups = m.groupdict()
        if form.kind == "constructor" and groups["name"] != holder.name:
            continue
        begin = start + m.start() + len(m[0]) - len(m[0].lstrip())
        if groups.get("export"):
            begin += m.start("export") + len(groups["export"]) - (len(m[0]) - len(m[0].lstrip())) - m.start()
        exported = bool(groups.get("export"))
        at = m.start("name")
        head_mods = piece[m.start() : at]
        marks = [text[start + x.start() : start + x.end()] for x in re.finditer(ANNOTATION, piece[:at])] if language.annotated else []
        if language.name not in ("java", "kotlin") and (exported or form.kind == "method"):
            marks = []
        # Annotations, and in Java and Kotlin all modifiers, stand before the line of the declaration.
        own = groups["mods"] if language.name in ("java", "kotlin") else "".join(x + " " for x in re.findall(ANNOTATION, groups["mods"])) if language.annotated else ""
        declared = start + m.end("mods") if own and language.annotated else begin
        while declared < len(code) and code[declared].isspace():
            declared += 1
        params = groups.get("params")
        span = m.span("params") if params is not None else None
        kind = "method" if form.kind == "constructor" else form.kind
        returns = groups.get("returns")
        mods = groups["mods"] if language.name in ("java", "kotlin") else re.sub(ANNOTATION, "", head_mods) if language.annotated else head_mods
        return Found(
            kind, groups["name"], begin, declared, end, mods.lower(), " ".join(text[start + span[0] : start + span[1]].split()) if span else None,
            " ".join(returns.split()) if returns else None, [x.lstrip("@").strip() for x in marks], holder,
        )
    return None


#: What begins a new head after a line end, where the language ends declarations by it.
_NEXT_HEAD = re.compile(r"\s*(?:(?:public|private|internal|protected|open|abstract|data|sealed|override|suspend|inline|enum|fun|class|interface|val|var|object|type|func|import|package|const)\b|@|\}|\Z)")


def _heads(code: str, language: Language) -> Iterator[tuple[str, int, int]]:
    """(mark, start of the head, place of the mark) for each `{`, `}` and `;` outside of parentheses; a line end counts where the language ends declarations by it."""
    by_line = any("\n" in form.ends for form in language.forms)
    depth, start = 0, 0
    saved: list[tuple[int, int]] = []
    for m in re.finditer(r"[(){};\[\]]|\n" if by_line else r"[(){};\[\]]", code):
        mark, at = m[0], m.start()
        if mark in "([":
            depth += 1
        elif mark in ")]":
            depth = max(depth - 1, 0)
        elif mark == "{":
            yield "{" if not depth else "(", start, at
            saved.append((depth, start))
            depth, start = 0, at + 1
        elif mark == "}":
            yield "}", start, at
            depth, outer = saved.pop() if saved else (0, at + 1)
            start = outer if depth else at + 1
        elif not depth:
            if mark == "\n" and not _NEXT_HEAD.match(code, at):
                continue
            yield mark, start, at
            start = at + 1


def _blocks(code: str, text: str, language: Language) -> list[Found]:
    out: list[Found] = []
    open_: list[Found | None] = []
    for mark, start, at in _heads(code, language):
        holder = next((x for x in reversed(open_) if x), None)
        direct = open_[-1] if open_ else None
        if mark in "{;\n":
            found = _declared(language, code, text, (start, at), mark, direct if direct and direct.kind in CONTAINERS else None)
            if found:
                found.holder = holder
                found.end = at + (mark == ";")
                out.append(found)
        if mark == "{":
            open_.append(found)
        elif mark == "(":
            open_.append(None)
        elif mark == "}" and open_:
            closed = open_.pop()
            if closed:
                closed.end = at + 1
    for x in open_:
        if x:
            x.end = len(code.rstrip())
    return out


_RUBY = re.compile(
    r"^[ \t]*(?:(?P<kind>class|module|def)\b(?:[ \t]+(?P<name>[\w:.?!=<>\[\]+*/%-]+))?[ \t]*(?P<params>\([^)]*\)|(?<=\S)[ \t]+[^;\n<=][^;\n]*)?|(?:if|unless|while|until|case|for|begin)\b)|=[ \t]*(?:if|unless|case|begin|while)\b|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$|(?<![.:\w])(?P<end>end)\b(?!:)",
    re.M,
)


def _ruby(code: str, text: str) -> list[Found]:
    """Classes, modules and methods; methods of a singleton (def self.x) give no row."""
    out: list[Found] = []
    open_: list[Found | None] = []
    loop_line = -1
    for m in _RUBY.finditer(code):
        word = m[0].strip()
        if m["end"]:
            if open_ and (closed := open_.pop()):
                closed.end = m.end()
            continue
        line = code.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip()))
        if word.startswith("do"):
            if line == loop_line:  # the do of a while line
                continue
            open_.append(None)
            continue
        if re.match(r"(?:while|until|for)\b", word):
            loop_line = line
        found = None
        name = m["name"]
        if m["kind"] and name and not (m["kind"] == "def" and "." in name) and not name.startswith("<<"):
            begin = m.start("kind")
            holder = next((x for x in reversed(open_) if x), None)
            span = m.span("params") if m["kind"] == "def" and m["params"] else None
            params = " ".join(text[span[0] : span[1]].split()) if span else None
            found = Found("method" if m["kind"] == "def" else m["kind"], name.rpartition("::")[2] if m["kind"] != "def" else name, begin, begin, len(code.rstrip()), m["kind"], params, holder=holder)
            out.append(found)
        open_.append(found)
        if m["kind"] == "def" and re.match(r"[^\n]*\)?[ \t]=[ \t]", code[m.end() :]):  # a method of one line has no end
            open_.pop()
    return out


def definitions(path: str, text: str) -> Iterator[dict]:
    language = language_of(path)
    if language is None:
        return
    code, comments = blanked(text, language)
    found = _ruby(code, text) if language.name == "ruby" else _blocks(code, text, language)
    package = re.search(language.package, code, re.M) if language.package else None
    base = package[1] if package else ".".join(PurePosixPath(path).with_suffix("").parts)
    line_ends = [m.start() for m in re.finditer("\n", text)]
    k, doc_at = 0, 0

    def place(at: int) -> tuple[int, int]:
        n = bisect_left(line_ends, at)
        return n + 1, len(text[line_ends[n - 1] + 1 if n else 0 : at].encode())

    for x in found:
        scope, up, in_container = [], x.holder, False
        while up:
            if up.kind in CONTAINERS:
                in_container = True
                scope.insert(0, up.name)
            up = up.holder
        kind = "method" if x.kind == "function" and in_container else x.kind
        before = x.start
        if language.name in ("typescript", "tsx", "javascript"):  # a doc comment stands before the words that export
            before -= len(re.search(r"(?:(?:export|default|declare)\s+)*$", code[: x.start])[0])
        while doc_at < len(comments) and comments[doc_at][1] <= before:
            doc_at += 1
        doc = None
        if doc_at and not code[comments[doc_at - 1][1] : before].strip():
            raw = text[slice(*comments[doc_at - 1])].strip()
            doc = clean_comment(raw) or None if raw.startswith(language.doc) else None
        (first, col), (last, end_col) = place(x.start), place(x.end)
        signature = None if x.params is None else f"{x.params} -> {x.returns}" if x.returns else x.params
        yield {
            "source_file": path, "ord": k, "name": x.name, "kind": kind, "qualified_name": ".".join([base, *scope, x.name]), "start_line": place(x.declared)[0], "end_line": last, "start_col": col, "end_col": end_col,
            "signature": signature, "docstring": doc, "decorators": x.decorators, "is_async": "async" in x.mods, "is_static": "static" in x.mods, "is_abstract": "abstract" in x.mods,
            "visibility": next((v for v in VISIBILITIES if v in x.mods), "private" if x.name.startswith("_") else "public"), "bases": [], "returns": None,
        }
        k += 1
