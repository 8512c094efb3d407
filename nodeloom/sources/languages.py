"""Extraction of declarations, imports and calls for many languages from one description each.

A :class:`Language` says how types, functions, imports and calls are written and how a body ends;
:func:`extractor` turns it into a function for ``extractors.EXTRACTORS``. Comments and strings are
blanked first, declarations are found by expression, bodies by bracket or keyword matching, and
what lies inside what follows from the bodies. No grammar is needed; what a language allows but
nobody writes on one line with its name may be missed, never invented.
"""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from nodeloom.functions.ids import make_id_py

Row = tuple[str, str | None, str | None, str | None, str | None, int]
_NAME = r"[A-Za-z_$][\w$]*"
_GENERIC = r"(?:\s*<[^{}();]*?>)?"
_LIST = r"[\w$.:,<>\[\]&\s]+?"
_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_C_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_CONTROL = "if for while switch catch return function elif else unless until do when match with sizeof typeof instanceof new await yield throw and or not in is case foreach using lock synchronized super this assert defined".split()


@dataclass(frozen=True)
class Language:
    """Expressions name their parts: ``name``, ``bases`` (inherited), ``interfaces``
    (implemented), ``owner`` (a type named apart from the body)."""

    types: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    #: Functions only where they lie directly in a type.
    methods: tuple[str, ...] = ()
    #: Bodies that belong to a type declared elsewhere: ``owner`` with ``bases`` or ``interfaces``.
    extensions: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    comment: str = _C_COMMENT
    string: str = _C_STRING
    #: "{}", "indent", "next" (up to the next function), or (opening, closing) expressions.
    block: str | tuple[str, str] = "{}"
    calls: tuple[str, ...] = (rf"(?<![\w$@#])(?P<name>{_NAME}[!?]?){_GENERIC}\s*\(",)
    #: Functions whose names are strings.
    quoted: tuple[str, ...] = ()
    #: Bases named like ``IName`` are interfaces.
    marked_interfaces: bool = False
    flags: int = re.M


def file_id(path: str) -> str:
    parts = path.rsplit("/", 2)
    return make_id_py(*parts[-2:-1], parts[-1].rsplit(".", 1)[0])


def module_id(path: str, name: str) -> str:
    """Id of what an import names: a file for a relative or path-like name, else the module."""
    name = name.strip().strip("\"'<>").removeprefix("package:")
    if name.startswith("."):
        return file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), name)) + ("" if re.search(r"\.\w+$", posixpath.basename(name)) else ".x"))
    return file_id(name) if re.search(r"\.(h|hh|hpp|cuh|rb|php|ps1|psm1|psd1|dart|dm|inc|zig|jl|R|lua)$", name) else make_id_py(re.split(r"\s+as\s+|\s*=", name)[0])


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _brackets(code: str) -> list[tuple[int, int]]:
    """(start, end) of all bodies in braces, by start."""
    open_at, out = [], []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_at.append(m.start())
        elif open_at:
            out.append((open_at.pop(), m.end()))
    return sorted(out + [(a, len(code)) for a in open_at])


def _keyword_end(code: str, at: int, latest: int, opening: str, closing: str, flags: int) -> int | None:
    """End of the body that opens from ``at`` to ``latest``; None if none does."""
    depth = 0
    for m in re.compile(f"(?P<close>{closing})|(?P<open>{opening})", flags).finditer(code, at):
        if not depth and (m["open"] is None or m.start() > latest):
            return None
        depth += 1 if m["open"] is not None else -1
        if not depth:
            return m.end()
    return len(code) if depth else None


def _indent_end(code: str, at: int) -> int:
    line = code.rfind("\n", 0, at) + 1
    depth = len(code[line:at]) - len(code[line:at].lstrip())
    for m in re.finditer(r"\n([ \t]*)(?=\S)", code[at:]):
        if len(m[1]) <= depth:
            return at + m.start()
    return len(code)


@dataclass
class _Declared:
    at: int
    text_end: int
    name: str
    kind: str  # type, function, extension
    match: re.Match
    end: int = 0
    id: str = ""


def _group(m: re.Match, name: str) -> str | None:
    return m.groupdict().get(name)


def _names(text: str | None) -> list[str]:
    """Names of a list of types, without their arguments."""
    text = re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", re.sub(r"<[^<>]*>", "", text or ""))
    words = (re.sub(r"^(?:public|private|protected|virtual|final|readonly)\s+", "", x.strip()) for x in re.split(r",|&|\bwith\b|\+", text))
    return [re.split(r"[.:\s\\]+", w)[-1] for w in words if re.match(r"[A-Za-z_\\:.]", w)]


def extractor(lang: Language) -> Callable[[str, str], list[Row]]:
    """Function (path, text) -> rows as ``extractors.extract`` expects them."""
    compiled = {k: [re.compile(p, lang.flags) for p in getattr(lang, k)] for k in ("types", "functions", "methods", "extensions", "imports", "calls", "quoted")}
    both = re.compile(f"({lang.comment})|({lang.string})", re.S | re.M)

    def declared(code: str, quiet: str) -> list[_Declared]:
        found: dict[int, _Declared] = {}
        for kind, key in (("extension", "extensions"), ("type", "types"), ("function", "functions"), ("method", "methods"), ("method", "quoted")):
            for m in (m for p in compiled[key] for m in p.finditer(quiet if key == "quoted" else code)):
                name = _group(m, "name") or _group(m, "owner") or ""
                at = m.start("name") if _group(m, "name") else m.start("owner")
                if name and name not in _CONTROL:
                    found.setdefault(at, _Declared(at, m.end(), name, kind, m))
        return [found[k] for k in sorted(found)]

    def bodies(code: str, all_: list[_Declared]) -> None:
        spans = _brackets(code)
        starts = [a for a, _ in spans]
        for i, d in enumerate(all_):
            nearest = all_[i + 1].at if i + 1 < len(all_) else len(code)
            line_end = code.find("\n", d.text_end)
            d.end = d.text_end if line_end < 0 else line_end
            found = None
            if lang.block == "indent":
                found = _indent_end(code, d.at)
            elif lang.block == "next":
                found = nearest if d.kind != "type" else _keyword_end(code, d.at, d.text_end, r"\brecord\b|=\s*(?:packed\s+)?(?:class|object|interface)\b(?!\s*(?:;|of\b))|\bcase\b|\bbegin\b", r"\bend\b", re.I)
            elif lang.block != "{}":
                found = _keyword_end(code, d.match.start(), d.end, *lang.block, lang.flags)
            k = bisect_right(starts, max(d.at, d.text_end - 2))
            if found is None and k < len(spans) and starts[k] < nearest and not re.search("[;}]", code[d.text_end : starts[k]]):
                found = spans[k][1]
            d.end = d.end if found is None else found

    def extract(path: str, text: str) -> list[Row]:
        fid = file_id(path)
        rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
        quiet = both.sub(lambda m: _blank(m) if m[1] is not None else m[0], text)
        code = both.sub(lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[2] is not None else _blank(m), text)
        breaks = [m.start() for m in re.finditer("\n", text)]
        line = lambda at: bisect_right(breaks, at - 1) + 1
        all_ = declared(code, quiet)
        bodies(code, all_)
        scope: list[_Declared] = []
        kept: list[_Declared] = []
        seen = {fid}
        for d in all_:
            while scope and scope[-1].end <= d.at:
                scope.pop()
            above = scope[-1] if scope else None
            in_type = above is not None and above.kind != "function"
            if d.kind == "method" and not in_type:
                continue
            d.kind = "function" if d.kind == "method" else d.kind
            owner = _group(d.match, "owner")
            parent = make_id_py(fid, owner) if owner and d.kind == "function" else above.id if above else fid
            method = d.kind == "function" and (in_type or bool(owner))
            if d.kind == "extension":
                d.id = make_id_py(fid, d.name)
            else:
                d.id = make_id_py(parent, d.name)
                label = d.name if d.kind == "type" else f".{d.name}()" if method else f"{d.name}()"
                if d.id not in seen:
                    seen.add(d.id)
                    rows.append(("node", d.id, label, None, None, line(d.at)))
                rows.append(("edge", d.id, None, parent, "method" if method else "contains", line(d.at)))
            if d.kind != "function":
                for group, relation in (("bases", "inherits"), ("interfaces", "implements")):
                    for x in _names(_group(d.match, group)):
                        marked = lang.marked_interfaces and re.match("I[A-Z]", x)
                        rows.append(("edge", make_id_py(x), None, d.id, "implements" if marked else relation, line(d.at)))
            kept.append(d)
            if d.end > d.at:
                scope.append(d)
        for p in compiled["imports"]:
            for m in p.finditer(quiet):
                relation = "re_exports" if m[0].lstrip().startswith("export") else "imports_from" if re.search(r"\bfrom\b", m[0]) else "imports"
                for name in re.split(r"\s*,\s*", m["name"]) if relation == "imports" and not re.search(r"[\"'<]", m["name"]) else [m["name"]]:
                    rows.append(("edge", module_id(path, name), None, fid, relation, line(m.start())))
        functions, own = [d for d in kept if d.kind == "function"], {d.at for d in kept}
        at = [d.at for d in functions]
        for m in (m for p in compiled["calls"] for m in p.finditer(code)):
            k = bisect_right(at, m.start("name")) - 1
            while k >= 0 and functions[k].end <= m.start("name"):
                k -= 1
            if k < 0 or m.start("name") in own or m["name"] in _CONTROL:
                continue
            before = code[max(0, m.start("name") - 3) : m.start("name")].rstrip()
            rows.append(("member_call" if before.endswith((".", "->", "::", ":")) else "call", None, m["name"], functions[k].id, "calls", line(m.start("name"))))
        return rows

    return extract


_INHERIT = rf"(?:\s+extends\s+(?P<bases>{_LIST}))?(?:\s+implements\s+(?P<interfaces>{_LIST}))?\s*(?=\{{)"
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|partial|readonly|open|inline|suspend|synchronized|native|extern|unsafe|global|lazy|implicit|data|inner|infix|operator|tailrec|external|webservice|transient|testMethod)\s+)*"
_TYPED_METHOD = rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}(?:<[^>(]+>\s+)?(?:[\w$.<>\[\],?]+(?:\s*,\s*[\w<>\[\]?]+)*\s+)?(?P<name>{_NAME})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?\s*(?=\{{|;|=>)"

JAVASCRIPT = Language(
    types=(rf"\b(?:class|interface|enum|namespace)\s+(?P<name>{_NAME}){_GENERIC}{_INHERIT}", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{_NAME})[^=\n]*="),
    functions=(rf"\bfunction\s*\*?\s*(?P<name>{_NAME}){_GENERIC}\s*\(", rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=>{{}}]+)?=>|{_NAME}\s*=>)", rf"\b(?:module\.)?exports\.(?P<name>{_NAME})\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>)"),
    methods=(rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*\*?(?P<name>#?{_NAME}){_GENERIC}\s*\([^;{{}}]*\)\s*(?::[^{{;=]+)?\s*(?=\{{)", rf"^[ \t]+(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>{_NAME})\s*=\s*(?:async\s*)?\([^()]*\)\s*(?::[^=>{{}}]+)?=>"),
    imports=(r"\bimport\s+(?:type\s+)?(?:[\w$*{},\s]+?\s+from\s+)?[\"'](?P<name>[^\"']+)[\"']", r"\bexport\s+(?:type\s+)?[\w$*{},\s]+?\s+from\s+[\"'](?P<name>[^\"']+)[\"']", r"\b(?:require|import)\s*\(\s*[\"'](?P<name>[^\"']+)[\"']\s*\)"),
    string=_C_STRING + r"|`(?:[^`\\]|\\.)*`",
)
GO = Language(
    types=(rf"^type\s+(?P<name>{_NAME}){_GENERIC}(?:\[[^\]\n]*\])?\s+(?:struct|interface)\b", rf"^type\s+(?P<name>{_NAME})\s+=?\s*[\w.\[\]*]+\s*$"),
    functions=(rf"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>{_NAME})(?:\[[^\]]*\])?\s*\(",),
    imports=(r"^import\s+(?:[\w.]+\s+)?(?P<name>\"[^\"]+\")", r"^\s+(?:[\w.]+\s+)?(?P<name>\"[\w./~-]+\")\s*$"),
    string=_C_STRING + r"|`[^`]*`",
)
RUST = Language(
    types=(rf"\b(?:struct|enum|union)\s+(?P<name>{_NAME}){_GENERIC}", rf"\btrait\s+(?P<name>{_NAME}){_GENERIC}(?:\s*:\s*(?P<bases>[\w:+<>\s]+?))?\s*(?:where[^{{]*)?(?=\{{)", rf"\btype\s+(?P<name>{_NAME}){_GENERIC}\s*=", rf"^\s*(?:pub\s+)?mod\s+(?P<name>{_NAME})\s*(?=\{{)", rf"\bmacro_rules!\s*(?P<name>{_NAME})"),
    functions=(rf"\bfn\s+(?P<name>{_NAME}){_GENERIC}\s*\(",),
    extensions=(rf"\bimpl{_GENERIC}\s+(?:(?P<interfaces>[\w:]+){_GENERIC}\s+for\s+)?(?:&?(?:mut\s+)?)(?:\w+::)*(?P<owner>{_NAME}){_GENERIC}\s*(?:where[^{{]*)?(?=\{{)",),
    imports=(r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+)", r"^\s*extern\s+crate\s+(?P<name>\w+)"),
    string=r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.[^']*)'",
)
JAVA = Language(
    types=(rf"\b(?:class|interface|enum|@interface)\s+(?P<name>{_NAME}){_GENERIC}{_INHERIT}", rf"\brecord\s+(?P<name>{_NAME}){_GENERIC}\s*\([^{{}}]*\)(?:\s+implements\s+(?P<interfaces>{_LIST}))?\s*(?=\{{)"),
    methods=(_TYPED_METHOD,),
    imports=(r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;",),
)
APEX = Language(
    types=JAVA.types + (rf"^\s*(?i:trigger)\s+(?P<name>{_NAME})\s+(?i:on)\s+(?P<bases>\w+)\s*\([^)]*\)\s*(?=\{{)",), methods=JAVA.methods, flags=re.M | re.I,
)
GROOVY = Language(
    types=JAVA.types + (rf"\btrait\s+(?P<name>{_NAME}){_INHERIT}",),
    functions=(rf"^\s*def\s+(?:static\s+)?(?P<name>{_NAME})\s*\([^)]*\)\s*(?=\{{)",),
    methods=JAVA.methods,
    quoted=(r"^\s*(?:def|void)\s+(?P<q>[\"'])(?P<name>[^\n]+?)(?P=q)\s*\(\)\s*(?=\{)",),
    imports=(r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)",),
)
C = Language(
    types=(rf"\b(?:struct|union|enum)\s+(?P<name>{_NAME})\s*(?=\{{)", rf"\}}\s*(?P<name>{_NAME})\s*;"),
    functions=(rf"^(?!\s*(?:return|else|typedef|#))[ \t]*(?:[\w*&:<>,~]+[\s*&]+)+(?P<name>{_NAME})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?=\{{)",),
    imports=(r"^\s*#\s*include\s*(?P<name>[<\"][^>\"\n]+[>\"])",),
)
CPP = Language(
    types=(rf"\b(?:class|struct|union)\s+(?:\w+\s+)?(?P<name>{_NAME})(?:\s+final)?(?:\s*:\s*(?P<bases>{_LIST}))?\s*(?=\{{)", rf"\benum\s+(?:class\s+)?(?P<name>{_NAME})[^;{{}}]*(?=\{{)", rf"\bnamespace\s+(?P<name>{_NAME})\s*(?=\{{)"),
    functions=(rf"^[ \t]*(?!return\b|else\b|delete\b|#)(?:[\w*&:<>,~]+[\s*&]+)*(?P<owner>{_NAME})(?:<[^>]*>)?::(?P<name>~?{_NAME})\s*\([^;{{}}]*\)[^;{{}}]*?(?=\{{)", *C.functions, rf"^[ \t]*__global__\s+\w+\s+(?P<name>{_NAME})\s*\("),
    methods=(rf"^[ \t]+(?!return\b|else\b|delete\b)(?:[\w*&:<>,]+[\s*&]+)*(?P<name>~?{_NAME})\s*\([^;{{}}]*\)[^;{{}}=]*?(?=\{{|;)",),
    imports=C.imports,
    calls=(rf"(?<![\w$@#])(?P<name>{_NAME})(?:\s*<[\w\s,:]*>)?\s*(?:<<<[^;]*?>>>)?\s*\(",),
)
OBJC = Language(
    types=(rf"@interface\s+(?P<name>{_NAME})(?:\s*:\s*(?P<bases>\w+))?(?:\s*<(?P<interfaces>[\w,\s]+)>)?", rf"@protocol\s+(?P<name>{_NAME})(?:\s*<(?P<bases>[\w,\s]+)>)?(?![^\n]*;)"),
    extensions=(rf"@implementation\s+(?P<owner>{_NAME})",),
    functions=(C.functions[0],),
    methods=(rf"^\s*[-+]\s*\([^)]*\)\s*(?P<name>{_NAME})",),
    imports=(r"^\s*#\s*(?:import|include)\s*(?P<name>[<\"][^>\"\n]+[>\"])", r"^\s*@import\s+(?P<name>[\w.]+)"),
    block=(r"@interface|@protocol(?![^\n]*;)|@implementation", r"@end"),
    calls=(*C.calls, r"\[\s*(?:[\w.]+|\[[^\[\]]*\])\s+(?P<name>\w+)"),
)
RUBY = Language(
    types=(r"^\s*class\s+(?:\w+::)*(?P<name>\w+)(?:\s*<\s*(?P<bases>[\w:]+))?", r"^\s*module\s+(?:\w+::)*(?P<name>\w+)"),
    functions=(r"^\s*(?:\w+\s+)?def\s+(?:self\.)?(?P<name>\w+[!?=]?)",),
    imports=(r"^\s*require(?:_relative)?\s*\(?\s*[\"'](?P<name>[^\"']+)[\"']",),
    comment=r"(?<![\w\"'])#[^\n{]*|^=begin.*?^=end",
    block=(r"(?<![.\w:])(?:class|module|def|begin|case|do)(?![\w:?])|(?:^|(?<=[;=]))[ \t]*(?:if|unless|while|until)\b", r"(?<![.\w:])end(?![\w:?])"),
    calls=(r"(?<![\w$@#])(?P<name>[a-z_]\w*[!?]?)\s*\(", r"(?<=\.)(?P<name>[a-z_]\w*[!?]?)(?!\s*[\w(=])"),
)
CSHARP = Language(
    marked_interfaces=True,
    types=(rf"\b(?:class|interface|struct|record(?:\s+(?:class|struct))?)\s+(?P<name>{_NAME}){_GENERIC}(?:\s*\([^{{}};]*\))?(?:\s*:\s*(?P<bases>{_LIST}))?\s*(?:where[^{{]*)?(?=\{{|;)", rf"\benum\s+(?P<name>{_NAME})", rf"^\s*namespace\s+(?P<name>[\w.]+)"),
    methods=(_TYPED_METHOD,),
    imports=(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;",),
)
KOTLIN = Language(
    types=(rf"\b(?:class|interface|object)\s+(?P<name>{_NAME}){_GENERIC}(?:\s*(?:private\s+|internal\s+)?(?:constructor\s*)?\([^{{}}]*?\))?(?:[ \t]*:\s*(?P<bases>[\w.<>,()\s&]+?))?\s*(?=\{{|$)", rf"\btypealias\s+(?P<name>{_NAME})"),
    functions=(rf"\bfun\s+(?:<[^>]+>\s+)?(?:(?P<owner>{_NAME}){_GENERIC}\??\.)?(?P<name>{_NAME})\s*\(",),
    imports=(r"^\s*import\s+(?P<name>[\w.]+(?:\.\*)?)",),
)
SCALA = Language(
    types=(rf"\b(?:class|trait|object|enum)\s+(?P<name>{_NAME})(?:\s*\[[^\]]*\])?(?:\s*\([^{{}}]*?\))*(?:\s+extends\s+(?P<bases>[\w.\[\],()\s]+?(?:\s+with\s+[\w.\[\],\s]+?)*))?\s*(?=\{{|:?$)",),
    functions=(rf"\bdef\s+(?P<name>{_NAME})",),
    imports=(r"^\s*import\s+(?P<name>[\w.]+)",),
)
PHP = Language(
    types=(rf"\b(?:class|interface|trait|enum)\s+(?P<name>{_NAME})(?:\s*:\s*\w+)?(?:\s+extends\s+(?P<bases>[\w\\,\s]+?))?(?:\s+implements\s+(?P<interfaces>[\w\\,\s]+?))?\s*(?=\{{)",),
    functions=(rf"\bfunction\s+&?(?P<name>{_NAME})\s*\(",),
    imports=(r"^\s*use\s+(?:function\s+|const\s+)?(?P<name>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?[\"'](?P<name>[^\"']+)[\"']"),
    comment=r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/",
)
SWIFT = Language(
    types=(rf"\b(?:class|struct|enum|protocol|actor)\s+(?P<name>{_NAME}){_GENERIC}(?:\s*:\s*(?P<bases>{_LIST}))?\s*(?:where[^{{]*)?(?=\{{)",),
    functions=(rf"\bfunc\s+(?P<name>{_NAME}){_GENERIC}\s*\(", r"\b(?P<name>init)[?!]?\s*\(", r"\b(?P<name>deinit)\s*(?=\{)"),
    extensions=(rf"\bextension\s+(?:\w+\.)*(?P<owner>{_NAME}){_GENERIC}(?:\s*:\s*(?P<interfaces>{_LIST}))?\s*(?:where[^{{]*)?(?=\{{)",),
    imports=(r"^\s*(?:@testable\s+)?import\s+(?:(?:class|struct|func|enum|protocol)\s+)?(?P<name>[\w.]+)",),
)
ELIXIR = Language(
    types=(r"\b(?:defmodule|defprotocol)\s+(?P<name>[\w.]+)",),
    functions=(r"^\s*(?:def|defp|defmacro|defmacrop|defguard)\s+(?P<name>[a-z_]\w*[!?]?)",),
    extensions=(r"\bdefimpl\s+(?P<interfaces>[\w.]+),\s*for:\s*(?P<owner>[\w.]+)",),
    imports=(r"^\s*(?:import|alias|use|require)\s+(?P<name>[A-Z][\w.]*)",),
    comment=r"#[^\n{]*", string=r"\"\"\".*?\"\"\"|" + _C_STRING,
    block=(r"\bdo\b(?!:)|\bfn\b", r"\bend\b"),
)
JULIA = Language(
    types=(r"^\s*(?:mutable\s+)?struct\s+(?P<name>\w+)(?:\{[^}]*\})?(?:\s*<:\s*(?P<bases>[\w.]+))?", r"^\s*abstract\s+type\s+(?P<name>\w+)(?:\s*<:\s*(?P<bases>[\w.]+))?", r"^\s*module\s+(?P<name>\w+)"),
    functions=(r"^\s*function\s+(?:\w+\.)*(?P<name>\w+!?)", r"^(?P<name>\w+!?)\([^)\n]*\)(?:::\w+)?\s*=(?!=)", r"^\s*macro\s+(?P<name>\w+)"),
    imports=(r"^\s*(?:using|import)\s+(?P<name>[\w.]+(?:\s*,\s*[\w.]+)*)", r"\binclude\(\s*(?P<name>\"[^\"]+\")"),
    comment=r"#=.*?=#|#[^\n]*",
    block=(r"^\s*(?:mutable\s+struct|struct|abstract\s+type|module|function|macro|if|for|while|begin|let|try|quote)\b|\bdo\b", r"(?<![\w\[:])end\b"),
)
FORTRAN = Language(
    types=(r"^[ \t]*(?:sub)?module\s+(?!procedure\b)(?P<name>\w+)", r"^[ \t]*program\s+(?P<name>\w+)", r"^[ \t]*type\s*(?:,\s*(?:extends\s*\(\s*(?P<bases>\w+)\s*\)|[\w\s]+))*\s*(?:::)?\s*(?P<name>\w+)[ \t]*$"),
    functions=(r"^[ \t]*(?!end\b)(?:[\w()*=,]+[ \t]+)*(?:subroutine|function)\s+(?P<name>\w+)",),
    imports=(r"^[ \t]*use\s*(?:,\s*\w+\s*)?(?:::)?\s*(?P<name>\w+)", r"^[ \t]*#?include\s+(?P<name>[\"'<][^\"'>]+[\"'>])"),
    comment=r"![^\n]*", string=r"\"[^\"\n]*\"|'[^'\n]*'",
    block=(r"^[ \t]*(?!end\b)(?:[\w()*=]+[ \t]+)*(?:subroutine|function)\s+\w+|^[ \t]*(?:sub)?module\s+(?!procedure)\w+|^[ \t]*program\s+\w+|^[ \t]*type\s*(?:,[^:\n]*)?(?:::)?\s*\w+[ \t]*$", r"^[ \t]*end\s*(?:subroutine|function|(?:sub)?module|program|type)\b[^\n]*|^[ \t]*end[ \t]*$"),
    calls=(r"\bcall\s+(?:\w+\s*%\s*)?(?P<name>\w+)",), flags=re.M | re.I,
)
POWERSHELL = Language(
    types=(r"^\s*(?:class|enum)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w,\s]+?))?\s*(?=\{)",),
    functions=(r"\b(?:function|filter)\s+(?:\w+:)?(?P<name>[\w-]+)",),
    methods=(r"^\s*(?:(?:static|hidden)\s+)*(?:\[[\w\[\].]+\]\s*)?(?P<name>\w+)\s*\([^)]*\)\s*(?=\{)",),
    imports=(r"^\s*(?:Import-Module|using\s+(?:module|namespace))\s+(?:-Name\s+)?(?P<name>[\"']?[\w./\\-]+[\"']?)", r"^\s*\.\s+(?P<name>[\"']?[\w$./\\-]+\.ps1[\"']?)"),
    comment=r"<#.*?#>|#[^\n]*", string=r"\"(?:[^\"`]|`.)*\"|'[^'\n]*'",
    calls=(r"(?<![\w-])(?P<name>[A-Za-z]+-[A-Za-z]\w*)(?![\w-])", r"(?<=[.:])(?P<name>\w+)\s*\("), flags=re.M | re.I,
)
DREAMMAKER = Language(
    types=(r"^(?P<name>/?(?:datum|obj|mob|turf|area|atom|client|world|image|icon)(?:/(?!proc\b|verb\b)\w+)*)\s*$",),
    functions=(r"^(?P<owner>/?(?:\w+/)*?\w+)/(?:proc|verb)/(?P<name>\w+)\s*\(", r"^\s+(?:proc|verb)/(?P<name>\w+)\s*\(", r"^/?proc/(?P<name>\w+)\s*\(", r"^(?P<owner>/(?:\w+/)*\w+)/(?P<name>\w+)\s*\("),
    methods=(r"^\s+(?P<name>\w+)\s*\([^)\n]*\)\s*$",),
    imports=(r"^\s*#include\s+(?P<name>[\"<][^\">\n]+[\">])",), block="indent",
)
VERILOG = Language(
    types=(r"^\s*(?:module|interface(?!\s+class)|program|package)\s+(?:automatic\s+)?(?P<name>\w+)", r"^\s*(?:virtual|interface)?\s*(?:virtual\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>\w+))?"),
    functions=(r"^\s*(?:virtual\s+|static\s+|local\s+)*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)*?(?P<name>\w+)\s*[(;]",),
    imports=(r"^\s*`include\s+(?P<name>\"[^\"]+\")", r"^\s*import\s+(?P<name>\w+)::"),
    block=(r"^\s*(?:module|interface|program|package|(?:virtual\s+)?class|(?:virtual\s+|static\s+|local\s+)*(?:function|task))\b", r"\bend(?:module|interface|program|package|class|function|task)\b"),
    string=r"\"(?:[^\"\\\n]|\\.)*\"",
)
PASCAL = Language(
    types=(r"^\s*(?P<name>\w+)\s*=\s*(?:packed\s+)?(?:class|record|interface|object)\b(?:\s*\((?P<bases>[\w.,\s]+)\))?(?!\s*;)",),
    functions=(r"^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?:(?P<owner>\w+)\.)?(?P<name>\w+)",),
    imports=(r"\buses\s+(?P<name>[\w.]+(?:\s+in\s+'[^']*')?(?:\s*,\s*[\w.]+(?:\s+in\s+'[^']*')?)*)\s*;", r"\{\$I(?:NCLUDE)?\s+(?P<name>[\w./\\]+)\}"),
    comment=r"//[^\n]*|\{(?!\$).*?\}|\(\*.*?\*\)", string=r"'(?:[^'\n]|'')*'", block="next", flags=re.M | re.I,
)
DART = Language(
    types=(rf"\b(?:class|mixin|enum)\s+(?P<name>{_NAME}){_GENERIC}(?:\s+extends\s+(?P<bases>{_LIST}(?:\s+with\s+{_LIST})?))?(?:\s+(?:implements|on)\s+(?P<interfaces>{_LIST}))?\s*(?=\{{)", rf"\btypedef\s+(?P<name>{_NAME})"),
    functions=(rf"^(?!\s)(?:[\w<>\[\]?,]+\s+)?(?P<name>{_NAME})\s*\([^;]*?\)\s*(?:async\*?\s*)?(?=\{{|=>)",),
    methods=(rf"^[ \t]+(?:(?:static|final|const|factory|external|@override)\s+)*(?:[\w<>\[\]?,]+\s+)?(?:get\s+)?(?P<name>{_NAME})(?:\.\w+)?\s*(?:\([^;{{}}]*\))?\s*(?::[^{{;]+)?(?:async\*?\s*)?(?=\{{|=>)",),
    extensions=(rf"\bextension\s+\w*\s*on\s+(?P<owner>{_NAME}){_GENERIC}\s*(?=\{{)",),
    imports=(r"^\s*(?:import|export|part)\s+(?:of\s+)?[\"'](?P<name>[^\"']+)[\"']",),
)
LUA = Language(
    functions=(r"\bfunction\s+(?:(?P<owner>\w+)[.:])?(?P<name>\w+)\s*\(", r"\b(?:local\s+)?(?P<name>\w+)\s*=\s*function\b"),
    types=(r"^(?:export\s+)?type\s+(?P<name>\w+)(?:<[^>]*>)?\s*=",),
    imports=(r"\brequire\s*\(?\s*[\"'](?P<name>[^\"']+)[\"']",), comment=r"--\[\[.*?\]\]|--[^\n]*",
    block=(r"\b(?:function|do|then)\b|\brepeat\b", r"\bend\b|\buntil\b|\b(?=elseif\b)"),
)
ZIG = Language(
    types=(r"\bconst\s+(?P<name>\w+)\s*=\s*(?:extern\s+|packed\s+)?(?:struct|enum|union|opaque|error)\b",), functions=(r"\bfn\s+(?P<name>\w+)\s*\(",),
    imports=(r"@import\(\s*(?P<name>\"[^\"]+\")",), comment=r"//[^\n]*",
)
R = Language(functions=(r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\(",), imports=(r"^\s*(?:library|require)\(\s*[\"']?(?P<name>[\w.]+)", r"\bsource\(\s*(?P<name>\"[^\"]+\")"), comment=r"#[^\n]*")

_script = extractor(JAVASCRIPT)


def component(path: str, text: str) -> list[Row]:
    """Astro, Svelte and Vue: front matter and script parts as TypeScript, and the components that
    the markup uses."""
    scripts = [m for m in re.finditer(r"\A---\r?\n(.*?)^---|<script\b[^>]*>(.*?)</script>", text, re.S | re.M)]
    kept = re.sub(r"[^\n]", " ", text)
    for m in scripts:
        k = 1 if m[1] is not None else 2
        kept = kept[: m.start(k)] + m[k] + kept[m.end(k) :]
    rows, fid = _script(path, kept), file_id(path)
    markup = re.sub(r"\A---.*?^---|<(script|style)\b.*?</\1>", _blank, text, flags=re.S | re.M)
    used = {m[1]: text.count("\n", 0, m.start()) + 1 for m in reversed(list(re.finditer(r"<([A-Z]\w*)", markup)))}
    return rows + [("call", None, name, fid, "uses", n) for name, n in sorted(used.items(), key=lambda x: (x[1], x[0]))]


def terraform(path: str, text: str) -> list[Row]:
    """Blocks as nodes, references between them within the folder."""
    fid, code = file_id(path), re.sub(r"#[^\n]*|//[^\n]*|/\*.*?\*/", _blank, text, flags=re.S)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    module, spans = make_id_py(*posixpath.dirname(path).rsplit("/", 1)[-1:]), _brackets(code)
    known, blocks = set(), []
    for m in re.finditer(r'^(resource|data|module|variable|output|provider|locals)\b[ \t]*((?:"[^"\n]*"[ \t]*)*)\{', code, re.M):
        names = re.findall(r'"([^"]*)"', m[2])
        prefix = {"resource": [], "variable": ["var"], "locals": ["local"]}.get(m[1], [m[1]])
        end = next((b for a, b in spans if a == m.end() - 1), len(code))
        labels = [".".join([*prefix, *names])] if m[1] != "locals" else [f"local.{x}" for x in re.findall(r"^\s*(\w+)\s*=", code[m.end() : end], re.M)]
        for label in labels:
            nid, line = make_id_py(module, label), code.count("\n", 0, m.start()) + 1
            known.add(label)
            rows += [("node", nid, label, None, None, line), ("edge", nid, None, fid, "contains", line)]
            blocks.append((nid, m.end(), end))
    for nid, a, b in blocks:
        for x in dict.fromkeys(re.findall(r"\b((?:var|local|module)\.\w+|data\.\w+\.\w+|[a-z]+_\w+\.\w+)", code[a:b])):
            target = make_id_py(module, x)
            if target != nid:
                rows.append(("edge", target, None, nid, "references", code.count("\n", 0, a) + 1))
    return rows


def dotnet_project(path: str, text: str) -> list[Row]:
    """Project files: references to projects and packages, target frameworks; an SLNX's projects."""
    fid = file_id(path)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text))
    for e in root.iter():
        inc = e.get("Include") or e.get("Path")
        if e.tag in ("ProjectReference", "Project") and inc:
            rows.append(("edge", file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), inc.replace("\\", "/")))), None, fid, "contains" if e.tag == "Project" else "imports", 1))
        elif e.tag == "PackageReference" and inc:
            nid = make_id_py("nuget", inc)
            rows += [("node", nid, inc, None, None, 1), ("edge", nid, None, fid, "imports", 1)]
        elif e.tag in ("TargetFramework", "TargetFrameworks") and e.text:
            for x in e.text.split(";"):
                rows += [("node", make_id_py("framework", x), x, None, None, 1), ("edge", make_id_py("framework", x), None, fid, "references", 1)]
    return rows


def solution(path: str, text: str) -> list[Row]:
    """Projects of a solution and what they depend on."""
    fid = file_id(path)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    ids: dict[str, str] = {}
    for n, line in enumerate(text.splitlines(), 1):
        m = re.match(r'Project\("\{[^}]*\}"\)\s*=\s*"([^"]*)",\s*"([^"]*)",\s*"\{([^}]*)\}"', line.strip())
        if m and "." in m[2]:
            nid = ids[m[3].upper()] = file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), m[2].replace("\\", "/"))))
            rows += [("node", nid, m[1], None, None, n), ("edge", nid, None, fid, "contains", n)]
    for block in re.findall(r'"\{([^}]*)\}"\s*\r?\n(?:(?!EndProject\b).)*?ProjectSection\(ProjectDependencies\)[^\n]*\n(.*?)EndProjectSection', text, re.S):
        for dep in re.findall(r"\{([^}]*)\}\s*=", block[1]):
            if block[0].upper() in ids and dep.upper() in ids:
                rows.append(("edge", ids[dep.upper()], None, ids[block[0].upper()], "imports", 1))
    return rows


_csharp = extractor(CSHARP)


def razor(path: str, text: str) -> list[Row]:
    """Directives, components used, and the members of code blocks."""
    fid = file_id(path)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    for n, line in enumerate(text.splitlines(), 1):
        m = re.match(r"\s*@(using|inject|inherits|model)\s+([\w.<>]+)", line)
        if m:
            rows.append(("edge", make_id_py(m[2]), None, fid, {"using": "imports", "inherits": "inherits"}.get(m[1], "references"), n))
        rows += [("call", None, x, fid, "uses", n) for x in re.findall(r"<([A-Z]\w*)", line)]
    for m in re.finditer(r"@code\s*\{", text):
        end = next((b for a, b in _brackets(text) if a == m.end() - 1), len(text))
        inner = "\n" * text.count("\n", 0, m.start()) + "class Code {" + text[m.end() : end]
        rows += [r for r in _csharp(path, inner) if r[0] != "node" or r[2] not in (path.rsplit("/", 1)[-1], "Code")]
    return rows


def form(path: str, text: str) -> list[Row]:
    """Delphi and Lazarus forms: components by nesting, event handlers as calls."""
    fid = file_id(path)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    above = [fid]
    for n, line in enumerate(text.splitlines(), 1):
        made = re.match(r"\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*(\w+)", line)
        event = re.match(r"\s*(On\w+)\s*=\s*(\w+)\s*$", line)
        if made:
            nid = make_id_py(above[-1], made[1])
            rows += [("node", nid, made[1], None, None, n), ("edge", nid, None, above[-1], "contains", n), ("edge", make_id_py(made[2]), None, nid, "references", n)]
            above.append(nid)
        elif event:
            rows.append(("call", None, event[2], above[-1], "calls", n))
        elif line.strip() == "end" and len(above) > 1:
            above.pop()
    return rows


def lazarus_package(path: str, text: str) -> list[Row]:
    fid = file_id(path)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    root = ET.fromstring(text)
    for e in root.iter():
        if e.tag == "Filename" and e.get("Value"):
            rows.append(("edge", file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), e.get("Value")))), None, fid, "contains", 1))
        elif e.tag == "PackageName" and e.get("Value"):
            rows += [("node", make_id_py("package", e.get("Value")), e.get("Value"), None, None, 1), ("edge", make_id_py("package", e.get("Value")), None, fid, "imports", 1)]
    return rows


def dm_map(path: str, text: str) -> list[Row]:
    """Types placed on a DreamMaker map, or windows and elements of its interface file."""
    fid = file_id(path)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    if path.endswith(".dmf"):
        above = fid
        for n, line in enumerate(text.splitlines(), 1):
            m = re.match(r"\s*(window|elem|menu|macro)\s+\"([^\"]+)\"", line)
            if m:
                parent = above if m[1] == "elem" else fid
                nid = make_id_py(parent, m[2])
                rows += [("node", nid, m[2], None, None, n), ("edge", nid, None, parent, "contains", n)]
                above = nid if m[1] != "elem" else above
        return rows
    placed = dict.fromkeys(re.findall(r"(?<![\w\"])(/(?:obj|mob|turf|area|datum)(?:/\w+)*)", text))
    return rows + [("edge", make_id_py(x), None, fid, "uses", 1) for x in placed]


def ps_manifest(path: str, text: str) -> list[Row]:
    """A PowerShell module manifest: its root, nested and required modules and exported functions."""
    fid = file_id(path)
    rows: list[Row] = [("node", fid, path.rsplit("/", 1)[-1], None, None, 1)]
    code = re.sub(r"<#.*?#>|#[^\n]*", _blank, text, flags=re.S)
    for key, relation in (("RootModule", "imports"), ("NestedModules", "imports"), ("RequiredModules", "imports"), ("FunctionsToExport", "references")):
        m = re.search(rf"(?:^|[{{;])\s*{key}\s*=\s*(@\((.*?)\)|[^\n]+)", code, re.S | re.M)
        for x in re.findall(r"[\"']([^\"'*]*[A-Za-z][^\"'*]*)[\"']", m[1]) if m else []:
            rows.append(("edge", module_id(path, x) if relation == "imports" else make_id_py(x), None, fid, relation, code.count("\n", 0, m.start()) + 1))
    return rows


#: Suffixes of each language.
SUFFIXES: dict[str, Callable[[str, str], list[Row]]] = {
    s: f
    for f, suffixes in (
        (_script, ".js .jsx .mjs .cjs .ejs .ts .tsx .mts .cts"), (extractor(GO), ".go"), (extractor(RUST), ".rs"), (extractor(JAVA), ".java"), (extractor(C), ".c .h"), (extractor(CPP), ".cc .cpp .cxx .hpp .hh .cu .cuh"),
        (extractor(RUBY), ".rb"), (_csharp, ".cs"), (extractor(KOTLIN), ".kt .kts"), (extractor(SCALA), ".scala"), (extractor(PHP), ".php"), (extractor(SWIFT), ".swift"), (extractor(ELIXIR), ".ex .exs"), (extractor(OBJC), ".m .mm"),
        (extractor(JULIA), ".jl"), (extractor(FORTRAN), ".f .f90 .f95 .f03 .f08"), (extractor(POWERSHELL), ".ps1 .psm1"), (ps_manifest, ".psd1"), (extractor(GROOVY), ".groovy .gradle"), (extractor(DREAMMAKER), ".dm"), (dm_map, ".dmm .dmf"),
        (extractor(APEX), ".cls .trigger"), (extractor(VERILOG), ".v .sv .svh"), (terraform, ".tf .tfvars .hcl"), (dotnet_project, ".csproj .fsproj .vbproj .slnx"), (solution, ".sln"), (razor, ".razor .cshtml"),
        (extractor(PASCAL), ".pas .pp .dpr .lpr"), (form, ".dfm .lfm"), (lazarus_package, ".lpk"), (extractor(DART), ".dart"), (component, ".astro .svelte .vue"), (extractor(LUA), ".lua .luau"), (extractor(ZIG), ".zig"), (extractor(R), ".r"),
    )
    for s in suffixes.split()
}
