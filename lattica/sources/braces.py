"""Functions of brace languages, by their headers and matching braces over masked text.

Strings and comments are blanked, place by place, so that line numbers and columns stay. A header is a
name before a parameter list before a brace; control words aren't names. Facts are those of
`code.FUNCTIONS` that can be told without types."""

from __future__ import annotations

import re

LANGUAGES = ("javascript", "typescript", "rust", "go", "java", "csharp", "c", "cpp")
_LITERAL = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'""", re.S)
_RUST_LITERAL = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\[^\n]+?|[^'\\\n])'""", re.S)
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "loop", "unsafe", "sizeof", "using", "lock", "fixed", "foreach", "synchronized", "new", "throw", "await", "function", "with", "select", "defer", "go", "case"}
_NAME = r"[A-Za-z_$][\w$]*"
HEADERS = {
    "rust": re.compile(rf"\bfn\s+({_NAME})\s*(?:<[^{{}};()]*>)?\s*\("),
    "go": re.compile(rf"\bfunc\s+(?:\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)[^)]*\)\s*)?({_NAME})\s*(?:\[[^\]]*\])?\("),
    "javascript": re.compile(rf"(?:\bfunction\s*\*?\s*({_NAME})?\s*\()|(?:\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;{{}}]+)?=\s*(?:async\s*)?\()|(?:^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?({_NAME})\s*(?:<[^{{}};()]*>)?\()", re.M),
    "java": re.compile(rf"\b({_NAME})\s*\("),
}
_CLASS = re.compile(rf"\b(?:class|struct|interface|trait|impl|enum)\s+(?:<[^>]*>\s*)?(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?({_NAME})")
_BRANCH = re.compile(r"\b(?:if|for|foreach|while|case|catch|match|loop)\b|&&|\|\||\?(?![.?:])")
_BLOCK = re.compile(r"\b(?:if|for|foreach|while|switch|match|loop|try|else|catch|do)\b[^{};]*$")
_CALL = re.compile(rf"({_NAME})!?\s*(?:::<[^>]*>)?\(")
_WORD = re.compile(_NAME)
_STORE = re.compile(rf"(?:\b(?:let|const|var|mut|int|long|double|float|bool|boolean|String|auto)\s+)?\b({_NAME})\s*(?::[^=;{{}}()]+)?(?::=|(?<![=!<>+\-*/%&|^])=(?![=>]))")


def masked(text: str, language: str) -> str:
    """The text with comments and the insides of strings as blanks."""
    def blank(m: re.Match) -> str:
        s = m.group(0)
        inner = re.sub(r"[^\n]", " ", s)
        return inner if s.startswith("/") else s[0] + inner[1:-1] + s[-1]

    return (_RUST_LITERAL if language == "rust" else _LITERAL).sub(blank, text)


def closing(text: str, at: int, opening: str, close: str) -> int:
    """The place of the bracket that closes the one at `at`, or -1."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == opening:
            depth += 1
        elif text[i] == close:
            depth -= 1
            if not depth:
                return i
    return -1


def parameters(inside: str, language: str) -> list[str]:
    out, depth, start = [], 0, 0
    parts = []
    for i, c in enumerate(inside):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and inside[i - 1 : i] not in ("=", "-"):
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(inside[start:i])
            start = i + 1
    for p in [*parts, inside[start:]]:
        p = p.split("=")[0].strip()
        if language in ("rust", "typescript", "javascript"):
            words = _WORD.findall(p.split(":")[0])
            word = words[-1] if words else ""
        elif language == "go":
            words = _WORD.findall(p)
            word = words[0] if words else ""
        else:
            words = _WORD.findall(p)
            word = words[-1] if len(words) > 1 else ""
        if word and word not in ("self", "this", "void"):
            out.append(word)
    return out


def _body_start(text: str, at: int, language: str) -> int:
    """Where the body's brace is, if what follows the parameter list is a header's end, else -1."""
    end = closing(text, at, "(", ")")
    if end < 0:
        return -1
    rest = text[end + 1 : end + 400]
    tail = {
        "rust": r"\s*(?:->\s*[^{};]+)?(?:\s*where\b[^{};]*)?\{",
        "go": r"\s*(?:\([^{}]*\)|[\w.*\[\]]+)?\s*\{",
        "javascript": r"\s*(?::\s*[^{};=]+?)?\s*(?:=>\s*)?\{",
        "java": r"\s*(?:const\b|noexcept\b|override\b|final\b|throws\s+[\w.,\s]+|where\b[^{};]*|:\s*[^{};]*)*\s*\{",
    }[language]
    m = re.match(tail, rest)
    return end + m.end() if m else -1


def parse(path: str, content: str, language: str) -> list[dict]:
    text = masked(content, language)
    kind = {"typescript": "javascript", "csharp": "java", "c": "java", "cpp": "java"}.get(language, language)
    line_of = [0]
    for i, c in enumerate(text):
        if c == "\n":
            line_of.append(i + 1)

    def line(at: int) -> int:
        import bisect

        return bisect.bisect_right(line_of, at)

    classes = []
    for m in _CLASS.finditer(text):
        brace = text.find("{", m.end())
        if 0 <= brace and ";" not in text[m.end() : brace]:
            classes.append((brace, closing(text, brace, "{", "}"), m.group(1)))
    found = []
    for m in HEADERS[kind].finditer(text):
        names = [g for g in m.groups() if g]
        name = names[-1] if names else "<anonymous>"
        owner = m.group(1) if kind == "go" and len(names) > 1 else None
        if name in _CONTROL or (kind == "java" and text[max(0, m.start() - 1) : m.start()] == "."):
            continue
        start = _body_start(text, m.end() - 1, kind)
        if start < 0:
            continue
        end = closing(text, start, "{", "}")
        if end < 0:
            continue
        if any(f["_start"] == start for f in found):
            continue
        if owner is None:
            inside = [c for a, z, c in classes if a < m.start() < z]
            owner = inside[-1] if inside else None
        found.append({"_start": start, "_end": end, "_head": m.start(), "name": name, "class_name": owner, "params": parameters(text[m.end() : closing(text, m.end() - 1, "(", ")")], language)})
    out = []
    for f in found:
        body, inner = text[f["_start"] + 1 : f["_end"]], [g for g in found if f["_start"] < g["_head"] < f["_end"]]
        for g in sorted(inner, key=lambda g: -g["_head"]):  # functions inside have rows of their own
            a, z = g["_head"] - f["_start"] - 1, g["_end"] - f["_start"]
            body = body[:a] + re.sub(r"[^\n]", " ", body[a:z]) + body[z:]
        depth = deepest = 0
        stack = []
        for i, c in enumerate(body):
            if c == "{":
                block = bool(_BLOCK.search(body[max(0, i - 200) : i]))
                stack.append(block)
                depth += block
                deepest = max(deepest, depth)
            elif c == "}" and stack:
                depth -= stack.pop()
        returns = re.findall(r"\breturn\b\s*([^;\n}]?)", body)
        stores = [x for x in _STORE.findall(body) if x not in _CONTROL]
        calls = [x for x in _CALL.findall(body) if x not in _CONTROL]
        first = content.rfind("\n", 0, f["_head"]) + 1
        head, before = content[first : f["_start"]], content[:first].rstrip().rsplit("\n", 1)[-1].strip()
        out.append({
            "path": path, "name": f["name"], "qualified_name": f"{path}::{f['class_name'] + '.' if f['class_name'] else ''}{f['name']}", "class_name": f["class_name"], "line_start": line(f["_head"]), "line_end": line(f["_end"]), "params": f["params"],
            "mutable_defaults": 0, "complexity": 1 + len(_BRANCH.findall(body)), "nesting": deepest, "returns": sum(bool(r) for r in returns), "bare_returns": sum(not r for r in returns), "yields": len(re.findall(r"\byield\b", body)), "yields_in_loop": 0,
            "is_async": bool(re.search(r"\basync\b", head)), "has_doc": before.endswith("*/") or before.startswith(("///", "//")), "decorators": [], "calls": calls, "reads": [w for w in _WORD.findall(body) if w not in _CONTROL and w not in calls], "stores": stores,
        })
    return out
