"""Facts of Rust, Kotlin, Swift, F# and Mojo source, by line scanners.

No grammar of these languages is at hand, so this is an approximation: strings and comments are blanked, declarations are
found by pattern, and their extent by braces (or by indentation for F# and Mojo). Macros are read as written; Rust items of features
that aren't active are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from graphloom.sources.facts import Fact, last_part, module_of

VERBS = "get|post|put|delete|patch|head|options"


@dataclass
class Language:
    declarations: list[tuple[str, str]]  # pattern with the name in group 1, kind
    imports: str
    indented: bool = False
    comment: str = r"//[^\n]*|/\*.*?\*/"
    not_calls: str = "if|for|while|match|switch|when|return|catch|guard|in|as|is|let|fn|func|fun|def|assert|print|println|Some|Ok|Err|None"


LANGUAGES = {
    "rust": Language([(r"\bmod\s+(\w+)", "Module"), (r"\bstruct\s+(\w+)", "Struct"), (r"\benum\s+(\w+)", "Enum"), (r"\btrait\s+(\w+)", "Trait"), (r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", "impl"), (r"\bfn\s+(\w+)", "Function")], r"^\s*(?:pub\s+)?use\s+([^;]+);"),
    "kotlin": Language([(r"\benum\s+class\s+(\w+)", "Enum"), (r"\b(?<!enum )class\s+(\w+)", "Class"), (r"\binterface\s+(\w+)", "Interface"), (r"\bobject\s+(\w+)", "Class"), (r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", "Function"), (r"\b(?:val|var)\s+(\w+)", "Unknown"), (r"\btypealias\s+(\w+)", "TypeAlias")], r"^\s*import\s+([\w.*]+)"),
    "swift": Language([(r"\bclass\s+(?!func|var)(\w+)", "Class"), (r"\bstruct\s+(\w+)", "Struct"), (r"\benum\s+(\w+)", "Enum"), (r"\bprotocol\s+(\w+)", "Interface"), (r"\bextension\s+(\w+)", "impl"), (r"\bfunc\s+(\w+)", "Function"), (r"\btypealias\s+(\w+)", "TypeAlias")], r"^\s*import\s+(?:\w+\s+)?([\w.]+)"),
    "fsharp": Language([(r"^\s*module\s+(?:rec\s+)?([\w.]+)\s*=", "Module"), (r"^\s*type\s+(\w+)", "Class"), (r"^\s*let\s+(?:rec\s+|inline\s+|private\s+)*(\w+)", "Function"), (r"^\s*(?:static\s+)?member\s+(?:\w+\.)?(\w+)", "Method")], r"^\s*open\s+([\w.]+)", True, r"//[^\n]*|\(\*.*?\*\)"),
    "mojo": Language([(r"^\s*struct\s+(\w+)", "Struct"), (r"^\s*class\s+(\w+)", "Class"), (r"^\s*trait\s+(\w+)", "Interface"), (r"^\s*(?:async\s+)?(?:fn|def)\s+(\w+)", "Function")], r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", True, r"#[^\n]*"),
}
#: Texts of which a line must hold one before a pattern is tried on it.
WORDS = {
    "spawn": {"rust": ("spawn",), "swift": ("Task",), "kotlin": ("launch", "async")},
    "channel": {"rust": ("mpsc", "oneshot", "broadcast", "watch"), "kotlin": ("Channel",), "swift": ("AsyncStream", "AsyncChannel")},
    "send": {"rust": ("send",), "kotlin": ("send", "Send", "emit"), "swift": ("yield", "send")},
    "receive": {"rust": ("recv",), "kotlin": ("receive", "Receive", "collect"), "swift": ("await",)},
    "import": {"rust": ("use",), "kotlin": ("import",), "swift": ("import",), "fsharp": ("open",), "mojo": ("import",)},
    "declaration": {"Module": ("mod",), "Struct": ("struct",), "Enum": ("enum",), "Trait": ("trait",), "impl": ("impl", "extension"), "Class": ("class", "object", "type"), "Interface": ("interface", "protocol", "trait"), "Function": ("fn", "fun", "let", "def"), "Method": ("member",), "Unknown": ("val", "var"), "TypeAlias": ("typealias",)},
}
_STRING = re.compile(r'"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"', re.S)
_CALL = re.compile(r"(?<![\w@#])((?:[A-Za-z_]\w*(?:\.|::))*[A-Za-z_]\w*)(?:::<[^>]*>)?\s*\(")
SPAWN = {"rust": r"\b((?:tokio::(?:task::)?|std::thread::|thread::)spawn)\s*\(", "swift": r"\b(Task\.detached|Task|addTask)\s*(?:\(|\{)", "kotlin": r"\b((?:\w+\.)?(?:launch|async))\s*(?:\(|\{)"}
SPAWNED = re.compile(r"(?:\s*(?:[({]|async\b|move\b|\|[^|]*\||detached\b|await\b|try\b|\w+:(?!:)))*\s*([A-Za-z_][\w:.]*)\s*\(")
SEND = {"rust": r"([\w.]+)\.(?:send|try_send|blocking_send)\s*\(", "kotlin": r"([\w.]+)\.(?:send|trySend|emit)\s*\(", "swift": r"([\w.]+)\.(?:yield|send)\s*\("}
RECEIVE = {"rust": r"([\w.]+)\.(?:recv|try_recv|recv_timeout|blocking_recv)\s*\(", "kotlin": r"([\w.]+)\.(?:receive|tryReceive|collect)\s*[({]", "swift": r"\bfor\s+await\s+\w+\s+in\s+([\w.]+)"}
#: Names of types that a language brings with it; they are no references of interest.
PREDEFINED = frozenset("Self String Str Vec Option Result Box Rc Arc Some None Ok Err Int Int8 Int16 Int32 Int64 UInt UInt8 Float Float32 Float64 Double Bool Boolean Unit Any AnyObject Void Long Short Byte Char Character List Map Set Array Dictionary Optional Error Nothing Seq SIMD".split())
_TYPES = re.compile(r"(?:(?<!:):(?!:)|->)\s*([^=;{]*)")
_TYPE_NAME = re.compile(r"((?:\b\w+(?:::|\.))*\b[A-Z]\w*\b)(?!\s*\(|::|\.)")
_BRACE = re.compile(r"[{};]")
_NO_TYPES = re.compile(r"\s*(use|import|open|from|#|@)\b")
_GATE = re.compile(r'\s*#\[cfg\(\s*(not\()?\s*feature\s*=\s*"([^"]*)"\s*\)?\s*\)\]')
CHANNEL = {"rust": r"let\s*\(\s*(?:mut\s+)?(\w+)\s*,\s*(?:mut\s+)?(\w+)\s*\)\s*(?::[^=]*)?=\s*([\w:]*(?:mpsc|oneshot|broadcast|watch)[\w:]*)::", "kotlin": r"\bval\s+(\w+)()\s*=\s*(Channel)\s*[<(]", "swift": r"\blet\s+(\w+)()\s*=\s*(AsyncStream|AsyncChannel)\b"}


@lru_cache
def _wiped(comment: str) -> re.Pattern:
    return re.compile(rf"{_STRING.pattern}|{comment}", re.S)


@lru_cache
def _names_of(words: str) -> frozenset[str]:
    return frozenset(words.split("|"))


def _found(what: str, language: str, patterns: dict[str, str], line: str) -> Iterator[re.Match]:
    """Places of a language's pattern in a line, which isn't tried if none of its words is there."""
    return re.finditer(patterns[language], line) if any(w in line for w in WORDS[what].get(language, ())) else iter(())


def blank(text: str, comment: str) -> str:
    """Comments and the inside of strings as spaces, so that places stay."""
    wipe = lambda s: re.sub(r"[^\n]", " ", s) if "\n" in s else " " * len(s)
    keep = lambda m: m[0][0] + wipe(m[0][1:-1]) + m[0][-1] if m[0][0] == '"' else wipe(m[0])
    return _wiped(comment).sub(keep, text)


def _end(lines: list[str], at: int, column: int, indented: bool) -> int:
    """Number of the last line (from 0) of what is declared on line ``at``."""
    if indented:
        own, last = len(lines[at]) - len(lines[at].lstrip()), at
        for k in range(at + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= own:
                    break
                last = k
        return last
    depth, seen = 0, False
    for k in range(at, len(lines)):
        for m in _BRACE.finditer(lines[k], column if k == at else 0):
            c = m[0]
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
                if seen and depth <= 0:
                    return k
            elif c == ";" and not seen:
                return k
        if not seen and k > at and not lines[k].strip():
            return at
        if not seen and "=" in lines[k][column if k == at else 0 :]:
            return k
    return len(lines) - 1


def _module(language: str, path: str, text: str) -> str:
    """Kotlin: the package header, else the path. F#: the declared module or namespace, else the file's name. Others: the path."""
    if language == "rust":
        return module_of(path.removesuffix("/mod.rs"))
    if language == "kotlin" and (m := re.search(r"^\s*package\s+([\w.]+)", text, re.M)):
        return m[1]
    if language == "fsharp":
        m = re.search(r"^(?:module|namespace)\s+(?:rec\s+)?([\w.]+)\s*$", text, re.M)
        return m[1] if m else module_of(path, ".").rsplit(".", 1)[-1]
    return module_of(path, ".")


def gated(lines: list[str], raw: list[str], features: tuple[str, ...]) -> list[str]:
    """The lines without items whose feature isn't among the active ones, or is and mustn't be; other conditions are left."""
    lines = list(lines)
    for k, row in enumerate(raw):
        m = _GATE.match(row)
        if m and (m[2] in features) == bool(m[1]):
            at = k + 1
            while at < len(lines) - 1 and re.match(r"\s*(#\[|$)", raw[at]):
                at += 1
            for j in range(k, _end(lines, at, 0, False) + 1 if at < len(lines) else k + 1):
                lines[j] = ""
    return lines


def _paired(channels: list[tuple[str, str]], sends: list[tuple[str, str]], receives: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Scopes of sender and receiver of a file's channels. Variables that no declaration names go by what they are called."""
    of = lambda ends, var: {s for v, s in ends if v == var or v.startswith((f"{var}.", f"{var}_")) or v.endswith(f".{var}")}
    like = lambda ends, *marks: {s for v, s in ends if any(m in v for m in marks)}
    found = {(s, r) for tx, rx in channels for s in of(sends, tx) for r in of(receives, rx)}
    declared = {tx for tx, _ in channels}
    loose = [x for x in sends if x[0] not in declared]
    found |= {(s, r) for s in like(loose, "tx", "sender") for r in like(receives, "rx", "receiver")}
    yield from sorted((s, r) for s, r in found if s != r)


#: Confidence of a call's target: known through an import, in the own class, in the own module, a simple name, anything else. Fixed values.
LADDER = {"rust": (0.5, 1.0, 1.0, 0.7, 0.5), "mojo": (0.5, 1.0, 1.0, 0.7, 0.5), "fsharp": (0.5, 0.5, 1.0, 0.5, 0.5), "kotlin": (1.0, 1.0, 1.0, 0.5, 0.5), "swift": (1.0, 0.9, 0.7, 0.6, 0.5)}


def _callee(language: str, name: str, own: str, methods: dict[str, set[str]], names: dict[str, str], imports: dict[str, str]) -> tuple[str, float]:
    """A call's target as far as the file knows it, and how sure that is. ``own``: the calling scope; ``methods``: of each type."""
    imported, of_class, of_module, simple, other = LADDER[language]
    parts = re.split(r"::|\.", name)
    home = own.rsplit(".", 1)[0] if own.rsplit(".", 1)[0] in methods else None
    if len(parts) == 2 and parts[0] in ("self", "this", "Self"):
        if home and parts[1] in methods[home]:
            return f"{home}.{parts[1]}", of_class
        return (f"{last_part(home)}.{parts[1]}", 0.8 if language != "swift" else other) if home else (name, other)
    if language in ("kotlin", "swift") and parts[0] in imports:
        return ".".join([imports[parts[0]], *parts[1:]]), imported
    if len(parts) == 1:
        if language in ("kotlin", "swift") and home and name in methods[home]:
            return f"{home}.{name}", of_class
        return (names[name], of_module) if name in names else (name, simple)
    owner = next((c for c in methods if len(parts) == 2 and last_part(c) == parts[0] and parts[1] in methods[c]), None)
    return (f"{owner}.{parts[1]}", of_class) if owner and language == "rust" else (name, other)


def extract(language: str, path: str, text: str, features: tuple[str, ...] = ()) -> Iterator[Fact]:
    spec = LANGUAGES[language]
    plain = blank(text, spec.comment)
    module, within = _module(language, path, plain), "." if language == "fsharp" else "::"
    lines, raw = plain.split("\n"), text.split("\n")
    if language == "rust":
        lines = gated(lines, raw, features)
    yield Fact("symbol", last_part(module), module, "Module", None, 1, max(1, len(raw)))
    found: list[tuple[int, int, str, str]] = []
    declared: set[tuple[int, int]] = set()
    for pattern, kind in spec.declarations:
        own_words, compiled = WORDS["declaration"][kind], re.compile(pattern)
        for k, line in enumerate(lines):
            for m in compiled.finditer(line) if any(w in line for w in own_words) else ():
                declared.add((k, m.start(1)))
                header = kind == "Unknown" and "(" in line[: m.start()] and re.match(r"[\w\s@]*\bclass\b", line)  # a property in a class's header
                found.append((k, k if header else _end(lines, k, m.end(), spec.indented), m[1], kind))
    found.sort(key=lambda x: (x[0], -x[1]))
    open_: list[tuple[int, str, str]] = []  # last line, name, kind
    scopes: list[tuple[int, int, str, str]] = []
    for first, last, name, kind in found:
        while open_ and open_[-1][0] < first:
            open_.pop()
        in_type = bool(open_) and open_[-1][2] in ("Struct", "Class", "Trait", "Interface", "Enum", "impl")
        inner = bool(open_) and open_[-1][2] in ("Function", "Method")
        if kind == "Unknown" and inner:
            continue  # a local value
        if kind == "Function" and in_type:
            kind = "Method"
        around = within.join([module, *dict.fromkeys(n for _, n, _ in open_)])
        qualified = f"{around}.{name}" if kind == "Method" else f"{around}{within}{name}"
        open_.append((last, name, kind))
        if kind != "impl":
            scopes.append((first, last, qualified, kind))
            yield Fact("symbol", name, qualified, kind, None, first + 1, last + 1)
            yield from _tests(language, raw, first, last, name, qualified, kind)
            if language in ("kotlin", "swift"):
                for mark in _marks(raw, first):
                    yield Fact("decorator", mark, qualified, "", mark, first + 1, first + 1)
        m = re.search(r"\b(?:class|struct|interface|object|protocol|enum|extension)\s+\w+(?:<[^>]*>)?[\s\w]*(?:\([^)]*\))?\s*:\s*([\w., <>()]+)", lines[first]) if language in ("kotlin", "swift") and kind not in ("Unknown", "Function", "Method") else re.search(r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s", lines[first]) if kind == "impl" else None
        for base in re.split(r",(?![^<(]*[>)])", m[1]) if m else ():
            if bare := re.sub(r"[<(].*", "", base).strip():
                # Kotlin calls a base class's constructor; in Swift the first of a class's bases is taken for its class.
                extends = (base.rstrip().endswith(")") if language == "kotlin" else kind == "Class" and m[1].lstrip().startswith(bare)) and kind != "Interface"
                yield Fact("base", bare.rsplit("::", 1)[-1], qualified if kind != "impl" else f"{module}::{name}", "", bare, first + 1, first + 1, None, {"implements": str(not extends).lower()})

    @lru_cache(None)
    def scope(k: int) -> str:
        return next((q for a, b, q, kind in reversed(scopes) if a <= k <= b and kind in ("Function", "Method")), module)

    @lru_cache(None)
    def owner(k: int) -> str:
        return next((q for a, b, q, _ in reversed(scopes) if a <= k <= b), module)

    headers = {a for a, _, _, kind in scopes if kind in ("Class", "Enum", "Interface")}
    order: dict[str, int] = {}
    names = {last_part(q): q for _, _, q, kind in scopes if kind == "Function"}
    methods: dict[str, set[str]] = {}
    for _, _, q, kind in scopes:
        if kind == "Method":
            methods.setdefault(q.rsplit(".", 1)[0], set()).add(last_part(q))
    imports: dict[str, str] = {}
    channels, sends, receives = [], [], []
    not_calls = _names_of(spec.not_calls)
    for k, line in enumerate(lines):
        if not line or line.isspace():
            continue
        for m in _found("import", language, {language: spec.imports}, line):
            target = next(g for g in m.groups() if g).strip()
            yield Fact("import", re.split(r"::|\.", target)[-1], module, "", target, k + 1, k + 1)
            imports[last_part(target)] = target
        for m in _CALL.finditer(line) if "(" in line else ():
            last = last_part(m[1])
            if (k, m.start(1)) in declared or m[1] in not_calls or language == "kotlin" and k in headers:
                continue
            own = scope(k)
            order[own] = order.get(own, -1) + 1
            target, sure = _callee(language, m[1], own, methods, names, imports)
            yield Fact("call", last, own, "", target, k + 1, k + 1, order[own], {"confidence": str(sure)})
        if (":" in line or "->" in line) and not _NO_TYPES.match(line):
            for name in dict.fromkeys(n for m in _TYPES.finditer(line) for n in _TYPE_NAME.findall(m[1])):
                if last_part(name) not in PREDEFINED:
                    yield Fact("type", last_part(name), owner(k), "", name, k + 1, k + 1)
        for m in _found("spawn", language, SPAWN, line):
            started = SPAWNED.match("\n".join([line[m.end() - 1 :], *lines[k + 1 : k + 3]]))
            yield Fact("spawn", m[1], scope(k), m[1], started[1] if started else "unknown", k + 1, k + 1)
        for m in _found("channel", language, CHANNEL, line):
            channels.append((m[1], m[2] or m[1]))
            yield Fact("channel", m[1], scope(k), m[3].rsplit("::", 1)[-1], m[2] or m[1], k + 1, k + 1)
        for role, what, patterns, ends in (("tx", "send", SEND, sends), ("rx", "receive", RECEIVE, receives)):
            for m in _found(what, language, patterns, line):
                ends.append((m[1], scope(k)))
                yield Fact("end", m[1], scope(k), role, None, k + 1, k + 1)
        if language == "rust":
            if "unsafe" not in line:
                pass
            elif m := re.search(r"\bunsafe\s+fn\s+(\w+)", line):
                yield Fact("unsafe", m[1], f"{scope(k)}", "function", None, k + 1, _end(lines, k, m.end(), False) + 1)
            elif m := re.search(r"\bunsafe\s*\{", line):
                yield Fact("unsafe", "block", scope(k), "block", None, k + 1, _end(lines, k, m.start(), False) + 1)
            if "extern" in line and re.search(r'\bextern\s+"', line):
                yield Fact("ffi", (re.search(r'extern\s+"([^"]*)"', raw[k]) or ["", "C"])[1], scope(k), "extern", None, k + 1, k + 1)
    for sender, receiver in _paired(channels, sends, receives):
        yield Fact("send", last_part(receiver), sender, "SendsTo", receiver)
    yield from _routes(language, module, text, scope)


def _marks(raw: list[str], first: int) -> list[str]:
    """Names of the annotations above a declaration, and on its own line before it."""
    k = first
    while k > 0 and "@" in raw[k - 1] and re.match(r"(\s*@[\w.]+(\([^)]*\))?)+\s*$", raw[k - 1]):
        k -= 1
    return [m for row in raw[k : first + 1] if "@" in row for m in re.findall(r"(?:^|\s)@((?!file:)\w+(?:\.\w+)*)", row)]


def _tests(language: str, raw: list[str], first: int, last: int, name: str, qualified: str, kind: str) -> Iterator[Fact]:
    above = []
    k = first - 1
    while k >= 0 and re.match(r"\s*(#\[|\[<|@)", raw[k]):
        above.append(raw[k].strip())
        k -= 1
    above.append(raw[first].strip())
    marks = " ".join(above)
    is_test = {
        "rust": lambda: re.search(r"#\[(?:\w+::)*(test|rstest|test_case)\b", marks),
        "fsharp": lambda: re.search(r"\[<\s*(?:\w+\.)*(Fact|Theory|Test|TestCase|Property)(?:Attribute)?\b", marks),
        "kotlin": lambda: re.search(r"@(?:\w+\.)*(Test|ParameterizedTest)\b", marks),
        "swift": lambda: re.search(r"@Test\b(.*arguments:)?", marks) or (kind == "Method" and re.match("test", name)),
        "mojo": lambda: re.match("test_|Test", name),
    }[language]
    if is_test():
        many = bool(re.search(r"rstest|test_case|Theory|TestCase|Property|Parameterized|arguments:", marks))
        frame = {"rust": "cargo", "fsharp": "fsharp", "kotlin": "junit", "swift": "XCTest", "mojo": "mojo"}[language]
        yield Fact("test", name, qualified, "Class" if kind in ("Class", "Struct") else "Function", None, first + 1, last + 1, None, {"framework": frame, "parametrized": str(many).lower()})


def _routes(language: str, module: str, text: str, scope) -> Iterator[Fact]:
    """Routes by attribute or by chains and nested blocks; nested prefixes are joined in Kotlin."""
    line = lambda m: text.count("\n", 0, m.start())
    if language == "rust" and '"' in text:
        for m in re.finditer(rf'#\[(?:\w+::)*({VERBS})\(\s*"([^"]*)"', text):
            handler = re.compile(r"fn\s+(\w+)").search(text, m.end())
            yield Fact("route", handler[1] if handler else "", f"{module}::{handler[1]}" if handler else module, m[1].upper(), m[2], line(m) + 1, line(m) + 1)
        for m in re.finditer(rf'\.route\(\s*"([^"]*)"\s*,\s*(?:\w+::)*({VERBS})\(\s*([\w:]+)', text):
            yield Fact("route", m[3], scope(line(m)), m[2].upper(), m[1], line(m) + 1, line(m) + 1)
    elif language == "kotlin":
        prefixes: list[tuple[int, str]] = []
        depth = 0
        for k, row in enumerate(text.split("\n")):
            m = re.search(rf'\b(route|{VERBS})\s*(?:\(\s*"([^"]*)"\s*\))?\s*\{{', row) if "{" in row else None
            if m and m[1] == "route":
                prefixes.append((depth, m[2] or ""))
            elif m and (m[2] is not None or prefixes):
                yield Fact("route", m[1], scope(k), m[1].upper(), "".join(p for _, p in prefixes) + (m[2] or ""), k + 1, k + 1)
            depth += row.count("{") - row.count("}")
            while prefixes and depth <= prefixes[-1][0]:
                prefixes.pop()
    elif language == "fsharp":
        for m in re.finditer(rf'\b({VERBS})\s+"([^"]*)"\s+\(?(\w+)', text):
            yield Fact("route", m[3], module, m[1].upper(), m[2], line(m) + 1, line(m) + 1)
        for m in re.finditer(rf'\b({VERBS.upper()})\s*>=>\s*routef?\s+"([^"]*)"\s*>=>\s*(\w+)', text):
            yield Fact("route", m[3], module, m[1], m[2], line(m) + 1, line(m) + 1)
