"""Facts of source files by their tokens and nesting, for languages without a parser in the standard library.

A file is cut into tokens; brackets, statement ends and (in Ruby) ``end`` give
the nesting. The tokens before an opening brace or a statement's end are a
header, and its keyword or shape says what it declares. This is no full parser:
headers that macros build, and types inferred by a compiler, are not seen.

Rows are those of ``FACT``; lines and columns count from 0. A file that is cut
off in the middle gives the facts up to there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from factloom.functions.ids import fact_id

#: Words that declare a symbol, and the symbol's kind, by language.
DECLARES = {
    "go": {"package": "package", "func": "function", "type": "type_alias", "var": "variable", "const": "constant"},
    "typescript": {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum", "namespace": "namespace", "let": "variable", "var": "variable", "const": "constant"},
    "javascript": {"function": "function", "class": "class", "let": "variable", "var": "variable", "const": "constant"},
    "rust": {"struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "fn": "function", "type": "type_alias", "const": "constant", "static": "variable", "macro_rules": "function"},
    "c": {"struct": "struct", "enum": "enum", "typedef": "type_alias"},
    "cpp": {"namespace": "namespace", "class": "class", "struct": "struct", "enum": "enum", "typedef": "type_alias"},
    "java": {"package": "package", "class": "class", "interface": "interface", "enum": "enum"},
    "php": {"namespace": "namespace", "class": "class", "interface": "interface", "trait": "trait", "function": "function", "const": "constant"},
    "ruby": {"module": "module", "class": "class", "def": "function"},
}
#: Words before a declaration that do not name it.
MODIFIERS = set("abstract async declare default export extern final inline internal native override private protected pub public readonly static strictfp synchronized transient unsafe virtual volatile constexpr explicit friend mutable".split())
#: Words that are followed by a bracket and are no call.
CONTROL = set("if for while switch catch return sizeof foreach elseif match select defer go elsif unless until case when new throw func fn function typeof await yield and or not in do else super".split())
TYPES = {"class", "struct", "interface", "trait", "enum"}
TYPE_FIRST = {"c", "cpp", "java"}
NEWLINE_ENDS = {"go", "typescript", "javascript", "ruby"}
LANGUAGES = tuple(DECLARES)


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int
    pos: int = -1

    @property
    def end(self) -> tuple[int, int]:
        lines = self.text.count("\n")
        return self.line + lines, len(self.text) - self.text.rfind("\n") - 1 if lines else self.col + len(self.text)


@dataclass
class Frame:
    kind: str
    what: str
    owner: int | None
    scope: int
    at: Token
    symbol: tuple | None = None
    access: str = "public"
    header: list[Token] = field(default_factory=list)
    depth: int = 0


def token_pattern(language: str) -> re.Pattern:
    remark = r"\#[^\n]*|(?m:^=begin[\s\S]*?^=end)" if language == "ruby" else r"//[^\n]*|/\*[\s\S]*?\*/" + (r"|\#(?!\[)[^\n]*" if language == "php" else "")
    text = r'"(?:\\[\s\S]|[^"\\])*"' if language in ("rust", "php", "ruby") else r'"(?:\\.|[^"\\\n])*"'
    if language == "rust":
        text += r"|'(?:\\[^\n]+?|[^'\\\n])'"
    else:
        text += r"|'(?:\\.|[^'\\\n])*'"
    if language in ("go", "typescript", "javascript"):
        text += r"|`(?:\\[\s\S]|[^`\\])*`" if language != "go" else r"|`[^`]*`"
    if language == "php":
        remark += r"|\A[\s\S]*?<\?(?:php|=)|\?>[\s\S]*?(?:<\?(?:php|=)|\Z)"
    before = r"(?P<pre>^[ \t]*\#(?:\\\n|[^\n])*)|" if language in ("c", "cpp") else ""
    name = r"[@$]{0,2}[^\W\d]\w*[?!]?(?![=~])|[@$]{0,2}[^\W\d]\w*" if language == "ruby" else r"'?\$?[^\W\d][\w$]*"
    return re.compile(rf"{before}(?P<skip>{remark}|[ \t\r\f\v]+)|(?P<nl>\n)|(?P<str>{text})|(?P<name>{name})|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|:=|\.\.\.|\?\.|[^\s])", re.MULTILINE)


PATTERNS = {x: token_pattern(x) for x in LANGUAGES}


def tokens_of(text: str, language: str) -> list[Token]:
    out, line, start = [], 0, 0
    for m in PATTERNS[language].finditer(text):
        kind, raw = m.lastgroup, m.group()
        if kind != "skip" and (kind != "nl" or language in NEWLINE_ENDS):
            out.append(Token(kind, raw, line, m.start() - start, m.start()))
        if "\n" in raw:
            line += raw.count("\n")
            start = m.start() + raw.rfind("\n") + 1
    return out


def joined(tokens: list[Token]) -> str:
    return re.sub(r"(?<=\w) (?=\W)|(?<=\W) (?=\w)", "", " ".join(t.text for t in tokens))


def split_at(tokens: list[Token], mark: str = ",") -> list[list[Token]]:
    """Parts between marks outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text in "([{<") - (t.text in ")]}>") if t.kind == "op" else 0
        if t.text == mark and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def bracket(tokens: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at ``at``; the last token if none does."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k].text in "([{") - (tokens[k].text in ")]}") if tokens[k].kind == "op" else 0
        if depth == 0:
            return k
    return len(tokens) - 1


def angle(tokens: list[Token], at: int) -> int:
    """Index of the angle that closes the one at ``at``; the last token if none does."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k].text == "<") - (tokens[k].text == ">")
        if depth == 0:
            return k
    return len(tokens) - 1


class LexicalFacts:
    """Facts of one file as (fact, id, name, kind, owner, detail, span) rows."""

    def __init__(self, path: str, text: str, language: str):
        self.path, self.language, self.rows = path, language, []
        self.declared: set[tuple[int, int]] = set()
        self.known: set[int] = set()
        self.types: dict[str, int] = {}
        self.unbound: dict[int, str] = {}
        self.template: list[Token] = []
        self.text, self.tokens = text, tokens_of(text, language)
        first, lines = Token("op", "", 0, 0), text.count("\n") + 1
        self.frames = [Frame("file", "", None, fact_id(path, "scope", 0, 0, "file"), first)]
        self.walk_ruby() if language == "ruby" else self.walk()
        last = Token("op", "", lines, 0)
        while self.frames:
            self.pop(last)
        self.bind()

    # Rows.

    def add(self, fact: str, name: str, kind: str, owner: int | None, detail: str, at: Token, end: Token) -> int:
        key = fact_id(self.path, fact, kind, name, at.line, at.col, detail if fact == "import" else "")
        if key not in self.known:
            self.known.add(key)
            self.rows.append((fact, key, name, kind, owner, detail, at.line, at.col, *end.end))
            if fact == "symbol" and (kind in TYPES or kind == "type_alias"):
                self.types.setdefault(name, key)
        return key

    def written(self, part: list[Token], kept: list[Token]) -> str:
        """What stands in the file for the kept tokens of a part; joined where others lie between."""
        if not kept:
            return ""
        low, high = part.index(kept[0]), part.index(kept[-1]) + 1
        return self.text[kept[0].pos : kept[-1].pos + len(kept[-1].text)] if part[low:high] == kept else joined(kept)

    def push(self, kind: str, what: str, owner: int | None, at: Token, symbol: tuple | None = None) -> None:
        private = self.language == "cpp" and what == "class"
        self.frames.append(Frame(kind, what, owner, fact_id(self.path, "scope", kind, at.line, at.col), at, symbol, "private" if private else "public"))

    def pop(self, end: Token) -> None:
        f = self.frames.pop()
        self.rows.append(("scope", f.scope, "", f.kind, self.frames[-1].scope if self.frames else None, str(f.owner or ""), f.at.line, f.at.col, *end.end))
        if f.symbol:
            self.add(*f.symbol, end)

    def owner(self) -> tuple[int | None, str]:
        """The nearest type or namespace around, and its kind; functions hide it."""
        f = self.frames[-1]
        return (f.owner, f.what) if f.kind in ("class", "impl") else (None, "")

    def visible(self, words: list[str], name: str) -> str:
        if self.language == "go":
            return "public" if name[:1].isascii() and name[:1].isupper() else "private"
        if self.language == "rust":
            return "public" if "pub" in words else "private"
        if self.language == "javascript":
            return "public" if "export" in words else "private"
        said = next((w for w in words if w in ("public", "protected", "private")), None)
        if said is None and self.frames[-1].what == "interface":
            return "public"
        return said or ("package" if self.language == "java" else self.frames[-1].access)

    def modifiers(self, words: list[str]) -> str:
        """What is stored of the words before a declaration, behind its visibility; PHP's only."""
        held = [w for w in words if w in ("static", "abstract", "final")] if self.language == "php" else []
        return ":" + ",".join(held) if held else ""

    def bind(self) -> None:
        """Gives methods that stand before their receiver's type to it."""
        for k, row in enumerate(self.rows):
            owner = self.types.get(self.unbound.get(row[1], ""))
            if row[0] == "symbol" and owner is not None:
                self.rows[k] = (*row[:4], owner, *row[5:])
                self.rows.append(("member", fact_id(self.path, "member", row[1]), row[2], "method", owner, row[5].partition(":")[0], *row[6:]))

    # Headers.

    def header(self, h: list[Token], opens: bool, end: Token) -> bool:
        """Declares what a header says; if it opens a body, pushes its frame. Says whether its names may be references."""
        words, notes, k, self.template = [], [], 0, []
        while k < len(h):
            t = h[k]
            if t.text == "@" and k + 1 < len(h) and self.language in ("java", "typescript", "javascript"):
                stop = bracket(h, k + 2) if k + 2 < len(h) and h[k + 2].text == "(" else k + 1
                notes.append((h[k + 1].text, "decorator", joined(h[k + 2 : stop + 1]), t, h[stop]))
                k = stop + 1
            elif t.text == "#" and k + 1 < len(h) and h[k + 1].text == "[":
                stop = bracket(h, k + 1)
                notes.append((joined(h[k + 2 : stop]), "attribute", "", t, h[stop]))
                k = stop + 1
            elif (t.text in MODIFIERS and (t.text, self.language) != ("static", "rust")) or (t.text == "const" and k + 1 < len(h) and h[k + 1].text in ("fn", "enum")):
                words.append(t.text)
                k = bracket(h, k + 1) + 1 if t.text == "pub" and k + 1 < len(h) and h[k + 1].text == "(" else k + 1
            elif t.text == "template" and self.language == "cpp" and len(h) > k + 1:
                stop = angle(h, k + 1)
                self.template = h[k + 2 : stop]
                k = stop + 1
            else:
                break
        body = h[k:]
        if self.language == "cpp" and len(body) > 1 and not words and body[0].text == ":":
            body = body[1:]
        if self.language == "cpp" and len(words) == 1 and body[:1] and body[0].text == ":":
            self.frames[-1].access, body, words = words[0], body[1:], []
        first = h[0] if h else end
        if body and self.imports(body, first, end):
            return False
        before = len(self.frames)
        if body and not self.keyword(body, words, opens, first, end):
            self.shape(body, words, opens, first, end)
        for name, kind, detail, t, stop in notes:
            self.add("annotation", name, kind, self.frames[-1].owner if len(self.frames) > before else None, detail, t, stop)
        if opens and len(self.frames) == before:
            inside = bool(body) and body[0].text == "impl"
            self.push("impl" if inside else "block", "impl" if inside else "", self.implemented(body) if inside else None, end)
        return not body or body[0].text not in ("package", "namespace")

    def implemented(self, body: list[Token]) -> int | None:
        names = [t.text for t in body]
        rest = names[names.index("for") + 1 :] if "for" in names else names[1:]
        known = [x for x in rest if x in self.types]
        return self.types[known[0]] if known else None

    def imports(self, body: list[Token], first: Token, end: Token) -> bool:
        head, texts, lang = body[0].text, [t.text for t in body], self.language
        unquoted = lambda x: x[1:-1] if x[:1] in "\"'`" else x
        strings = [unquoted(t.text) for t in body if t.kind == "str"]
        if head == "import" and lang == "go":
            for part in [body[i - (i > 0 and body[i - 1].kind in ("name", "op") and body[i - 1].text not in ("(", "import")) : i + 1] for i, t in enumerate(body) if t.kind == "str"]:
                self.add("import", unquoted(part[-1].text), "module", None, part[0].text if len(part) > 1 else "", part[0], part[-1])
        elif head == "import" and lang == "java":
            static = "static" in texts
            self.add("import", "".join(texts[1 + static :]), "static" if static else "module", None, "", first, end)
        elif head == "use" and lang == "rust":
            for path, alias in self.use_tree(body[1:], ""):
                self.add("import", path, "wildcard" if path.endswith("*") else "module", None, alias, first, end)
        elif head == "use" and lang == "php" and self.owner()[0] is None:
            for part in split_at(body[1:]):
                named = [t.text for t in part]
                self.add("import", "".join(named[: named.index("as")] if "as" in named else named), "type", None, named[-1] if "as" in named else "", part[0], part[-1])
        elif head in ("require", "require_once", "include", "include_once") and lang == "php" and strings:
            self.add("import", strings[0], "file", None, "", first, end)
        elif head == "using" and lang == "cpp":
            space = "namespace" in texts
            self.add("import", "".join(texts[1 + space :]), "namespace" if space else "symbol", None, "", first, end)
        elif lang == "javascript" and strings and head in ("const", "let", "var") and "require" in texts:
            self.add("import", strings[0], "require", None, joined(body[1 : texts.index("=")]) if "=" in texts else "", first, end)
            return False
        elif lang in ("typescript", "javascript") and strings and (head == "import" or ("from" in texts and first.text == "export")):
            self.script_import(body, first, end, strings[-1])
        else:
            return False
        return True

    def script_import(self, body: list[Token], first: Token, end: Token, source: str) -> None:
        texts = [t.text for t in body]
        what = body[texts[0] == "import" : texts.index("from")] if "from" in texts else []
        if first.text == "export":
            self.add("import", source, "reexport", None, joined(what), first, end)
            return
        if not what:
            self.add("import", source, "side_effect", None, "", first, end)
        for part in split_at(what):
            if part[0].text == "{":
                for one in split_at(part[1:-1]):
                    self.add("import", source, "named", None, f"{one[0].text}:{one[-1].text if len(one) > 1 else ''}", one[0], one[-1])
            else:
                self.add("import", source, "namespace" if part[0].text == "*" else "default", None, part[-1].text, part[0], part[-1])

    def use_tree(self, body: list[Token], before: str) -> list[tuple[str, str]]:
        """Paths of a use declaration and their aliases."""
        out = []
        for part in split_at(body):
            at = next((k for k, t in enumerate(part) if t.text == "{"), None)
            if at is not None:
                out += self.use_tree(part[at + 1 : bracket(part, at)], before + "".join(t.text for t in part[:at]))
            else:
                texts = [t.text for t in part]
                alias = texts[-1] if "as" in texts else ""
                out.append((before + "".join(texts[: texts.index("as")] if alias else texts), alias))
        return out

    def keyword(self, body: list[Token], words: list[str], opens: bool, first: Token, end: Token) -> bool:
        kind = DECLARES[self.language].get(body[0].text)
        if kind is None or (len(body) > 1 and body[1].text in ("(", "=", ":", ".") and body[0].text not in ("func", "var", "const", "function")):
            return False
        lang, rest = self.language, body[1:]
        if lang == "typescript" and kind == "constant" and rest[:1] and rest[0].text == "enum":
            kind, rest = "enum", rest[1:]
        if lang == "cpp" and kind == "enum" and rest[:1] and rest[0].text in ("class", "struct"):
            rest = rest[1:]
        if kind in ("function", "method"):
            return self.callable(rest, words, opens, first, end, None)
        if lang in ("c", "cpp") and body[0].text in ("struct", "class", "enum"):
            call = next((k for k, t in enumerate(body) if t.text in ("(", ":", "=")), 0)
            if call and body[call].text == "(" and len([t for t in body[1:call] if t.kind == "name"]) > 1:
                return False  # a function that returns one
        if lang == "go" and kind in ("variable", "constant", "type_alias") and rest[:1] and rest[0].text == "(":
            return True  # a group's lines come as headers of their own
        if body[0].text == "typedef":
            if opens:
                kind, rest = next(((DECLARES[lang][t.text], rest[1:]) for t in rest[:1] if t.text in ("struct", "enum")), (kind, rest))
            else:
                at = next((k for k, t in enumerate(rest) if t.text == "("), None)
                if at is None:
                    rest = [t for t in rest if t.kind == "name"][-1:]
                else:  # of a function, or a pointer to one
                    pointer = at + 1 < len(rest) and rest[at + 1].text == "*"
                    rest = [t for t in rest[at:] if t.kind == "name"][:1] if pointer else [t for t in rest[:at] if t.kind == "name"][-1:]
        names = [t for t in rest if t.kind == "name"]
        if lang in ("c", "cpp") and body[0].text in ("struct", "class", "enum") and not opens:
            return len(names) < 2
        if not names:
            return False
        name = names[0]
        if lang == "go" and body[0].text == "type":
            kind = next((t.text for t in rest[1:] if t.text in ("struct", "interface")), "type_alias") if opens else "type_alias"
        if kind in ("variable", "constant") and self.frames[-1].kind == "class":
            self.add("member", name.text, "constant" if kind == "constant" else "field", self.frames[-1].owner, self.visible(words, name.text), name, end)
            self.declared.add((name.line, name.col))
            return True
        title = name.text
        if kind in ("package", "namespace"):
            title = joined(rest).replace(" ", "")
        self.declared.add((name.line, name.col))
        owner = self.owner()[0]
        key = fact_id(self.path, "symbol", kind, title, first.line, first.col, "")
        if kind in ("variable", "constant") and lang in ("typescript", "javascript") and self.arrow(rest, title, words, opens, first, end):
            return True
        if kind not in ("package", "namespace", "variable", "constant"):
            self.type_parameters(self.template or self.generic(rest, name)[0], key)
        symbol = ("symbol", title, kind, owner, self.visible(words, title) + self.modifiers(words), first)
        if not opens or kind in ("variable", "constant", "type_alias"):
            self.add(*symbol, end)
            return True
        scope = "namespace" if kind in ("namespace", "package") else "module" if kind == "module" else "class"
        self.push(scope, kind, key if scope == "class" else None, end, symbol)
        if kind in TYPES:
            self.bases(rest[self.generic(rest, name)[1] :], key)
        return True

    def type_parameters(self, tokens: list[Token], key: int) -> None:
        """What stands between the angles (in Go, brackets) of a declaration."""
        go, held = self.language == "go", []
        for part in split_at(tokens):
            names = [t for t in part if t.kind == "name"]
            if not names:
                continue
            value = next((k for k, t in enumerate(part) if t.text == "=" and self.language in ("cpp", "typescript")), len(part))
            if self.language == "cpp":
                name = [t for t in part[:value] if t.kind == "name"][-1]
                kind, rest = ("type" if part[0].text in ("typename", "class") else "value"), []
            else:
                name = next((t for t in names if t.text not in ("const", "in", "out")), names[0])
                kind = "lifetime" if name.text[:1] == "'" else "value" if part[0].text == "const" and self.language == "rust" else "type"
                rest = part[part.index(name) + 1 : value]
                rest = rest[1:] if rest[:1] and rest[0].text == ":" else rest[1:] if self.language == "typescript" else rest
            held.append((name, kind, self.written(part, rest), part[-1]))
        for n, (name, kind, said, last) in enumerate(held):
            if go and not said:  # names that share the constraint after the last of them
                said = next((x[2] for x in held[n:] if x[2]), "")
            self.declared.add((name.line, name.col))
            self.add("type_parameter", name.text, kind, key, f"{n}:{said}", name, last)

    def generic(self, rest: list[Token], name: Token) -> tuple[list[Token], int]:
        """Tokens of the type parameters after a declaration's name, and where what follows them begins."""
        at = rest.index(name) + 1
        if at < len(rest) and rest[at].text == "<" and self.language in ("typescript", "java", "rust"):
            stop = angle(rest, at)
            return rest[at + 1 : stop], stop + 1
        if at < len(rest) and rest[at].text == "[" and self.language == "go":
            stop = bracket(rest, at)
            inside = rest[at + 1 : stop]
            if len(inside) > 1 and inside[0].kind == "name" and inside[1].text not in (".", "*", "+", "-"):
                return inside, stop + 1
        return [], at

    def arrow(self, rest: list[Token], title: str, words: list[str], opens: bool, first: Token, end: Token) -> bool:
        """A variable whose value is a function; says whether it is one."""
        at = next((k for k, t in enumerate(rest) if t.text == "="), len(rest))
        value = rest[at + 1 :]
        value = value[1:] if value[:1] and value[0].text == "async" else value
        if not value:
            return False
        start = next((k for k, t in enumerate(value) if t.text == "("), None) if value[0].text == "function" else 0
        if value[0].text == "<":
            start = angle(value, 0) + 1
        typed = value[1 : start - 1] if value[0].text == "<" else []
        if start is None or start >= len(value):
            return False
        if value[start].text == "(":
            stop = bracket(value, start)
            held, after = value[start + 1 : stop], value[stop + 1 :]
        else:
            held, after = value[start : start + 1], value[start + 1 :]
        outer = next((k for k, t in enumerate(after) if t.text == "=>"), None)
        if value[0].text != "function" and (outer is None or (outer > 0 and after[0].text != ":") or not (value[start].text == "(" or value[start].kind == "name")):
            return False
        key = fact_id(self.path, "symbol", "function", title, first.line, first.col, "")
        self.parameters(held, key)
        self.type_parameters(typed, key)
        self.returned(after[:outer], [], key)
        symbol = ("symbol", title, "function", self.owner()[0], self.visible(words, title), first)
        if opens and (value[0].text == "function" or outer == len(after) - 1):
            self.push("function", "", key, end, symbol)
        else:
            self.add(*symbol, end)
        return True

    def bases(self, rest: list[Token], key: int) -> None:
        """Names after extends, implements or a colon."""
        on = False
        for t in rest:
            if t.text in ("extends", "implements", ":") and (t.text != ":" or self.language == "cpp"):
                on = True
            elif on and t.kind == "name" and t.text not in MODIFIERS:
                self.add("member", t.text, "embedded" if self.language == "cpp" else "base_class", key, f"public:{t.text}", t, t)

    def callable(self, rest: list[Token], words: list[str], opens: bool, first: Token, end: Token, fixed: str | None) -> bool:
        """A function or method whose name and brackets are in rest."""
        owner, what = self.owner()
        receiver = []
        if self.language == "go" and rest[:1] and rest[0].text == "(":
            stop = bracket(rest, 0)
            receiver, rest = rest[1:stop], rest[stop + 1 :]
        at = next((k for k, t in enumerate(rest) if t.text == "("), None)
        named = [t for t in rest[:at] if t.kind == "name"]
        typed = self.template
        if self.language == "java" and rest[:1] and rest[0].text == "<":
            stop = angle(rest, 0)
            typed, rest = rest[1:stop], rest[stop + 1 :]
            at = next((k for k, t in enumerate(rest) if t.text == "("), None)
            named = [t for t in rest[:at] if t.kind == "name"]
        elif named and self.language not in TYPE_FIRST:
            typed, after = self.generic(rest, named[0])
            at = next((k for k, t in enumerate(rest) if t.text == "(" and k >= after), None)
        if at is None or not named:
            if self.language == "rust" and named:  # a macro
                at = len(rest)
            else:
                if opens:
                    self.push("function", "", None, end)
                return True
        name = named[0] if self.language not in TYPE_FIRST else named[-1]
        if receiver:
            held = [t.text for t in receiver if t.kind == "name"]
            owner = next((self.types[x] for x in held if x in self.types), None)
        method = bool(receiver) or what != "" or (self.language == "cpp" and at > 1 and rest[at - 2].text == "::")
        if method and self.language == "rust" and at < len(rest):  # what has no receiver belongs to the type, not to a value
            method = any(t.text == "self" for part in split_at(rest[at + 1 : bracket(rest, at)])[:1] for t in part)
        kind = fixed or ("method" if method else "function")
        self.declared.add((name.line, name.col))
        key = fact_id(self.path, "symbol", kind, name.text, first.line, first.col, "")
        symbol = ("symbol", name.text, kind, owner, self.visible(words, name.text) + self.modifiers(words), first)
        if receiver and owner is None and held:
            self.unbound[key] = held[min(1, len(held) - 1)]
        self.type_parameters(typed, key)
        if owner is not None and (kind in ("method", "constructor") or what):
            given = rest[: rest.index(name)] if self.language in TYPE_FIRST and kind != "constructor" else []
            said = self.written(rest, given) if self.language != "rust" else self.written(rest, rest)
            self.add("member", name.text, kind if kind == "constructor" else "method", owner, f"{self.visible(words, name.text)}:{said}".rstrip(":"), name, end)
        if receiver:
            self.parameter(receiver, key, 0, "receiver")
        stop = bracket(rest, at) if at < len(rest) else at
        self.parameters(rest[at + 1 : stop], key)
        self.returned(rest[stop + 1 :], rest[: rest.index(name)], key)
        if not opens:
            self.add(*symbol, end)
            return True
        self.push("function", "", key, end, symbol)
        return True

    def parameters(self, tokens: list[Token], key: int) -> None:
        parts, ordinal = split_at(tokens), 0
        named = self.language == "go" and any(len(x) > 1 and x[0].kind == "name" and x[1].text not in (".", "(", "[") or len(x) > 2 and x[0].kind == "name" and x[1].text == "[" and x[2].text == "]" for x in parts)
        for n, part in enumerate(parts):
            shared = next((x[1:] for x in parts[n:] if len(x) > 1), []) if named and len(part) == 1 else []
            ordinal += self.parameter(part, key, ordinal, "parameter", shared)

    def parameter(self, whole: list[Token], key: int, ordinal: int, kind: str, shared: list[Token] | None = None) -> int:
        """One parameter; in Go ``shared`` is the type that stands after a later name."""
        value = next((k for k, t in enumerate(whole) if t.text == "="), len(whole))
        part = [t for t in whole[:value] if t.text not in ("final", "mut", "readonly", "public", "private", "protected", "...")]
        names = [t for t in part if t.kind == "name"]
        if not names or (self.language in TYPE_FIRST and len(names) == 1):
            return 0
        name = names[-1] if self.language in TYPE_FIRST else next((t for t in names if t.text.startswith("$")), names[0])
        if name.text == "self":
            kind = "receiver"
        kept = [t for t in part if t is not name and t.text not in (":", "?")]
        said = self.written(whole, kept)
        if shared:
            said = self.written(shared, shared)
        elif kind == "receiver" and self.language == "rust" and ":" not in [t.text for t in whole]:
            said = self.written(whole, whole)
        self.declared.add((name.line, name.col))
        self.add("parameter", name.text.lstrip("$"), kind, key, f"{ordinal}:{said}", name, part[-1])
        return 1

    def returned(self, after: list[Token], before: list[Token], key: int) -> None:
        """Return types, numbered by themselves."""
        if self.language in TYPE_FIRST:
            while len(before) > 1 and before[-1].text == "::":
                before = before[:-2]
            kept = before
        else:
            kept = after[1:] if after[:1] and after[0].text in (":", "->") else after if self.language == "go" else []
        stop = next((k for k, t in enumerate(kept) if t.text in ("where", "=", "=>")), len(kept))
        kept = kept[:stop]
        if kept and self.language == "go" and kept[0].text == "(":
            parts = split_at(kept[1 : bracket(kept, 0)])
            named = any(len(x) > 1 and x[0].kind == "name" and x[1].text not in (".", "[", "(") for x in parts)
            for n, part in enumerate(parts):
                kind = next((x[1:] for x in parts[n:] if len(x) > 1), part) if named else part
                self.add("parameter", part[0].text if named else "", "return", key, f"{n}:{self.written(kind, kind)}", part[0], part[-1])
        elif kept and joined(kept) != "void":
            self.add("parameter", "", "return", key, f"0:{self.written(kept, kept)}", kept[0], kept[-1])

    def shape(self, body: list[Token], words: list[str], opens: bool, first: Token, end: Token) -> bool:
        """Methods, functions and fields without a keyword of their own."""
        if not body or body[0].text in CONTROL:
            return False
        lang, inside, what = self.language, self.frames[-1].kind == "class", self.frames[-1].what
        texts = [t.text for t in body]
        assigned = min((texts.index(x) for x in ("=", ":=") if x in texts), default=len(body))
        call = texts.index("(") if "(" in texts else len(body)
        if call < assigned and call > 0 and body[call - 1].kind == "name":
            bare = call == 1
            if inside and lang in ("java", "cpp", "typescript", "javascript") and what != "" and (opens or not bare or what == "interface" or lang == "cpp" or "abstract" in words):
                made = lang == "java" and bare
                return self.callable(body, words, opens, first, end, "constructor" if made else None)
            if inside and lang == "go" and what == "interface":
                self.add("member", body[0].text, "method", self.frames[-1].owner, f"{self.visible(words, body[0].text)}:{self.written(body, body)}", body[0], end)
                return False
            if inside and what == "enum" and bare:
                return self.variant(body, end)
            if lang in ("c", "cpp") and not bare and not any(f.kind in ("function", "class") for f in self.frames):
                return self.callable(body, words, opens, first, end, None)
            if not inside:
                return False
        if inside and what == "enum" and not (lang == "java" and len([t for t in body[:assigned] if t.kind == "name"]) > 1):
            return self.variant(body, end)
        if inside:
            return self.fields(body[:assigned], words, first, end)
        if lang == "go" and ":=" in texts:
            for t in body[: texts.index(":=")]:
                if t.kind == "name" and t.text != "_" and t.text not in CONTROL:
                    self.add("symbol", t.text, "variable", None, self.visible(words, t.text), t, end)
                    self.declared.add((t.line, t.col))
        elif lang in ("c", "cpp") and not opens:
            self.variables(body, words, first, end)
        return False

    def variables(self, body: list[Token], words: list[str], first: Token, end: Token) -> None:
        """A type and the names that it is given, at any depth of C and C++."""
        for n, part in enumerate(split_at(body)):
            stop = next((k for k, t in enumerate(part) if t.text in ("=", "[")), len(part))
            held = part[:stop]
            names = [t for t in held if t.kind == "name"]
            if len(names) < 2 - (n > 0) or any(t.kind != "name" and t.text not in ("*", "&", "::", "<", ">", ",") for t in held) or held[-1].kind != "name":
                return
            if names[0].text in CONTROL or names[0].text in ("goto", "break", "continue", "using", "delete") or (len(held) > 1 and held[-2].text == "::"):
                return
            self.declared.add((names[-1].line, names[-1].col))
            self.add("symbol", names[-1].text, "variable", None, self.visible(words, names[-1].text), first, end)

    def variant(self, body: list[Token], end: Token) -> bool:
        if body[0].kind == "name":
            self.add("member", body[0].text, "variant", self.frames[-1].owner, "public", body[0], body[-1])
            if self.language == "c":  # its names are visible without the enumeration's
                self.add("symbol", body[0].text, "constant", None, "public", body[0], body[-1])
            self.declared.add((body[0].line, body[0].col))
        return False

    def fields(self, part: list[Token], words: list[str], first: Token, end: Token) -> bool:
        lang, owner = self.language, self.frames[-1].owner
        names = [t for t in part if t.kind == "name"]
        if not names:
            return False
        if lang == "go" and (len(names) == 1 or part[0].text == "*" or (len(part) > 1 and part[1].text == ".")):
            kept = [t for t in part if t.kind != "str"]
            self.add("member", names[-1].text, "embedded", owner, f"{self.visible(words, names[-1].text)}:{self.written(part, kept).lstrip('*')}", part[0], part[-1])
            return False
        if lang == "php" and part[0].text == "use":
            for t in names[1:]:
                self.add("member", t.text, "embedded", owner, f"public:{t.text}", t, t)
            return False
        name = names[-1] if lang in TYPE_FIRST else next((t for t in names if t.text.startswith("$")), names[0])
        kind = "property" if lang in ("typescript", "javascript", "php") else "constant" if lang == "java" and {"static", "final"} <= set(words) else "field"
        self.declared.add((name.line, name.col))
        at = part.index(name)
        if lang in TYPE_FIRST or lang == "php":
            kept = part[:at]
        else:
            kept = [t for t in part[at + 1 :] if t.kind != "str"] if lang in ("go", "rust", "typescript") else []
            kept = kept[1:] if kept and kept[0].text in ("?", "!") else kept
            kept = kept[1:] if kept and kept[0].text == ":" else kept
        self.add("member", name.text.lstrip("$"), kind, owner, f"{self.visible(words, name.text)}:{self.written(part, kept)}".rstrip(":"), name, end)
        if lang == "java" and kind == "constant":
            self.add("symbol", name.text, kind, owner, self.visible(words, name.text), first, end)
        return False

    # The walk.

    def preprocessor(self, t: Token) -> None:
        if m := re.match(r"\s*#\s*include\s*[<\"]([^>\"]+)", t.text):
            self.add("import", m[1], "header", None, "", t, t)
        elif m := re.match(r"\s*#\s*define\s+(\w+)(\()?", t.text):
            self.add("symbol", m[1], "function" if m[2] else "constant", None, "public", t, t)

    def refer(self, k: int) -> None:
        t, before = self.tokens[k], self.tokens[k - 1].text if k else ""
        after = self.tokens[k + 1].text if k + 1 < len(self.tokens) else ""
        if (t.line, t.col) in self.declared or (t.text in CONTROL and (t.text, self.language) != ("new", "rust")) or t.text in MODIFIERS or t.text in DECLARES[self.language]:
            return
        scope = self.frames[-1].scope
        if (before in (".", "?.") or before == "->" and self.language in ("c", "cpp")) and self.language not in ("php", "ruby"):
            self.add("reference", t.text, "field_access", scope, "", t, t)
        elif after == "(" or (self.language == "ruby" and (before == "." or self.command(k))):
            self.add("reference", t.text, "call", scope, "", t, t)
        elif t.text[:1].isupper():
            self.add("reference", t.text, "type_annotation", scope, "", t, t)
        elif self.frames[-1].kind in ("function", "block") and (self.language == "c" or self.language in ("go", "javascript", "typescript") and after in (".", "?.") and t.text != "this"):
            self.add("reference", t.text, "read", scope, "", t, t)

    def command(self, k: int) -> bool:
        """Whether a Ruby name begins a line and is followed by an argument."""
        follows = self.tokens[k + 1].kind if k + 1 < len(self.tokens) else "nl"
        return (k == 0 or self.tokens[k - 1].kind == "nl") and follows in ("name", "str", "num") and self.tokens[k + 1].text not in ("if", "unless", "while", "until", "do", "and", "or")

    def ends(self, header: list[Token], k: int) -> bool:
        """Whether a line ends a statement."""
        last = header[-1].text
        after = next((t.text for t in self.tokens[k + 1 :] if t.kind != "nl"), "")
        return last not in ("=", ",", "+", "-", "*", "&", "|", "(", "[", ":", ".", "=>", "?", "<", "extends", "implements") and after not in (".", "?.", "{", "&", "|", "?", ":") or self.language == "go"

    def walk(self) -> None:
        first = Token("op", "", 0, 0)
        names: list[int] = []  # of the header, referred to once it is known what it declares
        group = ""
        opened = closed = first  # of the group

        def settle(opens: bool, end: Token) -> None:
            f = self.frames[-1]
            h, f.header = f.header, []
            if group and h and h[0].text != group and not opens:
                at, end = (h[0], end) if group == "type" else (opened, closed)
                h = [Token("name", group, at.line, at.col), *h]
            grown = len(self.frames)
            refers = self.header(h, opens, end) if h or opens else True
            inner = self.frames[grown:]
            del self.frames[grown:]
            for k in names if refers else ():
                self.refer(k)
            names.clear()
            self.frames += inner

        for k, t in enumerate(self.tokens):
            f = self.frames[-1]
            if t.kind == "pre":
                self.preprocessor(t)
                continue
            if t.kind == "name":
                names.append(k)
            inline = t.text == "{" and f.header and (f.header[0].text == "use" and self.language == "rust" or f.header[0].text in ("import", "export") and self.language in ("typescript", "javascript") and len(f.header) < 4 and f.header[-1].text in ("import", "export", ",", "type"))
            if t.kind == "op" and t.text in "([" or inline:
                if t.text == "(" and self.language == "go" and f.depth == 0 and len(f.header) == 1 and f.header[0].text in ("var", "const", "type"):
                    opened, closed = f.header[0], self.tokens[bracket(self.tokens, k)]
                    group, f.header = opened.text, []
                    continue
                f.depth += 1
                f.header.append(t)
            elif t.kind == "op" and t.text in ")]" or (t.text == "}" and f.depth and f.header and f.header[0].text in ("use", "import", "export")):
                if group and f.depth == 0:
                    settle(False, t)
                    group = ""
                    continue
                f.depth = max(f.depth - 1, 0)
                f.header.append(t)
            elif t.text == "{" and t.kind == "op":
                held, group = group, ""
                settle(True, t)
                group = held
            elif t.text == "}" and t.kind == "op":
                settle(False, t)
                if len(self.frames) > 1:
                    self.pop(t)
            elif t.text == ";" and f.depth == 0:
                settle(False, t)
            elif t.text == "," and f.depth == 0 and f.kind == "class" and (f.what == "enum" or (f.what == "struct" and self.language == "rust")):
                settle(False, t)
            elif t.text == ":" and self.language == "cpp" and f.depth == 0 and len(f.header) == 1 and f.header[0].text in ("public", "protected", "private"):
                f.access, f.header = f.header[0].text, []
            elif t.kind == "nl":
                if f.depth == 0 and f.header and self.ends(f.header, k):
                    settle(False, f.header[-1])
            else:
                f.header.append(t)
        settle(False, self.tokens[-1] if self.tokens else self.frames[0].at)

    def walk_ruby(self) -> None:
        line: list[Token] = []
        looped = False
        for k, t in enumerate(self.tokens):
            if t.kind == "nl" or t.text == ";":
                if line:
                    self.ruby_line(line)
                line, looped = [], False
                continue
            line.append(t)
            head, before = len(line) == 1, line[-2].text if len(line) > 1 else ""
            if t.kind != "name" or before in (".", ":"):
                if t.kind == "name" and before == ".":
                    self.refer(k)
                continue
            if t.text == "end":
                if len(self.frames) > 1:
                    self.pop(t)
            elif t.text in ("class", "module") and head or t.text == "def":
                self.ruby_open(k, t)
            elif t.text in ("if", "unless", "while", "until", "for", "case", "begin") and (head or before in ("=", "(")):
                looped = t.text in ("while", "until", "for")
                self.push("block", "", None, t)
            elif t.text == "do" and not looped:
                self.push("block", "", None, t)
            elif t.text not in ("if", "unless", "while", "until", "do", "then", "self", "nil", "true", "false"):
                self.refer(k)
        if line:
            self.ruby_line(line)

    def ruby_open(self, k: int, t: Token) -> None:
        rest = []
        for x in self.tokens[k + 1 :]:
            if x.kind == "nl" or x.text == ";":
                break
            rest.append(x)
        names = [x for x in rest if x.kind == "name"]
        if not names or (rest[0].text == "<"):
            self.push("class", "", self.frames[-1].owner, t)  # class << self
            return
        name = names[1] if names[0].text == "self" and len(names) > 1 else names[0]
        self.declared.add((name.line, name.col))
        owner, what = self.owner()
        kind = {"class": "class", "module": "module", "def": "method" if what else "function"}[t.text]
        key = fact_id(self.path, "symbol", kind, name.text, t.line, t.col, "")
        self.push("function" if t.text == "def" else "class", "" if t.text == "def" else kind, key, t, ("symbol", name.text, kind, owner, self.frames[-1].access, t))
        if t.text == "def":
            for n, part in enumerate(split_at([x for x in rest[rest.index(name) + 1 :] if x.text not in "()"])):
                if part[0].kind == "name" or len(part) > 1 and part[0].text in "*&":
                    one = next(x for x in part if x.kind == "name")
                    self.declared.add((one.line, one.col))
                    self.add("parameter", one.text, "parameter", key, f"{n}:", one, one)
        elif len(names) > 1 and any(x.text == "<" for x in rest):
            self.add("member", names[-1].text, "base_class", key, f"public:{names[-1].text}", names[-1], names[-1])

    def ruby_line(self, line: list[Token]) -> None:
        head, f = line[0], self.frames[-1]
        values = [t for t in line[1:] if t.kind in ("name", "str")]
        if head.text in ("require", "require_relative") and values:
            self.add("import", values[0].text.strip("\"'"), "relative" if head.text == "require_relative" else "module", None, "", head, line[-1])
        elif f.kind == "class" and head.text in ("private", "protected", "public") and not values:
            f.access = head.text
        elif f.kind == "class" and head.text in ("attr_reader", "attr_writer", "attr_accessor", "include", "extend", "prepend"):
            for t in values:
                attribute = head.text.startswith("attr")
                self.add("member", t.text, "property" if attribute else "embedded", f.owner, "public" if attribute else f"public:{t.text}", t, t)
        elif f.kind == "class" and len(line) > 2 and line[1].text == "=" and head.text[:1].isupper():
            self.add("member", head.text, "constant", f.owner, f.access, head, line[-1])
