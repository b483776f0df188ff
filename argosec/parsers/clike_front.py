"""A tolerant front end for JavaScript, TypeScript, Go, Java, C# and PHP.

A tokenizer and an operator parser that only recognise what rules look at: calls, assignments,
names, chains, literals, pairs, functions, classes, returns, loops, tries. What they don't know is
passed over a token at a time, so no input fails.
"""

from __future__ import annotations

import re

from argosec.parsers.html_front import Lines
from argosec.parsers.tree import Node, unquote

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|<\?php|<\?=?|\?>)
    |(?P<str>@?\$?@?"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
    |(?P<num>\d[\w.]*)
    |(?P<id>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
    |(?P<op>\.\.\.|\?->|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|::|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.=|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|<<|>>|<-|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??=", ".="}
_BINARY = {"+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "==", "!=", "===", "!==", "<=", ">=", "&&", "||", "??", "<<", ">>", "?", "**"}
_PREFIX = {"!", "-", "+", "~", "*", "&", "...", "++", "--", "<-", "@"}
_JS_PREFIX = {"await", "typeof", "delete", "void", "yield", "throw", "async"}
_WORD_PREFIX = {
    "javascript": _JS_PREFIX,
    "typescript": _JS_PREFIX,
    "go": {"go"},
    "java": {"throw"},
    "csharp": {"await", "throw", "ref", "out", "in"},
    "php": {"print", "clone", "throw"},
}
_MODIFIERS = {"static", "public", "private", "protected", "internal", "final", "abstract", "override", "virtual", "readonly", "sealed", "synchronized", "export", "default", "declare", "async", "partial", "volatile", "transient", "unsafe", "extern", "native"}
_WORD_BINARY = {"instanceof", "in", "of", "is", "as", "satisfies", "and", "or", "xor"}
_CONSTANTS = {"true", "false", "null", "undefined", "nil", "True", "False", "NULL", "TRUE", "FALSE"}
_PHP_CALLS = {"echo", "include", "include_once", "require", "require_once"}


class _Parser:
    def __init__(self, source: str, language: str):
        self.s, self.lang, self.where = source, language, Lines(source)
        self.js, self.typed = language in ("javascript", "typescript"), language in ("java", "csharp")
        self.t: list[tuple[str, str, int, int]] = []
        i, before = 0, "op"
        if language == "php" and "<?" in source:
            i = source.index("<?")
        while i < len(source):
            if self.js and source[i] == "/" and before in ("op", "word") and (m := _REGEX.match(source, i)):
                self.t.append(("str", m[0], i, m.end()))
                i, before = m.end(), "str"
                continue
            if language == "php" and source[i] == "#" and source[i : i + 2] != "#[":
                i = (source.find("\n", i) + len(source)) % (len(source) + 0 or 1) if source.find("\n", i) >= 0 else len(source)
                continue
            if language == "csharp" and source.startswith('@"', i):
                end = re.compile(r'@"(?:[^"]|"")*"').match(source, i)
                if end:
                    self.t.append(("str", end[0], i, end.end()))
                    i, before = end.end(), "str"
                    continue
            if language == "php" and source.startswith("?>", i):
                nxt = source.find("<?", i)
                self.t.append(("op", ";", i, i + 2))
                i, before = (nxt if nxt >= 0 else len(source)), "op"
                continue
            m = _TOKEN.match(source, i)
            i = m.end()
            if m.lastgroup != "skip":
                self.t.append((m.lastgroup, m[0], m.start(), m.end()))
                before = "word" if m[0] in ("return", "typeof", "case") else "x" if m.lastgroup != "op" or m[0] in ")]}" else "op"
        self.i, self.n, self.header = 0, len(self.t), 0

    # tokens
    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < self.n else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < self.n else ""

    def accept(self, *texts: str) -> bool:
        if self.i < self.n and self.peek() in texts and self.kind() != "str":
            self.i += 1
            return True
        return False

    def span(self, a: int, z: int | None = None) -> tuple:
        z = self.i - 1 if z is None else z
        if a >= self.n:
            return (*self.where(len(self.s)), *self.where(len(self.s)))
        return (*self.where(self.t[a][2]), *self.where(self.t[max(a, z)][3]))

    def text(self, a: int, z: int | None = None) -> str:
        z = self.i if z is None else z
        return self.s[self.t[a][2] : self.t[z - 1][3]] if z > a else ""

    def skip_balanced(self, *stop: str) -> None:
        deep = 0
        while self.i < self.n:
            x = self.peek()
            if deep == 0 and x in stop:
                return
            deep += (x in "([{<" and self.kind() == "op") - (x in ")]}>" and self.kind() == "op")
            if deep < 0:
                return
            self.i += 1

    def node(self, kind: str, a: int, children=(), text: str = "", **attrs) -> Node:
        return Node(kind, text, self.span(a), list(children), {k: v for k, v in attrs.items() if v is not None})

    # statements
    def file(self) -> Node:
        out = []
        while self.i < self.n:
            out.append(self.statement())
        root = Node("module", "", (1, 0, *self.where(len(self.s))), [x for x in out if x])
        return root

    def block(self) -> Node:
        a, out = self.i, []
        self.accept("{")
        old, self.header = self.header, 0
        while self.i < self.n and self.peek() != "}":
            out.append(self.statement())
        self.accept("}")
        self.header = old
        return self.node("block", a, [x for x in out if x])

    def body(self) -> Node:
        if self.peek() == "{":
            return self.block()
        a = self.i
        one = self.statement()
        return self.node("block", a, [one] if one else [])

    def head(self) -> list[Node]:
        """What stands between a keyword and its block."""
        out = []
        if self.peek() == "(" and self.lang != "go":
            out.append(self.group("(", ")"))
        else:
            self.header += 1
            while self.i < self.n and self.peek() not in ("{", "}"):
                at = self.i
                e = self.expression()
                if e:
                    out.append(e)
                if self.i == at:
                    self.i += 1
            self.header -= 1
        return out

    def statement(self) -> Node | None:
        a, x, k = self.i, self.peek(), self.kind()
        if k == "op":
            if x in (";", ",", ")", "]", "}", ":"):
                self.i += 1
                return None
            if x == "{":
                return self.block()
            if x == "@" and self.typed or x == "#" or (x == "@" and self.js):
                self.i += 1
                e = self.expression()
                return self.node("unknown", a, [e] if e else [])
            if x == "[" and self.lang == "csharp":
                return self.group("[", "]")
        if k == "id" and self.peek(1) not in (".", "=", ":=", "->", "::") or x in ("return",):
            if x in ("if", "elseif"):
                self.i += 1
                children = [*self.head(), self.body()]
                while self.peek() in ("else", "elseif"):
                    b = self.i
                    if self.accept("else") and self.peek() != "if":
                        children.append(self.node("unknown", b, [self.body()]))
                        break
                    self.i += 1
                    more = [*self.head(), self.body()]
                    children.append(self.node("unknown", b, more))
                return self.node("if", a, children)
            if x in ("for", "foreach", "while", "switch", "select", "using", "lock", "fixed", "synchronized", "with") and (self.peek(1) in ("(", "{", "await") or self.lang == "go") and not (x in ("using", "synchronized") and self.peek(1) != "("):
                self.i += 1
                self.accept("await")
                kind = {"for": "for", "foreach": "for", "while": "while", "switch": "switch", "select": "select"}.get(x, "unknown")
                return self.node(kind, a, [*self.head(), self.body()])
            if x == "do" and self.peek(1) == "{":
                self.i += 1
                b = self.body()
                cond = self.head() if self.accept("while") else []
                return self.node("while", a, [b, *cond])
            if x == "try":
                return self.try_()
            if x == "return":
                self.i += 1
                b = self.i
                e = None if self.peek() in (";", "}") else self.expression_list()
                return self.node("return", a, [e] if e else [], return_expr=self.text(b) if e else None)
            if x == "defer":
                self.i += 1
                e = self.expression()
                return self.node("defer", a, [e] if e else [])
            if x in ("import", "using", "package", "namespace") or x == "use" and self.lang == "php":
                if x == "import" and self.peek(1) == "(" and self.js:
                    return self.expression_list()
                return self.import_()
            if x in ("case", "default") and not self.js or x == "case":
                self.i += 1
                e = None if self.peek() == ":" else self.expression()
                return e
            if x in _MODIFIERS and self.kind(1) in ("id", "op") and self.peek(1) not in ("=", "(", "."):
                self.i += 1
                return self.statement()
            if x in ("const", "let", "var", "type") and (self.kind(1) == "id" or self.peek(1) in ("(", "{", "[")):
                return self.declaration()
            if x in ("function", "func", "fn"):
                return self.function()
            if x in ("class", "interface", "enum", "trait", "record", "struct") and self.kind(1) == "id" and not (x == "record" and self.peek(1) == "("):
                return self.class_()
            if x in _PHP_CALLS and self.lang == "php":
                return self.php_call()
        e = self.expression_list()
        if self.i == a:
            self.i += 1
            return None
        # Type name ... : a declaration in Java, C# or a typed PHP property; a call and a block: a method
        if e and e.kind == "call" and self.peek() in ("{", ":", "throws") and not self.header and self.method_like():
            return self.function_from(e, a)
        if e and self.kind() == "id" and (self.typed or self.lang == "php") and self.peek() not in _WORD_BINARY and e.kind in ("identifier", "attribute", "binary_op", "unknown"):
            return self.typed_declaration(a, e)
        return e

    def method_like(self) -> bool:
        if self.peek() == "{":
            return not self.lang == "go"
        j = self.i
        while j < self.n and self.t[j][1] not in ("{", ";", "}", "="):
            j += 1
        return j < self.n and self.t[j][1] == "{" and j - self.i < 24

    def function_from(self, call: Node, a: int) -> Node:
        self.skip_balanced("{")
        name = call.children[0]
        given = call.children[-1]
        names = [c.text for c in given.walk() if c.kind == "identifier"]
        body = self.block() if self.peek() == "{" else None
        return self.node("function_def", a, [name, given, *([body] if body else [])], parameters=names or None, function_name=None if self.js else name.text or None)

    def typed_declaration(self, a: int, kind: Node) -> Node | None:
        out = [Node("unknown", "", kind.loc, [kind])]
        while self.kind() == "id":
            b = self.i
            name = Node("identifier", self.peek(), self.span(b, b))
            self.i += 1
            if self.peek() == "(" and (j := self.closing(self.i)) and (self.t[j + 1][1] if j + 1 < self.n else "") in ("{", "throws", ";", "where", "=>", ":"):
                return self.named_function(a, name)
            while self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
            if self.accept("="):
                c = self.i
                e = self.expression()
                out.append(self.node("assignment", b, [name, *([e] if e else [])], lhs=name.text, rhs=self.text(c)))
            elif self.peek() == "{":  # a property with accessors
                out.append(self.block())
                if self.accept("="):
                    c = self.i
                    e = self.expression()
                    out.append(self.node("assignment", b, [name, *([e] if e else [])], lhs=name.text, rhs=self.text(c)))
            elif self.accept("=>"):
                e = self.expression()
                out += [e] if e else []
            elif self.typed and self.peek() in (",", ";"):
                out.append(self.node("assignment", b, [name], lhs=name.text))
            elif self.lang == "csharp" and self.accept("in"):
                e = self.expression()
                out += [name, *([e] if e else [])]
            elif self.accept(":"):
                e = self.expression()
                out += [name, *([e] if e else [])]
            else:
                out.append(name)
            if not self.accept(","):
                break
        return self.node("unknown", a, out)

    def closing(self, i: int) -> int:
        deep = 0
        for j in range(i, self.n):
            if self.t[j][0] == "op":
                deep += (self.t[j][1] in "([{") - (self.t[j][1] in ")]}")
                if deep == 0:
                    return j
        return 0

    def parameters(self) -> tuple[Node, list[str]]:
        """A parenthesised list: the name of each parameter is its last word before a default, or in Go and TypeScript its first."""
        a, names, nodes = self.i, [], []
        end = self.closing(self.i)
        self.accept("(")
        while self.i < end:
            words, b = [], self.i
            while self.i < end and self.peek() not in (",", "=") and not (self.peek() == ":" and self.js):
                if self.peek() in ("<", "[", "{"):
                    if self.peek() == "{" and self.js:
                        self.i += 1
                        continue
                    close = {"<": ">", "[": "]", "{": "}"}[self.peek()]
                    self.i += 1
                    self.skip_balanced(close)
                    self.accept(close)
                    continue
                if self.kind() == "id" and self.peek() not in _MODIFIERS:
                    words.append(self.i)
                self.i += 1
            if self.js and self.accept(":"):
                self.skip_balanced(",", "=", ")")
            if words:
                j = words[0] if self.lang == "go" or self.js else words[-1]
                names.append(self.t[j][1])
                nodes.append(Node("identifier", self.t[j][1], self.span(j, j)))
            if self.accept("="):
                e = self.expression()
                nodes += [e] if e else []
            if not self.accept(",") and self.i < end and self.i == b:
                self.i += 1
        self.i = max(self.i, end)
        self.accept(")")
        return self.node("unknown", a, nodes), names

    def named_function(self, a: int, name: Node | None) -> Node:
        params, names = self.parameters()
        if self.peek() != "{":
            self.skip_balanced("{", ";", "=>")
        children = [*([name] if name else []), params]
        if self.accept("=>"):
            e = self.expression()
            children += [e] if e else []
        elif self.peek() == "{":
            children.append(self.block())
        return self.node("function_def", a, children, parameters=names or None, function_name=name.text if name and not self.js else None)

    def function(self) -> Node:
        a = self.i
        self.i += 1
        self.accept("*", "&")
        if self.lang == "go" and self.peek() == "(" and self.kind() == "op":
            j = self.closing(self.i)
            if j + 2 < self.n and self.t[j + 1][0] == "id" and self.t[j + 2][1] == "(":
                self.i = j + 1
        name = None
        if self.kind() == "id":
            name = Node("identifier", self.peek(), self.span(self.i, self.i))
            self.i += 1
        if self.peek() == "<":
            self.skip_balanced("(")
        if self.peek() != "(":
            return self.node("unknown", a, [name] if name else [])
        params, names = self.parameters()
        if self.lang == "php" and self.accept("use") and self.peek() == "(":
            self.parameters()
        children = [*([name] if name else []), params]
        if self.peek() not in ("{", "=>", ";"):
            if self.lang == "go":
                while self.i < self.n and self.peek() != "{" and self.peek() not in (")", "}", ",", ";"):
                    if self.peek() == "(":
                        self.i = self.closing(self.i) + 1
                    elif self.peek() in ("interface", "struct") and self.peek(1) == "{":
                        self.i = self.closing(self.i + 1) + 1
                    else:
                        self.i += 1
            else:
                self.skip_balanced("{", "=>", ";", ")", ",")
        if self.accept("=>"):
            e = self.expression()
            children += [e] if e else []
        elif self.peek() == "{":
            children.append(self.block())
        return self.node("function_def", a, children, parameters=names or None, function_name=name.text if name and not self.js else None)

    def class_(self) -> Node:
        a = self.i
        self.i += 1
        name = Node("identifier", self.peek(), self.span(self.i, self.i))
        self.i += 1
        bases = []
        while self.i < self.n and self.peek() not in ("{", ";"):
            if self.peek() == "(":
                bases.append(self.group("(", ")"))
                continue
            self.i += 1
        body = [self.block()] if self.peek() == "{" else []
        return Node("class_def" if self.lang != "go" else "unknown", "", self.span(a), [name, *bases, *body])

    def try_(self) -> Node:
        a = self.i
        self.i += 1
        children = [self.group("(", ")")] if self.peek() == "(" else []
        children.append(self.block())
        handlers = []
        while self.peek() in ("catch", "finally"):
            b, word = self.i, self.peek()
            self.i += 1
            types, inner = [], []
            if self.peek() == "(":
                c = self.i
                inner.append(self.group("(", ")"))
                types = [self.text(c + 1, self.i - 1)]
            if self.peek() == "when":
                inner += self.head()
            block = self.block()
            children.append(self.node("unknown", b, [*inner, block]))
            if word == "catch" and self.lang not in ("java", "go"):
                handlers.append((not types, types, not block.children))
        return self.node("try", a, children, except_handlers=handlers or None)

    def import_(self) -> Node:
        a, names = self.i, []
        self.i += 1
        line = self.where(self.t[a][2])[0]
        if self.peek() == "(":
            self.i = self.closing(self.i) + 1
            return self.node("import", a)
        while self.i < self.n and self.peek() != ";" and (self.where(self.t[self.i][2])[0] == line or self.peek() in ("}", "from", ",") or self.kind() == "str" or self.kind() == "id" and self.t[self.i - 1][1] in ("{", ",")):
            if self.peek() == "{" and self.lang in ("csharp", "php", "java"):
                break
            if self.kind() == "id" and self.peek() not in ("from", "as", "type", "static"):
                names.append(Node("identifier", self.peek(), self.span(self.i, self.i)))
            self.i += 1
        self.accept(";")
        return self.node("import", a, [self.node("unknown", a, names)])

    def declaration(self) -> Node:
        a, out = self.i, []
        go = self.lang == "go"
        self.i += 1
        if go and self.peek() == "(":
            self.i += 1
            while self.i < self.n and self.peek() != ")":
                at = self.i
                out.append(self.declarator(True))
                self.accept(";", ",")
                if self.i == at:
                    self.i += 1
            self.accept(")")
            return self.node("unknown", a, [x for x in out if x])
        while True:
            d = self.declarator(go)
            out += [d] if d else []
            if not self.accept(","):
                break
        return self.node("unknown", a, out)

    def declarator(self, go: bool) -> Node | None:
        b = self.i
        if self.peek() in ("{", "["):
            left = self.group(self.peek(), {"{": "}", "[": "]"}[self.peek()])
        elif self.kind() == "id":
            left = Node("identifier", self.peek(), self.span(b, b))
            self.i += 1
            while go and self.peek() == "," and self.kind(1) == "id":
                self.i += 2
        else:
            return None
        lhs = self.text(b)
        if self.js and (self.accept("!") or True) and self.accept(":"):
            self.skip_balanced("=", ",", ";", ")", "of", "in")
        if go and self.peek() not in ("=", ")", ";"):
            line = self.where(self.t[b][2])[0]
            while self.i < self.n and self.peek() != "=" and self.where(self.t[self.i][2])[0] == line and self.peek() not in (")", "}", ";"):
                if self.peek() in ("struct", "interface") and self.peek(1) == "{":
                    self.i = self.closing(self.i + 1)
                self.i += 1
        if self.accept("of", "in"):
            e = self.expression()
            return self.node("unknown", b, [left, *([e] if e else [])])
        if not self.accept("="):
            return self.node("assignment", b, [left], lhs=lhs)
        c = self.i
        e = self.expression_list() if go else self.expression()
        return self.node("assignment", b, [left, *([e] if e else [])], lhs=lhs, rhs=self.text(c))

    def php_call(self) -> Node:
        a = self.i
        name = Node("identifier", self.peek(), self.span(a, a))
        self.i += 1
        args = []
        while e := self.expression():
            args.append(e)
            if not self.accept(","):
                break
        return self.node("call", a, [name, self.node("unknown", a, args)], argument_count=len(args))

    # expressions
    def expression_list(self) -> Node | None:
        """An expression, or in Go several with commas on the left of an assignment."""
        a = self.i
        e = self.expression()
        if self.lang == "go" and e and self.peek() == "," and not self.header:
            many = [e]
            while self.accept(","):
                more = self.expression()
                if not more:
                    break
                many.append(more)
            if many[-1].kind == "assignment":
                last = many.pop()
                left = self.node("unknown", a, [*many, last.children[0]])
                return self.node("assignment", a, [left, *last.children[1:]], lhs=self.s[self.t[a][2] : self.s.index(last.attrs["lhs"], self.t[a][2]) + len(last.attrs["lhs"])], rhs=last.attrs.get("rhs"))
            return self.node("unknown", a, many)
        return e

    def expression(self) -> Node | None:
        a = self.i
        left = self.unary()
        if left is None:
            return None
        parts, at = [left], a
        while self.i < self.n and self.kind() != "str":
            x = self.peek()
            if x in _ASSIGN:
                z = self.i
                lhs_node, begin = parts[-1], at
                self.i += 1
                c = self.i
                right = self.expression()
                made = Node("assignment", "", self.span(begin), [lhs_node, *([right] if right else [])], {"lhs": self.text(begin, z), "rhs": self.text(c), "augmented": x not in ("=", ":=")})
                parts[-1] = made
                break
            if x == "=>" and self.lang == "php" or x == ":" and self.lang == "csharp" and len(parts) == 1 and left.kind == "identifier" and self.pairs:
                break
            if x in ("=>", "->") and self.lang != "php":
                self.i += 1
                names = [c.text for p in parts[-1:] for c in p.walk() if c.kind == "identifier"]
                body = self.block() if self.peek() == "{" else self.expression()
                parts[-1] = self.node("function_def", at, [parts[-1], *([body] if body else [])], parameters=names or None)
                continue
            if x == "?" and self.js and self.peek(1) in (":", ")", ","):
                break
            if x in _BINARY or x == "." and self.lang == "php" or x in _WORD_BINARY and self.kind() == "id" and not (x in ("as", "satisfies") and not (self.js or self.lang == "csharp")) and not (x == "in" and self.lang == "go"):
                if x in ("as", "satisfies") :
                    self.i += 1
                    self.type_()
                    continue
                self.i += 1
                if x == "?":
                    mid = self.expression()
                    if self.accept(":"):
                        end = self.expression()
                        parts = [self.node("unknown", a, [*parts, *(p for p in (mid, end) if p)])]
                        at = a
                    elif mid:
                        parts.append(mid)
                    continue
                at = self.i
                right = self.unary()
                if right is None:
                    break
                parts.append(right)
                continue
            break
        return parts[0] if len(parts) == 1 else self.node("binary_op", a, parts)

    pairs = False

    def type_(self) -> None:
        if self.kind() == "id":
            self.i += 1
            while self.peek() == "." and self.kind(1) == "id":
                self.i += 2
            if self.peek() == "<":
                self.i += 1
                self.skip_balanced(">")
                self.accept(">")
            while self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
        elif self.peek() in ("{", "[", "("):
            self.i = self.closing(self.i) + 1

    def unary(self) -> Node | None:
        a, x = self.i, self.peek()
        if self.i >= self.n:
            return None
        word = self.kind() == "id" and x in _WORD_PREFIX[self.lang] and (self.kind(1) in ("id", "str", "num") or self.peek(1) in ("(", "{", "[", "!", "&", "*"))
        if self.kind() == "op" and x in _PREFIX or word or x in _MODIFIERS and self.kind(1) == "id":
            if x == "print" and self.lang == "php":
                return self.php_call()
            if x in ("async",) and self.peek(1) == "function":
                self.i += 1
                return self.unary()
            self.i += 1
            e = self.unary()
            return self.node("unknown", a, [e] if e else [])
        return self.postfix(self.primary())

    def group(self, open_: str, close: str) -> Node:
        """Everything between two brackets, as a list of expressions and pairs."""
        a, out = self.i, []
        self.accept(open_)
        old, self.header = self.header, 0
        was, self.pairs = self.pairs, True
        while self.i < self.n and not (self.peek() == close and self.kind() == "op"):
            at = self.i
            e = self.pair() if open_ == "{" and self.js else self.expression()
            if e and self.peek() in (":", "=>") and self.kind() == "op" and self.lang in ("go", "php", "csharp"):
                self.i += 1
                v = self.expression()
                e = self.node("unknown", at, [e, *([v] if v else [])])
            elif e and self.typed and self.kind() == "id" and e.kind in ("identifier", "attribute", "binary_op"):
                e = self.typed_declaration(at, e)
            elif e and self.js and self.peek() == ":" and open_ == "(":
                self.i += 1
                self.skip_balanced(",", "=", ")")
            if e:
                out.append(e)
            if self.i == at:
                if self.peek() == "}" and close != "}":
                    break
                if self.kind() == "id" and self.peek() in ("const", "let", "var"):
                    e = self.declaration()
                    out += [e]
                else:
                    self.i += 1
        self.accept(close)
        self.header, self.pairs = old, was
        return self.node("unknown", a, out)

    def pair(self) -> Node | None:
        """A member of an object literal."""
        a = self.i
        if self.kind() in ("id", "str", "num") and self.peek(1) == ":" and self.t[self.i + 1][0] == "op":
            key = Node("identifier", self.peek(), self.span(a, a)) if self.kind() == "id" else Node("literal", unquote(self.peek()), self.span(a, a))
            name = self.peek()
            self.i += 2
            c = self.i
            v = self.expression()
            return self.node("keyword_argument", a, [key, *([v] if v else [])], kwarg_name=name, kwarg_value=self.text(c))
        e = self.expression()
        if e and e.kind == "call" and self.peek() == "{":
            return self.function_from(e, a)
        return e

    def primary(self) -> Node | None:
        a, x, k = self.i, self.peek(), self.kind()
        if k == "str":
            self.i += 1
            inner = []
            if x[0] == "`" and "${" in x or x.startswith("$") or self.lang == "php" and x[0] == '"':
                inner = self.embedded(x, a)
            return self.node("literal", a, inner, unquote(x.lstrip("@$")) if x[0] in "\"'`@$" else x)
        if k == "num" or k == "id" and x in _CONSTANTS:
            self.i += 1
            return self.node("literal", a, text=x)
        if k == "id":
            if x in ("function", "func", "fn") and (self.peek(1) in ("(", "*", "&") or self.kind(1) == "id"):
                return self.function()
            if x == "class" and (self.js or self.lang == "php") and (self.peek(1) == "{" or self.kind(1) == "id"):
                return self.class_()
            if x == "new" and self.kind(1) == "id":
                return self.new()
            if x in _PHP_CALLS and self.lang == "php":
                return self.php_call()
            if x in ("map", "chan", "struct", "interface") and self.lang == "go" and self.peek(1) in ("[", "{"):
                self.i += 1
                inner = [self.group("[", "]")] if self.peek() == "[" else []
                while self.kind() == "id" or self.peek() in ("[", "]", "*", "."):
                    self.i += 1
                inner += [self.group("{", "}")] if self.peek() == "{" and not self.header else []
                return self.node("unknown", a, inner)
            if x in ("if", "for", "while", "return", "else", "case", "catch", "try", "switch"):
                return None
            self.i += 1
            return self.node("identifier", a, text=x)
        if x == "(":
            g = self.group("(", ")")
            if self.typed and len(g.children) == 1 and (self.kind() in ("id", "str") or self.peek() == "(") and g.children[0].kind in ("identifier", "attribute"):
                e = self.unary()  # a cast
                return self.node("unknown", a, [g, *([e] if e else [])])
            return g if len(g.children) != 1 or self.peek() in ("=>", "->") else self.node("unknown", a, g.children)
        if x == "[":
            g = self.group("[", "]")
            if self.lang == "go" and (self.kind() == "id" or self.peek() == "*"):
                self.accept("*")
                e = self.postfix(self.primary())
                return self.node("unknown", a, [g, *([e] if e else [])])
            return g
        if x == "{":
            return self.group("{", "}")
        if x == "\\" and self.lang == "php":
            self.i += 1
            return self.primary()
        if x == "<" and self.js:
            return None
        return None

    def embedded(self, x: str, a: int) -> list[Node]:
        """Names inside an interpolated string."""
        base = self.t[a][2]
        found = re.finditer(r"\$(?:\{([^}]*)\}|([A-Za-z_]\w*))|\{\$?([^}{]*)\}" if self.lang == "php" else r"\$?\{([^}]*)\}", x)
        out = []
        for m in found:
            body = next((g for g in m.groups() if g), "")
            if self.lang == "php":
                body = "$" + body.lstrip("$")
            sub = _Parser(body, self.lang)
            e = sub.expression()
            if e:
                at = (*self.where(base + m.start()), *self.where(base + m.end()))
                for d in e.walk():
                    d.loc = at
                out.append(e)
        return out

    def new(self) -> Node:
        a = self.i
        word = Node("unknown", "new", self.span(a, a))
        self.i += 1
        b = self.i
        kind = Node("identifier", self.peek(), self.span(b, b))
        self.i += 1
        while self.peek() in (".", "\\") and self.kind(1) == "id":
            name = Node("identifier", self.peek(1), self.span(self.i + 1, self.i + 1))
            self.i += 2
            kind = name if self.lang in ("java", "php") else self.node("attribute", b, [kind, name])
        if self.peek() == "<":
            self.i += 1
            self.skip_balanced(">")
            self.accept(">")
        while self.peek() == "[":
            return self.node("unknown", a, [kind, self.group("[", "]"), *([self.group("{", "}")] if self.peek() == "{" else [])])
        args = self.group("(", ")") if self.peek() == "(" else self.node("unknown", a)
        more = []
        if self.peek() == "{" and self.typed:
            more = [self.block()] if self.lang == "java" else [self.group("{", "}")]
        if self.lang == "php":
            return self.node("unknown", a, [kind, args])
        children = [kind, args, *more] if self.lang == "java" else [word, kind, args, *more]
        return self.node("call", a, children, argument_count=len(args.children))

    def postfix(self, e: Node | None) -> Node | None:
        if e is None:
            return None
        a = self.i - 1
        begin = e.loc[:2]

        def at(kind, children, **attrs):
            return Node(kind, "", (*begin, *self.span(max(a, 0))[2:]), children, attrs)

        while self.i < self.n and self.kind() == "op":
            x = self.peek()
            if x in (".", "?.") and self.lang != "php" or x in ("->", "?->", "::") and self.lang == "php" or x == "::" and self.typed:
                if self.kind(1) == "id":
                    name = Node("identifier", self.peek(1), self.span(self.i + 1, self.i + 1))
                    self.i += 2
                    if self.lang == "php":
                        if self.peek() == "(":
                            args = self.group("(", ")")
                            e = at("call", [e, name, args], argument_count=len(args.children))
                        else:
                            e = at("unknown", [e, name])
                    else:
                        if self.lang == "java" and self.peek() == "<":
                            pass
                        e = at("attribute", [e, name])
                elif self.peek(1) in ("(", "["):
                    self.i += 1
                elif self.peek(1) == "<" and self.lang == "java":
                    self.i += 2
                    self.skip_balanced(">")
                    self.accept(">")
                    self.i -= 1
                    if self.kind(1) == "id":
                        name = Node("identifier", self.peek(1), self.span(self.i + 1, self.i + 1))
                        self.i += 2
                        e = at("attribute", [e, name])
                    else:
                        self.i += 1
                else:
                    break
            elif x == "(":
                args = self.group("(", ")")
                e = at("call", [e, args], argument_count=len(args.children))
            elif x == "[":
                sub = self.group("[", "]")
                if self.js:
                    e = at("attribute", [e, *sub.children])
                else:
                    e = at("attribute" if self.lang == "csharp" else "unknown", [e, sub])
            elif x in ("++", "--"):
                self.i += 1
            elif x == "!" and self.lang == "typescript" and self.peek(1) in (".", ")", ",", ";", "["):
                self.i += 1
            elif x == "{" and self.lang == "go" and not self.header and e.kind in ("identifier", "attribute"):
                e = at("unknown", [e, self.group("{", "}")])
            elif x == "<" and (self.typed or self.lang == "typescript") and self.generic_call():
                self.i = self.generic_call()
            else:
                break
        if e.kind == "identifier" and self.kind() == "str" and self.peek()[0] == "`" and self.js:
            lit = self.primary()
            e = at("call", [e, *([lit] if lit else [])], argument_count=1)
        return e

    def generic_call(self) -> int:
        """Place after a list of type arguments that a call or a name follows; 0 if this is a comparison."""
        deep = 0
        for j in range(self.i, min(self.n, self.i + 30)):
            k, x = self.t[j][:2]
            if x == "<":
                deep += 1
            elif x in (">", ">>"):
                deep -= len(x)
                if deep <= 0:
                    nxt = self.t[j + 1] if j + 1 < self.n else ("", "")
                    return j + 1 if nxt[1] in ("(", "[") or nxt[0] == "id" and self.typed or nxt[1] == "." else 0
            elif not (k == "id" or x in (",", ".", "?", "[", "]", "&", "|")):
                return 0
        return 0


def parse(source: str, language: str) -> tuple[Node, str | None]:
    return _Parser(source, language).file(), None
