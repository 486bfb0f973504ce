"""C#."""

from __future__ import annotations

import re

from riskframe.syntax.base import Cursor, Fault

#: C#'s reserved words, modifiers, and the precedence of binary operators.
KEYWORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
MODIFIERS = frozenset("abstract const extern internal new override private protected public readonly sealed static unsafe virtual volatile fixed ref".split())
SOFT_MODIFIERS = frozenset(["async", "partial", "required", "file", "scoped"])
PRECEDENCE = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "is": 8, "as": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "..": 12,
}
ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "??="])

_TOKEN = re.compile(
    r"""\s*(?:(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*\*/)|(?P<interp>\$+@?"|@\$")
|(?P<raw>"{3,})|(?P<STR>@"(?:[^"]|"")*"(?:u8)?|"(?:[^"\\\n]|\\.)*"(?:u8)?|'(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.))')
|(?P<ID>@?[^\W\d]\w*|\\u[0-9a-fA-F]{4}\w*)
|(?P<NUM>0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:[0-9][0-9_]*(?:\.[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[fFdDmMuUlL]*)
|(?P<op>\?\?=|<<=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|->|::|<<|\.\.|[-+*/%&|^!~<>=?:;,.(){}\[\]\#])|\Z)""",
    re.X,
)
_BLANKS = re.compile(r"\s*")
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)([^\n]*)")
_NOT_START = frozenset([";", ")", "]", "}", ",", ":", "EOF", "=", "==", "!=", "=>", ".", "?", "??", "&&", "||", "|", "^", "/", "%", "<=", ">=", "is", "as", "switch", "with", "in"])


class parser(Cursor):
    def __init__(self, src, ext):
        super().__init__(src, ext)
        self.K, self.S, self.E = [], [], []
        self.holes: dict[int, list] = {}  # token of an interpolated text: the code in it, as (start, end)
        self.defined: set[str] = set()
        self.conditions: list[list] = []
        self.lex(0, len(src))
        for c in self.conditions:
            self.faults.append(Fault("unexpected-end", len(src), "#endif expected"))
        self.K.append("EOF"), self.S.append(len(src)), self.E.append(len(src))
        self.scopes: list[str] = []

    # Tokens.
    def lex(self, at, n):
        src, match = self.src, _TOKEN.match
        K, S, E = self.K, self.S, self.E
        kind, start_, end_ = K.append, S.append, E.append
        while at < n:
            m = match(src, at, n)
            if m is None:
                at = _BLANKS.match(src, at, n).end()
                if at >= n:
                    break
                quote = src[at] in "\"'" or src.startswith('@"', at) or src.startswith("/*", at)
                self.faults.append(Fault("unterminated-literal" if quote else "bad-token", at, f"unexpected character {src[at]!r}"))
                nl = src.find("\n", at)
                at = (n if nl < 0 or src[at] in "@/" else nl) if quote else at + 1
                continue
            g, at = m.lastgroup, m.end()
            if g == "ID":
                t = m[g]
                kind(t if t in KEYWORDS else "ID")
                start_(at - len(t))
                end_(at)
            elif g == "op":
                t = m[g]
                begin = at - len(t)
                if t == "#" and not src[src.rfind("\n", 0, begin) + 1 : begin].strip():
                    at = self.directive(begin, n)
                else:
                    kind(t)
                    start_(begin)
                    end_(at)
            elif g == "interp" or g == "raw":
                at = self.interpolated(m.start(g), m[g], n)
            elif g == "NUM" or g == "STR":
                kind(g)
                start_(m.start(g))
                end_(at)

    def directive(self, at, n):
        """Handles a preprocessor line; code whose condition doesn't hold is skipped. The offset to go on at."""
        src = self.src
        m = _DIRECTIVE.match(src, src.rfind("\n", 0, at) + 1)
        word, rest = m[1], m[2]
        if word == "define":
            self.defined.add(rest.strip())
        elif word == "undef":
            self.defined.discard(rest.strip())
        elif word == "if":
            self.conditions.append([at, self.holds(rest, at)])
            if not self.conditions[-1][1]:
                return self.skip(m.end(), n)
        elif word in ("elif", "else"):
            if not self.conditions:
                self.faults.append(Fault("unexpected-token", at, "#" + word))
            else:
                return self.skip(m.end(), n)  # an earlier branch held
        elif word == "endif":
            if not self.conditions:
                self.faults.append(Fault("unexpected-token", at, "#endif"))
            else:
                self.conditions.pop()
        elif word not in ("region", "endregion", "pragma", "nullable", "line", "warning", "error", "r", "load"):
            self.faults.append(Fault("bad-token", at, f"unknown directive #{word}"))
        return m.end()

    def skip(self, at, n):
        """Past the code up to the branch that holds or the end of the condition."""
        src, depth = self.src, 0
        while True:
            nl = src.find("\n", at)
            if nl < 0:
                return n
            m = _DIRECTIVE.match(src, nl + 1)
            at = nl + 1
            if m is None:
                continue
            w = m[1]
            if w == "if":
                depth += 1
            elif w == "endif":
                if depth == 0:
                    self.conditions.pop()
                    return m.end()
                depth -= 1
            elif depth == 0 and w in ("else", "elif") and not self.conditions[-1][1]:
                if w == "else" or self.holds(m[2], m.start()):
                    self.conditions[-1][1] = True
                    return m.end()
            at = m.end()

    def holds(self, text, at):
        words = re.findall(r"\w+|&&|\|\||==|!=|[!()]", text.split("//")[0])
        out = [("not " if w == "!" else " and " if w == "&&" else " or " if w == "||" else w if w in ("==", "!=", "(", ")") else str(w == "true" or w in self.defined)) for w in words]
        try:
            return bool(eval("".join(out).strip(), {"__builtins__": {}}))  # made of True, False, operators and brackets only
        except SyntaxError:
            self.faults.append(Fault("unexpected-token", at, "condition expected"))
            return False

    def interpolated(self, at, opening, n):
        """A $ text, a raw text or both; notes where its code stands. The offset after it."""
        src = self.src
        dollars = opening.count("$")
        quotes = at + len(opening.rstrip('"'))
        run = len(src[quotes:n]) - len(src[quotes:n].lstrip('"'))
        raw = run >= 3 and "@" not in opening
        verbatim = "@" in opening
        holes = []
        at0, at = at, quotes + (run if raw else 1)
        close = '"' * run if raw else '"'
        width = dollars if raw else 1
        while True:
            if at >= n:
                self.faults.append(Fault("unterminated-literal", at0, "text without end"))
                return n
            c = src[at]
            if raw and src.startswith(close, at):
                end = at + len(close)
                while src[end : end + 1] == '"':
                    end += 1
                break
            if not raw and c == '"':
                if verbatim and src[at + 1 : at + 2] == '"':
                    at += 2
                    continue
                end = at + 1
                break
            if not raw and c == "\n" and not verbatim:
                self.faults.append(Fault("unterminated-literal", at0, "text without end"))
                return at
            if not raw and not verbatim and c == "\\":
                at += 2
                continue
            if dollars and c == "{":
                braces = 0
                while src[at + braces : at + braces + 1] == "{":
                    braces += 1
                if (raw and braces < width) or (not raw and braces % 2 == 0):
                    at += braces
                    continue
                start = at + braces
                end = self.hole_end(start, n)
                holes.append((start, end))
                at = end + width
                continue
            if dollars and not raw and c == "}":
                if src[at + 1 : at + 2] == "}":
                    at += 2
                    continue
                self.faults.append(Fault("unexpected-token", at, "unexpected }"))
            at += 1
        if src.startswith("u8", end):
            end += 2
        self.K.append("STR"), self.S.append(at0), self.E.append(end)
        if holes:
            self.holes[at0] = holes
        return end

    def hole_end(self, at, n):
        """Where the code that starts at an offset ends: at the brace that closes it."""
        src, depth = self.src, 0
        while at < n:
            c = src[at]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if depth == 0:
                    return at
                depth -= 1
            elif c in "\"'$@":
                m = _TOKEN.match(src, at, n)
                if m is not None and m.lastgroup in ("interp", "raw"):
                    k, s, e, h = len(self.K), len(self.S), len(self.E), dict(self.holes)
                    at = self.interpolated(at, m[0], n)
                    del self.K[k:], self.S[s:], self.E[e:]
                    self.holes = h
                    continue
                if m is not None and m.lastgroup == "STR":
                    at = m.end()
                    continue
            at += 1
        return n

    def check_holes(self, at):
        """Parses the code in an interpolated text: an expression, then optional alignment and format."""
        for start, end in self.holes.get(at, ()):
            outer = self.K, self.S, self.E, self.i
            self.K, self.S, self.E, self.i = [], [], [], 0
            self.lex(start, end)
            self.K.append("EOF"), self.S.append(end), self.E.append(end)
            try:
                self.expression()
                if self.maybe(","):
                    self.expression()
                if self.K[self.i] not in ("EOF", ":"):
                    self.fail()
            finally:
                self.K, self.S, self.E, self.i = outer

    def word(self, w, i=None):
        i = self.i if i is None else i
        return self.K[i] == "ID" and self.src[self.S[i] : self.E[i]] == w

    def maybe_word(self, w):
        if self.word(w):
            self.i += 1
            return True
        return False

    def name(self):
        return self.text(self.take("ID"))

    def scoped(self, name):
        return ".".join([*self.scopes, name])

    # Declarations.
    def file(self):
        while self.K[self.i] == "extern" and self.word("alias", self.i + 1):
            self.i += 2
            self.name()
            self.take(";")
        self.top_level(self.top, stops=frozenset(["namespace", "class", "public", "internal"]))
        if not self.modules:
            self.modules.append({"system": "csharp-namespace", "name": "global::"})

    def top(self):
        k = self.K[self.i]
        if k == "using" and self.K[self.i + 1] not in ("(",) and self.using_ahead():
            self.using(False)
        elif self.word("global") and self.K[self.i + 1] == "using":
            self.i += 1
            self.using(True)
        elif k == "[" and (self.word("assembly", self.i + 1) or self.word("module", self.i + 1)):
            self.attributes()
        elif k == "namespace":
            self.namespace()
        elif k == ";":
            self.i += 1
        else:
            start = self.i
            if self.attempt(self.type_declaration_head):
                self.i = start
                self.type_declaration()
            elif self.scopes:
                self.type_declaration()
            else:
                self.statement()

    def using_ahead(self):
        """A using directive, not a using declaration."""
        j = self.i + 1
        if self.K[j] in ("static", "unsafe"):
            return True
        if self.K[j] != "ID":
            return False
        if self.K[j + 1] == "=":
            return not self.scopes or True
        while self.K[j + 1] in (".", "::") and self.K[j + 2] == "ID":
            j += 2
        return self.K[j + 1] in (";", "<") and not (self.word("var", self.i + 1))

    def using(self, is_global):
        start = self.take("using")
        kind, binding = "using", ""
        if self.maybe("static"):
            kind = "using-static"
        self.maybe("unsafe")
        if self.K[self.i] == "ID" and self.K[self.i + 1] == "=":
            kind, binding = "using-alias", self.text()
            self.i += 2
        a = self.i
        self.type_()
        self.references.append({"kind": kind, "specifier": "".join(self.src[self.S[a] : self.E[self.i - 1]].split()), "binding": binding, "scope": ".".join(self.scopes), "start": self.S[start], "end": self.E[self.i - 1]})
        self.take(";")

    def namespace(self):
        self.take("namespace")
        a = self.i
        self.name()
        while self.maybe("."):
            self.name()
        name = self.src[self.S[a] : self.E[self.i - 1]]
        self.scopes.append(name)
        self.modules.append({"system": "csharp-namespace", "name": ".".join(self.scopes)})
        if self.maybe(";"):
            return
        self.take("{")
        while self.K[self.i] not in ("}", "EOF"):
            self.guarded(self.top)
        self.take("}")
        self.maybe(";")
        self.scopes.pop()

    def attributes(self):
        while self.K[self.i] == "[":
            self.i += 1
            if (self.K[self.i] in ("ID", "return", "event")) and self.K[self.i + 1] == ":":
                self.i += 2
            while self.K[self.i] != "]":
                self.type_()
                if self.K[self.i] == "(":
                    self.arguments()
                if not self.maybe(","):
                    break
            self.take("]")

    def modifiers(self):
        while True:
            k = self.K[self.i]
            if k in MODIFIERS:
                if k == "new" and self.K[self.i + 1] in ("(", "[", "{"):
                    return
                if k == "ref" and self.K[self.i + 1] not in ("struct", "ID") or k == "fixed" and self.K[self.i + 1] == "(":
                    return
                if k == "ref" and not self.word("partial", self.i + 1) and self.K[self.i + 1] != "struct":
                    return
                self.i += 1
            elif k == "ID" and self.text() in SOFT_MODIFIERS and (self.K[self.i + 1] in MODIFIERS or self.K[self.i + 1] in ("ID", "class", "struct", "interface", "enum", "void", "delegate", "event", "(") or self.K[self.i + 1] in PREDEFINED):
                if self.K[self.i + 1] == "(" and self.text() != "async":
                    return
                if self.K[self.i + 1] == "(":
                    return
                self.i += 1
            else:
                return

    def type_declaration_head(self):
        self.attributes()
        self.modifiers()
        k = self.K[self.i]
        if k in ("class", "struct", "interface", "enum"):
            return True
        if k == "delegate" and self.K[self.i + 1] not in ("(", "{", "*"):
            return True
        if self.word("record") and self.K[self.i + 1] in ("ID", "class", "struct"):
            return self.K[self.i + 1] != "ID" or self.K[self.i + 2] in ("(", "{", ":", ";", "<")
        self.fail("type expected")

    def type_declaration(self):
        self.attributes()
        start = self.i
        self.modifiers()
        k = self.K[self.i]
        if k == "enum":
            self.i += 1
            t = self.begin_type("enum", self.scoped(self.name()), self.S[start])
            if self.maybe(":"):
                self.type_()
            self.take("{")
            while self.K[self.i] != "}":
                self.attributes()
                self.name()
                if self.maybe("="):
                    self.expression()
                if not self.maybe(","):
                    break
            self.take("}")
            self.maybe(";")
            self.end_type(t)
            return
        if k == "delegate":
            self.i += 1
            self.return_type()
            t = self.begin_type("delegate", self.scoped(self.name()), self.S[start])
            self.type_params()
            self.params("(", ")")
            self.constraints()
            self.take(";")
            self.end_type(t)
            return
        kind = k
        if self.maybe_word("record"):
            kind = "record"
            self.maybe("class") or self.maybe("struct")
        elif k in ("class", "struct", "interface"):
            self.i += 1
        else:
            self.fail("type declaration expected")
        name = self.name()
        t = self.begin_type(kind, self.scoped(name), self.S[start])
        self.type_params()
        if self.K[self.i] == "(":
            self.params("(", ")")
        if self.maybe(":"):
            while True:
                self.type_()
                if self.K[self.i] == "(":
                    self.arguments()
                if not self.maybe(","):
                    break
        self.constraints()
        if not self.maybe(";"):
            self.take("{")
            self.scopes.append(name)
            while self.K[self.i] not in ("}", "EOF"):
                self.guarded(self.member, name)
            self.scopes.pop()
            self.take("}")
            self.maybe(";")
        self.end_type(t)

    def type_params(self):
        if self.maybe("<"):
            while True:
                self.attributes()
                self.maybe("in") or self.maybe("out")
                self.name()
                if not self.maybe(","):
                    break
            self.take(">")

    def constraints(self):
        while self.word("where") and self.K[self.i + 1] == "ID":
            self.i += 2
            self.take(":")
            while True:
                k = self.K[self.i]
                if k == "new":
                    self.i += 1
                    self.take("(")
                    self.take(")")
                elif k in ("class", "struct", "default"):
                    self.i += 1
                    self.maybe("?")
                elif self.maybe_word("allows"):
                    self.take("ref")
                    self.take("struct")
                else:
                    self.type_()
                if not self.maybe(","):
                    break

    def member(self, owner):
        if self.maybe(";"):
            return
        self.attributes()
        start = self.i
        self.modifiers()
        K = self.K
        k = K[self.i]
        if k in ("class", "struct", "interface", "enum") or (k == "delegate" and K[self.i + 1] != "*") or (self.word("record") and K[self.i + 1] in ("ID", "class", "struct") and (K[self.i + 1] != "ID" or K[self.i + 2] in ("(", "{", ":", ";", "<"))):
            self.i = start
            return self.type_declaration()
        if k == "~":
            self.i += 1
            return self.callable("destructor", self.name(), start)
        if k == "event":
            self.i += 1
            self.type_()
            self.member_name()
            if K[self.i] == "{":
                self.accessors("")
            else:
                while True:
                    if self.maybe("="):
                        self.expression()
                    if not self.maybe(","):
                        break
                    self.name()
                self.take(";")
            return
        if k in ("implicit", "explicit"):
            self.i += 1
            self.take("operator")
            checked = "checked " if self.maybe("checked") else ""
            a = self.i
            self.type_()
            target = "".join(self.src[self.S[a] : self.E[self.i - 1]].split())
            return self.callable("conversion_operator", f"{checked}{k} operator {target}", start)
        if k == "ID" and K[self.i + 1] == "(" and self.text() == owner:
            self.i += 1
            return self.callable("constructor", owner, start)
        self.return_type()
        if K[self.i] == "operator" or (K[self.i] == "ID" and self.explicit_operator()):
            while K[self.i] != "operator":
                self.i += 1
            self.i += 1
            checked = "checked " if self.maybe("checked") else ""
            a = self.i
            while K[self.i] != "(":
                if K[self.i] in ("EOF", ";", "{", "}"):
                    self.fail()
                self.i += 1
            return self.callable("operator", f"{checked}operator {self.src[self.S[a] : self.E[self.i - 1]]}", start)
        prefix, name = self.member_name()
        k = K[self.i]
        if name == "this":
            j = self.begin_callable("indexer", self.scoped(prefix + "this"), self.S[start])
            self.params("[", "]")
            if K[self.i] == "=>":
                self.body_of(j)
                self.i += 1
                self.expression()
                self.take(";")
                self.end_callable(j)
            else:
                self.callables.pop(), self.open.pop(), self.cx.pop()
                self.depth -= 1
                self.accessors(prefix + "this")
        elif k in ("(", "<"):
            self.callable("method", prefix + name, start)
        elif k == "{":
            self.accessors(prefix + name)
            if self.maybe("="):
                self.expression(self.scoped(name))
                self.take(";")
        elif k == "=>":
            j = self.begin_callable("property", self.scoped(prefix + name), self.S[start])
            self.body_of(j)
            self.i += 1
            self.expression()
            self.take(";")
            self.end_callable(j)
        else:
            if k == "[":  # a fixed buffer
                self.i += 1
                self.expression()
                self.take("]")
            if self.maybe("="):
                self.initializer(self.scoped(name))
            while self.maybe(","):
                other = self.name()
                if self.maybe("="):
                    self.initializer(self.scoped(other))
            self.take(";")

    def explicit_operator(self):
        j = self.i
        while self.K[j] == "ID" and self.K[j + 1] == ".":
            j += 2
        return self.K[j] == "operator"

    def member_name(self):
        """(explicit interface prefix, name) of a member; this for an indexer."""
        a = self.i
        while True:
            if self.K[self.i] == "this":
                self.i += 1
                return self.src[self.S[a] : self.S[self.i - 1]], "this"
            n = self.i
            self.name()
            if self.K[self.i] == "<":
                m = self.mark()
                if self.attempt(self.type_args) and self.K[self.i] == ".":
                    self.i += 1
                    continue
                self.back(m)
            if self.K[self.i] in (".", "::"):
                self.i += 1
                continue
            return self.src[self.S[a] : self.S[n]], self.text(n)

    def callable(self, kind, name, start):
        j = self.begin_callable(kind, self.scoped(name), self.S[start])
        self.type_params()
        self.params("(", ")")
        if kind == "constructor" and self.maybe(":"):
            if self.K[self.i] not in ("base", "this"):
                self.fail()
            self.i += 1
            self.arguments()
        self.constraints()
        if self.K[self.i] == "{":
            self.body_of(j)
            self.block()
            self.maybe(";")
        elif self.K[self.i] == "=>":
            self.body_of(j)
            self.i += 1
            self.expression()
            self.take(";")
        else:
            self.take(";")
        self.end_callable(j)

    def accessors(self, owner):
        self.take("{")
        if self.K[self.i] == "}":
            self.fail("accessor expected")
        while self.K[self.i] != "}":
            self.attributes()
            start = self.i
            self.modifiers()
            name = self.name()
            if name not in ("get", "set", "init", "add", "remove"):
                self.fail("accessor expected", self.i - 1)
            j = self.begin_callable("accessor", self.scoped(f"{owner}.{name}" if owner else name), self.S[start])
            if self.K[self.i] == "{":
                self.body_of(j)
                self.block()
            elif self.K[self.i] == "=>":
                self.body_of(j)
                self.i += 1
                self.expression()
                self.take(";")
            else:
                self.take(";")
            self.end_callable(j)
        self.take("}")

    def params(self, open_, close):
        self.take(open_)
        while self.K[self.i] != close:
            self.attributes()
            while self.K[self.i] in ("ref", "out", "in", "params", "this", "readonly") or (self.word("scoped") and self.K[self.i + 1] in ("ID", "ref", "in", "out")):
                self.i += 1
            if self.word("__arglist"):
                self.i += 1
            else:
                self.type_()
                self.name()
                if self.maybe("="):
                    self.expression()
            if not self.maybe(","):
                break
        self.take(close)

    # Types.
    def return_type(self):
        if self.maybe("ref"):
            self.maybe("readonly")
        self.type_()

    def type_(self):
        k = self.K[self.i]
        if k in PREDEFINED:
            self.i += 1
        elif k == "ID":
            self.qualified_name()
        elif k == "(":
            self.i += 1
            n = 0
            while True:
                self.type_()
                self.maybe("ID")
                n += 1
                if not self.maybe(","):
                    break
            self.take(")")
            if n < 2:
                self.fail("tuple type expected")
        elif k == "delegate" and self.K[self.i + 1] == "*":
            self.i += 2
            while self.K[self.i] == "ID":
                self.i += 1
            if self.K[self.i] == "[":
                self.i += 1
                while not self.maybe("]"):
                    self.i += 1
            self.take("<")
            while True:
                while self.K[self.i] in ("ref", "out", "in", "readonly"):
                    self.i += 1
                self.type_()
                if not self.maybe(","):
                    break
            self.take(">")
        else:
            self.fail("type expected")
        while True:
            k = self.K[self.i]
            if k == "?" or k == "*":
                self.i += 1
            elif k == "[" and self.K[self.i + 1] in ("]", ","):
                self.i += 1
                while self.maybe(","):
                    pass
                self.take("]")
            else:
                return

    def qualified_name(self):
        self.name()
        if self.K[self.i] == "::":
            self.i += 1
            self.name()
        if self.K[self.i] == "<":
            self.type_args()
        while self.K[self.i] == "." and self.K[self.i + 1] == "ID":
            self.i += 1
            self.name()
            if self.K[self.i] == "<":
                self.type_args()

    def type_args(self):
        self.take("<")
        if self.K[self.i] in (",", ">"):
            while self.maybe(","):
                pass
        else:
            while True:
                self.attributes()
                self.type_()
                if not self.maybe(","):
                    break
        self.close_angle()

    def close_angle(self):
        if self.K[self.i] == ">=":
            i = self.i
            self.K[i : i + 1], self.S[i : i + 1], self.E[i : i + 1] = [">", "="], [self.S[i], self.S[i] + 1], [self.S[i] + 1, self.E[i]]
        self.take(">")

    # Statements.
    def block(self):
        self.take("{")
        while self.K[self.i] not in ("}", "EOF"):
            self.guarded(self.statement)
        self.take("}")

    def statement(self):
        k = self.K[self.i]
        f = self.STATEMENTS.get(k)
        if f is not None:
            return f(self)
        if k == "[" and self.attempt(self.attributes):
            k = self.K[self.i]
        if k == "ID":
            if self.K[self.i + 1] == ":":
                self.i += 2
                if self.K[self.i] != "}":
                    self.statement()
                return
            w = self.text()
            if w == "yield" and self.K[self.i + 1] in ("return", "break"):
                self.i += 1
                if self.maybe("return"):
                    self.expression()
                else:
                    self.take("break")
                self.take(";")
                return
            if w == "await" and self.K[self.i + 1] in ("foreach", "using"):
                self.i += 1
                return self.statement()
        if k == "case" or k == "default" and self.K[self.i + 1] == ":":
            self.fail()
        start = self.i
        if self.attempt(self.local_function_head):
            self.local_function(start)
        elif self.attempt(self.local_head):
            self.local_rest()
        else:
            self.expression()
            self.take(";")

    def local_function_head(self):
        while self.K[self.i] in ("static", "unsafe", "extern") or (self.word("async") and self.K[self.i + 1] != "("):
            self.i += 1
        self.return_type()
        self.local_name = self.i
        self.name()
        if self.K[self.i] == "<":
            self.type_params()
        if self.K[self.i] != "(":
            self.fail()
        self.tree()
        if self.K[self.i] not in ("{", "=>") and not (self.word("where") and self.K[self.i + 1] == "ID"):
            self.fail()
        self.i = self.local_name
        return True

    def tree(self):
        close = self.OPEN[self.K[self.i]]
        self.i += 1
        while self.K[self.i] != close:
            k = self.K[self.i]
            if k == "EOF" or k in self.CLOSE:
                self.fail()
            if k in self.OPEN:
                self.tree()
            else:
                self.i += 1
        self.i += 1

    def local_function(self, start):
        self.callable("local_function", self.name(), start)

    def local_head(self):
        self.maybe("const")
        if self.word("scoped") and self.K[self.i + 1] in ("ID", "ref"):
            self.i += 1
        if self.maybe("ref"):
            self.maybe("readonly")
        self.type_()
        if self.K[self.i] != "ID" or self.K[self.i + 1] not in ("=", ";", ",", "["):
            self.fail()
        return True

    def local_rest(self):
        self.declarators()
        self.take(";")

    def declarators(self):
        while True:
            name = self.name()
            if self.maybe("="):
                self.initializer(self.scoped(name))
            if not self.maybe(","):
                return

    def initializer(self, name=None):
        if self.K[self.i] == "{":
            self.array_initializer()
        elif self.maybe("ref"):
            self.expression()
        elif self.maybe("stackalloc"):
            self.stackalloc()
        else:
            self.expression(name)

    def array_initializer(self):
        self.take("{")
        while self.K[self.i] != "}":
            self.initializer()
            if not self.maybe(","):
                break
        self.take("}")

    def stackalloc(self):
        if self.K[self.i] != "[":
            self.type_()
        if self.maybe("["):
            if self.K[self.i] != "]":
                self.expression()
            self.take("]")
        if self.K[self.i] == "{":
            self.array_initializer()

    def declare(self):
        self.i += 1
        self.type_()
        self.declarators()
        self.take(";")

    def if_(self):
        self.i += 1
        self.branch()
        self.parens()
        self.statement()
        if self.maybe("else"):
            self.statement()

    def parens(self):
        self.take("(")
        self.expression()
        self.take(")")

    def while_(self):
        self.i += 1
        self.branch()
        self.parens()
        self.statement()

    def do_(self):
        self.i += 1
        self.branch()
        self.statement()
        self.take("while")
        self.parens()
        self.take(";")

    def for_(self):
        self.i += 1
        self.branch()
        self.take("(")
        if self.K[self.i] != ";":
            if self.attempt(self.local_head):
                self.declarators()
            else:
                self.expressions()
        self.take(";")
        if self.K[self.i] != ";":
            self.expression()
        self.take(";")
        if self.K[self.i] != ")":
            self.expressions()
        self.take(")")
        self.statement()

    def expressions(self):
        self.expression()
        while self.maybe(","):
            self.expression()

    def foreach(self):
        self.i += 1
        self.branch()
        self.take("(")
        if not self.attempt(self.foreach_head):
            self.expression()
            self.take("in")
        self.expression()
        self.take(")")
        self.statement()

    def foreach_head(self):
        if self.maybe("ref"):
            self.maybe("readonly")
        self.type_()
        self.name()
        self.take("in")

    def jump(self):
        k = self.K[self.i]
        self.i += 1
        if k == "goto":
            if self.maybe("case"):
                self.expression()
            elif not self.maybe("default"):
                self.name()
        self.take(";")

    def return_(self):
        self.i += 1
        if self.K[self.i] != ";":
            self.maybe("ref")
            self.expression()
        self.take(";")

    def throw(self):
        self.i += 1
        if self.K[self.i] != ";":
            self.expression()
        self.take(";")

    def try_(self):
        self.i += 1
        self.block()
        some = False
        while self.maybe("catch"):
            some = True
            self.branch()
            if self.maybe("("):
                self.type_()
                self.maybe("ID")
                self.take(")")
            if self.maybe_word("when"):
                self.parens()
            self.block()
        if self.maybe("finally"):
            some = True
            self.block()
        if not some:
            self.fail("catch or finally expected")

    def switch(self):
        self.i += 1
        self.parens() if self.K[self.i] == "(" else self.fail("( expected")
        self.take("{")
        while self.K[self.i] != "}":
            if self.K[self.i] == "default":
                self.i += 1
            else:
                self.take("case")
                self.pattern()
                if self.maybe_word("when"):
                    self.expression()
            self.take(":")
            while self.K[self.i] not in ("case", "}", "EOF") and not (self.K[self.i] == "default" and self.K[self.i + 1] == ":"):
                self.guarded(self.statement, stops=frozenset(["case"]))
        self.take("}")

    def using_statement(self):
        self.i += 1
        if self.maybe("("):
            if self.attempt(self.local_head):
                self.declarators()
            else:
                self.expression()
            self.take(")")
            self.statement()
        else:
            self.local_head()
            self.local_rest()

    def lock(self):
        self.i += 1
        self.parens()
        self.statement()

    def fixed(self):
        self.i += 1
        self.take("(")
        self.type_()
        self.declarators()
        self.take(")")
        self.statement()

    def checked(self):
        if self.K[self.i + 1] == "{":
            self.i += 1
            self.block()
        else:
            self.expression()
            self.take(";")

    def unsafe(self):
        if self.K[self.i + 1] == "{":
            self.i += 1
            self.block()
        else:
            start = self.i
            self.local_function_head()
            self.local_function(start)

    def empty(self):
        self.i += 1

    STATEMENTS = {
        "{": block, ";": empty, "if": if_, "while": while_, "do": do_, "for": for_, "foreach": foreach, "break": jump, "continue": jump,
        "goto": jump, "return": return_, "throw": throw, "try": try_, "switch": switch, "using": using_statement, "lock": lock,
        "fixed": fixed, "checked": checked, "unchecked": checked, "unsafe": unsafe,
    }

    # Expressions.
    def expression(self, name=None):
        k = self.K[self.i]
        if k == "throw":
            self.i += 1
            return self.expression()
        if k == "ref":
            self.i += 1
            return self.expression()
        if self.lambda_ahead():
            return self.lambda_(name)
        if self.word("from") and self.K[self.i + 1] in ("ID",) and (self.K[self.i + 2] == "in" or self.K[self.i + 3] == "in"):
            return self.query()
        a = self.i
        self.conditional(name)
        k = self.K[self.i]
        if k == ">":
            k = self.joined()
        if k in ASSIGN:
            target = self.src[self.S[a] : self.E[self.i - 1]]
            self.i += 1
            self.expression(target if len(target) < 200 else None)

    def joined(self):
        """> tokens that stand together read as one operator: >>, >>>, >=, >>= or >>>=."""
        i, src = self.i, self.src
        j = i
        while j - i < 2 and self.K[j + 1] == ">" and self.S[j + 1] == self.E[j]:
            j += 1
        if self.K[j + 1] in (">=", "=") and self.S[j + 1] == self.E[j] and (self.K[j + 1] == ">=" or j > i or True):
            j += 1
        if j == i:
            return ">"
        t = src[self.S[i] : self.E[j]]
        if t not in (">>", ">>>", ">=", ">>=", ">>>="):
            return ">"
        self.K[i : j + 1], self.E[i : j + 1], self.S[i : j + 1] = [t], [self.E[j]], [self.S[i]]
        return t

    def lambda_ahead(self):
        K = self.K
        j = self.i
        while K[j] == "static" or (K[j] == "ID" and self.text(j) == "async" and K[j + 1] in ("ID", "(", "static", "delegate")):
            j += 1
        k = K[j]
        if k == "delegate" and K[j + 1] in ("(", "{"):
            return True
        if k == "ID" and K[j + 1] == "=>":
            return True
        if k == "(":
            depth = 0
            while True:
                k = K[j]
                if k in self.OPEN:
                    depth += 1
                elif k in self.CLOSE:
                    depth -= 1
                    if depth == 0:
                        return K[j + 1] == "=>"
                elif k in ("EOF", ";"):
                    return False
                j += 1
        if k in PREDEFINED or (k == "ID" and K[j + 1] in ("(", "<", "[", "?", ".")) or k == "[":
            if k == "[" or k in PREDEFINED or K[j + 1] in ("(", "<", "?"):
                return self.typed_lambda_ahead()
        return False

    def typed_lambda_ahead(self):
        """A lambda with attributes or an explicit return type."""
        m = self.mark()
        try:
            self.attributes()
            while self.K[self.i] == "static" or self.word("async"):
                self.i += 1
            if self.K[self.i] != "(":
                self.type_()
            if self.K[self.i] != "(":
                return False
            self.tree()
            return self.K[self.i] == "=>"
        except Fault:
            return False
        finally:
            self.back(m)

    def lambda_(self, name):
        start = self.i
        self.attributes()
        anonymous = False
        while self.K[self.i] == "static" or self.word("async") and self.K[self.i + 1] != "=>":
            self.i += 1
        k = self.K[self.i]
        j = self.begin_callable("anonymous_method" if k == "delegate" else "lambda", name or self.scoped("<anonymous>"), self.S[start])
        if k == "delegate":
            anonymous = True
            self.i += 1
            if self.K[self.i] == "(":
                self.params("(", ")")
        elif k == "ID" and self.K[self.i + 1] == "=>":
            self.i += 1
        else:
            if k != "(":
                self.type_()
            if not self.attempt(self.params, "(", ")"):
                self.take("(")
                while self.K[self.i] != ")":
                    while self.K[self.i] in ("ref", "out", "in"):
                        self.i += 1
                    self.name()
                    if not self.maybe(","):
                        break
                self.take(")")
        if not anonymous:
            self.take("=>")
        self.body_of(j)
        if anonymous or self.K[self.i] == "{":
            self.block()
        else:
            self.expression()
        self.end_callable(j)

    def query(self):
        while True:
            k = self.text() if self.K[self.i] == "ID" else self.K[self.i]
            if k == "from" or k == "join":
                self.i += 1
                if self.K[self.i + 1] != "in":
                    self.type_()
                self.name()
                self.take("in")
                self.expression()
                if k == "join":
                    if not self.maybe_word("on"):
                        self.fail("on expected")
                    self.expression()
                    if not self.maybe_word("equals"):
                        self.fail("equals expected")
                    self.expression()
                    if self.maybe_word("into"):
                        self.name()
            elif k == "let":
                self.i += 1
                self.name()
                self.take("=")
                self.expression()
            elif k == "where":
                self.i += 1
                self.expression()
            elif k == "orderby":
                self.i += 1
                while True:
                    self.expression()
                    self.maybe_word("ascending") or self.maybe_word("descending")
                    if not self.maybe(","):
                        break
            elif k == "select" or k == "group":
                self.i += 1
                self.expression()
                if k == "group":
                    if not self.maybe_word("by"):
                        self.fail("by expected")
                    self.expression()
                if not self.maybe_word("into"):
                    return
                self.name()
            else:
                self.fail("query clause expected")

    def conditional(self, name=None):
        self.binary(0, name)
        if self.K[self.i] == "?":
            self.i += 1
            self.branch()
            self.maybe("ref")
            self.expression()
            self.take(":")
            self.maybe("ref")
            self.expression()

    def binary(self, least, name=None):
        K = self.K
        if K[self.i] == ".." and least < 12:
            self.i += 1
            if K[self.i] not in (")", "]", ",", ";", "}"):
                self.binary(12)
        else:
            self.unary(name)
        while True:
            k = K[self.i]
            if k == ">":
                k = self.joined()
            if k == "switch" and least < 13 and K[self.i + 1] == "{":
                self.switch_expression()
                continue
            if k == "ID" and self.text() == "with" and K[self.i + 1] == "{":
                self.i += 1
                self.object_initializer()
                continue
            p = PRECEDENCE.get(k, 0)
            if p <= least and not (k == "??" and least < 1):
                return
            self.i += 1
            if p < 4:
                self.branch()
            if k == "is":
                self.pattern()
            elif k == "as":
                self.type_no_conditional()
            elif k == "??":
                if K[self.i] == "throw":
                    self.expression()
                else:
                    self.binary(0)
            elif k == "..":
                if K[self.i] not in (")", "]", ",", ";", "}"):
                    self.binary(12)
            else:
                if K[self.i] == "throw":
                    self.fail()
                self.binary(p)

    def type_no_conditional(self):
        """A type after as or is: a ? belongs to it only if no expression follows."""
        m = self.mark()
        self.type_()
        if self.K[self.i - 1] == "?" and self.K[self.i] not in (")", ";", ",", "]", "}", "&&", "||", "??", "==", "!=", ":", "EOF", ".", "?"):
            end = self.i - 1
            self.back(m)
            self.type_until(end)

    def type_until(self, end):
        saved = self.K[end]
        self.K[end] = "EOF"
        try:
            self.type_()
        finally:
            self.K[end] = saved

    def switch_expression(self):
        self.take("switch")
        self.take("{")
        while self.K[self.i] != "}":
            self.branch()
            self.pattern()
            if self.maybe_word("when"):
                self.expression()
            self.take("=>")
            self.expression()
            if not self.maybe(","):
                break
        self.take("}")

    # Patterns.
    def pattern(self):
        self.and_pattern()
        while self.word("or"):
            self.branch()
            self.i += 1
            self.and_pattern()

    def and_pattern(self):
        self.not_pattern()
        while self.word("and"):
            self.branch()
            self.i += 1
            self.not_pattern()

    def not_pattern(self):
        while self.word("not") and self.K[self.i + 1] not in (")", ",", ";", "=>", "}", ":"):
            self.i += 1
        self.primary_pattern()

    def primary_pattern(self):
        K = self.K
        k = K[self.i]
        if k in ("<", ">", "<=", ">="):
            if k == ">":
                self.joined()
            self.i += 1
            self.binary(9)
        elif k == "[":
            self.i += 1
            while K[self.i] != "]":
                self.pattern()
                if not self.maybe(","):
                    break
            self.take("]")
            self.designation()
        elif k == "..":
            self.i += 1
            if K[self.i] not in ("]", ","):
                self.pattern()
        elif k == "{":
            self.property_pattern()
            self.designation()
        elif k == "(":
            if not self.attempt(self.positional):
                self.binary(8)
        elif self.word("var") and K[self.i + 1] in ("ID", "("):
            self.i += 1
            if K[self.i] == "(":
                self.tree()
            else:
                self.name()
        elif (k == "ID" or k in PREDEFINED) and self.attempt(self.type_pattern):
            pass
        else:
            self.binary(8)

    def positional(self):
        self.take("(")
        while self.K[self.i] != ")":
            if self.K[self.i] == "ID" and self.K[self.i + 1] == ":":
                self.i += 2
            self.pattern()
            if not self.maybe(","):
                break
        self.take(")")
        if self.K[self.i] == "{":
            self.property_pattern()
        self.designation()
        if self.K[self.i] not in self.AFTER_PATTERN and not self.pattern_word():
            self.fail()

    AFTER_PATTERN = frozenset([")", "]", "}", ",", ";", ":", "=>", "&&", "||", "?", "??", "==", "!=", "EOF", "|", "&", "^", "switch"])

    def pattern_word(self):
        return self.K[self.i] == "ID" and self.text() in ("or", "and", "when", "on", "equals", "into", "by", "select", "where", "orderby", "group", "let", "from", "join", "ascending", "descending")

    def type_pattern(self):
        self.type_no_conditional()
        k = self.K[self.i]
        if k == "(":
            self.positional()
            return
        if k == "{":
            self.property_pattern()
        self.designation()
        if self.K[self.i] not in self.AFTER_PATTERN and not self.pattern_word():
            self.fail()

    def designation(self):
        if self.K[self.i] == "ID" and not self.pattern_word():
            self.i += 1

    def property_pattern(self):
        self.take("{")
        while self.K[self.i] != "}":
            self.name()
            while self.maybe("."):
                self.name()
            self.take(":")
            self.pattern()
            if not self.maybe(","):
                break
        self.take("}")

    def unary(self, name=None):
        k = self.K[self.i]
        if k in ("+", "-", "!", "~", "++", "--", "&", "*", "^"):
            self.i += 1
            return self.unary()
        if k == "ID" and self.text() == "await" and self.K[self.i + 1] not in _NOT_START and self.K[self.i + 1] not in PRECEDENCE and self.K[self.i + 1] != ";":
            self.i += 1
            return self.unary()
        if k == "(" and self.attempt(self.cast):
            if self.lambda_ahead():
                return self.lambda_(name)
            return self.unary(name)
        self.primary(name)

    def cast(self):
        self.take("(")
        simple = self.K[self.i] in PREDEFINED
        self.type_()
        definite = simple or self.K[self.i - 1] in ("]", "?", "*")
        self.take(")")
        k = self.K[self.i]
        if k in ("ID", "STR", "NUM", "(", "!", "~", "this", "base", "new", "typeof", "sizeof", "default", "checked", "unchecked", "true", "false", "null", "static", "delegate") or k in PREDEFINED:
            if k == "ID" and self.pattern_word() and not simple:
                self.fail()
            return True
        if definite and k in ("-", "+", "&", "*", "++", "--", "^"):
            return True
        self.fail()

    def primary(self, name=None):
        K = self.K
        k = K[self.i]
        if k == "ID":
            self.i += 1
            if K[self.i] == "::":
                self.i += 1
                self.name()
            if K[self.i] == "<":
                self.attempt(self.call_type_args)
        elif k in ("NUM", "this", "true", "false", "null"):
            self.i += 1
        elif k == "STR":
            self.i += 1
            if self.holes:
                self.check_holes(self.S[self.i - 1])
        elif k == "base":
            self.i += 1
            if K[self.i] not in (".", "["):
                self.fail()
        elif k == "(":
            self.i += 1
            n = 0
            while True:
                if K[self.i] == "ID" and K[self.i + 1] == ":":
                    self.i += 2
                if not self.attempt(self.declaration_expression):
                    self.expression(name if n == 0 else None)
                n += 1
                if not self.maybe(","):
                    break
            self.take(")")
        elif k == "new":
            self.new()
        elif k in ("typeof", "sizeof"):
            self.i += 1
            self.take("(")
            self.type_()
            self.take(")")
        elif k == "default":
            self.i += 1
            if self.maybe("("):
                self.type_()
                self.take(")")
        elif k in ("checked", "unchecked"):
            self.i += 1
            self.parens()
        elif k == "stackalloc":
            self.i += 1
            self.stackalloc()
        elif k == "[":
            self.i += 1
            while K[self.i] != "]":
                if K[self.i] == "..":
                    self.i += 1
                self.expression()
                if not self.maybe(","):
                    break
            self.take("]")
        elif k in PREDEFINED:
            self.i += 1
            if K[self.i] not in (".", "[", "?", "*", ")", ">"):
                self.fail()
            if K[self.i] != ".":
                self.fail()
        else:
            self.fail("expression expected")
        self.suffixes()

    def suffixes(self):
        K = self.K
        while True:
            k = K[self.i]
            if k == "." or k == "->":
                self.i += 1
                self.name()
                if K[self.i] == "<":
                    self.attempt(self.call_type_args)
            elif k == "?" and K[self.i + 1] in (".", "[") and self.conditional_access():
                self.i += 1
            elif k == "(":
                self.arguments()
            elif k == "[":
                self.i += 1
                while True:
                    if K[self.i] == "ID" and K[self.i + 1] == ":":
                        self.i += 2
                    self.expression()
                    if not self.maybe(","):
                        break
                self.take("]")
            elif k in ("++", "--"):
                self.i += 1
            elif k == "!" and K[self.i + 1] != "=" and K[self.i + 1] not in ("ID", "NUM", "STR", "("):
                self.i += 1
            else:
                return

    def conditional_access(self):
        """?. and ?[ read as access unless the bracket starts the first branch of a conditional."""
        if self.K[self.i + 1] == ".":
            return True
        m = self.mark()
        try:
            self.i += 1
            self.tree()
            return self.K[self.i] != ":"
        except Fault:
            return False
        finally:
            self.back(m)

    def call_type_args(self):
        self.type_args()
        if self.K[self.i] not in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", "EOF", "{"):
            self.fail()

    def declaration_expression(self):
        """var x or Type x inside a tuple."""
        self.type_()
        self.name()
        if self.K[self.i] not in (",", ")"):
            self.fail()

    def arguments(self):
        self.take("(")
        while self.K[self.i] != ")":
            if self.K[self.i] == "ID" and self.K[self.i + 1] == ":":
                self.i += 2
            k = self.K[self.i]
            if k in ("ref", "out", "in"):
                self.i += 1
                if not self.attempt(self.declaration_expression):
                    self.expression()
            else:
                self.expression()
            if not self.maybe(","):
                break
        self.take(")")

    def new(self):
        self.take("new")
        K = self.K
        k = K[self.i]
        if k == "{":
            self.anonymous_object()
        elif k == "(":
            self.arguments()
            if K[self.i] == "{":
                self.object_initializer()
        elif k == "[":
            self.i += 1
            while self.maybe(","):
                pass
            self.take("]")
            self.array_initializer()
        else:
            if k in PREDEFINED:
                self.i += 1
            else:
                self.qualified_name()
            while K[self.i] in ("?", "*") and K[self.i + 1] in ("[", "(", "?"):
                self.i += 1
            if K[self.i] == "[":
                if K[self.i + 1] not in ("]", ","):
                    self.i += 1
                    self.expressions()
                    self.take("]")
                while K[self.i] == "[" and K[self.i + 1] in ("]", ","):
                    self.i += 1
                    while self.maybe(","):
                        pass
                    self.take("]")
                if K[self.i] == "{":
                    self.array_initializer()
            else:
                if K[self.i] == "(":
                    self.arguments()
                    if K[self.i] == "{":
                        self.object_initializer()
                else:
                    self.object_initializer()

    def anonymous_object(self):
        self.take("{")
        while self.K[self.i] != "}":
            if self.K[self.i] == "ID" and self.K[self.i + 1] == "=":
                self.i += 2
            self.expression()
            if not self.maybe(","):
                break
        self.take("}")

    def object_initializer(self):
        self.take("{")
        while self.K[self.i] != "}":
            if self.K[self.i] == "ID" and self.K[self.i + 1] == "=":
                self.i += 2
                self.nested_initializer()
            elif self.K[self.i] == "[":
                self.i += 1
                self.expressions()
                self.take("]")
                self.take("=")
                self.nested_initializer()
            elif self.K[self.i] == "{":
                self.array_initializer()
            else:
                self.expression()
            if not self.maybe(","):
                break
        self.take("}")

    def nested_initializer(self):
        if self.K[self.i] == "{":
            self.object_initializer()
        else:
            self.maybe("ref")
            self.expression()
