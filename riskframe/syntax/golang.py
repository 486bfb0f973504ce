"""Go."""

from __future__ import annotations

import re

from riskframe.syntax.base import Cursor, Fault

#: Go's keywords and the precedence of its binary operators.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
PRECEDENCE = {
    "||": 1, "&&": 2,
    "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3,
    "+": 4, "-": 4, "|": 4, "^": 4,
    "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5,
}
ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="])

_ESCAPE = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_TOKEN = re.compile(
    rf"""[ \t\r]*(?:(?P<ID>[^\W\d]\w*)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*\*/)
|(?P<NUM>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?[0-9_]+)?i?|0[bBoO][0-9_]+i?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)
|(?P<STR>"(?:[^"\\\n]|{_ESCAPE})*"|`[^`]*`|'(?:[^'\\\n]|{_ESCAPE})')
|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{{}},;.:~])|\Z)""",
    re.X,
)
_BLANKS = re.compile(r"[ \t\r]*")
_ENDS = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_DECL = frozenset(["func", "type", "var", "const"])


class parser(Cursor):
    def __init__(self, src, ext):
        super().__init__(src, ext)
        K, S, E = self.K, self.S, self.E = [], [], []
        at, n, match, last = 0, len(src), _TOKEN.match, ""
        kind, start_, end_ = K.append, S.append, E.append
        while at < n:
            m = match(src, at)
            if m is None:
                at = _BLANKS.match(src, at).end()
                self.faults.append(_bad(src, at))
                nl = src.find("\n", at)
                at = at + 1 if src[at] not in "\"'`" and not src.startswith("/*", at) else (n if src[at] in "`/" or nl < 0 else nl)
                continue
            g, at = m.lastgroup, m.end()
            if g == "ID" or g == "op":
                t = m[g]
                last = t if g == "op" or t in KEYWORDS else g
                kind(last)
                start_(at - len(t))
                end_(at)
            elif g == "nl" or (g == "block" and "\n" in m[g]):
                if last in _ENDS:
                    last = ";"
                    kind(last)
                    start_(m.start(g))
                    end_(m.start(g))
            elif g == "NUM" or g == "STR":
                last = g
                kind(g)
                start_(m.start(g))
                end_(at)
        if last in _ENDS:
            K.append(";"), S.append(n), E.append(n)
        K.append("EOF"), S.append(n), E.append(n)
        self.lev = 0
        self.package = ""

    def file(self):
        self.take("package")
        self.package = self.text(self.take("ID"))
        self.modules.append({"system": "go-package", "name": self.package})
        self.end_stmt()
        while self.K[self.i] == "import":
            self.guarded(self.imports, stops=_DECL)
        self.top_level(self.declaration, stops=_DECL)

    def end_stmt(self):
        if self.K[self.i] not in ")}" or self.K[self.i] == "EOF":
            if self.K[self.i] != "EOF":
                self.take(";")

    def group(self, item):
        """One item, or a bracketed list of them."""
        if self.maybe("("):
            while self.K[self.i] != ")":
                item()
                if self.K[self.i] != ")":
                    self.take(";")
            self.take(")")
        else:
            item()

    def imports(self):
        self.take("import")
        self.group(self.import_spec)
        self.end_stmt()

    def import_spec(self):
        start, binding = self.i, "default"
        if self.K[self.i] in ("ID", "."):
            binding = self.text()
            self.i += 1
        at = self.take("STR")
        self.references.append({"kind": "import", "specifier": self.text(at)[1:-1], "binding": binding, "scope": "", "start": self.S[start], "end": self.E[at]})

    def declaration(self):
        k = self.K[self.i]
        if k == "func":
            self.func_decl()
        elif k in ("var", "const", "type"):
            self.i += 1
            self.group({"var": self.var_spec, "const": self.var_spec, "type": self.type_spec}[k])
        else:
            self.fail("declaration expected")
        self.end_stmt()

    def func_decl(self):
        start = self.take("func")
        parts = [self.package]
        if self.K[self.i] == "(":
            a = self.i
            self.params()
            words = self.src[self.S[a] + 1 : self.S[self.i - 1]].split()
            parts.append("(" + "".join(words[1:] if len(words) > 1 and words[0].isidentifier() else words) + ")")
        parts.append(self.text(self.take("ID")))
        j = self.begin_callable("method" if len(parts) > 2 else "function", ".".join(parts), self.S[start])
        if self.K[self.i] == "[":
            self.type_params()
        self.signature()
        if self.K[self.i] == "{":
            self.body_of(j)
            self.block()
        self.end_callable(j)

    def type_params(self):
        self.take("[")
        while self.K[self.i] != "]":
            self.take("ID")
            while self.maybe(","):
                self.take("ID")
            self.constraint()
            if not self.maybe(","):
                break
        self.take("]")

    def constraint(self):
        while True:
            self.maybe("~")
            self.type_()
            if not self.maybe("|"):
                return

    def signature(self):
        self.params()
        k = self.K[self.i]
        if k == "(":
            self.params()
        elif self.type_starts(k):
            self.type_()

    def params(self):
        self.take("(")
        while self.K[self.i] != ")":
            if not self.maybe("..."):
                self.type_()
                if self.K[self.i] not in (",", ")"):
                    if self.K[self.i - 1] not in ("ID", "]"):
                        self.fail()
                    self.maybe("...")
                    self.type_()
            else:
                self.type_()
            if not self.maybe(","):
                break
        self.take(")")

    @staticmethod
    def type_starts(k):
        return k in ("ID", "*", "[", "(", "map", "chan", "func", "struct", "interface", "<-")

    def type_(self):
        k = self.K[self.i]
        self.i += 1
        if k == "ID":
            if self.maybe("."):
                self.take("ID")
            if self.K[self.i] == "[" and self.K[self.i + 1] != "]":
                self.attempt(self.type_args)
        elif k == "*":
            self.type_()
        elif k == "(":
            self.type_()
            self.take(")")
        elif k == "[":
            if not self.maybe("]"):
                if not self.maybe("..."):
                    self.nested(self.expression)
                self.take("]")
            self.type_()
        elif k == "map":
            self.take("[")
            self.type_()
            self.take("]")
            self.type_()
        elif k == "chan":
            self.maybe("<-")
            self.type_()
        elif k == "<-":
            self.take("chan")
            self.type_()
        elif k == "func":
            self.signature()
        elif k == "struct":
            self.struct_body()
        elif k == "interface":
            self.interface_body()
        else:
            self.i -= 1
            self.fail("type expected")

    def type_args(self):
        self.take("[")
        while True:
            self.type_()
            if not self.maybe(",") or self.K[self.i] == "]":
                break
        self.take("]")

    def struct_body(self):
        self.take("{")
        while self.K[self.i] != "}":
            if self.maybe("*"):
                self.type_()
            else:
                self.take("ID")
                k = self.K[self.i]
                if k == ".":
                    self.i -= 1
                    self.type_()
                elif k not in (";", "}", "STR"):
                    while self.maybe(","):
                        self.take("ID")
                    self.type_()
            self.maybe("STR")
            if self.K[self.i] != "}":
                self.take(";")
        self.take("}")

    def interface_body(self):
        self.take("{")
        while self.K[self.i] != "}":
            if self.K[self.i] == "ID" and self.K[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            if self.K[self.i] != "}":
                self.take(";")
        self.take("}")

    def type_spec(self):
        start = self.take("ID")
        name = self.text(start)
        if self.K[self.i] == "[" and self.K[self.i + 1] == "ID" and self.K[self.i + 2] != "]":
            self.attempt(self.type_params)
        alias = self.maybe("=")
        k = self.K[self.i]
        j = self.begin_type("type_alias" if alias else k if k in ("struct", "interface") else "type", f"{self.package}.{name}", self.S[start])
        self.type_()
        self.end_type(j)

    def var_spec(self):
        start = self.take("ID")
        names = 1
        while self.maybe(","):
            self.take("ID")
            names += 1
        if self.K[self.i] not in ("=", ";", ")", "}"):
            self.type_()
        if self.maybe("="):
            self.expressions(self.text(start))

    # Statements.
    def block(self):
        lev, self.lev = self.lev, 0
        self.take("{")
        while self.K[self.i] not in ("}", "EOF"):
            self.guarded(self.statement_line)
        self.take("}")
        self.lev = lev

    def statement_line(self):
        self.statement()
        if self.K[self.i] not in ("}", ";"):
            self.fail("end of statement expected")
        self.maybe(";")

    def statement(self):
        k = self.K[self.i]
        if k == "ID" and self.K[self.i + 1] == ":":
            self.i += 2
            if self.K[self.i] not in ("}", ";"):
                self.statement()
        elif k in ("var", "const", "type"):
            self.i += 1
            self.group({"var": self.var_spec, "const": self.var_spec, "type": self.type_spec}[k])
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.i += 1
            self.cases(True)
        elif k == "{":
            self.block()
        elif k == "return":
            self.i += 1
            if self.K[self.i] not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue", "goto"):
            self.i += 1
            if k == "goto":
                self.take("ID")
            else:
                self.maybe("ID")
        elif k == "fallthrough":
            self.i += 1
        elif k in ("go", "defer"):
            self.i += 1
            self.expression()
            if self.K[self.i - 1] != ")":
                self.fail("call expected")
        elif k not in (";", "}"):
            self.simple()

    def simple(self, ranged=False):
        """A simple statement; true if it is a range clause."""
        start = self.i
        if ranged and self.maybe("range"):
            self.expression()
            return True
        self.expressions()
        k = self.K[self.i]
        if k in ASSIGN:
            single = self.text(start) if self.K[start] == "ID" and self.i == start + 1 else self.src[self.S[start] : self.E[self.i - 1]]
            if k == ":=" and any(self.K[j] not in ("ID", ",") for j in range(start, self.i)):
                self.fail("name expected left of :=")
            self.i += 1
            if ranged and self.maybe("range"):
                self.expression()
                return True
            if k == ":=" and self.K[self.i] == "range":
                self.fail()
            self.expressions(single if "," not in single else None)
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.expression()
        return False

    def header(self):
        """Init and condition of an if or switch, up to its block."""
        lev, self.lev = self.lev, -1
        if self.K[self.i] != "{":
            if self.K[self.i] != ";":
                self.simple()
            if self.maybe(";") and self.K[self.i] != "{":
                self.simple()
                self.lev = lev
                return True
        self.lev = lev
        return False

    def if_(self):
        self.take("if")
        self.branch()
        if self.K[self.i] == "{":
            self.fail("condition expected")
        self.header()
        if self.K[self.i - 1] == ";":
            self.fail("condition expected")
        self.block()
        if self.maybe("else"):
            if self.K[self.i] == "if":
                self.if_()
            else:
                self.block()

    def for_(self):
        self.take("for")
        self.branch()
        lev, self.lev = self.lev, -1
        if self.K[self.i] != "{":
            ranged = self.K[self.i] != ";" and self.simple(True)
            if not ranged and self.maybe(";"):
                if self.K[self.i] != ";":
                    self.simple()
                if self.K[self.i] != "{":
                    self.take(";")
                    if self.K[self.i] != "{":
                        self.simple()
        self.lev = lev
        self.block()

    def switch(self):
        self.take("switch")
        self.header()
        self.cases(False)

    def cases(self, select):
        lev, self.lev = self.lev, 0
        self.take("{")
        while self.K[self.i] != "}":
            if self.maybe("default"):
                pass
            else:
                self.take("case")
                self.branch()
                if select:
                    self.simple()
                else:
                    self.expressions()
            self.take(":")
            while self.K[self.i] not in ("case", "default", "}", "EOF"):
                self.guarded(self.case_line, stops=frozenset(["case", "default"]))
        self.take("}")
        self.lev = lev

    def case_line(self):
        self.statement()
        if self.K[self.i] not in ("}", ";", "case", "default"):
            self.fail("end of statement expected")
        self.maybe(";")

    # Expressions.
    def expressions(self, name=None):
        self.expression(0, name)
        while self.maybe(","):
            self.expression()

    def nested(self, f, *args):
        lev, self.lev = self.lev, max(self.lev, 0) + 1
        r = f(*args)
        self.lev = lev
        return r

    def expression(self, least=0, name=None):
        self.unary(name)
        K = self.K
        while True:
            k = K[self.i]
            p = PRECEDENCE.get(k, 0)
            if p <= least:
                return
            if p < 3:
                self.branch()
            self.i += 1
            self.expression(p)

    def unary(self, name=None):
        while self.K[self.i] in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            if self.K[self.i] == "<-" and self.K[self.i + 1] == "chan":
                break
            self.i += 1
        self.primary(name)

    def primary(self, name=None):
        K = self.K
        first = self.i
        k = K[first]
        literal_type = False
        if k == "ID":
            self.i += 1
            literal_type = True
        elif k in ("NUM", "STR"):
            self.i += 1
        elif k == "(":
            self.i += 1
            self.nested(self.expression, 0, name)
            self.take(")")
        elif k == "func":
            self.func_literal(name)
        elif k in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type_()
            if K[self.i] == "{" and k in ("[", "map", "struct"):
                self.literal_value()
            elif K[self.i] != "(" and K[self.i] not in (")", ",", "]", ":"):
                self.fail()
        else:
            self.fail("expression expected")
        while True:
            k = K[self.i]
            if k == ".":
                self.i += 1
                if self.maybe("("):
                    if not self.maybe("type"):
                        self.type_()
                    self.take(")")
                    literal_type = False
                else:
                    self.take("ID")
            elif k == "(":
                self.called(first)
                self.nested(self.arguments)
                literal_type = False
            elif k == "[":
                self.nested(self.index)
            elif k == "{" and literal_type and self.lev >= 0:
                self.literal_value()
                literal_type = False
            else:
                return

    def called(self, first):
        """Notes a call: the dotted name that is called, '' for any other expression."""
        plain = all(self.K[i] == ("." if (i - first) % 2 else "ID") for i in range(first, self.i)) and self.i > first
        owner = next((j for kind, j in reversed(self.open) if kind == "callable"), None)
        self.calls.append({"target": "".join(map(self.text, range(first, self.i))) if plain else "", "owner": owner, "start": self.S[first], "end": self.E[self.i - 1]})

    def func_literal(self, name):
        start = self.take("func")
        j = self.begin_callable("function_literal", f"{self.package}.{name or '<anonymous>'}", self.S[start])
        self.signature()
        if self.K[self.i] == "{":
            self.body_of(j)
            self.block()
            self.end_callable(j)
        else:  # a function type
            self.open.pop(), self.cx.pop(), self.callables.pop()
            self.depth -= 1

    def arguments(self):
        self.take("(")
        while self.K[self.i] != ")":
            self.expression()
            self.maybe("...")
            if not self.maybe(","):
                break
        self.take(")")

    def index(self):
        self.take("[")
        colons = 0
        while self.K[self.i] != "]":
            if self.maybe(":"):
                colons += 1
                if colons > 2:
                    self.fail()
            else:
                self.expression()
                if not self.maybe(",") and self.K[self.i] not in ("]", ":"):
                    self.fail()
        if self.K[self.i - 1] == "[":
            self.fail("index expected")
        self.take("]")

    def literal_value(self):
        lev, self.lev = self.lev, 0
        self.take("{")
        while self.K[self.i] != "}":
            self.element()
            if self.maybe(":"):
                self.element()
            if not self.maybe(","):
                break
        self.take("}")
        self.lev = lev

    def element(self):
        if self.K[self.i] == "{":
            self.literal_value()
        else:
            self.expression()


def _bad(src, at):
    if src[at] in "\"'`" or src.startswith("/*", at):
        return Fault("unterminated-literal", at, "literal or comment without end")
    return Fault("bad-token", at, f"unexpected character {src[at]!r}")
