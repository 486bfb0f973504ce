"""TypeScript and TSX. Tokens are read on demand, since only the parser knows where regular expressions, template
texts and JSX begin."""

from __future__ import annotations

import re

from riskframe.syntax.base import Cursor, Fault

#: Reserved words, and the precedence of binary operators.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
PRECEDENCE = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="])
MODIFIERS = frozenset("public private protected static abstract override readonly declare async accessor export default const in out".split())

_SKIP = re.compile(r"(?:[^\S\n]+|\n|//[^\n  ]*|/\*(?:[^*]|\*(?!/))*\*/)+")
_TOKEN = re.compile(
    r"""(?P<ID>\#?[^\W\d][\w$‌‍]*|\#?(?:[$_]|\\u[0-9a-fA-F]{4}|[^\W\d])[\w$]*)
|(?P<NUM>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?)
|(?P<STR>"(?:[^"\\\n]|\\(?:\r\n|\n|.))*"|'(?:[^'\\\n]|\\(?:\r\n|\n|.))*')
|(?P<op>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@`])""",
    re.X,
)
_GREATER = re.compile(r">>>=|>>>|>>=|>>|>=|>")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?:.|\n)|\$(?!\{))*", re.S)
_JSX_NAME = re.compile(r"[^\W\d][\w$\-]*(?:[.:][^\W\d][\w$\-]*)*", re.U)
_JSX_TEXT = re.compile(r"[^<>{}]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_STOPS = frozenset("export import class function interface enum namespace".split())


class parser(Cursor):
    def __init__(self, src, ext):
        super().__init__(src, ext)
        self.jsx = ext == "tsx"
        self.K, self.S, self.E, self.NL = [], [], [], []
        self.scopes: list[str] = []
        self.at = src.find("\n") if src.startswith("#!") and "\n" in src else len(src) if src.startswith("#!") else 0
        self.no_in = False
        self.lex()

    # Tokens.
    def lex(self):
        src, at = self.src, self.at
        newline = False
        c = src[at : at + 1]
        if c <= " " or c == "/" or c > "~":  # blanks or a comment may stand here
            m = _SKIP.match(src, at)
            if m is not None:
                end = m.end()
                newline = src.find("\n", at, end) >= 0
                at = end
            if at >= len(src):
                self.push("EOF", len(src), len(src), newline)
                return
        m = _TOKEN.match(src, at)
        if m is None:
            self.push("BAD", at, at + 1, newline)
            return
        kind, end = m.lastgroup, m.end()
        if kind == "op":
            kind = m[0]
        elif kind == "ID":
            t = m[0]
            if t in RESERVED:
                kind = t
        self.K.append(kind)
        self.S.append(at)
        self.E.append(end)
        self.NL.append(newline)
        self.at = end

    def push(self, kind, start, end, newline):
        self.K.append(kind), self.S.append(start), self.E.append(end), self.NL.append(newline)
        self.at = end

    def adv(self):
        self.i += 1
        if self.i == len(self.K):
            self.lex()

    def peek(self, n=1):
        while self.i + n >= len(self.K):
            if self.K[-1] == "EOF":
                return "EOF"
            self.lex()
        return self.K[self.i + n]

    def cut(self, at):
        """Forgets the tokens after the current one; reading goes on at an offset."""
        j = self.i + 1
        del self.K[j:], self.S[j:], self.E[j:], self.NL[j:]
        self.at = at

    def retoken(self, kind, end):
        """Makes the current token another one, up to an offset."""
        self.K[self.i], self.E[self.i] = kind, end
        self.cut(end)

    def take(self, kind):
        i = self.i
        if self.K[i] != kind:
            if self.K[i] == "BAD":
                self.bad()
            self.fail(f"{kind} expected, {self.K[i]} found")
        self.adv()
        return i

    def bad(self):
        c = self.src[self.S[self.i]]
        raise Fault("unterminated-literal" if c in "\"'/" else "bad-token", self.S[self.i], f"unexpected character {c!r}")

    def maybe(self, kind):
        if self.K[self.i] == kind:
            self.adv()
            return True
        return False

    def word(self, w):
        i = self.i
        return self.K[i] == "ID" and self.src[self.S[i] : self.E[i]] == w

    def maybe_word(self, w):
        if self.word(w):
            self.adv()
            return True
        return False

    def peek_word(self, n=1):
        return self.src[self.S[self.i + n] : self.E[self.i + n]] if self.peek(n) not in ("EOF",) else ""

    def recover(self, f, start, stops=frozenset()):
        self.faults.append(f)
        depth = 0
        if self.i == start and self.K[start] not in ("EOF", "}"):
            self.adv()
        while True:
            k = self.K[self.i]
            if k == "EOF":
                return
            if depth == 0:
                if k == ";":
                    self.adv()
                    return
                if k == "}" or (k in stops and self.NL[self.i]) or (self.NL[self.i] and self.i > start and k not in ".)],:?=+&|" and self.S[self.i] > f.at):
                    return
            if k in self.OPEN:
                depth += 1
            elif k in self.CLOSE:
                depth = max(0, depth - 1)
            self.adv()

    def greater(self):
        """The operator that starts at a > token, as the scanner reads it in expressions."""
        m = _GREATER.match(self.src, self.S[self.i])
        if m.end() != self.E[self.i]:
            self.retoken(m[0], m.end())
        return m[0]

    def file(self):
        self.modules.append({"system": "typescript-module", "name": ""})
        while self.K[self.i] != "EOF":
            if self.K[self.i] == "}":
                self.faults.append(Fault("unexpected-token", self.S[self.i], "unexpected }"))
                self.adv()
            else:
                self.guarded(self.statement, stops=_STOPS)

    def semicolon(self):
        if not self.maybe(";") and self.K[self.i] not in ("}", "EOF") and not self.NL[self.i]:
            if self.K[self.i] == "BAD":
                self.bad()
            self.fail("; expected")

    def name(self):
        """An identifier; contextual words are names."""
        return self.text(self.take("ID"))

    def any_name(self):
        if self.K[self.i] != "ID" and self.K[self.i] not in RESERVED:
            self.fail("name expected")
        self.adv()
        return self.text(self.i - 1)

    def scoped(self, name):
        return ".".join([*self.scopes, name])

    # Statements.
    def block(self):
        self.take("{")
        no_in, self.no_in = self.no_in, False
        while self.K[self.i] not in ("}", "EOF"):
            self.guarded(self.statement)
        self.take("}")
        self.no_in = no_in

    def statement(self):
        k = self.K[self.i]
        f = self.STATEMENTS.get(k)
        if f is not None:
            f(self)
        elif k == "ID":
            w = self.text()
            f = self.WORDS.get(w)
            if f is None or not f(self):
                if self.peek() == ":":
                    self.adv(), self.adv()
                    self.statement()
                else:
                    self.expression_statement()
        else:
            self.expression_statement()

    def expression_statement(self):
        self.expression()
        self.semicolon()

    def if_(self):
        self.adv()
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
        self.adv()
        self.branch()
        self.parens()
        self.statement()

    def do_(self):
        self.adv()
        self.branch()
        self.statement()
        self.take("while")
        self.parens()
        self.maybe(";")

    def for_(self):
        self.adv()
        self.branch()
        self.maybe_word("await")
        self.take("(")
        if self.K[self.i] != ";":
            no_in, self.no_in = self.no_in, True
            k = self.K[self.i]
            if k in ("var", "const") or (self.word("let") and (self.peek() in ("ID", "[", "{"))):
                self.adv()
                self.declarators(True)
            else:
                self.expression()
            self.no_in = no_in
        if self.maybe_word("of") or self.maybe("in"):
            self.expression()
        else:
            self.take(";")
            if self.K[self.i] != ";":
                self.expression()
            self.take(";")
            if self.K[self.i] != ")":
                self.expression()
        self.take(")")
        self.statement()

    def return_(self):
        self.adv()
        if self.K[self.i] not in (";", "}", "EOF") and not self.NL[self.i]:
            self.expression()
        self.semicolon()

    def jump(self):
        self.adv()
        if self.K[self.i] == "ID" and not self.NL[self.i]:
            self.adv()
        self.semicolon()

    def throw(self):
        self.adv()
        if self.NL[self.i]:
            self.fail("expression expected")
        self.expression()
        self.semicolon()

    def try_(self):
        self.adv()
        self.block()
        some = False
        if self.maybe("catch"):
            some = True
            self.branch()
            if self.maybe("("):
                self.binding()
                if self.maybe(":"):
                    self.type_()
                self.take(")")
            self.block()
        if self.maybe("finally"):
            some = True
            self.block()
        if not some:
            self.fail("catch or finally expected")

    def switch(self):
        self.adv()
        self.parens()
        self.take("{")
        while self.K[self.i] != "}":
            if self.maybe("default"):
                pass
            else:
                self.take("case")
                self.branch()
                self.expression()
            self.take(":")
            while self.K[self.i] not in ("case", "default", "}", "EOF"):
                self.guarded(self.statement, stops=frozenset(["case", "default"]))
        self.take("}")

    def with_(self):
        self.adv()
        self.parens()
        self.statement()

    def var(self):
        if self.K[self.i] == "const" and self.peek() == "enum":
            self.adv()
            return self.enum()
        self.adv()
        self.declarators()
        self.semicolon()

    def let(self):
        if self.peek() in ("ID", "[", "{"):
            self.var()
            return True

    def using(self):
        if self.peek() == "ID" and not self.NL[self.i + 1]:
            self.var()
            return True

    def declarators(self, in_for=False):
        while True:
            a = self.i
            self.binding()
            name = self.src[self.S[a] : self.E[self.i - 1]]
            self.maybe("!")
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.assignment(self.scoped(name))
            if not self.maybe(","):
                return

    def binding(self):
        k = self.K[self.i]
        if k == "ID":
            self.adv()
        elif k == "[":
            self.adv()
            while self.K[self.i] != "]":
                if not self.maybe(","):
                    self.maybe("...")
                    self.binding()
                    if self.maybe("="):
                        self.assignment()
                    if self.K[self.i] != "]":
                        self.take(",")
            self.take("]")
        elif k == "{":
            self.adv()
            while self.K[self.i] != "}":
                if self.maybe("..."):
                    self.binding()
                else:
                    plain = self.K[self.i] == "ID"
                    self.property_name()
                    if self.maybe(":"):
                        self.binding()
                    elif not plain:
                        self.fail(": expected")
                    if self.maybe("="):
                        self.assignment()
                if self.K[self.i] != "}":
                    self.take(",")
            self.take("}")
        else:
            if k == "BAD":
                self.bad()
            self.fail("name or pattern expected")

    def property_name(self):
        """The name's text, '' if computed."""
        k = self.K[self.i]
        if k == "[":
            self.adv()
            self.assignment()
            self.take("]")
            return self.src[self.S[self.i - 1] : self.E[self.i - 1]] and ""
        if k in ("STR", "NUM"):
            self.adv()
            return self.text(self.i - 1)
        return self.any_name()

    def function(self, start=None):
        start = self.i if start is None else start
        self.take("function")
        star = self.maybe("*")
        name = self.text() if self.K[self.i] == "ID" else ""
        self.maybe("ID")
        j = self.begin_callable("generator_function" if star else "function", self.scoped(name or "<anonymous>"), self.S[start])
        self.signature()
        if self.K[self.i] == "{":
            self.body_of(j)
            self.block()
        else:  # an overload or ambient signature
            self.semicolon()
            self.drop_callable()
            return
        self.end_callable(j)

    def drop_callable(self):
        self.callables.pop(), self.open.pop(), self.cx.pop()
        self.depth -= 1

    def signature(self):
        if self.K[self.i] == "<":
            self.type_params()
        self.params()
        if self.maybe(":"):
            self.return_type()

    def params(self):
        self.take("(")
        while self.K[self.i] != ")":
            while self.K[self.i] == "@":
                self.decorator()
            while self.K[self.i] == "ID" and self.text() in MODIFIERS and self.peek() in ("ID", "{", "["):
                self.adv()
            self.maybe("...")
            if self.K[self.i] == "this":
                self.adv()
            else:
                self.binding()
            self.maybe("?")
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.assignment()
            if self.K[self.i] != ")":
                self.take(",")
        self.take(")")

    def decorator(self):
        self.take("@")
        if self.K[self.i] == "(":
            self.parens()
        else:
            self.any_name()
            while self.maybe("."):
                self.any_name()
            if self.K[self.i] == "<":
                self.attempt(self.type_args)
            if self.K[self.i] == "(":
                self.arguments()

    def decorated(self):
        while self.K[self.i] == "@":
            self.decorator()
        self.maybe("export")
        self.maybe("default")
        self.maybe_word("abstract")
        self.class_()

    def class_(self, statement=True):
        start = self.take("class")
        name = ""
        if self.K[self.i] == "ID" and not (self.word("implements") and self.peek() == "ID"):
            name = self.name()
        if self.K[self.i] == "<":
            self.type_params()
        j = self.begin_type("class", self.scoped(name), self.S[start]) if statement else None
        if self.maybe("extends"):
            self.unary_suffixes()
            if self.K[self.i] == "<":
                self.type_args()
        if self.maybe_word("implements"):
            self.type_list()
        self.take("{")
        if statement and name:
            self.scopes.append(name)
        while self.K[self.i] not in ("}", "EOF"):
            self.guarded(self.member)
        self.take("}")
        if statement and name:
            self.scopes.pop()
        if j is not None:
            self.end_type(j)

    def type_list(self):
        self.type_()
        while self.maybe(","):
            self.type_()

    def member(self):
        if self.maybe(";"):
            return
        while self.K[self.i] == "@":
            self.decorator()
        start = self.i
        if self.word("static") and self.peek() == "{":
            self.adv()
            self.block()
            return
        while (self.K[self.i] == "ID" or self.K[self.i] in ("const", "in", "export", "default")) and self.text() in MODIFIERS and self.peek() not in ("(", "=", ";", ":", "?", "!", "}", ",", "<") and not (self.NL[self.i + 1] and self.text() not in ("static", "public", "private", "protected")):
            self.adv()
        if self.K[self.i] == "[" and self.peek() == "ID" and self.peek(2) == ":":
            self.index_signature()
            self.member_end()
            return
        star = self.maybe("*")
        if (self.word("get") or self.word("set")) and self.peek() not in ("(", "=", ";", ":", "?", "!", "}", "<") and not self.NL[self.i + 1]:
            self.adv()
        a = self.i
        self.property_name()
        name = self.src[self.S[a] : self.E[self.i - 1]]
        self.maybe("?") or self.maybe("!")
        if self.K[self.i] in ("(", "<"):
            self.method(name, start)
            if self.K[self.i - 1] != "}":
                self.member_end()
            return
        if star:
            self.fail("( expected")
        if self.maybe(":"):
            self.type_()
        if self.maybe("="):
            self.assignment(self.scoped(name))
        self.member_end()

    def member_end(self):
        if not self.maybe(";") and self.K[self.i] != "}" and not self.NL[self.i]:
            self.fail("; expected")

    def method(self, name, start):
        j = self.begin_callable("method", self.scoped(name or "<anonymous>"), self.S[start])
        self.signature()
        if self.K[self.i] == "{":
            self.body_of(j)
            self.block()
            self.end_callable(j)
        else:
            self.drop_callable()

    def index_signature(self):
        self.take("[")
        self.name()
        self.take(":")
        self.type_()
        self.take("]")
        if self.maybe(":"):
            self.type_()

    def interface(self):
        if self.peek() != "ID" or self.NL[self.i + 1]:
            return False
        start = self.i
        self.adv()
        j = self.begin_type("interface", self.scoped(self.name()), self.S[start])
        if self.K[self.i] == "<":
            self.type_params()
        if self.maybe("extends"):
            self.type_list()
        self.object_type()
        self.end_type(j)
        return True

    def type_alias(self):
        if self.peek() != "ID" or self.NL[self.i + 1]:
            return False
        start = self.i
        self.adv()
        j = self.begin_type("type_alias", self.scoped(self.name()), self.S[start])
        if self.K[self.i] == "<":
            self.type_params()
        self.take("=")
        self.type_()
        self.semicolon()
        self.end_type(j)
        return True

    def enum(self):
        start = self.take("enum")
        j = self.begin_type("enum", self.scoped(self.name()), self.S[start])
        self.take("{")
        while self.K[self.i] != "}":
            self.property_name()
            if self.maybe("="):
                self.assignment()
            if self.K[self.i] != "}":
                self.take(",")
        self.take("}")
        self.end_type(j)

    def namespace(self):
        if self.peek() not in ("ID", "STR") or self.NL[self.i + 1]:
            return False
        self.adv()
        name = self.text()
        self.adv()
        while self.maybe("."):
            name += "." + self.any_name()
        if self.K[self.i] == "{":
            self.scopes.append(name)
            self.block()
            self.scopes.pop()
        else:
            self.semicolon()
        return True

    def global_(self):
        if self.peek() != "{":
            return False
        self.adv()
        self.block()
        return True

    def declare(self):
        if self.NL[self.i + 1] if self.peek() != "EOF" else True:
            return False
        if self.peek() not in ("ID", "var", "const", "function", "class", "enum"):
            return False
        self.adv()
        self.statement()
        return True

    def abstract(self):
        if self.peek() != "class":
            return False
        self.adv()
        self.class_()
        return True

    def async_(self):
        if self.peek() != "function" or self.NL[self.i + 1]:
            return False
        start = self.i
        self.adv()
        self.function(start)
        return True

    def refer(self, kind, at, start, binding=""):
        self.references.append({"kind": kind, "specifier": self.text(at)[1:-1], "binding": binding, "scope": "", "start": self.S[start], "end": self.E[at]})

    def import_(self):
        if self.peek() in ("(", "."):
            return self.expression_statement()
        start = self.i
        self.adv()
        if self.K[self.i] == "STR":
            self.adv()
            self.refer("side-effect", self.i - 1, start)
        else:
            if self.word("type") and (self.peek() in ("{", "*") or (self.peek() == "ID" and self.peek_word() != "from") or (self.peek_word() == "from" and self.peek(2) == "ID")):
                self.adv()
            if self.K[self.i] == "ID":
                self.adv()
                if self.maybe("="):
                    if self.word("require") and self.peek() == "(":
                        self.adv(), self.adv()
                        self.refer("import-require", self.take("STR"), start)
                        self.take(")")
                    else:
                        self.name()
                        while self.maybe("."):
                            self.any_name()
                    return self.semicolon()
                if self.K[self.i] == ",":
                    self.adv()
                elif not self.word("from"):
                    self.fail("from expected")
            if self.maybe("*"):
                if not self.maybe_word("as"):
                    self.fail("as expected")
                self.name()
            elif self.K[self.i] == "{":
                self.specifiers()
            self.from_("import", start)
        self.with_attributes()
        self.semicolon()

    def with_attributes(self):
        if self.K[self.i] == "with" or self.word("assert"):
            self.adv()
            self.object_literal()

    def from_(self, kind, start):
        if not self.maybe_word("from"):
            self.fail("from expected")
        self.refer(kind, self.take("STR"), start)

    def specifiers(self):
        self.take("{")
        while self.K[self.i] != "}":
            if self.word("type") and self.peek() not in (",", "}") and self.peek_word() != "as":
                self.adv()
            if self.K[self.i] == "STR":
                self.adv()
            else:
                self.any_name()
            if self.maybe_word("as"):
                if self.K[self.i] == "STR":
                    self.adv()
                else:
                    self.any_name()
            if self.K[self.i] != "}":
                self.take(",")
        self.take("}")

    def export(self):
        start = self.i
        self.adv()
        k = self.K[self.i]
        if k == "default":
            self.adv()
            k = self.K[self.i]
            if k == "function":
                self.function()
            elif k == "class":
                self.class_()
            elif k == "@":
                self.decorated()
            elif self.word("abstract") and self.peek() == "class":
                self.abstract()
            elif self.word("interface") and self.peek() == "ID":
                self.interface()
            elif self.word("async") and self.peek() == "function":
                self.async_()
            else:
                self.assignment()
                self.semicolon()
        elif k == "*":
            self.adv()
            if self.maybe_word("as"):
                self.any_name()
            self.from_("re-export", start)
            self.with_attributes()
            self.semicolon()
        elif k == "{" or (self.word("type") and self.peek() in ("{", "*")):
            if k != "{":
                self.adv()
            if self.maybe("*"):
                self.maybe_word("as") and self.any_name()
            else:
                self.specifiers()
            if self.word("from"):
                self.from_("re-export", start)
            self.with_attributes()
            self.semicolon()
        elif k == "=":
            self.adv()
            self.expression()
            self.semicolon()
        elif self.word("as"):
            self.adv()
            self.name()
            self.name()
            self.semicolon()
        elif k == "import":
            self.import_()
        elif k in ("var", "const", "function", "class", "enum", "@") or (k == "ID" and self.text() in ("let", "type", "interface", "namespace", "module", "declare", "abstract", "async", "global")):
            self.statement()
        else:
            self.fail("declaration expected")

    def debugger(self):
        self.adv()
        self.semicolon()

    STATEMENTS = {
        "{": block, "if": if_, "while": while_, "do": do_, "for": for_, "return": return_, "break": jump, "continue": jump,
        "throw": throw, "try": try_, "switch": switch, "with": with_, "var": var, "const": var, "function": function, "@": decorated,
        "class": class_, "enum": enum, "import": import_, "export": export, "debugger": debugger, ";": adv,
    }
    WORDS = {
        "let": let, "using": using, "interface": interface, "type": type_alias, "namespace": namespace, "module": namespace,
        "global": global_, "declare": declare, "abstract": abstract, "async": async_,
    }

    # Types.
    def type_params(self):
        self.take("<")
        while self.K[self.i] != ">":
            while self.K[self.i] in ("const", "in") or (self.word("out") and self.peek() == "ID"):
                self.adv()
            self.name()
            if self.maybe("extends"):
                self.type_()
            if self.maybe("="):
                self.type_()
            if self.K[self.i] != ">":
                self.take(",")
        self.take(">")

    def type_args(self):
        self.take("<")
        self.type_list()
        self.take(">")

    def return_type(self):
        if self.word("asserts") and self.peek() in ("ID", "this") and not self.NL[self.i + 1]:
            self.adv()
            self.adv()
            if self.maybe_word("is"):
                self.type_()
        elif self.K[self.i] in ("ID", "this") and self.peek() == "ID" and self.peek_word() == "is" and not self.NL[self.i + 1]:
            self.adv(), self.adv()
            self.type_()
        else:
            self.type_()

    def type_(self):
        if self.K[self.i] in ("<", "new") or (self.word("abstract") and self.peek() == "new") or (self.K[self.i] == "(" and self.function_type_ahead()):
            self.function_type()
            return
        self.union()
        if self.K[self.i] == "extends" and not self.NL[self.i]:
            self.adv()
            self.union_or_function()
            self.take("?")
            self.type_()
            self.take(":")
            self.type_()

    def union_or_function(self):
        if self.K[self.i] in ("<", "new") or (self.K[self.i] == "(" and self.function_type_ahead()):
            self.function_type()
        else:
            self.union()

    def function_type_ahead(self):
        k = self.peek()
        if k in (")", "..."):
            return True
        if k in ("ID", "this", "{", "["):
            m = self.mark()
            try:
                self.adv()
                if self.K[self.i] == "this":
                    self.adv()
                else:
                    self.binding()
                if self.K[self.i] in (":", ",", "?", "="):
                    return True
                if self.K[self.i] == ")":
                    self.adv()
                    return self.K[self.i] == "=>"
                return False
            except Fault:
                return False
            finally:
                self.back(m)
        return False

    def function_type(self):
        self.maybe_word("abstract")
        self.maybe("new")
        if self.K[self.i] == "<":
            self.type_params()
        self.params()
        self.take("=>")
        self.return_type()

    def union(self):
        self.maybe("|")
        self.intersection()
        while self.maybe("|"):
            self.intersection()

    def intersection(self):
        self.maybe("&")
        self.type_operator()
        while self.maybe("&"):
            self.type_operator()

    def type_operator(self):
        if self.K[self.i] == "ID":
            w = self.text()
            if w in ("keyof", "unique", "readonly") and self.peek() not in (",", ";", ")", "]", "}", ">", "=", "|", "&", "[", ":", "?", "=>", "EOF"):
                self.adv()
                return self.type_operator()
            if w == "infer" and self.peek() == "ID":
                self.adv(), self.adv()
                if self.K[self.i] == "extends":
                    m = self.mark()
                    self.adv()
                    self.union()
                    if self.K[self.i] == "?":
                        self.back(m)
                return
        if self.K[self.i] == "(" and self.function_type_ahead():
            return self.function_type()
        self.type_primary()
        while True:
            k = self.K[self.i]
            if k == "[" and not self.NL[self.i]:
                self.adv()
                if self.K[self.i] != "]":
                    self.type_()
                self.take("]")
            elif k == "!" and not self.NL[self.i]:
                self.adv()
            else:
                return

    def type_primary(self):
        k = self.K[self.i]
        if k == "ID" or k in ("void", "null", "this", "true", "false", "STR", "NUM"):
            self.adv()
            if k == "ID":
                self.type_reference_rest()
        elif k == "-":
            self.adv()
            self.take("NUM")
        elif k == "{":
            if not self.attempt(self.mapped_type):
                self.object_type()
        elif k == "[":
            self.adv()
            while self.K[self.i] != "]":
                self.maybe("...")
                if self.K[self.i] == "ID" and (self.peek() == ":" or (self.peek() == "?" and self.peek(2) == ":")):
                    self.adv()
                    self.maybe("?")
                    self.take(":")
                self.type_()
                self.maybe("?")
                if self.K[self.i] != "]":
                    self.take(",")
            self.take("]")
        elif k == "(":
            self.adv()
            self.type_()
            self.take(")")
        elif k == "typeof":
            self.adv()
            if self.K[self.i] == "import":
                self.import_type()
            else:
                self.any_name()
                self.type_reference_rest()
        elif k == "import":
            self.import_type()
        elif k == "`":
            self.template(self.type_)
        elif k == "new" or k == "<":
            self.function_type()
        else:
            if k == "BAD":
                self.bad()
            self.fail("type expected")

    def type_reference_rest(self):
        while self.K[self.i] == ".":
            self.adv()
            self.any_name()
        if self.K[self.i] == "<" and not self.NL[self.i]:
            self.type_args()

    def import_type(self):
        self.take("import")
        self.take("(")
        self.take("STR")
        if self.maybe(","):
            self.object_literal()
        self.take(")")
        self.type_reference_rest()

    def mapped_type(self):
        self.take("{")
        if self.K[self.i] in ("+", "-"):
            self.adv()
        self.maybe_word("readonly")
        self.take("[")
        self.name()
        self.take("in")
        self.type_()
        if self.maybe_word("as"):
            self.type_()
        self.take("]")
        if self.K[self.i] in ("+", "-"):
            self.adv()
        self.maybe("?")
        if self.maybe(":"):
            self.type_()
        self.maybe(";") or self.maybe(",")
        self.take("}")

    def object_type(self):
        self.take("{")
        while self.K[self.i] != "}":
            self.type_member()
            if not self.maybe(";") and not self.maybe(",") and self.K[self.i] != "}" and not self.NL[self.i]:
                self.fail("; expected")
        self.take("}")

    def type_member(self):
        k = self.K[self.i]
        if k in ("(", "<"):
            return self.signature()
        if k == "new" and self.peek() in ("(", "<"):
            self.adv()
            return self.signature()
        while self.K[self.i] == "ID" and self.text() in ("readonly", "static", "public", "private", "protected") and self.peek() not in ("(", ":", "?", "<", ";", ",", "}"):
            self.adv()
        if self.K[self.i] == "[" and self.peek() == "ID" and self.peek(2) == ":":
            return self.index_signature()
        if (self.word("get") or self.word("set")) and self.peek() not in ("(", ":", "?", "<", ";", ",", "}"):
            self.adv()
        self.property_name()
        self.maybe("?")
        if self.K[self.i] in ("(", "<"):
            self.signature()
        elif self.maybe(":"):
            self.type_()

    # Expressions.
    def expression(self):
        self.assignment()
        while self.maybe(","):
            self.assignment()

    def assignment(self, name=None):
        k = self.K[self.i]
        if k == "ID":
            w = self.text()
            if w == "async" and not (self.NL[self.i + 1] if self.peek() != "EOF" else True):
                if self.peek() == "ID" and self.peek(2) == "=>":
                    return self.simple_arrow(name)
                if self.peek() in ("(", "<") and self.attempt(self.arrow_head, name):
                    return self.arrow_body()
            if self.peek() == "=>":
                return self.simple_arrow(name)
            if w == "yield" and self.cx and self.peek() not in (".", "=", "=>", "("):
                self.adv()
                self.maybe("*")
                if not self.NL[self.i] and self.K[self.i] not in (")", "]", "}", ",", ";", ":", "EOF"):
                    self.assignment()
                return
        elif k == "(":
            if self.attempt(self.arrow_head, name):
                return self.arrow_body()
        elif k == "<":
            if self.attempt(self.arrow_head, name):
                return self.arrow_body()
        a = self.i
        self.conditional(name)
        k = self.K[self.i]
        if k == ">":
            k = self.greater()
        if k in ASSIGN:
            target = self.src[self.S[a] : self.E[self.i - 1]]
            self.adv()
            self.assignment(target if len(target) < 200 else None)

    def simple_arrow(self, name):
        start = self.i
        j = self.begin_callable("arrow_function", name or self.scoped("<anonymous>"), self.S[start])
        self.maybe_word("async") if self.peek() == "ID" else None
        self.take("ID")
        if self.NL[self.i]:
            self.fail()
        self.take("=>")
        self.arrow_body(j)

    def arrow_head(self, name):
        start = self.i
        j = self.begin_callable("arrow_function", name or self.scoped("<anonymous>"), self.S[start])
        self.maybe_word("async")
        if self.K[self.i] == "<":
            jsx_like = self.jsx and self.peek(2) not in (",", "extends")
            if jsx_like:
                self.fail()
            self.type_params()
        self.params()
        if self.maybe(":"):
            self.return_type()
        if self.NL[self.i]:
            self.fail()
        self.take("=>")
        self.arrow_at = j
        return True

    def arrow_body(self, j=None):
        j = self.open[-1][1] if j is None else j
        self.body_of(j)
        if self.K[self.i] == "{":
            no_in, self.no_in = self.no_in, False
            self.block()
            self.no_in = no_in
        else:
            self.assignment()
        self.end_callable(j)

    def conditional(self, name=None):
        self.binary(0, name)
        if self.K[self.i] == "?":
            self.adv()
            self.branch()
            no_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = no_in
            self.take(":")
            self.assignment()

    def binary(self, least, name=None):
        self.unary(name)
        while True:
            k = self.K[self.i]
            if k == ">":
                k = self.greater()
            elif k == "ID":
                if not self.NL[self.i] and self.text() in ("as", "satisfies") and least < 8:
                    self.adv()
                    if not self.maybe("const"):
                        self.type_()
                    continue
                return
            elif k == "in" and self.no_in:
                return
            p = PRECEDENCE.get(k, 0)
            if p <= least:
                return
            if p < 4:
                self.branch()
            self.adv()
            self.binary(p - 1 if k == "**" else p)

    def unary(self, name=None):
        k = self.K[self.i]
        if k in ("!", "~", "+", "-", "++", "--", "typeof", "void", "delete"):
            self.adv()
            self.unary()
            return
        if k == "ID" and self.text() == "await" and self.peek() not in (".", "=", "=>", ")", ",", ";", "?.", "]", "}", ":", "EOF"):
            self.adv()
            self.unary()
            return
        if k == "<":
            if self.jsx:
                self.jsx_element()
                self.cut_after_jsx()
                self.suffixes(True)
                return
            self.type_args()
            self.unary()
            return
        self.unary_suffixes(name)
        if self.K[self.i] in ("++", "--") and not self.NL[self.i]:
            self.adv()

    def unary_suffixes(self, name=None):
        self.primary(name)
        self.suffixes(True)

    def suffixes(self, calls):
        while True:
            k = self.K[self.i]
            if k == "." or k == "?.":
                self.adv()
                if k == "?." and self.K[self.i] in ("(", "["):
                    continue
                if k == "?." and self.K[self.i] == "<":
                    self.type_args()
                    continue
                self.any_name()
            elif k == "[":
                self.adv()
                no_in, self.no_in = self.no_in, False
                self.expression()
                self.no_in = no_in
                self.take("]")
            elif k == "(" and calls:
                self.arguments()
            elif k == "`":
                self.template(self.expression)
            elif k == "!" and not self.NL[self.i]:
                self.adv()
            elif k == "<" and self.attempt(self.call_type_args):
                pass
            else:
                return

    def call_type_args(self):
        self.type_args()
        k = self.K[self.i]
        if k in ("(", "`") or k in (")", "]", ":", ";", ",", ".", "?.", "==", "!=", "===", "!==", "&&", "||", "??", "}", "EOF", "?", "=", "|", "&", "^", "instanceof", "in") or self.NL[self.i]:
            return True
        self.fail()

    def arguments(self):
        self.take("(")
        no_in, self.no_in = self.no_in, False
        while self.K[self.i] != ")":
            self.maybe("...")
            self.assignment()
            if self.K[self.i] != ")":
                self.take(",")
        self.take(")")
        self.no_in = no_in

    def primary(self, name=None):
        k = self.K[self.i]
        if k == "ID":
            if self.text() == "async" and self.peek() == "function" and not self.NL[self.i + 1]:
                start = self.i
                self.adv()
                return self.function_expression(name, start)
            self.adv()
        elif k in ("NUM", "STR", "this", "null", "true", "false", "super"):
            self.adv()
        elif k == "(":
            self.adv()
            no_in, self.no_in = self.no_in, False
            self.assignment(name)
            while self.maybe(","):
                self.assignment()
            self.no_in = no_in
            self.take(")")
        elif k == "[":
            self.adv()
            no_in, self.no_in = self.no_in, False
            while self.K[self.i] != "]":
                if not self.maybe(","):
                    self.maybe("...")
                    self.assignment()
                    if self.K[self.i] != "]":
                        self.take(",")
            self.take("]")
            self.no_in = no_in
        elif k == "{":
            self.object_literal()
        elif k == "function":
            self.function_expression(name, self.i)
        elif k == "class":
            self.class_(False)
        elif k == "@":
            while self.K[self.i] == "@":
                self.decorator()
            self.class_(False)
        elif k == "new":
            self.adv()
            if self.maybe("."):
                self.any_name()
                return
            self.primary()
            self.suffixes(False)
            if self.K[self.i] == "<":
                self.attempt(self.call_type_args)
            if self.K[self.i] == "(":
                self.arguments()
        elif k == "`":
            self.template(self.expression)
        elif k in ("/", "/="):
            m = _REGEX.match(self.src, self.S[self.i])
            if m is None:
                raise Fault("unterminated-literal", self.S[self.i], "regular expression without end")
            self.retoken("STR", m.end())
            self.adv()
        elif k == "import":
            self.adv()
            if self.maybe("."):
                self.any_name()
            elif self.K[self.i] == "(":
                self.arguments()
            else:
                self.fail()
        elif k == "BAD":
            self.bad()
        else:
            self.fail("expression expected")

    def function_expression(self, name, start):
        self.take("function")
        star = self.maybe("*")
        own = self.text() if self.K[self.i] == "ID" else ""
        self.maybe("ID")
        j = self.begin_callable("generator_function" if star else "function", self.scoped(own) if own else name or self.scoped("<anonymous>"), self.S[start])
        self.signature()
        self.body_of(j)
        self.block()
        self.end_callable(j)

    def object_literal(self):
        self.take("{")
        no_in, self.no_in = self.no_in, False
        while self.K[self.i] != "}":
            if self.maybe("..."):
                self.assignment()
            else:
                start = self.i
                star = self.maybe("*")
                if self.K[self.i] == "ID" and self.text() in ("get", "set", "async") and self.peek() not in ("(", ":", ",", "}", "=", "<"):
                    self.adv()
                    star = self.maybe("*") or star
                plain = self.K[self.i] == "ID"
                a = self.i
                self.property_name()
                name = self.src[self.S[a] : self.E[self.i - 1]]
                k = self.K[self.i]
                if k in ("(", "<"):
                    j = self.begin_callable("method", self.scoped(name), self.S[start])
                    self.signature()
                    self.body_of(j)
                    self.block()
                    self.end_callable(j)
                elif k == ":":
                    self.adv()
                    self.assignment(self.scoped(name))
                elif plain and not star:
                    if self.maybe("="):
                        self.assignment()
                else:
                    self.fail(": expected")
            if self.K[self.i] != "}":
                self.take(",")
        self.take("}")
        self.no_in = no_in

    def template(self, inner):
        """A template text: its pieces are read here, what stands in ${ } by inner."""
        src, at = self.src, self.E[self.i]
        no_in, self.no_in = self.no_in, False
        while True:
            m = _TEMPLATE.match(src, at)
            at = m.end()
            if at >= len(src) or src[at] == "\\":
                raise Fault("unterminated-literal", self.S[self.i], "template text without end")
            if src[at] == "`":
                break
            # The token before the hole ends at its brace.
            self.retoken("`", at + 2)
            self.adv()
            inner()
            if self.K[self.i] != "}":
                self.take("}")
            at = self.E[self.i]
        self.retoken("STR", at + 1)
        self.adv()
        self.no_in = no_in

    # JSX.
    def jsx_space(self, at):
        return _SPACE.match(self.src, at).end()

    def jsx_fail(self, at, what):
        raise Fault("unexpected-end" if at >= len(self.src) else "unexpected-token", at, what)

    def jsx_element(self):
        """From the < of the current token; leaves the current token ending where the element ends."""
        at = self.jsx_read(self.S[self.i])
        self.retoken("STR", at)

    def cut_after_jsx(self):
        self.adv()

    def jsx_read(self, at):
        src = self.src
        at = self.jsx_space(at + 1)
        m = _JSX_NAME.match(src, at)
        name = m[0] if m else ""
        at = self.jsx_space(m.end() if m else at)
        if m:
            if src[at : at + 1] == "<":
                at = self.jsx_code(at, self.type_args, closing=False)
                at = self.jsx_space(at)
            while True:
                c = src[at : at + 1]
                if c == "/" or c == ">":
                    break
                if c == "{":
                    at = self.jsx_code(at, self.jsx_spread)
                else:
                    a = _JSX_NAME.match(src, at)
                    if a is None:
                        self.jsx_fail(at, "attribute expected")
                    at = self.jsx_space(a.end())
                    if src[at : at + 1] == "=":
                        at = self.jsx_space(at + 1)
                        c = src[at : at + 1]
                        if c == "{":
                            at = self.jsx_code(at, self.assignment)
                        elif c == "<":
                            at = self.jsx_read(at)
                        else:
                            s = _JSX_STRING.match(src, at)
                            if s is None:
                                self.jsx_fail(at, "value expected")
                            at = s.end()
                at = self.jsx_space(at)
            if src[at] == "/":
                at = self.jsx_space(at + 1)
                if src[at : at + 1] != ">":
                    self.jsx_fail(at, "> expected")
                return at + 1
        elif src[at : at + 1] != ">":
            self.jsx_fail(at, "element name expected")
        at += 1
        while True:
            at = _JSX_TEXT.match(src, at).end()
            c = src[at : at + 1]
            if c == "{":
                after = self.jsx_space(at + 1)
                at = after + 1 if src[after : after + 1] == "}" else self.jsx_code(at, self.jsx_child)
            elif c == "<":
                after = self.jsx_space(at + 1)
                if src[after : after + 1] == "/":
                    after = self.jsx_space(after + 1)
                    m = _JSX_NAME.match(src, after)
                    if (m[0] if m else "") != name:
                        self.jsx_fail(after, f"end of {name or 'fragment'} expected")
                    after = self.jsx_space(m.end() if m else after)
                    if src[after : after + 1] != ">":
                        self.jsx_fail(after, "> expected")
                    return after + 1
                at = self.jsx_read(at)
            else:
                self.jsx_fail(at, "unexpected character in JSX text" if c else "element without end")

    def jsx_spread(self):
        self.take("...")
        self.assignment()

    def jsx_child(self):
        self.maybe("...")
        self.expression()

    def jsx_code(self, at, inner, closing=True):
        """Reads code in braces (or type arguments) at an offset as tokens; the offset after it."""
        self.retoken("<jsx", at + 1 if closing else at)
        self.adv()
        inner()
        if not closing:
            return self.E[self.i - 1]
        if self.K[self.i] != "}":
            self.take("}")
        return self.E[self.i]
