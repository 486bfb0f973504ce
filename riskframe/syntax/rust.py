"""Rust."""

from __future__ import annotations

import re

from riskframe.syntax.base import Cursor, Fault

#: Rust's strict keywords and the precedence of its binary operators.
KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
)
PRECEDENCE = {
    "..": 2, "..=": 2, "||": 3, "&&": 4,
    "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5,
    "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11,
}
ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="])

_TOKEN = re.compile(
    r"""\s*(?:(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?c?r(?P<h>\#*)"(?:(?!"(?P=h)).|\n)*"(?P=h))
|(?P<STR>[bc]?"(?:[^"\\]|\\(?:\n|.))*"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|.))')
|(?P<LIFE>'[^\W\d]\w*)|(?P<rawid>r\#[^\W\d]\w*)|(?P<ID>[^\W\d]\w*)
|(?P<NUM>0[xX][0-9a-fA-F_]+\w*|0[bBoO][0-9_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*)
|(?P<op>\.\.\.|\.\.=|<<=|>>=|&&|\|\||==|!=|<=|>=|->|=>|::|\.\.|\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|[-+*/%^!&|=<>@.,;:\#$?~()\[\]{}])|\Z)""",
    re.X,
)
_BLANKS = re.compile(r"\s*")
_COMMENT = re.compile(r"/\*|\*/")
_ITEM = frozenset("fn struct enum union trait impl mod use const static type extern pub unsafe async macro_rules".split())
_BLOCKLIKE = frozenset(["if", "match", "loop", "while", "for", "unsafe", "{", "LIFE"])


class parser(Cursor):
    def __init__(self, src, ext):
        super().__init__(src, ext)
        K, S, E = self.K, self.S, self.E = [], [], []
        at, n, match = 0, len(src), _TOKEN.match
        if src.startswith("#!") and not src.startswith("#!["):
            at = src.find("\n") if "\n" in src else n
        kind, start_, end_ = K.append, S.append, E.append
        while at < n:
            m = match(src, at)
            if m is None:
                at = _BLANKS.match(src, at).end()
                quote = src[at] in "\"'"
                self.faults.append(Fault("unterminated-literal" if quote else "bad-token", at, f"unexpected character {src[at]!r}"))
                at = n if src[at] == '"' else at + 1
                continue
            g, at = m.lastgroup, m.end()
            if g == "ID" or g == "op":
                t = m[g]
                kind(t if g == "op" or t in KEYWORDS else g)
                start_(at - len(t))
                end_(at)
            elif g == "block":
                begin, depth = m.start(g), 1
                while depth:
                    c = _COMMENT.search(src, at)
                    if c is None:
                        self.faults.append(Fault("unterminated-literal", begin, "comment without end"))
                        at = n
                        break
                    depth += 1 if c[0] == "/*" else -1
                    at = c.end()
            elif g is not None and g != "line":
                kind("STR" if g in ("raw", "h") else "ID" if g == "rawid" else g)
                start_(m.start("raw" if g == "h" else g))
                end_(at)
        K.append("EOF"), S.append(n), E.append(n)
        self.scopes: list[str] = []
        self.no_struct = False

    def split(self):
        """Takes the first character off a token such as >> or && or ||."""
        k, i = self.K[self.i], self.i
        self.K[i : i + 1], self.S[i : i + 1], self.E[i : i + 1] = [k[0], k[1:]], [self.S[i], self.S[i] + 1], [self.S[i] + 1, self.E[i]]

    def gt(self):
        k = self.K[self.i]
        if k in (">>", ">=", ">>="):
            self.split()
        self.take(">")

    def file(self):
        while self.K[self.i] == "#" and self.K[self.i + 1] == "!":
            self.attribute()
        self.modules.append({"system": "rust-crate", "name": "crate"})
        self.top_level(self.item, stops=_ITEM)

    # Items.
    def attributes(self):
        while self.K[self.i] == "#":
            self.attribute()

    def attribute(self):
        self.take("#")
        self.maybe("!")
        if self.K[self.i] != "[":
            self.fail("[ expected")
        self.tree()

    def tree(self):
        """One balanced group of tokens."""
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

    def name(self):
        """An identifier; weak keywords are plain names here."""
        return self.text(self.take("ID"))

    def scoped(self, name):
        return "::".join([*self.scopes, name])

    def visibility(self):
        if self.maybe("pub") and self.K[self.i] == "(" and self.K[self.i + 1] in ("crate", "super", "self", "in"):
            self.tree()

    def item(self):
        self.attributes()
        start = self.i
        self.visibility()
        if not self.item_rest(start):
            self.fail("item expected")

    def item_rest(self, start):
        """Parses an item after attributes and visibility; false (nothing taken) if there is none."""
        K = self.K
        k, k2 = K[self.i], K[self.i + 1] if K[self.i] != "EOF" else ""
        j = self.i
        while K[j] in ("const", "async", "unsafe") or (K[j] == "extern" and K[j + 1] in ("STR", "fn")) or (K[j] == "STR" and K[j - 1] == "extern") or (K[j] == "ID" and self.text(j) in ("default", "safe") and K[j + 1] in ("fn", "unsafe", "async", "const", "extern", "type", "impl")):
            j += 1
        if K[j] == "fn":
            self.i = j
            self.function(start)
        elif K[j] in ("impl", "trait") or (K[j] == "ID" and self.text(j) == "auto" and K[j + 1] == "trait"):
            self.i = j + (K[j] == "ID")
            (self.impl if K[j] == "impl" else self.trait)(start)
        elif k == "const" or k == "static":
            if k == "const" and k2 == "{":
                return False
            self.i += 1
            self.maybe("mut")
            name = "_" if K[self.i] == "ID" and self.text() == "_" else self.text(self.i)
            self.take("ID")
            self.maybe_generics()
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.expression(name=self.scoped(name))
            self.where()
            self.take(";")
        elif k == "type" or (k == "ID" and self.text() == "default" and k2 == "type"):
            self.i += 1 + (k == "ID")
            t = self.begin_type("type_alias", self.scoped(self.name()), self.S[start])
            self.maybe_generics()
            if self.maybe(":"):
                self.bounds()
            self.where()
            if self.maybe("="):
                self.type_()
            self.where()
            self.take(";")
            self.end_type(t)
        elif k == "struct" or (k == "ID" and self.text() == "union" and k2 == "ID"):
            self.i += 1
            t = self.begin_type("struct" if k == "struct" else "union", self.scoped(self.name()), self.S[start])
            self.maybe_generics()
            self.where()
            if K[self.i] == "{":
                self.fields()
            else:
                if K[self.i] == "(":
                    self.tuple_fields()
                self.where()
                self.take(";")
            self.end_type(t)
        elif k == "enum":
            self.i += 1
            t = self.begin_type("enum", self.scoped(self.name()), self.S[start])
            self.maybe_generics()
            self.where()
            self.take("{")
            while K[self.i] != "}":
                self.attributes()
                self.visibility()
                self.name()
                if K[self.i] == "{":
                    self.fields()
                elif K[self.i] == "(":
                    self.tuple_fields()
                if self.maybe("="):
                    self.expression()
                if not self.maybe(","):
                    break
            self.take("}")
            self.end_type(t)
        elif k == "mod":
            self.i += 1
            name = self.name()
            if not self.maybe(";"):
                self.modules.append({"system": "rust-crate", "name": "::".join(["crate", *self.scopes, name])})
                self.take("{")
                self.scopes.append(name)
                self.members(self.item)
                self.scopes.pop()
        elif k == "use":
            self.i += 1
            self.use("", start)
            self.take(";")
        elif k == "extern":
            self.i += 1
            if self.maybe("crate"):
                self.i += K[self.i] in ("ID", "self")
                if self.maybe("as"):
                    self.name()
                self.take(";")
            else:
                self.maybe("STR")
                self.take("{")
                self.members(self.associated)
        elif k == "ID" and self.text() == "macro_rules" and k2 == "!":
            self.i += 2
            self.name()
            brace = K[self.i] == "{"
            if K[self.i] not in self.OPEN:
                self.fail()
            self.tree()
            if not brace:
                self.take(";")
        elif k in ("ID", "crate", "self", "super", "::") and self.macro_ahead():
            if self.macro() != "{":
                self.take(";")
        else:
            return False
        return True

    def members(self, f):
        while self.K[self.i] not in ("}", "EOF"):
            self.guarded(f)
        self.take("}")

    def macro_ahead(self):
        j = self.i + (self.K[self.i] == "::")
        while self.K[j] in ("ID", "crate", "self", "super") and self.K[j + 1] == "::":
            j += 2
        return self.K[j] in ("ID", "crate") and self.K[j + 1] == "!" and self.K[j + 2] in ("(", "[", "{")

    def macro(self):
        while self.K[self.i] != "!":
            self.i += 1
        self.i += 1
        k = self.K[self.i]
        self.tree()
        return k

    def use(self, prefix, start):
        parts = []
        self.maybe("::")
        while True:
            k = self.K[self.i]
            if k == "{":
                self.i += 1
                while self.K[self.i] != "}":
                    self.use("::".join([p for p in (prefix, *parts) if p]), start)
                    if not self.maybe(","):
                        break
                self.take("}")
                return
            if k == "*":
                self.i += 1
                self.leaf("::".join([p for p in (prefix, *parts) if p]), "*", start)
                return
            if k not in ("ID", "crate", "self", "super", "Self", "$"):
                self.fail("path expected")
            if k == "$":
                self.i += 1
            parts.append(self.text())
            self.i += 1
            if not self.maybe("::"):
                break
        binding = parts[-1]
        if self.maybe("as"):
            binding = self.text(self.take("ID"))
        self.leaf("::".join([p for p in (prefix, *parts) if p]), binding, start)

    def leaf(self, specifier, binding, start):
        self.references.append({"kind": "use", "specifier": specifier, "binding": binding, "scope": "::".join(["crate", *self.scopes]), "start": self.S[start], "end": self.E[self.i - 1]})

    def fields(self):
        self.take("{")
        while self.K[self.i] != "}":
            self.attributes()
            self.visibility()
            self.name()
            self.take(":")
            self.type_()
            if not self.maybe(","):
                break
        self.take("}")

    def tuple_fields(self):
        self.take("(")
        while self.K[self.i] != ")":
            self.attributes()
            self.visibility()
            self.type_()
            if not self.maybe(","):
                break
        self.take(")")

    def impl(self, start):
        self.take("impl")
        if self.K[self.i] == "<":
            self.generics()
        self.maybe("const")
        self.maybe("!")
        a = self.i
        self.type_()
        target = "".join(self.src[self.S[a] : self.E[self.i - 1]].split())
        if self.maybe("for"):
            b = self.i
            self.type_()
            target = f"<{''.join(self.src[self.S[b] : self.E[self.i - 1]].split())} as {target}>"
        self.where()
        self.take("{")
        self.scopes.append(target)
        self.members(self.associated)
        self.scopes.pop()

    def trait(self, start):
        self.take("trait")
        name = self.name()
        t = self.begin_type("trait", self.scoped(name), self.S[start])
        self.maybe_generics()
        if self.maybe(":"):
            self.bounds()
        self.where()
        if self.maybe("="):
            self.bounds()
            self.take(";")
        else:
            self.take("{")
            self.scopes.append(name)
            self.members(self.associated)
            self.scopes.pop()
        self.end_type(t)

    def associated(self):
        self.attributes()
        start = self.i
        self.visibility()
        if self.K[self.i] not in ("fn", "const", "type", "static", "async", "unsafe", "extern") and not (self.K[self.i] == "ID" and (self.text() in ("default", "safe") or self.macro_ahead())) and not self.macro_ahead():
            self.fail("member expected")
        if not self.item_rest(start):
            self.fail("member expected")

    def function(self, start):
        self.take("fn")
        j = self.begin_callable("function", self.scoped(self.name()), self.S[start])
        self.maybe_generics()
        self.take("(")
        while self.K[self.i] != ")":
            self.attributes()
            if not self.attempt(self.self_param):
                if not self.maybe("..."):
                    if not self.attempt(self.typed_param):
                        self.type_()
            if not self.maybe(","):
                break
        self.take(")")
        if self.maybe("->"):
            self.type_()
        self.where()
        if self.K[self.i] == "{":
            self.body_of(j)
            self.block()
        else:
            self.take(";")
        self.end_callable(j)

    def self_param(self):
        if self.maybe("&"):
            self.maybe("LIFE")
        self.maybe("mut")
        self.take("self")
        if self.maybe(":"):
            self.type_()
        if self.K[self.i] not in (",", ")"):
            self.fail()

    def typed_param(self):
        self.pattern(False)
        self.take(":")
        if not self.maybe("..."):
            self.type_()

    def maybe_generics(self):
        if self.K[self.i] == "<":
            self.generics()

    def generics(self):
        self.take("<")
        while self.K[self.i] not in (">", ">=", ">>"):
            self.attributes()
            if self.maybe("LIFE"):
                if self.maybe(":"):
                    while self.maybe("LIFE"):
                        if not self.maybe("+"):
                            break
            elif self.maybe("const"):
                self.name()
                self.take(":")
                self.type_()
                if self.maybe("="):
                    self.const_arg()
            else:
                self.name()
                if self.maybe(":"):
                    self.bounds()
                if self.maybe("="):
                    self.type_()
            if not self.maybe(","):
                break
        self.gt()

    def const_arg(self):
        if self.K[self.i] == "{":
            self.block()
        else:
            self.maybe("-")
            if self.K[self.i] in ("NUM", "STR", "true", "false", "ID"):
                self.i += 1
            else:
                self.fail()

    def bounds(self):
        while self.K[self.i] in ("LIFE", "ID", "?", "(", "for", "::", "crate", "self", "super", "Self", "<", "~", "dyn", "impl", "async", "const"):
            if not self.maybe("LIFE"):
                if self.maybe("("):
                    self.maybe("?")
                    self.bounds()
                    self.take(")")
                else:
                    self.maybe("?")
                    if self.maybe("~"):
                        self.take("const")
                    self.maybe("async")
                    if self.maybe("for"):
                        self.generics()
                    self.type_path()
            if not self.maybe("+"):
                break

    def where(self):
        if self.maybe("where"):
            while self.K[self.i] not in ("{", ";", "=", "EOF"):
                if self.maybe("LIFE"):
                    self.take(":")
                    self.bounds()
                else:
                    if self.maybe("for"):
                        self.generics()
                    self.type_()
                    self.take(":")
                    self.bounds()
                if not self.maybe(","):
                    break

    # Types.
    def type_(self):
        k = self.K[self.i]
        if k == "&&":
            self.split()
            k = "&"
        if k == "&":
            self.i += 1
            self.maybe("LIFE")
            self.maybe("mut")
            self.type_()
        elif k == "*":
            self.i += 1
            if self.K[self.i] not in ("const", "mut"):
                self.fail()
            self.i += 1
            self.type_()
        elif k == "(":
            self.i += 1
            while self.K[self.i] != ")":
                self.type_()
                if not self.maybe(","):
                    break
            self.take(")")
        elif k == "[":
            self.i += 1
            self.type_()
            if self.maybe(";"):
                self.expression()
            self.take("]")
        elif k == "!":
            self.i += 1
        elif k in ("dyn", "impl"):
            self.i += 1
            self.bounds()
        elif k in ("fn", "unsafe", "extern", "for"):
            if self.maybe("for"):
                self.generics()
            self.maybe("unsafe")
            if self.maybe("extern"):
                self.maybe("STR")
            if self.maybe("fn"):
                self.take("(")
                while self.K[self.i] != ")":
                    if self.K[self.i] == "ID" and self.K[self.i + 1] == ":":
                        self.i += 2
                    if not self.maybe("..."):
                        self.type_()
                    if not self.maybe(","):
                        break
                self.take(")")
                if self.maybe("->"):
                    self.type_()
            else:
                self.type_path()
        elif self.macro_ahead():
            self.macro()
        else:
            self.type_path()
            if self.K[self.i] == "+" and self.K[self.i + 1] == "LIFE":
                self.i += 1
                self.bounds()

    def type_path(self):
        if self.K[self.i] in ("<", "<<"):
            self.qualified()
        else:
            self.maybe("::")
            self.segment(False)
        while self.maybe("::"):
            self.segment(False)

    def qualified(self):
        if self.K[self.i] == "<<":
            self.split()
        self.take("<")
        self.type_()
        if self.maybe("as"):
            self.type_path()
        self.gt()
        if self.K[self.i] != "::":
            self.fail(":: expected")

    def segment(self, in_expression):
        k = self.K[self.i]
        if k not in ("ID", "crate", "self", "super", "Self") and not (k == "<" and self.K[self.i - 1] == "::"):
            self.fail("path expected")
        if k != "<":
            self.i += 1
        k = self.K[self.i]
        if in_expression:
            if k == "::" and self.K[self.i + 1] in ("<", "<<"):
                self.i += 1
                self.generic_args()
        elif k in ("<", "<<"):
            self.generic_args()
        elif k == "::" and self.K[self.i + 1] == "<":
            self.i += 1
            self.generic_args()
        elif k == "(" and self.text(self.i - 1) in ("Fn", "FnMut", "FnOnce", "AsyncFn", "AsyncFnMut", "AsyncFnOnce"):
            self.i += 1
            while self.K[self.i] != ")":
                self.type_()
                if not self.maybe(","):
                    break
            self.take(")")
            if self.maybe("->"):
                self.type_()

    def generic_args(self):
        if self.K[self.i] == "<<":
            self.split()
        self.take("<")
        while self.K[self.i] not in (">", ">>", ">=", ">>="):
            k = self.K[self.i]
            if k == "LIFE":
                self.i += 1
            elif k in ("NUM", "STR", "true", "false", "{", "-"):
                self.const_arg()
            else:
                self.type_()
                if self.maybe("="):
                    if self.K[self.i] in ("NUM", "{", "-"):
                        self.const_arg()
                    else:
                        self.type_()
                elif self.maybe(":"):
                    self.bounds()
            if not self.maybe(","):
                break
        self.gt()

    # Patterns.
    def pattern(self, alternatives=True):
        if alternatives:
            self.maybe("|")
        while True:
            self.one_pattern()
            if not alternatives or not self.maybe("|"):
                return

    def one_pattern(self):
        k = self.K[self.i]
        if k == "&&":
            self.split()
            k = "&"
        if k == "&":
            self.i += 1
            self.maybe("mut")
            self.one_pattern()
        elif k in ("ref", "mut"):
            self.i += 1
            self.maybe("mut")
            self.name()
            if self.maybe("@"):
                self.one_pattern()
        elif k in ("(", "["):
            self.i += 1
            self.patterns(self.OPEN[k])
        elif k in ("NUM", "STR", "true", "false", "-"):
            self.range_end()
            if self.K[self.i] in ("..=", "..", "..."):
                self.i += 1
                if self.K[self.i] in ("NUM", "STR", "-", "ID", "Self", "crate", "self"):
                    self.range_end()
        elif k in ("..", "..="):
            self.i += 1
            if self.K[self.i] in ("NUM", "STR", "-", "ID"):
                self.range_end()
        elif k == "const" and self.K[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif k in ("ID", "crate", "self", "super", "Self", "::", "<"):
            if self.macro_ahead():
                self.macro()
                return
            self.path()
            k = self.K[self.i]
            if k == "(":
                self.i += 1
                self.patterns(")")
            elif k == "{":
                self.i += 1
                while self.K[self.i] != "}":
                    self.attributes()
                    if self.maybe(".."):
                        break
                    if self.K[self.i] in ("ID", "NUM") and self.K[self.i + 1] == ":":
                        self.i += 2
                        self.pattern()
                    else:
                        self.maybe("ref")
                        self.maybe("mut")
                        self.name()
                    if not self.maybe(","):
                        break
                self.take("}")
            elif k == "@":
                self.i += 1
                self.one_pattern()
            elif k in ("..=", "..", "..."):
                self.i += 1
                if self.K[self.i] in ("NUM", "STR", "-", "ID", "Self", "crate"):
                    self.range_end()
        else:
            self.fail("pattern expected")

    def range_end(self):
        self.maybe("-")
        if self.K[self.i] in ("NUM", "STR", "true", "false"):
            self.i += 1
        else:
            self.path()

    def patterns(self, close):
        while self.K[self.i] != close:
            self.pattern()
            if not self.maybe(","):
                break
        self.take(close)

    def path(self):
        if self.K[self.i] == "<":
            self.qualified()
            self.take("::")
        else:
            self.maybe("::")
        self.segment(True)
        while self.K[self.i] == "::":
            self.i += 1
            self.segment(True)

    # Statements.
    def block(self):
        free, self.no_struct = self.no_struct, False
        self.take("{")
        while self.K[self.i] == "#" and self.K[self.i + 1] == "!":
            self.attribute()
        while self.K[self.i] not in ("}", "EOF"):
            self.guarded(self.statement)
        self.take("}")
        self.no_struct = free

    def statement(self):
        if self.maybe(";"):
            return
        self.attributes()
        k = self.K[self.i]
        if k == "let":
            self.i += 1
            a = self.i
            self.pattern()
            name = self.src[self.S[a] : self.E[self.i - 1]]
            if self.maybe(":"):
                self.type_()
            if self.maybe("="):
                self.expression(name=self.scoped(name))
                if self.maybe("else"):
                    self.block()
            self.take(";")
            return
        start = self.i
        if k in _ITEM or k in ("ID", "::"):
            self.visibility()
            macro = k in ("ID", "crate", "self", "super", "::") and self.macro_ahead()
            if macro:
                m = self.mark()
                if self.macro() == "{" and self.K[self.i] not in (".", "?"):
                    return
                self.back(m)
            elif not (k == "unsafe" and self.K[self.i + 1] == "{") and not (k == "async" and self.K[self.i + 1] in ("{", "move", "|", "||")) and self.item_rest(start):
                return
        block = k in _BLOCKLIKE
        if block and not (k == "LIFE" and self.K[self.i + 1] != ":"):
            self.block_expression()
            if self.K[self.i] not in (".", "?"):
                self.maybe(";")
                return
            self.suffixes()
            self.operators(0)
        else:
            self.expression()
        if self.K[self.i] != "}":
            self.take(";")

    # Expressions.
    def expression(self, least=0, name=None):
        k = self.K[self.i]
        if k in ("..", "..="):
            self.i += 1
            if self.starts():
                self.expression(2)
        else:
            self.unary(name)
        self.operators(least, name)

    def starts(self):
        k = self.K[self.i]
        return k in ("ID", "NUM", "STR", "(", "[", "-", "*", "!", "&", "&&", "|", "||", "<", "::", "LIFE", "self", "Self", "crate", "super", "true", "false", "if", "match", "loop", "while", "for", "unsafe", "move", "async", "return", "break", "continue") or (k == "{" and not self.no_struct)

    def operators(self, least, name=None):
        while True:
            k = self.K[self.i]
            if k == "as":
                self.i += 1
                self.type_()
                continue
            if k in ASSIGN:
                if least > 1:
                    return
                self.i += 1
                self.expression(0)
                continue
            p = PRECEDENCE.get(k, 0)
            if p <= least:
                return
            self.i += 1
            if p == 2:
                if self.starts():
                    self.expression(2)
                continue
            if p in (3, 4):
                self.branch()
            self.expression(p)

    def unary(self, name=None):
        while True:
            k = self.K[self.i]
            if k in ("-", "!", "*"):
                self.i += 1
            elif k in ("&", "&&"):
                self.i += 1
                if self.K[self.i] == "ID" and self.text() == "raw" and self.K[self.i + 1] in ("const", "mut"):
                    self.i += 2
                else:
                    self.maybe("mut")
            else:
                break
        self.primary(name)
        self.suffixes()

    def suffixes(self):
        while True:
            k = self.K[self.i]
            if k == "?":
                self.branch()
                self.i += 1
            elif k == ".":
                self.i += 1
                k = self.K[self.i]
                if k == "await" or k == "NUM":
                    self.i += 1
                elif k in ("ID",):
                    self.i += 1
                    if self.K[self.i] == "::":
                        self.i += 1
                        self.generic_args()
                else:
                    self.fail("member expected")
            elif k == "(":
                self.listed(")")
            elif k == "[":
                self.listed("]")
            else:
                return

    def listed(self, close):
        free, self.no_struct = self.no_struct, False
        self.i += 1
        while self.K[self.i] != close:
            self.attributes()
            self.expression()
            if not self.maybe(","):
                break
        self.take(close)
        self.no_struct = free

    def condition(self):
        free, self.no_struct = self.no_struct, True
        while True:
            if self.maybe("let"):
                self.pattern()
                self.take("=")
                self.expression(4)
                if self.K[self.i] in ("&&", "||"):
                    self.branch()
                    self.i += 1
                    continue
                break
            self.expression(4)
            if self.K[self.i] in ("&&", "||"):
                self.branch()
                self.i += 1
                continue
            self.operators(0)
            break
        self.no_struct = free

    def block_expression(self):
        k = self.K[self.i]
        if k == "LIFE":
            self.i += 1
            self.take(":")
            k = self.K[self.i]
        if k == "{":
            self.block()
        elif k == "unsafe":
            self.i += 1
            self.block()
        elif k == "if":
            self.i += 1
            self.branch()
            self.condition()
            self.block()
            if self.maybe("else"):
                if self.K[self.i] == "if":
                    self.block_expression()
                else:
                    self.block()
        elif k == "while":
            self.i += 1
            self.branch()
            self.condition()
            self.block()
        elif k == "loop":
            self.i += 1
            self.block()
        elif k == "for":
            self.i += 1
            self.branch()
            self.pattern()
            self.take("in")
            free, self.no_struct = self.no_struct, True
            self.expression()
            self.no_struct = free
            self.block()
        elif k == "match":
            self.i += 1
            free, self.no_struct = self.no_struct, True
            self.expression()
            self.no_struct = False
            self.take("{")
            while self.K[self.i] == "#" and self.K[self.i + 1] == "!":
                self.attribute()
            while self.K[self.i] != "}":
                if self.K[self.i] == "EOF":
                    self.fail()
                self.arm()
            self.take("}")
            self.no_struct = free
        else:
            self.fail("block expected")

    def arm(self):
        self.attributes()
        a = self.i
        self.pattern()
        if self.src[self.S[a] : self.E[self.i - 1]] != "_":
            self.branch()
        if self.maybe("if"):
            self.condition()
            self.no_struct = False
        self.take("=>")
        block = self.K[self.i] == "{"
        if block:
            self.block()
            if self.K[self.i] in (".", "?"):
                self.suffixes()
                self.operators(0)
                block = False
        else:
            self.expression()
        if not self.maybe(",") and not block and self.K[self.i] != "}":
            self.fail(", expected")

    def primary(self, name=None):
        K = self.K
        k = K[self.i]
        if k in ("NUM", "STR", "true", "false"):
            self.i += 1
        elif k in ("ID", "self", "Self", "crate", "super", "::", "<"):
            if self.macro_ahead():
                self.macro()
                return
            if k == "ID" and self.text() == "builtin" and K[self.i + 1] == "#":
                self.fail()
            self.path()
            if K[self.i] == "{" and not self.no_struct:
                self.struct_literal()
        elif k == "(":
            free, self.no_struct = self.no_struct, False
            self.i += 1
            while K[self.i] != ")":
                self.attributes()
                self.expression(name=name)
                if not self.maybe(","):
                    break
            self.take(")")
            self.no_struct = free
        elif k == "[":
            free, self.no_struct = self.no_struct, False
            self.i += 1
            while K[self.i] != "]":
                self.expression()
                if not self.maybe(",") and not self.maybe(";"):
                    break
            self.take("]")
            self.no_struct = free
        elif k in _BLOCKLIKE:
            if k == "LIFE" and K[self.i + 1] != ":":
                self.fail()
            self.block_expression()
        elif k == "const" and K[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif k == "async" and K[self.i + 1] in ("{", "move") and (K[self.i + 1] == "{" or K[self.i + 2] == "{"):
            self.i += 1
            self.maybe("move")
            self.block()
        elif k in ("|", "||", "move", "static", "async"):
            self.closure(name)
        elif k in ("return", "break", "continue"):
            self.i += 1
            if k != "return":
                self.maybe("LIFE")
            if k != "continue" and self.starts():
                self.expression()
        elif k == "let":
            self.fail("let outside a condition")
        else:
            self.fail("expression expected")

    def closure(self, name):
        start = self.i
        while self.K[self.i] in ("static", "async", "move"):
            self.i += 1
        j = self.begin_callable("closure", name or self.scoped("<anonymous>"), self.S[start])
        if not self.maybe("||"):
            self.take("|")
            while self.K[self.i] != "|":
                self.attributes()
                self.pattern(False)
                if self.maybe(":"):
                    self.type_()
                if not self.maybe(","):
                    break
            self.take("|")
        if self.maybe("->"):
            self.type_()
            self.body_of(j)
            self.block()
        else:
            self.body_of(j)
            self.expression()
        self.end_callable(j)

    def struct_literal(self):
        self.take("{")
        while self.K[self.i] != "}":
            self.attributes()
            if self.maybe(".."):
                if self.K[self.i] != "}":
                    self.expression()
                break
            if self.K[self.i] not in ("ID", "NUM"):
                self.fail("field expected")
            self.i += 1
            if self.maybe(":"):
                self.expression()
            if not self.maybe(","):
                break
        self.take("}")
