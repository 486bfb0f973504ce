"""What the four parsers share: faults, recovery, token cursors and the facts they gather."""

from __future__ import annotations

import bisect
import sys
from dataclasses import dataclass, field

#: Frames of the recursive descent, which live on the heap. A level of brackets takes at most ten, so that sources nested
#: 5 000 deep are read; deeper ones, beyond what compilers of these languages take, are an error of the file (too-deep).
_RECURSION = 60_000


class Fault(Exception):
    """A syntax error at an offset."""

    def __init__(self, code: str, at: int, what: str = ""):
        self.code, self.at, self.what = code, at, what


@dataclass
class File:
    """Errors are (code, line, byte column, message); facts are lists of dicts in document order."""

    errors: list[tuple] = field(default_factory=list)
    callables: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    modules: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)


class Lines:
    """Offsets of a decoded text as 1-based lines and UTF-8 byte columns."""

    def __init__(self, src: str):
        self.src = src
        self.starts = [0]
        at = src.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = src.find("\n", at + 1)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset)
        return line, len(self.src[self.starts[line - 1] : offset].encode("utf-8", "surrogatepass")) + 1


def run(parser, source: bytes, ext: str, facts: bool = True) -> File:
    """Decodes, parses and locates the errors and, if asked for, the facts. A leading byte order mark is allowed; other bytes must be UTF-8."""
    out = File()
    if source[:3] == b"\xef\xbb\xbf":
        source = source[3:]
    try:
        src = source.decode("utf-8")
    except UnicodeDecodeError as e:
        src = source.decode("utf-8", "replace")
        out.errors.append(("bad-encoding", 1, e.start + 1, "not UTF-8"))
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(_RECURSION)
    p = None
    faults: list[Fault] = []
    try:
        p = parser(src, ext)
        p.file()
        faults = p.faults
    except Fault as f:
        faults = (p.faults if p else []) + [f]
    except RecursionError:
        faults = (p.faults if p else []) + [Fault("too-deep", 0, "nesting too deep")]
    finally:
        sys.setrecursionlimit(limit)
    lines = Lines(src) if faults or facts else None
    for f in faults:
        line, col = lines.at(min(f.at, len(src)))
        out.errors.append((f.code, line, col, f.what))
    if p is not None and facts:
        out.callables, out.types, out.modules, out.references, out.calls = p.callables, p.types, p.modules, p.references, p.calls
        for fact in (*out.callables, *out.types, *out.references, *out.calls):
            fact["start_line"], fact["start_column"] = lines.at(fact["start"])
            fact["end_line"], fact["end_column"] = lines.at(fact["end"])
        for fact in out.callables:
            line, col = lines.at(fact["start"])
            fact["name"] = fact["name"].replace("<anonymous>", f"<anonymous@{line}:{col}>")
            fact["signature"] = " ".join(src[fact["start"] : fact.get("body", fact["end"])].split())
        for fact in (*out.callables, *out.types):
            fact["start_byte"] = len(src[: fact["start"]].encode("utf-8", "surrogatepass"))
            fact["end_byte"] = fact["start_byte"] + len(src[fact["start"] : fact["end"]].encode("utf-8", "surrogatepass"))
    return out


class Cursor:
    """A parser over a list of tokens: K kinds, S starts, E ends. Kinds of names, numbers and texts are 'ID', 'NUM'
    and 'STR'; any other token's kind is its text; the last is 'EOF'."""

    OPEN = {"(": ")", "[": "]", "{": "}"}
    CLOSE = frozenset(")]}")

    def __init__(self, src: str, ext: str):
        self.src, self.ext = src, ext
        self.i = 0
        self.faults: list[Fault] = []
        self.callables: list[dict] = []
        self.types: list[dict] = []
        self.modules: list[dict] = []
        self.references: list[dict] = []
        self.calls: list[dict] = []
        self.open: list[tuple[str, int]] = []  # enclosing declarations: (callable or type, index)
        self.cx = [0]
        self.depth = 0

    # Cursor.
    def text(self, i: int | None = None) -> str:
        i = self.i if i is None else i
        return self.src[self.S[i] : self.E[i]]

    def fail(self, what: str = "", i: int | None = None):
        i = self.i if i is None else i
        k = self.K[i]
        raise Fault("unexpected-end" if k == "EOF" else "unexpected-token", self.S[i], what or f"unexpected {k}")

    def take(self, kind: str) -> int:
        i = self.i
        if self.K[i] != kind:
            self.fail(f"{kind} expected, {self.K[i]} found")
        self.i = i + 1
        return i

    def maybe(self, kind: str) -> bool:
        if self.K[self.i] == kind:
            self.i += 1
            return True
        return False

    # Trying one reading and going back.
    def mark(self):
        return self.i, len(self.callables), len(self.types), len(self.references), len(self.open), list(self.cx), self.depth, len(self.faults), len(self.calls)

    def back(self, m) -> None:
        self.i, a, b, c, d, self.cx, self.depth, e, f = m
        del self.callables[a:], self.types[b:], self.references[c:], self.open[d:], self.faults[e:], self.calls[f:]

    def attempt(self, f, *args):
        """f's result, or None and back where it was if f meets a fault."""
        m = self.mark()
        try:
            r = f(*args)
        except Fault:
            self.back(m)
            return None
        if len(self.faults) > m[7]:
            self.back(m)
            return None
        return True if r is None else r

    # Facts.
    def branch(self) -> None:
        self.cx[-1] += 1

    def begin_callable(self, kind: str, name: str, start: int) -> int:
        owner = next(((k, j) for k, j in reversed(self.open)), ("file", 0))
        self.callables.append({"kind": kind, "name": name, "start": start, "end": start, "depth": self.depth, "parent_kind": owner[0], "parent_index": owner[1]})
        self.open.append(("callable", len(self.callables) - 1))
        self.cx.append(1)
        self.depth += 1
        return len(self.callables) - 1

    def end_callable(self, j: int) -> None:
        c = self.callables[j]
        c["end"], c["complexity"] = self.E[self.i - 1], self.cx.pop()
        self.open.pop()
        self.depth -= 1

    def body_of(self, j: int) -> None:
        self.callables[j]["body"] = self.S[self.i]

    def begin_type(self, kind: str, name: str, start: int) -> int:
        owner = next(((k, j) for k, j in reversed(self.open)), ("file", 0))
        self.types.append({"kind": kind, "name": name, "start": start, "end": start, "parent_kind": owner[0], "parent_index": owner[1]})
        self.open.append(("type", len(self.types) - 1))
        return len(self.types) - 1

    def end_type(self, j: int) -> None:
        self.types[j]["end"] = self.E[self.i - 1]
        self.open.pop()

    # Panic mode.
    def recover(self, f: Fault, start: int, stops: frozenset = frozenset()) -> None:
        """Notes the fault and goes on after the next ';' or before the end of the block, outside any brackets."""
        self.faults.append(f)
        depth, K = 0, self.K
        if self.i == start and K[start] != "EOF" and K[start] != "}":
            self.i += 1
        while True:
            k = K[self.i]
            if k == "EOF":
                return
            if depth == 0:
                if k == ";":
                    self.i += 1
                    return
                if k == "}" or k in stops:
                    return
            if k in self.OPEN:
                depth += 1
            elif k in self.CLOSE:
                depth = max(0, depth - 1)
            self.i += 1

    def guarded(self, f, *args, stops: frozenset = frozenset()) -> None:
        """Parses one statement or declaration; a fault in it is noted and skipped."""
        start, m = self.i, (len(self.open), len(self.cx), self.depth)
        try:
            f(*args)
        except Fault as e:
            for kind, j in reversed(self.open[m[0] :]):
                fact = self.callables[j] if kind == "callable" else self.types[j]
                fact["end"] = max(fact["end"], self.E[self.i - 1] if self.i else fact["start"])
                if kind == "callable":
                    fact["complexity"] = self.cx.pop()
            del self.open[m[0] :], self.cx[m[1] :]
            self.depth = m[2]
            self.recover(e, start, stops)

    def top_level(self, f, stops: frozenset = frozenset()) -> None:
        """Declarations up to the end of the file; a closing bracket that nothing opened is an error each."""
        while self.K[self.i] != "EOF":
            if self.K[self.i] == "}":
                self.faults.append(Fault("unexpected-token", self.S[self.i], "unexpected }"))
                self.i += 1
            else:
                self.guarded(f, stops=stops)
