"""Hand-written parsers for Go, C#, Rust and TypeScript: recursive-descent statements and declarations,
precedence-climbing expressions, panic-mode recovery. They report every syntax error and, on the way, the
callables, types, modules and references of a file."""

from __future__ import annotations

#: File extension and language.
LANGUAGES = {"go": "go", "cs": "csharp", "rs": "rust", "ts": "typescript", "tsx": "typescript"}


_PARSERS: dict = {}


def extension(path: str | None) -> str | None:
    """The path's extension in lower case if it names a supported language."""
    ext = (path or "").rpartition(".")[2].lower()
    return ext if ext in LANGUAGES and "." in (path or "") else None


def parse(source: bytes, ext: str, facts: bool = True):
    """The parsed file: a base.File with errors (none if the syntax is right) and, if asked for, facts."""
    from riskframe.syntax import base

    if ext not in _PARSERS:
        module = {"go": "golang", "cs": "csharp", "rs": "rust", "ts": "typescript", "tsx": "typescript"}[ext]
        _PARSERS[ext] = __import__(f"riskframe.syntax.{module}", fromlist=["parser"]).parser
    parser = _PARSERS[ext]
    return base.run(parser, source, ext, facts)
