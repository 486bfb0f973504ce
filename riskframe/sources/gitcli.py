"""A thin driver-side helper that runs git; the texts and rows it returns feed the readers."""

from __future__ import annotations

import os
import subprocess

PATHS, BYTES = 128, 12_288  # pathspecs and their bytes per call


def run(root: str, *args: str) -> bytes:
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if out.returncode:
        raise RuntimeError(f"git {args[0]}: {out.stderr.decode(errors='replace').strip()}")
    return out.stdout


def batches(paths: list[str]) -> list[list[str]]:
    """Paths in groups that fit one call."""
    out: list[list[str]] = []
    size = 0
    for p in paths:
        n = len(p.encode()) + 1
        if not out or len(out[-1]) >= PATHS or size + n > BYTES:
            out.append([])
            size = 0
        out[-1].append(p)
        size += n
    return out


def merge_base(root: str, base: str) -> tuple[str, str]:
    """(merge base of base and HEAD, HEAD)."""
    commit = run(root, "rev-parse", "--verify", base + "^{commit}").decode().strip()
    head = run(root, "rev-parse", "HEAD").decode().strip()
    return run(root, "merge-base", commit, head).decode().strip(), head


def diffs(root: str, commit: str, paths: list[str]) -> list[str]:
    """Diff texts without context from a commit to the working tree, one per group of paths."""
    return [run(root, "diff", "--unified=0", "--no-renames", "--no-color", "--no-ext-diff", commit, "--", *g).decode("utf-8", "replace") for g in batches(sorted(set(paths)))]


def untracked(root: str, paths: list[str]) -> list[tuple[str, str]]:
    """(path, text) of untracked source files below the paths."""
    out = []
    for g in batches(sorted(set(paths))):
        for p in run(root, "ls-files", "--others", "--exclude-standard", "-z", "--", *g).decode("utf-8", "replace").split("\0"):
            if p.lower().endswith((".cs", ".go", ".rs", ".ts", ".tsx")) and not os.path.islink(os.path.join(root, p)):
                with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                    out.append((p, f.read()))
    return out


def tree(root: str, commit: str) -> list[tuple[str, str, str]]:
    """(path, mode, object) of a commit's entries."""
    out = []
    for line in run(root, "ls-tree", "-r", "-z", "--full-tree", commit).decode("utf-8", "replace").split("\0"):
        if line:
            head, _, path = line.partition("\t")
            mode, _, oid = head.split(" ")
            out.append((path, mode, oid))
    return out


def blob_table(spark, scratch, root: str, entries: list[tuple[str, str, str]]):
    """path and content of a commit's entries as a table, read and written in groups of at most PATHS objects, so that the
    driver holds one group at a time."""
    parts = None
    for at in range(0, len(entries), PATHS):
        group = entries[at : at + PATHS]
        held = blobs(root, [oid for _, _, oid in group])
        part = scratch.cut(spark.createDataFrame([(p, bytearray(held[oid])) for p, _, oid in group], "path string, content binary"))
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else spark.createDataFrame([], "path string, content binary")


def blobs(root: str, objects: list[str]) -> dict[str, bytes]:
    """Contents of objects."""
    if not objects:
        return {}
    data = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input="\n".join(objects).encode() + b"\n", capture_output=True, check=True).stdout
    out, at = {}, 0
    for oid in objects:
        end = data.index(b"\n", at)
        size = int(data[at:end].split()[2])
        out[oid] = data[end + 1 : end + 1 + size]
        at = end + 2 + size
    return out
