"""The registry of repos, scopes, and the discovery of repos on disk."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath


class ScopeError(ValueError):
    """A scope that names nothing: queries fail rather than widen."""


@dataclass(frozen=True)
class Repo:
    repo_id: str
    root: str
    collection_path: str = ""
    enabled: bool = True


@dataclass
class Registry:
    repos: list[Repo] = field(default_factory=list)
    external_roots: list[str] = field(default_factory=list)

    def enabled(self) -> list[str]:
        return sorted(r.repo_id for r in self.repos if r.enabled)

    def root(self, repo_id: str) -> str | None:
        return next((r.root for r in self.repos if r.repo_id == repo_id), None)

    def digest(self) -> str:
        rows = sorted((r.repo_id, r.root, r.collection_path, r.enabled) for r in self.repos)
        return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def parse(data: object, strict: bool = True) -> Registry:
    """A registry from JSON. Strict: a bad row is an error that names it; else it is left out. Two rows of one id are an error when strict, the first counts otherwise."""
    if not isinstance(data, dict) or not isinstance(data.get("repos"), list):
        if strict:
            raise ValueError("a registry is an object with a list of repos")
        return Registry()
    off = {x for x in data.get("disabled") or [] if isinstance(x, str)}
    out: dict[str, Repo] = {}
    for i, r in enumerate(data["repos"]):
        bad = next((k for k in ("repo_id", "root") if not isinstance(r, dict) or not isinstance(r.get(k), str) or not r[k].strip()), None)
        bad = bad or ("enabled" if not isinstance(r.get("enabled", True), bool) else None)
        if bad or r["repo_id"] in out:
            if strict:
                raise ValueError(f"repos[{i}].{bad}: not valid" if bad else f"repos[{i}].repo_id: {r['repo_id']} is there twice")
            continue
        out[r["repo_id"]] = Repo(r["repo_id"], r["root"], r.get("collection_path") or "", r.get("enabled", True) and r["repo_id"] not in off)
    return Registry(list(out.values()), [x for x in data.get("external_roots") or [] if isinstance(x, str)])


def load(path: str, strict: bool = True) -> Registry:
    try:
        return parse(json.loads(Path(path).read_text(encoding="utf-8")), strict)
    except (OSError, ValueError):
        if strict:
            raise
        return Registry()


def match_cwd(reg: Registry, cwd: str) -> str | None:
    """The repo with the longest root that the folder is in; of equal roots the least id."""
    here = PurePosixPath(os.path.normpath(cwd))
    found = [(-len(PurePosixPath(r.root).parts), r.repo_id) for r in reg.repos if r.enabled and here.is_relative_to(PurePosixPath(os.path.normpath(r.root)))]
    return min(found)[1] if found else None


def resolve_scope(reg: Registry, scope: str, cwd: str | None = None) -> list[str]:
    """Repos of a scope: 'current', 'all' or 'repo:<id>'. What cannot be resolved is an error, never everything."""
    ids = reg.enabled()
    if not ids:
        raise ScopeError("no repo is registered")
    if scope == "all":
        return ids
    if scope == "current":
        found = match_cwd(reg, cwd) if cwd else None
        if not found:
            raise ScopeError(f"no registered repo holds {cwd}; use all or repo:<id> with one of {', '.join(ids[:10])}")
        return [found]
    if scope.startswith("repo:") and scope[5:] in ids:
        return [scope[5:]]
    raise ScopeError(f"{scope} names no enabled repo")


def resolve_repos(reg: Registry, repos: list[str] | None, exclude: list[str] | None) -> list[str]:
    ids = reg.enabled()
    unknown = sorted(set(repos or []) - set(ids))
    if unknown:
        raise ScopeError(f"not registered or not enabled: {', '.join(unknown)}")
    left = sorted(set(repos or ids) - set(exclude or []))
    if not left:
        raise ScopeError("no repo is left")
    return left


@dataclass(frozen=True)
class Link:
    """A folder that holds the marker, and where that leads: to itself, or as a link elsewhere; nowhere if broken."""

    root: str
    target: str | None
    rejected: bool = False


def _under(path: str, roots: list[str]) -> bool:
    return any((path + os.sep).startswith(r.rstrip(os.sep) + os.sep) for r in roots)


def discover(roots: list[str], marker: str = ".git", depth: int = 4, approved: list[str] | None = None) -> tuple[list[Link], list[tuple[str, str]]]:
    """Folders up to depth below the roots that hold the marker, and (path, error) of those that could not be read.

    Links out of a root are not followed. A marker that leads out of the approved roots (by default the roots
    themselves) is rejected.
    """
    if not 1 <= depth <= 8:
        raise ValueError("depth is 1 to 8")
    found: dict[str, Link] = {}
    errors, tops = [], [os.path.realpath(r) for r in roots]
    allowed = tops if approved is None else [os.path.realpath(r) for r in approved]
    todo = [(top, top, 0) for top in tops]
    while todo:
        top, at, d = todo.pop()
        try:
            names = sorted(os.listdir(at))
        except OSError as e:
            errors.append((at, type(e).__name__))
            continue
        if marker in names:
            mark = os.path.join(at, marker)
            target = (os.path.realpath(mark) if os.path.islink(mark) else at) if os.path.exists(mark) else None
            found[at] = Link(at, target, target is not None and not _under(target, allowed))
        for n in names if d < depth else ():
            real = os.path.realpath(os.path.join(at, n))
            if not n.startswith(".") and n != marker and os.path.isdir(real) and _under(real, [top]):
                todo.append((top, real, d + 1))
    return [found[k] for k in sorted(found)], errors


def reconcile(reg: Registry, links: list[Link], errors: list[tuple[str, str]], graph_file: str = "graph.json") -> dict[str, list]:
    """What discovery says of each enabled repo, and of what is not registered.

    registered: a link leads to its collection from its root, or a failed scan may hide one. renamed: (id, old root, new
    root) where one leads there from elsewhere. broken: its root's link leads nowhere. missing: its collection is gone.
    removed: none leads there, and the scan would have seen it. auto_add: its collection holds no graph yet. duplicates:
    ids that share a collection. unregistered: roots that lead elsewhere. rejected: roots that lead out of bounds.
    """
    out: dict[str, list] = {k: [] for k in ("registered", "renamed", "broken", "missing", "removed", "auto_add", "duplicates", "unregistered", "rejected")}
    out["rejected"] = [x.root for x in links if x.rejected]
    good = [x for x in links if not x.rejected]
    leads: dict[str, list[str]] = {}
    for x in good:
        if x.target is not None:
            leads.setdefault(x.target, []).append(x.root)
    broken, failed = {x.root for x in good if x.target is None}, [os.path.realpath(p) for p, _ in errors]
    home = {r.repo_id: os.path.realpath(r.collection_path or r.root) for r in reg.repos}
    for r in sorted(reg.repos, key=lambda r: r.repo_id):
        if not r.enabled:
            continue
        root, at = os.path.realpath(r.root), home[r.repo_id]
        there, came = os.path.exists(at), sorted(leads.get(at, []))
        if came:
            state, entry = ("registered", r.repo_id) if root in came else ("renamed", (r.repo_id, root, came[0]))
        elif root in broken:
            state, entry = "broken", r.repo_id
        elif not there:
            state, entry = "missing", r.repo_id
        else:
            state, entry = ("registered" if _under(root, failed) else "removed"), r.repo_id
        out[state].append(entry)
        if there and not os.path.exists(os.path.join(at, graph_file)):
            out["auto_add"].append(r.repo_id)
    shared = list(home.values())
    out["duplicates"] = sorted(i for i, p in home.items() if shared.count(p) > 1)
    out["unregistered"] = sorted(root for target, roots in leads.items() if target not in set(shared) for root in roots)
    return out
