"""What a working tree's history says about it, read from its files alone."""

from __future__ import annotations

import hashlib
import os
import re

_OID = re.compile(r"[0-9a-f]{40}(?:[0-9a-f]{24})?")


def _text(*path: str) -> str | None:
    try:
        with open(os.path.join(*path), encoding="utf-8", errors="replace") as f:
            return f.read().strip()
    except OSError:
        return None


def folders(root: str) -> tuple[str, str] | None:
    """The folder of a tree's history, and the one that it shares with other trees; None without a history."""
    own = os.path.join(root, ".git")
    if os.path.isfile(own):  # a linked tree or a submodule names its folder in a file
        named = _text(own) or ""
        own = os.path.normpath(os.path.join(root, named.removeprefix("gitdir:").strip()))
    if not os.path.isdir(own):
        return None
    common = _text(own, "commondir")
    return own, os.path.normpath(os.path.join(own, common)) if common else own


def _named(own: str, common: str, ref: str) -> str | None:
    """The commit that a ref names: its own file, or a line of the packed ones."""
    for folder in dict.fromkeys((own, common)):
        found = _text(folder, ref)
        if found and _OID.fullmatch(found):
            return found
    for folder in dict.fromkeys((own, common)):
        for line in (_text(folder, "packed-refs") or "").splitlines():
            oid, _, name = line.strip().partition(" ")
            if name.strip() == ref and _OID.fullmatch(oid):
                return oid
    return None


def fingerprint(root: str, scope_key: str = "") -> dict[str, str | None]:
    """``root_path, branch, head, index_sha, scope_key`` of a tree, as ``store.workspace_status`` takes them.

    ``head`` is null if it cannot be told, ``branch`` if no branch is checked out,
    ``index_sha`` (of the staging file's bytes) if nothing was ever staged.
    """
    out: dict[str, str | None] = {"root_path": os.path.realpath(root), "branch": None, "head": None, "index_sha": None, "scope_key": scope_key}
    found = folders(root)
    if found is None:
        return out
    own, common = found
    head = _text(own, "HEAD") or ""
    if _OID.fullmatch(head):
        out["head"] = head
    elif head.startswith("ref:"):
        ref = head.removeprefix("ref:").strip()
        out["branch"], out["head"] = ref.removeprefix("refs/heads/"), _named(own, common, ref)
    try:
        with open(os.path.join(own, "index"), "rb") as f:
            out["index_sha"] = hashlib.sha256(f.read()).hexdigest()
    except OSError:
        pass
    return out
