"""Which paths the ignore files of their folders leave out."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

#: Rules of one ignore file, first to last: pattern over the path below the file's folder, whether it keeps, whether for folders only.
Rules = list[tuple[re.Pattern, bool, bool]]


def _glob(body: str) -> str:
    """Regular expression of a glob in which `*` and `?` stop at slashes and `**` spans folders."""
    made, k = "", 0
    while k < len(body):
        c = body[k]
        if body.startswith("**/", k) and (k == 0 or body[k - 1] == "/"):
            made, k = made + "(?:.*/)?", k + 3
            continue
        if body[k:] == "**" and k and body[k - 1] == "/":
            return made + ".+"
        if c == "*":
            made += "[^/]*"
            while body[k + 1 : k + 2] == "*":
                k += 1
        elif c == "?":
            made += "[^/]"
        elif c == "[" and (end := body.find("]", k + 2)) > 0:
            inner = body[k + 1 : end].replace("\\", "\\\\")
            made += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            k = end
        elif c == "\\" and k + 1 < len(body):
            k += 1
            made += re.escape(body[k])
        else:
            made += re.escape(c)
        k += 1
    return made


def parsed(text: str) -> Rules:
    """The rules of an ignore file's text. Lines that are no valid pattern are passed over."""
    found: Rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        folders, line = line.endswith("/"), line.rstrip("/")
        fixed = "/" in line  # a slash within ties the pattern to the file's own folder
        try:
            found.append((re.compile(("" if fixed else "(?:.*/)?") + _glob(line.lstrip("/")), re.DOTALL), keeps, folders))
        except re.error:
            continue
    return found


def _read(path: str) -> Rules:
    try:
        with open(path, encoding="utf-8", errors="replace") as file:
            return parsed(file.read())
    except OSError:
        return []


def _verdict(rules: Rules, path: str, is_folder: bool) -> bool | None:
    """Whether the last rule that matches ignores the path; None if none does."""
    for pattern, keeps, folders in reversed(rules):
        if (is_folder or not folders) and pattern.fullmatch(path):
            return not keeps
    return None


@dataclass(frozen=True)
class Level:
    """The ignore files that hold in a folder: those of the folder itself and of the folders above it."""

    folder: str
    above: Level | None
    plain: tuple
    git: tuple
    in_git: bool
    top: bool  # the folder begins a repository: rules for git from above it do not hold

    @classmethod
    def of(cls, folder: str, above: Level | None) -> Level:
        top = os.path.exists(os.path.join(folder, ".git"))
        in_git = top or bool(above and above.in_git)
        git = _read(os.path.join(folder, ".gitignore")) if in_git else []
        git = (_read(os.path.join(folder, ".git/info/exclude")) if top else []) + git
        return cls(folder, above, tuple(_read(os.path.join(folder, ".ignore"))), tuple(git), in_git, top)

    @classmethod
    def down_to(cls, folder: str) -> Level:
        """The level of a folder, from the root of the file system down."""
        parent = os.path.dirname(folder)
        return cls.of(folder, cls.down_to(parent) if parent != folder else None)

    def ignores(self, path: str, is_folder: bool) -> bool:
        """Whether a path in this folder is left out. `.ignore` goes before `.gitignore`, deeper files before those above."""
        for kind in ("plain", "git"):
            at = self
            while at is not None:
                found = _verdict(getattr(at, kind), os.path.relpath(path, at.folder), is_folder) if getattr(at, kind) else None
                if found is not None:
                    return found
                at = None if kind == "git" and at.top else at.above
        return False
