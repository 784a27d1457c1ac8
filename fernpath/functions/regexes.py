"""Regular expressions of a linear-time dialect, restated for Java's engine, and the literal text that a match must hold.

The dialect has Unicode classes, `$` only at the very end, `.` for all but a line feed, and neither look-around nor
back-references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


class RegexError(ValueError):
    """A pattern outside the dialect."""


# The ASCII classes that have names.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


def _flags(text: str) -> tuple[set[str], set[str], str]:
    """Flags that `flags` or `flags:` after (? turns on and off, and what ends them."""
    k = min((x for x in (text.find(")"), text.find(":")) if x >= 0), default=-1)
    on, _, off = text[:k].partition("-") if k >= 0 else ("?", "", "")
    if not set(on + off) <= set("ims"):
        raise RegexError(f"Invalid regex: flags {text[:k]!r} are not supported")
    return set(on), set(off), text[k]


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Java's engine. Raises RegexError for what the dialect lacks."""
    made, k, in_class = [], 0, 0
    lines = [False]  # by open group: whether ^ and $ hold at every line
    while k < len(pattern):
        c, pair = pattern[k], pattern[k : k + 2]
        if c == "\\":
            if k + 1 == len(pattern):
                raise RegexError(f"Invalid regex: {pattern!r} ends with a backslash")
            if not in_class and (pair[1] in "123456789" or pair[1] in "kGZRXQE"):
                raise RegexError(f"Invalid regex: {pair} is not supported")
            made.append(pair)
            k += 2
            continue
        if in_class:
            if pair == "[:":
                end = pattern.find(":]", k)
                name = pattern[k + 2 : end]
                if end < 0 or name.lstrip("^") not in POSIX:
                    raise RegexError(f"Invalid regex: no class {pattern[k:k + 12]!r}")
                made.append(f"[{'^' * name.startswith('^')}{POSIX[name.lstrip('^')]}]")
                k = end + 2
                continue
            in_class += (c == "[") - (c == "]" and not (made[-1] == "[" or made[-2:] == ["[", "^"]))
        elif c == "[":
            in_class = 1
        elif c == "(":
            lines.append(lines[-1])
            if pattern[k + 1 : k + 2] == "?":
                if any(pattern.startswith(x, k + 2) for x in ("=", "!", "<=", "<!", ">")):
                    raise RegexError(f"Invalid regex: look-around at {k} in {pattern!r}")
                if pattern.startswith("P<", k + 2):
                    made.append("(?<")
                    k += 4
                    continue
                if not pattern.startswith("<", k + 2):
                    on, off, end = _flags(pattern[k + 2 :])
                    if end == ")":
                        lines.pop()  # holds for the rest of the group around it
                    lines[-1] = (lines[-1] or "m" in on) and "m" not in off
                    if end == ")":
                        close = pattern.index(")", k)
                        made.append(pattern[k : close + 1])
                        k = close + 1
                        continue
        elif c == ")" and len(lines) > 1:
            lines.pop()
        elif c == "+" and made and made[-1] in ("*", "+", "?", "}"):
            raise RegexError(f"Invalid regex: repeated quantifier at {k} in {pattern!r}")
        elif c == "$":
            c = "$" if lines[-1] else "\\z"
        made.append(c)
        k += 1
    return ("(?diuU)" if ignore_case else "(?dU)") + "".join(made)


def checked(spark: SparkSession, pattern: str, ignore_case: bool = False) -> str:
    """java() of a pattern that Java's engine accepts too, so that a bad one fails here and not in a task."""
    found = java(pattern, ignore_case)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(found)
    except Exception as e:
        raise RegexError(f"Invalid regex: {pattern!r}") from e
    return found


@dataclass(frozen=True)
class All:
    """Needs every part; without parts it needs nothing."""

    parts: tuple = ()


@dataclass(frozen=True)
class Any:
    """Needs one of its parts."""

    parts: tuple


ANYTHING = All()


def both(parts: list):
    flat = [q for p in parts for q in (p.parts if isinstance(p, All) else (p,))]
    return All(tuple(dict.fromkeys(flat)))


def either(parts: list):
    return ANYTHING if ANYTHING in parts or not parts else parts[0] if len(parts) == 1 else Any(tuple(parts))


class _Unknown(Exception):
    pass


class _Reader:
    """Reads a pattern into the literal strings that every match must contain. Whatever it does not know needs nothing."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def more(self) -> bool:
        return self.at < len(self.text)

    def alternatives(self):
        parts = [self.sequence()]
        while self.more() and self.text[self.at] == "|":
            self.at += 1
            parts.append(self.sequence())
        return either(parts)

    def quantifier(self) -> tuple[bool, bool]:
        """Whether one stands here, and whether it allows none at all."""
        if not self.more():
            return False, False
        c = self.text[self.at]
        if c in "?*+":
            self.at += 1
            none = c != "+"
        elif c == "{":
            end = self.text.find("}", self.at)
            body = self.text[self.at + 1 : end]
            if end < 0 or not body.split(",")[0].strip().isdigit():
                raise _Unknown
            self.at, none = end + 1, int(body.split(",")[0]) == 0
        else:
            return False, False
        if self.more() and self.text[self.at] == "?":
            self.at += 1
        return True, none

    def sequence(self):
        needs, run = [], []

        def flush():
            if run:
                needs.append("".join(run))
                run.clear()

        while self.more() and self.text[self.at] not in "|)":
            c = self.text[self.at]
            self.at += 1
            if c == "(":
                flush()
                if self.text.startswith("?", self.at):
                    for head in ("?:", "?P<", "?<", "?i:", "?i)"):
                        if self.text.startswith(head, self.at):
                            break
                    else:
                        raise _Unknown
                    if head == "?i)":
                        self.at += 3
                        continue
                    self.at = self.text.index(">", self.at) + 1 if head.endswith("<") else self.at + len(head)
                inner = self.alternatives()
                if not self.more():
                    raise _Unknown
                self.at += 1
                if not self.quantifier()[1]:
                    needs.append(inner)
            elif c == "[":
                flush()
                if self.text.startswith("^", self.at):
                    self.at += 1
                if self.text.startswith("]", self.at):
                    self.at += 1
                while self.more() and self.text[self.at] != "]":
                    if self.text[self.at] == "[":
                        raise _Unknown
                    self.at += 2 if self.text[self.at] == "\\" else 1
                self.at += 1
                self.quantifier()
            elif c in ".^$":
                flush()
                self.quantifier()
            else:
                if c == "\\":
                    c = self.text[self.at : self.at + 1]
                    self.at += 1
                    if c.isalnum():
                        if c not in "bBdDwWsSAz":
                            raise _Unknown
                        flush()
                        self.quantifier()
                        continue
                run.append(c)
                there, none = self.quantifier()
                if none:
                    run.pop()
                if there:
                    flush()
        flush()
        return both(needs)


def needed(pattern: str):
    """What text a match of the pattern must contain: strings under All and Any. All(()) where nothing can be said."""
    reader = _Reader(pattern)
    try:
        found = reader.alternatives()
        return found if not reader.more() else ANYTHING
    except (_Unknown, IndexError, ValueError):
        return ANYTHING
