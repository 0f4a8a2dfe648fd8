"""Regular expressions in the syntax without look-around, made fit for Java."""

from __future__ import annotations

import re
from dataclasses import dataclass

REFUSED = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]")
NAMED = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
# The bracket classes of POSIX and what Java calls them.
POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}
BRACKET = re.compile(r"\[:(\^?)([a-z]+):\]")


@dataclass(frozen=True)
class Rx:
    """A Java pattern, the numbers of its named groups, how many groups it has,
    and the same pattern without groups that capture."""

    java: str
    names: tuple[tuple[str, int], ...] = ()
    groups: int = 0
    bare: str = ""


def valid(java: str) -> bool:
    """Whether Java takes the pattern; asked of the driver's JVM if there is one."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None:
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import IllegalArgumentException

        try:
            context._jvm.java.util.regex.Pattern.compile(java)
            return True
        except (Py4JJavaError, IllegalArgumentException):
            return False
    try:
        import regex

        regex.compile(java.removeprefix("(?U)"))
    except ImportError:
        return True
    except regex.error:
        return False
    return True


def to_java(pattern: str, unicode: bool = True) -> Rx | None:
    """The pattern for Java, or None if it isn't valid: look-around and
    back-references don't exist in this syntax. Named groups become numbered
    ones, as Java allows no underscore in names; ``[[:alpha:]]`` and its like
    become Java's classes. ``unicode`` (the syntax's default) makes classes,
    word borders and letter case cover all scripts."""
    if REFUSED.search(re.sub(r"\\\\", "", pattern)):
        return None
    names: list[tuple[str, int]] = []
    out: list[str] = []
    bare: list[str] = []
    i, group, in_class = 0, 0, False

    def put(text: str, plain: str | None = None) -> None:
        out.append(text)
        bare.append(text if plain is None else plain)

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            put(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            m = BRACKET.match(pattern, i)
            if m:
                if m[2] not in POSIX:
                    return None
                put(f"\\{'P' if m[1] else 'p'}{{{POSIX[m[2]]}}}")
                i = m.end()
                continue
            if c == "[":
                c = "\\["
            elif c == "]":
                in_class = out[-1] in ("[", "[^")
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                put("[^")
                i += 2
                continue
        elif c == "(":
            m = NAMED.match(pattern, i)
            if m:
                group += 1
                names.append((m[1], group))
                put("(", "(?:")
                i = m.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                group += 1
                put("(", "(?:")
                i += 1
                continue
        put(c)
        i += 1
    flag = "(?U)" if unicode else ""
    java = flag + "".join(out)
    return Rx(java, tuple(names), group, flag + "".join(bare)) if valid(java) else None


def quote(text: str) -> str:
    """A Java pattern that matches ``text`` itself."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", text)
