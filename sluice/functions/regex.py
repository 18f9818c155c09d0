"""Patterns of a linear-time, Unicode-aware dialect, given to Java's engine.

Differences that are evened out: ``\\w \\d \\s \\b`` are Unicode; ``$`` without flags is the very end of
the text and not the place before a last newline; ``.`` leaves out ``\\n`` alone. Look-around and
back-references do not exist in the dialect and are refused when the pattern is given.
"""

from __future__ import annotations

import re


class PatternError(ValueError):
    """The pattern is not one of the dialect."""


def to_java(pattern: str) -> str:
    """The same pattern for Java; raises PatternError at once if it is none."""
    out, at, depth = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if at + 1 == len(pattern):
                raise PatternError("a pattern cannot end in a backslash")
            nxt = pattern[at + 1]
            if depth == 0 and (nxt.isdigit() and nxt != "0" or nxt == "k"):
                raise PatternError("back-references are not supported")
            if nxt in "GZXQE":
                raise PatternError(f"unknown escape \\{nxt}")
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif depth == 0:
            if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), at):
                raise PatternError("look-around and atomic groups are not supported")
            if pattern.startswith("(?P<", at):
                out.append("(?<")
                at += 4
                continue
            if c in "*+?}" and pattern[at + 1 : at + 2] == "+":
                raise PatternError("possessive repeats are not supported")
            if c == "$" and not re.search(r"\(\?[a-zA-Z]*m", pattern):
                out.append(r"\z")
                at += 1
                continue
        out.append(c)
        at += 1
    java = "(?Ud)" + "".join(out)
    _verify(java)
    return java


def _verify(java: str) -> None:
    """Refuses what is no pattern at all, with the JVM's own compiler where one runs."""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm if SparkContext._active_spark_context else None
    if jvm is None:
        try:
            re.compile(re.sub(r"\\[pP](\{[^}]*\}|.)", "x", java[5:]).replace("(?<", "(?P<").replace(r"\z", r"\Z"))
        except re.error as e:
            raise PatternError(str(e)) from e
        return
    try:
        jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise PatternError(str(e).splitlines()[0]) from e
