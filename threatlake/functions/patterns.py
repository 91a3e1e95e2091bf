"""Regular expressions written for other dialects, restated for Spark's Java engine."""

from __future__ import annotations

try:
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_parse as _parser

_JS_SPACE = r"\t\n\x0B\f\r    -     　﻿"
_ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def from_ecmascript(pattern: str, ignore_case: bool = True) -> str:
    """ASCII word edges, Unicode white space, and a dot that stops at every line terminator."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(_JS_SPACE if in_class else f"[{_JS_SPACE}]")
            i += 2
        elif pair == r"\S":
            out.append(f"[^{_JS_SPACE}]")
            i += 2
        elif pair == r"\b" and not in_class:
            out.append(_ASCII_EDGE)
            i += 2
        elif ch == "\\":
            out.append(pair)
            i += 2
        elif ch == "[" and in_class:
            out.append(r"\[")
            i += 1
        elif ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
            i += 1
        elif ch == "&" and in_class:
            out.append(r"\&")
            i += 1
        elif ch == "." and not in_class:
            out.append(r"[^\n\r  ]")
            i += 1
        elif ch == "$" and not in_class:
            out.append(r"\z")
            i += 1
        else:
            out.append(ch)
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def from_python(pattern: str) -> str:
    """Case-insensitive, Unicode-aware classes and word edges; ``$`` also before a final newline."""
    return "(?iU)" + pattern


def required_literals(pattern: str, most: int = 64) -> list[set[str]]:
    """Literal sets of which every match must contain one member each, in lower case.

    Testing a text for these plain substrings first is far cheaper than searching the expression,
    and cannot lose a match. An empty list means that nothing can be required.
    """
    tree = _parser.parse(pattern.lower())

    def best(groups: list[set[str]]) -> set[str] | None:
        return max(groups, key=lambda g: min(map(len, g)), default=None)

    def walk(items) -> tuple[set[str] | None, list[set[str]]]:
        """(all exact texts, or None) and the required sets of a sequence."""
        run, groups, exact = {""}, [], True

        def flush() -> None:
            nonlocal run
            if all(run):
                groups.append(run)
            run = {""}

        def extend(texts: set[str] | None, inner: list[set[str]]) -> None:
            nonlocal run, exact
            if texts is not None and len(texts) * len(run) <= most:
                run = {a + b for a in run for b in texts}
                return
            exact = False
            flush()
            groups.extend(inner if texts is None else [texts] if all(texts) else [])

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                extend({chr(arg)}, [])
            elif name == "SUBPATTERN":
                extend(*walk(arg[-1]))
            elif name == "BRANCH":
                parts = [walk(branch) for branch in arg[1]]
                if all(p[0] is not None for p in parts):
                    extend(set().union(*(p[0] for p in parts)), [])
                else:
                    picks = [p[0] if p[0] and all(p[0]) else best(p[1]) for p in parts]
                    extend(None, [set().union(*picks)] if all(picks) else [])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = arg
                texts, inner = walk(body)
                if (low, high) == (0, 1) and texts is not None:
                    extend(texts | {""}, [])
                elif low >= 1:
                    extend(None, inner if texts is None else [texts] if all(texts) else [])
                else:
                    extend(None, [])
            elif name == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" for o, _ in arg):
                extend({chr(c) for _, c in arg}, [])
            elif name != "AT":
                extend(None, [])
        final = run if exact else None
        flush()
        return final, groups

    return [g for g in walk(tree)[1] if g]
