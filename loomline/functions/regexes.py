"""Regular expressions in RE2's dialect, for the JVM and for Python."""

from __future__ import annotations

import re
from dataclasses import dataclass

# The members of RE2's \s, and of its POSIX classes, inside brackets.
_SPACE = r"\t\n\f\r "
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_REFUSED = (r"\(\?<?[=!]", "look-around"), (r"\\[1-9]", "back-references"), (r"\(\?>", "atomic groups"), (r"[*+?}]\+", "possessive repetition"), (r"\(\?[a-zA-Z]*U", "the flag U"), (r"\\[ZGRXhHkKN]", "this escape")


@dataclass(frozen=True)
class Pattern:
    """One pattern: as given, for Java, and for Python's ``regex``; ``literal``: it has no special characters."""

    source: str
    java: str
    python: str
    literal: bool
    #: It neither looks at its place nor matches nothing, so that splitting by it needs no loop.
    plain: bool


def _pieces(source: str):
    """Quoted text, escapes, POSIX classes and single characters, each with whether it stands in brackets."""
    i, inside = 0, False
    while i < len(source):
        if source.startswith(r"\Q", i):
            end = source.find(r"\E", i)
            end = len(source) if end < 0 else end
            yield "quoted", source[i + 2 : end], inside
            i = end + 2
            continue
        posix = re.match(r"\[:(\^?)(\w+):\]", source[i:]) if inside else None
        if posix:
            yield "posix", posix[1] + posix[2], inside
            i += posix.end()
            continue
        if source[i] == "\\":
            long = re.match(r"\\(?:[pP]\{\^?\w+\}|x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|.)", source[i:], re.S)
            if not long:
                raise ValueError(f"a pattern ends in a backslash: {source}")
            yield "escape", long[0], inside
            i += long.end()
            continue
        c = source[i]
        if not inside and c == "[":
            head = re.match(r"\[\^?\]?", source[i:])[0]
            yield "open", head, inside
            inside = True
            i += len(head)
            continue
        if inside and c == "]":
            inside = False
        yield "char", c, inside
        i += 1


def compile_pattern(source: str) -> Pattern:
    """Raises ValueError for what RE2 refuses."""
    bare = re.sub(r"\\Q.*?(\\E|$)|\\\\|\[[^\]]*\]", "", source, flags=re.S)
    for bad, name in _REFUSED:
        if re.search(bad, bare):
            raise ValueError(f"{name} can't be used: {source}")
    literal = bool(source) and not re.search(r"[\\.+*?()|\[\]{}^$]", source)
    many, looks, java, python = bool(re.search(r"\(\?[a-z]*m", bare)), False, [], []
    for kind, text, inside in _pieces(source):
        j = p = text
        if kind == "quoted":
            j, p = ("".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in text),) * 2
        elif kind == "posix":
            name = text.lstrip("^")
            if name not in _POSIX:
                raise ValueError(f"no such class: [:{text}:]")
            j = f"[^{_POSIX[name]}]" if text[0] == "^" else _POSIX[name]
            p = f"\\P{{posix_{name}}}" if text[0] == "^" else _POSIX[name]
        elif kind == "escape":
            if text in (r"\s", r"\S"):
                own = _SPACE if text == r"\s" else f"^{_SPACE}"
                j = own if inside and text == r"\s" else f"[{own}]"
                p = own if inside and text == r"\s" else r"\S" if inside else f"[{own}]"
            elif text == r"\z":
                p, looks = r"\Z", True
            elif text == r"\C":
                raise ValueError("single bytes can't be matched")
            elif text in (r"\A", r"\b", r"\B"):
                looks = True
        elif kind == "char" and not inside and text in "^$":
            looks = True
            if text == "$" and not many:
                j, p = r"\z", r"\Z"
        elif kind == "char" and inside and text in "[&":
            j, p = "\\" + text, "\\" + text
        java.append(j)
        python.append(p)
    py = "".join(python)
    try:
        import regex

        empty = regex.fullmatch(py, "", flags=regex.ASCII | regex.VERSION0) is not None
    except ImportError:
        empty = re.fullmatch(py, "", flags=re.ASCII) is not None
    except Exception as error:
        raise ValueError(f"a pattern can't be read: {source}: {error}") from None
    return Pattern(source, "(?d)" + "".join(java), py, literal, literal or not looks and not empty)


def compile_patterns(sources) -> list[Pattern]:
    """Each pattern on its own; the first that can't be read raises ValueError."""
    return [compile_pattern(s) for s in sources]


def union_pattern(*sources: str) -> Pattern:
    """One pattern with the given ones as alternatives."""
    return compile_pattern("|".join(f"(?:{s})" for s in sources))


def quote(text: str) -> str:
    r"""``text`` for Java between \Q and \E."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
