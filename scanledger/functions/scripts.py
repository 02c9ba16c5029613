"""What is code, comment and string in the text of a script (JavaScript and TypeScript), found in one pass.

``code_only`` blanks what line rules must not see; ``described_texts`` finds the texts that describe a tool or a field.  Both
are small vectorised helpers over (source) columns; positions and lines of the source are kept.

Defined results: a string that isn't closed ends with its line, a template, block comment or embedded expression that isn't
closed ends with the file; a null source gives null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NEXT = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|["'`/{}]""", re.S)
_REST = {q: re.compile(rf"[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*", re.S) for q in "\"'"}
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\.|\$(?!\{))[^`\\$]*)*", re.S)
_PATTERN = re.compile(r"(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")
#: After these a slash begins a pattern and does not divide.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|void|throw|new|delete))\s*\Z")
#: A string that is one value: a name, an address, a path.  All others may hold anything, code too.
_VALUE = re.compile(r"""[^\s"'`(){}=]*\Z""")

COMMENT, STRING, PIECE, PATTERN = range(4)


def marks(source: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of comments, strings, patterns and the pieces of templates around embedded code, in order."""
    at, depths = 0, []  # open braces within each open ${
    while m := _NEXT.search(source, at):
        start, c = m.start(), m.group()
        at = m.end()
        if c[:2] in ("//", "/*"):
            yield COMMENT, start, at
        elif c in _REST:
            at = _REST[c].match(source, at).end()
            at += source[at : at + 1] == c
            yield STRING, start, at
        elif c == "/":
            if _BEFORE_PATTERN.search(source[max(0, start - 20) : start]) and (p := _PATTERN.match(source, at)):
                at = p.end()
                yield PATTERN, start, at
        elif c == "{":
            if depths:
                depths[-1] += 1
        elif c == "}" and not depths:
            pass
        elif c == "}" and depths[-1]:
            depths[-1] -= 1
        else:  # a template begins, or goes on behind embedded code
            if c == "}":
                depths.pop()
            at = _TEMPLATE.match(source, at).end()
            whole = c == "`" and source[at : at + 1] != "$"
            if source[at : at + 1] == "$":
                at += 2
                depths.append(0)
            else:
                at += source[at : at + 1] == "`"
            yield STRING if whole else PIECE, start, at


def _blank(text: str) -> str:
    return re.sub(r"[^\r\n]", " ", text)


def code_of(source: str) -> str:
    """The source with comments, patterns and strings blanked; strings that are one value stay, and so do all line ends."""
    out, last = [], 0
    for kind, start, end in marks(source):
        out.append(source[last:start])
        text = source[start:end]
        if kind == STRING:
            inner = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
            out.append(text if _VALUE.match(inner) else text[0] + _blank(inner) + text[len(inner) + 1 :])
        else:
            out.append(_blank(text))
        last = end
    return "".join([*out, source[last:]])


def code_only(source: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else code_of(s))

    return F.pandas_udf(run, "string")(source)


# In the skeleton of a source a text is its number in double quotes, and comments are gone.
_NAME = r"[A-Za-z_$][\w$]*+"
_TEXTS = r'(?>"\d+"(?:\s*\+\s*"\d+")*+)'
_ENDS = r"(?!\s*[+.(\[?`*/%&|<>=-])"
_DECLARED = re.compile(rf"(?<![\w$.])(?:const|let|var)\s+({_NAME})\s*(?::\s*string\s*)?=\s*({_TEXTS}){_ENDS}")
_DESCRIBED = re.compile(rf"(?<![\w$.])description\s*:\s*({_TEXTS}|{_NAME}){_ENDS}|\.describe\(\s*({_TEXTS}|{_NAME})\s*,?\s*\)")


def _skeleton(source: str) -> tuple[str, list[tuple[int, int]]]:
    """The source with its outermost texts numbered, and their places."""
    out, texts, last, opened = [], [], 0, []
    for kind, start, end in marks(source):
        if kind == PIECE:
            if source[start] == "`":
                opened.append(start)
            if source[end - 2 : end] == "${" or not opened:
                continue
            start = opened.pop()
        if opened:
            continue
        out.append(source[last:start])
        if kind in (STRING, PIECE):
            if source[start + 1 : end - 1] == "description" and source[end:].lstrip()[:1] == ":":
                out.append("description")
            else:
                out.append(f'"{len(texts)}"')
                texts.append((start, end))
        else:
            out.append(" " if kind == COMMENT else "/ /")
        last = end
    return "".join([*out, source[last:]]), texts


def texts_of(source: str) -> list[tuple[int, list[str]]]:
    """(line, quoted texts that are joined) of every description, each once, in order.

    A description is the value of a key ``description`` or the only argument of ``.describe``: texts joined by plus signs, or
    the name of a constant of this file, whose line is then its own.  What is computed otherwise is left out.
    """
    skeleton, places = _skeleton(source)

    def told(expression: str) -> tuple[int, tuple[str, ...]]:
        numbers = [int(n) for n in re.findall(r'"(\d+)"', expression)]
        line = source.count("\n", 0, places[numbers[0]][0]) + 1
        return line, tuple(source[a:b] for a, b in (places[n] for n in numbers))

    constants = {m[1]: m[2] for m in _DECLARED.finditer(skeleton)}
    found = set()
    for m in _DESCRIBED.finditer(skeleton):
        said = m[1] or m[2]
        said = said if said[0] == '"' else constants.get(said)
        if said:
            found.add(told(said))
    return [(line, list(texts)) for line, texts in sorted(found)]


def described_texts(source: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [{"line": line, "texts": said} for line, said in texts_of(s or "")])

    return F.pandas_udf(run, "array<struct<line: int, texts: array<string>>>")(source)
