"""A lexer for PHP source: enough to extract facts, not to run it."""

from __future__ import annotations

import re
from typing import NamedTuple


class SyntaxProblem(ValueError):
    """The source can't be read as PHP."""


class Token(NamedTuple):
    """kind: html, open, var, name, string (constant text), template (with parts that vary), number, op."""

    kind: str
    text: str
    line: int
    end: int
    #: where it starts in the source, and where what follows it starts
    pos: int = 0
    stop: int = 0
    #: of a name, op or attr: the text in lower case
    word: str | None = None

    def low(self) -> str:
        return self.text.lower() if self.word is None else self.word


_NAME = r"[A-Za-z_\x80-\U0010FFFF][A-Za-z0-9_\x80-\U0010FFFF]*"
_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)
_SCAN = re.compile(rf"""
    (?P<space>\s+)
  | (?P<close>\?>\n?)
  | (?P<attr>\#\[)
  | (?P<comment>(?:\#|//)[^\n]*?(?=\?>|\n|\Z)|/\*.*?(?:\*/|\Z))
  | (?P<heredoc><<<[ \t]*(?P<q>["']?)(?P<label>{_NAME})(?P=q)\r?\n)
  | (?P<var>\${_NAME})
  | (?P<name>\\?{_NAME}(?:\\{_NAME})*)
  | (?P<number>0[xXbBoO][0-9A-Fa-f_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?)
  | (?P<single>'(?:[^'\\]|\\.)*')
  | (?P<double>"(?:[^"\\]|\\.)*")
  | (?P<shell>`(?:[^`\\]|\\.)*`)
  | (?P<op>\?->|<=>|===|!==|\*\*=|\?\?=|\.\.\.|<<=|>>=|->|::|=>|\+\+|--|<=|>=|==|!=|<>|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|.)
""", re.X | re.S)
_VARIES = re.compile(r"(?<!\\)(?:\\\\)*(?:\$[A-Za-z_{\x80-\U0010FFFF]|\{\$)")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f", "\\": "\\", "$": "$", '"': '"'}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text, flags=re.S)


def tokenize(source: str) -> list[Token]:
    """All tokens but white space and comments. Raises SyntaxProblem for unclosed strings or comments."""
    out: list[Token] = []
    at, line, html = 0, 1, True
    match, size = _SCAN.match, len(source)
    while at < size:
        if html:
            m = _OPEN.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                out.append(Token("html", text, line, line + text.count("\n"), at, at + len(text)))
                line += text.count("\n")
            if not m:
                break
            out.append(Token("open", m[0], line, line, m.start(), m.end()))
            at, html = m.end(), False
            continue
        if source[at] == " ":
            at += 1
            continue
        m = match(source, at)
        kind, text, pos = m.lastgroup, m[0], at
        at = m.end()
        # what can't hold a line break
        if kind == "op":
            if text in "\"'`":
                raise SyntaxProblem("a string isn't closed")
            out.append(Token(kind, text, line, line, pos, at, text))
            continue
        if kind == "name" or kind == "attr":
            out.append(Token(kind, text, line, line, pos, at, text.lower()))
            continue
        start, line = line, line + text.count("\n")
        if kind == "heredoc":
            end = re.compile(rf"^[ \t]*{m['label']}(?![A-Za-z0-9_])", re.M).search(source, at)
            if not end:
                raise SyntaxProblem("a heredoc isn't closed")
            body = source[at : end.start()].removesuffix("\n")
            line += source[at : end.end()].count("\n")
            at = end.end()
            varies = m["q"] != "'" and _VARIES.search(body)
            out.append(Token("template" if varies else "string", body, start, line, pos, at))
        elif kind in ("space", "comment"):
            if text.startswith("/*") and not text.endswith("*/"):
                raise SyntaxProblem("a comment isn't closed")
        elif kind == "close":
            out.append(Token("op", ";", start, start, pos, at, ";"))
            html = True
        elif kind == "single":
            out.append(Token("string", re.sub(r"\\([\\'])", r"\1", text[1:-1]), start, line, pos, at))
        elif kind == "double":
            out.append(Token("template" if _VARIES.search(text[1:-1]) else "string", _unescaped(text[1:-1]), start, line, pos, at))
        else:
            out.append(Token(kind, text, start, line, pos, at))
    return out
