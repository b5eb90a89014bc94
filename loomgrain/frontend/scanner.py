"""Lexical scanning of JavaScript and TypeScript."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Fixed values of the language: reserved and contextual words, and operators longest first.
KEYWORDS = frozenset(
    "abstract accessor any as assert asserts async await bigint boolean break case catch class const constructor continue debugger declare default "
    "defer delete do else enum export extends false finally for from function get global if implements import in infer instanceof interface "
    "intrinsic is keyof let module namespace never new null number object of out override package private protected public readonly require "
    "return satisfies set static string super switch symbol this throw true try type typeof undefined unique unknown using var void while with yield".split()
)
OPERATORS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split()

_SPACE = re.compile(r"(?:\s|﻿|//[^\n\r]*|/\*.*?(?:\*/|\Z))+", re.S)
_WORD = re.compile(r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_OPERATOR = re.compile("|".join(re.escape(o) for o in sorted(OPERATORS, key=len, reverse=True)))
#: As a plain scanner sees it: signs that could close type arguments come one at a time.
_PLAIN_OPERATOR = re.compile("|".join(re.escape(o) for o in sorted((o for o in OPERATORS if not o.startswith(">") or o == ">"), key=len, reverse=True)))


@dataclass
class Token:
    kind: str  # word, number, string, template (a piece of one), private, sign, regex, end
    text: str
    start: int
    end: int
    newline: bool = False  # a line break came before it


class Scanner:
    """Tokens on demand, so that the parser can say where a regular expression or a template goes on."""

    def __init__(self, source: str):
        self.source = source

    def skip(self, at: int) -> int:
        if at == 0 and self.source.startswith("#!"):
            at = (self.source + "\n").index("\n")
        m = _SPACE.match(self.source, at)
        return m.end() if m else at

    def template(self, at: int) -> Token:
        """From a back-tick or a closing brace to the next ``${`` or the end."""
        end = _CHUNK.match(self.source, at + 1).end()
        end += 2 if self.source.startswith("${", end) else 1 if end < len(self.source) else 0
        return Token("template", self.source[at:end], at, end)

    def next(self, at: int, regex: bool = False, plain: bool = False) -> Token:
        s, start = self.source, self.skip(at)
        newline = "\n" in s[at:start]
        if start >= len(s):
            return Token("end", "", start, start, newline)
        c = s[start]
        if c in "'\"":
            return Token("string", (m := _STRING.match(s, start))[0], start, m.end(), newline)
        if c == "`":
            t = self.template(start)
            t.newline = newline
            return t
        if c.isdigit() or c == "." and s[start + 1 : start + 2].isdigit():
            return Token("number", (m := _NUMBER.match(s, start))[0], start, m.end(), newline)
        if m := _WORD.match(s, start):
            return Token("word", m[0], start, m.end(), newline)
        if c == "#" and (m := _WORD.match(s, start + 1)):
            return Token("private", s[start : m.end()], start, m.end(), newline)
        if regex and c == "/" and (m := _REGEX.match(s, start)):
            return Token("regex", m[0], start, m.end(), newline)
        if m := (_PLAIN_OPERATOR if plain else _OPERATOR).match(s, start):
            return Token("sign", m[0], start, m.end(), newline)
        return Token("sign", c, start, start + 1, newline)


def normal_form(kind: str, text: str) -> str:
    """Identifiers and literals without their spelling; keywords and signs as they are."""
    if kind == "private" or kind == "word" and text not in KEYWORDS:
        return "$ID"
    return "$LIT" if kind in ("number", "string", "template", "regex") else text


def tokenize(source: str, skip: list[tuple[int, int]] = ()) -> list[tuple[str, str, int, int]]:
    """``(normal form, text, line, place)`` of the plain token stream, without those that begin in ``skip`` ranges.

    No parser guides it: regular expressions come as signs and words, markup as code, ``>`` signs singly.
    """
    scan, out, at, line, counted, depth, ranges = Scanner(source), [], 0, 1, 0, [], sorted(skip)
    r = 0
    while True:
        t = scan.next(at, plain=True)
        if t.kind == "end":
            return out
        if t.text == "}" and depth and depth[-1] == 0:
            t = scan.template(t.start)
            if not t.text.endswith("${"):
                depth.pop()
        elif t.kind == "template":
            if t.text.endswith("${"):
                depth.append(0)
        elif depth and t.kind == "sign":
            depth[-1] += (t.text == "{") - (t.text == "}")
        line += source.count("\n", counted, t.start)
        counted = t.start
        while r < len(ranges) and ranges[r][1] <= t.start:
            r += 1
        if not (r < len(ranges) and ranges[r][0] <= t.start):
            out.append((normal_form(t.kind, t.text), t.text, line, t.start))
        at = t.end
