"""Java tokens with byte offsets.  Comments are kept apart; broken input never raises."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short void".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed non-sealed".split())

_TOKEN = re.compile(
    rb'(?P<space>[\s\x1a]+)'
    rb'|(?P<line>//[^\n]*)'
    rb'|(?P<block>/\*.*?(?:\*/|\Z))'
    rb'|(?P<text>"""(?:\\.|[^\\])*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)'
    rb'|(?P<word>non-sealed(?![\w$])|[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)'
    rb'|(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)'
    rb'|(?P<sign>->|::|\.\.\.|>>>=|<<=|>>=|[-+*/&|^%!=<>]=|&&|\|\||\+\+|--|.)',
    re.S,
)


class Token(NamedTuple):
    kind: str
    text: str
    lo: int
    hi: int


class Comment(NamedTuple):
    text: str
    lo: int
    hi: int


class Source:
    """The tokens and comments of a file, with matching brackets and line positions."""

    def __init__(self, code: bytes):
        self.code = code
        self.tokens: list[Token] = []
        self.comments: list[Comment] = []
        for m in _TOKEN.finditer(code):
            kind = m.lastgroup
            if kind == "space":
                continue
            text = m[0].decode("utf-8", "replace")
            if kind in ("line", "block"):
                self.comments.append(Comment(text.rstrip("\r"), m.start(), m.start() + len(m[0].rstrip(b"\r"))))
            else:
                self.tokens.append(Token(kind, text, m.start(), m.end()))
        self.match, self.broken = self._matched()
        self.line_starts = [0] + [m.end() for m in re.finditer(rb"\n", code)]
        self.comment_ends = [c.hi for c in self.comments]

    def _matched(self) -> tuple[list[int], list[int]]:
        """For each opening bracket the index of its closing one (the last token if there is none), and the brackets without a partner."""
        out, open_, broken = [-1] * len(self.tokens), [], []
        pair = {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.tokens):
            if t.kind != "sign":
                continue
            if t.text in "([{":
                open_.append(i)
            elif t.text in pair:
                at = next((k for k in range(len(open_) - 1, -1, -1) if self.tokens[open_[k]].text == pair[t.text]), None)
                if at is None or (t.text != "}" and any(self.tokens[k].text == "{" for k in open_[at + 1 :])):
                    broken.append(i)
                    continue
                for k in open_[at + 1 :]:
                    out[k] = i - 1
                    broken.append(k)
                out[open_[at]], out[i] = i, open_[at]
                del open_[at:]
        for k in open_:
            out[k] = len(self.tokens) - 1
            broken.append(k)
        return out, broken

    def point(self, at: int) -> tuple[int, int]:
        """1-based line and byte column of a byte offset."""
        line = bisect_right(self.line_starts, at)
        return line, at - self.line_starts[line - 1] + 1

    def text(self, lo: int, hi: int) -> str:
        return self.code[lo:hi].decode("utf-8", "replace")

    def comment_before(self, lo: int) -> str | None:
        """The comments right before ``lo``: a blank line or another token ends the run."""
        i = bisect_right(self.comment_ends, lo) - 1
        out, to = [], lo
        while i >= 0:
            c = self.comments[i]
            gap = self.code[c.hi : to]
            if gap.strip() or b"\n\n" in gap.replace(b"\r\n", b"\n"):
                break
            if b"\n" not in self.code[max(0, self.code.rfind(b"\n", 0, c.lo)) : c.lo] and self.code[: c.lo].strip():
                break
            if self.code[self.code.rfind(b"\n", 0, c.lo) + 1 : c.lo].strip():
                break  # it ends a line of code
            out.append(c.text)
            to = c.lo
            i -= 1
        return "\n".join(reversed(out)) or None
