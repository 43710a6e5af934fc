"""Tokens of SQL text in four dialects: quotes, comments and placeholders are seen for what they are."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from polygate.errors import SqlSyntaxError


class Dialect(Enum):
    MYSQL = "mysql"
    POSTGRES = "postgres"
    TSQL = "tsql"
    SQLITE = "sqlite"


@dataclass(frozen=True)
class Token:
    """kind: word, ident (quoted), str, blob, num, param, sysvar, op, space.  value: without quotes and escapes."""

    kind: str
    text: str
    value: str = ""

    def __post_init__(self) -> None:
        if not self.value:
            object.__setattr__(self, "value", self.text)

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""

    def is_(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words

    def op(self, *ops: str) -> bool:
        return self.kind == "op" and self.text in ops


_MYSQL_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0", "Z": "\x1a"}
_OPS = ("<=>", "->>", "::", "<>", "!=", "<=", ">=", "||", "&&", "<<", ">>", "->", ":=", "==")


def _quoted(sql: str, i: int, quote: str, backslash: bool, what: str) -> tuple[str, int]:
    """The value of a quoted run that opens at ``i``, and where it ends; a doubled quote stands for one."""
    close = "]" if quote == "[" else quote
    out, i = [], i + 1
    while i < len(sql):
        c = sql[i]
        if backslash and c == "\\" and i + 1 < len(sql):
            d = sql[i + 1]
            out.append("\\" + d if d in "%_" else _MYSQL_ESCAPES.get(d, d))
            i += 2
        elif c == close:
            if sql[i + 1 : i + 2] == close:
                out.append(close)
                i += 2
            else:
                return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    raise SqlSyntaxError(f"unterminated {what}")


def lex(sql: str, dialect: Dialect) -> list[Token]:
    """Tokens of ``sql``; comments become a blank."""
    out: list[Token] = []
    i, n = 0, len(sql)
    mysql, pg, tsql, sqlite = (dialect is d for d in Dialect)
    while i < n:
        c = sql[i]
        if c.isspace():
            j = i
            while j < n and sql[j].isspace():
                j += 1
            out.append(Token("space", " "))
            i = j
        elif sql.startswith("--", i) and not (mysql and i + 2 < n and not sql[i + 2].isspace()) or mysql and c == "#":
            j = sql.find("\n", i)
            i = n if j < 0 else j
            out.append(Token("space", " "))
        elif sql.startswith("/*", i):
            depth, j = 1, i + 2
            while depth:
                a, b = sql.find("*/", j), sql.find("/*", j) if pg or tsql else -1
                if a < 0:
                    raise SqlSyntaxError("unterminated comment")
                depth, j = (depth + 1, b + 2) if 0 <= b < a else (depth - 1, a + 2)
            out.append(Token("space", " "))
            i = j
        elif c == "'" or (c == '"' and mysql):
            value, j = _quoted(sql, i, c, mysql, "string")
            out.append(Token("str", sql[i:j], value) if value else Token("str", sql[i:j], "\0empty"))
            i = j
        elif c in "nNeExX" and sql[i + 1 : i + 2] == "'" and ((c in "nN" and (tsql or mysql)) or (c in "eE" and pg) or c in "xX"):
            value, j = _quoted(sql, i + 1, "'", c in "eE" or (mysql and c in "nN"), "string")
            out.append(Token("blob" if c in "xX" else "str", sql[i:j], value or "\0empty"))
            i = j
        elif c == "`" and (mysql or sqlite) or c == '"' or c == "[" and (tsql or sqlite):
            value, j = _quoted(sql, i, c, False, "identifier")
            out.append(Token("ident", sql[i:j], value))
            i = j
        elif pg and c == "$" and not sql[i + 1 : i + 2].isdigit() and (j := _dollar(sql, i)):
            tag = sql[i:j]
            end = sql.find(tag, j)
            if end < 0:
                raise SqlSyntaxError("unterminated string")
            out.append(Token("str", sql[i : end + len(tag)], sql[j:end] or "\0empty"))
            i = end + len(tag)
        elif c == "?" or c == "$" and sql[i + 1 : i + 2].isdigit():
            j = i + 1
            while j < n and sql[j].isdigit():
                j += 1
            out.append(Token("param", sql[i:j]))
            i = j
        elif sql.startswith("@@", i):
            j = i + 2
            while j < n and (sql[j].isalnum() or sql[j] in "_."):
                j += 1
            out.append(Token("sysvar", sql[i:j], sql[i + 2 : j]))
            i = j
        elif c.isdigit() or c == "." and sql[i + 1 : i + 2].isdigit():
            j = i
            if sql[i : i + 2].lower() == "0x":
                j += 2
                while j < n and sql[j] in "0123456789abcdefABCDEF":
                    j += 1
                out.append(Token("blob", sql[i:j], sql[i + 2 : j]))
            else:
                while j < n and (sql[j].isdigit() or sql[j] == "."):
                    j += 1
                if j < n and sql[j] in "eE" and (sql[j + 1 : j + 2].isdigit() or sql[j + 1 : j + 2] in ("+", "-") and sql[j + 2 : j + 3].isdigit()):
                    j += 2
                    while j < n and sql[j].isdigit():
                        j += 1
                out.append(Token("num", sql[i:j]))
            i = j
        elif c.isalpha() or c in "_@#" and not (c == "#" and not tsql):
            j = i + 1
            while j < n and (sql[j].isalnum() or sql[j] in "_$#@"):
                j += 1
            out.append(Token("word", sql[i:j]))
            i = j
        else:
            two = next((o for o in _OPS if sql.startswith(o, i)), c)
            out.append(Token("op", two))
            i += len(two)
    return out


def _dollar(sql: str, i: int) -> int:
    """Where a dollar quote's tag ends, 0 if there is none."""
    j = i + 1
    while j < len(sql) and (sql[j].isalnum() or sql[j] == "_"):
        j += 1
    return j + 1 if sql[j : j + 1] == "$" else 0


def value_of(t: Token) -> str:
    """A string token's value, which may be empty."""
    return "" if t.value == "\0empty" else t.value


def significant(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind != "space"]


def split_statements(tokens: list[Token]) -> list[list[Token]]:
    """Statements between semicolons, empty ones left out."""
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.op(";"):
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if significant(s)]


def close_of(tokens: list[Token], i: int) -> int:
    """The index of the parenthesis that closes the one at ``i``."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].op("("):
            depth += 1
        elif tokens[j].op(")"):
            depth -= 1
            if not depth:
                return j
    raise SqlSyntaxError("unbalanced parentheses")


def split_commas(tokens: list[Token]) -> list[list[Token]]:
    """Parts between commas outside parentheses; none of an empty list."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        depth += t.op("(") - t.op(")")
        if t.op(",") and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [] if len(out) == 1 and not significant(out[0]) else out


def text_of(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens).strip()
