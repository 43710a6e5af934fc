"""From a dialect's tokens to Spark SQL text: everything that is an expression or a query.

The tree is Spark's business; what has to be moved needs only parenthesis depth and clause words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from polygate.errors import SqlSyntaxError, UnsupportedError
from polygate.functions import scalar
from polygate.lexer import Dialect, Token, close_of, significant, split_commas, text_of, value_of

HINTS = {"SQL_CALC_FOUND_ROWS", "SQL_NO_CACHE", "SQL_CACHE", "SQL_SMALL_RESULT", "SQL_BIG_RESULT", "SQL_BUFFER_RESULT"}
_CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "OFFSET", "FETCH", "FOR", "INTO"}
_UNUSED = "\x01"
#: Names of the one schema there is.
SCHEMAS = {"main", "dbo", "public"}


@dataclass
class Options:
    """like_ci: LIKE ignores case, as SQLite's does."""

    like_ci: bool = False


@dataclass
class Emitted:
    text: str
    params: list[int] = field(default_factory=list)  # ordinals used, from 1
    like_params: set[int] = field(default_factory=set)  # those that are patterns of a MySQL LIKE


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(s: str) -> str:
    """A Spark string literal: backslashes are escapes there."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def like_pattern(p: str) -> str:
    r"""A MySQL LIKE pattern without escapes that Spark rejects: ``\x`` means x, a last backslash itself."""
    out, i = [], 0
    while i < len(p):
        if p[i] == "\\":
            d = p[i + 1 : i + 2]
            out.append("\\" + d if d in ("%", "_", "\\") and d else "\\\\" if not d else d)
            i += 2
        else:
            out.append(p[i])
            i += 1
    return "".join(out)


class Rewriter:
    """Rewrites one statement's tokens, whose placeholders are numbered."""

    def __init__(self, dialect: Dialect, options: Options | None = None) -> None:
        self.dialect, self.options = dialect, options or Options()
        self.params, self.like_params = [], set()

    def number(self, t: Token) -> int:
        n = int(t.text[1:] or 0)
        if n < 1:
            raise SqlSyntaxError(f"placeholder {t.text}")
        self.params.append(n)
        return n

    def emit(self, tokens: list[Token]) -> str:
        return self.join(self.rewrite(tokens))

    @staticmethod
    def join(parts: list[str]) -> str:
        return "".join(parts).strip()

    def rewrite(self, tokens: list[Token]) -> list[str]:
        tokens = self.structure(tokens)
        out: list[str] = []
        i = 0
        last: list[Token] = []  # significant tokens so far
        while i < len(tokens):
            t = tokens[i]
            nxt = self.after(tokens, i)
            if t.kind == "space":
                out.append(" ")
                i += 1
                continue
            call = nxt < len(tokens) and tokens[nxt].op("(")
            dotted = bool(last) and last[-1].op(".")
            if t.kind == "word" and call and not dotted:
                end = close_of(tokens, nxt)
                done = self.call(t, tokens[nxt + 1 : end], tokens[nxt : end + 1])
                if done is not None:
                    out.append(done)
                    last.append(tokens[end])
                    i = end + 1
                    continue
            if t.is_("LIKE") or t.is_("ILIKE"):
                i = self.like(tokens, i, out)
                last.append(t)
                continue
            if t.is_("REGEXP", "RLIKE"):
                out.append("RLIKE")
            elif t.kind == "word" and t.upper in scalar.BARE and not call and not dotted:
                out.append(scalar.BARE[t.upper])
            elif t.kind == "word" and t.upper == "FROM" and nxt < len(tokens) and tokens[nxt].is_("DUAL"):
                i = nxt
            elif t.op("::") and nxt < len(tokens) and tokens[nxt].kind == "word":
                name, i = self.type_name(tokens, nxt)
                out.append(f"::{name}")
                last.append(t)
                continue
            elif t.op("==") and self.dialect is Dialect.SQLITE:
                out.append("=")
            elif t.kind == "word" and t.upper == "INFORMATION_SCHEMA" and nxt < len(tokens) and tokens[nxt].op("."):
                view = tokens[self.after(tokens, nxt)]
                out.append(quote(f"information_schema__{view.value.lower()}"))
                i = self.after(tokens, nxt)
            else:
                out.append(self.atom(t))
            last.append(t)
            i += 1
        return out

    @staticmethod
    def after(tokens: list[Token], i: int) -> int:
        i += 1
        while i < len(tokens) and tokens[i].kind == "space":
            i += 1
        return i

    def atom(self, t: Token) -> str:
        if t.kind == "ident":
            return quote(t.value)
        if t.kind == "str":
            return literal(value_of(t))
        if t.kind == "blob":
            return f"X'{value_of(t)}'"
        if t.kind == "param":
            return f":p{self.number(t)}"
        if t.kind == "sysvar":
            return scalar.variable(t.value)
        return t.text

    def like(self, tokens: list[Token], i: int, out: list[str]) -> int:
        """Emits LIKE with its pattern; MySQL patterns are made ones that Spark takes, others get no escape."""
        word = "ILIKE" if self.options.like_ci else tokens[i].text
        j = self.after(tokens, i)
        if j >= len(tokens):
            raise SqlSyntaxError("LIKE without a pattern")
        p = tokens[j]
        end = self.after(tokens, j)
        escape = end < len(tokens) and tokens[end].is_("ESCAPE")
        if p.kind == "str" and not escape and self.dialect is Dialect.MYSQL:
            out.append(f"{word} {literal(like_pattern(value_of(p)))}")
            return j + 1
        if p.kind == "param" and not escape and self.dialect is Dialect.MYSQL:
            n = self.number(p)
            self.like_params.add(n)
            out.append(f"{word} :p{n}")
            return j + 1
        if p.kind in ("str", "param") and not escape:
            out.append(f"{word} {self.atom(p)} ESCAPE '{_UNUSED}'")
            return j + 1
        out.append(word + " ")
        return j

    def type_name(self, tokens: list[Token], i: int) -> tuple[str, int]:
        """A type at ``i`` in Spark's words, and where it ends; a length of a string type is dropped."""
        name = tokens[i].text
        spark = scalar.CAST_TYPES.get(name.upper())
        j = i + 1
        nxt = self.after(tokens, i)
        if nxt < len(tokens) and tokens[nxt].op("("):
            end = close_of(tokens, nxt)
            return (spark or name + text_of(tokens[nxt : end + 1])), end + 1
        if name.upper() == "DOUBLE" and nxt < len(tokens) and tokens[nxt].is_("PRECISION"):
            return "DOUBLE", nxt + 1
        if name.upper() in ("SIGNED", "UNSIGNED") and nxt < len(tokens) and tokens[nxt].is_("INTEGER", "INT"):
            return "BIGINT", nxt + 1
        return spark or name, j

    def call(self, t: Token, inner: list[Token], whole: list[Token]) -> str | None:
        """A call in Spark SQL; None to go on word by word."""
        name = t.upper
        if name == "CAST":
            at = [i for i, x in enumerate(inner) if x.is_("AS") and sum(y.op("(") - y.op(")") for y in inner[:i]) == 0]
            if at:
                kind = [x for x in inner[at[-1] + 1 :] if x.kind != "space"]
                if kind and kind[0].kind == "word":
                    return f"CAST({self.emit(inner[: at[-1]])} AS {self.type_name(kind, 0)[0]})"
            return None
        if name == "GROUP_CONCAT":
            return self.group_concat(inner)
        if name not in scalar.COMMON and name not in scalar.OWN[self.dialect]:
            return None
        return scalar.rewrite(name, [self.emit(a) for a in split_commas(inner)], self.dialect)

    def group_concat(self, inner: list[Token]) -> str:
        sep = "','"
        at = next((i for i, x in enumerate(inner) if x.is_("SEPARATOR")), None)
        if at is not None:
            sep, inner = self.emit(inner[at + 1 :]), inner[:at]
        order = next((i for i, x in enumerate(inner) if x.is_("ORDER")), None)
        tail = ""
        if order is not None:
            tail, inner = f" WITHIN GROUP ({self.emit(inner[order:])})", inner[:order]
        distinct = ""
        body = significant(inner)
        if body and body[0].is_("DISTINCT"):
            distinct, inner = "DISTINCT ", inner[inner.index(body[0]) + 1 :]
        parts = split_commas(inner)
        if len(parts) == 2 and at is None:
            sep, parts = self.emit(parts[1]), parts[:1]
        value = self.emit(parts[0]) if len(parts) == 1 else "concat(" + ", ".join(self.emit(p) for p in parts) + ")"
        return f"listagg({distinct}CAST({value} AS STRING), {sep}){tail}"

    # --- what has to be moved ---------------------------------------------------------------------------------------

    def structure(self, tokens: list[Token]) -> list[Token]:
        """Hints, ``TOP n`` and ``LIMIT a, b``, at this depth; inner parentheses follow when they are emitted."""
        out = self.hints(tokens) if self.dialect is Dialect.MYSQL else list(tokens)
        return self.each_depth(self.unqualified(out))

    def unqualified(self, tokens: list[Token]) -> list[Token]:
        """Names without the one schema's name: after FROM and JOIN, and in front of a table's name and a column's."""
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if t.kind in ("word", "ident") and t.value.lower() in SCHEMAS and not self.before(out, len(out)).op("."):
                parts = tokens[i + 1 : i + 5]
                names = [p.kind in ("word", "ident") for p in parts]
                table = len(parts) > 1 and parts[0].op(".") and names[1]
                column = table and len(parts) > 3 and parts[2].op(".") and (names[3] or parts[3].op("*"))
                if column or table and self.before(out, len(out)).is_("FROM", "JOIN"):
                    i += 2
                    continue
            out.append(t)
            i += 1
        return out

    def each_depth(self, tokens: list[Token]) -> list[Token]:
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            if tokens[i].op("("):
                end = close_of(tokens, i)
                out += [tokens[i], *self.each_depth(tokens[i + 1 : end]), tokens[end]]
                i = end + 1
            else:
                out.append(tokens[i])
                i += 1
        if self.dialect is Dialect.MYSQL:
            out = self.limit(out)
        if self.dialect is Dialect.TSQL:
            out = self.top(out)
        return self.fetch(out)

    def fetch(self, tokens: list[Token]) -> list[Token]:
        """``OFFSET a ROWS FETCH NEXT b ROWS ONLY`` is ``LIMIT b OFFSET a``; either part may stand alone."""
        i = next((i for i, t in enumerate(tokens) if t.is_("OFFSET", "FETCH") and self.depth(tokens, i) == 0), None)
        if i is None:
            return tokens
        sig = [t for t in tokens[i:] if t.kind != "space"]
        offset, at = None, 0
        if sig[0].is_("OFFSET"):
            end = next((k for k, t in enumerate(sig) if t.is_("ROW", "ROWS")), None)
            if end is None:
                return tokens
            offset, at = sig[1:end], end + 1
        rest: list[Token] = []
        blank = Token("space", " ")
        if at < len(sig) and sig[at].is_("FETCH"):
            end = next((k for k in range(at, len(sig)) if sig[k].is_("ROW", "ROWS")), None)
            if end is None or end + 1 >= len(sig) or not sig[end + 1].is_("ONLY"):
                raise UnsupportedError("FETCH ... WITH TIES is not supported")
            most = sig[at + 2 : end] or [Token("num", "1")]
            rest, at = [Token("word", "LIMIT"), blank, *most, blank], end + 2
        if offset is not None:
            rest += [Token("word", "OFFSET"), blank, *offset, blank]
        return [*tokens[:i], *rest, *(x for t in sig[at:] for x in (t, blank))]

    @staticmethod
    def hints(tokens: list[Token]) -> list[Token]:
        out: list[Token] = []
        after_select = False
        for t in tokens:
            if after_select and t.kind == "word" and t.upper in HINTS:
                continue
            if t.kind != "space":
                after_select = t.is_("SELECT") or after_select and t.is_("DISTINCT", "ALL")
            out.append(t)
        return out

    def limit(self, tokens: list[Token]) -> list[Token]:
        """``LIMIT a, b`` is ``LIMIT b OFFSET a``; placeholders keep their numbers."""
        i = next((i for i, t in enumerate(tokens) if t.is_("LIMIT") and self.depth(tokens, i) == 0), None)
        if i is None:
            return tokens
        a = self.after(tokens, i)
        comma = self.after(tokens, a)
        if comma >= len(tokens) or not tokens[comma].op(","):
            return tokens
        b = self.after(tokens, comma)
        if b >= len(tokens):
            raise SqlSyntaxError("LIMIT a, without b")
        first, second = tokens[a], tokens[b]
        blank = Token("space", " ")
        return [*tokens[: i + 1], blank, second, blank, Token("word", "OFFSET"), blank, first, *tokens[b + 1 :]]

    @staticmethod
    def depth(tokens: list[Token], i: int) -> int:
        return sum(t.op("(") - t.op(")") for t in tokens[:i])

    def top(self, tokens: list[Token]) -> list[Token]:
        """``SELECT TOP n`` is a LIMIT at the end of its query, unless that has one."""
        i = next((i for i, t in enumerate(tokens) if t.is_("TOP") and self.depth(tokens, i) == 0 and self.before(tokens, i).is_("SELECT", "DISTINCT", "ALL")), None)
        if i is None:
            return tokens
        a = self.after(tokens, i)
        if a >= len(tokens):
            raise SqlSyntaxError("TOP without a number")
        end = close_of(tokens, a) if tokens[a].op("(") else a
        n = tokens[a : end + 1]
        nxt = self.after(tokens, end)
        words = [t for j, t in enumerate(tokens) if t.kind == "word" and self.depth(tokens, j) == 0]
        if nxt < len(tokens) and tokens[nxt].is_("PERCENT", "WITH"):
            raise UnsupportedError("TOP ... PERCENT and TOP ... WITH TIES are not supported")
        if any(t.is_("UNION", "INTERSECT", "EXCEPT") for t in words):
            raise UnsupportedError("TOP in a branch of a set operation: put the branch in parentheses")
        rest = [*tokens[:i], *tokens[end + 1 :]]
        if any(t.is_("LIMIT", "FETCH") for t in words):
            return rest
        return [*rest, Token("space", " "), Token("word", "LIMIT"), Token("space", " "), *n]

    @staticmethod
    def before(tokens: list[Token], i: int) -> Token:
        return next((t for t in reversed(tokens[:i]) if t.kind != "space"), Token("op", ";"))


def name_outputs(tokens: list[Token]) -> list[Token]:
    """Gives each computed output column of the outermost SELECT the text it was written as for a name."""
    sig = [i for i, t in enumerate(tokens) if t.kind != "space"]
    if not sig or not tokens[sig[0]].is_("SELECT"):
        return tokens
    start = sig[0] + 1
    depth, end, set_op = 0, len(tokens), False
    for i in range(start, len(tokens)):
        t = tokens[i]
        depth += t.op("(") - t.op(")")
        if not depth and t.kind == "word":
            if end == len(tokens) and t.upper in _CLAUSES:
                end = i
            set_op |= t.is_("UNION", "INTERSECT", "EXCEPT")
    if set_op:
        return tokens
    out: list[Token] = []
    for k, item in enumerate(split_commas(tokens[start:end])):
        if k:
            out.append(Token("op", ","))
        body = significant(item)
        while body and (body[0].is_("DISTINCT", "ALL") or body[0].kind == "word" and body[0].upper in HINTS):
            body = body[1:]
        if len(body) > 2 and body[0].is_("TOP") and (body[1].op("(") or body[1].kind in ("num", "param")):
            body = body[close_of(body, 1) + 1 :] if body[1].op("(") else body[2:]
        if body and _needs_name(body):
            at = item.index(body[0])
            out += [*item, Token("word", " AS "), Token("ident", "", text_of(item[at:])), Token("space", " ")]
        else:
            out += item
    return [*tokens[:start], *out, *tokens[end:]]


def _needs_name(body: list[Token]) -> bool:
    if body[-1].op("*") and (len(body) == 1 or body[-2].op(".")):
        return False
    if all(t.kind in ("word", "ident") or t.op(".") for t in body):  # a column, or one with an alias
        return len(body) == 1 and body[0].is_("NULL", "TRUE", "FALSE")
    if len(body) > 1 and body[-1].kind in ("word", "ident", "str") and not body[-1].is_("END", "NULL", "TRUE", "FALSE"):
        before = body[-2]
        if before.is_("AS") or before.op(")") or before.kind in ("num", "str", "ident", "param", "sysvar") or before.is_("END", "NULL"):
            return False
        if before.kind == "word" and not before.is_("AND", "OR", "NOT", "LIKE", "IS", "IN", "DIV", "MOD", "BETWEEN", "REGEXP", "RLIKE", "INTERVAL"):
            return False
    return True


def number_params(tokens: list[Token]) -> list[Token]:
    """Numbers plain question marks from left to right, so that no move changes what they stand for."""
    n, out = 0, []
    for t in tokens:
        if t.kind == "param" and t.text == "?":
            n += 1
            t = Token("param", f"?{n}")
        out.append(t)
    return out


def to_spark(tokens: list[Token], dialect: Dialect, options: Options | None = None, named: bool = True) -> Emitted:
    """Spark SQL for a query's or expression's tokens."""
    r = Rewriter(dialect, options)
    tokens = number_params(tokens)
    text = r.emit(name_outputs(tokens) if named else tokens)
    return Emitted(text, sorted(set(r.params)), r.like_params)
