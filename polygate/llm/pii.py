"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for card numbers, mod-97 for IBANs, ranges and digit
counts for addresses and phones), and context words just before a span raise or lower its score.

Spans are found where Spark has no function that returns match positions: ``split`` on the pattern gives the text
between matches and ``regexp_extract_all`` the matches, so running lengths are the positions, in code points; folds of
a fixed length sum them up and carry the last code points, where context words stand.  The
patterns are possessive and start only where a run starts (or where the last match ended), which accepts the same
matches as the plain patterns, yet takes linear time and no stack on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polygate.llm.common import documents


@dataclass(frozen=True)
class Kind:
    """What one kind of personal data looks like: pattern, check, score and context words."""

    name: str
    pattern: str
    hint: str  # a character without which the pattern can't match; empty: none
    valid: Callable[[Column], Column]
    score: float
    context: str
    against: str = r"\b\B"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(16, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def _iban(m: Column) -> Column:
    """Mod-97 over the digits with letters as 10 to 35 and the first four characters moved to the end."""
    flat = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(turned.substr(i, F.lit(1))))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97)
    return F.length(flat).between(15, 34) & (rest == 1)


_LOCAL = r"[A-Za-z0-9._%+-]"
#: The kinds that every result counts, in the order of its spans.
BASE = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "mail|write|contact|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", ".", lambda m: m.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|\z)){4}\z"), 0.6, r"\bip\b|host|address|server|adresse|dirección", "version|release|build|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card, 0.8, "card|visa|master|credit|karte|carte|tarjeta", "order|invoice|isbn|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(8, 15), 0.7, r"phone|\btel|call|fax|mobil|llam|appel"),
)
#: What the method adds: account numbers that pass mod-97.
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", _iban, 0.9, r"iban|account|konto|compte|cuenta|\bbank")
KINDS = (*BASE, IBAN)
#: How many code points before a span its context words may stand.
CONTEXT = 40


#: Matches that one fold takes.  A fold copies the spans that it has found so far at each step, so its length is fixed:
#: the time is linear in the matches, and the folds are joined at the end.
FOLD = 128


def _spans(text: Column, hits: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind: array of struct(start, end, score), in order of start."""
    span = "array<struct<start:int,end:int,score:double>>"
    none = F.array().cast(span)

    def state(pos: Column, tail: Column, out: Column) -> Column:
        """What a fold carries: where it stands in the text, the last code points before that, and what it has found."""
        return F.struct(pos.alias("pos"), tail.alias("tail"), out.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        start = acc["pos"] + F.length(e["gap"])
        end = start + F.length(e["hit"])
        before = F.right(F.concat(acc["tail"], e["gap"]), F.lit(CONTEXT))
        low = F.lower(before)
        score = kind.score + F.when(low.rlike(kind.context), 0.1).otherwise(0.0) - F.when(low.rlike(kind.against), 0.3).otherwise(0.0)
        keep = e["hit"].isNotNull() & kind.valid(e["hit"])
        found = F.array(F.struct(start.alias("start"), end.alias("end"), F.round(score, 2).alias("score")))
        tail = F.right(F.concat(before, F.coalesce(e["hit"], F.lit(""))), F.lit(CONTEXT))
        return state(F.coalesce(end, start), tail, F.when(keep, F.concat(acc["out"], found)).otherwise(acc["out"]))

    def fold(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, state(acc["pos"], acc["tail"], none), step)
        # one element, so that the inner fold is evaluated once for its three fields
        return F.element_at(F.transform(F.array(inner), lambda x: state(x["pos"], x["tail"], F.concat(acc["out"], F.array(x["out"])))), 1)

    walk = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), hits.alias("hit"))
    walk = F.transform(walk, lambda e: F.struct(e["gap"].alias("gap"), e["hit"].alias("hit")))
    first = state(F.lit(0), F.lit(""), F.array().cast(f"array<{span}>"))

    def folds(w: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / FOLD).cast("int")), lambda i: F.slice(w, i * FOLD + 1, FOLD))
        return F.aggregate(parts, first, fold, lambda acc: F.flatten(acc["out"]))

    found = F.element_at(F.transform(F.array(walk), folds), 1)  # bound as a variable, so that the text is split once
    return F.when(F.size(hits) > 0, found).otherwise(none)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, text, email, ip, ...): for each kind an array of struct(start, end, score), ends exclusive.

    One row for each row of ``docs``, in place: no shuffle.  A null text counts as empty and has no spans; null and
    repeated ids are kept; other columns are left out, so their names never clash.  Very long texts take time linear in
    their length and in the number of matches.  An empty table gives an empty one.
    """
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    nothing = F.array().cast("array<string>")
    hits = []
    for k in kinds:
        all_hits = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))
        hits.append((F.when(F.col("text").contains(k.hint), all_hits).otherwise(nothing) if k.hint else all_hits).alias(f"hits_{k.name}"))
    rows = rows.select("doc_id", "text", *hits)
    return rows.select("doc_id", "text", *[_spans(F.col("text"), F.col(f"hits_{k.name}"), k).alias(k.name) for k in kinds])


def joined(kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""


    def of(name: str) -> Column:
        return F.transform(name, lambda s: F.concat_ws(":", F.lit(name), s["start"], s["end"]))

    return F.concat_ws(",", *[of(k.name) for k in kinds])


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans and their scores."""
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        F.concat_ws(",", *[F.transform(k.name, lambda s: s["score"].cast("string")) for k in KINDS]).alias("scores"),
    )
