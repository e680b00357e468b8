"""Personal data in texts, by expressions only: patterns propose, checksums confirm, context scores.

Patterns propose spans.  Spark returns matches without places, so a text is both matched and split by each pattern, and
running lengths of the pieces between the matches give every span's start in code points; these sums run in blocks,
so that a text of very many numbers takes time in proportion to its length.  Validators confirm: parts
of addresses up to 255, Luhn for cards, mod-97 for IBANs, digit counts for phones.  A span's score starts from its kind,
and words near it (``WINDOW`` characters to either side) raise it; kinds that a pattern alone cannot tell from other
numbers need such words to pass ``MIN_SCORE``.

The base kinds (email, ip, card, phone) are leftmost, non-overlapping matches whose failures are dropped without
another try; they stay whatever their score.  Spans that start together are ordered by kind as listed.  The added kinds are ``iban`` (mod-97) and ``ssn`` (context words).  A
possessive quantifier or a look-behind in a pattern only saves repeated scans of a run: it never changes the matches.

Work is per row, without shuffles, and every document is handled alike.

Defined cases: a null text has no spans; long texts are handled whole; other columns pass through, but for one
with the name of the result, which is replaced; equal rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 40
MIN_SCORE = 0.5
CONTEXT_BOOST = 0.35
#: Numbers whose sums run in one array.
BLOCK = 256
#: Characters of a chunk, from which the words near a span are read.
CHUNK = 1024

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))), _luhn_value)
    return F.pmod(F.aggregate(values, F.lit(0), lambda total, v: total + v), F.lit(10)) == 0


def _luhn_value(digit: Column, at: Column) -> Column:
    value = digit.cast("int")
    doubled = value * 2
    return F.when(at % 2 == 0, value).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))


def mod97(iban: Column) -> Column:
    """Whether an IBAN, with its first four characters moved to the end and letters read as numbers, leaves 1."""
    compact = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    codes = F.transform(F.regexp_extract_all(moved, F.lit("[A-Z0-9]"), F.lit(0)), F.ascii)

    def step(rest: Column, code: Column) -> Column:
        letter = code >= 65
        return F.pmod(F.when(letter, rest * 100 + (code - 55)).otherwise(rest * 10 + (code - 48)), F.lit(97))

    return F.aggregate(codes, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.  ``needs``: a character that every match has, to pass over texts without it."""

    name: str
    pattern: str
    score: float
    confirm: object = None
    context: str = ""
    base: bool = False
    needs: tuple[str, ...] = field(default=())


KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9, None, "mail|contact|correo|courriel", True, ("@",),
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6, lambda m: m.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"), r"\bip\b|address|server|host|login", True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        0.7, lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m)), "card|visa|credit|karte|tarjeta|carte", True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.6, lambda m: F.length(_digits(m)).between(10, 15), "phone|tel|call|mobile|fax", True, ("+",),
    ),
    Kind(
        "iban",
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
        0.6, lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m), "iban|bank|account|konto|cuenta|compte",
    ),
    Kind(
        "ssn",
        r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        0.2, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000"), r"\bssn\b|social security", False, ("-",),
    ),
)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(numbers: Column) -> Column:
    """The array cut into arrays of ``BLOCK``."""
    return F.transform(
        F.when(F.size(numbers) > 0, F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)),
    )


def _sums_before(numbers: Column) -> Column:
    """For each number, the sum of those before it.  An array grows by copying, so sums run within blocks, and over the
    blocks' totals."""

    def run(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    def shifted(inside: Column, by: Column) -> Column:
        return F.transform(F.slice(inside, F.lit(1), F.size(inside) - 1), lambda x: x + by)

    def joined(inner: Column) -> Column:
        totals = F.transform(inner, lambda sums: F.element_at(sums, -1))
        return F.flatten(F.zip_with(inner, F.slice(run(totals), F.lit(1), F.size(inner)), shifted))

    return _let(F.transform(_let(numbers, _blocks), run), joined)


def _piece(chunks: Column, start: Column, length: Column) -> Column:
    """Characters of the text that the chunks make up, at most ``CHUNK`` of them; the text itself would be walked from
    its beginning for every span."""
    at = F.floor(start / CHUNK).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return F.substr(two, (start - at * CHUNK + 1).cast("int"), length)


def _spans(text: Column, chunks: Column, kind: Kind, order: int) -> Column:
    """Confirmed spans of one kind, in order of their starts.  The work is linear in the text, but for its running sums."""

    def placed(found: Column) -> Column:
        """found: matches, and the gaps before them."""
        steps = F.zip_with(found["matches"], found["gaps"], lambda m, g: F.length(m) + F.length(g))
        spans = F.zip_with(
            found["matches"],
            F.zip_with(_sums_before(steps), found["gaps"], lambda before, g: before + F.length(g)),
            lambda m, start: F.struct(start.alias("start"), m.alias("match")),
        )
        return spans if kind.confirm is None else F.filter(spans, lambda s: kind.confirm(s["match"]))

    def scored(span: Column) -> Column:
        end = span["start"] + F.length(span["match"])
        before = _piece(chunks, F.greatest(span["start"] - WINDOW, F.lit(0)), F.least(span["start"], F.lit(WINDOW)))
        near = F.lower(F.concat(before, F.lit(" "), _piece(chunks, end, F.lit(WINDOW))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), F.lit(CONTEXT_BOOST)).otherwise(F.lit(0.0))
        return F.struct(
            span["start"].cast("int").alias("start"), F.lit(order).alias("order"), end.cast("int").alias("end"),
            F.lit(kind.name).alias("kind"), span["match"].alias("match"), score.alias("score"),
        )

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # the last piece of the split stands after the last match
    gaps = _let(F.split(text, kind.pattern, -1), lambda g: F.slice(g, F.lit(1), F.size(g) - 1))
    out = F.transform(_let(F.struct(matches.alias("matches"), gaps.alias("gaps")), placed), scored)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= MIN_SCORE)


def find(df: DataFrame, text_col: str = "text", out_col: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Appends ``out_col``: an array of (start, order, end, kind, match, score), by start and then kind as listed."""
    if out_col.lower() == text_col.lower():
        raise ValueError(f"{out_col!r} can't be read and replaced at once")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind_type = "array<struct<start:int,order:int,end:int,kind:string,match:string,score:double>>"

    def all_spans(chunks: Column) -> Column:
        found = []
        for order, kind in enumerate(kinds):
            spans = _spans(text, chunks, kind, order).cast(kind_type)
            for needed in kind.needs:
                spans = F.when(F.contains(text, F.lit(needed)), spans).otherwise(F.array().cast(kind_type))
            found.append(spans)
        return F.array_sort(F.concat(*found))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return df.withColumn(out_col, _let(chunks, all_spans))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of every span, comma-joined."""
    if base_only:
        base = [k.name for k in KINDS if k.base]
        spans = F.filter(spans, lambda s: s["kind"].isin(base))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replaces every span of ``spans_col`` in the text by its kind in angle brackets."""
    text, spans = F.col(text_col), F.col(spans_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(state: Column, s: Column) -> Column:
        piece = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        shown = F.concat(state["done"], piece, F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), shown.alias("done")))

    return df.withColumn(text_col, F.aggregate(spans, start, step, lambda state: F.concat(state["done"], F.substr(text, state["at"] + 1, F.length(text)))))
