"""Boundary states: what the counters of a text need to know of its parts.

Most counters are sums over characters. Runs and keywords are not: those at the
ends of a part may go on in its neighbour. A state keeps the sums, and for each
class of runs how many there are, the longest, and the lengths of the open ones
at both ends; of ASCII words it keeps the open ones at both ends as far as a
keyword could reach. ``combined`` joins two states into that of the joined text
and is associative, so parts may be folded in any grouping that keeps order,
without their texts. ``EMPTY`` is the neutral state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, COUNTERS, KEYWORDS, PATTERNS, SPACE

#: Counters that are sums over characters, in the order of a state's ``sums``; ``code_marks`` are the marks among code signals.
SUMS = ("byte_count", "rune_count", "code_marks", *(k for k in PATTERNS if not k.endswith("_runs")))
RUNS = {"alphanumeric": f"{ALNUM}+", "whitespace": f"[{SPACE}]+"}
#: Characters of an open word that are kept, one more than the longest keyword has.
REACH = max(map(len, KEYWORDS)) + 1
_RUN = "struct<runs:bigint,longest:bigint,left:bigint,right:bigint>"
STATE = f"struct<size:bigint,sums:array<bigint>,alphanumeric:{_RUN},whitespace:{_RUN},keywords:bigint,head:string,tail:string,word:boolean>"
_WORD = "[A-Za-z0-9_]"


def _run(text: Column, pattern: str, reversed_text: Column) -> Column:
    length = lambda t: F.char_length(F.regexp_extract(t, f"^({pattern})", 1)).cast("long")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.char_length)), F.lit(0)).cast("long")
    return F.struct(F.regexp_count(text, F.lit(pattern)).cast("long").alias("runs"), longest.alias("longest"), length(text).alias("left"), length(reversed_text).alias("right"))


def _is_keyword(word: Column) -> Column:
    return word.isin(*KEYWORDS).cast("long")


def state(text: Column, needed: frozenset | None = None) -> Column:
    """The state of a string column; null is the empty text. Of ``SUMS``, only ``needed`` ones are counted, others are 0."""
    text = F.coalesce(text, F.lit(""))
    back = F.reverse(text)
    count = {k: F.regexp_count(text, F.lit(PATTERNS[k])) for k in SUMS if k in PATTERNS}
    count |= {"byte_count": F.octet_length(text), "rune_count": F.char_length(text), "code_marks": F.regexp_count(text, F.lit(r"[{}\[\]();:=<>]"))}
    sums = F.array(*[(count[k] if needed is None or k in needed else F.lit(0)).cast("long") for k in SUMS])
    keyword = f"(?<!{_WORD})(?:{'|'.join(KEYWORDS)})(?!{_WORD})"
    head = F.regexp_extract(text, f"^({_WORD}+)", 1)
    tail = F.reverse(F.regexp_extract(back, f"^({_WORD}+)", 1))
    word = F.char_length(head) == F.char_length(text)
    # keywords at the ends are open: they are counted when the ends are closed
    inner = F.regexp_count(text, F.lit(keyword)).cast("long") - _is_keyword(head) - F.when(word, F.lit(0)).otherwise(_is_keyword(tail))
    return F.struct(
        F.char_length(text).cast("long").alias("size"), sums.alias("sums"), *[_run(text, p, back).alias(k) for k, p in RUNS.items()],
        inner.alias("keywords"), F.left(head, F.lit(REACH)).alias("head"), F.right(tail, F.lit(REACH)).alias("tail"), word.alias("word"),
    ).cast(STATE)


def _lines(*fields: tuple[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")"


def _words(name: str) -> str:
    return f"{name} IN ({', '.join(repr(w) for w in KEYWORDS)})"


def _joined_run(k: str) -> str:
    """The runs of a class in the text of a followed by that of b."""
    return _lines(
        ("runs", f"a.{k}.runs + b.{k}.runs - IF(a.{k}.right > 0 AND b.{k}.left > 0, 1L, 0L)"), ("longest", f"greatest(a.{k}.longest, b.{k}.longest, a.{k}.right + b.{k}.left)"),
        ("left", f"IF(a.{k}.left = a.size, a.size + b.{k}.left, a.{k}.left)"), ("right", f"IF(b.{k}.right = b.size, b.size + a.{k}.right, b.{k}.right)"),
    )


# SQL text, for expressions of this size are built much faster that way than call by call
_EMPTY_RUN = _lines(("runs", "0L"), ("longest", "0L"), ("left", "0L"), ("right", "0L"))
_EMPTY = _lines(("size", "0L"), ("sums", f"array({', '.join(['0L'] * len(SUMS))})"), *[(k, _EMPTY_RUN) for k in RUNS], ("keywords", "0L"), ("head", "''"), ("tail", "''"), ("word", "true"))
_JOINED = _lines(
    ("size", "a.size + b.size"), ("sums", "zip_with(a.sums, b.sums, (x, y) -> x + y)"), *[(k, _joined_run(k)) for k in RUNS],
    # a word that is open on both sides of the joint is closed, unless it is all there is on one of them
    ("keywords", f"a.keywords + b.keywords + IF(NOT a.word AND NOT b.word AND {_words('concat(a.tail, b.head)')}, 1L, 0L)"),
    ("head", f"IF(a.word, left(concat(a.head, b.head), {REACH}), a.head)"), ("tail", f"IF(b.word, right(concat(a.tail, b.tail), {REACH}), b.tail)"), ("word", "a.word AND b.word"),
)


def empty() -> Column:
    """The state of the empty text."""
    return F.expr(f"CAST({_EMPTY} AS {STATE})")


def folded(states: str) -> Column:
    """The state of the texts of an array of states, given by its name, one after the other."""
    return F.expr(f"aggregate({states}, CAST({_EMPTY} AS {STATE}), (a, b) -> CAST({_JOINED} AS {STATE}))")


def combined(a: str, b: str) -> Column:
    """The state of the text of ``a`` followed by that of ``b``, both given by name."""
    return folded(f"array({a}, {b})")


def counters(s: Column) -> dict[str, Column]:
    """The 27 counters of a state's whole text."""
    out = {k: F.element_at(s["sums"], i + 1) for i, k in enumerate(SUMS)}
    for k in RUNS:
        out[f"{k}_runs"], out[f"max_{k}_run"] = s[k]["runs"], s[k]["longest"]
    out["words"] = out["alphanumeric_runs"]
    out["lines"] = F.when(out["byte_count"] > 0, out["newlines"] + 1).otherwise(F.lit(0).cast("long"))
    ends = _is_keyword(s["head"]) + F.when(s["word"], F.lit(0).cast("long")).otherwise(_is_keyword(s["tail"]))
    out["code_signals"] = out.pop("code_marks") + s["keywords"] + ends
    return {k: out[k] for k in COUNTERS}


#: Rows that are folded at once.
FOLDED_ROWS = 4096


def folded_by(rows: DataFrame, key: list[str], order: list[str], columns: dict[str, str], needed: frozenset | None = None) -> DataFrame:
    """Per key: state columns of its rows, folded in the order of ``order``; ``columns`` says what text stands between two rows.

    Rows are dealt by ranges of (key, order) and folded in stretches of at most
    ``FOLDED_ROWS``, then the stretches of a range, then the ranges of a key, so
    no task holds more than a part of a large key.
    """
    rows = rows.select(*key, *order, *columns).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).select(*key, F.monotonically_increasing_id().alias("_at"), *columns)
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_stretch": F.shiftright("_at", FOLDED_ROWS.bit_length() - 1)})
    gaps = {c: f"gap_{i}" for i, (c, between) in enumerate(columns.items()) if between}
    rows = rows.withColumns({g: state(F.lit(columns[c]), needed) for c, g in gaps.items()})
    for by in ([*key, "_range", "_stretch"], [*key, "_range"], key):
        rows = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", *columns, *gaps.values()))).alias("_s"), F.min("_at").alias("_at"))
        apart = {c: f"flatten(transform(_s, (x, i) -> IF(i > 0, array(x.{g}, x.{c}), array(x.{c}))))" for c, g in gaps.items()}
        kept = [F.expr(f"_s[0].{g}").alias(g) for g in gaps.values()]
        rows = rows.select(*by, "_at", *[folded(apart.get(c, f"transform(_s, x -> x.{c})")).alias(c) for c in columns], *kept)
    return rows.drop("_at", *gaps.values())


def needs(names) -> frozenset:
    """The ``SUMS`` that features are made of."""
    made = {
        "average_alphanumeric_run": ("alphanumeric_runes",), "average_whitespace_run": ("whitespace",), "average_line_bytes": ("byte_count", "newlines"), "lines": ("newlines",),
        "code_density": ("code_marks", "rune_count"), "structured_density": ("structured_signals", "rune_count"), "code_signals": ("code_marks",),
    }
    return frozenset(reduce(lambda a, n: a | set(made.get(n, (n,))), names, {"byte_count"})) & frozenset(SUMS)
