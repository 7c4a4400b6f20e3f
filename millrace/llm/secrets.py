"""Secret scans: fixed patterns plus windows of high entropy, all as SQL expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern. Runs that are too short can't start later within themselves, so the least length stands in the pattern;
#: an assignment that is too short takes its text away from later ones, so it is dropped after matching.
BASE = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{12,}+"), ("hex", r"[0-9a-f]{32,}+"))


@dataclass(frozen=True)
class CharClass:
    """Runs of a class of characters, and the entropy (bits per character) from which a window of a run is a secret."""

    kind: str
    others: str  # characters of the class, as in a regular expression
    alphabet: str  # the same characters one by one
    window: int
    bits: float
    holds: str  # what a run must begin with, as a lookahead: something that plain words lack

    @property
    def pattern(self) -> str:
        c = f"[{self.others}]"
        return rf"(?<!{c})(?={self.holds}){c}{{{self.window},}}+"


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Hex and base64 runs hold a digit; runs of letters alone change from small to capital letters four times, and need more
#: entropy, so that words written together are no candidates. "=" is padding at an end, or stands before a value: it is in no run.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdefABCDEF", 20, 3.0, "[A-Fa-f]*+[0-9]"),
    CharClass("entropy_base64", "0-9A-Za-z+/_-", "0123456789" + _LETTERS + _LETTERS.upper() + "+/_-", 20, 3.9, "[A-Za-z+/_-]*+[0-9]"),
    CharClass("entropy_letters", "A-Za-z", _LETTERS + _LETTERS.upper(), 24, 4.1, "(?:[A-Z]*+[a-z]++[A-Z]){4}"),
)
#: Stretches of high entropy that match any of these are no secrets: placeholders, counted-out alphabets, UUIDs, bare numbers.
ALLOW = (
    r"(?i)example|sample|placeholder|dummy|changeme|redacted|x{6,}",
    r"(?i)0123456789|1234567890|abcdefghij",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9+/_-]+$",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running_sum(xs: Column) -> Column:
    """Sums of the first 1, 2, .. numbers of an array: each pass adds what stands 1, 2, 4, .. places before, so the cost is
    n log n."""
    doubling = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), F.lit(1), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)))).cast("int"))
    return F.aggregate(doubling, xs, lambda acc, step: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step), F.lit(0))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, s, e>> of all matches, with offsets in code points.

    Splitting by the pattern gives the gaps between the matches that extracting gives, and lengths add up to offsets.
    """

    def placed(found: Column) -> Column:
        lengths = F.transform(
            F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("gap"), found.alias("m")),
            lambda x: F.length(x["gap"]) + F.length(x["m"]),
        )
        ends = let(lengths, running_sum)
        return F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("s"), e.alias("e")))

    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def _clogc(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)


def hot_window(run: Column, cls: CharClass) -> Column:
    """struct<.., a, z>: the start of the first window with enough entropy, and the end of the last one; -1 if there is none.

    The window moves by one character: one count goes down, one goes up, and the sum of c*log2(c) over all counts follows
    by the difference. The counts stand in a string with one place for each letter of the class.
    """
    w = cls.window
    letters = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(cls.alphabet), c))
    moves = let(
        letters,
        lambda xs: F.flatten(
            F.transform(
                xs,
                lambda x, i: F.array(
                    F.struct(F.coalesce(F.get(xs, i - w), F.lit(0)).alias("x"), F.lit(-1).alias("by"), F.lit(-1).alias("i")),
                    F.struct(x.alias("x"), F.lit(1).alias("by"), i.alias("i")),
                ),
            )
        ),
    )
    start = F.struct(
        F.lit("0" * len(cls.alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("a"), F.lit(-1).alias("z")
    )

    def step(st: Column, mv: Column) -> Column:
        return F.when(mv["x"] == 0, st).otherwise(let(F.ascii(F.substring(st["n"], mv["x"], F.lit(1))) - 48, lambda count: moved(st, mv, count)))

    def moved(st: Column, mv: Column, count: Column) -> Column:
        s = st["s"] + _clogc(count + mv["by"]) - _clogc(count)
        hot = (mv["i"] >= w - 1) & (F.log2(F.lit(float(w))) - s / w >= cls.bits)
        return F.struct(
            F.overlay(st["n"], F.char(count + mv["by"] + 48), mv["x"], F.lit(1)).alias("n"),
            s.alias("s"),
            F.when(hot & (st["a"] < 0), mv["i"] - w + 1).otherwise(st["a"]).alias("a"),
            F.when(hot, mv["i"] + 1).otherwise(st["z"]).alias("z"),
        )

    return F.aggregate(moves, start, step)


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: tuple[CharClass, ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """One row per input row: id, base and spans, both array<struct<s, o, kind, e>> in the order of start and kind.

    base: the fixed patterns, leftmost and non-overlapping per kind. spans: base, plus for each class the stretch of a
    candidate run that its windows of high entropy cover, unless that stretch matches a pattern of `allow`. Offsets count
    code points, ends are exclusive. No row is shuffled and no Python runs; a text without a candidate costs one pass per
    pattern. Very long texts are read whole: time follows the length of runs, and n log n the number of matches.

    Null and empty text: no spans. A null id stays null, repeated rows are scanned alike, other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda o, kind, s, e: F.struct(s.alias("s"), F.lit(o).alias("o"), F.lit(kind).alias("kind"), e.alias("e"))

    def of_base(o: int) -> Column:
        kind, pattern = BASE[o]
        found = matches(F.col("t"), pattern)
        if kind == "assign":
            found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
        return F.transform(found, lambda x: span(o, kind, x["s"], x["e"]))

    def of_class(o: int, cls: CharClass) -> Column:
        def suspect(stretch: Column) -> Column:
            out = F.lit(True)
            for pattern in allow:
                out = out & ~F.regexp_like(stretch, F.lit(pattern))
            return out

        found = matches(F.col("t"), cls.pattern)
        hot = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), hot_window(x["m"], cls).alias("w")))
        hot = F.filter(hot, lambda x: (x["w"]["a"] >= 0) & suspect(F.substring(x["m"], x["w"]["a"] + 1, x["w"]["z"] - x["w"]["a"])))
        return F.transform(hot, lambda x: span(o, cls.kind, x["s"] + x["w"]["a"], x["s"] + x["w"]["z"]))

    base = F.array_sort(F.concat(*(of_base(o) for o in range(len(BASE)))))
    more = F.concat(*(of_class(len(BASE) + k, c) for k, c in enumerate(classes)))
    return (
        docs.select(F.col(id_col).alias(id_col), text.alias("t"))
        .select(id_col, base.alias("base"), more.alias("more"))
        .select(id_col, "base", F.array_sort(F.concat("base", "more")).alias("spans"))
    )


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind, _ in BASE),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )
