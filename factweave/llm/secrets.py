"""Secret scanning in SQL expressions only.

Three fixed patterns give the base spans. Beyond them, candidate strings (runs of 20 or more token
characters that hold a digit) are classed as hexadecimal or base-64; a window of ``WINDOW``
characters slides over each, its Shannon entropy kept by incremental counts: the character that
enters and the one that leaves change two counts and the running sum of c*log2(c). The counts of
all characters are five-bit fields of a few longs, and the sum is a whole number of 2**-40, so a step
costs the same anywhere in a candidate and nothing is rounded away. A candidate is reported from
its first to its last window at or above its class's threshold, unless an allow-list pattern matches
it or a base span covers part of it.

All work is per row, without a shuffle. Candidates are walked once; offsets are summed in runs and
base spans are found by halving, so no step copies what was gathered before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import bound, cut_blocks, free_name, laid_end_to_end, text_blocks

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run shorter than 18 can hold no match that is long enough
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # UUID
    r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefghij",
    r"^[0-9_=/+-]+$",  # numbers and rules
    r"^(?:[A-Za-z]+[0-9]{0,4}[/_=-])+[A-Za-z]*[0-9]{0,4}$",  # words joined to a path or name
)
PLACEHOLDER = "[SECRET]"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_PLACED = "array<struct<start:int,kind:int,end:int,word:string>>"


def _located(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans (code points, end exclusive), with the matched word, of the leftmost non-overlapping matches.

    The parts between matches and the matches themselves, laid end to end, give the offsets.
    ``keep``: a condition on the match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = bound(found, lambda hits: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit")))

    def span(x: Column, at: Column) -> Column:
        start = (at + F.length(x["gap"])).cast("int")
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("word"))

    placed = laid_end_to_end(steps, lambda x: F.length(x["gap"]) + F.length(x["hit"]), span)
    if keep is not None:
        placed = F.filter(placed, lambda x: keep(x["word"]))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(_PLACED))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(_SPAN)


def base_kinds(text: Column) -> list[Column]:
    """Spans of each base kind, in order; those of one kind do not overlap."""
    def keeps(word: Column) -> Column:
        return F.length(F.regexp_extract(word, ASSIGN, 2)) >= ASSIGN_LEAST

    return [_plain(_located(text, ASSIGN, 0, keeps)), _plain(_located(text, ACCESS, 1)), _plain(_located(text, HEX, 2))]


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind."""
    return F.array_sort(F.concat(*base_kinds(text)))


_SCALE = 1 << 40
_FIELDS = 12  # five-bit counts in a long


def window_hits(candidate: Column, window: int = WINDOW) -> Column:
    """(first, last): start of the first and end of the last window at the threshold, or null."""
    sizes = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0).cast("long") for c in range(window + 1)])
    hexed = candidate.rlike("^[0-9A-Fa-f]+$")
    most = F.when(hexed, round(window * (math.log2(window) - THRESHOLDS["hex"]) * _SCALE)).otherwise(round(window * (math.log2(window) - THRESHOLDS["base64"]) * _SCALE))
    words = -(-len(ALPHABET) // _FIELDS)
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0).cast("long").alias("total"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def unit(code: Column) -> Column:
        """A count of one in the field of a code within its long."""
        return F.call_function("shiftleft", F.lit(1).cast("long"), (code % _FIELDS) * 5)

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.floor(code / _FIELDS).cast("int")), (code % _FIELDS) * 5).bitwiseAND(31).cast("int")

    def put(counts: Column, code: Column, sign: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k == F.floor(code / _FIELDS).cast("int"), c + sign * unit(code)).otherwise(c))

    def slide(codes: Column, limit: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - window)

            def moved(less: Column) -> Column:
                """After the leaving character: counts and total; now the entering one."""
                n = count(less["counts"], enters)
                total = less["total"] + F.get(sizes, n + 1) - F.get(sizes, n)
                hit = (i + 1 >= window) & (total <= limit + window)
                return F.struct(
                    put(less["counts"], enters, 1).alias("counts"), total.alias("total"),
                    F.when(acc["first"].isNull() & hit, i + 1 - window).otherwise(acc["first"]).alias("first"),
                    F.when(hit, i + 1).otherwise(acc["last"]).alias("last"),
                )

            gone = count(acc["counts"], leaves)
            less = F.when(
                i >= window, F.struct(put(acc["counts"], leaves, -1).alias("counts"), (acc["total"] + F.get(sizes, gone - 1) - F.get(sizes, gone)).alias("total"))
            ).otherwise(F.struct(acc["counts"].alias("counts"), acc["total"].alias("total")))
            return bound(less, moved)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), empty, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    both = F.struct(codes.alias("codes"), most.alias("most"))
    return bound(both, lambda b: slide(b["codes"], b["most"]))


_HALVINGS = 31


def _touched(spans: Column, p: Column) -> Column:
    """Whether one of the spans (ordered, apart from each other) overlaps p: the last that starts before its end."""
    ends = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = F.get(spans, middle)["start"] < p["end"]
        step = F.when(before, F.struct((middle + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))
        return F.when(acc["low"] < acc["high"], step).otherwise(acc)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    last = F.aggregate(rounds, ends, halve, lambda acc: F.get(spans, acc["low"] - 1)["end"])
    return F.when(F.size(spans) > 0, F.coalesce(last > p["start"], F.lit(False))).otherwise(False)


def entropy_spans(text: Column, kinds: list[Column]) -> Column:
    """Spans of candidates with high windows that no base span touches; kinds: ``base_kinds``."""

    def fine(word: Column) -> Column:
        out = word.rlike("[0-9]")
        for pattern in ALLOWED:
            out = out & ~word.rlike(pattern)
        return out

    def free(p: Column) -> Column:
        out = F.lit(True)
        for spans in kinds:
            out = out & ~_touched(spans, p)
        return out

    def narrowed(p: Column) -> Column:
        def span(hit: Column) -> Column:
            return F.struct((p["start"] + hit["first"]).alias("start"), F.lit(3).alias("kind"), (p["start"] + hit["last"]).alias("end"))

        return bound(window_hits(p["word"]), span)

    places = F.filter(_located(text, CANDIDATE, 3, fine), free)
    hits = F.filter(F.transform(places, narrowed), lambda p: p["start"].isNotNull())
    return F.when(text.rlike("[0-9]"), hits.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, text: str = "text", base: str = "base", found: str = "found") -> DataFrame:
    """docs with ``base`` and ``found`` (base and entropy) span arrays, by start then kind.

    Null texts count as empty and have no span. Columns of those names are replaced; the arguments
    give others.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    names: list[str] = []
    one = docs
    for i, spans in enumerate(base_kinds(clean)):  # columns, not a struct: its fields would be put into every use
        names.append(free_name(one, KINDS[i]))
        one = one.withColumn(names[-1], spans)
    own = [F.col(n) for n in names]
    more = free_name(one, KINDS[3])
    two = one.withColumn(more, entropy_spans(clean, own))
    return two.withColumns({base: F.array_sort(F.concat(*own)), found: F.array_sort(F.concat(*own, F.col(more)))}).drop(*names, more)


def spelled(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str = "text", spans: str = "found") -> Column:
    """The text with each stretch of touching or overlapping spans replaced by a placeholder."""
    source, own = F.col(text), F.col(spans)

    def pieces(stretches: Column) -> Column:
        """What stands before each stretch, then what follows the last."""
        before = F.transform(stretches, lambda _, i: F.when(i > 0, F.get(stretches, i - 1)["end"]).otherwise(0))

        def cut(blocks: Column) -> Column:
            kept = F.zip_with(before, stretches, lambda a, s: F.concat(cut_blocks(blocks, a, s["start"]), F.lit(PLACEHOLDER)))
            return F.concat(F.array_join(kept, ""), cut_blocks(blocks, F.element_at(stretches, -1)["end"], F.length(source)))

        return bound(text_blocks(source), cut)

    return F.when(source.isNull() | (F.size(own) == 0), source).otherwise(bound(_stretches(own), pieces))


def _stretches(spans: Column) -> Column:
    """Ordered spans joined where they touch: those that start beyond all ends before, each to the farthest end up to the next."""
    reach = _farthest(spans)

    def opened(at: Column) -> Column:
        def of(far: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i)["start"] > F.get(far, i - 1)))
            return bound(
                first,
                lambda f: F.transform(
                    f, lambda i, n: F.struct(F.get(at, i)["start"].alias("start"), F.get(far, F.coalesce(F.get(f, n + 1), F.size(at)) - 1).alias("end"))
                ),
            )

        return bound(reach, of)

    return bound(spans, opened)


def _farthest(spans: Column) -> Column:
    """The greatest end up to each span, in runs."""
    run = 256
    none = F.array().cast("array<int>")

    def walk(ends: Column, first: Column) -> Column:
        start = F.struct(first.alias("most"), none.alias("out"))

        def step(acc: Column, e: Column) -> Column:
            most = F.greatest(acc["most"], e)
            return F.struct(most.alias("most"), F.concat(acc["out"], F.array(most)).alias("out"))

        return F.aggregate(ends, start, step, lambda acc: acc["out"])

    ends = F.transform(spans, lambda s: s["end"])
    runs = bound(ends, lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / run).cast("int")), lambda r: F.slice(e, r * run + 1, F.lit(run))))

    def spread(r: Column) -> Column:
        tops = walk(F.transform(r, lambda e: F.array_max(e)), F.lit(0))
        firsts = F.concat(F.array(F.lit(0)), F.slice(tops, 1, F.size(tops) - 1))
        return F.flatten(F.zip_with(r, firsts, walk))

    return bound(runs, spread)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("found").alias("spans"),
    )


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a placeholder. Other columns stay, whatever their names."""
    base, found = free_name(docs, "base_spans"), free_name(docs, "found_spans")
    clean = scan(docs, base=base, found=found).withColumn("text", redacted(spans=found))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)
