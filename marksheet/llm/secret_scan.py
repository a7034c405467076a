"""Operator 4: secret scans, fixed patterns and sliding-window entropy.

Patterns (``assign``, ``access``, ``hex``): leftmost non-overlapping matches, with the length
condition applied to matches. Positions come from the pieces between matches: splitting a text
at a pattern and listing the matches give the same cuts, so a match's start is the length of all
pieces and matches before it.

Entropy (``entropy_hex``, ``entropy_base64``): a candidate is a run of at least ``WINDOW``
characters of the class. A fold over its characters keeps the counts of the last ``WINDOW`` ones:
a step adds one character and removes one, and changes the entropy by the two terms they touch.
The span reaches from the first to the last window at the class's limit. Candidates without a
digit, or that an allow-list rule knows as a whole (identifiers, words, paths of words), or that overlap a fixed-pattern match, are suppressed. Of a candidate with a placeholder in it the parts beside the placeholders are judged.

Scale: every row for itself, built-in functions only, no shuffle; whole texts.

Defined results: null or empty text has no spans (empty string, zero counts). Repeated rows
give repeated results; spans at one start are told apart by kind. Null ids are kept. Extra
columns are ignored by the query and kept by ``scan``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
LIMITS = {"entropy_hex": 3.0, "entropy_base64": 3.8}
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CLASSES = {"entropy_hex": r"[0-9A-Fa-f]{20,}", "entropy_base64": r"[A-Za-z0-9+/_=-]{20,}"}
PLACEHOLDER = r"(?i:example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token)|xxxx|0000000000|1234567890|abcdefghij)"
WORDS = r"(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*|[A-Z]+|[a-z])[0-9]{0,4}|[0-9]{1,4}"
SEGMENT = rf"[_.-]*(?:{WORDS})(?:[_.-]+(?:{WORDS}))*[_.=-]*"
ALLOWED = [
    rf"^(?:(?!{PLACEHOLDER}).){{0,{WINDOW - 1}}}(?:{PLACEHOLDER}(?:(?!{PLACEHOLDER}).){{0,{WINDOW - 1}}})+$",  # no window beside placeholders
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # a plain identifier
    r"^[0-9]+$", r"^[A-Za-z]+$", r"^[A-Za-z_-]+[0-9]{0,4}$",                           # numbers and words
    rf"^/?(?:{SEGMENT}/)+(?:{SEGMENT})?$",                                               # paths, every segment of words
]
KINDS = ["assign", "access", "hex", *CLASSES]
SPAN = "array<struct<start:int,rank:int,end:int>>"


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, pieces between them) of a text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def located(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans (start, rank, end) of a pattern's matches; ``keep`` judges a match's text."""
    found, between = matches(text, pattern)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        ok = F.lit(True) if keep is None else keep(pair["hit"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    pairs = F.arrays_zip(found.alias("hit"), F.slice(between, F.lit(1), F.size(found)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["spans"]))


def hot_windows(run: Column, limit: float, width: int = WINDOW) -> Column:
    """(first, last) 0-based window starts whose entropy is at the limit, null if there is none.
    The entropy of a window of w characters is log2 w - S / w with S the sum of c log2 c; the
    fold updates S and the counts (a map from character to count) by one character in, one out."""
    chars = F.split(run, "")
    need = width * (F.log2(F.lit(float(width))) - limit)  # S at most this

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def count(counts: Column, code: Column) -> Column:
        return F.element_at(counts, code)

    def put(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code - 1), F.array(count(counts, code) + F.lit(by).cast("double")), F.slice(counts, code + 1, F.lit(128)))

    def step(acc: Column, i: Column) -> Column:
        code_in = F.ascii(F.element_at(chars_of(acc), i + 1))
        c = count(acc["counts"], code_in)
        return F.struct(acc["chars"].alias("chars"), put(acc["counts"], code_in, 1).alias("counts"), (acc["s"] + term(c + 1) - term(c)).alias("s"),
                        acc["first"].alias("first"), acc["last"].alias("last"))

    def leave(acc: Column, i: Column) -> Column:
        code_out = F.ascii(F.element_at(chars_of(acc), i - width + 1))
        c = count(acc["counts"], code_out)
        return F.struct(acc["chars"].alias("chars"), F.when(i >= width, put(acc["counts"], code_out, -1)).otherwise(acc["counts"]).alias("counts"),
                        F.when(i >= width, acc["s"] - term(c) + term(c - 1)).otherwise(acc["s"]).alias("s"), acc["first"].alias("first"), acc["last"].alias("last"))

    def chars_of(acc: Column) -> Column:
        return acc["chars"]

    def look(acc: Column, i: Column) -> Column:
        hot = (i >= width - 1) & (acc["s"] <= need + 1e-9)
        at = (i - width + 1).cast("int")
        return F.struct(acc["chars"].alias("chars"), acc["counts"].alias("counts"), acc["s"].alias("s"), F.when(hot & acc["first"].isNull(), at).otherwise(acc["first"]).alias("first"),
                        F.when(hot, at).otherwise(acc["last"]).alias("last"))

    def each(acc: Column, i: Column) -> Column:
        # three small updates, each bound once
        one = F.transform(F.array(acc), lambda a: F.when(i >= width, leave(a, i)).otherwise(a))
        two = F.transform(one, lambda a: step(a, i))
        return F.element_at(F.transform(two, lambda a: look(a, i)), 1)

    none = F.lit(None).cast("int")
    start = F.struct(chars.alias("chars"), F.array_repeat(F.lit(0.0), 128).alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"))
    steps = F.transform(F.sequence(F.lit(0), F.length(run) - 1), lambda x: x)
    return F.aggregate(steps, start, each, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def allowed(run: Column) -> Column:
    out = ~run.rlike("[0-9]")
    for rule in ALLOWED:
        out = out | run.rlike(rule)
    return out


def entropy_spans(text: Column, kind: str, rank: int, base: Column) -> Column:
    """Spans of one character class, without allowed ones; of a run that meets base spans the parts
    outside them are judged."""
    pattern = CLASSES[kind]
    runs = located(text, pattern, rank)

    def judged(span: Column) -> Column:
        run = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        pure = ~run.rlike("^[0-9A-Fa-f]+$") if kind == "entropy_base64" else F.lit(True)  # hex runs are judged as hex
        hot = F.when(pure & ~allowed(run), hot_windows(run, LIMITS[kind]))
        return F.struct((span["start"] + hot["first"]).alias("start"), F.lit(rank).alias("rank"), (span["start"] + hot["last"] + WINDOW).alias("end"))

    def beside(span: Column) -> Column:
        run = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        parts = located(run, f"{PLACEHOLDER}|(?:(?!{PLACEHOLDER}).)+", rank, lambda hit: (F.length(hit) >= WINDOW) & ~hit.rlike(PLACEHOLDER))
        moved = F.transform(parts, lambda s: F.struct((span["start"] + s["start"]).alias("start"), s["rank"].alias("rank"), (span["start"] + s["end"]).alias("end")))
        return F.when(run.rlike(PLACEHOLDER), moved).otherwise(F.array(span))

    def free(span: Column) -> Column:
        """The parts of a run outside base spans that hold a window."""
        def part(start: Column, end: Column) -> Column:
            return F.when(end - start >= WINDOW, F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))).otherwise(F.array().cast(SPAN))

        def cut(acc: Column, b: Column) -> Column:
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["parts"], part(acc["at"], F.least(b["start"], span["end"]))).alias("parts"))

        met = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        start = F.struct(span["start"].alias("at"), F.array().cast(SPAN).alias("parts"))
        return F.when(F.size(met) == 0, F.array(span)).otherwise(F.aggregate(met, start, cut, lambda acc: F.concat(acc["parts"], part(acc["at"], span["end"]))))

    parts = F.flatten(F.transform(F.flatten(F.transform(runs, free)), beside))
    return F.filter(F.transform(parts, judged), lambda s: s["start"].isNotNull())


def _written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``, arrays of (start, rank in KINDS, end)."""
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    base = F.array_sort(F.concat(located(t, ASSIGN, 1, long_enough), located(t, ACCESS, 2), located(t, HEX, 3)))
    out = docs.withColumn("base_spans", base)
    found = [entropy_spans(t, kind, 4 + i, F.col("base_spans")) for i, kind in enumerate(CLASSES)]
    return out.withColumn("all_spans", F.array_sort(F.concat(F.col("base_spans"), *found)))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out = scan(docs.select("doc_id", "text")).select("doc_id", "base_spans", "all_spans")
    ranks = F.transform("base_spans", lambda s: s["rank"])
    n = [(F.size(ranks) - F.size(F.array_remove(ranks, rank))).cast("long").alias(f"n_{k}") for rank, k in enumerate(KINDS[:3], start=1)]
    return out.select("doc_id", *n, F.sha2(_written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"))
