"""Secret scans with DataFrame functions only.

Base kinds are regular expressions.  Beside them, long candidate strings are screened by the Shannon entropy of a
sliding window: a fold moves the window along the string and keeps the count of each character of the class's alphabet
in a few numbers, so each step changes two counts and the entropy's sum with them.  All folds are linear in the text.  An allow-list drops what is known to be harmless.

Null and empty texts have no spans.  Repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.folds import let, running_max, running_sum

#: The base kinds, in the order that settles ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE, MIN_ACCESS = 12, 18

#: Any string that may hold a span other than an assignment's.
LONG = r"[A-Za-z0-9+/_=-]{16,}+"
KEYWORDS = r"(?i:passw|secret|token|api_?key)"

#: Candidates of the entropy screen: at least a window long.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Alphabet and least entropy in bits of each character class, the narrowest that holds the whole candidate.
CLASSES = {"hex": ("0123456789abcdef", 3.0), "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.5), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7)}
#: Harmless: words and numbers alone, UUIDs, placeholders, runs of one character, paths of words.
ALLOWED = (
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9+/_=-]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|sample|dummy|changeme|your[_-]?key",
    r"(?i)0123456789|abcdefghij",
    r"(.)\1{7}",
    r"^/?[A-Za-z_-]+[0-9]{0,4}(/[A-Za-z_-]*[0-9]{0,4})+$",
)

#: A span by code points and, for taking it out of the text, by bytes.
_SPAN = "struct<start:int,end:int,at:int,to:int,value:string>"
#: Counts of letters that one number holds, of COUNT_BITS each.
COUNTS, COUNT_BITS = 12, 5


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end and value of all leftmost matches: what lies between them tells where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda g: _two(F.length(g), F.octet_length(g)))
    own = F.transform(found, lambda v: _two(F.length(v), F.octet_length(v)))
    ends = running_sum(F.zip_with(F.slice(gaps, 1, F.size(found)), own, lambda gap, n: gap + n))
    starts = F.zip_with(ends, own, lambda end, n: end - n)
    pieces = F.arrays_zip(starts.alias("from"), found.alias("whole"), values.alias("value"))

    def span(piece: Column) -> Column:
        start, at = _first(piece["from"]), _second(piece["from"])
        return F.struct(start.alias("start"), (start + F.length(piece["whole"])).alias("end"), at.alias("at"), (at + F.octet_length(piece["whole"])).alias("to"), piece["value"].alias("value"))

    return F.transform(pieces, span)


def _two(one: Column, other: Column) -> Column:
    """Two places in one number; sums of such numbers add up both."""
    return F.shiftleft(one.cast("bigint"), 32) + other


def _first(both: Column) -> Column:
    return F.shiftright(both, 32).cast("int")


def _second(both: Column) -> Column:
    return both.bitwiseAND(F.lit(2**32 - 1)).cast("int")


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def window_entropy(value: Column, alphabet: str) -> Column:
    """The largest entropy in bits of any window of the string, by counts that change with each step of the window.

    The counts of the alphabet's letters stand in a few numbers, COUNT_BITS each, and a step changes two of them."""
    term = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 2)]
    # What the sum of terms gains where a count of so many grows by one, and loses where it falls by one.
    grows, falls = F.array(*[F.lit(term[c + 1] - term[c]) for c in range(WINDOW + 1)]), F.array(*[F.lit(term[max(c, 1) - 1] - term[c]) for c in range(WINDOW + 1)])
    numbers = -(-len(alphabet) // COUNTS)
    # A letter by the number that holds its count, the count's place there, and one such count.
    place = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k // COUNTS).alias("number"), F.lit(k % COUNTS * COUNT_BITS).alias("shift"), F.lit(1 << k % COUNTS * COUNT_BITS).cast("bigint").alias("one")) for k in range(len(alphabet))])
    codes = F.transform(F.array_remove(F.split(value, ""), ""), lambda c: F.get(place, F.position(c, F.lit(alphabet)) - 1))
    nobody = F.struct(F.lit(-1).alias("k"), F.lit(-1).alias("number"), F.lit(0).alias("shift"), F.lit(0).cast("bigint").alias("one"))
    moves = F.zip_with(codes, F.slice(F.concat(F.array_repeat(nobody, WINDOW), codes), 1, F.size(codes)), lambda enters, leaves: F.struct(enters.alias("enters"), leaves.alias("leaves")))

    def step(state: Column, move: Column) -> Column:
        into, out = move["enters"], move["leaves"]
        count = lambda code: F.call_function("shiftright", F.get(state["counts"], code["number"]), code["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
        full = out["k"] >= 0
        change = F.when(into["k"] == out["k"], 0.0).otherwise(F.get(grows, count(into)) + F.when(full, F.get(falls, count(out))).otherwise(0.0))
        counts = F.transform(state["counts"], lambda c, k: c + F.when(k == into["number"], into["one"]).otherwise(0) - F.when(k == out["number"], out["one"]).otherwise(0))
        total = state["total"] + change
        n = state["n"] + 1
        best = F.when(n >= WINDOW, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("least"), n.alias("n"))

    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), numbers).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"), F.lit(0).alias("n"))
    return F.aggregate(moves, start, step, lambda state: F.lit(math.log2(WINDOW)) - state["least"] / WINDOW)


def _suspect(span: Column) -> Column:
    """Whether a candidate is a secret: not on the allow-list, and random enough for its character class."""
    value = span["value"]
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    random = F.lit(False)
    narrower = F.lit(False)
    for alphabet, least in CLASSES.values():
        inside = value.rlike("^[" + alphabet.replace("-", "\\-") + "]*$") & ~narrower
        random = F.when(inside, window_entropy(value, alphabet) >= least).otherwise(random)
        narrower = narrower | inside
    return ~allowed & random


def secret_spans(text: Column) -> Column:
    """array of (start, kind, end, at, to): places in code points and then in bytes, ends exclusive, by start and then
    kind, which is a place in KINDS."""
    may = text.rlike(LONG)

    def kind(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["at"].alias("at"), s["to"].alias("to")))

    assign = F.when(text.rlike(KEYWORDS), F.filter(_spans(text, ASSIGN, 1), lambda s: F.length(s["value"]) >= MIN_VALUE)).otherwise(_none())
    access = F.when(may & text.contains("AKIA"), F.filter(_spans(text, ACCESS), lambda s: F.length(s["value"]) >= MIN_ACCESS)).otherwise(_none())
    hexes = F.when(may, _spans(text, HEX)).otherwise(_none())
    random = F.when(may, F.filter(_spans(text, CANDIDATE), _suspect)).otherwise(_none())
    return F.array_sort(F.concat(kind(assign, 0), kind(access, 1), kind(hexes, 2), kind(random, 3)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``found``, the spans of its text; entropy spans that lie within
    a base span are left out."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("found", secret_spans(F.coalesce("row.text", F.lit(""))))


    def outside(reach: Column) -> Column:
        # All base spans that begin no later stand before an entropy span.
        return F.filter("found", lambda s, k: (s["kind"] < 3) | (F.get(reach, k) < s["end"]))

    reach = running_max(F.transform("found", lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(-1).cast("bigint")))
    return found.withColumn("found", F.when(F.exists("found", lambda s: s["kind"] == 3), let(reach, outside)).otherwise(F.col("found")))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; spans that overlap are replaced as one."""
    text = F.col("row.text")

    def cut(both: Column) -> Column:
        data, reach = both["data"], both["reach"]
        before = lambda k: F.when(k > 0, F.get(reach, k - 1)).otherwise(0).cast("int")
        part = lambda at, to: F.substring(data, at + 1, to - at).cast("string")
        pieces = F.transform("found", lambda s, k: F.when(s["at"] >= before(k), F.concat(part(before(k), s["at"]), F.lit(mark))).otherwise(""))
        last = F.element_at(reach, -1).cast("int")
        return F.concat(F.array_join(pieces, ""), part(last, F.length(data)))

    reach = running_max(F.transform("found", lambda s: s["to"].cast("bigint")))
    both = F.struct(text.cast("binary").alias("data"), reach.alias("reach"))
    clean = F.when(F.size("found") > 0, let(both, cut)).otherwise(text)
    return scan(docs).select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), count(3).alias("n_entropy")
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all ``documents``."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
