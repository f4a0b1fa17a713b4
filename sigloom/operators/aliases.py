"""Articles and the aliases of targets, phrases and scripts without blanks too, by an automaton in each task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of an alias at least, unless it has han; characters of a body, and of its lead, that are read;
#: what makes an alias one of a script without blanks; what doesn't stand beside any other.
LEAST, BODY, LEAD = 3, 20_000, 600
HAN, WITHOUT_BLANKS = "[一-鿿]", "[一-鿿぀-ヿ가-힯]"
BESIDE = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
#: Aliases that one automaton holds and the driver passes on at once; more take several passes over the articles.
MOST = 200_000


def usable(aliases: DataFrame) -> DataFrame:
    """target_id and alias, trimmed and in small letters, of those that are long enough to mean something."""
    alias = F.trim("alias")
    long = (F.length(alias) >= LEAST) | alias.rlike(HAN)
    return aliases.where(long).select("target_id", F.lower(alias).alias("alias")).distinct()


def _found(automaton: ahocorasick.Automaton, text: str) -> set[int]:
    """Numbers of the aliases that stand in a text."""
    out: set[int] = set()
    for end, (number, size, bounded) in automaton.iter(text):
        if number not in out:
            first = end - size
            if not bounded or ((first < 0 or text[first] not in BESIDE) and (end + 1 == len(text) or text[end + 1] not in BESIDE)):
                out.add(number)
    return out


def alias_hits(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, target_id, in_title, n_body and in_lead for every article (id, title, content) and target that meet: whether
    an alias stands in the title, how many different ones in the body's first BODY characters, and whether one in its
    lead.  Aliases with han, kana or hangul may stand anywhere, others not beside a Latin letter or a digit.  Null texts
    hold nothing; an article's aliases are looked for all at once, in one pass over its text."""
    owned = usable(aliases)
    names = owned.select("alias").distinct()
    shards = max(1, -(-names.count() // MOST))
    found = None
    for shard in range(shards):
        words = [r.alias for r in names.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == shard).collect()]

        def run(batches: Iterator[pa.RecordBatch], words: list[str] = words) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for number, word in enumerate(words):
                automaton.add_word(word, (number, len(word), not re.search(WITHOUT_BLANKS, word)))
            automaton.make_automaton()
            for batch in batches if words else ():
                out: list[tuple] = []
                for key, title, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    titled, body, lead = (_found(automaton, t.lower()) for t in (title or "", (content or "")[:BODY], (content or "")[:LEAD]))
                    out += [(key, words[n], n in titled, n in body, n in lead) for n in sorted(titled | body | lead)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "alias", "titled", "body", "lead"])

        part = rows.select(F.col("id").cast("bigint").alias("id"), "title", "content").mapInArrow(run, "id bigint, alias string, titled boolean, body boolean, lead boolean")
        found = part if found is None else found.union(part)
    met = found.join(owned, "alias")
    return met.groupBy("id", "target_id").agg(F.bool_or("titled").alias("in_title"), F.count_if("body").alias("n_body"), F.bool_or("lead").alias("in_lead"))
