"""Names of a dictionary in texts, by one Aho-Corasick pass.

The automaton holds all names, is built once from a dictionary of measured size and broadcast; a text is
read once whatever the number and the length of the names.  A dictionary of more than ``BOUND`` bytes
is not broadcast: texts then meet it on runs of tokens as long as its longest name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: names of at most so many bytes in all are broadcast
BOUND = 16 << 20
TOKEN = r"([a-z0-9.]+)"
MATCHES = "array<struct<name:string,at:int,hits:int>>"
_ARROW = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32()), ("hits", pa.int32())]))
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def automaton(names: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n in names:
        if n:
            found.add_word(n, n)
    found.make_automaton()
    return found


def _spans(a: ahocorasick.Automaton, text: str, words: bool) -> Iterator[tuple[int, str]]:
    """(start, name) of all names in a text; with ``words`` of those that stand at word bounds, from the left
    the longest at a place, none inside another."""
    if not len(a):
        return
    each = ((end - len(n) + 1, n) for end, n in a.iter(text))
    if not words:
        yield from each
        return
    edge = lambda i: (i > 0 and text[i - 1] in _WORD) != (i < len(text) and text[i] in _WORD)
    longest: dict[int, str] = {}
    for start, n in each:
        if len(n) > len(longest.get(start, "")) and edge(start) and edge(start + len(n)):
            longest[start] = n
    free = 0
    for start in sorted(longest):
        if start >= free:
            free = start + len(longest[start])
            yield start, longest[start]


def find(a: ahocorasick.Automaton, text: str | None, words: bool = False) -> list[dict]:
    """Each different name of a text once, in the order of its first place, with its number of hits."""
    seen: dict[str, dict] = {}
    for start, n in sorted(_spans(a, text or "", words)):
        if (row := seen.get(n)) is None:
            seen[n] = {"name": n, "at": start, "hits": 1}
        else:
            row["hits"] += 1
    return list(seen.values())


def with_matches(rows: DataFrame, text: Column, names: Iterable[str], column: str = "matches", words: bool = False) -> DataFrame:
    """The rows with ``column``: the names found in a text, ordered by first place (counted from 0).

    ``names`` is a list known to be small (at most BOUND bytes).  Case counts: give lower-case
    names and texts to leave it out.  A null or empty text has no names.
    """
    names = list(names)
    if sum(map(len, names)) > BOUND:
        raise ValueError(f"a broadcast dictionary may have {BOUND} bytes")
    shared = rows.sparkSession.sparkContext.broadcast(automaton(names))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(shared.value, t, words) for t in b.column("_text").to_pylist()]
            kept = [c for c in b.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, _ARROW)], [*kept, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return rows.drop(column).withColumn("_text", text).mapInArrow(task, f"{kinds}, `{column}` {MATCHES}")


def names_of(matches: Column | str) -> Column:
    return (F.col(matches) if isinstance(matches, str) else matches)["name"]


def collected(spark: SparkSession, dictionary: DataFrame, name: str = "name") -> list[str] | None:
    """The different names of a dictionary, where their measured size is at most BOUND; else None."""
    listed = dictionary.select(F.col(name).alias("n")).filter("n IS NOT NULL AND n <> ''").distinct()
    size = listed.agg(F.sum(F.octet_length("n").cast("bigint"))).first()[0] or 0
    return [r.n for r in listed.collect()] if size <= BOUND else None


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def tag_names(rows: DataFrame, key: str, text: Column, dictionary: DataFrame) -> DataFrame:
    """(key, entity, type), each once, of the names of a dictionary (name, type) in a text, as whole
    tokens and of any length."""
    named = dictionary.select(F.col("name").alias("entity"), "type")
    known = collected(rows.sparkSession, dictionary)
    if known is None:
        return _tag_by_runs(rows, key, text, named)
    # tokens and names stand between spaces, so a name matches whole tokens only
    spaced = F.concat(F.lit(" "), F.array_join(_tokens(text), " "), F.lit(" "))
    found = with_matches(rows.select(key, spaced.alias("t")), F.col("t"), [f" {n} " for n in known]).drop("t")
    one = found.select(key, F.explode(names_of("matches")).alias("entity")).select(key, F.trim("entity").alias("entity"))
    return one.join(named, "entity").select(key, "entity", "type").distinct()


def _tag_by_runs(rows: DataFrame, key: str, text: Column, named: DataFrame) -> DataFrame:
    """The same for a dictionary of any size: runs of tokens that begin like a name, of the lengths that its names have."""
    parts = named.withColumn("n", F.size(F.split("entity", " "))).withColumn("head", F.element_at(F.split("entity", " "), 1))
    heads = parts.select("head", "n").distinct()
    at = rows.select(key, _tokens(text).alias("t")).select(key, "t", F.posexplode("t").alias("i", "head"))
    runs = at.join(heads, "head").select(key, F.array_join(F.slice("t", F.col("i") + 1, F.col("n")), " ").alias("entity")).distinct()
    return runs.join(named, "entity").select(key, "entity", "type").distinct()


def first_in_list(rows: DataFrame, text: Column, positions: dict[str, int], column: str) -> DataFrame:
    """Of the names in a text the one that stands first in a list, null for none."""
    place = F.create_map(*[F.lit(x) for kv in positions.items() for x in kv]) if positions else F.create_map().cast("map<string,int>")
    found = with_matches(rows, text, positions, "_m")
    best = F.array_min(F.transform("_m", lambda m: F.struct(F.element_at(place, m["name"]).alias("p"), m["name"].alias("name"))))
    return found.withColumn(column, best["name"]).drop("_m")


def longest_name(matches: Column | str) -> Column:
    """The longest of the names found, the first in order of letters of equal ones."""
    return F.array_min(F.transform(names_of(matches), lambda n: F.struct((-F.length(n)).alias("n"), n.alias("name"))))["name"]
