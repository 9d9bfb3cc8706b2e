"""Secret scans: a trigram inverted index in front of the regexes, all in SQL.

Each rule's regex is parsed into a Boolean query over the trigrams that any match
must hold (``trigrams``: an OR of ANDs).  The index has a posting (trigram, row)
for each distinct trigram of a text that some rule asks for, found in one pass;
postings are intersected by row, and the rows that satisfy a rule's query are its
candidates, which alone are verified with the regex.  A rule whose regex has no
mandatory trigrams (a run of hex digits) scans every text where it lies.

Postings and candidates are a few longs each.  Candidates go to the texts by
broadcast if there are at most ``BROADCAST`` of them (12 bytes each), so that no
text moves; beyond it texts and candidates meet in a join by key.

Spans are leftmost and non-overlapping for each rule, in code points, end
exclusive.  Base rules: assign, access, hex; a match that fails its length is
dropped and the search goes on behind it.  Further rules add spans of their own
kinds and change no base span.  Work is in proportion to text and matches: sums
over matches and pieces of a text are made in chunks.

Nulls: a null text is empty; null ids are kept, their postings go by the text.
Repeated rows each give a row.  Other columns are kept, but for one named like
the new column of spans, which that replaces; an empty table gives an empty
result; texts of any length are searched whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, trigrams

#: Candidates that are broadcast at most.
BROADCAST = 4_000_000
#: Matches that are summed one by one, characters of a text's pieces.
CHUNK, PIECE = 64, 4096
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``group``: what ``least`` is the length of."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0

    @property
    def search(self) -> str:
        """The regex, with ``least`` inside where the whole match is a run of one class."""
        if self.least and not self.group and re.fullmatch(r"\[[^\]]+\]\+", self.regex):
            return f"{self.regex[:-1]}{{{self.least},}}"
        return self.regex


#: The base rules in their order, then the added ones.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED


def asked_for(rules: tuple[Rule, ...]) -> list[str]:
    """The index's trigrams, a list that the rules alone decide."""
    return sorted({t for r in rules for alternative in trigrams.query(r.regex) for t in alternative})


def any_of(wanted: list[str]) -> str:
    """A regex that finds each place of any of these trigrams, overlapping ones too."""
    heads: dict[str, list[str]] = {}
    for t in wanted:
        heads.setdefault(t[0], []).append(t[1:])
    return "(?s)(?=(" + "|".join(f"{re.escape(a)}(?:{'|'.join(map(re.escape, tails))})" for a, tails in heads.items()) + "))"


def postings(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, key): the distinct trigrams asked for, as numbers, that a row's text
    holds; ``rows`` has key and text."""
    wanted = asked_for(rules)
    if not wanted:
        return rows.select(F.lit(0).alias("trigram"), "key").limit(0)
    low = F.lower("text")  # ASCII letters map to ASCII letters: no match is lost
    held = F.array_distinct(F.regexp_extract_all(low, F.lit(any_of(wanted)), F.lit(1)))
    number = F.create_map(*[F.lit(x) for i, t in enumerate(wanted) for x in (t, i)])
    return rows.select("key", F.explode(held).alias("held")).select(number[F.col("held")].alias("trigram"), "key")


def candidates(posted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): bit r is set if the row's postings satisfy the query of rule r."""
    wanted = asked_for(rules)
    number = {t: i for i, t in enumerate(wanted)}
    firsts = range(0, max(1, len(wanted)), 63)
    bits = [F.bit_or(F.when((F.col("trigram") >= lo) & (F.col("trigram") < lo + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") - lo)).otherwise(F.lit(0).cast("long"))).alias(f"b{lo}") for lo in firsts]
    met = posted.groupBy("key").agg(*bits)
    found = F.lit(0).cast("long")
    for r, rule in enumerate(rules):
        satisfied = F.lit(False)
        for alternative in trigrams.query(rule.regex):
            present = F.lit(True)
            for lo in firsts:
                if need := sum(1 << (number[t] - lo) for t in alternative if lo <= number[t] < lo + 63):
                    present = present & (F.col(f"b{lo}").bitwiseAND(F.lit(need)) == need)
            satisfied = satisfied | present
        found = found.bitwiseOR(F.when(satisfied, F.lit(1 << r)).otherwise(F.lit(0)).cast("long"))
    return met.select("key", found.alias("rules")).filter("rules != 0")


def let(value: Column, use) -> Column:
    """``use(value)``, the value worked out once: lambdas would repeat it at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before_each(values: Column) -> Column:
    """What all earlier values of an array sum to, for each of them.

    Folds that grow an array copy it at each step, so they run over chunks.
    ``values`` should be a column or a lambda's variable."""
    sums = lambda part, start: F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    chunks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK)), lambda i: F.slice(values, i + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    each = F.arrays_zip(chunks.alias("c"), sums(totals, F.lit(0)).alias("start"))
    return F.when(F.size(values) > 0, F.flatten(F.transform(each, lambda z: sums(z["c"], z["start"])))).otherwise(F.array().cast("array<int>"))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,kind_no,end,kind>> of one rule's spans in a text."""
    whole = rf"(?s)\G(.*?)({rule.search})"  # \G: what follows the last match is read once
    sizes = lambda group: F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(group)), F.length)
    both = F.arrays_zip(sizes(1).alias("g"), sizes(2).alias("h"), (sizes(2 + rule.group) if rule.group else sizes(2)).alias("n"))
    places = lambda z: F.arrays_zip(let(F.transform(z, lambda x: x["g"] + x["h"]), before_each).alias("at"), z.alias("z"))
    good = F.filter(let(both, places), lambda p: p["z"]["n"] >= rule.least)
    return F.transform(good, lambda p: F.struct((p["at"] + p["z"]["g"]).alias("start"), F.lit(order).alias("kind_no"), (p["at"] + p["z"]["g"] + p["z"]["h"]).alias("end"), F.lit(rule.kind).alias("kind")))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "secret_spans", broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with a last column ``spans_col``: sorted by start, then kind.

    Rows are matched to candidates by a hash of id and text; rows that share one
    are candidates together, and at worst a text is verified in vain.
    """
    names = [c for c in docs.columns if c != spans_col]
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    found = common.stored(candidates(postings(docs.select(key.alias("key"), F.col(text_col).alias("text")), rules), rules), "secret-candidates").withColumnRenamed("key", "known")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"))
    few = found.count() <= broadcast
    joined = keyed.join(F.broadcast(found) if few else found, F.col("key") == F.col("known"), "left").withColumn("rules", F.coalesce("rules", F.lit(0).cast("long")))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    parts = []
    for r, rule in enumerate(rules):
        if trigrams.query(rule.regex):
            asked = F.col("rules").bitwiseAND(F.lit(1 << r)) != 0
        else:  # it scans all texts: a plain search decides first
            asked = text.rlike(rule.search)
        parts.append(F.when(asked, rule_spans(text, rule, r)))
    spans = F.array_sort(F.concat(*[F.coalesce(p, F.array().cast(SPANS)) for p in parts]))
    return joined.select("row", spans.alias(spans_col)).select("row.*", spans_col)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``find``'s output."""
    base = F.filter("secret_spans", lambda s: s["kind_no"] < len(BASE))
    of = lambda r: F.size(F.filter("secret_spans", lambda s: s["kind_no"] == r))
    counts = [of(r).cast("long").alias(f"n_{rule.kind}") for r, rule in enumerate(BASE)]
    return found.select(F.col(id_col).cast("long").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def redact(found: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = None, spans_col: str = "secret_spans") -> DataFrame:
    """``find``'s input again, each span (overlapping ones as one) replaced by ``mark``;
    ``length_col``, if given, follows the new text where it changed."""
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col(spans_col)
    # A span starts a new mark if none before it reaches beyond its start.
    before = lambda ends: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)).alias("from")))
    at = let(let(F.transform(spans, lambda s: s["end"]), _furthest), before)
    kept = F.filter(at, lambda s, i: (i == 0) | (s["start"] >= s["from"]))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    number = lambda x: F.floor(x / PIECE).cast("int")
    cut = lambda held, a, b: F.when(b > a, F.substring(F.array_join(F.slice(held, number(a) + 1, number(b - 1) - number(a) + 1), ""), a % PIECE + 1, b - a)).otherwise(F.lit(""))
    heads = lambda held: F.transform(kept, lambda s: F.concat(cut(held, s["from"], s["start"]), F.lit(mark)))
    tail = lambda held: cut(held, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
    cleaned = let(pieces, lambda held: F.concat(F.array_join(heads(held), ""), tail(held)))
    changed = F.size(spans_col) > 0
    out = found.withColumn(text_col, F.when(changed, cleaned).otherwise(F.col(text_col)))
    if length_col in found.columns:
        out = out.withColumn(length_col, F.when(changed, F.length(text_col)).otherwise(F.col(length_col)).cast(found.schema[length_col].dataType))
    return out.drop(spans_col)


def _furthest(values: Column) -> Column:
    """The largest value so far, for each of an array, in chunks as in ``before_each``."""
    most = lambda part, start: F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct(F.greatest(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(F.greatest(acc["at"], x))).alias("out")), lambda acc: acc["out"])
    chunks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK)), lambda i: F.slice(values, i + 1, F.lit(CHUNK)))
    tops = most(F.transform(chunks, F.array_max), F.lit(0))
    starts = F.arrays_zip(chunks.alias("c"), F.concat(F.array(F.lit(0)), tops).alias("start"))
    each = F.filter(F.transform(starts, lambda z: F.when(z["c"].isNotNull(), most(z["c"], z["start"]))), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.flatten(each)).otherwise(F.array().cast("array<int>"))


#: The digest in DuckDB; ``?`` is replaced by a rule's regex.
def _oracle() -> str:
    parts = []
    for r, rule in enumerate(RULES):
        regex = rule.regex.replace("'", "''")
        sized = f"length(regexp_extract_all(t, '(?s)(.*?)({regex})', {2 + rule.group})[i])" if rule.group else "length(hits[i])"
        parts.append(
            f"select rid, {r} as kind_no, '{rule.kind}' as kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) as s, length(hits[i]) as n, {sized} as sized, {rule.least} as least "
            f"from (select rid, t, regexp_extract_all(t, '(?s)(.*?)({regex})', 1) as gaps, regexp_extract_all(t, '(?s)(.*?)({regex})', 2) as hits from d where regexp_matches(t, '{regex}')), lateral (select unnest(range(1, len(hits) + 1)) as i)"
        )
    union = " union all ".join(parts)
    return (
        "with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), "
        f"s as (select rid, kind_no, kind, cast(s as bigint) as s, cast(s + n as bigint) as e from ({union}) where sized >= least), "
        "g as (select rid, count(*) filter (kind_no = 0) as n_assign, count(*) filter (kind_no = 1) as n_access, count(*) filter (kind_no = 2) as n_hex, "
        "string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) filter (kind_no < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) as spans from s group by rid) "
        "select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)"
    )


ORACLE_SQL = _oracle()
