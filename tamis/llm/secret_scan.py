"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: an OR over literal
alternatives of the AND of their trigrams. The index holds postings (trigram, doc_id) of the
trigrams that some rule asks for; a rule's candidates are the documents whose postings
satisfy one of its alternatives. Only candidates are matched against the expression. A rule
without mandatory trigrams (a plain character class) is matched against every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle

# The rule expressions of the scan.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

BROADCAST_ROWS = 500_000  # candidate rows of 12 bytes each: at most some 6 MB
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose group ``measured`` has ``least`` characters count."""

    kind: str
    pattern: str
    measured: int
    least: int


RULES = (Rule("assign", ASSIGN, 2, 6), Rule("access", ACCESS, 0, 20), Rule("hex", HEX, 0, 24))
# Published forms of private keys, tokens and keys of hosted services, and logins and keys in URLs.
ADDED = (
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 1),
    Rule("git_token", r"(ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]+", 0, 40),
    Rule("chat_token", r"xox[abeprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("payment_key", r"(sk|rk)_live_[A-Za-z0-9]+", 0, 24),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("url_login", r"[a-z]+://[^\x00-\x20/?#:@]+:([^\x00-\x20/?#:@]+)@", 1, 1),
    Rule("url_key", r"[?&](access_token|api_key|apikey|client_secret|signature)=([A-Za-z0-9%_.~-]+)", 2, 8),
)
ALL_RULES = (*RULES, *ADDED)


def literal_alternatives(pattern: str) -> list[list[str]]:
    """For each way through the expression, its mandatory literal runs, in lower case.

    What isn't a literal breaks a run. An expression with too many ways loses detail, never
    a way: the query then only asks for less.
    """

    def walk(nodes) -> list[list[str | None]]:
        ways: list[list[str | None]] = [[]]
        for op, arg in nodes:
            if op is sre.LITERAL:
                step = [[chr(arg).lower()]]
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len({chr(c).lower() for _, c in arg}) == 1:
                step = [[chr(arg[0][1]).lower()]]
            elif op is sre.SUBPATTERN:
                step = walk(arg[3])
            elif op is sre.BRANCH:
                step = [way for branch in arg[1] for way in walk(branch)]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
                step = [[], *walk(arg[2])]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                step = [[*way, None] for way in walk(arg[2])]
            else:
                step = [[None]]
            if len(ways) * len(step) > MAX_ALTERNATIVES:
                step = [[None]]
            ways = [a + b for a in ways for b in step]
        return ways

    found = []
    for way in walk(sre_parser.parse(pattern)):
        runs = "".join(c if c is not None else "\0" for c in way).split("\0")
        if (kept := [r for r in runs if len(r) >= 3]) not in found:
            found.append(kept)
    return found


def trigram_query(pattern: str) -> list[set[str]] | None:
    """OR of ANDs of lower-case trigrams; None where some way through has no trigram."""
    ways = [{run[i : i + 3] for run in runs for i in range(len(run) - 2)} for runs in literal_alternatives(pattern)]
    if not all(ways):
        return None
    return [w for i, w in enumerate(ways) if not any(o < w or (o == w and j < i) for j, o in enumerate(ways))]


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given lower-case trigrams over the whole texts."""
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the bits of the indexed rules whose trigram query a document satisfies."""
    wanted = [
        (n << 16 | w, t, len(way))
        for n, r in enumerate(rules)
        for w, way in enumerate(trigram_query(r.pattern) or [])
        for t in sorted(way)
    ]
    if not wanted:
        return docs.select("doc_id").limit(0).withColumn("rules", F.lit(0))
    rows = (F.struct(F.lit(w).alias("way"), F.lit(t).alias("trigram"), F.lit(n).alias("asked")) for w, t, n in wanted)
    terms = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))
    postings = trigram_index(docs, sorted({t for _, t, _ in wanted}))
    # the terms are a few rows for each rule
    met = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "way", "asked").count().where("count = asked")
    bit = F.lit(0)
    for n in range(len(rules)):
        bit = F.when(F.shiftright("way", 16) == n, F.lit(1 << n)).otherwise(bit)
    return met.groupBy("doc_id").agg(F.bit_or(bit).alias("rules"))


def steps(text: Column, rule: Rule) -> Column:
    """For each match in order: the characters before it, its own, and those of the measured group.

    The gaps are the pieces between matches, so gaps and sizes add up to positions; the last
    step has a gap only.
    """
    pattern = F.lit(rule.pattern)
    return F.zip_with(
        F.zip_with(
            F.transform(F.split(text, rule.pattern, -1), F.length),
            F.transform(F.regexp_extract_all(text, pattern, 0), F.length),
            lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")),
        ),
        F.transform(F.regexp_extract_all(text, pattern, rule.measured), F.length),
        lambda at, measured: F.struct(at["gap"].alias("gap"), at["size"].alias("size"), measured.alias("measured")),
    )


def placed(matches: Column, rule: Rule, rank: int) -> Column:
    """From gaps and sizes in order to (start, rank, end) of the matches that are long enough, in code points."""
    return F.aggregate(
        matches,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(
                x["measured"] >= rule.least,
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(rank).alias("rank"),
                            (acc["at"] + x["gap"] + x["size"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id and found, an array of (start, rank, end) by start, then rank.

    ``rank`` is the rule's place in ``rules``; positions are code points, the end exclusive.
    Null texts count as empty. Rows with a null doc_id, or one that repeats, are scanned
    like any other: the index only says which texts to match, so a shared id adds work but
    no match. Other input columns are ignored.
    """
    slim = payload(docs, "doc_id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    indexed = settle(candidates(slim.where("doc_id is not null"), rules))
    if indexed.count() <= BROADCAST_ROWS:
        indexed = F.broadcast(indexed)
    all_bits = (1 << len(rules)) - 1
    asked = F.when(F.col("doc_id").isNull(), F.lit(all_bits)).otherwise(F.coalesce("rules", F.lit(0)))
    out = slim.join(indexed, "doc_id", "left").withColumn("asked", asked)
    found = []
    for n, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            gate = F.col("text").rlike(long) if (long := long_enough(rule)) else F.lit(True)
        else:
            gate = F.col("asked").bitwiseAND(F.lit(1 << n)) != 0
        none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
        found.append(F.when(gate, placed(steps(F.col("text"), rule), rule, n)).otherwise(none))
    return out.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def long_enough(rule: Rule) -> str | None:
    """An expression that any text with a counting match of a lone character class satisfies."""
    parsed = sre_parser.parse(rule.pattern)
    lone = len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and parsed[0][1][0] == 1 and rule.pattern.endswith("+")
    return f"{rule.pattern[:-1]}{{{rule.least}}}" if lone and rule.measured == 0 else None


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """Counts, the text of all spans and the SHA-256 of those of the first ``base`` rules."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))

    def text(spans: Column) -> Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    def of_rule(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    counts = [of_rule(n).alias(f"n_{r.kind}") for n, r in enumerate(rules[:base])]
    first = F.filter("found", lambda s: s["rank"] < base)
    return scanned.select("doc_id", *counts, F.sha2(text(first), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))

