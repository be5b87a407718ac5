"""Secret scans: each rule's regex gives a Boolean trigram query; a trigram index gives candidates; these are verified.

All on DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, written

#: Strings that a part of a regex may match are told apart up to so many; beyond that their trigrams are combined.
MOST_STRINGS = 8


@dataclass(frozen=True)
class Rule:
    """kind: name in results; pattern: valid in Java and Python, never matching the empty string, no lookaround.

    group, least: a match counts if that group (0: all of it) has so many characters; matches that don't count still
    hide what they cover. any_case: for the letters A-Z.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The three base rules. Of ``AKIA[A-Z0-9]+`` with 20 or more characters and ``[0-9a-f]+`` with 24 or
#: more, the minimum is in the pattern: such a run of one class is found or dropped as a whole either way.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules, all with mandatory trigrams.
MORE = (
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

# A trigram query is True (every text), a trigram, or ("and" | "or", frozenset of queries).


def _join(op: str, parts) -> object:
    flat: set = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    # Absorption: x and (x or y) is x; x or (x and y) is x.
    inner = {p: p[1] if isinstance(p, tuple) else frozenset({p}) for p in flat}
    flat = {p for p in flat if not any(inner[q] < inner[p] for q in flat)}
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of(strings: set[str]) -> object:
    """Query that every text with one of these strings fulfils."""
    return _join("or", [_join("and", {s[k : k + 3] for k in range(len(s) - 2)}) for s in strings])


def _analyse(parsed) -> tuple[set[str] | None, object]:
    """(all strings that it can match, or None if too many; query)."""
    strings: set[str] | None = {""}
    queries: list = []

    def flush() -> None:
        nonlocal strings
        if strings:
            queries.append(_of(strings))
        strings = None

    for op, arg in parsed:
        own: set[str] | None = None
        query: object = True
        if op is sre.LITERAL:
            own = {chr(arg)}
        elif op is sre.IN and not any(o is sre.NEGATE or o is sre.CATEGORY for o, _ in arg):
            chars = {chr(c) for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))}
            own = chars if len(chars) <= 6 else None
        elif op is sre.SUBPATTERN:
            own, query = _analyse(arg[3])
        elif op is sre.BRANCH:
            each = [_analyse(b) for b in arg[1]]
            own = set().union(*(e[0] for e in each)) if all(e[0] is not None for e in each) else None
            query = _join("or", [e[1] if e[0] is None else _of(e[0]) for e in each])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            inner_strings, inner_query = _analyse(inner)
            if high == 1 and inner_strings is not None:
                own = inner_strings | {""} if low == 0 else inner_strings
            elif low == high and inner_strings is not None and len(inner_strings) ** low <= MOST_STRINGS:
                own = {"".join(p) for p in product(inner_strings, repeat=low)}
            elif low:
                query = inner_query if inner_strings is None else _of(inner_strings)
        elif op is sre.AT:
            own = {""}
        if own is not None and strings is not None and len(own) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
            continue
        flush()
        queries.append(query)
        # A new run of strings starts behind what isn't told apart.
        strings = own if own is not None else {""}
    if not queries:
        return strings, _of(strings or set())
    flush()
    return None, _join("and", queries)


def trigram_query(rule: Rule) -> object:
    """Boolean query over lower-cased trigrams that each text with a match fulfils; True: the rule scans every text."""

    def lower(q):
        return q if q is True else q.lower() if isinstance(q, str) else _join(q[0], [lower(p) for p in q[1]])

    return lower(_analyse(sre_parse.parse(rule.pattern))[1])


def _trigrams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _alternatives(query: object) -> set[frozenset[str]]:
    """The query as alternatives, each a set of trigrams that must all be there."""
    if isinstance(query, str):
        return {frozenset({query})}
    parts = [_alternatives(p) for p in sorted(query[1], key=str)]
    every = set().union(*parts) if query[0] == "or" else {frozenset().union(*each) for each in product(*parts)}
    return {x for x in every if not any(y < x for y in every)}


#: Documents of one block of the index: a posting list is a bitmap of so many bits for each block that has any.
BLOCK = 32_768


def postings(numbered: DataFrame) -> DataFrame:
    """(block, trigram, docs) from numbered (number from 1 on, trigrams: array): the inverted index, a bitmap a list.

    Lists are cut into blocks of documents, so that a frequent trigram's list is many rows, and are put together from
    partial bitmaps: a task sends one bitmap a block and trigram, however many documents it has.
    """
    each = numbered.select("number", F.explode("trigrams").alias("trigram"))
    return each.groupBy(F.bitmap_bucket_number("number").alias("block"), "trigram").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("docs"))


def candidates(index: DataFrame, queries: dict[str, object], number: dict[str, int]) -> DataFrame:
    """(number, wanted: array of kinds): documents that fulfil a query, from intersections and unions of posting lists.

    queries: trigram queries by kind, none of them True; number: by trigram. In each block the lists of an alternative
    are intersected, if all are there, and those of a rule's alternatives united.
    """
    wanted = [(kind, k, number[g], len(each)) for kind, q in queries.items() for k, each in enumerate(sorted(_alternatives(q), key=sorted)) for g in sorted(each)]
    known = F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("alternative"), F.lit(c).alias("trigram"), F.lit(d).alias("need")) for a, b, c, d in wanted])
    of = index.select("block", "docs", F.explode(F.filter(known, lambda w: w["trigram"] == F.col("trigram"))).alias("w")).select("block", "docs", "w.kind", "w.alternative", "w.need")
    both = of.groupBy("block", "kind", "alternative", "need").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("docs").alias("docs")).filter("n = need")
    either = both.groupBy("block", "kind").agg(F.bitmap_or_agg("docs").alias("docs")).filter(F.bitmap_count("docs") > 0)
    octet = F.conv(F.hex(F.substring("docs", F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    octets = either.select("block", "kind", "docs", F.explode(F.sequence(F.lit(0), F.lit(BLOCK // 8 - 1))).alias("at")).select("block", "kind", "at", octet.alias("octet")).filter("octet > 0")
    bits = octets.select("block", "kind", "at", "octet", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).filter(F.expr("shiftright(octet, bit) & 1 = 1"))
    found = bits.select(((F.col("block") - 1) * BLOCK + F.col("at") * 8 + F.col("bit") + 1).alias("number"), "kind")
    return found.groupBy("number").agg(F.collect_set("kind").alias("wanted"))  # at most as many as there are rules


def _spans(text: str, rule: Rule) -> Column:
    """array<struct<start, end, at>> of a rule's matches, leftmost and without overlap, in code points.

    What a split by the regex leaves between the matches gives their places: the pieces and the matches alternate.
    """
    regex = ("(?i)" if rule.any_case else "") + rule.pattern
    pattern = F.lit(regex)
    n = lambda c: F.char_length(c).cast("long")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), n) if rule.group else F.transform(whole, n)
    each = F.arrays_zip(F.transform(F.split(text, regex, -1), n).alias("gap"), F.transform(whole, n).alias("long"), measured.alias("measured"))
    # The last piece has no match behind it.
    start = F.aggregate(
        F.filter(each, lambda e: e["long"].isNotNull()),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("found")),
        lambda s, e: F.struct(
            (s["at"] + e["gap"] + e["long"]).alias("at"),
            F.when(e["measured"] >= rule.least, F.concat(s["found"], F.array(F.struct((s["at"] + e["gap"]).alias("start"), (s["at"] + e["gap"] + e["long"]).alias("end"))))).otherwise(s["found"]).alias("found"),
        ),
    )
    # Most texts have no match: they need neither split nor sum.
    return F.when(F.regexp_like(text, pattern), start["found"]).otherwise(F.array().cast("array<struct<start:long,end:long>>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, keyed: bool = False) -> DataFrame:
    """(doc_id[, text_hash], found: map of kind to array<struct<start, end>>) of every whole text; code points, end exclusive.

    Rules with mandatory trigrams: an inverted index of these trigrams over all texts (``postings``) gives by Boolean
    queries the candidates (``candidates``), and only these texts are read again and matched. A rule without such
    trigrams is matched in every text. Null and empty texts have no spans. Rows of equal doc_id, null included, are told
    apart by their text's hash, and equal rows get equal results. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    out = ["doc_id", *["text_hash"] * keyed]
    queries = {r: trigram_query(r) for r in rules}
    indexed = [r for r in rules if queries[r] is not True]
    number = {g: k for k, g in enumerate(sorted(set().union(*map(_trigrams, queries.values()))))}
    empty = F.array().cast("array<struct<start:long,end:long>>")
    scanned = F.create_map(*[x for r in rules if queries[r] is True for x in (F.lit(r.kind), _spans("text", r))]) if len(indexed) < len(rules) else F.create_map().cast("map<string,array<struct<start:long,end:long>>>")
    if not indexed:
        return rows.select(*out, scanned.alias("found"))
    # F.lower changes more letters than A-Z, which can only add candidates. A variable of transform holds the lower-cased
    # text: a column of its own would be put into each of its uses, and so would a filter's condition.
    there = F.transform(F.array(F.lower("text")), lambda low: F.array_compact(F.array(*[F.when(low.contains(g), F.lit(k)) for g, k in number.items()])))[0]
    # Written once, so that a number names one document however often tasks run again.
    numbered = written(rows.select("doc_id", "text_hash", there.alias("trigrams"), (F.monotonically_increasing_id() + 1).alias("number")), "numbered").filter(F.size("trigrams") > 0)
    index = written(postings(numbered), "postings")
    wanted = candidates(index, {r.kind: queries[r] for r in indexed}, number)
    chosen = numbered.join(wanted, "number").select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "wanted").dropDuplicates(["own_id", "own_hash"])
    chosen = written(chosen, "candidates")
    verified = F.create_map(*[x for r in indexed for x in (F.lit(r.kind), F.when(F.array_contains("wanted", r.kind), _spans("text", r)).otherwise(empty))])
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    checked = written(rows.join(chosen, same).select("own_id", "own_hash", verified.alias("verified")), "verified").dropDuplicates(["own_id", "own_hash"])
    none = F.create_map(*[x for r in indexed for x in (F.lit(r.kind), empty)])
    return rows.select("doc_id", "text_hash", scanned.alias("scanned")).join(checked, same, "left").select(*out, F.map_concat("scanned", F.coalesce("verified", none)).alias("found"))


def digest(found: str | Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of these rules' spans by start, then by the order of the rules, joined by commas."""
    found = F.col(found) if isinstance(found, str) else found

    def named(k: int, kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("order"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("as")))

    each = F.flatten(F.array(*[named(k, r.kind) for k, r in enumerate(rules)]))
    return F.array_join(F.transform(F.array_sort(each), lambda s: s["as"]), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mask: str = "[SECRET]") -> DataFrame:
    """docs with all spans of the rules in ``text`` replaced by mask, overlapping ones by one; all other columns stay.

    A null text stays null. Repeated rows stay repeated.
    """
    own_id, own_hash, spans = (free_name(n, docs.columns) for n in ("own_id", "own_hash", "spans"))
    found = scan(docs, rules, keyed=True).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.array_sort(F.flatten(F.map_values("found"))).alias(spans))
    found = found.filter(F.size(spans) > 0).dropDuplicates([own_id, own_hash])
    text = F.col("text").cast("string")
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).alias("out"),
        ),
        lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.char_length(text))),
    )
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(own_hash))
    joined = docs.join(written(found, "secrets"), same, "left")
    return joined.select(*[F.when(F.col(spans).isNull(), text).otherwise(done).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])

