"""Secret scan: rule matches plus windows of high character entropy, in DataFrame functions only.

Every span is found where the text is scanned; nothing is shuffled. A null text counts as empty and has no
spans; repeated rows are scanned one by one; extra columns are not looked at. Offsets are code points and
ends are exclusive. The entropy scan measures strings of one run of characters that hold a digit: a run of letters alone, however random,
is no candidate. Time and memory grow in proportion to the text and to its matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, text_of, unpacked

# The patterns that the base kinds are defined by.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
#: Looked at before ASSIGN: the letters that its words begin with. It changes no match, but passes over other characters sooner.
BEGINS = "(?=[PpSsTtAa])"

#: Candidate strings of the entropy scan: a run of at least WINDOW such characters; those without a digit are left out.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Values that are merged in one growing array.
CHUNK = 256
#: Sums of c * log2(c) are kept as whole numbers of this part of a bit, so that they don't depend on the way they were reached.
SCALE = 1 << 32
#: Least entropy in bits of a window, by the character class that the whole candidate stays in.
CLASSES = [("^[0-9]+$", 3.2), ("^[0-9a-f]+$|^[0-9A-F]+$", 3.0), ("^[0-9a-z]+$|^[0-9A-Z]+$", 3.5), (".", 3.8)]
#: Candidates that are left alone: identifiers and placeholders that look random but are public.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|x{6}",
    r"(?i)0123456789|abcdefghij",
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The merged values (from 0 on) up to each place of an array<int>. Chunks are merged first and then chained, so the cost of the arrays
    that grow is the chunk's size for each value, not the array's."""

    def chain(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("t"), F.expr("cast(array() as array<int>)").alias("o"))
        step = lambda s, x: let(merge(s["t"], x), lambda m: F.struct(m.alias("t"), F.concat(s["o"], F.array(m)).alias("o")))
        return F.aggregate(part, state, step, lambda s: s["o"])

    def whole(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / CHUNK).cast("int"))
        return let(F.transform(chunks, lambda c: F.slice(v, c * CHUNK + 1, CHUNK)), joined)

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), merge))
        before = F.concat(F.array(F.lit(0)), chain(totals, F.lit(0)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, c: chain(p, F.get(b, c)))))

    return let(values, whole)


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches of pattern; with a group, matches whose
    group is shorter than `least` are dropped afterwards. What lies between two matches comes from split(), so
    a running sum of lengths gives the offsets. Texts without a match are passed over once."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # split() has one part more than there are matches
    pieces = F.filter(F.arrays_zip(between.alias("p"), found.alias("m"), groups.alias("g")), lambda x: x["m"].isNotNull())

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: F.length(y["p"]) + F.length(y["m"])), lambda a, b: a + b)

        def at(e: Column) -> Column:
            return F.transform(x, lambda y, i: F.struct((F.get(e, i) - F.length(y["m"])).alias("s"), F.get(e, i).alias("e"), y["m"].alias("v"), F.length(y["g"]).alias("n")))

        kept = F.filter(let(ends, at), lambda y: y["n"] >= (least if group is not None else 0))
        return F.transform(kept, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["v"].alias("v")))

    return F.when(text.rlike(pattern), let(pieces, placed)).otherwise(none)


def weights(window: int) -> list[int]:
    """c * log2(c) for c = 0..window in parts of SCALE."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def largest_sum(bits: float, window: int) -> int:
    """Most that the counts' c * log2(c) may sum to in a window of at least `bits` bits."""
    return math.floor(window * (math.log2(window) - bits) * SCALE) + window


def entropy_range(window: int = WINDOW) -> str:
    """SQL for struct<first, last> of a candidate x(s, v, most): where its first and its last window begin whose
    counts' c * log2(c) sum to x.most or less, from 0, or -1. The counts of the window's characters are carried along
    as a string, one character for each code from 32 to 127; a step rewrites those of the characters that leave and
    enter, and changes the sum by what these two counts weigh before and after."""
    if window > 80:
        raise ValueError("a window has at most 80 characters")  # a count is one ASCII character
    table = "array(" + ", ".join(f"{x}L" for x in weights(window)) + ")"
    held = lambda state, c: f"(ascii(substr({state}, {c} - 31, 1)) - 40)"
    put = lambda state, c, n: f"overlay({state} placing chr(40 + {n}) from {c} - 31 for 1)"
    fill = f"""aggregate(slice(split(x.v, ''), 1, {window}), named_struct('n', repeat('(', 96), 'sum', 0L),
        (a, y) -> transform(array({held('a.n', 'ascii(y)')}),
          n -> named_struct('n', {put('a.n', 'ascii(y)', '(n + 1)')}, 'sum', a.sum + w[n + 1] - w[n]))[0])"""
    leave = f"""transform(array({held('a.n', 'c.o')}),
        n -> named_struct('n', {put('a.n', 'c.o', '(n - 1)')}, 'sum', a.sum + w[n - 1] - w[n]))[0]"""
    enter = f"""transform(array({held('b.n', 'c.i')}),
        n -> named_struct('n', {put('b.n', 'c.i', '(n + 1)')}, 'sum', b.sum + w[n + 1] - w[n]))[0]"""
    hit = lambda state, i: f"named_struct('n', {state}.n, 'sum', {state}.sum, 'first', if(a.first < 0 and {state}.sum <= x.most, {i}, a.first), 'last', if({state}.sum <= x.most, {i}, a.last))"
    return f"""
      transform(array({table}), w -> transform(array({fill}), f -> aggregate(
        transform(arrays_zip(slice(split(x.v, ''), 1, length(x.v) - {window}), slice(split(x.v, ''), {window} + 1, length(x.v))),
          (z, k) -> named_struct('o', ascii(z['0']), 'i', ascii(z['1']), 'k', k + 1)),
        named_struct('n', f.n, 'sum', f.sum, 'first', if(f.sum <= x.most, 0, -1), 'last', if(f.sum <= x.most, 0, -1)),
        (a, c) -> if(c.o = c.i, {hit('a', 'c.k')}, transform(array({leave}), b -> transform(array({enter}), d -> {hit('d', 'c.k')})[0])[0]),
        a -> named_struct('first', a.first, 'last', a.last)))[0])[0]"""


def candidates(text: Column, allow: list[str] | None = None, window: int = WINDOW) -> Column:
    """array<struct<s, v, most>>: the strings to measure, without the allowed ones and those without a digit, with
    the largest_sum of their class."""

    def kept(x: Column) -> Column:
        hit = ~x["v"].rlike("[0-9]") | (F.length(x["v"]) < window)
        for rule in ALLOW if allow is None else allow:
            hit = hit | x["v"].rlike(rule)
        return ~hit

    def most(x: Column) -> Column:
        out = F
        for rule, bits in CLASSES:
            out = out.when(x["v"].rlike(rule), F.lit(largest_sum(bits, window)).cast("long"))
        return out

    found = F.filter(spans(text, CANDIDATE), kept)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["v"].alias("v"), most(x).alias("most")))


def scan(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    allow: list[str] | None = None,
) -> DataFrame:
    """Per row: doc_id and `found`: array<struct<s, k, e, kind>> by start and kind; k counts KINDS from 0.
    An entropy span runs from a candidate's first high-entropy window to the end of its last one."""
    found = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    found = found.select(
        "doc_id",
        spans(F.col("t"), BEGINS + ASSIGN, 2, 6).alias("k0"),
        spans(F.col("t"), ACCESS).alias("k1"),
        spans(F.col("t"), HEX).alias("k2"),
        candidates(F.col("t"), allow, window).alias("c"),
    )
    found = found.withColumn("c", F.expr(f"transform(c, x -> named_struct('s', x.s, 'r', {entropy_range(window)}))"))
    wide = f"named_struct('s', x.s + x.r.first, 'e', x.s + x.r.last + {window})"
    found = found.withColumn("k3", F.expr(f"transform(filter(c, x -> x.r.first >= 0), x -> {wide})"))

    def of(k: int) -> Column:
        return F.transform(
            F.col(f"k{k}"),
            lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(KINDS[k]).alias("kind")),
        )

    return found.select("doc_id", F.array_sort(F.concat(*map(of, range(4)))).alias("found"))


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """documents with every found span replaced by mask; overlapping spans are replaced once. All rows and
    columns stay; a null text stays null."""
    out = packed(documents, text_col).withColumnRenamed(text_col, "__given").withColumn("__t", text_of("__given"))
    t = F.col("__t")
    pieces = {f"__k{k}": v for k, v in enumerate([spans(t, BEGINS + ASSIGN, 2, 6), spans(t, ACCESS), spans(t, HEX)])}
    out = out.withColumns(pieces | {"__c": candidates(t)})
    out = out.withColumn("__c", F.expr(f"transform(__c, x -> named_struct('s', x.s, 'r', {entropy_range()}))"))
    out = out.withColumn(
        "__m",
        F.expr(f"""array_sort(concat(
          transform(__k0, x -> named_struct('s', x.s, 'e', x.e)), transform(__k1, x -> named_struct('s', x.s, 'e', x.e)),
          transform(__k2, x -> named_struct('s', x.s, 'e', x.e)), transform(filter(__c, x -> x.r.first >= 0),
            x -> named_struct('s', x.s + x.r.first, 'e', x.s + x.r.last + {WINDOW}))))"""),
    )
    found, ends = F.col("__m"), running(F.transform("__m", lambda x: x["e"]), lambda a, b: F.greatest(a, b))

    def cut(chars: Column, until: Column) -> Column:
        """Between the spans, each of which begins at or behind the end of all before it, the text; instead of them the mask."""
        text = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        end = lambda i: F.when(i == 0, 0).otherwise(F.get(until, i - 1))
        begun = F.filter(F.transform(found, lambda x, i: F.struct(end(i).alias("a"), x["s"].alias("b"))), lambda x: x["b"] >= x["a"])
        head = F.array_join(F.transform(begun, lambda x: F.concat(text(x["a"], x["b"]), F.lit(mask))), "")
        return F.concat(head, text(end(F.size(until)), F.size(chars)))

    masked = let(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda chars: let(ends, lambda until: cut(chars, until)))
    return unpacked(out, documents.columns, **{text_col: F.when(F.size("__m") == 0, F.col("__given")).otherwise(masked)})


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans from scan()'s spans."""

    def written(found: Column) -> Column:
        one = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
        return F.array_join(F.transform(found, one), ",")

    def count(k: int) -> Column:
        return F.size(F.filter(F.col("found"), lambda x: x["k"] == k)).cast("long")

    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.filter(F.col("found"), lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    """The digest in DuckDB's SQL, which counts each window's characters anew."""

    def found(k: int, pattern: str, group: int, least: int) -> str:
        return f"""SELECT r, {k} AS k, p, m, g, {least} AS least FROM (
          SELECT r, string_split_regex(text, p) AS p, regexp_extract_all(text, p) AS m, regexp_extract_all(text, p, {group}) AS g
          FROM d, (SELECT $r${pattern}$r$ AS p) WHERE regexp_matches(text, p))"""

    bits = " ".join(f"WHEN regexp_matches(v, $r${rule}$r$) THEN {largest_sum(least, window)}" for rule, least in CLASSES)
    allowed = " OR ".join(f"regexp_matches(v, $r${rule}$r$)" for rule in ALLOW)
    table = ", ".join(str(x) for x in weights(window))
    one = "CASE k " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found(0, ASSIGN, 2, 6)} UNION ALL {found(1, ACCESS, 0, 0)} UNION ALL {found(2, HEX, 0, 0)} UNION ALL {found(3, CANDIDATE, 0, window)}),
m AS (SELECT r, k, least, m[i] AS v, length(g[i]) AS n,
             (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
c AS (SELECT row_number() OVER () AS c, r, s, v, CASE {bits} END AS most FROM m
      WHERE k = 3 AND n >= least AND regexp_matches(v, '[0-9]') AND NOT ({allowed})),
w AS (SELECT c, i, unnest(string_split(substr(v, i + 1, {window}), '')) AS ch
      FROM (SELECT c, v, unnest(range(0, length(v) - {window} + 1)) AS i FROM c)),
h AS (SELECT c, i, sum(([{table}])[n + 1]) AS total FROM (SELECT c, i, ch, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL),
x AS (SELECT r, 3 AS k, any_value(s) + min(i) AS s, any_value(s) + max(i) + {window} AS e FROM h JOIN c USING (c) WHERE total <= most GROUP BY c, r
      UNION ALL SELECT r, k, s, s + length(v) FROM m WHERE k < 3 AND n >= least),
g AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS h,
             coalesce(string_agg({one}, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base, string_agg({one}, ',' ORDER BY s, k, e) AS spans
      FROM x GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
