"""Secrets in whole texts: fixed forms, and character Markov models.

Two first-order models of characters, one of random strings and one of ordinary
identifiers, are counted by Spark from labelled samples: the values that the
fixed forms find, and the other words of the same bounded set of documents. A
unbroken token of 16 or more characters is a secret if the log-likelihood ratio of the two models
over its characters reaches a fixed value.

Everything is a DataFrame or SQL function; no Python runs on the executors. The
driver sees the counts of character pairs, at most twice 128 squared rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import free_prefix, seeded, text_or_empty
from spanloom.operators.skew import let

# Documents to learn from, at most so many with a fixed form and so many others.
TRAIN_ROWS = 2_000
SEED = 31
# The contract's forms, the group of the value, and its least length.
FORMS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
)
# The same spans as "hex" where a run is long enough, found without the many short runs.
_LONG_HEX = r"([0-9a-f]{24,})"
RANDOM = "random"
TOKEN = r"([A-Za-z0-9+/_=-]{16,})"
ORDINARY = r"[A-Za-z0-9+/_=-]{4,}"
LEAST_VALUE = 16  # characters of a value that counts as random, and of a token that is judged
LEAST_RATIO = 8.0  # natural logarithm
PRIOR = 4.0  # weight of a character's overall share in its pairs' shares
_BLOCK = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(pattern: str, group: int) -> str:
    """SQL: (s, e, v) for each match of ``pattern`` in t: code points, end exclusive, and a group.

    Text between matches and the matches' lengths add up to their places; sums
    run in blocks, so that a text with very many matches stays cheap.
    """

    r = _quoted(pattern)
    sums = let(
        "bs",
        f"transform(sequence(0, (size(ls) - 1) div {_BLOCK}), b -> slice(ls, b * {_BLOCK} + 1, {_BLOCK}))",
        let(
            "os",
            "aggregate(bs, array(0), (a, x) -> concat(a, array(a[size(a) - 1] + aggregate(x, 0, (s, y) -> s + y))))",
            "flatten(transform(bs, (x, b) -> slice(aggregate(x, array(os[b]), (a, y) -> concat(a, array(a[size(a) - 1] + y))), 2, "
            f"{_BLOCK})))",
        ),
    )
    found = let(
        "ms",
        f"regexp_extract_all(t, {r}, 0)",
        let(
            "vs",
            f"regexp_extract_all(t, {r}, {group})",
            let(
                "gs",
                f"split(t, {r}, -1)",
                let(
                    "ls",
                    "transform(ms, (m, i) -> length(gs[i]) + length(m))",
                    let("es", sums, "transform(es, (e, i) -> struct(e - length(ms[i]) as s, e as e, vs[i] as v))"),
                ),
            ),
        ),
    )
    return f"case when t rlike {r} then {found} else cast(array() as array<struct<s:int,e:int,v:string>>) end"


def base_spans(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``t`` (its text, null: empty) and ``base``: (s, k, e, kind, v) by place, then form."""

    own = free_prefix(docs.columns)
    out = docs.withColumn("t", text_or_empty(text_column))
    parts = []
    for k, (kind, pattern, group, least) in enumerate(FORMS):
        out = out.withColumn(f"{own}{kind}", F.expr(_places(_LONG_HEX if kind == "hex" else pattern, group)))
        parts.append(
            f"transform(filter({own}{kind}, x -> length(x.v) >= {least}), "
            f"x -> struct(x.s as s, {k} as k, x.e as e, '{kind}' as kind, x.v as v))"
        )
    return out.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))")).drop(*[f"{own}{kind}" for kind, *_ in FORMS])


def _samples(docs: DataFrame, id_column: str, text_column: str, rows: int) -> DataFrame:
    """(label, v): values of the fixed forms (1) and ordinary tokens (0) of a bounded set of documents."""

    text = text_or_empty(text_column)
    hit = text.rlike(_LONG_HEX) | text.rlike(FORMS[0][1]) | text.rlike("AKIA[A-Z0-9]{16}")
    keyed = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    some = [seeded(keyed.where(x), rows, SEED).select("text") for x in (hit, ~hit)]
    found = base_spans(some[0].unionByName(some[1]))
    values = found.select(F.explode("base.v").alias("v")).distinct().where(F.length("v") >= LEAST_VALUE)
    tokens = found.select(F.explode(F.expr(f"regexp_extract_all(t, {_quoted(ORDINARY)}, 0)")).alias("v"))
    # A token long enough to be judged is not its own example of an ordinary one.
    tokens = tokens.where(F.length("v") < LEAST_VALUE)
    others = tokens.distinct().join(values, "v", "left_anti")
    return values.select(F.lit(1).alias("label"), "v").unionByName(others.select(F.lit(0).alias("label"), "v"))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS) -> list[float]:
    """Log ratios of character pairs: at 128 * first + second, where first is 0 at a token's start."""

    chars = F.expr("transform(split(v, ''), c -> ascii(c))")
    pairs = _samples(docs, id_column, text_column, rows).select("label", chars.alias("c")).select(
        "label", F.explode(F.expr("zip_with(concat(array(0), c), c, (a, b) -> struct(a as a, b as b))")).alias("p")
    )
    known = pairs.where("p.b between 1 and 127").groupBy("label", "p.a", "p.b").count().collect()
    logs = []
    for label in (1, 0):
        count = {(r.a, r.b): r["count"] for r in known if r.label == label}
        single, first = [1.0] * 128, [0.0] * 128
        for (a, b), n in count.items():
            single[b] += n
            first[a] += n
        total = sum(single)
        logs.append([
            math.log((count.get((a, b), 0) + PRIOR * single[b] / total) / (first[a] + PRIOR))
            for a in range(128) for b in range(128)
        ])
    return [r - o for r, o in zip(*logs)]


def find(docs: DataFrame, ratios: list[float], text_column: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (s, k, e, kind, v), by place and kind.

    ``spans`` holds all of ``base`` and the tokens that the models call random.
    Base spans cut a token into parts, which are judged one by one. A null or
    empty text has no spans. Every input row comes back, repeated ones too; input columns
    named t, base or spans are replaced. An empty table gives an empty result.
    """

    own = free_prefix(docs.columns)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    found = base_spans(docs, text_column).withColumn(f"{own}tokens", F.expr(_places(TOKEN, 1)))

    def ratio(token: Column) -> Column:
        codes = F.transform(F.split(token["v"], ""), F.ascii)
        pairs = F.zip_with(F.concat(F.array(F.lit(0)), codes), codes, lambda a, b: F.when(b.isNotNull(), F.get(table, 128 * a + b)))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))

    cut = f"{own}tokens"
    for k in range(len(FORMS)):
        cut = _outside(cut, k)
    found = found.withColumn(f"{own}parts", F.expr(f"if(size({own}tokens) > 0 and size(base) > 0, {cut}, {own}tokens)"))
    random = F.transform(
        F.filter(f"{own}parts", lambda x: ratio(x) >= least),
        lambda x: F.struct(x["s"].alias("s"), F.lit(len(FORMS)).alias("k"), x["e"].alias("e"), F.lit(RANDOM).alias("kind"), x["v"].alias("v")),
    )
    extra = F.when(F.size(f"{own}parts") > 0, random).otherwise(F.array().cast(_KIND))
    return found.withColumn("spans", F.array_sort(F.concat("base", extra))).drop(f"{own}tokens", f"{own}parts", "t")


def _outside(parts: str, k: int) -> str:
    """SQL: what the base spans of form ``k``, which never overlap each other, leave of ``parts``."""

    start, end = "if(i = 0, x.s, hit[i - 1].e)", "if(i = size(hit), x.e, hit[i].s)"
    piece = f"struct({start} as s, {end} as e, substring(x.v, {start} - x.s + 1, {end} - {start}) as v)"
    between = let("hit", f"filter(base, b -> b.k = {k} and b.s < x.e and x.s < b.e)", f"transform(sequence(0, size(hit)), i -> {piece})")
    return f"filter(flatten(transform({parts}, x -> {between})), x -> x.s < x.e)"


_KIND = "array<struct<s:int,k:int,e:int,kind:string,v:string>>"
