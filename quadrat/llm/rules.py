"""Quality rules as a learned decision list, in DataFrame operations alone.

Every text gets a few statistics. From rows with a 0/1 label, sequential covering learns an ordered
list of rules, each a conjunction of thresholds on those statistics that marks low quality: a rule
grows by the threshold with the greatest information gain on one part of the rows, loses its last
thresholds as long as that helps on the other part, and the rows it covers leave before the next
rule is sought. The list becomes one conditional expression; the first rule that holds rejects.

The sample for learning is bounded (``SAMPLE``); the search sees it only as counts per statistic and
bin, summed by Spark. All rows are judged in a single pass without a shuffle.

Defined results: a null text counts as empty. Statistics of a text without words are 0, and so no
rule needs to treat them apart. Without labels of both kinds no rule is learned and all rows pass.
Repeated rows and ids are judged row by row. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import SPACE, free_names, stored

#: At most this many labelled rows are used for learning (those with the smallest hash of the id).
SAMPLE = 20_000
#: Thresholds tried per statistic, conditions per rule, rules per list.
BINS, CONDITIONS, RULES = 48, 3, 12
#: A rule must be right this often on the rows kept for pruning.
PRECISION = 0.85

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "mean_word", "symbols_per_word", "dup_lines_per_line", "repeated_share", "distinct_share",
    "capitals_share", "shouts_per_word", "stops_per_word", "words_per_line",
)


@dataclass(frozen=True)
class Condition:
    """``statistic <= bound`` or ``statistic > bound``."""

    statistic: str
    above: bool
    bound: float

    def holds(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.statistic)
        return c > F.lit(self.bound) if self.above else c <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Append the statistics of a text column, each name with ``prefix``.

    ``n_repeat_words`` counts the words that stand in a window of three words which occurs at least
    twice; windows are compared by a 64-bit hash. They are sorted with their positions, so a very
    long text costs n log n.
    """
    kept = df.columns
    if clash := {c.lower() for c in kept} & {(prefix + n).lower() for n in BASE + RATIOS}:
        raise ValueError(f"columns exist already: {sorted(clash)}; choose another prefix")
    body, hashes, windows, lines = free_names(kept, "body", "hashes", "windows", "lines")
    get = F.get
    out = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body))
    word_list = F.filter(F.split(body, SPACE), lambda w: w != "")
    line_list = F.filter(F.split(body, "\n"), lambda w: F.length(F.translate(w, " \t\n\x0b\f\r", "")) > 0)
    out = out.select(
        "*",
        F.transform(word_list, lambda w: F.xxhash64(w)).alias(hashes),
        F.transform(line_list, lambda w: F.xxhash64(w)).alias(lines),
    )
    h, n = F.col(hashes), F.size(hashes)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    out = out.select(
        "*",
        F.array_sort(
            F.transform(
                starts,
                lambda i: F.struct(F.xxhash64(get(h, i), get(h, i + 1), get(h, i + 2)).alias("w"), i.alias("i")),
            )
        ).alias(windows),
    )
    s = F.col(windows)
    twice = F.filter(
        s, lambda x, k: x["w"].eqNullSafe(get(s, k - 1)["w"]) | x["w"].eqNullSafe(get(s, k + 1)["w"])
    )
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")
        ),
        lambda a: a["n"],
    )
    t = F.col(body)
    base = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")),
        "n_symbols": _removed(t, "#*$%&|<>"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
    }
    more = free_names(kept, "n_lines", "n_distinct", "n_capitals", "n_shouts", "n_stops")
    counts = (
        F.size(lines), F.size(F.array_distinct(h)), _removed(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _removed(t, "!"), _removed(t, ".,;:?"),
    )
    out = out.select(
        *[F.col(f"`{c}`") for c in kept],
        *[c.cast("long").alias(prefix + name) for name, c in base.items()],
        *[c.cast("long").alias(name) for name, c in zip(more, counts, strict=True)],
    )
    b = {name: F.col(prefix + name).cast("double") for name in BASE}
    n_lines, n_distinct, n_capitals, n_shouts, n_stops = (F.col(c).cast("double") for c in more)

    def share(x: Column, of: Column) -> Column:
        return F.when(of > 0, x / of).otherwise(F.lit(0.0))

    ratios = (
        share(b["word_chars"], b["n_words"]), share(b["n_symbols"], b["n_words"]),
        share(b["n_dup_lines"], n_lines), share(b["n_repeat_words"], b["n_words"]),
        share(n_distinct, b["n_words"]), share(n_capitals, b["word_chars"]),
        share(n_shouts, b["n_words"]), share(n_stops, b["n_words"]), share(b["n_words"], n_lines),
    )
    (made,) = free_names(out.columns, "made")
    fields = [F.col(prefix + n).alias(n) for n in BASE] + [c.alias(n) for n, c in zip(RATIOS, ratios, strict=True)]
    # a generator of one row: conditions on the statistics stay above it, where they are columns, instead of
    # being pushed down as ever longer copies of the expressions
    once = out.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(F.struct(*fields))).alias(made))
    return once.select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(made)[n].alias(prefix + n) for n in BASE + RATIOS]
    )


def base_failed(prefix: str = "") -> Column:
    """Too short, or more than half of the words stand in repeated windows."""
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


def labelled_sample(df: DataFrame, labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``df`` with their label; ids with several labels take the least.

    The ids are chosen first, by hash, and are few enough to travel to the texts.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(limit)
    )
    return df.join(F.broadcast(chosen), F.col(f"`{key}`") == F.col("_key"), "inner").drop("_key")


def learn(sample: DataFrame, label: str, statistics: tuple[str, ...] = BASE[:1] + RATIOS) -> list[Rule]:
    """Learn the list from rows with statistics and a 0/1 label (0 is what the rules look for)."""
    edges_row = sample.agg(
        *[F.percentile_approx(s, [k / BINS for k in range(1, BINS)], 2000).alias(s) for s in statistics]
    ).first()
    if edges_row is None or any(edges_row[s] is None for s in statistics):
        return []
    edges = {s: sorted(set(map(float, edges_row[s]))) for s in statistics}

    def binned(s: str) -> Column:
        """Number of edges below the value: 0 for values up to the first edge."""
        e = F.array(*[F.lit(x) for x in edges[s]])
        return F.size(F.filter(e, lambda x: F.col(s) > x))

    part = F.pmod(F.xxhash64(*statistics, F.lit("part")), F.lit(3)) == 0
    rows = stored(
        sample.select(
            F.col(label).cast("int").alias("y"), part.alias("pruning"), *[binned(s).alias(s) for s in statistics]
        ).groupBy("y", "pruning", *statistics).agg(F.count("*").alias("n")),
        "rule-bins",
    )

    def holds(rule) -> Column:
        cond = F.lit(True)
        for s, above, k in rule:
            cond = cond & (F.col(s) > k if above else F.col(s) <= k)
        return cond

    left = F.lit(True)
    out: list[Rule] = []
    while len(out) < RULES:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < CONDITIONS:
            best = _best(rows.where(left & holds(rule) & ~F.col("pruning")), statistics, edges)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        got = rows.where(left & F.col("pruning")).agg(
            *[
                F.coalesce(F.sum(F.when(holds(r) & (F.col("y") == y), F.col("n"))), F.lit(0)).alias(f"c{k}_{y}")
                for k, r in enumerate(prefixes)
                for y in (0, 1)
            ]
        ).first()
        worth = [((got[f"c{k}_0"] + 1) / (got[f"c{k}_0"] + got[f"c{k}_1"] + 2), got[f"c{k}_0"], -k) for k in range(len(prefixes))]
        value, hits, k = max(worth)
        if value < PRECISION or hits < 2:
            break
        rule = prefixes[-k]
        out.append(tuple(Condition(s, above, edges[s][b]) for s, above, b in rule))
        left = left & ~holds(rule)
    return out


def _best(rows: DataFrame, statistics, edges):
    """The threshold with the greatest gain over the given rows, as (statistic, above, bin)."""
    counts = rows.select(
        "y", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in statistics])).alias("x")
    ).groupBy("x.s", "x.b", "y").agg(F.sum("n").alias("n")).collect()
    table: dict[str, dict[int, list[int]]] = {}
    for r in counts:
        table.setdefault(r["s"], {}).setdefault(r["b"], [0, 0])[r["y"]] += r["n"]
    total = [sum(x[y] for x in next(iter(table.values()), {}).values()) for y in (0, 1)]
    if not total[0] or not total[1]:
        return None
    before = math.log2(total[0] / sum(total))
    best, top = None, 1e-9
    for s in sorted(table):
        low = [0, 0]
        for b in range(len(edges[s])):
            low = [low[y] + table[s].get(b, [0, 0])[y] for y in (0, 1)]
            for above, (p, q) in ((False, low), (True, [total[y] - low[y] for y in (0, 1)])):
                if p < 5 or p + q == sum(total):
                    continue
                gain = p * (math.log2(p / (p + q)) - before)
                if gain > top:
                    best, top = (s, above, b), gain
    return best


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """False where a rule rejects, by the first rule that holds; true where none does."""
    if not rules:
        return F.lit(True)
    case = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.holds(prefix)
        case = F.when(cond, False) if case is None else case.when(cond, False)
    return case.otherwise(True)


def judged(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
           limit: int = SAMPLE, prefix: str = "") -> DataFrame:
    """Rows with their statistics, ``base_failed`` and ``kept`` (all names with ``prefix``)."""
    slim = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    few = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l"))
    sample = with_statistics(labelled_sample(slim, few, "k", "l", limit), "t").drop("t")
    rules = learn(stored(sample, "rule-sample"), "_label")
    out = with_statistics(df, text, prefix)
    return out.select(
        "*",
        base_failed(prefix).alias(prefix + "base_failed"),
        (~base_failed(prefix) & verdict(rules, prefix)).alias(prefix + "kept"),
    )
