"""URL filters: host/path rules first, then boosted trees on lexical features.

All of it is DataFrame expressions.  The trees are fitted from histograms that Spark
aggregates over a bounded, staged sample of labelled URLs; a fitted model is one nested
``CASE`` expression, so scoring is a projection without shuffle or Python.

Suffix statistics are the smoothed share of blocked URLs for the host's last one, two and three labels.
A labelled URL's own label is taken out of its statistics (leave one out), so that the trees learn what
they say about other URLs.  A fifth of the sample is kept back to place the verdict: the margin moves so
that 0.5 is where blocked and allowed URLs are told apart best, each kind counting alike, whatever
their shares are.

Defined results: a null URL, or one without ``://``, has an empty host and path; an empty
table gives an empty result; repeated rows are judged alike; other columns pass through
(``with_verdict`` only adds the columns named in its docstring, replacing same-named ones).
With no labelled URL, or labels of one kind only, the method's verdict is ``allow``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled import lowest_hashes
from gridloom.staging import stage

#: The production rule list, (action, host suffix + path prefix).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Labelled URLs that the trees are fitted on, at most (the lowest hashes of the URL).
SAMPLE_ROWS = 20_000
#: Slots of the hashed suffix table; its size bounds what is broadcast.
SUFFIX_SLOTS = 1 << 14
LABELS = (1, 2, 3)  # of the host's end
SMOOTH = 10.0  # URLs of the usual share that every suffix starts with

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = _LOWER + "0123456789" + "-._~/?&=%+:@"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _rule_fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, prefix = rule.partition("/")
    at_host = (host == name) | F.endswith(host, F.lit(f".{name}"))
    return at_host & F.startswith(path, F.lit(slash + prefix))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule, or null."""
    longest_first = sorted(rules, key=lambda r: -len(r[1]))
    return F.coalesce(F.lit(None).cast("string"), *(F.when(_rule_fits(host, path, r), F.lit(r)) for _, r in longest_first))


def rule_action(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    return reduce(lambda c, r: c.when(rule == r[1], F.lit(r[0])), rules, F.when(F.lit(False), F.lit(""))).otherwise(None)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits over a fixed alphabet, other characters as one symbol: linear in the text."""
    total = F.greatest(F.length(text), F.lit(1)).cast("double")
    counts = [_count_of(text, c) for c in _ALPHABET]
    counts.append(F.length(F.translate(text, _ALPHABET, "")))
    share = F.transform(F.array(*counts), lambda n: n / total)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))


def lexical_features(url: Column) -> dict[str, Column]:
    """Name → double column; all depend on the URL's characters alone."""
    text = F.lower(F.coalesce(url, F.lit("")))
    host, path, length = host_of(url), path_of(url), F.length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    whole = F.greatest(length, F.lit(1))
    columns = {
        "url_length": length,
        "host_length": F.length(host),
        "host_labels": _count_of(host, "."),
        "longest_run": F.length(F.regexp_extract(host, r"([^.]*)\.[^.]*$", 1)),
        "path_depth": _count_of(path, "/"),
        "path_length": F.length(path),
        "digit_ratio": _count_of(text, "0123456789") / whole,
        "host_digits": _count_of(host, "0123456789"),
        "hyphens": _count_of(host, "-"),
        "entropy": _entropy(text),
        "parameters": F.when(query == "", 0).otherwise(_count_of(query, "&") + 1),
        "fragment": F.instr(text, "#") > 0,
        "escapes": _count_of(text, "%"),
    }
    return {k: c.cast("double") for k, c in columns.items()}


def _suffix_slots(host: Column) -> Column:
    """The slots of the host's last one, two and three labels."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(k), F.substring_index(host, ".", -k)), F.lit(SUFFIX_SLOTS)).cast("int") for k in LABELS))


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """``slot, n, blocked`` over all labelled URLs (``host``, ``y``): at most ``SUFFIX_SLOTS`` rows, whatever the input."""
    return labelled.select(F.explode(_suffix_slots(F.col("host"))).alias("slot"), "y").groupBy("slot").agg(F.count("*").alias("n"), F.sum("y").alias("blocked"))


@dataclass
class Tree:
    """One node: either a leaf value or ``feature < threshold`` with two subtrees."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def column(self) -> Column:
        if self.feature is None or self.low is None or self.high is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) < F.lit(self.threshold), self.low.column()).otherwise(self.high.column())

    def leaves(self) -> list[Tree]:
        return [self] if self.low is None else self.low.leaves() + self.high.leaves()

    def leaf_index(self) -> Column:
        """The position, in ``leaves()``, of the leaf a row falls into."""
        numbered = {id(x): i for i, x in enumerate(self.leaves())}

        def walk(node: Tree) -> Column:
            if node.low is None:
                return F.lit(numbered[id(node)])
            return F.when(F.col(node.feature) < F.lit(node.threshold), walk(node.low)).otherwise(walk(node.high))

        return walk(self)


@dataclass
class UrlModel:
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    suffixes: DataFrame | None = None
    prior: float = 0.5

    def margin(self) -> Column:
        return reduce(lambda a, t: a + t.column(), self.trees, F.lit(float(self.base)))

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))


def _with_features(df: DataFrame, suffixes: DataFrame, prior: float, own: Column | None = None) -> DataFrame:
    """``df`` (with ``__url``) and the feature columns, prefixed ``__f_``; ``own``: the row's label, to be left out of its statistics."""
    out = df.withColumns({f"__f_{k}": c for k, c in lexical_features(F.col("__url")).items()})
    out = out.withColumn("__slots", _suffix_slots(host_of(F.col("__url"))))
    gone = F.lit(0.0) if own is None else own
    one = F.lit(0.0 if own is None else 1.0)
    for i, k in enumerate(LABELS):
        small = suffixes.select(F.col("slot").alias("__slot"), F.col("n").alias("__n"), F.col("blocked").alias("__blocked"))
        out = out.join(F.broadcast(small), F.get("__slots", F.lit(i)) == F.col("__slot"), "left")
        n = F.greatest(F.coalesce(F.col("__n"), F.lit(0)) - one, F.lit(0.0))
        rate = (F.greatest(F.coalesce(F.col("__blocked"), F.lit(0.0)) - gone, F.lit(0.0)) + SMOOTH * prior) / (n + SMOOTH)
        out = out.withColumns({f"__f_suffix{k}_rate": rate, f"__f_suffix{k}_count": F.log1p(n)}).drop("__slot", "__n", "__blocked")
    return out.drop("__slots")


def fit(labelled: DataFrame, trees: int = 8, depth: int = 3, rate: float = 0.4, bins: int = 16, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Boosted trees with logistic loss from ``labelled`` (``url``, ``y`` = 1 for block).

    Suffix statistics cover every labelled row; the trees see the ``sample_rows`` rows of
    lowest hash of ``key`` (a hash of the whole row, so that a repeated URL is not taken or
    left as a whole), or of the URL where there is none.  Each level is one aggregation into (leaf, feature, bin) histograms, of
    which at most ``2**depth * features * bins`` rows reach the driver.
    """
    key = F.col("key") if "key" in labelled.columns else F.xxhash64("url")
    labelled = labelled.select(F.col("url").alias("__url"), host_of(F.col("url")).alias("host"), F.col("y").cast("double").alias("y"), key.alias("__key"))
    suffixes = stage(suffix_statistics(labelled), "url-suffixes")
    total = labelled.agg(F.count("*").alias("n"), F.avg("y").alias("share")).first()
    share = 0.5 if total["share"] is None else total["share"]
    sample = lowest_hashes(labelled, sample_rows, total["n"], "__key")
    featured = _with_features(sample, suffixes, share, F.col("y"))
    names = [c for c in featured.columns if c.startswith("__f_")]
    every = stage(featured.select(*names, "y", (F.pmod(F.xxhash64(F.lit(5), "__key"), F.lit(5)) == 0).alias("__back")).coalesce(1), "url-sample")
    sample = every.where("NOT __back").drop("__back")

    steps = [i / bins for i in range(1, bins)]
    edges = sample.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), *(F.percentile_approx(c, steps, 10_000).alias(c) for c in names)).first()
    n, positive = edges["n"], edges["pos"] or 0.0
    prior = positive / n if n else 0.5
    model = UrlModel(suffixes=suffixes, prior=share)
    if not n or positive in (0.0, float(n)):
        model.base = -20.0
        return model
    cuts = {c: sorted(set(edges[c])) for c in names}
    model.base = math.log(prior / (1 - prior))

    binned = F.array(*(F.struct(F.lit(i).alias("f"), reduce(lambda a, t, c=c: a + (F.col(c) >= F.lit(t)).cast("int"), cuts[c], F.lit(0)).alias("b")) for i, c in enumerate(names)))
    sample = stage(sample.withColumn("__bins", binned).coalesce(1), "url-binned").coalesce(1)
    for _ in range(trees):
        root = Tree()
        p = model.probability()
        graded = sample.withColumns({"__g": F.col("y") - p, "__h": p * (1 - p)})
        for _ in range(depth):
            _grow(graded, root, names, cuts, rate)
        model.trees.append(root)
    model.base -= _best_margin(every.where("__back"), model)
    return model


def _best_margin(back: DataFrame, model: UrlModel, width: float = 0.05, reach: float = 10.0) -> float:
    """The margin at which the share of blocked URLs above it exceeds that of allowed ones most."""
    cell = F.floor(F.greatest(F.least(model.margin(), F.lit(reach)), F.lit(-reach)) / width).cast("int").alias("cell")
    cells = sorted(tuple(r) for r in back.groupBy(cell).agg(F.sum(1 - F.col("y")).alias("allowed"), F.sum("y").alias("blocked")).collect())
    allowed, blocked = (sum(c[i] for c in cells) for i in (1, 2))
    if not allowed or not blocked:
        return 0.0
    best, at = 0.0, 0.0
    below_allowed = below_blocked = 0.0
    for (cell_, a, b), following in zip(cells, [*cells[1:], None], strict=True):
        below_allowed, below_blocked = below_allowed + a, below_blocked + b
        gain = below_allowed / allowed - below_blocked / blocked
        if following and gain > best + 1e-12:
            best, at = gain, width * (cell_ + 1 + following[0]) / 2  # halfway to the next cell that has URLs
    return at


def _grow(graded: DataFrame, root: Tree, names: list[str], cuts: dict[str, list[float]], rate: float, ridge: float = 1.0) -> None:
    """Split every leaf of ``root`` where that gains most; set leaf values."""
    cells = graded.select(root.leaf_index().alias("leaf"), "__g", "__h", F.explode("__bins").alias("cell"))
    histogram: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
    for r in cells.groupBy("leaf", "cell.f", "cell.b").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h")).collect():
        histogram.setdefault((r["leaf"], r["f"]), {})[r["b"]] = (r["g"], r["h"])
    for i, leaf in enumerate(root.leaves()):
        best = (1e-6, None, 0.0, 0.0, 0.0)
        for f, name in enumerate(names):
            bars = histogram.get((i, f))
            if not bars:
                continue
            g_all, h_all = sum(b[0] for b in bars.values()), sum(b[1] for b in bars.values())
            g = h = 0.0
            for b, cut in enumerate(cuts[name]):
                g, h = g + bars.get(b, (0.0, 0.0))[0], h + bars.get(b, (0.0, 0.0))[1]
                if h < 1.0 or h_all - h < 1.0:
                    continue
                gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all * g_all / (h_all + ridge)
                if gain > best[0]:
                    best = (gain, name, cut, rate * g / (h + ridge), rate * (g_all - g) / (h_all - h + ridge))
        if best[1] is not None:
            leaf.feature, leaf.threshold, leaf.low, leaf.high = best[1], best[2], Tree(best[3]), Tree(best[4])


def with_verdict(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` to every row.

    A fitting rule decides; else ``block`` where the trees' probability is 0.5 or more.
    Without ``model``, one is fitted on the rows that a rule labels.
    """
    named = df.drop("host", "path", "rule", "verdict", "block_score").withColumn("__url", F.col(url))
    named = named.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    named = named.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        labelled = named.where(F.col("rule").isNotNull())
        plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]  # maps can't be hashed
        keyed = labelled.withColumn("key", F.xxhash64(*(c for c in plain if c in labelled.columns)))
        model = fit(keyed.select(F.col("__url").alias("url"), (rule_action(F.col("rule"), rules) == "block").cast("int").alias("y"), "key"))
    judged = _with_features(named, model.suffixes, model.prior).withColumn("block_score", model.probability())
    verdict = F.coalesce(rule_action(F.col("rule"), rules), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    judged = judged.withColumn("verdict", verdict)
    return judged.select(*(c for c in judged.columns if not c.startswith("__")))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return with_verdict(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
