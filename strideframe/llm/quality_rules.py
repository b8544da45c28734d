"""Document quality: text statistics and a learned decision list.

``text_stats`` counts words, symbols, repeated lines and repeated three-word windows of whole texts in
Arrow batches. ``learn_rules`` fits an ordered list of threshold conjunctions by sequential covering:
each rule is grown condition by condition on two thirds of the labelled rows (by information gain),
pruned on the rest, and kept while it is precise enough there; rows it covers leave before the next
rule. ``verdict`` emits the list as one Spark conditional expression.

Defined results: a null or empty text has no words and fails the base rule; labels that are null are
ignored, and of several labels of a document the lowest counts; without labels of both kinds the list is
empty and keeps what passes the base rule; columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, tidy, word_hashes

SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops"]

#: What rules may test; SQL over the statistics, all finite.
FEATURES = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

_BLANKS = b"\t\n\x0b\x0c\r "
_REST = bytes(range(0x80, 0xC0))  # bytes that continue a code point


def _stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    h, lens = word_hashes(texts)
    n, docs = len(h), len(texts)
    owner = np.repeat(np.arange(docs), lens)
    repeat = np.zeros(n, bool)
    if n > 2:
        key = mix(mix(mix(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(3) + h[2:]) ^ mix(owner[:-2].astype(np.uint64) + np.uint64(1))
        whole = owner[:-2] == owner[2:]
        _, inverse, count = np.unique(key[whole], return_inverse=True, return_counts=True)
        at = np.flatnonzero(whole)[count[inverse] > 1]
        for k in range(3):
            repeat[at + k] = True
    out = {"n_words": lens, "n_repeat_words": np.bincount(owner, repeat, docs).astype(np.int64) if n else np.zeros(docs, np.int64)}
    less = lambda t, chars: len(t) - len(t.translate(None, chars))
    dup, lines = [], []
    for t in texts:
        cut = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(cut) - len(set(cut)))
        lines.append(t.count(b"\n") + 1)
    out["n_dup_lines"], out["n_lines"] = np.array(dup), np.array(lines)
    out["word_chars"] = np.array([len(t.translate(None, _BLANKS + _REST)) for t in texts])
    out["n_symbols"] = np.array([less(t, SYMBOLS) for t in texts])
    out["n_upper"] = np.array([less(t, bytes(range(65, 91))) for t in texts])
    out["n_digits"] = np.array([less(t, bytes(range(48, 58))) for t in texts])
    out["n_stops"] = np.array([less(t, b".!?") for t in texts])
    return out


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, STATS) for every row of ``docs``; statistics are of the whole text."""
    base = docs.select(id_col, *carry, F.col(text_col).alias("__text"))
    kept = [f for f in base.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{s} long" for s in STATS])

    def run(batches):
        for b in batches:
            for first, texts in pieces(b, "__text"):
                got = _stats(texts)
                yield pa.RecordBatch.from_arrays([b.column(f.name).slice(first, len(texts)) for f in kept] + [pa.array(got[s].astype(np.int64)) for s in STATS], [f.name for f in kept] + STATS)

    return base.mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.at_least else x[self.feature] < self.cut

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= F.lit(self.cut) if self.at_least else value < F.lit(self.cut)


def _covered(rule, x, n):
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x, bad, max_conditions, cuts):
    """Add the condition of the highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    hit = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (~bad & hit).any():
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for f, v in x.items():
            own = np.unique(v[hit])
            tries = own[1:] if len(own) <= cuts else np.unique(np.quantile(own, np.linspace(0, 1, cuts + 2)[1:-1]))
            order = np.sort(v[hit & bad]), np.sort(v[hit & ~bad])
            for at_least in (True, False):
                below = [np.searchsorted(o, tries, "left") for o in order]
                p1, n1 = (p - below[0], n - below[1]) if at_least else (below[0], below[1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - before), -1)
                if len(g) and g.max() > gain:
                    k = int(g.argmax())
                    gain, best = g[k], Condition(f, at_least, float(tries[k]))
        if best is None:
            break
        rule.append(best)
        hit &= best.holds(x)
    return rule


def _worth(rule, x, bad):
    hit = _covered(rule, x, len(bad))
    p, n = (bad & hit).sum(), (~bad & hit).sum()
    return (p - n) / (p + n) if p + n else -1.0


def fit_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_rows: int = 4, cuts: int = 64) -> list[list[Condition]]:
    """Sequential covering of the bad rows; deterministic in the order of the rows."""
    rules: list[list[Condition]] = []
    if not bad.any() or bad.all():
        return rules
    grow = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        part = [{f: v[m] for f, v in x.items()} for m in (left & grow, left & ~grow)]
        side = [bad[left & grow], bad[left & ~grow]]
        if not side[0].any():
            break
        rule = _grow(part[0], side[0], max_conditions, cuts)
        while len(rule) > 1 and _worth(rule[:-1], part[1], side[1]) >= _worth(rule, part[1], side[1]):
            rule = rule[:-1]
        hit = _covered(rule, x, len(bad)) & left
        if not rule or hit.sum() < min_rows or bad[hit].mean() < min_precision or _worth(rule, part[1], side[1]) < 2 * min_precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **fit) -> list[list[Condition]]:
    """A decision list from at most ``max_labelled`` labelled documents (those of the lowest id hash)."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = text_stats(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), carry=("quality",))
    got = rows.select("doc_id", "quality", *[F.expr(e).alias(f) for f, e in FEATURES.items()], base_failed().alias("__failed")).where("not __failed").toPandas()
    got = got.sort_values(["doc_id", *FEATURES]).reset_index(drop=True)
    return fit_rules({f: got[f].to_numpy(float) for f in FEATURES}, got["quality"].to_numpy() == 0, **fit)


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as a conditional expression over STATS: true keeps the document."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Statistics, base_failed and kept of every document."""
    rules = learn_rules(docs, labels, **options)
    return text_stats(docs, carry=carry).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    rows = docs.withColumns({f"__c{k}": F.col(c) for k, c in enumerate(docs.columns)}).select("doc_id", "text", *[f"__c{k}" for k in range(len(docs.columns))])
    kept = judge(rows, labels, carry=tuple(f"__c{k}" for k in range(len(docs.columns))), **options).where("kept")
    return kept.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)])
