"""Quality rules as weak supervision: each rule votes good (1), bad (-1) or abstains (0) on a text.

Expectation-maximisation over the counts of vote patterns estimates how often each rule votes what on good and on bad
texts, without labels; the posterior chance of a good text replaces the demand that all rules pass. Texts enter the
fit only through counts per pattern (at most 3 ** rules rows, whatever the input), made over all documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, per_text, words_of

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
MARKS = b"!?"
#: Frequent function words of the languages served.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that for it was with as on be at by this are from or a an have not "
    b"der die das und ist von zu den mit des im ein eine nicht auf sich dem als "
    b"le la les de et un une est que des en du dans pour qui au par pas "
    b"el los las y del se con por su para no lo al una es como".split()
)

FACTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_upper bigint, n_lower bigint, n_marks bigint, n_function_words bigint"
)
FACT_NAMES = [f.split()[0] for f in FACTS.split(", ")]

#: (rule, bad when, good when); neither is an abstention. Ratios are compared in whole numbers.
RULES = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_size", "word_chars < 2 * n_words OR word_chars > 16 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    ("repeated_words", "100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    ("capitals", "n_upper > n_lower", "5 * n_upper <= n_lower"),
    ("exclamation", "5 * n_marks > n_words", "50 * n_marks <= n_words"),
    ("function_words", "n_words >= 50 AND n_function_words = 0", "20 * n_function_words >= n_words"),
)

#: Fails whatever the rules say.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    table: dict[bytes, int] = {}
    c = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    base = len(table)
    if base < 1 << 21:
        keys = (c[:-2] * base + c[1:-1]) * base + c[2:]
    else:  # three numbers would not fit into 64 bits: number the pairs first
        keys = np.unique(c[:-2] * base + c[1:-1], return_inverse=True)[1] * base + c[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(keys)] |= twice
    return int(hit.sum())


def facts_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(FACT_NAMES)
    raw, words = text.encode("utf-8", "surrogatepass"), words_of(text)
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    lines = Counter(line for line in raw.split(b"\n") if line.strip(BLANKS))
    return (
        len(words), len(text) - count(BLANKS), count(SYMBOLS), sum(lines.values()) - len(lines), repeated(words),
        sum(lines.values()), count(UPPER), count(LOWER), count(MARKS), sum(map(FUNCTION_WORDS.__contains__, words)),
    )


def _facts(texts: list[str | None]) -> list[pa.Array]:
    table = np.array([facts_of(t) for t in texts], np.int64).reshape(-1, len(FACT_NAMES))
    return [pa.array(table[:, k]) for k in range(len(FACT_NAMES))]


@dataclass
class Model:
    """The share of good texts, and each rule's chances of voting -1, 0, 1 on a bad and on a good text."""

    good: float
    votes: np.ndarray  # rules x (bad, good) x 3

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.log(self.good / (1 - self.good)) + sum(
            np.log(self.votes[j, 1, patterns[:, j] + 1] / self.votes[j, 0, patterns[:, j] + 1]) for j in range(len(self.votes))
        )
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_patterns(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> Model:
    """Expectation-maximisation from the guess that any bad vote makes a text doubtful.

    Ten made-up texts of each kind per rule keep every chance above zero, and give an empty table the prior beliefs.
    The share of good texts stays between 0.5 and 0.99, so that good names the common kind.
    """
    m = len(RULES)
    prior = np.tile(np.array([[6.0, 2.0, 2.0], [0.5, 1.5, 8.0]]), (m, 1, 1))
    counts = np.asarray(counts, float)
    patterns = np.asarray(patterns, int).reshape(-1, m)
    p = np.where((patterns < 0).any(1), 0.2, 0.95)
    model = Model(0.9, prior / prior.sum(2, keepdims=True))
    for _ in range(steps):
        votes = prior.copy()
        for j in range(m):
            for kind, weight in ((0, counts * (1 - p)), (1, counts * p)):
                votes[j, kind] += np.bincount(patterns[:, j] + 1, weight, minlength=3)
        share = float(np.clip((counts @ p + 9) / (counts.sum() + 10), 0.5, 0.99))
        model = Model(share, votes / votes.sum(2, keepdims=True))
        if np.abs((new := model.posterior(patterns)) - p).max(initial=0) < 1e-9:
            break
        p = new
    return model


def facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the facts of their whole texts; null and empty texts have zeros, columns of these names are replaced."""
    return per_text(docs, text_col, _facts, FACTS)


def votes(rows: DataFrame, name: str = "votes") -> DataFrame:
    """Facts with the array of votes, in the order of RULES."""
    return rows.withColumn(
        name,
        F.array(*[F.expr(f"CAST(CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS INT)") for _, bad, good in RULES]),
    )


def fit(rows: DataFrame) -> Model:
    """Fit on a table of votes: only one row per pattern reaches the driver."""
    seen = rows.groupBy("votes").count().collect()
    return fit_patterns(np.array([r["votes"] for r in seen]), np.array([r["count"] for r in seen]))


def judge(docs: DataFrame, model: Model | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with their facts, votes, posterior, base_failed and kept; columns of these names are replaced.

    Without a model it is fitted on the counts of all the rows. Every row is judged by its own text: null ids, ties
    and repeated rows are kept apart, null and empty texts fail the base rules, an empty table gives an empty one.
    """
    rows = votes(facts(docs.drop("votes", "posterior", "base_failed", "kept"), text_col))
    model = model or fit(votes(facts(docs.select(text_col), text_col)))
    odds = F.lit(float(np.log(model.good / (1 - model.good))))
    for j in range(len(RULES)):
        lean = np.log(model.votes[j, 1] / model.votes[j, 0])
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in lean]), F.col("votes")[j] + 2)
    return (
        rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
