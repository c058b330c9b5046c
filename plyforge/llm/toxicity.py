"""Toxicity by weak supervision: many noisy voters, a generative model of them, and a linear classifier on its posteriors.

1. Voters. Lexicon voters fire on a word (SEED_WORDS, and words that the labelled rows of the training fold point at),
   pattern voters on the first letters of a word (as mined), on shouting, on insults close together, on no insult at all.
2. Generative label model (numpy, on the driver, over a sample of MOST_LABELLED rows at most): expectation maximisation of
   the voters' class-conditional firing rates, in which a row's given label is one more voter of accuracy LABEL_ACCURACY;
   correlations of voters given the class are estimated from the residuals, and a voter's log-odds are divided by how many
   others it repeats.
3. A logistic regression on the counts behind the votes, fitted to the posteriors, scores every whole text.

Only rows of ``labels`` with crc32(doc_id as text) mod FOLDS not 0 are learnt from. Labels, language, source and doc_id are
never inputs of a score.

Handling of odd input: a null text counts as empty and is scored as such; labels without a doc_id or class are ignored,
of several labels of a doc_id the largest counts; repeated rows are scored each; a null doc_id is scored and never held
out; with no labelled row of one class the seed words alone decide; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import common

FOLDS, MOST_LABELLED, MOST_VOTERS, LEAST_ROWS, LABEL_ACCURACY = 5, 20_000, 800, 3, 0.98
PREFIXES = (4, 5, 6, 7)
KNOWN_WORDS = 300_000

#: English insults (fixed values): voters that need no labels.
SEED_WORDS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "crap", "damn", "despicable", "disgusting", "dumb", "filth", "fool", "fuck", "garbage",
    "hate", "idiot", "idiotic", "imbecile", "loser", "moron", "pathetic", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless",
)

_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SHOUT, _BANGS = re.compile(r"[A-ZÀ-ÞĀ-Ž]{3,}"), re.compile(r"!{2,}")
#: Columns of the pattern voters, after the counted ones.
PATTERNS = ("share", "distinct", "hits", "none", "shouting", "bangs", "length")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TO_WORDS).split()


def parts_of(word: bytes) -> list[str]:
    """What may vote for a word: itself, and its first letters."""
    text = word.decode("utf-8", "replace")
    return [text, *(text[:n] + "*" for n in PREFIXES if len(text) > n)]


class Voters:
    """Counts of a text: hits of each voter, then PATTERNS."""

    class _Known(dict):
        def __init__(self, of):
            self.of = of

        def __missing__(self, word):
            found = tuple(self.of[p] for p in parts_of(word) if p in self.of)
            if len(self) > KNOWN_WORDS:
                self.clear()
            self[word] = found
            return found

    def __init__(self, names: list[str]):
        self.names = names
        self.known = self._Known({n: i for i, n in enumerate(names)})

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """(voters that fire, their counts, pattern values)."""
        words = words_of(text)
        fired = [x for x in map(self.known.__getitem__, words) if x]
        ids, counts = np.unique(np.array([i for x in fired for i in x], np.int64), return_counts=True)
        hits, n = len(fired), len(words)
        distinct = len(set(fired))
        shout = sum(map(len, _SHOUT.findall(text))) / max(1, len(text)) if text else 0.0
        return ids, counts, [100 * hits / max(1, n), float(np.log1p(distinct)), float(np.log1p(hits)), float(hits == 0), shout, float(np.log1p(len(_BANGS.findall(text)))), float(np.log1p(n)) / 10]


def training_fold() -> F.Column:
    return F.expr(f"crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} <> 0")


def sampled_labels(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, toxic): at most ``most`` labelled rows of the training fold, those of the least hash."""
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    return found.where(training_fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


@common.task("toxicity")
def _mined(batches):
    """Rows of each class that have a word or prefix, summed within the task as far as memory allows."""
    counts: dict[str, list[int]] = {}

    def flush():
        names = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[n][1] for n in names], pa.int64()), pa.array([counts[n][0] for n in names], pa.int64())], names=["name", "bad", "good"])
        counts.clear()
        return out

    for batch in batches:
        for part in common.slices(batch, "text"):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                for name in {p for w in set(words_of(text)) for p in parts_of(w)}:
                    counts.setdefault(name, [0, 0])[toxic] += 1
            if len(counts) > 400_000:
                yield flush()
    if counts:
        yield flush()


def mined_voters(rows: DataFrame, n_bad: int, n_good: int) -> list[str]:
    """Words and prefixes whose rate among toxic rows stands above that among the others by many standard errors."""
    counts = rows.mapInArrow(_mined, "name string, bad long, good long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    strong = counts.where(F.col("bad") >= LEAST_ROWS).withColumn("z", odds / error).where((F.col("z") > 1.5) & (odds > 1.5)).orderBy(F.desc("z"), F.desc("bad"), "name").limit(MOST_VOTERS)
    return [r["name"] for r in strong.select("name").collect()]


def _votes(names: list[str]):
    @common.task("toxicity")
    def run(batches):
        voters = Voters(names)
        for batch in batches:
            for part in common.slices(batch, "text"):
                made = [voters(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.float64()))], names=["toxic", "ids", "counts", "patterns"])

    return run


def _blocks(n: int, size: int = 2000):
    return [slice(at, min(n, at + size)) for at in range(0, n, size)]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Posterior of class 1 for each row. votes: 0/1 by row and voter; labels: 0/1, or -1 where none is given."""
    n, m = votes.shape
    given = np.where(labels < 0, 0.0, (2 * labels - 1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)))
    # A start that breaks the symmetry of the classes: the labels, and voters firing at all.
    post = np.where(labels < 0, np.clip(votes.mean(1) * 4, 0.02, 0.9), np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY))
    share = np.ones(m)
    for turn in range(rounds):
        fired = np.vstack([post, 1 - post]) @ votes
        bad = (fired[0] + 0.2) / (post.sum() + 2)
        good = (fired[1] + 0.2) / ((1 - post).sum() + 2)
        prior = np.log((post.sum() + 1) / ((1 - post).sum() + 1))
        if turn == rounds // 2 and m:
            # Correlations given the class: residuals of the votes against their expected rates.
            both = np.zeros((m, m))
            for rows in _blocks(n):
                rest = votes[rows] - (post[rows, None] * bad + (1 - post[rows, None]) * good)
                both += rest.T @ rest
            scale = np.sqrt(np.diag(both) + 1e-9)
            share = 1 / np.clip(both / scale[:, None] / scale, 0, 1).sum(1)
        fires, silent = np.log(bad / good) * share, np.log((1 - bad) / (1 - good)) * share
        score = prior + given + votes @ (fires - silent).astype(np.float32) + silent.sum()
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, by Newton steps; the last weight is the intercept."""
    d = x.shape[1]
    w, keep = np.zeros(d + 1), np.full(d + 1, ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        grad, curve = keep * w, np.diag(keep)
        for rows in _blocks(len(x)):
            part = np.hstack([x[rows], np.ones((rows.stop - rows.start, 1), x.dtype)]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            grad += part.T @ (p - y[rows])
            curve += (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 5 / max(5e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Voter names and weights; small (MOST_VOTERS), so it travels with the tasks."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scorer(self):
        voters, m = Voters(self.names), len(self.names)
        per_voter, per_pattern, start = self.weights[:m], self.weights[m:-1], self.weights[-1]

        def score(text: str) -> float:
            ids, counts, patterns = voters(text)
            z = start + float(per_voter[ids] @ np.log1p(counts)) + float(per_pattern @ np.array(patterns))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``docs`` holds the texts of the labelled rows (and others, which are passed over)."""
    chosen = common.saved(sampled_labels(labels), "labels")
    rows = common.saved(common.id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")  # MOST_LABELLED rows at most on the broadcast side
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    names = list(SEED_WORDS)
    if seen.get(0) and seen.get(1):
        names += [n for n in mined_voters(rows, seen[1], seen[0]) if n not in SEED_WORDS]
    else:
        # Nothing to learn from: each insult word counts, and a text without any is clean.
        weights = np.zeros(len(names) + len(PATTERNS) + 1)
        weights[: len(names)], weights[-1] = 4.0, -3.0
        return Model(names, weights)
    got = rows.mapInArrow(_votes(names), "toxic int, ids array<long>, counts array<long>, patterns array<double>").toArrow()
    m = len(names)
    # Single precision, filled in place: MOST_LABELLED x (MOST_VOTERS + patterns) values at most.
    x = np.zeros((got.num_rows, m + len(PATTERNS)), np.float32)
    for i, (ids, counts, patterns) in enumerate(zip(*(got.column(c) for c in ("ids", "counts", "patterns")), strict=True)):
        x[i, ids.values.to_numpy()] = np.log1p(counts.values.to_numpy())
        x[i, m:] = patterns.values.to_numpy()
    y = got.column("toxic").to_numpy()
    share, distinct, hits, none, shout, bangs = (x[:, m + i] for i in range(6))
    votes = np.empty((len(x), m + 6), np.float32)
    votes[:, :m] = x[:, :m] > 0
    votes[:, m:] = np.column_stack([share >= 0.7, distinct > np.log1p(1.5), hits > np.log1p(2.5), none == 1, shout > 0.3, bangs > 0])
    return Model(names, logistic(x, label_model(votes, y)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, one row per row of ``docs``."""

    @common.task("toxicity")
    def run(batches):
        score = model.scorer()
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(score, part.column("text").to_pylist())), pa.float64())], names=["doc_id", "score"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """``docs`` whose score is below ``most``, all columns kept; nothing is shuffled."""

    @common.task("toxicity")
    def run(batches):
        score = model.scorer()
        for batch in batches:
            for part in common.slices(batch, text_col):
                yield part.filter(pa.array([score(t or "") < most for t in part.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", F.coalesce(~training_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
