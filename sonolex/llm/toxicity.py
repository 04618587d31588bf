"""Toxicity: a logistic classifier that is regularised with counterfactuals.

Features are the presence of words and of their first 4, 5 and 6 letters, hashed. The ones that tell the labels apart best (by
the log-likelihood ratio, over the whole sample) are kept, ``KEPT`` of them, with all those of identity terms. Every sentence of the
labelled texts that names a group is swapped: its identity terms move on by one place in their line, by two, and so on, so each term stands for every
other of its kind once. The fit penalises the squared change of the text's score under each such swap, so that the mention of a group says
nothing by itself, whichever it is.

Fitting takes a bounded sample of labelled rows, ``SAMPLE`` by the hash of their ids; scoring covers whole texts and all rows.

Defined results: null and empty texts get the score of a text without features; if all labels are alike, every score is the smoothed share of
label 1, a third without any label; rows with several labels count with each; repeated rows are scored each, and so are rows without an
id, which have no label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, lists, pieces, prepare

SAMPLE, KEPT, BITS, PENALTY, RIDGE, STEPS = 20_000, 1024, 26, 1.0, 1e-3, 400
_EDGE = ".,;:!?\"'()[]{}<>-_*#&%$/\\|«»„“”‘’…"

#: Identity terms, a kind to a line; a swap stays within its line.
IDENTITIES = [
    "women men girls boys females males",
    "woman man girl boy female male",
    "muslims christians jews hindus buddhists atheists catholics",
    "muslim christian jewish hindu buddhist atheist catholic",
    "black white asian latino african european arab",
    "gay straight lesbian heterosexual bisexual transgender",
    "immigrants foreigners refugees natives citizens",
    "frauen männer mädchen jungen",
    "muslime christen juden ausländer flüchtlinge",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs immigrés réfugiés",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos inmigrantes refugiados",
]
LINES = [line.split() for line in IDENTITIES]
PLACE = {w: (k, i) for k, line in enumerate(LINES) for i, w in enumerate(line)}
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


@lru_cache(maxsize=50_000)
def _features(word: str) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return tuple({zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in (word, *(f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n))})


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words without punctuation around them."""
    return {w.strip(_EDGE) for w in set((text or "").lower().split())} - {""}


def features(found: set[str]) -> list[int]:
    return sorted({f for w in found for f in _features(w)})


def swaps(text: str | None) -> list[tuple[set[int], set[int]]]:
    """For each sentence that names a group and each swap of it: the features that the text gains, and those that it loses."""
    sentences = [words_of(x) for x in _SENTENCE.split(text or "")]
    named = [i for i, found in enumerate(sentences) if any(w in PLACE for w in found)]
    out: dict[tuple, tuple[set[int], set[int]]] = {}
    counts: dict[str, int] = {}
    for found in sentences if named else ():
        for w in found:
            counts[w] = counts.get(w, 0) + 1
    own: dict[int, int] = {}  # in how many of the text's words a feature is
    for w in counts:
        for f in _features(w):
            own[f] = own.get(f, 0) + 1
    for i in named:
        terms = sorted(w for w in sentences[i] if w in PLACE)
        for by in range(1, max(len(LINES[PLACE[w][0]]) for w in terms)):
            new = {LINES[k][(j + by) % len(LINES[k])] for k, j in map(PLACE.get, terms)} - sentences[i]
            old = {w for w in terms if counts[w] == 1}  # said elsewhere too, the text keeps it
            new = {w for w in new if w not in counts}
            lost, gained = [f for w in old for f in _features(w)], {f for w in new for f in _features(w)}
            gone = {f for f in lost if own[f] <= lost.count(f)}
            if gained - set(own) or gone - gained:
                out[tuple(sorted(old)), tuple(sorted(new))] = (gained - set(own), gone - gained)
    return list(out.values())


def _sampled(batches):
    """(y, features) of each text, and (plus, minus) of each of its swaps, in flat lists with their borders."""
    for part in pieces(batches, 1 << 20):
        rows = []
        for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist()):
            rows.append((y, True, features(words_of(text)), []))
            rows += [(None, False, sorted(plus), sorted(minus)) for plus, minus in swaps(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (2, 3))], ["y", "own", "f", "g"])


def fit(rows: list[tuple[int, list[int], int]], pairs: list[tuple[list[int], list[int]]], n: int, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam from rows (label, features, how many there are) and swaps (features gained, features lost)."""
    y, many = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], float)
    share = ((y * many).sum() + 0.5) / (many.sum() + 1.5)
    bias, w = float(np.log(share / (1 - share))), np.zeros(n)
    if not len(y) or y.min() == y.max():
        return w, bias

    def sparse(which):
        return np.repeat(np.arange(len(which)), [len(x) for x in which]), np.array([f for x in which for f in x], np.int64)

    r1, c1 = sparse([r[1] for r in rows])
    (r2, c2), (r3, c3) = sparse([p[0] for p in pairs]), sparse([p[1] for p in pairs])
    grad_m, grad_v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        s = bias + np.bincount(r1, w[c1], len(rows))
        err = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * many / many.sum()
        g = np.bincount(c1, err[r1], n) + ridge * w
        if pairs:
            gap = (np.bincount(r2, w[c2], len(pairs)) - np.bincount(r3, w[c3], len(pairs))) * 2 * penalty / len(pairs)
            g += np.bincount(c2, gap[r2], n) - np.bincount(c3, gap[r3], n)
        full = np.append(g, err.sum())
        grad_m = 0.9 * grad_m + 0.1 * full
        grad_v = 0.99 * grad_v + 0.01 * full**2
        move = 0.1 * (grad_m / (1 - 0.9**t)) / (np.sqrt(grad_v / (1 - 0.99**t)) + 1e-8)
        w -= move[:n]
        bias -= float(move[n])
    return w, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, penalty: float = PENALTY):
    """({feature: weight}, bias) from ``sample`` labelled rows."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "toxicity")
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y is not null and id is not null")
    chosen = scratch.save(chosen.orderBy(F.xxhash64("id"), "id", "y").limit(sample), "chosen")  # at most ``sample`` pairs of numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    rows = scratch.save(rows.mapInArrow(_sampled, "y int, own boolean, f array<int>, g array<int>"), "rows")
    total = {r["y"]: r["n"] for r in rows.where("own").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n = total.get(1, 0), sum(total.values())
    seen = rows.where("own").select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).where("n >= 3")
    # log-likelihood ratio of the feature's presence and the label
    term = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    a, b = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    p, m = n1 / max(n, 1), F.col("n").cast("double")
    ratio = term(a, m * p) + term(b, m * (1 - p)) + term(F.lit(float(n1)) - a, (n - m) * p + 1e-9) + term(F.lit(float(n - n1)) - b, (n - m) * (1 - p) + 1e-9)
    best = [r["f"] for r in seen.select("f", ratio.alias("g")).orderBy(F.desc("g"), "f").limit(KEPT).collect()] if 0 < n1 < n else []
    kept = {f: i for i, f in enumerate(sorted({*best, *features(set(PLACE))}))}
    small = F.lit(list(kept)).cast("array<int>")
    part = rows.select("y", "own", F.array_intersect("f", small).alias("f"), F.array_intersect("g", small).alias("g"))
    data = part.where("own").groupBy("y", F.array_sort("f").alias("f")).agg(F.count("*").alias("n"))
    # equal rows once, with their number; swaps likewise: no more than ``sample`` labels ask for
    texts = sorted((r["y"], [kept[f] for f in r["f"]], r["n"]) for r in data.collect())
    turned = part.where("not own and (size(f) > 0 or size(g) > 0)").select(F.array_sort("f").alias("f"), F.array_sort("g").alias("g")).distinct()
    turned = sorted(([kept[f] for f in r["f"]], [kept[f] for f in r["g"]]) for r in turned.collect())
    w, bias = fit(texts, turned, len(kept), penalty)
    scratch.drop("rows", "chosen")
    return {f: float(w[i]) for f, i in kept.items()}, bias


def _scores(shared, keep_text: bool):
    def run(batches):
        weight, bias = shared.value
        memory: dict[str, tuple[int, ...]] = {}
        for part in pieces(batches, 1 << 20):
            total = []
            for text in part.column("text").to_pylist():
                found: set[int] = set()
                for w in set((text or "").lower().split()):
                    own = memory.get(w)
                    if own is None:
                        own = tuple(f for f in _features.__wrapped__(w.strip(_EDGE)) if f in weight)
                        if len(memory) < 200_000:
                            memory[w] = own
                    if own:
                        found.update(own)
                total.append(sum(weight[f] for f in sorted(found)))
            score = 1 / (1 + np.exp(-np.clip(np.array(total) + bias, -30, 30)))
            rest = [c for c in part.schema.names if c != "text" or keep_text]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(score)], [*rest, "__score"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, higher where label 1 is likelier."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), False), f"id {kind}, __score double")
    return out.select(F.col("id").alias(id_col), F.col("__score").alias("score"))


def without_toxic(docs: DataFrame, model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the limit; scored in place, without a join."""
    prepare(docs.sparkSession)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" if c != text_col else "text" for i, c in enumerate(names)])
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    out = rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), True), f"{schema}, __score double")
    return out.where(F.col("__score") < limit).drop("__score").toDF(*names)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
