"""Language identification by inferring each document's mixture of languages.

Every language has a smoothed distribution over hashed character trigrams. Expectation-
maximisation finds the proportions that best explain a document's n-grams; languages are
then dropped one at a time while a penalised likelihood (half the logarithm of the number
of n-grams per language) improves. The language with the largest share of what stays is
the prediction, its share the score.

Defined results: null or empty texts and texts without a letter are `und` with score 0, as
is every text when nothing could be learned; ties go to the language first by code point.
Training rows without language or text are left out; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipwatch.llm.common import give_back

BUCKETS = 1 << 16
SAMPLE_PER_LANG = 3000  # training documents per language, the first by a hash of the id
MODEL_CELLS = 1 << 26  # 256 MB at most; beyond 1,024 languages each has fewer buckets, none is left out
EM_ROUNDS = 10
EM_MORE = 4  # rounds after a language is dropped, from the shares before
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Bucket of every trigram of the lower-cased text, with runs of other characters than letters as one space."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    letter = letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[keep]
    mixed = code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA6B) ^ code[2:] * np.uint32(0xC2B2AE35)
    return ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)


@dataclass(frozen=True)
class LanguageModel:
    """Names in code point order and log probabilities, one row per language, a power of two of buckets."""

    names: list[str]
    logp: np.ndarray

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """(language, share, all languages kept with their shares) of a whole text."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, []
        found = np.sort(grams(text) & np.uint16(self.logp.shape[1] - 1), kind="stable")
        ends = np.append(np.flatnonzero(found[1:] != found[:-1]), len(found) - 1)
        total = len(found)
        weight = np.diff(ends, prepend=-1) / total
        logp = self.logp[:, found[ends]]
        like = np.exp(logp - logp.max(0))

        def fit(rows: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
            part = like[rows]
            for _ in range(rounds if len(rows) > 1 else 0):
                share = share * (part @ (weight / (share @ part)))
            # A text far from a language underflows; it is then as unlikely as can be told.
            return share, float(total * (weight @ np.log(np.maximum(share @ part, 1e-300))))

        rows = np.arange(len(self.names))
        share, fitted = fit(rows, np.full(len(rows), 1.0 / len(rows)), EM_ROUNDS)
        penalty = 0.5 * np.log(total)
        while len(rows) > 1:
            fewer = np.delete(np.arange(len(rows)), int(np.argmin(share)))
            small, less = fit(rows[fewer], share[fewer] / share[fewer].sum(), EM_MORE)
            if less < fitted - penalty:
                break
            rows, share, fitted = rows[fewer], small, less
        best = int(np.argmax(share))
        return (
            self.names[rows[best]],
            float(min(1.0, share[best] / share.sum())),
            [(self.names[r], float(s)) for r, s in zip(rows, share, strict=True)],
        )


def learn_languages(
    rows: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id",
    sample_per_lang: int = SAMPLE_PER_LANG, cells: int = MODEL_CELLS,
) -> LanguageModel:
    """N-gram distributions of a bounded sample of labelled rows.

    The sample takes the first `sample_per_lang` rows of each language by a hash of `order`;
    the n-grams are counted on the cluster. Every label is learned; the model has no more than `cells`
    numbers as long as 16 buckets a language fit.
    """
    labelled = rows.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(order).alias("h")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull()
    )
    counts = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()
    names = sorted(r["l"] for r in counts)
    if not names:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32))
    buckets = min(BUCKETS, max(16, 1 << (max(1, cells // len(names)).bit_length() - 1)))
    # Hashes are uniform, so a threshold by each language's count gives about twice the sample; the cut is exact below.
    share = {r["l"]: min(1.0, 2.0 * sample_per_lang / r["n"] + 64.0 / r["n"]) for r in counts}
    reach = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, min(2**63 - 1, int((2.0 * v - 1.0) * 2**63)))])
    chosen = labelled.filter(F.col("h") <= reach[F.col("l")])
    limit = F.row_number().over(Window.partitionBy("l").orderBy("h", F.length("t"), "t"))
    sample = chosen.withColumn("r", limit).filter(F.col("r") <= sample_per_lang).select("l", "t")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for name, t in zip(part["l"], part["t"], strict=True):
                own = sums.setdefault(name, np.zeros(buckets, np.int64))
                own += np.bincount(grams(t) & np.uint16(buckets - 1), minlength=buckets)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"l": name, "g": at, "n": own[at]})
        sums.clear()
        give_back()

    tables = np.zeros((len(names), buckets), np.float32)
    place = {name: k for k, name in enumerate(names)}
    totals = (
        sample.mapInPandas(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
        .groupBy("l").agg(F.collect_list("g").alias("g"), F.collect_list("n").alias("n"))
    )
    for r in totals.toLocalIterator():
        tables[place[r["l"]], r["g"]] = r["n"]
    tables += 0.5
    tables /= tables.sum(1, keepdims=True, dtype=np.float64)
    return LanguageModel(names, np.log(tables, out=tables))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred, score and lang_mix (every language kept, with its share); other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_mix array<struct<lang string, share double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in parts:
            found = [own.infer(t) for t in texts]
            yield pd.DataFrame(
                {
                    "lang_pred": [x[0] for x in found],
                    "score": [x[1] for x in found],
                    "lang_mix": [[{"lang": a, "share": b} for a, b in x[2]] for x in found],
                }
            )
        give_back()

    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "lang_mix")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    made = docs.select(*kept, run(F.col(f"`{text}`")).alias("_mix"))
    return made.select(*kept, *[F.col(f"_mix.{x}").alias(n) for x, n in zip(("lang_pred", "score", "lang_mix"), names, strict=True)])

