"""Language identification with rank-order profiles.

A profile lists the most frequent n-grams (1 to 3 letters of lower-cased words, with the blanks at
their ends) in order of frequency. A document's own profile is compared with each language's by the
out-of-place distance: the sum over the document's n-grams of how far apart the two ranks are, or the
profile's size where the language lacks the n-gram. The nearest language wins; ties go to the language
whose name sorts first. The score is 1 minus the distance as a share of the largest possible one.

Null texts and texts without a letter give `und` with score 0, as do all texts where no labelled
training row exists. Texts of any length are counted whole, in bounded slices. Repeated rows are
scored each on its own; other columns are not looked at. A table without rows gives none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import texts_of, unit_hash

#: N-grams kept in a language's profile and in a document's.
PROFILE, DOC_PROFILE = 400, 300
#: About so many labelled documents of each language are learned from.
TRAIN_PER_LANG = 1_000
#: Letters counted at once.
SLICE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(codes: np.ndarray, n_starts: int) -> np.ndarray:
    """Codes of all n-grams that start at the first n_starts places; 21 bits a letter."""
    a = codes.astype(np.uint64)
    one = a[:n_starts][codes[:n_starts] != 32]
    two = a[: len(a) - 1][:n_starts] | a[1:][:n_starts] << np.uint64(21)
    m = max(0, min(n_starts, len(a) - 2))
    three = (a[:m] | a[1 : m + 1] << np.uint64(21) | a[2 : m + 2] << np.uint64(42))[codes[1 : m + 1] != 32]
    return np.concatenate([one, two, three])


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.append(first, len(grams)))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as sorted codes, and how often each occurs."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[raw], raw, 32) if len(raw) else raw
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(codes) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = [_counted(_grams(codes[i : i + SLICE + 2], min(SLICE, len(codes) - i))) for i in range(0, len(codes), SLICE)]
    while len(found) > 1:  # merge two by two: no more than two slices' n-grams at once
        (a, x), (b, y) = found.pop(), found.pop()
        grams, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        found.append((grams, np.bincount(place, np.concatenate([x, y])).astype(np.int64)))
    return found[0]


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return grams[np.lexsort((grams, -counts))[:most]]


class Profiles:
    """Language profiles side by side: ranks[i, l] is where n-gram i stands in language l."""

    def __init__(self, by_lang: dict[str, list[int]]):
        self.langs = sorted(by_lang)
        self.grams = np.unique(np.array([g for p in by_lang.values() for g in p], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), PROFILE, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(by_lang[lang], np.uint64)), k] = np.arange(len(by_lang[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        doc = ranked(*ngram_counts(text), DOC_PROFILE)
        if not len(doc) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, doc)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == doc
        ranks = self.ranks[np.where(known, at, len(self.grams))]
        places = np.arange(len(doc), dtype=np.int32)[:, None]
        off = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - places)).sum(axis=0)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (PROFILE * len(doc)))


def learn(docs: DataFrame, usable: Column, per_lang: int = TRAIN_PER_LANG) -> Profiles:
    """Profiles from the labelled rows for which `usable` holds: about per_lang documents of each
    language, picked by a hash of doc_id. So what comes to the driver is bounded by the number of
    languages times per_lang, whatever the corpus."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, per_lang / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Profiles({})
    shares = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                mine = total.setdefault(lang, {})
                grams, counts = ngram_counts(text)
                for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                    mine[g] = mine.get(g, 0) + n
        for lang, mine in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], names=["lang", "gram", "n"])

    picked = rows.where(unit_hash(F.col("doc_id")) < shares[F.col("lang")]).select("lang", "text")
    counts = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Profiles({lang: ranked(p["gram"].to_numpy(np.uint64), p["n"].to_numpy(), PROFILE).tolist() for lang, p in counts.groupby("lang")})


def predict(docs: DataFrame, profiles: Profiles, *keep: Column | str) -> DataFrame:
    """(kept columns, lang_pred, score) from the texts alone. Narrow: no shuffle."""
    rows = docs.select(*keep, docs["text"].alias("text"))
    out = rows.drop("text").schema

    def work(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in out.names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*out.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return rows.mapInArrow(work, StructType(out.fields).add("lang_pred", StringType()).add("score", DoubleType()))
