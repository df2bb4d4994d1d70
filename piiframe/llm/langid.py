"""Language identification by hierarchical discrimination.

A text's hashed letter n-grams first decide its language family; then one-versus-one linear
support vector machines tell the languages of that family apart.

Defined results: a null text, or one without a letter, gets ``und`` and score 0; so does
every text when no labelled row can be learned from.  Repeated rows get equal results.  A
null doc_id counts as not held out and is not learned from.  An empty table gives no rows.  Other
columns are not read, and stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import unused
from .common import small_batches

UNDETERMINED = "und"
BUCKETS = 1 << 13
#: Characters handled at once, so that a very long text needs little memory.
SPAN = 1 << 20

# Members of language families by ISO 639-1 code.  A code that is not listed
# is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tr tt ug uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for start in range(0, 0x110000, 0x10000):
        table[start : start + 0x10000] = [chr(c).isalpha() for c in range(start, start + 0x10000)]
    return table


_LETTER: np.ndarray | None = None


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the bigrams and trigrams over lower-cased letters; each run of other
    characters is one word border.  Comes in spans; a border is assumed at each span's ends
    only where the text itself starts or ends."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    carry = np.zeros(1, np.uint32)
    for at in range(0, max(len(text), 1), SPAN):
        code = np.frombuffer(text[at : at + SPAN].lower().encode("utf-32-le", "replace"), np.uint32)
        code = np.where(_LETTER[code], code, 0).astype(np.uint32)
        if at + SPAN >= len(text):
            code = np.append(code, np.uint32(0))
        code = np.concatenate([carry, code])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code = code[keep]
        carry = code[-2:] if len(code) > 1 else code
        if len(code) < 2:
            continue
        two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
        two = two[1:] if at else two  # the carried pair was counted before
        yield np.concatenate([(two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D), (three ^ (three >> np.uint32(15))) * np.uint32(0x297A2D39)]) >> np.uint32(19)


def counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS)
    for part in ngrams(text):
        total += np.bincount(part, minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


#: Frequencies are scaled by this, so that margins of typical texts are near 1.
SCALE = 40.0
#: Share of even chance in a language's profile, so that unseen n-grams have a finite weight.
EVEN = 0.1


def fit_svm(rows: np.ndarray, sign: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the bias last) of a linear support vector machine with hinge loss, by dual
    coordinate descent; the order of the steps is seeded, so equal data give equal weights."""
    n, width = rows.shape
    weights, alpha = np.zeros(width + 1), np.zeros(n)
    square = np.einsum("ij,ij->i", rows, rows, dtype=np.float64) + 1.0
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            gradient = sign[i] * (weights[:-1] @ rows[i] + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[:-1] += step * rows[i]
                weights[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return weights


@dataclass
class Model:
    """families: name -> its languages.  Columns of `weights`: one machine per family against
    the rest (two families share one), then one per pair of languages of a family."""

    families: list[tuple[str, list[str]]] = field(default_factory=list)
    pairs: list[tuple[int, int, int]] = field(default_factory=list)  # family, two positions in it
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of each language, log of how much likelier its texts have a bucket than even chance.
    profile: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))

    @classmethod
    def fit(cls, langs: list[str], rows: np.ndarray) -> Model:
        """rows: scaled frequencies, one row of BUCKETS per label."""
        groups: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            groups.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        families, labels = sorted(groups.items()), np.array(langs, object)
        family = np.array([FAMILY_OF.get(x, x) for x in langs], object)
        columns = []
        if len(families) > 1:
            for name, _ in families[: 1 if len(families) == 2 else None]:
                columns.append(fit_svm(rows, np.where(family == name, 1.0, -1.0)))
        pairs = []
        for f, (_, members) in enumerate(families):
            for a, b in combinations(range(len(members)), 2):
                own = (labels == members[a]) | (labels == members[b])
                columns.append(fit_svm(rows[own], np.where(labels[own] == members[a], 1.0, -1.0)))
                pairs.append((f, a, b))
        stacked = np.array(columns).reshape(len(columns), BUCKETS + 1)
        shares = np.stack([rows[labels == x].mean(0, dtype=np.float64) / SCALE for x in sorted(set(langs))], 1)
        ratio = np.log((1 - EVEN) * shares * BUCKETS + EVEN)
        profile = ratio / (shares * ratio).sum(0)
        return cls(families, pairs, np.ascontiguousarray(stacked[:, :-1].T, np.float32), stacked[:, -1], np.ascontiguousarray(profile, np.float32))

    def totals(self, text: str, table: np.ndarray) -> tuple[np.ndarray, int]:
        total, n = np.zeros(table.shape[1]), 0
        for part in ngrams(text):
            total += table[part].sum(0, dtype=np.float64)
            n += len(part)
        return total, n

    def assess(self, text: str | None, both: np.ndarray) -> tuple[str, float, float]:
        """Language, score, and how like the learned texts of the nearest language the n-grams
        are, whatever the number of labels: 1 for a typical text, 0 or less for letters at even
        chance.  both: the columns of weights and profile, for one pass."""
        if not self.families or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        total, n = self.totals(text, both)
        heads = self.weights.shape[1]
        return *self.choose(total[:heads], n), float(total[heads:].max() / max(n, 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        return self.choose(*self.totals(text, self.weights))

    def choose(self, total: np.ndarray, n: int) -> tuple[str, float]:
        margin = total * (SCALE / max(n, 1)) + self.bias
        sure = 1.0 / (1.0 + np.exp(-2.0 * np.clip(margin, -30, 30)))
        heads = 0 if len(self.families) == 1 else 1 if len(self.families) == 2 else len(self.families)
        if heads == 0:
            best, score = 0, 1.0
        elif heads == 1:
            best = int(sure[0] < 0.5)
            score = float(sure[0] if best == 0 else 1.0 - sure[0])
        else:
            best = int(np.argmax(margin[:heads]))
            score = float(sure[best])
        members = self.families[best][1]
        votes = np.zeros((len(members), 2))
        for (f, a, b), p in zip(self.pairs, sure[heads:]):
            if f == best:
                votes[a] += (p >= 0.5, p)
                votes[b] += (p < 0.5, 1.0 - p)
        if len(members) == 1:
            return members[0], score
        lang = max(range(len(members)), key=lambda i: (votes[i][0], votes[i][1], -i))
        return members[lang], score * float(votes[lang][1]) / (len(members) - 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, per_lang: int = 400, rows: int = 4096, seed: int = 11) -> Model:
    """Fit on a bounded sample of labelled rows: of every language the `per_lang` rows whose
    seeded hash of doc_id is smallest, or fewer of each (but 8) where the languages are so many
    that this would make over `rows` in all.  labelled: doc_id, text, lang."""
    small_batches(labelled.sparkSession)
    source = labelled.select(F.col("doc_id"), F.col("text"), F.col("lang"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    found = source.groupBy("lang").count().collect()  # a row for each label
    if not found:
        return Model()
    per_lang = min(per_lang, max(8, rows // len(found)))
    # Hashes spread evenly, so a limit on the hash leaves a small multiple of per_lang rows to rank.
    spread = {r["lang"]: min(1.0, (2.0 * per_lang + 50) / r["count"]) for r in found}
    limit = F.create_map(*[F.lit(x) for k, v in spread.items() for x in (k, int(-(2**63) + v * (2**64 - 1)) if v < 1 else 2**63 - 1)])
    few = source.where(F.col("_h") <= F.element_at(limit, F.col("lang")))
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text")))).where(F.col("_r") <= per_lang)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, where, value = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    c = counts(text)
                    at = np.flatnonzero(c)
                    langs.append(lang)
                    where.append(at.astype(np.int32))
                    value.append((c[at] * (SCALE / c.sum())).astype(np.float32))
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(where, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "at", "value"])

    got = ranked.select("lang", "text").mapInArrow(features, "lang string, at array<int>, value array<float>").toArrow()
    langs = got.column("lang").to_pylist()
    if not langs:
        return Model()
    rows = np.zeros((len(langs), BUCKETS), np.float32)
    for i, (at, value) in enumerate(zip(got.column("at"), got.column("value"))):
        rows[i, at.values.to_numpy()] = value.values.to_numpy()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], rows[i].tobytes()))
    return Model.fit([langs[i] for i in order], rows[order])


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """Add two columns to every row of docs (three if `known` is named); the whole text counts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x machines, whatever the input's size
    made = unused(docs, "langid")[0]

    @F.pandas_udf("struct<lang: string, score: double>")
    def of(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    @F.pandas_udf("struct<lang: string, score: double, known: double>")
    def of_known(texts):
        import pandas as pd

        both = np.hstack([shared.value.weights, shared.value.profile])
        return pd.DataFrame([shared.value.assess(t, both) for t in texts], columns=["lang", "score", "known"])

    found = docs.withColumn(made, (of_known if known else of)(F.col(text)))
    if known:
        found = found.withColumn(known, F.col(f"{made}.known"))
    return found.withColumn(pred, F.col(f"{made}.lang")).withColumn(score, F.col(f"{made}.score")).drop(made)


def identify(docs: DataFrame, per_lang: int = 400, rows: int = 4096) -> DataFrame:
    """Learn from the labelled rows that are not held out, and predict every row:
    doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), per_lang, rows)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
