"""Licence scans: which paragraphs name a licence, and of which family.

A paragraph's word 1- to 3-grams go to a sparse logistic regression (Spark ML's),
trained from notices of each family (whole and in parts), from statements of other
licences and from all ordinary lines of all texts.  Of a line only the n-grams that
templates have count, so lines with the same ones are one row with a count.  Wordings that it wasn't trained from
calibrate it: a temperature for its probabilities, and the least probability
below which a paragraph is of the unknown class.  A prediction is confirmed by
comparison with the family's templates, in which n-grams that several families
share count for little; what isn't confirmed is of the unknown class too.

A paragraph is what blank lines enclose.  In it, lines with a word that only
notices have, and single lines between such, are judged together, so a wrapped
notice is one and the prose around it is left out.

Defined results: a null or empty text has no paragraphs; texts of any length
are read whole; ties go to the family that sorts first; rows that repeat give
equal rows; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.staging import staged

from .license_texts import HELD_OUT, OTHERS, OTHERS_HELD_OUT, TEMPLATES, VERSIONS

UNKNOWN = "unknown"
#: However many ordinary lines there are, all together weigh as so many rows of training (four
#: fifths) and calibration (a fifth); a word that fewer than one of so many has isn't ordinary.
ORDINARY = 3000
#: Least likeness to a template, and least weight of n-grams in common with it.
SIMILAR, EVIDENCE = 0.65, 1.9
#: Of the unknown class's calibration rows, at most this share may pass.
FALSE_ALARMS = 0.01
TEMPERATURES = (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)
_WORD = re.compile(r"[a-z0-9.+-]*[a-z0-9+]")
_NUMBER = re.compile(r"v?\d+(\.\d+)*$")
_PLAIN = frozenset(
    "a an and any are as at be been but by can do each for from has have how if in into is it its like made may more most no not of on one only or other "
    "out over same some so such than that the their them then there these they this those to two under up was when where which who will with you your".split()
)


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams_of(words: list[str]) -> set[str]:
    """1- to 3-grams, numbers as one sign, without those of plain words only."""
    marked = ["#" if _NUMBER.match(w) else w for w in words]
    made = set()
    for k in (1, 2, 3):
        for i in range(len(marked) - k + 1):
            if not _PLAIN.issuperset(marked[i : i + k]):
                made.add(" ".join(marked[i : i + k]))
    return made


def filled(texts: list[str]) -> list[list[str]]:
    """Words of each text, once for every version where it has one."""
    return [words_of(t.replace("{v}", v)) for t in texts for v in (VERSIONS if "{v}" in t else VERSIONS[:1])]


def parts_of(words: list[str], size: int = 24, step: int = 12) -> list[list[str]]:
    """The words, and if they are many, stretches of them as lines of a file would cut them."""
    if len(words) <= size:
        return [words]
    return [words, *(words[i : i + size] for i in range(0, len(words) - size // 2, step))]


def soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Classifier:
    """Multinomial logistic regression over the n-grams of the templates.

    Other n-grams weigh nothing, so prose without any word that only templates
    have gets the answer of an empty paragraph.
    """

    def __init__(self):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        self.made = [(f, words) for f in sorted(TEMPLATES) for words in filled(TEMPLATES[f])]
        self.other = filled(OTHERS)
        self.grams = sorted(set().union(*(grams_of(w) for _, w in self.made)))
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.words = frozenset(w for _, words in self.made for w in words)
        self._weigh(self.made, self.other)

    def places(self, words: list[str]) -> list[int]:
        """The numbers of the templates' n-grams among those of ``words``."""
        if self.words.isdisjoint(words) and not any(map(_NUMBER.match, words)):  # any number is "#"
            return []
        return sorted(self.number[g] for g in grams_of(words) if g in self.number)

    def rows(self, share: np.ndarray) -> list[tuple[int, list[int]]]:
        """Family and n-grams of each row of training that isn't an ordinary line: notices and
        their parts, by themselves and beside what an ordinary line has (``share`` of lines by
        n-gram), and other statements."""
        rng = np.random.default_rng(5)
        found = []
        for family, words in self.made:
            for part in parts_of(words):
                own = self.places(part)
                around = np.flatnonzero(rng.random(len(share)) < share).tolist()
                found += [(self.families.index(family), own), (self.families.index(family), sorted({*own, *around}))]
        return found + [(len(self.families) - 1, self.places(w)) for w in [*self.other, *self.other, *self.other, *[[]] * 20]]

    def learn(self, w: np.ndarray, b: np.ndarray, share: np.ndarray, ordinary: int) -> None:
        self.w, self.b = w, b
        ordinarily = {g for g, x in zip(self.grams, share, strict=True) if x >= 1 / ordinary}
        names = {"license", "licensed", "licence", "licenses", "copyright", "gnu", "gpl", "spdx-license-identifier", "unlicense", "cc0", "reserved"}
        common = {w for w in self.words if ("#" if _NUMBER.match(w) else w) in ordinarily}
        self.telling = frozenset({w for w in self.words if len(w) > 3} - common - _PLAIN | names)

    def logits(self, places: list[int]) -> np.ndarray:
        return self.b + self.w[places].sum(0) / max(1.0, len(places)) ** 0.5

    def losses(self, places: list[int], family: int) -> np.ndarray:
        """What each temperature costs for a row of ``family``."""
        z = self.logits(places)[None]
        return np.array([-np.log(soft(z / t)[0, family] + 1e-12) for t in TEMPERATURES])

    def passes(self, places: list[int]) -> float | None:
        """The probability of a row that isn't of the unknown class, in ten thousandths rounded up."""
        family, sure, *_ = self._judge_grams({self.grams[i] for i in places})
        return None if family == UNKNOWN else float(np.ceil(sure * 1e4) / 1e4)

    def _weigh(self, made: list[tuple[str, list[str]]], other: list[list[str]]) -> None:
        """What an n-gram tells: little if several families, or other licences, have it."""
        has: dict[str, set[str]] = {}
        for family, words in [*made, *((UNKNOWN, w) for w in other)]:
            for g in grams_of(words):
                has.setdefault(g, set()).add(family)
        self.tells = {g: 1.0 / len(f) ** 2 for g, f in has.items() if g in self.number}
        self.by_family = {f: {frozenset(grams_of(w)) for g, w in made if g == f} for f in TEMPLATES}

    def _answer(self, words: list[str]) -> tuple[str, float, float]:
        """Family, probability and likeness to its nearest template; unknown unless all suffice."""
        return self._judge(words)[:3]

    def _judge(self, words: list[str]) -> tuple[str, float, float, bool]:
        """As ``_answer``, and whether nearly all of a template is there."""
        return self._judge_grams({g for g in grams_of(words) if g in self.number})

    def _judge_grams(self, grams: set[str]) -> tuple[str, float, float, bool]:
        p = soft(self.logits(sorted(self.number[g] for g in grams))[None] / self.temperature)[0]
        best = int(p.argmax())
        family, sure = self.families[best], float(p[best])
        if family == UNKNOWN or sure < self.least:
            return UNKNOWN, sure, 0.0, False
        like, whole, tells = 0.0, False, self.tells
        own = sum(tells[g] for g in grams)
        for t in self.by_family[family]:
            both = sum(tells[g] for g in grams & t)
            if both >= EVIDENCE:
                size = sum(tells[g] for g in t)
                like = max(like, both / min(own, size))
                whole |= both >= 0.8 * size
        return (family, sure, like, whole) if like >= SIMILAR else (UNKNOWN, sure, like, False)

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        words = words_of(paragraph)
        return self.nothing if self.telling.isdisjoint(words) else self._answer(words)

    def paragraphs(self, text: str) -> list[list[tuple[int, list[str]]]]:
        """What is judged: the lines (number, words) of each run in each paragraph."""
        runs: list[list[tuple[int, list[str]]]] = []
        last = gap = None
        for nr, line in enumerate(text.split("\n")):
            words = words_of(line)
            if not words:
                if not line.strip():
                    last = gap = None  # a blank line ends the paragraph
                continue
            if self.telling.isdisjoint(words):
                gap = (nr, words) if last is not None and nr == last + 1 else None
                continue
            if last is not None and (nr == last + 1 or (gap is not None and gap[0] == nr - 1)):
                runs[-1] += [gap] if gap is not None and nr > last + 1 else []
            else:
                runs.append([])
            runs[-1].append((nr, words))
            last, gap = nr, None
        return runs

    def scan(self, text: str) -> list[tuple[int, str, float, float]]:
        """First line, family, probability and likeness of each licence paragraph.

        Where lines of a run are whole statements of several families, each is
        one; so are the lines that are recognised where the run isn't.
        """
        found = []
        for run in self.paragraphs(text):
            lines = [(nr, *a) for nr, words in run if len(run) > 1 and (a := self._judge(words))[0] != UNKNOWN]
            whole = [line[:4] for line in lines if line[4]]
            if len({line[1] for line in whole}) > 1:
                found += whole
                continue
            answer = self._answer([w for _, words in run for w in words])
            found += [(run[0][0], *answer)] if answer[0] != UNKNOWN else [line[:4] for line in lines]
        return found


def ordinary_lines(docs: DataFrame, model: Classifier, text: str = "text", line_words: int = 200) -> DataFrame:
    """rest, places, n: how many ordinary lines (without words of licences) of all texts have
    just those n-grams of the templates.  ``rest`` is a fifth of the lines, by a hash, that
    calibrates.  A line of many words is several, so that none weighs as a whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    licensed = re.compile("licen|copyright|rights|permission|warrant")
    names, kinds = ["rest", "places", "n"], [pa.bool_(), pa.list_(pa.int32()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value.places
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                for line in t.split("\n"):
                    if line.strip() and not licensed.search(line.lower()):
                        words, rest = words_of(line), zlib.crc32(line.encode("utf-8", "replace")) % 5 == 4
                        for i in range(0, max(1, len(words)), line_words):
                            found[rest, tuple(places(words[i : i + line_words]))] += 1
            rows = [(rest, list(at), n) for (rest, at), n in found.items()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    texts = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "rest boolean, places array<int>, n long").groupBy("rest", "places").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", ordinary: int = ORDINARY, rounds: int = 150, ridge: float = 1e-4) -> Classifier:
    """A classifier whose unknown class has all ordinary lines of the texts.

    All weigh as ``ordinary`` rows or, if there are fewer, as themselves.  What the driver
    gets are sums by n-gram of the templates, by temperature and by probability.
    """
    spark, model = docs.sparkSession, Classifier()
    lines = staged(ordinary_lines(docs, model, text))
    total = {r["rest"]: r["n"] for r in lines.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    fitted, kept = total.get(False, 0), total.get(True, 0)
    share = np.zeros(len(model.grams))
    for r in lines.select(F.explode("places").alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n")).collect():
        share[r["at"]] = r["n"] / (fitted + kept)

    # every family weighs the same, and in the unknown one the ordinary lines as said
    unknown, own = len(model.families) - 1, model.rows(share)
    mass = np.bincount([f for f, _ in own], minlength=unknown + 1).astype(float)
    all_lines = min(fitted, ordinary * 4 / 5)
    mass[unknown] += all_lines
    given = spark.createDataFrame([(float(f), at, float(1 / mass[f])) for f, at in own], "label double, places array<int>, weight double")
    prose = lines.where("not rest").select(F.lit(float(unknown)).alias("label"), "places", (F.col("n") * (all_lines / max(fitted, 1) / mass[unknown])).alias("weight"))
    width = len(model.grams)
    vector = F.udf(lambda at: Vectors.sparse(width, at, [max(1, len(at)) ** -0.5] * len(at)), VectorUDT())
    rows = staged(given.coalesce(1).union(prose).select("label", "weight", vector("places").alias("features")))
    fit = LogisticRegression(family="multinomial", maxIter=rounds, regParam=ridge, standardization=False, weightCol="weight").fit(rows)
    model.learn(fit.coefficientMatrix.toArray().T, fit.interceptVector.toArray(), share, ordinary)
    _calibrate(model, lines.where("rest"), kept, ordinary / 5)
    model.nothing = model._answer([])
    return model


def _calibrate(model: Classifier, lines: DataFrame, n: int, most: float) -> None:
    """The temperature at which wordings that weren't learned are likeliest, and the least
    probability that keeps the unknown ones out: statements, and all ``n`` lines, which
    weigh ``most`` or, if they are fewer, as themselves."""
    context, unknown = lines.sparkSession.sparkContext, len(model.families) - 1
    weight = min(n, most) / max(n, 1)
    known = [(model.families.index(f), model.places(w)) for f in sorted(HELD_OUT) for w in filled(HELD_OUT[f])]
    others = [model.places(w) for w in filled(OTHERS_HELD_OUT)]
    size = Counter(f for f, _ in known)

    def over(judge) -> DataFrame:
        """``judge`` of each row of ``lines``, with its count."""
        shared = context.broadcast(model)
        arrow = pa.list_(pa.float64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [judge(shared.value, at) for at in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(values, arrow), batch.column(1)], names=["x", "n"])

        return lines.select("places", "n").mapInArrow(run, "x array<double>, n long")

    costs = over(lambda m, at: m.losses(at, unknown).tolist())
    sums = costs.agg(*(F.sum(F.col("x")[i] * F.col("n")).alias(f"t{i}") for i in range(len(TEMPERATURES)))).first()
    rest = np.array([s or 0.0 for s in sums]) * weight + sum(model.losses(at, unknown) for at in others)
    loss = rest / (len(others) + n * weight) + sum(model.losses(at, f) / size[f] for f, at in known)
    model.temperature, model.least = TEMPERATURES[int(loss.argmin())], 0.0

    passed = over(lambda m, at: [p] if (p := m.passes(at)) is not None else []).select(F.explode("x").alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()
    held = Counter({r["p"]: r["n"] * weight for r in passed})
    held.update(p for at in others if (p := model.passes(at)) is not None)
    left, model.least = int(FALSE_ALARMS * (len(others) + n * weight)), 0.5
    for p in sorted(held, reverse=True):
        left -= held[p]
        if left < 0:
            model.least = min(0.95, max(0.5, p + 1e-6))
            break


SCHEMA = "doc_id long, n_license long, family string, probability double, similarity double, families array<string>, first_lines array<long>"


def scan(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its licence paragraphs (first lines, families) and the
    family of the surest, null without one."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # the n-grams of the templates
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = model.scan(t or "")
                best = max(found, key=lambda f: (f[2], f[3], -f[0]), default=(None, None, None, None))
                rows.append((len(found), *best[1:], [f[1] for f in found], [f[0] for f in found]))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, SCHEMA)
