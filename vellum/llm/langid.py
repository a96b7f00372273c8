"""Language ID: averaged hashed subword embeddings under a linear softmax.

A word gives its character n-grams, an n-gram the bucket of its hash; a text is the
mean of the embeddings of all its n-grams, and a linear layer scores the languages and
one class more, which stands for none of them. Embeddings and layer are trained together
by stochastic gradient descent in numpy, on the driver, over a bounded sample of labelled
rows and over negatives made from them: words with their letters dealt anew, words of
letters drawn at random, and words of letters of other scripts.

Rejection is calibrated on what is kept back, every fifth text of a language. A
temperature is fitted to these texts and to negatives made from them. Then scores of right
predictions are set against scores of negatives and of whole languages that further models,
trained without them, have never seen. Right predictions are those of the kept texts, and
those of their words that yet other models have never seen: each of these is trained
without one part of all words and judges texts of that part alone, as a reader of new
vocabulary does. What is judged is the probability of all languages together, so a text that mixes them
is kept. The threshold is the least at which no more than PASSED of the wrong ones pass, or the score that REJECTED of the right ones miss if that is lower.

After training only the product of embeddings and layer is needed (buckets x classes),
so a text costs one look-up per distinct word; its size does not depend on the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, ship

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (2, 3, 4)
EPOCHS = 3
RATE = 0.5
SEED = 7
#: Labelled rows the model is fitted on: about this many for all languages together, but PER_LANGUAGE of each; of a text, a stretch of TRAIN_CHARS characters.
TRAIN_DOCS, PER_LANGUAGE, TRAIN_CHARS = 2_000, 50, 1_500
#: Examples cut from a training text besides the whole, and their words.
WINDOWS, WINDOW_WORDS = 4, (1, 24)
#: Negatives of each kind for one training text.
NEGATIVES = 0.2
#: Share of negatives and languages left out that may pass, and the smaller share of right predictions, on texts kept back and on words not seen, that may be rejected for it: a text wrongly rejected is lost.
PASSED, REJECTED = 0.003, 0.001
#: Parts of all words of which a model each is trained without one, and the least letters of such a part's text that is judged.
WORD_FOLDS, WORD_LETTERS = 2, 60
#: Labels learned: the most frequent ones. This bounds what the driver holds, with the rows of a label.
MOST_LABELS = 200
#: Models that are trained to calibrate, each without one part of the languages, and their epochs.
FOLDS, FOLD_EPOCHS = 3, 1
#: Code points of letters from which words of other scripts are made: Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Kana, Han, Hangul.
SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Words whose scores a task remembers; the memory is emptied when full.
REMEMBERED = 300_000
#: Characters of text whose new words are looked up together.
CHUNK_CHARS = 4_000_000

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, each between its boundary marks, and the word of each."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            whole = np.nonzero(of[: len(of) - n + 1] == of[n - 1 :])[0] if len(of) >= n else np.zeros(0, np.int64)
            mixed = np.full(len(whole), n, np.uint64)
            for k in range(n):
                mixed = (mixed ^ codes[whole + k]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
            buckets.append((mixed % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(of[whole])
    return np.concatenate(buckets), np.concatenate(owners)


class LanguageModel:
    """Scores of languages by bucket, and in the last column that of none of them; predicts a label, a score and whether to reject."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.labels, self.table, self.bias, self.temperature, self.threshold = labels, table, bias, temperature, threshold
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums, self.sizes = np.zeros((0, self.table.shape[1])), np.zeros(0)

    def learn(self, words: set[str]) -> None:
        """Sum the scores of words not met before."""
        if len(self.rows) + len(words) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.rows]
        if not new or not self.labels:
            return
        buckets, owners = grams(new)
        sums = [np.bincount(owners, weights=self.table[buckets, k], minlength=len(new)) for k in range(self.table.shape[1])]
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, np.stack(sums, axis=1)])
        self.sizes = np.concatenate([self.sizes, np.bincount(owners, minlength=len(new))])

    def logits(self, words: Counter) -> np.ndarray:
        """Scores of a text from its words, all of them learned."""
        at = [self.rows[w] for w in words]
        times = np.fromiter(words.values(), np.float64, len(words))
        return (times @ self.sums[at]) / (times @ self.sizes[at]) + self.bias

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Label, score in 0..1 and whether it is rejected, for each text; one without letters is undetermined."""
        counted = [Counter(WORD.findall((text or "").lower())) for text in texts]
        self.learn({w for words in counted for w in words})
        return [self._predict(words) for words in counted]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]

    def _predict(self, words: Counter) -> tuple[str, float, bool]:
        if not self.labels or not any(any(map(str.isalpha, w)) for w in words):
            return UNDETERMINED, 0.0, True
        p = softmax(self.logits(words) / self.temperature)
        best = int(p[:-1].argmax())
        # A text of two languages has a low score, but is not one of none of them.
        return self.labels[best], float(min(1.0, p[best])), float(p[:-1].sum()) < self.threshold


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _cuts(text: str, random: np.random.Generator) -> list[list[str]]:
    """The words of a text, and of windows of it."""
    words = WORD.findall(text.lower())
    cuts = [words]
    for _ in range(WINDOWS):
        size = int(random.integers(*WINDOW_WORDS, endpoint=True))
        begin = int(random.integers(0, max(1, len(words) - size)))
        cuts.append(words[begin : begin + size])
    return [c for c in cuts if c]


def negatives(words: list[str], letters: np.ndarray, random: np.random.Generator) -> list[list[str]]:
    """Of one list of words, three that belong to no language: letters of each word dealt anew, letters drawn from all, letters of another script."""
    low, high = SCRIPTS[int(random.integers(len(SCRIPTS)))]
    codes = [np.array([ord(c) for c in w], np.uint32) for w in words]
    dealt = [random.permutation(c) for c in codes]
    drawn = [random.choice(letters, len(c)) for c in codes]
    foreign = [random.integers(low, high, len(c), endpoint=True) for c in codes]
    return [[c.astype("<u4").tobytes().decode("utf-32-le") for c in made] for made in (dealt, drawn, foreign)]


def letters_of(texts: list[list[str]]) -> np.ndarray:
    """Code points of all letters of the texts."""
    return np.array(sorted({ord(c) for words in texts for c in set("".join(words))}) or [ord("a")], np.uint32)


def _example(words: list[str], answer: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets with their shares."""
    found = grams(words)[0]
    buckets, times = np.unique(found, return_counts=True)
    return buckets, times / len(found), answer


def _descend(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, random: np.random.Generator, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over the examples: the scores of buckets by class, and of classes."""
    embedding = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, classes)), np.zeros(classes)
    steps, done = epochs * max(1, len(examples)), 0
    for _ in range(epochs):
        for k in random.permutation(len(examples)):
            buckets, shares, answer = examples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = shares @ embedding[buckets]
            error = softmax(mean @ layer + bias)
            error[answer] -= 1
            back = layer @ error
            layer -= rate * mean[:, None] * error
            bias -= rate * error
            embedding[buckets] -= (rate * len(buckets) ** 0.5) * shares[:, None] * back
    return embedding @ layer, bias


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    """A model from labelled texts. Every fifth text of each language (in the order given) is kept back for calibration.

    With no text kept back, that is with under five texts of every language, nothing
    is rejected but texts without a letter.
    """
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros(1))
    random, none = np.random.default_rng(SEED), len(labels)
    met, used, held = [0] * len(labels), [], []
    for text, answer in zip(texts, map(labels.index, langs), strict=True):
        met[answer] += 1
        if met[answer] % 5:
            used.append((_cuts(text, random), answer))
        elif words := WORD.findall(text.lower()):
            held.append((words, answer))
    letters = letters_of([cuts[0] for cuts, _ in used if cuts])
    examples = [_example(words, answer) for cuts, answer in used for words in cuts]
    made = [words[: WINDOW_WORDS[1]] for cuts, _ in used for words in cuts if random.random() < NEGATIVES]
    examples += [_example(words, none) for own in made for words in negatives(own, letters, random)]
    model = LanguageModel(labels, *_descend(examples, none + 1, random, EPOCHS))
    if held:
        unseen = []
        for fold in range(FOLDS):
            known = [k for k in range(none) if k % FOLDS != fold]
            left_out = [words for words, answer in held if answer % FOLDS == fold]
            if left_out and known:
                number = {k: n for n, k in enumerate([*known, none])}
                seen = [(buckets, shares, number[answer]) for buckets, shares, answer in examples if answer in number]
                partial = LanguageModel([labels[k] for k in known], *_descend(seen, len(known) + 1, random, FOLD_EPOCHS))
                unseen.append((partial, left_out))
        _calibrate(model, held, unseen, _new_words(used, held, labels, letters, random), random)
    return model


def _part(word: str) -> int:
    """The part of all words that a word belongs to, whatever its text."""
    return sum(map(ord, word)) * 31 % 97 % WORD_FOLDS


def _new_words(used: list[tuple[list[list[str]], int]], held: list[tuple[list[str], int]], labels: list[str], letters: np.ndarray, random: np.random.Generator) -> list[tuple[LanguageModel, list[tuple[list[str], int]]]]:
    """Models that were trained without one part of all words, each with the words of that part of the texts kept back."""
    out = []
    for part in range(WORD_FOLDS):
        seen = [([w for w in words if _part(w) != part], answer) for cuts, answer in used for words in cuts[:3]]
        seen = [(words, answer) for words, answer in seen if words]
        examples = [_example(words, answer) for words, answer in seen]
        made = [words[: WINDOW_WORDS[1]] for words, _ in seen if random.random() < NEGATIVES]
        examples += [_example(words, len(labels)) for own in made for words in negatives(own, letters, random)]
        new = [([w for w in words if _part(w) == part], answer) for words, answer in held]
        new = [(words, answer) for words, answer in new if sum(map(len, words)) >= WORD_LETTERS]
        if examples and new:
            out.append((LanguageModel(labels, *_descend(examples, len(labels) + 1, random, FOLD_EPOCHS)), new))
    return out


def _calibrate(
    model: LanguageModel, held: list[tuple[list[str], int]], unseen: list[tuple[LanguageModel, list[list[str]]]], new: list[tuple[LanguageModel, list[tuple[list[str], int]]]], random: np.random.Generator
) -> None:
    """Set the temperature of least loss, then a threshold between the scores of right predictions and those of negatives."""

    def logits(by: LanguageModel, words: list[str]) -> np.ndarray:
        counted = Counter(words)
        by.learn(set(counted))
        return by.logits(counted)

    letters = letters_of([words for words, _ in held])
    scored = [(logits(model, words), answer) for words, answer in held]
    made = [logits(model, words) for own, _ in held for words in negatives(own[: WINDOW_WORDS[1]], letters, random)]
    answered = scored + [(z, len(model.labels)) for z in made]
    # Targets short of 1, after Platt: without them separable texts would have no temperature of least loss.
    sure = (len(answered) + 1) / (len(answered) + 2)
    scores, answers = np.stack([z for z, _ in answered]), np.array([answer for _, answer in answered])
    targets = np.full(scores.shape, (1 - sure) / (scores.shape[1] - 1))
    targets[np.arange(len(answers)), answers] = sure

    def loss(t: float) -> float:
        log = (scores - scores.max(axis=1, keepdims=True)) / t
        log -= np.log(np.exp(log).sum(axis=1, keepdims=True))
        return float(-(targets * log).sum())

    grid = np.geomspace(0.01, 20, 80)
    model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])

    def score(z: np.ndarray) -> float:
        """Of all languages together against none, as log odds."""
        p = z / model.temperature
        return float(p[:-1].max() + np.log(np.exp(p[:-1] - p[:-1].max()).sum()) - p[-1])

    judged = scored + [(logits(by, words), answer) for by, texts in new for words, answer in texts]
    right = [score(z) for z, answer in judged if int(z[:-1].argmax()) == answer]
    wrong = [score(z) for z in made] + [score(logits(by, words)) for by, left_out in unseen for words in left_out]
    if right:
        low, high = float(np.quantile(wrong, 1 - PASSED)), float(np.quantile(right, REJECTED))
        model.threshold = float(1 / (1 + np.exp(-min(low, high))))


def train(docs: DataFrame, usable: Column, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fit on a bounded sample of the ``usable`` rows of ``docs`` with text and lang.

    The MOST_LABELS most frequent languages are learned and get like shares of the sample,
    PER_LANGUAGE rows or more if they have so many; rows are drawn by a hash of doc_id and text, and of a text
    longer than TRAIN_CHARS a stretch of that length from a place drawn likewise. The
    driver holds one stretch per sampled row and one row of scores per language.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LABELS).collect()}
    if not counts:
        return fit([], [])
    each = max(PER_LANGUAGE, train_docs / len(counts))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    draw = F.xxhash64("doc_id", "text", F.lit(SEED))
    chance = F.pmod(draw, F.lit(1 << 20)) / float(1 << 20)
    begin = F.pmod(F.shiftright(draw, 20), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    sample = labelled.filter(chance < share[F.col("lang")]).select(draw.alias("draw"), F.xxhash64("text").alias("mark"), "lang", F.substring("text", begin, F.lit(TRAIN_CHARS)).alias("text"))
    # The draw gives a language more than its share only by chance; twice the share is never exceeded.
    rows = sample.orderBy("draw", "mark", "lang").limit(int(2 * each * len(counts))).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: CRC-32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), only_accepted: bool = False) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and rejected; ``only_accepted`` drops the rejected rows and those columns.

    Only the text is looked at. Null texts and texts without a letter are ``und`` with
    score 0 and rejected, as is every text if nothing was learned. Repeated rows get
    equal results; an empty table gives none. Columns not in ``keep`` cannot clash;
    those of ``keep`` that bear a name made here are replaced.
    """
    made = ["lang_pred string", "score double", "rejected boolean"] * (not only_accepted)
    kept = [c for c in keep if only_accepted or c not in ("lang_pred", "score", "rejected")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], *made])
    names = [*kept, *[m.split()[0] for m in made]]
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.table, model.bias, model.temperature, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            found = [x for chunk in chunks(batch.column(len(kept)).to_pylist(), CHUNK_CHARS) for x in own.predict_all(chunk)]
            columns = batch.columns[: len(kept)]
            if only_accepted:
                accepted = pa.array([not rejected for _, _, rejected in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(accepted) for c in columns], names)
            else:
                label, score, rejected = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema)


ship(__name__)
