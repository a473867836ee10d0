"""Language ID by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum, over all ways to cut it into pieces, of the product of their probabilities; a forward pass over the word gives it.
A text's log probability is the sum over its words, so each distinct word is scored once per worker.

Training: expectation-maximisation on the distinct words of the labelled texts, all of them or at most `sample_rows`
(whole texts, taken by a hash of key and text, spread over the languages); words are counted by Spark, and so are the
expected counts of a round, at most one row for each language and piece.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the language that sorts first;
repeated rows get the same answer; without labelled texts everything with a letter is `und`; only text and language
columns are read, whatever else the table has.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import resident, written

UNKNOWN = "und"
CACHE = 800_000
#: Words of more letters are scored in logs and not kept by the cache.
LONG = 48
#: Labels that are learned, the most frequent ones: a model holds a probability for each of them and each piece.
LANGUAGES = 200
#: Words and letters of texts that a task counts before it hands them on, and distinct words of a task that learns.
HELD, HELD_LETTERS, PART = 200_000, 1 << 25, 100_000
#: What a character costs that no piece covers, and the smoothing of a piece's count.
CHARACTER = 1e-7
SMOOTH = 0.05
#: Sums of products below that are taken in logs: what a float loses is far smaller.
TINY = 1e-280
_RUNS = re.compile(r"[^\W\d_]+")


def pieces_of(model: str) -> list[str]:
    """The vocabulary's pieces of letters, lower case, after the word mark if there is one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {sp.id_to_piece(i).replace("▁", "^").lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(x for x in found if x and (x.lstrip("^").isalpha() or x == "^"))


def units(text: str) -> list[str]:
    """Lower-case runs of letters."""
    found = _RUNS.findall(text.lower())
    if not text.isascii():
        found = [w for w in found if w.isalpha() or any(map(str.isalpha, w))]
    return found


class Model:
    """logs: array of pieces x languages of natural-log probabilities."""

    def __init__(self, languages: list[str], pieces: list[str], logs: np.ndarray) -> None:
        self.languages, self.pieces = languages, pieces
        self.logs = logs
        self.probs = np.exp(logs.astype(np.float64))
        #: By character; "" holds the probabilities of the piece that ends there.
        self.trie: dict = {}
        for piece, row in zip(pieces, self.probs.tolist(), strict=True):
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = row
        self.single = {x for x in pieces if len(x) == 1}
        #: Piece -> place; -2 for what only begins a piece.
        self.index = {x[:k]: -2 for x in pieces for k in range(1, len(x))} | {x: i for i, x in enumerate(pieces)}
        self.cache: dict[str, int] = {}
        self.table = np.zeros((1024, len(languages)))

    def _edges(self, word: str) -> tuple[str, list[list[tuple[int, int]]]]:
        """For each end in the marked word: (start, piece); -1 stands for a character without a piece."""
        s, get = "^" + word, self.index.get
        n = len(s)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                k = get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    ends[j].append((i, k))
            if get(s[i], -2) < 0:
                ends[i + 1].append((i, -1))
        return s, ends

    def score(self, word: str) -> np.ndarray:
        """Log probability of the word in each language, all segmentations summed."""
        if len(word) > LONG:
            return self._log_score(word)
        s, trie = "^" + word, self.trie
        n = len(s)
        none = [0.0] * len(self.languages)
        forward = [none] * (n + 1)
        forward[0] = [1.0] * len(self.languages)
        for i in range(n):
            before, node = forward[i], trie
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                row = node.get("")
                if row is not None:
                    forward[j + 1] = [a + x * y for a, x, y in zip(forward[j + 1], before, row)]  # noqa: B905
            if s[i] not in self.single:
                forward[i + 1] = [a + x * CHARACTER for a, x in zip(forward[i + 1], before)]  # noqa: B905
        if min(forward[n]) < TINY:
            return self._log_score(word)
        return np.array([math.log(x) for x in forward[n]])

    def _log_score(self, word: str) -> np.ndarray:
        """score() for words whose probability may be too small for a float."""
        s, ends = self._edges(word)
        forward = np.zeros((len(s) + 1, len(self.languages)))
        for j in range(1, len(s) + 1):
            forward[j] = np.logaddexp.reduce([forward[i] + (math.log(CHARACTER) if k < 0 else self.logs[k]) for i, k in ends[j]], axis=0)
        return forward[-1]

    def expected(self, word: str, language: int, count: float, into: np.ndarray) -> None:
        """Adds the expected number of uses of each piece in the word to `into`."""
        s, ends = self._edges(word)
        p, n = self.probs[:, language], len(s)
        forward, back = [0.0] * (n + 1), [0.0] * (n + 1)
        forward[0] = back[n] = 1.0
        for j in range(1, n + 1):
            forward[j] = sum(forward[i] * (CHARACTER if k < 0 else p[k]) for i, k in ends[j])
        for j in range(n, 0, -1):
            for i, k in ends[j]:
                back[i] += back[j] * (CHARACTER if k < 0 else p[k])
        if forward[n] >= TINY:
            for j in range(1, n + 1):
                for i, k in ends[j]:
                    if k >= 0:
                        into[k] += count * forward[i] * p[k] * back[j] / forward[n]
            return
        cost = lambda k: math.log(CHARACTER) if k < 0 else float(self.logs[k, language])
        forward, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        forward[0] = back[n] = 0.0
        for j in range(1, n + 1):
            forward[j] = float(np.logaddexp.reduce([-math.inf, *[forward[i] + cost(k) for i, k in ends[j]]]))
        for j in range(n, 0, -1):
            for i, k in ends[j]:
                back[i] = float(np.logaddexp(back[i], back[j] + cost(k)))
        for j in range(1, n + 1):
            for i, k in ends[j]:
                if k >= 0:
                    into[k] += count * math.exp(forward[i] + cost(k) + back[j] - forward[n])

    def score_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of log probabilities (texts x languages), numbers of units and of their letters."""
        cache = self.cache
        if len(cache) >= CACHE:
            cache.clear()
        found = [units(x) for x in texts]
        new = set(chain.from_iterable(found)).difference(cache)
        long = {w: self.score(w) for w in new if len(w) > LONG}
        missing = list(new.difference(long))
        if missing:
            first = len(cache)
            if first + len(missing) > len(self.table):
                grown = np.zeros((2 * (first + len(missing)), len(self.languages)))
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[first : first + len(missing)] = [self.score(w) for w in missing]
            cache.update(zip(missing, range(first, first + len(missing)), strict=True))
        out = np.zeros((len(texts), len(self.languages)))
        for k, x in enumerate(found):
            if x:
                short = [w for w in x if w not in long] if long else x
                out[k] = self.table[np.fromiter(map(cache.__getitem__, short), np.int64, len(short))].sum(axis=0)
                if len(short) < len(x):
                    out[k] += sum(long[w] for w in x if w in long)
        return out, np.array([len(x) for x in found]), np.array([len("".join(x)) for x in found])


def fit(docs: DataFrame, model: str, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int | None = 2_000, rounds: int = 2, languages: int = LANGUAGES) -> Model | None:
    """Learns from the labelled rows it is given; None if there are none. Each of the `languages` most frequent labels
    gets an equal part of sample_rows, rows with the least hashes of key and text, or all that it has; with None, all."""
    rows = docs.select(F.xxhash64(F.col(key), F.col(text), F.lit(7)).alias("_h"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    often = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    by = {r["lang"]: r["n"] for r in often.collect()}
    if not by:
        return None
    languages = sorted(by)
    if sample_rows is None:
        picked = rows.where(F.col("lang").isin(languages)).select("text", "lang")
    else:
        each = max(1, sample_rows // len(languages))
        # about twice as many as are wanted, of which the window takes the first
        share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, 2 * each / n))) for x, n in by.items()])
        some = rows.where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30))
        turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h"))
        picked = some.withColumn("_turn", turn).where(F.col("_turn") <= each).select("text", "lang")

    def counted(found: dict[str, Counter[str]]) -> pa.RecordBatch:
        names = [y for y, n in found.items() for _ in n]
        cols = [pa.array(names, pa.string()), pa.array(chain.from_iterable(found.values()), pa.string()), pa.array(chain.from_iterable(n.values() for n in found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "word", "n"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[str]] = defaultdict(Counter)
        held = letters = 0
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                for x, y in zip(*[c.to_pylist() for c in whole.slice(at, 500).columns], strict=True):
                    n = found[y]
                    held -= len(n)
                    n.update(units(x))
                    held, letters = held + len(n), letters + len(x)
                    if held >= HELD or letters >= HELD_LETTERS:
                        yield counted(found)
                        found.clear()
                        held = letters = 0
        yield counted(found)

    words = written(picked.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    words = words.repartition(1 + words.count() // PART)  # what a word costs is time, not bytes
    pieces = pieces_of(model)
    logs = np.full((len(pieces), len(languages)), -math.log(len(pieces)))
    place = {x: i for i, x in enumerate(languages)}
    for _ in range(rounds):
        # pieces x languages numbers: bounded by the vocabulary
        state = words.sparkSession.sparkContext.broadcast((languages, pieces, logs))

        def expect(it: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            m = Model(*state.value)
            total = np.zeros((len(languages), len(pieces)))
            for batch in it:
                for x, w, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    m.expected(w, place[x], n, total[place[x]])
            a, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["l", "p", "n"])

        got = words.mapInArrow(expect, "l int, p int, n double").groupBy("l", "p").agg(F.sum("n").alias("n")).toArrow()
        total = np.full((len(pieces), len(languages)), SMOOTH)
        total[got["p"].to_numpy(), got["l"].to_numpy()] += got["n"].to_numpy()
        logs = np.log(total / total.sum(axis=0))
    return Model(languages, pieces, logs)


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (the winner's posterior with evidence per unit tempered to at most
    TEMPER units, 0 to 1) and lang_fit (mean log10 probability of a letter in the predicted language)."""
    spark = docs.sparkSession
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("lang_fit")).schema
    # pieces x languages numbers: bounded by the vocabulary
    state = spark.sparkContext.broadcast(model and (model.languages, model.pieces, model.logs))
    name = uuid.uuid4().hex
    place = keep.index(text) if text in keep else len(keep)  # the text crosses to Python once

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(name, state)
        for whole in it:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [x or "" for x in batch.column(place).to_pylist()]
                lang, score, fit_ = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if m is not None:
                    sums, n, letters = m.score_texts(texts)
                    evidence = sums - sums.max(axis=1, keepdims=True)
                    evidence *= np.minimum(1.0, TEMPER / np.maximum(n, 1))[:, None]
                    p = np.exp(evidence)
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    for k in np.flatnonzero(n):
                        lang[k] = m.languages[best[k]]
                        score[k] = p[k, best[k]]
                        fit_[k] = sums[k, best[k]] / math.log(10) / letters[k]
                cols = [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(fit_)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(run, schema)


#: Units of evidence that a posterior counts at most.
TEMPER = 25
def _model(name: str, state) -> Model | None:
    """One per worker, kept between its tasks."""
    return resident(("language", name), lambda: state.value and Model(*state.value))


def learn_and_predict(docs: DataFrame, model: str, held_out, keep: tuple[str, ...] = ("doc_id",), **fit_options) -> DataFrame:
    """Fits on rows that aren't held out and predicts every row. held_out: a boolean Column."""
    return predict(docs, fit(docs.where(~held_out), model, **fit_options), keep=keep)
