"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded words, normalised by length, with exception phrases.

Folding maps homoglyphs and accents to plain letters, digits and signs to the letters they stand for, and drops what
is no letter; a word with other punctuation inside counts by its parts as well. The lexicon is learned: word beginnings,
and pairs of words, whose log odds of occurring in a toxic document are high. A phrase of a match and its neighbour
that is seen mostly in documents that are not toxic makes an exception. A logistic curve turns the weights' sum and
the sum per 100 words into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import RollingHash, discard, materialise, renamed, steps, string_buffers, tidy, white_cuts, words_of
from .fingerprints import shingle_hashes

#: Labelled rows that the model is fitted on at most (those with the smallest hash of their id); what it learns is bounded by them alone.
SAMPLE_ROWS = 20_000
#: Letters of the shortest beginning that may be a term, and of the longest but for whole words.
SHORTEST, LONGEST = 3, 14
LEAST_WEIGHT = 3.0
#: About the log of the number of candidate terms: fewer than one is expected to pass by chance.
LEAST_SURPRISE = 12.0
#: The same for pairs of words: edited copies of a toxic text share its pairs, so a pair needs many more documents than a word (65 where one in ten is toxic).
LEAST_PAIR_SURPRISE = 150.0
# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("абвгдеёзикмнорстухѕіјԁԛԝһӏαβγεηικνορτυχω", "abbrdeeeukmhopctyxsijdqwhlabyenikvoptuxw", strict=True))
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}


ENDS = "!|.,;:?\"'()[]{}<>*_-"


class Letters(dict):
    """For str.translate(): letters for code points, nothing for what is no letter, and with parted a blank for punctuation; line feeds are blanks."""

    def __init__(self, parted: bool):
        super().__init__({10: " "})
        self.parted = parted

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        c = DIGITS.get(c, HOMOGLYPHS.get(c, c))
        self[point] = out = c if c.isalpha() else " " if self.parted and unicodedata.category(c)[0] in "PSZ" else None
        return out


JOINED, PARTED = Letters(False), Letters(True)
#: Ends of the words of lines of one word that hold a sign which stands for a letter inside words.
HEAD, TAIL = re.compile(rf"\n[{re.escape(ENDS)}]*[!|][{re.escape(ENDS)}]*"), re.compile(rf"[!|][{re.escape(ENDS)}]*(?=\n)")


def fold(word: str) -> str:
    """Lower case, compatibility form, no accents, homoglyphs and digits as letters, all else dropped.

    Signs at the ends are punctuation, not letters, unless they are @ or $."""
    return forms(word)[0]


@lru_cache(maxsize=1 << 16)
def forms(word: str) -> list[str]:
    """The folded word; behind it its folded parts, where inner punctuation that stands for no letter parts it."""
    ascii_ = word.isascii()
    if ascii_ and word.isalpha():
        return [word.lower()]
    word = word.strip(ENDS).lower()
    plain = word if ascii_ else unicodedata.normalize("NFKD", word)
    parts = plain.translate(PARTED).split()
    return [plain.translate(JOINED), *parts] if len(parts) > 1 else [parts[0] if parts else ""]


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Forms of the distinct words of the ranges, and the number of each range's word."""
    keys = RollingHash(data).of(starts, ends)
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    whole = data.tobytes()
    return [forms(whole[a:b].decode("utf-8", "replace")) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], at


def running(names: list[list[str]], number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded words of rows one after the other, with the parts of a word in its place, and where each row's begin."""
    parts = [x[1:] or x for x in names]
    sizes = np.array([len(x) for x in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = sizes[number]
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = np.array([w for x in parts for w in x], object)
    return flat[np.repeat(begin[number] - ends[:-1], n) + np.arange(int(ends[-1]))] if len(number) else flat[:0], ends[first]


def _counts(terms_of: Callable, wanted: Callable[[int], bool] = lambda label: True):
    """Documents of the sample with and without the label that hold each of terms_of(forms, numbers, first) for each row."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        rows = [0, 0]
        for batch in batches:
            labels = batch.column(1).to_pylist()
            data, offsets = string_buffers(batch.column(0))
            for i, j in steps(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = words_of(part, at)
                names, number = _folded(part, starts, ends)
                for k, terms in enumerate(terms_of(names, number, first)):
                    rows[labels[i + k]] += 1
                    if wanted(labels[i + k]):
                        (toxic if labels[i + k] else clean).update(terms)
                if len(toxic) + len(clean) > 100_000:
                    yield _counted(toxic, clean, [0, 0])
                    toxic, clean = Counter(), Counter()
        yield _counted(toxic, clean, rows)

    return run


def beginnings(names: list[list[str]], number: np.ndarray, first: np.ndarray):
    """For each row the beginnings of its folded words, and those words."""
    heads = [[w[:k] for w in forms_ for k in (*range(SHORTEST, min(len(w), LONGEST + 1)), len(w)) if k >= SHORTEST] for forms_ in names]
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield {t for n in set(number[a:b].tolist()) for t in heads[n]}


def phrases(names: list[list[str]], number: np.ndarray, first: np.ndarray, among: frozenset[str] | None = None):
    """For each row its pairs of neighbouring folded words, joined by a blank; of a given set if there is one."""
    words, at = running(names, number, first)
    for a, b in zip(at[:-1], at[1:], strict=True):
        row = words[a:b].tolist()
        found = {f"{x} {y}" for x, y in zip(row[:-1], row[1:], strict=True) if x and y}
        yield found if among is None else found & among


def _counted(toxic: Counter, clean: Counter, rows: list[int]) -> pa.RecordBatch:
    terms = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array([*terms, None], pa.string()), pa.array([*(toxic[t] for t in terms), rows[1]], pa.int64()), pa.array([*(clean[t] for t in terms), rows[0]], pa.int64())],
        names=["term", "toxic", "clean"],
    )


def worth(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, least: float = LEAST_SURPRISE) -> dict[str, float]:
    """Log odds of the terms that have high ones and are unlikely to have them by chance."""
    odds = lambda t, c: math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((c + 0.5) / (n_clean - c + 0.5))
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)

    def surprise(t: int, c: int) -> float:
        """Log of how unlikely it is that so many of a term's documents are toxic by chance (Chernoff's bound)."""
        p = t / (t + c)
        return (t + c) * (p * math.log(p / rate) + (1 - p) * math.log(max(1 - p, 1e-12) / (1 - rate))) if p > rate else 0.0

    return {x: w for x, (t, c) in counts.items() if (w := odds(t, c)) >= LEAST_WEIGHT and surprise(t, c) >= least}


def closed_terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The lexicon: beginnings with high log odds, as long as they lose few documents, without those that a shorter entry covers."""
    weight = worth(counts, n_toxic, n_clean)
    longer: dict[str, list[str]] = {}
    for x in weight:
        longer.setdefault(x[:-1], []).append(x)
    kept: dict[str, float] = {}
    for x in sorted(weight, key=lambda x: (len(x), x)):
        if any(x[:k] in kept for k in range(SHORTEST, len(x))):
            continue
        while ext := [y for y in longer.get(x, ()) if counts[y][0] >= 0.9 * counts[x][0]]:
            x = min(ext)
        if len(x) == SHORTEST and counts[x][0] < 20:
            continue
        kept[x] = weight[x]
    return kept


class Lexicon:
    """An automaton of ' term' over folded words that are joined by blanks: a term matches where a word begins.

    A term is the beginning of a word, or a word and behind a blank the beginning of the next one.
    """

    def __init__(self, weights: dict[str, float], exceptions: frozenset[tuple[str, str]] = frozenset(), curve: tuple = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.machine = None
        self.rows = 0  # that it was fitted on

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "machine": None, "rows": self.rows}

    def build(self) -> None:
        if self.machine is None and self.weights:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self.machine.add_word(" " + t, (w, t))
            self.machine.make_automaton()

    def match(self, words: list[str]) -> dict[int, tuple[float, str]]:
        """For each word at which a term begins the largest weight, and its term."""
        text, found = " " + " ".join(words), {}
        for end, hit in self.machine.iter(text):
            k = text.count(" ", 0, end - len(hit[1]) + 1) - 1
            if k not in found or hit > found[k]:
                found[k] = hit
        return found

    def hopeful(self, words: list[bytes]) -> bool:
        """Whether a term may match in a row of words: their text is folded as a whole, once parted and once not, and searched."""
        text = "\n" + b"\n".join(words).decode("utf-8", "replace") + "\n"
        if "!" in text or "|" in text:
            text = TAIL.sub("", HEAD.sub("\n", text))
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFKD", text)
        parted = " " + " ".join(text.translate(PARTED).split())
        return next(self.machine.iter(parted), None) is not None or next(self.machine.iter(text.translate(JOINED)), None) is not None

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str, str, str]]]:
        """For each row: sum of weights, words; and the matches as (row, term, word before, word after).

        The automaton runs over each row's words, with the parts of a word in its place. A word none of whose parts
        matches counts if it does so as a whole. Rows in whose text it finds nothing are not looked at word by word.
        """
        sums, counts, found = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64), []
        self.build()
        near = []
        for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            cuts, last, hit = white_cuts(data, a, b), [], False
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                words = data[x:y].tobytes().split()  # at the six characters
                counts[r] += len(words)
                hit = hit or bool(self.weights and words and self.hopeful(last + words))
                last = words[-1:] or last
            if hit:
                near.append(r)
        if near:
            size = np.diff(offsets)[near]
            at = np.concatenate([[0], np.cumsum(size)])
            part = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in near])
            sums[near], found = self.measure_words(part, at)
            found = [(near[r], *rest) for r, *rest in found]
        return sums, counts, found

    def measure_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str, str, str]]]:
        """Sums and matches of measure(), word by word."""
        sums, found = np.zeros(len(offsets) - 1), []
        for i, j in steps(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = words_of(part, at)
            if not len(starts):
                continue
            names, number = _folded(part, starts, ends)
            words, begin = running(names, number, first)
            wholes = {n: hit for n, x in enumerate(names) if len(x) > 1 for hit in self.match(x[:1]).values()}
            marked = np.zeros(len(names), bool)
            marked[list(wholes)] = True
            each = np.array([max(1, len(x) - 1) for x in names])[number]
            place = np.cumsum(each) - each  # of each word's first part
            for r in range(j - i):
                row = words[begin[r] : begin[r + 1]].tolist()
                hits = [(k, k + 1 + t.count(" "), w, t) for k, (w, t) in self.match(row).items()]
                for k in (np.flatnonzero(marked[number[first[r] : first[r + 1]]]) + first[r]).tolist() if wholes else ():
                    a = int(place[k] - begin[r])
                    b = a + int(each[k])
                    if not any(a <= h[0] < b for h in hits):
                        hits.append((a, b, *wholes[int(number[k])]))
                for a, b, w, t in sorted(hits):
                    before, after = row[a - 1] if a else "", row[b] if b < len(row) else ""
                    found.append((i + r, t, before, after))
                    if (before, t) not in self.exceptions and (t, after) not in self.exceptions:
                        sums[i + r] += w
        return sums, found

    @staticmethod
    def features(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(sums)), np.log1p(sums), np.log1p(sums * 100 / np.maximum(counts, 100))], 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums, counts, _ = self.measure(data, offsets)
        return 1 / (1 + np.exp(-np.clip(self.features(sums, counts) @ np.array(self.curve), -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple:
    """Weights by Newton's method with a small penalty; slopes are kept at 0 or above, so more matches never lower a score."""
    free = [0, 1, 2]
    while True:
        w = np.zeros(len(free))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ w, -40, 40)))
            g = x[:, free].T @ (p - y) + ridge * w
            h = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + ridge * np.eye(len(free))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        below = [f for f, v in zip(free, w, strict=True) if f and v < 0]
        if not below:
            return tuple(float(dict(zip(free, w, strict=True)).get(k, 0.0)) for k in range(3))
        free = [f for f in free if f not in below]


def held_out(ident) -> F.Column:
    """True for the fifth of ids on which nothing is learned; a null id counts as the id ''."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def one_of_copies(sample: DataFrame) -> DataFrame:
    """_text and _toxic of sample (at most SAMPLE_ROWS labelled rows) without near copies, which say the same thing again.

    Rows of one label that share their least shingle meet the one of them with the smallest id, and go only if their
    sets have Jaccard 0.75 or more with its set.
    """
    group = Window.partitionBy("_least", "_toxic").orderBy("doc_id", F.xxhash64("_text"), "_text")
    sample = sample.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_least", F.array_min(shingle_hashes(F.col("_text"))))
    sample = sample.withColumn("_first", F.first("_text").over(group)).withColumn("_rank", F.row_number().over(group))

    def near(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["a"], pair["b"]))
        return 100 * both >= 75 * (F.size(pair["a"]) + F.size(pair["b"]) - both)

    pair = F.array(F.struct(shingle_hashes(F.col("_text")).alias("a"), shingle_hashes(F.col("_first")).alias("b")))
    copy = F.when(F.col("_rank") == 1, F.lit(False)).when(F.col("_text") == F.col("_first"), F.lit(True)).otherwise(F.exists(pair, near))
    return sample.filter(~copy).select("_text", "_toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Fit a lexicon on at most SAMPLE_ROWS labelled rows outside the held-out fifth; only texts and labels are used.

    Labels without an id or a mark are left out; an id with several marks is toxic if one of them says so, and each of
    several rows with one id counts. Null text counts as empty. Without rows nothing matches and all texts are clean.
    Other columns are ignored.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text")).join(F.broadcast(marks), "doc_id").select("_text", "_toxic", "doc_id"), "toxic-sample")
    learned = materialise(one_of_copies(sample), "toxic-learned")
    discard(sample)
    sample = learned.repartition(learned.sparkSession.sparkContext.defaultParallelism)

    def counted(run: Callable, least: str) -> dict[str, tuple[int, int]]:
        counts = sample.mapInArrow(tidy(run), "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        return {r[0]: (r[1], r[2]) for r in counts.filter(f"term IS NULL OR {least}").collect()}

    found = counted(_counts(beginnings), "toxic >= 4 AND toxic > 4 * clean")
    n_toxic, n_clean = found.pop(None, (0, 0))
    weights = closed_terms(found, n_toxic, n_clean)
    # Pairs of words: those of toxic rows, without a word that says it alone, are counted in all rows.
    alone = lambda w: any(w[:k] in weights for k in range(SHORTEST, len(w) + 1))
    some = counted(_counts(phrases, bool), "toxic >= 4")
    some.pop(None, None)
    among = frozenset(x for x in some if not any(map(alone, x.split())))
    if among:
        found = counted(_counts(lambda *row: phrases(*row, among)), "toxic >= 4 AND toxic > 4 * clean")
        found.pop(None, None)
        weights |= worth(found, n_toxic, n_clean, LEAST_PAIR_SURPRISE)
    weights = dict(sorted(weights.items()))
    plain = Lexicon(weights)

    def matches(batches):
        for batch in batches:
            _, _, hits = plain.measure(*string_buffers(batch.column(0)))
            labels_ = batch.column(1).to_pylist()
            pairs = Counter((a, b, labels_[r]) for r, t, before, after in hits for a, b in ((before, t), (t, after)) if a and b)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in pairs], pa.string()), pa.array([k[1] for k in pairs], pa.string()), pa.array([k[2] for k in pairs], pa.int32()), pa.array(list(pairs.values()), pa.int64())], names=["a", "b", "toxic", "n"])

    around = sample.mapInArrow(tidy(matches), "a string, b string, toxic int, n bigint").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"))
    exceptions = frozenset((r["a"], r["b"]) for r in around.filter("c >= 3 AND c > 3 * t").collect())
    model = Lexicon(weights, exceptions)

    def features(batches):
        for batch in batches:
            sums, words, _ = model.measure(*string_buffers(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array(words), batch.column(1)], names=["s", "w", "toxic"])

    rows = sorted(sample.mapInArrow(tidy(features), "s double, w bigint, toxic int").collect())  # at most SAMPLE_ROWS; in one order, so that sums are the same
    discard(learned)
    model.rows = len(rows)
    if rows:
        s, w, y = (np.array(x, float) for x in zip(*rows, strict=True))
        model.curve = logistic(Lexicon.features(s, w), y)
    else:
        model.curve = (-2.0, 1.0, 0.0)
    return model


def toxicity_scores(docs: DataFrame, model: Lexicon) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null text counts as empty and scores as clean as any text without matches. Null and repeated ids are rows like
    others; a null id is held out as the id ''. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text"))

    def score(batches):
        for batch in batches:
            scores = model.scores(*string_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.mapInArrow(tidy(score), "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; each row is judged by its own text, whatever its id.

    Null text counts as empty and stays. Columns of any name pass through; an empty table gives no rows.
    """
    model = learn(docs, labels)
    at, plain = docs.columns.index("text"), renamed(docs)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*string_buffers(batch.column(at))) < 0.5))

    return plain.mapInArrow(tidy(keep), plain.schema).toDF(*docs.columns)
