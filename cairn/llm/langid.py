"""Language ID by a linear-chain conditional random field over the words of a text.

Words are runs of letters (not of other word characters, as ² or ½), lower-cased; a run of over 40 letters is several words in a row of
40 letters and the rest, so that every letter counts. A word's features are its prefixes and suffixes of up to
three bytes, its n-grams of two and three bytes with the word's borders, and the word itself
(the lexicon), hashed to a weight table; one transition matrix links the labels of neighbours.
The weights maximise the conditional likelihood of training sequences in which stretches of
documents of different languages follow each other, so that changes of language within a text
are learned too. Forward-backward gives each word's label probabilities; a document gets the
label with the largest mean, which is its score.

Training uses at most ``sample_docs`` labelled documents (those with the smallest hash of their
text and label, copies once), of each eight stretches of ``stretch`` words spread over the text. Each label gets
as many of them as the most frequent one has, its own repeated, or its even part of 40,000 if that
is less. Every document is then predicted from its whole text.

Edge cases: null text or one without letters: ``und``, score 0. Null lang: not used for training.
Without any labelled document all texts are ``und``. Ties go to the label that sorts first.
Only the text is an input of a prediction; extra columns are ignored; every row is predicted,
repeated ones too.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import mapped, release, remainder, small_batches, table
from cairn.llm.segments import mix

BUCKETS = 1 << 16
#: Pieces that train a model, the same number for each label.
PIECES = 40_000
UNKNOWN = "und"
#: Signs that Python's \\w has beside letters, digits and the underscore, such as \u00b2 and \u00bd.
_SIGNS = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: A longer run of letters is several words.
LONGEST = 40
_WORD = re.compile(rf"[^\W\d_{_SIGNS}]{{1,{LONGEST}}}")
#: Values of one array (words by labels) while training: sequences go through forward-backward so many at a time.
PART = 1 << 19
#: Characters whose words are looked up together, and batches judged side by side.
SLICE = 1 << 20
TOGETHER = 10
_U = np.uint64


def letter_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' features, and whose each is (ascending).

    Features are a word's prefixes and suffixes of two to four bytes, its n-grams of two and three, and the word itself, over its
    UTF-8 bytes between borders.
    """
    framed = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    n = np.array([len(x) for x in framed], np.int64)
    data = np.frombuffer(b"".join(framed) + bytes(4), np.uint8).astype(np.uint64)
    begin = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    left = np.repeat(begin + n, n) - np.arange(len(word))  # bytes from here to the word's end
    code, codes = np.zeros(len(word), np.uint64), {}
    for k in range(4):
        code = code | data[k : k + len(word)] << _U(8 * k)
        codes[k + 1] = code
    found, owner = [], []

    def add(values: np.ndarray, of: np.ndarray, kind: int) -> None:
        found.append((mix(values + (_U(kind) << _U(40))) & _U(BUCKETS - 1)).astype(np.int64))
        owner.append(of)

    for k in (2, 3, 4):
        some = np.flatnonzero(n > k)
        add(codes[k][begin[some]], some, k)
        add(codes[k][begin[some] + n[some] - k], some, 8 + k)
        if k < 4:
            at = np.flatnonzero(left >= k)
            add(codes[k][at], word[at], 16 + k)
    place = np.arange(len(word)) - begin[word]
    if len(n):
        add(np.add.reduceat(mix(data[: len(word)] + (place.astype(np.uint64) << _U(8))), begin), np.arange(len(n)), 32)
    flat, of = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found, owner))
    by = np.argsort(of, kind="stable")
    return flat[by], of[by]


def _scores(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's features."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.add.reduceat(weights[flat], begin, axis=0)


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((c.isalpha() for c in map(chr, range(0x110000))), bool, 0x110000)


def words_of(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What letter_words() gives of each text, all at once.

    The lower-cased texts in a row, where each word begins in it and its length, its hash, and where each text's words begin.
    """
    low = [(t or "").lower() for t in texts]
    joined = "\n".join(low)
    ends = np.cumsum([len(t) + 1 for t in low])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    begin, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    parts = -(-size // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, size = np.repeat(begin, parts) + nth * LONGEST, np.minimum(np.repeat(size, parts) - nth * LONGEST, LONGEST)
    if not len(begin):
        return joined, begin, size, np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    hashes = mix(np.add.reduceat(mix(points[np.repeat(begin, size) + place].astype(np.uint64) | (place.astype(np.uint64) << _U(24))), first) + size.astype(np.uint64))
    return joined, begin, size, hashes, np.concatenate([[0], np.searchsorted(begin, ends)])


def forward_backward(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """emission (T, D, L), positive. Marginals (T, D, L, zero after the end), pair sums (L, L), log partition."""
    T, D, L = emission.shape
    alpha, scale = np.empty_like(emission), np.ones((T, D), emission.dtype)
    for t in range(T):
        a = (start if t == 0 else alpha[t - 1] @ transition) * emission[t]
        s = a.sum(1)
        alpha[t], scale[t] = a / s[:, None], s
    live = np.arange(T)[:, None] < length[None, :]
    beta, marginal, pairs = np.ones((D, L), emission.dtype), np.empty_like(emission), np.zeros((L, L))
    for t in range(T - 1, -1, -1):
        m = alpha[t] * beta
        marginal[t] = m / m.sum(1, keepdims=True) * live[t][:, None]
        if t:
            back = emission[t] * beta
            inside = live[t][:, None]
            pairs += (alpha[t - 1] * inside).T @ (back / (scale[t][:, None])) * transition
            beta = np.where(inside, back @ transition.T, 1)
            beta /= np.where(live[t], scale[t], 1)[:, None]
    return marginal, pairs, (np.log(scale) * live).sum()


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, L)
    transition: np.ndarray  # log scores (L, L)
    #: Hashes of words seen (ascending), the row of each in ``rows``, and their emissions.
    seen: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    rows: np.ndarray | None = None
    most: int = 400_000

    def _emissions(self, words: list[str]) -> np.ndarray:
        out = [np.empty((0, len(self.labels)), np.float32)]
        for k in range(0, len(words), 20_000):
            e = _scores(self.weights, *_table(words[k : k + 20_000]))
            out.append(np.exp(e - e.max(1, keepdims=True)).astype(np.float32).clip(1e-6))
        return np.concatenate(out)

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word, and where each text's words begin."""
        # some SLICE characters at a time
        ends = np.cumsum([len(t) if t else 0 for t in texts])
        cuts = np.searchsorted(ends, np.arange(SLICE, (int(ends[-1]) if len(ends) else 0) + SLICE, SLICE)).tolist()
        got = [self._numbered(texts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(texts)]) if b > a]
        if not got:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate([n for n, _ in got]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in got]))])

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        joined, begin, size, hashes, at = words_of(texts)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.isin(distinct, self.seen, assume_unique=True)
        if not known.all():
            new = first[~known]
            made = self._emissions([joined[b : b + n] for b, n in zip(begin[new].tolist(), size[new].tolist())])
            place = np.arange(len(self.seen), len(self.seen) + len(new), dtype=np.int32)
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
            seen, place = np.concatenate([self.seen, distinct[~known]]), np.concatenate([self.place, place])
            order = np.argsort(seen)
            self.seen, self.place = seen[order], place[order]
        return self.place[np.searchsorted(self.seen, distinct)][which.reshape(-1)] if len(distinct) else np.empty(0, np.int32), at

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Mean label probabilities of each text's words; zeros without words."""
        return self.judged([texts])[0][0]

    def judged(self, parts: list[list[str | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts, shares and the mean over each text's words of their largest probability; zeros without words.

        Texts of all lists that are of similar length go through forward-backward side by side.
        """
        if len(self.seen) > self.most:
            self.seen, self.place, self.rows = np.empty(0, np.uint64), np.empty(0, np.int32), None
        numbers, at = zip(*[self._numbers(p) for p in parts])
        begin = np.concatenate([a[:-1] + sum(len(n) for n in numbers[:k]) for k, a in enumerate(at)])
        length, numbers = np.concatenate([np.diff(a) for a in at]), np.concatenate(numbers)
        out, sure = np.zeros((len(length), len(self.labels))), np.zeros(len(length))
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        a = np.exp(self.transition - self.transition.max()).astype(np.float32)
        start, k = np.full(len(self.labels), 1 / len(self.labels), np.float32), 0
        while k < len(order):
            # texts of similar length together, at most twice as long as the first and half a million words in all
            first, end = length[order[k]], k + 1
            while end < len(order) and length[order[end]] <= max(64, 2 * first) and (end - k + 1) * length[order[end]] <= 500_000:
                end += 1
            group, k = order[k:end], end
            T = int(length[group[-1]])
            e = np.ones((T, len(group), len(self.labels)), np.float32)
            for j, d in enumerate(group):
                e[: length[d], j] = self.rows[numbers[begin[d] : begin[d] + length[d]]]
            marginal = forward_backward(e, a, start, length[group])[0]
            out[group] = marginal.sum(0, dtype=np.float64) / length[group][:, None]
            sure[group] = marginal.max(2).sum(0, dtype=np.float64) / length[group]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return list(zip(np.split(out, cuts), np.split(sure, cuts)))


def train(rows: list[tuple[str, str]], stretch: int = 40, steps: int = 40, seed: int = 5) -> Model:
    """rows: (text, label)."""
    labels = sorted({y for t, y in rows if letter_words(t)})
    L, rng = len(labels), np.random.default_rng(seed)
    pieces: list[tuple[list[str], int]] = []
    once: dict[str, str] = {}  # each word is held once, however often it occurs
    for text, y in rows:
        if not (w := letter_words(text)):
            continue
        begins = range(0, len(w), stretch)
        for k in range(min(len(begins), 8)):  # spread evenly over the text
            i = begins[k * len(begins) // min(len(begins), 8)]
            pieces.append(([once.setdefault(x, x) for x in w[i : i + stretch]], labels.index(y)))
    if not pieces:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    index: dict[str, int] = {}
    # every label weighs the same, whatever its share of the documents
    by = [[p for p in pieces if p[1] == k] for k in range(L)]
    level = max(1, min(max(map(len, by)), PIECES // L))
    # of a label with more pieces than that, some from all of its documents
    pieces = [b[i % len(b) if len(b) <= level else i * len(b) // level] for b in by for i in range(level)]
    order = rng.permutation(len(pieces))
    group = 4
    T, D = stretch * group, -(-len(pieces) // group)
    ids, gold, length = np.zeros((T, D), np.int32), np.zeros((T, D), np.int32), np.zeros(D, np.int64)
    for k in range(D):
        w, y = [], []
        for p in order[k * group : (k + 1) * group]:
            w += pieces[p][0]
            y += [pieces[p][1]] * len(pieces[p][0])
        ids[: len(w), k] = [index.setdefault(x, len(index)) for x in w]
        gold[: len(w), k], length[k] = y, len(w)
    flat, owner = _table(list(index))
    live = np.arange(T)[:, None] < length[None, :]
    truth_pairs = np.zeros((L, L))
    np.add.at(truth_pairs, (gold[:-1][live[1:]], gold[1:][live[1:]]), 1)
    weights, transition = np.zeros((BUCKETS, L)), np.eye(L)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transition), np.zeros_like(transition)]
    start, words = np.full(L, 1 / L), live.sum()
    gold_at = np.stack([np.bincount(ids[live & (gold == k)], minlength=len(index)) for k in range(L)], 1).astype(np.float64)
    side = max(1, PART // (T * L))
    for step in range(1, steps + 1):
        score = _scores(weights, flat, owner)
        score = np.exp(score - score.max(1, keepdims=True)).clip(1e-6)
        g, pairs = gold_at.copy(), np.zeros((L, L))
        for k in range(0, D, side):
            own, there = ids[:, k : k + side], live[:, k : k + side]
            marginal, found, _ = forward_backward(np.where(there[:, :, None], score[own], 1), np.exp(transition), start, length[k : k + side])
            pairs += found
            g -= np.stack([np.bincount(own[there], marginal[:, :, y][there], len(index)) for y in range(L)], 1)
        grad = np.stack([np.bincount(flat, g[owner, k], BUCKETS) for k in range(L)], 1) / words - 1e-6 * weights
        grad_t = (truth_pairs - pairs) / words - 1e-6 * transition
        for w, d, m, v in ((weights, grad, *state[:2]), (transition, grad_t, *state[2:])):
            m += 0.1 * (d - m)
            v += 0.05 * (d * d - v)
            w += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-8)
    return Model(labels, weights.astype(np.float32), transition)


def fit(labelled: DataFrame, sample_docs: int = 2000) -> Model:
    """labelled has text and lang; at most sample_docs of its distinct rows are read to the driver."""
    some = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").withColumn("k", F.xxhash64("text", "lang"))
    # only hashes are sorted; then the rows up to the last one are read, copies once
    last = some.select("k").distinct().orderBy("k").limit(sample_docs).agg(F.max("k")).first()[0]
    part = [] if last is None else some.where(F.col("k") <= last).dropDuplicates(["text", "lang"]).limit(sample_docs).collect()
    release(labelled.sparkSession)  # the driver trains, beside its JVM
    return train(sorted((r["text"], r["lang"]) for r in part))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred and lang_score; every column kept."""
    data = documents.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transition))
    rows = documents.drop("lang_pred", "lang_score")

    def start() -> Callable:
        labels, weights, transition = data.value
        held = Model(labels, weights, transition)

        def each(batches: list[pa.RecordBatch]) -> list[dict]:
            if not labels:
                return [{"lang_pred": [UNKNOWN] * len(b), "lang_score": [0.0] * len(b)} for b in batches]
            out = []
            for share, _ in held.judged([b.column("text").to_pylist() for b in batches]):
                best = share.argmax(1)
                score = share[np.arange(len(share)), best]
                out.append({"lang_pred": [labels[b] if s > 0 else UNKNOWN for b, s in zip(best, score)], "lang_score": score.clip(0, 1)})
            return out

        return each

    return mapped(rows, start, {"lang_pred": "string", "lang_score": "double"}, rows.columns, TOGETHER)


def keep_known(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """documents without those that have no letters or whose words' likeliest labels have a mean probability below ``least``.

    So a text in several languages stays if each word's language is clear.
    Without any label to learn from nothing is known of languages, and all documents stay.
    """
    if not model.labels:
        return documents
    data = documents.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transition))

    def start() -> Callable:
        held = Model(*data.value)

        def each(batches: list[pa.RecordBatch]) -> list[tuple[dict, np.ndarray]]:
            return [({}, (sure > 0) & (sure >= least)) for _, sure in held.judged([b.column("text").to_pylist() for b in batches])]

        return each

    return mapped(documents, start, {}, documents.columns, TOGETHER)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
